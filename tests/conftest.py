import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession, types as T  # noqa: E402

import logframe as lf  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield lf.configure(session)
    session.stop()


@pytest.fixture(scope="session")
def table(spark):
    """A raw text table: ``table("level:string code:number", [("INFO", "200"), …])``."""

    def build(columns: str, rows, row_id: bool = True):
        spec = [c.split(":") for c in columns.split()]
        schema = T.StructType([T.StructField("_row_id", T.LongType())] + [T.StructField(k, T.StringType()) for k, _ in spec])
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)
        df = lf.with_types(df, dict(spec))
        return df if row_id else df.drop("_row_id")

    return build


def ids(df):
    return [r["_row_id"] for r in df.collect()]


def rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
