"""What the operators of this folder share: intermediate tables, word splitting, fold numbers."""

from __future__ import annotations

import atexit
import contextlib
import pathlib
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from logframe.session import scratch_dir

#: A word is a run of characters that are none of space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
_CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_left: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _delete_left() -> None:
    for spark, path in _left:
        with contextlib.suppress(Exception):  # the session may have ended already
            _delete(spark, path)


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a finished write are of no more use: the written table replaces them."""
    before = spark.conf.get(_CLEAN_SHUFFLES, None)
    spark.conf.set(_CLEAN_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEAN_SHUFFLES)
        else:
            spark.conf.set(_CLEAN_SHUFFLES, before)


class Scratch:
    """Intermediate tables of one operator call, in the shared folder of ``spark.checkpoint.dir``.

    ``save`` writes a table and reads it back: its lineage ends there, and what depends on the
    layout (numbers, names) stays fixed when an executor is lost. ``drop`` deletes a table that no
    later step reads; the rest goes when the session's Python process ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, scratch_dir(spark)
        _left.append((spark, self.root))

    def save(self, df: DataFrame, name: str, *, partition_by: str | None = None) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        writer = df.write.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        with _shuffles_dropped(self.spark):
            writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # for drop()
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            _delete(self.spark, table._scratch_path)


def fold(id_column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in no fold (null)."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % folds


def held_out(id_column: str, folds: int) -> Column:
    """Rows of fold 0. A null id is never held out."""
    return F.coalesce(fold(id_column, folds) == 0, F.lit(False))


_sent_to: set[str] = set()


def _send_package(spark: SparkSession) -> None:
    """Let Spark hand this package to the Python workers, which need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _sent_to:
        return
    top = pathlib.Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="logframe-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/logframe.zip", "w") as out:
        for path in sorted(top.rglob("*.py")):
            out.write(path, path.relative_to(top.parent))
    context.addPyFile(f"{folder}/logframe.zip")
    _sent_to.add(context.applicationId)


def send_package(spark: SparkSession) -> None:
    _send_package(spark)


def numbered(scratch: Scratch, df: DataFrame, order: list[str], within: list[str], name: str, total: str) -> DataFrame:
    """``df`` with each row's number from 0 by ascending ``order`` among those equal in ``within``, and their ``total``.

    ``order`` begins with ``within``, holds no nulls there, and decides ties. Rows are dealt by ranges of
    ``order``, sorted and written with their place; the counts by partition, one row for each run of
    ``within`` in it, then turn places into numbers. So a third of all rows under one key spreads over tasks.
    """
    by = [F.col(c).asc_nulls_first() for c in order]
    put = {"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}
    placed = scratch.save(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumns(put), "placed")
    runs = placed.groupBy("_part", *within).agg(F.count("*").alias("_rows"), F.min("_place").alias("_first"))
    every = Window.partitionBy(*within)
    earlier = every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select("_part", *within, "_first", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"), F.sum("_rows").over(every).alias(total))
    out = placed.join(scratch.save(starts, "starts"), ["_part", *within])
    return out.withColumn(name, F.col("_start") + F.col("_place") - F.col("_first")).drop("_part", "_place", "_first", "_start")


def map_arrow(df: DataFrame, rows, schema: str) -> DataFrame:
    """``mapInArrow`` with batches bounded in bytes, as a few texts may be very long."""
    spark = df.sparkSession
    _send_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return df.mapInArrow(rows, schema)


def slices(texts: list[str], most: int, overlap: int = 0) -> Iterator[list[tuple[int, str]]]:
    """Texts as (index, piece) in lists of about ``most`` characters.

    A longer text is cut into pieces; each begins with the last ``overlap`` characters of the one before.
    """
    batch, size = [], 0
    for i, text in enumerate(texts):
        start = 0
        while True:
            piece = text[start : start + most]
            batch.append((i, piece))
            size += len(piece)
            if size >= most:
                yield batch
                batch, size = [], 0
            if start + most >= len(text):
                break
            start += most - overlap
    if batch:
        yield batch
