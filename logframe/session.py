"""Session defaults and shared scratch space."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    # Dates are compared as instants; one fixed zone makes text, buckets and filters agree.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

_local_scratch: str | None = None


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on."""
    for key, value in _DEFAULTS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    _widen_shuffles(spark)
    return spark


def _widen_shuffles(spark: SparkSession) -> None:
    """Start shuffles with several partitions per core where the default would be too few.

    Adaptive execution merges what turns out small. A number the user has set is left alone.
    """
    initial = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    if spark.conf.get("spark.sql.shuffle.partitions") == "200" and spark.conf.get(initial, None) is None:
        wanted = 4 * spark.sparkContext.defaultParallelism
        if wanted > 200:
            spark.conf.set(initial, str(wanted))


def scratch_dir(spark: SparkSession) -> str:
    """A fresh path in the shared folder named by ``spark.checkpoint.dir``.

    A machine-local folder is used only on a local master with the setting unset; on a cluster
    an unset folder is an error, because other executors could not read what one of them wrote.
    """
    global _local_scratch
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        if _local_scratch is None:
            _local_scratch = tempfile.mkdtemp(prefix="logframe-")
            atexit.register(shutil.rmtree, _local_scratch, ignore_errors=True)
        root = _local_scratch
    return f"{root.rstrip('/')}/logframe/{uuid.uuid4().hex}"


_written: list[tuple[SparkSession, str]] = []


@atexit.register
def _delete_written() -> None:
    for spark, path in _written:
        with contextlib.suppress(Exception):  # the session may have ended already
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to shared storage and read it back, cutting its lineage.

    Every later use reads the same files, so values that depend on the physical layout
    (partition numbers, row positions) stay fixed even when an executor is lost. The files are
    deleted when the session's Python process ends, as results may be read until then.
    """
    spark = df.sparkSession
    path = scratch_dir(spark)
    _written.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
