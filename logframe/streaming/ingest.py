"""Log files read as they arrive."""

from __future__ import annotations

import calendar
import datetime
from collections.abc import Iterator, Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import DataStreamReader, DataStreamWriter, StatefulProcessor

from logframe.functions import dates, values
from logframe.schema import Field, describe, field_of, ref, with_types
from logframe.sources import files
from logframe.sources.delimited import cut_by, described, read_delimited
from logframe.sources.headers import column_keys
from logframe.sources.inference import to_typed
from logframe.sources.logs import decoded, parse_log

# How long the windows of a bucket are, and where they start: the epoch was a Thursday. Months differ in length.
_WINDOWS = {"hour": ("1 hour", "0 seconds"), "day": ("1 day", "0 seconds"), "week": ("7 days", "4 days"), "month": ("1 day", "0 seconds")}


def _reader(spark: SparkSession, files_per_batch: int | None) -> DataStreamReader:
    reader = spark.readStream.option("pathGlobFilter", "*{" + ",".join(files.EXTENSIONS) + "}")
    return reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader


def ingest_stream(
    spark: SparkSession,
    folder: str,
    pattern: str,
    types: dict[str, str] | None = None,
    files_per_batch: int | None = None,
    encoding: str = "utf-8",
) -> DataFrame:
    """A stream of parsed log rows from the text files that appear in a folder.

    Types cannot be inferred before data arrives, nor can the encoding be detected, so they are
    given; other columns are strings.
    """
    lines = decoded(_reader(spark, files_per_batch), folder, encoding).select("value")
    return with_types(parse_log(lines, pattern), types or {})


def ingest_delimited_stream(
    spark: SparkSession,
    folder: str,
    header: Sequence[str],
    types: dict[str, str] | None = None,
    delimiter: str = ",",
    encoding: str = "utf-8",
    multi_line: bool = False,
    files_per_batch: int | None = None,
) -> DataFrame:
    """A stream of rows from the delimited files that appear in a folder, all under the given header.

    Each file's own first line is skipped. Cells are raw strings with the given types by column key.
    """
    keys = column_keys(header)
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(keys))])
    reader = cut_by(_reader(spark, files_per_batch), delimiter, encoding, multi_line).option("header", True)
    return with_types(described(reader.schema(schema).csv(folder), keys, encoding), types or {})


def append_delimited(
    spark: SparkSession,
    folder: str,
    path: str,
    checkpoint: str,
    columns: Sequence[str],
    types: Mapping[str, str] | None = None,
    files_per_batch: int = 1000,
) -> DataStreamWriter:
    """Append the delimited files that appear in a folder to a Parquet table, each under its own header.

    Delimiter, encoding, quoting and header of every file are found as ``read_delimited`` finds them:
    columns may come in any order, be missing (NULL) or be more than asked for (left out). The table
    has the columns with the given headers, typed by column key with ``types`` (else strings), and
    ``_file``. Files without a header row add nothing.

    The stream itself is one row per new file, of its path; no content is read for that. A batch
    reads its files, ``files_per_batch`` at most, and overwrites its own folder ``batch=<number>`` of
    the table, so a batch that is run again after a failure leaves its rows once.
    """
    keys = column_keys(columns)
    seen = _reader(spark, files_per_batch).format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)

    def add(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        # One row per file of the batch; Spark reports paths URL-encoded.
        arrived = sorted(unquote(r["path"]) for r in batch.filter("length > 0").select("path").collect())
        if not arrived:
            return
        try:
            rows = read_delimited(session, arrived, infer=False)
        except files.EmptyFile:
            return
        there = set(rows.columns)
        chosen = [describe(ref(key) if key in there else F.lit(None).cast("string"), key, (types or {}).get(key, "string"), name) for name, key in keys]
        to_typed(rows.select("_file", *chosen)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return seen.select("path", "length").writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)


def append_rows(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append the typed rows of a stream to a Parquet table, exactly once."""
    return (
        to_typed(stream)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )


def bucket_counts(stream: DataFrame, time: str, bucket: str, late: str = "1 hour", window: bool = False) -> DataFrame:
    """Rows per date bucket of a stream: ``name``, ``value``, and with ``window`` the ``window`` instead of the name.

    Buckets are closed once the latest time seen is ``late`` past their end; their state is then
    dropped, so it holds open buckets only. Rows without a time are left out. As months differ in
    length, a month comes as one row per closed day of it, which gives the days of open months too;
    ``month_counts`` gives one row per closed month.
    """
    f: Field | None = field_of(stream, time)
    if f is None:
        raise ValueError(f"no column {time!r}")
    if bucket not in _WINDOWS:
        raise ValueError(f"a stream is bucketed by {', '.join(_WINDOWS)}; not {bucket!r}")
    length, start = _WINDOWS[bucket]
    at = stream.select(values.instant(f).cast("timestamp").alias("at")).filter("at is not null")
    windows = at.withWatermark("at", late).groupBy(F.window("at", length, startTime=start)).agg(F.count("*").alias("value"))
    if window:
        return windows
    return windows.select(dates.bucket_label(F.col("window.start"), bucket).alias("name"), "value")


def _month_total() -> StatefulProcessor:
    class MonthTotal(StatefulProcessor):  # nested, so that it travels to the workers as it is
        """Adds up a month's closed days and hands the month over when the watermark has passed its end."""

        def init(self, handle) -> None:
            self.handle = handle
            self.total = handle.getValueState("total", "value long")

        def handleInputRows(self, key, rows, timerValues) -> Iterator:
            added = sum(int(frame["value"].sum()) for frame in rows)
            held = self.total.get()[0] if self.total.exists() else 0
            self.total.update((held + added,))
            year, month = map(int, key[0].split("-"))
            end = datetime.datetime(year + month // 12, month % 12 + 1, 1)
            self.handle.registerTimer(calendar.timegm(end.timetuple()) * 1000)
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
            import pandas as pd

            if self.total.exists():
                value = self.total.get()[0]
                self.total.clear()
                yield pd.DataFrame({"name": [key[0]], "value": [value]})

        def close(self) -> None:
            pass

    return MonthTotal()


_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def month_counts(stream: DataFrame, time: str, late: str = "1 hour") -> DataFrame:
    """Rows per calendar month of a stream: ``name``, ``value``, one row for each month that is closed.

    A month is closed once the latest time seen is ``late`` past its end. Days are counted first, with
    a partial aggregate, and a month is handed its closed days, 31 rows at most, so a month that gets
    all rows is no hot key. A timer at the end of the month makes it come out. For append mode; state
    with timers is kept in RocksDB, which this sets for the session.
    """
    days = bucket_counts(stream, time, "day", late, window=True)
    stream.sparkSession.conf.set(_STATE_STORE, _ROCKS)
    named = days.select(F.date_format("window.start", "yyyy-MM").alias("month"), F.window_time("window").alias("at"), "value")
    return named.groupBy("month").transformWithStateInPandas(
        _month_total(), outputStructType="name string, value long", outputMode="append", timeMode="EventTime"
    )
