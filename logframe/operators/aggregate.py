"""Grouped aggregation, date buckets and chart series."""

from __future__ import annotations

from typing import Literal

from pyspark.sql import Column, DataFrame, functions as F

from logframe.functions import dates, values
from logframe.schema import DATE, ROW_ID, Field, field_of, has_row_id

# The name of the group of missing cells, and the longest series per chart kind.
EMPTY_GROUP = "(empty)"
SERIES_LIMITS = {"bar": 40, "line": 100, "pie": 8}

AGGREGATIONS = ("count", "sum", "avg", "min", "max")


def dimension(f: Field, bucket: str = "none") -> tuple[Column, callable]:
    """What to group by, and how to name a group afterwards.

    Native values are grouped as they are and named once per group, not once per row.
    """
    empty = F.lit(EMPTY_GROUP)
    if f.type == DATE and bucket != "none":
        label = lambda start: dates.bucket_label(start, bucket)
        start = dates.bucket_start(values.instant(f), bucket)
        if not f.is_text:
            return start, lambda key: F.coalesce(label(key), empty)
        return F.coalesce(label(start), values.text(f), empty), lambda key: key
    key, native = values.group_key(f)
    if native:
        return key, lambda k: F.coalesce(values.native_text(k, f.stored), empty)
    return F.coalesce(key, empty), lambda k: k


def measure_column(df: DataFrame, agg: str, measure: str | None) -> Column:
    if agg not in AGGREGATIONS:
        raise ValueError(f"unknown aggregation {agg!r}")
    f = field_of(df, measure) if measure else None
    return F.lit(None).cast("double") if f is None else values.num(f)


def reduce_measure(agg: str, m: Column) -> Column:
    """The aggregate of a group; a group without a usable measure gives 0."""
    if agg == "count":
        return F.count("*")
    return F.coalesce(getattr(F, agg)(m), F.lit(0.0))


def _grouped(df: DataFrame, dim: str, agg: str, measure: str | None, bucket: str) -> DataFrame:
    f = field_of(df, dim)
    if f is None:
        return df.sparkSession.createDataFrame([], "name string, value double, _first bigint")
    key, label = dimension(f, bucket)
    m = measure_column(df, agg, measure)
    first = F.min(ROW_ID) if has_row_id(df) else F.lit(0)
    out = df.groupBy(key.alias("_key")).agg(reduce_measure(agg, m).alias("value"), first.alias("_first"))
    return out.select(label(F.col("_key")).alias("name"), "value", "_first")


def group_aggregate(
    df: DataFrame, dim: str, agg: str = "count", measure: str | None = None, bucket: str = "none"
) -> DataFrame:
    """One row per category of ``dim``: its name and the aggregate of ``measure``.

    Cells of the measure that are no numbers are left out. ``bucket`` (hour, day, week, month)
    applies to date columns.
    """
    return _grouped(df, dim, agg, measure, bucket).select("name", "value")


def chart_series(
    df: DataFrame,
    dim: str,
    agg: str = "count",
    measure: str | None = None,
    bucket: str = "none",
    kind: str = "bar",
    limit: int | None | Literal["chart"] = "chart",
) -> DataFrame:
    """The series a chart shows: largest first for bar and pie, by name for line.

    By default it is cut off as a chart of that kind is; ``limit=None`` gives every category.

    Equal values keep the order in which their categories first appear (``_row_id``), or the
    order of their names when the table has no row order.
    """
    grouped = _grouped(df, dim, agg, measure, bucket)
    if kind == "line":
        # A column, because a sort evaluates an expression in every comparison.
        grouped = grouped.withColumn("_natural", values.natural_key(F.col("name")))
        order = [F.asc("_natural"), F.asc("name")]
    else:
        order = [F.desc("value"), F.asc("_first"), F.asc("name")]
    ordered = grouped.orderBy(*order)
    most = SERIES_LIMITS[kind] if limit == "chart" else limit
    return (ordered if most is None else ordered.limit(most)).select("name", "value")


def group_total(df: DataFrame, dim: str, bucket: str = "none") -> DataFrame:
    """Number of categories before a series is cut off."""
    return _grouped(df, dim, "count", None, bucket).agg(F.count("*").alias("group_count"))
