"""Several tables side by side: shared columns, overlaid aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, functions as F

from logframe.functions import values
from logframe.operators.aggregate import AGGREGATIONS, dimension, measure_column
from logframe.operators.predicates import filter_all
from logframe.schema import FILE, NUMBER, ROW_ID, Field, describe, field_of, fields_of, has_row_id

# Fixed value: categories an overlay shows.
MAX_CATEGORIES = 60


def labels(names: Sequence[str]) -> list[str]:
    """Unique labels for file names: a repeat gets the lowest number that no other table's label has."""
    out: list[str] = []
    for name in names:
        numbered = (f"{name} ({k})" for k in count(2))
        out.append(name if name not in out else next(x for x in numbered if x not in out and x not in names))
    return out


def common_columns(tables: Sequence[DataFrame], numeric: bool = False) -> list[Field]:
    """Columns every table has, in the first table's order; with ``numeric``, numbers everywhere."""
    if not tables:
        return []
    by_key = [{f.key: f for f in fields_of(t)} for t in tables]
    return [
        f
        for f in by_key[0].values()
        if all(f.key in d for d in by_key) and (not numeric or all(d[f.key].type == NUMBER for d in by_key))
    ]


def align_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One long table of the shared columns, tagged with each row's table in ``_file``.

    Columns stored differently are aligned as text with the first table's logical type.
    """
    shared = common_columns(list(tables.values()))

    def columns(t: DataFrame) -> list[Column]:
        out = []
        for f in shared:
            own = field_of(t, f.key)
            same = all(field_of(o, f.key).stored == f.stored for o in tables.values())
            out.append(own.col if same else describe(values.text(own), f.key, f.type, f.name))
        return out

    return reduce(
        DataFrame.unionByName,
        (t.select(F.lit(name).alias(FILE), *columns(t)) for name, t in tables.items()),
    )


def overlay(
    tables: Mapping[str, DataFrame],
    dim: str | None = None,
    agg: str = "count",
    measure: str | None = None,
    bucket: str = "none",
    kind: str = "bar",
    filters: Mapping[str, Sequence] | None = None,
    limit: int | None = MAX_CATEGORIES,
) -> DataFrame:
    """One row per category of a shared column, one column per table, 0 where a table has none.

    ``filters`` holds each table's own conditions. A dimension or measure the tables do not share
    falls back to the first shared one. Ordered by the total over all tables (bar) or by name
    (line); ``limit=None`` keeps every category. All tables meet in one shuffle of partial
    aggregates; categories that all tables store alike are named afterwards, once each.
    """
    if agg not in AGGREGATIONS:
        raise ValueError(f"unknown aggregation {agg!r}")
    frames = list(tables.values())
    shared = [f.key for f in common_columns(frames)]
    numeric = [f.key for f in common_columns(frames, numeric=True)]
    if not shared:
        raise ValueError("the tables share no column")
    dim = dim if dim in shared else shared[0]
    measure = None if agg == "count" else measure if measure in numeric else next(iter(numeric), None)

    stored = {(field_of(t, dim).stored, field_of(t, dim).type) for t in frames}
    named_later = len(stored) == 1
    _, name_of = dimension(field_of(frames[0], dim), bucket)

    def tagged(i: int, name: str) -> DataFrame:
        t = filter_all(tables[name], (filters or {}).get(name, ()))
        key, label = dimension(field_of(t, dim), bucket)
        return t.select(
            (key if named_later else label(key)).alias("name"),
            measure_column(t, agg, measure).alias("m"),
            F.lit(i).alias("t"),
            (F.col(ROW_ID) if has_row_id(t) else F.lit(0)).cast("bigint").alias("r"),
        )

    rows = reduce(DataFrame.union, (tagged(i, name) for i, name in enumerate(tables)))

    def series(i: int) -> Column:
        own = F.col("t") == i
        if agg == "count":
            return F.count_if(own)
        return F.coalesce(getattr(F, agg)(F.when(own, F.col("m"))), F.lit(0.0))

    grouped = rows.groupBy("name").agg(
        *(series(i).alias(f"_s{i}") for i in range(len(frames))),
        *(F.min(F.when(F.col("t") == i, F.col("r"))).alias(f"_f{i}") for i in range(len(frames))),
    )
    if named_later:
        grouped = grouped.withColumn("name", name_of(F.col("name")))
    if kind == "line":
        grouped = grouped.withColumn("_natural", values.natural_key(F.col("name")))
        order = [F.asc("_natural"), F.asc("name")]
    else:
        total = reduce(Column.__add__, (F.col(f"_s{i}") for i in range(len(frames))))
        # Ties: as the categories first appear, reading the tables one after the other.
        order = [total.desc(), *(F.col(f"_f{i}").asc_nulls_last() for i in range(len(frames))), F.col("name")]
    ordered = grouped.orderBy(*order)
    cut = ordered if limit is None else ordered.limit(limit)
    return cut.select("name", *(F.col(f"_s{i}").alias(label) for i, label in enumerate(tables)))
