"""Cross-tabulation of two columns with totals, capped axes and numeric ranges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from logframe.functions import values
from logframe.functions.ranges import Ranges, readable_ranges
from logframe.operators.aggregate import measure_column
from logframe.schema import NUMBER, Field, field_of, fields_of
from logframe.session import materialize

# Distinct values per axis, and the name of the group that takes the rest.
AXIS_LIMIT = 20
OTHERS = "(others)"

_INFINITY = float("inf")


def default_axes(df: DataFrame) -> tuple[str, str]:
    """The axes of a cross table nobody has set up: the first two columns."""
    keys = [f.key for f in fields_of(df)]
    return keys[0], keys[min(1, len(keys) - 1)]


def crosstab(
    df: DataFrame,
    row: str,
    col: str,
    agg: str = "count",
    measure: str | None = None,
    row_bucket: bool = False,
    col_bucket: bool = False,
) -> DataFrame | None:
    """Long cross table: one row per cell, row total, column total and the grand total.

    Columns: ``row_value`` and ``col_value`` (NULL where totalled) with their places ``row_at``
    and ``col_at``; ``level``; ``value``; on ranged axes the bounds ``row_low`` … ``col_high``;
    ``row_others`` / ``col_others`` mark the collected rest of an axis with more than 20 values.
    Rows with a blank in either column are left out; empty cells are 0. Totals come from the rows,
    so an average total is a true average. An unknown column gives None.

    The rows are read once: they are reduced to one row per pair of values, with its count, sum and
    number of measured cells, and written. The axes, 20 entries each at most, are looked up in these
    pairs, as ``DataFrame.pivot`` does with its values; cells, totals and the collected rest add them
    up.
    """
    if agg not in ("count", "sum", "avg"):
        raise ValueError(f"unknown aggregation {agg!r}")
    fields = {"row": field_of(df, row), "col": field_of(df, col)}
    if None in fields.values():
        return None
    ranged = {
        side: wanted and fields[side].type == NUMBER
        for side, wanted in (("row", row_bucket), ("col", col_bucket))
    }
    filled = ~values.is_blank(fields["row"]) & ~values.is_blank(fields["col"])
    keyed = df.filter(filled).select(
        *(
            (values.num(f) if ranged[side] else values.group_key(f)[0]).alias(side)
            for side, f in fields.items()
        ),
        measure_column(df, agg, measure).alias("m"),
    )
    pairs = materialize(keyed.groupBy("row", "col").agg(F.count("*").alias("n"), F.sum("m").alias("s"), F.count("m").alias("k")))
    axes = _axes(pairs, fields, ranged)

    placed = pairs
    for axis in axes.values():
        placed = axis.place(placed)
    cells = placed.groupBy("row_at", "col_at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("k").alias("k"))
    totals = cells.cube("row_at", "col_at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("k").alias("k"))
    value = {
        "count": F.col("n").cast("double"),
        "sum": F.col("s"),
        "avg": F.col("s") / F.nullif("k", F.lit(0)),
    }[agg]
    sums = totals.select(
        F.coalesce("row_at", F.lit(-1)).alias("row_at"),
        F.coalesce("col_at", F.lit(-1)).alias("col_at"),
        value.alias("value"),
    )
    return (
        _grid(df, axes)
        .join(F.broadcast(sums), ["row_at", "col_at"], "left")
        .withColumn("value", F.coalesce("value", F.lit(0.0)))
        .select(*_COLUMNS)
    )


@dataclass(frozen=True)
class _Axis:
    side: str
    stored: T.DataType
    kept: list[tuple]  # (value, text) of a value axis
    others: bool
    ranges: Ranges | None

    def entries(self) -> list[tuple]:
        """(at, value, low, high, others) of every entry, and the total at place -1."""
        if self.ranges:
            out = [(i, self.ranges.label(i), *self.ranges.bounds(i), False) for i in range(self.ranges.count)]
        else:
            out = [(i, text, None, None, False) for i, (_, text) in enumerate(self.kept)]
        if self.others:
            out.append((len(out), OTHERS, None, None, True))
        return [*out, (-1, None, None, None, False)]

    def place(self, t: DataFrame) -> DataFrame:
        """Add the place of every row on this axis, leaving out rows that have none."""
        c, at = F.col(self.side), f"{self.side}_at"
        if self.ranges:
            return t.filter(F.abs(c) < _INFINITY).withColumn(at, self.ranges.index(c))
        schema = T.StructType([T.StructField("_v", self.stored), T.StructField(at, T.IntegerType())])
        lookup = t.sparkSession.createDataFrame([(v, i) for i, (v, _) in enumerate(self.kept)], schema)
        joined = t.join(F.broadcast(lookup), c == F.col("_v"), "left" if self.others else "inner").drop("_v")
        return joined.fillna(len(self.kept), [at]) if self.others else joined


def _axes(pairs: DataFrame, fields: dict[str, Field], ranged: dict[str, bool]) -> dict[str, _Axis]:
    """Both axes in one job: the two lookups are subqueries of a single row."""
    lookups = {
        side: _span(pairs, side) if ranged[side] else _frequent(pairs, side, fields[side]) for side in fields
    }
    found = pairs.sparkSession.range(0, 1, 1, 1).select(*(q.alias(side) for side, q in lookups.items())).first()
    out = {}
    for side, f in fields.items():
        stored = T.StringType() if f.is_text else f.stored
        if ranged[side]:
            low, high = found[side]
            ranges = None if low is None else readable_ranges(low, high)
            out[side] = _Axis(side, stored, [], False, ranges)
        else:
            values_ = [(e["v"], e["text"]) for e in found[side]]
            others = len(values_) > AXIS_LIMIT
            out[side] = _Axis(side, stored, values_[: AXIS_LIMIT - 1] if others else values_, others, None)
    return out


def _frequent(pairs: DataFrame, side: str, f: Field) -> Column:
    """The most frequent values, one more than an axis holds, as a small array."""
    text = F.col("v") if f.is_text else values.native_text(F.col("v"), f.stored)
    top = (
        pairs.groupBy(F.col(side).alias("v"))
        .agg(F.sum("n").alias("n"))
        .select("v", (-F.col("n")).alias("n"), text.alias("text"))
        .withColumn("natural", values.natural_key(F.col("text")))
        .orderBy("n", "natural", "text")
        .limit(AXIS_LIMIT + 1)
    )
    return top.agg(F.array_sort(F.collect_list(F.struct("n", "natural", "text", "v")))).scalar()


def _span(pairs: DataFrame, side: str) -> Column:
    """Smallest and largest finite number."""
    c = F.col(side)
    finite = F.when(F.abs(c) < _INFINITY, c)
    return pairs.agg(F.struct(F.min(finite).alias("low"), F.max(finite).alias("high"))).scalar()


_COLUMNS = [
    "row_at", "col_at", "row_value", "col_value", "level", "value",
    "row_low", "row_high", "col_low", "col_high", "row_others", "col_others",
]


def _grid(df: DataFrame, axes: dict[str, _Axis]) -> DataFrame:
    """Every pair of entries, totals included: 21 x 21 at most."""
    schema = (
        "row_at int, row_value string, row_low double, row_high double, row_others boolean, "
        "col_at int, col_value string, col_low double, col_high double, col_others boolean, level string"
    )
    level = {(True, True): "cell", (True, False): "row_total", (False, True): "col_total", (False, False): "grand"}
    rows = [
        (*r, *c, level[r[0] >= 0, c[0] >= 0])
        for r in axes["row"].entries()
        for c in axes["col"].entries()
    ]
    return df.sparkSession.createDataFrame(rows, schema)


def pivot_wide(long: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The cells as a grid: one row per row value, one column per column value.

    Without ``columns`` the axis, 20 values at most, is looked up first.
    """
    cells = long.filter(F.col("level") == "cell")
    if columns is None:
        axis = cells.select("col_at", "col_value").distinct().orderBy("col_at").collect()
        columns = [r["col_value"] for r in axis]
    return cells.groupBy("row_value").pivot("col_value", columns).agg(F.first("value"))


def largest_cell(long: DataFrame) -> DataFrame:
    """The largest cell, 0 at least."""
    top = F.greatest(F.coalesce(F.max("value"), F.lit(0.0)), F.lit(0.0))
    return long.filter(F.col("level") == "cell").agg(top.alias("max"))
