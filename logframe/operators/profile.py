"""Column profiles: counts, distinct values, histograms and most frequent values.

However many columns a profile covers, the table is read in one pass (top values: two). Each row
becomes its cells, as (column, value) in a common form, and a partial aggregate reduces these to the
distinct values of the task before anything is moved. Counts, extremes and sums then come from the
distinct values and their numbers.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from logframe.functions import values
from logframe.schema import NUMBER, ROW_ID, Field, fields_of, has_row_id

# Histogram bins, listed values, and the count above which distinct is "10,000+".
BINS = 12
TOP_VALUES = 5
DISTINCT_FLOOR = 10_000

#: Counters of a column's sketch of frequent values, and how many of the values it tracks it lists.
SKETCH, LISTED = 8192, 1000
#: Distinct values, as estimated, up to which a column is counted without a sketch: a partial aggregate reduces it enough.
MANY = 10_000


def _chosen(df: DataFrame, keys: Iterable[str] | None, numeric: bool | None = None) -> list[Field]:
    wanted = None if keys is None else set(keys)
    return [
        f
        for f in fields_of(df)
        if (wanted is None or f.key in wanted) and (numeric is None or (f.type == NUMBER) == numeric)
    ]


#: The forms a cell's value takes: one of them is set, none of a blank cell.
_FORMS = {"whole": "bigint", "real": "double", "word": "string"}


def _form(f: Field) -> tuple[str, Column]:
    """The common form of a cell with one value per distinct ``text(f)``, and in which of the three it is."""
    c, _ = values.group_key(f)
    if isinstance(f.stored, (T.IntegralType, T.BooleanType)):
        return "whole", c.cast("bigint")
    if isinstance(f.stored, T.DateType):
        return "whole", F.unix_date(c).cast("bigint")
    if isinstance(f.stored, T.TimestampType):
        return "whole", F.unix_micros(c)
    if isinstance(f.stored, (T.DoubleType, T.FloatType)):
        return "real", c.cast("double")
    return "word", c if f.is_text else c.cast("string")


def _original(f: Field) -> Column:
    """A value in its common form as the column's own type."""
    if isinstance(f.stored, T.DateType):
        return F.date_from_unix_date(F.col("whole").cast("int"))
    if isinstance(f.stored, T.TimestampType):
        return F.timestamp_micros("whole")
    return F.col(_form(f)[0]).cast(f.stored)


def _number(f: Field) -> Column:
    """A value in its common form as a number; NULL if it is none."""
    if f.is_text:
        return values.parse_number(F.col("word"))
    return F.nullif(F.col(_form(f)[0]).cast("double"), F.lit(float("nan")))


def _cells(df: DataFrame, chosen: list[Field], *also: str, only: dict[int, list] | None = None) -> DataFrame:
    """One row per cell: ``slot`` (the column's place in ``chosen``), its value in one of three forms, and ``also``.

    Of the columns in ``only`` the other values than those named are left blank.
    """

    def cell(slot: int, f: Field) -> Column:
        form, value = _form(f)
        if only and slot in only:
            value = F.when(value.isin(*only[slot]), value)
        return F.struct(F.lit(slot).alias("slot"), *((value if name == form else F.lit(None)).cast(kind).alias(name) for name, kind in _FORMS.items()))

    return df.select(*also, F.inline(F.array(*(cell(i, f) for i, f in enumerate(chosen)))))


def _by_slot(chosen: list[Field], build) -> Column:
    """``build(field)`` of the row's column; None stands for NULL. Columns with the same expression share a branch."""
    branches: dict[str, tuple[Column, list[int]]] = {}
    for i, f in enumerate(chosen):
        made = build(f)
        if made is not None:
            branches.setdefault(str(made), (made, []))[1].append(i)
    out = None
    for made, slots in branches.values():
        here = F.col("slot").isin(*slots)
        out = F.when(here, made) if out is None else out.when(here, made)
    return F.lit(None) if out is None else out


def _is_filled() -> Column:
    return F.col("whole").isNotNull() | F.col("real").isNotNull() | F.col("word").isNotNull()


def _labelled(df: DataFrame, chosen: list[Field], measured: DataFrame) -> DataFrame:
    """The columns with what was measured of each, one row a column at most, in the table's order."""
    labels = df.sparkSession.createDataFrame([(i, f.key, f.type) for i, f in enumerate(chosen)], "slot int, key string, type string")
    return labels.join(F.broadcast(measured), "slot", "left")


_STATS_SCHEMA = (
    "key string, type string, count bigint, null_count bigint, distinct_count bigint, "
    "min double, max double, mean double, sum double"
)


def column_stats(df: DataFrame, keys: Iterable[str] | None = None, approximate: bool = False) -> DataFrame:
    """One row per column: filled, blank and distinct cells, and for numbers min, max, mean, sum.

    Distinct counts are exact; ``approximate=True`` trades that for a pass without a shuffle of the
    values.
    """
    chosen = _chosen(df, keys)
    if not chosen:
        return df.sparkSession.createDataFrame([], _STATS_SCHEMA)
    return (_approximate_stats if approximate else _exact_stats)(df, chosen)


def _exact_stats(df: DataFrame, chosen: list[Field]) -> DataFrame:
    x = _by_slot(chosen, lambda f: _number(f) if f.type == NUMBER else None).cast("double")
    groups = _distinct(df, chosen).withColumns({"x": x, "filled": _is_filled()})
    n, x, filled = F.col("n"), F.col("x"), F.col("filled")
    count = lambda which: F.coalesce(F.sum(F.when(which, n)), F.lit(0)).cast("bigint")
    total = F.sum(x * n)
    measured = groups.groupBy("slot").agg(
        count(filled).alias("count"),
        count(~filled).alias("null_count"),
        F.count_if(filled).alias("distinct_count"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        (total / F.sum(F.when(x.isNotNull(), n))).alias("mean"),
        total.alias("sum"),
    )
    none = {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("count", "null_count", "distinct_count")}
    return _labelled(df, chosen, measured).withColumns(none).drop("slot")


def _distinct(df: DataFrame, chosen: list[Field]) -> DataFrame:
    """Distinct values by column with their number of cells ``n``."""
    return _cells(df, chosen).groupBy("slot", *_FORMS).agg(F.count("*").alias("n"))


def _approximate_stats(df: DataFrame, chosen: list[Field]) -> DataFrame:
    def of(f: Field, i: int) -> list[Column]:
        v = values.group_key(f)[0]
        x = values.parse_number(v) if f.is_text else F.nullif(v.cast("double"), F.lit(float("nan")))
        numbers = [F.min(x), F.max(x), F.avg(x), F.sum(x)] if f.type == NUMBER else [F.lit(None).cast("double")] * 4
        parts = [F.count(v), F.count_if(v.isNull()), F.approx_count_distinct(v), *numbers]
        names = ("count", "null_count", "distinct_count", "min", "max", "mean", "sum")
        return F.struct(F.lit(f.key).alias("key"), F.lit(f.type).alias("type"), *(p.alias(name) for p, name in zip(parts, names)))

    return df.agg(F.array(*(of(f, i) for i, f in enumerate(chosen))).alias("rows")).select(F.inline("rows"))


def distinct_counts(df: DataFrame, keys: Iterable[str] | None = None) -> DataFrame:
    """Distinct cells per column, and the bounded form shown as "10,000+"."""
    chosen = _chosen(df, keys)
    if not chosen:
        return df.sparkSession.createDataFrame([], "key string, distinct_count bigint, shown_count bigint, capped boolean")
    measured = _distinct(df, chosen).groupBy("slot").agg(F.count_if(_is_filled()).alias("distinct_count"))
    n = F.coalesce("distinct_count", F.lit(0).cast("bigint"))
    return _labelled(df, chosen, measured).select(
        "key",
        n.alias("distinct_count"),
        F.least(n, F.lit(DISTINCT_FLOOR).cast("bigint")).alias("shown_count"),
        (n > DISTINCT_FLOOR).alias("capped"),
    )


def histogram(df: DataFrame, keys: Iterable[str] | None = None, bins: int = BINS) -> DataFrame:
    """Equal bins between the smallest and largest number of each numeric column.

    The largest number belongs to the last bin; with one distinct number every row is in the
    first. A column without numbers gives no rows. The ends, one row, are looked up first, as
    ``DataFrame.pivot`` does with its values, so the counting pass compares with constants.
    """
    chosen = _chosen(df, keys, numeric=True)
    ends = _ends(df, chosen)
    chosen = [f for f in chosen if f.key in ends]
    schema = "slot int, key string, bin int, low double, high double"
    grid = [
        (i * bins + at, f.key, at, *bin_bounds(*ends[f.key], at, bins))
        for i, f in enumerate(chosen)
        for at in range(bins)
    ]
    grid_df = df.sparkSession.createDataFrame(grid, schema)
    if not chosen:
        return grid_df.select("key", "bin", "low", "high", F.lit(0).cast("bigint").alias("count"))

    # A cell becomes one whole number: which column, and which bin of it.
    slots = F.array(*((_bin_of(values.num(f), *ends[f.key], bins) + i * bins).cast("int") for i, f in enumerate(chosen)))
    counts = (
        df.select(F.explode(slots).alias("slot"))
        .filter("slot is not null")
        .groupBy("slot")
        .agg(F.count("*").alias("n"))
    )
    # Both sides hold at most one row per bin and column.
    return grid_df.join(F.broadcast(counts), "slot", "left").select(
        "key", "bin", "low", "high", F.coalesce("n", F.lit(0)).alias("count")
    )


def _ends(df: DataFrame, chosen: list[Field]) -> dict[str, tuple[float, float]]:
    """Smallest and largest number per column that has any."""
    if not chosen:
        return {}
    row = df.agg(
        *(F.min(values.num(f)).alias(f"low{i}") for i, f in enumerate(chosen)),
        *(F.max(values.num(f)).alias(f"high{i}") for i, f in enumerate(chosen)),
    ).first()
    found = {f.key: (row[f"low{i}"], row[f"high{i}"]) for i, f in enumerate(chosen)}
    return {key: pair for key, pair in found.items() if pair[0] is not None}


def _bin_of(v: Column, low: float, high: float, bins: int) -> Column:
    if low == high:
        return F.when(v.isNotNull(), 0)
    at = F.floor((v - low) / (high - low) * bins)
    return F.greatest(F.when(v.isNotNull(), 0), F.least(at, F.when(v.isNotNull(), bins - 1)))


def bin_bounds(low: float, high: float, index: int, bins: int = BINS) -> tuple[float, float]:
    """Ends of one bin; the last one closes at the largest value."""
    width = (high - low) / bins
    return low + index * width, high if index == bins - 1 else low + (index + 1) * width


_TOP_SCHEMA = "key string, value string, count bigint, share double, total bigint, others_count bigint"


def top_values(df: DataFrame, keys: Iterable[str] | None = None, n: int | None = TOP_VALUES) -> DataFrame:
    """Most frequent values of each non-numeric column, with their share and the rest's count; all with ``n=None``.

    Equal counts keep the order of first appearance (``_row_id``), or of the values without one.

    The table is read twice, and a third time if a column has many values. The first pass counts
    filled cells and estimates distinct ones; the next sketches the frequent values of the columns
    with many. Where the sketch's error bound proves which values can be among the first ``n``, the
    last pass counts only these, so that nothing else of the column is moved; of the other columns
    it counts every value. Counts are exact either way. All but the last pass run at once.
    """
    chosen = _chosen(df, keys, numeric=False)
    if not chosen:
        return df.sparkSession.createDataFrame([], _TOP_SCHEMA)
    totals, only = _frequent(df, chosen, n)
    also = [ROW_ID] if has_row_id(df) else []
    first = F.min(ROW_ID) if also else F.lit(0).cast("bigint")
    groups = _cells(df, chosen, *also, only=only).filter(_is_filled()).groupBy("slot", *_FORMS).agg(F.count("*").alias("count"), first.alias("_first"))
    total = _by_slot(chosen, lambda f: F.lit(totals[f.key]).cast("bigint"))
    shown = _by_slot(chosen, lambda f: F.col("word") if f.is_text else values.native_text(_original(f), f.stored))
    key = F.get(F.array(*(F.lit(f.key) for f in chosen)), F.col("slot"))
    count = F.col("count")
    if n is None:
        rest = F.lit(0).cast("bigint")
        return groups.select(key.alias("key"), shown.alias("value"), "count", (count / total).alias("share"), total.alias("total"), rest.alias("others_count"))
    # Each task passes on the first n of a column, so no column is gathered.
    order = W.partitionBy("slot").orderBy(F.desc("count"), "_first", "whole", "word")
    top = groups.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)
    rest = total - F.sum("count").over(W.partitionBy("slot"))
    named = top.select("slot", "place", key.alias("key"), shown.alias("value"), "count", (count / total).alias("share"), total.alias("total"), rest.alias("others_count"))
    return named.orderBy("slot", "place").drop("slot", "place")


def _frequent(df: DataFrame, chosen: list[Field], n: int | None) -> tuple[dict[str, int], dict[int, list]]:
    """Filled cells of each column, and for each column where that is proven the values that may be among the first n.

    A sketch of S counters has no count too low and none too high by more than 3.5 / S of the rows it
    has seen, merged sketches included; a value it does not list occurs no more often than that. With
    e for this error, the n-th count listed less e is a floor: n values occur that often at least. If
    the floor is above e, values that are not listed lie below it, and so do those listed below it.
    """
    sketch = lambda c: F.call_function("approx_top_k", c, F.lit(LISTED), F.lit(SKETCH * 3 // 4))
    forms = [_form(f)[1] for f in chosen]
    passed = [F.count(c).alias(f"t{i}") for i, c in enumerate(forms)]
    passed += [F.approx_count_distinct(c, 0.1).alias(f"d{i}") for i, c in enumerate(forms)]
    row = df.agg(F.count("*").alias("rows"), *passed).first()
    many = [i for i in range(len(chosen)) if n and row[f"d{i}"] > MANY]
    sketches = df.agg(*(sketch(forms[i]).alias(f"s{i}") for i in many)).first() if many else None
    error = 3.5 / SKETCH * row["rows"]
    only = {}
    for i in many:
        listed = [(x["item"], x["count"]) for x in sketches[f"s{i}"]]
        seen = [c for v, c in listed if v is not None]
        floor = seen[n - 1] - error if len(seen) >= n else 0
        if floor > error and (len(listed) < LISTED or listed[-1][1] < floor):
            only[i] = [v for v, c in listed if v is not None and c >= floor]
    return {f.key: row[f"t{i}"] for i, f in enumerate(chosen)}, only


def column_kinds(df: DataFrame) -> DataFrame:
    """How each column is profiled: by histogram, by values, or not at all when it has none."""
    chosen = fields_of(df)
    usable = [
        F.count(values.num(f) if f.type == NUMBER else values.blank_to_null(f.col) if f.is_text else f.col).alias(f"c{i}")
        for i, f in enumerate(chosen)
    ]
    rows = F.array(
        *(
            F.struct(
                F.lit(f.key).alias("key"),
                F.when(F.col(f"c{i}") == 0, "empty")
                .otherwise("numeric" if f.type == NUMBER else "categorical")
                .alias("kind"),
            )
            for i, f in enumerate(chosen)
        )
    )
    return df.agg(*usable).select(F.inline(rows))
