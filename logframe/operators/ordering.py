"""Sort, top rows, pages and row positions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from logframe.functions import values
from logframe.schema import BOOLEAN, NUMBER, ROW_ID, Field, all_of, fields_of, has_row_id
from logframe.session import materialize

#: Distinct values, as estimated, and characters up to which a text column is sorted by a dictionary.
DICTIONARY, DICTIONARY_CHARS = 20_000, 2_000_000

#: The keyset index of a page: ranges of one step, rows sampled for their bounds, and rows that are sorted in the end.
RANGES, SAMPLED, RANGE_ROWS = 12, 1024, 100_000


def sort_columns(f: Field) -> list[Column]:
    """Ascending sort columns for one key.

    Numbers and booleans compare by value, text by locale with embedded numbers by value. In a
    raw number or boolean column the cells that did not parse follow, as text.
    """
    if not f.is_text:
        return [values.num(f) if isinstance(f.stored, (T.DoubleType, T.FloatType)) else f.col]
    if f.type == NUMBER:
        n = values.num(f)
        return [n, F.when(n.isNull(), values.natural_key(values.text(f)))]
    if f.type == BOOLEAN:
        b = values.flag(f)
        return [b, F.when(b.isNull(), values.natural_key(values.text(f)))]
    return [values.natural_key(values.text(f))]


def sort_order(df: DataFrame, keys: Iterable, places: Mapping[str, str] | None = None) -> list[tuple[Column, str]]:
    """Sort columns and directions for (key, direction) pairs; unknown keys are skipped.

    ``places`` names, by key, columns with the place of a value in its column's order.
    """
    known, places = {f.key: f for f in fields_of(df)}, places or {}
    order = []
    for spec in keys:
        key, direction = (spec["columnKey"], spec["direction"]) if isinstance(spec, Mapping) else spec
        if key in known:
            columns = [F.col(places[key])] if key in places else sort_columns(known[key])
            order += [(c, direction) for c in columns]
    if order:
        # The row position decides ties. Without one the partition of the input does, so that the
        # range partitioning of the sort can split a value that a large part of the rows share.
        order.append((F.col(ROW_ID) if has_row_id(df) else F.spark_partition_id(), "asc"))
    return order


def ordered(df: DataFrame, order: Sequence[tuple[Column, str]]) -> DataFrame:
    """Sort by computed columns, missing ones last in both directions.

    The sort columns are projected first: a sort evaluates an expression anew in every comparison.
    """
    keys = {f"_sort{i}": c for i, (c, _) in enumerate(order)}
    turns = [
        F.col(k).asc_nulls_last() if direction == "asc" else F.col(k).desc_nulls_last()
        for k, (_, direction) in zip(keys, order)
    ]
    return df.withColumns(keys).orderBy(*turns) if order else df


def multi_sort(df: DataFrame, keys: Iterable) -> DataFrame:
    """Rows sorted by the keys in priority order; without a known key the base order stays.

    Missing cells come last in both directions. The original row position decides ties.

    Text is collated once per distinct value where a column has few: those values are sorted first,
    at once, and rows then sort by the place of their value. A sketch of the distinct values decides;
    a column with many is collated row by row.
    """
    keys = [(spec["columnKey"], spec["direction"]) if isinstance(spec, Mapping) else spec for spec in keys]
    ranked, places = _ranked(df, [key for key, _ in keys])
    order = sort_order(ranked, keys, places)
    return ordered(ranked, order).select(*df.columns)


def _ranked(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with the place of each text value in the order of its column, and the name of that by key.

    Values that the order does not tell apart share a place. The size of a dictionary is checked
    before it is broadcast: fewer than twice DICTIONARY values, and DICTIONARY_CHARS characters at most.
    """
    chosen = [f for f in fields_of(df) if f.key in set(keys) and f.is_text and f.type not in (NUMBER, BOOLEAN)]
    if not chosen:
        return df, {}
    seen = df.agg(*(F.approx_count_distinct(f.col, 0.1).alias(f"n{i}") for i, f in enumerate(chosen))).first()
    out, places = df, {}
    for i, f in enumerate(chosen):
        if seen[f"n{i}"] > DICTIONARY:
            continue
        distinct = df.select(values.text(f).alias("v")).filter("v IS NOT NULL").distinct().limit(2 * DICTIONARY)
        at = F.dense_rank().over(W.orderBy(values.natural_key(F.col("v"))))
        words = [tuple(r) for r in distinct.select("v", at.alias("at")).collect()]
        if len(words) >= 2 * DICTIONARY or sum(len(w) for w, _ in words) > DICTIONARY_CHARS:
            continue
        name = f"_place{i}"
        dictionary = df.sparkSession.createDataFrame(words, f"_word{i} string, {name} int")
        out = out.join(F.broadcast(dictionary), values.text(f) == F.col(f"_word{i}"), "left").drop(f"_word{i}")
        places[f.key] = name
    return out, places


def top_k(df: DataFrame, keys: Iterable, n: int) -> DataFrame:
    """First rows of the sorted table."""
    return ordered(df, sort_order(df, keys)).limit(n).select(*df.columns)


def page(df: DataFrame, keys: Sequence, offset: int, n: int) -> DataFrame:
    """A window of rows of the sorted table.

    The order is total at every depth, so pages fit together: the row position decides ties, and
    after it the values of all columns; rows equal in all of these are interchangeable.

    A page is placed by a keyset index: bounds taken from a sample cut the order into ranges, one
    pass counts the rows of each, and only the ranges that hold the page are looked at further, until
    they hold few rows. Only keys are read on the way, no row is copied or moved, and what is sorted
    in the end is bounded. The index is looked up at once, the page itself is lazy.
    """
    if n <= 0:
        return df.limit(0)
    order, few = _total_order(df, keys)
    names = [f"_key{i}" for i in range(len(order))]
    bare = df.select(*(c.alias(k) for k, (c, _) in zip(names, order)))
    ranges, before, held = None, 0, bare.count()
    for depth in dict.fromkeys((few, len(order))):  # all columns only where many rows share the given keys
        ranges, before, held = _place(bare, order[:depth], names[:depth], offset, offset + n, ranges, before, held)
    rows = df.withColumns(dict(zip(names, (c for c, _ in order))))
    chosen = rows if ranges is None else rows.filter(ranges)
    return chosen.orderBy(*_turns(order, names)).offset(offset - before).limit(n).select(*df.columns)


def _total_order(df: DataFrame, keys: Sequence) -> tuple[list[tuple[Column, str]], int]:
    """Sort columns that leave only equal rows tied, and how many of them are the given keys and the row position."""
    known = {f.key: f for f in fields_of(df)}
    pairs = [(spec["columnKey"], spec["direction"]) if isinstance(spec, Mapping) else spec for spec in keys]
    order = [(c, direction) for key, direction in pairs if key in known for c in sort_columns(known[key])]
    if has_row_id(df):
        order.append((F.col(ROW_ID), "asc"))
    every = order + [(f.col, "asc") for f in known.values()]
    return every, len(order)


def _turns(order: Sequence[tuple[Column, str]], names: Sequence[str]) -> list[Column]:
    return [F.col(k).asc_nulls_last() if direction == "asc" else F.col(k).desc_nulls_last() for k, (_, direction) in zip(names, order)]


def _carried(c: Column, kind: T.DataType) -> Column:
    """A key in a form that comes to the driver and back unchanged."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp"))
    return F.unix_date(c) if isinstance(kind, T.DateType) else c


def _constant(value, kind: T.DataType) -> Column:
    """A key brought back as a constant of its own type."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.timestamp_micros(F.lit(value)).cast(kind)
    if isinstance(kind, T.DateType):
        return F.date_from_unix_date(F.lit(value))
    if isinstance(kind, T.StringType):
        return F.lit(value) if kind.collation == "UTF8_BINARY" else F.collate(F.lit(value), kind.collation)
    return F.lit(value).cast(kind)


class _Bound:
    """A place in the order: the keys of a row, to compare rows with."""

    def __init__(self, values: Sequence, kinds: Sequence[T.DataType], order: Sequence[tuple[Column, str]], names: Sequence[str]):
        self.parts = [(F.col(k), None if v is None else _constant(v, kind), direction) for v, kind, (_, direction), k in zip(values, kinds, order, names)]

    def before(self) -> Column:
        """Whether a row comes before this place. Missing keys come last."""
        out = F.lit(False)
        for c, v, direction in reversed(self.parts):
            if v is None:
                first, same = c.isNotNull(), c.isNull()
            else:
                first, same = F.coalesce(c < v if direction == "asc" else c > v, F.lit(False)), F.coalesce(c == v, F.lit(False))
            out = first | (same & out)
        return out

    def at(self) -> Column:
        return all_of(c.isNull() if v is None else F.coalesce(c == v, F.lit(False)) for c, v, _ in self.parts)


def _place(
    bare: DataFrame, order: Sequence[tuple[Column, str]], names: Sequence[str], start: int, end: int, inside: Column | None, before: int, rows: int
) -> tuple[Column | None, int, int]:
    """Which rows hold the places from ``start`` to ``end`` of the order, how many come before these, and how many they are.

    Begins with the ``rows`` rows ``inside`` and ends with few of them, or with rows equal in ``order``.
    """
    kinds = [bare.schema[k].dataType for k in names]
    while order and rows > max(RANGE_ROWS, 2 * (end - start)):
        held = bare if inside is None else bare.filter(inside)
        sample = held.sample(min(1.0, SAMPLED / rows), seed=7).orderBy(*_turns(order, names))
        taken = [tuple(r) for r in sample.select(*(_carried(F.col(k), kind) for k, kind in zip(names, kinds))).collect()]
        cut = sorted({len(taken) * k // RANGES for k in range(1, RANGES)}) if taken else []
        bounds = [_Bound(v, kinds, order, names) for v in dict.fromkeys(taken[i] for i in cut)]
        if not bounds:
            return inside, before, rows
        # Ranges by number: 2 i before the i-th bound, 2 i + 1 at it, 2 * len(bounds) after the last.
        counts = dict(held.groupBy(_range_of(bounds, 0, len(bounds)).alias("r")).agg(F.count("*").alias("n")).collect())
        first = last = None
        low, seen = before, before
        for r in range(2 * len(bounds) + 1):
            here = counts.get(r, 0)
            if here and seen < end and seen + here > start:
                first, low = (r, seen) if first is None else (first, low)
                last = r
            seen += here
        if first is None:  # beyond the end of the table
            return F.lit(False), start, 0
        narrowed = all_of(x for x in (inside, _from(bounds, first), _to(bounds, last)) if x is not None)
        held_rows = sum(counts.get(r, 0) for r in range(first, last + 1))
        inside, before = narrowed, low
        stuck = held_rows == rows or (first == last and first % 2)  # no narrower range, or rows equal in every key
        rows = held_rows
        if stuck:
            break
    return inside, before, rows


def _range_of(bounds: Sequence[_Bound], low: int, high: int) -> Column:
    """Number of a row's range, found by halving."""
    if low == high:
        return F.lit(2 * low)
    mid = (low + high) // 2
    return F.when(bounds[mid].before(), _range_of(bounds, low, mid)).when(bounds[mid].at(), 2 * mid + 1).otherwise(_range_of(bounds, mid + 1, high))


def _from(bounds: Sequence[_Bound], r: int) -> Column | None:
    if r == 0:
        return None
    return ~bounds[r // 2].before() if r % 2 else ~(bounds[r // 2 - 1].before() | bounds[r // 2 - 1].at())


def _to(bounds: Sequence[_Bound], r: int) -> Column | None:
    if r == 2 * len(bounds):
        return None
    return bounds[r // 2].before() | bounds[r // 2].at() if r % 2 else bounds[r // 2].before()


def with_position(df: DataFrame, order: Sequence[tuple[Column, str]], name: str = "position") -> DataFrame:
    """Number the rows 0, 1, … in the given order without gathering them in one task.

    The range-sorted rows are written once with their partition and place in it; the partition
    sizes, one row per partition, turn that place into a position in the table.
    """
    place = {"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}
    sorted_rows = materialize(ordered(df, order).select(*df.columns).withColumns(place))
    sizes = sorted_rows.groupBy("_part").agg(F.count("*").alias("n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    place = F.col("_place") - F.shiftleft(F.col("_part").cast("bigint"), 33)
    return (
        sorted_rows.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + place)
        .drop("_part", "_place", "_start")
    )
