"""Differences between two tables: columns, and rows matched by a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from logframe.functions import values
from logframe.operators.compare import common_columns
from logframe.schema import NUMBER, ROW_ID, Field, any_of, field_of, fields_of, has_row_id
from logframe.session import materialize

# Fixed value: rows listed per status.
SAMPLE = 20


def schema_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns by key: ``added``, ``removed``, ``changed`` type or ``unchanged``, from a to b."""
    spark = a.sparkSession
    side = lambda df: spark.createDataFrame(
        [(f.key, f.name, f.type) for f in fields_of(df)], "key string, name string, type string"
    )
    left, right = side(a).alias("a"), side(b).alias("b")
    status = (
        F.when(F.col("a.key").isNull(), "added")
        .when(F.col("b.key").isNull(), "removed")
        .when(F.col("a.type") != F.col("b.type"), "changed")
        .otherwise("unchanged")
    )
    return left.join(right, F.col("a.key") == F.col("b.key"), "full_outer").select(
        F.coalesce("a.key", "b.key").alias("key"),
        F.coalesce("a.name", "b.name").alias("name"),
        status.alias("status"),
        F.col("a.type").alias("from_type"),
        F.col("b.type").alias("to_type"),
    )


def row_diff(a: DataFrame, b: DataFrame, key: str | None = None) -> DataFrame | None:
    """Rows of two tables matched by ``key``, the first shared column by default.

    One row per key: ``key``, ``status`` (added, removed, changed, unchanged), ``changes`` (array
    of key, from, to for the shared columns that differ), ``duplicated`` and the position of the
    row in either table. Blank keys are left out, and of rows with the same key the first one
    counts. Blank cells are equal to each other, and cells are compared as text. A key that is
    missing from either table gives None.

    Keys are counted first, in a hash aggregate over the key and the position alone. Only the keys
    that a table repeats are kept, with the position of their first row; they are written, and each
    row of such a key other than the first drops out before any row is moved. So a table is dealt by
    key once, for the full outer join, and a hot key never meets in one task.
    """
    shared = common_columns([a, b])
    if key is None:
        key = next((f.key for f in shared), None)
    if key not in {f.key for f in shared}:
        return None
    pairs = [(f, field_of(b, f.key)) for f in shared if f.key != key]
    key_a, key_b = field_of(a, key), field_of(b, key)
    native = _same_storage(key_a, key_b)
    left = _first_rows(a, key_a, [p[0] for p in pairs], native).select(
        F.col("k").alias("ka"), F.col("row").alias("ra"), F.col("n").alias("na")
    )
    right = _first_rows(b, key_b, [p[1] for p in pairs], native).select(
        F.col("k").alias("kb"), F.col("row").alias("rb"), F.col("n").alias("nb")
    )
    joined = left.join(right, F.col("ka") == F.col("kb"), "full_outer")

    both = F.col("ka").isNotNull() & F.col("kb").isNotNull()
    # A struct per compared column, NULL where the cells agree; compact drops those.
    found = [_change(i, fa, fb) for i, (fa, fb) in enumerate(pairs)]
    changes = F.array_compact(F.array(*found)) if found else F.array().cast(_CHANGES)
    differs = any_of(~_same(i, fa, fb) for i, (fa, fb) in enumerate(pairs))
    status = (
        F.when(F.col("kb").isNull(), "removed")
        .when(F.col("ka").isNull(), "added")
        .when(differs if differs is not None else F.lit(False), "changed")
        .otherwise("unchanged")
    )
    merged = F.coalesce("ka", "kb")
    printed = values.native_text(merged, key_a.stored) if native and not key_a.is_text else merged
    return joined.select(
        printed.alias("key"),
        status.alias("status"),
        F.when(both, changes).otherwise(F.array().cast(_CHANGES)).alias("changes"),
        (F.coalesce("na", F.lit(0)) + F.coalesce("nb", F.lit(0)) > F.when(both, 2).otherwise(1)).alias("duplicated"),
        F.col("ra._at").alias("a_at"),
        F.col("rb._at").alias("b_at"),
    )


_CHANGES = "array<struct<key:string,from:string,to:string>>"


def _same_storage(a: Field, b: Field) -> bool:
    return a.stored == b.stored and a.type == b.type and not (a.is_text and a.type == NUMBER)


def _first_rows(df: DataFrame, key: Field, compared: list[Field], native: bool) -> DataFrame:
    """One row per key: the first by position, or the smallest when the table has no row order."""
    k = values.group_key(key)[0] if native else values.text(key)
    at = F.col(ROW_ID) if has_row_id(df) else F.lit(None).cast("bigint")
    keyed = df.filter(~values.is_blank(key))
    repeated = _repeated_keys(keyed.select(k.alias("k"), at.alias("at")))
    cells = [(values.text(f) if f.is_text else f.col).alias(f"c{i}") for i, f in enumerate(compared)]
    rows = keyed.select(k.alias("k"), F.struct(at.alias("_at"), *cells).alias("row"))
    if repeated is None:
        return rows.withColumn("n", F.lit(1).cast("bigint"))
    told = rows.join(repeated, F.col("k") == F.col("again"), "left")
    kept = told.filter(F.col("first").isNull() | (F.col("row._at") == F.col("first")))
    # What is left of a key without positions, or with a position twice: its smallest row. Each task passes on one.
    place = F.row_number().over(W.partitionBy("k").orderBy("row"))
    return kept.withColumn("place", place).filter("place = 1").select("k", "row", F.coalesce("n", F.lit(1).cast("bigint")).alias("n"))


def _repeated_keys(keys: DataFrame) -> DataFrame | None:
    """Keys that several rows share (``again``), with their number and first position; None if there are none.

    A table of its own, so that the join with the rows knows its size: a small one is broadcast by
    Spark, with a large one the rows of a hot key are split between tasks.
    """
    counted = keys.groupBy(F.col("k").alias("again")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    found = materialize(counted.filter("n > 1"))
    return None if found.isEmpty() else found


def _cell(side: str, i: int) -> Column:
    return F.col(f"{side}.c{i}")


def _cell_text(side: str, i: int, f: Field) -> Column:
    c = _cell(side, i)
    return c if f.is_text else values.native_text(c, f.stored)


def _same(i: int, fa: Field, fb: Field) -> Column:
    """Equal as text, blanks included; native columns of one type need no printing."""
    if fa.stored == fb.stored:
        return _cell("ra", i).eqNullSafe(_cell("rb", i))
    return _cell_text("ra", i, fa).eqNullSafe(_cell_text("rb", i, fb))


def _change(i: int, fa: Field, fb: Field) -> Column:
    return F.when(
        ~_same(i, fa, fb),
        F.struct(
            F.lit(fa.key).alias("key"),
            _cell_text("ra", i, fa).alias("from"),
            _cell_text("rb", i, fb).alias("to"),
        ),
    )


def changed_fields(diff: DataFrame) -> DataFrame:
    """Every differing field of every changed row, with both values."""
    return diff.filter(F.col("status") == "changed").select("key", F.inline("changes").alias("field", "from", "to"))


def diff_summary(diff: DataFrame) -> DataFrame:
    """The four counts, and whether any key is repeated in a table."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("added", "removed", "changed", "unchanged")]
    return diff.agg(*counts, F.coalesce(F.bool_or("duplicated"), F.lit(False)).alias("duplicate_keys"))


def diff_samples(diff: DataFrame, n: int = SAMPLE) -> DataFrame:
    """First rows per status: added in the second table's order, removed and changed in the first's."""

    def first(status: str) -> DataFrame:
        at = F.col("b_at" if status == "added" else "a_at")
        top = diff.filter(F.col("status") == status).orderBy(at, "key").limit(n)  # n rows of each task at most meet
        return top.withColumn("place", F.row_number().over(W.orderBy(at, "key"))).select("status", "place", "key", "changes")

    return first("added").union(first("removed")).union(first("changed"))
