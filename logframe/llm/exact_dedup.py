"""Exact duplicates by deterministic block naming.

Each text is cut into blocks of a fixed number of characters. The distinct blocks are sorted and
named by integers; then adjacent names are paired and the pairs are named in turn, until each
document has a single name. Two documents have the same (level, name) if and only if their texts
are equal: a name stands for one content, and texts of unequal block counts differ in length.

Contents are compared as they are when blocks are named. Occurrences then look their names up by a
128-bit digest, which is shown to be unique among all named blocks first; if two blocks ever share
one, the digests are taken again with other seeds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from logframe.llm.common import Scratch

BLOCK_CHARS = 4096


def _blocks(text: Column, size: int) -> Column:
    """The text in blocks; the empty text is one empty block."""
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.when(text == "", F.array(F.lit(""))).otherwise(cut)


def _digest(seed: int) -> Callable[[Column], Column]:
    return lambda block: F.struct(
        F.xxhash64(F.lit(seed), block).alias("a"),
        F.xxhash64(F.lit(-seed), F.length(block), block).alias("b"),
    )


def row_key() -> Column:
    """A number for each row. It follows the splits of the scan, so it holds only where it is written with the rows."""
    return F.monotonically_increasing_id()


def _named(distinct: DataFrame, *keys: str) -> DataFrame:
    """Distinct rows, already dealt by their keys, sorted and numbered in each partition.

    The partition's number is the upper part of the name, so names need no global order. Both the
    dealing and the sort depend on the contents only.
    """
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def document_names(df: DataFrame, text: str = "text", block_chars: int = BLOCK_CHARS, key: str | None = None) -> DataFrame:
    """Every row of ``df`` without its text, with ``text_sha256`` and the identity of its text.

    Returns the given columns but ``text``, then ``text_sha256``, ``name_level``, ``name`` and
    ``row_key``, a number of the row: that in the column ``key``, else a new one. A null text counts
    as empty. Repeated rows stay.
    """
    scratch = Scratch(df.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    carried = [F.col(f"`{c}`") for c in df.columns if c not in (text, key)]
    for seed in range(1, 100):
        base = scratch.save(
            df.select(
                F.struct(*carried).alias("row"),
                F.sha2(body.cast("binary"), 256).alias("sha"),
                (F.col(key) if key else row_key()).alias("row_key"),
                F.transform(_blocks(body, block_chars), _digest(seed)).alias("digests"),
            ),
            "base",
        )
        contents = df.select(F.explode(_blocks(body, block_chars)).alias("block")).groupBy("block").agg(F.lit(1).alias("one"))
        names = scratch.save(_named(contents, "block").select(_digest(seed)(F.col("block")).alias("digest"), "name"), "names")
        found = names.agg(F.count("*").alias("n"), F.countDistinct("digest").alias("d")).first()
        if found["n"] == found["d"]:
            break
        scratch.drop(base, names)
    parts = base.select("row_key", F.size("digests").alias("n"), F.posexplode("digests").alias("pos", "digest"))
    level = scratch.save(parts.join(names, "digest").select("row_key", "n", "pos", "name"), "level")
    scratch.drop(names)
    done, depth = [], 0
    longest = base.agg(F.max(F.size("digests"))).first()[0] or 1
    while True:
        done.append(level.filter("n = 1").select("row_key", F.lit(depth).alias("name_level"), "name"))
        if longest <= 1:
            break
        pairs = scratch.save(
            level.filter("n > 1")
            .groupBy("row_key", F.expr("cast((n + 1) div 2 as int)").alias("n"), F.expr("cast(pos div 2 as int)").alias("pos"))
            .agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
            ),
            "pairs",
        )
        names = scratch.save(_named(pairs.select("left", "right").distinct(), "left", "right"), "names")
        level = scratch.save(pairs.join(names, ["left", "right"]).select("row_key", "n", "pos", "name"), "level")
        scratch.drop(pairs, names)
        longest, depth = (longest + 1) // 2, depth + 1
    identity = done[0]
    for more in done[1:]:
        identity = identity.union(more)
    return scratch.save(
        base.select("row", "sha", "row_key").join(identity, "row_key").select("row.*", F.col("sha").alias("text_sha256"), "name_level", "name", "row_key"),
        "identity",
    )


def exact_dedup(df: DataFrame, id: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS, key: str | None = None) -> DataFrame:
    """Groups of equal texts; of each the row with the largest id stays.

    One row per row of ``df``: ``id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``,
    ``name_level``, ``name``, ``row_key``. Texts are compared unchanged, a null text counts as empty, and a null
    id is smaller than any other. Of rows that repeat both id and text exactly one is kept. ``key`` names
    a column with the number of the row, if it has one. Other columns are ignored, so their names can't
    clash; an empty table gives an empty result.
    """
    numbered = [F.col(key).alias("key")] if key else []
    named = document_names(df.select(F.col(id).alias("id"), F.col(text).alias("text"), *numbered), "text", block_chars, "key" if key else None)
    groups = named.groupBy("name_level", "name").agg(F.count("*").alias("group_size"), F.max(F.struct("id", "row_key")).alias("keep"))
    groups = Scratch(df.sparkSession).save(groups, "groups")  # as a table of its own, so that a join on a hot name can be split
    return named.join(groups, ["name_level", "name"]).select(
        F.col("id").alias(id),
        F.col("keep.id").alias("keep_id"),
        "group_size",
        (F.col("row_key") == F.col("keep.row_key")).alias("kept"),
        "text_sha256",
        "name_level",
        "name",
        "row_key",
    )


def drop_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df``, with all their columns, without those that ``exact_dedup`` does not keep.

    Rows are written once with their numbers, so that a number means the same row in every later scan,
    however that is split.
    """
    rows = numbered_rows(df)
    plain = rows.select(F.col(f"row.`{id}`").alias("id"), F.col(f"row.`{text}`").alias("text"), "key")
    gone = exact_dedup(plain, "id", "text", key="key").filter("NOT kept").select("row_key")
    return rows.join(gone, F.col("key") == F.col("row_key"), "left_anti").select("row.*")


def numbered_rows(df: DataFrame) -> DataFrame:
    """The rows as ``row``, each with a number ``key``, written: names of their columns can't clash with others."""
    return Scratch(df.sparkSession).save(df.select(F.struct("*").alias("row"), row_key().alias("key")), "rows")
