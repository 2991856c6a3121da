"""Filter interaction audit: what each filter of a chain removes, in every order, and its fair share.

A document fails some of the filters. A coalition of filters removes the documents that fail any of
its members, so the removals of all orders follow from the 32 coalitions: a step removes what its
coalition removes beyond the coalition before it. The fair share of a filter is its Shapley value in
this game, taken from the potential of Hart and Mas-Colell: the potential of a coalition is its
removal plus the potentials of the coalitions one member smaller, divided by its size, and the value
of a filter is the potential of all filters minus that of all others.

Documents are reduced to counts by (part, failed filters) before any of this, 32 rows a part at most.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, functions as F

from logframe.llm.common import Scratch

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
_GAP = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, _GAP), "")


def text_failures(text: Column, words: Column) -> dict[str, Column]:
    """Conditions of the filters that look at one text: too short, too repetitive, too many capitals, symbols.

    ``text`` has no nulls, ``words`` are its words, told apart by case.
    """
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": F.lit(100).cast("long") * F.size(F.array_distinct(words)) < F.lit(LEAST_DISTINCT).cast("long") * F.size(words),
        "C": F.lit(100).cast("long") * capitals > F.lit(MOST_CAPITALS).cast("long") * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def _bits(conditions: Mapping[str, Column], filters: str) -> Column:
    return sum((F.when(c, F.lit(1 << filters.index(name))).otherwise(F.lit(0)) for name, c in conditions.items()), F.lit(0))


def failures(df: DataFrame, id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """Failed filters of each document: ``id``, ``part``, ``mask`` (bit k for the k-th filter) and ``n``.

    Rows that repeat id, part and text come as one with their number ``n``. A null text counts as empty, a null
    part as the empty string. The last filter fails documents whose text a smaller id has; a null id is neither
    smaller nor larger than any, so its documents pass. Texts are compared by their sha256. Other columns are
    ignored; an empty table gives an empty result.

    Equal texts are never gathered: the smallest id of each text is found by a partial aggregate and then joined
    by (text, id), so that a text with many copies is dealt to many tasks.
    """
    scratch = Scratch(df.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    whole = df.select(F.col(id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), body.alias("body"))
    cut = whole.withColumn("words", words_of(F.col("body")))  # a projection of its own, so that each text is cut once
    mask = _bits(text_failures(F.col("body"), F.col("words")), FILTERS)
    one = cut.select("id", "part", F.unhex(F.sha2("body", 256)).alias("sha"), mask.alias("mask"))
    base = scratch.save(one.groupBy("id", "part", "sha", "mask").agg(F.count("*").alias("n")), "failures")
    first = base.filter("id IS NOT NULL").groupBy("sha").agg(F.min("id").alias("first"))
    told = base.join(first.select(F.col("sha").alias("of"), "first"), (F.col("sha") == F.col("of")) & (F.col("id") == F.col("first")), "left")
    copy = F.col("id").isNotNull() & F.col("first").isNull()
    return told.select(F.col("id").alias(id), "part", (F.col("mask") + _bits({"E": copy}, FILTERS)).alias("mask"), "n", "sha")


def flags(labels: DataFrame, id: str = "doc_id") -> DataFrame:
    """Labelled ids (``of``) with ``good`` (any row has quality 1) and ``toxic`` (any row has toxic 1), as 0 or 1."""
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    return labels.filter(F.col(id).isNotNull()).groupBy(F.col(id).alias("of")).agg(one("quality").alias("good"), one("toxic").alias("toxic")).filter("good + toxic > 0")


def classes(failed: DataFrame, labels: DataFrame, id: str = "doc_id") -> DataFrame:
    """Documents by ``part`` and ``mask``: ``n``, and how many of them are ``good`` and ``toxic``."""
    salt = F.when(F.col(id).isNull(), F.hex("sha")).otherwise(F.lit(""))  # null ids match nothing and are dealt by their text
    known = flags(labels, id).withColumn("none", F.lit(""))
    told = failed.withColumn("salt", salt).join(known, (F.col(id) == F.col("of")) & (F.col("salt") == F.col("none")), "left")
    count = lambda c: F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c)
    return told.groupBy("part", "mask").agg(F.sum("n").alias("n"), count("good"), count("toxic"))


def coalitions(counted: DataFrame, filters: str, counts: Sequence[str]) -> DataFrame:
    """One row per part: for each count an array with what every coalition of filters removes, by its bits."""
    every = F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))

    def removed(c: str) -> Column:
        hit = lambda s: F.aggregate("seen", F.lit(0).cast("long"), lambda total, x: total + F.when(x["mask"].bitwiseAND(s) != 0, x[c]).otherwise(0))
        return F.transform(every, hit).alias(c)

    seen = counted.groupBy("part").agg(F.collect_list(F.struct("mask", *counts)).alias("seen"))  # at most 2^filters rows a part
    total = F.aggregate("seen", F.lit(0).cast("long"), lambda t, x: t + x[counts[0]])
    return seen.select("part", total.alias("total"), *(removed(c) for c in counts))


def shapley(games: DataFrame, filters: str, count: str = "n") -> DataFrame:
    """``games`` with ``shapley``: for each filter its Shapley value times the number of orders, a whole number.

    Potentials are kept times the factorial of the number of filters, which makes each of them whole.
    """
    k = len(filters)
    orders = math.factorial(k)
    by_size = [[s for s in range(1 << k) if s.bit_count() == size] for size in range(k + 1)]
    out = games.withColumn("p0", F.lit(0).cast("long"))
    for size in range(1, k + 1):
        smaller = lambda s: sum((F.col(f"p{s & ~(1 << i)}") for i in range(k) if s >> i & 1), F.lit(0).cast("long"))
        out = out.withColumns({f"p{s}": F.call_function("div", orders * F.get(F.col(count), F.lit(s)) + smaller(s), F.lit(size)) for s in by_size[size]})
    grand = (1 << k) - 1
    values = F.array(*(F.col(f"p{grand}") - F.col(f"p{grand & ~(1 << i)}") for i in range(k)))
    return out.select(*games.columns, values.alias("shapley"))


def interactions(counted: DataFrame, filters: str = FILTERS, counts: Sequence[str] = ("n", "good", "toxic")) -> DataFrame:
    """Every order of the filters, step by step, for every part.

    ``counted`` has ``part``, ``mask`` and the counts, the first of them of all documents. One row per part, order
    and step: ``kept``, ``removed``, ``redundant``, ``unique_fails``, ``shapley`` and ``<count>_lost`` for the others.
    """
    k = len(filters)
    games = shapley(coalitions(counted, filters, counts), filters, counts[0])
    order = F.explode(F.array(*(F.lit("".join(o)) for o in permutations(filters)))).alias("filter_order")
    rows = games.select("*", order).select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))

    def bits(letters: Column) -> Column:
        return sum((F.when(F.instr(letters, f) > 0, 1 << i).otherwise(0) for i, f in enumerate(filters)), F.lit(0))

    rows = rows.withColumn("at", F.instr(F.lit(filters), F.expr("substring(filter_order, step, 1)")) - 1)
    rows = rows.withColumns({"before": bits(F.expr("substring(filter_order, 1, step - 1)")), "own": F.call_function("shiftleft", F.lit(1), F.col("at"))})
    at = lambda c, s: F.get(F.col(c), s)
    after = F.col("before") + F.col("own")
    step = lambda c: at(c, after) - at(c, F.col("before"))
    grand = F.lit((1 << k) - 1)
    first = counts[0]
    return rows.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - at(first, after)).alias("kept"),
        step(first).alias("removed"),
        (at(first, F.col("own")) - step(first)).alias("redundant"),
        (at(first, grand) - at(first, grand - F.col("own"))).alias("unique_fails"),
        *(step(c).alias(f"{c}_lost") for c in counts[1:]),
        F.get("shapley", F.col("at")).alias("shapley"),
    )


def audit(df: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """The five filters in all 120 orders over the documents, by part: see ``failures`` and ``interactions``."""
    return interactions(classes(failures(df, id, text, part), labels, id))
