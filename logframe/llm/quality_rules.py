"""Quality rules: divergence of a document's character classes and common words from its language's.

Every text gives counts: of characters by class, of the common words of a few languages, and of
repeated lines and words. References are the sums of these histograms over all documents of a
language that pass the basic rules. A document whose Jensen-Shannon divergence from its language's
reference exceeds a threshold is not kept, unless it is too short for a histogram to mean anything.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from logframe.llm.common import WORD, Scratch

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
#: Character classes by pattern, counted in this order; what none of them holds is one class more.
CLASSES = ("[a-z]", SPACE, SYMBOLS, "[A-Z]", "[0-9]", r"[.,;:'\x22()\-]", "[!?]", "[à-öø-ÿ]")
#: The most common function words of four languages. A word of two languages is one bin. A word counts
#: if it stands between spaces as it is written here.
COMMON_WORDS = (
    "the of and to in a is that for it was on are as with they at be this from "
    "der die und das den von zu mit sich des auf für ist nicht ein eine als auch dem "
    "de la le et les un une dans que est pour qui par plus pas sur au "
    "el y los se del las por con para una su al lo como más"
).split()
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
WINDOW = 8
#: A histogram of fewer words than this is not judged.
MIN_JUDGED_WORDS = 30
MAX_CLASS_DIVERGENCE = 0.06
MAX_WORD_DIVERGENCE = 0.2

_BINS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-=_~^@!?"  # a letter per common word


def _without(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, f"{pattern}+", "")


def _lost(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(_without(text, pattern))


def windows(hashes: Column) -> Column:
    """A 64-bit hash of every window of ``WINDOW`` words, from the 64-bit hashes of the words.

    ``hashes`` has to be a column: it is read for each window, and an expression would be computed anew.
    """
    starts = F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1))
    return F.when(F.size(hashes) >= WINDOW, F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))).otherwise(
        F.array().cast("array<bigint>")
    )


def _covered(windows: Column) -> tuple[Column, Column]:
    """Sorted (hash, place) of the windows if any repeats; from that the words covered."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    ordered = F.when(F.size(F.array_distinct(windows)) < F.size(windows), placed)
    pairs = F.col("ordered")
    again = F.filter(pairs, lambda x, k: (F.get(pairs, k - 1)["h"] == x["h"]) | F.coalesce(F.get(pairs, k + 1)["h"] == x["h"], F.lit(False)))
    return ordered, F.sort_array(F.transform(again, lambda x: x["i"]))


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence, base 2, of two arrays of counts with positive sums."""

    def shares(x: Column) -> Column:
        total = F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
        return F.transform(x, lambda v: v / total)

    def term(a: Column, b: Column) -> Column:
        middle = (a + b) / 2
        half = lambda v: F.when(v > 0, v * F.log2(v / middle) / 2).otherwise(0.0)
        return half(a) + half(b)

    return F.aggregate(F.zip_with(shares(p), shares(q), term), F.lit(0.0), lambda a, v: a + v)


def measures(df: DataFrame, id: str, text: str, lang: str) -> DataFrame:
    """``id``, ``lang`` ('' if null), the base counts and both histograms of every row."""
    bins = _BINS[: len(set(COMMON_WORDS))]
    listed = F.array(*map(F.lit, sorted(set(COMMON_WORDS))))
    rows = df.select(F.col(id).alias("id"), F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    words = rows.select(
        "*",
        F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"),
        F.regexp_extract_all("text", F.lit(rf"(?<![^\x20\x09-\x0D])(?:{'|'.join(sorted(set(COMMON_WORDS)))})(?![^\x20\x09-\x0D])"), F.lit(0)).alias("common"),
        _without(F.col("text"), CLASSES[0]).alias("odd"),
        F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD)).alias("lines"),
    )
    words = words.withColumn("visible", _without(F.col("odd"), CLASSES[1]))  # most of a text is gone by now
    length, spaces = F.length("text"), F.length("odd") - F.length("visible")
    counts = words.select(
        "id",
        "lang",
        F.size("words").cast("long").alias("n_words"),
        (length - spaces).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        length.alias("length"),
        F.array(length - F.length("odd"), spaces, *[_lost(F.col("visible"), c) for c in CLASSES[2:]]).alias("by_class"),
        F.array_join(F.transform("common", lambda w: F.substring(F.lit(bins), F.array_position(listed, w).cast("int"), F.lit(1))), "").alias("marks"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    counts = counts.select("*", windows(F.col("hashes")).alias("windows")).drop("hashes")
    ordered, places = _covered(F.col("windows"))
    counts = counts.select("*", ordered.alias("ordered")).drop("windows").select("*", places.alias("places")).drop("ordered")
    step = F.transform("places", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("places"), k + 1) - p, F.lit(WINDOW))))
    repeated = F.coalesce(F.aggregate(step, F.lit(0), lambda a, v: a + v), F.lit(0)).cast("long")
    rest = F.col("length") - F.aggregate("by_class", F.lit(0), lambda a, v: a + v)
    of_words = F.transform(F.array(*map(F.lit, bins)), lambda b: (F.length("marks") - F.length(F.replace(F.col("marks"), b, F.lit("")))).cast("double"))
    out = counts.select(
        "id",
        "lang",
        "n_words",
        "word_chars",
        F.element_at("by_class", CLASSES.index(SYMBOLS) + 1).cast("long").alias("n_symbols"),
        "n_dup_lines",
        repeated.alias("n_repeat_words"),
        F.concat("by_class", F.array(rest)).cast("array<double>").alias("classes"),
        F.concat(F.array((F.col("n_words") - F.length("marks")).cast("double")), of_words).alias("common"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def judge(df: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The measures of every document and whether it is kept.

    Returns ``id``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``,
    ``base_failed``, ``class_divergence``, ``word_divergence``, ``kept``. A null text has no words and
    fails the basic rules. Documents without a language are compared with each other; a language none
    of whose documents passes the basic rules has no reference, its divergences are null. Repeated rows
    count as often as they occur, ids may repeat or be null. Other columns are ignored; an empty table
    gives an empty result.
    """
    scratch = Scratch(df.sparkSession)
    found = scratch.save(measures(df, id, text, lang), "measures")
    sized = [("classes", len(CLASSES) + 1), ("common", len(set(COMMON_WORDS)) + 1)]
    sums = {name: F.array(*[F.sum(F.element_at(name, k + 1)) for k in range(n)]).alias(f"all_{name}") for name, n in sized}
    references = scratch.save(found.filter("NOT base_failed").groupBy("lang").agg(*sums.values()), "references")
    told = found.join(references, "lang", "left")
    told = told.withColumn("class_divergence", F.when(F.col("n_words") > 0, divergence(F.col("classes"), F.col("all_classes"))))
    has_words = F.aggregate("common", F.lit(0.0), lambda a, v: a + v) > 0
    told = told.withColumn("word_divergence", F.when(has_words, divergence(F.col("common"), F.col("all_common"))))
    rules = [F.col("class_divergence") <= MAX_CLASS_DIVERGENCE, F.col("word_divergence") <= MAX_WORD_DIVERGENCE]
    like = reduce(lambda a, b: a & b, [F.coalesce(r, F.lit(True)) for r in rules])
    return told.select(
        F.col("id").alias(id),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "class_divergence",
        "word_divergence",
        (~F.col("base_failed") & ((F.col("n_words") < MIN_JUDGED_WORDS) | like)).alias("kept"),
    )
