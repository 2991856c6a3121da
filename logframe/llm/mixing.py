"""Mixing sources to target weights by weighted sampling without replacement.

Each document gets an exponential key (Efraimidis and Spirakis): minus the logarithm of a uniform
number, divided by its quality weight, so better documents tend to come first. A source takes
complete epochs of all its documents, then, in the order of the keys, as many as the rest of its
token budget holds. The running sums are taken in two steps: the keys are dealt into buckets, the
budget falls into one bucket of each source, and only documents of that bucket are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from logframe.llm.common import WORD, Scratch
from logframe.llm.exact_dedup import numbered_rows, row_key

WEIGHTS = (5.0, 2.0, 1.0)
MOST_EPOCHS = 3
SEED = "mix-1"
#: Buckets of keys on each of the two levels.
FANOUT = 1024


def quality_weight(text: Column) -> Column:
    """0.05 to 1: more for texts of lower-case letters and spaces, less for symbols, digits and capitals."""
    plain = F.length(F.regexp_replace(text, r"[^\p{Ll} ]+", ""))
    return F.lit(0.05) + F.lit(0.95) * plain / F.greatest(F.length(text), F.lit(1))


def uniform(id: Column, seed: str) -> Column:
    """A number above 0 and below 1 that depends on the id and the seed only."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit("null"))).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Targets of sources (source, source_size): shares by weight of all sizes, at most ``most`` times the size.

    What a source can't take is shared by weight among the others. In the order of size by weight, a
    source is full if its cap is at most its share of what the fuller ones before it have left.
    """
    named = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weighed = named.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    all_of = Window.partitionBy()
    before = Window.orderBy(F.col("source_size") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(all_of) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    share = left.cast("double") / (F.sum("weight").over(all_of) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    shared = weighed.withColumn("share", share).withColumn("full", most * F.col("source_size") <= F.col("share") * F.col("weight"))
    level = F.max(F.when(~F.col("full"), F.col("share"))).over(all_of)
    target = F.when(F.col("full"), (most * F.col("source_size")).cast("double")).otherwise(level * F.col("weight"))
    return shared.select("source", "source_size", "rank", target.alias("target"))


def mix(
    df: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    most: int = MOST_EPOCHS,
    seed: str = SEED,
    key: str | None = None,
) -> DataFrame:
    """How often each document is taken: ``id``, ``source``, ``size``, ``source_size``, ``target``, ``copies``, ``taken``,
    and ``row_key``, a number of the row: that in the column ``key``, else a new one.

    ``size`` is the number of words (null text: 0), ``taken`` is ``size`` times ``copies``. The document
    on which the budget ends is taken if at least half of it fits. A null source is a source of its own,
    the last one; rows with a null id share one key and are ordered by their text; documents of size 0
    take nothing. Reruns agree. Other columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(df.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    number = F.col(key) if key else row_key()
    rank_key = -F.log(uniform(F.col(id), seed)) / quality_weight(body)
    place = F.least(F.floor(float(FANOUT * FANOUT) * (1 - F.exp(-F.col("key")))), F.lit(FANOUT * FANOUT - 1)).cast("long")
    sized = scratch.save(
        df.select(F.col(id).alias("id"), F.col(source).alias("source"), F.regexp_count(body, F.lit(WORD)).cast("long").alias("size"), rank_key.alias("key"), F.xxhash64(body).alias("tie"), number.alias("row_key"))
        .withColumn("place", place),
        "sized",
    )
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    epochs = F.coalesce(F.floor(F.col("target") / F.col("source_size")), F.lit(0))
    plan = scratch.save(
        source_targets(sizes, weights, most)
        .withColumn("epochs", epochs.cast("long"))
        .withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")),
        "plan",
    )

    def edge(rows: DataFrame, bucket: Column, known: DataFrame) -> DataFrame:
        """Of each source the bucket in which its budget ends, and the words before that bucket."""
        sums = rows.groupBy("rank", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
        run = Window.partitionBy("rank").orderBy("bucket")
        ends = sums.join(known, "rank").withColumn("until", F.sum("words").over(run) + F.col("before"))
        over = ends.filter(F.col("until") > F.col("budget"))
        first = over.groupBy("rank").agg(F.min(F.struct("bucket", (F.col("until") - F.col("words")).alias("before"))).alias("edge"))
        return first.select("rank", F.col("edge.bucket").alias("edge"), F.col("edge.before").alias("before"))

    ranked = sized.join(plan.select(F.col("source").alias("of"), "rank", "source_size", "target", "epochs", "budget"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    upper = F.floor(F.col("place") / FANOUT)
    budgets = plan.select("rank", "budget", F.lit(0).cast("long").alias("before"))
    coarse = scratch.save(edge(ranked, upper, budgets), "coarse")
    in_coarse = ranked.join(coarse.select("rank", "edge"), "rank").filter(upper == F.col("edge"))
    fine = scratch.save(edge(in_coarse, F.col("place"), plan.select("rank", "budget").join(coarse.select("rank", "before"), "rank")), "fine")
    told = ranked.join(fine.select("rank", "edge", "before"), "rank", "left")
    at_edge = F.coalesce(F.col("place") == F.col("edge"), F.lit(False))
    run = Window.partitionBy("rank").orderBy("key", F.col("id").asc_nulls_first(), "tie", "size").rowsBetween(Window.unboundedPreceding, 0)
    until = F.sum("size").over(run) + F.col("before")
    whole = told.filter(~at_edge).withColumn("more", F.coalesce(F.col("place") < F.col("edge"), F.lit(False)))
    part = told.filter(at_edge).withColumn("until", until).withColumn("more", F.col("budget") - F.col("until") + F.col("size") >= F.col("size") / 2).drop("until")
    copies = F.when(F.col("size") > 0, F.col("epochs") + F.col("more").cast("long")).otherwise(F.col("epochs"))
    return whole.unionByName(part).select(
        F.col("id").alias(id),
        F.col("source").alias(source),
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (F.col("size") * copies).alias("taken"),
        "row_key",
    )


def take(df: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``df``, with all their columns, as often as ``mix`` takes them.

    Rows are written once with their numbers, so that a number means the same row in every later scan,
    however that is split.
    """
    rows = numbered_rows(df)
    plain = rows.select(*(F.col(f"row.`{c}`").alias(name) for c, name in ((id, "id"), (text, "text"), (source, "source"))), "key")
    taken = mix(plain, "id", "text", "source", key="key").filter("copies > 0")
    copies = taken.select("row_key", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return rows.join(copies, F.col("key") == F.col("row_key")).select("row.*")
