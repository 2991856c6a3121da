"""Near duplicates by SuperMinHash: signatures, banding, verification and union-find grouping.

A document is the set of its distinct word shingles, each a 64-bit hash. SuperMinHash gives every
element a permutation of the signature's places and a random number for each step; in step j the
element offers j plus its number to the j-th place of its permutation. A place keeps the least offer,
and a document is finished once no place can improve, after few steps for long texts. Ranks of one
element differ from place to place, so estimates vary less than with independent hash functions.

Documents of equal sets are one node. Nodes that agree in all rows of a band share a bucket. In each
bucket all nodes are compared with the one that shares most buckets with others: copies are connected
through their original by that. Pairs in a bucket that are still apart are then compared too, each
once, unless sizes rule the similarity out: shingles that no other such node has can't be common, so
they bound the intersection from above and the union from below. Each comparison that decides is one
of full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from logframe.llm.common import Scratch, map_arrow, slices

SHINGLE = 5
PLACES = 256
#: Percent of the union that the intersection must reach.
SIMILARITY = 85
#: Signatures that agree in so many standard deviations less than the similarity are of pairs below it (1e-8).
SURE = 5.6
#: Pairs are compared if they share so many bands; those at the similarity share fewer with a chance below ``MISSED``.
LEAST_BANDS = 3
MISSED = 1e-6
BATCH_CHARS = 1 << 19
_NONE = np.uint32(0xFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; of all words if there are fewer; none without a word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and six kinds of space
    if not words:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(size, len(words))
    code = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        code = _mix(code * np.uint64(0x9E3779B97F4A7C15) + hashed[k : len(words) - n + 1 + k])
    return np.unique(code)


def signatures(sets: list[np.ndarray], places: int = PLACES) -> np.ndarray:
    """SuperMinHash of each set, ``places`` (a power of two up to 256) 32-bit numbers; all ones for the empty set.

    The permutation of an element is affine: an odd step and a start, both from its hash.
    """
    out = np.full((len(sets), places), _NONE, np.uint32)
    flat, mask, bits = out.reshape(-1), np.uint32(places - 1), np.uint64(40)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    element = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    seed = _mix(element + np.uint64(0x632BE59BD9B4E019))
    start, step = seed.astype(np.uint32), (seed >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    for j in range(places):
        if not len(element):
            break
        place = (start + step * np.uint32(j)) & mask
        offer = (_mix(element + np.uint64(j * 0x9E3779B97F4A7C15 % (1 << 64))) >> bits).astype(np.uint32) | np.uint32(j << 24)
        np.minimum.at(flat, owner * places + place, offer)
        unfinished = out.max(axis=1) >= (j + 1) << 24
        if not unfinished.all():
            keep = unfinished[owner]
            owner, element, start, step = owner[keep], element[keep], start[keep], step[keep]
    return out


def missed(percent: int, rows: int, places: int = PLACES) -> float:
    """The chance that a pair at the similarity shares fewer than ``LEAST_BANDS`` bands, for independent places."""
    bands, hit = places // rows, (percent / 100) ** rows
    return sum(math.comb(bands, k) * hit**k * (1 - hit) ** (bands - k) for k in range(LEAST_BANDS))


def rows_for(percent: int, places: int = PLACES) -> int:
    """The most rows a band may have for pairs at the similarity to be found: 6 at 85 percent, 5 at 80."""
    return max((r for r in range(1, 17) if missed(percent, r, places) < MISSED), default=1)


def _describe(places: int, rows: int):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n, a, b, bands, brief = [], [], [], [], []
            for group in slices([t or "" for t in texts], max(BATCH_CHARS, max((len(t or "") for t in texts), default=0) + 1)):
                for at in range(0, len(group), 200):
                    sets = [shingles(t) for _, t in group[at : at + 200]]
                    signed = signatures(sets, places)
                    code = np.arange(places // rows, dtype=np.uint64) + np.zeros((len(sets), 1), np.uint64)
                    for k in range(rows):
                        code = _mix(code * np.uint64(0x9E3779B97F4A7C15) + signed[:, k : places // rows * rows : rows])
                    n.extend(map(len, sets))
                    a.extend(int(_mix(s).sum()) for s in sets)
                    b.extend(int(_mix(s ^ np.uint64(0xD6E8FEB86659FD93)).sum()) for s in sets)
                    bands.extend(list(code.view(np.int64)))
                    brief.extend(x.tobytes() for x in (signed & np.uint32(0xFF)).astype(np.uint8))
            as_long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.record_batch(
                [batch.column(0), pa.array(n, pa.int64()), as_long(a), as_long(b), pa.array(bands, pa.list_(pa.int64())), pa.array(brief, pa.binary())],
                ["id", "n", "set_a", "set_b", "bands", "brief"],
            )

    return describe


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            yield pa.record_batch([part.column(0), pa.array([shingles(t).tobytes() for t in part.column(1).to_pylist()], pa.binary())], ["id", "elements"])


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, elements in zip(batch.column(0).to_pylist(), batch.column(1)):
            found = np.frombuffer(elements.as_buffer(), np.int64)
            yield pa.record_batch([pa.array(found), pa.array(np.full(len(found), name, np.int64))], ["element", "id"])


def _alike(places: int, percent: int):
    """Pairs whose short signatures agree often enough for the similarity to be possible."""
    least = percent / 100 - SURE * math.sqrt(percent / 100 * (1 - percent / 100) / places)

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.array([np.frombuffer(v.as_buffer(), np.uint8) for v in batch.column(k)]).reshape(-1, places) for k in (2, 3))
            keep = (x == y).mean(axis=1) >= least
            yield pa.record_batch(batch.columns[:2], ["a", "b"]).filter(pa.array(keep))

    return alike


def _linked(percent: int):
    """Pairs whose full sets reach the similarity."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for p, q in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.record_batch(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return linked


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of one task: every node with the least node it reaches there."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if root(x) != x]
    yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["a", "b"])


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``node`` and ``label``, the least node it is connected with, for every node of the links (a, b).

    Each task joins its own links by union-find. Then labels spread: a node takes the least label
    around it and the label of its label, until nothing changes.
    """
    forest = scratch.save(map_arrow(links, _forest, "a long, b long").distinct(), "forest")
    edges = scratch.save(forest.union(forest.select("b", "a")).distinct(), "edges")
    labels = scratch.save(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        around = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("least"))
        nearer = labels.join(around, labels["node"] == around["a"]).select("node", "label", F.least("label", "least").alias("new"))
        mine, theirs = nearer.alias("x"), labels.select(F.col("node").alias("at"), F.col("label").alias("beyond"))
        jumped = mine.join(theirs, F.col("new") == F.col("at"), "left").select("node", F.col("label").alias("old"), F.least("new", "beyond").alias("label"))
        after = scratch.save(jumped, "labels")
        changed = after.filter("old <> label").limit(1).count()
        scratch.drop(labels)
        labels = after.drop("old")
        labels._scratch_path = after._scratch_path
        if not changed:
            scratch.drop(forest, edges)
            return labels


def near_dedup(df: DataFrame, id: str = "doc_id", text: str = "text", percent: int = SIMILARITY, places: int = PLACES, rows: int | None = None) -> DataFrame:
    """Groups of documents linked by ``percent`` of common shingles, directly or through others.

    One row per row of ``df``: ``id`` (a whole number), ``n_shingles``, ``component_id`` (least id
    reachable, itself included), ``kept`` (whether that is its own). A text without words has no
    shingle and no link. A null id has no links either: its component is null and it is kept. Rows that
    share an id are one document here: links of any of them count, and all of them are kept or none.
    Two documents at the similarity miss each other with a chance of ``missed``, below 1e-6 by ``rows_for``.
    Other columns are ignored; an empty table gives an empty result.
    """
    spark = df.sparkSession
    rows = rows or rows_for(percent, places)
    scratch = Scratch(spark)
    plain = df.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    schema = "id long, n long, set_a long, set_b long, bands array<bigint>, brief binary"
    signed = scratch.save(map_arrow(plain, _describe(places, rows), schema), "signed")
    found = signed.filter("n > 0 AND id IS NOT NULL")
    same = scratch.save(found.groupBy("set_a", "set_b", "n").agg(F.min("id").alias("rep")), "same")
    first = found.join(same, ["set_a", "set_b", "n"]).filter("id = rep").select("rep", "n", "bands", "brief")
    nodes = scratch.save(first.groupBy("rep", "n").agg(F.first("bands").alias("bands"), F.first("brief").alias("brief")), "nodes")
    placed = nodes.select("rep", "n", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("c")).filter("c > 1")
    crowded = scratch.save(placed.join(shared, "bucket"), "crowded")
    company = crowded.groupBy("rep").agg(F.sum("c").alias("weight"))
    centers = crowded.join(company, "rep").groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("rep")).alias("least"))).alias("best"))
    buckets = scratch.save(crowded.join(centers, "bucket").select("bucket", "rep", "n", (-F.col("best.least")).alias("center")), "buckets")
    scratch.drop(crowded)
    wanted = buckets.select(F.col("rep").alias("id")).distinct()
    texts = plain.join(wanted, "id", "left_semi")
    sets = scratch.save(map_arrow(texts, _sets, "id long, elements binary"), "sets")

    def beside(rows: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
        x = table.select(F.col(key).alias("k"), F.col(value).alias("x"))
        y = table.select(F.col(key).alias("k"), F.col(value).alias("y"))
        rows = rows.join(x, F.col("a") == F.col("k")).drop("k").join(y, F.col("b") == F.col("k")).drop("k")
        return rows.select("a", "b", "x", "y")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Those pairs, given with both short signatures, that are links."""
        likely = scratch.save(map_arrow(pairs, _alike(places, percent), "a long, b long"), f"{name}-likely")
        out = scratch.save(map_arrow(beside(likely, sets, "id", "elements"), _linked(percent), "a long, b long"), name)
        scratch.drop(likely)
        return out

    starred = buckets.filter("rep <> center").select(F.least("rep", "center").alias("a"), F.greatest("rep", "center").alias("b")).distinct()
    near = verified(beside(starred, nodes, "rep", "brief"), "near")
    grouped = components(near, scratch)
    told = buckets.join(grouped, F.col("rep") == F.col("node"), "left").select("bucket", "rep", "n", F.coalesce("label", "rep").alias("label"))
    parts = told.groupBy("bucket", "label").agg(F.count("*").alias("c")).groupBy("bucket")
    mixed = parts.agg(F.count("*").alias("labels"), F.max_by("label", F.struct("c", "label")).alias("main")).filter("labels > 1").select("bucket", "main")
    open_rows = scratch.save(told.join(mixed, "bucket"), "open")
    open_nodes = scratch.save(open_rows.select("rep").distinct(), "open-nodes")
    elements = map_arrow(sets.join(open_nodes, F.col("id") == F.col("rep"), "left_semi"), _elements, "element long, id long")
    alone = elements.groupBy("element").agg(F.count("*").alias("c"), F.min("id").alias("rep")).filter("c = 1").groupBy("rep").agg(F.count("*").alias("own"))
    about = nodes.select("rep", "bands", "brief").join(open_nodes, "rep").join(alone, "rep", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    open_rows = scratch.save(open_rows.join(scratch.save(about, "about"), "rep"), "open-rows")

    def side(name: str) -> list:
        return [F.col(c).alias(f"{name}_{c}") for c in ("rep", "n", "own", "label", "bands", "brief")]

    rest = open_rows.filter("label <> main").select("bucket", "main", *side("a")).join(open_rows.select("bucket", *side("b")), "bucket")
    common = F.least(F.col("a_n") - F.col("a_own"), F.col("b_n") - F.col("b_own"))
    union = F.greatest(F.col("a_n") + F.col("b_own"), F.col("b_n") + F.col("a_own"))
    agree = F.zip_with("a_bands", "b_bands", lambda x, y: F.when(x == y, x))
    # A pair is taken in the LEAST_BANDSth bucket that it shares: once, and only if it shares so many.
    turn = F.get(F.filter(agree, lambda x: x.isNotNull()), F.lit(LEAST_BANDS - 1)) == F.col("bucket")
    in_order = (F.col("b_label") == F.col("main")) | (F.col("a_rep") < F.col("b_rep"))  # two outsiders meet twice
    fits = (F.col("a_label") != F.col("b_label")) & in_order & (100 * common >= percent * union) & F.coalesce(turn, F.lit(False))
    rest = rest.filter(fits).select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b"), "a_brief", "b_brief")
    more = verified(rest, "more")
    links = near.union(more)
    labels = components(links, scratch)
    scratch.drop(sets, buckets, open_rows)
    member = same.join(labels, F.col("rep") == F.col("node"), "left").select("set_a", "set_b", "n", F.coalesce("label", "rep").alias("component"))
    by_id = signed.select("id", "n", "set_a", "set_b").join(scratch.save(member, "member"), ["set_a", "set_b", "n"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce(F.col("component"), F.col("id")))
    return by_id.select(
        F.col("id").alias(id), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")
    )


def drop_near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", percent: int = SIMILARITY) -> DataFrame:
    """The rows of ``df``, with all their columns, without those that ``near_dedup`` does not keep."""
    gone = near_dedup(df, id, text, percent).filter("NOT kept").select(F.col(id).alias("gone")).distinct()
    rows = df.select(F.struct("*").alias("row"), F.col(id).alias("key"))  # names of the row's columns can't clash
    return rows.join(gone, F.col("key") == F.col("gone"), "left_anti").select("row.*")
