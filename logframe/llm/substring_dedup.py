"""Substring duplicates: words in a run of words that occurs earlier in the corpus are removed.

A window is a fixed number of consecutive words. Most windows occur once, so their counts are first
bounded from above by a count-min sketch, and only windows that it says may be repeated are grouped.

* What is counted. Of the short grams in a window the one with the least hash stands for it. Equal
  windows have equal grams at equal offsets, so a gram occurs at least as often as any window that it
  stands for, and one count for each place of a gram bounds all of its windows at once. That is about
  a sixth of the counting that windows themselves would take, and loses none.
* The sketch. Every gram counts in one cell of each of two rows, whose width follows the number of
  places counted: four cells or more for each. Each partition's own sketch holds the cells that it
  touches (the partial aggregate of the first shuffle); adding these up merges them. The second row
  counts only the grams whose cell in the first has a count of two or more: all places of a repeated
  gram are among them. Neither the sketch nor what is looked up in it is ever in one place: cells are
  looked up by a join, so it may grow with the corpus.
* The second pass. Windows whose gram has a count of two or more in both rows go on, with a 128-bit
  BLAKE2b digest of their words and their place. Grouping them finds each window's first place.
  Windows elsewhere are repeated, and so are the words they cover.

Longer grams let fewer windows through that are not repeated, but more of them have to be counted. Of
texts in which 20 % of all windows are repeated, grams of 5 words let 24 % through, 8 words 22 %.

Places are ordered by id, then text, then word. Nothing is gathered by window: groups are reduced to
their first place by a partial aggregate, and places are joined with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from logframe.llm.common import Scratch, map_arrow, numbered

WINDOW, GRAM = 20, 8
#: Cells per counted place in each row of the sketch, at least; rows take the upper and the lower bits of a hash.
ROOM = 4
#: A document is numbered in pieces of 2^PIECE words, so that a place is one number.
PIECE = 16
#: Places are grouped in so many shares of their digests, one after the other, so that only a share is shuffled at a time.
SHARES = 4

_SEGMENT, _LONG_WORD = 1 << 20, 1 << 16
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_powers: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None


def _mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd number, of its inverse modulo 2^64, and a number for each byte."""
    global _powers
    if _powers is None:
        n, base = _SEGMENT + _LONG_WORD + 1, int(_ODD)
        inverse = pow(base, -1, 1 << 64)
        runs = []
        for b in (base, inverse):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            runs.append(np.cumprod(steps, dtype=np.uint64))
        _powers = runs[0], runs[1], _mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
    return _powers


def word_bounds(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in UTF-8 bytes; a text ends at each of ``ends``, and so does a word."""
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(_SPACE[data], out=inside[1:-1])
    first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cut = ends[(ends > 0) & (ends < len(data))]
    first[cut] = inside[1:-1][cut]
    last[cut - 1] = inside[1:-1][cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a polynomial, taken as a difference of running sums."""
    power, inverse, of_byte = _tables()
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        origin = starts[at]
        to = max(at + 1, int(np.searchsorted(starts, origin + _SEGMENT)))
        part = data[origin : min(int(ends[to - 1]), int(origin) + _SEGMENT + _LONG_WORD)]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(of_byte[part] * power[: len(part)], out=sums[1:])
        s = starts[at:to] - origin
        e = np.minimum(ends[at:to] - origin, len(part))
        out[at:to] = (sums[e] - sums[s]) * inverse[np.minimum(s, len(inverse) - 1)] + (e - s).astype(np.uint64) * _ODD
        at = to
    for k in np.flatnonzero(ends - starts > _LONG_WORD):
        out[k] = int.from_bytes(blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return _mix(out)


def _extreme(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least or largest of every ``width`` consecutive numbers, by doubling."""
    take, have = (np.minimum if least else np.maximum), 1
    while have < width:
        step = min(have, width - have)
        x = take(x[: len(x) - step], x[step:])
        have += step
    return x


def window_grams(words: np.ndarray, owner: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the grams, each window's least gram hash, and whether a window lies in one text."""
    n = len(words)
    if n < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
    grams = np.zeros(n - gram + 1, np.uint64)
    for k in range(gram):
        grams = grams * _ODD + words[k : n - gram + 1 + k]
    grams = _mix(grams)
    return grams, _extreme(grams, window - gram + 1, True), owner[window - 1 :] == owner[: n - window + 1]


def counted_grams(grams: np.ndarray, least: np.ndarray, valid: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """Places of the grams that are the least of some window; of equal ones in a window all count."""
    pad = np.zeros(window - gram, np.uint64)
    best = _extreme(np.concatenate((pad, np.where(valid, least, np.uint64(0)), pad)), window - gram + 1, False)
    return np.flatnonzero((best == grams) & (best > 0))


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string array without nulls."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def _chunks(offsets: np.ndarray, most: int = _SEGMENT) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes, one row at least."""
    at, rows = 0, len(offsets) - 1
    while at < rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, to
        at = to


def _read(data: np.ndarray, offsets: np.ndarray, at: int, to: int) -> tuple[np.ndarray, ...]:
    """Of rows ``at`` to ``to``: their bytes, word starts and ends, each word's row, and each row's first word."""
    part, bounds = data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
    starts, ends = word_bounds(part, bounds[1:])
    first = np.searchsorted(starts, bounds)
    owner = np.repeat(np.arange(to - at), np.diff(first))
    return part, starts, ends, owner, first


def _lists(values: list[np.ndarray], counts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    sizes = np.concatenate([np.zeros(1, np.int64), *counts])
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), pa.array(flat, kind))


def _count_pass(window: int, gram: int):
    def rows(batches):
        for batch in batches:
            data, offsets = _texts(batch.column("body"))
            n_words, values, counts = [], [], []
            for at, to in _chunks(offsets):
                part, starts, ends, owner, first = _read(data, offsets, at, to)
                grams, least, valid = window_grams(word_hashes(part, starts, ends), owner, window, gram)
                places = counted_grams(grams, least, valid, window, gram) if len(grams) else np.zeros(0, np.int64)
                n_words.append(np.diff(first))
                values.append(grams[places].view(np.int64))
                counts.append(np.bincount(owner[places], minlength=to - at))
            words = np.concatenate(n_words) if n_words else np.zeros(0, np.int64)
            columns = [batch.column("id"), batch.column("ta"), batch.column("tb"), pa.array(words, pa.int64()), _lists(values, counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "ta", "tb", "n_words", "grams"])

    return rows


def cell(gram: Column, row: int, bits: int) -> Column:
    """The cell of a gram in a row of 2^bits cells: the first row takes the upper bits, the second the lower ones."""
    return F.shiftrightunsigned(gram, 64 - bits) if row == 0 else gram.bitwiseAND(F.lit((1 << bits) - 1))


def repeated_by_sketch(scratch: Scratch, places: DataFrame, counted: int) -> DataFrame:
    """Rows of ``places`` (with a column ``gram``) whose gram occurs twice or more by both rows of the sketch."""
    bits = min(62, max(4, (ROOM * counted - 1).bit_length()))
    for row in (0, 1):
        before = places
        own = places.withColumn("cell", cell(F.col("gram"), row, bits))
        merged = own.groupBy("cell").agg(F.count("*").alias("n"))  # the partitions' own sketches, added up
        often = scratch.save(merged.filter("n > 1").select("cell"), "cells")
        places = scratch.save(own.join(often, "cell", "left_semi").drop("cell"), "often")
        scratch.drop(often, *([before] if row else []))
    return places


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in ``known``, distinct and sorted."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _marked(least: np.ndarray, valid: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Windows whose gram is marked. Neighbours mostly share a gram: each run is looked up once."""
    if not len(least):
        return np.zeros(0, np.int64)
    run = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    hit = _among(least[run].view(np.int64), known)
    return np.flatnonzero(np.repeat(hit, np.diff(np.append(run, len(least)))) & valid)


def _joined(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """All words with one space after each, and where each begins."""
    sizes = ends - starts
    at = np.concatenate(([0], np.cumsum(sizes + 1)))
    out = np.full(at[-1], 0x20, np.uint8)
    nth = np.arange(sizes.sum())
    word = np.repeat(np.arange(len(sizes)), sizes)
    within = nth - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[at[word] + within] = part[starts[word] + within]
    return out.tobytes(), at


def _place_pass(window: int, gram: int):
    def rows(batches):
        for batch in batches:
            data, offsets = _texts(batch.column("body"))
            marks = batch.column("marks")
            known = marks.flatten().to_numpy(zero_copy_only=False)
            of = np.concatenate(([0], np.cumsum(marks.value_lengths().to_numpy(zero_copy_only=False))))
            numbers = batch.column("num").to_numpy(zero_copy_only=False)
            digests, places = [], []
            for at, to in _chunks(offsets):
                part, starts, ends, owner, first = _read(data, offsets, at, to)
                _, least, valid = window_grams(word_hashes(part, starts, ends), owner, window, gram)
                seen = _marked(least, valid, np.unique(known[of[at] : of[to]]))  # marks of a neighbour only add candidates
                if not len(seen):
                    continue
                words, begins = _joined(part, starts, ends)
                spans = zip(begins[seen].tolist(), (begins[seen + window] - 1).tolist(), strict=True)
                digests += [blake2b(words[s:e], digest_size=16).digest() for s, e in spans]
                inside = seen - first[owner[seen]]
                places.append(((numbers[at:to][owner[seen]] + (inside >> PIECE)) << PIECE) | (inside & ((1 << PIECE) - 1)))
            pairs = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            spots = np.concatenate(places) if places else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(spots, pa.int64())], ["a", "b", "at"])

    return rows


def _removal_pass(window: int):
    def covered(words: int, starts: list[int]) -> list[tuple[int, int]]:
        spans: list[tuple[int, int]] = []
        for s in sorted(set(starts)):
            if spans and s <= spans[-1][1]:
                spans[-1] = spans[-1][0], s + window
            else:
                spans.append((s, s + window))
        return spans

    def rows(batches):
        for batch in batches:
            data, offsets = _texts(batch.column("body"))
            body = data[offsets[0] : offsets[-1]].tobytes()
            bounds = (offsets - offsets[0]).tolist()
            n_words, n_removed, removed, kept = [], [], [], []
            for row, repeats in enumerate(batch.column("repeats").to_pylist()):
                words = body[bounds[row] : bounds[row + 1]].split()  # bytes are split at the same six characters
                starts = [(x["piece"] << PIECE) + s for x in repeats or () for s in x["starts"]]
                spans = covered(len(words), starts)
                left, at = [], 0
                for s, e in spans:
                    left += words[at:s]
                    at = e
                left += words[at:]
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                removed.append([{"start": s, "end": e} for s, e in spans])
                kept.append(b" ".join(left))
            spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            columns = [batch.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, spans_type), pa.array(kept, pa.binary()).view(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "n_removed", "removed", "kept"])

    return rows


def _keyed(df: DataFrame, id: str, text: str) -> DataFrame:
    """``id``, ``body`` and two hashes of it; rows equal in all of them are one document."""
    body = F.coalesce(F.col(text), F.lit(""))
    whole = df.select(F.col(id).alias("id"), body.alias("body"))
    return whole.select("id", F.xxhash64(F.lit(1), "body").alias("ta"), F.xxhash64(F.lit(-1), F.length("body"), "body").alias("tb"), "body")


def _same(left: str, right: str) -> Column:
    """Equality of the keys of two aliased tables; null ids are equal."""
    one = lambda c: F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return one("id") & one("ta") & one("tb")


def _later(scratch: Scratch, places: DataFrame) -> DataFrame:
    """Of places (a, b, at) those that are not the first of their digest (a, b), as ``starts`` by piece ``num``."""
    groups = places.groupBy("a", "b").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    firsts = scratch.save(groups.filter("last > first").select("a", "b", "first"), "firsts")
    later = places.join(firsts, ["a", "b"]).filter(F.col("at") > F.col("first"))
    start = F.col("at").bitwiseAND(F.lit((1 << PIECE) - 1)).cast("int")
    out = scratch.save(later.groupBy(F.shiftright("at", PIECE).alias("num")).agg(F.collect_list(start).alias("starts")), "later")
    scratch.drop(firsts)
    return out


def repeated_windows(df: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Windows that also start earlier, by document: ``id``, ``ta``, ``tb`` and ``repeats``, an array of (piece, starts).

    A start counts from the first word of its piece of 2^16 words; a piece may be named more than once.
    Documents without such a window have no row.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    texts = _keyed(df, id, text)
    kind = dict(texts.dtypes)["id"]
    counts = scratch.save(map_arrow(texts, _count_pass(window, gram), f"id {kind}, ta long, tb long, n_words long, grams array<long>"), "grams")
    grams = counts.filter(F.col("n_words") >= window)

    # Documents in order, in pieces: the number of a document is that of its first piece.
    pieces = F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("n_words") - 1, PIECE))).alias("piece")
    distinct = grams.select("id", "ta", "tb", "n_words").distinct().select("id", "ta", "tb", pieces)
    ordered = scratch.save(numbered(scratch, distinct, ["id", "ta", "tb", "piece"], [], "num", "of"), "pieces")
    heads = ordered.filter("piece = 0").select("id", "ta", "tb", "num")

    counted = grams.agg(F.sum(F.size("grams"))).first()[0] or 0
    found = repeated_by_sketch(scratch, grams.alias("g").join(heads.alias("h"), _same("g", "h")).select("h.num", F.explode("grams").alias("gram")), counted)
    marks = found.groupBy("num").agg(F.collect_set("gram").alias("marks"))
    marked = scratch.save(marks.join(heads, "num"), "marks")
    scratch.drop(counts, found)

    look = texts.alias("t").join(marked.alias("m"), _same("t", "m")).select("t.body", "m.num", "m.marks")
    found = map_arrow(look, _place_pass(window, gram), "a long, b long, at long")
    places = scratch.save(found.withColumn("share", F.pmod("a", F.lit(SHARES)).cast("int")), "places", partition_by="share")
    scratch.drop(marked)
    by_piece = [_later(scratch, places.filter(F.col("share") == k)) for k in range(SHARES)]
    scratch.drop(places)
    repeats = reduce(DataFrame.union, by_piece).join(ordered.select("num", "id", "ta", "tb", "piece"), "num").groupBy("id", "ta", "tb").agg(F.collect_list(F.struct("piece", "starts")).alias("repeats"))
    out = scratch.save(repeats, "repeats")
    scratch.drop(*by_piece)
    return out


def substring_dedup(df: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per row of ``df``: ``id``, ``n_words``, ``n_removed``, ``removed`` (spans of words, end exclusive) and ``kept``.

    Removed is each word covered by a window of ``window`` words that also starts earlier: in a document before
    this one, or earlier in it. Windows are judged on the input. ``kept`` has the words left, joined by one space.

    Documents are ordered by id, null ids first; of documents that share an id the order is that of two hashes
    of the text, and rows that repeat both id and text are one document, so all of them get the same result.
    A null text has no words; fewer words than a window make none. Extra columns are ignored, and names can't
    clash; an empty table gives an empty result.
    """
    if not 0 < gram < window:
        raise ValueError("a gram has fewer words than a window")
    texts = _keyed(df, id, text)
    repeats = repeated_windows(df, id, text, window, gram)
    told = texts.alias("t").join(repeats.alias("r"), _same("t", "r"), "left").select("t.id", "t.body", "r.repeats")
    kind = dict(texts.dtypes)["id"]
    spans = "array<struct<start: long, end: long>>"
    return map_arrow(told, _removal_pass(window), f"id {kind}, n_words long, n_removed long, removed {spans}, kept string").withColumnRenamed("id", id)
