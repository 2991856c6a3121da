"""Best-fit packing of token sequences by exact-complement hashing.

Only lengths matter for a packing, and there are at most ``capacity`` of them. So documents become
pieces, pieces are counted by length, and the plan is made on the counts: for each length, from long
to short, singles, pairs and triples whose lengths sum up to exactly the gap are consumed as often as
their counts allow; what remains is packed best-fit, longest first. The plan says which numbers of
each length go to which sequences. Each piece gets its number among those of its length from its
task's running count and the counts of the tasks before, and looks its place up in the plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from logframe.llm.common import Scratch, map_arrow
from logframe.llm.tokens import word_cache

CAPACITY = 2048
END_ID = 0


def pieces(df: DataFrame, tokenizer: str, id: str, text: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``id``, ``piece``, ``start``, ``length``, ``ids_crc32``, the task and the number among its pieces of that length."""
    kind = df.schema[id].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_cache(tokenizer, leading_space=False)
        end, task, met = np.array([end_id], "<u4"), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for rows in batches:
            row, piece, start, length, crc, local = [], [], [], [], [], []
            found, counts = encoder.encode(rows.column(1))
            for i, ids in zip(range(len(counts)), np.split(found.astype("<u4"), np.cumsum(counts)[:-1])):
                ids = np.append(ids, end)
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part))
                    local.append(met[len(part)])
                    met[len(part)] += 1
            yield pa.record_batch(
                [rows.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32())]
                + [pa.array(c, pa.int64()) for c in (start, length, crc, local)]
                + [pa.array([task] * len(row), pa.int32())],
                ["id", "piece", "start", "length", "ids_crc32", "local", "task"],
            )

    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, local long, task int"
    return map_arrow(df.select(F.col(id).alias("id"), F.col(text).alias("text")), cut, schema)


class Plan:
    """Patterns of lengths with their multiplicity, made on a table of counts by length."""

    def __init__(self, counts: np.ndarray):
        self.capacity = len(counts) - 1
        self.left = counts.astype(np.int64).copy()
        self.patterns: list[tuple[tuple[int, ...], int]] = []
        for length in range(self.capacity, 0, -1):
            if 4 * length >= self.capacity:
                self._complements(length)
        self._best_fit()

    def _take(self, *lengths: int) -> None:
        """Consume a combination as often as the counts allow."""
        times = min(int(self.left[x]) // lengths.count(x) for x in lengths)
        if times:
            for x in lengths:
                self.left[x] -= times
            self.patterns.append((lengths, times))

    def _pairs(self, total: int) -> Iterator[tuple[int, int]]:
        """Available pairs of lengths with this sum, the longer one first, most unequal first."""
        longer = np.arange(total - 1, (total - 1) // 2, -1)
        for a in longer[(self.left[longer] > 0) & (self.left[total - longer] > 0)]:
            yield int(a), total - int(a)

    def _complements(self, length: int) -> None:
        gap = self.capacity - length
        if not self.left[length]:
            return
        if gap == 0:
            self._take(length)
            return
        self._take(length, gap)
        for a, b in self._pairs(gap):
            if not self.left[length]:
                return
            self._take(length, a, b)
        for a in range(gap - 2, (gap - 1) // 3, -1):
            if not self.left[length]:
                return
            if self.left[a]:
                for b, c in self._pairs(gap - a):
                    if b <= a:
                        self._take(length, a, b, c)
                    if not self.left[length] or not self.left[a]:
                        break

    def _best_fit(self) -> None:
        """Pack what is left, longest first, each into the fullest sequence with room for it."""
        open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
        has_room = np.zeros(self.capacity + 1, bool)

        def put(gap: int, lengths: tuple[int, ...], times: int) -> None:
            open_bins.setdefault(gap, []).append((lengths, times))
            has_room[gap] = True

        for length in range(self.capacity, 0, -1):
            n = int(self.left[length])
            while n:
                room = length + int(has_room[length:].argmax())
                if not has_room[room]:
                    fit = self.capacity // length
                    full, rest = divmod(n, fit)
                    if full:
                        put(self.capacity - fit * length, (length,) * fit, full)
                    if rest:
                        put(self.capacity - rest * length, (length,) * rest, 1)
                    break
                lengths, times = open_bins[room].pop()
                has_room[room] = bool(open_bins[room])
                fit = min(room // length, n)  # one sequence takes several, as best fit would
                used = min(times, max(n // fit, 1))
                if used < times:
                    put(room, lengths, times - used)
                put(room - fit * length, lengths + (length,) * fit, used)
                n -= used * fit
            self.left[length] = 0
        for bins in open_bins.values():
            self.patterns.extend(bins)

    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per interval of numbers of one length: its key (length, first number), first sequence and offset."""
        used = np.zeros(self.capacity + 1, np.int64)
        key, sequence, offset, first = [], [], [], 0
        for lengths, times in self.patterns:
            at = 0
            for length in lengths:
                key.append((length << 48) + int(used[length]))
                sequence.append(first)
                offset.append(at)
                used[length] += times
                at += length
            first += times
        order = np.argsort(np.array(key, np.int64), kind="stable")
        return tuple(np.array(x, np.int64)[order] for x in (key, sequence, offset))


def pack(df: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Where every piece of every document goes, in as few sequences of ``capacity`` tokens as it can.

    One row per piece: ``id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``,
    ``offset``. A document's ids end in ``end_id``; only longer ones are cut, and the last piece may be
    shorter. A null or empty text is a piece of the end id alone. Repeated rows are packed as often as
    they occur; a null id is carried along. Other columns are ignored; an empty table gives an empty
    result. The driver gets the counts by length and the plan, whose size the capacity bounds.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    cut = scratch.save(pieces(df, tokenizer, id, text, capacity, end_id), "pieces")
    by_task = scratch.save(cut.groupBy("task", "length").agg(F.count("*").alias("n")), "counts")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in by_task.groupBy("length").agg(F.sum("n")).collect():
        counts[length] = n
    plan = spark.sparkContext.broadcast(Plan(counts).places())
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    kind = df.schema[id].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sequence, offset = plan.value
        for rows in batches:
            number = rows.column(5).to_numpy()
            wanted = (rows.column(3).to_numpy() << 48) + number
            at = np.searchsorted(key, wanted, side="right") - 1
            yield pa.record_batch(
                [*rows.columns[:5], pa.array(sequence[at] + (wanted - key[at])), pa.array(offset[at])],
                ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    numbered = cut.join(offsets, ["task", "length"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("local") + F.col("before")).alias("number"))
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return map_arrow(numbered, place, schema).withColumnRenamed("id", id)
