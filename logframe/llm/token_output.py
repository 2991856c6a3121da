"""Token ids as binary files: frequency-ranked, in a byte-aligned code of variable length.

Ids are replaced by their rank in frequency, so that the most frequent 256 take one byte. A rank takes
one to four bytes, least significant first; the lengths, less one, are kept apart in control bytes of
two bits each, four to a byte, lowest bits first. A decoder looks up in a table, for each control
byte, where its four values begin and end, and gathers all bytes of a block at once in numpy.

The files are Parquet. ``ranks``: one row, ``ids`` (32-bit ids by rank). ``blocks``: folders
``part=N`` in ascending order of document id; each row is a block of whole documents, ascending too,
with ``block`` (its number in the part), ``part_offset`` (tokens of the part before it), ``doc_ids``,
``counts`` (tokens per document), ``control`` and ``data``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from logframe.llm.common import Scratch, map_arrow
from logframe.llm.tokens import word_cache

END_ID = 2
#: A block is closed once it holds this many tokens.
BLOCK_TOKENS = 1 << 18

#: For each control byte the lengths of its four values.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def encode(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of 32-bit values."""
    values = values.astype(np.uint32)
    length = 1 + (values > 0xFF) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = length - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    four = values.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.tobytes(), four[np.arange(4) < length[:, None]].tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values of a block."""
    control_bytes = np.frombuffer(control, np.uint8)
    length = LENGTHS[control_bytes].ravel()[:n]
    start = np.cumsum(length) - length
    padded = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.uint32)
    word = padded[start] | padded[start + 1] << 8 | padded[start + 2] << 16 | padded[start + 3] << 24
    return word & _MASKS[length]


def _stage(tokenizer: str, end_id: int):
    """Rows sorted by id to blocks of plain ids."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_cache(tokenizer, leading_space=True)
        part, number, offset = TaskContext.get().partitionId(), 0, 0
        for rows in batches:
            names = rows.column(0)
            found, counts = encoder.encode(rows.column(1))
            counts += 1
            ends = np.cumsum(counts)
            ids = np.full(len(found) + len(counts), end_id, "<u4")
            inner = np.ones(len(ids), bool)
            inner[ends - 1] = False
            ids[inner] = found
            out, a, at = [], 0, 0
            while a < len(counts):
                b = min(int(np.searchsorted(ends, at + BLOCK_TOKENS)) + 1, len(counts))
                until = int(ends[b - 1])
                out.append((number, offset, names.slice(a, b - a).to_pylist(), counts[a:b].tolist(), ids[at:until].tobytes()))
                number, offset, a, at = number + 1, offset + until - at, b, until
            yield pa.record_batch(
                [
                    pa.array([part] * len(out), pa.int32()),
                    pa.array([x[0] for x in out], pa.int32()),
                    pa.array([x[1] for x in out], pa.int64()),
                    pa.array([x[2] for x in out], pa.list_(names.type)),
                    pa.array([x[3] for x in out], pa.list_(pa.int64())),
                    pa.array([x[4] for x in out], pa.binary()),
                ],
                ["part", "block", "part_offset", "doc_ids", "counts", "ids"],
            )

    return blocks


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for rows in batches:
        for ids in rows.column(0):
            found = np.bincount(np.frombuffer(ids.as_buffer(), "<u4"), minlength=len(total))
            found[: len(total)] += total
            total = found
    at = np.flatnonzero(total)
    yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])


def _blocks_schema(id_type: str) -> str:
    return f"part int, block int, part_offset long, doc_ids array<{id_type}>, counts array<bigint>, control binary, data binary"


class TokenFiles:
    """Written token files: ``path`` holds ``ranks`` and ``blocks``."""

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint"):
        self.spark, self.path, self.id_type = spark, path, id_type

    def blocks(self) -> DataFrame:
        return self.spark.read.schema(_blocks_schema(self.id_type)).parquet(f"{self.path}/blocks")

    def ranks(self) -> np.ndarray:
        return np.frombuffer(self.spark.read.parquet(f"{self.path}/ranks").first()["ids"], "<u4")

    def documents(self, id: str = "doc_id") -> DataFrame:
        """Every document decoded: ``id``, ``start``, ``n_tokens``, ``ids_crc32``, in no particular order.

        ``start`` is the number of ids of all documents before it, ``ids_crc32`` the unsigned crc32 of
        its ids as little-endian unsigned 32-bit integers.
        """
        blocks = self.blocks()
        parts = blocks.groupBy("part").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
        earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as files
        starts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_start"))
        ranks = self.spark.sparkContext.broadcast(self.ranks())

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                for k in range(rows.num_rows):
                    start, counts = rows.column(0)[k].as_py(), rows.column(2)[k].values.to_numpy()
                    ids = ranks.value[decode(rows.column(3)[k].as_py(), rows.column(4)[k].as_py(), int(counts.sum()))].astype("<u4")
                    ends = np.cumsum(counts)
                    crc = [zlib.crc32(ids[b - n : b].tobytes()) for n, b in zip(counts, ends)]
                    yield pa.record_batch(
                        [rows.column(1)[k].values, pa.array(start + ends - counts), pa.array(counts), pa.array(crc, pa.int64())],
                        ["id", "start", "n_tokens", "ids_crc32"],
                    )

        placed = blocks.join(F.broadcast(starts) if parts.count() <= 100_000 else starts, "part")
        decoded = map_arrow(
            placed.select((F.col("part_start") + F.col("part_offset")).alias("start"), "doc_ids", "counts", "control", "data"),
            read,
            f"id {self.id_type}, start long, n_tokens long, ids_crc32 long",
        )
        return decoded.withColumnRenamed("id", id)


def write_tokens(df: DataFrame, tokenizer: str, path: str, id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> TokenFiles:
    """Encode all texts and write them in ascending order of ``id`` under ``path``.

    Each document's ids end in ``end_id``; a null or empty text has that alone. Null ids come first;
    documents that share an id are ordered by a hash of their text, repeated rows stay. Other columns are
    ignored; an empty table gives files without documents. The driver gets one count per token id.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    kind = df.schema[id].dataType.simpleString()
    rows = df.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(F.col("id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("id").asc_nulls_first(), "tie")
    staged = scratch.save(map_arrow(ordered.select("id", "text"), _stage(tokenizer, end_id), _blocks_schema(kind).replace("control binary, data binary", "ids binary")), "staged")
    counts = map_arrow(staged.select("ids"), _count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    by_rank = sorted(((-n, i) for i, n in counts.collect()))
    ids = np.array([i for _, i in by_rank], "<u4")
    rank_of = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.uint32)
    rank_of[ids] = np.arange(len(ids))
    shared = spark.sparkContext.broadcast(rank_of)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            coded = [encode(shared.value[np.frombuffer(x.as_buffer(), "<u4")]) for x in rows.column(5)]
            yield pa.record_batch(
                [*rows.columns[:5], pa.array([c for c, _ in coded], pa.binary()), pa.array([d for _, d in coded], pa.binary())],
                ["part", "block", "part_offset", "doc_ids", "counts", "control", "data"],
            )

    coded = map_arrow(staged, code, _blocks_schema(kind))
    coded.write.partitionBy("part").option("compression", "uncompressed").parquet(f"{path}/blocks")
    spark.createDataFrame([(bytearray(ids.tobytes()),)], "ids binary").coalesce(1).write.parquet(f"{path}/ranks")
    scratch.drop(staged)
    return TokenFiles(spark, path, kind)
