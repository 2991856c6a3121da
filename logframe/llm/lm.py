"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

The most frequent words (the head) form classes of equal size by rank; all others share one class
more, in which words have their smoothed relative frequencies. The probability of a word is that of its
class given the context, times that of the word in its class given the context. Both are softmax
models over hashed features: the word before, the one before that (a skip), and the pair. Weights
start at zero, biases at the logarithms of the frequencies.

Training takes the shards of the training documents in turn. Each task adds up, for the weights its
tokens touch, how often features and outcomes occur and how often the model expects them; Spark sums
these gradients over the tasks, and the driver moves each weight by a damped logarithm of their ratio.
Texts are scored in sparse numpy batches: rows of the weight tables are gathered per token.

Words are counted over all training documents. The counts of the most frequent ones (``KNOWN``, a
bounded table) are broadcast; the words of a text beyond them are joined with their counts by shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from logframe.llm.common import Scratch, held_out, map_arrow

CLASSES = 32
MEMBERS = 32
KNOWN = 1 << 17
BUCKETS = 1 << 12
SHARDS = 4
#: A weight moves by this much of the damped log ratio; three features are active at a time.
RATE = 0.5
DAMPING = 3.0
SMOOTHING = 0.1
END = b""
CHUNK_TOKENS = 50_000
#: Distinct words that one task counts before it hands them on.
FLUSH_WORDS = 300_000

_START = -2


def tokens(text: str | None) -> list[bytes]:
    """The words, A-Z in lower case, and the end."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def handed() -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])

    for rows in batches:
        for text in rows.column(0).to_pylist():
            seen.update(tokens(text))
            if len(seen) > FLUSH_WORDS:
                yield handed()
                seen.clear()
    yield handed()


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``word`` and ``c`` over all rows; the end of a text is the empty word."""
    return map_arrow(df.select(F.col(text).alias("text")), _count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class _Index(dict):
    """Numbers of words; -1 for others."""

    def __missing__(self, word: bytes) -> int:
        return -1


class Model:
    """Known words with their counts, and biases and weights of the two softmax layers."""

    def __init__(self, words: list[bytes], counts: list[int], n: int, v: int):
        self.index = _Index(zip(words, range(len(words))))
        self.counts = np.array(counts, float)
        self.n, self.v = n, v
        head = np.zeros(CLASSES * MEMBERS)
        head[: min(len(head), len(counts))] = counts[: len(head)]
        self.n_head = min(len(head), len(counts))
        self.tail_mass = n - head.sum() + SMOOTHING * (v - self.n_head + 1)
        mass = np.append(head.reshape(CLASSES, MEMBERS).sum(axis=1), self.tail_mass)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.class_bias = np.maximum(np.log(mass / mass.sum()), -60).astype(np.float32)
            within = np.log(head.reshape(CLASSES, MEMBERS) / mass[:CLASSES, None])
        self.word_bias = np.maximum(np.nan_to_num(within, nan=-60), -60).astype(np.float32)
        self.class_weights = np.zeros((BUCKETS, CLASSES + 1), np.float32)
        self.word_weights = np.zeros((BUCKETS, MEMBERS), np.float32)

    def base_log(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + SMOOTHING) / (self.n + SMOOTHING * (self.v + 1)))


def _bucket(kind: int, *values: np.ndarray) -> np.ndarray:
    code = np.full(len(values[0]), kind, np.uint32)
    for v in values:
        code = (code ^ v.astype(np.uint32)) * np.uint32(0x9E3779B1)
        code ^= code >> np.uint32(15)
    return ((code * np.uint32(0x85EBCA77)) >> np.uint32(20)).astype(np.int64) & (BUCKETS - 1)


def _contexts(index: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before each token and the one before that; both stop at the start of a text."""
    one, two = np.empty_like(index), np.empty_like(index)
    one[1:], two[2:] = index[:-1], index[:-2]
    one[starts] = two[starts] = _START
    after = starts[starts + 1 < len(index)] + 1
    two[after] = _START
    return one, two


def _softmax(logits: np.ndarray) -> np.ndarray:
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def _layers(model: Model, index: np.ndarray, one: np.ndarray, two: np.ndarray):
    """Of both layers: features (list of bucket arrays), outcomes and probabilities; and which tokens are in the head."""
    head = (index >= 0) & (index < model.n_head)
    of = np.where(head, index // MEMBERS, CLASSES)
    features = [_bucket(1, one), _bucket(2, two), _bucket(3, one, two)]
    logits = model.class_bias + sum(model.class_weights[f] for f in features)
    inner = [_bucket(4, one[head], of[head]), _bucket(5, two[head], of[head])]
    inner_logits = model.word_bias[of[head]] + sum(model.word_weights[f] for f in inner)
    return head, (features, of, _softmax(logits)), (inner, index[head] % MEMBERS, _softmax(inner_logits))


def _batches_of_tokens(model: Model, texts: list[str | None]) -> Iterator[tuple[list[list[bytes]], np.ndarray, np.ndarray]]:
    """Texts as words, all their indices (-1: not known) and where each text starts."""
    some, size = [], 0
    for k, text in enumerate(texts):
        some.append(tokens(text))
        size += len(some[-1])
        if size >= CHUNK_TOKENS or k == len(texts) - 1:
            index = np.fromiter(map(model.index.__getitem__, chain.from_iterable(some)), np.int64, size)
            lengths = np.array([len(w) for w in some])
            yield some, index, np.cumsum(lengths) - lengths
            some, size = [], 0


def _add_by_bucket(total: np.ndarray, bucket: np.ndarray, rows: np.ndarray) -> None:
    if len(bucket):
        order = np.argsort(bucket, kind="stable")
        sorted_buckets = bucket[order]
        first = np.flatnonzero(np.append(True, sorted_buckets[1:] != sorted_buckets[:-1]))
        total[sorted_buckets[first]] += np.add.reduceat(rows[order], first, axis=0)


def gradient(df: DataFrame, model: Model, text: str = "text") -> list[tuple[np.ndarray, np.ndarray]]:
    """Of both layers the observed and the expected counts of (bucket, outcome), summed over all rows."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    widths = (CLASSES + 1, MEMBERS)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.zeros((BUCKETS, w)) for w in widths]
        expected = [np.zeros((BUCKETS, w)) for w in widths]
        for rows in batches:
            for _, index, starts in _batches_of_tokens(shared.value, rows.column(0).to_pylist()):
                one, two = _contexts(index, starts)
                for at in range(0, len(index), CHUNK_TOKENS):
                    part = slice(at, at + CHUNK_TOKENS)
                    _, *layers = _layers(shared.value, index[part], one[part], two[part])
                    for k, (features, outcome, p) in enumerate(layers):
                        for f in features:
                            seen[k] += np.bincount(f * widths[k] + outcome, minlength=seen[k].size).reshape(seen[k].shape)
                            _add_by_bucket(expected[k], f, p)
        for k in (0, 1):
            at = np.flatnonzero(expected[k].any(axis=1))
            both = np.concatenate([seen[k][at], expected[k][at]], axis=1)
            yield pa.record_batch(
                [pa.array(np.full(len(at), k), pa.int32()), pa.array(at, pa.int32()), pa.array(list(both), pa.list_(pa.float64()))], ["layer", "bucket", "sums"]
            )

    parts = map_arrow(df.select(F.col(text).alias("text")), sums, "layer int, bucket int, sums array<double>")
    total = F.array(*[F.sum(F.get("sums", F.lit(k))) for k in range(2 * max(widths))]).alias("sums")
    out = [(np.zeros((BUCKETS, w)), np.zeros((BUCKETS, w))) for w in widths]
    found = parts.groupBy("layer", "bucket").agg(total).toArrow()
    layer, bucket = found.column("layer").to_numpy(), found.column("bucket").to_numpy()
    values = np.array(found.column("sums").to_pylist(), float).reshape(-1, 2 * max(widths))
    for k, w in enumerate(widths):
        of = layer == k
        out[k][0][bucket[of]], out[k][1][bucket[of]] = values[of, :w], values[of, w : 2 * w]
    return out


def fit(df: DataFrame, counts: DataFrame, id: str = "doc_id", text: str = "text", folds: int = 10, shards: int = SHARDS) -> Model:
    """Learn from all rows of ``df`` outside fold 0, one gradient update per shard of them."""
    size = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    known = counts.orderBy(F.desc("c"), "word").limit(KNOWN).toArrow()
    model = Model(known.column("word").to_pylist(), known.column("c").to_pylist(), size["n"] or 0, size["v"])
    shard = F.pmod(F.floor(F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")), F.lit(0)) / folds), F.lit(shards))
    for k in range(shards):
        layers = gradient(df.filter(~held_out(id, folds)).filter(shard == k), model, text)
        for (seen, expected), weights in zip(layers, (model.class_weights, model.word_weights)):
            weights += RATE * np.log((seen + DAMPING) / (expected + DAMPING)).astype(np.float32)
    return model


def _score(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        task, number = TaskContext.get().partitionId() << 40, 0
        for rows in batches:
            out, rest, n_rest = [], [], []
            for some, index, starts in _batches_of_tokens(model, rows.column(1).to_pylist()):
                one, two = _contexts(index, starts)
                log = np.zeros(len(index))
                for at in range(0, len(index), CHUNK_TOKENS):
                    part = slice(at, at + CHUNK_TOKENS)
                    head, (_, of, p), (_, member, q) = _layers(model, index[part], one[part], two[part])
                    tail_log = np.log10((model.counts[np.maximum(index[part], 0)] + SMOOTHING) / model.tail_mass) if len(model.counts) else 0.0
                    here = np.log10(np.maximum(p[np.arange(len(of)), of], 1e-30).astype(float))
                    here += np.where(head | (index[part] < 0), 0.0, tail_log)
                    here[head] += np.log10(np.maximum(q[np.arange(len(member)), member], 1e-30).astype(float))
                    log[part] = here
                known = index >= 0
                base = np.where(known, model.base_log(model.counts[np.maximum(index, 0)]), 0.0) if len(model.counts) else np.zeros(len(index))
                sums = [np.add.reduceat(x, starts) for x in (log, base, known.astype(np.int64))]
                ends = np.append(starts[1:], len(index))
                for k, words in enumerate(some):
                    out.append((task + number, len(words), int(sums[2][k]), float(sums[1][k]), float(sums[0][k])))
                    number += 1
                unknown = ~known
                rest.extend(compress(chain.from_iterable(some), unknown.tolist()))
                n_rest.extend(np.add.reduceat(unknown.astype(np.int64), starts).tolist())
            yield pa.record_batch(
                [rows.column(0)]
                + [pa.array([x[k] for x in out], t) for k, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.int64()), (3, pa.float64()), (4, pa.float64()))]
                + [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_rest)), pa.int32()), pa.array(rest, pa.binary()))],
                ["id", "row_key", "n_tokens", "n_known", "base", "log", "rest"],
            )

    return score


def score_texts(df: DataFrame, id: str = "doc_id", text: str = "text", folds: int = 10) -> DataFrame:
    """Learn on the rows outside fold 0 and score every row.

    Returns ``id``, ``held_out``, ``n_tokens`` (words and the end), ``n_known`` (those seen in training),
    ``train_tokens``, ``base_score`` (log10 probability by smoothed word frequencies) and ``score`` (by
    the model). A null or empty text is the end alone; a null id is never held out; repeated rows count
    as often as they occur; without training rows every word is unknown. Other columns are ignored; an
    empty table gives an empty result.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    counts = scratch.save(word_counts(df.filter(~held_out(id, folds)), text), "counts")
    model = fit(df, counts, id, text, folds)
    kind = df.schema[id].dataType.simpleString()
    schema = f"id {kind}, row_key long, n_tokens long, n_known long, base double, log double, rest array<binary>"
    read = map_arrow(df.select(F.col(id).alias("id"), F.col(text).alias("text")), _score(spark.sparkContext.broadcast(model)), schema)
    scored = scratch.save(read, "scored")
    rest = scored.select("row_key", F.explode("rest").alias("word"))
    told = rest.join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    whole = float(max(model.n + SMOOTHING * (model.v + 1), SMOOTHING))
    more = told.groupBy("row_key").agg(
        F.sum((F.col("c") > 0).cast("long")).alias("more_known"),
        F.sum(F.log10((F.col("c") + SMOOTHING) / whole)).alias("more_base"),
        F.sum(F.log10((F.col("c") + SMOOTHING) / float(model.tail_mass))).alias("more_log"),
    )
    return scored.drop("rest").join(more, "row_key", "left").select(
        F.col("id").alias(id),
        held_out("id", folds).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("log") + F.coalesce("more_log", F.lit(0.0))).alias("score"),
    )
