"""Quality classifier: regularised quadratic discriminant analysis of document statistics.

Each text becomes a short vector of transformed statistics. Of the labelled training rows, class
means and covariances follow from sums that Spark adds up; covariances are shrunk towards the
diagonal of the pooled one. A text's score is the logistic of the difference of the two classes'
log densities (Mahalanobis distances through Cholesky factors kept in the model) and log priors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logframe.llm.common import Scratch, fold, held_out, map_arrow

SHRINKAGE = 0.1
#: Log densities are divided by this before the logistic, so that scores do not all end at 0 or 1.
TEMPERATURE = 4.0
THRESHOLD = 0.3
FEATURES = (
    "log_words", "word_length", "upper", "digit", "punctuation", "shout", "symbol", "bar", "other_ascii",
    "distinct_words", "distinct_lines", "longest_word", "top_word", "plain_words", "line_words", "symbol_words",
)

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = b"0123456789"
_PUNCTUATION = b".,;:'\"()-"
_SHOUT = b"!?"
_SYMBOL = b"#*$%&<>"
_BAR = b"|"
_REST = bytes(c for c in range(33, 127) if c not in _UPPER + _LOWER + _DIGIT + _PUNCTUATION + _SHOUT + _SYMBOL + _BAR)


def _share(part: float, whole: float) -> float:
    """A proportion on a log scale; 0.002 keeps a few stray characters near zero."""
    return float(np.log(0.002 + part / whole))


def statistics(text: str) -> list[float]:
    """The transformed statistics of one text, in the order of ``FEATURES``. The empty text has them too."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = max(len(words), 1), max(len(raw), 1)
    count = lambda kind: len(raw) - len(raw.translate(None, kind))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lengths = sum(map(len, words))
    return [
        float(np.log1p(len(words))),
        float(np.log((1 + lengths) / (n + 0.2))),
        _share(count(_UPPER), size),
        _share(count(_DIGIT), size),
        _share(count(_PUNCTUATION), size),
        _share(count(_SHOUT), size),
        _share(count(_SYMBOL), size),
        _share(count(_BAR), size),
        _share(count(_REST), size),
        float(np.log(0.02 + len(seen) / n)) + 0.3 * float(np.log1p(len(words))),
        _share(len(lines) - len(set(lines)), max(len(lines), 1)),
        float(np.log1p(max(map(len, words), default=0))),
        _share(max(seen.values(), default=0), n),
        _share(sum(w.isalpha() and w.islower() for w in words), n),
        float(np.log1p(len(words) / max(len(lines), 1))),
        _share(sum(c for w, c in seen.items() if not w[-1:].isalnum() and w[-1] not in b".,;:|" and w[-1] < 128), n),
    ]


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per class of one task: the number of rows, the sum of the vectors and of their products, as one array."""
    d = len(FEATURES)
    total = np.zeros((2, 1 + d + d * d))
    for rows in batches:
        label = rows.column(0).to_numpy()
        x = np.array(rows.column(1).to_pylist(), float).reshape(-1, d)
        for k in (0, 1):
            v = x[label == k]
            total[k] += np.concatenate([[len(v)], v.sum(axis=0), (v.T @ v).ravel()])
    k, i = np.indices(total.shape)
    yield pa.record_batch([pa.array(k.ravel(), pa.int32()), pa.array(i.ravel(), pa.int32()), pa.array(total.ravel())], ["label", "place", "value"])


class Discriminant:
    """Class means, Cholesky factors of the shrunk covariances, log determinants and log priors."""

    def __init__(self, moments: np.ndarray, shrinkage: float = SHRINKAGE):
        d = len(FEATURES)
        n = moments[:, 0]
        self.only = None if n.min() >= 2 else float((n[1] + 0.5) / (n.sum() + 1))
        if self.only is not None:
            return
        self.mean = moments[:, 1 : 1 + d] / n[:, None]
        spread = moments[:, 1 + d :].reshape(2, d, d) / n[:, None, None] - self.mean[:, :, None] * self.mean[:, None, :]
        pooled = np.diag((spread * n[:, None, None]).sum(axis=0)) / n.sum()
        target = np.diag(np.maximum(pooled, 0) + 1e-3)
        self.factor = np.linalg.cholesky((1 - shrinkage) * spread + shrinkage * target)
        self.log_det = 2 * np.log(np.diagonal(self.factor, axis1=1, axis2=2)).sum(axis=1)
        self.log_prior = np.log(n / n.sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1; the share of label 1 if a class has fewer than two rows."""
        if self.only is not None:
            return np.full(len(x), self.only)
        density = []
        for k in (0, 1):
            z = np.linalg.solve(self.factor[k], (x - self.mean[k]).T)
            density.append(self.log_prior[k] - 0.5 * (self.log_det[k] + (z * z).sum(axis=0)))
        return 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / TEMPERATURE, -50, 50)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        x = [statistics(t or "") for t in rows.column(1).to_pylist()]
        yield pa.record_batch([rows.column(0), pa.array(x, pa.list_(pa.float64()))], ["id", "x"])


def classify(df: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    """Score every row of ``df``; learn from its rows that ``labels`` marks 0 or 1, outside fold 0.

    Returns ``id``, ``held_out``, ``score`` (0 to 1, higher: label 1 likelier) and ``predicted``. A null
    text is scored as the empty one; a null id has no label and is never held out; null labels teach
    nothing, repeated ones count as often as they occur. Only text is an input of a score. If a class
    has fewer than two rows, every score is the share of label 1 (0.5 without labels). Other columns
    are ignored; an empty table gives an empty result.
    """
    spark = df.sparkSession
    kind = df.schema[id].dataType.simpleString()
    x = map_arrow(df.select(F.col(id).alias("id"), F.col(text).alias("text")), _features, f"id {kind}, x array<double>")
    vectors = Scratch(spark).save(x, "statistics")
    marks = labels.select(F.col(id).alias("id"), F.col(label).cast("int").alias("label")).filter("label IN (0, 1)").filter(fold("id", folds) != 0)
    found = map_arrow(vectors.join(marks, "id").select("label", "x"), _moments, "label int, place int, value double")
    sums = np.zeros((2, 1 + len(FEATURES) + len(FEATURES) ** 2))
    for k, i, value in found.groupBy("label", "place").agg(F.sum("value")).collect():
        sums[k, i] = value
    shared = spark.sparkContext.broadcast(Discriminant(sums))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            x = np.array(rows.column(1).to_pylist(), float).reshape(-1, len(FEATURES))
            yield pa.record_batch([rows.column(0), pa.array(shared.value.score(x))], ["id", "score"])

    scored = map_arrow(vectors, score, f"id {kind}, score double")
    return scored.select(
        F.col("id").alias(id), held_out("id", folds).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
