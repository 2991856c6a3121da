"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, every run of other characters than letters becomes one space, and the
1-, 2- and 3-grams of what remains are hashed into a fixed number of buckets. Counts per language
come from all labelled rows of the training folds; the table of log probabilities (languages x
buckets) is broadcast, and batches of texts are scored as sparse rows times that table in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from logframe.llm.common import held_out, map_arrow, slices

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
BATCH_CHARS = 1 << 19
SMOOTHING = 0.5
UNDETERMINED = "und"

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """For each code point of the Basic Multilingual Plane, whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x10000)), bool, 0x10000)
    return _letters


def _is_letter(points: np.ndarray) -> np.ndarray:
    found = _letter_table()[np.minimum(points, 0xFFFF)]
    for i in np.flatnonzero(points > 0xFFFF):
        found[i] = chr(points[i]).isalpha()
    return found


def _grams(batch: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every n-gram, the place in the batch it belongs to, and whether each text has a letter."""
    lowered = [piece.lower() for _, piece in batch]
    points = np.frombuffer(" ".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.cumsum([len(t) + 1 for t in lowered])
    letter = _is_letter(points)
    has_letter = np.add.reduceat(np.append(letter, False), np.append(0, ends[:-1]), dtype=np.int64) > 0
    points = np.where(letter, points, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first space after a letter
    owner = np.searchsorted(ends, np.flatnonzero(keep), side="right")
    points = points[keep].astype(np.uint32)
    buckets, owners = [], []
    code = np.zeros(len(points), np.uint32)
    with np.errstate(over="ignore"):
        for n in range(1, max(ORDERS) + 1):
            rest = points[n - 1 :]
            code = code[: len(rest)] * np.uint32(0x01000193) + rest
            if n in ORDERS:
                mixed = (code + np.uint32(n)) * np.uint32(0x9E3779B1)
                inside = owner[: len(rest)] == owner[n - 1 :]
                buckets.append((mixed >> np.uint32(17))[inside])
                owners.append(owner[n - 1 :][inside])
    return np.concatenate(buckets), np.concatenate(owners), has_letter


def _strings(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of one task: (lang, bucket, n); bucket -1 holds the number of texts."""
    total: dict[str, np.ndarray] = {}
    n_texts: dict[str, int] = {}
    for rows in batches:
        langs = rows.column(1).to_pylist()
        for lang in langs:
            n_texts[lang] = n_texts.get(lang, 0) + 1
        for batch in slices(_strings(rows.column(0)), BATCH_CHARS, max(ORDERS) - 1):
            buckets, owners, _ = _grams(batch)
            names = sorted({langs[i] for i, _ in batch})
            of = np.array([names.index(langs[i]) for i, _ in batch])
            counts = np.bincount(of[owners] * BUCKETS + buckets, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
            for k, lang in enumerate(names):
                total[lang] = total[lang] + counts[k] if lang in total else counts[k].copy()
    for lang, counts in total.items():
        at = np.flatnonzero(counts)
        yield pa.record_batch(
            [pa.array([lang] * (len(at) + 1)), pa.array(np.append(-1, at), pa.int32()), pa.array(np.append(n_texts[lang], counts[at]), pa.int64())],
            ["lang", "bucket", "n"],
        )


class LanguageModel:
    """Languages and the log probability of each bucket in each, with the log prior."""

    def __init__(self, langs: list[str], log_prob: np.ndarray, log_prior: np.ndarray):
        self.langs, self.log_prob, self.log_prior = langs, log_prob, log_prior


def fit(df: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Learn from all rows with a language. What reaches the driver is languages x buckets counts."""
    counts = map_arrow(df.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("lang IS NOT NULL"), _count, "lang string, bucket int, n long")
    found = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = found.column("lang").to_pylist()
    langs = sorted(set(names))
    place = {x: k for k, x in enumerate(langs)}
    table, texts = np.zeros((len(langs), BUCKETS)), np.zeros(len(langs))
    row, bucket, n = np.array([place[x] for x in names], int), found.column("bucket").to_numpy(), found.column("n").to_numpy()
    seen = bucket >= 0
    table[row[seen], bucket[seen]] = n[seen]
    texts[row[~seen]] = n[~seen]
    table += SMOOTHING
    log_prob = np.log(table / table.sum(axis=1, keepdims=True))
    return LanguageModel(langs, np.ascontiguousarray(log_prob.T), np.log(texts / max(texts.sum(), 1)))


def tag(df: DataFrame, model: LanguageModel, text: str = "text", lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """All columns of ``df`` with the predicted language and its posterior probability.

    A text without a letter, a null one too, and every text if nothing was learned, is ``und`` with score 0.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    place = df.columns.index(text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for rows in batches:
            texts = _strings(rows.column(place))
            total = np.tile(known.log_prior, (len(texts), 1))
            lettered = np.zeros(len(texts), bool)
            for batch in slices(texts, BATCH_CHARS, max(ORDERS) - 1) if known.langs else ():
                buckets, owners, has_letter = _grams(batch)
                at = np.array([i for i, _ in batch])
                np.logical_or.at(lettered, at, has_letter)
                for k in range(len(known.langs)):
                    np.add.at(total[:, k], at, np.bincount(owners, known.log_prob[buckets, k], len(batch)))
            if known.langs:
                share = np.exp(total - total.max(axis=1, keepdims=True))
                share /= share.sum(axis=1, keepdims=True)
                best = share.argmax(axis=1)
                langs = [known.langs[b] if ok else UNDETERMINED for b, ok in zip(best, lettered)]
                scores = np.where(lettered, share[np.arange(len(best)), best], 0.0)
            else:
                langs, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            yield pa.record_batch([*rows.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*rows.schema.names, lang_name, score_name])

    schema = T.StructType([*df.schema.fields, T.StructField(lang_name, T.StringType()), T.StructField(score_name, T.DoubleType())])
    return map_arrow(df, score, schema)


def identify(df: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 5) -> DataFrame:
    """Learn on the rows whose crc32 of the id, modulo ``folds``, is not 0, and predict every row.

    Returns ``id``, ``held_out``, ``lang_pred`` and ``score``. Rows without a language teach nothing
    but are predicted; a null id is never held out; repeated rows count as often as they occur. Only
    text is an input of a prediction. Other columns are ignored; an empty table gives an empty result.
    """
    model = fit(df.filter(~held_out(id, folds)), text, lang)
    return tag(df.select(id, text), model, text).select(id, held_out(id, folds).alias("held_out"), "lang_pred", "score")


def reject_unknown(df: DataFrame, text: str = "text", id: str = "doc_id", lang: str = "lang", folds: int = 5, least: float = 0.3) -> DataFrame:
    """The rows of ``df`` whose text has a language: one with a letter, and a posterior of ``least`` at least."""
    model = fit(df.filter(~held_out(id, folds)), text, lang)
    pred, score = (name + "_" * (1 + max(map(len, df.columns))) for name in ("pred", "score"))  # longer than any name of df
    tagged = tag(df, model, text, pred, score)
    return tagged.filter((F.col(pred) != UNDETERMINED) & (F.col(score) >= least)).drop(pred, score)
