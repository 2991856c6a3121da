"""Personal data by weak supervision: labelers vote, their reliabilities are estimated, a classifier decides.

Fixed patterns give the base spans (email, ip, card, phone), which always stay. Looser patterns give
further candidates: spelled-out addresses, phone numbers without a country code, long digit chains.
Five labelers look at each candidate and vote yes, no or nothing: the strict pattern (regex), known
endings, prefixes and ranges (gazetteer), the words before it (context), a check of its digits, and
its surroundings. Expectation-maximisation over the counts of all vote patterns of all documents
estimates how each labeler votes on true and false candidates; the posteriors train a logistic
classifier on features of the span, which adds the candidates it is sure of.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logframe.llm.common import map_arrow

KINDS = ("email", "ip", "card", "phone")
#: A candidate that is no base span is added from this probability on.
SURE = 0.9
ROUNDS = 50

# Base patterns. Possessive repeats and the look-behind change no match: a run of digits that fails
# from its first digit fails from the others too.
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Looser ones.
_SPELLED = re.compile(r"\x20?(?:\[at\]|\(at\)|\x20at\x20)\x20?[A-Za-z0-9-]+\x20?(?:\[dot\]|\(dot\)|\x20dot\x20)\x20?[A-Za-z]{2,}", re.I)
_LOCAL_PHONE = re.compile(r"(?<![0-9+.\x20()-])\x20?\(?[0-9]{3,4}\)?[\x20.-][0-9]{3}[\x20.-]?[0-9]{4}(?![0-9.-])")

#: Gazetteers: common endings of addresses, first digits of payment cards, country calling codes.
ENDINGS = frozenset("com org net edu gov info io co uk de fr es it eu us ch at example test".split())
CARD_STARTS = frozenset("3456")
CALLING_CODES = frozenset("1 33 34 39 41 43 44 46 49 52 54 55 61 81 86 91".split())
#: Context words by kind, and words that speak against any kind.
CONTEXT = {
    "email": re.compile(r"mail|contact|write|reach|kontakt|correo|courriel", re.I),
    "ip": re.compile(r"\bip\b|address|server|host|login|adresse", re.I),
    "card": re.compile(r"card|visa|credit|payment|pay|karte|carte|tarjeta", re.I),
    "phone": re.compile(r"phone|call|tel|mobile|fax|anruf|appel|llam", re.I),
}
AGAINST = re.compile(r"version|order|invoice|serial|isbn|release|number of|figure|table", re.I)
CONTEXT_CHARS = 32


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _left(text: str, at: int, floor: int) -> int:
    while at > floor and text[at - 1] in _LOCAL:
        at -= 1
    return at


def _matches(text: str) -> Iterator[tuple[int, int, int, bool]]:
    """All matches of the base patterns, whether or not they hold their conditions: kind, start, end, held."""
    if "@" in text:
        floor = 0
        for m in _AT.finditer(text):
            start = _left(text, m.start(), floor)
            if start < m.start():
                yield 0, start, m.end(), True
                floor = m.end()
    for m in _IP.finditer(text):
        yield 1, m.start(), m.end(), all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _digits(m[0])
            yield 2, m.start(), m.end(), 16 <= len(digits) <= 19 and _luhn(digits)
    if "+" in text:
        for m in _PHONE.finditer(text):
            yield 3, m.start(), m.end(), 8 <= len(_digits(m[0])) <= 15


def candidates(text: str) -> list[tuple[int, int, int, bool]]:
    """Base spans (marked True) and further candidates that overlap none of them."""
    found = sorted(_matches(text))
    base = [x for x in found if x[3]]
    more = [x for x in found if not x[3] and (x[0] != 2 or 13 <= len(_digits(text[x[1] : x[2]])) <= 19)]
    for m in _SPELLED.finditer(text):
        if (start := _left(text, m.start(), 0)) < m.start():
            more.append((0, start, m.end(), False))
    for m in _LOCAL_PHONE.finditer(text):
        more.append((3, m.start() + (m[0][0] == " "), m.end(), False))
    if not more:
        return base
    taken = sorted((s, e) for _, s, e, _ in base)
    out, last = list(base), -1
    for k, s, e, _ in sorted(more, key=lambda x: (x[1], -x[2])):
        at = int(np.searchsorted([t[0] for t in taken], e)) if taken else 0
        if s >= last and (at == 0 or max(t[1] for t in taken[:at]) <= s):
            out.append((k, s, e, False))
            last = e
    return out


def _votes(text: str, kind: int, start: int, end: int, held: bool) -> tuple[int, ...]:
    """The labelers' votes: regex, gazetteer, context, digits, surroundings; 1 yes, 2 no, 0 none."""
    span, digits = text[start:end], _digits(text[start:end])
    before = text[max(0, start - CONTEXT_CHARS) : start]
    if kind == 0:
        known = 1 if re.split(r"[^A-Za-z]", span)[-1].lower() in ENDINGS else 2
        check = 2 if ".." in span or span[0] in ".-" else 1 if held else 0
    elif kind == 1:
        known = 1 if span.split(".")[0] in ("10", "127", "172", "192") else 0
        check = 1 if held and not any(len(x) > 1 and x[0] == "0" for x in span.split(".")) else 2
    elif kind == 2:
        known = 1 if digits[0] in CARD_STARTS else 2
        check = 1 if _luhn(digits) else 2
    else:
        known = (1 if any(digits.startswith(c) for c in CALLING_CODES) else 2) if span[0] == "+" else 0
        check = 2 if len(set(digits)) <= 2 else 1 if 8 <= len(digits) <= 15 else 2
    context = 2 if AGAINST.search(before) else 1 if CONTEXT[KINDS[kind]].search(before) else 0
    edges = text[start - 1 : start] + text[end : end + 1]
    around = 2 if any(c.isalnum() or c in "-_/=" for c in edges) else 1
    return 1 if held else 0, known, context, check, around


def _traits(text: str, kind: int, start: int, end: int) -> tuple[int, ...]:
    """Small categories that describe a span to the classifier, without its votes."""
    span = text[start:end]
    digits = len(_digits(span))
    marks = sum(1 << k for k, c in enumerate("@.-(+ ") if c in span)
    spread = min(len(re.findall(r"[0-9]+", span)), 7)
    before = text[max(0, start - CONTEXT_CHARS) : start]
    return kind, min(digits, 20), marks, spread, int(bool(CONTEXT[KINDS[kind]].search(before))), int(bool(AGAINST.search(before)))


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for rows in batches:
        for text in rows.column(0).to_pylist():
            for kind, start, end, held in candidates(text or ""):
                seen[" ".join(map(str, (kind, *_votes(text, kind, start, end, held), *_traits(text, kind, start, end))))] += 1
    yield pa.record_batch([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["pattern", "n"])


N_VOTES = 5


def reliabilities(kind: np.ndarray, votes: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns with their counts.

    Returns each pattern's probability of being personal data, and for each labeler the probability of
    its votes (none, yes, no) on false and on true candidates.
    """
    balance = (votes == 1).sum(axis=1) - (votes == 2).sum(axis=1)
    p = 1 / (1 + np.exp(-balance.astype(float)))
    table = np.zeros((N_VOTES, 2, 3))
    for _ in range(rounds):
        prior = np.full(len(KINDS), 0.5)
        for k in range(len(KINDS)):
            of = kind == k
            prior[k] = (1 + (n * p)[of].sum()) / (2 + n[of].sum())
        for j in range(N_VOTES):
            for v in range(3):
                of = votes[:, j] == v
                table[j, 1, v], table[j, 0, v] = 1 + (n * p)[of].sum(), 1 + (n * (1 - p))[of].sum()
        table /= table.sum(axis=2, keepdims=True)
        log = np.log(table)[np.arange(N_VOTES), :, votes].sum(axis=1)
        p = 1 / (1 + np.exp(np.clip(np.log(1 - prior[kind]) + log[:, 0] - np.log(prior[kind]) - log[:, 1], -50, 50)))
    return p, table


def _design(traits: np.ndarray) -> np.ndarray:
    """One column per kind, digit range, mark, number of digit groups and context."""
    kind, digits, marks, spread, context, against = traits.T
    columns = [kind == k for k in range(4)] + [(kind == k) & (digits // 4 == d) for k in range(4) for d in range(6)]
    columns += [(marks >> k) & 1 for k in range(6)] + [spread == s for s in range(8)] + [context, against]
    return np.stack(columns, axis=1).astype(float)


class SpanModel:
    """Labeler reliabilities and the weights of the span classifier, from counts of patterns."""

    def __init__(self, patterns: np.ndarray, n: np.ndarray):
        kind, votes, traits = patterns[:, 0], patterns[:, 1 : 1 + N_VOTES], patterns[:, 1 + N_VOTES :]
        self.posterior, self.table = reliabilities(kind, votes, n)
        x = _design(traits)
        self.weights = np.zeros(x.shape[1])
        for _ in range(30):  # Newton steps of a ridge-regularised logistic regression on the posteriors
            p = 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))
            slope = x.T @ (n * (self.posterior - p)) - self.weights
            self.weights += np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.eye(x.shape[1]), slope)

    def probability(self, traits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_design(traits) @ self.weights, -30, 30)))


def fit(df: DataFrame, text: str = "text") -> SpanModel | None:
    """Learn from the candidates of all rows; None if there are none.

    The driver gets one row per pattern of votes and traits; their number is bounded by the categories.
    """
    counts = map_arrow(df.select(F.col(text).alias("text")), _patterns, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    rows = sorted((tuple(map(int, r["pattern"].split())), r["n"]) for r in counts.collect())
    return SpanModel(np.array([p for p, _ in rows]), np.array([n for _, n in rows], float)) if rows else None


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find_pii(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The spans of personal data of every document.

    Returns ``id``, ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` (base spans), ``base_sha256`` (of the base
    spans written as kind:start:end, joined by commas, by kind and start, in code points), ``spans`` (all
    of them, written likewise) and ``n_added``. A null or empty text has none. Ids may repeat or be null;
    other columns are ignored; an empty table gives an empty result. Texts are read twice.
    """
    shared = df.sparkSession.sparkContext.broadcast(fit(df, text))
    kind = df.schema[id].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            counts, digest, spans, added = [], [], [], []
            for t in rows.column(1).to_pylist():
                found = candidates(t or "")
                base = sorted(x[:3] for x in found if x[3])
                loose = [x[:3] for x in found if not x[3]]
                if loose:
                    sure = shared.value.probability(np.array([_traits(t, *x) for x in loose])) >= SURE
                    loose = [x for x, s in zip(loose, sure) if s]
                counts.append([sum(x[0] == k for x in base) for k in range(len(KINDS))])
                digest.append(hashlib.sha256(_written(base).encode()).hexdigest())
                spans.append(_written(sorted(base + loose)))
                added.append(len(loose))
            by_kind = np.array(counts, np.int64).reshape(-1, len(KINDS))
            yield pa.record_batch(
                [rows.column(0), *[pa.array(by_kind[:, k]) for k in range(len(KINDS))], pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())],
                ["id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"],
            )

    schema = f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return map_arrow(df.select(F.col(id).alias("id"), F.col(text).alias("text")), find, schema).withColumnRenamed("id", id)
