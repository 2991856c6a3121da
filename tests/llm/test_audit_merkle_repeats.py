"""Filter audit (11), Merkle manifest (12) and substring duplicates (13) against brute force."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from logframe.llm import filter_audit, merkle, substring_dedup
from logframe.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
#: Columns beyond those of documents have the names that the operators use inside.
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, n long, tree string, part string, id long, num long, mask int, first string"
SONG = " ".join(f"word{k}" for k in range(30))
ODD = [
    (1, "a", "en", 4, None),
    (2, "a", "en", None, ""),
    (None, None, None, 3, "no id at all, but words"),
    (None, None, None, None, None),
    (None, None, "", 1, f"before {SONG} after"),
    (5, "b", "en", 9, f"{SONG} and then {SONG} again"),
    (6, "b", "en", 9, f"{SONG} and then {SONG} again"),
    (6, "b", "en", 9, f"{SONG} and then {SONG} again"),
    (6, "c", "de", 9, f"other text, same id {SONG}"),
    (7, "é", "de", 9, "Ärger MIT Großen BUCHSTABEN | und # zeichen"),
    (9_007_199_254_740_993, "a", "fr", 9, "x" * 70_000 + " " + "la " * 400),
    (10, "a", "fr", 9, "many different words " + " ".join(f"v{k}" for k in range(300))),
    (-3, "a", "fr", 9, "THE END " * 250),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 1, "t", "p", 2, 3, 4, "f") for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables")
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (1, 0, 1), (5, 1, 1), (6, None, 1), (None, 1, 1), (77, 1, 1), (10, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_audit(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    seen, docs = {}, []
    for i, _, text in rows:
        if i is not None:
            seen[text] = min(i, seen.get(text, i))
    for i, part, text in rows:
        w = words_of(text)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": re.search("[#$%&*|]", text) is not None,
            "E": i is not None and i > seen[text],
        }
        docs.append((part, {f for f, x in fails.items() if x}, i in good, i in toxic))
    out, shares = {}, Counter()
    for part in {d[0] for d in docs}:
        for order in map("".join, permutations("ABCDE")):
            left = [d for d in docs if d[0] == part]
            for step, f in enumerate(order, 1):
                hit = [d for d in left if f in d[1]]
                failing = sum(f in d[1] for d in docs if d[0] == part)
                only = sum(d[1] == {f} for d in docs if d[0] == part)
                left = [d for d in left if f not in d[1]]
                out[part, order, step] = (len(left), len(hit), failing - len(hit), only, sum(d[2] for d in hit), sum(d[3] for d in hit), f)
                shares[part, f] += len(hit)
    return {(*k, *v[:6], shares[k[0], v[6]]) for k, v in out.items()}


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_op11(request, labels, table):
    df = request.getfixturevalue(table)
    rows = [(r["doc_id"], r["lang"] or "", r["text"] or "") for r in df.collect()]
    got = filter_audit.audit(df, labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {tuple(r) for r in got.collect()} == brute_audit(rows, [tuple(r) for r in labels.collect()])


def test_op11_general_game(spark):
    """Three filters, one count: the glove game's values are known (1/6, 1/6, 4/6 of one document, times 6 orders)."""
    counted = spark.createDataFrame([("x", 0b011, 3), ("x", 0b100, 2), ("x", 0, 5)], "part string, mask int, n long")
    got = {r["filter_order"][r["step"] - 1]: r["shapley"] for r in filter_audit.interactions(counted, "PQR", ("n",)).collect()}
    assert got == {"P": 9, "Q": 9, "R": 12}  # 3 removed by P or Q are shared, 2 are R's: 1.5, 1.5 and 2 times 6


def test_op11_empty_tables(odd, labels):
    assert filter_audit.audit(odd.limit(0), labels).count() == 0
    unlabelled = filter_audit.audit(odd, labels.limit(0))
    assert unlabelled.agg(F.sum(F.col("good_lost") + F.col("toxic_lost"))).first()[0] == 0


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf_of(row):
    values = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row]
    return sha("".join(values))


def tree_levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k : k + 8])) for k in range(0, len(out[-1]), 8)])
    return out


def brute_manifest(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of (doc_id, source, lang, n_chars, text)."""
    parts = {}
    for r in rows:
        parts.setdefault(r[2], []).append(r)
    names = sorted(parts, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for p in names:
        parts[p].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[p] = tree_levels([leaf_of(r) for r in parts[p]])
    top = tree_levels([trees[p][-1][0] for p in names])
    root, out = top[-1][0] if names else None, []
    for at, p in enumerate(names):
        for i, r in enumerate(parts[p]):
            text = r[4]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            node, proof = leaf_of((*r[:4], text)), ""
            for levels, k in ((trees[p], i), (top, at)):
                for nodes in levels[:-1]:
                    run = nodes[k - k % 8 : k - k % 8 + 8]
                    left, right = "".join(run[: k % 8]), "".join(run[k % 8 + 1 :])
                    proof, node, k = proof + left + right, sha(left + node + right), k // 8
            out.append((r[0], leaf_of(r), trees[p][-1][0], root, sha(proof), node, node == root))
    return Counter(out)


def many(n=1300):
    """More rows in one part than a superblock holds, and ten parts of a row each."""
    return [(k, "s", "big", k, f"Row {k % 7}") for k in range(n)] + [(n + k, "s", f"p{k}", k, f"Row {k}") for k in range(10)]


@pytest.mark.parametrize("table", ["odd", "documents", "many"])
def test_op12(request, spark, table):
    df = spark.createDataFrame(many(), "doc_id long, source string, lang string, n_chars long, text string") if table == "many" else request.getfixturevalue(table)
    got = merkle.tamper_check(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    rows = [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert Counter(tuple(r) for r in got) == brute_manifest(rows)
    assert any(not r["verified"] for r in got)


def test_op12_proofs_verify_without_the_operator(spark):
    df = spark.createDataFrame(many(100), "doc_id long, source string, lang string, n_chars long, text string")
    for r in merkle.tamper_check(df, with_proof=True).collect():
        assert sha("".join(r["proof"])) == r["proof_sha256"] and all(len(x) == 64 for x in r["proof"])


def test_op12_empty_and_single(odd):
    assert merkle.tamper_check(odd.limit(0)).count() == 0
    one = odd.filter("doc_id = 7")
    row = merkle.tamper_check(one).first()
    assert row["leaf"] == row["subroot"] == row["root"] and row["proof_sha256"] == sha("")


def in_order(df):
    """(order, id, text): null ids first, then by id; equal ids are ordered by the operator's hashes of the text."""
    rows = substring_dedup._keyed(df, "doc_id", "text").collect()
    return [((r["id"] is not None, r["id"] or 0, r["ta"], r["tb"]), r["id"], r["body"]) for r in rows]


def brute_repeats(rows, window):
    """Id, words, removed, kept text of each row. Rows equal in id and text are one document."""
    first, out = {}, {}
    for order, _, text in sorted(set(rows), key=lambda r: r[0]):
        w = words_of(text)
        gone = set()
        for k in range(len(w) - window + 1):
            if first.setdefault(tuple(w[k : k + window]), (order, k)) != (order, k):
                gone.update(range(k, k + window))
        out[order] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return Counter((i, *out[order]) for order, i, _ in rows)


@pytest.mark.parametrize("table,window,gram", [("odd", 20, 8), ("odd", 3, 2), ("documents", 20, 8), ("documents", 6, 5)])
def test_op13(request, table, window, gram):
    df = request.getfixturevalue(table)
    got = substring_dedup.substring_dedup(df, window=window, gram=gram).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got) == brute_repeats(in_order(df), window)


def test_op13_removed_spans_are_what_is_missing(documents):
    texts = dict(documents.select("doc_id", "text").collect())
    for r in substring_dedup.substring_dedup(documents).collect():
        w = words_of(texts[r["doc_id"]])
        gone = {k for s in r["removed"] for k in range(s["start"], s["end"])}
        assert len(gone) == r["n_removed"] and r["kept"] == " ".join(x for k, x in enumerate(w) if k not in gone)


def test_op13_planted_passages(spark):
    """A passage of 60 words in every third document goes but for its first place; all else stays."""
    rng = random.Random(3)
    fresh = lambda n: [f"q{rng.randint(0, 10**12)}" for _ in range(n)]
    passage, exact, short = fresh(60), fresh(20), fresh(19)
    rows = [(i, " \n".join(fresh(40) + (passage if i % 3 == 0 else exact if i % 3 == 1 else short) + fresh(40))) for i in range(300)]
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 0 if i < 3 else (60, 20, 0)[i % 3] for i in range(300)}


def test_op13_long_text_in_pieces(spark):
    """A text longer than a piece and a segment, with a run that crosses the pieces' border."""
    rng = random.Random(4)
    words = [f"z{rng.randint(0, 10**12)}" for _ in range(140_000)]
    words[65_530:65_560] = words[100:130]
    words[131_000:131_040] = ["same"] * 40
    got = substring_dedup.substring_dedup(spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[70_000:70_050]))], "doc_id long, text string")).collect()
    spans = {r["doc_id"]: [tuple(s) for s in r["removed"]] for r in got}
    assert spans == {1: [(65_530, 65_560), (131_001, 131_040)], 2: [(0, 50)]}


def test_op13_empty_table(odd):
    assert substring_dedup.substring_dedup(odd.limit(0)).count() == 0
    assert [tuple(r)[:3] for r in substring_dedup.substring_dedup(odd.filter("text IS NULL AND doc_id = 1")).collect()] == [(1, 0, 0)]


def test_op13_counts_bound_windows():
    """Every window's gram is counted at least as often as the window occurs, runs of one word included."""
    rng = random.Random(8)
    for _ in range(30):
        words = [rng.choice("abc" if rng.random() < 0.3 else "abcdefghij") for _ in range(rng.randint(5, 400))]
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        starts, ends = substring_dedup.word_bounds(data, np.array([len(data)]))
        hashes = substring_dedup.word_hashes(data, starts, ends)
        grams, least, valid = substring_dedup.window_grams(hashes, np.zeros(len(words), int), 5, 2)
        if not len(grams):
            continue
        counted = Counter(grams[substring_dedup.counted_grams(grams, least, valid, 5, 2)].tolist())
        often = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        assert all(counted[least[k]] >= often[tuple(words[k : k + 5])] for k in range(len(words) - 4))


def test_op13_word_hashes_depend_on_the_word_alone():
    """The same word has one hash wherever it stands, also across segments; words of equal length differ."""
    rng = random.Random(10)
    vocabulary = [f"w{rng.randint(0, 10**9):09d}" for _ in range(5000)] + ["ü" * 40_000, "y" * 70_000]
    words = [rng.choice(vocabulary) for _ in range(300_000)]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends = substring_dedup.word_bounds(data, np.array([len(data)]))
    by_word = {}
    for w, h in zip(words, substring_dedup.word_hashes(data, starts, ends).tolist()):
        by_word.setdefault(w, set()).add(h)
    assert all(len(x) == 1 for x in by_word.values()) and len({h for x in by_word.values() for h in x}) == len(by_word)


def test_op13_words_are_split_as_stated():
    text = "a\x1cb c d\x0be\x85 f\r\ng\t"
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends = substring_dedup.word_bounds(data, np.array([len(data)]))
    assert [data[s:e].tobytes().decode() for s, e in zip(starts, ends)] == words_of(text) == [x.decode() for x in text.encode().split()]


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_merkle_manifest", "op13_substring_dedup"])
def test_queries_have_sql(name):
    assert name in QUERIES and name in ORACLES
