"""Every training-data operator against brute force, round trips or held-out accuracy, and on awkward rows."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from logframe.llm import exact_dedup, langid, lm, mixing, near_dedup, packing, pii, quality_classifier, quality_rules, token_output, tokens
from logframe.llm.tokens import WordCache, word_cache

FOLDER = "/root/testdata/sf0.001"
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, rank string, label string, name string, row string, task string"
ODD = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, " \n\t ", "en", "a"),
    (None, "no id at all, but words", "en", None),
    (None, None, None, None),
    (5, "the cat sat on the mat and then the cat sat on the mat again " * 3, "en", "a"),
    (6, "the cat sat on the mat and then the cat sat on the mat again " * 3, "en", "b"),
    (7, "der hund lief über die straße und bellte die katze an " * 400, "de", "b"),
    (8, "mail me: someone@example.org or call +49 (30) 1234-5678; 192.168.1.77", "de", "c"),
    (9, "x" * 30_000, None, "c"),
    (10, "short", "en", "c"),
    (10, "same id, other text", "en", "c"),
    (11, "repeated row", "en", "a"),
    (11, "repeated row", "en", "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "r", "l", "n", "x", "t") for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def stored(spark, odd, tmp_path_factory):
    """The same rows as a stored table: row numbers hold for those."""
    path = f"file://{tmp_path_factory.mktemp('odd')}/documents.parquet"
    odd.write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables")
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def texts_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def key(x):
    return tuple((v is not None, v) for v in x)


@pytest.mark.parametrize("path,space", [(BYTES, True), (WORDS, False)])
def test_word_cache_equals_library(path, space):
    rng = random.Random(5)
    signs = ["a", "B", "é", "ß", "İ", "Σ", " ", "  ", "\n", "\t", ".", ",", "'s", "<|endoftext|>", "1", "½", "中", "́", "😀", "\x1c", "\x85", "%%", "foo", "Bar"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in WordCache(path, space).ids(texts)] == want


@pytest.mark.parametrize("path,space", [(BYTES, True), (WORDS, False)])
def test_word_cache_at_every_cut(path, space, monkeypatch):
    """Runs of blanks, signs and accents, small groups, and a memory that fills up, against the library."""
    monkeypatch.setattr(tokens, "GROUP", 300)
    monkeypatch.setattr(tokens, "MEMORY", 60)
    rng = random.Random(9)
    signs = [*"aBJéÉßĲя中½²µª×÷'.-_#5٣\t\r\n\v\f\x00\x1c\x85\xa0\u1680\u2003\u2028\u202f\u205f\u3000\u200b“\u0301\u030c\u0338K😀", "'S", "'ll", "  ", ".\n", "\n\n", " \n", *"    ", *"\n\n", "the", "The"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(6000)]
    library = Tokenizer.from_file(path)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    cache = WordCache(path, space, added=True)
    assert [x.tolist() for x in cache.ids(texts)] == want
    ids, counts = cache.encode(pa.array([*texts[:50], None], pa.string()).slice(7))
    assert ids.tolist() == sum(want[7:50], []) and counts.tolist() == [*map(len, want[7:50]), 0]
    assert cache.ids([]) == []


@pytest.mark.parametrize("path,space", [(BYTES, True), (WORDS, False)])
def test_a_word_beside_many_signs_is_encoded_once(path, space):
    """Before, the library got every word again for each sign behind it."""
    words = ["".join(chr(97 + (k // 26**j) % 26) for j in range(3)) for k in range(200)]
    ends = ["", ".", "***", "%%%", "&&", "-", "()", "'", "\"", "#", "\nand"]
    texts = [" ".join(w + end for w in words) for end in ends]
    cache, given = WordCache(path, space), []

    class Counted:
        def __init__(self, of):
            self.of = of

        def tokenize(self, word):
            given.append(word)
            return self.of.tokenize(word)

        def encode_batch(self, pieces, **options):
            given.extend(pieces)
            return self.of.encode_batch(pieces, **options)

    cache.model, cache.tokenizer = Counted(cache.model), Counted(cache.tokenizer)
    got = [x.tolist() for x in cache.ids(texts)]
    assert got == [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]
    assert len(given) < 250


def test_long_texts_do_not_fill_the_memory(monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY_SIZE", 20_000)
    cache = WordCache(BYTES, True)
    for k in range(30):
        cache.ids(["中" * (1000 + k), "some words"])
    assert cache.size < 30_000 and len(cache.number) < 20


def test_coding_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        values = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        control, data = token_output.encode(values)
        assert len(control) == -(-n // 4) and token_output.decode(control, data, n).tolist() == values.tolist()


def encoded(path, text, end):
    return Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_op1(request, tmp_path, table):
    df = request.getfixturevalue(table)
    files = token_output.write_tokens(df, BYTES, f"file://{tmp_path}/t")
    got = sorted((tuple(r) for r in files.documents().collect()), key=lambda r: r[1])
    assert [r[1] for r in got] == [sum(x[2] for x in got[:k]) for k in range(len(got))]
    assert [key(r[:1]) for r in got] == sorted(key(r[:1]) for r in got)
    want = [(i, len(ids), crc(ids)) for i, t in texts_of(df) for ids in [encoded(BYTES, t, 2)]]
    assert sorted(((r[0], r[2], r[3]) for r in got), key=key) == sorted(want, key=key)
    ranks = files.ranks()
    assert len(set(ranks.tolist())) == len(ranks) and ranks[0] == Counter(x for _, t in texts_of(df) for x in encoded(BYTES, t, 2)).most_common(1)[0][0]


def base_spans(text):
    def digits(x):
        return re.sub("[^0-9]", "", x)

    def luhn(x):
        return sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(x[::-1])) % 10 == 0

    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda x: 16 <= len(digits(x)) <= 19 and luhn(digits(x))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 8 <= len(digits(x)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, (p, ok) in enumerate(rules) for m in re.finditer(p, text) if ok(m[0])]


def test_op2_base_spans():
    rng = random.Random(2)
    signs = list("aB1@.+-% 0925()") + ["@a.b", "1.2.3.4", "4111 1111 1111 1111", "+1 (555) 123-4567", "255.", " at ", " dot ", "é"]
    for _ in range(4000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 30)))
        assert sorted(x[:3] for x in pii.candidates(text) if x[3]) == base_spans(text), text


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_op2(request, table):
    df = request.getfixturevalue(table)
    got = sorted(((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in pii.find_pii(df).collect()), key=key)
    want = []
    for i, t in texts_of(df):
        spans = base_spans(t)
        written = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in spans)
        want.append((i, *[sum(x[0] == k for x in spans) for k in range(4)], hashlib.sha256(written.encode()).hexdigest()))
    assert got == sorted(want, key=key)


def test_op2_learns_reliable_labelers():
    votes = np.array([[1, 1, 0, 1, 1], [0, 2, 0, 2, 1], [1, 0, 1, 1, 1], [0, 0, 0, 2, 2]])
    p, _ = pii.reliabilities(np.zeros(4, int), votes, np.array([50.0, 40, 30, 20]))
    assert (p[[0, 2]] > 0.9).all() and (p[[1, 3]] < 0.1).all()


def test_op3(stored):
    rows = mixing.mix(stored).collect()
    sizes = Counter()
    for r in ODD:
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    targets = {r["source"]: r["target"] for r in rows}
    assert {r["source"]: r["source_size"] for r in rows} == sizes
    assert math.isclose(sum(targets.values()), sum(sizes.values())) and all(targets[s] <= 3 * sizes[s] + 1e-9 for s in sizes)
    assert all(r["taken"] == r["copies"] * r["size"] and r["copies"] <= 3 for r in rows)
    for s in sizes:
        longest = max([r["size"] for r in rows if r["source"] == s])
        assert abs(sum(r["taken"] for r in rows if r["source"] == s) - targets[s]) <= longest
    again = mixing.mix(stored).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_op3_water_filling(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 90)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    assert got == {"a": 30.0, "b": 800.0, "c": 270.0}


def test_op4(documents):
    got = {r["doc_id"]: r for r in lm.score_texts(documents).collect()}
    words = {i: t.encode().lower().split() + [b""] for i, t in texts_of(documents)}
    train = Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(train.values()), len(train)
    for i, ws in words.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(w in train for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel_tol=1e-9)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_op4_is_a_distribution():
    model = lm.Model([b"a", b"b", b""], [5, 3, 2], 12, 5)
    rng = np.random.default_rng(0)
    model.class_weights += rng.normal(size=model.class_weights.shape).astype(np.float32)
    index, start = np.array([0, 1, 2]), np.array([-2, -2, -2])
    _, (_, _, p), (_, _, q) = lm._layers(model, index, start, start)
    tail = sum((c + 0.1) / model.tail_mass for c in (1, 1, 0))
    assert np.allclose(p.sum(axis=1), 1, atol=1e-5) and np.allclose(q.sum(axis=1), 1, atol=1e-5) and math.isclose(tail, 1)


def test_op5(documents, spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = quality_classifier.classify(documents, labels).join(labels, "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.9 and all(0 <= r["score"] <= 1 for r in rows)


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_op6(request, table):
    df = request.getfixturevalue(table)
    got = exact_dedup.exact_dedup(df, block_chars=7).collect()
    groups = {}
    for i, t in texts_of(df):
        groups.setdefault(t, []).append(i)
    want = Counter((i, max((x for x in g if x is not None), default=None), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_op7(documents):
    rows = langid.identify(documents).join(documents.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95


def test_op7_odd(odd):
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.identify(odd).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (7, "de")} <= got


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_op8(request, table):
    df = request.getfixturevalue(table)
    got = packing.pack(df, WORDS).collect()
    want = Counter()
    for i, t in texts_of(df):
        ids = encoded(WORDS, t, 0)
        want.update((i, k, at, len(ids[at : at + 2048]), crc(ids[at : at + 2048])) for k, at in enumerate(range(0, len(ids), 2048)))
    assert Counter(tuple(r)[:5] for r in got) == want
    at = Counter()
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at[r["sequence_id"]]
        at[r["sequence_id"]] += r["length"]
    assert max(at.values()) <= 2048 and len(at) <= -(-sum(at.values()) // 2048) + 2


def test_op8_plan_uses_every_piece_once():
    rng = np.random.default_rng(4)
    for _ in range(20):
        counts = np.append(0, rng.integers(0, 6, 64))
        plan = packing.Plan(counts)
        used = Counter()
        for lengths, times in plan.patterns:
            assert sum(lengths) <= 64 and times > 0
            used.update({x: times * lengths.count(x) for x in set(lengths)})
        assert all(used[k] == counts[k] for k in range(1, 65))


def rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often, covered, seen, dup = Counter(windows), set(), set(), 0
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered.update(range(i, i + 8))
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_op9(request, table):
    df = request.getfixturevalue(table)
    rows = quality_rules.judge(df).collect()
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows)
    assert got == Counter((i, *rules(t)) for i, t in texts_of(df))
    assert not any(r["kept"] and r["base_failed"] for r in rows)


def shingle_set(text):
    words = text.encode().lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def brute_components(rows):
    sets, label = {}, {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingle_set(t))
        label[i] = i
    ids = sorted(x for x in sets if x is not None)
    edges = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if any(x and 100 * len(x & y) >= 85 * len(x | y) for x in sets[a] for y in sets[b])]
    while any(label[a] != label[b] for a, b in edges):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label


def star(n=60):
    """An original and copies of it with more and more words changed: few links but those to the original."""
    rng = random.Random(9)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
    for i in range(n):
        copy = list(words)
        for _ in range(i % 5):
            copy[rng.randrange(200)] = f"x{rng.randint(0, 10**9)}"
        yield 1000 + i, " ".join(copy)


@pytest.mark.parametrize("table", ["odd", "documents", "star"])
def test_op10(request, spark, table):
    df = spark.createDataFrame(list(star()), "doc_id long, text string") if table == "star" else request.getfixturevalue(table)
    rows = texts_of(df)
    label = brute_components(rows)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_dedup(df).collect())
    assert got == Counter((i, len(shingle_set(t)), label[i] if i is not None else None, i is None or label[i] == i) for i, t in rows)


def test_op10_signatures_estimate_similarity():
    a, b = np.arange(400, dtype=np.uint64), np.arange(100, 500, dtype=np.uint64)
    x, y = near_dedup.signatures([near_dedup._mix(a), near_dedup._mix(b)])
    assert abs((x == y).mean() - 0.6) < 0.12


OPERATORS = {
    "op2": lambda df: pii.find_pii(df),
    "op3": lambda df: mixing.mix(df),
    "op4": lambda df: lm.score_texts(df),
    "op5": lambda df: quality_classifier.classify(df, df.select("doc_id", F.lit(1).alias("quality"))),
    "op6": lambda df: exact_dedup.exact_dedup(df),
    "op7": lambda df: langid.identify(df),
    "op8": lambda df: packing.pack(df, WORDS),
    "op9": lambda df: quality_rules.judge(df),
    "op10": lambda df: near_dedup.near_dedup(df),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(empty, name):
    assert OPERATORS[name](empty).count() == 0


def test_empty_table_op1(empty, tmp_path):
    assert token_output.write_tokens(empty, BYTES, f"file://{tmp_path}/t").documents().count() == 0


@pytest.mark.parametrize("name", ["op4", "op5"])
def test_odd_rows(odd, name):
    assert OPERATORS[name](odd).count() == len(ODD)


def test_pipeline(spark, documents):
    """Each stage held against its operator's own brute force, on what the stage before it kept."""
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, docs, FOLDER)
        before, left = dict(texts_of(docs)), dict(texts_of(after))
        assert after.columns == documents.columns
        if name == "language_id":
            assert set(left) == {i for i, t in before.items() if any(c.isalpha() for c in t)}
        elif name == "exact_dedup":
            last = {t: max(i for i, x in before.items() if x == t) for t in before.values()}
            assert set(left) == set(last.values())
        else:
            label = brute_components(list(before.items()))
            assert set(left) == {i for i in before if label[i] == i}
        docs = after
    assert corpus_pipeline.run(spark, FOLDER).count() > 0


ADDED = ["see <|endoftext|> here", "a\n <|endoftext|>\n b", "x<|endoftext|>\u0301y", "<|EndOfText|> <|startoftext|>", "<|endoftext|>" * 3, "none"]


@pytest.mark.parametrize("path,space", [(BYTES, True), (WORDS, False)])
def test_added_tokens_as_in_the_untouched_library(path, space):
    rng = random.Random(6)
    signs = ["a", "B", "é", "Σ", " ", "  ", "\n", "\t", ".", "'s", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "1", "中", "\u0301", "foo"]
    texts = ADDED + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 20))) for _ in range(3000)]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in word_cache(path, space).ids(texts)] == want


def test_added_tokens_in_op1_and_op8(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(ADDED)), "doc_id long, text string")
    files = token_output.write_tokens(df, BYTES, f"file://{tmp_path}/t")
    ids = [encoded(BYTES, t, 2) for t in ADDED]
    starts = np.cumsum([0, *map(len, ids)])
    assert sorted(map(tuple, files.documents().collect())) == [(i, starts[i], len(x), crc(x)) for i, x in enumerate(ids)]
    ids = [encoded(WORDS, t, 0) for t in ADDED]
    assert sorted((r["doc_id"], r["length"], r["ids_crc32"]) for r in packing.pack(df, WORDS).collect()) == [(i, len(x), crc(x)) for i, x in enumerate(ids)]


def scattered(n=200):
    """Pairs of 200 words with four scattered words changed: 176 of 216 shingles in common, 81 %."""
    rng = random.Random(11)
    for i in range(n):
        words = [f"w{rng.randint(0, 10**9)}" for _ in range(200)]
        other = [f"x{rng.randint(0, 10**9)}" if k in (20, 70, 120, 170) else w for k, w in enumerate(words)]
        yield from ((2 * i, " ".join(words)), (2 * i + 1, " ".join(other)))


def test_near_copies_at_80_percent_are_dropped_at_80(spark):
    df = spark.createDataFrame(list(scattered()), "doc_id long, text string")
    assert [near_dedup.rows_for(p) for p in (80, 85)] == [5, 6]
    assert all(near_dedup.missed(p, near_dedup.rows_for(p)) < 1e-6 for p in range(50, 101))
    assert sorted(r["doc_id"] for r in near_dedup.drop_near_duplicates(df, percent=80).collect()) == list(range(0, 400, 2))


@pytest.fixture(scope="module")
def clashing(spark, documents, tmp_path_factory):
    """Documents in six files, with columns named as the operators name theirs; some rows twice."""
    own = {c: F.lit(c) for c in ("row_key", "key", "row", "copy", "gone", "_lang_pred", "_lang_score", "pred", "score")}
    path = f"file://{tmp_path_factory.mktemp('clash')}/documents.parquet"
    df = documents.withColumns(own)
    df.union(df.filter("doc_id % 9 = 0")).repartition(6).write.parquet(path)
    return spark.read.parquet(path)


STAGE_FUNCTIONS = {
    "language_id": langid.reject_unknown,
    "exact_dedup": exact_dedup.drop_duplicates,
    "near_dedup": near_dedup.drop_near_duplicates,
    "mixing": mixing.take,
}


@pytest.mark.parametrize("name", STAGE_FUNCTIONS)
def test_stages_keep_columns_whose_names_clash(clashing, name):
    got = STAGE_FUNCTIONS[name](clashing)
    assert got.columns == clashing.columns
    for r in got.limit(50).collect():
        assert all(r[c] == c for c in clashing.columns[5:])


@pytest.mark.parametrize("stage", ["exact_dedup", "mixing"])
def test_rows_hold_when_splits_are_planned_anew(spark, clashing, stage):
    """Spark cuts splits by the cores there are: with others at run time than when the plan was made, rows stay the same."""
    cores = "spark.sql.leafNodeDefaultParallelism"
    try:
        spark.conf.set(cores, "1")
        planned = STAGE_FUNCTIONS[stage](clashing)
        spark.conf.set(cores, "8")
        got = Counter(r["doc_id"] for r in planned.select("doc_id").collect())
    finally:
        spark.conf.unset(cores)
    rows = [(r["doc_id"], r["text"] or "") for r in clashing.select("doc_id", "text").collect()]
    if stage == "exact_dedup":
        assert got == Counter({max(i for i, x in rows if x == t): 1 for _, t in set(rows)})
    else:
        copies = Counter()
        for r in mixing.mix(clashing).collect():
            copies[r["doc_id"]] += r["copies"]
        assert got == +copies


def test_pipeline_by_value(spark, documents):
    """What the last two stages return: copies as the mix says, and all of their tokens in their places."""
    docs = documents
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, FOLDER)
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    texts = dict(texts_of(docs))
    want = Counter()
    for i, n in copies.items():
        ids = encoded(WORDS, texts[i], 0)
        want.update({(i, k, at, len(ids[at : at + 2048]), crc(ids[at : at + 2048])): n for k, at in enumerate(range(0, len(ids), 2048))})
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == +want
    at = Counter()
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at[r["sequence_id"]]
        at[r["sequence_id"]] += r["length"]
    assert max(at.values()) <= 2048
