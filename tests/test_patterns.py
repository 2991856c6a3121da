import pytest
from pyspark.sql import functions as F

import logframe as lf
from logframe.functions import patterns
from logframe.functions.patterns import PatternError, translate


def all_matches(spark, source, text, flags=""):
    df = spark.createDataFrame([(text,)], "s string")
    return df.select(F.regexp_extract_all("s", F.lit(translate(source, flags).java), F.lit(0))).first()[0]


@pytest.mark.parametrize(
    "source,flags,text,expected",
    [
        (r"\bcole\b", "", "école cole", ["cole", "cole"]),  # words are ASCII
        (r"a.c", "", "abc a\u0085c a\nc", ["abc", "a\u0085c"]),
        (r"a.c", "s", "a\nc", ["a\nc"]),
        (r"x$", "", "x\n", []),
        (r"x$", "m", "x\ny", ["x"]),
        (r"^y", "m", "x\ny", ["y"]),
        (r"a\sb", "", "a b a b", ["a b", "a b"]),
        (r"[^]", "", "\n", ["\n"]),
        (r"[[&]+", "", "a[&&]", ["[&&"]),
        (r"a{x", "", "a{x", ["a{x"]),
        (r"É", "i", "é É", ["é", "É"]),
        (r"(?<a_b>x)\k<a_b>", "", "xx", ["xx"]),
        (r"\/\-", "", "/-", ["/-"]),
        (r"(?:a|b)+?c", "", "abc", ["abc"]),
        (r"\+\++", "", "+++", ["+++"]),
    ],
)
def test_javascript_meaning(spark, source, flags, text, expected):
    assert all_matches(spark, source, text, flags) == expected


def test_group_numbers_count_plain_groups():
    assert translate(r"(x)(?<first>a)(?:b)(?<!c)[(](?<second_>d)").groups == {"first": 2, "second_": 3}


@pytest.mark.parametrize("source", ["a++", "[a", "a\\", "(?<a>x)(?<a>y)", r"\k<q>(?<p>x)"])
def test_rejected(source):
    with pytest.raises(PatternError):
        translate(source)


@pytest.mark.parametrize("source", ["(", "a)", "*a", "(?<a>("])
def test_invalid_in_java(spark, source):
    assert not patterns.is_valid(spark, translate(source).java)


def test_named_patterns_agree_with_their_translation(spark):
    texts = [
        "from 10.0.0.4 to 10.0.0.9.", "1.2.3.4.5 v1.2.3.4 é1.2.3.4", "ops@example.com, +a@b.c-d.e- x@y", "a@b.cc+d@e.ff.", "00:1A:2B:3C:4D:5E", "00-1A-2B-3C-4D-5E:1",
        "fe80::1 a:b:c 2026-06-19 08:01:12", "[10/Oct/2023:13:55:36 +0000]", "550e8400-e29b-41d4-a716-446655440000", "404 x503 4044 500.", "", "ÿ@ü.de é@a.b.",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    for id, source in lf.NAMED_PATTERNS.items():
        plain = F.regexp_extract_all("s", F.lit(translate(source, "i").java), F.lit(0))
        pair = df.select(plain.alias("a"), patterns.matches(F.col("s"), patterns.named(id), id).alias("b"), patterns.has_match(F.col("s"), id).alias("c"))
        for r in pair.collect():
            assert r["a"] == r["b"] and bool(r["a"]) == r["c"]
