import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from logframe.functions import values
from logframe.functions.ranges import number_label, readable_ranges
from logframe.operators.predicates import parse_operand


def strings(spark, items):
    return spark.createDataFrame(list(enumerate(items)), "i int, s string").coalesce(1)


def one_column(spark, items, build):
    return [r[0] for r in strings(spark, items).select(build(F.col("s"))).collect()]


def js_text(x: float) -> str:
    """Model of how JavaScript prints a number."""
    if x == 0:
        return "0"
    sign, x = ("-", -x) if x < 0 else ("", x)
    digits, exponent = f"{x!r}e0".split("e")[0:2] if "e" not in repr(x) else repr(x).split("e")
    whole, _, fraction = digits.partition(".")
    fraction = "" if fraction == "0" else fraction
    point = len(whole) + int(exponent)
    all_digits = (whole + fraction).lstrip("0")
    point -= len(whole + fraction) - len(all_digits) if whole.strip("0") == "" else 0
    all_digits = all_digits.rstrip("0") or "0"
    n = len(all_digits)
    if n <= point <= 21:
        return sign + all_digits + "0" * (point - n)
    if 0 < point <= 21:
        return sign + all_digits[:point] + "." + all_digits[point:]
    if -6 < point <= 0:
        return sign + "0." + "0" * -point + all_digits
    e = point - 1
    mantissa = all_digits[0] + ("." + all_digits[1:] if n > 1 else "")
    return f"{sign}{mantissa}e{'+' if e > 0 else '-'}{abs(e)}"


NUMBERS = {
    "7": 7.0, "007": 7.0, " 12 ": 12.0, " 5﻿": 5.0, "0x1F": 31.0, "0b101": 5.0, "0o17": 15.0, "1e3": 1000.0, ".5": 0.5,
    "5.": 5.0, "+3": 3.0, "-0": 0.0, "Infinity": float("inf"), "-Infinity": float("-inf"), "1e400": float("inf"),
    "": None, "  ": None, "5f": None, "1d": None, "NaN": None, "-0x10": None, "1_000": None, "1,5": None, "inf": None, "0x": None, ".": None,
}


def test_numbers_are_read_as_javascript_reads_them(spark):
    got = one_column(spark, list(NUMBERS), values.parse_number)
    assert got == list(NUMBERS.values())


@pytest.mark.parametrize("raw,value", [(k, v) for k, v in NUMBERS.items() if k != "1e400"])
def test_operands_are_read_like_cells(raw, value):
    assert parse_operand(raw) == value


def test_number_text_matches_the_model(spark):
    rng = random.Random(7)
    xs = [0.0, -0.0, 200.0, 0.5, 1e21, 1e20, 123456789012345.0, 12345678.25, 0.001, 0.00012, 1.5e-7, -2.5e-9, 1e-6, 2.0**53, 1e300]
    xs += [float(f"{rng.choice('-+')}{rng.randint(1, 99999)}e{rng.randint(-9, 15)}") for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in xs], "x double").coalesce(1)
    got = [r[0] for r in df.select(values.number_text(F.col("x"))).collect()]
    assert got == [js_text(x) for x in xs]


def test_classify(spark):
    votes = {
        "true": "boolean", "FALSE": "boolean", " yes ": "boolean", "0": "number", "-3.14": "number", "0x1F": "number", "1e5": "number",
        "2026-06-19": "date", "2026-06-19T08:01:12": "date", "2026-06-19garbage": "date", "": None, "  ": None, "/api/users": "string",
        "Infinity": "string", "08:01": "string",
    }
    assert one_column(spark, list(votes), values.classify) == list(votes.values())


def test_instants(spark):
    got = one_column(spark, ["2026-06-19", "2026-06-19T08:01:12", "2026-06-19T08:01:12Z", "08:01:12", "2026-06-19garbage", "x"], values.parse_instant)
    assert [str(g) if g else None for g in got] == ["2026-06-19 00:00:00", "2026-06-19 08:01:12", "2026-06-19 08:01:12", None, None, None]


def test_natural_order(spark):
    items = ["item10", "Item2", "item1b", "item2", "item", "zeta", "émile", "a10b2", "a10b10", "a9b99", "x" + "9" * 25, "x1" + "0" * 25]
    df = strings(spark, items).withColumn("k", values.natural_key(F.col("s")))
    got = [r[0] for r in rows(df.orderBy("k", "i"), "s")]
    assert got == ["a9b99", "a10b2", "a10b10", "émile", "item", "item1b", "item2", "Item2", "item10", "x" + "9" * 25, "x1" + "0" * 25, "zeta"]


def test_readable_ranges():
    r = readable_ranges(0, 1000)
    assert (r.step, r.count, r.label(0), r.bounds(10)) == (100, 11, "0–100", (1000, 1100))
    single = readable_ranges(5, 5)
    assert (single.count, single.label(0), single.bounds(0)) == (1, "5", (5, 5))
    assert readable_ranges(3, 2400).label(0) == "0–200"
    assert [readable_ranges(3, 2400).count, readable_ranges(3, 2400).step] == [13, 200]
    assert readable_ranges(-50, 3).label(0) == "-50–-45"


@pytest.mark.parametrize("x,label", [(1200, "1,200"), (0.5, "0.5"), (0.125, "0.13"), (1234567.891, "1,234,567.89"), (-1200, "-1,200"), (10, "10"), (100, "100")])
def test_number_label(x, label):
    assert number_label(x) == label
