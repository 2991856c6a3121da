import random
import re

import pytest

import logframe as lf
from conftest import rows

RULES = [("email", "EMAIL"), ("mac", "MAC"), ("ipv6", "IP6"), ("ipv4", "IP")]


def model(table_rows, mode, classes):
    """Cell by cell, class by class, numbering values as they come."""
    numbers = {}

    def label(token):
        def replace(match):
            if mode == "token":
                return f"[{token}]"
            known = numbers.setdefault(token, {})
            return f"[{token}_{known.setdefault(match[0], len(known) + 1)}]"

        return replace

    out = []
    for row in table_rows:
        cells = []
        for cell in row:
            for id, token in RULES:
                if cell is not None and id in classes:
                    cell = re.sub(lf.NAMED_PATTERNS[id], label(token), cell, flags=re.I | re.A)
            cells.append(cell)
        out.append(tuple(cells))
    return out


def random_cell(rng):
    parts = ["10.0.0.4", "10.0.0.9", "ops@example.com", "a.b+c@x-y.org.", "00:1A:2B:3C:4D:5E", "00-1a-2b-3c-4d-5e", "fe80:1:2:3", "08:01:12", "x", "é", " ", ", ", "é10.0.0.4", "@", "[", "1.2.3.4.5", "u@10.0.0.4"]
    return None if rng.random() < 0.1 else "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 8)))


@pytest.mark.parametrize("mode", ["token", "consistent"])
@pytest.mark.parametrize("classes", [["email", "mac", "ipv6", "ipv4"], ["ipv4", "ipv6"], ["mac"]])
def test_against_the_model(table, mode, classes):
    rng = random.Random(len(classes))
    data = [(random_cell(rng), random_cell(rng)) for _ in range(120)]
    got = lf.redact(table("a:string b:string", data).repartition(3), classes, mode)
    assert rows(got.orderBy("_row_id"), "a", "b") == model(data, mode, classes)


def test_rare_values_join_by_shuffle(table, monkeypatch):
    monkeypatch.setattr("logframe.operators.redact.BROADCAST_VALUES", 0)
    monkeypatch.setattr("logframe.operators.redact.FREQUENT", 2)
    data = [(f"10.0.0.{i % 7} 10.0.0.1",) for i in range(60)]
    got = lf.redact(table("a:string", data), ["ipv4"], "consistent")
    assert rows(got.orderBy("_row_id"), "a") == model(data, "consistent", ["ipv4"])


def test_parsed_numbers_stay(table):
    t = table("n:number f:boolean s:string", [("10", "true", "10.0.0.1"), ("10.0.0.1", "10.0.0.2", None)])
    assert rows(lf.redact(t), "n", "f", "s") == [("10", "true", "[IP]"), ("[IP]", "[IP]", None)]
    assert rows(lf.redact(t, mode="consistent").orderBy("_row_id"), "n", "f", "s") == [("10", "true", "[IP_1]"), ("[IP_1]", "[IP_2]", None)]
    assert lf.signature(lf.redact(t, mode="consistent")) == lf.signature(t)


def test_options(table):
    t = table("s:string", [("10.0.0.1",)], row_id=False)
    assert lf.redact(t, []) is t
    with pytest.raises(ValueError):
        lf.redact(t, mode="consistent")
    with pytest.raises(ValueError):
        lf.redact(t, mode="hash")


def test_consistent_labels_when_positions_repeat(spark):
    df = spark.createDataFrame([(1, "at 10.0.0.1"), (1, "at 10.0.0.2"), (2, "10.0.0.1 again")], "_row_id long, text string")
    got = sorted(r["text"] for r in lf.redact(df, mode="consistent").collect())
    assert sorted(got) == ["[IP_1] again", "at [IP_1]", "at [IP_2]"]
