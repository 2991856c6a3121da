import functools
import random

import pytest
from pyspark.sql import functions as F

import logframe as lf
from conftest import ids, rows
from logframe.operators.ordering import sort_order

PARCELS = [("fine", "17", "/stock/bolts"), ("slow", "88", "/ship/track"), ("lost", "231", "/stock/nuts"), ("slow", "92", "/ship/track"), ("fine", None, "/tariff")]


# --- search and extraction ------------------------------------------------------------------


@pytest.mark.parametrize("query,regex,expected", [("SHIP ", False, [1, 3]), ("231", False, [2]), ("null", False, []), ("  ", False, [0, 1, 2, 3, 4]),
                                                  (r"\b[89]\d\b", True, [1, 3]), ("(", True, [0, 1, 2, 3, 4]), ("a++", True, [0, 1, 2, 3, 4]), ("^/STOCK/n", True, [2])])
def test_search(table, query, regex, expected):
    t = table("state:string crates:number route:string", PARCELS)
    assert ids(lf.search(t, query, regex)) == expected
    assert ids(lf.search(lf.to_typed(t), query, regex)) == expected


def test_search_sees_coerced_text(table):
    t = table("n:number flag:boolean", [("007", "yes"), ("70", "no"), ("x007", "maybe")])
    assert ids(lf.search(t, "007")) == [2]
    assert ids(lf.search(t, "true")) == [0]


def test_search_reads_only_columns_that_can_match(spark, tmp_path):
    spark.range(5).selectExpr("id", "cast(id as double) x", "'abc' s", "id > 2 flag", "timestamp_ntz'2026-01-01' d").write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    plan = lf.search(t, "zzz").select("s")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<s:string>" in plan
    assert lf.search(t, "true").count() == 2 and lf.search(t, "01-01t00").count() == 5 and lf.search(t, "4").count() == 1


def test_extract(table):
    data = [("dock 198.51.100.7 opened; dock 198.51.100.7 shut", "203.0.113.20"), (None, "198.51.100.7"), ("version 1.2.3", ""), ("bridge 203.0.113.20 -> 192.0.2.55", None)]
    t = table("note:string peer:string", data)
    assert rows(lf.extract_matches(t, "ipv4")) == [("198.51.100.7", 3), ("203.0.113.20", 2), ("192.0.2.55", 1)]
    assert rows(lf.extract_matches(t, r"DOCK|bridge")) == [("dock", 2), ("bridge", 1)]
    assert rows(lf.extract_matches(t, "[")) == [] and rows(lf.extract_matches(t, "ipv4", limit=2)) == [("198.51.100.7", 3), ("203.0.113.20", 2)]
    assert ids(lf.quick_pattern(t, "ipv4")) == [0, 1, 3]


# --- order ----------------------------------------------------------------------------------

LATENCY = [("INFO", "10"), ("ERROR", "50"), ("ERROR", "20"), ("INFO", "5"), ("WARN", None)]


@pytest.mark.parametrize("keys,expected", [
    ([("latency", "asc")], [3, 0, 2, 1, 4]),
    ([("latency", "desc")], [1, 2, 0, 3, 4]),
    ([("level", "asc"), ("latency", "desc")], [1, 2, 0, 3, 4]),
    ([("level", "asc"), ("latency", "asc")], [2, 1, 3, 0, 4]),
    ([("gone", "asc"), ("level", "desc")], [4, 0, 3, 1, 2]),
    ([("gone", "asc")], [0, 1, 2, 3, 4]),
])
def test_multi_sort(table, keys, expected):
    t = table("level:string latency:number", LATENCY)
    assert ids(lf.multi_sort(t, keys)) == expected


def test_sort_puts_text_after_numbers_and_blanks_last(table):
    t = table("n:number", [("b10",), ("7",), (None,), ("b9",), ("12",), ("",)])
    assert ids(lf.multi_sort(t, [("n", "asc")])) == [1, 4, 3, 0, 2, 5]
    assert ids(lf.multi_sort(t, [("n", "desc")])) == [4, 1, 0, 3, 2, 5]


def test_sort_against_brute_force(spark, table):
    rng = random.Random(3)
    data = [(rng.choice(["a", "b", "B", None]), rng.choice(["1", "2.5", "10", None]), rng.choice(["yes", "no", None])) for _ in range(200)]
    t = table("s:string n:number f:boolean", data)
    keys = [("f", "desc"), ("s", "asc"), ("n", "desc")]
    value = {"s": lambda r: {"a": 0, "b": 1, "B": 2}.get(r[0]), "n": lambda r: r[1] and float(r[1]), "f": lambda r: r[2] and r[2] == "yes"}

    def compare(i, j):
        for key, direction in keys:
            a, b = value[key](data[i]), value[key](data[j])
            if a == b:
                continue
            if a is None or b is None:
                return 1 if a is None else -1
            return (1 if a > b else -1) * (1 if direction == "asc" else -1)
        return i - j

    expected = sorted(range(200), key=functools.cmp_to_key(compare))
    assert ids(lf.multi_sort(t, keys)) == expected
    assert ids(lf.top_k(t, keys, 7)) == expected[:7]
    assert ids(lf.page(t, keys, 30, 5)) == expected[30:35]
    placed = lf.with_position(t.repartition(5), sort_order(t, keys))
    assert [r["_row_id"] for r in placed.orderBy("position").collect()] == expected
    assert sorted(r["position"] for r in placed.collect()) == list(range(200))


def test_deep_page(spark, monkeypatch):
    monkeypatch.setattr("logframe.operators.ordering.RANGE_ROWS", 10)
    df = lf.with_row_id(spark.range(500).selectExpr("id", "id % 3 AS k").repartition(7), "id")
    expected = sorted(range(500), key=lambda i: (-(i % 3), i))
    assert [r["id"] for r in lf.page(df, [("k", "desc")], 340, 20).collect()] == expected[340:360]


def test_views_of_columns(table):
    t = table("a:string b:number c:date", [("x", "1", "2026-01-01")], row_id=False)
    saved = [{"key": "c", "visible": True}, {"key": "gone"}, {"key": "a", "visible": False}]
    view = lf.reconcile_columns(t, saved)
    assert view == [{"key": "c", "visible": True}, {"key": "a", "visible": False}, {"key": "b", "visible": True}]
    assert lf.select_view(t, view).columns == ["c", "b"]
    assert lf.signature(t) == "a:string|b:number|c:date"


# --- groups and charts ----------------------------------------------------------------------

# A Sunday night, the Monday after it, and a Sunday four weeks on.
SHIFTS = [("ok", "4", "2025-11-02T23:10:00"), ("ok", "9", "2025-11-02T23:50:00"), ("bad", "31", "2025-11-03T00:05:00"), ("odd", "2", "2025-11-30T12:00:00")]


def test_group_aggregates(table):
    t = table("kind:string n:number at:date", SHIFTS + [(None, "x", "soon"), ("(empty)", None, None)])
    get = lambda agg: dict(rows(lf.group_aggregate(t, "kind", agg, "n")))
    assert get("count") == {"ok": 2, "bad": 1, "odd": 1, "(empty)": 2}
    assert get("sum") == {"ok": 13, "bad": 31, "odd": 2, "(empty)": 0}
    assert get("avg") == {"ok": 6.5, "bad": 31, "odd": 2, "(empty)": 0}
    assert get("min") == {"ok": 4, "bad": 31, "odd": 2, "(empty)": 0}
    assert get("max") == {"ok": 9, "bad": 31, "odd": 2, "(empty)": 0}
    by = lambda bucket: dict(rows(lf.group_aggregate(t, "at", bucket=bucket)))
    assert by("hour") == {"2025-11-02 23:00": 2, "2025-11-03 00:00": 1, "2025-11-30 12:00": 1, "soon": 1, "(empty)": 1}
    assert by("week") == {"2025-10-27": 2, "2025-11-03": 1, "2025-11-24": 1, "soon": 1, "(empty)": 1}
    assert by("day")["2025-11-02"] == 2 and by("month")["2025-11"] == 4
    assert rows(lf.group_aggregate(t, "gone")) == [] and dict(rows(lf.group_aggregate(t, "kind", "sum", "gone")))["ok"] == 0


def test_native_groups_print_like_text(spark):
    df = spark.createDataFrame([(7.0, True), (7.5, None), (None, False)], "x double, f boolean")
    assert dict(rows(lf.group_aggregate(df, "x"))) == {"7": 1, "7.5": 1, "(empty)": 1}
    assert dict(rows(lf.group_aggregate(df, "f"))) == {"true": 1, "false": 1, "(empty)": 1}
    with pytest.raises(ValueError):
        lf.group_aggregate(df, "x", "median", "x")


def test_chart_order_and_limits(table):
    t = table("k:string v:number", [("b", "1"), ("a", "1"), ("c10", "5"), ("c9", "1")])
    assert rows(lf.chart_series(t, "k", "sum", "v")) == [("c10", 5.0), ("b", 1.0), ("a", 1.0), ("c9", 1.0)]
    assert [r[0] for r in rows(lf.chart_series(t, "k", kind="line"))] == ["a", "b", "c9", "c10"]
    many = table("k:string", [(f"k{i}",) for i in range(120)])
    assert [lf.chart_series(many, "k", kind=k).count() for k in ("bar", "line", "pie")] == [40, 100, 8]
    assert rows(lf.group_total(many, "k")) == [(120,)]


# --- profiles -------------------------------------------------------------------------------


def test_column_stats(table):
    t = table("dept:string wage:number", [("x1", "7"), ("x1", "9"), ("y2", None), ("z3", "21"), ("", "7.0"), (None, "n/a"), ("y2", "2")])
    exact = [("dept", "string", 5, 2, 3, None, None, None, None), ("wage", "number", 6, 1, 5, 2.0, 21.0, 9.2, 46.0)]
    assert rows(lf.column_stats(t)) == exact
    assert rows(lf.column_stats(t, approximate=True)) == exact
    assert rows(lf.column_stats(lf.to_typed(t), ["wage"])) == [("wage", "number", 5, 2, 4, 2.0, 21.0, 9.2, 46.0)]
    assert rows(lf.column_stats(t.filter("1 = 0"))) == [("dept", "string", 0, 0, 0, None, None, None, None), ("wage", "number", 0, 0, 0, None, None, None, None)]


def test_distributions(table):
    t = table("dept:string n:number blank:string", [("x1", "6", None), ("x1", "18", None), ("y2", "120", ""), ("z3", "60", None), ("x1", None, None), ("y2", "6", "")])
    assert rows(lf.top_values(t)) == [("dept", "x1", 3, 0.5, 6, 0), ("dept", "y2", 2, 2 / 6, 6, 0), ("dept", "z3", 1, 1 / 6, 6, 0)]
    h = rows(lf.histogram(t))
    assert len(h) == 12 and {r[1]: r[4] for r in h if r[4]} == {0: 2, 1: 1, 5: 1, 11: 1}
    assert (h[0][2], h[11][3]) == (6.0, 120.0)
    assert dict(rows(lf.column_kinds(t))) == {"dept": "categorical", "n": "numeric", "blank": "empty"}
    assert rows(lf.histogram(table("n:number", [("5",), ("5",), ("x",)])))[0] == ("n", 0, 5.0, 5.0, 2)
    assert rows(lf.histogram(table("n:number", [("x",), (None,)]))) == []
    assert lf.bin_bounds(0, 120, 5) == (50, 60) and lf.bin_bounds(0, 120, 11) == (110, 120)


def test_top_values_sum_up_the_rest(table):
    t = table("k:string", [(f"k{i % 8}",) for i in range(30)])
    got = rows(lf.top_values(t, n=5))
    assert [r[1] for r in got] == ["k0", "k1", "k2", "k3", "k4"] and {r[5] for r in got} == {10}


def test_distinct_counts(spark):
    df = spark.range(10_001).selectExpr("id", "id % 7 AS k")
    assert rows(lf.distinct_counts(df)) == [("id", 10_001, 10_000, True), ("k", 7, 7, False)]


# --- cross tables ---------------------------------------------------------------------------

STORES = [("Oslo", "true", "4"), ("Oslo", "true", "6"), ("Oslo", "true", "2"), ("Bergen", "false", "50"), ("Oslo", "false", "8"), ("Bergen", "true", None), ("Narvik", None, "3")]


def cells(df):
    return {(r["row_value"], r["col_value"]): r["value"] for r in df.collect()}


def test_crosstab(table):
    t = table("depot:string frozen:boolean kilos:number", STORES)
    assert cells(lf.crosstab(t, "depot", "frozen")) == {
        ("Oslo", "true"): 3, ("Oslo", "false"): 1, ("Oslo", None): 4, ("Bergen", "true"): 1, ("Bergen", "false"): 1, ("Bergen", None): 2,
        (None, "true"): 4, (None, "false"): 2, (None, None): 6,
    }
    sums = cells(lf.crosstab(t, "depot", "frozen", "sum", "kilos"))
    assert (sums["Oslo", "true"], sums["Bergen", "false"], sums["Bergen", "true"], sums[None, None]) == (12, 50, 0, 70)
    avg = cells(lf.crosstab(t, "depot", "frozen", "avg", "kilos"))
    assert (avg["Oslo", "true"], avg["Oslo", "false"], avg["Bergen", "false"], avg[None, None]) == (4, 8, 50, 14)
    assert rows(lf.largest_cell(lf.crosstab(t, "depot", "frozen"))) == [(3.0,)]
    wide = {r["row_value"]: (r["true"], r["false"]) for r in lf.pivot_wide(lf.crosstab(t, "depot", "frozen")).collect()}
    assert wide == {"Oslo": (3, 1), "Bergen": (1, 1)}
    assert lf.crosstab(t, "depot", "gone") is None and lf.default_axes(t) == ("depot", "frozen")


def test_crosstab_ranges(table):
    t = table("depot:string frozen:boolean kilos:number", STORES)
    got = cells(lf.crosstab(t, "kilos", "depot", row_bucket=True))
    assert (got["0–5", "Oslo"], got["0–5", "Narvik"], got["5–10", "Oslo"], got["50–55", "Bergen"], got[None, None]) == (2, 1, 2, 1, 6)
    single = lf.crosstab(table("n:number s:string", [("5", "a"), ("5", "b"), ("x", "a")]), "n", "s", row_bucket=True)
    assert cells(single)["5", None] == 2 and cells(single)[None, "a"] == 1
    empty = lf.crosstab(table("n:number s:string", [("x", "a")]), "n", "s", row_bucket=True)
    assert cells(empty)[None, None] == 0


def test_crosstab_collects_the_rest(table):
    data = [(f"v{i}", "(others)" if i % 2 else "x") for i in range(25) for _ in range(1 + (i < 3))]
    out = lf.crosstab(table("k:string s:string", data), "k", "s")
    axis = [r["row_value"] for r in out.filter("level = 'row_total'").orderBy("row_at").collect()]
    assert axis == ["v0", "v1", "v2", *(f"v{i}" for i in range(3, 19)), "(others)"]
    rest = out.filter("row_others and level = 'row_total'").first()
    assert rest["value"] == 6 and rest["row_at"] == 19
    assert out.filter("col_others").count() == 0 and cells(out)[None, "(others)"] == 13
    assert lf.from_cell(out.filter("row_others").first(), "k", "string", "s", "string") == []


def test_crosstab_on_unusual_values(spark):
    df = spark.createDataFrame([(1.5, "b"), (float("nan"), "c"), (1.5, ""), (None, "a"), (2.0, "a")], "x double, s string")
    got = cells(lf.crosstab(df, "x", "s"))
    assert got["1.5", "b"] == 1 and got["2", "a"] == 1 and got[None, None] == 3


# --- comparison -----------------------------------------------------------------------------


def test_overlay(table):
    a = table("level:string latency:number x:string", [("INFO", "10", ""), ("INFO", "20", ""), ("ERROR", "100", "")])
    b = table("level:string latency:number", [("INFO", "5"), ("WARN", "50")])
    assert rows(lf.overlay({"a.csv": a, "b.csv": b}, "level")) == [("INFO", 2, 1), ("ERROR", 1, 0), ("WARN", 0, 1)]
    assert rows(lf.overlay({"a": a, "b": b}, "level", "avg", "latency", kind="line")) == [("ERROR", 100.0, 0.0), ("INFO", 15.0, 5.0), ("WARN", 0.0, 50.0)]
    filtered = lf.overlay({"a": a, "b": b}, "level", filters={"a": [("latency", "gt", "15")]})
    assert rows(filtered) == [("INFO", 1, 1), ("ERROR", 1, 0), ("WARN", 0, 1)]
    assert lf.overlay({"a": a, "b": b}, "gone").columns == ["name", "a", "b"]
    many = table("k:string", [(f"k{i}",) for i in range(70)])
    assert lf.overlay({"a": many, "b": many}, "k").count() == 60
    assert [f.key for f in lf.common_columns([a, b])] == ["level", "latency"] and [f.key for f in lf.common_columns([a, b], numeric=True)] == ["latency"]
    assert lf.labels(["x", "y", "x", "x"]) == ["x", "y", "x (2)", "x (3)"]
    both = lf.align_tables({"a": a, "b": lf.to_typed(b)})
    assert both.columns == ["_file", "level", "latency"] and both.count() == 5 and lf.signature(both) == "level:string|latency:number"


def test_schema_diff(table):
    a = table("id:number level:string referrer:string", [])
    b = table("id:string level:string bytes:number", [])
    got = {(r["key"], r["status"], r["from_type"], r["to_type"]) for r in lf.schema_diff(a, b).collect()}
    assert got == {("bytes", "added", None, "number"), ("referrer", "removed", "string", None), ("id", "changed", "number", "string"), ("level", "unchanged", "string", "string")}


def test_row_diff(table):
    a = table("part:string grams:number note:string", [("k7", "15", ""), ("k2", "31", "old"), ("k9", "8", None), (None, "1", ""), ("k7", "9", "")])
    b = table("part:string grams:number note:string", [("k5", "64", None), ("k2", "31", "new"), ("", "7", ""), ("k7", "15.0", None)])
    diff = lf.row_diff(a, b, "part")
    got = {r["key"]: (r["status"], [tuple(c) for c in r["changes"]], r["duplicated"]) for r in diff.collect()}
    assert got == {"k7": ("unchanged", [], True), "k2": ("changed", [("note", "old", "new")], False), "k9": ("removed", [], False), "k5": ("added", [], False)}
    assert rows(lf.diff_summary(diff)) == [(1, 1, 1, 1, True)]
    assert rows(lf.changed_fields(diff)) == [("k2", "note", "old", "new")]
    assert {(r["status"], r["place"], r["key"]) for r in lf.diff_samples(diff).collect()} == {("added", 1, "k5"), ("removed", 1, "k9"), ("changed", 1, "k2")}
    assert lf.row_diff(a, b, "gone") is None
    native = {r["key"]: r["status"] for r in lf.row_diff(lf.to_typed(a), b, "part").collect()}
    assert native == {"k7": "unchanged", "k2": "changed", "k9": "removed", "k5": "added"}


def test_row_diff_compares_keys_as_text(spark, table):
    a = table("id:number v:string", [("7", "a"), ("08", "b")])
    b = spark.createDataFrame([(7, "a"), (8, "c")], "id int, v string")
    assert {r["key"]: r["status"] for r in lf.row_diff(a, b, "id").collect()} == {"7": "unchanged", "8": "changed"}


def test_samples_keep_the_table_order(table):
    a = table("id:string v:string", [(f"a{i}", "1") for i in range(30, 0, -1)])
    b = table("id:string v:string", [(f"b{i}", "1") for i in range(25, 0, -1)])
    got = lf.diff_samples(lf.row_diff(a, b)).orderBy("status", "place").collect()
    assert [r["key"] for r in got] == [f"b{i}" for i in range(25, 5, -1)] + [f"a{i}" for i in range(30, 10, -1)]


def test_labels_stay_apart():
    from logframe.operators.compare import labels

    assert labels(["q.csv", "r.csv", "q.csv", "q.csv (2)", "q.csv"]) == ["q.csv", "r.csv", "q.csv (3)", "q.csv (2)", "q.csv (4)"]


def test_long_digit_runs_sort_by_length(spark):
    from logframe.functions.values import natural_key

    runs = ["v" + "7" * n for n in (1000, 998, 1002, 999, 9)]
    df = spark.createDataFrame([(r,) for r in runs], "t string")
    assert [len(r["t"]) for r in df.orderBy(natural_key(F.col("t"))).collect()] == [10, 999, 1000, 1001, 1003]


def test_every_row_votes_on_types(table):
    df = table("a:string", [(str(k),) for k in range(60)] + [("abc",)] * 100)
    assert lf.field_of(lf.infer_types(df), "a").type == "string"
