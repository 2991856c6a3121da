import datetime as dt

import pytest
from pyspark.sql import functions as F

import logframe as lf
from conftest import ids

HARBOURS = [("storm", "90", "no"), ("calm", None, "TRUE"), ("brisk", "55", None), ("calm", "12", "Yes"), ("storm", "97", "false"), ("gale", "55", "no")]


@pytest.fixture(scope="module")
def harbours(table):
    return table("wind:string knots:number open:boolean", HARBOURS).cache()


@pytest.fixture(scope="module")
def typed(harbours):
    return lf.to_typed(harbours).cache()


ALL = [0, 1, 2, 3, 4, 5]
CASES = [
    ([("wind", "contains", "ORM")], [0, 4]),
    ([("wind", "notContains", "al")], [0, 2, 4]),
    ([("knots", "equals", "55")], [2, 5]),
    ([("knots", "equals", "55.0")], [2, 5]),
    ([("knots", "equals", "abc")], []),
    ([("knots", "notEquals", "55")], [0, 1, 3, 4]),
    ([("knots", "notEquals", "abc")], ALL),
    ([("knots", "gte", "90")], [0, 4]),
    ([("knots", "gt", "90")], [4]),
    ([("knots", "lt", "55")], [3]),
    ([("knots", "lte", "55.5")], [2, 3, 5]),
    ([("knots", "between", "97", "55")], [0, 2, 4, 5]),
    ([("knots", "isEmpty")], [1]),
    ([("knots", "isNotEmpty")], [0, 2, 3, 4, 5]),
    ([("knots", "contains", "5")], [2, 5]),
    ([("knots", "gt", "-Infinity")], [0, 2, 3, 4, 5]),
    ([("open", "isTrue")], [1, 3]),
    ([("open", "isFalse")], [0, 4, 5]),
    ([("open", "equals", "TRUE")], [1, 3]),
    ([("open", "notEquals", "true")], [0, 2, 4, 5]),
    ([("open", "gt", "0")], [1, 3]),
    ([("wind", "isTrue")], []),
    ([("wind", "contains", "storm"), ("knots", "gte", "97")], [4]),
    ([("nothing", "equals", "x"), ("wind", "equals", "CALM")], [1, 3]),
    *(([("knots", *rest)], ALL) for rest in (("gt", ""), ("gt", "x"), ("between", "1", "x"))),
]


@pytest.mark.parametrize("conditions,expected", CASES)
def test_conditions_on_raw_and_native_columns(harbours, typed, conditions, expected):
    assert sorted(ids(lf.filter_all(harbours, conditions))) == expected
    assert sorted(ids(lf.filter_all(typed, conditions))) == expected


def test_unparsed_cells_stay_text(table):
    t = table("n:number", [("5",), ("five",), ("5.0",), (None,), ("",), ("0x5",)])
    assert ids(lf.filter_all(t, [("n", "equals", "5")])) == [0, 2, 5]
    assert ids(lf.filter_all(t, [("n", "notEquals", "5")])) == [1, 3, 4]
    assert ids(lf.filter_all(t, [("n", "contains", "FIVE")])) == [1]
    assert ids(lf.filter_all(t, [("n", "isEmpty")])) == [3, 4]
    assert ids(lf.filter_all(t, [("n", "isNotEmpty")])) == [0, 1, 2, 5]


DATES = ["2026-06-19T08:00:00", "2026-06-20", "garbage", None, "2026-06-19T23:59:59.500"]


def test_dates_compare_as_instants(table):
    t = table("at:date", [(d,) for d in DATES])
    assert ids(lf.filter_all(t, [("at", "gt", "2026-06-19T12:00:00")])) == [1, 4]
    assert ids(lf.filter_all(t, [("at", "between", "2026-06-20", "2026-06-19")])) == [0, 1, 4]
    assert ids(lf.filter_all(t, [("at", "lte", "nonsense")])) == [0, 1, 2, 3, 4]
    assert ids(lf.filter_all(t, [("at", "equals", "GARBAGE")])) == [2]
    assert ids(lf.filter_all(t, [("at", "contains", "06-19")])) == [0, 4]
    assert ids(lf.filter_all(t, [("at", "gte", "2026-06-20T02:00:00+02:00")])) == [1]


@pytest.mark.parametrize("stored", ["timestamp", "timestamp_ntz", "date"])
def test_native_dates(spark, stored):
    df = spark.createDataFrame([(0, "2026-06-19"), (1, "2026-06-20"), (2, None)], "_row_id bigint, d string").withColumn("d", F.col("d").cast(stored))
    assert ids(lf.filter_all(df, [("d", "gte", "2026-06-20")])) == [1]
    assert ids(lf.filter_all(df, [("d", "equals", "2026-06-19")])) == [0]
    assert ids(lf.filter_all(df, [("d", "notEquals", "2026-06-19")])) == [1, 2]
    assert ids(lf.filter_all(df, [("d", "lt", "2026-06-19T12:00:00")])) == [0]


@pytest.mark.parametrize("op,expected", [("gt", [2]), ("gte", [2]), ("lt", [0, 1]), ("lte", [0, 1]), ("equals", []), ("notEquals", [0, 1, 2, 3])])
def test_fraction_against_whole_numbers(spark, op, expected):
    df = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, None)], "_row_id bigint, n int")
    assert ids(lf.filter_all(df, [("n", op, "2.5")])) == expected


@pytest.mark.parametrize("operand,op,expected", [("1e30", "lt", [0, 1]), ("1e30", "gt", []), ("-Infinity", "gt", [0, 1]), ("3000000000", "lte", [0, 1]), ("-3000000000.5", "lt", [])])
def test_operands_outside_the_column_type(spark, operand, op, expected):
    df = spark.createDataFrame([(0, 1), (1, -2), (2, None)], "_row_id bigint, n int")
    assert ids(lf.filter_all(df, [("n", op, operand)])) == expected


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(0, 1.0), (1, float("nan")), (2, None)], "_row_id bigint, x double")
    assert ids(lf.filter_all(df, [("x", "gt", "0")])) == [0]
    assert ids(lf.filter_all(df, [("x", "lte", "5")])) == [0]


def test_groups(harbours):
    brisk = [("wind", "equals", "BRISK")]
    heavy = [("wind", "equals", "STORM"), ("knots", "gt", "90")]
    assert ids(lf.filter_groups(harbours, [brisk, heavy])) == [2, 4]
    assert ids(lf.filter_groups(harbours, [[("knots", "gt", "")], heavy])) == [4]
    assert ids(lf.filter_groups(harbours, [[("knots", "gt", "")]])) == ALL
    assert ids(lf.filter_groups(harbours, [])) == ALL


def test_operator_catalogue():
    assert lf.operators_for("boolean") == ["isTrue", "isFalse", "isEmpty", "isNotEmpty"]
    assert "between" in lf.operators_for("date") and "contains" not in lf.operators_for("number")
    assert len(lf.OPERATORS) == 13


def test_native_comparisons_reach_the_scan(spark, tmp_path):
    df = spark.range(10).selectExpr("id", "cast(id as int) n", "cast(id as double) x", "timestamp_ntz'2026-01-01' + make_dt_interval(id) d", "cast(id as string) s")
    df.write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    conditions = [("id", "gt", "2.5"), ("n", "lte", "7"), ("x", "between", "1", "8"), ("d", "gte", "2026-01-02"), ("id", "notEquals", "4")]
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = lf.filter_all(t, conditions)._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("\n")[0]
    for part in ("GreaterThanOrEqual(id,3)", "LessThanOrEqual(n,7)", "GreaterThanOrEqual(x,1.0)", "GreaterThanOrEqual(d,2026-01-02", "EqualNullSafe(id,4)"):
        assert part in pushed
    assert sorted(r["id"] for r in lf.filter_all(t, conditions).collect()) == [3, 5, 6, 7]


def test_drill_down(harbours):
    assert lf.from_range("knots", 12.0, 55.5) == lf.Condition("knots", "between", "12", "55.5")
    assert lf.from_category("open", "boolean", "false").op == "isFalse"
    assert lf.from_category("wind", "string", "gale") == lf.Condition("wind", "equals", "gale")
    assert lf.from_field("knots", "number", None).op == "isEmpty"
    assert lf.narrow([["a"], ["b"]], ["c"]) == [["a", "c"], ["b"]]
    assert lf.narrow([], ["c"]) == [["c"]]
    cell = lf.crosstab(harbours, "wind", "open").filter("row_value = 'calm' and col_value = 'true'").first()
    conditions = lf.from_cell(cell, "wind", "string", "open", "boolean")
    assert ids(lf.filter_groups(harbours, [conditions])) == [1, 3]


def test_iso_operands():
    from logframe.functions.dates import parse_iso

    assert parse_iso("2026") == dt.datetime(2026, 1, 1)
    assert parse_iso("2026-06-19 08:01") == dt.datetime(2026, 6, 19, 8, 1)
    assert parse_iso("2026-06-19T08:01:12.5Z") == dt.datetime(2026, 6, 19, 8, 1, 12, 500000)
    assert parse_iso("2026-13-01") is None and parse_iso("June 19") is None
