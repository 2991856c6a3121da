"""What plans read and move, and results at the edges of the ways they take."""

import functools
import random

import pytest
from pyspark.sql import functions as F

import logframe as lf
from conftest import ids, rows
from logframe.operators import ordering, profile


def plan_of(df):
    """The plan as it ran, or as it would; broadcasts and reused parts are not shown twice."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("+- == Initial Plan ==")[0] if "== Initial Plan ==" in text else text


@pytest.fixture
def stored(spark, tmp_path):
    """Rows as a CSV file of several splits, so that scans are seen in the plan."""

    def put(df, name="in"):
        path = str(tmp_path / name)
        df.write.options(header=True).csv(path)
        return spark.read.options(header=True).schema(df.schema).csv(path)

    return put


# --- row differences ---------------------------------------------------------------------------


def editions(spark, n=2000, hot=0):
    a = spark.range(n).selectExpr("id AS _row_id", "id AS k", "id % 7 AS v")
    b = spark.range(n).selectExpr("id AS _row_id", "id + 10 AS k", "(id + 10) % 7 + CAST(id % 50 = 0 AS int) AS v")
    again = spark.range(hot).selectExpr(f"{n} + id AS _row_id", "42L AS k", "id AS v")
    return (a.union(again), b.union(again)) if hot else (a, b)


@pytest.mark.parametrize("hot", [0, 5000])
def test_row_diff_needs_no_sorted_aggregate(spark, stored, hot):
    a, b = editions(spark, hot=hot)
    diff = lf.row_diff(stored(a, "a"), stored(b, "b"), "k")
    plan = plan_of(diff)
    assert "SortAggregate" not in plan
    # Each table is dealt by key once, for the join.
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("FileScan csv") == 2
    assert rows(lf.diff_summary(diff)) == [(10, 10, 40, 1950, bool(hot))]
    got = {r["key"]: (r["status"], r["a_at"], r["b_at"], r["duplicated"]) for r in diff.filter("key in ('42', '5', '2005')").collect()}
    assert got == {"42": ("unchanged", 42, 32, bool(hot)), "5": ("removed", 5, None, False), "2005": ("added", None, 1995, False)}


def test_row_diff_takes_the_smallest_row_without_positions(spark):
    rng = random.Random(1)
    a, b = ([(rng.randint(0, 40), rng.choice("xyz"), rng.choice([None, 1.5, 2.5])) for _ in range(400)] for _ in range(2))
    df_a, df_b = (spark.createDataFrame(x, "k int, s string, f double").repartition(5) for x in (a, b))
    low = lambda data: {k: min(((s, f) for j, s, f in data if j == k), key=lambda r: (r[0], r[1] is not None, r[1] or 0)) for k in {r[0] for r in data}}
    first_a, first_b = low(a), low(b)
    want = {str(k): ("added" if k not in first_a else "removed" if k not in first_b else "unchanged" if first_a[k] == first_b[k] else "changed") for k in {*first_a, *first_b}}
    diff = lf.row_diff(df_a, df_b, "k")
    assert {r["key"]: r["status"] for r in diff.collect()} == want
    assert "SortAggregate" not in plan_of(diff)


def test_row_diff_with_a_position_twice(spark):
    a = spark.createDataFrame([(1, "k", "b"), (1, "k", "a"), (2, "k", "0"), (3, "l", "x")], "_row_id long, key string, v string")
    b = spark.createDataFrame([(1, "k", "a"), (2, "l", "x")], "_row_id long, key string, v string")
    assert sorted(rows(lf.row_diff(a, b, "key"), "key", "status", "duplicated")) == [("k", "unchanged", True), ("l", "unchanged", False)]


# --- profiles ----------------------------------------------------------------------------------


def mixed(spark, n=3000):
    return spark.range(n).selectExpr(
        "id", "cast(id % 11 AS int) AS small", "id / 8.0D AS real", "cast(id % 100 AS decimal(10, 2)) AS price", "cast(id % 90 AS string) AS word",
        "id % 2 = 0 AS flag", "date_add(DATE'2024-01-01', cast(id % 31 AS int)) AS day", "timestamp_seconds(id % 500) AS at",
        "cast(timestamp_seconds(id % 400) AS timestamp_ntz) AS local", "if(id % 3 = 0, NULL, id % 17) AS gaps",
    )


def test_column_stats_read_a_file_once(spark, stored):
    df = stored(mixed(spark))
    stats = lf.column_stats(df)
    plan = plan_of(stats)
    assert plan.count("FileScan csv") == 1 and plan.count("Exchange hashpartitioning") == 2 and "SortAggregate" not in plan
    assert plan_of(lf.distinct_counts(df)).count("FileScan csv") == 1
    assert plan_of(lf.column_stats(df, approximate=True)).count("FileScan csv") == 1


def test_column_stats_of_every_type(spark):
    df = mixed(spark)
    df = df.union(spark.range(1).selectExpr(*(f"CAST(NULL AS {kind})" for _, kind in df.dtypes)))
    got = {r["key"]: r for r in lf.column_stats(df).collect()}
    distinct = {"id": 3000, "small": 11, "real": 3000, "price": 100, "word": 90, "flag": 2, "day": 31, "at": 500, "local": 400, "gaps": 17}
    assert list(got) == df.columns and {k: r["distinct_count"] for k, r in got.items()} == distinct
    assert {r["key"]: r["distinct_count"] for r in lf.distinct_counts(df).collect()} == distinct
    for c in ("id", "small", "real", "price", "gaps"):
        want = df.agg(F.count(c), F.min(c).cast("double"), F.max(c).cast("double"), F.avg(c).cast("double"), F.sum(c).cast("double")).first()
        assert [got[c][k] for k in ("count", "min", "max", "mean", "sum")] == pytest.approx(list(want))
    assert got["word"]["sum"] is None and got["gaps"]["null_count"] == 1001


def test_numbers_that_are_none(spark):
    df = spark.createDataFrame([(float("nan"),), (float("nan"),), (-0.0,), (0.0,), (None,)], "x double")
    assert rows(lf.column_stats(df)) == [("x", "number", 4, 1, 2, 0.0, 0.0, 0.0, 0.0)]


def frequent(data, n):
    counts = {}
    for i, v in enumerate(data):
        if v is not None:
            c, at = counts.get(v, (0, i))
            counts[v] = (c + 1, at)
    top = sorted(counts.items(), key=lambda x: (-x[1][0], x[1][1]))[:n]
    return [(v, c) for v, (c, _) in top]


@pytest.mark.parametrize("kind", ["proven", "flat", "few"])
def test_top_values_by_sketch_and_by_full_count(spark, monkeypatch, kind):
    rng = random.Random(kind)
    heavy = [f"heavy{k}" for k in range(9) for _ in range(300 + 10 * k)]
    data = {"proven": heavy + [f"r{i}" for i in range(9000)], "flat": [f"r{i % 4000}" for i in range(12000)], "few": heavy + [None] * 100}[kind]
    rng.shuffle(data)
    monkeypatch.setattr(profile, "SKETCH", 256)
    monkeypatch.setattr(profile, "LISTED", 40)
    monkeypatch.setattr(profile, "MANY", 0)
    df = spark.createDataFrame(list(enumerate(data)), "_row_id long, v string").repartition(6)
    _, only = profile._frequent(df, profile._chosen(df, None, numeric=False), 5)
    assert (0 in only) == (kind != "flat")
    got = lf.top_values(df)
    assert [(r["value"], r["count"]) for r in got.collect()] == frequent(data, 5)
    assert {r["total"] for r in got.collect()} == {sum(v is not None for v in data)}
    if kind == "proven":  # only the frequent values are counted
        assert set(only[0]) <= {f"heavy{k}" for k in range(9)}


def test_top_values_read_a_file_twice_for_any_number_of_columns(spark, stored):
    df = stored(spark.range(500).selectExpr("cast(id % 3 AS string) AS a", "cast(id % 5 AS string) AS b", "cast(id AS string) AS c", "id % 2 = 0 AS d"))
    top = lf.top_values(df)  # the first pass has run
    assert plan_of(top).count("FileScan csv") == 1
    assert [r["key"] for r in top.collect()] == ["a"] * 3 + ["b"] * 5 + ["c"] * 5 + ["d"] * 2


# --- pages and sorts -----------------------------------------------------------------------------


def before(a, b, directions):
    for x, y, direction in zip(a, b, directions):
        if x == y:
            continue
        if x is None or y is None:
            return 1 if x is None else -1
        return (1 if x > y else -1) * (1 if direction == "asc" else -1)
    return 0


@pytest.mark.parametrize("positions", [True, False])
def test_pages_of_every_depth_fit_together(spark, monkeypatch, positions):
    monkeypatch.setattr(ordering, "RANGE_ROWS", 25)
    monkeypatch.setattr(ordering, "RANGES", 4)
    monkeypatch.setattr(ordering, "SAMPLED", 40)
    monkeypatch.setattr(ordering, "materialize", None)  # no table is written
    rng = random.Random(5)
    data = [(i, rng.choice([None, 1.5, 2.5, 3.5]), rng.choice([None, "a", "b", "b2", "b10"]), rng.choice([True, False, None])) for i in range(400)]
    df = spark.createDataFrame(data, "id long, x double, s string, f boolean").repartition(7)
    df = lf.with_row_id(df, "id") if positions else df.drop("id").withColumn("same", F.lit(1))
    natural = {None: None, "a": 0, "b": 1, "b2": 2, "b10": 3}

    key = (lambda r: (natural[r[2]] if r[2] else None, r[1], r[3], r[0] if positions else 0))
    want = sorted(data, key=functools.cmp_to_key(lambda a, b: before(key(a), key(b), ("desc", "asc", "desc", "asc"))))
    keys = [("s", "desc"), ("x", "asc"), ("f", "desc")]
    for offset, n in ((0, 10), (95, 30), (200, 7), (390, 30), (400, 5), (1000, 5)):
        got = [(r["id"] if positions else None, r["x"], r["s"], r["f"]) for r in lf.page(df, keys, offset, n).collect()]
        assert got == [((r[0] if positions else None), *r[1:]) for r in want[offset : offset + n]], offset


def test_page_by_dates_times_and_decimals(spark, monkeypatch):
    monkeypatch.setattr(ordering, "RANGE_ROWS", 20)
    monkeypatch.setattr(ordering, "RANGES", 5)
    monkeypatch.setattr(ordering, "SAMPLED", 50)
    df = spark.range(600).selectExpr("id", "date_add(DATE'1969-12-01', cast(id % 60 AS int)) AS d", "timestamp_micros(id % 7 * 1234567) AS t", "cast(id % 13 / 8 AS decimal(9, 3)) AS p", "cast(timestamp_seconds(id % 5) AS timestamp_ntz) AS z")
    want = [r["id"] for r in df.orderBy(F.desc("d"), "t", F.desc("p"), "z", "id").collect()]
    keys = [("d", "desc"), ("t", "asc"), ("p", "desc"), ("z", "asc"), ("id", "asc")]
    for offset in (0, 250, 580):
        assert [r["id"] for r in lf.page(df, keys, offset, 30).collect()] == want[offset : offset + 30]


def test_page_of_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(ordering, "RANGE_ROWS", 10)
    df = spark.range(300).selectExpr("7 AS a", "'x' AS b")
    assert lf.page(df, [("a", "asc")], 250, 20).count() == 20 and lf.page(df, [("a", "asc")], 290, 20).count() == 10
    assert lf.page(df, [("a", "asc")], 0, 0).count() == 0


@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_dictionary_sorts_as_collation_does(spark, table, monkeypatch, direction):
    rng = random.Random(6)
    words = [None, "", "b", "B", "a10", "a9", "ä", "z", "Z2", "é", "e", "007", "7", " x"]
    t = table("w:string d:date n:number", [(rng.choice(words), rng.choice(["2024-01-02", "2023", None]), str(rng.randint(0, 3))) for _ in range(300)])
    keys = [("w", direction), ("d", "asc"), ("n", "desc")]
    quick = lf.multi_sort(t, keys)
    assert quick.columns == t.columns and "_place0" in plan_of(quick) and "_place1" in plan_of(quick)
    monkeypatch.setattr(ordering, "DICTIONARY", 0)
    slow = lf.multi_sort(t, keys)
    assert "_place0" not in plan_of(slow) and ids(quick) == ids(slow)


# --- cross tables --------------------------------------------------------------------------------


def test_crosstab_reads_a_file_once(spark, stored):
    df = stored(spark.range(2000).selectExpr("id % 30 AS r", "id % 4 AS c", "id AS m"))
    table = lf.crosstab(df, "r", "c", "avg", "m")
    assert "FileScan csv" not in plan_of(table)  # the pairs have been written
    assert table.filter("level = 'grand'").first()["value"] == pytest.approx(999.5)
    assert table.filter("row_others AND level = 'row_total'").count() == 1


# --- delimiters ----------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text,delimiter",
    [
        ("name;val;z\n" + "n1;1,5;k\n" * 300 + "r;1;2;3\n", ";"),  # decimal commas and one ragged line
        ("a,b,c,d\n" + "1,2,3\n" * 40 + "1|2,3\n", ","),  # a header with a cell too many
        ("only one column\n1,5\n2,5\n", ","),  # nothing cuts the header
        ("id|text\n" + "1|a, b, c\n2|x, y, z\n" * 20, "|"),
        (";;\n\nx;y;z\n1;2;3\n", ";"),  # separators only come first
        ('q;"a, b"\n1;"c, d, e"\n', ";"),
        ("a\tb,c\n1\t2,3\n4\t5,6\n", "\t"),  # both cut alike: the tab after the comma in order, so the comma's rank decides
    ],
)
def test_delimiter_by_the_header_and_the_modal_count(spark, tmp_path, text, delimiter):
    (tmp_path / "f.csv").write_text(text)
    found = lf.detect_delimiters(lf.lines_of(spark, str(tmp_path))).first()["delimiter"]
    assert found == delimiter or (text.startswith("a\tb,c") and found == ",")


def test_ragged_file_is_cut_right(spark, tmp_path):
    (tmp_path / "f.csv").write_text("name;val;z\n" + "n1;1,5;k\n" * 300 + "r;1;2;3\n")
    table = lf.read_delimited(spark, str(tmp_path / "f.csv"))
    assert [f.key for f in lf.fields_of(table)] == ["name", "val", "z"] and table.count() == 301


# --- streams -------------------------------------------------------------------------------------


def test_months_come_as_one_row_each(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    days = ["2023-12-31 23:59:59", "2024-02-01 00:00:00", "2024-02-29 12:00:00", "2024-02-29 13:00:00", "2024-03-01 00:30:00", "2024-03-05 00:00:00"]
    (folder / "a.log").write_text("".join(f"{d} INFO x\n" for d in days))
    count = lambda: {tuple(r) for r in spark.read.schema("name string, value long").parquet(str(tmp_path / "o")).collect()}

    def run():
        stream = lf.month_counts(lf.ingest_stream(spark, str(folder), "app", {"time": "date"}), "time", late="1 hour")
        lf.append_rows(stream, str(tmp_path / "o"), str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    run()
    assert count() == {("2023-12", 1), ("2024-02", 3)}
    (folder / "b.log").write_text("2024-03-31 08:00:00 INFO x\n2024-04-02 00:00:00 INFO y\n2024-02-20 00:00:00 INFO late\n")
    run()  # the open month was kept between the runs; a closed one does not come again
    assert count() == {("2023-12", 1), ("2024-02", 3), ("2024-03", 3)}


def test_stream_of_files_under_their_own_headers(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("id,Größe\n1,ü\n2,y\n")
    (folder / "b.csv").write_bytes("Größe;extra;id\nä;q;3\n".encode("cp1252"))
    (folder / "empty.csv").write_text("")

    def run():
        stream = lf.append_delimited(spark, str(folder), str(tmp_path / "o"), str(tmp_path / "c"), ["id", "Größe", "more"], {"id": "number"}, files_per_batch=2)
        stream.trigger(availableNow=True).start().awaitTermination()
        return sorted(rows(spark.read.parquet(str(tmp_path / "o")), "id", "gr_e", "more", "_file"))

    first = [(1.0, "ü", None, "a.csv"), (2.0, "y", None, "a.csv"), (3.0, "ä", None, "b.csv")]
    assert run() == first
    (folder / "c.csv").write_text("more\tid\nm\t4\n")
    assert run() == [*first, (4.0, None, "m", "c.csv")]


def test_a_batch_that_runs_again_leaves_its_rows_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("id\n1\n")
    for _ in range(2):  # with its checkpoint lost, the stream begins again with batch 0
        stream = lf.append_delimited(spark, str(tmp_path / "in"), str(tmp_path / "o"), str(tmp_path / f"c{_}"), ["id"])
        stream.trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "o")), "id") == [("1",)]
