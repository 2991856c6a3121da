import json

import pytest

import logframe as lf
from conftest import rows

ROWS = [("2026-01-05T10:00:00", "INFO", "5"), ("2026-01-06T11:00:00", "ERROR", "70"), ("2026-01-12T12:00:00", "ERROR", "90"), (None, "WARN", "80")]


def test_view(table):
    t = table("at:date level:string ms:number", ROWS)
    spec = {
        "groups": [{"id": "1", "filters": [{"columnKey": "ms", "operator": "gt", "value": "50"}]}, {"id": "2", "filters": "broken"}],
        "query": "e",
        "sort": [{"columnKey": "ms", "direction": "desc"}, {"columnKey": "ms", "direction": "sideways"}],
        "columns": [{"key": "ms", "visible": True}, {"key": "level", "visible": False}],
        "chart": {"type": "line", "dimensionKey": "at", "aggregation": "count", "bucket": "week", "measureKey": None},
        "pivot": {"rowKey": "level", "colKey": "ms", "aggregation": "sum", "measureKey": "ms", "colBucket": True},
    }
    view = lf.apply_view(t, json.dumps(spec))
    assert view.table.columns == ["ms", "at"] and rows(view.table, "ms") == [("90",), ("70",)]
    assert rows(view.chart) == [("2026-01-05", 1), ("2026-01-12", 1)]
    assert view.pivot.filter("level = 'grand'").first()["value"] == 160


def test_older_and_partial_views(table):
    t = table("at:date level:string ms:number", ROWS)
    old = {"filters": [{"columnKey": "level", "operator": "equals", "value": "error"}, {"bad": 1}], "sort": {"columnKey": "ms", "direction": "asc"}}
    view = lf.apply_view(t, old)
    assert rows(view.table, "ms") == [("70",), ("90",)] and view.chart is None and view.pivot is None
    assert lf.apply_view(t, {}).table.count() == 4
    regex = lf.apply_view(t, {"groups": [], "query": "^(warn|info)$", "searchRegex": True})
    assert regex.table.count() == 2
    assert lf.apply_view(t, {"pivot": {"rowKey": "level", "colKey": "ms", "aggregation": "max"}}).pivot is None
    fits = lf.apply_to_all({"a": t, "b": t.select("level")}, old, lf.signature(t))
    assert list(fits) == ["a"]


LINES = ["2026-01-05 10:00:00 INFO started", "2026-01-05 23:59:59 WARN slow", "junk", "2026-01-07 00:00:00 INFO done", "2026-01-13 08:00:00 ERROR failed"]


@pytest.fixture
def log_folder(tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    for i, line in enumerate(LINES):
        (folder / f"{i}.log").write_text(line + "\n")
    (folder / "other.json").write_text("{}")
    return str(folder)


def test_stream_to_table(spark, log_folder, tmp_path):
    stream = lf.ingest_stream(spark, log_folder, "app", {"time": "date"}, files_per_batch=2)
    lf.append_rows(stream, str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    batch = lf.to_typed(lf.with_types(lf.parse_log(lf.read_lines(spark, log_folder), "app"), {"time": "date"}))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(rows(got, "time", "level", "message")) == sorted(rows(batch, "time", "level", "message")) and got.count() == 4


@pytest.mark.parametrize("bucket", ["hour", "day", "week"])
def test_stream_buckets_equal_batch(spark, log_folder, bucket):
    name = f"buckets_{bucket}"
    stream = lf.ingest_stream(spark, log_folder, "app", {"time": "date"})
    counts = lf.bucket_counts(stream, "time", bucket)
    counts.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    batch = lf.group_aggregate(lf.with_types(lf.parse_log(lf.read_lines(spark, log_folder), "app"), {"time": "date"}), "time", bucket=bucket)
    assert dict(rows(spark.table(name))) == dict(rows(batch))


def test_closed_buckets_are_emitted_once(spark, log_folder, tmp_path):
    stream = lf.ingest_stream(spark, log_folder, "app", {"time": "date"})
    out, ck = str(tmp_path / "o"), str(tmp_path / "c")
    writer = lf.bucket_counts(stream, "time", "day", late="1 hour").writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert dict(rows(spark.read.parquet(out))) == {"2026-01-05": 2, "2026-01-07": 1}


def test_stream_options(spark, log_folder):
    stream = lf.ingest_stream(spark, log_folder, "app", {"time": "date"})
    for time, bucket in (("gone", "day"), ("time", "year")):
        with pytest.raises(ValueError):
            lf.bucket_counts(stream, time, bucket)


def test_csv_keeps_blanks_around_cells(spark, table, tmp_path):
    lf.write_csv(table("a:string b:string", [("  lead", "trail  "), ('q"u', "two\nlines")]), f"{tmp_path}/out", redact_classes=None)
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert "  lead,trail  " in text and '"q""u"' in text


def test_months_of_a_stream_add_up(spark, log_folder, tmp_path):
    stream = lf.ingest_stream(spark, log_folder, "app", {"time": "date"})
    counts = lf.bucket_counts(stream, "time", "month", late="1 hour")
    lf.append_rows(counts, str(tmp_path / "o"), str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "o")).groupBy("name").sum("value")) == [("2026-01", 3)]


def test_delimited_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_bytes('Größe;ort\n5;"Köln; €"\n;\n7;\n'.encode("cp1252"))
    (tmp_path / "in" / "b.txt").write_bytes("Größe;ort\n9;x\n".encode("cp1252"))
    stream = lf.ingest_delimited_stream(spark, str(tmp_path / "in"), ["Größe", "ort"], {"gr_e": "number"}, ";", "windows-1252", files_per_batch=1)
    assert [(f.key, f.name, f.type) for f in lf.fields_of(stream)] == [("gr_e", "Größe", "number"), ("ort", "ort", "string")]
    lf.append_rows(stream, str(tmp_path / "o"), str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(rows(spark.read.parquet(str(tmp_path / "o")))) == [(5.0, "Köln; €"), (7.0, None), (9.0, "x")]
