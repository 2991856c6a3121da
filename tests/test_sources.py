import json

import pytest

import logframe as lf
from conftest import rows
from logframe.functions.patterns import PatternError

REQUESTS = b'''at,Level,Status Code,ms,cached,ip
2026-03-01T10:00:00,INFO,200,12,true,10.1.0.1
2026-03-01T10:00:05,WARN,404,,no,10.1.0.2
  	

2026-03-01T10:00:09,"ERR, ""bad""",5xx,1200,false,10.1.0.1
'''


@pytest.fixture
def put(tmp_path):
    def write(name: str, content: bytes) -> str:
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
        return str(path)

    return write


def read(spark, path, **options):
    df = lf.read_delimited(spark, path, **options)
    return df, rows(df.orderBy("_row_id"), *(f.key for f in lf.fields_of(df)))


def test_read_delimited(spark, put):
    df, got = read(spark, put("a.csv", REQUESTS))
    assert [(f.key, f.name, f.type) for f in lf.fields_of(df)] == [
        ("at", "at", "date"), ("level", "Level", "string"), ("status_code", "Status Code", "number"),
        ("ms", "ms", "number"), ("cached", "cached", "boolean"), ("ip", "ip", "string"),
    ]
    assert got[1] == ("2026-03-01T10:00:05", "WARN", "404", None, "no", "10.1.0.2")
    assert got[2][1:3] == ('ERR, "bad"', "5xx") and len(got) == 3
    assert rows(lf.coerce(df).orderBy("_row_id"), "cached") == [("true",), ("false",), ("false",)]
    assert rows(lf.to_typed(df).orderBy("_row_id"), "status_code", "ms") == [(200.0, 12.0), (404.0, None), (None, 1200.0)]


def test_line_ends_and_splits_do_not_matter(spark, put):
    path = put("a b+%20é.csv", REQUESTS.replace(b"\n", b"\r\n"))
    expected = read(spark, put("b/a.csv", REQUESTS))[1]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40")
    try:
        assert read(spark, path)[1] == expected
        assert read(spark, path, delimiter=",", encoding="utf-8", multi_line=False)[1] == expected
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("encoding,bom,detected", [("utf-8", b"", "utf-8"), ("utf-8", b"\xef\xbb\xbf", "utf-8"), ("utf-16-le", b"\xff\xfe", "utf-16le"),
                                                   ("utf-16-be", b"\xfe\xff", "utf-16be"), ("cp1252", b"", "windows-1252")])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_encodings(spark, put, encoding, bom, detected, end):
    text = end.join(["naïve;Größe €", "café;1", "Ÿ–;2", ""])
    path = put("e.csv", bom + text.encode(encoding))
    found = lf.detect_encodings(lf.lines_of(spark, path)).first()
    assert found["encoding"] == detected
    df, got = read(spark, path)
    assert got == [("café", "1"), ("Ÿ–", "2")]
    assert [f.name for f in lf.fields_of(df)] == ["naïve", "Größe €"] and [f.type for f in lf.fields_of(df)] == ["string", "number"]


def test_line_breaks_inside_quotes(spark, put):
    text = 'k,v\n1,"two\nlines, ""quoted"""\n2,x\n'
    assert read(spark, put("m.csv", text.encode()))[1] == [("1", 'two\nlines, "quoted"'), ("2", "x")]
    assert read(spark, put("u.csv", b"\xff\xfe" + text.encode("utf-16-le")))[1] == [("1", 'two\nlines, "quoted"'), ("2", "x")]


@pytest.mark.parametrize("text,delimiter", [("a,b\n1,2\n", ","), ("a\tb\n1\t2\n", "\t"), ("a|b|c\n1|2|3\n", "|"), ("a;b\n1,5;2\n3;4,7\n", ";"),
                                            ("single\nx\n", ","), ('a;b\n"1,2,3";4\n"1,2,3";4\n', ";"), ("\n\n a;b \n1;2", ";")])
def test_delimiters(spark, put, text, delimiter):
    path = put("d.txt", text.encode())
    assert lf.detect_delimiters(lf.lines_of(spark, path)).first()["delimiter"] == delimiter


def test_unlike_files_read_together(spark, put):
    a = put("x/a.csv", b"k,v\n1,a\n2,b\n")
    put("x/b.tsv", b"k\tw\n3\tc\n")
    put("x/c.json", b'{"k": 1}')
    df, got = read(spark, a.rsplit("/", 1)[0])
    assert sorted(got) == [("1", "a", None), ("2", "b", None), ("3", None, "c")]
    assert {r[0] for r in rows(df, "_file")} == {"a.csv", "b.tsv"}
    summary = {tuple(r) for r in rows(lf.dataset_summary(spark, a.rsplit("/", 1)[0]))}
    assert summary == {("a.csv", 12, 2, ",", "utf-8"), ("b.tsv", 8, 1, "\t", "utf-8")}
    same_name = [a, put("y/a.csv", b"k,v\n9,z\n")]
    assert sorted(r[2] for r in rows(lf.dataset_summary(spark, same_name))) == [1, 2]


def test_rejected_files(spark, put):
    with pytest.raises(lf.UnsupportedFile):
        lf.read_delimited(spark, put("x.json", b"{}"))
    with pytest.raises(lf.EmptyFile):
        lf.read_delimited(spark, put("e.csv", b""))
    with pytest.raises(lf.EmptyFile):
        lf.read_delimited(spark, put("f.csv", b"  \n\n"))


def test_ragged_records(spark, put):
    path = put("r.csv", b'a,b,c\n1,2\n1,2,3,4\n5,6,7\n8,9,"open\n')
    df = lf.read_delimited(spark, path, keep_bad=True, infer=False)
    assert rows(df.orderBy("_row_id"), "a", "b", "c")[:3] == [("1", "2", None), ("1", "2", "3"), ("5", "6", "7")]
    bad = [(r["code"], r["record"]) for r in lf.malformed_records(df).orderBy("row").collect()]
    assert bad[:2] == [("TooFewFields", "1,2"), ("TooManyFields", "1,2,3,4")]


@pytest.mark.parametrize("headers,keys", [
    (["Status Code"], ["status_code"]), (["id", "id", "id"], ["id", "id_2", "id_3"]), (["", "   ", None], ["column_1", "column_2", "column_3"]),
    (["a..b--c"], ["a_b_c"]), (["﻿x", "É!"], ["x", "column_2"]), (["a", "a_2", "a"], ["a", "a_2", "a_3"]),
])
def test_column_keys(headers, keys):
    assert [k for _, k in lf.column_keys(headers)] == keys


def test_load_many(spark, put):
    paths = [put("x/a.csv", b"k,v\n1,a\n"), put("y/a.csv", b"k;w\n2;b\n")]
    tables = lf.load_many(spark, paths)
    assert list(tables) == ["a.csv", "a.csv (2)"]
    stacked = lf.stack_tables(tables)
    assert sorted(rows(stacked, "_file", "k", "v", "w"), key=lambda r: r[0]) == [("a.csv", "1", "a", None), ("a.csv (2)", "2", None, "b")]


# --- types ----------------------------------------------------------------------------------


def test_votes(table):
    t = table("a:string b:string c:string d:string e:string", [("1", "x", "true", "2026-01-01", None), ("x", "2", "3", "2026-01-02T10:00", " "), (None, "3", "no", "x", "")])
    got = {r["key"]: (r["string"], r["number"], r["boolean"], r["date"], r["type"]) for r in lf.type_votes(t).collect()}
    assert got == {"a": (1, 1, 0, 0, "string"), "b": (1, 2, 0, 0, "number"), "c": (0, 1, 2, 0, "boolean"), "d": (1, 0, 0, 2, "date"), "e": (0, 0, 0, 0, "string")}


def test_every_row_votes_unless_a_sample_is_named(table):
    t = table("a:string", [("1",)] * 50 + [("x",)] * 200).coalesce(1)
    assert lf.field_of(lf.infer_types(t, sample=50), "a").type == "number"
    assert lf.field_of(lf.infer_types(t), "a").type == "string"


def test_retype(table):
    t = table("code:string flag:string", [("200", "true"), ("404", "YES"), ("", "x")])
    typed = lf.retype(t, {"code": "number", "flag": "boolean", "gone": "date"})
    assert lf.signature(typed) == "code:number|flag:boolean"
    assert rows(lf.to_typed(typed), "code", "flag") == [(200.0, True), (404.0, True), (None, None)]
    back = lf.retype(typed, {"code": "string", "flag": "string"})
    assert rows(back, "code", "flag") == [("200", "true"), ("404", "true"), (None, "x")]
    assert lf.retype(t, {"code": "string"}).schema == t.schema
    native = lf.retype(lf.to_typed(typed), {"code": "string"})
    assert lf.signature(native) == "code:string|flag:boolean" and rows(native, "code")[0] == ("200",)
    with pytest.raises(ValueError):
        lf.retype(t, {"code": "decimal"})


# --- logs -----------------------------------------------------------------------------------

ACCESS = b'''10.9.0.1 - - [01/Mar/2026:10:00:00 +0000] "GET /a HTTP/1.1" 200 12 "-" "UA/1"\r
\r
no access line\r
10.9.0.2 - bob [01/Mar/2026:10:00:07 +0000] "POST /b HTTP/1.1" 503 -
'''


def test_access_log(spark, put):
    lines = lf.read_lines(spark, put("x.log", ACCESS))
    got = lf.infer_types(lf.parse_log(lines, "access"))
    assert rows(got, "ip", "request", "status", "bytes", "referer", "agent") == [
        ("10.9.0.1", "GET /a HTTP/1.1", "200", "12", "-", "UA/1"),
        ("10.9.0.2", "POST /b HTTP/1.1", "503", "-", None, None),
    ]
    assert lf.field_of(got, "status").type == "number"
    assert rows(lf.parse_log_report(lines, "access")) == [(2, 1)]
    assert rows(lf.parse_log_report(lines, r"(?<x>zzz)")) == [(0, 3)]
    assert lf.parse_log(lines, "access", require_match=True).count() == 2
    with pytest.raises(lf.NoMatch):
        lf.parse_log(lines, r"(?<x>zzz)", require_match=True)


def test_other_templates(spark):
    lines = spark.createDataFrame([("Feb  3 04:05:06 mill7 cron[88]: nightly tidy: 3 files",), ("2025-12-24T18:00:01,250 NOTICE   bells rang twice",)], "value string")
    assert rows(lf.parse_log(lines, "syslog")) == [("Feb  3 04:05:06", "mill7", "cron[88]", "nightly tidy: 3 files")]
    assert rows(lf.parse_log(lines, "app")) == [("2025-12-24T18:00:01,250", "NOTICE", "bells rang twice")]
    assert set(lf.TEMPLATES) == {"access", "syslog", "app"} and len(lf.SNIPPETS) == 6


def test_log_patterns(spark):
    lines = spark.createDataFrame([("zz a=1 B=2 zz",), ("x",), ("",)], "value string")
    marked = spark.createDataFrame([("k=a\u001fb|c",), ("k=d|\r",)], "value string")
    assert rows(lf.parse_log(marked, r"(?<k>[^=]+)=(?<v>[^|]*)\|(?<w>.*)")) == [("k", "a\u001fb", "c"), ("k", "d", None)]
    pattern = r"(\w)=(?<the_first>\d) (?:b)=(?<second>\d)"
    assert rows(lf.parse_log(lines, pattern, "ig")) == [("1", "2")]
    assert rows(lf.parse_log(lines, pattern)) == []
    for bad in (r"^\d+;(\w+)$", "(?<day>[0-9"):
        with pytest.raises(PatternError):
            lf.parse_log(lines, bad)


@pytest.mark.parametrize("encoding,bom", [("utf-16-le", b"\xff\xfe"), ("utf-16-be", b"\xfe\xff"), ("cp1252", b""), ("utf-8", b"\xef\xbb\xbf")])
def test_decoded_lines(spark, put, encoding, bom):
    path = put("l.log", bom + 'é "quoted", €\r\nsecond\r\n'.encode(encoding))
    assert rows(lf.read_lines(spark, path).orderBy("_row_id"), "value") == [('é "quoted", €',), ("second",)]


# --- exports --------------------------------------------------------------------------------


def text_of(path):
    return "".join(p.read_text() for p in sorted(path.glob("part-*")))


def test_exports(spark, put, tmp_path):
    df, _ = read(spark, put("a.csv", REQUESTS))
    view = lf.select_view(lf.multi_sort(df, [("ms", "desc")]), [{"key": k, "visible": True} for k in ("level", "status_code", "ms", "cached")])
    lf.write_csv(view, str(tmp_path / "c"))
    assert text_of(tmp_path / "c") == 'Level,Status Code,ms,cached\n"ERR, ""bad""",5xx,1200,false\nINFO,200,12,true\nWARN,404,,false\n'
    lf.write_json(view, str(tmp_path / "j"))
    got = [json.loads(line) for line in text_of(tmp_path / "j").splitlines()]
    assert got[0] == {"Level": 'ERR, "bad"', "Status Code": "5xx", "ms": 1200, "cached": False}
    assert got[2] == {"Level": "WARN", "Status Code": 404, "ms": None, "cached": False}


def test_redacted_export(spark, put, tmp_path):
    df, _ = read(spark, put("a.csv", REQUESTS))
    lf.write_csv(df, str(tmp_path / "c"), redact_classes=None, redact_mode="consistent")
    text = text_of(tmp_path / "c")
    assert "10.1." not in text and text.count("[IP_1]") == 2 and text.count("[IP_2]") == 1


def test_clashing_headers_fall_back_to_keys(spark, put, tmp_path):
    df, _ = read(spark, put("h.csv", b"a,A\n1,2\n"))
    lf.write_json(df, str(tmp_path / "j"))
    assert json.loads(text_of(tmp_path / "j")) == {"a": 1, "a_2": 2}
    lf.write_csv(df, str(tmp_path / "c"))
    assert text_of(tmp_path / "c").startswith("a,A\n")


# --- several files --------------------------------------------------------------------------


def test_every_file_has_its_own_header(spark, put):
    folder = put("u/a.csv", b"id,name\n1,kim\n").rsplit("/", 1)[0]
    put("u/b.csv", b"name,id\nzed,9\n")
    put("u/c.csv", b"id,name,extra\n3,ola,x\n")
    put("u/d.csv", b"\n")
    df, got = read(spark, folder)
    assert got == [("1", "kim", None), ("9", "zed", None), ("3", "ola", "x")]
    given, same = read(spark, folder, delimiter=",", encoding="utf-8", multi_line=False)
    assert same == got


def test_separator_only_lines_before_the_header(spark, put):
    path = put("s.csv", b",,\n\n , ,\nid,name,x\n1,a,\nid,name,x\n2,b,c\n")
    df, got = read(spark, path)
    assert [f.name for f in lf.fields_of(df)] == ["id", "name", "x"]
    assert got == [("1", "a", None), ("id", "name", "x"), ("2", "b", "c")]


def test_header_with_a_line_break(spark, put):
    df, got = read(spark, put("h.csv", b'"a\nb",c\n1,"x\ny"\n'))
    assert [f.name for f in lf.fields_of(df)] == ["a\nb", "c"] and got == [("1", "x\ny")]


def test_rows_keep_the_order_of_the_files_given(spark, put):
    small = put("o/z_small.csv", b"k\ns1\ns2\n")
    large = put("o/a_large.csv", b"k\n" + b"".join(b"l%04d\n" % i for i in range(2000)))
    expected = ["s1", "s2"] + [f"l{i:04d}" for i in range(2000)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in (old, "700"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            df = lf.read_delimited(spark, [small, large])
            assert [r["k"] for r in df.orderBy("_row_id").collect()] == expected
            assert df.select("_row_id").distinct().count() == 2002
            for encoding in (None, "utf-8"):
                lines = lf.read_lines(spark, [small, large], encoding)
                assert [r["value"] for r in lines.orderBy("_row_id").collect()] == ["k", "s1", "s2", "k", *expected[2:]]
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_a_quote_inside_a_cell_spans_no_lines(spark, put):
    path = put("q.csv", b'item,n\n5" pipe,1\n"6"" pipe",2\n')
    assert not lf.profile_files(spark, path)[0].multi_line
    assert lf.profile_files(spark, put("r.csv", b'item,n\n"two\nlines",2\n'))[0].multi_line


def test_all_lines_decide_on_the_delimiter(spark, put):
    text = "a;b\n" + "1;2,3\n" * 12 + "1;2\n" * 400
    assert lf.profile_files(spark, put("v.csv", text.encode()))[0].delimiter == ";"


def test_blank_cells_of_bad_records_count(spark, put):
    df = lf.read_delimited(spark, put("w.csv", b'a,b,c\n1,,3,4\n"x,y",2\n1,2,3\n'), keep_bad=True, infer=False)
    assert [r["code"] for r in lf.malformed_records(df).orderBy("row").collect()] == ["TooManyFields", "TooFewFields"]
