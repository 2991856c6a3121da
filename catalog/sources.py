"""Files written from the tables and read back, log lines and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

import logframe as lf
from catalog.registry import query
from catalog.tables import ACCESS_SQL, access_lines


def _written(df: DataFrame, path: str, **options) -> str:
    df.write.options(header=True, escape='"', **options).csv(path)
    return path


@query(
    "A1_read_delimited",
    """SELECT cast(doc_id AS double) AS doc_id, nullif(text, '') AS text, lang, nullif(source, 'src1') AS the_source FROM documents""",
)
def read_delimited(t):
    # Texts hold line breaks and quotes, so records span lines; one header is no valid key.
    docs = t.documents.select("doc_id", "text", "lang", F.nullif("source", F.lit("src1")).alias(" The Source!"))
    table = lf.read_delimited(t.spark, _written(docs, lf.scratch_dir(t.spark)))
    return lf.to_typed(table).drop("_row_id", "_file")


_DELIMITED = {"nation": ",", "region": ";", "supplier": "|", "customer": "\t"}


def _four_files(t) -> str:
    root = lf.scratch_dir(t.spark)
    for name, sep in _DELIMITED.items():
        _written(getattr(t, name), f"{root}/{name}", sep=sep)
    return f"{root}/*"


@query(
    "A2_detect_delimiter",
    "SELECT * FROM (VALUES ('nation', ','), ('region', ';'), ('supplier', '|'), ('customer', chr(9))) AS d(folder, delimiter)",
)
def detect_delimiter(t):
    found = lf.detect_delimiters(lf.lines_of(t.spark, _four_files(t)))
    folder = F.regexp_extract("file", "/([^/]+)/[^/]+$", 1)
    return found.select(folder.alias("folder"), "delimiter").distinct()


@query(
    "A3_decode_files",
    """SELECT conv_id, turn, replace(role || ' ' || text, chr(10), ' ') AS value FROM conversations""",
)
def decode_files(t):
    # The same table once in UTF-16 with a byte-order mark, once in Latin-1 where that can hold it.
    flat = t.conversations.select(
        "conv_id", "turn", F.concat_ws(" ", "role", F.replace(F.col("text"), F.lit("\n"), F.lit(" "))).alias("value")
    )
    latin = F.col("value").rlike(r"^[\x00-\x7f\xa0-\xff]*$")
    wide = lf.read_delimited(t.spark, _written(flat.filter(~latin), lf.scratch_dir(t.spark), encoding="UTF-16"), infer=False)
    narrow = lf.read_delimited(t.spark, _written(flat.filter(latin), lf.scratch_dir(t.spark), encoding="ISO-8859-1"), infer=False)
    both = narrow.unionByName(wide)
    return both.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "value")


@query(
    "A7_parse_log",
    f"WITH {ACCESS_SQL} SELECT event_id, ip, time, request, status, bytes, referer, agent FROM parsed",
)
def parse_log(t):
    return lf.parse_log(access_lines(t), "access")


@query(
    "A7_parse_log_typed",
    f"WITH {ACCESS_SQL} SELECT event_id, cast(status AS double) AS status, cast(bytes AS double) AS bytes, request FROM parsed WHERE status = '500'",
)
def parse_log_typed(t):
    rows = lf.with_types(lf.parse_log(access_lines(t), "access"), {"status": "number", "bytes": "number"})
    return lf.to_typed(lf.filter_all(rows, [("status", "gte", "500")])).select("event_id", "status", "bytes", "request")


@query(
    "A8_log_templates",
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time, upper(event_type) AS level, 'user ' || cast(user_id AS varchar) AS message, 'app' AS template FROM events
    UNION ALL SELECT event_id, strftime(ts, '%b ') || strftime(ts, '%d %H:%M:%S'), 'host' || cast(user_id AS varchar), event_type, 'syslog' FROM events""",
)
def log_templates(t):
    e = t.events
    user = F.col("user_id").cast("string")
    app = e.select("event_id", F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.upper("event_type"), F.lit("user"), user).alias("value"))
    sys = e.select(
        "event_id",
        F.concat(F.date_format("ts", "MMM dd HH:mm:ss"), F.lit(" host"), user, F.lit(" svc[1]: "), F.col("event_type")).alias("value"),
    )
    parsed = lf.parse_log(sys, "syslog").select("event_id", "time", F.col("host").alias("level"), "message")
    return (
        lf.parse_log(app, "app").withColumn("template", F.lit("app"))
        .unionByName(parsed.withColumn("template", F.lit("syslog")))
    )


@query(
    "A9_parse_log_report",
    """SELECT cast(count(*) FILTER (event_type <> 'signup') AS bigint) AS matched, cast(count(*) FILTER (event_type = 'signup') AS bigint) AS unmatched FROM events""",
)
def parse_log_report(t):
    return lf.parse_log_report(access_lines(t), "access")


@query("A10_dataset_summary", "SELECT ',' AS delimiter, 'utf-8' AS encoding, cast(count(*) AS bigint) AS row_count, 3 AS files FROM orders")
def dataset_summary(t):
    path = _written(t.orders.repartition(3), lf.scratch_dir(t.spark))
    per_file = lf.dataset_summary(t.spark, path)
    return per_file.groupBy("delimiter", "encoding").agg(
        F.sum("row_count").alias("row_count"), F.count("*").cast("int").alias("files")
    )


@query(
    "A11_malformed_records",
    """SELECT CASE event_type WHEN 'view' THEN 'TooFewFields' ELSE 'TooManyFields' END AS code, cast(count(*) AS bigint) AS n
    FROM events WHERE event_type IN ('view', 'click') GROUP BY 1""",
)
def malformed_records(t):
    e = t.events
    cells = F.concat_ws(",", F.col("event_id").cast("string"), "event_type")
    body = e.select(
        F.when(F.col("event_type") == "view", cells)
        .when(F.col("event_type") == "click", F.concat(cells, F.lit(",1,2")))
        .otherwise(F.concat(cells, F.lit(",1")))
        .alias("value")
    )
    # A header line on top of every file.
    path = lf.scratch_dir(t.spark)
    body.select(F.split("value", ",", 2).alias("p")).select(
        F.get("p", F.lit(0)).alias("id"), F.get("p", F.lit(1)).alias("kind,n")
    ).write.options(header=True, quote="").csv(path)
    table = lf.read_delimited(t.spark, path, keep_bad=True, infer=False)
    return lf.malformed_records(table).groupBy("code").agg(F.count("*").alias("n"))


@query(
    "A12_load_many",
    """SELECT 'people' AS _file, cast(c_custkey AS varchar) AS id, c_name AS name, c_mktsegment FROM customer
    UNION ALL SELECT 'people (2)', cast(s_suppkey AS varchar), s_name, NULL FROM supplier""",
)
def load_many(t):
    root = lf.scratch_dir(t.spark)
    _written(t.customer.selectExpr("c_custkey AS id", "c_name AS name", "c_mktsegment"), f"{root}/x/people")
    _written(t.supplier.selectExpr("s_suppkey AS id", "s_name AS name"), f"{root}/y/people", sep=";")
    tables = lf.load_many(t.spark, [f"{root}/x/people", f"{root}/y/people"])
    return lf.stack_tables(tables)


def _log_folder(t) -> str:
    path = lf.scratch_dir(t.spark)
    access_lines(t).select("value").write.option("lineSep", "\n").text(path)
    return path


def _streamed(t, stream_rows: DataFrame) -> DataFrame:
    path = lf.scratch_dir(t.spark)
    lf.append_rows(stream_rows, path, lf.scratch_dir(t.spark)).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(path)


@query(
    "A14_ingest_stream",
    f"WITH {ACCESS_SQL} SELECT ip, request, cast(status AS double) AS status, cast(bytes AS double) AS bytes, agent FROM parsed",
)
def ingest_stream(t):
    rows = lf.ingest_stream(t.spark, _log_folder(t), "access", {"status": "number", "bytes": "number"})
    return _streamed(t, rows).select("ip", "request", "status", "bytes", "agent")


@query(
    "A14_bucket_counts",
    """WITH seen AS (SELECT date_trunc('second', ts) AS ts FROM events WHERE event_type <> 'signup')
    SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS name, cast(count(*) AS bigint) AS value FROM seen GROUP BY date_trunc('day', ts)
    HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM seen) - INTERVAL 1 HOUR""",
)
def bucket_counts(t):
    # Append mode: only days that the watermark has closed come out.
    rows = lf.ingest_stream(t.spark, _log_folder(t), "access", {"time": "date"})
    return _streamed(t, lf.bucket_counts(rows, "time", "day", late="1 hour"))


@query(
    "A14_bucket_counts_month",
    """WITH seen AS (SELECT date_trunc('second', ts) AS ts FROM events WHERE event_type <> 'signup')
    SELECT strftime(ts, '%Y-%m') AS name, cast(count(*) AS bigint) AS value FROM seen
    WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM seen) - INTERVAL 1 HOUR GROUP BY 1""",
)
def bucket_counts_month(t):
    rows = lf.ingest_stream(t.spark, _log_folder(t), "access", {"time": "date"})
    days = _streamed(t, lf.bucket_counts(rows, "time", "month", late="1 hour"))
    return days.groupBy("name").agg(F.sum("value").alias("value"))


@query(
    "A14_month_counts",
    """SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m') AS name, cast(count(*) AS bigint) AS value FROM orders GROUP BY date_trunc('month', o_orderdate)
    HAVING date_trunc('month', o_orderdate) + INTERVAL 1 MONTH <= (SELECT max(o_orderdate) FROM orders) - INTERVAL 1 HOUR""",
)
def month_counts(t):
    # One row for each month that the watermark has passed.
    path = lf.scratch_dir(t.spark)
    t.orders.select(F.concat_ws(" ", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit("INFO order"), "o_orderkey")).write.text(path)
    return _streamed(t, lf.month_counts(lf.ingest_stream(t.spark, path, "app", {"time": "date"}), "time", late="1 hour"))


@query(
    "A14_stream_unlike_headers",
    """SELECT cast(c_custkey AS double) AS id, c_name AS name, c_acctbal AS balance FROM customer
    UNION ALL SELECT cast(s_suppkey AS double), s_name || ' é', s_acctbal FROM supplier
    UNION ALL SELECT cast(n_nationkey AS double), n_name, NULL FROM nation""",
)
def stream_unlike_headers(t):
    # Files of three kinds arrive in one folder: other delimiters, encodings, column orders, a column missing, one too many.
    folder, path = lf.scratch_dir(t.spark), lf.scratch_dir(t.spark)
    _written(t.customer.selectExpr("c_custkey AS Id", "c_name AS Name", "c_acctbal AS Balance"), f"{folder}/a")
    named = t.supplier.select(F.col("s_acctbal").alias("Balance"), F.concat("s_name", F.lit(" é")).alias("Name"), F.col("s_suppkey").alias("Id"))
    _written(named, f"{folder}/b", sep=";", encoding="ISO-8859-1")
    _written(t.nation.selectExpr("n_regionkey AS region", "n_name AS name", "n_nationkey AS id"), f"{folder}/c", sep="\t")
    types = {"id": "number", "balance": "number"}
    stream = lf.append_delimited(t.spark, f"{folder}/*", path, lf.scratch_dir(t.spark), ["Id", "Name", "Balance"], types, files_per_batch=2)
    stream.trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(path).select("id", "name", "balance")


@query("A14_stream_delimited", "SELECT cast(event_id AS double) AS id, event_type AS kind, value AS amount FROM events")
def stream_delimited(t):
    path = _written(t.events.selectExpr("event_id AS ID", "event_type AS Kind", "value AS Amount"), lf.scratch_dir(t.spark), sep="|")
    types = {"id": "number", "amount": "number"}
    return _streamed(t, lf.ingest_delimited_stream(t.spark, path, ["ID", "Kind", "Amount"], types, "|", files_per_batch=2))


@query(
    "A14_stream_windows_1252",
    """SELECT cast(event_id AS varchar) AS id, 'café ' || cast(user_id AS varchar) || ' €' AS note FROM events""",
)
def stream_windows_1252(t):
    note = F.concat_ws(" ", F.lit("id"), "event_id", F.lit("café"), "user_id", F.lit("\x80"))  # the byte of the euro sign
    path = lf.scratch_dir(t.spark)
    t.events.select(note.alias("line")).write.options(encoding="ISO-8859-1").csv(path)
    return _streamed(t, lf.ingest_stream(t.spark, path, r"^id (?<id>\d+) (?<note>.*)$", encoding="windows-1252"))


# --- several files that differ ---------------------------------------------------------------


@query(
    "A1_unlike_headers",
    """SELECT cast(c_custkey AS varchar) AS id, c_name AS name, NULL AS nation, c_mktsegment AS segment FROM customer
    UNION ALL SELECT cast(s_suppkey AS varchar), s_name, cast(s_nationkey AS varchar), NULL FROM supplier""",
)
def unlike_headers(t):
    root = lf.scratch_dir(t.spark)
    _written(t.customer.selectExpr("c_custkey AS id", "c_name AS name", "c_mktsegment AS segment"), f"{root}/a")
    _written(t.supplier.selectExpr("s_nationkey AS nation", "s_name AS name", "s_suppkey AS id"), f"{root}/b")
    return lf.read_delimited(t.spark, f"{root}/*", infer=False).select("id", "name", "nation", "segment")


@query("A1_blank_first_line", "SELECT cast(event_id AS varchar) AS id, event_type AS kind, cast(user_id AS varchar) AS who FROM events")
def blank_first_line(t):
    # Every file begins with a line of separators only; its header comes after that.
    line = F.concat_ws(",", "event_id", "event_type", "user_id")
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    path = lf.scratch_dir(t.spark)
    t.events.repartition(3, "user_id").select(F.when(first, F.concat(F.lit(",,\nid,kind,who\n"), line)).otherwise(line).alias("value")).write.text(path)
    return lf.read_delimited(t.spark, path, infer=False).drop("_row_id", "_file")


@query(
    "A2_detect_delimiter_many",
    "SELECT * FROM (VALUES ('few', '|', cast(3 AS bigint)), ('many', ';', cast(70 AS bigint))) AS d(folder, delimiter, files)",
)
def detect_delimiter_many(t):
    # Amounts with a decimal comma; the last lines of a file count as much as the first.
    root = lf.scratch_dir(t.spark)
    amount = F.translate(F.col("o_totalprice").cast("string"), ".", ",").alias("amount")
    for folder, n, sep in (("few", 3, "|"), ("many", 70, ";")):
        _written(t.orders.repartition(n).select("o_orderkey", amount, "o_orderstatus"), f"{root}/{folder}", sep=sep, quote="")
    found = lf.detect_delimiters(lf.lines_of(t.spark, f"{root}/*"))
    folder = F.regexp_extract("file", "/([^/]+)/[^/]+$", 1)
    return found.groupBy(folder.alias("folder"), "delimiter").agg(F.count("*").alias("files"))


@query(
    "A2_ragged_decimal_commas",
    "SELECT ';' AS delimiter, cast(count(*) AS bigint) AS row_count FROM orders",
)
def ragged_decimal_commas(t):
    # Every line has one comma more than separators would need, and one line of a file is ragged.
    amount = F.translate(F.col("o_totalprice").cast("string"), ".", ",")
    cells = [F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 997 == 5, F.concat(amount, F.lit(";;"))).otherwise(amount), F.col("o_orderstatus")]
    path = lf.scratch_dir(t.spark)
    t.orders.select(F.concat_ws(";", *cells).alias("order;amount;status")).write.options(header=True, quote="").csv(path)
    per_file = lf.dataset_summary(t.spark, path)
    return per_file.groupBy("delimiter").agg(F.sum("row_count").alias("row_count"))


@query(
    "A5_infer_types_default",
    """SELECT 'id' AS key, 'number' AS type, cast(count(*) AS bigint) AS number, cast(0 AS bigint) AS string FROM events
    UNION ALL SELECT 'v', 'string', count(*) FILTER (event_id < 60), count(*) FILTER (event_id >= 60) FROM events""",
)
def infer_types_default(t):
    v = F.when(F.col("event_id") < 60, F.col("event_id").cast("string")).otherwise(F.col("event_type"))
    table = lf.read_delimited(t.spark, _written(t.events.select(F.col("event_id").alias("id"), v.alias("v")), lf.scratch_dir(t.spark)))
    votes = lf.type_votes(table).select("key", "number", "string")
    types = t.spark.createDataFrame([(f.key, f.type) for f in lf.fields_of(table)], "key string, type string")
    return votes.join(types, "key")


@query(
    "O1_file_order",
    """SELECT k, name, row_number() OVER (ORDER BY part, k) - 1 AS position FROM (
    SELECT 0 AS part, cast(r_regionkey AS double) AS k, r_name AS name FROM region
    UNION ALL SELECT 1, cast(c_custkey AS double), c_name FROM customer)""",
)
def file_order(t):
    # A small file before large ones; Spark packs the largest splits first.
    root = lf.scratch_dir(t.spark)
    _written(t.region.selectExpr("r_regionkey AS k", "r_name AS name").orderBy("k").coalesce(1), f"{root}/z")
    _written(t.customer.selectExpr("c_custkey AS k", "c_name AS name").repartitionByRange(3, "k").sortWithinPartitions("k"), f"{root}/a")
    table = lf.to_typed(lf.read_delimited(t.spark, [f"{root}/z", f"{root}/a"]))
    return lf.with_position(table, [(F.col("_row_id"), "asc")]).select("k", "name", "position")
