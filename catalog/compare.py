"""Tables side by side and their differences."""

from __future__ import annotations

from pyspark.sql import functions as F

import logframe as lf
from catalog.registry import query

# Two editions of the orders: the later one numbers every order 100 higher.
_EDITIONS = """a AS (SELECT o_orderkey AS key, o_orderstatus AS status, o_orderpriority AS priority FROM orders),
  b AS (SELECT o_orderkey + 100 AS key, o_orderstatus AS status, o_orderpriority AS priority FROM orders)"""


def editions(t):
    a = t.orders.select(
        F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")
    )
    b = a.withColumn("key", F.col("key") + 100)
    return lf.with_row_id(a, "key"), lf.with_row_id(b, "key")


_DIFF = f"""WITH {_EDITIONS}, diff AS (
  SELECT coalesce(a.key, b.key) AS key,
         CASE WHEN b.key IS NULL THEN 'removed' WHEN a.key IS NULL THEN 'added'
              WHEN a.status <> b.status OR a.priority <> b.priority THEN 'changed' ELSE 'unchanged' END AS state,
         a.status AS s1, b.status AS s2, a.priority AS p1, b.priority AS p2
  FROM a FULL OUTER JOIN b ON a.key = b.key)"""


@query(
    "C1_align_tables",
    """SELECT 'part' AS _file, p_partkey AS key, p_retailprice AS amount FROM part
    UNION ALL SELECT 'customer', c_custkey, c_acctbal FROM customer""",
)
def align_tables(t):
    part = t.part.withColumnsRenamed({"p_partkey": "key", "p_retailprice": "amount"})
    customer = t.customer.withColumnsRenamed({"c_custkey": "key", "c_acctbal": "amount"})
    return lf.align_tables({"part": part, "customer": customer})


@query(
    "C3_overlay",
    """SELECT name, round(coalesce(avg(v) FILTER (f = 0), 0), 4) AS customers, round(coalesce(avg(v) FILTER (f = 1), 0), 4) AS suppliers
    FROM (SELECT cast(c_nationkey AS varchar) AS name, c_acctbal AS v, 0 AS f FROM customer
          UNION ALL SELECT cast(s_nationkey AS varchar), s_acctbal, 1 FROM supplier) GROUP BY name""",
)
def overlay(t):
    customers = t.customer.withColumnsRenamed({"c_nationkey": "nation", "c_acctbal": "balance"})
    suppliers = t.supplier.withColumnsRenamed({"s_nationkey": "nation", "s_acctbal": "balance"})
    both = lf.overlay({"customers": customers, "suppliers": suppliers}, "nation", "avg", "balance")
    return both.withColumns({c: F.round(c, 4) for c in ("customers", "suppliers")})


@query(
    "C3_overlay_by_week",
    """SELECT name, cast(count(*) FILTER (f = 0) AS bigint) AS orders, cast(count(*) FILTER (f = 1) AS bigint) AS shipments FROM
    (SELECT strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS name, 0 AS f FROM orders
     UNION ALL SELECT strftime(date_trunc('week', l_shipdate), '%Y-%m-%d'), 1 FROM lineitem) GROUP BY name ORDER BY name LIMIT 60""",
)
def overlay_by_week(t):
    orders = t.orders.select(F.col("o_orderdate").alias("day"))
    shipments = t.lineitem.select(F.col("l_shipdate").alias("day"))
    return lf.overlay({"orders": orders, "shipments": shipments}, "day", bucket="week", kind="line")


@query(
    "C3_overlay_every_category",
    """SELECT name, cast(count(*) FILTER (f = 0) AS bigint) AS orders, cast(count(*) FILTER (f = 1) AS bigint) AS shipments FROM
    (SELECT strftime(o_orderdate, '%Y-%m-%d') AS name, 0 AS f FROM orders
     UNION ALL SELECT strftime(l_shipdate, '%Y-%m-%d'), 1 FROM lineitem) GROUP BY name""",
)
def overlay_every_category(t):
    orders = t.orders.select(F.col("o_orderdate").alias("day"))
    shipments = t.lineitem.select(F.col("l_shipdate").alias("day"))
    return lf.overlay({"orders": orders, "shipments": shipments}, "day", bucket="day", kind="line", limit=None)


@query(
    "C4_overlay_filtered",
    """SELECT event_type AS name, cast(count(*) FILTER (value >= 50) AS bigint) AS high, cast(count(*) FILTER (value < 50) AS bigint) AS low
    FROM events GROUP BY 1""",
)
def overlay_filtered(t):
    filters = {"high": [("value", "gte", "50")], "low": [("value", "lt", "50"), ("value", "gt", "")]}
    return lf.overlay({"high": t.events, "low": t.events}, "event_type", filters=filters)


@query(
    "C5_schema_diff",
    """SELECT * FROM (VALUES ('key', 'unchanged', 'number', 'number'), ('name', 'unchanged', 'string', 'string'),
      ('c_nationkey', 'removed', 'number', NULL), ('balance', 'changed', 'number', 'string'), ('c_mktsegment', 'removed', 'string', NULL),
      ('s_nationkey', 'added', NULL, 'number')) AS d(key, status, from_type, to_type)""",
)
def schema_diff(t):
    # Both tables as text, with the types their cells vote for, every row voting.
    a = t.customer.withColumnsRenamed({"c_custkey": "key", "c_name": "name", "c_acctbal": "balance"})
    b = t.supplier.withColumnsRenamed({"s_suppkey": "key", "s_name": "name"})
    b = b.withColumn("balance", F.concat(F.lit("$"), F.col("s_acctbal").cast("string"))).drop("s_acctbal")
    voted = [lf.infer_types(df.select(*(F.col(c).cast("string") for c in df.columns)), sample=None) for df in (a, b)]
    return lf.schema_diff(*voted).drop("name")


@query("C6_row_diff", f"{_DIFF} SELECT cast(key AS varchar) AS key, state AS status FROM diff")
def row_diff(t):
    return lf.row_diff(*editions(t), "key").select("key", "status")


@query(
    "C6_row_diff_repeated",
    """WITH a AS (SELECT l_partkey AS key, min_by(l_returnflag, l_orderkey * 10 + l_linenumber) AS flag, count(*) AS n FROM
                  (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_returnflag) GROUP BY 1),
            b AS (SELECT p_partkey AS key, left(p_type, 1) AS flag FROM part)
    SELECT cast(coalesce(a.key, b.key) AS varchar) AS key, CASE WHEN b.key IS NULL THEN 'removed' WHEN a.key IS NULL THEN 'added'
           WHEN a.flag <> b.flag THEN 'changed' ELSE 'unchanged' END AS status, coalesce(a.n > 1, false) AS duplicated
    FROM a FULL OUTER JOIN b ON a.key = b.key""",
)
def row_diff_repeated(t):
    first = F.min(F.struct("l_partkey", "l_returnflag")).alias("x")
    lines = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(first)
    a = lines.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("_row_id"),
        F.col("x.l_partkey").alias("key"),
        F.col("x.l_returnflag").alias("flag"),
    )
    b = t.part.select(F.col("p_partkey").alias("_row_id"), F.col("p_partkey").alias("key"), F.left("p_type", F.lit(1)).alias("flag"))
    return lf.row_diff(a, b, "key").select("key", "status", "duplicated")


@query(
    "C6_row_diff_unpositioned",
    """WITH a AS (SELECT user_id AS key, min(event_type) AS kind, count(*) AS n FROM events GROUP BY 1),
            b AS (SELECT user_id + 5 AS key, min(event_type) AS kind, count(*) AS n FROM events WHERE value > 1 GROUP BY 1)
    SELECT cast(coalesce(a.key, b.key) AS varchar) AS key, CASE WHEN b.key IS NULL THEN 'removed' WHEN a.key IS NULL THEN 'added'
           WHEN a.kind <> b.kind THEN 'changed' ELSE 'unchanged' END AS status, coalesce(a.n, 0) > 1 OR coalesce(b.n, 0) > 1 AS duplicated
    FROM a FULL OUTER JOIN b ON a.key = b.key""",
)
def row_diff_unpositioned(t):
    # Keys that many rows share, in tables without an order: the smallest row of a key counts.
    a = t.events.select(F.col("user_id").alias("key"), F.col("event_type").alias("kind"))
    b = t.events.filter("value > 1").select((F.col("user_id") + 5).alias("key"), F.col("event_type").alias("kind"))
    return lf.row_diff(a, b, "key").select("key", "status", "duplicated")


@query(
    "C7_changed_fields",
    f"""{_DIFF} SELECT cast(key AS varchar) AS key, 'status' AS field, s1 AS "from", s2 AS "to" FROM diff WHERE state = 'changed' AND s1 <> s2
    UNION ALL SELECT cast(key AS varchar), 'priority', p1, p2 FROM diff WHERE state = 'changed' AND p1 <> p2""",
)
def changed_fields(t):
    return lf.changed_fields(lf.row_diff(*editions(t), "key"))


@query(
    "C8_diff_summary",
    f"""{_DIFF} SELECT cast(count(*) FILTER (state = 'added') AS bigint) AS added, cast(count(*) FILTER (state = 'removed') AS bigint) AS removed,
    cast(count(*) FILTER (state = 'changed') AS bigint) AS changed, cast(count(*) FILTER (state = 'unchanged') AS bigint) AS unchanged,
    false AS duplicate_keys FROM diff""",
)
def diff_summary(t):
    return lf.diff_summary(lf.row_diff(*editions(t), "key"))


@query(
    "C9_diff_samples",
    f"""{_DIFF} SELECT state AS status, cast(place AS int) AS place, cast(key AS varchar) AS key FROM
    (SELECT state, key, row_number() OVER (PARTITION BY state ORDER BY key) AS place FROM diff WHERE state <> 'unchanged') WHERE place <= 20""",
)
def diff_samples(t):
    return lf.diff_samples(lf.row_diff(*editions(t), "key")).select("status", "place", "key")
