"""Derived tables the queries share, each next to its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

import logframe as lf

# Events with missing cells, so that conditions on blanks have something to decide.
SPARSE_SQL = """sparse AS (
  SELECT event_id, user_id, ts, nullif(event_type, 'error') AS event_type,
         CASE WHEN value >= 5 THEN value END AS value
  FROM events)"""


def sparse_events(t) -> DataFrame:
    return t.events.select(
        "event_id",
        "user_id",
        "ts",
        F.nullif("event_type", F.lit("error")).alias("event_type"),
        F.when(F.col("value") >= 5, F.col("value")).alias("value"),
    )


# Events as raw strings, the way a text file holds them, with flags spelled in several ways.
RAW_SQL = """raw AS (
  SELECT event_id, '00' || cast(user_id AS varchar) AS n,
         CASE event_type WHEN 'click' THEN 'YES' WHEN 'view' THEN 'no' WHEN 'error' THEN 'n/a' ELSE 'true' END AS flag,
         replace(cast(ts AS varchar), ' ', 'T') AS moment,
         CASE WHEN value < 5 THEN '' WHEN value < 8 THEN 'unknown' ELSE cast(value AS varchar) END AS amount,
         event_type AS kind
  FROM events)"""


def raw_events(t) -> DataFrame:
    e = t.events
    raw = e.select(
        "event_id",
        F.concat(F.lit("00"), F.col("user_id").cast("string")).alias("n"),
        F.when(F.col("event_type") == "click", "YES")
        .when(F.col("event_type") == "view", "no")
        .when(F.col("event_type") == "error", "n/a")
        .otherwise("true")
        .alias("flag"),
        F.translate(F.col("ts").cast("string"), " ", "T").alias("moment"),
        F.when(F.col("value") < 5, "").when(F.col("value") < 8, "unknown").otherwise(F.col("value").cast("string")).alias("amount"),
        F.col("event_type").alias("kind"),
    )
    return lf.with_types(raw, {"n": "number", "flag": "boolean", "moment": "date", "amount": "number"})


# Log lines rendered from events: access lines, some without the optional tail, some garbage.
def access_lines(t) -> DataFrame:
    e = t.events
    user = F.col("user_id").cast("string")
    head = F.concat(
        F.lit("10.0."), F.floor(F.col("user_id") / 250).cast("string"), F.lit("."), (F.col("user_id") % 250).cast("string"),
        F.lit(" - - ["), F.col("ts").cast("string"), F.lit('] "GET /'), F.col("event_type"), F.lit("/"), user, F.lit(' HTTP/1.1" '),
        F.when(F.col("event_type") == "error", "500").otherwise("200"), F.lit(" "), F.col("event_id").cast("string"),
    )
    line = F.when(F.col("event_type") == "signup", F.concat(F.lit("broken "), user)).when(
        F.col("event_type") == "click", head
    ).otherwise(F.concat(head, F.lit(' "-" "agent '), user, F.lit('"')))
    return e.select("event_id", F.concat(line, F.lit("\r")).alias("value"))


ACCESS_SQL = """parsed AS (
  SELECT event_id, event_type,
         '10.0.' || cast(user_id // 250 AS varchar) || '.' || cast(user_id % 250 AS varchar) AS ip,
         cast(ts AS varchar) AS time, 'GET /' || event_type || '/' || cast(user_id AS varchar) || ' HTTP/1.1' AS request,
         CASE event_type WHEN 'error' THEN '500' ELSE '200' END AS status, cast(event_id AS varchar) AS bytes,
         CASE WHEN event_type <> 'click' THEN '-' END AS referer,
         CASE WHEN event_type <> 'click' THEN 'agent ' || cast(user_id AS varchar) END AS agent
  FROM events WHERE event_type <> 'signup')"""


# Notes on network devices: IPv6 and MAC addresses and UUIDs made of a digest of the customer's number.
_HEX = "md5('net-' || cast(c_custkey AS varchar))"
_CUT = {
    "ipv6": "(" + " || ':' || ".join(f"substr(h, {1 + 4 * k}, 4)" for k in range(8)) + ")",
    "mac": "(" + " || sep || ".join(f"substr(h, {1 + 2 * k}, 2)" for k in range(6)) + ")",
    "uuid": "(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12))",
}
_NOTE = f"""CASE c_custkey % 5 WHEN 0 THEN 'peer ' || {_CUT['ipv6']} || ' is up' WHEN 1 THEN 'nic=' || upper({_CUT['mac']}) || ', fallback 10.0.0.' || cast(c_custkey % 7 AS varchar)
  WHEN 2 THEN 'trace ' || {_CUT['uuid']} || '; again ' || {_CUT['uuid']} WHEN 3 THEN 'at 10:45:30 ' || {_CUT['mac']} || ' met ' || {_CUT['ipv6']} ELSE c_name END"""
_DEVICES = f"""SELECT c_custkey AS host, {_NOTE} AS note FROM
  (SELECT c_custkey, c_name, {_HEX} AS h, CASE WHEN c_custkey % 2 = 0 THEN ':' ELSE '-' END AS sep FROM customer)"""
DEVICES_SQL = f"devices AS ({_DEVICES})"


def devices(t) -> DataFrame:
    return t.spark.sql(_DEVICES.replace("varchar", "string").replace("FROM customer", "FROM {customer}"), customer=t.customer)
