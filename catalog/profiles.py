"""Column types and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

import logframe as lf
from catalog.registry import query
from catalog.tables import RAW_SQL, SPARSE_SQL, raw_events, sparse_events

# A raw cell's vote, spelled out for SQL.
_VOTE = r"""CASE WHEN trim(v) = '' THEN NULL WHEN lower(trim(v)) IN ('true', 'false', 'yes', 'no') THEN 'boolean'
  WHEN regexp_full_match(trim(v), '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN 'number'
  WHEN regexp_matches(trim(v), '^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2})?') THEN 'date'
  WHEN v IS NOT NULL THEN 'string' END"""


@query(
    "A5_infer_types",
    f"""WITH {RAW_SQL},
      cells AS (SELECT 'n' AS key, n AS v FROM raw UNION ALL SELECT 'flag', flag FROM raw UNION ALL SELECT 'moment', moment FROM raw
                UNION ALL SELECT 'amount', amount FROM raw UNION ALL SELECT 'kind', kind FROM raw),
      votes AS (SELECT key, {_VOTE} AS t FROM cells),
      counts AS (SELECT key, cast(count(*) FILTER (t = 'string') AS bigint) AS string, cast(count(*) FILTER (t = 'number') AS bigint) AS number,
             cast(count(*) FILTER (t = 'boolean') AS bigint) AS boolean, cast(count(*) FILTER (t = 'date') AS bigint) AS date
      FROM votes GROUP BY key)
    SELECT *, CASE greatest(string, number, boolean, date) WHEN 0 THEN 'string' WHEN string THEN 'string'
      WHEN number THEN 'number' WHEN boolean THEN 'boolean' ELSE 'date' END AS type FROM counts""",
)
def infer_types(t):
    return lf.type_votes(raw_events(t).drop("event_id"), sample=None)


@query(
    "A6_coerce",
    f"""WITH {RAW_SQL} SELECT event_id, cast(cast(n AS bigint) AS varchar) AS n,
      CASE lower(flag) WHEN 'yes' THEN 'true' WHEN 'no' THEN 'false' ELSE flag END AS flag, moment,
      CASE WHEN amount = '' THEN NULL WHEN amount LIKE '%.0' THEN left(amount, length(amount) - 2) ELSE amount END AS amount, kind
    FROM raw""",
)
def coerce(t):
    return lf.coerce(raw_events(t))


@query(
    "A6_to_typed",
    f"""WITH {RAW_SQL} SELECT event_id, cast(n AS double) AS n, CASE lower(flag) WHEN 'yes' THEN true WHEN 'true' THEN true WHEN 'no' THEN false END AS flag,
      try_cast(amount AS double) AS amount, kind FROM raw""",
)
def to_typed(t):
    return lf.to_typed(raw_events(t)).drop("moment")


@query(
    "A13_retype_columns",
    f"""WITH {RAW_SQL} SELECT event_id, cast(cast(n AS bigint) AS varchar) AS n,
      CASE lower(flag) WHEN 'yes' THEN 'true' WHEN 'no' THEN 'false' ELSE flag END AS flag, kind FROM raw""",
)
def retype(t):
    return lf.retype(raw_events(t), {"n": "string", "flag": "string", "kind": "string", "gone": "date"}).select("event_id", "n", "flag", "kind")


def _stats_sql(table: str, columns: dict[str, str], prefix: str = "") -> str:
    parts = []
    for c, kind in columns.items():
        numbers = (
            f"cast(min({c}) AS double), cast(max({c}) AS double), round(avg({c}), 4), round(cast(sum({c}) AS double), 4)"
            if kind == "number"
            else "cast(NULL AS double), cast(NULL AS double), cast(NULL AS double), cast(NULL AS double)"
        )
        parts.append(
            f"SELECT '{c}', '{kind}', count({c}), count(*) - count({c}), count(DISTINCT {c}), {numbers} FROM {table}"
        )
    body = " UNION ALL ".join(parts)
    return (
        f"{prefix}SELECT * FROM ({body}) AS s(key, type, count, null_count, distinct_count, min, max, mean, sum)"
    )


_LINEITEM = {
    **{c: "number" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")},
    "l_returnflag": "string",
    "l_linestatus": "string",
    "l_shipdate": "date",
}


def _rounded_stats(df):
    return df.withColumns({c: F.round(c, 4) for c in ("mean", "sum")})


@query("S1_column_stats", _stats_sql("lineitem", _LINEITEM))
def column_stats(t):
    return _rounded_stats(lf.column_stats(t.lineitem))


@query(
    "S1_column_stats_sparse",
    _stats_sql("sparse", {"event_id": "number", "user_id": "number", "ts": "date", "event_type": "string", "value": "number"}, f"WITH {SPARSE_SQL} "),
)
def column_stats_sparse(t):
    return _rounded_stats(lf.column_stats(sparse_events(t)))


@query(
    "S2_distinct_count",
    "SELECT key, n AS distinct_count, least(n, 10000) AS shown_count, n > 10000 AS capped FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS key, count(DISTINCT {c}) AS n FROM lineitem" for c in _LINEITEM)
    + ")",
)
def distinct_count(t):
    return lf.distinct_counts(t.lineitem)


def _histogram_sql(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS key, cast(bin AS int) AS bin, round(lo + bin * (hi - lo) / 12, 4) AS low,
        round(CASE WHEN bin = 11 THEN hi ELSE lo + (bin + 1) * (hi - lo) / 12 END, 4) AS high, cast(coalesce(n, 0) AS bigint) AS count
        FROM (SELECT range AS bin FROM range(12)) CROSS JOIN (SELECT cast(min({c}) AS double) AS lo, cast(max({c}) AS double) AS hi FROM {table})
        LEFT JOIN (SELECT least(cast(floor(({c} - lo) / (hi - lo) * 12) AS int), 11) AS b, count(*) AS n
                   FROM {table}, (SELECT min({c}) AS lo, max({c}) AS hi FROM {table}) WHERE {c} IS NOT NULL GROUP BY 1) ON b = bin"""
        for c in columns
    )


@query("S3_numeric_histogram", _histogram_sql("lineitem", ["l_quantity", "l_extendedprice", "l_partkey"]))
def numeric_histogram(t):
    h = lf.histogram(t.lineitem, ["l_quantity", "l_extendedprice", "l_partkey"])
    return h.withColumns({"low": F.round("low", 4), "high": F.round("high", 4)})


def _top_sql(table: str, columns: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS key, {shown} AS value, count, round(count / total, 4) AS share, total, total - cast(sum(count) OVER () AS bigint) AS others_count
        FROM (SELECT {c} AS v, cast(count(*) AS bigint) AS count, (SELECT cast(count({c}) AS bigint) FROM {table}) AS total FROM {table}
              WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)"""
        for c, shown in columns.items()
    )


@query(
    "S4_top_values",
    _top_sql("orders", {"o_orderstatus": "v", "o_orderpriority": "v", "o_orderdate": "replace(cast(v AS varchar), ' ', 'T')"}),
)
def top_values(t):
    return lf.top_values(t.orders).withColumn("share", F.round("share", 4))


@query(
    "S4_top_values_skewed",
    _top_sql("skewed", {"host": "v", "page": "v"}).replace("SELECT 'host'", """WITH skewed AS (
      SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'h' || cast(l_linenumber AS varchar) ELSE 'rare' || cast(l_orderkey AS varchar) || '-' || cast(l_partkey AS varchar) END AS host,
             'p' || cast(l_orderkey AS varchar) AS page FROM lineitem) SELECT 'host'""", 1).replace("total, 4)", "total, 9)"),
)
def top_values_skewed(t):
    # One column with few frequent values among very many rare ones, one with none that stands out.
    rare = F.concat_ws("-", F.concat(F.lit("rare"), F.col("l_orderkey").cast("string")), F.col("l_partkey").cast("string"))
    host = F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit("h"), F.col("l_linenumber").cast("string"))).otherwise(rare)
    rows = t.lineitem.select(host.alias("host"), F.concat(F.lit("p"), F.col("l_orderkey").cast("string")).alias("page"))
    return lf.top_values(rows).withColumn("share", F.round("share", 9))


@query(
    "S5_value_share",
    """SELECT lang AS value, cast(count(*) AS bigint) AS count, round(count(*) / (SELECT count(lang) FROM documents), 6) AS share
    FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""",
)
def value_share(t):
    return lf.top_values(t.documents, ["lang"]).select("value", "count", F.round("share", 6).alias("share"))


@query(
    "S5_value_share_all",
    """SELECT cast(user_id AS varchar) AS value, cast(count(*) AS bigint) AS count, round(count(*) / (SELECT count(*) FROM events), 9) AS share
    FROM events GROUP BY 1""",
)
def value_share_all(t):
    users = t.events.select(F.col("user_id").cast("string").alias("user_id"))
    return lf.top_values(users, ["user_id"], n=None).select("value", "count", F.round("share", 9).alias("share"))


@query(
    "S6_bin_bounds",
    """SELECT cast(range AS int) AS bin, round(lo + range * w, 4) AS low, round(CASE WHEN range = 11 THEN hi ELSE lo + (range + 1) * w END, 4) AS high
    FROM range(12), (SELECT min(value) AS lo, max(value) AS hi, (max(value) - min(value)) / 12 AS w FROM events)""",
)
def bin_bounds(t):
    h = lf.histogram(t.events, ["value"])
    return h.select("bin", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


@query(
    "S4_column_kinds",
    """SELECT * FROM (VALUES ('event_id', 'numeric'), ('user_id', 'numeric'), ('ts', 'categorical'), ('event_type', 'categorical'),
    ('value', 'numeric'), ('nothing', 'empty')) AS k(key, kind)""",
)
def column_kinds(t):
    return lf.column_kinds(sparse_events(t).withColumn("nothing", F.lit(None).cast("string")))
