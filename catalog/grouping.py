"""Grouped aggregation and cross tables."""

from __future__ import annotations

from pyspark.sql import functions as F

import logframe as lf
from catalog.registry import query
from catalog.tables import RAW_SQL, SPARSE_SQL, raw_events, sparse_events


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 4) for c in columns or ("value",)})


@query("G1_group_count", f"WITH {SPARSE_SQL} SELECT coalesce(event_type, '(empty)') AS name, cast(count(*) AS bigint) AS value FROM sparse GROUP BY 1")
def group_count(t):
    return lf.group_aggregate(sparse_events(t), "event_type")


def _measured(id: str, agg: str) -> None:
    @query(
        f"{id}_group_{agg}",
        f"WITH {SPARSE_SQL} SELECT cast(user_id AS varchar) AS name, round(coalesce({agg}(value), 0), 4) AS value FROM sparse GROUP BY 1",
    )
    def build(t, agg=agg):
        return _rounded(lf.group_aggregate(sparse_events(t), "user_id", agg, "value"))


for _id, _agg in (("G2", "sum"), ("G3", "avg"), ("G4", "min"), ("G5", "max")):
    _measured(_id, _agg)


@query(
    "G2_group_sum_raw",
    f"WITH {RAW_SQL} SELECT kind AS name, round(coalesce(sum(try_cast(amount AS double)), 0), 4) AS value FROM raw GROUP BY 1",
)
def sum_raw(t):
    return _rounded(lf.group_aggregate(raw_events(t), "kind", "sum", "amount"))


_LABELS = {
    "hour": "strftime(ts, '%Y-%m-%d %H:00')",
    "day": "strftime(ts, '%Y-%m-%d')",
    "week": "strftime(date_trunc('week', ts), '%Y-%m-%d')",
    "month": "strftime(ts, '%Y-%m')",
}


def _bucketed(bucket: str, label: str) -> None:
    @query(
        f"G6_date_bucket_{bucket}",
        f"SELECT {label} AS name, round(avg(value), 4) AS value FROM events GROUP BY 1",
    )
    def build(t, bucket=bucket):
        return _rounded(lf.group_aggregate(t.events, "ts", "avg", "value", bucket))


for _bucket, _label in _LABELS.items():
    _bucketed(_bucket, _label)


@query(
    "G6_date_bucket_raw",
    f"WITH {RAW_SQL} SELECT left(moment, 10) AS name, cast(count(*) AS bigint) AS value FROM raw GROUP BY 1",
)
def bucket_raw(t):
    return lf.group_aggregate(raw_events(t), "moment", bucket="day")


@query(
    "G7_chart_bar",
    """SELECT cast(user_id AS varchar) AS name, round(sum(value), 4) AS value FROM events GROUP BY user_id
    ORDER BY sum(value) DESC, min(event_id) LIMIT 40""",
)
def chart_bar(t):
    return _rounded(lf.chart_series(lf.with_row_id(t.events, "event_id"), "user_id", "sum", "value"))


@query(
    "G7_chart_line",
    "SELECT strftime(l_shipdate, '%Y-%m') AS name, round(avg(l_extendedprice), 4) AS value FROM lineitem GROUP BY 1 ORDER BY 1 LIMIT 100",
)
def chart_line(t):
    return _rounded(lf.chart_series(t.lineitem, "l_shipdate", "avg", "l_extendedprice", "month", "line"))


@query(
    "G7_chart_pie",
    "SELECT cast(user_id AS varchar) AS name, cast(count(*) AS bigint) AS value FROM events GROUP BY user_id ORDER BY count(*) DESC, min(event_id) LIMIT 8",
)
def chart_pie(t):
    return lf.chart_series(lf.with_row_id(t.events, "event_id"), "user_id", kind="pie")


@query(
    "G7_chart_all",
    "SELECT cast(user_id AS varchar) AS name, cast(count(*) AS bigint) AS value FROM events GROUP BY user_id",
)
def chart_all(t):
    return lf.chart_series(lf.with_row_id(t.events, "event_id"), "user_id", limit=None)


@query("G7_group_total", "SELECT cast(count(DISTINCT user_id) AS bigint) AS group_count FROM events")
def group_total(t):
    return lf.group_total(t.events, "user_id")


# --- cross tables ---------------------------------------------------------------------------

_SHOWN = ["row_value", "col_value", "level", "value"]


def _cube_sql(source: str, row: str, col: str, value: str) -> str:
    """Dense cells and totals of two complete axes."""
    return f"""WITH base AS ({source}),
      grid AS (SELECT r, c FROM (SELECT DISTINCT {row} AS r FROM base UNION ALL SELECT NULL) CROSS JOIN
                                (SELECT DISTINCT {col} AS c FROM base UNION ALL SELECT NULL)),
      sums AS (SELECT {row} AS r, {col} AS c, {value} AS v FROM base GROUP BY CUBE (1, 2))
    SELECT cast(grid.r AS varchar) AS row_value, cast(grid.c AS varchar) AS col_value,
           CASE WHEN grid.r IS NULL AND grid.c IS NULL THEN 'grand' WHEN grid.r IS NULL THEN 'col_total'
                WHEN grid.c IS NULL THEN 'row_total' ELSE 'cell' END AS level,
           round(coalesce(v, 0), 4) AS value
    FROM grid LEFT JOIN sums ON grid.r IS NOT DISTINCT FROM sums.r AND grid.c IS NOT DISTINCT FROM sums.c"""


_ORDERS = "SELECT o_orderstatus AS s, o_orderpriority AS p, o_totalprice AS m FROM orders"


@query("X1_crosstab_count", _cube_sql(_ORDERS, "s", "p", "cast(count(*) AS double)"))
def crosstab_count(t):
    return _rounded(lf.crosstab(t.orders, "o_orderstatus", "o_orderpriority").select(*_SHOWN))


@query("X2_crosstab_sum", _cube_sql(_ORDERS, "s", "p", "sum(m)"))
def crosstab_sum(t):
    return _rounded(lf.crosstab(t.orders, "o_orderstatus", "o_orderpriority", "sum", "o_totalprice").select(*_SHOWN))


@query(
    "X3_crosstab_avg",
    _cube_sql("SELECT l_linestatus AS s, l_linenumber AS p, CASE WHEN l_discount > 0 THEN l_extendedprice END AS m FROM lineitem", "s", "p", "avg(m)"),
)
def crosstab_avg(t):
    discounted = t.lineitem.withColumn("l_extendedprice", F.when(F.col("l_discount") > 0, F.col("l_extendedprice")))
    return _rounded(lf.crosstab(discounted, "l_linestatus", "l_linenumber", "avg", "l_extendedprice").select(*_SHOWN))


@query(
    "X4_pivot_margins",
    """SELECT l_returnflag AS row_value, l_linestatus AS col_value, round(avg(l_quantity), 4) AS value,
    CASE grouping(l_returnflag, l_linestatus) WHEN 1 THEN 'row_total' WHEN 2 THEN 'col_total' WHEN 3 THEN 'grand' END AS level
    FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus) HAVING grouping(l_returnflag, l_linestatus) > 0""",
)
def pivot_margins(t):
    table = lf.crosstab(t.lineitem, "l_returnflag", "l_linestatus", "avg", "l_quantity")
    return _rounded(table.filter("level <> 'cell'").select(*_SHOWN))


@query(
    "X5_axis_top_others",
    _cube_sql(
        """SELECT l_returnflag AS f, coalesce(cast(top.k AS varchar), '(others)') AS s, l_quantity AS m FROM lineitem LEFT JOIN
        (SELECT l_suppkey AS k FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, l_suppkey LIMIT 19) top ON l_suppkey = top.k""",
        "f",
        "s",
        "avg(m)",
    ),
)
def axis_top_others(t):
    return _rounded(lf.crosstab(t.lineitem, "l_returnflag", "l_suppkey", "avg", "l_quantity").select(*_SHOWN))


@query(
    "X6_axis_buckets",
    """SELECT l_returnflag AS row_value, CAST(floor(l_extendedprice / 10000) * 10000 AS double) AS col_low,
    CAST(floor(l_extendedprice / 10000) * 10000 + 10000 AS double) AS col_high, CAST(count(*) AS double) AS value
    FROM lineitem GROUP BY ALL""",
)
def axis_buckets(t):
    table = lf.crosstab(t.lineitem, "l_returnflag", "l_extendedprice", col_bucket=True)
    return table.filter("level = 'cell' and value > 0").select("row_value", "col_low", "col_high", "value")


@query(
    "X7_bucket_labels",
    """SELECT format('{:,}', lo) || '–' || format('{:,}', lo + 10000) AS col_value, CAST(count(*) AS double) AS value
    FROM (SELECT CAST(floor(l_extendedprice / 10000) * 10000 AS bigint) AS lo FROM lineitem) GROUP BY lo""",
)
def bucket_labels(t):
    table = lf.crosstab(t.lineitem, "l_returnflag", "l_extendedprice", col_bucket=True)
    return table.filter("level = 'col_total'").select("col_value", "value")


@query(
    "X8_pivot_wide",
    """SELECT l_returnflag AS row_value, round(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END), 4) AS "O",
    round(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END), 4) AS "F" FROM lineitem GROUP BY 1""",
)
def pivot_wide(t):
    wide = lf.pivot_wide(lf.crosstab(t.lineitem, "l_returnflag", "l_linestatus", "sum", "l_quantity"))
    return _rounded(wide, "O", "F")


@query(
    "X8_largest_cell",
    """SELECT round(greatest(max(v), 0), 4) AS max FROM
    (SELECT sum(l_quantity) AS v FROM lineitem GROUP BY l_returnflag, l_linestatus)""",
)
def largest_cell(t):
    return _rounded(lf.largest_cell(lf.crosstab(t.lineitem, "l_returnflag", "l_linestatus", "sum", "l_quantity")), "max")
