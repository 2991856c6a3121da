"""Columns, sort, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

import logframe as lf
from catalog.registry import query
from catalog.tables import SPARSE_SQL, sparse_events
from logframe.operators.ordering import sort_order


def _sorted(df, keys, *columns):
    return lf.with_position(df, sort_order(df, keys)).select("position", *columns)


@query("P1_select_view", "SELECT o_totalprice, o_orderkey, o_custkey, o_orderdate, o_orderpriority FROM orders")
def select_view(t):
    saved = [
        {"key": "o_totalprice", "visible": True},
        {"key": "gone", "visible": True},
        {"key": "o_orderstatus", "visible": False},
        {"key": "o_orderkey", "visible": True},
    ]
    return lf.select_view(t.orders, lf.reconcile_columns(t.orders, saved))


@query(
    "O1_multi_sort",
    f"""WITH {SPARSE_SQL} SELECT row_number() OVER (ORDER BY event_type ASC NULLS LAST, value DESC NULLS LAST, event_id) - 1 AS position,
    event_id, event_type, value FROM sparse""",
)
def multi_sort(t):
    rows = lf.with_row_id(sparse_events(t), "event_id")
    return _sorted(rows, [("event_type", "asc"), ("value", "desc"), ("nothing", "asc")], "event_id", "event_type", "value")


@query(
    "O1_sort_rows",
    "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem",
)
def sort_rows(t):
    return lf.multi_sort(t.lineitem, [("l_extendedprice", "desc")]).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query(
    "O2_natural_order",
    """SELECT row_number() OVER (ORDER BY split_part(p_brand, '#', 1) DESC, cast(split_part(p_brand, '#', 2) AS int) DESC, p_partkey) - 1
    AS position, p_partkey, p_brand FROM part""",
)
def natural_order(t):
    return _sorted(lf.with_row_id(t.part, "p_partkey"), [("p_brand", "desc")], "p_partkey", "p_brand")


@query(
    "O3_top_k",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100",
)
def top_k(t):
    return lf.top_k(lf.with_row_id(t.orders, "o_orderkey"), [("o_totalprice", "desc")], 100).select("o_orderkey", "o_totalprice")


@query(
    "O4_page",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 50 OFFSET 200",
)
def page(t):
    return lf.page(lf.with_row_id(t.orders, "o_orderkey"), [("o_totalprice", "asc")], 200, 50).select("o_orderkey", "o_totalprice")


@query(
    "O4_deep_page",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 50 OFFSET 12000",
)
def deep_page(t):
    return lf.page(lf.with_row_id(t.orders, "o_orderkey"), [("o_totalprice", "asc")], 12_000, 50).select("o_orderkey", "o_totalprice")


@query(
    "O1_sort_text",
    "SELECT event_id, event_type, row_number() OVER (ORDER BY event_type DESC, event_id) - 1 AS position FROM events",
)
def sort_text(t):
    # The sort of a text column by its dictionary, numbered as sorted.
    rows = lf.multi_sort(lf.with_row_id(t.events, "event_id"), [("event_type", "desc")]).select("event_id", "event_type")
    place = rows.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    return lf.with_position(place, [(F.col("part"), "asc"), (F.col("at"), "asc")]).select("event_id", "event_type", "position")


@query(
    "O4_page_without_positions",
    """SELECT l_orderkey, l_partkey, l_quantity, l_shipdate FROM lineitem
    ORDER BY l_shipdate DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus
    LIMIT 100 OFFSET 30000""",
)
def page_without_positions(t):
    # Ties of the ship date fall to the values of all columns.
    return lf.page(t.lineitem, [("l_shipdate", "desc")], 30_000, 100).select("l_orderkey", "l_partkey", "l_quantity", "l_shipdate")
