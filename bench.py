"""Time the headline stages and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Eight stages (filter, search, two sorts, column statistics, distributions, cross table, chart) on
``events`` and ``lineitem``, then row diff, overlay, extraction, redaction and log parsing, then a
deep page, top values, and profiles and a cross table over the orders as a CSV file. Every
stage is forced in full with the ``noop`` sink: one warm-up, then the median of ``BENCH_RUNS``.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession, functions as F  # noqa: E402

import logframe as lf  # noqa: E402
from catalog.compare import editions  # noqa: E402
from catalog.registry import Tables  # noqa: E402
from catalog.tables import access_lines  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def distributions(df):
    """Both kinds of distribution, as the profile of every column needs."""
    bins = lf.histogram(df).select("key", F.col("bin").cast("string").alias("value"), "count")
    return bins.union(lf.top_values(df).select("key", "value", "count"))


def orders_csv(t: Tables):
    path = lf.scratch_dir(t.spark)
    t.orders.repartition(int(CPUS)).write.options(header=True).csv(path)
    return lf.with_types(lf.read_delimited(t.spark, path, ",", "utf-8", False, infer=False), {"o_totalprice": "number", "o_custkey": "number"})


def stages(t: Tables):
    events, lineitem, csv = t.events, t.lineitem, orders_csv(t)
    return {
        "filter_events": lambda: lf.filter_all(events, [("value", "gte", "50")]),
        "filter_lineitem": lambda: lf.filter_all(lineitem, [("l_quantity", "gte", "25")]),
        "search_events": lambda: lf.search(events, "error"),
        "search_lineitem": lambda: lf.search(lineitem, "A"),
        "search_numbers_lineitem": lambda: lf.search(lineitem, "123"),
        "sort_number_events": lambda: lf.multi_sort(events, [("value", "desc")]),
        "sort_number_lineitem": lambda: lf.multi_sort(lineitem, [("l_extendedprice", "desc")]),
        "sort_text_events": lambda: lf.multi_sort(events, [("event_type", "asc"), ("props", "asc")]),
        "sort_text_lineitem": lambda: lf.multi_sort(lineitem, [("l_returnflag", "asc"), ("l_linestatus", "asc")]),
        "stats_events": lambda: lf.column_stats(events),
        "stats_lineitem": lambda: lf.column_stats(lineitem),
        "distributions_events": lambda: distributions(events),
        "distributions_lineitem": lambda: distributions(lineitem),
        "pivot_avg_events": lambda: lf.crosstab(events, "event_type", "user_id", "avg", "value"),
        "pivot_avg_lineitem": lambda: lf.crosstab(lineitem, "l_returnflag", "l_suppkey", "avg", "l_quantity"),
        "chart_avg_events": lambda: lf.chart_series(events, "event_type", "avg", "value"),
        "chart_month_lineitem": lambda: lf.chart_series(lineitem, "l_shipdate", "avg", "l_extendedprice", "month", "line"),
        "row_diff_orders": lambda: lf.row_diff(*editions(t), "key"),
        "overlay_days": lambda: lf.overlay(
            {"orders": t.orders.select(F.col("o_orderdate").alias("day")), "shipments": lineitem.select(F.col("l_shipdate").alias("day"))},
            "day", bucket="month", kind="line",
        ),
        "extract_email_documents": lambda: lf.extract_matches(t.documents, "email"),
        "redact_token_documents": lambda: lf.redact(t.documents),
        "parse_log_events": lambda: lf.parse_log(access_lines(t), "access"),
        "deep_page_lineitem": lambda: lf.page(lineitem, [("l_extendedprice", "desc")], 400_000, 50),
        "top_values_orders": lambda: lf.top_values(t.orders),
        "stats_csv_orders": lambda: lf.column_stats(csv),
        "pivot_avg_csv_orders": lambda: lf.crosstab(csv, "o_orderstatus", "o_orderpriority", "avg", "o_totalprice"),
    }


def timed(build) -> float:
    start = time.perf_counter()
    build().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("logframe-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    t = Tables(spark, FOLDER)
    seconds = {}
    for name, build in stages(t).items():
        timed(build)
        seconds[name] = round(statistics.median(timed(build) for _ in range(RUNS)), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "sum of stage medians",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
