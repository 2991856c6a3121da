"""Conditions, groups, search and extraction."""

from __future__ import annotations

import logframe as lf
from catalog.registry import query
from catalog.tables import DEVICES_SQL, RAW_SQL, SPARSE_SQL, devices, raw_events, sparse_events

COLS = ["event_id", "event_type", "value"]


def _filtered(name: str, conditions: list, where: str) -> None:
    @query(name, f"WITH {SPARSE_SQL} SELECT event_id, event_type, value FROM sparse WHERE {where}")
    def build(t, conditions=conditions):
        return lf.filter_all(sparse_events(t), conditions).select(*COLS)


_filtered("F1_contains", [("event_type", "contains", "CLI")], "contains(lower(event_type), 'cli')")
_filtered("F2_not_contains", [("event_type", "notContains", "cli")], "event_type IS NULL OR NOT contains(lower(event_type), 'cli')")
_filtered("F3_equals", [("event_type", "equals", "VIEW"), ("user_id", "equals", "8")], "event_type = 'view' AND user_id = 8")
_filtered("F4_not_equals", [("event_type", "notEquals", "view"), ("value", "notEquals", "12.5")],
          "event_type IS DISTINCT FROM 'view' AND value IS DISTINCT FROM 12.5")
_filtered("F5_gt", [("value", "gt", "50")], "value > 50")
_filtered("F6_gte", [("value", "gte", "50"), ("user_id", "gte", "10.5")], "value >= 50 AND user_id >= 10.5")
_filtered("F7_lt", [("value", "lt", "50"), ("ts", "lt", "2024-01-15T12:00:00")], "value < 50 AND ts < TIMESTAMP '2024-01-15 12:00:00'")
_filtered("F8_lte", [("value", "lte", "50"), ("value", "lte", "not a number")], "value <= 50")
_filtered("F9_between", [("value", "between", "90", "10"), ("ts", "between", "2024-01-05", "2024-01-20")],
          "value BETWEEN 10 AND 90 AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'")
_filtered("F12_is_empty", [("event_type", "isEmpty")], "event_type IS NULL OR event_type = ''")
_filtered("F13_is_not_empty", [("value", "isNotEmpty"), ("event_type", "isNotEmpty")], "value IS NOT NULL AND event_type <> ''")
_filtered("F14_filter_all", [("value", "gte", "20"), ("event_type", "contains", "e"), ("value", "gt", " "), ("nothing", "equals", "x")],
          "value >= 20 AND contains(lower(event_type), 'e')")


@query("F14_zero_operand", "SELECT event_id, value FROM events WHERE value > 0 AND event_id <> 0")
def zero_operand(t):
    """Saved views hold numbers too: 0 is an operand, not a missing one."""
    zero = [{"columnKey": c, "operator": op, "value": 0} for c, op in (("value", "gt"), ("event_id", "notEquals"))]
    return lf.filter_all(t.events, zero).select("event_id", "value")


@query("F10_is_true", f"WITH {RAW_SQL} SELECT event_id, kind FROM raw WHERE lower(flag) IN ('true', 'yes')")
def is_true(t):
    return lf.filter_all(raw_events(t), [("flag", "isTrue")]).select("event_id", "kind")


@query("F11_is_false", f"WITH {RAW_SQL} SELECT event_id, kind FROM raw WHERE lower(flag) IN ('false', 'no')")
def is_false(t):
    return lf.filter_all(raw_events(t), [("flag", "isFalse")]).select("event_id", "kind")


@query(
    "F3_equals_raw_number",
    f"WITH {RAW_SQL} SELECT event_id, n, amount FROM raw WHERE cast(n AS bigint) = 8 AND try_cast(nullif(amount, '') AS double) IS DISTINCT FROM 12.5",
)
def equals_raw(t):
    return lf.filter_all(raw_events(t), [("n", "equals", "8.0"), ("amount", "notEquals", "12.5")]).select("event_id", "n", "amount")


@query(
    "F15_filter_groups",
    f"""WITH {SPARSE_SQL} SELECT event_id, event_type, value FROM sparse
    WHERE (event_type = 'view' AND value > 100) OR (event_type IS NULL) OR (user_id BETWEEN 5 AND 9)""",
)
def filter_groups(t):
    groups = [
        [("event_type", "equals", "view"), ("value", "gt", "100")],
        [("event_type", "isEmpty")],
        [("user_id", "between", "5", "9"), ("value", "gt", "")],
        [("value", "lt", "")],
    ]
    return lf.filter_groups(sparse_events(t), groups).select(*COLS)


@query(
    "F17_search_text",
    """SELECT doc_id, n_chars FROM documents WHERE contains(lower(text), 'tion') OR contains(lower(lang), 'tion')
    OR contains(lower(source), 'tion')""",
)
def search_text(t):
    return lf.search(t.documents, " TION ").select("doc_id", "n_chars")


@query(
    "F17_search_numbers",
    """SELECT o_orderkey, o_totalprice FROM orders WHERE contains(cast(o_orderkey AS varchar), '12')
    OR contains(cast(o_custkey AS varchar), '12') OR contains(o_orderstatus, '12') OR contains(o_orderpriority, '12')
    OR contains(CASE WHEN o_totalprice = floor(o_totalprice) THEN cast(cast(o_totalprice AS bigint) AS varchar)
                ELSE cast(o_totalprice AS varchar) END, '12')
    OR contains(replace(cast(o_orderdate AS varchar), ' ', 'T'), '12')""",
)
def search_numbers(t):
    return lf.search(t.orders, "12").select("o_orderkey", "o_totalprice")


@query("F18_search_regex", r"SELECT p_partkey, p_name, p_brand FROM part WHERE regexp_matches(p_name, '(?i)^(small|red)\b.*g') OR regexp_matches(p_brand, '(?i)^(small|red)\b.*g') OR regexp_matches(p_type, '(?i)^(small|red)\b.*g')")
def search_regex(t):
    return lf.search(t.part, r"^(?:small|RED)\b.*g", regex=True).select("p_partkey", "p_name", "p_brand")


@query("F18_search_regex_invalid", "SELECT o_orderkey, o_orderstatus FROM orders")
def search_invalid(t):
    return lf.search(t.orders, "(", regex=True).select("o_orderkey", "o_orderstatus")


def _pattern(id: str, source: str) -> None:
    @query(f"F19_quick_pattern_{id.replace('-', '_')}", f"SELECT doc_id, lang FROM documents WHERE regexp_matches(text, '(?i){source}')")
    def build(t, id=id):
        return lf.quick_pattern(t.documents.drop("n_chars"), id).select("doc_id", "lang")

    @query(
        f"F20_extract_{id.replace('-', '_')}",
        f"""SELECT value, cast(count(*) AS bigint) AS count FROM
        (SELECT unnest(regexp_extract_all(text, '(?i){source}', 0)) AS value FROM documents) GROUP BY value""",
    )
    def extract(t, id=id):
        return lf.extract_matches(t.documents.select("doc_id", "text"), id)


for _id, _source in lf.NAMED_PATTERNS.items():
    if _id != "http-err":
        _pattern(_id, _source)


def _device_pattern(id: str) -> None:
    source = lf.NAMED_PATTERNS[id]

    @query(f"F19_devices_{id}", f"WITH {DEVICES_SQL} SELECT host, note FROM devices WHERE regexp_matches(note, '(?i){source}')")
    def build(t):
        return lf.quick_pattern(devices(t), id)

    @query(
        f"F20_devices_{id}",
        f"""WITH {DEVICES_SQL} SELECT value, cast(count(*) AS bigint) AS count FROM
        (SELECT unnest(regexp_extract_all(note, '(?i){source}', 0)) AS value FROM devices) GROUP BY value""",
    )
    def extract(t):
        return lf.extract_matches(devices(t), id)


for _id in ("ipv6", "mac", "uuid"):
    _device_pattern(_id)


@query(
    "F19_quick_pattern_http_err",
    r"""SELECT page_id, url FROM pages WHERE regexp_matches(url, '\b[45]\d{2}\b') OR regexp_matches(html, '\b[45]\d{2}\b')
    OR regexp_matches(cast(page_id AS varchar), '\b[45]\d{2}\b')""",
)
def http_err(t):
    return lf.quick_pattern(t.pages, "http-err").select("page_id", "url")


@query(
    "F20_extract_http_err",
    r"""SELECT value, cast(count(*) AS bigint) AS count FROM (
      SELECT unnest(regexp_extract_all(html, '\b[45]\d{2}\b', 0)) AS value FROM pages
      UNION ALL SELECT unnest(regexp_extract_all(url, '\b[45]\d{2}\b', 0)) FROM pages
      UNION ALL SELECT unnest(regexp_extract_all(cast(page_id AS varchar), '\b[45]\d{2}\b', 0)) FROM pages) GROUP BY value""",
)
def extract_http(t):
    return lf.extract_matches(t.pages, "http-err")


@query(
    "F20_extract_regex",
    r"""SELECT value, cast(count(*) AS bigint) AS count FROM
    (SELECT unnest(regexp_extract_all(html, '(?i)href="[^"]+"', 0)) AS value FROM pages) GROUP BY value""",
)
def extract_regex(t):
    return lf.extract_matches(t.pages.select("html"), r'HREF="[^"]+"')


@query(
    "F21_drill_bin",
    """WITH ends AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 12 AS w FROM orders)
    SELECT o_orderkey, o_totalprice FROM orders, ends WHERE o_totalprice BETWEEN lo + 3 * w AND lo + 4 * w""",
)
def drill_bin(t):
    # The bin's row is looked up like a click on the chart: one row of twelve.
    bin_ = lf.histogram(t.orders, ["o_totalprice"]).filter("bin = 3").first()
    return lf.filter_all(t.orders, [lf.from_range("o_totalprice", bin_["low"], bin_["high"])]).select("o_orderkey", "o_totalprice")


@query(
    "F21_drill_cell",
    """SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders
    WHERE o_orderstatus = (SELECT o_orderstatus FROM orders GROUP BY 1 ORDER BY count(*) DESC, o_orderstatus LIMIT 1)
      AND o_orderpriority = (SELECT o_orderpriority FROM orders GROUP BY 1 ORDER BY count(*) DESC, o_orderpriority LIMIT 1)""",
)
def drill_cell(t):
    cell = lf.crosstab(t.orders, "o_orderstatus", "o_orderpriority").filter("row_at = 0 and col_at = 0").first()
    conditions = lf.from_cell(cell, "o_orderstatus", "string", "o_orderpriority", "string")
    return lf.filter_groups(t.orders, lf.narrow([], conditions)).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query(
    "F21_drill_category",
    """SELECT event_id, event_type FROM events
    WHERE event_type = (SELECT event_type FROM events GROUP BY 1 ORDER BY avg(value) DESC, event_type LIMIT 1)""",
)
def drill_category(t):
    bar = lf.chart_series(t.events, "event_type", "avg", "value").first()
    return lf.filter_all(t.events, [lf.from_category("event_type", "string", bar["name"])]).select("event_id", "event_type")


@query("F21_drill_boolean", f"WITH {RAW_SQL} SELECT event_id, kind FROM raw WHERE lower(flag) IN ('no', 'false')")
def drill_boolean(t):
    # The click is on the "false" slice of the flags, however they are spelled.
    table = raw_events(t)
    slice_ = lf.chart_series(table, "flag", kind="pie").filter("name = 'false'").first()
    return lf.filter_all(table, [lf.from_category("flag", "boolean", slice_["name"])]).select("event_id", "kind")


@query("F21_drill_blank_field", f"WITH {SPARSE_SQL} SELECT event_id, value FROM sparse WHERE event_type IS NULL AND value = (SELECT value FROM sparse WHERE event_type IS NULL AND value IS NOT NULL ORDER BY event_id LIMIT 1)")
def drill_blank_field(t):
    # Two fields of one row: a blank one and a number.
    table = sparse_events(t)
    row = lf.top_k(lf.with_row_id(lf.filter_all(table, [("event_type", "isEmpty"), ("value", "isNotEmpty")]), "event_id"), [("event_id", "asc")], 1).first()
    conditions = [lf.from_field("event_type", "string", row["event_type"]), lf.from_field("value", "number", repr(row["value"]))]
    return lf.filter_all(table, conditions).select("event_id", "value")
