"""Redaction, exports and saved views."""

from __future__ import annotations

import logframe as lf
from catalog.registry import query
from catalog.tables import DEVICES_SQL, devices

_P = {k: f"(?i){v}" for k, v in lf.NAMED_PATTERNS.items()}


def _redacted(text: str) -> str:
    for id, token in (("email", "EMAIL"), ("mac", "MAC"), ("ipv6", "IP6"), ("ipv4", "IP")):
        text = f"regexp_replace({text}, '{_P[id]}', '[{token}]', 'g')"
    return text


@query("E1_redact_token", f"SELECT doc_id, {_redacted('text')} AS text, source FROM documents")
def redact_token(t):
    return lf.redact(t.documents.select("doc_id", "text", "source"))


@query("E1_redact_pages", f"SELECT page_id, url, {_redacted('html')} AS html FROM (SELECT page_id, {_redacted('url')} AS url, html FROM pages)")
def redact_pages(t):
    return lf.redact(t.pages)


def _consistent_sql(steps: list[tuple[str, str]], first: str = "t0 AS (SELECT doc_id, text FROM documents)") -> str:
    """Class after class: list the matches, number them by first appearance, weave the text anew."""
    ctes = [first]
    for i, (id, token) in enumerate(steps):
        ctes += [
            f"m{i} AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_P[id]}', 0)) AS v, "
            f"unnest(range(len(regexp_extract_all(text, '{_P[id]}', 0)))) AS place FROM t{i})",
            f"d{i} AS (SELECT v, '[{token}_' || row_number() OVER (ORDER BY min(doc_id * 1000000 + place)) || ']' AS label FROM m{i} GROUP BY v)",
            f"l{i} AS (SELECT doc_id, list(label ORDER BY place) AS labels FROM m{i} JOIN d{i} USING (v) GROUP BY doc_id)",
            f"p{i} AS (SELECT doc_id, string_split_regex(text, '{_P[id]}') AS pieces, labels FROM t{i} LEFT JOIN l{i} USING (doc_id))",
            f"t{i + 1} AS (SELECT doc_id, array_to_string([pieces[k] || coalesce(labels[k], '') for k in range(1, len(pieces) + 1)], '') AS text FROM p{i})",
        ]
    return f"WITH {', '.join(ctes)} SELECT doc_id, text FROM t{len(steps)}"


@query("E2_redact_consistent", _consistent_sql([("email", "EMAIL"), ("mac", "MAC"), ("ipv6", "IP6"), ("ipv4", "IP")]))
def redact_consistent(t):
    rows = lf.with_row_id(t.documents.select("doc_id", "text"), "doc_id")
    return lf.redact(rows, mode="consistent").select("doc_id", "text")


@query("E1_redact_devices", f"WITH {DEVICES_SQL} SELECT host, {_redacted('note')} AS note FROM devices")
def redact_devices(t):
    return lf.redact(devices(t))


@query(
    "E2_redact_devices",
    _consistent_sql([("email", "EMAIL"), ("mac", "MAC"), ("ipv6", "IP6"), ("ipv4", "IP")], f"{DEVICES_SQL}, t0 AS (SELECT host AS doc_id, note AS text FROM devices)")
    .replace("SELECT doc_id, text FROM t4", "SELECT doc_id AS host, text AS note FROM t4"),
)
def redact_devices_consistently(t):
    return lf.redact(lf.with_row_id(devices(t), "host"), mode="consistent").select("host", "note")


_VALUE = """CASE WHEN value = floor(value) THEN cast(cast(value AS bigint) AS varchar) ELSE cast(value AS varchar) END"""


@query(
    "E3_write_csv",
    f"""SELECT cast(event_id AS varchar) AS event_id, replace(cast(ts AS varchar), ' ', 'T') AS ts, cast(user_id AS varchar) AS user_id,
    event_type, {_VALUE} AS value, props FROM events""",
)
def write_csv(t):
    path = lf.scratch_dir(t.spark)
    lf.write_csv(t.events, path)
    return t.spark.read.option("header", True).option("escape", '"').csv(path)


@query(
    "E4_write_json",
    """SELECT event_id, replace(cast(ts AS varchar), ' ', 'T') AS ts, user_id, nullif(event_type, 'error') AS event_type, value, props FROM events""",
)
def write_json(t):
    path = lf.scratch_dir(t.spark)
    lf.write_json(t.events.selectExpr("event_id", "ts", "user_id", "nullif(event_type, 'error') AS event_type", "value", "props"), path)
    return t.spark.read.schema("event_id bigint, ts string, user_id bigint, event_type string, value double, props string").json(path)


_VIEW = {
    "groups": [
        {"id": "a", "filters": [{"columnKey": "value", "operator": "gte", "value": "30"}, {"columnKey": "event_type", "operator": "contains", "value": "e"}]},
        {"id": "b", "filters": [{"columnKey": "event_type", "operator": "equals", "value": "click"}]},
        {"id": "c", "filters": [{"columnKey": "value", "operator": "gt", "value": ""}]},
    ],
    "query": '"k": 4',
    "sort": {"columnKey": "value", "direction": "desc"},
    "chart": {"type": "line", "dimensionKey": "ts", "measureKey": "value", "aggregation": "sum", "bucket": "day"},
    "columns": [{"key": "value", "visible": True}, {"key": "user_id", "visible": False}, {"key": "event_id", "visible": True}],
    "pivot": {"rowKey": "event_type", "colKey": "event_type", "aggregation": "count", "measureKey": None},
}
_SHOWN = """((value >= 30 AND contains(event_type, 'e')) OR event_type = 'click') AND contains(props, '"k": 4')"""


@query("V1_apply_view", f"SELECT value, event_id, ts, event_type, props FROM events WHERE {_SHOWN}")
def apply_view(t):
    return lf.apply_view(t.events, _VIEW).table


@query(
    "V1_view_chart",
    f"SELECT strftime(ts, '%Y-%m-%d') AS name, round(sum(value), 4) AS value FROM events WHERE {_SHOWN} GROUP BY 1 ORDER BY 1 LIMIT 100",
)
def view_chart(t):
    return lf.apply_view(t.events, _VIEW).chart.selectExpr("name", "round(value, 4) AS value")


@query(
    "V1_view_pivot",
    f"""WITH k AS (SELECT event_type AS e FROM events WHERE {_SHOWN})
    SELECT a.e AS row_value, b.e AS col_value, cast((SELECT count(*) FROM k WHERE k.e = a.e AND k.e = b.e) AS double) AS value
    FROM (SELECT DISTINCT e FROM k) a CROSS JOIN (SELECT DISTINCT e FROM k) b""",
)
def view_pivot(t):
    return lf.apply_view(t.events, _VIEW).pivot.filter("level = 'cell'").select("row_value", "col_value", "value")
