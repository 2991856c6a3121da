"""Saved views: one configuration applied to any table of the same shape."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame

from logframe.operators.aggregate import AGGREGATIONS, chart_series
from logframe.operators.columns import reconcile_columns, select_view
from logframe.operators.crosstab import crosstab
from logframe.operators.ordering import multi_sort
from logframe.operators.predicates import filter_groups
from logframe.operators.search import search
from logframe.schema import signature as fingerprint


@dataclass(frozen=True)
class View:
    """Results of a view: the filtered rows, the table shown, and the chart and cross table if any."""

    filtered: DataFrame
    table: DataFrame
    chart: DataFrame | None
    pivot: DataFrame | None


# The parts of a saved view that are read one by one: each key with its type or its possible values.
_CONDITION = {"columnKey": str, "operator": str, "value": str}
_SORT_KEY = {"columnKey": str, "direction": ("asc", "desc")}
_GROUP = {"filters": list}


def _of_shape(parts, shape: Mapping) -> list[Mapping]:
    """Those of the parts that have every key of the shape; none if it is no list."""

    def fits(part) -> bool:
        if not isinstance(part, Mapping):
            return False
        return all(part.get(k) in want if isinstance(want, tuple) else isinstance(part.get(k), want) for k, want in shape.items())

    return [p for p in parts if fits(p)] if isinstance(parts, list) else []


def filter_groups_of(spec: Mapping) -> list[list[Mapping]]:
    """Condition groups of a view; a group with a malformed condition is left out whole.

    Views without ``groups`` hold one flat list, of which the well-formed conditions count.
    """
    if isinstance(spec.get("groups"), list):
        groups = [g["filters"] for g in _of_shape(spec["groups"], _GROUP)]
        return [g for g in groups if len(_of_shape(g, _CONDITION)) == len(g)]
    flat = _of_shape(spec.get("filters"), _CONDITION)
    return [flat] if flat else []


def sort_keys_of(spec: Mapping) -> list[tuple[str, str]]:
    """Sort keys of a view, a list or a single one."""
    given = spec.get("sort")
    return [(k["columnKey"], k["direction"]) for k in _of_shape(given if isinstance(given, list) else [given], _SORT_KEY)]


def _chart(df: DataFrame, spec) -> DataFrame | None:
    if not isinstance(spec, Mapping) or not spec.get("dimensionKey"):
        return None
    agg = spec.get("aggregation")
    return chart_series(
        df,
        spec["dimensionKey"],
        agg if agg in AGGREGATIONS else "count",
        spec.get("measureKey"),
        spec.get("bucket") or "none",
        spec.get("type") or "bar",
    )


def _pivot(df: DataFrame, spec) -> DataFrame | None:
    if not isinstance(spec, Mapping) or not spec.get("rowKey") or not spec.get("colKey"):
        return None
    if spec.get("aggregation") not in ("count", "sum", "avg"):
        return None
    return crosstab(
        df,
        spec["rowKey"],
        spec["colKey"],
        spec["aggregation"],
        spec.get("measureKey"),
        spec.get("rowBucket") is True,
        spec.get("colBucket") is True,
    )


def apply_view(df: DataFrame, spec: Mapping | str) -> View:
    """Filters, then search, then sort and columns; chart and cross table use the filtered rows.

    ``spec`` is a saved view as a mapping or JSON text; missing parts are tolerated. Nothing runs
    until a result is used, but for the axes of a cross table. Cache ``filtered`` when several
    results are.
    """
    spec = json.loads(spec) if isinstance(spec, str) else spec
    filtered = filter_groups(df, filter_groups_of(spec))
    filtered = search(filtered, spec.get("query") or "", spec.get("searchRegex") is True)
    columns = spec.get("columns")
    view = reconcile_columns(df, columns if isinstance(columns, list) else [])
    shown = select_view(multi_sort(filtered, sort_keys_of(spec)), view)
    return View(filtered, shown, _chart(filtered, spec.get("chart")), _pivot(filtered, spec.get("pivot")))


def apply_to_all(tables: Mapping[str, DataFrame], spec: Mapping | str, signature: str) -> dict[str, View]:
    """One view over every table whose column keys and types have the given fingerprint."""
    return {name: apply_view(t, spec) for name, t in tables.items() if fingerprint(t) == signature}
