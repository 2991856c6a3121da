"""Visible columns, their order, and saved column lists."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame

from logframe.schema import fields_of, ref


def reconcile_columns(df: DataFrame, saved: Iterable[Mapping]) -> list[dict]:
    """Fit a saved column list to this table: known columns keep their place and visibility,
    unknown ones go, new ones are appended and visible."""
    keys = [f.key for f in fields_of(df)]
    kept = [{"key": i["key"], "visible": bool(i.get("visible", True))} for i in saved if i["key"] in keys]
    have = {i["key"] for i in kept}
    return kept + [{"key": k, "visible": True} for k in keys if k not in have]


def select_view(df: DataFrame, view: Iterable[Mapping]) -> DataFrame:
    """The visible columns in view order; unknown keys are skipped."""
    keys = {f.key for f in fields_of(df)}
    return df.select(*(ref(i["key"]) for i in view if i.get("visible", True) and i["key"] in keys))
