"""Exports of the current view, in its row and column order."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from logframe.functions import values
from logframe.operators.redact import redact
from logframe.schema import BOOLEAN, DATE, NUMBER, Field, fields_of


# Spark trims cells on writing unless told not to.
_AS_IS = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _names(df: DataFrame, unique: bool) -> dict[str, str]:
    """Header per column: the original one, or the key where headers would clash."""
    names = {f.key: f.name for f in fields_of(df)}
    lowered = [n.lower() for n in names.values()]
    return {k: k if unique and lowered.count(n.lower()) > 1 else n for k, n in names.items()}


def write_csv(
    df: DataFrame, path: str, redact_classes: Iterable[str] | None = (), redact_mode: str = "token", mode: str = "errorifexists"
) -> None:
    """CSV with the original headers, raw numbers, blanks as nothing, and quotes where needed.

    A sorted table is written in sorted parts, so the parts in name order keep its order.
    """
    out = _export(df, redact_classes, redact_mode)
    shown = out.select(*(values.text(f).alias(f.key) for f in fields_of(out)))
    named = shown.toDF(*_names(out, unique=False).values())
    named.write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "").options(**_AS_IS).csv(path)


def write_json(
    df: DataFrame, path: str, redact_classes: Iterable[str] | None = (), redact_mode: str = "token", mode: str = "errorifexists"
) -> None:
    """One JSON object per line, keyed by header, with NULLs kept.

    Raw number and boolean columns are written cell by cell as a variant: a number or boolean
    where the cell is one, its text where it is not.
    """
    out = _export(df, redact_classes, redact_mode)
    shown = out.select(*(_json_cell(f).alias(f.key) for f in fields_of(out)))
    named = shown.toDF(*_names(out, unique=True).values())
    named.write.mode(mode).option("ignoreNullFields", False).json(path)


def _json_cell(f: Field) -> Column:
    if not f.is_text:
        return values.text(f) if f.type == DATE else f.col
    shown = values.text(f)
    typed = {NUMBER: F.abs(values.num(f)) < float("inf"), BOOLEAN: values.flag(f).isNotNull()}.get(f.type)
    if typed is None:
        return shown
    return F.when(typed, F.try_parse_json(shown)).otherwise(shown.cast(T.VariantType()))


def _export(df: DataFrame, classes: Iterable[str] | None, mode: str) -> DataFrame:
    chosen = None if classes is None else list(classes)
    return df if chosen == [] else redact(df, chosen, mode)
