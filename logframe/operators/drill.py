"""Conditions built from a result: a histogram bin, a category, a cross-table cell, a field."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Row

from logframe.operators.predicates import Condition
from logframe.schema import BOOLEAN


def _number(x: float) -> str:
    return str(int(x)) if float(x).is_integer() else repr(float(x))


def from_range(key: str, low: float, high: float) -> Condition:
    """Values of a bin or bucket; both ends are included, so an edge value meets two bins."""
    return Condition(key, "between", _number(low), _number(high))


def from_category(key: str, type: str, value: str) -> Condition:
    """One category; booleans have their own operators."""
    if type == BOOLEAN:
        return Condition(key, "isTrue" if value == "true" else "isFalse")
    return Condition(key, "equals", value)


def from_field(key: str, type: str, value: str | None) -> Condition:
    """One field of a row; a blank one looks for blanks."""
    return Condition(key, "isEmpty") if value in (None, "") else from_category(key, type, value)


def from_cell(cell: Row | Mapping, row_key: str, row_type: str, col_key: str, col_type: str) -> list[Condition]:
    """Both conditions of a cross-table cell. A collected ``(others)`` cell has none."""
    cell = cell.asDict() if isinstance(cell, Row) else cell
    if cell.get("row_others") or cell.get("col_others"):
        return []
    out = []
    for side, key, type in (("row", row_key, row_type), ("col", col_key, col_type)):
        if cell.get(f"{side}_low") is not None:
            out.append(from_range(key, cell[f"{side}_low"], cell[f"{side}_high"]))
        else:
            out.append(from_category(key, type, cell[f"{side}_value"]))
    return out


def narrow(groups: list[list], conditions: list[Condition]) -> list[list]:
    """Add conditions to the first group, or start one."""
    if not groups:
        return [list(conditions)]
    return [[*groups[0], *conditions], *groups[1:]]
