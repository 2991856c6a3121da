"""Type-aware conditions compiled to boolean Columns, and their AND/OR groups.

Positive conditions may evaluate to NULL where a cell is missing; a filter drops such rows, so no
``coalesce`` hides the bare comparison from the scan. Negated conditions keep missing cells and
say so explicitly.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, functions as F, types as T

from logframe.functions import dates, values
from logframe.schema import BOOLEAN, DATE, NUMBER, STRING, Field, all_of, any_of, fields_of


@dataclass(frozen=True)
class Operator:
    operands: int
    types: tuple[str, ...]


# The condition operators, their operand counts and the types they are offered for.
OPERATORS = {
    "contains": Operator(1, (STRING, DATE)),
    "notContains": Operator(1, (STRING, DATE)),
    "equals": Operator(1, (STRING, NUMBER, DATE)),
    "notEquals": Operator(1, (STRING, NUMBER, DATE)),
    "gt": Operator(1, (NUMBER, DATE)),
    "gte": Operator(1, (NUMBER, DATE)),
    "lt": Operator(1, (NUMBER, DATE)),
    "lte": Operator(1, (NUMBER, DATE)),
    "between": Operator(2, (NUMBER, DATE)),
    "isTrue": Operator(0, (BOOLEAN,)),
    "isFalse": Operator(0, (BOOLEAN,)),
    "isEmpty": Operator(0, (STRING, NUMBER, BOOLEAN, DATE)),
    "isNotEmpty": Operator(0, (STRING, NUMBER, BOOLEAN, DATE)),
}


def operators_for(type: str) -> list[str]:
    """Operators offered for a logical type."""
    return [name for name, op in OPERATORS.items() if type in op.types]


@dataclass(frozen=True)
class Condition:
    key: str
    op: str
    value: str = ""
    value2: str = ""

    @property
    def complete(self) -> bool:
        """Whether every operand the operator needs is there; incomplete conditions are ignored."""
        meta = OPERATORS.get(self.op)
        if meta is None:
            return False
        return all(v.strip() for v in (self.value, self.value2)[: meta.operands])

    @classmethod
    def of(cls, spec: "Condition | Mapping | Sequence") -> "Condition":
        """From a saved-view mapping, a (key, op, value, value2) sequence, or a Condition."""
        if isinstance(spec, Condition):
            return spec
        if isinstance(spec, Mapping):
            key = spec.get("columnKey", spec.get("key", ""))
            op = spec.get("operator", spec.get("op", ""))
            given = ("" if v is None else str(v) for v in (spec.get("value"), spec.get("value2")))
            return cls(key, op, *given)
        return cls(*(str(p) for p in spec))


def condition(df: DataFrame, spec) -> Column | None:
    """The condition as a Column, or None when it is incomplete or names an unknown column."""
    c = Condition.of(spec)
    if not c.complete:
        return None
    field = next((f for f in fields_of(df) if f.key == c.key), None)
    return None if field is None else _compile(field, c)


def filter_all(df: DataFrame, conditions: Iterable) -> DataFrame:
    """Rows that meet every complete condition."""
    cond = _all(df, conditions)
    return df if cond is None else df.filter(cond)


def filter_groups(df: DataFrame, groups: Iterable[Iterable]) -> DataFrame:
    """Rows that meet any group; a group is met when all its conditions are.

    Groups without a complete condition are ignored, and with none left every row passes.
    """
    compiled = (_all(df, g) for g in groups)
    cond = any_of(c for c in compiled if c is not None)
    return df if cond is None else df.filter(cond)


def _all(df: DataFrame, conditions: Iterable) -> Column | None:
    return all_of(c for c in (condition(df, s) for s in conditions) if c is not None)


def _compile(f: Field, c: Condition) -> Column:
    match c.op:
        case "isEmpty":
            return values.is_blank(f)
        case "isNotEmpty":
            return ~values.is_blank(f)
        case "isTrue":
            return values.flag(f)
        case "isFalse":
            return ~values.flag(f)
        case "contains":
            return contains_text(f, c.value)
        case "notContains":
            return values.is_blank(f) | ~contains_text(f, c.value)
        case "equals":
            return _equals(f, c.value)
        case "notEquals":
            return ~F.coalesce(_equals(f, c.value), F.lit(False)) if f.is_text else _not_equals(f, c.value)
        case "between":
            return _between(f, c.value, c.value2)
        case _:
            return _compare(f, c.op, c.value)


def contains_text(f: Field, needle: str) -> Column:
    """Literal substring without case."""
    cell = f.col if f.is_text and f.type in (STRING, DATE) else values.text(f)
    wanted = needle.lower()
    # Without a letter in it there is no case to ignore.
    caseless = wanted == needle.upper()
    return F.contains(cell if caseless else F.lower(cell), F.lit(wanted))


# --- equality -------------------------------------------------------------------------------


def _equals(f: Field, raw: str) -> Column:
    if f.type == NUMBER:
        n = parse_operand(raw)
        if n is None:
            return F.lit(False)
        return _number_test(f, "eq", n)
    if f.type == DATE and not f.is_text:
        at = dates.parse_iso(raw)
        return F.lit(False) if at is None else f.col == _date_literal(f, at)
    if isinstance(f.stored, T.BooleanType):
        return {"true": f.col, "false": ~f.col}.get(raw.lower(), F.lit(False))
    return F.lower(values.text(f)) == raw.lower()


def _not_equals(f: Field, raw: str) -> Column:
    """Negated equality of a native column, as a null-safe comparison the scan understands."""
    if f.type == NUMBER:
        n = parse_operand(raw)
        exact = None if n is None else _literal(f, n)
        return F.lit(True) if exact is None else ~f.col.eqNullSafe(exact)
    if f.type == DATE:
        at = dates.parse_iso(raw)
        return F.lit(True) if at is None else ~f.col.eqNullSafe(_date_literal(f, at))
    return ~F.coalesce(_equals(f, raw), F.lit(False))


# --- order ----------------------------------------------------------------------------------

_TESTS = {
    "eq": lambda c, v: c == v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
}


def _compare(f: Field, op: str, raw: str) -> Column:
    if f.type == DATE:
        at = dates.parse_iso(raw)
        return F.lit(True) if at is None else _TESTS[op](values.instant(f), _date_literal(f, at))
    n = parse_operand(raw)
    return F.lit(True) if n is None else _number_test(f, op, n)


def _between(f: Field, raw1: str, raw2: str) -> Column:
    if f.type == DATE:
        ends = [dates.parse_iso(r) for r in (raw1, raw2)]
        if None in ends:
            return F.lit(True)
        low, high = (_date_literal(f, e) for e in sorted(ends))
        return values.instant(f).between(low, high)
    ends = [parse_operand(r) for r in (raw1, raw2)]
    if None in ends:
        return F.lit(True)
    low, high = sorted(ends)
    return _number_test(f, "gte", low) & _number_test(f, "lte", high)


def parse_operand(raw: str) -> float | None:
    """A numeric operand, or None; accepts what a cell accepts."""
    t = raw.strip(values.SPACE)
    radix = {"0x": 16, "0o": 8, "0b": 2}.get(t[:2].lower())
    try:
        if radix:
            return float(int(t[2:], radix))
        if t.lstrip("+-").lower().startswith(("inf", "nan")) or "_" in t:
            return {"Infinity": math.inf, "+Infinity": math.inf, "-Infinity": -math.inf}.get(t)
        return float(t)
    except (ValueError, OverflowError):
        return None


def _literal(f: Field, n: float) -> Column | None:
    """``n`` as a literal of the column's own type, or None when the column cannot hold it."""
    if isinstance(f.stored, T.IntegralType):
        limit = {"byte": 7, "short": 15, "integer": 31}.get(f.stored.typeName(), 63)
        if not math.isfinite(n) or n != math.floor(n) or not -(2**limit) <= n < 2**limit:
            return None
        return F.lit(int(n)).cast(f.stored)
    return F.lit(n)


def _number_test(f: Field, op: str, n: float) -> Column:
    """Numeric comparison on the bare column where the storage allows, so the scan can skip data."""
    if isinstance(f.stored, T.IntegralType):
        exact = _literal(f, n)
        if exact is not None:
            return _TESTS[op](f.col, exact)
        if op == "eq":
            return F.lit(False)
        # No value of the column equals n: compare with the next whole number towards the test.
        if math.isfinite(n) and abs(n) < 2**53:
            if op in ("gt", "gte"):
                return f.col >= _literal_or_wide(f, math.ceil(n))
            return f.col <= _literal_or_wide(f, math.floor(n))
        passes = (n > 0) == (op in ("lt", "lte"))
        return f.col.isNotNull() if passes else F.lit(False)
    if isinstance(f.stored, (T.DoubleType, T.FloatType)):
        test = _TESTS[op](f.col, F.lit(n))
        # NaN is no number here, but Spark orders it above every number.
        return test & ~F.isnan(f.col) if op in ("gt", "gte") else test
    return _TESTS[op](values.num(f), F.lit(n))


def _literal_or_wide(f: Field, n: int) -> Column:
    exact = _literal(f, n)
    return F.lit(n).cast("bigint") if exact is None else exact


def _date_literal(f: Field, at: datetime) -> Column:
    if isinstance(f.stored, T.TimestampNTZType):
        return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")
    if isinstance(f.stored, T.DateType) and at.time() == datetime.min.time():
        return F.lit(date(at.year, at.month, at.day))
    return F.lit(at.isoformat(sep=" ") + "+00:00").cast("timestamp")
