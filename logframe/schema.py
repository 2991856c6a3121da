"""Logical column types carried in DataFrame field metadata.

A table is an ordinary DataFrame. Text-sourced columns stay raw strings and carry their logical
type (``string``, ``number``, ``boolean`` or ``date``) and original header in the field metadata;
columns with a native Spark type get the logical type from it. Spark keeps the metadata through
select, filter, sort and union, so no wrapper object is needed.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

STRING, NUMBER, BOOLEAN, DATE = "string", "number", "boolean", "date"
LOGICAL_TYPES = (STRING, NUMBER, BOOLEAN, DATE)

ROW_ID = "_row_id"
FILE = "_file"
BAD_RECORD = "_bad_record"
#: How many cells more (or fewer, below 0) than its header a bad record has.
SURPLUS = "_surplus"
_INTERNAL = {ROW_ID, FILE, BAD_RECORD, SURPLUS}

_DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)


@dataclass(frozen=True)
class Field:
    key: str
    name: str
    type: str
    stored: T.DataType

    @property
    def col(self) -> Column:
        return ref(self.key)

    @property
    def is_text(self) -> bool:
        """True when the column holds raw strings, whatever its logical type."""
        return isinstance(self.stored, T.StringType)


def ref(key: str) -> Column:
    """Column by exact name, also when the name holds dots or backticks."""
    return F.col("`" + key.replace("`", "``") + "`")


def _logical_type(field: T.StructField) -> str | None:
    stored = field.dataType
    if isinstance(stored, T.StringType):
        return field.metadata.get("logical_type", STRING)
    if isinstance(stored, T.NumericType):
        return NUMBER
    if isinstance(stored, T.BooleanType):
        return BOOLEAN
    if isinstance(stored, _DATES):
        return DATE
    return None


def fields_of(df: DataFrame) -> list[Field]:
    """The user-visible columns; nested and binary columns have no logical type and are left out."""
    out = []
    for f in df.schema.fields:
        kind = _logical_type(f)
        if f.name not in _INTERNAL and kind is not None:
            out.append(Field(f.name, f.metadata.get("name", f.name), kind, f.dataType))
    return out


def field_of(df: DataFrame, key: str) -> Field | None:
    return next((f for f in fields_of(df) if f.key == key), None)


def signature(df: DataFrame) -> str:
    """Fingerprint of a table's shape; saved views fit every table with the same one."""
    return "|".join(f"{f.key}:{f.type}" for f in fields_of(df))


def describe(column: Column, key: str, type: str, name: str | None = None) -> Column:
    """Alias a raw string column with its logical type and header."""
    return column.alias(key, metadata={"name": name or key, "logical_type": type})


def with_types(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Set the logical type of raw string columns; values and other columns are untouched."""
    known = {f.key: f for f in fields_of(df)}
    for kind in types.values():
        if kind not in LOGICAL_TYPES:
            raise ValueError(f"unknown logical type {kind!r}")
    return df.select(
        *(
            describe(ref(c), c, types[c], known[c].name)
            if c in types and c in known and known[c].is_text
            else ref(c)
            for c in df.columns
        )
    )


def with_row_id(df: DataFrame, order: str | None = None) -> DataFrame:
    """Add ``_row_id``, the original row position that ties and "first appearance" refer to.

    ``order`` names an existing column that already orders the rows; prefer it for columnar tables,
    because it is deterministic and lets filters be pushed to the scan. Without it the rows are
    numbered in scan order, which for one text file is file order; number a table where it is
    read, because after a shuffle the order of rows is not fixed.
    """
    return df.withColumn(ROW_ID, ref(order) if order else F.monotonically_increasing_id())


def has_row_id(df: DataFrame) -> bool:
    return ROW_ID in df.columns


def all_of(parts: Iterable[Column]) -> Column | None:
    out = None
    for p in parts:
        out = p if out is None else out & p
    return out


def any_of(parts: Iterable[Column]) -> Column | None:
    out = None
    for p in parts:
        out = p if out is None else out | p
    return out
