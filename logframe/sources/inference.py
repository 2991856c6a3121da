"""Column types: inferred by vote, applied, overridden."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from logframe.functions import values
from logframe.schema import BOOLEAN, DATE, LOGICAL_TYPES, NUMBER, STRING, describe, fields_of, ref, with_types

# Fixed value: which type wins a draw.
PRECEDENCE = (STRING, NUMBER, BOOLEAN, DATE)


def type_votes(df: DataFrame, sample: int | None = None) -> DataFrame:
    """Votes and winner per raw column: ``key``, a count per type, ``type``.

    Every row votes, or the ``sample`` first ones if that is given; blank cells do not. One aggregate over one
    pass; a column without votes is a string column.
    """
    chosen = [f for f in fields_of(df) if f.is_text]
    if not chosen:
        return df.sparkSession.createDataFrame([], "key string, string bigint, number bigint, boolean bigint, date bigint, type string")
    voters = df if sample is None else df.limit(sample)
    classes = voters.select(*(values.classify(f.col).alias(f"k{i}") for i, f in enumerate(chosen)))
    counted = classes.agg(
        *(F.count_if(F.col(f"k{i}") == t).alias(f"{t}{i}") for i in range(len(chosen)) for t in PRECEDENCE)
    )
    rows = F.array(
        *(
            F.struct(F.lit(f.key).alias("key"), *(F.col(f"{t}{i}").alias(t) for t in PRECEDENCE))
            for i, f in enumerate(chosen)
        )
    )
    votes = counted.select(F.inline(rows))
    most = F.greatest(*PRECEDENCE)
    winner = F.coalesce(*(F.when((F.col(t) == most) & (most > 0), t) for t in PRECEDENCE), F.lit(STRING))
    return votes.withColumn("type", winner)


def infer_types(df: DataFrame, sample: int | None = None) -> DataFrame:
    """Give every raw column the logical type its cells vote for."""
    winners = {r["key"]: r["type"] for r in type_votes(df, sample).collect()}
    return with_types(df, winners)


def coerce(df: DataFrame, types: Mapping[str, str] | None = None) -> DataFrame:
    """Cells in their coerced form: ``007`` in a number column becomes ``7``, ``yes`` ``true``.

    Blank cells become NULL and cells that do not fit the type stay as they are.
    """
    return _as_text(with_types(df, types or {}), {f.key: f.type for f in fields_of(df)} | dict(types or {}))


def retype(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Override column types, starting from the coerced text of each cell.

    Unknown columns and columns that already have the type are left alone.
    """
    for kind in types.values():
        if kind not in LOGICAL_TYPES:
            raise ValueError(f"unknown logical type {kind!r}")
    return _as_text(df, {f.key: types[f.key] for f in fields_of(df) if types.get(f.key, f.type) != f.type})


def _as_text(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    known = {f.key: f for f in fields_of(df)}
    return df.select(
        *(
            describe(values.text(known[c]), c, types[c], known[c].name)
            if c in types and c in known and (known[c].is_text or types[c] != known[c].type)
            else ref(c)
            for c in df.columns
        )
    )


def to_typed(df: DataFrame) -> DataFrame:
    """Native Spark columns for further work; cells that do not fit their type become NULL."""
    read = {NUMBER: values.num, BOOLEAN: values.flag, DATE: values.instant, STRING: values.text}
    known = {f.key: f for f in fields_of(df)}
    return df.select(
        *(
            read[known[c].type](known[c]).alias(c, metadata={"name": known[c].name})
            if c in known and known[c].is_text
            else ref(c)
            for c in df.columns
        )
    )
