"""Search and extraction over all columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

from logframe.functions import patterns, values
from logframe.operators.predicates import contains_text
from logframe.schema import BOOLEAN, DATE, NUMBER, Field, any_of, fields_of

# What the text of a native column can be made of. A query with anything else cannot occur in it,
# so that column is neither printed nor read.
_NATIVE_TEXT = {
    NUMBER: re.compile(r"[-+0-9.e]*|-?[infty]*"),
    DATE: re.compile(r"[-+0-9.:t]*"),
    BOOLEAN: re.compile(r"[truefals]*"),
}


def _may_contain(f: Field, needle: str) -> bool:
    return f.is_text or _NATIVE_TEXT[f.type].fullmatch(needle) is not None


def search_condition(df: DataFrame, query: str) -> Column | None:
    needle = query.strip().lower()
    if not needle:
        return None
    hits = any_of(contains_text(f, needle) for f in fields_of(df) if _may_contain(f, needle))
    return F.lit(False) if hits is None else hits


def regex_condition(df: DataFrame, query: str) -> Column | None:
    if not query.strip():
        return None
    try:
        java = patterns.translate(query, "i").java
    except patterns.PatternError:
        return None
    if not patterns.is_valid(df.sparkSession, java):
        return None
    hits = any_of(values.text(f).rlike(java) for f in fields_of(df))
    return F.lit(False) if hits is None else hits


def _searched(df: DataFrame, skip_numbers: bool) -> list[Field]:
    return [
        f
        for f in fields_of(df)
        if not (skip_numbers and isinstance(f.stored, (T.NumericType, T.BooleanType)))
    ]


def search(df: DataFrame, query: str, regex: bool = False) -> DataFrame:
    """Rows in which any cell contains the query, without case.

    A blank query and an invalid regular expression leave the table as it is.
    """
    cond = regex_condition(df, query) if regex else search_condition(df, query)
    return df if cond is None else df.filter(cond)


def quick_pattern(df: DataFrame, id: str) -> DataFrame:
    """Rows in which any cell matches a named pattern."""
    cells = _searched(df, skip_numbers=id not in patterns.NUMERIC_PATTERNS)
    hits = any_of(patterns.has_match(values.text(f), id) for f in cells)
    return df.filter(F.lit(False) if hits is None else hits)


def extract_matches(df: DataFrame, pattern: str, limit: int | None = None) -> DataFrame:
    """Every occurrence of a pattern in every cell, as distinct value and count.

    ``pattern`` is a named pattern or a regular expression. An invalid one gives no rows.
    """
    known = pattern in patterns.NAMED_PATTERNS
    skip = known and pattern not in patterns.NUMERIC_PATTERNS
    try:
        java = patterns.named(pattern) if known else patterns.translate(pattern, "i").java
        valid = patterns.is_valid(df.sparkSession, java)
    except patterns.PatternError:
        valid = False
    cells = [values.text(f) for f in _searched(df, skip)] if valid else []
    if not cells:
        return df.sparkSession.createDataFrame([], "value string, count bigint")
    found = F.flatten(F.array(*(patterns.matches(c, java, pattern) for c in cells)))
    # The outer form, because explode would evaluate its input a second time to drop empty arrays.
    values_ = df.select(F.explode_outer(found).alias("value")).filter("value is not null")
    counts = values_.groupBy("value").agg(F.count("*").alias("count"))
    ordered = counts.orderBy(F.desc("count"), F.collate("value", "UNICODE"), "value")
    return ordered if limit is None else ordered.limit(limit)
