"""Typed readings of a cell, as Column expressions.

Cells follow JavaScript conversion rules where a result depends on them: what counts as a number,
how a number prints, which words are booleans.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from logframe.schema import BOOLEAN, DATE, NUMBER, STRING, Field

# The words read as booleans.
TRUE_WORDS = ("true", "yes")
FALSE_WORDS = ("false", "no")

# The characters a number may be padded with.
SPACE = (
    "\t\n\u000b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)

_DECIMAL = r"^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|Infinity)$"
_RADIX = r"^0(?:[xX][0-9a-fA-F]+|[oO][0-7]+|[bB][01]+)$"
_DATE_PREFIX = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2})?"
_YEAR_FIRST = r"^\s*[+-]?[0-9]{4}"

_EXACT_INT = float(2**53)


def null() -> Column:
    return F.lit(None)


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _radix_value(t: Column) -> Column:
    """Value of a 0x / 0o / 0b literal of any length."""
    base = (
        F.when(F.lower(F.substring(t, 2, 1)) == "x", 16.0)
        .when(F.lower(F.substring(t, 2, 1)) == "o", 8.0)
        .otherwise(2.0)
    )
    digits = F.split(F.lower(F.substring(t, 3, 1 << 30)), "")
    step = lambda acc, d: acc * base + F.conv(d, 16, 10).cast("double")
    return F.aggregate(digits, F.lit(0.0), step)


def parse_number(c: Column) -> Column:
    """A string read as a number, or NULL."""
    t = trimmed(c)
    return F.when(t.rlike(_DECIMAL), t.try_cast("double")).when(t.rlike(_RADIX), outlined(t, _radix_value))


def parse_flag(c: Column) -> Column:
    word = F.lower(c)
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def parse_instant(c: Column) -> Column:
    """ISO date or date-time text as a UTC timestamp, or NULL. Bare times are not dates."""
    return F.when(c.rlike(_YEAR_FIRST), c.try_cast("timestamp"))


def number_text(c: Column) -> Column:
    """A double printed the way JavaScript prints it: ``200``, ``0.5``, ``1e+21``.

    Spark prints plain digits between 1e-3 and 1e7. The other fractions are rare and their code is
    long, so it is kept out of the generated method, which the JVM would not compile otherwise.
    """
    size = F.abs(c)
    return (
        F.when((size < _EXACT_INT) & (c == F.rint(c)), c.try_cast("bigint").cast("string"))
        .when((size >= 1e-3) & (size < 1e7), c.cast("string"))
        .otherwise(outlined(c, _long_number_text))
    )


def outlined(c: Column, build) -> Column:
    """``build(c)`` evaluated outside the generated code, for branches that are rarely taken."""
    return F.get(F.transform(F.array(c), build), F.lit(0))


def _long_number_text(c: Column) -> Column:
    raw = c.cast("string")
    size = F.abs(c)
    bare = F.replace(raw, F.lit(".0E"), F.lit("E"))
    return (
        F.when(F.isnan(c) | (size == float("inf")), raw)
        .when(size >= 1e21, F.replace(bare, F.lit("E"), F.lit("e+")))
        .when(size >= 1e7, _plain(raw, 16))
        .when(size >= 1e-6, _plain(raw, 30))
        .otherwise(F.lower(bare))
    )


def _plain(raw: Column, scale: int) -> Column:
    """Scientific notation written out, without trailing zeros."""
    return F.regexp_replace(raw.try_cast(T.DecimalType(38, scale)).cast("string"), r"\.?0+$", "")


def num(f: Field) -> Column:
    """The cell as a double; NULL when it is missing or not a number."""
    c = f.col
    if isinstance(f.stored, (T.DoubleType, T.FloatType)):
        d = c.cast("double")
        return F.when(~F.isnan(d), d)
    if isinstance(f.stored, T.NumericType):
        return c.cast("double")
    if isinstance(f.stored, T.BooleanType):
        return c.cast("double")
    if not f.is_text:
        return null().cast("double")
    if f.type == BOOLEAN:
        return F.coalesce(parse_flag(c).cast("double"), parse_number(c))
    return parse_number(c)


def flag(f: Field) -> Column:
    """The cell as a boolean; NULL unless it is a cell of a boolean column that parsed."""
    if isinstance(f.stored, T.BooleanType):
        return f.col
    if f.is_text and f.type == BOOLEAN:
        return parse_flag(f.col)
    return null().cast("boolean")


def instant(f: Field) -> Column:
    """The cell as a timestamp; NULL when it is missing or not a date."""
    if f.is_text:
        return parse_instant(f.col)
    if f.type == DATE:
        return f.col
    return null().cast("timestamp")


def text(f: Field) -> Column:
    """The cell as text after coercion: ``007`` in a number column prints ``7``."""
    c = f.col
    if f.is_text:
        c = blank_to_null(c)
        if f.type == NUMBER:
            return F.coalesce(number_text(parse_number(c)), c)
        if f.type == BOOLEAN:
            return F.coalesce(parse_flag(c).cast("string"), c)
        return c
    return native_text(c, f.stored)


def native_text(c: Column, stored: T.DataType) -> Column:
    """Text of a value of a native Spark type."""
    if isinstance(stored, (T.DoubleType, T.FloatType)):
        return number_text(c.cast("double"))
    if isinstance(stored, T.DecimalType):
        s = c.cast("string")
        return F.when(F.contains(s, F.lit(".")), F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)
    if isinstance(stored, (T.TimestampType, T.TimestampNTZType)):
        return F.translate(c.cast("string"), " ", "T")
    return c.cast("string")


def group_key(f: Field) -> tuple[Column, bool]:
    """The cheapest column with one value per distinct ``text(f)``, and whether it is native.

    Native values group as they are and are printed after the aggregation, once per group.
    """
    if f.is_text:
        return text(f), False
    return f.col, True


def is_blank(f: Field) -> Column:
    return f.col.isNull() | (f.col == "") if f.is_text else f.col.isNull()


def is_unparsed_text(f: Field) -> Column | None:
    """Where a raw cell is still a string after coercion; None when every cell is one."""
    if f.type == NUMBER:
        return parse_number(f.col).isNull()
    if f.type == BOOLEAN:
        return parse_flag(f.col).isNull()
    return None


def classify(c: Column) -> Column:
    """The logical type one raw cell votes for; NULL for a blank cell, which does not vote."""
    t = trimmed(c)
    return (
        F.when(t == "", null())
        .when(F.lower(t).isin(*TRUE_WORDS, *FALSE_WORDS), BOOLEAN)
        .when((t.rlike(_DECIMAL) & t.rlike("[0-9]")) | t.rlike(_RADIX), NUMBER)
        .when(t.rlike(_DATE_PREFIX), DATE)
        .when(t.isNotNull(), STRING)
    )


def natural_key(c: Column) -> Column:
    """Sort key under which text orders by locale and embedded numbers by value.

    Every digit run becomes its length (without leading zeros) followed by its digits, so
    ``item2`` precedes ``item10``; the root collation orders the rest.
    """
    bare = lambda run: F.ltrim(run, F.lit("0"))
    sized = F.transform(
        F.regexp_extract_all(c, F.lit("[0-9]+|[^0-9]+"), F.lit(0)),
        lambda run: F.when(
            run.rlike("^[0-9]"),
            F.concat(F.lpad(F.length(bare(run)).cast("string"), 10, "0"), bare(run)),
        ).otherwise(run),
    )
    key = F.when(c.rlike("[0-9]"), F.array_join(sized, "")).otherwise(c)
    return F.collate(key, "UNICODE")
