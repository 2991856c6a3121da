"""Regular expressions: the named patterns, and JavaScript syntax carried over to Java's engine."""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession, functions as F

# The named search patterns (JavaScript syntax, matched without case).
NAMED_PATTERNS = {
    "ipv4": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "ipv6": r"\b(?:[0-9a-f]{1,4}:){2,7}[0-9a-f]{1,4}\b",
    "mac": r"\b(?:[0-9a-f]{2}[:-]){5}[0-9a-f]{2}\b",
    "email": r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b",
    "http-err": r"\b[45]\d{2}\b",
    "uuid": r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b",
}

# Characters of which every match of a pattern holds one; a cell without any is not searched.
_REQUIRED = {"ipv4": ".", "ipv6": ":", "mac": ":-", "email": "@", "uuid": "-"}

# Patterns that start and end in a word character.
_WORD_TO_WORD = frozenset({"ipv4", "ipv6", "mac", "http-err", "uuid"})

# Named patterns that a printed number can match; the others need characters no number has.
NUMERIC_PATTERNS = frozenset({"http-err"})

# JavaScript's \b, \s, `.`, `^` and `$` differ from Java's: words are ASCII, spaces are Unicode,
# and `$` does not stand before a final line break.
_BOUNDARY = r"(?:(?=\w)(?<!\w)|(?!\w)(?<=\w))"
_NO_BOUNDARY = r"(?:(?=\w)(?<=\w)|(?!\w)(?<!\w))"
_WIDE_SPACES = r"\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_SPACES = r"\s" + _WIDE_SPACES
# The same with ASCII decided first, which is what most text is.
_SPACE = rf"[\s[[^\x00-\x7f]&&[{_WIDE_SPACES}]]]"
_NO_SPACE = rf"[\x21-\x7e[^{_SPACES}]]"
_BREAKS = r"\n\r\u2028\u2029"
_QUANTIFIER = re.compile(r"\{\d+(?:,\d*)?\}")
_NAMED_GROUP = re.compile(r"\(\?<([A-Za-z_$][\w$]*)>")
_KNOWN_ESCAPES = set("dDwWfnrtvxu") | set("0123456789")


class PatternError(ValueError):
    """The pattern cannot be used."""


@dataclass(frozen=True)
class Pattern:
    """A pattern in Java syntax, with the number of each named group."""

    java: str
    groups: dict[str, int]


def translate(source: str, flags: str = "") -> Pattern:
    """Carry a JavaScript pattern over to Java syntax.

    Named groups become plain ones, because Java group names allow fewer characters.
    """
    multiline, dot_all = "m" in flags, "s" in flags
    names = _group_numbers(source)
    out: list[str] = []
    i, in_class = 0, False
    while i < len(source):
        ch = source[i]
        if ch == "\\":
            piece, i = _escape(source, i, in_class, names)
            out.append(piece)
            continue
        if in_class:
            in_class = ch != "]"
            out.append("\\" + ch if ch in "[&" else ch)
        elif ch == "[":
            if source.startswith("[^]", i):
                out.append(r"[\s\S]")
                i += 3
                continue
            if source.startswith("[]", i):
                out.append("(?!)")
                i += 2
                continue
            in_class = True
            out.append(ch)
            if source[i + 1 : i + 2] == "^":
                out.append("^")
                i += 1
        elif ch == "(" and (m := _NAMED_GROUP.match(source, i)):
            out.append("(")
            i = m.end()
            continue
        elif ch == ".":
            out.append(r"[\s\S]" if dot_all else f"[^{_BREAKS}]")
        elif ch == "^":
            out.append(rf"(?:\A|(?<=[{_BREAKS}]))" if multiline else r"\A")
        elif ch == "$":
            out.append(rf"(?:\z|(?=[{_BREAKS}]))" if multiline else r"\z")
        elif ch == "{" and not _QUANTIFIER.match(source, i):
            out.append(r"\{")
        elif ch == "+" and re.search(r"(?<!\\)(?:[*+?]|\{\d+(?:,\d*)?\})$", source[:i]):
            raise PatternError("nothing to repeat")
        else:
            out.append(ch)
        i += 1
    if in_class:
        raise PatternError("unterminated character class")
    prefix = "(?iu)" if "i" in flags else ""
    return Pattern(prefix + "".join(out), names)


def _group_numbers(source: str) -> dict[str, int]:
    """First number of every named group, counting all capturing groups in source order."""
    numbers: dict[str, int] = {}
    count, i, in_class = 0, 0, False
    while i < len(source):
        ch = source[i]
        if ch == "\\":
            i += 2
            continue
        if in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
        elif ch == "(":
            named = _NAMED_GROUP.match(source, i)
            if named or source[i + 1 : i + 2] != "?":
                count += 1
            if named:
                if named[1] in numbers:
                    raise PatternError(f"duplicate group name {named[1]!r}")
                numbers[named[1]] = count
        i += 1
    return numbers


def _escape(source: str, i: int, in_class: bool, names: dict[str, int]) -> tuple[str, int]:
    """Translate the escape that starts at ``i``; returns it and the position after it."""
    if i + 1 >= len(source):
        raise PatternError("pattern ends in a backslash")
    ch = source[i + 1]
    after = i + 2
    if ch == "b":
        return (r"\x08" if in_class else _BOUNDARY), after
    if ch == "B" and not in_class:
        return _NO_BOUNDARY, after
    if ch == "s":
        return (_SPACES if in_class else _SPACE), after
    if ch == "S":
        return (f"[^{_SPACES}]" if in_class else _NO_SPACE), after
    if ch == "k" and (m := re.compile(r"<([^>]+)>").match(source, after)):
        if m[1] not in names:
            raise PatternError(f"unknown group {m[1]!r}")
        return f"\\{names[m[1]]}", m.end()
    if ch == "0":
        return r"\x00", after
    if ch == "v":
        return r"\x0B", after
    if ch == "c":
        return source[i : i + 3], i + 3
    if ch.isascii() and ch.isalpha() and ch not in _KNOWN_ESCAPES:
        return ch, after
    return "\\" + ch, after


def is_valid(spark: SparkSession, java: str) -> bool:
    """Whether Java's engine, which Spark matches with, accepts the pattern; no query is planned for that."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(java)
        return True
    except IllegalArgumentException:
        return False


def named(id: str) -> str:
    """A named pattern in Java syntax.

    Between word characters at both ends ``\\b`` is one look to either side, which is cheaper.
    """
    source = NAMED_PATTERNS[id]
    if id in _WORD_TO_WORD:
        return rf"(?i)(?<!\w){source[2:-2]}(?!\w)"
    return "(?i)" + translate(source).java


def _may_match(c: Column, id: str) -> Column:
    held = [F.contains(c, F.lit(sign)) for sign in _REQUIRED[id]]
    return functools.reduce(Column.__or__, held)


def has_match(c: Column, id: str) -> Column:
    """Whether a named pattern occurs in a cell; false for a missing one."""
    found = c.rlike(named(id))
    if id in _REQUIRED:
        found = _may_match(c, id) & found
    return F.coalesce(found, F.lit(False))


def replaced(c: Column, id: str, by: str) -> Column:
    """Every occurrence of a named pattern replaced."""
    out = F.regexp_replace(c, named(id), by)
    return F.when(_may_match(c, id), out).otherwise(c) if id in _REQUIRED else out


def matches(c: Column, java: str, id: str | None = None) -> Column:
    """Every occurrence, in order; ``id`` names the pattern when it is a named one."""
    found = F.regexp_extract_all(c, F.lit(java), F.lit(0))
    none = F.array().cast("array<string>")
    if id in _REQUIRED:
        return F.when(_may_match(c, id), found).otherwise(none)
    return F.coalesce(found, none)
