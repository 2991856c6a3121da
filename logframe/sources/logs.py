"""Log lines parsed with a named-group pattern."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logframe.functions import patterns, values
from logframe.schema import FILE, ROW_ID, describe
from logframe.sources import files

# Ready patterns and the snippets patterns are put together from.
TEMPLATES = {
    "access": r'^(?<ip>\S+) \S+ \S+ \[(?<time>[^\]]+)\] "(?<request>[^"]*)" (?<status>\d+) (?<bytes>\S+)'
    r'(?: "(?<referer>[^"]*)" "(?<agent>[^"]*)")?',
    "syslog": r"^(?<time>\w{3}\s+\d+ \d{2}:\d{2}:\d{2}) (?<host>\S+) (?<process>[^:]+): (?<message>.*)$",
    "app": r"^(?<time>\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}[.,\d]*)\s+(?<level>[A-Z]+)\s+(?<message>.*)$",
}
SNIPPETS = {
    "timestamp": r"(?<timestamp>\S+)",
    "level": r"(?<level>[A-Z]+)",
    "component": r"(?<component>\S+)",
    "message": r"(?<message>.*)",
    "ip": r"(?<ip>\S+)",
    "status": r"(?<status>\d+)",
}
ALLOWED_FLAGS = "imsu"


class NoMatch(ValueError):
    """A pattern that matches no line of a log."""


@dataclass(frozen=True)
class LogPattern:
    java: str
    groups: dict[str, int]

    @property
    def fields(self) -> list[str]:
        return list(self.groups)


def compile_pattern(spark: SparkSession, pattern: str, flags: str = "") -> LogPattern:
    """A template name or a pattern with named groups; the groups become columns in their order."""
    source = TEMPLATES.get(pattern, pattern)
    translated = patterns.translate(source, "".join(f for f in flags if f in ALLOWED_FLAGS))
    if not translated.groups:
        raise patterns.PatternError("the pattern has no named group such as (?<message>.*)")
    if not patterns.is_valid(spark, translated.java):
        raise patterns.PatternError(f"invalid pattern: {source}")
    return LogPattern(translated.java, translated.groups)


def read_lines(spark: SparkSession, paths: str | Sequence[str], encoding: str | None = None) -> DataFrame:
    """Lines of text files, decoded, with file name and position (file as given, place in the file).

    The encoding is detected per file unless it is given, which saves a pass.
    """
    names = [paths] if isinstance(paths, str) else list(paths)
    files.check_extensions(names)
    if encoding is None:
        found = files.detect_encodings(files.lines_of(spark, names)).select("file", "size", "encoding").collect()
        kinds: dict[str, list[str]] = {}
        for r in found:
            kinds.setdefault(r["encoding"], []).append(unquote(r["file"]))
        sizes = [(r["file"], r["size"]) for r in found]
        kinds = {e: names for e in kinds} if len(kinds) == 1 else kinds
    else:
        kinds, sizes = {encoding: names}, files.listing(spark, names)
    if not kinds:
        return spark.createDataFrame([], f"{ROW_ID} bigint, {FILE} string, value string")
    positions = files.Positions(spark, files.in_order(sizes, names))
    marks = [F.col("_metadata.file_name").alias(FILE), *positions.marks()]
    parts = [positions.number(decoded(spark.read, p, e, *marks), ROW_ID) for e, p in sorted(kinds.items())]
    return reduce(DataFrame.union, (p.select(ROW_ID, FILE, "value") for p in parts))


def decoded(reader, paths: str | list[str], encoding: str, *more: Column) -> DataFrame:
    """``value``, the lines that a batch or stream reader finds, decoded, and further columns of the source."""
    reader = reader.option("pathGlobFilter", "*{" + ",".join(files.EXTENSIONS) + "}")
    if encoding.lower().startswith("utf-16"):
        # The CSV reader decodes UTF-16 and splits it; a separator no text holds keeps lines whole.
        reader = reader.option("encoding", encoding.upper()).option("lineSep", "\n").option("sep", "\u0001")
        raw = reader.option("quote", "").schema("value string").csv(paths)
        return raw.select(F.regexp_replace("value", "\r$", "").alias("value"), *more)
    value = F.regexp_replace("value", "^\ufeff", "") if encoding.lower() == "utf-8" else _windows(F.col("value"))
    return reader.text(paths).select(value.alias("value"), *more)


def _windows(value: Column) -> Column:
    return files.decoded(F.decode(value.cast("binary"), "ISO-8859-1"), "windows-1252")


def _line(value: Column) -> Column:
    """The line without the carriage return a Windows line end leaves."""
    return F.when(F.endswith(value, F.lit("\r")), F.left(value, F.length(value) - 1)).otherwise(value)


# Stands between the groups of a match while they are one string.
_MARK = "\u001f"


def _groups(line: Column, compiled: LogPattern) -> Column:
    """All groups of the first match as an array, from one run of the pattern over the line.

    A line that holds the mark itself takes one run per group instead.
    """
    numbers = compiled.groups.values()
    whole = rf"\A(?s:.*?)(?:{compiled.java})(?s:.*)\z"
    joined = F.regexp_replace(line, whole, _MARK.join(f"${n}" for n in numbers))
    single = F.array(*(F.regexp_extract(line, compiled.java, n) for n in numbers))
    return F.when(F.contains(line, F.lit(_MARK)), single).otherwise(F.split(joined, _MARK, -1))


def parse_log(
    lines: DataFrame, pattern: str, flags: str = "", column: str = "value", require_match: bool = False
) -> DataFrame:
    """Matching lines as raw string columns, one per named group, the first match in each line.

    Works on any DataFrame with a column of lines, batch or streaming; its other columns stay.
    A group that took no part in the match is blank, as a NULL. ``require_match`` looks for one
    matching line first and raises when there is none.
    """
    compiled = compile_pattern(lines.sparkSession, pattern, flags)
    value = _line(F.col(column))
    if require_match and lines.filter(value.rlike(compiled.java)).isEmpty():
        raise NoMatch("no line matches the pattern")
    others = [c for c in lines.columns if c != column and c not in compiled.groups]
    matched = lines.filter((F.length(value) > 0) & value.rlike(compiled.java))
    # The line and the array are columns of their own, so that each is made once.
    line = matched.select(*others, value.alias("_line"))
    cut = line.select(*others, _groups(F.col("_line"), compiled).alias("_groups"))
    return cut.select(
        *others,
        *(
            describe(values.blank_to_null(F.get("_groups", F.lit(i))), name, "string")
            for i, name in enumerate(compiled.groups)
        ),
    )


def parse_log_report(lines: DataFrame, pattern: str, flags: str = "", column: str = "value") -> DataFrame:
    """How many non-empty lines match and do not: ``matched``, ``unmatched``."""
    compiled = compile_pattern(lines.sparkSession, pattern, flags)
    value = _line(F.col(column))
    hit = value.rlike(compiled.java)
    return lines.filter(F.length(value) > 0).agg(
        F.count_if(hit).alias("matched"), F.count_if(~hit).alias("unmatched")
    )
