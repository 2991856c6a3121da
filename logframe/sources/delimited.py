"""Delimited text tables."""

from __future__ import annotations

import csv
import io
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from logframe.functions import values
from logframe.schema import BAD_RECORD, FILE, ROW_ID, SURPLUS, all_of, any_of, describe
from logframe.sources import files
from logframe.sources.headers import column_keys
from logframe.sources.inference import infer_types


@dataclass(frozen=True)
class FileProfile:
    path: str
    name: str
    size: int
    encoding: str
    delimiter: str
    multi_line: bool


def profile_files(spark: SparkSession, paths: str | Sequence[str]) -> list[FileProfile]:
    """Encoding, delimiter and quoting of every file, from one pass over their bytes.

    One small row per file reaches the driver, as it does when Spark lists the files.
    """
    found = files.detect(files.lines_of(spark, paths)).orderBy("file").collect()
    # Reported paths are URL-encoded.
    return [FileProfile(unquote(r["file"]), unquote(r["name"]), r["size"], r["encoding"], r["delimiter"], r["multi_line"]) for r in found]


@dataclass(frozen=True)
class _Kind:
    """What files have to share to be read together."""

    delimiter: str
    encoding: str
    multi_line: bool
    header: tuple[str | None, ...] = ()
    late: bool = False  # separator-only lines come before the header


def read_delimited(
    spark: SparkSession,
    paths: str | Sequence[str],
    delimiter: str | None = None,
    encoding: str | None = None,
    multi_line: bool | None = None,
    infer: bool = True,
    keep_bad: bool = False,
    full_paths: bool = False,
) -> DataFrame:
    """CSV, TSV and other delimited files with a header row each, as raw strings with logical types.

    What is not given is detected per file. Files alike in that and in their header are read
    together; columns of different headers are united by key. Blank lines are skipped, missing cells
    are NULL, surplus cells are dropped. ``_file`` holds the file name and ``_row_id`` the position of
    a row: by file as given (those of a folder by path), then by place in the file. With delimiter,
    encoding and ``multi_line`` given no detection pass is made; ``multi_line=False`` keeps files
    splittable. ``keep_bad`` adds the raw text of records with the wrong number of cells as
    ``_bad_record`` and the difference as ``_surplus``; ``full_paths`` puts the path of a file into
    ``_file`` instead of its name.
    """
    names = [paths] if isinstance(paths, str) else list(paths)
    files.check_extensions(names)
    profiles = None if None not in (delimiter, encoding, multi_line) else profile_files(spark, names)
    return _read(spark, names, profiles, delimiter, encoding, multi_line, infer, keep_bad, full_paths)


def _read(
    spark: SparkSession,
    names: list[str],
    profiles: list[FileProfile] | None,
    delimiter: str | None = None,
    encoding: str | None = None,
    multi_line: bool | None = None,
    infer: bool = True,
    keep_bad: bool = False,
    full_paths: bool = False,
) -> DataFrame:
    plain: dict[_Kind, list[str]] = {}
    if profiles is None:
        plain[_Kind(delimiter, encoding, multi_line)] = names
    for p in profiles or []:
        kind = _Kind(delimiter or p.delimiter, encoding or p.encoding, p.multi_line if multi_line is None else multi_line)
        plain.setdefault(kind, []).append(p.path)
    kinds: dict[_Kind, list[str]] = {}
    found: list[tuple[str, int]] = []
    for kind, paths in plain.items():
        wide = kind.encoding.lower().startswith("utf-16")
        for file, size, head in files.first_records(spark, paths, wide, kind.multi_line, kind.delimiter):
            header, late = _header(head, kind.delimiter, kind.encoding)
            found.append((file, size))
            kinds.setdefault(replace(kind, header=header, late=late), []).append(unquote(file))
    if not kinds:
        raise files.EmptyFile("the file is empty or has no header row")
    if len(kinds) == 1 and (profiles is None or len(found) == len(profiles)):
        kinds = {kind: names for kind in kinds}  # all alike: Spark lists the folders itself
    positions = files.Positions(spark, files.in_order(found, names))
    parts = [_read_alike(spark, paths, kind, positions, keep_bad, full_paths) for kind, paths in kinds.items()]
    table = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    front = [ROW_ID, FILE, *([BAD_RECORD, SURPLUS] if keep_bad else [])]
    table = table.select(*front, *(c for c in table.columns if c not in front))
    return infer_types(table) if infer else table


def _header(head: bytes, delimiter: str, encoding: str) -> tuple[tuple[str | None, ...], bool]:
    """Labels of the first record with a visible cell, and whether separator-only records precede it."""
    name = "latin-1" if encoding == "windows-1252" else encoding
    if encoding.lower().startswith("utf-16"):
        head = head[: len(head) // 2 * 2]  # the line end of a record starts with half a character
    text = head.decode(name, "replace").lstrip("\ufeff")
    late, cells = False, []
    for cells in csv.reader(io.StringIO(text.replace("\x00", ""), newline=""), delimiter=delimiter):
        if any(c.strip() for c in cells):
            break
        late = late or len(cells) > 1
    return tuple(_clean(c, encoding) for c in cells), late


def cut_by(reader, delimiter: str, encoding: str, multi_line: bool):
    """A batch or stream reader set up for delimited text."""
    reader = (
        reader.option("sep", delimiter)
        .option("quote", '"')
        .option("escape", '"')
        .option("encoding", files.reader_encoding(encoding))
        .option("multiLine", multi_line)
        .option("pathGlobFilter", "*{" + ",".join(files.EXTENSIONS) + "}")
    )
    # A line of UTF-16 ends in two bytes; naming the separator makes the reader split there.
    return reader.option("lineSep", "\n") if encoding.lower().startswith("utf-16") and not multi_line else reader


def _cells(n: int, encoding: str) -> list[Column]:
    """The cells ``c0`` … as the reader gives them, decoded; blank ones are NULL."""
    out = [files.decoded(F.col(f"c{i}"), encoding) for i in range(n)]
    if encoding.lower().startswith("utf-16"):
        out[-1] = F.regexp_replace(out[-1], "\r$", "")
    return [values.blank_to_null(c) for c in out]


def described(raw: DataFrame, keys: Sequence[tuple[str, str]], encoding: str, *front: str | Column) -> DataFrame:
    """Rows with a visible cell, under their keys and headers."""
    filled = any_of(F.trim(f"c{i}") != "" for i in range(len(keys)))
    return raw.filter(filled).select(*front, *(describe(c, key, "string", name) for c, (name, key) in zip(_cells(len(keys), encoding), keys)))


def _file_of_row(full_path: bool) -> Column:
    """The file a row comes from; Spark reports it URL-encoded, but for plus signs."""
    reported = F.col("_metadata.file_path" if full_path else "_metadata.file_name")
    return F.url_decode(F.replace(reported, F.lit("+"), F.lit("%2B")))


def _read_alike(
    spark: SparkSession, paths: list[str], kind: _Kind, positions: files.Positions, keep_bad: bool, full_paths: bool
) -> DataFrame:
    reader = cut_by(spark.read, kind.delimiter, kind.encoding, kind.multi_line)
    keys = column_keys(list(kind.header))
    columns = [T.StructField(f"c{i}", T.StringType()) for i in range(len(keys))]
    if keep_bad:
        columns.append(T.StructField(BAD_RECORD, T.StringType()))
        reader = reader.option("columnNameOfCorruptRecord", BAD_RECORD)
    raw = reader.option("header", True).schema(T.StructType(columns)).csv(paths)
    rows = raw.select("*", _file_of_row(full_paths).alias(FILE), *positions.marks())
    if kind.late:
        # The reader has taken a separator-only line for the header, which is left as the first row with a visible cell.
        is_header = all_of(c.eqNullSafe(values.blank_to_null(F.lit(h))) for c, h in zip(_cells(len(keys), kind.encoding), kind.header))
        first = rows.filter(is_header & (F.col("_block") == 0)).groupBy("_path").agg(F.min("_place").alias("_place"))
        rows = rows.join(F.broadcast(first), ["_path", "_place"], "left_anti")  # one row per file
    front = [ROW_ID, FILE]
    if keep_bad:
        bare = F.regexp_replace(BAD_RECORD, '"[^"]*"', "")
        cells = F.length(bare) - F.length(F.replace(bare, F.lit(kind.delimiter), F.lit(""))) + 1
        front += [BAD_RECORD, F.when(F.col(BAD_RECORD).isNotNull(), cells - len(keys)).alias(SURPLUS)]
    return described(positions.number(rows, ROW_ID), keys, kind.encoding, *front)


def _clean(label: str | None, encoding: str) -> str:
    text = (label or "").rstrip("\r")
    return text.translate(str.maketrans(files.WINDOWS_FROM, files.WINDOWS_TO)) if encoding == "windows-1252" else text


def dataset_summary(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Per file: name, size, rows, delimiter and encoding."""
    profiles = profile_files(spark, paths)
    facts = spark.createDataFrame(
        [(p.path, p.name, p.size, p.delimiter, p.encoding) for p in profiles],
        "path string, file_name string, file_size bigint, delimiter string, encoding string",
    )
    table = _read(spark, [p.path for p in profiles], profiles, infer=False, full_paths=True)
    rows = table.groupBy(F.col(FILE).alias("path")).agg(F.count("*").alias("row_count"))
    return facts.join(rows, "path", "left").select(
        "file_name", "file_size", F.coalesce("row_count", F.lit(0)).alias("row_count"), "delimiter", "encoding"
    )


def malformed_records(table: DataFrame) -> DataFrame:
    """Records with too few or too many cells, or an unclosed quote: code, message, row, text.

    ``table`` is read with ``keep_bad=True``. They are reported, not removed.
    """
    bad, surplus = F.col(BAD_RECORD), F.col(SURPLUS)
    quotes = F.length(bad) - F.length(F.replace(bad, F.lit('"'), F.lit("")))
    code = F.when(quotes % 2 == 1, "MissingQuotes").when(surplus < 0, "TooFewFields").otherwise("TooManyFields")
    message = (
        F.when(quotes % 2 == 1, "A quoted cell is not closed")
        .when(surplus < 0, "The record has fewer cells than the header")
        .otherwise("The record has more cells than the header")
    )
    return table.filter(bad.isNotNull()).select(
        FILE, F.col(ROW_ID).alias("row"), code.alias("code"), message.alias("message"), bad.alias("record")
    )


def load_many(spark: SparkSession, paths: Sequence[str], **options) -> dict[str, DataFrame]:
    """Several tables side by side, labelled by file name; repeated names get `` (2)``."""
    from logframe.operators.compare import labels

    names = labels([p.rstrip("/").rsplit("/", 1)[-1] for p in paths])
    return {name: read_delimited(spark, p, **options) for name, p in zip(names, paths)}


def stack_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    """All tables as one, tagged in ``_file``; columns a table lacks are NULL."""
    tagged = [t.drop(FILE, ROW_ID).withColumn(FILE, F.lit(name)) for name, t in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
