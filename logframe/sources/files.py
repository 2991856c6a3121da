"""What the bytes of text files tell: encoding, delimiter, quoting, header, order.

Everything is read with the splittable text source, which hands over raw bytes per line, so one
distributed job covers any number of files of any size.
"""

from __future__ import annotations

import contextlib
import fnmatch
import re
from collections.abc import Iterable, Iterator, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

# Accepted file name endings and delimiters tried.
EXTENSIONS = (".csv", ".tsv", ".log", ".txt")
DELIMITERS = (",", "\t", "|", ";")
DEFAULT_DELIMITER = ","

# A row position is the place of its block among all blocks, then 33 bits for its place in the block.
PLACE_BITS = 33
# Blocks are counted in steps of so many bytes, or of the smallest split that the session allows.
BLOCK_STEP = 1 << 20
# With splits of this size every file is one partition of its own.
_WHOLE_FILE = 1 << 45

# Windows-1252 prints these where ISO-8859-1 has control codes; the rule is Python's codec.
_C1 = [chr(b) for b in range(0x80, 0xA0)]
_WINDOWS = [bytes([ord(c)]).decode("cp1252", "replace") for c in _C1]
WINDOWS_FROM = "".join(c for c, w in zip(_C1, _WINDOWS) if w != "\ufffd")
WINDOWS_TO = "".join(w for w in _WINDOWS if w != "\ufffd")


class UnsupportedFile(ValueError):
    """The file name does not end in an accepted extension."""


class EmptyFile(ValueError):
    """The file has no header row."""

    code = "EMPTY_FILE"


def check_extensions(paths: Sequence[str]) -> None:
    """Reject files that are named one by one and are no text tables; folders are filtered."""
    for p in paths:
        name = p.rstrip("/").rsplit("/", 1)[-1].lower()
        if "." in name and "*" not in name and not name.endswith(EXTENSIONS):
            raise UnsupportedFile(f"{name} is not one of {', '.join(EXTENSIONS)}")


def _glob() -> str:
    return "*{" + ",".join(EXTENSIONS) + "}"


def lines_of(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Raw lines with their file and place: ``file``, ``name``, ``size``, ``block``, ``place``, ``value``."""
    text = spark.read.option("pathGlobFilter", _glob()).text(paths if isinstance(paths, str) else list(paths))
    return text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_name").alias("name"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        "value",
    )


def detect(lines: DataFrame) -> DataFrame:
    """Per file: ``file``, ``name``, ``size``, ``encoding``, ``multi_line``, ``delimiter``; every line counts.

    A byte-order mark decides the encoding, else whether the bytes are valid UTF-8; windows-1252 is
    what remains. A file is multi-line if a cell that opens with a quote is still open at the end of
    some line. The delimiter is the one under which most lines have as many fields as the header, the
    first line with a visible cell; of equals the one whose most frequent field count has most lines,
    then the one that gives the header most fields. One that does not cut the header is no candidate;
    with none left it is the comma.

    Lines are reduced to one row per file and combination of field counts first, so a long file
    moves as little as a short one; all columns have fixed width.
    """
    start = F.hex(F.substring(F.col("value").cast("binary"), 1, 2))
    place = F.when(F.col("block") == 0, F.col("place"))
    visible = F.translate("value", "\u0000\ufeff", "")
    seen = lines.select(
        "file", "name", "size", place.alias("place"), start.alias("start"), F.is_valid_utf8("value").alias("valid"), visible.alias("line")
    )
    single = F.replace("line", F.lit('""'), F.lit(""))
    left_open = F.contains("line", F.lit('"')) & single.rlike(r'(?:^|[,\t|;]) *"[^"]*$') & (_count(single, '"') % 2 == 1)
    bare = F.when(F.contains("line", F.lit('"')), F.regexp_replace("line", '"[^"]*"', "")).otherwise(F.col("line"))
    filled = F.regexp_like("line", F.lit(r'[^\s,\t|;"]'))
    counts = [f"n{i}" for i in range(len(DELIMITERS))]
    cut = seen.select("*", left_open.alias("open"), F.when(filled, F.col("place")).alias("heads"), F.when(F.trim("line") != "", bare).alias("bare")).select(
        "*", *((_count(F.col("bare"), d) + 1).alias(n) for n, d in zip(counts, DELIMITERS))
    )
    shapes = cut.groupBy("file", "name", "size", *counts).agg(
        # A mark counts in the first line only. The line reader drops the mark of UTF-8.
        F.min("place").alias("first"),
        F.min(F.when(F.col("start") == "FFFE", F.col("place"))).alias("little"),
        F.min(F.when(F.col("start") == "FEFF", F.col("place"))).alias("big"),
        F.bool_and("valid").alias("utf8"),
        F.bool_or("open").alias("multi_line"),
        F.min("heads").alias("heads"),
        F.count("bare").alias("lines"),
    )
    facts = ("first", "little", "big", "utf8", "multi_line")
    cases = F.inline(F.array(*(F.struct(F.lit(i).alias("rank"), F.col(n).alias("fields")) for i, n in enumerate(counts))))
    merged = {"first": F.min, "little": F.min, "big": F.min, "utf8": F.bool_and, "multi_line": F.bool_or}
    again = [merge(c).alias(c) for c, merge in merged.items()]
    by_count = shapes.select("file", "name", "size", *facts, "heads", "lines", cases).groupBy("file", "name", "size", "rank", "fields")
    counted = by_count.agg(*again, F.min("heads").alias("heads"), F.sum("lines").alias("lines"))
    # One row per field count of a file's delimiter; the header is in the one with the first visible line.
    header = F.first("fields").over(W.partitionBy("file", "rank").orderBy(F.col("heads").asc_nulls_last()))
    agreed = F.sum(F.when(F.col("fields") == F.col("header"), F.col("lines")))
    scored = counted.withColumn("header", header).groupBy("file", "name", "size", "rank").agg(*again, F.max("header").alias("header"), agreed.alias("agreed"), F.max("lines").alias("mode"))
    one = lambda c, i: F.max(F.when(F.col("rank") == i, F.col(c))).alias(f"{c}{i}")
    wide = scored.groupBy("file", "name", "size").agg(*again, *(one(c, i) for c in ("header", "agreed", "mode") for i in range(len(DELIMITERS))))
    encoding = (
        F.when(F.col("little") == F.col("first"), "utf-16le")
        .when(F.col("big") == F.col("first"), "utf-16be")
        .when(F.col("utf8"), "utf-8")
        .otherwise("windows-1252")
    )

    def score(i: int, delimiter: str) -> Column:
        order = [F.col(f"{c}{i}").alias(c) for c in ("agreed", "mode", "header")]
        return F.when(F.col(f"header{i}") > 1, F.struct(*order, F.lit(-i).alias("rank"), F.lit(delimiter).alias("delimiter")))

    best = F.greatest(*(score(i, d) for i, d in enumerate(DELIMITERS)))["delimiter"]
    return wide.select("file", "name", "size", encoding.alias("encoding"), "multi_line", F.coalesce(best, F.lit(DEFAULT_DELIMITER)).alias("delimiter"))


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def detect_encodings(lines: DataFrame) -> DataFrame:
    """``file``, ``name``, ``size``, ``encoding``, ``multi_line`` (see ``detect``)."""
    return detect(lines).drop("delimiter")


def detect_delimiters(lines: DataFrame) -> DataFrame:
    """``file`` and ``delimiter`` (see ``detect``)."""
    return detect(lines).select("file", "delimiter")


@contextlib.contextmanager
def _settings(spark: SparkSession, **values: str) -> Iterator[None]:
    keys = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def first_records(spark: SparkSession, paths: str | Sequence[str], wide: bool, multi_line: bool, delimiter: str) -> list[tuple[str, int, bytes]]:
    """Per file that has a record with a visible cell: reported path, size, bytes up to the first such record.

    One task per file reads the start of it and stops there.
    """
    reader = spark.read.option("pathGlobFilter", _glob())
    text = (reader.option("lineSep", "\n") if wide else reader).text(paths if isinstance(paths, str) else list(paths))
    lines = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value"))
    blank = bytes({*b' \t\r\n\x0b\x0c\x00\xef\xbb\xbf\xfe\xff"', *"".join(DELIMITERS).encode(), *delimiter.encode()})

    def heads(batches):  # nested, so that it travels to the workers as it is
        import re

        import pyarrow as pa

        shape = pa.schema([("file", pa.string()), ("size", pa.int64()), ("head", pa.binary())])
        start, rest, found, file, size = b"", [], False, None, 0
        for batch in batches:
            for file, size, value in zip(*(c.to_pylist() for c in batch.columns)):
                rest.append(value)
                found = found or bool(value.translate(None, blank))
                if not found:
                    continue
                start = start or b"\n".join(rest)
                record = b"\n".join(rest)
                plain = record.replace(b"\x00", b"").replace(b'""', b"")
                if not (multi_line and plain.count(b'"') % 2 and re.search(rb'(?:^|[,\t|;\n]) *"[^"]*$', plain)):
                    yield pa.RecordBatch.from_pylist([{"file": file, "size": size, "head": record}], shape)
                    return
        if found:
            yield pa.RecordBatch.from_pylist([{"file": file, "size": size, "head": start}], shape)

    whole = str(_WHOLE_FILE)
    with _settings(
        spark, spark__sql__files__maxPartitionBytes=whole, spark__sql__files__openCostInBytes=whole, spark__sql__execution__arrow__maxRecordsPerBatch="64"
    ):
        found = lines.mapInArrow(heads, "file string, size bigint, head binary").collect()
    return [(r["file"], r["size"], bytes(r["head"])) for r in found]


def listing(spark: SparkSession, paths: str | Sequence[str]) -> list[tuple[str, int]]:
    """Reported path and size of every file; no content is read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", _glob()).load(paths if isinstance(paths, str) else list(paths))
    return [tuple(r) for r in found.select("_metadata.file_path", "_metadata.file_size").collect()]


def _local(path: str) -> str:
    return re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", path).rstrip("/")


def in_order(found: Iterable[tuple[str, int]], names: Sequence[str]) -> list[tuple[str, int]]:
    """Files in the order in which ``names`` gives them or their folders; those of a folder by path."""
    wanted = [_local(n) for n in names]

    def place(path: str) -> int:
        path = _local(path)
        for i, name in enumerate(wanted):
            tail = "/" + name.lstrip("/")
            if path.endswith(tail) or tail + "/" in path or fnmatch.fnmatchcase(path, f"*{tail}*"):
                return i
        return len(wanted)

    return sorted(found, key=lambda f: (place(unquote(f[0])), unquote(f[0])))


class Positions:
    """Row positions that follow the files as given, then the place in the file, however Spark packs the splits."""

    def __init__(self, spark: SparkSession, ordered: Sequence[tuple[str, int]]):
        conf = spark._jsparkSession.sessionState().conf()
        self.step = max(1, min(BLOCK_STEP, conf.filesMaxPartitionBytes(), conf.filesOpenCostInBytes()))
        at, rows = 0, []
        for file, size in ordered:
            rows.append((file, at))
            at += size // self.step + 1
        # One row per file, as many as the driver has listed.
        self.table = spark.createDataFrame(rows, "_path string, _base bigint") if len(rows) > 1 else None

    @staticmethod
    def marks() -> list[Column]:
        """What ``number`` needs of every row; select it straight from the reader."""
        return [
            F.col("_metadata.file_path").alias("_path"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_place"),
        ]

    def number(self, rows: DataFrame, name: str) -> DataFrame:
        base = F.lit(0)
        if self.table is not None:
            rows, base = rows.join(F.broadcast(self.table), "_path", "left"), F.col("_base")
        block = base + F.floor(F.col("_block") / self.step)
        position = F.shiftleft(block.cast("bigint"), PLACE_BITS) + F.col("_place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
        return rows.withColumn(name, position).drop("_path", "_base", "_block", "_place")


def decoded(c: Column, encoding: str) -> Column:
    """Finish the decoding of a cell read by Spark; Windows text is read as ISO-8859-1."""
    return F.translate(c, WINDOWS_FROM, WINDOWS_TO) if encoding == "windows-1252" else c


def reader_encoding(encoding: str) -> str:
    """Charset Spark's readers take for a detected encoding."""
    return {"windows-1252": "ISO-8859-1"}.get(encoding, encoding.upper())
