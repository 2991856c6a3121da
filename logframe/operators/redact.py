"""Redaction of sensitive values, by a fixed token or by a stable number per value.

Consistent redaction numbers each distinct value in the order of its first appearance. Cells are
cut into literal and matched pieces; only matches are grouped, numbered and joined, and the
literal text stays in its row.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from logframe.functions import patterns, values
from logframe.operators.ordering import with_position
from logframe.schema import ROW_ID, Field, any_of, fields_of, has_row_id, ref
from logframe.session import materialize

# The classes in order of precedence, and their tokens. A MAC address also looks
# like an IPv6 address, so it comes first.
TOKENS = {"email": "EMAIL", "mac": "MAC", "ipv6": "IP6", "ipv4": "IP"}

# A dictionary up to this size is broadcast; of a larger one this many values, most frequent
# first, and the rest is joined by shuffle.
BROADCAST_VALUES = 100_000
BROADCAST_CHARS = 32_000_000
FREQUENT = 1000


def _classes(classes: Iterable[str] | None) -> list[str]:
    wanted = set(TOKENS if classes is None else classes)
    return [c for c in TOKENS if c in wanted]


def _string_cells(df: DataFrame) -> list[Field]:
    return [f for f in fields_of(df) if f.is_text]


def redact(df: DataFrame, classes: Iterable[str] | None = None, mode: str = "token") -> DataFrame:
    """Replace sensitive values in every string cell; parsed numbers and booleans stay.

    ``token`` writes ``[IP]``; ``consistent`` writes ``[IP_1]``, ``[IP_2]`` …, the same for the
    same value throughout the table, numbered as the values first appear. The order of rows is
    that of ``_row_id``, which ``consistent`` needs.
    """
    if mode not in ("token", "consistent"):
        raise ValueError(f"unknown redaction mode {mode!r}")
    chosen = _classes(classes)
    cells = _string_cells(df)
    if not chosen or not cells:
        return df
    if mode == "token":
        return df.withColumns({f.key: _keep_metadata(df, f, _string_only(f, _tokens(f.col, chosen))) for f in cells})
    if not has_row_id(df):
        raise ValueError("consistent redaction needs a row order; add one with with_row_id")
    return _consistent(df, chosen, cells)


def _keep_metadata(df: DataFrame, f: Field, c: Column) -> Column:
    return c.alias(f.key, metadata=df.schema[f.key].metadata)


def _string_only(f: Field, redacted: Column) -> Column:
    """In a number or boolean column only cells that did not parse are strings."""
    unparsed = values.is_unparsed_text(f)
    return redacted if unparsed is None else F.when(unparsed, redacted).otherwise(f.col)


def _tokens(c: Column, chosen: list[str]) -> Column:
    for id in chosen:
        c = patterns.replaced(c, id, f"[{TOKENS[id]}]")
    return c


# --- consistent -----------------------------------------------------------------------------

_PIECE = "array<struct<token:string,text:string>>"


def _piece(token: Column, text: Column) -> Column:
    return F.struct(token.cast("string").alias("token"), text.alias("text"))


def _pieces(c: Column, chosen: list[str]) -> Column:
    """The cell as alternating literal pieces (no token) and matches, class by class.

    A later class looks into the literal pieces only. Cutting there changes no match: the
    patterns look around by word boundaries only, and a bracket bounds a word as an end does.
    """
    out = F.array(_piece(F.lit(None), c))
    for id in chosen:
        out = F.flatten(F.transform(out, _cutter(patterns.named(id), TOKENS[id])))
    return out


def _cutter(java: str, token: str):
    """Cut a literal piece at every match, so that literals and matches alternate."""

    def cut(piece: Column) -> Column:
        literals = F.split(piece["text"], java, -1)
        found = F.regexp_extract_all(piece["text"], F.lit(java), F.lit(0))
        pair = lambda s, i: F.array(_piece(F.lit(None), s), _piece(F.lit(token), F.get(found, i)))
        # The last literal has no match after it; the empty place goes.
        woven = F.filter(F.flatten(F.transform(literals, pair)), lambda p: p["text"].isNotNull())
        return F.when(piece["token"].isNull(), woven).otherwise(F.array(piece))

    return cut


_KEY = "_redacted_row"


def _spots(i: int) -> Column:
    """The matches of one cell with their places among its pieces."""
    spot = lambda p, at: F.struct(
        F.lit(i).alias("cell"), at.alias("at"), p["token"].alias("token"), p["text"].alias("value")
    )
    placed = F.transform(F.coalesce(F.col(f"_p{i}"), F.array().cast(_PIECE)), spot)
    return F.filter(placed, lambda s: s["token"].isNotNull())


def _consistent(df: DataFrame, chosen: list[str], cells: list[Field]) -> DataFrame:
    hit = any_of(patterns.has_match(f.col, id) for id in chosen for f in cells)
    marked = df.withColumn("_hit", hit)
    clean = marked.filter(~F.col("_hit")).drop("_hit")

    # Rows with a match carry each string cell as pieces; matches get their place in the row.
    def pieces(f: Field) -> Column:
        whole = F.array(_piece(F.lit(None), f.col))
        unparsed = values.is_unparsed_text(f)
        cut = _pieces(f.col, chosen)
        cut = cut if unparsed is None else F.when(unparsed, cut).otherwise(whole)
        return F.when(f.col.isNull(), F.lit(None).cast(_PIECE)).otherwise(cut)

    # The pieces hold the whole text, so the cells themselves need not move with them.
    cut = marked.filter("_hit").withColumns({f"_p{i}": pieces(f) for i, f in enumerate(cells)})
    # Rows find their labels again by a key of their own: the position may repeat.
    cut = materialize(cut.drop("_hit", *(f.key for f in cells)).withColumn(_KEY, F.monotonically_increasing_id()))
    spots = F.flatten(F.array(*(_spots(i) for i in range(len(cells)))))
    found = cut.select(ROW_ID, _KEY, F.explode_outer(spots).alias("s")).select(ROW_ID, _KEY, "s.*").filter("token is not null")

    placed = _labelled(found, _numbered(found))
    own = lambda i: F.when(F.col("cell") == i, F.struct("at", "label"))
    placed = placed.groupBy(_KEY).agg(
        *(F.sort_array(F.collect_list(own(i)))["label"].alias(f"_l{i}") for i in range(len(cells)))
    )

    # Pieces alternate: literals at even places, matches at odd ones.
    def rebuilt(i: int, f: Field) -> Column:
        texts = F.transform(
            F.col(f"_p{i}"),
            lambda p, at: F.when(at % 2 == 0, p["text"]).otherwise(F.get(F.col(f"_l{i}"), F.shiftright(at, 1))),
        )
        return _keep_metadata(df, f, F.array_join(texts, ""))

    joined = cut.join(placed, _KEY, "left")
    by_key = {f.key: i for i, f in enumerate(cells)}
    repaired = joined.select(
        *(rebuilt(by_key[c], cells[by_key[c]]) if c in by_key else ref(c) for c in df.columns)
    )
    return clean.unionByName(repaired)


def _labelled(found: DataFrame, numbered: DataFrame) -> DataFrame:
    """Every match with its label.

    A dictionary of checked size is broadcast. Of a larger one the most frequent values are, so
    that no value that many matches share travels; what is left is spread evenly by a shuffle.
    """
    known = ["token", "value"]
    size = numbered.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("value")), F.lit(0)).alias("chars")).first()
    if size["n"] <= BROADCAST_VALUES and size["chars"] <= BROADCAST_CHARS:
        return found.join(F.broadcast(numbered.select(*known, "label")), known)
    frequent = numbered.orderBy(F.desc("n"), "token", "value").limit(FREQUENT)
    near = found.join(F.broadcast(frequent.select(*known, "label")), known, "left")
    done = near.filter("label is not null")
    rest = near.filter("label is null").drop("label").join(numbered.select(*known, "label"), known)
    return done.unionByName(rest)


def _numbered(found: DataFrame) -> DataFrame:
    """Every distinct value with its label: token and rank of first appearance."""
    distinct = found.groupBy("token", "value").agg(F.min(_place(found)).alias("first"), F.count("*").alias("n"))
    placed = with_position(distinct, [(F.col("token"), "asc"), (F.col("first"), "asc")], "position")
    # Four tokens at most: their first positions fit any broadcast.
    starts = placed.groupBy("token").agg(F.min("position").alias("_start"))
    number = (F.col("position") - F.col("_start") + 1).cast("string")
    return placed.join(F.broadcast(starts), "token").select(
        "token", "value", "n", F.concat(F.lit("["), "token", F.lit("_"), number, F.lit("]")).alias("label")
    )


def _place(found: DataFrame) -> Column:
    """Where a match stands: row, cell, place in the cell.

    For whole-number rows it is one number, of fixed width, which a hash aggregate can hold.
    """
    if not isinstance(found.schema[ROW_ID].dataType, T.IntegralType):
        return F.struct(F.col(ROW_ID).alias("row"), "cell", "at")
    within = F.shiftleft(F.col("cell").cast("bigint"), 32) + F.col("at")
    return (F.col(ROW_ID).cast("decimal(19,0)") * F.lit(2**48).cast("decimal(16,0)") + within).cast("decimal(38,0)")
