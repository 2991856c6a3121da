"""Merkle manifest of a dataset: a digest of all rows, and for each row the proof that it belongs.

Rows are the leaves of one tree per part, in the order of their ids; the parts' roots are the leaves
of a tree on top. Nodes are dealt into superblocks, subtrees of a few levels whose leaves are
consecutive. Going up, each superblock becomes one node of the next round, until every part has one.
Going down, leaves and the outer nodes they need are cogrouped by superblock: a superblock receives
the one row with its siblings outside, rebuilds its own levels, joins both into the proofs of its
leaves and folds these back to the root. No task holds more than one superblock at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from logframe.llm.common import Scratch, numbered, send_package

FANOUT, LEVELS = 8, 3
BLOCK = FANOUT**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _field(value: Column) -> Column:
    """``-`` for a null, else the number of UTF-8 bytes, a colon and the value."""
    as_text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(as_text).cast("string"), F.lit(":"), as_text))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(_field, fields)), 256)


def levels_of(n: int) -> int:
    """Levels that a superblock of a tree with ``n`` nodes has above its nodes."""
    level = 0
    while n > 1 and level < LEVELS:
        n, level = -(-n // FANOUT), level + 1
    return level


def build(digests: list[str], levels: int) -> list[list[str]]:
    """The nodes of a superblock, level by level, its top last."""
    out = [digests]
    for _ in range(levels):
        below = out[-1]
        out.append([_digest("".join(below[k : k + FANOUT])) for k in range(0, len(below), FANOUT)])
    return out


def siblings(tree: list[list[str]]) -> list[list[tuple[str, str]]]:
    """For each level but the top, what stands left and right of each node in its run, concatenated."""
    out = []
    for nodes in tree[:-1]:
        runs = [nodes[k - k % FANOUT : k - k % FANOUT + FANOUT] for k in range(len(nodes))]
        out.append([("".join(run[: k % FANOUT]), "".join(run[k % FANOUT + 1 :])) for k, run in enumerate(runs)])
    return out


def _up(nodes: DataFrame) -> DataFrame:
    """Tops of the superblocks of (tree, i, n, digest), as nodes of the next round."""

    def reduce(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("i")
        n, levels = int(frame["n"].iloc[0]), levels_of(int(frame["n"].iloc[0]))
        top = build(frame["digest"].tolist(), levels)[-1][0]
        return pd.DataFrame({"tree": [frame["tree"].iloc[0]], "i": [int(frame["i"].iloc[0]) // BLOCK], "n": [-(-n // FANOUT**levels)], "digest": [top]})

    keyed = nodes.select("tree", "i", "n", "digest", F.expr(f"i div {BLOCK}").alias("block"))
    return keyed.groupBy("tree", "block").applyInPandas(reduce, "tree string, i long, n long, digest string")


_OUTER = "root string, subroot string, lefts array<string>, rights array<string>"


def _exchange(nodes: DataFrame, outer: DataFrame, finish: Callable, schema: str) -> DataFrame:
    """Cogroup nodes with the outer row (tree, i, root, subroot, lefts, rights) of their superblock.

    ``finish`` gets the nodes of a superblock in order, the outer row, and each node's own siblings
    (left, right) from the lowest level up to the top of the superblock.
    """

    def meet(frame: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("i")
        sides = siblings(build(frame["digest"].tolist(), levels_of(int(frame["n"].iloc[0]))))
        paths = [[level[k // FANOUT**h] for h, level in enumerate(sides)] for k in range(len(frame))]
        return finish(frame, above.iloc[0], paths)

    keyed = nodes.withColumn("block", F.expr(f"i div {BLOCK}"))
    return keyed.groupBy("tree", "block").cogroup(outer.groupBy("tree", "i")).applyInPandas(meet, schema)


def _descend(frame: pd.DataFrame, above: pd.Series, paths: list) -> pd.DataFrame:
    """The outer rows of the nodes, for the round below."""
    return pd.DataFrame(
        {
            "tree": frame["tree"].tolist(),
            "i": frame["i"].tolist(),
            "root": above["root"],
            "subroot": above["subroot"],
            "lefts": [[left for left, _ in p] + list(above["lefts"]) for p in paths],
            "rights": [[right for _, right in p] + list(above["rights"]) for p in paths],
        }
    )


def _prove(with_proof: bool) -> Callable:
    def finish(frame: pd.DataFrame, above: pd.Series, paths: list) -> pd.DataFrame:
        outer = list(zip(above["lefts"], above["rights"], strict=True))
        beyond = "".join(left + right for left, right in outer)
        proofs, folded = [], []
        for path, changed, leaf in zip(paths, frame["changed"], frame["digest"], strict=True):
            proofs.append("".join(left + right for left, right in path) + beyond)
            node = changed if isinstance(changed, str) else leaf
            for left, right in [*path, *outer]:
                node = _digest(left + node + right)
            folded.append(node)
        out = pd.DataFrame({"id": frame["id"], "part": frame["part"], "position": frame["i"], "leaf": frame["digest"]})
        out["subroot"], out["root"] = above["subroot"], above["root"]
        if with_proof:
            out["proof"] = [[p[k : k + 64] for k in range(0, len(p), 64)] for p in proofs]
        out["proof_sha256"] = [_digest(p) for p in proofs]
        out["folded_root"] = folded
        out["verified"] = out["folded_root"] == out["root"]
        return out

    return finish


def _rounds(scratch: Scratch, nodes: DataFrame) -> list[DataFrame]:
    """The nodes and those of every round above, each written; trees have one node in the last."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    out = [nodes]
    while len(out) == 1 or most > 1:
        out.append(scratch.save(_up(out[-1]), "round"))
        most = -(-most // BLOCK)
    return out


def manifest(df: DataFrame, id: str, part: str, fields: list[Column], changed: Column | None = None, with_proof: bool = False) -> DataFrame:
    """One row per row of ``df``: ``id``, ``part``, ``position`` in its part, ``leaf``, ``subroot``, ``root``,
    ``proof_sha256``, ``folded_root`` and ``verified``; with ``with_proof`` also ``proof``, the siblings' digests.

    ``fields`` make up the leaf. ``changed`` is the leaf to be verified, null where it is the same as the leaf:
    it is folded with the original siblings to ``folded_root``.

    Leaves ascend by id, null ids first; rows that share an id ascend by leaf, so rows that are equal throughout
    are interchangeable. A null part is a part of its own, the first one. Extra columns are ignored, and names
    can't clash. An empty table gives an empty result. Numbers and nodes are written between the rounds.
    """
    spark = df.sparkSession
    send_package(spark)
    scratch = Scratch(spark)
    changed = F.lit(None).cast("string") if changed is None else changed
    tree = F.when(F.col(part).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(part).cast("string")))
    rows = scratch.save(df.select(tree.alias("tree"), F.col(id).alias("id"), F.col(part).alias("part"), leaf(fields).alias("digest"), changed.alias("changed")), "rows")
    leaves = numbered(scratch, rows, ["tree", "id", "digest", "changed"], ["tree"], "i", "n")
    opaque = {c: F.col(c).cast("string") for c in ("id", "part")}  # pandas would turn whole numbers with nulls into floats
    levels = _rounds(scratch, scratch.save(leaves.withColumns(opaque), "leaves"))

    subroots = levels[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest")
    parts = scratch.save(numbered(scratch, subroots, ["tree", "of"], ["tree"], "i", "n"), "parts")
    top = _rounds(scratch, parts)
    none = F.array().cast("array<string>")
    outer = top[-1].select("tree", "i", F.col("digest").alias("root"), F.lit(None).cast("string").alias("subroot"), none.alias("lefts"), none.alias("rights"))
    for nodes in reversed(top[:-1]):
        outer = _exchange(nodes, outer, _descend, f"tree string, i long, {_OUTER}")
    outer = outer.join(parts.select("i", "of", "digest"), "i")
    outer = scratch.save(outer.select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("i"), "root", F.col("digest").alias("subroot"), "lefts", "rights"), "outer")
    for nodes in reversed(levels[1:-1]):
        outer = scratch.save(_exchange(nodes, outer, _descend, f"tree string, i long, {_OUTER}"), "outer")
    kinds = dict(rows.dtypes)
    schema = "id string, part string, position long, leaf string, subroot string, root string, "
    schema += "proof array<string>, " * with_proof + "proof_sha256 string, folded_root string, verified boolean"
    out, given = _exchange(levels[0], outer, _prove(with_proof), schema), {"id": id, "part": part}
    return out.select(*((F.col(c).cast(kinds[c]).alias(given[c]) if c in given else F.col(c)) for c in out.columns))


def lowered_every_third(id: Column, text: Column) -> Column:
    """The text with A-Z lower-cased where 3 divides the crc32 of the id, else null: a change that proofs must find."""
    return F.when(F.crc32(id.cast("string").cast("binary")) % 3 == 0, F.translate(text, _CAPITALS, _SMALL))


def tamper_check(df: DataFrame, with_proof: bool = False) -> DataFrame:
    """``manifest`` of ``documents`` by language, with every third document's text lower-cased before it is verified.

    A null id is never changed, and a null text stays null.
    """
    small = lowered_every_third(F.col("doc_id"), F.col("text"))
    fields = [F.col(c) for c in FIELDS]
    changed = F.when(small.isNotNull(), leaf([*fields[:-1], small]))
    return manifest(df, "doc_id", "lang", fields, changed, with_proof)
