"""Merkle manifest of a dataset by cogrouped subtree exchange.

Every row is a leaf; the leaves of a language, in the order of doc_id, form a tree of fixed
fan-out, and the roots of the languages form the tree above. A superblock is a run of
fan-out ** 4 leaves, the unit of exchange:

1. leaves are digested in DataFrame functions and get their place by range partitioning, so
   a language that holds most rows is spread like any other;
2. each superblock is reduced to its top node; the nodes above the superblocks, a thousandth
   of the leaves, are reduced level by level with grouped aggregates;
3. going down again, every run hands its members their siblings together with those of its
   parent (one row joins one row), which gives each superblock the outer nodes that its
   proofs need: at most fan-out - 1 per level;
4. leaves and outer nodes are cogrouped by superblock, and one ``applyInPandas`` finishes the
   local reduction, joins the proofs and folds them.

H is the lowercase hex sha256 of its inputs put together, digests as hex text.

Defined results: a null field is ``-``, any other its UTF-8 byte count, ``:`` and value; null
doc_id and null lang come first; equal doc_ids of a language are ordered by their leaves, and
rows equal in all fields are leaves of their own; an empty text is ``0:``; the row with null
doc_id is judged for tampering by the text ``-``. An empty table has no rows. Extra columns
are ignored.
"""

from __future__ import annotations

from functools import partial
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glucoframe.llm.ranges import placed
from glucoframe.llm.scratch import Scratch

FAN_OUT = 8
LOCAL_LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PROVEN = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def field(c: Column) -> Column:
    s = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_of(columns: list[Column]) -> Column:
    """H of the fields of a row."""
    return F.sha2(F.concat(*map(field, columns)), 256)


def tampered_text(doc_id: Column, text: Column) -> Column:
    """The text with A-Z lowered where 3 divides the crc32 of the decimal doc_id."""
    hit = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("-")).cast("binary")) % 3 == 0
    return F.when(hit, F.translate(text, UPPER, LOWER)).otherwise(text)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, changed): digests as bytes; ``changed`` is the leaf of the tampered
    row, null if the row is not tampered with."""
    text = tampered_text(F.col("doc_id"), F.col("text"))
    fields = [F.col(c) for c in FIELDS]
    leaf, changed = leaf_of(fields), leaf_of([*fields[:-1], text])
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.unhex(leaf).alias("leaf"),
        F.when(text.isNotNull() & (text != F.col("text")), F.unhex(changed)).alias("changed"))


def H(parts) -> str:
    return sha256("".join(parts).encode("ascii")).hexdigest()


def height(leaves: Column, fan_out: int) -> Column:
    """Levels above the leaves: runs are folded while several nodes remain. By whole numbers."""
    powers = F.array(*(F.lit(fan_out ** k) for k in range(1, 63) if fan_out ** k < 2 ** 63))
    return F.size(F.filter(powers, lambda p: p < leaves)) + F.when(leaves > 1, 1).otherwise(0)


def _levels(nodes: list[str], levels: int, fan_out: int) -> list[list[str]]:
    out = [nodes]
    for _ in range(levels):
        last = out[-1]
        out.append([H(last[i:i + fan_out]) for i in range(0, len(last), fan_out)])
    return out


def _top(pdf: pd.DataFrame, fan_out: int, local: int) -> pd.DataFrame:
    pdf = pdf.sort_values("place")
    levels = int(min(local, pdf.height.iloc[0]))
    top = _levels([d.hex() for d in pdf.leaf], levels, fan_out)[-1][0]
    return pd.DataFrame({"tree": pdf.tree.iloc[:1].to_numpy(), "idx": pdf.superblock.iloc[:1].to_numpy(), "digest": [top]})


def run_digest(*extra: Column) -> Column:
    """The digests of a run in order."""
    return F.transform(F.array_sort(F.collect_list(F.struct("idx", "digest"))), lambda n: n["digest"])


class Trees:
    """Trees over ``nodes`` (tree, idx, digest) with ``heights`` (tree, levels): the roots, and the
    outer nodes of each node, lowest level first, as (own position, siblings) pairs."""

    def __init__(self, scratch: Scratch, nodes: DataFrame, heights: DataFrame, fan_out: int):
        most = heights.agg(F.max("levels")).first()[0] or 0
        self.runs: list[DataFrame] = []
        level = nodes.join(heights, "tree").withColumnRenamed("levels", "left")
        ends = []
        for _ in range(most):
            ends.append(level.where("left = 0").select("tree", F.col("digest").alias("root")))
            run = (level.where("left > 0").withColumn("run", F.expr(f"idx div {fan_out}"))
                   .groupBy("tree", "run", "left").agg(run_digest().alias("members")))
            run = scratch.stored(run)
            self.runs.append(run)
            level = run.select("tree", F.col("run").alias("idx"), F.sha2(F.concat_ws("", "members"), 256).alias("digest"),
                               (F.col("left") - 1).alias("left"))
        ends.append(level.where("left = 0").select("tree", F.col("digest").alias("root")))
        roots = ends[0]
        for e in ends[1:]:
            roots = roots.unionByName(e)
        self.roots = scratch.stored(roots)
        self.outer = self._down(scratch, nodes, fan_out)

    def _down(self, scratch: Scratch, nodes: DataFrame, fan_out: int) -> DataFrame:
        none = F.array().cast("array<struct<at:int,siblings:array<string>>>")
        above = None  # outer nodes of the level above
        for run in reversed(self.runs):
            rows = run.select("tree", "run", "members")
            if above is not None:
                rows = rows.join(above.withColumnRenamed("idx", "run"), ["tree", "run"], "left")
            else:
                rows = rows.withColumn("outer", none)
            member = rows.select("tree", "run", "members", F.coalesce("outer", none).alias("above"), F.posexplode("members").alias("at", "_"))
            own = F.struct(F.col("at"), F.filter("members", lambda m, i: i != F.col("at")).alias("siblings"))
            above = scratch.stored(member.select("tree", (F.col("run") * fan_out + F.col("at")).alias("idx"),
                                                 F.concat(F.array(own), F.col("above")).alias("outer")))
        rows = nodes.select("tree", "idx")
        return (rows.withColumn("outer", none) if above is None else
                rows.join(above, ["tree", "idx"], "left").withColumn("outer", F.coalesce("outer", none)))


def fold(digest: str, path: list[tuple[int, list[str]]]) -> str:
    for at, siblings in path:
        digest = H([*siblings[:at], digest, *siblings[at:]])
    return digest


def _proven(leaves: pd.DataFrame, outer: pd.DataFrame, fan_out: int, local: int) -> pd.DataFrame:
    """One superblock: the local tree from its leaves, the path above from its outer nodes."""
    if not len(leaves):
        return pd.DataFrame({c.split()[0]: [] for c in _PROVEN.split(", ")})
    leaves = leaves.sort_values("place")
    levels = _levels([d.hex() for d in leaves.leaf], int(min(local, leaves.height.iloc[0])), fan_out)
    above = [(o["at"], list(o["siblings"])) for o in outer.outer.iloc[0]]
    subroot, root = outer.subroot.iloc[0], outer.root.iloc[0]
    above_text = "".join(s for _, siblings in above for s in siblings)
    proofs, folded = [], []
    for i, changed in enumerate(leaves.changed):
        path, k = [], i
        for level in levels[:-1]:
            first = k - k % fan_out
            path.append((k - first, level[first:k] + level[k + 1:first + fan_out]))
            k //= fan_out
        proofs.append(H([*(s for _, siblings in path for s in siblings), above_text]))
        folded.append(fold(levels[0][i] if changed is None else changed.hex(), path + above))
    return pd.DataFrame({"doc_id": leaves.doc_id.to_numpy(), "leaf": levels[0], "subroot": subroot, "root": root,
                         "proof_sha256": proofs, "folded_root": folded, "verified": [f == root for f in folded]})


def manifest(docs: DataFrame, fan_out: int = FAN_OUT, local: int = LOCAL_LEVELS) -> DataFrame:
    """One row per document: its leaf, subroot and root, the digest of its proof, and the root
    that the proof gives for the tampered document."""
    scratch = Scratch(docs.sparkSession, "merkle")
    size = fan_out ** local
    leaves = placed(scratch, scratch.stored(digests(docs)), ["lang"], ["doc_id", "leaf"])
    counts = leaves.groupBy("lang").agg(F.count(F.lit(1)).alias("leaves"))
    # languages in order; ``tree`` is the place of a language
    trees = scratch.stored(placed(scratch, counts, [], ["lang"], "tree").withColumn("height", height(F.col("leaves"), fan_out)))
    leaves = scratch.stored(
        leaves.alias("l").join(trees.alias("t"), F.col("l.lang").eqNullSafe(F.col("t.lang")))
        .select("tree", "height", "place", F.expr(f"place div {size}").alias("superblock"), "doc_id", "leaf", "changed"))

    tops = scratch.stored(leaves.select("tree", "superblock", "place", "height", "leaf").groupBy("tree", "superblock").applyInPandas(
        partial(_top, fan_out=fan_out, local=local), "tree long, idx long, digest string"))
    within = Trees(scratch, tops, trees.select("tree", F.greatest(F.lit(0), F.col("height") - local).alias("levels")), fan_out)

    one = F.lit(0).cast("long")
    langs = within.roots.select(one.alias("tree"), F.col("tree").alias("idx"), F.col("root").alias("digest"))
    over = Trees(scratch, langs, langs.groupBy("tree").agg(height(F.count(F.lit(1)), fan_out).alias("levels")), fan_out)

    of_lang = (over.outer.select(F.col("idx").alias("tree"), F.col("outer").alias("over"), one.alias("_all"))
               .join(over.roots.select(F.col("tree").alias("_all"), "root"), "_all").drop("_all")
               .join(within.roots.withColumnRenamed("root", "subroot"), "tree"))
    outer = (within.outer.join(of_lang, "tree")
             .select("tree", F.col("idx").alias("superblock"), F.concat("outer", "over").alias("outer"), "subroot", "root"))
    return leaves.groupBy("tree", "superblock").cogroup(outer.groupBy("tree", "superblock")).applyInPandas(
        partial(_proven, fan_out=fan_out, local=local), _PROVEN)
