"""Hard-negative mining with anchor spanning-tree bounds.

Vectors are scaled, floored to integers and scored by inner product with anchors. Anchors
are dealt into blocks of one label (hyperplane signs, then a hash, so a hot label has many
blocks), and each block gets a minimum spanning tree that also holds the origin, on which
every row scores 0. A row c scored on a parent p bounds its score on the child a:

    |<a, c> - <p, c>| <= |a - p| * |c|

so a child starts from the parent's score plus or minus edge times norm, and only rows whose
interval meets a score window that still matters are scored again. Children of the origin
(anchors with no neighbour nearer than their own length) are scored in one matrix product.

Windows: for positives everything from the fifth best score known so far; for negatives
[low % of a positive's score, that score], cut at the fifth best known in it. What is known
comes from a first search among the anchors themselves, so the rows that tasks hand on
follow the number of anchors and not the number of tasks, and from the rows a task has seen.

Anchors are searched in waves of bounded bytes, each broadcast in turn; rows never move.

Defined results: rows with a null id, label or vector, or a null or non-finite component take
no part; an empty vector takes part with score 0; of vectors of unequal length the shorter
one counts as filled up with zeros. Repeated ids are rows of their own, but no row with the
anchor's id is its positive. Fewer rows than asked for: all of them. Scores that do not fit
64 bits raise OverflowError. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glucoframe.llm.scratch import Scratch

SCALE = 256
BLOCK = 512
WAVE_BYTES = 32 << 20
PLANES = 16
ROWS = 4096
_SLACK = 1 + 1e-9
_ANCHOR = "anchor_no long, vec_id long, label long, vector array<double>, norm double"
_FOREST = _ANCHOR + ", block long, node int, parent int, edge double"
_FOUND = "anchor_no long, slot int, vec_id long, score long"


def scaled_rows(batch: pa.RecordBatch, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, labels and the matrix of floor(scale * x) of the rows of a batch that take part."""
    vectors = batch.column("embedding")
    size = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    odd = ~np.isfinite(x)  # null components came as nan
    keep = np.ones(len(batch), bool)
    for name in ("vec_id", "label", "embedding"):
        keep &= batch.column(name).is_valid().to_numpy(zero_copy_only=False)
    size = np.where(vectors.is_valid().to_numpy(zero_copy_only=False), size, 0)
    row = np.repeat(np.arange(len(batch)), size)
    keep[row[odd]] = False
    place = np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size)
    full = np.zeros((len(batch), int(size.max(initial=0))))
    with np.errstate(invalid="ignore"):
        full[row, place] = np.floor(scale * x)
    ids = batch.column("vec_id").fill_null(0).to_numpy()
    labels = batch.column("label").fill_null(0).to_numpy()
    return ids[keep], labels[keep], full[keep]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers held in doubles: by doubles where they are exact, else by whole numbers."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    if not d or not a.size or not b.size:
        return np.zeros((len(a), len(b)))
    if np.abs(a).max() * np.abs(b).max() * d < 2.0 ** 53:
        return a @ b.T
    whole = np.frompyfunc(int, 1, 1)
    out = whole(a) @ whole(b).T
    if max(abs(out.min()), abs(out.max())) >= 2 ** 63:
        raise OverflowError("a score does not fit 64 bits")
    return out


def _anchors(batches: Iterable[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    """Anchors with their length and the sides of fixed random hyperplanes that they lie on."""
    for batch in batches:
        no = batch.column("anchor_no").to_numpy()
        whole = pa.RecordBatch.from_arrays([batch.column("anchor_no"), *(batch.column(c) for c in ("label", "embedding"))],
                                           ["vec_id", "label", "embedding"])
        kept, labels, x = scaled_rows(whole, scale)
        by = np.argsort(no)
        ids = batch.column("vec_id").to_numpy()[by[np.searchsorted(no, kept, sorter=by)]]
        planes = np.random.default_rng(11).standard_normal((PLANES, max(1, x.shape[1])))[:, :x.shape[1]]
        side = ((x @ planes.T) >= 0) @ (1 << np.arange(PLANES))
        yield pa.RecordBatch.from_arrays(
            [pa.array(kept), pa.array(ids), pa.array(labels), pa.array(list(x), pa.list_(pa.float64())),
             pa.array(np.sqrt((x * x).sum(axis=1))), pa.array(side.astype(np.int64))],
            ["anchor_no", "vec_id", "label", "vector", "norm", "side"])


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimum spanning tree of the rows and the origin by Prim's method. Returns the rows in
    an order in which parents come first, the parent of each (a place in that order, -1 for
    the origin) and the edge lengths."""
    n = len(x)
    squares = (x * x).sum(axis=1)
    edge, parent = np.sqrt(squares), np.full(n, -1)
    open_ = np.ones(n, bool)
    order, parents, edges = np.empty(n, int), np.empty(n, int), np.empty(n)
    for i in range(n):
        at = int(np.argmin(np.where(open_, edge, np.inf)))
        order[i], parents[i], edges[i] = at, parent[at], edge[at]
        open_[at] = False
        d = np.sqrt(((x - x[at]) ** 2).sum(axis=1))
        near = open_ & (d < edge)
        edge[near], parent[near] = d[near], i
    return order, parents, edges


def _tree(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("anchor_no").reset_index(drop=True)
    width = max(map(len, pdf.vector))
    x = np.zeros((len(pdf), width))
    for i, v in enumerate(pdf.vector):
        x[i, :len(v)] = v
    order, parents, edges = spanning_tree(x)
    out = pdf.iloc[order].reset_index(drop=True)
    out["block"], out["node"], out["parent"], out["edge"] = int(key[0]), np.arange(len(pdf)), parents, edges
    return out[["anchor_no", "vec_id", "label", "vector", "norm", "block", "node", "parent", "edge"]]


def forest(anchors: DataFrame, block: int = BLOCK) -> DataFrame:
    """Spanning trees of blocks of about ``block`` anchors of one label."""
    labels = anchors.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    bits = F.least(F.lit(PLANES), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / block)))).cast("int")
    sided = (anchors.join(labels, "label")
             .withColumn("bucket", F.col("side") % F.pow(F.lit(2), bits).cast("long")).drop("n"))
    buckets = sided.groupBy("label", "bucket").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))
    dealt = sided.join(buckets, ["label", "bucket"]).withColumn(
        "block", F.xxhash64("label", "bucket", F.pmod(F.xxhash64("anchor_no"), F.col("parts"))))
    # two blocks of one hash are told apart by their label
    return dealt.groupBy("block", "label").applyInPandas(_tree, _FOREST)


class Tree:
    """One block: nodes in an order in which parents come first."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values("node")
        self.label, self.no = rows.label.iloc[0], rows.anchor_no.to_numpy()
        self.ids, self.parent, self.edge = rows.vec_id.to_numpy(), rows.parent.to_numpy(), rows.edge.to_numpy()
        width = max(map(len, rows.vector))
        self.x = np.zeros((len(rows), width))
        for i, v in enumerate(rows.vector):
            self.x[i, :len(v)] = v
        self.children = np.bincount(self.parent[self.parent >= 0], minlength=len(rows))


class Windows:
    """Score windows of one anchor: [low, high] each, and the best ``top`` rows in each so far.
    ``low`` rises to the worst of them once there are ``top``."""

    def __init__(self, low: list[float], high: list[float], top: int):
        self.low, self.high, self.top = list(low), list(high), top
        self.best: list[list[tuple[int, int]]] = [[] for _ in low]

    def meets(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        out = np.zeros(len(lo), bool)
        for a, b in zip(self.low, self.high):
            out |= (hi >= a) & (lo <= b)
        return out

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        for i, (a, b) in enumerate(zip(self.low, self.high)):
            at = np.flatnonzero((scores >= a) & (scores <= b))
            if not len(at):
                continue
            found = self.best[i] + [(-int(s), int(r)) for s, r in zip(scores[at], ids[at])]
            found.sort()
            self.best[i] = found[:self.top]
            if len(self.best[i]) == self.top:
                self.low[i] = max(a, -self.best[i][-1][0])


class Search:
    """Rows against the trees of one wave; ``rescored`` counts the products below the roots."""

    def __init__(self, trees: list[Tree], windows: dict[int, Windows], same_label: bool):
        self.trees, self.windows, self.same_label = trees, windows, same_label
        self.bounded = self.rescored = 0

    def add(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        norms = np.sqrt((x * x).sum(axis=1))
        for tree in self.trees:
            at = np.flatnonzero((labels == tree.label) == self.same_label)
            if len(at):
                self._tree(tree, ids[at], x[at], norms[at])

    def _tree(self, tree: Tree, ids: np.ndarray, x: np.ndarray, norms: np.ndarray) -> None:
        roots = np.flatnonzero(tree.parent < 0)
        scores = products(tree.x[roots], x)
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        left = tree.children.copy()
        for k, node in enumerate(roots):
            self._keep(tree, node, ids, scores[k])
            if left[node]:
                known[node] = scores[k], scores[k]
        for node in np.flatnonzero(tree.parent >= 0):
            parent = tree.parent[node]
            lo, hi = known[parent]
            reach = tree.edge[node] * norms * _SLACK
            lo, hi = lo - reach, hi + reach
            w = self.windows.get(tree.no[node])
            if w is None:
                again = np.zeros(0, int)
            elif scores.dtype == object:  # beyond exact doubles: no bounds
                again = np.arange(len(ids))
            else:
                again = np.flatnonzero(w.meets(lo, hi))
            self.bounded += len(ids)
            self.rescored += len(again)
            if len(again):
                s = products(tree.x[node:node + 1], x[again])[0]
                lo[again] = hi[again] = s
                self._keep(tree, node, ids[again], s)
            if left[node]:
                known[node] = lo, hi
            left[parent] -= 1
            if not left[parent]:
                del known[parent]

    def _keep(self, tree: Tree, node: int, ids: np.ndarray, scores: np.ndarray) -> None:
        w = self.windows.get(tree.no[node])
        if w is None:
            return
        may = np.flatnonzero((scores >= min(w.low)) & (scores <= max(w.high)))
        if self.same_label:
            may = may[ids[may] != tree.ids[node]]
        if len(may):
            w.add(ids[may], scores[may])


def _search(batches, wave, scale: int, same_label: bool, top: int):
    trees, bounds = wave.value
    search = Search(trees, {no: Windows(low, high, top) for no, (low, high) in bounds.items()}, same_label)
    for batch in batches:
        for i in range(0, len(batch), ROWS):
            search.add(*scaled_rows(batch.slice(i, ROWS), scale))
    out = [(no, slot, r, -s) for no, w in search.windows.items() for slot, rows in enumerate(w.best) for s, r in rows]
    for i in range(0, len(out), 50_000):
        no, slot, ids, scores = zip(*out[i:i + 50_000])
        yield pa.RecordBatch.from_arrays([pa.array(no, pa.int64()), pa.array(slot, pa.int32()),
                                          pa.array(ids, pa.int64()), pa.array(scores, pa.int64())],
                                         ["anchor_no", "slot", "vec_id", "score"])


def _best(found: DataFrame, top: int) -> DataFrame:
    first = Window.partitionBy("anchor_no", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80,
                   scale: int = SCALE, block: int = BLOCK, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """For each anchor and each of its best ``positives`` rows of the same label, the best
    ``negatives`` rows of other labels that score from ``low`` % to 100 % of the positive.
    ``vectors``: vec_id, label, embedding."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "hard-negatives")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    chosen = scratch.stored(vectors.where(is_anchor & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding",
        F.monotonically_increasing_id().alias("anchor_no")))
    anchors = chosen.mapInArrow(partial(_anchors, scale=scale), _ANCHOR + ", side long")
    trees = scratch.stored(forest(anchors, block))
    size = trees.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width")).first()
    n_waves = max(1, -(-size["n"] * (8 * (size["width"] or 0) + 128) // wave_bytes))
    out = []
    for w in range(n_waves):
        wave = trees.where(F.pmod(F.xxhash64("block", "label"), F.lit(n_waves)) == w)
        table = wave.toPandas()  # at most about wave_bytes
        if len(table):
            out.append(_mined(scratch, rows, chosen.drop("anchor_no"), table, positives, negatives, low, scale))
    if not out:
        empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        return spark.createDataFrame([], empty)
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def _mined(scratch: Scratch, rows: DataFrame, seeds: DataFrame, table: pd.DataFrame, positives: int, negatives: int,
           low: int, scale: int) -> DataFrame:
    """The anchors of one wave against all rows."""
    spark = rows.sparkSession
    blocks = [Tree(t) for _, t in table.groupby(["block", "label"])]
    numbers = table.anchor_no.tolist()

    def searched(candidates: DataFrame, bounds: dict, same_label: bool, top: int) -> DataFrame:
        wave = spark.sparkContext.broadcast((blocks, bounds))
        return _best(candidates.mapInArrow(partial(_search, wave=wave, scale=scale, same_label=same_label, top=top), _FOUND), top)

    def raised(bounds: dict, found: DataFrame, top: int) -> dict:
        """Windows cut at the worst of ``top`` rows that are known already."""
        known = {(r["anchor_no"], r["slot"]): r["score"] for r in found.where(F.col("rank") == top).collect()}  # one per window
        return {no: ([max(a, known.get((no, i), a)) for i, a in enumerate(lo)], hi) for no, (lo, hi) in bounds.items()}

    every = {no: ([-np.inf], [np.inf]) for no in numbers}
    every = raised(every, searched(seeds, every, True, positives), positives)
    same = scratch.stored(searched(rows, every, True, positives))

    around: dict[int, tuple[list, list]] = {}
    for r in same.orderBy("anchor_no", "rank").collect():  # at most ``positives`` per anchor of the wave
        lo, hi = around.setdefault(r["anchor_no"], ([], []))
        hi.append(r["score"])
        lo.append(-(-low * r["score"] // 100))
    around = raised(around, searched(seeds, around, False, negatives), negatives)
    other = searched(rows, around, False, negatives)

    names = spark.createDataFrame(table[["anchor_no", "vec_id"]].rename(columns={"vec_id": "anchor_id"}), "anchor_no long, anchor_id long")
    pairs = same.select("anchor_no", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return scratch.stored(
        other.join(pairs, ["anchor_no", "slot"]).join(names, "anchor_no")
        .select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
