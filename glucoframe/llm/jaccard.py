"""N-gram Jaccard join by prefix filters under several global token orders.

A document is the set of its distinct ``k``-word shingles (64-bit hashes). Two
documents link when ``den * |x & y| >= num * |x | y|``. Equal sets are one class
and are handled once.

A global order puts shingles that a count sketch of the whole corpus finds
frequent behind the others, and breaks ties by a seeded hash; each seed gives
another order. Linked sets must share a token among the first
``n - ceil(t n) + 1`` tokens under EVERY order, and up to the last token that
both prefixes cover, the tokens that only one of them has are part of the
symmetric difference, whose size the threshold bounds. Both are necessary
conditions, so no link is lost. The first order is indexed; the candidates of a
bucket are filtered by size and position, then by the prefixes under all
orders. A parity sketch (each token flips one of ``PARITY_BITS`` bits) differs in
no more bits than the sets differ in tokens, which drops near misses, again
without losing a link. What is left is verified on the texts.

Hot buckets: up to ``ALL_PAIRS`` classes are paired directly. In a larger bucket
a leader is paired with the others, which joins a group of near copies
into one component without listing its pairs; the bucket then stays open, and a
second pass tries every class outside the bucket's largest component against the
classes of other components. The rows of a bucket pass through the first task one batch
at a time; in the second pass the classes outside the largest component and all classes
are dealt into blocks, and each pair of blocks is a group of its own. Every pair that shares an indexed token is thus
either tried or known to be connected.

The order is any fixed total order for the result to be right; the sketch only
makes prefixes selective. Its size is fixed (``CELLS`` counters), the table that
is sent to the executors is ``CELLS`` bytes.

Defined results: null text and text without words have no shingles, their
component is their own id; rows with equal ids are separate documents; a null id
stays null and never wins as the smallest id unless all ids are null.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glucoframe.llm.components import components
from glucoframe.llm.scratch import Scratch
from glucoframe.llm.textstream import Words, mix, release_memory, seeded, slices, text_buffers, windows, words_of

CELL_BITS = 20
CELLS = 1 << CELL_BITS
SKETCH_PARTS = 16
ORDERS = 3
ALL_PAIRS = 64
PARITY_BITS = 1024
SLICE_BYTES = 4 << 20
BLOCK_ROWS = 2048
BLOCK_TOKENS = 1 << 20
KEY_BITS = 58


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer than k words make one shingle."""
    grams = windows(words.hashes, k)
    first = words.first
    out = []
    for i in range(len(first) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= k:
            out.append(np.unique(grams[a:b - k + 1]))
        elif b > a:
            out.append(windows(words.hashes[a:b], int(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_key(shingles: np.ndarray) -> int:
    """64-bit key of a set, as a signed integer; 0 is the empty set."""
    if not len(shingles):
        return 0
    with np.errstate(over="ignore"):
        total = np.array([seeded(shingles, 11).sum(dtype=np.uint64) + np.uint64(len(shingles))])
    return int(mix(total).view(np.int64)[0])


def _texts(batch: pa.RecordBatch, column: str, k: int):
    """(row, set) of every text, in slices of bounded size."""
    data, offsets = text_buffers(batch.column(column))
    for i, j in slices(offsets, SLICE_BYTES):
        part = words_of(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
        yield from zip(range(i, j), shingle_sets(part, k))


def _survey(batches, k: int):
    """Per document (id, n, class); per task the counters of its shingles, in parts."""
    cells = np.zeros(CELLS, np.int64)
    total = 0
    for batch in batches:
        n, key = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
        held = []
        for row, s in _texts(batch, "text", k):
            n[row], key[row] = len(s), class_key(s)
            held.append(s)
            if sum(map(len, held[-64:])) and len(held) >= 512:
                cells += np.bincount((np.concatenate(held) >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=CELLS)
                held = []
        if held:
            cells += np.bincount((np.concatenate(held) >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=CELLS)
        total += int(n.sum())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n), pa.array(key),
             pa.nulls(len(batch), pa.int32()), pa.nulls(len(batch), pa.binary())],
            ["doc_id", "n", "cls", "part", "cells"])
    if total:
        z = zstandard.ZstdCompressor()
        parts = np.split(np.minimum(cells, 2 ** 31 - 1).astype(np.int32), SKETCH_PARTS)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(SKETCH_PARTS, pa.int64()), pa.nulls(SKETCH_PARTS, pa.int64()), pa.nulls(SKETCH_PARTS, pa.int64()),
             pa.array(range(SKETCH_PARTS), pa.int32()), pa.array([z.compress(p.tobytes()) for p in parts], pa.binary())],
            ["doc_id", "n", "cls", "part", "cells"])
    release_memory()


def _add_parts(batches):
    """Sum of the counters of each part, over any number of rows."""
    sums: dict[int, np.ndarray] = {}
    z = zstandard.ZstdDecompressor()
    for batch in batches:
        for part, raw in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist()):
            add = np.frombuffer(z.decompress(raw), np.int32).astype(np.int64)
            sums[part] = sums[part] + add if part in sums else add
    for part, s in sums.items():
        raw = zstandard.ZstdCompressor().compress(np.minimum(s, 2 ** 31 - 1).astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([raw], pa.binary())], ["part", "cells"])


def frequency_classes(cells: np.ndarray) -> np.ndarray:
    """0 for counters that hold what chance puts there, then one class per doubling."""
    load = cells.mean()
    over = (cells - load) / (4 * np.sqrt(load) + 8)
    return np.where(over > 1, 1 + np.floor(np.log2(np.maximum(over, 1))), 0).astype(np.uint8)


def prefix_length(n, num: int, den: int):
    return n - -(-num * n // den) + 1


def order_keys(shingles: np.ndarray, classes: np.ndarray, order: int) -> np.ndarray:
    """Keys whose order is the global order ``order``; below 2**63."""
    cls = np.minimum(classes[(shingles >> np.uint64(64 - CELL_BITS)).astype(np.int64)], 31).astype(np.uint64)
    return (cls << np.uint64(KEY_BITS)) | (seeded(shingles, 20 + order) >> np.uint64(64 - KEY_BITS))


def parity(shingles: np.ndarray) -> bytes:
    """Each token flips one bit: two sketches differ in at most as many bits as the sets in tokens."""
    at = (seeded(shingles, 40) & np.uint64(PARITY_BITS - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=PARITY_BITS) & 1).astype(np.uint8)).tobytes()


def _sketches(column: pa.Array) -> np.ndarray:
    """Parity sketches as rows of 64-bit numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _prefixes(batches, k: int, num: int, den: int, table):
    """One row per class that a task sees: its prefixes under all orders."""
    classes = table.value
    seen: set[int] = set()
    for batch in batches:
        rows: list[tuple] = []
        for _, s in _texts(batch, "text", k):
            key = class_key(s)
            if not len(s) or key in seen:
                continue
            if len(seen) < 2_000_000:  # only spares repeated rows, the caller removes the others
                seen.add(key)
            p = prefix_length(len(s), num, den)
            sides = [np.sort(order_keys(s, classes, o))[:p] for o in range(ORDERS)]
            rows.append((key, len(s), sides[0].astype(np.int64), sides[1:], parity(s)))
        lists = [_lists([r[2] for r in rows], pa.int64())]
        for o in range(ORDERS - 1):
            # later orders only filter, 31 bits are enough (equal tokens stay equal)
            lists.append(_lists([_short(r[3][o]) for r in rows], pa.int32()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
             pa.array([r[4] for r in rows], pa.binary()), *lists],
            ["cls", "n", "odd", *(f"o{i}" for i in range(ORDERS))])
    release_memory()


def _short(keys: np.ndarray) -> np.ndarray:
    """31 bits of each key that keep its frequency class and order: 5 bits class, 26 bits hash."""
    return (keys >> np.uint64(KEY_BITS + 5 - 31)).astype(np.int32)


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def most_apart(n, m, num: int, den: int):
    """The largest symmetric difference of linked sets of n and m tokens."""
    return n + m - 2 * least_shared(n, m, num, den)


def _close(na, nb, i, j, num, den):
    return (den * np.minimum(na, nb) >= num * np.maximum(na, nb)) & (np.abs(i - j) <= most_apart(na, nb, num, den))


def _bucket_pairs(batches, num: int, den: int):
    """Rows (token, cls, n, pos), sorted by token and in a fixed order within it -> candidate
    pairs; (token) of open buckets. The first row of an open bucket is its leader; no more
    than a batch and a small bucket is held."""
    names = ("token", "cls", "n", "pos")

    def small_pairs(tok, cls, n, pos):
        """Pairs of whole buckets of up to ALL_PAIRS classes."""
        order = np.lexsort((cls, tok))
        tok, cls, n, pos = tok[order], cls[order], n[order], pos[order]
        start = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]])
        size = np.diff(np.r_[start, len(tok)])
        # small buckets of one size at a time: all their pairs in one go
        for z in np.unique(size[(size > 1) & (size <= ALL_PAIRS)]):
            at = start[size == z]
            ii, jj = np.triu_indices(z, 1)
            step = max(1, 2_000_000 // len(ii))
            for s in range(0, len(at), step):
                a = (at[s:s + step, None] + ii).ravel()
                b = (at[s:s + step, None] + jj).ravel()
                ok = _close(n[a], n[b], pos[a], pos[b], num, den)
                a, b = a[ok], b[ok]
                yield pd.DataFrame({"a": cls[a], "b": cls[b], "na": n[a], "nb": n[b], "i": pos[a], "j": pos[b], "forced": False})

    def leader_pairs(lead, cls, n, pos):
        """Rows of an open bucket with its leader."""
        _, c, m, p = lead
        ok = _close(n, m, pos, p, num, den) & (cls != c)
        cls, n, pos = cls[ok], n[ok], pos[ok]
        less = cls < c
        return pd.DataFrame({"a": np.where(less, cls, c), "b": np.where(less, c, cls), "na": np.where(less, n, m), "nb": np.where(less, m, n),
                             "i": np.where(less, pos, p), "j": np.where(less, p, pos), "forced": True})

    def sent(f):
        return pa.RecordBatch.from_pandas(
            f.reindex(columns=["a", "b", "na", "nb", "i", "j", "forced", "token"]), schema=_PAIR_SCHEMA, preserve_index=False)

    carry, lead = None, None
    for batch in batches:
        rows = [batch.column(c).to_numpy() for c in names]
        if lead is not None:
            go = int(np.searchsorted(rows[0], lead[0], side="right"))
            yield sent(leader_pairs(lead, *(r[:go] for r in rows[1:])))
            rows = [r[go:] for r in rows]
        if carry is not None:
            rows = [np.concatenate([c, r]) for c, r in zip(carry, rows)]
        if not len(rows[0]):
            continue
        lead = None
        new = np.r_[True, (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])]
        rows = [r[new] for r in rows]
        start = np.flatnonzero(np.r_[True, rows[0][1:] != rows[0][:-1]])
        ends = np.r_[start[1:], len(rows[0])]
        opened = np.flatnonzero(ends - start > ALL_PAIRS)
        for s, e in zip(start[opened], ends[opened]):
            lead = tuple(r[s] for r in rows)
            yield sent(leader_pairs(lead, *(r[s:e] for r in rows[1:])))
        if len(opened):
            yield sent(pd.DataFrame({"token": rows[0][start[opened]]}))
        if lead is not None and lead[0] != rows[0][-1]:
            lead = None
        carry = None if lead is not None else [r[start[-1]:] for r in rows]
        yield from map(sent, small_pairs(*(r[:start[-1]] for r in rows)))
    if carry is not None:
        yield from map(sent, small_pairs(*carry))
    release_memory()


_PAIR_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("na", pa.int64()), ("nb", pa.int64()),
                          ("i", pa.int32()), ("j", pa.int32()), ("forced", pa.bool_()), ("token", pa.int64())])
_PAIRS = "a long, b long, na long, nb long, i int, j int, forced boolean, token long"


def least_shared(n, m, num: int, den: int):
    """The smallest intersection of linked sets of n and m tokens."""
    return -(-num * (n + m) // (num + den))


def shares_prefix(x: np.ndarray, y: np.ndarray, only_x: int, only_y: int) -> bool:
    """Whether sorted prefixes share a token and, up to the last token that both cover, at
    most only_x and only_y tokens are on one side alone."""
    end = min(x[-1], y[-1])
    x, y = x[:np.searchsorted(x, end, side="right")], y[:np.searchsorted(y, end, side="right")]
    if not _common(x, y):
        return False
    # tokens that have the key of the end may go on behind a prefix: only those before it count
    x, y = x[:np.searchsorted(x, end)], y[:np.searchsorted(y, end)]
    shared = _common(x, y)
    return len(x) - shared <= only_x and len(y) - shared <= only_y


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Number of shared keys; at least that where keys of one side repeat."""
    both = np.concatenate([x, y])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def _filter_parity(batches, num: int, den: int):
    """Keep the pairs whose parity sketches are no further apart than linked sets can be."""
    for batch in batches:
        n, m = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
        apart = np.bitwise_count(_sketches(batch.column("xodd")) ^ _sketches(batch.column("yodd"))).sum(axis=1, dtype=np.int64)
        yield batch.select(["a", "b"]).filter(pa.array(apart <= most_apart(n, m, num, den)))


def _filter_orders(batches, num: int, den: int):
    """Keep the pairs whose prefixes agree with a link under every order."""
    for batch in batches:
        n, m = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
        both = least_shared(n, m, num, den)
        only_x, only_y = n - both, m - both
        keep = np.ones(len(batch), bool)
        for o in range(ORDERS):
            x, y = batch.column(f"x{o}"), batch.column(f"y{o}")
            xo, yo = x.offsets.to_numpy(), y.offsets.to_numpy()
            xv, yv = x.values.to_numpy(), y.values.to_numpy()
            for r in np.flatnonzero(keep):
                keep[r] = shares_prefix(xv[xo[r]:xo[r + 1]], yv[yo[r]:yo[r + 1]], only_x[r], only_y[r])
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _verify(batches, k: int, num: int, den: int):
    """Exact Jaccard test of (a, b, text_a, text_b)."""
    for batch in batches:
        keep = np.zeros(len(batch), bool)
        left = dict(_texts(batch, "text_a", k))
        for row, y in _texts(batch, "text_b", k):
            x = left.pop(row)
            shared = _common(x, y)
            keep[row] = shared > 0 and den * shared >= num * (len(x) + len(y) - shared)
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _links(pairs: DataFrame, classes: DataFrame, reps: DataFrame, docs: DataFrame, k, num, den,
           scratch: Scratch) -> DataFrame:
    """Candidate pairs (a, b) -> stored links (a, b)."""
    def side(table: DataFrame, key: str, n: str, odd: str | None = None, lists: str | None = None) -> DataFrame:
        kept = [F.col("odd").alias(odd)] if odd else [F.col(f"o{o}").alias(f"{lists}{o}") for o in range(ORDERS)]
        return table.select(F.col("cls").alias(key), F.col("n").alias(n), *kept)

    pairs = pairs.select("a", "b")
    # sizes and sketches first; the lists of what parity leaves
    near = scratch.stored(pairs.join(side(classes, "a", "na", odd="xodd"), "a").join(side(classes, "b", "nb", odd="yodd"), "b")
                          .mapInArrow(partial(_filter_parity, num=num, den=den), "a long, b long"))
    ids = near.select(F.col("a").alias("cls")).unionByName(near.select(F.col("b").alias("cls"))).distinct()
    met = classes.join(ids, "cls", "left_semi")
    cand = scratch.stored(near.join(side(met, "a", "na", lists="x"), "a").join(side(met, "b", "nb", lists="y"), "b")
                          .mapInArrow(partial(_filter_orders, num=num, den=den), "a long, b long"))
    scratch.drop(near)
    wanted = cand.select(F.col("a").alias("cls")).unionByName(cand.select(F.col("b").alias("cls"))).distinct()
    wanted = wanted.join(reps, "cls")
    # rows of the wanted ids, each once, then those of a wanted class (repeated and null ids)
    ids = wanted.select("rep").distinct()
    texts = (docs.join(ids, docs["doc_id"].eqNullSafe(ids["rep"]), "left_semi").select("text")
             .mapInArrow(partial(_with_class, k=k, names=["text"]), "text string, __cls long").withColumnRenamed("__cls", "cls"))
    texts = texts.join(wanted.select("cls"), "cls", "left_semi").dropDuplicates(["cls"]).select("cls", "text")
    texts = scratch.stored(texts)
    both = (cand.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a")), "a")
            .join(texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b")), "b")
            .select("a", "b", "text_a", "text_b"))
    links = scratch.stored(both.mapInArrow(partial(_verify, k=k, num=num, den=den), "a long, b long"))
    scratch.drop(cand, texts)
    return links


def _across(tok: int, cls, n, root, stray, member, sketch, offs, flat, opens, num: int, den: int):
    """Pairs of one block of an open bucket: each stray class (outside its largest component)
    against the members of other components, by the tokens that both prefixes cover and by parity."""
    uniq, inv = np.unique(flat, return_inverse=True)
    lens = np.diff(offs)
    last = flat[offs[1:] - 1]
    mark = np.zeros(len(uniq), bool)
    out = []
    for x in np.flatnonzero(stray):
        both = least_shared(n[x], n, num, den)
        apart = np.bitwise_count(sketch ^ sketch[x]).sum(axis=1, dtype=np.int64)
        ok = (member & (root != root[x]) & (apart <= n + n[x] - 2 * both)
              & (den * np.minimum(n, n[x]) >= num * np.maximum(n, n[x])))
        if not ok.any():
            continue
        own = inv[offs[x]:offs[x + 1]]
        mark[own] = True
        shared = np.add.reduceat(mark[inv], offs[:-1], dtype=np.int64)
        mark[own] = False
        end = np.minimum(last, last[x])
        in_y = np.add.reduceat(flat <= np.repeat(end, lens), offs[:-1], dtype=np.int64)
        in_x = np.searchsorted(flat[offs[x]:offs[x + 1]], end, side="right")
        ok &= (in_x - shared <= n[x] - both) & (in_y - shared <= n - both)
        # a pair is sent from the first of its open buckets only
        before = opens(x)
        before = before[before < tok]
        out += [(min(cls[x], cls[y]), max(cls[x], cls[y])) for y in np.flatnonzero(ok) if not np.isin(before, opens(y)).any()]
    return out


def _open_pairs(batches, num: int, den: int):
    """Rows of blocks (token, i, j), sorted by them -> candidate pairs."""
    held: list[pa.RecordBatch] = []
    last = None

    def done():
        t = pa.Table.from_batches(held).combine_chunks()
        o0, opens = t.column("o0").combine_chunks(), t.column("opens").combine_chunks()
        offs, of = (c.offsets.to_numpy().astype(np.int64) for c in (o0, opens))
        flat, tokens = o0.values.to_numpy()[offs[0]:offs[-1]], opens.values.to_numpy()
        pairs = _across(last[0], *(t.column(c).to_numpy() for c in ("cls", "n", "root", "stray", "member")),
                        _sketches(t.column("odd")), offs - offs[0], flat, lambda x: tokens[of[x]:of[x + 1]], num, den)
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])

    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("token", "i", "j")])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), len(batch)]
        for s, e in zip(cuts, cuts[1:]):
            if e == s:
                continue
            key = tuple(keys[:, s].tolist())
            if held and key != last:
                yield done()
                held = []
            last = key
            held.append(batch.slice(s, e - s))
    if held:
        yield done()
    release_memory()


def _open_rows(index: DataFrame, opened: DataFrame, roots: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Rows of the open buckets that hold more than one component, with the prefix of each class,
    in blocks (token, i, j): the i-th block of the classes outside the largest component with
    the j-th block of all classes."""
    rows = (index.select("token", "cls", "n").join(opened, "token", "left_semi")
            .join(roots, F.col("cls") == F.col("v"), "left")
            .select("token", "cls", F.coalesce("root", "cls").alias("root"),
                    (F.col("n") - F.ceil(F.lit(num) * F.col("n") / F.lit(den) - 1e-9) + 1).alias("p")))
    per = rows.groupBy("token", "root").agg(F.count(F.lit(1)).alias("c"), F.sum("p").alias("w"))
    top = per.groupBy("token").agg(F.max(F.struct("c", "root", "w")).alias("top"), F.count(F.lit(1)).alias("roots"),
                                   F.sum("c").alias("c"), F.sum("w").alias("w")).where("roots > 1")

    def blocks(c, w):
        return F.greatest(F.ceil(c / BLOCK_ROWS), F.ceil(w / BLOCK_TOKENS))

    top = top.select("token", F.col("top.root").alias("top"), blocks(F.col("c"), F.col("w")).alias("nj"),
                     blocks(F.col("c") - F.col("top.c"), F.col("w") - F.col("top.w")).alias("ni"))
    rows = rows.join(top, "token")
    # at most a prefix long
    opens = rows.groupBy("cls").agg(F.collect_list("token").alias("opens"))
    rows = (rows.withColumn("stray", F.col("root") != F.col("top"))
            .withColumn("own_i", F.pmod(F.xxhash64("cls", F.lit(1)), "ni")).withColumn("own_j", F.pmod(F.xxhash64("cls", F.lit(2)), "nj")))
    zero = F.lit(0).cast("long")
    as_member = F.transform(F.sequence(zero, F.col("ni") - 1), lambda i: F.struct(
        i.alias("i"), F.col("own_j").alias("j"), F.lit(True).alias("member"), (F.col("stray") & (i == F.col("own_i"))).alias("stray")))
    as_stray = F.transform(F.filter(F.sequence(zero, F.col("nj") - 1), lambda j: F.col("stray") & (j != F.col("own_j"))), lambda j: F.struct(
        F.col("own_i").alias("i"), j.alias("j"), F.lit(False).alias("member"), F.lit(True).alias("stray")))
    rows = rows.select("token", "cls", "root", F.explode(F.concat(as_member, as_stray)).alias("b"))
    return (rows.join(opens, "cls").join(classes.select("cls", "n", "odd", "o0"), "cls")
            .select("token", "b.i", "b.j", "cls", "n", "root", "b.stray", "b.member", "odd", "opens", "o0"))


def _rooted_classes(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, cls) of every document; (cls, smallest doc_id, root of the component) of every class."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    survey = scratch.stored(docs.mapInArrow(
        partial(_survey, k=k), "doc_id long, n long, cls long, part int, cells binary"))
    docs_cls = survey.where("part is null").select("doc_id", "n", "cls")
    cells = np.zeros(CELLS, np.int64)
    summed = (survey.where("part is not null").select("part", "cells").repartition(SKETCH_PARTS, "part")
              .mapInArrow(_add_parts, "part int, cells binary").collect())  # CELLS counters, whatever the input
    for r in summed:
        step = CELLS // SKETCH_PARTS
        cells[r["part"] * step:(r["part"] + 1) * step] = np.frombuffer(
            zstandard.ZstdDecompressor().decompress(r["cells"]), np.int32)
    table = spark.sparkContext.broadcast(frequency_classes(cells))
    fields = "cls long, n long, odd binary, " + ", ".join(f"o{o} array<{'long' if o == 0 else 'int'}>" for o in range(ORDERS))
    classes = scratch.stored(docs.mapInArrow(partial(_prefixes, k=k, num=num, den=den, table=table), fields)
                             .dropDuplicates(["cls"]))
    reps = docs_cls.where("cls != 0").groupBy("cls").agg(F.min("doc_id").alias("rep"))
    index = classes.select("cls", "n", F.posexplode("o0").alias("pos", "token"))
    found = scratch.stored(index.select("token", "cls", "n", "pos").repartition("token")
                           .sortWithinPartitions("token", F.xxhash64("cls", "token"))
                           .mapInArrow(partial(_bucket_pairs, num=num, den=den), _PAIRS))
    # a pair that meets in whole buckets only: the shared tokens are all counted
    pairs = found.where("token is null").groupBy("a", "b").agg(
        F.first("na").alias("na"), F.first("nb").alias("nb"), F.count(F.lit(1)).alias("s"),
        F.max("i").alias("i"), F.max("j").alias("j"), F.max("forced").alias("forced"))
    most = F.col("na") + F.col("nb") - 2 * F.ceil(F.lit(num) * (F.col("na") + F.col("nb")) / F.lit(num + den) - 1e-9)

    def cut(n):
        return F.col(n) - F.ceil(F.lit(num) * F.col(n) / F.lit(den) - 1e-9) + 1

    apart = F.least(cut("na") + F.col("j") + 1, F.col("i") + 1 + cut("nb")) - 2 * F.col("s")
    pairs = pairs.where(F.col("forced") | (apart <= most)).select("a", "b")
    links = _links(pairs, classes, reps, docs, k, num, den, scratch)
    opened = scratch.stored(found.where("token is not null").select("token").distinct())
    scratch.drop(found)
    roots = components(links, scratch)
    if not opened.isEmpty():
        rows = _open_rows(index, opened, roots, classes, num, den)
        more = (rows.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
                .mapInArrow(partial(_open_pairs, num=num, den=den), "a long, b long").distinct())
        links = links.unionByName(_links(more, classes, reps, docs, k, num, den, scratch))
        roots = components(links, scratch)
    scratch.drop(classes, opened)
    rooted = (reps.join(roots, F.col("cls") == F.col("v"), "left")
              .select("cls", "rep", F.coalesce("root", "cls").alias("root")))
    return docs_cls, rooted


def jaccard_groups(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """One row per document of ``docs(doc_id, text)``: doc_id, n_shingles, component_id
    (smallest doc_id reachable by links of at least num/den)."""
    docs_cls, rooted = _rooted_classes(docs, k, num, den)
    label = rooted.groupBy("root").agg(F.min("rep").alias("least"))
    named = rooted.join(label, "root").select("cls", "least")
    return (docs_cls.join(named, "cls", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("cls") == 0, F.col("doc_id")).otherwise(F.col("least")).alias("component_id")))


def _with_class(batches, k: int, names: list[str]):
    for batch in batches:
        key = np.zeros(len(batch), np.int64)
        for row, s in _texts(batch, "text", k):
            key[row] = class_key(s)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(key)], [*names, "__cls"])


def one_of_each_group(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` (all columns) with one row of each group: of the class of its smallest doc_id.
    Rows without words stay, they are linked with nothing."""
    _, rooted = _rooted_classes(docs, k, num, den)
    best = rooted.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull(), "rep", "cls")).alias("m"))
    keepers = best.select(F.col("m.cls").alias("__k"), F.col("m.rep").alias("__rep"))
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("__cls", T.LongType())])
    keyed = docs.mapInArrow(partial(_with_class, k=k, names=names), schema)
    kept = keyed.join(keepers, (F.col("__cls") == F.col("__k")) & F.col("doc_id").eqNullSafe(F.col("__rep")), "left")
    kept = kept.where("__cls = 0 OR __k IS NOT NULL")
    # equal rows of the chosen document
    same = Window.partitionBy("__cls", "doc_id").orderBy("text")
    return (kept.withColumn("__r", F.row_number().over(same)).where("__cls = 0 OR __r = 1").select(*names))
