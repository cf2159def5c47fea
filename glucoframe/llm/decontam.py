"""Benchmark decontamination with a broadcast hash set of test n-grams.

A window is ``width`` consecutive words of a test item (an item of fewer words is
one window). The windows are broadcast as sorted hashes behind a small bit table;
documents are scanned once, hashes that hit are verified word by word. The table
is cut into blocks of at most ``MAX_WINDOWS`` windows: one block is the usual
case and needs no shuffle; a larger benchmark is scanned block by block and the
hits, a few rows, are joined back to their documents.

Defined results: null texts have no words; items without words have no windows;
a null item id counts as the id "null"; equal ids are one item; rows with equal
doc ids are separate documents.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glucoframe.llm.textstream import _FOLD, NOT_ALNUM, Words, slices, text_buffers, windows, words_of

WIDTH = 10
MAX_WINDOWS = 200_000
SLICE_BYTES = 4 << 20
BIT_TABLE = 22

_HITS = "doc_id long, mark binary, spans array<int>, items array<string>"


def word_bytes(words: Words, i: int, j: int) -> bytes:
    """Words i..j-1, folded, joined by one space."""
    return b" ".join(_FOLD[words.data[a:b]].tobytes() for a, b in zip(words.starts[i:j], words.ends[i:j]))


def _item_windows(batches, width: int):
    """(item, length, hash, words) of every window of an item."""
    for batch in batches:
        ids = [str(x) if x is not None else "null" for x in batch.column("item_id").to_pylist()]
        data, offsets = text_buffers(batch.column("text"))
        w = words_of(data, offsets, NOT_ALNUM)
        rows = []
        for r, item in enumerate(ids):
            a, b = int(w.first[r]), int(w.first[r + 1])
            size = min(width, b - a)
            if size:
                for p, h in enumerate(windows(w.hashes[a:b], size)):
                    rows.append((item, size, int(h.view(np.int64)), word_bytes(w, a + p, a + p + size)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.binary()))],
            ["item", "size", "hash", "words"])


class WindowTable:
    """Windows of one block: per length the hashes, and by hash the words and items."""

    def __init__(self, rows):
        self.by_hash: dict[int, list[tuple[bytes, list[str]]]] = {}
        sizes: dict[int, set[int]] = {}
        for r in rows:
            sizes.setdefault(r["size"], set()).add(r["hash"])
            self.by_hash.setdefault(r["hash"], []).append((bytes(r["words"]), list(r["items"])))
        self.hashes = {s: np.sort(np.array(list(h), np.int64).view(np.uint64)) for s, h in sizes.items()}
        self.bits = {}
        for s, h in self.hashes.items():
            table = np.zeros(1 << BIT_TABLE, bool)
            table[(h >> np.uint64(64 - BIT_TABLE)).astype(np.int64)] = True
            self.bits[s] = table

    def occurrences(self, w: Words):
        """(word position, length, items) of every verified occurrence."""
        doc = None
        for size, hashes in self.hashes.items():
            h = windows(w.hashes, size)
            if not len(h):
                continue
            near = np.flatnonzero(self.bits[size][(h >> np.uint64(64 - BIT_TABLE)).astype(np.int64)])
            at = np.searchsorted(hashes, h[near])
            near = near[hashes[np.minimum(at, len(hashes) - 1)] == h[near]]
            if not len(near):
                continue
            if doc is None:
                doc = np.repeat(np.arange(len(w.first) - 1), w.counts)
            for p in near[doc[near] == doc[near + size - 1]]:
                words = word_bytes(w, p, p + size)
                for known, items in self.by_hash[int(h[p].view(np.int64))]:
                    if known == words:
                        yield int(p), size, int(doc[p]), items


def _tables(bench: DataFrame, width: int) -> list:
    """Broadcast window tables, each of at most MAX_WINDOWS distinct windows."""
    spark = bench.sparkSession
    rows = (bench.select("item_id", "text")
            .mapInArrow(partial(_item_windows, width=width), "item string, size int, hash long, words binary")
            .groupBy("size", "hash", "words").agg(F.collect_set("item").alias("items")))
    total = rows.count()
    blocks = max(1, -(-total // MAX_WINDOWS))
    tables = []
    for b in range(blocks):
        part = rows.where(F.pmod("hash", F.lit(2 * blocks)).isin(2 * b, 2 * b + 1)) if blocks > 1 else rows
        tables.append(spark.sparkContext.broadcast(WindowTable(part.collect())))
    return tables


def _scanned(batch, column, table: WindowTable):
    """(first row, words, merged hit spans and items by row) of slices of a batch."""
    data, offsets = text_buffers(batch.column(column))
    for i, j in slices(offsets, SLICE_BYTES):
        w = words_of(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], NOT_ALNUM)
        hits: dict[int, tuple[list, set]] = {}
        for p, size, row, items in table.occurrences(w):
            spans, found = hits.setdefault(row, ([], set()))
            spans.append((p - int(w.first[row]), p - int(w.first[row]) + size))
            found.update(items)
        yield i, w, {r: (merged(s), f) for r, (s, f) in hits.items()}


def merged(spans) -> list[tuple[int, int]]:
    """Sorted spans, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _report_batch(ids, n_words, spans, items):
    hit = [sum(b - a for a, b in s) for s in spans]
    sha = [hashlib.sha256(",".join(sorted(f)).encode()).hexdigest() for f in items]
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(n_words, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(f) for f in items], pa.int64()),
         pa.array(sha, pa.string()), pa.array([h > 0 for h in hit], pa.bool_())],
        ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


_REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _report(batches, table):
    for batch in batches:
        n = np.zeros(len(batch), np.int64)
        spans, items = [()] * len(batch), [()] * len(batch)
        for i, w, hits in _scanned(batch, "text", table.value):
            n[i:i + len(w.first) - 1] = w.counts
            for r, (s, f) in hits.items():
                spans[i + r], items[i + r] = s, f
        yield _report_batch(batch.column("doc_id"), n, spans, items)


def _block_hits(batches, table):
    """Rows of documents that a block hits, known by id and digest of the text."""
    for batch in batches:
        rows = []
        ids = batch.column("doc_id").to_pylist()
        for i, w, hits in _scanned(batch, "text", table.value):
            for r, (s, f) in hits.items():
                lo, hi = w.offsets[r], w.offsets[r + 1]
                rows.append((ids[i + r], hashlib.md5(w.data[lo:hi].tobytes()).digest(), [x for p in s for x in p], sorted(f)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[c] for r in rows], t) for c, t in
             enumerate((pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.string())))],
            ["doc_id", "mark", "spans", "items"])


def _pairs(flat) -> list[tuple[int, int]]:
    flat = flat or []
    return merged(zip(flat[::2], flat[1::2]))


def _with_hits(docs: DataFrame, tables) -> DataFrame:
    """``docs`` with the columns __spans and __items of all blocks."""
    hits = None
    for t in tables:
        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_block_hits, table=t), _HITS)
        hits = part if hits is None else hits.unionByName(part)
    hits = (hits.distinct().groupBy("doc_id", "mark")  # equal rows of a document give equal hits
            .agg(F.flatten(F.collect_list("spans")).alias("__spans"),
                 F.array_distinct(F.flatten(F.collect_list("items"))).alias("__items"))
            .select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), "__spans", "__items"))
    mark = F.unhex(F.md5(F.encode(F.coalesce("text", F.lit("")), "utf-8")))
    return docs.join(hits, F.col("doc_id").eqNullSafe(F.col("__id")) & (mark == F.col("__mark")), "left").drop("__id", "__mark")


def _report_joined(batches):
    for batch in batches:
        data, offsets = text_buffers(batch.column("text"))
        n = np.zeros(len(batch), np.int64)
        for i, j in slices(offsets, SLICE_BYTES):
            n[i:j] = words_of(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], NOT_ALNUM).counts
        yield _report_batch(batch.column("doc_id"), n, [_pairs(s) for s in batch.column("__spans").to_pylist()],
                            [f or () for f in batch.column("__items").to_pylist()])


def contamination(docs: DataFrame, bench: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per document: words, words in occurrences of test windows, the items found."""
    tables = _tables(bench, width)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if len(tables) == 1:
        return docs.mapInArrow(partial(_report, table=tables[0]), _REPORT)
    return _with_hits(docs, tables).mapInArrow(_report_joined, _REPORT)


def _cut(batches, schema, drop_share: float, table=None):
    """Batches without hit spans, and without documents that mostly consist of them."""
    for batch in batches:
        keep = np.ones(len(batch), bool)
        texts: dict[int, str] = {}
        if table is None:
            data, offsets = text_buffers(batch.column("text"))
            given = batch.column("__spans").to_pylist()
            found = []
            for r in (r for r, s in enumerate(given) if s):
                found.append((r, words_of(data[offsets[r]:offsets[r + 1]], np.array([0, offsets[r + 1] - offsets[r]]), NOT_ALNUM),
                              {0: (_pairs(given[r]), ())}))
        else:
            found = _scanned(batch, "text", table.value)
        for i, w, hits in found:
            for r, (spans, _) in hits.items():
                n = int(w.counts[r])
                if sum(b - a for a, b in spans) >= drop_share * n:
                    keep[i + r] = False
                    continue
                first, lo, hi = int(w.first[r]), int(w.offsets[r]), int(w.offsets[r + 1])
                parts, at = [], lo
                for a, b in spans:
                    parts.append(w.data[at:w.starts[first + a]].tobytes())
                    at = int(w.ends[first + b - 1])
                parts.append(w.data[at:hi].tobytes())
                texts[i + r] = b"".join(parts).decode("utf-8")
        yield replaced(batch, texts, schema).filter(pa.array(keep))


def replaced(batch: pa.RecordBatch, texts: dict[int, str], schema: list[str]) -> pa.RecordBatch:
    """``batch`` in the columns of ``schema`` with some new texts, and n_chars to match."""
    columns = {c: batch.column(c) for c in schema}
    if texts:
        old = columns["text"].to_pylist()
        for r, t in texts.items():
            old[r] = t
        columns["text"] = pa.array(old, columns["text"].type)
        if "n_chars" in columns:
            n = columns["n_chars"].to_pylist()
            for r, t in texts.items():
                n[r] = len(t)
            columns["n_chars"] = pa.array(n, columns["n_chars"].type)
    return pa.RecordBatch.from_arrays([columns[c] for c in schema], schema)


def decontaminated(docs: DataFrame, bench: DataFrame, width: int = WIDTH, drop_share: float = 0.5) -> DataFrame:
    """``docs`` (all columns) without occurrences of test windows: hit spans are cut out of
    the text, documents of which they make up ``drop_share`` of the words are removed.
    Documents without a hit stay as they are."""
    tables = _tables(bench, width)
    names = docs.columns
    if len(tables) == 1:
        return docs.mapInArrow(partial(_cut, schema=names, drop_share=drop_share, table=tables[0]), docs.schema)
    return _with_hits(docs, tables).mapInArrow(partial(_cut, schema=names, drop_share=drop_share), docs.schema)
