"""Best-fit packing with exact-complement hashing.

Texts are tokenized (vocabulary file by path), end with one separator id and are
cut into pieces of at most ``size`` tokens. The packing is planned on the
histogram of piece lengths (at most ``size`` numbers, whatever the input): from
the longest length down, the gap of a sequence is looked up in an index of the
sums of one, two and three lengths, and combinations that fill it exactly are
used up under the availability counts; what is left is packed best-fit. A plan
is a list of patterns with multiplicities, that is ranges of ranks per length.
Pieces get their rank within their length by salted windows, so that a length
that a third of all pieces share is spread over many tasks.

Defined results: null and empty texts are one piece of one token (the separator);
rows with equal ids are separate documents.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections import defaultdict
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glucoframe.llm.scratch import Scratch
from glucoframe.llm.textstream import SPACE, Words, release_memory, slices, spans_of, text_buffers, words_of

SIZE = 2048
SEPARATOR = 0
CACHED = 120_000
RANKED_TOGETHER = 500
SLICE_BYTES = 6 << 20
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: pieces that the vocabulary's splitter makes of a folded word (a fixed value of that file):
#: 's|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+
#: Bytes by kind: 0 white space, 1 letter, 2 digit, 3 other, 4 not told by its byte.
_KIND = np.full(256, 4, np.uint8)
_KIND[0x20:0x7F] = 3
_KIND[SPACE] = 0
for _lo, _hi, _k in ((0x30, 0x39, 2), (0x41, 0x5A, 1), (0x61, 0x7A, 1), (0x80, 0xBF, 1), (0xC3, 0xC8, 1)):
    _KIND[_lo:_hi + 1] = _k  # C3 to C8 lead U+00C0 to U+023F: letters, but for those below
_KIND[ord("'")] = 4
_NOT_LETTERS = ((0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0))  # U+00D7, U+00F7; U+0130 folds to two characters


def _byte_letters() -> dict[int, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others follow U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = [b for b in range(256) if b not in own]
    return {b: 0x100 + i for i, b in enumerate(other)}


_BYTE_LETTERS = _byte_letters()


class PieceCache(dict):
    """ids (as little-endian bytes) of pieces; a bounded cache of two generations."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.older: dict[bytes, bytes] = {}

    def whole(self, word: bytes) -> bytes:
        """A word that may fall into several pieces, by the whole tokenizer."""
        return np.asarray(self.tokenizer.encode(word.decode("utf-8"), add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, piece: bytes) -> bytes:
        """One piece, by the tokenizer's model."""
        ids = self.older.get(piece)
        if ids is None:
            if piece.isascii():
                letters = piece.decode("ascii").lower()
            else:
                letters = piece.decode("utf-8").lower().encode("utf-8").decode("latin-1").translate(_BYTE_LETTERS)
            t = [x.id for x in self.model.tokenize(letters)]
            ids = struct.pack(f"<{len(t)}I", *t)
        if len(self) >= CACHED:
            self.older = dict(self)
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


def split_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    """Pieces of texts, and whether one is a whole word that only the tokenizer can split.

    The tokenizer never joins characters across white space, and under its rule a
    word of ASCII and Latin letters falls into runs of letters, single digits and
    runs of other characters. Words with other characters or an apostrophe stay whole."""
    n = len(data)
    kind = _KIND[data]
    for lead, then in _NOT_LETTERS:
        at = np.flatnonzero((data[:-1] == lead) & (data[1:] == then))
        kind[at] = 4
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    space = kind == 0
    begin, stop = ~space, ~space
    begin[1:] &= space[:-1] | edge[1:n]
    stop[:-1] &= space[1:] | edge[1:n]
    odd = kind == 4
    if odd.any():
        # bytes of words that hold an odd byte
        word = np.cumsum(begin) - 1
        has = np.zeros(int(word[-1]) + 1, bool)
        has[word[odd]] = True
        odd = has[word] & ~space
    same = (kind[1:] == kind[:-1]) & (kind[1:] != 2) & ~edge[1:n]
    begin[1:] |= ~same & ~odd[1:] & ~space[1:]
    stop[:-1] |= ~same & ~odd[:-1] & ~space[:-1]
    pieces = spans_of(data, offsets, begin, stop)
    return pieces, odd[pieces.starts]


def token_ids(data: np.ndarray, offsets: np.ndarray, cache: PieceCache) -> tuple[np.ndarray, np.ndarray]:
    """ids of texts that lie one after another, each followed by the separator; and the
    text offsets in them. Every distinct piece is looked up once (the vocabulary folds
    A-Z as the hash does)."""
    w, odd = split_pieces(data, offsets) if len(data) else (words_of(data, offsets), np.zeros(0, bool))
    _, at, inverse = np.unique(w.hashes + odd, return_index=True, return_inverse=True)
    raw = data.tobytes()
    found = [cache.whole(raw[a:b]) if o else cache[raw[a:b]]
             for a, b, o in zip(w.starts[at].tolist(), w.ends[at].tolist(), odd[at].tolist())]
    flat = np.frombuffer(b"".join(found), "<u4")
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    begin = np.cumsum(sizes) - sizes
    # the separator is one more word at the end of each text
    n = len(offsets) - 1
    flat = np.append(flat, np.uint32(SEPARATOR))
    sizes, begin = np.append(sizes, 1), np.append(begin, len(flat) - 1)
    word = np.insert(inverse, w.first[1:], len(found))
    size = sizes[word]
    end = np.cumsum(size)
    last = w.first[1:] + np.arange(n)  # place of each separator
    ids = flat[np.repeat(begin[word] - (end - size), size) + np.arange(end[-1] if len(end) else 0)]
    return ids, np.concatenate([[0], end[last]])


def _pieces(batches, path: str, size: int):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    cache = PieceCache(path)  # a task's own: an idle worker keeps no memory
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    for batch in batches:
        docs = batch.column("doc_id").to_pylist()
        data, offsets = text_buffers(batch.column("text"))
        for i, j in slices(offsets, SLICE_BYTES):
            ids, bounds = token_ids(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], cache)
            raw, bounds = ids.astype("<u4").tobytes(), bounds.tolist()
            rows = [(docs[i + r], k, at, min(size, hi - lo - at), zlib.crc32(raw[4 * (lo + at):4 * min(lo + at + size, hi)]))
                    for r, (lo, hi) in enumerate(zip(bounds, bounds[1:]))
                    for k, at in enumerate(range(0, hi - lo, size))]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32"])
    del cache
    release_memory()


class SumIndex:
    """Sums of two lengths: for each sum the lengths a <= b that make it."""

    def __init__(self, lengths: list[int], size: int):
        self.of: dict[int, list[tuple[int, int]]] = defaultdict(list)
        lengths = sorted(lengths, reverse=True)
        for i, a in enumerate(lengths):
            for b in lengths[i:]:
                if a + b <= size:
                    self.of[a + b].append((a, b))

    def fills(self, gap: int, left: dict[int, int]):
        """Combinations of one, two or three available lengths that sum up to ``gap``,
        the longest first."""
        if left.get(gap):
            yield (gap,)
        for a, b in self.of.get(gap, ()):
            if left.get(a, 0) > (a == b) and left.get(b):
                yield a, b
        for a in sorted((x for x, n in left.items() if n and x < gap), reverse=True):
            if 3 * a < gap:
                break  # a is the longest of the three
            if not left.get(a):
                continue
            for b, c in self.of.get(gap - a, ()):
                if b <= a:
                    yield a, b, c


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, tuple[int, ...]]]:
    """(how often, lengths of one sequence): uses every piece once."""
    left = {x: n for x, n in counts.items() if n}
    index = SumIndex(list(left), size)
    out: list[tuple[int, tuple[int, ...]]] = []

    def take(combo: tuple[int, ...]) -> int:
        need: dict[int, int] = defaultdict(int)
        for x in combo:
            need[x] += 1
        times = min(left.get(x, 0) // n for x, n in need.items())
        if times:
            for x, n in need.items():
                left[x] -= n * times
            out.append((times, combo))
        return times

    rest: dict[int, int] = {}
    for x in sorted(left, reverse=True):
        if x == size:
            take((x,))
            continue
        for combo in index.fills(size - x, left):
            if not left[x]:
                break
            take((x, *combo))
        if left[x]:
            rest[x] = left[x]
            left[x] = 0
    return out + best_fit(rest, size)


def best_fit(counts: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best fit by decreasing length, on groups of equal sequences."""
    by_gap: dict[int, list[list]] = defaultdict(list)  # gap -> [times, lengths]
    for x in sorted(counts, reverse=True):
        n = counts[x]
        while n:
            gap = min((g for g, groups in by_gap.items() if g >= x and groups), default=None)
            if gap is None:
                # new sequences, each with as many as fit
                each = min(size // x, n)
                times = n // each
                by_gap[size - each * x].append([times, (x,) * each])
                n -= times * each
                continue
            group = by_gap[gap].pop()
            each = min(gap // x, n)
            times = min(group[0], n // each)
            by_gap[gap - each * x].append([times, group[1] + (x,) * each])
            if group[0] > times:
                by_gap[gap].append([group[0] - times, group[1]])
            n -= times * each
    return [(t, lengths) for groups in by_gap.values() for t, lengths in groups]


def run_table(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, first sequence, offset), sorted by rank."""
    used: dict[int, int] = defaultdict(int)
    rows: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    sequence = 0
    for times, lengths in patterns:
        at = 0
        for x in lengths:
            rows[x].append((used[x], sequence, at))
            used[x] += times
            at += x
        sequence += times
    return {x: np.array(r, np.int64) for x, r in rows.items()}


def _place(batches, table):
    runs = table.value
    for batch in batches:
        length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
        for x in np.unique(length):
            at = np.flatnonzero(length == x)
            r = runs[int(x)]
            k = np.searchsorted(r[:, 0], rank[at], side="right") - 1
            sequence[at] = r[k, 1] + rank[at] - r[k, 0]
            offset[at] = r[k, 2]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)],
            ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def ranked(pieces: DataFrame, counts: dict[int, int]) -> DataFrame:
    """``pieces`` with a rank from 0 within their length, without a task per length."""
    spark = pieces.sparkSession
    salts = spark.createDataFrame([(x, -(-n // RANKED_TOGETHER)) for x, n in counts.items()], "length long, salts long")
    salted = pieces.join(F.broadcast(salts), "length").withColumn(  # at most SIZE rows
        "salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts")))
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "start")
    return (salted.withColumn("r", F.row_number().over(own) - 1).join(sizes, ["length", "salt"])
            .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("r") + F.col("before")).cast("long").alias("rank")))


def packed(docs: DataFrame, tokenizer_path: str, size: int = SIZE) -> DataFrame:
    """One row per piece with its sequence and offset."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = scratch.stored(docs.mapInArrow(partial(_pieces, path=tokenizer_path, size=size), _PIECES))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # <= size rows
    table = spark.sparkContext.broadcast(run_table(plan(counts, size)))
    # one rank for one piece, also when a task is run again
    placed = scratch.stored(ranked(pieces, counts))
    return placed.mapInArrow(partial(_place, table=table), _PIECES + ", sequence_id long, offset long")
