"""Secret scan: fixed patterns, and strings that a Markov model finds random.

Two first-order character models, of random strings and of ordinary identifiers,
are compared by their log-likelihood ratio. They are trained from labelled
samples: strings that a fixed pattern found (1), and all other strings of the
same alphabet (0); every text counts, the models are tables of 66 x 66 counts.
Strings of ``MIN_LENGTH`` characters or more, less the spans of fixed patterns, are cut
at separators (paths, assignments, URLs), and the maximal scoring runs of their parts
are tried: no run that begins or ends inside of one scores more, and they do not
overlap. One of ``MIN_LENGTH`` characters is reported as kind ``markov`` when its ratio
is at least ``MIN_MEAN`` nats per character and ``MIN_TOTAL`` + 2 ln(m) in all, as m parts
have fewer than m^2 runs. Without such a run, a whole string is reported that reaches
``MIN_MEAN`` and ``MIN_TOTAL``.

Spans are code points, end exclusive. Null texts are empty. Without positive
samples the random model is uniform.
"""

from __future__ import annotations

import hashlib
import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glucoframe.llm.decontam import merged, replaced
from glucoframe.llm.textstream import slices, text_buffers

#: fixed patterns, in the order of the kinds
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16
_STEMS = (b"passw", b"secret", b"token", b"api")

MIN_LENGTH = 16
MIN_SAMPLE = 8
MIN_TOTAL = 20.0
MIN_MEAN = 0.75
#: weight of the characters' own frequencies in the transitions
BACK_OFF = 20.0
SLICE_BYTES = 4 << 20

#: alphabet of candidate strings: A-Z a-z 0-9 + / _ = -
_ALPHABET = [*range(65, 91), *range(97, 123), *range(48, 58), *b"+/_=-"]
SYMBOLS = len(_ALPHABET)
_SYMBOL = np.full(256, SYMBOLS, np.int16)
_SYMBOL[_ALPHABET] = np.arange(SYMBOLS)
_IS_HEX = np.zeros(256, bool)
_IS_HEX[[*range(48, 58), *range(97, 103)]] = True
#: characters that end a part of a string
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[*b"+/_=-"]] = True
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def runs(flags: np.ndarray, offsets: np.ndarray, least: int):
    """Starts and ends of runs of at least ``least`` set bytes, cut where texts meet."""
    if not len(flags):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(flags), bool)
    cut = offsets[1:-1]
    edge[cut[cut < len(flags)]] = True
    edge[0] = True
    start = flags.copy()
    start[1:] &= ~flags[:-1] | edge[1:]
    stop = flags.copy()
    stop[:-1] &= ~flags[1:] | edge[1:]
    a, b = np.flatnonzero(start), np.flatnonzero(stop) + 1
    keep = b - a >= least
    return a[keep], b[keep]


def _base_spans(data: np.ndarray, offsets: np.ndarray):
    """Row -> spans (kind, start, end) in bytes, and the byte span of the value itself."""
    out: dict[int, list[tuple[int, int, int, int, int]]] = {}
    raw = data.tobytes()
    low = raw.translate(_LOWER)

    def rows_with(hay: bytes, needles) -> set[int]:
        found: set[int] = set()
        for needle in needles:
            at = hay.find(needle)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, side="right")) - 1
                found.add(row)
                at = hay.find(needle, int(offsets[row + 1]))  # once a text is enough
        return found

    def text(row: int) -> tuple[str, int]:
        return raw[offsets[row]:offsets[row + 1]].decode("latin-1"), int(offsets[row])

    # the patterns are ASCII, so they may run over bytes one by one
    for row in rows_with(low, _STEMS):
        s, o = text(row)
        for m in ASSIGN.finditer(s):
            if m.end(2) - m.start(2) >= MIN_ASSIGN:
                out.setdefault(row, []).append((0, o + m.start(), o + m.end(), o + m.start(2), o + m.end(2)))
    for row in rows_with(raw, (b"AKIA",)):
        s, o = text(row)
        for m in ACCESS.finditer(s):
            if m.end() - m.start() >= MIN_ACCESS:
                out.setdefault(row, []).append((1, o + m.start(), o + m.end(), o + m.start(), o + m.end()))
    for a, b in zip(*runs(_IS_HEX[data], offsets, MIN_HEX)):
        row = int(np.searchsorted(offsets, a, side="right")) - 1
        out.setdefault(row, []).append((2, int(a), int(b), int(a), int(b)))
    return out


def _count(symbols: np.ndarray) -> np.ndarray:
    """Transitions between the symbols of runs that are kept apart by SYMBOLS (the outside)."""
    n = SYMBOLS + 1
    return np.bincount(symbols[:-1].astype(np.int64) * n + symbols[1:], minlength=n * n)


def _train(batches):
    """Transitions (label, at, n) of the strings of one task."""
    total = np.zeros((2, (SYMBOLS + 1) ** 2), np.int64)
    for batch in batches:
        data, offsets = text_buffers(batch.column("text"))
        for i, j in slices(offsets, SLICE_BYTES):
            d, off = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
            a, b = runs(_SYMBOL[d] < SYMBOLS, off, MIN_SAMPLE)
            keep = np.zeros(len(d) + 1, np.int64)
            np.add.at(keep, a, 1)
            np.add.at(keep, b, -1)
            sample = np.cumsum(keep[:-1]) > 0
            secret = np.zeros(len(d), bool)
            for spans in _base_spans(d, off).values():
                for *_, lo, hi in spans:
                    secret[lo:hi] = True
            for label, where in ((0, sample & ~secret), (1, secret)):
                # one symbol of the outside before and after each text and run
                sym = np.where(where, _SYMBOL[d], SYMBOLS)
                total[label] += _count(np.concatenate([[SYMBOLS], sym, [SYMBOLS]]))
    label, at = np.nonzero(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array(label, pa.int32()), pa.array(at, pa.int32()), pa.array(total[label, at], pa.int64())], ["label", "at", "n"])


def markov_ratio(docs: DataFrame) -> np.ndarray:
    """Matrix of log P(next | at; random) - log P(next | at; ordinary), 66 x 66 with the
    outside as the last symbol, trained on all texts."""
    rows = (docs.select("text").mapInArrow(_train, "label int, at int, n long")
            .groupBy("label", "at").agg(F.sum("n").alias("n")).collect())  # at most 2 x 66 x 66
    n = SYMBOLS + 1
    counts = np.zeros((2, n * n))
    for r in rows:
        counts[r["label"], r["at"]] = r["n"]
    counts = counts.reshape(2, n, n)
    counts[:, SYMBOLS, SYMBOLS] = 0
    # every string is itself part of the ordinary sample: one occurrence is left out
    counts[0] = np.maximum(counts[0] - 1, 0)
    alone = counts.sum(axis=1, keepdims=True) + 0.5
    alone /= alone.sum(axis=2, keepdims=True)
    logs = np.log((counts + BACK_OFF * alone) / (counts.sum(axis=2, keepdims=True) + BACK_OFF))
    return logs[1] - logs[0]


def maximal_runs(scores) -> list[tuple[int, int, float]]:
    """(first, end, sum) of all maximal scoring runs of ``scores``, from left to right: one pass
    over the positive scores, joining a run with an earlier one where the sum of both is
    larger than either (each join ends a run, so the time is linear)."""
    found: list[tuple[int, int, float, float]] = []  # first, end, sum before, sum up to the end
    before = 0.0
    lower: list[int] = []  # for each run, the nearest earlier one with a smaller sum before it, or -1
    for i, x in enumerate(scores):
        if x > 0:
            run = (i, i + 1, before, before + x)
            at = len(found) - 1
            while True:
                while at >= 0 and found[at][2] >= run[2]:
                    at = lower[at]
                if at < 0 or found[at][3] >= run[3]:
                    break
                run = (found[at][0], run[1], found[at][2], run[3])
                del found[at:], lower[at:]
                at -= 1
            found.append(run)
            lower.append(at)
        before += x
    return [(a, b, hi - lo) for a, b, lo, hi in found]


def _sub_runs(data: np.ndarray, lo: int, hi: int, gains: np.ndarray):
    """Spans of the random parts of one string; ``gains`` is the ratio of each of its characters."""
    first = np.r_[0, np.flatnonzero(_SEPARATOR[data[lo:hi - 1]]) + 1]
    for a, b, total in maximal_runs(np.add.reduceat(gains, first).tolist()):
        start = lo + int(first[a])
        end = hi if b == len(first) else lo + int(first[b]) - 1  # without the separator
        least = MIN_TOTAL + 2 * np.log(len(first))
        if end - start >= MIN_LENGTH and total >= least and total >= MIN_MEAN * (end - start):
            yield start, end


def _scan(data: np.ndarray, offsets: np.ndarray, ratio: np.ndarray):
    """Row -> sorted spans (start, kind, end) in code points."""
    found = _base_spans(data, offsets)
    spans: dict[int, list[tuple[int, int, int]]] = {r: [(a, k, b) for k, a, b, *_ in s] for r, s in found.items()}
    free = _SYMBOL[data] < SYMBOLS
    for known in spans.values():
        for lo, _, hi in known:
            free[lo:hi] = False
    a, b = runs(free, offsets, MIN_LENGTH)
    if len(a):
        sym = _SYMBOL[data]
        gain = np.zeros(len(data) + 1)  # of each character after the one before; the outside before a string
        gain[1:-1] = ratio[sym[:-1], sym[1:]]
        gain[a] = ratio[SYMBOLS, sym[a]]
        ends = np.stack([a, b], axis=1).ravel()
        after = ratio[sym[b - 1], SYMBOLS]
        total = np.add.reduceat(gain, ends)[::2] + after
        good = (total >= MIN_TOTAL) & (total >= MIN_MEAN * (b - a))
        best = np.add.reduceat(np.maximum(gain, 0), ends)[::2] + np.maximum(after, 0)
        marked = []
        for i in np.flatnonzero(best >= MIN_TOTAL).tolist():
            gains = gain[a[i]:b[i]].copy()
            gains[-1] += after[i]
            marked += list(_sub_runs(data, int(a[i]), int(b[i]), gains)) or [(int(a[i]), int(b[i]))] * int(good[i])
        for lo, hi in marked:
            row = int(np.searchsorted(offsets, lo, side="right")) - 1
            spans.setdefault(row, []).append((lo, 3, hi))
    out = {}
    for row, s in spans.items():
        lo, hi = offsets[row], offsets[row + 1]
        before = np.concatenate([[0], np.cumsum((data[lo:hi] & 0xC0) != 0x80)])
        out[row] = sorted((int(before[x - lo]), k, int(before[y - lo])) for x, k, y in s)
    return out


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _report(batches, ratio):
    for batch in batches:
        spans = [()] * len(batch)
        data, offsets = text_buffers(batch.column("text"))
        for i, j in slices(offsets, SLICE_BYTES):
            for r, s in _scan(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], ratio.value).items():
                spans[i + r] = s
        base = [[x for x in s if x[1] != 3] for s in spans]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array([sum(x[1] == k for x in s) for s in spans], pa.int64()) for k in range(3)),
             pa.array([hashlib.sha256(_joined(s).encode()).hexdigest() for s in base]), pa.array([_joined(s) for s in spans]),
             pa.array([sum(x[1] == 3 for x in s) for s in spans], pa.int64())],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov"])


def secret_spans(docs: DataFrame, ratio: np.ndarray | None = None) -> DataFrame:
    """One row per document with its secrets; trains on ``docs`` unless ``ratio`` is given."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(markov_ratio(docs) if ratio is None else ratio)
    return docs.mapInArrow(partial(_report, ratio=shared),
                           "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long")


def _redact(batches, schema, ratio, mask):
    for batch in batches:
        data, offsets = text_buffers(batch.column("text"))
        texts = {}
        for i, j in slices(offsets, SLICE_BYTES):
            for r, spans in _scan(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], ratio.value).items():
                text = data[offsets[i + r]:offsets[i + r + 1]].tobytes().decode("utf-8")
                parts, at = [], 0
                for a, b in merged((a, b) for a, _, b in spans):
                    parts += [text[at:a], mask]
                    at = b
                texts[i + r] = "".join([*parts, text[at:]])
        yield replaced(batch, texts, schema)


def redacted(docs: DataFrame, mask: str = "[SECRET]", ratio: np.ndarray | None = None) -> DataFrame:
    """``docs`` (all columns, all rows) with every secret replaced by ``mask``."""
    shared = docs.sparkSession.sparkContext.broadcast(markov_ratio(docs) if ratio is None else ratio)
    return docs.mapInArrow(partial(_redact, schema=docs.columns, ratio=shared, mask=mask), docs.schema)
