"""Quality classifier from weak labels.

Overlapping heuristic labellers say good, bad or nothing about a text. Their
accuracies are estimated by expectation-maximisation over the counts of all vote
patterns of the corpus (at most 3 ** labellers patterns). A hashed linear scorer
(frequencies of character-class 4-grams and bucketed statistics) is trained on
the posterior labels of about ``MAX_SAMPLE`` documents at most, chosen by a hash of id
and text, equal rows once, and scores every whole text.

Defined results: null texts are empty; an empty text gets the score of the
scorer's intercept and its statistics like any other; rows with equal ids are
scored one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glucoframe.llm.textstream import slices, text_buffers, windows, words_of

MAX_SAMPLE = 8_000
GRAMS = 1024
ROUNDS = 100
SLICE_BYTES = 4 << 20

#: statistic -> (the labeller says bad above, the text is tidy up to)
LIMITS = {
    "symbols": (0.2, 0.02),
    "repeats": (0.3, 0.1),
    "upper": (0.5, 0.2),
    "bangs": (0.2, 0.05),
    "few_words": (1 / 3, 1 / 3),
    "dup_lines": (0.3, 0.1),
    "word_length": (12.0, 9.0),
    "unstopped": (0.985, 0.97),
}
#: one labeller per statistic that says bad or nothing; one for tidy texts that says good
#: (all statistics in order), bad (two objections or more) or nothing
LABELLERS = (*LIMITS, "tidy")
#: bytes by class: letters, capitals, digits, white space, other scripts; marks stand for themselves
_CLASS = np.arange(256, dtype=np.uint64)
_CLASS[ord("a"):ord("z") + 1] = 200
_CLASS[ord("A"):ord("Z") + 1] = 201
_CLASS[ord("0"):ord("9") + 1] = 202
_CLASS[[0x20, *range(0x09, 0x0E)]] = 203
_CLASS[128:] = 200
_SYMBOL, _UPPER, _LETTER, _STOP = (np.zeros(256, bool) for _ in range(4))
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[ord("A"):ord("Z") + 1] = True
_LETTER[(_CLASS == 200) | (_CLASS == 201)] = True
_STOP[list(b".,;:?!")] = True


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return run[offsets[1:]] - run[offsets[:-1]]


def _repeated(keys: np.ndarray) -> int:
    """How many of the keys occur twice or more."""
    _, n = np.unique(keys, return_counts=True)
    return int(n[n > 1].sum())


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row per text, one column per statistic."""
    w = words_of(data, offsets)
    n = np.maximum(w.counts, 1)
    letters = np.maximum(_sums(_LETTER[data], offsets), 1)
    grams = windows(w.hashes, 3)
    lines = np.zeros((len(n), 2))
    repeats = np.zeros(len(n))
    for i in range(len(n)):
        a, b = w.first[i], w.first[i + 1]
        if b - a >= 6:
            repeats[i] = _repeated(grams[a:b - 2]) / (b - a - 2)
        own = [x for x in data[offsets[i]:offsets[i + 1]].tobytes().split(b"\n") if x.strip()]
        lines[i] = len(own), len(set(own))
    return np.stack([
        _sums(_SYMBOL[data], offsets) / n, repeats, _sums(_UPPER[data], offsets) / letters, _sums(data == ord("!"), offsets) / n,
        1 / n, 1 - lines[:, 1] / np.maximum(lines[:, 0], 1), np.diff(offsets) / n - 1, 1 - _sums(_STOP[data], offsets) / n], axis=1)


def votes(stats: np.ndarray) -> np.ndarray:
    """1 good, 0 bad, 2 nothing."""
    bad, tidy = np.array(list(LIMITS.values())).T
    objects = stats > bad
    overall = np.where((stats <= tidy).all(axis=1), 1, np.where(objects.sum(axis=1) > 1, 0, 2))
    return np.concatenate([np.where(objects, 0, 2), overall[:, None]], axis=1).astype(np.uint8)


def features(data: np.ndarray, offsets: np.ndarray, stats: np.ndarray):
    """Hashed 4-grams (feature per byte position) and bucketed statistics (feature per text and statistic)."""
    code = _CLASS[data]
    follows = np.append(code, np.zeros(3, code.dtype))
    for k in (1, 2, 3):
        # the k-th class after each byte; nothing follows the end of a text, whatever text comes next
        after = follows[k:len(data) + k].copy()
        for j in range(1, k + 1):
            last = offsets[1:] - j
            after[last[last >= 0]] = 0
        code = (code << np.uint64(8)) | after
    with np.errstate(over="ignore"):
        grams = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)).astype(np.int64)
    steps = np.clip(np.floor(np.log2(np.maximum(stats, 1 / 256)) + 8), 0, 15).astype(np.int64)
    return grams, GRAMS + np.arange(stats.shape[1]) * 16 + steps


WIDTH = GRAMS + 16 * len(LIMITS)


def _batch_slices(batch):
    data, offsets = text_buffers(batch.column("text"))
    for i, j in slices(offsets, SLICE_BYTES):
        yield i, j, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]


def _patterns(batches):
    seen: dict[bytes, int] = {}
    for batch in batches:
        for _, _, data, offsets in _batch_slices(batch):
            for v in map(bytes, votes(statistics(data, offsets))):
                seen[v] = seen.get(v, 0) + 1
    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["votes", "n"])


def _vectors(batches):
    for batch in batches:
        v, x = [], []
        for _, _, data, offsets in _batch_slices(batch):
            stats = statistics(data, offsets)
            grams, extra = features(data, offsets, stats)
            v += map(bytes, votes(stats))
            for i, (a, b) in enumerate(zip(offsets, offsets[1:])):
                row = np.zeros(WIDTH, np.float32)
                row[:GRAMS] = np.bincount(grams[a:b], minlength=GRAMS) / max(b - a, 1)
                row[extra[i]] = 1
                x.append(row.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary()), pa.array(x, pa.binary())], ["votes", "x"])


class LabellerModel:
    """Two classes; each labeller has its own chances of good, bad and nothing in either."""

    def __init__(self, patterns: np.ndarray, n: np.ndarray):
        good, bad = (patterns == 1).sum(axis=1), (patterns == 0).sum(axis=1)
        q = (good + 1.0) / (good + 2.0 * bad + 2.0)  # a labeller says bad for a reason
        one_hot = np.stack([patterns == x for x in (0, 1, 2)], axis=2).astype(float)
        for _ in range(ROUNDS):
            p1 = (np.einsum("r,rvx->vx", q * n, one_hot) + 1) / ((q * n).sum() + 3)
            p0 = (np.einsum("r,rvx->vx", (1 - q) * n, one_hot) + 1) / (((1 - q) * n).sum() + 3)
            self.prior = np.clip((q * n).sum() / n.sum(), 0.02, 0.98)
            self.chances, self.gain = (p1, p0), np.log(p1 / p0)
            q = self.posterior(patterns)

    def posterior(self, v: np.ndarray) -> np.ndarray:
        z = np.log(self.prior / (1 - self.prior)) + np.take_along_axis(self.gain[None], v[:, :, None].astype(int), axis=2)[:, :, 0].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fitted_scorer(x: np.ndarray, q: np.ndarray, penalty: float = 1e-4, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradient steps."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1).astype(np.float64)
    scale = 1 / np.maximum(np.sqrt((x * x).mean(axis=0)), 1e-3)
    x *= scale
    step = 4 / max(1e-9, np.linalg.norm(x, 2) ** 2 / len(x) + penalty)
    w = y = np.zeros(x.shape[1])
    for t in range(rounds):
        grad = x.T @ (1 / (1 + np.exp(-np.clip(x @ y, -30, 30))) - q) / len(x) + penalty * y
        new = y - step * grad
        y, w = new + t / (t + 3) * (new - w), new
    w = w * scale
    return w[:-1], float(w[-1])


def _score(batches, model):
    w, bias = model.value
    for batch in batches:
        out = np.zeros(len(batch))
        for i, j, data, offsets in _batch_slices(batch):
            stats = statistics(data, offsets)
            grams, extra = features(data, offsets, stats)
            run = np.concatenate([[0], np.cumsum(w[grams])])
            mean = (run[offsets[1:]] - run[offsets[:-1]]) / np.maximum(np.diff(offsets), 1)
            out[i:j] = mean + w[extra].sum(axis=1) + bias
        score = 1 / (1 + np.exp(-np.clip(out, -30, 30)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array(score >= 0.5)], ["doc_id", "score", "kept"])


def quality_scores(docs: DataFrame) -> DataFrame:
    """One row per document: score (0 to 1, higher is better) and whether it is kept (0.5 or more)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = (docs.select("text").mapInArrow(_patterns, "votes binary, n long").groupBy("votes").agg(F.sum("n").alias("n"))
              .collect())  # at most 3 ** len(LABELLERS) patterns
    if not counts:
        return spark.createDataFrame([], "doc_id long, score double, kept boolean")
    patterns = np.array([list(r["votes"]) for r in counts], np.uint8)
    n = np.array([r["n"] for r in counts], float)
    labels = LabellerModel(patterns, n)
    total = int(n.sum())
    chosen = docs if total <= MAX_SAMPLE else docs.where(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(total)) < int(MAX_SAMPLE * 0.95))
    # rows that are equal in both come all or none: they count once
    rows = chosen.dropDuplicates(["doc_id", "text"]).select("text").mapInArrow(_vectors, "votes binary, x binary").collect()  # about MAX_SAMPLE rows of 4 WIDTH bytes
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), np.float32).reshape(-1, WIDTH)
    q = labels.posterior(np.array([list(r["votes"]) for r in rows], np.uint8).reshape(-1, len(LABELLERS)))
    model = spark.sparkContext.broadcast(fitted_scorer(x, q) if len(x) else (np.zeros(WIDTH), 0.0))
    return docs.mapInArrow(partial(_score, model=model), "doc_id long, score double, kept boolean")
