"""Language-model scores by deleted interpolation.

P(w | v) = l2 c(v w)/c(v) + l1 c(w)/N + l0 /(V+1), with weights l per bucket of the
context's frequency (one per doubling of c(v)). The weights are learned by
expectation-maximisation on counts held out of the training texts (the deleted
part), the final counts are those of all training texts.

Words are counted by hash. The text is worked off in chunks; a task sends the
distinct words and word pairs of a chunk, with their counts, in blocks by hash
range; each range sums them up and answers every block with the totals; the
chunks score their texts with the answers. A word of a third of all tokens is one
key per chunk, so no key is hot. Chunk numbers follow the input's partitions, so
``docs`` must be read again in the same way (a scan of files is); a chunk that
does not fit its answers is an error.

Defined results: null texts are empty and consist of the end token; rows with
equal ids are separate documents; a null id counts as the empty string for the
split; without training texts every probability is uniform over V+1 = 1 words.
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glucoframe.llm.scratch import Scratch
from glucoframe.llm.textstream import mix, seeded, slices, text_buffers, words_of

FOLDS, HELD_OUT, DELETED = 7, 2, 3
CHUNK_BYTES = 12 << 20
BUCKETS = 64
STEPS = 4  # quantisation of the statistics for the weights: a quarter of a doubling
ROUNDS = 60
LEAST_UNIFORM = 1e-4
END = np.uint64(0x9E3779B97F4A7C15)

_KEYS = "r int, chunk long, part boolean, u binary, un binary, b binary, bn binary"
_ANSWERS = ("r int, chunk long, part boolean, u binary, b binary, ufit binary, bfit binary, "
            "v long, n long, nfit long")


def fold_of(doc_id) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS


class Stream:
    """Tokens of texts, each closed by the end token, and the token before each one."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        w = words_of(data, offsets)
        self.tokens = np.insert(w.hashes, w.first[1:], END)
        self.counts = w.counts + 1
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.before = np.empty_like(self.tokens)
        self.before[1:] = self.tokens[:-1]
        if len(self.tokens):
            self.before[0] = END
        with np.errstate(over="ignore"):
            self.pairs = mix(seeded(self.before, 1) * np.uint64(3) + seeded(self.tokens, 2))

    def keys(self):
        """Distinct words and pairs, and where each token's are."""
        return np.unique(self.tokens, return_inverse=True), np.unique(self.pairs, return_inverse=True)


def _chunks(batches):
    """(chunk, part, ids, folds, data, offsets): texts of the deleted part apart from the others."""
    task, count = TaskContext.get().partitionId(), 0
    for batch in batches:
        ids = np.array(batch.column("doc_id").to_pylist(), dtype=object)
        folds = np.array([fold_of(x) for x in ids], np.int64)
        data, offsets = text_buffers(batch.column("text"))
        for i, j in slices(offsets, CHUNK_BYTES):
            chunk = (task << 32) + count
            count += 1
            for part in (False, True):
                rows = np.flatnonzero((folds[i:j] == DELETED) == part) + i
                if len(rows):
                    own = [data[offsets[r]:offsets[r + 1]] for r in rows]
                    yield chunk, part, ids[rows], folds[rows], np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])])


def _range_cuts(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where the sorted keys pass from one hash range to the next."""
    edges = np.array([(r << 64) // ranges for r in range(1, ranges)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _pack(counts: np.ndarray) -> bytes:
    """Whole numbers of 4 bytes, or of 8 if one needs them; the first byte tells."""
    width = 4 if counts.max(initial=0) < 2 ** 32 else 8
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(counts.astype(f"<u{width}").tobytes())


def _unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), f"<u{raw[0]}")


def _send_keys(batches, ranges: int):
    for chunk, part, _, folds, data, offsets in _chunks(batches):
        s = Stream(data, offsets)
        trains = np.repeat(folds != HELD_OUT, s.counts)
        columns = []
        for keys, at in s.keys():
            n = np.bincount(at[trains], minlength=len(keys))
            cuts = _range_cuts(keys, ranges)
            columns.append([keys[a:b].tobytes() for a, b in zip(cuts, cuts[1:])])
            columns.append([_pack(n[a:b]) for a, b in zip(cuts, cuts[1:])])
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(ranges), pa.int32()), pa.array([chunk] * ranges, pa.int64()), pa.array([part] * ranges),
             *(pa.array(c, pa.binary()) for c in columns)],
            ["r", "chunk", "part", "u", "un", "b", "bn"])


def _totals(raw_keys, raw_counts, part):
    """Totals of every key of a range, back in the order of the blocks: all, without the deleted part."""
    keys = [np.frombuffer(k, np.uint64) for k in raw_keys]
    counts = [_unpack(c).astype(np.int64) for c in raw_counts]
    sizes = np.cumsum([len(k) for k in keys])[:-1]
    uniq, at = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.concatenate(counts)
    deleted = np.repeat(part, [len(k) for k in keys])
    fit = np.bincount(at, weights=np.where(deleted, 0, n), minlength=len(uniq)).astype(np.int64)
    train = fit + np.bincount(at, weights=np.where(deleted, n, 0), minlength=len(uniq)).astype(np.int64)
    return train, fit, np.split(train[at], sizes), np.split(fit[at], sizes)


def _answer(group: pd.DataFrame) -> pd.DataFrame:
    part = group["part"].to_numpy(bool)
    train, fit, u, ufit = _totals(group["u"], group["un"], part)
    _, _, b, bfit = _totals(group["b"], group["bn"], part)
    out = group[["r", "chunk", "part"]].copy()
    out["u"], out["b"] = [_pack(x) for x in u], [_pack(x) for x in b]
    out["ufit"] = [_pack(x) if p else None for x, p in zip(ufit, part)]
    out["bfit"] = [_pack(x) if p else None for x, p in zip(bfit, part)]
    one = np.zeros(len(out), np.int64)
    one[0] = 1
    out["v"], out["n"], out["nfit"] = one * int((train > 0).sum()), one * int(train.sum()), one * int(fit.sum())
    return out


def _payload(batches, only_deleted: bool):
    for chunk, part, ids, _, data, offsets in _chunks(batches):
        if part or not only_deleted:
            z = zstandard.ZstdCompressor(level=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk], pa.int64()), pa.array([part]), pa.array([ids.tolist()], pa.list_(pa.int64())),
                 pa.array([z.compress(data.tobytes())], pa.binary()), pa.array([offsets.tolist()], pa.list_(pa.int64()))],
                ["chunk", "part", "ids", "texts", "offsets"])


_PAYLOAD = "chunk long, part boolean, ids array<long>, texts binary, offsets array<long>"


def buckets(context: np.ndarray) -> np.ndarray:
    """0 for contexts that were never seen, then one per doubling."""
    return np.where(context > 0, 1 + np.floor(np.log2(np.maximum(context, 1))), 0).astype(np.int64)


def _looked_up(left: pd.DataFrame, right: pd.DataFrame, u: str, b: str):
    """ids, stream, and for every token the counts of pair, context and word."""
    row = left.iloc[0]
    raw = zstandard.ZstdDecompressor().decompress(row["texts"])
    s = Stream(np.frombuffer(raw, np.uint8), np.asarray(row["offsets"], np.int64))
    (words, uat), (pairs, bat) = s.keys()
    right = right.sort_values("r")
    un = np.concatenate([_unpack(x) for x in right[u]]).astype(np.int64)
    bn = np.concatenate([_unpack(x) for x in right[b]]).astype(np.int64)
    if len(left) != 1 or len(un) != len(words) or len(bn) != len(pairs):
        raise RuntimeError("docs was not read in the same order again")
    word = un[uat]
    # the context of a token is the token before it; the first one's is the end token
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[0] = un[np.searchsorted(words, END)]
    return row["ids"], s, bn[bat], context, word


def _statistics(left: pd.DataFrame, right: pd.DataFrame, nfit: int) -> pd.DataFrame:
    """Held-out tokens by bucket and quantised relative frequencies; -1 where a count is 0."""
    if not len(left) or not len(right):
        return pd.DataFrame({"bucket": [], "q2": [], "q1": [], "tokens": []}).astype("int64")
    _, _, pair, context, word = _looked_up(left, right, "ufit", "bfit")

    def step(a, b):
        return np.where(a > 0, np.round(STEPS * np.log2(np.maximum(b, 1) / np.maximum(a, 1))), -1).astype(np.int64)

    f = pd.DataFrame({"bucket": buckets(context), "q2": step(pair, context), "q1": step(word, nfit)})
    return f.value_counts().rename("tokens").reset_index()


def interpolation_weights(bucket, q2, q1, tokens, v: int) -> np.ndarray:
    """Weights (l2, l1, l0) per bucket by expectation-maximisation."""
    out = np.tile([0.0, 0.9, 0.1], (BUCKETS, 1))
    for b in np.unique(bucket):
        at = bucket == b
        p = np.stack([np.where(q2[at] >= 0, 2.0 ** (-q2[at] / STEPS), 0), np.where(q1[at] >= 0, 2.0 ** (-q1[at] / STEPS), 0),
                      np.full(at.sum(), 1.0 / (v + 1))], axis=1)
        w = np.array([0.0, 0.9, 0.1]) if b == 0 else np.array([0.4, 0.5, 0.1])
        for _ in range(ROUNDS):
            share = p * w
            share /= share.sum(axis=1, keepdims=True)
            w = (share * tokens[at][:, None]).sum(axis=0) / tokens[at].sum()
            w[2] = max(w[2], LEAST_UNIFORM)
            w /= w.sum()
        out[b] = w
    # a bucket without held-out tokens takes the weights of the next smaller one
    seen = set(np.unique(bucket).tolist())
    for b in range(1, BUCKETS):
        if b not in seen and b > 1:
            out[b] = out[b - 1]
    return out


def _score(left: pd.DataFrame, right: pd.DataFrame, weights, v: int, n: int) -> pd.DataFrame:
    if not len(left) or not len(right):
        raise RuntimeError("docs was not read in the same order again")
    ids, s, pair, context, word = _looked_up(left, right, "u", "b")
    w = weights.value[buckets(context)]
    p = w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word / max(n, 1) + w[:, 2] / (v + 1)
    first = s.first[:-1]
    ids = list(ids)
    return pd.DataFrame({
        "doc_id": pd.array([None if x is None or x != x else int(x) for x in ids], dtype="Int64"),
        "held_out": [fold_of(None if x is None or x != x else int(x)) == HELD_OUT for x in ids],
        "n_tokens": s.counts.astype(np.int64), "n_known": np.add.reduceat((word > 0).astype(np.int64), first),
        "train_tokens": np.full(len(ids), n, np.int64),
        "base_score": np.add.reduceat(np.log10((word + 1) / (n + v + 1)), first),
        "score": np.add.reduceat(np.log10(p), first) if n else np.zeros(len(ids))})


def lm_scores(docs: DataFrame) -> DataFrame:
    """One row per document: held_out, token counts, add-one unigram and model log10 probability."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranges = 4 * max(1, docs.rdd.getNumPartitions())
    answers = scratch.stored(docs.mapInArrow(partial(_send_keys, ranges=ranges), _KEYS)
                             .groupBy("r").applyInPandas(_answer, _ANSWERS))
    total = answers.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("v", "n", "nfit"))).first()
    v, n, nfit = int(total["v"]), int(total["n"]), int(total["nfit"])
    deleted = docs.mapInArrow(partial(_payload, only_deleted=True), _PAYLOAD).groupBy("chunk", "part")

    def statistics(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _statistics(left, right, nfit)

    rows = (deleted.cogroup(answers.where("part").groupBy("chunk", "part"))
            .applyInPandas(statistics, "bucket long, q2 long, q1 long, tokens long")
            .groupBy("bucket", "q2", "q1").agg(F.sum("tokens").alias("tokens")).toPandas())  # as many as steps, not tokens
    weights = spark.sparkContext.broadcast(interpolation_weights(*(rows[c].to_numpy() for c in ("bucket", "q2", "q1", "tokens")), v))

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _score(left, right, weights, v, n)

    return (docs.mapInArrow(partial(_payload, only_deleted=False), _PAYLOAD).groupBy("chunk", "part")
            .cogroup(answers.select("r", "chunk", "part", "u", "b").groupBy("chunk", "part"))
            .applyInPandas(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                  "base_score double, score double"))
