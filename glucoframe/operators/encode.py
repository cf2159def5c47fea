"""Encoding operators (E1-E19): per-row array work, bounded by one day.

Array-form operators return Columns so that several of them compose in one
``select`` (one projection, no shuffle). Operators that need a corpus-wide
value (longest length, gene factors) aggregate once and broadcast one row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glucoframe.functions.glucose import (CLIP_HI, CLIP_LO, CLS_ID, DAY_SLOTS, IGNORE_LABEL,
                                          MASK_ID, PAD_ID, clip_value, encode_value,
                                          is_missing)
from glucoframe.operators.selection import grouped_median


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---- E1-E6 -----------------------------------------------------------------------
def clip_array(arr, lo: float = CLIP_LO, hi: float = CLIP_HI) -> Column:
    """E1 on array form: clamp non-missing readings, missing -> null."""
    return F.transform(_c(arr), lambda x: clip_value(x, lo, hi))


def encode_array(arr) -> Column:
    """E1+E3+E4: readings -> token ids of the fixed vocabulary, missing -> <pad>."""
    return F.transform(_c(arr), lambda x: encode_value(x))


def prepend_cls(arr, cls_id: int = CLS_ID) -> Column:
    """E5: <cls> at position 0."""
    return F.concat(F.array(F.lit(cls_id)), _c(arr))


def attention_mask(tokens, all_ones: bool = False, pad_id: int = PAD_ID) -> Column:
    """0 at <pad>, else 1 (the generation variant is all ones)."""
    if all_ones:
        return F.transform(_c(tokens), lambda t: F.lit(1))
    return F.transform(_c(tokens), lambda t: F.when(t == pad_id, F.lit(0)).otherwise(F.lit(1)))


def encode_sequences(df: DataFrame, arr: str = "input_ids", cls: bool = True,
                     out: str = "input_ids", mask: str = "attention_mask") -> DataFrame:
    """E1-E6 as one projection: clip, truncate, vocabulary id, <pad>, <cls>, mask."""
    tok = encode_array(arr)
    if cls:
        tok = prepend_cls(tok)
    keep = [c for c in df.columns if c not in (arr, out, mask)]
    return (df.select(*keep, tok.alias(out))
            .withColumn(mask, attention_mask(out)))


def encode_tokens_long(df: DataFrame, value: str = "value", out: str = "token") -> DataFrame:
    """E1+E3+E4 on long form."""
    return df.withColumn(out, encode_value(value))


# ---- E7 / E8 ---------------------------------------------------------------------
def upsample_pad(arr, factor: int = 3, length: int = DAY_SLOTS, pad_id: int = PAD_ID) -> Column:
    """Encode, follow every token by ``factor - 1`` pads, cut to ``length`` (Q4: NaN -> pad)."""
    expanded = F.flatten(F.transform(
        encode_array(arr),
        lambda t: F.concat(F.array(t), F.array_repeat(F.lit(pad_id), factor - 1))))
    return F.slice(expanded, 1, length)


def upsample_interpolate(arr, length: int = DAY_SLOTS) -> Column:
    """Between x[i-1] and x[i] insert mean(x[i-2], x[i-1], x[i]) and
    mean(x[i-1], x[i], x[i+1]) (two-point means at the ends): 3n - 2 points (Q15),
    cut to ``length``, then clipped and encoded (missing -> <pad>).
    """
    a = _c(arr)
    n = F.size(a)

    def at(i):
        return F.element_at(a, i + 1)

    def triple(i):
        first = F.when(i == 1, (at(i - 1) + at(i)) / 2.0).otherwise(
            (at(i - 2) + at(i - 1) + at(i)) / 3.0)
        second = F.when(i == n - 1, (at(i - 1) + at(i)) / 2.0).otherwise(
            (at(i - 1) + at(i) + at(i + 1)) / 3.0)
        return F.array(first, second, at(i).cast("double"))

    rest = F.when(n > 1, F.flatten(F.transform(F.sequence(F.lit(1), n - 1), triple))).otherwise(
        F.array().cast("array<double>"))
    full = F.when(n > 0, F.concat(F.array(at(0).cast("double")), rest)).otherwise(
        F.array().cast("array<double>"))
    return encode_array(F.slice(full, 1, length))


# ---- E9-E11 ----------------------------------------------------------------------
def bucket_array(arr, size: int = 10) -> Column:
    """Coarse vocabulary floor((v - 30) / size); missing stays null."""
    return F.transform(_c(arr), lambda x: F.when(~is_missing(x), F.floor((x - 30) / size).cast("int")))


def rank_order(df: DataFrame, arr: str = "input_ids", out: str = "order") -> DataFrame:
    """E10 for whole tables: ``out`` = stable argsort of each row's array, missing last in position
    order, by one numpy sort per Arrow batch and array length (reverse it for the descending order)."""
    schema = T.StructType([*[f for f in df.schema.fields if f.name != out], T.StructField(out, T.ArrayType(T.IntegerType()))])
    names = [f.name for f in schema.fields]

    def run(batches):
        for batch in batches:
            lists = batch.column(arr)
            offsets = lists.offsets.to_numpy()
            size = np.diff(offsets)
            flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
            order = np.empty(int(size.sum()), np.int32)
            at = offsets - offsets[0]
            for n in np.unique(size[size > 0]):
                rows = np.flatnonzero(size == n)
                x = flat[offsets[rows][:, None] + np.arange(n)]
                # nan (missing) sorts last
                order[at[rows][:, None] + np.arange(n)] = np.argsort(x, axis=1, kind="stable")
            made = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(order), mask=lists.is_null())
            yield pa.RecordBatch.from_arrays([made if c == out else batch.column(c) for c in names], names)
    return df.mapInArrow(run, schema)


def rank_encode(arr, descending: bool = False) -> Column:
    """Stable argsort of each row (missing last); ``descending`` reverses the
    row's order (Q1: the reversal is inside the row, never across rows)."""
    a = _c(arr)
    keyed = F.transform(a, lambda x, i: F.struct(x.alias("v"), i.alias("i")))
    present = F.filter(keyed, lambda s: ~is_missing(s["v"]))
    # only the present readings are sorted; missing positions follow in position order
    by_value = F.transform(F.array_sort(present), lambda s: s["i"])
    order = F.concat(by_value, F.array_except(F.transform(a, lambda x, i: i), by_value))
    return F.reverse(order) if descending else order


def band_array(arr) -> Column:
    """E11 on array form: 0 low / 1 in range / 2 high per reading."""
    from glucoframe.functions.glucose import glucose_band
    return F.transform(_c(arr), lambda x: glucose_band(x))


# ---- E12-E15 ---------------------------------------------------------------------
def special_tokens_mask(tokens, specials=(MASK_ID, PAD_ID)) -> Column:
    """1 for <mask>/<pad> (or the given special ids), else 0."""
    return F.transform(_c(tokens), lambda t: F.when(t.isin(list(specials)), 1).otherwise(0))


def pad_sequences(df: DataFrame, arr: str = "input_ids", strategy: str = "longest",
                  max_len: int | None = None, multiple_of: int | None = None,
                  side: str = "right", pad_id: int = PAD_ID, labels: str | None = None,
                  truncate: bool = True) -> DataFrame:
    """Pad token arrays; writes attention_mask, special_tokens_mask and -100 labels.

    strategy 'longest' pads to the corpus maximum (one aggregate, broadcast as a
    one-row frame), 'max_length' to ``max_len`` (cut when ``truncate``), 'none'
    leaves lengths; the target length is then rounded up to ``multiple_of``.
    """
    if strategy == "longest":
        target = df.agg(F.max(F.size(arr)).alias("_target"))
        out = df.crossJoin(F.broadcast(target))
        tgt = F.col("_target")
    elif strategy == "max_length":
        if max_len is None:
            raise ValueError("max_length strategy needs max_len")
        out, tgt = df, F.lit(max_len)
    elif strategy == "none":
        out, tgt = df, F.size(arr)
    else:
        raise ValueError(f"unknown padding strategy {strategy}")
    if multiple_of:
        tgt = (F.ceil(tgt / F.lit(multiple_of)) * multiple_of).cast("int")
    out = out.withColumn("_tgt", tgt)
    a = F.col(arr)
    if truncate and strategy == "max_length":
        a = F.slice(a, 1, max_len)

    def padded(x, fill):
        n_pad = F.greatest(F.col("_tgt") - F.size(x), F.lit(0))
        fill_arr = F.array_repeat(F.lit(fill), n_pad)
        return F.concat(x, fill_arr) if side == "right" else F.concat(fill_arr, x)

    out = out.withColumn(arr, padded(a, pad_id))
    if labels:
        lab = F.slice(F.col(labels), 1, max_len) if (truncate and strategy == "max_length") else F.col(labels)
        out = out.withColumn(labels, padded(lab, IGNORE_LABEL))
    out = (out.withColumn("attention_mask", attention_mask(arr, pad_id=pad_id))
           .withColumn("special_tokens_mask", special_tokens_mask(arr)))
    return out.drop("_tgt", "_target")


def pad_concat(a: DataFrame, b: DataFrame, arr: str, fill: int = IGNORE_LABEL) -> DataFrame:
    """Union of two array tables of unequal width; short rows right-padded
    with ``fill`` to the widest row of both (one aggregate, broadcast)."""
    u = a.unionByName(b)
    width = u.agg(F.max(F.size(arr)).alias("_w"))
    u = u.crossJoin(F.broadcast(width))
    out = u.withColumn(arr, F.concat(F.col(arr), F.array_repeat(
        F.lit(fill), F.greatest(F.col("_w") - F.size(arr), F.lit(0)))))
    return out.drop("_w")


def decode_array(tokens) -> Column:
    """Ids -> mg/dL; special ids -> null."""
    from glucoframe.functions.glucose import decode_token
    return F.transform(_c(tokens), lambda t: decode_token(t))


# ---- E17-E19: rank-value tokenisation of count tables -----------------------------
def qc_pass(cells: DataFrame, col: str = "filter_pass") -> DataFrame:
    """Keep cells with filter_pass = 1; all cells when the column is absent."""
    if col not in cells.columns:
        return cells
    return cells.filter(F.col(col) == 1)


def normalised_counts(counts: DataFrame, cell: str = "cell", gene: str = "gene",
                      n: str = "n", target_sum: float = 10000.0) -> DataFrame:
    """counts / cell total * target_sum (cell totals: one grouped aggregate + join)."""
    totals = counts.groupBy(cell).agg(F.sum(n).alias("_total"))
    return (counts.join(totals, cell)
            .withColumn("norm", F.try_divide(F.col(n) * F.lit(target_sum), F.col("_total")))
            .drop("_total"))


def gene_factors_median(norm: DataFrame, gene: str = "gene") -> DataFrame:
    """Per-gene normalisation factor: the exact median of its non-zero normalised counts, as in
    the reference's table, selected for all genes at once (``selection``)."""
    return grouped_median(norm.filter(F.col("norm") > 0), [gene], "norm", "factor")


def gene_factors_mean(norm: DataFrame, gene: str = "gene") -> DataFrame:
    """Per-gene normalisation factor as the mean of non-zero normalised counts.

    A cheaper factor than the median; any (gene, factor) table can be passed to
    :func:`tokenize_rank_values`, a given one too.
    """
    return norm.filter(F.col("norm") > 0).groupBy(gene).agg(F.avg("norm").alias("factor"))


def tokenize_rank_values(counts: DataFrame, factors: DataFrame, cell: str = "cell",
                         gene: str = "gene", n: str = "n", token: str | None = None,
                         max_len: int = 2048, target_sum: float = 10000.0) -> DataFrame:
    """E17 + E18: per cell, normalised counts / gene factor, non-zero kept, ordered
    by value descending (ties by token), truncated to ``max_len`` with its length.

    The per-cell list is bounded by the gene vocabulary; the factor table is
    joined on gene (Spark broadcasts it when small, shuffles otherwise).
    """
    norm = normalised_counts(counts, cell, gene, n, target_sum)
    j = norm.join(factors, gene)
    tok = F.col(token) if token else F.col(gene)
    j = j.withColumn("_v", F.try_divide(F.col("norm"), F.col("factor"))).filter(F.col("_v") > 0)
    g = j.groupBy(cell).agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("_v")).alias("k"), tok.alias("t")))).alias("_s"))
    ids = F.slice(F.transform(F.col("_s"), lambda s: s["t"]), 1, max_len)
    return g.select(cell, ids.alias("input_ids")).withColumn("length", F.size("input_ids"))
