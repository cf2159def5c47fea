"""Exact order statistics of many keys at once.

Values are counted once per (key, value); the counts' running sums by value, which split a large key
at range bounds (``ranking.prefix_sum``), tell the ranks that each value covers, and the wanted ranks
are picked out. No key's values ever meet in one task, however many there are, and all keys move
together, in one plan that starts no job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glucoframe.functions.glucose import is_missing
from glucoframe.operators.ranking import join_null_safe, prefix_sum


def order_statistics(df: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, Column],
                     buckets: int | None = None) -> DataFrame:
    """Per key, the value at each of ``ranks``: name -> 0-based rank as a column of ``_n``, the number
    of the key's values (null and NaN are left out). One row per key; null keys are a key of their own.
    ``buckets``: range buckets, in place of the number that the rows ask for."""
    keys = list(keys)
    counts = (df.filter(~is_missing(value)).select(*keys, F.col(value).cast("double").alias("_v"))
              .groupBy(*keys, "_v").agg(F.count("*").alias("_c")))
    n = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    summed = prefix_sum(counts, keys, ["_v"], "_c", "_upto", num_partitions=buckets, whole=True)
    targets = F.array(*[F.struct(F.lit(name).alias("_t"), r.cast("long").alias("_rank")) for name, r in ranks.items()])
    first = F.col("_upto") - F.col("_c")
    covered = F.filter(targets, lambda t: (t["_rank"] >= first) & (t["_rank"] < F.col("_upto")))
    hit = join_null_safe(summed, n, keys).select(*keys, "_v", F.inline(covered))
    return hit.groupBy(*keys).agg(*[F.max(F.when(F.col("_t") == name, F.col("_v"))).alias(name) for name in ranks])


def grouped_median(df: DataFrame, keys: Sequence[str], value: str, out: str = "median", buckets: int | None = None) -> DataFrame:
    """Exact median per key (mean of the two middle values of an even number)."""
    half = {"_lo": F.floor((F.col("_n") - 1) / 2), "_hi": F.floor(F.col("_n") / 2)}
    mid = order_statistics(df, keys, value, half, buckets)
    return mid.select(*keys, ((F.col("_lo") + F.col("_hi")) / 2.0).alias(out))
