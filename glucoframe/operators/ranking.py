"""Skew-safe exact ranks and running sums (global or within a key), planned without running a job.

``row_number().over(Window.partitionBy(key).orderBy(...))`` sends a whole key to one task; a
class that holds a third of the rows would be sorted in one place. Here the order (key, order
columns) is cut into buckets at fixed bounds:

* the bounds are quantiles of a sample chosen by a hash of the columns themselves. They depend
  on the data only, not on partitions or on which task runs when, so a task that is run again,
  or a second evaluation of the plan, puts every row in the same bucket. They travel as one row;
* a row's bucket is a column expression (a binary search among the bounds), and its rank within
  (key, bucket) a window over a bounded piece of the key;
* only a key that holds a bound can lie in two buckets. Rows of these keys alone (as many keys
  as bounds, at most) are counted per bucket, which gives the offsets, a table of at most twice as
  many rows as there are buckets: it is broadcast.

All of it is one lazy plan. The input is read several times (count, sample, offsets, result), the
first three for the key and order columns only; ``whole=True`` asks for all columns each time, so
that an input that ends in a shuffle is shuffled once and its output reused. Order columns must be
reproducible values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 500_000
SAMPLED_PER_BUCKET = 64
MOST_BUCKETS = 4096


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` in which null equals null, so that no row with a null key is lost."""
    other = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    out = left.join(other, cond, how)
    return out if how == "left_semi" else out.drop(*[f"_r_{k}" for k in keys])


def range_bounds(df: DataFrame, cols: Sequence[str], buckets: int | None = None, whole: bool = False) -> DataFrame:
    """One row: ``_bounds``, the sorted lower ends of all buckets but the first, as structs of ``cols``.

    About ``ROWS_PER_BUCKET`` rows a bucket, ``MOST_BUCKETS`` at most; few rows have no bounds.
    Rows are drawn by their hash, so equal rows would come together: the columns should tell rows
    apart."""
    df = df if whole else df.select(*cols)
    mark = F.xxhash64(*df.columns)
    # by the hash: twice the rows of one half
    n = df.agg((F.count_if(mark >= 0) * 2).alias("_n")) if whole else df.agg(F.count("*").alias("_n"))
    wanted = (F.lit(min(buckets, MOST_BUCKETS)) if buckets else
              F.least(F.lit(MOST_BUCKETS), F.ceil(F.col("_n") / ROWS_PER_BUCKET))).cast("int")
    size = n.select(wanted.alias("_wanted"), F.when(wanted > 1, F.try_divide(wanted * SAMPLED_PER_BUCKET, F.col("_n"))).otherwise(0.0).alias("_share"))
    place = mark.cast("double") / F.lit(2.0 ** 64) + 0.5
    drawn = (df.crossJoin(F.broadcast(size)).where(place < F.col("_share"))
             .agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("_s"), F.max("_wanted").alias("_k")))
    s, k = F.col("_s"), F.col("_k")
    picked = F.transform(F.sequence(F.lit(1), k - 1), lambda i: F.element_at(s, F.greatest(F.lit(1), (i * F.size(s) / k).cast("int"))))
    return drawn.select(F.when((k > 1) & (F.size(s) > 0), F.array_distinct(picked)).otherwise(F.slice(s, 1, 0)).alias("_bounds"))


def with_bucket(df: DataFrame, cols: Sequence[str], bounds: DataFrame, out: str = "_b") -> DataFrame:
    """``df`` with the number of bounds at or below each row."""
    b, row = F.col("_bounds"), F.struct(*cols)
    steps = F.array(*[F.lit(MOST_BUCKETS >> i) for i in range(1, MOST_BUCKETS.bit_length())])
    found = F.aggregate(steps, F.lit(0), lambda lo, step: F.when(
        (lo + step <= F.size(b)) & (F.get(b, lo + step - 1) <= row), lo + step).otherwise(lo))
    return df.crossJoin(F.broadcast(bounds)).withColumn(out, F.when(F.size(b) > 0, found).otherwise(0)).drop("_bounds")


def _before(df: DataFrame, keys: Sequence[str], cols: Sequence[str], bounds: DataFrame,
            totals: dict[str, Column]) -> DataFrame:
    """(keys, _b, totals of the key's earlier buckets) for keys that lie in several buckets."""
    if keys:
        crossing = bounds.select(F.explode("_bounds").alias("_k")).select(*[F.col("_k")[k].alias(k) for k in keys]).distinct()
        df = join_null_safe(df, F.broadcast(crossing), keys, "left_semi")  # at most a row per bound
    counted = with_bucket(df, cols, bounds).groupBy(*keys, "_b").agg(*[t.alias(n) for n, t in totals.items()])
    # at most two rows per bound
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select(*keys, "_b", *[F.sum(n).over(w).alias(n) for n in totals], F.row_number().over(
        Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_b")).alias("_nth"))
    return before.where("_nth > 1").drop("_nth")


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
                out: str = "rank", num_partitions: int | None = None) -> DataFrame:
    """Add ``out`` = 0-based rank of each row within its ``keys`` group by ``order``.

    ``order`` must be a total order (add a unique tie-breaker); keys=[] gives a
    global rank. ``num_partitions``: buckets, in place of the number that the rows ask for.
    """
    names = [f"_o{i}" for i in range(len(order))]
    base = df.withColumns({n: F.col(o) if isinstance(o, str) else o for n, o in zip(names, order)})
    cols = [*keys, *names]
    bounds = range_bounds(base, cols, num_partitions)
    local = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*names)) - 1
    ranked = with_bucket(base, cols, bounds).withColumn("_loc", local)
    before = _before(base.select(*cols), keys, cols, bounds, {"_off": F.count("*")})
    j = join_null_safe(ranked, F.broadcast(before), [*keys, "_b"], "left")
    return j.withColumn(out, (F.col("_loc") + F.coalesce("_off", F.lit(0))).cast("long")).drop("_b", "_loc", "_off", *names)


def global_rank(df: DataFrame, order: Sequence[Column | str], out: str = "rank",
                **kw) -> DataFrame:
    """0-based rank of every row in ``order`` (total order required)."""
    return rank_within(df, [], order, out, **kw)


def prefix_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str] | str,
               out: Sequence[str] | str | None = None, num_partitions: int | None = None, whole: bool = False) -> DataFrame:
    """Running sums of ``values`` within ``keys`` in ``order`` (inclusive), skew-safe.

    Same scheme as :func:`rank_within`: local running sums within (key, bucket) plus offsets.
    ``order`` must be unique within a key.
    """
    vals = [values] if isinstance(values, str) else list(values)
    outs = ([out] if isinstance(out, str) else list(out)) if out else [f"cum_{v}" for v in vals]
    cols = [*keys, *order]
    bounds = range_bounds(df, cols, num_partitions, whole)
    w = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = with_bucket(df, cols, bounds).withColumns({f"_loc_{v}": F.sum(v).over(w) for v in vals})
    before = _before(df.select(*cols, *[v for v in vals if v not in cols]), keys, cols, bounds, {f"_off_{v}": F.sum(v) for v in vals})
    j = join_null_safe(summed, F.broadcast(before), [*keys, "_b"], "left")
    j = j.withColumns({o: F.when(F.col(f"_loc_{v}").isNull(), F.col(f"_off_{v}")).otherwise(
        F.col(f"_loc_{v}") + F.coalesce(f"_off_{v}", F.lit(0))) for v, o in zip(vals, outs)})
    return j.drop("_b", *[f"_loc_{v}" for v in vals], *[f"_off_{v}" for v in vals])
