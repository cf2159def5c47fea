"""Clinical scaling, derived values and training objectives as tables.

Bounds and group means are one-row (or few-row) aggregates joined back by
broadcast; nothing is computed per pair of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glucoframe.functions.glucose import is_missing

# fixed values: loss weight of the course target p = 0.4, the rest share 1 - p
COURSE_WEIGHT = 0.4


def _bounds(fit: DataFrame, cols: Sequence[str]) -> DataFrame:
    return fit.agg(*[e for c in cols for e in (F.min(c).alias(f"_min_{c}"), F.max(c).alias(f"_max_{c}"))])


def minmax_fit_apply(fit: DataFrame, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Scale ``df`` columns with the min / max of ``fit`` (one-row aggregate, broadcast).

    A constant column gives 0/0 -> null (Q13, ``try_divide``)."""
    b = _bounds(fit, cols)
    j = df.crossJoin(F.broadcast(b))
    for c in cols:
        j = j.withColumn(c, F.try_divide(F.col(c) - F.col(f"_min_{c}"),
                                         F.col(f"_max_{c}") - F.col(f"_min_{c}")))
    return j.drop(*[n for c in cols for n in (f"_min_{c}", f"_max_{c}")])


def minmax(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per-column min-max scaling with the table's own bounds."""
    return minmax_fit_apply(df, df, cols)


def minmax_global(df: DataFrame, arrays: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """One min and one max over all elements of several array columns; returns
    (scaled frame, one-row bounds frame with gmin, gmax) for :func:`minmax_inverse`."""
    mins = [F.array_min(a) for a in arrays]
    maxs = [F.array_max(a) for a in arrays]
    b = df.agg(F.min(F.least(*mins) if len(mins) > 1 else mins[0]).alias("gmin"),
               F.max(F.greatest(*maxs) if len(maxs) > 1 else maxs[0]).alias("gmax"))
    j = df.crossJoin(F.broadcast(b))
    for a in arrays:
        j = j.withColumn(a, F.transform(a, lambda x: F.try_divide(x - F.col("gmin"), F.col("gmax") - F.col("gmin"))))
    return j.drop("gmin", "gmax"), b


def minmax_inverse(df: DataFrame, bounds: DataFrame, arrays: Sequence[str]) -> DataFrame:
    """A27 inverse: x * (gmax - gmin) + gmin."""
    j = df.crossJoin(F.broadcast(bounds))
    for a in arrays:
        j = j.withColumn(a, F.transform(a, lambda x: x * (F.col("gmax") - F.col("gmin")) + F.col("gmin")))
    return j.drop("gmin", "gmax")


def homa_ir(df: DataFrame, homa_is: str = "HOMA_IS", out: str = "HOMA_IR") -> DataFrame:
    """HOMA-IR = 1 / HOMA-IS after range cleaning (null stays null)."""
    return df.withColumn(out, F.try_divide(F.lit(1.0), F.col(homa_is)))


def unpivot_targets(df: DataFrame, key: str, targets: Sequence[str], preds: Sequence[str]) -> DataFrame:
    """(key, t, y, p) rows, one per target."""
    entries = F.array(*[F.struct(F.lit(i).alias("t"), F.col(y).cast("double").alias("y"),
                                 F.col(p).cast("double").alias("p"))
                        for i, (y, p) in enumerate(zip(targets, preds))])
    return df.select(key, F.inline(entries))


def masked_weighted_mse(df: DataFrame, key: str, targets: Sequence[str], preds: Sequence[str],
                        p: float = COURSE_WEIGHT) -> DataFrame:
    """sum(weight * squared error over present targets) / number of present targets.

    Weights: ``p`` for the first target (the course), (1 - p) / (k - 1) for the
    other k - 1 targets (the reference's weight vector).
    """
    k = len(targets) - 1
    lg = unpivot_targets(df, key, targets, preds)
    w = F.when(F.col("t") == 0, F.lit(p)).otherwise(F.lit((1.0 - p) / k))
    ok = ~is_missing("y")
    return lg.agg(
        F.try_divide(F.sum(F.when(ok, w * (F.col("p") - F.col("y")) ** 2)), F.count_if(ok).cast("double")).alias("loss"),
        F.count_if(ok).alias("n_present"))


def course_ordering_score(df: DataFrame, score: str = "score", course: str = "course") -> DataFrame:
    """Mean score gap 0 -> 0.5 and 0.5 -> 1; loss = (1 - gap1) + (1 - gap2).

    The mean of all pairwise differences between two groups equals the
    difference of the group means, so three grouped means replace the pairs.
    """
    g = df.groupBy().agg(*[F.avg(F.when(F.col(course) == v, F.col(score))).alias(n)
                           for v, n in ((0.0, "_m0"), (0.5, "_m05"), (1.0, "_m1"))])
    gap1 = F.col("_m05") - F.col("_m0")
    gap2 = F.col("_m1") - F.col("_m05")
    return g.select(gap1.alias("gap_0_05"), gap2.alias("gap_05_1"),
                    ((1.0 - gap1) + (1.0 - gap2)).alias("loss"))


def target_correlation(df: DataFrame, score: str, targets: Sequence[str]) -> DataFrame:
    """Pearson correlation of a score with each clinical target (one scan)."""
    lg = df.select(score, F.inline(F.array(*[F.struct(F.lit(t).alias("target"),
                                                      F.col(t).cast("double").alias("y"))
                                             for t in targets])))
    lg = lg.filter(~is_missing("y"))
    return lg.groupBy("target").agg(F.corr(score, "y").alias("corr"), F.count("*").alias("n"))
