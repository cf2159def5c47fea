"""Spectra and unit-root tests of bounded series.

The spectrum is a discrete Fourier transform in DataFrame functions: readings meet a broadcast
table of cosines and sines, and everything after the one shuffle by series stays where the
series is. The unit-root test fits all lags of all series of an Arrow batch at once, by one
batched orthogonalisation.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glucoframe.functions.glucose import is_missing


# ---- series in order -----------------------------------------------------------------
def ordered_series(rd: DataFrame, sample: str = "sample_id", pos: str = "pos", value: str = "value") -> DataFrame:
    """(sample, t, n, value): present readings numbered from 0 in position order, with their number."""
    w = Window.partitionBy(sample)
    return (rd.filter(~is_missing(value))
            .select(sample, (F.row_number().over(w.orderBy(pos)) - 1).alias("t"), F.count("*").over(w).cast("int").alias("n"),
                    F.col(value).cast("double").alias("value")))


# ---- A9 ------------------------------------------------------------------------------
def twiddles(df: DataFrame, nperseg: int) -> DataFrame:
    """(seg, j, c, s): cosine and sine of 2 pi j / seg for every segment length up to ``nperseg``;
    nperseg * (nperseg + 1) / 2 rows, whatever the data."""
    segs = df.sparkSession.range(1, nperseg + 1).select(F.col("id").cast("int").alias("seg"))
    angle = 2.0 * math.pi * F.col("j") / F.col("seg")
    return segs.select("seg", F.explode(F.sequence(F.lit(0), F.col("seg") - 1)).alias("j")).select(
        "seg", "j", F.cos(angle).alias("c"), F.sin(angle).alias("s"))


def welch_psd(rd: DataFrame, nperseg: int = 256, sample: str = "sample_id", pos: str = "pos",
              value: str = "value") -> DataFrame:
    """Welch power spectrum per series, (sample, k, freq, psd): periodic Hann window, half
    overlap, segment mean removed, density scaling, one-sided, averaged over segments.

    Present readings count in position order; a series shorter than ``nperseg`` is one segment.
    """
    d = ordered_series(rd, sample, pos, value)
    seg = F.least(F.lit(nperseg), F.col("n"))
    d = d.withColumn("seg", seg.cast("int")).withColumn("step", (F.col("seg") - F.floor(F.col("seg") / 2)).cast("int"))
    # segments that hold position t: those that start in (t - seg, t], of the ones that end within the series
    last = F.floor((F.col("n") - F.col("seg")) / F.col("step"))
    low = F.greatest(F.lit(0), F.ceil((F.col("t") - F.col("seg") + 1) / F.col("step")))
    high = F.least(last, F.floor(F.col("t") / F.col("step")))
    d = (d.where(low <= high).withColumn("part", F.explode(F.sequence(low, high)))
         .withColumn("u", (F.col("t") - F.col("part") * F.col("step")).cast("int"))
         .withColumn("x", F.col("value") - F.avg("value").over(Window.partitionBy(sample, "part"))))
    table = F.broadcast(twiddles(rd, nperseg))
    hann = F.when(F.col("seg") == 1, F.lit(1.0)).otherwise(0.5 - 0.5 * F.col("c"))
    d = d.join(table.withColumnRenamed("j", "u").drop("s"), ["seg", "u"]).select(
        sample, "part", "seg", "u", (F.col("x") * hann).alias("x"),
        F.explode(F.sequence(F.lit(0), F.floor(F.col("seg") / 2).cast("int"))).alias("k"))
    d = d.withColumn("j", ((F.col("k") * F.col("u")) % F.col("seg")).cast("int")).join(table, ["seg", "j"])
    parts = d.groupBy(sample, "part", "k", "seg").agg(F.sum(F.col("x") * F.col("c")).alias("re"), F.sum(F.col("x") * F.col("s")).alias("im"))
    # sum of the squared window: 3/8 of the length from three on
    power = F.when(F.col("seg") <= 2, F.lit(1.0)).otherwise(0.375 * F.col("seg"))
    sides = F.when((F.col("k") == 0) | (2 * F.col("k") == F.col("seg")), 1.0).otherwise(2.0)
    density = sides * (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / power
    return parts.groupBy(sample, "k", "seg").agg(F.avg(density).alias("psd")).select(
        sample, "k", (F.col("k") / F.col("seg")).alias("freq"), "psd")


# ---- A10 -----------------------------------------------------------------------------
#: fixed values: response surface of the Dickey-Fuller t statistic with a constant (MacKinnon):
#: beyond these bounds the p-value is 0 or 1; polynomial coefficients below and above the middle one
TAU_MIN, TAU_MID, TAU_MAX = -18.83, -1.61, 2.74
P_BELOW = (2.1659, 1.4412, 0.038269)
P_ABOVE = (1.7339, 0.93202, -0.12745, -0.010368)

CHUNK_BYTES = 32 << 20
_erfc = np.frompyfunc(math.erfc, 1, 1)
ADF_SCHEMA = "{sample} string, adf_stat double, p_value double, used_lag int, nobs int"


def adf_p_value(stat: np.ndarray) -> np.ndarray:
    """p-value of t statistics by the response surface; nan stays nan."""
    z = np.where(stat <= TAU_MID, np.polynomial.polynomial.polyval(stat, P_BELOW), np.polynomial.polynomial.polyval(stat, P_ABOVE))
    p = 0.5 * _erfc(-z / math.sqrt(2.0)).astype(np.float64)
    return np.where(np.isnan(stat), np.nan, np.where(stat > TAU_MAX, 1.0, np.where(stat < TAU_MIN, 0.0, p)))


def orthogonal(columns: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Orthonormal columns (series x time) of the given ones, in order, for all series at once, and
    whether each adds to those before it: one that is (nearly) their combination becomes zeros."""
    done, adds = [], []
    for c in columns:
        size = np.sqrt((c * c).sum(axis=1))
        r = c.copy()
        for _ in range(2):  # a second pass restores what cancellation lost
            for q in done:
                r -= (q * r).sum(axis=1, keepdims=True) * q
        left = np.sqrt((r * r).sum(axis=1))
        new = left > 1e-9 * np.maximum(size, 1e-300)
        done.append(np.where(new[:, None], r / np.where(new, left, 1.0)[:, None], 0.0))
        adds.append(new)
    return done, adds


def adf_batch(x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ADF t statistic (constant, no trend) and lag of each series: row i of ``x`` holds n[i]
    values. The lag has the least AIC among 0..max on the sample that all of them share, the
    statistic comes from a refit on all rows that the chosen lag leaves. nan: too short or constant."""
    most = np.minimum(np.ceil(12.0 * (n / 100.0) ** 0.25), n // 2 - 2).astype(int)
    usable = (n >= 6) & (most >= 0) & (np.where(np.arange(x.shape[1]) < n[:, None], x, x[:, :1]) != x[:, :1]).any(axis=1)
    most = np.where(usable, most, 0)
    dx = np.diff(x, axis=1)
    time = np.arange(dx.shape[1])
    inside = time < (n - 1)[:, None]

    def lagged(j: int) -> np.ndarray:
        out = np.zeros_like(dx)
        out[:, j:] = dx[:, :dx.shape[1] - j]
        return out

    deepest = int(most.max(initial=0))
    # one sample for all lags of a series: rows from its largest lag on
    rows = inside & (time >= most[:, None])
    y = np.where(rows, dx, 0.0)
    q, adds = orthogonal([np.where(rows, c, 0.0) for c in (np.ones_like(dx), x[:, :-1], *(lagged(j) for j in range(1, deepest + 1)))])
    nobs = rows.sum(axis=1)
    rss = (y * y).sum(axis=1) - (q[0] * y).sum(axis=1) ** 2
    best, lag = np.full(len(x), np.inf), np.zeros(len(x), int)
    for j in range(deepest + 1):
        rss = rss - (q[j + 1] * y).sum(axis=1) ** 2
        with np.errstate(divide="ignore", invalid="ignore"):
            aic = nobs * np.log(np.maximum(rss, 0.0) / nobs + 1e-300) + 2 * (j + 2)
        better = (j <= most) & (nobs > j + 2) & (aic < best)
        best, lag = np.where(better, aic, best), np.where(better, j, lag)

    rows = inside & (time >= lag[:, None])
    y = np.where(rows, dx, 0.0)
    # the level comes last: what is left of it carries its coefficient
    columns = [np.where(rows, np.ones_like(dx), 0.0)]
    columns += [np.where(rows & (lag >= j)[:, None], lagged(j), 0.0) for j in range(1, int(lag.max(initial=0)) + 1)]
    level = np.where(rows, x[:, :-1], 0.0)
    q, adds = orthogonal([*columns, level])
    fitted = [(c * y).sum(axis=1) for c in q]
    resid = y - sum(f[:, None] * c for f, c in zip(fitted, q))
    freedom = rows.sum(axis=1) - lag - 2
    usable &= adds[-1] & (freedom > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        sigma = np.sqrt((resid * resid).sum(axis=1) / freedom)
        stat = fitted[-1] / sigma
    return np.where(usable & np.isfinite(stat), stat, np.nan), lag


def _adf(batches, sample: str):
    for batch in batches:
        lists = batch.column("xs")
        offsets = lists.offsets.to_numpy()
        values, n = lists.values.to_numpy(), np.diff(offsets)
        stat, lag = np.full(len(n), np.nan), np.zeros(len(n), int)
        by_length = np.argsort(n, kind="stable")
        i = 0
        while i < len(n):
            # series of like length together, as many as a chunk holds
            j = i + 1
            while j < len(n) and (j - i + 1) * int(n[by_length[j]]) * 8 * 32 <= CHUNK_BYTES:
                j += 1
            at = by_length[i:j]
            width = max(int(n[at].max()), 2)
            x = np.zeros((len(at), width))
            place = np.arange(width) < n[at][:, None]
            x[place] = np.concatenate([values[offsets[k]:offsets[k + 1]] for k in at])
            # centred: the constant takes up the mean, and cancellation stays small
            x = np.where(place, x - (x.sum(axis=1) / np.maximum(n[at], 1))[:, None], 0.0)
            stat[at], lag[at] = adf_batch(x, n[at])
            i = j
        p = adf_p_value(stat)
        yield pa.RecordBatch.from_arrays(
            [batch.column(sample), pa.array(stat, pa.float64(), mask=np.isnan(stat)), pa.array(p, pa.float64(), mask=np.isnan(p)),
             pa.array(lag.astype(np.int32)), pa.array(n.astype(np.int32))], [sample, "adf_stat", "p_value", "used_lag", "nobs"])


def adf_test(rd: DataFrame, sample: str = "sample_id", pos: str = "pos", value: str = "value") -> DataFrame:
    """A10: augmented Dickey-Fuller test per series (constant, lag by AIC): statistic, p-value, lag
    and number of present readings. Null statistic: constant or fewer than six readings."""
    series = (rd.filter(~is_missing(value)).groupBy(F.col(sample).cast("string").alias(sample))
              .agg(F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(value).cast("double").alias("v")))).alias("xs"))
              .select(sample, F.transform("xs", lambda r: r["v"]).alias("xs")))
    return series.mapInArrow(lambda batches: _adf(batches, sample), ADF_SCHEMA.format(sample=sample))


# ---- Kolmogorov-Smirnov p-values -------------------------------------------------------
def kolmogorov_sf(z: Column, terms: int = 100) -> Column:
    """Asymptotic two-sided p-value Q(z) = 2 sum (-1)^(k-1) exp(-2 k^2 z^2)."""
    s = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
                    lambda acc, k: acc + F.when(k % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
                    * F.exp(F.lit(-2.0) * k * k * z * z))
    return F.when(z <= 0, F.lit(1.0)).otherwise(F.least(F.greatest(2.0 * s, F.lit(0.0)), F.lit(1.0)))


def ks_exact_p(gap: Column, na: Column, nb: Column) -> Column:
    """Exact two-sided p-value of the two-sample statistic, with ``gap`` = D * na * nb as a whole number.

    Under the null hypothesis the merged samples are a random lattice path from (0, 0) to
    (na, nb); p is the chance that it leaves the band |i * nb - j * na| < gap. The chances of the
    places i on the diagonal i + j = s are an array of na + 1 numbers, folded over s; what leaves
    the band is summed up on its way, so small p-values keep their digits."""
    total = na + nb
    start = F.struct(F.transform(F.sequence(F.lit(0), na), lambda i: F.when(i == 0, 1.0).otherwise(0.0)).alias("inside"),
                     F.lit(0.0).alias("left"))

    def step(state: Column, s: Column) -> Column:
        here = state["inside"]
        # from (i, s - i) a step in b keeps i, a step in a comes from i - 1
        moved = F.transform(here, lambda x, i: (x * (nb - s + i) + F.coalesce(F.get(here, i - 1), F.lit(0.0)) * (na - i + 1)) / (total - s))
        inside = lambda i: F.abs(i * nb - (s + 1 - i) * na) < gap
        # an array of one element binds the moved chances once for both uses
        return F.element_at(F.transform(F.array(moved), lambda m: F.struct(
            F.transform(m, lambda x, i: F.when(inside(i), x).otherwise(0.0)).alias("inside"),
            (state["left"] + F.aggregate(F.transform(m, lambda x, i: F.when(inside(i), 0.0).otherwise(x)), F.lit(0.0),
                                         lambda a, x: a + x)).alias("left"))), 1)

    p = F.aggregate(F.sequence(F.lit(0).cast("long"), total - 1), start, step, lambda state: state["left"])
    return F.when(gap <= 0, F.lit(1.0)).otherwise(F.least(p, F.lit(1.0)))
