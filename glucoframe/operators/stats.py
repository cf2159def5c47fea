"""Per-series and per-cohort statistics (A1-A8, A11, A12; A9 and A10 in ``spectra``) on long-form readings.

Long form: (sample_id, pos, value). Aggregations are grouped (partial
aggregation before the shuffle), per-series work is bounded by one day.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glucoframe.functions.glucose import HIGH, LOW, is_missing
from glucoframe.operators.ranking import join_null_safe, prefix_sum
from glucoframe.operators.spectra import kolmogorov_sf, ks_exact_p, ordered_series, welch_psd


def _keys(by) -> list:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


# ---- A1-A7 ------------------------------------------------------------------------
def band_counts(rd: DataFrame, value: str = "value", by=None) -> DataFrame:
    """A1: counts and shares of low (< 70), in-range and high (>= 180) readings."""
    v = F.col(value)
    ok = ~is_missing(value)
    g = rd.groupBy(*_keys(by)).agg(
        F.count_if(ok & (v < LOW)).alias("n_low"),
        F.count_if(ok & (v >= LOW) & (v < HIGH)).alias("n_in_range"),
        F.count_if(ok & (v >= HIGH)).alias("n_high"),
        F.count_if(ok).alias("n"))
    return (g.withColumn("share_low", F.try_divide(F.col("n_low"), F.col("n")))
             .withColumn("share_in_range", F.try_divide(F.col("n_in_range"), F.col("n")))
             .withColumn("share_high", F.try_divide(F.col("n_high"), F.col("n"))))


def combine_band_counts(counts: DataFrame, by) -> DataFrame:
    """Roll band counts (n_low, n_in_range, n_high, n) up to coarser groups and
    recompute the shares: pre-aggregate per fine key (e.g. person), join the
    small result to labels, then combine."""
    g = counts.groupBy(*_keys(by)).agg(*[F.sum(c).alias(c) for c in ("n_low", "n_in_range", "n_high", "n")])
    for c in ("low", "in_range", "high"):
        g = g.withColumn(f"share_{c}", F.try_divide(F.col(f"n_{c}"), F.col("n")))
    return g


def low_share(rd: DataFrame, sample: str = "sample_id", value: str = "value",
              threshold: float = LOW, share_inclusive: bool = True,
              filter_inclusive: bool = False) -> DataFrame:
    """A2: per sample, share of readings <= 70, among samples with a reading < 70 (Q2)."""
    v = F.col(value)
    share_hit = (v <= threshold) if share_inclusive else (v < threshold)
    any_hit = (v <= threshold) if filter_inclusive else (v < threshold)
    ok = ~is_missing(value)
    g = rd.filter(ok).groupBy(sample).agg(
        F.avg(share_hit.cast("double")).alias("low_share"),
        F.max(any_hit.cast("int")).alias("_any"),
        F.count("*").alias("n"))
    return g.filter(F.col("_any") == 1).drop("_any")


def high_low_share_samples(shares: DataFrame, threshold: float = 0.4) -> DataFrame:
    """A3: samples whose low share is at least the threshold."""
    return shares.filter(F.col("low_share") >= threshold)


def pooled_mean_std(rd: DataFrame, value: str = "value", by=None) -> DataFrame:
    """A4: mean and population standard deviation over all readings (per group)."""
    ok = rd.filter(~is_missing(value))
    return ok.groupBy(*_keys(by)).agg(F.avg(value).alias("mean"),
                                      F.stddev_pop(value).alias("std"),
                                      F.count("*").alias("n"))


def label_counts(df: DataFrame, col: str) -> DataFrame:
    """A5: class histogram."""
    return df.groupBy(col).agg(F.count("*").alias("n"))


def low_rate_by_label(rd: DataFrame, labels: DataFrame, col: str = "types",
                      sample: str = "sample_id", value: str = "value",
                      threshold: float = LOW) -> DataFrame:
    """Per class, share of samples with any reading under the threshold.

    Samples without readings count as "no low reading".
    """
    flags = rd.groupBy(sample).agg(
        F.max(F.coalesce((F.col(value) < threshold), F.lit(False)).cast("int")).alias("_low"))
    j = labels.select(sample, col).join(flags, sample, "left")
    return j.groupBy(col).agg(F.avg(F.coalesce(F.col("_low"), F.lit(0)).cast("double")).alias("low_rate"),
                              F.count("*").alias("n"))


def series_moments(rd: DataFrame, sample: str = "sample_id", value: str = "value") -> DataFrame:
    """Per series mean and population variance (missing readings ignored)."""
    ok = rd.filter(~is_missing(value))
    return ok.groupBy(sample).agg(F.avg(value).alias("mean"), F.var_pop(value).alias("var"),
                                  F.count("*").alias("n"))


# ---- A8 ---------------------------------------------------------------------------
def acf(rd: DataFrame, nlags: int = 20, sample: str = "sample_id", pos: str = "pos",
        value: str = "value") -> DataFrame:
    """Autocorrelation for lags 0..nlags per series, on long form.

    acf_k = sum over present pairs (x_t - m)(x_{t+k} - m) / sum over present
    (x_t - m)^2, m = mean of the present readings (statsmodels' default
    estimator on a gap-free series); a lag without pairs gives 0, zero variance
    gives null.

    Plan: one shuffle by sample, of the bounded positions and values; then all lags of the series of
    an Arrow batch at once, as products of a dense matrix with itself shifted.
    """
    series = rd.filter(~is_missing(value)).groupBy(sample).agg(F.collect_list(F.struct(
        F.col(pos).cast("int").alias("p"), F.col(value).cast("double").alias("v"))).alias("_pv"))
    schema = T.StructType([rd.schema[sample], T.StructField("_r", T.ArrayType(T.DoubleType()))])
    out = series.mapInArrow(lambda batches: _acf(batches, nlags), schema)
    return out.select(sample, F.posexplode("_r").alias("lag", "acf"))


#: numbers of a dense block of series
BLOCK_CELLS = 1 << 21


def _acf(batches, nlags: int):
    for batch in batches:
        lists = batch.column(1)
        offsets, entries = lists.offsets.to_numpy(), lists.flatten()
        offsets = offsets - offsets[0]
        at, v = entries.field("p").to_numpy(), entries.field("v").to_numpy()
        out = np.zeros((len(batch), nlags + 1))
        i = 0
        while i < len(batch):
            # positions from each series' first one on
            j = min(len(batch), i + max(1, BLOCK_CELLS // max(1, int(at.max() - at.min()) + 1)))
            size = np.diff(offsets[i:j + 1])
            row = np.repeat(np.arange(j - i), size)
            own, x = at[offsets[i]:offsets[j]], v[offsets[i]:offsets[j]]
            low = np.minimum.reduceat(own, offsets[i:j] - offsets[i])
            x = x - np.repeat(np.add.reduceat(x, offsets[i:j] - offsets[i]) / size, size)
            dense = np.zeros((j - i, int((own - low[row]).max()) + 1))
            np.add.at(dense, (row, own - low[row]), x)
            den = np.bincount(row, weights=x * x, minlength=j - i)
            for k in range(min(nlags, dense.shape[1] - 1) + 1):
                out[i:j, k] = (dense[:, :dense.shape[1] - k] * dense[:, k:]).sum(axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                out[i:j] = np.where(den[:, None] != 0, out[i:j] / den[:, None], np.nan)
            i = j
        flat = out.ravel()
        made = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, nlags + 1), pa.int32()),
                                        pa.array(flat, pa.float64(), mask=np.isnan(flat)))
        yield pa.RecordBatch.from_arrays([batch.column(0), made], [batch.schema.names[0], "_r"])


# ---- A11 / A12 ----------------------------------------------------------------------
#: up to so large a product of the sample sizes the p-value is exact
EXACT_UP_TO = 100_000


def ks_two_sample(a: DataFrame, b: DataFrame, value: str = "value", by=None, exact_up_to: int = EXACT_UP_TO) -> DataFrame:
    """Two-sample KS statistic D = max |F_a - F_b| and its p-value, per ``by`` group.

    The p-value is exact where na * nb <= ``exact_up_to``, asymptotic beyond (``exact`` tells).
    Values are counted per distinct value (partial aggregation); the two
    empirical CDFs are running sums over the value order within each group,
    computed with the skew-safe distributed prefix sum (no single-task window),
    all groups in one pass. A group without rows on either side has no row.
    """
    keys = _keys(by)
    ta = a.select(*keys, F.col(value).alias("v")).filter(~is_missing("v")).withColumn("_t", F.lit(0))
    tb = b.select(*keys, F.col(value).alias("v")).filter(~is_missing("v")).withColumn("_t", F.lit(1))
    both = ta.unionByName(tb)
    cnt = both.groupBy(*keys, "v").agg(F.count_if(F.col("_t") == 0).alias("ca"),
                                        F.count_if(F.col("_t") == 1).alias("cb"))
    tot = cnt.groupBy(*keys).agg(F.sum("ca").alias("na"), F.sum("cb").alias("nb")).where("na > 0 AND nb > 0")
    cum = prefix_sum(cnt, keys, ["v"], ["ca", "cb"], ["ra", "rb"], whole=True)
    j = join_null_safe(cum, tot, keys) if keys else cum.crossJoin(F.broadcast(tot))
    gap = F.abs(F.try_divide(F.col("ra"), F.col("na")) - F.try_divide(F.col("rb"), F.col("nb")))
    d = j.groupBy(*keys, "na", "nb").agg(F.max(gap).alias("ks_stat"))
    en = F.col("na") * F.col("nb") / (F.col("na") + F.col("nb"))
    z = (F.sqrt(en) + 0.12 + 0.11 / F.sqrt(en)) * F.col("ks_stat")
    few = F.col("na").cast("double") * F.col("nb") <= exact_up_to
    # the statistic is a multiple of 1 / (na * nb)
    steps = F.round(F.when(few, F.col("ks_stat") * F.col("na") * F.col("nb"))).cast("long")
    p = F.when(few, ks_exact_p(steps, F.least("na", "nb"), F.greatest("na", "nb"))).otherwise(kolmogorov_sf(z))
    if keys:  # few and small rows, but each takes some time
        d = d.repartition(a.sparkSession.sparkContext.defaultParallelism)
    return d.withColumn("p_value", p).withColumn("exact", few)


def series_measures(rd: DataFrame, nlags: int = 50, nperseg: int = 256, sample: str = "sample_id", pos: str = "pos",
                    value: str = "value", digits: int | None = 9) -> DataFrame:
    """(measure, value) of every series, present readings in order: ``mean``, ``var``, ``acf_k`` for
    lags below the length, ``psd_k``, and all lags (``acf``) and bins (``psd``) taken together.
    Values are kept at ``digits`` decimals (round(x * 10^d) / 10^d), so last-bit noise of the sums
    cannot split equal values."""
    series = ordered_series(rd, sample, pos, value)

    def rnd(c):
        return c if digits is None else F.round(c * float(10 ** digits), 0) / float(10 ** digits)

    def rows(df, *pairs):
        return df.select(F.inline(F.array(*[F.struct(m.alias("measure"), rnd(v).alias("value")) for m, v in pairs])))

    lags = acf(series, nlags, sample, "t", "value").join(series.where("t = 0").select(sample, "n"), sample).where("lag < n")
    psd = welch_psd(series.select(sample, F.col("t").alias(pos), F.col("value").alias(value)), nperseg, sample, pos, value)
    out = rows(series_moments(series, sample, "value"), (F.lit("mean"), F.col("mean")), (F.lit("var"), F.col("var")))
    for df, c, k in ((lags, "acf", "lag"), (psd, "psd", "k")):
        out = out.unionByName(rows(df, (F.lit(c), F.col(c)), (F.concat(F.lit(f"{c}_"), F.col(k).cast("string")), F.col(c))))
    return out.where("value IS NOT NULL")


def sampling_quality(a: DataFrame, b: DataFrame, nlags: int = 50, nperseg: int = 256, sample: str = "sample_id",
                     pos: str = "pos", value: str = "value", digits: int | None = 9,
                     exact_up_to: int = EXACT_UP_TO) -> DataFrame:
    """KS of per-series means, variances, autocorrelations (each lag, and all) and spectra
    (each bin, and all) between two sets of series: every measure is a key of one KS pass, and
    keys are split by value range, so the pooled ones never meet in one task."""
    r = ks_two_sample(*(series_measures(x, nlags, nperseg, sample, pos, value, digits) for x in (a, b)),
                      by="measure", exact_up_to=exact_up_to)
    return r.select("measure", "na", "nb", "ks_stat", "p_value", "exact")
