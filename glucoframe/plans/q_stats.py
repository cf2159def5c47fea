"""Registered queries: per-series and per-cohort statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from glucoframe.operators import shape, spectra, stats
from glucoframe.plans.registry import query
from glucoframe.sources import bindings as B

SHARES = ["share_low", "share_in_range", "share_high"]


@query("band_counts", """
    SELECT CAST(count_if(value < 70) AS BIGINT) AS n_low,
           CAST(count_if(value >= 70 AND value < 180) AS BIGINT) AS n_in_range,
           CAST(count_if(value >= 180) AS BIGINT) AS n_high, count(*) AS n,
           count_if(value < 70) / count(*) AS share_low,
           count_if(value >= 70 AND value < 180) / count(*) AS share_in_range,
           count_if(value >= 180) / count(*) AS share_high
    FROM readings""", views=("readings",), round_cols=SHARES)
def q_band_counts(spark, sf_dir):
    """A1: corpus counts and shares of the three glucose bands."""
    return stats.band_counts(B.readings(spark, sf_dir))


_LOW_SHARE_SQL = """
    SELECT sample_id, avg(CAST(value <= 70 AS DOUBLE)) AS low_share, count(*) AS n
    FROM readings GROUP BY sample_id HAVING bool_or(value < 70)"""


@query("low_share", _LOW_SHARE_SQL, views=("readings",), round_cols=["low_share"])
def q_low_share(spark, sf_dir):
    """A2: share of readings <= 70 per sample, among samples with a reading < 70 (Q2)."""
    return stats.low_share(B.readings(spark, sf_dir))


@query("high_low_share_samples", f"SELECT * FROM ({_LOW_SHARE_SQL}) s WHERE low_share >= 0.4",
       views=("readings",), round_cols=["low_share"])
def q_high_low_share_samples(spark, sf_dir):
    """A3: samples whose low share is at least 0.4."""
    return stats.high_low_share_samples(stats.low_share(B.readings(spark, sf_dir)), 0.4)


@query("pooled_mean_std", f"""
    SELECT avg(value) AS mean, stddev_pop(value) AS std, count(*) AS n
    FROM readings WHERE sample_id IN (SELECT sample_id FROM ({_LOW_SHARE_SQL}) s WHERE low_share >= 0.4)""",
       views=("readings",), round_cols=["mean", "std"])
def q_pooled_mean_std(spark, sf_dir):
    """A4: pooled mean and population std of all readings of the A3 samples (semi join)."""
    rd = B.readings(spark, sf_dir)
    hi = stats.high_low_share_samples(stats.low_share(rd), 0.4).select("sample_id")
    return stats.pooled_mean_std(rd.join(hi, "sample_id", "left_semi"))


@query("label_counts", "SELECT types, count(*) AS n FROM sample_labels GROUP BY types",
       views=("sample_labels",))
def q_label_counts(spark, sf_dir):
    """A5: class histogram of the samples."""
    return stats.label_counts(B.sample_labels(spark, sf_dir), "types")


@query("low_rate_by_label", """
    SELECT l.types, avg(CAST(coalesce(f.low, false) AS DOUBLE)) AS low_rate, count(*) AS n
    FROM sample_labels l LEFT JOIN (SELECT sample_id, bool_or(value < 70) AS low FROM readings GROUP BY 1) f
      ON l.sample_id = f.sample_id
    GROUP BY l.types""", views=("readings", "sample_labels"), round_cols=["low_rate"])
def q_low_rate_by_label(spark, sf_dir):
    """Per class, share of samples with any reading under 70."""
    return stats.low_rate_by_label(B.readings(spark, sf_dir), B.sample_labels(spark, sf_dir))


@query("series_moments", """
    SELECT sample_id, avg(value) AS mean, var_pop(value) AS var, count(*) AS n
    FROM readings GROUP BY sample_id""", views=("readings",), round_cols=["mean", "var"])
def q_series_moments(spark, sf_dir):
    """Per series mean and population variance."""
    return stats.series_moments(B.readings(spark, sf_dir))


@query("acf", """
    WITH d AS (SELECT sample_id, pos, value - avg(value) OVER (PARTITION BY sample_id) AS x FROM readings),
    den AS (SELECT sample_id, sum(x * x) AS den FROM d GROUP BY 1),
    lags AS (SELECT CAST(range AS INTEGER) AS lag FROM range(21)),
    num AS (SELECT a.sample_id, l.lag, sum(a.x * b.x) AS num
            FROM d a CROSS JOIN lags l JOIN d b ON b.sample_id = a.sample_id AND b.pos = a.pos + l.lag
            GROUP BY 1, 2)
    SELECT den.sample_id, l.lag, CASE WHEN den = 0 THEN NULL ELSE coalesce(num, 0) / den END AS acf
    FROM den CROSS JOIN lags l LEFT JOIN num ON num.sample_id = den.sample_id AND num.lag = l.lag""",
       views=("readings",), round_cols=["acf"])
def q_acf(spark, sf_dir):
    """Autocorrelation, lags 0..20, per person-day series."""
    return stats.acf(B.readings(spark, sf_dir), nlags=20)


def ks_p_sql(gap: str = "gap", na: str = "na", nb: str = "nb", stat: str = "ks_stat") -> str:
    """p-value: exact up to na * nb = 100,000 by a recurrence over the diagonals of the lattice
    of merged samples, asymptotic beyond."""
    z = f"((sqrt({na} * {nb} / ({na} + {nb})) + 0.12 + 0.11 / sqrt({na} * {nb} / ({na} + {nb}))) * {stat})"
    return f"""CASE WHEN {na} * {nb} > 100000 THEN
             CASE WHEN {z} <= 0 THEN 1.0 ELSE least(greatest(2.0 * list_sum(list_transform(range(1, 101),
                lambda k: (CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2.0 * k * k * {z} * {z}))), 0.0), 1.0) END
           WHEN {gap} <= 0 THEN 1.0
           ELSE 1.0 - list_reduce(list_transform(range({na} + {nb}), lambda s: [CAST(s AS DOUBLE)]),
             lambda acc, e: list_transform(acc, lambda x, i:
               CASE WHEN abs((i - 1) * {nb} - (e[1] + 2 - i) * {na}) >= {gap} THEN 0.0
               ELSE (x * ({nb} - e[1] + i - 1) + coalesce(acc[i - 1], 0.0) * ({na} - i + 2)) / ({na} + {nb} - e[1]) END),
             list_transform(range({na} + 1), lambda i: CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END))[{na} + 1] END"""


def ks_sql(values: str, key: str | None = None) -> str:
    """KS of the CTE ``values`` (key, v, ta): ta tells the first sample."""
    k = f"{key}, " if key else ""
    part = f"PARTITION BY {key} " if key else ""
    same = f"USING ({key})" if key else "ON true"
    return f"""
    cnt AS (SELECT {k}v, count(*) FILTER (WHERE ta) AS ca, count(*) FILTER (WHERE NOT ta) AS cb FROM {values} GROUP BY {k}v),
    tot AS (SELECT {k}CAST(sum(ca) AS BIGINT) AS na, CAST(sum(cb) AS BIGINT) AS nb FROM cnt GROUP BY ALL),
    cum AS (SELECT {k}v, sum(ca) OVER ({part}ORDER BY v ROWS UNBOUNDED PRECEDING) AS ra,
                   sum(cb) OVER ({part}ORDER BY v ROWS UNBOUNDED PRECEDING) AS rb FROM cnt),
    d AS (SELECT {k}na, nb, max(abs(ra / na - rb / nb)) AS ks_stat, CAST(max(abs(ra * nb - rb * na)) AS BIGINT) AS gap
          FROM cum JOIN tot {same} WHERE na > 0 AND nb > 0 GROUP BY ALL)
    SELECT {k}na, nb, ks_stat, {ks_p_sql()} AS p_value, na * nb <= 100000 AS exact FROM d"""


def welch_sql(series: str, nperseg: int, by: str = "sample_id") -> str:
    """CTEs ending in psd (by, k, seg, psd) of a CTE ``series`` (by, t, n, value)."""
    return f"""
    seg AS (SELECT *, least({nperseg}, n) AS seg, least({nperseg}, n) - least({nperseg}, n) // 2 AS step FROM {series}),
    part AS (SELECT * FROM (SELECT *, unnest(range(0, (n - seg) // step + 1)) AS part FROM seg)
             WHERE t >= part * step AND t < part * step + seg),
    win AS (SELECT {by}, part, seg, t - part * step AS u,
                   (value - avg(value) OVER (PARTITION BY {by}, part))
                   * CASE WHEN seg = 1 THEN 1 ELSE 0.5 - 0.5 * cos(2 * pi() * (t - part * step) / seg) END AS x FROM part),
    freq AS (SELECT *, unnest(range(0, seg // 2 + 1)) AS k FROM win),
    trans AS (SELECT {by}, part, k, seg, sum(x * cos(2 * pi() * ((k * u) % seg) / seg)) AS re,
                     sum(x * sin(2 * pi() * ((k * u) % seg) / seg)) AS im FROM freq GROUP BY ALL),
    psd AS (SELECT {by}, k, seg, avg((re * re + im * im) * CASE WHEN k = 0 OR 2 * k = seg THEN 1 ELSE 2 END
                   / CASE WHEN seg <= 2 THEN 1.0 ELSE 0.375 * seg END) AS psd FROM trans GROUP BY ALL)"""


_ORDERED = """SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY pos) - 1 AS t,
               count(*) OVER (PARTITION BY sample_id) AS n, value FROM month_series"""


@query("welch_psd", f"""
    WITH s AS ({_ORDERED}),{welch_sql("s", 32)}
    SELECT sample_id, CAST(k AS INTEGER) AS k, k / seg AS freq, round(psd, 3) AS psd FROM psd""",
       views=("month_series",), round_cols=["freq", "psd"])
def q_welch_psd(spark, sf_dir):
    """Welch power spectrum of each person's month, segments of 32 blocks."""
    p = spectra.welch_psd(B.month_series(spark, sf_dir), nperseg=32)
    return p.select("sample_id", "k", "freq", (F.round(F.col("psd") * 1000.0, 0) / 1000.0).alias("psd"))


@query("adf_stat")
def q_adf_stat(spark, sf_dir):
    """A10: ADF statistic, p-value and lag of each person's month (all series of a batch in one
    orthogonalisation; rows-only check here, values in the unit tests)."""
    return spectra.adf_test(B.month_series(spark, sf_dir))


_FOLD_MEANS = """
    WITH s AS (SELECT round(avg(r.value), 6) AS v, max(l.fold) = 0 AS ta, max(types) AS types
               FROM readings r JOIN sample_labels l ON r.sample_id = l.sample_id GROUP BY r.sample_id),"""


def _fold_means(spark, sf_dir):
    lab = B.sample_labels(spark, sf_dir).select("sample_id", "fold", "types")
    return stats.series_moments(B.readings(spark, sf_dir)).join(lab, "sample_id").select(
        F.round("mean", 6).alias("value"), "fold", "types")


@query("ks_two_sample", _FOLD_MEANS + ks_sql("s"), views=("readings", "sample_labels"), round_cols=["ks_stat", "p_value"])
def q_ks_two_sample(spark, sf_dir):
    """KS statistic and p-value between per-series means of fold 0 and the rest."""
    m = _fold_means(spark, sf_dir)
    return stats.ks_two_sample(m.filter("fold = 0"), m.filter("fold <> 0"))


@query("ks_exact_by_class", """
    WITH s AS (SELECT types, round(avg(value), 6) AS v, max(fold) = 0 AS ta
               FROM events e JOIN persons p ON p.person = e.user_id GROUP BY user_id, types),""" + ks_sql("s", "types"),
       views=("persons",), round_cols=["ks_stat", "p_value"])
def q_ks_exact_by_class(spark, sf_dir):
    """Exact p-values: per class, persons' mean values of fold 0 against the rest."""
    means = (B.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("person")).agg(F.round(F.avg("value"), 6).alias("value"))
             .join(B.persons(spark, sf_dir), "person"))
    return stats.ks_two_sample(means.filter("fold = 0"), means.filter("fold <> 0"), by="types")


@query("hstack", """
    SELECT m.sample_id, m.mean, m.var, l.low_share
    FROM (SELECT sample_id, avg(value) AS mean, var_pop(value) AS var FROM readings GROUP BY 1) m
    JOIN (SELECT sample_id, avg(CAST(value <= 70 AS DOUBLE)) AS low_share FROM readings GROUP BY 1) l
      ON m.sample_id = l.sample_id""", views=("readings",), round_cols=["mean", "var", "low_share"])
def q_hstack(spark, sf_dir):
    """Two per-sample tables side by side on the sample key (strict: unique keys)."""
    rd = B.readings(spark, sf_dir)
    m = stats.series_moments(rd).select("sample_id", "mean", "var")
    everyone = rd.groupBy("sample_id").agg(F.avg((F.col("value") <= 70).cast("double")).alias("low_share"))
    return shape.hstack(m, everyone, key="sample_id", strict=True)
