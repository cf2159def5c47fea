"""Spectra, unit-root and KS tests, order statistics and ranks against plain numpy."""
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from glucoframe.operators import ranking, selection, spectra, stats

LONG = "sample_id string, pos int, value double"


def long(spark, series, schema=LONG):
    return spark.createDataFrame([(k, i, None if v is None else float(v)) for k, x in series.items() for i, v in enumerate(x)], schema)


# ---- spectrum --------------------------------------------------------------------------
def welch_numpy(x, nperseg):
    seg = min(nperseg, len(x))
    win = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(seg) / seg) if seg > 1 else np.ones(1)
    parts = [x[s:s + seg] for s in range(0, len(x) - seg + 1, seg - seg // 2)]
    p = np.mean([np.abs(np.fft.rfft((y - y.mean()) * win)) ** 2 for y in parts], axis=0) / (win * win).sum()
    p[1:(-1 if seg % 2 == 0 else None)] *= 2
    return np.fft.rfftfreq(seg), p


def test_welch_equals_fft(spark):
    rng = np.random.default_rng(0)
    series = {f"n{n}": rng.normal(100, 20, n) for n in (1, 2, 3, 5, 16, 17, 31, 40, 288)}
    series["sine"] = np.sin(2 * np.pi * 0.125 * np.arange(64))
    series["flat"] = np.ones(20)
    got = {}
    for r in spectra.welch_psd(long(spark, series), nperseg=16).collect():
        got.setdefault(r["sample_id"], {})[r["k"]] = (r["freq"], r["psd"])
    assert set(got) == set(series)
    for k, x in series.items():
        freq, psd = welch_numpy(np.asarray(x, float), 16)
        assert sorted(got[k]) == list(range(len(psd)))
        assert np.allclose([got[k][i][0] for i in range(len(psd))], freq)
        assert np.allclose([got[k][i][1] for i in range(len(psd))], psd, rtol=1e-9, atol=1e-9)
    assert max(got["sine"], key=lambda i: got["sine"][i][1]) == 2


def test_welch_skips_missing_readings_and_has_no_python(spark):
    df = long(spark, {"a": [1.0, None, 5.0, float("nan"), 2.0, 8.0]})
    want = welch_numpy(np.array([1.0, 5.0, 2.0, 8.0]), 256)[1]
    out = spectra.welch_psd(df)
    assert np.allclose([r["psd"] for r in out.orderBy("k").collect()], want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


# ---- unit root -------------------------------------------------------------------------
def adf_lstsq(x):
    """One series by plain least squares."""
    n = len(x)
    most = max(0, min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2))
    dx = np.diff(x)

    def fit(lag, start):
        y = dx[start:]
        z = np.column_stack([x[start:-1], np.ones(len(y)), *[dx[start - j:len(dx) - j] for j in range(1, lag + 1)]])
        beta = np.linalg.lstsq(z, y, rcond=None)[0]
        return y, z, beta, ((y - z @ beta) ** 2).sum()

    aic = []
    for lag in range(most + 1):
        y, z, _, rss = fit(lag, most)
        if len(y) > z.shape[1]:
            aic.append((len(y) * math.log(rss / len(y)) + 2 * z.shape[1], lag))
    lag = min(aic)[1]
    y, z, beta, rss = fit(lag, lag)
    return beta[0] / math.sqrt(rss / (len(y) - z.shape[1]) * np.linalg.inv(z.T @ z)[0, 0]), lag


def test_adf_equals_least_squares_per_series(spark):
    rng = np.random.default_rng(2)
    series = {f"walk{n}": rng.normal(size=n).cumsum() + 100 for n in (12, 30, 60, 97, 288)}
    series |= {f"noise{n}": rng.normal(5, 2, n) for n in (15, 60, 97, 200)}
    ar = np.zeros(150)
    for i in range(2, 150):
        ar[i] = 0.6 * ar[i - 1] - 0.3 * ar[i - 2] + rng.normal()
    series["ar"] = ar
    got = {r["sample_id"]: r for r in spectra.adf_test(long(spark, series)).collect()}
    for k, x in series.items():
        stat, lag = adf_lstsq(np.asarray(x, float))
        assert got[k]["used_lag"] == lag and math.isclose(got[k]["adf_stat"], stat, rel_tol=1e-8), k
        assert got[k]["nobs"] == len(x)
    assert got["noise200"]["p_value"] < 0.01 and got["walk288"]["p_value"] > 0.05


def test_adf_fixed_values():
    # published 1 %, 5 % and 10 % critical values of the statistic with a constant
    p = spectra.adf_p_value(np.array([-3.43035, -2.86154, -2.56677, -1.61, -20.0, 3.0, np.nan]))
    assert np.allclose(p[:3], [0.01, 0.05, 0.10], atol=0.0005)
    assert 0.45 < p[3] < 0.50 and p[4] == 0.0 and p[5] == 1.0 and np.isnan(p[6])
    assert all(np.diff(spectra.adf_p_value(np.linspace(-18, 2.7, 400))) >= -1e-9)


def test_adf_edge_cases(spark):
    series = {"short": [1, 2, 3], "flat": [7.0] * 40, "one": [1.0], "line": list(range(40)), "gaps": [1, None, 4, 2, float("nan"), 8, 3, 9, 1, 5, 6, 2]}
    got = {r["sample_id"]: r for r in spectra.adf_test(long(spark, series)).collect()}
    assert set(got) == set(series)
    for k in ("short", "flat", "one"):
        assert got[k]["adf_stat"] is None and got[k]["p_value"] is None
    present = np.array([v for v in series["gaps"] if v is not None and v == v], float)
    assert got["gaps"]["nobs"] == len(present) == 10
    assert math.isclose(got["gaps"]["adf_stat"], adf_lstsq(present)[0], rel_tol=1e-8)
    assert spectra.adf_test(long(spark, {})).count() == 0


# ---- Kolmogorov-Smirnov ------------------------------------------------------------------
def ks(spark, a, b, **kw):
    col = lambda x: spark.createDataFrame([(float(v),) for v in x], "value double")
    return stats.ks_two_sample(col(a), col(b), **kw).collect()


def exact_brute(a, b):
    """All ways to split the ranks of the merged samples (no ties)."""
    na, nb = len(a), len(b)

    def gap(first):
        i = j = worst = 0
        for r in range(na + nb):
            i, j = (i + 1, j) if r in first else (i, j + 1)
            worst = max(worst, abs(i * nb - j * na))
        return worst

    merged = sorted([(v, 0) for v in a] + [(v, 1) for v in b])
    own = gap({r for r, (_, t) in enumerate(merged) if t == 0})
    ways = [gap(set(c)) for c in itertools.combinations(range(na + nb), na)]
    return sum(w >= own for w in ways) / len(ways)


def test_ks_exact_small_samples(spark):
    assert math.isclose(ks(spark, [1, 2, 3], [4, 5, 6])[0]["p_value"], 0.1, rel_tol=1e-12)
    assert math.isclose(ks(spark, range(5), range(10, 15))[0]["p_value"], 2 / math.comb(10, 5), rel_tol=1e-12)
    rng = np.random.default_rng(4)
    for na, nb in ((1, 1), (1, 6), (4, 7), (6, 5)):
        a, b = rng.normal(size=na), rng.normal(0.5, 1, nb)
        r = ks(spark, a, b)[0]
        assert r["exact"] and math.isclose(r["p_value"], exact_brute(a, b), rel_tol=1e-9), (na, nb)
    # a small p-value keeps its digits
    assert math.isclose(ks(spark, range(20), range(100, 120))[0]["p_value"], 2 / math.comb(40, 20), rel_tol=1e-9)
    assert ks(spark, [1, 2], [1, 2])[0]["p_value"] == 1.0
    assert ks(spark, [1, 2], []) == []


def test_ks_asymptotic_beyond_the_bound(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=90), rng.normal(0.3, 1, 110)
    exact, far = ks(spark, a, b)[0], ks(spark, a, b, exact_up_to=9_899)[0]
    assert exact["exact"] and not far["exact"] and exact["ks_stat"] == far["ks_stat"]
    assert abs(exact["p_value"] - far["p_value"]) < 0.02


def test_quality_report_keys(spark):
    rng = np.random.default_rng(6)
    a = long(spark, {f"a{i}": rng.normal(size=60).cumsum() for i in range(12)})
    b = a.where("pos % 3 = 0")
    got = {r["measure"]: r for r in stats.sampling_quality(a, b, nlags=30, nperseg=16).collect()}
    assert {"mean", "var", "acf", "psd", "acf_0", "acf_19", "psd_0", "psd_8"} <= set(got)
    assert "acf_25" not in got  # lags beyond the shorter series have one side only
    assert got["acf"]["na"] == 12 * 31 and got["acf"]["nb"] == 12 * 20
    assert got["acf_0"]["ks_stat"] == 0.0 and got["acf_0"]["p_value"] == 1.0
    same = {r["measure"]: r["ks_stat"] for r in stats.sampling_quality(a, a, nlags=5, nperseg=16).collect()}
    assert set(same.values()) == {0.0}


# ---- order statistics ----------------------------------------------------------------------
def test_medians_with_a_hot_key(spark):
    rng = np.random.default_rng(8)
    rows = [("hot", float(x)) for x in np.exp(rng.normal(0, 50, 3001))]
    rows += [(f"k{i}", float(x)) for i in range(20) for x in rng.normal(size=i + 1).round(1)]
    rows += [(None, 1.0), (None, 4.0), ("none", None), ("none", float("nan")), ("far", -1e300), ("far", 1e-300), ("k0", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    want = {}
    for k, x in rows:
        if x is not None and x == x:
            want.setdefault(k, []).append(x)
    for buckets in (None, 40):  # the hot key in one range bucket, and in most of forty
        got = {r["k"]: r["median"] for r in selection.grouped_median(df, ["k"], "v", buckets=buckets).collect()}
        assert got == {k: float(np.median(x)) for k, x in want.items()}
    ends = {r["k"]: (r["lo"], r["hi"]) for r in selection.order_statistics(df, ["k"], "v", {"lo": F.lit(0), "hi": F.col("_n") - 1}).collect()}
    assert ends == {k: (min(x), max(x)) for k, x in want.items()}
    plan = selection.grouped_median(df, ["k"], "v")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan


# ---- autocorrelation ---------------------------------------------------------------------
def test_acf_with_gaps_and_offsets(spark):
    rng = np.random.default_rng(9)
    data = {"gaps": {int(p): float(v) for p, v in zip(rng.choice(200, 40, replace=False), rng.normal(size=40))},
            "late": {900: 1.0, 902: 4.0, 903: 2.0}, "one": {7: 3.0}, "flat": {0: 2.0, 5: 2.0}}
    df = spark.createDataFrame([(k, p, v) for k, x in data.items() for p, v in x.items()] + [("late", 901, None)], LONG).repartition(3)
    got = {(r["sample_id"], r["lag"]): r["acf"] for r in stats.acf(df, nlags=6).collect()}
    assert len(got) == 4 * 7
    for k, x in data.items():
        m = np.mean(list(x.values()))
        den = sum((v - m) ** 2 for v in x.values())
        for lag in range(7):
            num = sum((v - m) * (x[p + lag] - m) for p, v in x.items() if p + lag in x)
            assert got[k, lag] is None if den == 0 else math.isclose(got[k, lag], num / den, abs_tol=1e-12)


# ---- ranks ---------------------------------------------------------------------------------
@pytest.fixture
def no_jobs(spark):
    """Asserts that a block starts no job."""
    tracker = spark.sparkContext.statusTracker()

    class Watch:
        def __enter__(self):
            spark.sparkContext.setJobGroup("no-jobs", "")

        def __exit__(self, *_):
            assert tracker.getJobIdsForGroup("no-jobs") == []
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return Watch()


def test_ranks_are_planned_without_a_job(spark, no_jobs):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), F.xxhash64("id").alias("o"), "id")
    with no_jobs:
        ranked = ranking.rank_within(df, ["k"], ["o", "id"], out="r", num_partitions=16)
        summed = ranking.prefix_sum(df, ["k"], ["o", "id"], "id", "c", num_partitions=16)
        ranked._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, ranked.select("k", "o", "id", "r").collect()))
    want, seen = [], {}
    for k, o, i in sorted(tuple(r) for r in df.select("k", "o", "id").collect()):
        want.append((k, o, i, seen.get(k, 0)))
        seen[k] = seen.get(k, 0) + 1
    assert got == want
    total, sums = {}, []
    for k, o, i, _ in want:
        total[k] = total.get(k, 0) + i
        sums.append((k, o, i, total[k]))
    assert sorted(map(tuple, summed.select("k", "o", "id", "c").collect())) == sums


def test_buckets_are_even_and_do_not_depend_on_partitions(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("k"), F.xxhash64("id").alias("o"))
    seen = []
    for parts in (1, 9):
        d = df.repartition(parts)
        bounds = ranking.range_bounds(d, ["k", "o"], 32)
        b = ranking.with_bucket(d, ["k", "o"], bounds).groupBy("_b").count().collect()
        seen.append(sorted(tuple(r) for r in b))
    assert seen[0] == seen[1] and len(seen[0]) == 32
    assert max(n for _, n in seen[0]) < 2.5 * 20_000 / 32


@pytest.mark.parametrize("parts", [1, 3, 40, 4096])
def test_global_ranks_small_tables(spark, parts):
    for n in (0, 1, 5, 300):
        df = spark.range(n).select((-F.col("id")).alias("o"))
        got = sorted(map(tuple, ranking.global_rank(df, ["o"], num_partitions=parts).collect()))
        assert got == [(o, i) for i, o in enumerate(range(-n + 1, 1))]
