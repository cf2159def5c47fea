import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glucoframe.functions import glucose as G
from glucoframe.operators import masking as M
from glucoframe.operators import ranking, sampling as W
from tests.conftest import rows


def dense(spark, n_samples=2, length=288):
    data = [(f"s{s}", p, float(40 + (p * 7 + s * 13) % 250)) for s in range(n_samples) for p in range(length)]
    return spark.createDataFrame(data, "sample_id string, pos int, value double")


def test_sliding_windows_geometry(spark):
    out = W.sliding_windows(dense(spark, 1), window=96, n=10)
    wins = out.groupBy("win").agg(F.min("pos").alias("s"), F.count("*").alias("n")).orderBy("win").collect()
    assert [r.s for r in wins] == [21 * i for i in range(10)] and all(r.n == 96 for r in wins)


def test_interval_sample_one_per_part(spark):
    out = W.interval_sample(dense(spark, 2), n_parts=96, n_draws=10, seed=3)
    g = out.groupBy("sample_id", "draw").agg(F.count("*").alias("n"), F.countDistinct("part").alias("p")).collect()
    assert len(g) == 20 and all(r.n == 96 and r.p == 96 for r in g)


def test_stride_sample_uneven_sections(spark):
    out = W.stride_sample(dense(spark, 1, 86), window=3, length=86)
    g = out.groupBy("k").agg(F.count("*").alias("n")).orderBy("k").collect()
    assert [r.n for r in g] == [28, 28, 28]          # 86 -> 28 sections, 2 slots dropped
    assert out.count() == 84


@settings(max_examples=8, deadline=None)
@given(st.integers(min_value=1, max_value=40))
def test_stride_parts_rebuild_series(spark, q):
    length = 3 * q
    df = dense(spark, 1, length)
    out = W.stride_sample(df, window=3, length=length).select("sample_id", (F.col("section") * 3 + F.col("k")).alias("pos"), "value")
    assert rows(out) == rows(df)


def test_rank_within_skewed_key_is_exact_and_partition_independent(spark):
    # one hot key holds most rows; ranks must equal a plain row_number
    from pyspark.sql import Window
    data = [("hot" if i % 10 else f"k{i % 7}", i, (i * 37) % 101) for i in range(3000)]
    df = spark.createDataFrame(data, "k string, id int, v int")
    ref = df.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("v", "id")) - 1)
    for parts in (1, 7):
        got = ranking.rank_within(df, ["k"], ["v", "id"], out="r", num_partitions=parts)
        assert rows(got, "k", "id", "r") == rows(ref, "k", "id", "r")


def test_prefix_sum_matches_window(spark):
    from pyspark.sql import Window
    df = spark.createDataFrame([("a" if i % 3 else "b", i, i % 5) for i in range(500)], "k string, o int, x int")
    ref = df.withColumn("c", F.sum("x").over(Window.partitionBy("k").orderBy("o")))
    got = ranking.prefix_sum(df, ["k"], ["o"], "x", "c", num_partitions=5)
    assert rows(got, "k", "o", "c") == rows(ref, "k", "o", "c")


def test_stratified_split_counts(spark):
    df = spark.createDataFrame([(f"id{i}", "A" if i < 70 else "B") for i in range(100)], "id string, label string")
    out = W.stratified_split(df, "label", 0.2, "id")
    g = {r.label: r.n for r in out.filter("split = 'test'").groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert g == {"A": 14, "B": 6}


def test_assign_shards_cover_and_wrap(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "k int")
    out = W.assign_shards(df, "k", n_proc=2, batch=4)
    assert out.count() == 16                       # filled to a multiple of 2 x 4
    assert {r.k for r in out.collect()} == set(range(10))
    w0 = [r.k for r in out.filter("worker = 0").orderBy("local_pos").collect()]
    assert w0 == [0, 1, 2, 3, 8, 9, 0, 1]          # batch-wise round robin, head repeated
    dl = W.assign_shards(df, "k", n_proc=2, batch=4, drop_last=True)
    assert dl.count() == 8


def test_length_grouped_longest_first(spark):
    df = spark.createDataFrame([(f"s{i}", (i * 7) % 23) for i in range(64)], "sample_id string, len int")
    out = W.length_grouped_batches(df, "sample_id", "len", batch=4)
    first = out.orderBy("order").first()
    assert first.len == 22
    for m in out.select("mega_id").distinct().collect():
        lens = [r.len for r in out.filter(F.col("mega_id") == m.mega_id).orderBy("pos_in_mega").collect()]
        assert lens[1:] == sorted(lens[1:], reverse=True)


def _sk_tfidf(docs):
    """scikit-learn TfidfVectorizer defaults (smooth idf, l2 rows) in numpy, terms >= 2 chars."""
    vocab_ = sorted({t for d in docs for t in d if len(str(t)) >= 2})
    idx = {t: i for i, t in enumerate(vocab_)}
    tf = np.zeros((len(docs), len(vocab_)))
    for r, d in enumerate(docs):
        for t in d:
            if t in idx:
                tf[r, idx[t]] += 1
    n = len(docs)
    df = (tf > 0).sum(0)
    x = tf * (np.log((1 + n) / (1 + df)) + 1)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x.sum(0)
    return dict(zip(vocab_, s / s.max()))


def test_tfidf_matches_scikit_defaults(spark):
    docs = [[5, 120, 120, 44], [120, 61, 61, 7], [44, 44, 44, 230]]
    data = [(0, f"d{i}", t) for i, d in enumerate(docs) for t in d]
    toks = spark.createDataFrame(data, "scope int, sample_id string, token int")
    counts = toks.groupBy("scope", "sample_id", "token").agg(F.count("*").alias("tf"))
    got = {r.token: (r.tfidf, r.prob) for r in M.mask_prob_tfidf(counts).collect()}
    ref = _sk_tfidf(docs)
    for t, v in ref.items():
        assert math.isclose(got[t][0], v, rel_tol=1e-9)
        assert math.isclose(got[t][1], min(max(v, 0.45), 0.6))
    assert got[5] == (0.0, 0.45) and got[7] == (0.0, 0.45)   # Q6: one-character ids


def test_apply_mask_never_hits_specials(spark):
    data = [("s", i, t) for i, t in enumerate([G.CLS_ID, 10, G.PAD_ID, 20, G.MASK_ID, 30] * 50)]
    toks = spark.createDataFrame(data, "sample_id string, tpos int, token int").withColumn("prob", F.lit(1.0))
    out = M.apply_mask(toks).collect()
    for r in out:
        if r.tpos == 0 or r.token in (G.CLS_ID, G.PAD_ID, G.MASK_ID):
            assert r.label == -100 and r.input_id == r.token
        else:
            assert r.label == r.token
    replaced = sum(r.input_id == G.MASK_ID for r in out if r.label != -100)
    assert 0.6 < replaced / sum(r.label != -100 for r in out) < 0.95


def test_rows_with_a_null_class_stay(spark):
    from glucoframe.operators.ranking import rank_within
    from glucoframe.operators.sampling import stratified_split
    df = spark.createDataFrame([(i, None if i % 4 == 0 else "a") for i in range(20)], "k long, label string")
    out = stratified_split(df, "label", 0.4, "k").collect()
    assert len(out) == 20
    assert sum(r["split"] == "test" for r in out if r["label"] is None) == 2
    for n in (1, 4, 16):
        ranks = rank_within(df, ["label"], ["k"], num_partitions=n).collect()
        assert sorted(r["rank"] for r in ranks if r["label"] is None) == list(range(5)) and len(ranks) == 20


def test_cv_sets_from_boolean_columns(spark, tmp_path):
    seq = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0), ("d", 4.0)], "k string, x double")
    splits = spark.createDataFrame([("a", True, False), ("b", False, None), ("c", True, True), ("z", True, True)], "k string, CV_1 boolean, CV_2 boolean")
    out = W.cv_splits(seq, splits, "k")
    assert rows(out, "fold", "target", "k", "x") == [("CV_1", "test", "b", 2.0), ("CV_1", "train", "a", 1.0), ("CV_1", "train", "c", 3.0),
                                                     ("CV_2", "test", "a", 1.0), ("CV_2", "train", "c", 3.0)]
    path = str(tmp_path / "cv")
    W.save_cv_splits(out, path)
    assert rows(W.load_cv_split(spark, path, "CV_1", "train")) == [("a", 1.0), ("c", 3.0)]
    assert W.load_cv_split(spark, path, "CV_1", "train").columns == ["k", "x"]
    assert W.cv_splits(seq, splits, "k", ["CV_2"]).count() == 2
    folds = W.fold_columns(spark.createDataFrame([("a", 0), ("b", 1)], "k string, fold int"), "k", n_folds=2)
    assert rows(folds, "k", "CV_1", "CV_2") == [("a", False, True), ("b", True, False)]
