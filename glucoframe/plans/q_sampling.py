"""Registered queries: re-sampling, splits, batching, sharding (W) and masking plans (M)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from glucoframe.functions.hashing import u_sql
from glucoframe.operators import masking as M
from glucoframe.operators import sampling as W
from glucoframe.operators import shape, stats, vocab
from glucoframe.plans.q_encode import tok_sql
from glucoframe.plans.q_stats import ks_sql, welch_sql
from glucoframe.plans.registry import query
from glucoframe.session import ensure_checkpoint_dir
from glucoframe.sources import bindings as B


def _labelled_readings(spark, sf_dir):
    rd = B.readings(spark, sf_dir)
    return rd.join(B.persons(spark, sf_dir).select("person", "types", "fold"), "person")


# ---- W1-W4 -------------------------------------------------------------------------------
@query("sliding_windows", """
    SELECT r.sample_id, CAST(w.range AS INTEGER) AS win, CAST(r.pos - w.range * 21 AS INTEGER) AS "offset",
           r.value, p.types
    FROM readings r JOIN persons p ON r.person = p.person, range(10) w
    WHERE r.pos >= w.range * 21 AND r.pos < w.range * 21 + 96""",
       views=("readings", "persons"), round_cols=["value"])
def q_sliding_windows(spark, sf_dir):
    """W1 + W4: ten 96-slot windows, step 21; the class label is carried to every window."""
    out = W.sliding_windows(_labelled_readings(spark, sf_dir), window=96, n=10)
    return out.select("sample_id", "win", "offset", "value", "types")


@query("interval_sample", f"""
    SELECT sample_id, CAST(d.range AS INTEGER) AS draw, CAST(pos // 3 AS INTEGER) AS part, value
    FROM readings, range(10) d
    WHERE pos = (pos // 3) * 3 + CAST(floor({u_sql(17, 'sample_id', 'd.range', 'pos // 3')} * 3) AS INTEGER)""",
       views=("readings",), round_cols=["value"])
def q_interval_sample(spark, sf_dir):
    """Ten draws, one reading from each of 96 equal parts (hash-uniform choice)."""
    out = W.interval_sample(B.readings(spark, sf_dir), n_parts=96, n_draws=10, seed=17)
    return out.select("sample_id", F.col("draw").cast("int"), "part", "value")


@query("stride_sample", """
    SELECT sample_id, CAST(pos % 3 AS INTEGER) AS k, CAST(pos // 3 AS INTEGER) AS section, value FROM readings""",
       views=("readings",), round_cols=["value"])
def q_stride_sample(spark, sf_dir):
    """Three low-rate series per day (offset k of each 3-slot section)."""
    out = W.stride_sample(B.readings(spark, sf_dir), window=3)
    return out.select("sample_id", "k", "section", "value")


_QUALITY_SQL = f"""
    WITH x AS (SELECT src || sample_id AS series, src = 'a' AS ta, pos, value FROM (
               SELECT 'a' AS src, * FROM month_series UNION ALL SELECT 'b', * FROM month_series WHERE pos % 2 = 0)),
    s AS (SELECT series, ta, row_number() OVER (PARTITION BY series ORDER BY pos) - 1 AS t,
                 count(*) OVER (PARTITION BY series) AS n, value, value - avg(value) OVER (PARTITION BY series) AS x FROM x),
    moments AS (SELECT series, ta, avg(value) AS mean, var_pop(value) AS var, sum(x * x) AS den FROM s GROUP BY ALL),
    lags AS (SELECT a.series, b.t - a.t AS lag, sum(a.x * b.x) AS num FROM s a JOIN s b
             ON a.series = b.series AND b.t - a.t BETWEEN 0 AND 50 GROUP BY ALL),{welch_sql("s", 32, "series, ta")},
    m AS (SELECT 'mean' AS measure, ta, mean AS v FROM moments UNION ALL SELECT 'var', ta, var FROM moments
          UNION ALL SELECT unnest(['acf', 'acf_' || lag]), ta, num / den FROM lags JOIN moments USING (series) WHERE den <> 0
          UNION ALL SELECT unnest(['psd', 'psd_' || k]), ta, psd FROM psd),
    v AS (SELECT measure, ta, round(v * 1e6) / 1e6 AS v FROM m),""" + ks_sql("v", "measure")


@query("sampling_quality", _QUALITY_SQL, views=("month_series",), round_cols=["ks_stat", "p_value"])
def q_sampling_quality(spark, sf_dir):
    """Means, variances, 51 autocorrelations and 17 spectrum bins, each and pooled, of the
    persons' months against the same months with every other block left out."""
    a = B.month_series(spark, sf_dir)
    return stats.sampling_quality(a, a.where("pos % 2 = 0"), nperseg=32, digits=6)


# ---- W5-W12 --------------------------------------------------------------------------------
@query("subset_n", f"""
    SELECT sample_id, p_id FROM sample_labels ORDER BY {u_sql(42, 'sample_id')}, sample_id LIMIT 250""",
       views=("sample_labels",))
def q_subset_n(spark, sf_dir):
    """250 samples of a seeded shuffle (a sampling operator: the limit is the feature)."""
    return W.subset_n(B.sample_labels(spark, sf_dir), 250, "sample_id", seed=42).select("sample_id", "p_id")


@query("stratified_split", f"""
    SELECT sample_id, types,
           CASE WHEN row_number() OVER (PARTITION BY types ORDER BY {u_sql(42, 'sample_id')}, sample_id) - 1
                     < floor(count(*) OVER (PARTITION BY types) * 0.2) THEN 'test' ELSE 'train' END AS split
    FROM sample_labels""", views=("sample_labels",))
def q_stratified_split(spark, sf_dir):
    """Class-proportional 20 % test split with exact, skew-safe ranks per class."""
    lab = B.sample_labels(spark, sf_dir).select("sample_id", "types")
    return W.stratified_split(lab, "types", 0.2, "sample_id", seed=42)


@query("random_split", f"""
    SELECT sample_id, CASE WHEN {u_sql(42, 'sample_id')} < 0.2 THEN 'valid' ELSE 'train' END AS split
    FROM sample_labels""", views=("sample_labels",))
def q_random_split(spark, sf_dir):
    """Stateless 20 % validation split."""
    return W.random_split(B.sample_labels(spark, sf_dir).select("sample_id"), 0.2, "sample_id")


@query("shuffle", "SELECT sample_id, types FROM sample_labels", views=("sample_labels",))
def q_shuffle(spark, sf_dir):
    """Seeded reorder of the samples (range partitions of the hash); the row multiset is
    unchanged, which is what the order-insensitive oracle checks."""
    return W.shuffle(B.sample_labels(spark, sf_dir).select("sample_id", "types"), "sample_id", seed=51)


_CV_SQL = """
    SELECT sample_id, types, 'CV_' || CAST(k.range + 1 AS VARCHAR) AS fold,
           CASE WHEN l.fold <> k.range THEN 'train' ELSE 'test' END AS target FROM sample_labels l, range(5) k"""


def _cv(spark, sf_dir):
    lab = B.sample_labels(spark, sf_dir)
    return W.cv_splits(lab.select("sample_id", "types"), W.fold_columns(lab, "sample_id"), "sample_id")


@query("cv_splits", _CV_SQL, views=("sample_labels",))
def q_cv_splits(spark, sf_dir):
    """Five (train, test) sets from boolean fold columns, one row per fold and sample."""
    return _cv(spark, sf_dir)


@query("cv_saved_sets", f"SELECT fold, target, count(*) AS n, min(sample_id) AS least FROM ({_CV_SQL}) GROUP BY 1, 2",
       views=("sample_labels",))
def q_cv_saved_sets(spark, sf_dir):
    """The ten saved sets, each read back from its own folder."""
    path = f"{ensure_checkpoint_dir(spark)}/cv/{uuid.uuid4().hex}"
    W.save_cv_splits(_cv(spark, sf_dir), path)
    out = None
    for fold in (f"CV_{k}" for k in range(1, 6)):
        for target in ("train", "test"):
            one = W.load_cv_split(spark, path, fold, target).agg(F.count("*").alias("n"), F.min("sample_id").alias("least"))
            one = one.where("n > 0").select(F.lit(fold).alias("fold"), F.lit(target).alias("target"), "n", "least")
            out = one if out is None else out.unionByName(one)
    return out


@query("label_ids", """
    SELECT sample_id, types, CAST(dense_rank() OVER (ORDER BY types) - 1 AS INTEGER) AS label_id
    FROM sample_labels""", views=("sample_labels",))
def q_label_ids(spark, sf_dir):
    """Class name -> id = dense rank of the sorted names over train and test (Q3)."""
    lab = B.sample_labels(spark, sf_dir).select("sample_id", "types", "fold")
    ids = vocab.label_ids(lab.filter("fold <> 0"), lab.filter("fold = 0"), "types")
    return vocab.apply_label_ids(lab, ids, "types").select("sample_id", "types", "label_id")


@query("keep_trained_labels", """
    WITH l AS (SELECT sample_id, fold, 'L' || CAST(p_id % 17 AS VARCHAR) AS label FROM sample_labels
               WHERE hba1c IS NOT NULL)
    SELECT sample_id, label FROM l WHERE fold = 0 AND label IN (SELECT label FROM l WHERE fold <> 0)""",
       views=("sample_labels",))
def q_keep_trained_labels(spark, sf_dir):
    """Test rows whose label occurs in training (left semi join on distinct labels)."""
    lab = shape.drop_missing_target(B.sample_labels(spark, sf_dir), "hba1c")
    lab = lab.select("sample_id", "fold",
                     F.concat(F.lit("L"), (F.col("p_id") % 17).cast("string")).alias("label"))
    out = vocab.keep_trained_labels(lab.filter("fold = 0"), lab.filter("fold <> 0"), "label")
    return out.select("sample_id", "label")


@query("pack_labels", """
    SELECT doc_id, CAST(quality AS VARCHAR) || ',' || CAST(toxic AS VARCHAR) AS flags FROM labels""")
def q_pack_labels(spark, sf_dir):
    """Several flag columns -> one label vector."""
    lab = B.table(spark, sf_dir, "labels")
    return lab.select("doc_id", F.array_join(vocab.pack_labels(["quality", "toxic"]), ",").alias("flags"))


# ---- W13 / W14 ------------------------------------------------------------------------------
@query("length_grouped_batches", f"""
    WITH s AS (SELECT sample_id, count(*) AS len FROM readings GROUP BY 1),
    m AS (SELECT greatest(least(count(*) // 32, 50), 1) * 8 AS msize FROM s),
    p AS (SELECT sample_id, len, row_number() OVER (ORDER BY {u_sql(42, 'sample_id')}, sample_id) - 1 AS perm FROM s),
    g AS (SELECT p.*, perm // msize AS mega_id, msize FROM p, m),
    r AS (SELECT *, row_number() OVER (PARTITION BY mega_id ORDER BY len DESC, perm) - 1 AS pos_in_mega FROM g),
    heads AS (SELECT mega_id, sample_id, len FROM r WHERE pos_in_mega = 0),
    best AS (SELECT mega_id AS max_mega FROM heads ORDER BY len DESC, mega_id LIMIT 1),
    k0 AS (SELECT sample_id AS k0 FROM heads WHERE mega_id = 0),
    f AS (SELECT r.sample_id, r.pos_in_mega, r.msize,
                 CASE WHEN r.sample_id = k0 AND pos_in_mega = 0 THEN max_mega
                      WHEN mega_id = max_mega AND pos_in_mega = 0 THEN 0 ELSE mega_id END AS mega_id
          FROM r, best, k0)
    SELECT sample_id, CAST(mega_id AS BIGINT) AS mega_id, CAST(pos_in_mega AS BIGINT) AS pos_in_mega,
           CAST(mega_id * msize + pos_in_mega AS BIGINT) AS "order" FROM f""", views=("readings",))
def q_length_grouped_batches(spark, sf_dir):
    """Length-grouped batch order (batch 8), longest sample first."""
    s = B.readings(spark, sf_dir).groupBy("sample_id").agg(F.count("*").alias("len"))
    out = W.length_grouped_batches(s, "sample_id", "len", batch=8, seed=42)
    return out.select("sample_id", "mega_id", "pos_in_mega", "order")


def _shard_sql(contiguous: bool) -> str:
    if contiguous:
        tot = "CAST(ceil(count(*) / 24.0) * 8 AS BIGINT) * 3"
        worker = "CAST((r + m * n) // per AS INTEGER)"
        local = "(r + m * n) % per"
        per = "CAST(ceil(count(*) / 24.0) * 8 AS BIGINT)"
    else:
        tot = "CAST(ceil(count(*) / 24.0) * 24 AS BIGINT)"
        worker = "CAST(((r + m * n) // 8) % 3 AS INTEGER)"
        local = "((r + m * n) // 24) * 8 + (r + m * n) % 8"
        per = "0"
    return f"""
    WITH r AS (SELECT sample_id, row_number() OVER (ORDER BY {u_sql(9, 'sample_id')}, sample_id) - 1 AS r
               FROM sample_labels),
    n AS (SELECT count(*) AS n, {tot} AS total, {per} AS per FROM r),
    c AS (SELECT range AS m FROM range(0, 64))
    SELECT sample_id, CAST(r + m * n AS BIGINT) AS j, {worker} AS worker, CAST({local} AS BIGINT) AS local_pos
    FROM r, n, c WHERE r + m * n < total"""


@query("assign_shards", _shard_sql(False), views=("sample_labels",))
def q_assign_shards(spark, sf_dir):
    """Batch-wise round-robin over 3 workers, batch 8, head rows repeated to fill."""
    s = B.sample_labels(spark, sf_dir).select("sample_id")
    return W.assign_shards(s, "sample_id", n_proc=3, batch=8, seed=9)


@query("assign_shards_contiguous", _shard_sql(True), views=("sample_labels",))
def q_assign_shards_contiguous(spark, sf_dir):
    """W14 (contiguous variant): one block of ceil(n / 24) * 8 positions per worker."""
    s = B.sample_labels(spark, sf_dir).select("sample_id")
    return W.assign_shards(s, "sample_id", n_proc=3, batch=8, seed=9, contiguous=True)


# ---- M1-M4 ----------------------------------------------------------------------------------
_COUNTS_SQL = f"""
    base AS (SELECT p.fold AS scope, r.sample_id, r.pos, {tok_sql('r.value')} AS token
             FROM readings r JOIN persons p ON r.person = p.person),
    tf AS (SELECT scope, sample_id, token, count(*) AS tf FROM base GROUP BY ALL),
    ns AS (SELECT scope, sample_id, count(*) AS n FROM base GROUP BY ALL),
    counts AS (SELECT * FROM tf UNION ALL SELECT scope, sample_id, 264, 288 - n FROM ns WHERE n < 288
               UNION ALL SELECT scope, sample_id, 265, 1 FROM ns)"""

_TFIDF_SQL = f"""
    {_COUNTS_SQL},
    term AS (SELECT * FROM counts WHERE length(CAST(token AS VARCHAR)) >= 2),
    n AS (SELECT scope, count(DISTINCT sample_id) AS n FROM term GROUP BY scope),
    dfq AS (SELECT scope, token, count(*) AS df FROM term GROUP BY ALL),
    idf AS (SELECT d.scope, token, ln((1.0 + CAST(n AS DOUBLE)) / (1.0 + CAST(df AS DOUBLE))) + 1.0 AS idf
            FROM dfq d JOIN n ON d.scope = n.scope),
    w AS (SELECT t.scope, sample_id, t.token, tf * idf AS w FROM term t JOIN idf i ON t.scope = i.scope AND t.token = i.token),
    nm AS (SELECT scope, sample_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL),
    col AS (SELECT w.scope, token, sum(w / norm) AS s FROM w JOIN nm ON w.scope = nm.scope AND w.sample_id = nm.sample_id
            GROUP BY ALL),
    top AS (SELECT scope, max(s) AS mx FROM col GROUP BY scope),
    res AS (SELECT c.scope, token, s / mx AS tfidf FROM col c JOIN top t ON c.scope = t.scope),
    allt AS (SELECT DISTINCT scope, token FROM counts),
    probs AS (SELECT a.scope, a.token, coalesce(tfidf, 0.0) AS tfidf,
                     least(greatest(coalesce(tfidf, 0.0), 0.45), 0.6) AS prob
              FROM allt a LEFT JOIN res r ON a.scope = r.scope AND a.token = r.token)"""


def _counts(spark, sf_dir):
    return M.token_counts(_labelled_readings(spark, sf_dir), scope="fold")


@query("mask_prob_tfidf", f"WITH {_TFIDF_SQL} SELECT * FROM probs", views=("readings", "persons"),
       round_cols=["tfidf", "prob"])
def q_mask_prob_tfidf(spark, sf_dir):
    """M1: tf-idf masking probabilities per token, fitted per fold (scikit-learn defaults, Q6)."""
    return M.mask_prob_tfidf(_counts(spark, sf_dir))


@query("mask_prob_frequency", f"""
    WITH {_COUNTS_SQL},
    b AS (SELECT scope, CASE WHEN token <= 31 THEN 0 WHEN token < 141 THEN 1 ELSE 2 END AS band, sum(tf) AS c
          FROM counts GROUP BY ALL),
    t AS (SELECT scope, sum(c) AS t FROM b GROUP BY scope)
    SELECT b.scope, band, c / t AS share, least(greatest(1.0 - c / t, 0.3), 0.6) AS prob
    FROM b JOIN t ON b.scope = t.scope""", views=("readings", "persons"), round_cols=["share", "prob"])
def q_mask_prob_frequency(spark, sf_dir):
    """M2: 1 - share of the token's band, clipped to 0.30..0.60, per fold."""
    return M.mask_prob_frequency(_counts(spark, sf_dir))


def _tokens(spark, sf_dir):
    rd = _labelled_readings(spark, sf_dir)
    from glucoframe.functions.glucose import encode_value
    return rd.select(F.col("fold").alias("scope"), "sample_id",
                     (F.col("pos") + 1).cast("int").alias("tpos"), encode_value("value").alias("token"))


@query("mask_prob_uniform", f"""
    SELECT sample_id, CAST(pos + 1 AS INTEGER) AS tpos, {tok_sql('value')} AS token,
           0.45 + 0.15 * {u_sql(3, 'sample_id', 'CAST(pos + 1 AS INTEGER)')} AS prob
    FROM readings""", views=("readings",), round_cols=["prob"])
def q_mask_prob_uniform(spark, sf_dir):
    """M3: random probability in 0.45..0.60 per reading position."""
    t = _tokens(spark, sf_dir).drop("scope")
    return M.mask_prob_uniform(t, random=True, seed=3)


@query("apply_mask", f"""
    WITH {_TFIDF_SQL},
    t AS (SELECT p.fold AS scope, r.sample_id, CAST(r.pos + 1 AS INTEGER) AS tpos, {tok_sql('r.value')} AS token
          FROM readings r JOIN persons p ON r.person = p.person),
    tp AS (SELECT t.*, pr.prob FROM t JOIN probs pr ON t.scope = pr.scope AND t.token = pr.token),
    d AS (SELECT *, {u_sql(7, 'sample_id', 'tpos', "'draw'")} < prob AS drawn,
                 {u_sql(7, 'sample_id', 'tpos', "'mask'")} < 0.8 AS rep,
                 {u_sql(7, 'sample_id', 'tpos', "'rand'")} < 0.5 AS rnd,
                 CAST(floor({u_sql(7, 'sample_id', 'tpos', "'id'")} * 266) AS INTEGER) AS rid FROM tp)
    SELECT g.sample_id,
           string_agg(CAST(CASE WHEN g.tpos = 0 THEN 265 WHEN d.token IS NULL THEN 264 WHEN NOT drawn THEN token
                                WHEN rep THEN 263 WHEN rnd THEN rid ELSE token END AS VARCHAR), ',' ORDER BY g.tpos) AS input_ids,
           string_agg(CAST(CASE WHEN drawn THEN token ELSE -100 END AS VARCHAR), ',' ORDER BY g.tpos) AS labels
    FROM (SELECT sample_id, unnest(range(289)) AS tpos FROM (SELECT DISTINCT sample_id FROM t) s) g
    LEFT JOIN d ON d.sample_id = g.sample_id AND d.tpos = g.tpos
    GROUP BY g.sample_id""", views=("readings", "persons"))
def q_apply_mask(spark, sf_dir):
    """M4: draw positions with the tf-idf plan; 80 % <mask>, 10 % random id, 10 % kept.

    One training row per sample: input ids and labels of all 289 positions.
    """
    t = M.attach_probs(_tokens(spark, sf_dir), M.mask_prob_tfidf(_counts(spark, sf_dir)))
    m = M.masked_rows(M.apply_mask(t, seed=7))
    return m.select("sample_id", F.array_join("input_ids", ",").alias("input_ids"),
                    F.array_join("labels", ",").alias("labels"))
