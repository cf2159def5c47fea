"""Registered queries: vectors, clusters, cross tables (A20-A24, A31) and model work."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from glucoframe.functions.hashing import u, u_sql
from glucoframe.operators import models as X
from glucoframe.operators import shape
from glucoframe.operators import vectors as V
from glucoframe.plans.registry import query
from glucoframe.sources import bindings as B

CLUSTERS = [f"C{i}" for i in range(10)] + ["Cx"]   # Cx: listed but absent, kept with zeros
LABELS = [f"L{i}" for i in range(10)]


def _token_vecs(spark, sf_dir):
    return B.token_vectors(B.readings(spark, sf_dir), parts=B.sample_parts(spark, sf_dir))


_TV_SQL = f"""tv AS (SELECT sample_id, tpos, d AS dim, {u_sql(13, 'sample_id', 'tpos', 'd')} AS x
                FROM (SELECT sample_id, tpos FROM weights WHERE layer = 0 AND head = 0) p,
                     (SELECT CAST(range AS INTEGER) AS d FROM range(4)) ds)"""


@query("sample_mean_pool", f"WITH {_TV_SQL} SELECT sample_id, dim, avg(x) AS m FROM tv GROUP BY 1, 2",
       views=("weights",), round_cols=["m"])
def q_sample_mean_pool(spark, sf_dir):
    """Mean of the token vectors of each sample (non-pad positions, <cls> included)."""
    v = V.sample_mean_pool(_token_vecs(spark, sf_dir), style="mean")
    return v.select("sample_id", F.posexplode("vec").alias("dim", "m"))


@query("sample_cls_pool", f"WITH {_TV_SQL} SELECT sample_id, dim, x AS m FROM tv WHERE tpos = 0",
       views=("weights",), round_cols=["m"])
def q_sample_cls_pool(spark, sf_dir):
    """A20 (cls style, Q16): the vector at the <cls> position."""
    v = V.sample_mean_pool(_token_vecs(spark, sf_dir), style="cls")
    return v.select("sample_id", F.posexplode("vec").alias("dim", "m"))


@query("sample_two_layer_pool", f"""WITH {_TV_SQL},
    tw AS (SELECT sample_id, tpos, d AS dim, {u_sql(14, 'sample_id', 'tpos', 'd')} AS x
           FROM (SELECT sample_id, tpos FROM weights WHERE layer = 0 AND head = 0) p,
                (SELECT CAST(range AS INTEGER) AS d FROM range(4)) ds)
    SELECT sample_id, dim, avg(x) AS m FROM tv WHERE tpos > 0 GROUP BY 1, 2
    UNION ALL SELECT sample_id, CAST(dim + 4 AS INTEGER), avg(x) FROM tw WHERE tpos > 0 GROUP BY 1, 2""",
       views=("weights",), round_cols=["m"])
def q_sample_two_layer_pool(spark, sf_dir):
    """A20 (two layers): mean token vectors of two layers without <cls>, one after the other."""
    rd, parts = B.readings(spark, sf_dir), B.sample_parts(spark, sf_dir)
    v = V.two_layer_pool(B.token_vectors(rd, parts=parts), B.token_vectors(rd, seed=14, parts=parts), exclude_cls=True)
    return v.select("sample_id", F.posexplode("vec").alias("dim", "m"))


def _split(spark, sf_dir):
    v = B.vectors(spark, sf_dir)
    return v.filter(~F.col("is_ref")), v.filter("is_ref")


_SIM_SQL = """
    pairs AS (SELECT t.vec_id, r.cluster, list_cosine_similarity(t.vec, r.vec) AS cs
              FROM vectors t JOIN vectors r ON NOT t.is_ref AND r.is_ref),
    sims AS (SELECT vec_id, cluster, avg(cs) AS sim FROM pairs GROUP BY 1, 2)"""


@query("cluster_similarity", f"WITH {_SIM_SQL} SELECT * FROM sims", views=("vectors",), round_cols=["sim"])
def q_cluster_similarity(spark, sf_dir):
    """Mean cosine of every target to every reference cluster (oracle: brute-force pairs)."""
    t, r = _split(spark, sf_dir)
    return V.cluster_similarity(t, r)


_ASSIGN_SQL = f"""{_SIM_SQL},
    best AS (SELECT vec_id, cluster, sim FROM (
               SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 9) DESC, cluster) AS rn
               FROM sims) q WHERE rn = 1)"""


@query("assign_cluster", f"WITH {_ASSIGN_SQL} SELECT * FROM best", views=("vectors",), round_cols=["sim"])
def q_assign_cluster(spark, sf_dir):
    """Best cluster per target (ties -> smallest name)."""
    t, r = _split(spark, sf_dir)
    return V.assign_cluster(t, r)


def _crosstab_sql() -> str:
    cols = ", ".join(f"CAST(count(b.vec_id) FILTER (WHERE 'L' || CAST(v.label AS VARCHAR) = '{lab}') AS BIGINT) AS {lab}"
                     for lab in LABELS)
    rows = " UNION ALL ".join(f"SELECT '{c}' AS cluster" for c in CLUSTERS)
    return f"""WITH {_ASSIGN_SQL}, rowsq AS ({rows})
    SELECT q.cluster, {cols}
    FROM rowsq q LEFT JOIN best b ON b.cluster = q.cluster LEFT JOIN vectors v ON v.vec_id = b.vec_id
    GROUP BY q.cluster"""


@query("crosstab", _crosstab_sql(), views=("vectors",))
def q_crosstab(spark, sf_dir):
    """Assigned cluster x true label count grid, given row order, zeros kept."""
    t, r = _split(spark, sf_dir)
    a = V.assign_cluster(t, r).join(t.select("vec_id", "label"), "vec_id")
    a = a.withColumn("true_label", F.concat(F.lit("L"), F.col("label").cast("string")))
    return V.crosstab(a, "cluster", "true_label", CLUSTERS, LABELS)


@query("mutual_information", f"""WITH {_ASSIGN_SQL},
    j AS (SELECT b.cluster AS a, 'L' || CAST(v.label AS VARCHAR) AS b FROM best b JOIN vectors v ON v.vec_id = b.vec_id),
    cells AS (SELECT a, b, count(*) AS nij FROM j GROUP BY 1, 2),
    ra AS (SELECT a, sum(nij) AS ai FROM cells GROUP BY a),
    rb AS (SELECT b, sum(nij) AS bj FROM cells GROUP BY b),
    n AS (SELECT sum(nij) AS n FROM cells),
    mi AS (SELECT sum((nij / n) * ln(n * nij / (ai * bj))) AS mi
           FROM cells JOIN ra ON cells.a = ra.a JOIN rb ON cells.b = rb.b, n),
    ha AS (SELECT sum(-(ai / n) * ln(ai / n)) AS h_a FROM ra, n),
    hb AS (SELECT sum(-(bj / n) * ln(bj / n)) AS h_b FROM rb, n)
    SELECT mi, h_a, h_b, mi / ((h_a + h_b) / 2.0) AS nmi FROM mi, ha, hb""",
       views=("vectors",), round_cols=["mi", "h_a", "h_b", "nmi"])
def q_mutual_information(spark, sf_dir):
    """Mutual information and normalised MI of assigned cluster versus true label."""
    t, r = _split(spark, sf_dir)
    a = V.assign_cluster(t, r).join(t.select("vec_id", "label"), "vec_id")
    a = a.withColumn("true_label", F.concat(F.lit("L"), F.col("label").cast("string")))
    return V.mutual_information(a, "cluster", "true_label")


@query("merge_to_sample_level", """
    SELECT person, CAST(d - 1 AS INTEGER) AS dim, avg(vec[d]) AS m
    FROM vectors, range(1, 65) AS r(d) GROUP BY 1, 2""", views=("vectors",), round_cols=["m"])
def q_merge_to_sample_level(spark, sf_dir):
    """Day vectors -> one mean vector per person."""
    v = V.merge_to_sample_level(B.vectors(spark, sf_dir))
    return v.select("person", F.posexplode("vec").alias("dim", "m"))


# ---- X1 / X2 ----------------------------------------------------------------------------------
# fixed scorer weights (a rule, not data): w_d = ((d * 7) % 13 - 6) / 30
LINEAR_W = [((d * 7) % 13 - 6) / 30.0 for d in range(64)]


def _linear_factory():
    w = np.array(LINEAR_W)

    def model(pdf: pd.DataFrame) -> pd.DataFrame:
        x = X.stack_vectors(pdf["vec"])
        z = x @ w if len(x) else np.zeros(0)
        return pd.DataFrame({"score": 1.0 / (1.0 + np.exp(-z))})
    return model


def _vec_sql(ws) -> str:
    return "[" + ", ".join(repr(float(x)) for x in ws) + "]::DOUBLE[]"


@query("batch_score", f"""
    SELECT vec_id, 1.0 / (1.0 + exp(-list_inner_product(vec, {_vec_sql(LINEAR_W)}))) AS score FROM vectors""",
       views=("vectors",), round_cols=["score"])
def q_batch_score(spark, sf_dir):
    """A user model (here a linear scorer) applied in Arrow batches, id kept beside the score."""
    v = B.vectors(spark, sf_dir).select("vec_id", "vec")
    return X.batch_score(v, _linear_factory, "vec_id long, score double", "linear-64", keep=["vec_id"])


def mlp_weights(dims=(64, 16, 8, 1)):
    """Fixed MLP weights from a rule (layer l, input i, output j)."""
    layers = []
    for l_, (a, b) in enumerate(zip(dims[:-1], dims[1:])):
        w = np.array([[(((i * 7 + j * 13 + l_ * 5) % 17) - 8) / 40.0 for j in range(b)] for i in range(a)])
        bias = np.array([((j + l_) % 3 - 1) / 10.0 for j in range(b)])
        layers.append((w, bias))
    return layers


#: weight and bias of each decoded target
MLP_DECODER = ((1.5, -0.5), (-2.0, 1.0), (0.25, 0.0))


def _mlp_sql() -> str:
    layers = mlp_weights()
    h = "vec"
    exprs = []
    for li, (w, b) in enumerate(layers):
        units = []
        for j in range(w.shape[1]):
            z = f"(list_inner_product({h}, {_vec_sql(w[:, j])}) + {float(b[j])!r})"
            units.append(z if li == len(layers) - 1 else f"1.0 / (1.0 + exp(-({z})))")
        exprs.append(units)
        h = f"h{li}"
    sel = []
    ctes = []
    src = "vectors"
    cols = "vec_id, vec"
    for li, units in enumerate(exprs[:-1]):
        ctes.append(f"l{li} AS (SELECT vec_id, [{', '.join(units)}] AS h{li} FROM {src})")
        src = f"l{li}"
    final = exprs[-1][0]
    targets = ", ".join(f"1.0 / (1.0 + exp(-({w} * score + {b}))) AS t{i}" for i, (w, b) in enumerate(MLP_DECODER))
    return ("WITH " + ", ".join(ctes) + f", scored AS (SELECT vec_id, 1.0 / (1.0 + exp(-({final}))) AS score FROM {src})"
            f" SELECT vec_id, score, {targets} FROM scored")


@query("severity_score", _mlp_sql(), views=("vectors",), round_cols=["score", "t0", "t1", "t2"])
def q_severity_score(spark, sf_dir):
    """64-16-8-1 network, sigmoid after every layer, with broadcast weights in a pandas UDF."""
    v = B.vectors(spark, sf_dir).select("vec_id", "vec")
    return X.severity_score(v, mlp_weights(), decoder=MLP_DECODER).select("vec_id", "score", "t0", "t1", "t2")


# ---- X3-X7: predictions, and the statements that certify the fits --------------------------------------
def _flags(d):
    return d.withColumn("odd", (F.col("label") % 2 == 1).cast("int")).withColumn("high", (F.col("label") >= 5).cast("int"))


@query("fit_classifier")
def q_fit_classifier(spark, sf_dir):
    """Logistic regression on reference vectors, predictions for the targets."""
    t, r = _split(spark, sf_dir)
    _, pred = X.fit_classifier(r, t, "label")
    return pred.select("vec_id", F.col("label").cast("int").alias("label"),
                       F.col("prediction").cast("int").alias("prediction"))


@query("fit_classifier_gradient", """
    SELECT label AS name, CAST(dim AS INTEGER) AS dim, CAST(0.0 AS DOUBLE) AS gradient
    FROM (SELECT DISTINCT label FROM vectors WHERE is_ref AND label IS NOT NULL), range(65) AS r(dim)""", views=("vectors",))
def q_fit_classifier_gradient(spark, sf_dir):
    """At the fitted weights the gradient of the penalised loss is zero in every class and dimension."""
    _, r = _split(spark, sf_dir)
    head, _ = X.fit_classifier(r, r, "label")
    return X.classifier_gradient(r, head, "label")


@query("fit_regressor")
def q_fit_regressor(spark, sf_dir):
    """Linear regression of the label value on the vectors."""
    t, r = _split(spark, sf_dir)
    _, pred = X.fit_regressor(r, t, "label")
    return pred.select("vec_id", F.col("label").cast("double").alias("y"), F.col("prediction").alias("p"))


@query("fit_regressor_gradient", """
    SELECT 'label' AS name, CAST(dim AS INTEGER) AS dim, CAST(0.0 AS DOUBLE) AS gradient
    FROM range(65) AS r(dim) WHERE EXISTS (FROM vectors WHERE is_ref)""", views=("vectors",))
def q_fit_regressor_gradient(spark, sf_dir):
    """The residuals are orthogonal to every dimension of the inputs and to the constant."""
    _, r = _split(spark, sf_dir)
    head, _ = X.fit_regressor(r, r, "label")
    return X.regressor_gradient(r, head)


@query("fit_multilabel")
def q_fit_multilabel(spark, sf_dir):
    """Two independent sigmoid heads (label odd, label >= 5), fitted in the same passes."""
    t, r = _split(spark, sf_dir)
    return X.fit_multilabel(_flags(r), _flags(t), ["odd", "high"], "vec_id")[1]


@query("fit_multilabel_gradient", """
    SELECT name, CAST(dim AS INTEGER) AS dim, CAST(0.0 AS DOUBLE) AS gradient
    FROM (SELECT unnest(['odd', 'high']) AS name), range(65) AS r(dim) WHERE EXISTS (FROM vectors WHERE is_ref)""", views=("vectors",))
def q_fit_multilabel_gradient(spark, sf_dir):
    """The gradient of each label's loss is zero in every dimension."""
    _, r = _split(spark, sf_dir)
    head, _ = X.fit_multilabel(_flags(r), _flags(r), ["odd", "high"], "vec_id")
    return X.multilabel_gradient(_flags(r), head)


@query("kmeans")
def q_kmeans(spark, sf_dir):
    """K-means (k = 10) of all vectors."""
    return X.kmeans(B.vectors(spark, sf_dir).select("vec_id", "vec"), 10).select("vec_id", "cluster")


@query("kmeans_nearest", "SELECT vec_id, false AS violated FROM vectors", views=("vectors",))
def q_kmeans_nearest(spark, sf_dir):
    """No vector is nearer to the mean of another cluster than to that of its own."""
    c = X.kmeans(B.vectors(spark, sf_dir).select("vec_id", "vec"), 10)
    return X.nearer_means(c).select("vec_id", "violated")


@query("pca")
def q_pca(spark, sf_dir):
    """First 8 principal components of all vectors (long output)."""
    p = X.pca(B.vectors(spark, sf_dir).select("vec_id", "vec"), 8)
    return p.select("vec_id", F.posexplode("pcs").alias("k", "pc"))


@query("pca_covariance", """
    SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(0.0 AS DOUBLE) AS off_diagonal, i = j AS spread
    FROM range(8) AS a(i), range(8) AS b(j) WHERE i <= j AND EXISTS (FROM vectors)""", views=("vectors",))
def q_pca_covariance(spark, sf_dir):
    """Coordinates along different axes have no covariance; each has a variance."""
    c = X.covariance(X.pca(B.vectors(spark, sf_dir).select("vec_id", "vec"), 8), "pcs")
    off = F.when(F.col("i") == F.col("j"), F.lit(0.0)).otherwise(F.col("cov"))
    return c.select("i", "j", off.alias("off_diagonal"), (F.abs("cov") > 1e-9).alias("spread"))


@query("pca_variances", """
    WITH v AS (SELECT vec_id, unnest(range(64)) AS i, unnest(vec) AS a FROM vectors)
    SELECT sum(var) AS total FROM (SELECT i, var_pop(a) AS var FROM v GROUP BY i)""", views=("vectors",), round_cols=["total"])
def q_pca_variances(spark, sf_dir):
    """Along all 64 axes the variances add up to those of the vectors' own coordinates."""
    c = X.covariance(X.pca(B.vectors(spark, sf_dir).select("vec_id", "vec"), 64), "pcs")
    return c.where("i = j").agg(F.sum("cov").alias("total"))


# ---- J1 / J2 -------------------------------------------------------------------------------------
@query("align", f"""
    WITH {_TV_SQL}, v AS (SELECT sample_id, avg(x) AS m0 FROM tv WHERE dim = 0 GROUP BY 1)
    SELECT v.sample_id, l.types, l.hba1c, v.m0 FROM v JOIN sample_labels l ON v.sample_id = l.sample_id""",
       views=("weights", "sample_labels"), round_cols=["hba1c", "m0"])
def q_align(spark, sf_dir):
    """Pooled sample vectors aligned with their label rows by key (strict: none missing)."""
    v = V.sample_mean_pool(_token_vecs(spark, sf_dir))
    lab = B.sample_labels(spark, sf_dir).select("sample_id", "types", "hba1c")
    a = shape.align(v, lab, "sample_id", strict=True)
    return a.select("sample_id", "types", "hba1c", F.element_at("vec", 1).alias("m0"))


@query("attach_label", f"""WITH {_ASSIGN_SQL}
    SELECT b.vec_id, b.cluster, 'L' || CAST(v.label AS VARCHAR) AS true_label
    FROM best b LEFT JOIN vectors v ON v.vec_id = b.vec_id""", views=("vectors",))
def q_attach_label(spark, sf_dir):
    """Look the true label of each assigned target up by id (left join, every row kept)."""
    t, r = _split(spark, sf_dir)
    summary = t.select("vec_id", F.concat(F.lit("L"), F.col("label").cast("string")).alias("true_label"))
    return shape.attach_label(V.assign_cluster(t, r).select("vec_id", "cluster"), summary, "vec_id")


@query("adjusted_mutual_information", f"""WITH {_ASSIGN_SQL},
    j AS (SELECT b.cluster AS a, 'L' || CAST(v.label AS VARCHAR) AS b FROM best b JOIN vectors v ON v.vec_id = b.vec_id),
    cells AS (SELECT a, b, count(*) AS nij FROM j GROUP BY 1, 2),
    ra AS (SELECT a, CAST(sum(nij) AS BIGINT) AS ai FROM cells GROUP BY a),
    rb AS (SELECT b, CAST(sum(nij) AS BIGINT) AS bj FROM cells GROUP BY b),
    n AS (SELECT CAST(sum(nij) AS BIGINT) AS n FROM cells),
    mi AS (SELECT sum((nij / n) * ln(n * nij / (ai * bj))) AS mi
           FROM cells JOIN ra ON cells.a = ra.a JOIN rb ON cells.b = rb.b, n),
    ha AS (SELECT sum(-(ai / n) * ln(ai / n)) AS h_a FROM ra, n),
    hb AS (SELECT sum(-(bj / n) * ln(bj / n)) AS h_b FROM rb, n),
    t AS (SELECT ai, bj, n, k FROM ra, rb, n, LATERAL (SELECT unnest(range(greatest(1, ai + bj - n), least(ai, bj) + 1)) AS k) r),
    e AS (SELECT coalesce(sum((k / n) * (ln(n * k) - ln(ai * bj)) * exp(
                   lgamma(ai + 1) + lgamma(bj + 1) + lgamma(n - ai + 1) + lgamma(n - bj + 1) - lgamma(n + 1)
                   - lgamma(k + 1) - lgamma(ai - k + 1) - lgamma(bj - k + 1) - lgamma(n - ai - bj + k + 1))), 0.0) AS emi
          FROM t)
    SELECT mi, emi, mi / ((h_a + h_b) / 2.0) AS nmi,
           CASE WHEN h_a = 0 AND h_b = 0 THEN 1.0
                ELSE (mi - emi) / greatest((h_a + h_b) / 2.0 - emi, 2.220446049250313e-16) END AS ami
    FROM mi, ha, hb, e""", views=("vectors",), round_cols=["mi", "emi", "nmi", "ami"])
def q_adjusted_mutual_information(spark, sf_dir):
    """A24 (adjusted): AMI of assigned cluster versus true label (expected MI under fixed marginals)."""
    t, r = _split(spark, sf_dir)
    a = V.assign_cluster(t, r).join(t.select("vec_id", "label"), "vec_id")
    a = a.withColumn("true_label", F.concat(F.lit("L"), F.col("label").cast("string")))
    return V.adjusted_mutual_information(a, "cluster", "true_label")
