"""Registered queries: evaluation metrics (K1-K13, K16, K17) and top-k classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from glucoframe.functions.hashing import u, u_sql
from glucoframe.operators import masking as M
from glucoframe.operators import metrics as K
from glucoframe.plans.registry import query
from glucoframe.sources import bindings as B

_PRED_SQL = "pr AS (SELECT *, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS y_pred FROM predictions)"


def _pred(spark, sf_dir):
    p = B.predictions(spark, sf_dir)
    return p.withColumn("y_pred", K.argmax_prediction("logits"))


@query("argmax_prediction", f"WITH {_PRED_SQL} SELECT doc_id, y_true, y_pred FROM pr", views=("predictions",))
def q_argmax_prediction(spark, sf_dir):
    """K1: class of the largest logit (first on ties)."""
    return _pred(spark, sf_dir).select("doc_id", "y_true", "y_pred")


@query("confusion_matrix", f"WITH {_PRED_SQL} SELECT y_true, y_pred, count(*) AS n FROM pr GROUP BY 1, 2",
       views=("predictions",))
def q_confusion_matrix(spark, sf_dir):
    """K2: counts true x predicted."""
    return K.confusion_matrix(_pred(spark, sf_dir))


@query("accuracy", f"WITH {_PRED_SQL} SELECT avg(CAST(y_true = y_pred AS DOUBLE)) AS accuracy, count(*) AS n FROM pr",
       views=("predictions",), round_cols=["accuracy"])
def q_accuracy(spark, sf_dir):
    """K3: share of correct predictions."""
    return K.accuracy(_pred(spark, sf_dir))


_CLASSWISE_SQL = f"""{_PRED_SQL},
    cls AS (SELECT y_true AS cls FROM pr UNION SELECT y_pred FROM pr),
    c AS (SELECT cls, CAST(count(*) FILTER (WHERE y_true = cls AND y_pred = cls) AS BIGINT) AS tp,
                 CAST(count(*) FILTER (WHERE y_true = cls) AS BIGINT) AS n_true,
                 CAST(count(*) FILTER (WHERE y_pred = cls) AS BIGINT) AS n_pred
          FROM cls, pr GROUP BY cls),
    s AS (SELECT cls, tp, n_true, n_pred,
                 CASE WHEN n_pred = 0 THEN NULL ELSE tp / n_pred END AS precision,
                 CASE WHEN n_true = 0 THEN NULL ELSE tp / n_true END AS recall,
                 coalesce(CASE WHEN n_true + n_pred = 0 THEN NULL ELSE 2.0 * tp / (n_true + n_pred) END, 0.0) AS f1
          FROM c)"""


@query("classwise_scores", f"WITH {_CLASSWISE_SQL} SELECT * FROM s", views=("predictions",),
       round_cols=["precision", "recall", "f1"])
def q_classwise_scores(spark, sf_dir):
    """K5: per-class precision and recall from the confusion counts (0/0 -> null)."""
    return K.classwise_scores(_pred(spark, sf_dir))


@query("macro_f1", f"WITH {_CLASSWISE_SQL} SELECT avg(f1) AS macro_f1, count(*) AS n_classes FROM s",
       views=("predictions",), round_cols=["macro_f1"])
def q_macro_f1(spark, sf_dir):
    """K4: unweighted mean of class F1."""
    return K.macro_f1(_pred(spark, sf_dir))


@query("misclassified", f"WITH {_PRED_SQL} SELECT doc_id, y_pred, y_true FROM pr WHERE y_true <> y_pred",
       views=("predictions",))
def q_misclassified(spark, sf_dir):
    """K6: wrong rows with id, predicted and true class."""
    return K.misclassified(_pred(spark, sf_dir), "doc_id")


_ML_SQL = """ml AS (
    SELECT doc_id, y_flags,
           [CAST(1.0 / (1.0 + exp(-scores[1])) > 0.5 AS INTEGER), CAST(1.0 / (1.0 + exp(-scores[2])) > 0.5 AS INTEGER)] AS p_flags,
           scores FROM predictions),
    lr AS (SELECT doc_id, CAST(l - 1 AS INTEGER) AS label, y_flags[l] AS y, p_flags[l] AS p
           FROM ml, (SELECT unnest([1, 2]) AS l) ls)"""


def _ml(spark, sf_dir):
    p = B.predictions(spark, sf_dir)
    return p.withColumn("p_flags", K.sigmoid_threshold("scores"))


@query("sigmoid_threshold", f"WITH {_ML_SQL} SELECT doc_id, array_to_string(p_flags, ',') AS p_flags FROM ml",
       views=("predictions",))
def q_sigmoid_threshold(spark, sf_dir):
    """K7: logits -> flags with sigmoid > 0.5."""
    return _ml(spark, sf_dir).select("doc_id", F.array_join("p_flags", ",").alias("p_flags"))


@query("multilabel_overall", f"""WITH {_ML_SQL},
    s AS (SELECT count(*) FILTER (WHERE y = 1 AND p = 1) AS tp, count(*) FILTER (WHERE y = 0 AND p = 1) AS fp,
                 count(*) FILTER (WHERE y = 1 AND p = 0) AS fn, count(*) AS n FROM lr),
    e AS (SELECT avg(CAST(y_flags = p_flags AS DOUBLE)) AS subset_accuracy FROM ml)
    SELECT subset_accuracy, coalesce(tp / nullif(tp + fp, 0), 0.0) AS micro_precision,
           coalesce(tp / nullif(tp + fn, 0), 0.0) AS micro_recall,
           coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS micro_f1, (fp + fn) / n AS hamming_loss
    FROM e, s""", views=("predictions",),
       round_cols=["subset_accuracy", "micro_precision", "micro_recall", "micro_f1", "hamming_loss"])
def q_multilabel_overall(spark, sf_dir):
    """K8: exact match, micro precision / recall / F1, Hamming loss."""
    return K.multilabel_overall(_ml(spark, sf_dir), "doc_id")


_PER_LABEL_SQL = f"""WITH {_ML_SQL},
    g AS (SELECT label, CAST(count(*) FILTER (WHERE y = 1 AND p = 1) AS BIGINT) AS tp,
                 CAST(count(*) FILTER (WHERE y = 0 AND p = 1) AS BIGINT) AS fp,
                 CAST(count(*) FILTER (WHERE y = 1 AND p = 0) AS BIGINT) AS fn, count(*) AS n FROM lr GROUP BY label),
    pl AS (SELECT label, tp, fp, fn, n, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision,
                  coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall,
                  coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f1,
                  (fp + fn) / n AS hamming, 1.0 - (fp + fn) / n AS accuracy FROM g)"""


@query("multilabel_per_label", f"{_PER_LABEL_SQL} SELECT * FROM pl", views=("predictions",),
       round_cols=["precision", "recall", "f1", "hamming", "accuracy"])
def q_multilabel_per_label(spark, sf_dir):
    """K9: accuracy, precision, recall, F1, Hamming per label."""
    return K.multilabel_per_label(_ml(spark, sf_dir), "doc_id")


@query("multilabel_macro", f"""{_PER_LABEL_SQL}
    SELECT avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1 FROM pl""",
       views=("predictions",), round_cols=["macro_precision", "macro_recall", "macro_f1"])
def q_multilabel_macro(spark, sf_dir):
    """Macro precision / recall / F1."""
    return K.multilabel_macro(K.multilabel_per_label(_ml(spark, sf_dir), "doc_id"))


@query("jaccard_samples", f"""WITH {_ML_SQL},
    r AS (SELECT doc_id, sum(CASE WHEN y = 1 AND p = 1 THEN 1 ELSE 0 END) AS i,
                 sum(CASE WHEN y = 1 OR p = 1 THEN 1 ELSE 0 END) AS un FROM lr GROUP BY doc_id)
    SELECT avg(coalesce(i / nullif(un, 0), 0.0)) AS jaccard FROM r""", views=("predictions",),
       round_cols=["jaccard"])
def q_jaccard_samples(spark, sf_dir):
    """Mean per-row Jaccard of true and predicted flag sets."""
    return K.jaccard_samples(_ml(spark, sf_dir))


@query("ranking_average_precision", """
    WITH e AS (SELECT doc_id, CAST(l AS INTEGER) AS l, y_flags[l] AS y, scores[l] AS s
               FROM predictions, (SELECT unnest([1, 2]) AS l) ls),
    rel AS (SELECT a.doc_id, a.l,
                   (SELECT count(*) FROM e b WHERE b.doc_id = a.doc_id AND b.y = 1 AND b.s >= a.s) /
                   (SELECT count(*) FROM e b WHERE b.doc_id = a.doc_id AND b.s >= a.s) AS pr
            FROM e a WHERE a.y = 1),
    n AS (SELECT doc_id, sum(y) AS nrel, count(*) AS nl FROM e GROUP BY doc_id),
    r AS (SELECT n.doc_id, CASE WHEN nrel = 0 OR nrel = nl THEN 1.0 ELSE (SELECT avg(pr) FROM rel WHERE rel.doc_id = n.doc_id) END AS v
          FROM n)
    SELECT avg(v) AS lrap FROM r""", views=("predictions",), round_cols=["lrap"])
def q_ranking_average_precision(spark, sf_dir):
    """Label ranking average precision of the flag scores."""
    return K.ranking_average_precision(B.predictions(spark, sf_dir))


@query("regression_metrics", """
    SELECT avg((y - p) * (y - p)) AS mse, 1.0 - avg((y - p) * (y - p)) / var_pop(y) AS r2, corr(y, p) AS pearson,
           count(*) AS n FROM reg_predictions""", views=("reg_predictions",), round_cols=["mse", "r2", "pearson"])
def q_regression_metrics(spark, sf_dir):
    """MSE, R^2, Pearson of price against 2100 x quantity."""
    return K.regression_metrics(B.reg_predictions(spark, sf_dir))


@query("masked_token_accuracy", f"""
    WITH m AS (
      SELECT sample_id, CAST(pos + 1 AS INTEGER) AS tpos,
             CASE WHEN value IS NULL OR isnan(value) THEN 264
                  ELSE CAST(trunc(least(greatest(value, 39), 301)) AS INTEGER) - 39 END AS token
      FROM readings),
    d AS (SELECT *, CASE WHEN {u_sql(7, 'sample_id', 'tpos', "'draw'")} < 0.45 THEN token ELSE -100 END AS label FROM m),
    p AS (SELECT *, CASE WHEN {u_sql(60, 'sample_id', 'tpos')} < 0.7 THEN label ELSE (label + 1) % 263 END AS pred FROM d)
    SELECT avg(CAST(label = pred AS DOUBLE)) AS accuracy, count(*) AS n FROM p WHERE label <> -100""",
       views=("readings",), round_cols=["accuracy"])
def q_masked_token_accuracy(spark, sf_dir):
    """Accuracy over masked positions (plan M3 at 0.45, predictions right 70 % of the time)."""
    from glucoframe.functions.glucose import encode_value
    rd = B.readings(spark, sf_dir)
    t = rd.select("sample_id", (F.col("pos") + 1).cast("int").alias("tpos"), encode_value("value").alias("token"))
    m = M.apply_mask(M.mask_prob_uniform(t), seed=7)
    pred = F.when(u(60, "sample_id", "tpos") < 0.7, F.col("label")).otherwise((F.col("label") + 1) % 263)
    return K.masked_token_accuracy(m.withColumn("pred", pred))


@query("log_loss", """
    SELECT avg(list_max(logits) + ln(list_sum(list_transform(logits, lambda x: exp(x - list_max(logits)))))
               - logits[y_true + 1]) AS log_loss, count(*) AS n
    FROM predictions WHERE y_true <> -100""", views=("predictions",), round_cols=["log_loss"])
def q_log_loss(spark, sf_dir):
    """Mean negative log softmax of the true class over stored logits."""
    return K.log_loss(B.predictions(spark, sf_dir))


@query("merge_metrics", f"""
    WITH {_PRED_SQL},
    s AS (SELECT *, CASE WHEN {u_sql(80, 'doc_id')} < 0.5 THEN 'eval' ELSE 'test' END AS split FROM pr),
    m AS (SELECT 0 AS run, split, 'accuracy' AS metric, avg(CAST(y_true = y_pred AS DOUBLE)) AS value FROM s GROUP BY split
          UNION ALL SELECT 0, split, 'n', CAST(count(*) AS DOUBLE) FROM s GROUP BY split
          UNION ALL SELECT 1, split, 'accuracy', avg(CAST(least(y_true, 1) = least(y_pred, 1) AS DOUBLE)) FROM s
                    WHERE split = 'eval' GROUP BY split)
    SELECT split || '_' || metric AS name, max_by(value, run) AS value, max(run) AS run FROM m GROUP BY 1""",
       views=("predictions",), round_cols=["value"])
def q_merge_metrics(spark, sf_dir):
    """Metric names prefixed by split; a later run overrides an earlier one."""
    s = _pred(spark, sf_dir).withColumn(
        "split", F.when(u(80, "doc_id") < 0.5, F.lit("eval")).otherwise(F.lit("test")))
    r0 = s.groupBy("split").agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"),
                                F.count("*").cast("double").alias("n"))
    r0 = r0.select(F.lit(0).alias("run"), "split",
                   F.inline(F.array(F.struct(F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value")),
                                    F.struct(F.lit("n").alias("metric"), F.col("n").alias("value")))))
    r1 = s.filter("split = 'eval'").groupBy("split").agg(
        F.avg((F.least("y_true", F.lit(1)) == F.least("y_pred", F.lit(1))).cast("double")).alias("value"))
    r1 = r1.select(F.lit(1).alias("run"), "split", F.lit("accuracy").alias("metric"), "value")
    return K.merge_metrics(r0.unionByName(r1))


@query("top_k_classes", """
    WITH l AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS cls, logits[i] / 0.7 AS l
               FROM predictions, (SELECT unnest([1, 2, 3]) AS i) ix),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY l DESC, cls) AS rn FROM l),
    k AS (SELECT *, exp(l - max(l) OVER (PARTITION BY doc_id)) AS e FROM r WHERE rn <= 2)
    SELECT doc_id, cls, e / sum(e) OVER (PARTITION BY doc_id) AS prob FROM k""",
       views=("predictions",), round_cols=["prob"])
def q_top_k_classes(spark, sf_dir):
    """Two best classes per row at temperature 0.7, renormalised."""
    return K.top_k_classes(B.predictions(spark, sf_dir), "doc_id", k=2, temperature=0.7)
