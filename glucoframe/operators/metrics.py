"""Evaluation metrics as tables (K1-K17, X8): predictions in, metrics out.

Multi-metric operators compute everything from one grouped aggregate
(confusion counts, per-label sums), never from a collected table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glucoframe.functions.glucose import IGNORE_LABEL


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---- K1-K6 ---------------------------------------------------------------------------------
def argmax_prediction(logits) -> Column:
    """K1: index of the largest logit, first one on ties."""
    a = _c(logits)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def confusion_matrix(df: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """K2: long confusion counts (y_true, y_pred, n)."""
    return df.groupBy(y, p).agg(F.count("*").alias("n"))


def accuracy(df: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """K3: share of correct predictions."""
    return df.agg(F.avg((F.col(y) == F.col(p)).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def classwise_scores(df: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """K5: per class precision = diag / predicted count, recall = diag / true count (0/0 -> null).

    Classes = labels seen in truth or prediction. From the confusion counts only.
    """
    cm = confusion_matrix(df, y, p)
    true_n = cm.groupBy(F.col(y).alias("cls")).agg(F.sum("n").alias("n_true"))
    pred_n = cm.groupBy(F.col(p).alias("cls")).agg(F.sum("n").alias("n_pred"))
    diag = cm.filter(F.col(y) == F.col(p)).select(F.col(y).alias("cls"), F.col("n").alias("tp"))
    classes = true_n.select("cls").unionByName(pred_n.select("cls")).distinct()
    j = classes.join(true_n, "cls", "left").join(pred_n, "cls", "left").join(diag, "cls", "left")
    j = j.select("cls", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("tp", "n_true", "n_pred")])
    return (j.withColumn("precision", F.try_divide(F.col("tp"), F.col("n_pred").cast("double")))
             .withColumn("recall", F.try_divide(F.col("tp"), F.col("n_true").cast("double")))
             .withColumn("f1", F.coalesce(F.try_divide(2.0 * F.col("tp"),
                                                       (F.col("n_true") + F.col("n_pred")).cast("double")),
                                          F.lit(0.0))))


def macro_f1(df: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """K4: unweighted mean of per-class F1 (0 for a class with no support and no prediction)."""
    return classwise_scores(df, y, p).agg(F.avg("f1").alias("macro_f1"), F.count("*").alias("n_classes"))


def misclassified(df: DataFrame, key: str, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """K6: wrong rows with id, predicted and true class."""
    return df.filter(F.col(y) != F.col(p)).select(key, p, y)


# ---- K7-K11: multi-label ----------------------------------------------------------------------
def sigmoid_threshold(scores, threshold: float = 0.5) -> Column:
    """K7: logits -> 0/1 flags by sigmoid(x) > threshold."""
    return F.transform(_c(scores), lambda x: (1.0 / (1.0 + F.exp(-x)) > threshold).cast("int"))


def _label_rows(df: DataFrame, key: str, y: str, p: str) -> DataFrame:
    z = F.arrays_zip(F.col(y).alias("y"), F.col(p).alias("p"))
    return df.select(key, F.posexplode(z).alias("label", "_z")).select(
        key, "label", F.col("_z.y").alias("y"), F.col("_z.p").alias("p"))


def multilabel_per_label(df: DataFrame, key: str, y: str = "y_flags", p: str = "p_flags") -> DataFrame:
    """K9: per label accuracy, precision, recall, F1 and Hamming loss (0/0 -> 0 as scikit-learn)."""
    lr = _label_rows(df, key, y, p)
    g = lr.groupBy("label").agg(
        F.count_if((F.col("y") == 1) & (F.col("p") == 1)).alias("tp"),
        F.count_if((F.col("y") == 0) & (F.col("p") == 1)).alias("fp"),
        F.count_if((F.col("y") == 1) & (F.col("p") == 0)).alias("fn"),
        F.count("*").alias("n"))
    prec = F.coalesce(F.try_divide(F.col("tp"), (F.col("tp") + F.col("fp")).cast("double")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp"), (F.col("tp") + F.col("fn")).cast("double")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), (2 * F.col("tp") + F.col("fp") + F.col("fn")).cast("double")),
                    F.lit(0.0))
    ham = (F.col("fp") + F.col("fn")) / F.col("n")
    return g.select("label", "tp", "fp", "fn", "n", prec.alias("precision"), rec.alias("recall"),
                    f1.alias("f1"), ham.alias("hamming"), (1.0 - ham).alias("accuracy"))


def multilabel_macro(per_label: DataFrame) -> DataFrame:
    """Macro precision / recall / F1 = mean over labels."""
    return per_label.agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
                         F.avg("f1").alias("macro_f1"))


def multilabel_overall(df: DataFrame, key: str, y: str = "y_flags", p: str = "p_flags") -> DataFrame:
    """K8: exact-match accuracy, micro precision / recall / F1, Hamming loss."""
    exact = df.agg(F.avg((F.col(y) == F.col(p)).cast("double")).alias("subset_accuracy"))
    lr = _label_rows(df, key, y, p)
    s = lr.agg(F.count_if((F.col("y") == 1) & (F.col("p") == 1)).alias("tp"),
               F.count_if((F.col("y") == 0) & (F.col("p") == 1)).alias("fp"),
               F.count_if((F.col("y") == 1) & (F.col("p") == 0)).alias("fn"),
               F.count("*").alias("n"))
    out = exact.crossJoin(s)
    return out.select(
        "subset_accuracy",
        F.coalesce(F.try_divide(F.col("tp"), (F.col("tp") + F.col("fp")).cast("double")), F.lit(0.0)).alias("micro_precision"),
        F.coalesce(F.try_divide(F.col("tp"), (F.col("tp") + F.col("fn")).cast("double")), F.lit(0.0)).alias("micro_recall"),
        F.coalesce(F.try_divide(2.0 * F.col("tp"), (2 * F.col("tp") + F.col("fp") + F.col("fn")).cast("double")),
                   F.lit(0.0)).alias("micro_f1"),
        ((F.col("fp") + F.col("fn")) / F.col("n")).alias("hamming_loss"))


def jaccard_samples(df: DataFrame, y: str = "y_flags", p: str = "p_flags") -> DataFrame:
    """Mean per-row |y and p| / |y or p| of the flag sets (empty union -> 0)."""
    z = F.arrays_zip(F.col(y).alias("y"), F.col(p).alias("p"))
    inter = F.size(F.filter(z, lambda e: (e["y"] == 1) & (e["p"] == 1)))
    union = F.size(F.filter(z, lambda e: (e["y"] == 1) | (e["p"] == 1)))
    return df.agg(F.avg(F.coalesce(F.try_divide(inter, union.cast("double")), F.lit(0.0))).alias("jaccard"))


def ranking_average_precision(df: DataFrame, y: str = "y_flags", s: str = "scores") -> DataFrame:
    """Label ranking average precision (rows with no or all relevant labels score 1)."""
    z = F.arrays_zip(F.col(y).alias("y"), F.col(s).alias("s"))
    rel = F.filter(z, lambda e: e["y"] == 1)

    def prec(e):
        rank_all = F.size(F.filter(z, lambda o: o["s"] >= e["s"]))
        rank_rel = F.size(F.filter(z, lambda o: (o["y"] == 1) & (o["s"] >= e["s"])))
        return rank_rel / rank_all
    n_rel = F.size(rel)
    row = F.when((n_rel == 0) | (n_rel == F.size(y)), F.lit(1.0)).otherwise(
        F.aggregate(F.transform(rel, prec), F.lit(0.0), lambda a, x: a + x) / n_rel)
    return df.agg(F.avg(row).alias("lrap"))


# ---- K12-K17 ------------------------------------------------------------------------------------
def regression_metrics(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """MSE, R^2 and Pearson in one aggregate."""
    ok = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull())
    g = ok.agg(F.avg((F.col(y) - F.col(p)) ** 2).alias("mse"), F.var_pop(y).alias("_v"),
               F.corr(y, p).alias("pearson"), F.count("*").alias("n"))
    return g.select("mse", (1.0 - F.try_divide(F.col("mse"), F.col("_v"))).alias("r2"), "pearson", "n")


def masked_token_accuracy(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Share correct where label <> -100; no such position -> null (no metric)."""
    ok = df.filter(F.col(label) != IGNORE_LABEL)
    return ok.agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"),
                  F.count("*").alias("n"))


def horizon_scores(df: DataFrame, y: str = "post", p: str = "pred") -> DataFrame:
    """MSE over all present (y, p) pairs (h = -1) and per-horizon MSE and Pearson."""
    z = df.select(F.posexplode(F.arrays_zip(F.col(y).alias("y"), F.col(p).alias("p"))).alias("h", "_z"))
    z = z.select("h", F.col("_z.y").alias("y"), F.col("_z.p").alias("p")).filter(
        F.col("y").isNotNull() & F.col("p").isNotNull())
    per = z.groupBy("h").agg(F.count("*").alias("n"), F.avg((F.col("y") - F.col("p")) ** 2).alias("mse"),
                             F.corr("y", "p").alias("pearson"))
    tot = z.agg(F.lit(-1).alias("h"), F.count("*").alias("n"), F.avg((F.col("y") - F.col("p")) ** 2).alias("mse"),
                F.lit(None).cast("double").alias("pearson"))
    return per.select(F.col("h").cast("int"), "n", "mse", "pearson").unionByName(
        tot.select(F.col("h").cast("int"), "n", "mse", "pearson"))


def log_loss(df: DataFrame, logits: str = "logits", y: str = "y_true") -> DataFrame:
    """Mean negative log softmax of the true class (log-sum-exp per row); label -100 ignored."""
    ok = df.filter(F.col(y) != IGNORE_LABEL)
    m = F.array_max(logits)
    lse = m + F.log(F.aggregate(F.col(logits), F.lit(0.0), lambda a, x: a + F.exp(x - m)))
    nll = lse - F.element_at(logits, F.col(y) + 1)
    return ok.agg(F.avg(nll).alias("log_loss"), F.count("*").alias("n"))


def merge_metrics(metrics: DataFrame, run: str = "run", split: str = "split", metric: str = "metric",
                  value: str = "value") -> DataFrame:
    """Names prefixed by split ('eval_', 'test_'); the latest run wins per name."""
    named = metrics.withColumn("name", F.concat(F.col(split), F.lit("_"), F.col(metric)))
    return named.groupBy("name").agg(F.max_by(value, run).alias("value"), F.max(run).alias("run"))


# ---- X8 ------------------------------------------------------------------------------------------------
def top_k_classes(df: DataFrame, key: str, logits: str = "logits", k: int = 2,
                  temperature: float = 1.0) -> DataFrame:
    """Per row, logits / temperature, keep the k best (ties -> lower class), softmax
    over the kept ones. Long output (key, cls, prob); the window is per row (bounded
    by the number of classes)."""
    lg = df.select(key, F.posexplode(logits).alias("cls", "_l"))
    lg = lg.withColumn("_l", F.col("_l") / temperature)
    w = Window.partitionBy(key).orderBy(F.col("_l").desc(), F.col("cls"))
    kept = lg.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    wk = Window.partitionBy(key)
    kept = kept.withColumn("_e", F.exp(F.col("_l") - F.max("_l").over(wk)))
    return kept.select(key, F.col("cls").cast("int"), (F.col("_e") / F.sum("_e").over(wk)).alias("prob"))
