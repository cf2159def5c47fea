"""Toxicity by weak supervision.

A lexicon is mined from labelled training texts (words far more frequent in toxic
ones). Every lexicon word and a few patterns are voters that say toxic, clean or
nothing. A generative label model estimates, by expectation-maximisation over the
votes alone, how each voter votes in either class (its accuracy and coverage);
the correlations that are left within the classes weigh down voters that repeat
each other. A linear classifier (hashed words and lexicon hits) is trained on the
posterior labels and scores every whole text.

Labels are read only of rows whose crc32(doc_id as text) mod 5 is not 0. The
label model and the classifier are fitted on at most ``MAX_LABELLED`` of them,
chosen by a hash of the id; copies and near copies of a text count once. Scores use the text
alone. Without labels of both classes no lexicon can be mined and every score is
the share of toxic labels (0 without labels).

Defined results: null texts are empty; repeated ids are scored row by row; if a
document has several labels the largest counts.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glucoframe.llm.scratch import Scratch

FOLDS = 5
MAX_LABELLED = 20_000
LEXICON = 64
FEATURES = 1 << 12
ROUNDS = 50


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS == 0


def prepared(docs: DataFrame) -> DataFrame:
    """Texts with their distinct folded words (runs of letters and marks)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}']+"), lambda w: w != ""))
    return docs.withColumn("text", text).withColumn("words", words)


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, words, toxic) of a bounded, hashed choice of labelled rows outside the held-out fold."""
    lab = (labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL")
           .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out()))
    n = lab.count()
    if n > MAX_LABELLED:
        lab = lab.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < int(MAX_LABELLED * 0.97))
    rows = docs.select("doc_id", "text").join(F.broadcast(lab), "doc_id")  # MAX_LABELLED rows
    # texts with the same least shingle are nearly always copies, and count once
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    rows = rows.withColumn("w", words).withColumn("least", F.expr(
        "array_min(transform(sequence(1, greatest(size(w) - 2, 1)), i -> xxhash64(get(w, i - 1), get(w, i), get(w, i + 1))))"))
    return prepared(rows.groupBy("least").agg(F.min_by("text", "doc_id").alias("text"), F.max("toxic").alias("toxic")))


def mined_lexicon(rows: DataFrame) -> list[str]:
    """The words that tell toxic training texts best, at most LEXICON."""
    n, n1 = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    n0 = n - n1
    if not n1 or not n0:
        return []
    least = max(3, n1 // 50)  # a few copies of one text make no lexicon
    seen = rows.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(
        F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    lift = F.log((F.col("a") + 0.5) / (n1 + 1)) - F.log((F.col("b") + 0.5) / (n0 + 1))
    best = seen.where((F.col("a") >= least) & (F.length("word") > 1)).withColumn("lift", lift).where("lift > 1.5")
    return [r["word"] for r in best.orderBy(F.desc(F.col("lift") * F.col("a")), "word").limit(LEXICON).collect()]


def hits(lexicon: list[str]) -> Column:
    if not lexicon:
        return F.lit(0)
    return F.size(F.array_intersect("words", F.array(*map(F.lit, lexicon))))


def votes(lexicon: list[str]) -> Column:
    """Votes as an array: 1 toxic, 0 clean, -1 nothing. One voter per word, then the patterns."""
    n = hits(lexicon)
    letters = F.length(F.regexp_replace("text", r"\P{L}+", ""))
    upper = F.length(F.regexp_replace("text", r"\P{Lu}+", ""))
    says = [F.when(F.array_contains("words", w), 1).otherwise(-1) for w in lexicon]
    says += [
        F.when(n >= 2, 1).when(n == 0, 0).otherwise(-1),
        F.when(n >= 1, 1).otherwise(0),
        F.when(upper * 2 > letters, 1).otherwise(-1),
        F.when(F.col("text").contains("!!"), 1).otherwise(-1),
        F.when(F.size("words") < 20, -1).when(n * 100 >= F.size("words"), 1).when(n * 1000 < F.size("words"), 0).otherwise(-1),
    ]
    return F.array(*says)


class LabelModel:
    """Two classes; each voter has its own chances of the votes -1, 0, 1 in either class.
    Expectation-maximisation over the votes, then weights for correlated voters."""

    def __init__(self, v: np.ndarray, start: np.ndarray):
        one_hot = np.stack([v == x for x in (-1, 0, 1)], axis=2).astype(float)  # rows, voters, votes
        q = np.clip(start.astype(float), 0.02, 0.98)
        for _ in range(ROUNDS):
            p1 = (np.einsum("r,rvx->vx", q, one_hot) + 0.5) / (q.sum() + 1.5)
            p0 = (np.einsum("r,rvx->vx", 1 - q, one_hot) + 0.5) / ((1 - q).sum() + 1.5)
            prior = np.clip(q.mean(), 1e-3, 1 - 1e-3)
            gain = np.log(p1 / p0)
            # voters that still go together within the classes share their weight
            e = (v == 1) - q[:, None] * p1[:, 2] - (1 - q[:, None]) * p0[:, 2]
            e -= e.mean(axis=0)
            sd = e.std(axis=0)
            self.correlations = (e.T @ e) / len(e) / (sd * sd[:, None] + 1e-3)  # voters without a residue count as independent
            shared = np.clip(self.correlations - np.diag(np.diag(self.correlations)), 0, 1)
            self.weights = 1 / (1 + shared.sum(axis=1))
            self.accuracies, self.gain, self.prior = (p1, p0), gain, prior
            new = self.posterior(v)
            if np.abs(new - q).max() < 1e-6:
                break
            q = new

    def posterior(self, v: np.ndarray) -> np.ndarray:
        at = np.take_along_axis(self.gain[None], (v + 1)[:, :, None], axis=2)[:, :, 0]
        z = np.log(self.prior / (1 - self.prior)) + at @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class ToxicityModel:
    """Lexicon, label model and linear classifier, fitted on labelled texts."""

    def __init__(self, docs: DataFrame, labels: DataFrame):
        spark = docs.sparkSession
        rows = Scratch(spark, "toxicity").stored(training_rows(docs, labels))
        self.lexicon = mined_lexicon(rows)
        self.share = float(rows.agg(F.coalesce(F.avg("toxic"), F.lit(0.0))).first()[0])
        self.classifier = None
        if not self.lexicon:
            return
        got = rows.select(F.xxhash64("text").alias("key"), votes(self.lexicon).alias("v"), "toxic").collect()  # MAX_LABELLED rows
        v = np.array([r["v"] for r in got], np.int8)
        self.label_model = LabelModel(v, np.array([r["toxic"] for r in got]))
        q = self.label_model.posterior(v)
        soft = spark.createDataFrame([(r["key"], float(x)) for r, x in zip(got, q)], "key long, q double")
        train = self.features(rows.withColumn("key", F.xxhash64("text"))).join(F.broadcast(soft), "key")  # MAX_LABELLED rows
        train = train.select("features", F.inline(F.array(
            F.struct(F.lit(1.0).alias("label"), F.col("q").alias("weight")),
            F.struct(F.lit(0.0).alias("label"), (1 - F.col("q")).alias("weight"))))).where("weight > 0.001")
        fit = LogisticRegression(weightCol="weight", regParam=0.002, elasticNetParam=0.9, maxIter=40, standardization=False)
        self.classifier = fit.fit(train)

    def features(self, rows: DataFrame) -> DataFrame:
        n = hits(self.lexicon)
        rows = rows.withColumn("any_hit", (n > 0).cast("double")).withColumn("hits", F.least(n, F.lit(5)) / 5.0)
        rows = HashingTF(numFeatures=FEATURES, binary=True, inputCol="words", outputCol="hashed").transform(rows)
        return VectorAssembler(inputCols=["hashed", "any_hit", "hits"], outputCol="features").transform(rows)

    def scored(self, docs: DataFrame, keep: list[str]) -> DataFrame:
        """Columns ``keep`` of ``docs`` and a score from 0 to 1."""
        named = docs.select("text", F.struct(*keep).alias("__kept"))
        if self.classifier is None:
            return named.select("__kept.*", F.lit(self.share).alias("__score"))
        out = self.classifier.transform(self.features(prepared(named)))
        return out.select("__kept.*", vector_to_array("probability")[1].alias("__score"))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = ToxicityModel(docs, labels)
    return model.scored(docs, ["doc_id"]).select(
        "doc_id", held_out().alias("held_out"), F.col("__score").alias("score"),
        (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` (all columns) without the texts that are scored 0.5 or more."""
    model = ToxicityModel(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels)
    return model.scored(docs, docs.columns).where("__score < 0.5").select(*docs.columns)
