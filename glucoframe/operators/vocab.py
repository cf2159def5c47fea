"""Vocabulary tables (V1, V2) and class ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glucoframe.functions.glucose import CLIP_HI, CLIP_LO

# special tokens, appended in this order (fixed values)
SPECIALS = ["<mask>", "<pad>", "<cls>"]


def _with_specials(base: DataFrame) -> DataFrame:
    """Append the specials after the highest id of ``base`` (one-row aggregate, broadcast)."""
    top = base.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("_top"))
    sp = base.sparkSession.createDataFrame([(s, i) for i, s in enumerate(SPECIALS)],
                                           "token string, k int")
    sp = sp.crossJoin(F.broadcast(top)).select(
        "token", (F.col("_top") + 1 + F.col("k")).cast("int").alias("id"))
    return base.unionByName(sp)


def build_vocab_fixed(spark: SparkSession, lo: int = CLIP_LO, hi: int = CLIP_HI) -> DataFrame:
    """V1: readings lo..hi -> ids 0..hi-lo, then <mask>, <pad>, <cls>."""
    base = spark.range(lo, hi + 1).select(
        F.col("id").cast("string").alias("token"), (F.col("id") - lo).cast("int").alias("id"))
    return _with_specials(base)


def build_vocab_learned(values: DataFrame, col: str = "value") -> DataFrame:
    """V2: distinct integer tokens of a corpus, sorted and numbered; specials appended.

    The distinct set is bounded by the value domain (integer mg/dL), so the
    numbering window runs on a small, already-reduced frame.
    """
    toks = (values.filter(F.col(col).isNotNull() & ~F.isnan(col))
            .select(F.col(col).cast("int").alias("t")).distinct())
    base = toks.select(F.col("t").cast("string").alias("token"),
                       (F.row_number().over(Window.orderBy("t")) - 1).cast("int").alias("id"))
    return _with_specials(base)


def label_ids(train: DataFrame, test: DataFrame | None = None, col: str = "label",
              out: str = "label_id") -> DataFrame:
    """Class name -> id over both sets, ids = dense rank of the sorted names (Q3).

    Returns the (label, label_id) map; join it (broadcast, bounded by the
    number of classes) to attach ids.
    """
    names = train.select(col)
    if test is not None:
        names = names.unionByName(test.select(col))
    names = names.filter(F.col(col).isNotNull()).distinct()
    return names.select(col, (F.dense_rank().over(Window.orderBy(col)) - 1).cast("int").alias(out))


def apply_label_ids(df: DataFrame, ids: DataFrame, col: str = "label") -> DataFrame:
    """Attach class ids by a broadcast join on the (bounded) class map."""
    return df.join(F.broadcast(ids), col, "inner")


def keep_trained_labels(test: DataFrame, train: DataFrame, col: str = "label") -> DataFrame:
    """Drop test rows whose label never occurs in training (left semi join)."""
    return test.join(train.select(col).distinct(), col, "left_semi")


def pack_labels(cols: Sequence[str]) -> F.Column:
    """Several flag columns -> one label vector."""
    return F.array(*[F.col(c).cast("int") for c in cols])
