"""Segments and attention-weight averages.

Intervals are half-open ``[lo, hi)`` on reading positions; the inclusive /
exclusive ends of each stage of the reference (Q8) are normalised when the
interval table is built. A weight at attention position ``tpos`` belongs to
reading position ``tpos - 1`` (position 0 is <cls>).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glucoframe.functions.glucose import DAY_SLOTS, LOW

MEALS = ("Breakfast", "Lunch", "Dinner")
BEFORE_MEAL_SLOTS = 18  # fixed value: 18 slots (90 minutes) before a meal


def _keys(k) -> list:
    return [k] if isinstance(k, str) else list(k)


# ---- J5: interval tables from the time split ---------------------------------------
def stage_intervals(ts: DataFrame, sample: str = "sample_id") -> DataFrame:
    """J5 + Q8/Q9: (sample_id, stage, seg, lo, hi) half-open intervals.

    dawn = [Dawn_s, Dawn_e]; before_meal = [s - 18, s) per present meal, start
    clamped at 0 (Q9); after_meal = (Breakfast_e, Lunch_s), (Lunch_e, Dinner_s),
    (Dinner_e, 288) when both ends are present; fast = [Fast_s, Fast_e).
    """
    c = F.col
    rows = [
        F.struct(F.lit("dawn").alias("stage"), F.lit(0).alias("seg"),
                 c("Dawn_s").alias("lo"), (c("Dawn_e") + 1).alias("hi")),
        F.struct(F.lit("fast").alias("stage"), F.lit(0).alias("seg"),
                 c("Fast_s").alias("lo"), c("Fast_e").alias("hi")),
    ]
    for i, m in enumerate(MEALS):
        rows.append(F.struct(F.lit("before_meal").alias("stage"), F.lit(i).alias("seg"),
                             F.greatest(c(f"{m}_s") - BEFORE_MEAL_SLOTS, F.lit(0)).alias("lo"),
                             c(f"{m}_s").alias("hi")))
    rows.append(F.struct(F.lit("after_meal").alias("stage"), F.lit(0).alias("seg"),
                         (c("Breakfast_e") + 1).alias("lo"), c("Lunch_s").alias("hi")))
    rows.append(F.struct(F.lit("after_meal").alias("stage"), F.lit(1).alias("seg"),
                         (c("Lunch_e") + 1).alias("lo"), c("Dinner_s").alias("hi")))
    rows.append(F.struct(F.lit("after_meal").alias("stage"), F.lit(2).alias("seg"),
                         (c("Dinner_e") + 1).alias("lo"), F.lit(DAY_SLOTS).alias("hi")))
    out = ts.select(sample, F.inline(F.array(*rows)))
    return (out.filter(c("lo").isNotNull() & c("hi").isNotNull())
            .select(sample, "stage", "seg", c("lo").cast("int").alias("lo"),
                    c("hi").cast("int").alias("hi")))


# ---- J4 -----------------------------------------------------------------------------
def segment_join(long: DataFrame, intervals: DataFrame, sample: str = "sample_id",
                 pos: str = "pos") -> DataFrame:
    """Rows of ``long`` whose position lies in an interval of the same sample.

    Equi-join on the sample (a handful of intervals per sample) plus a range
    predicate; a position inside two intervals is returned once per interval.
    """
    iv = intervals.withColumnRenamed(sample, "_s")
    cond = ((F.col(sample) == F.col("_s")) & (F.col(pos) >= F.col("lo"))
            & (F.col(pos) < F.col("hi")))
    return long.join(iv, cond, "inner").drop("_s")


def running_totals(long: DataFrame, keys: Sequence[str], value: str, pos: str = "pos", length: int = DAY_SLOTS) -> DataFrame:
    """One row per ``keys``: ``totals``, the positions p in order, each with the number c and the sum s of
    the values up to and including it. Null values are left out; positions lie in 0..length - 1,
    others raise.

    A running sum over the group's bounded positions and one collect on the same keys: nothing is
    shuffled where the input already lies by a part of the keys."""
    w = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    at = F.when((F.col(pos) >= 0) & (F.col(pos) < length), F.col(pos).cast("int")).otherwise(
        F.raise_error(F.concat(F.lit("position out of range: "), F.col(pos).cast("string"))).cast("int"))
    summed = long.where(F.col(pos).isNotNull()).select(
        *keys, at.alias("p"), F.count(value).over(w).alias("c"), F.coalesce(F.sum(value).over(w), F.lit(0.0)).cast("double").alias("s"))
    return summed.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("p", "c", "s"))).alias("totals"))


def prefix_array(part: str, totals: str = "totals", length: int = DAY_SLOTS) -> Column:
    """``length`` + 1 entries: entry b is the number (``part`` "c") or sum ("s") of the values at positions
    below b. Each position's total is repeated up to the next."""
    r = F.col(totals)
    runs = F.transform(r, lambda e, i: F.array_repeat(e[part], F.coalesce(F.get(r, i + 1)["p"], F.lit(length)) - e["p"]))
    zero = F.lit(0).cast("long") if part == "c" else F.lit(0.0)
    return F.concat(F.array_repeat(zero, F.get(r, F.lit(0))["p"] + 1), F.flatten(runs))


def mean_in_segment(long: DataFrame, intervals: DataFrame, value: str, group: Sequence[str] = (),
                    sample: str = "sample_id", pos: str = "pos", empty: float | None = 0.0,
                    length: int = DAY_SLOTS) -> DataFrame:
    """Mean of ``value`` inside each stage per (sample, group..., stage).

    Each (sample, group) becomes a pair of prefix arrays; an interval is the difference of two
    look-ups in them, so no row meets an interval, and a position counts once per interval holding it.
    Every (sample, group) gets a row for each stage the sample has; a stage without positions
    averages to ``empty`` (Q10: 0.0; None keeps null). Positions lie in 0..length - 1.

    Plan: the intervals are one array per sample (at most eight). A semi join with their samples
    brings the rows together by sample, if they are not already, and the rest stays there.
    """
    g = list(group)
    inside = lambda c: F.least(F.greatest(c, F.lit(0)), F.lit(length)).cast("int")
    ends = F.struct("stage", inside(F.col("lo")).alias("lo"), inside(F.greatest("lo", "hi")).alias("hi"))
    mine = intervals.groupBy(sample).agg(F.collect_list(ends).alias("_iv"))
    # hashed per partition, on the small side: both sides lie by sample, none is broadcast
    rows = long.join(mine.select(sample).hint("shuffle_hash"), sample, "left_semi")
    totals = running_totals(rows, [sample, *g], value, pos, length).join(mine.hint("shuffle_hash"), sample)
    # the arrays live inside this projection only
    both = F.array(F.struct(prefix_array("s", length=length).alias("s"), prefix_array("c", length=length).alias("c")))
    spans = F.flatten(F.transform(both, lambda a: F.transform("_iv", lambda i: F.struct(
        i["stage"].alias("stage"), (F.get(a["s"], i["hi"]) - F.get(a["s"], i["lo"])).alias("s"),
        (F.get(a["c"], i["hi"]) - F.get(a["c"], i["lo"])).alias("c")))))
    sums = totals.select(sample, *g, F.inline(spans))
    out = sums.groupBy(sample, *g, "stage").agg(F.try_divide(F.sum("s"), F.sum("c")).alias("mean"))
    if empty is not None:
        out = out.withColumn("mean", F.coalesce(F.col("mean"), F.lit(float(empty))))
    return out


# ---- A13-A17 ---------------------------------------------------------------------------
def attention_received(raw: DataFrame, keys=("sample_id", "layer", "head", "tpos"),
                       w: str = "w") -> DataFrame:
    """Mean over the query axis."""
    return raw.groupBy(*keys).agg(F.avg(w).alias("w"))


def cls_vs_rest(weights: DataFrame, keys=("sample_id", "layer", "head"), w: str = "w",
                tpos: str = "tpos") -> DataFrame:
    """Weight at position 0 (<cls>) and mean weight of the other positions."""
    return weights.groupBy(*keys).agg(
        F.avg(F.when(F.col(tpos) == 0, F.col(w))).alias("cls_w"),
        F.avg(F.when(F.col(tpos) > 0, F.col(w))).alias("rest_w"))


def with_reading_pos(weights: DataFrame, tpos: str = "tpos") -> DataFrame:
    """Reading position of a weight: tpos - 1; <cls> rows are dropped."""
    return weights.filter(F.col(tpos) > 0).withColumn("pos", (F.col(tpos) - 1).cast("int"))


def mean_where_value(weights: DataFrame, rd: DataFrame, pred=None,
                     keys=("sample_id", "layer", "head"), empty: float | None = 0.0) -> DataFrame:
    """Mean weight over positions whose reading satisfies ``pred`` (default < 70).

    Weights and readings are joined on (sample, position) after the <cls> shift;
    groups without such a position get ``empty`` (Q10).
    """
    pred = pred if pred is not None else (F.col("value") < LOW)
    wr = with_reading_pos(weights).join(rd.select("sample_id", "pos", "value"),
                                        ["sample_id", "pos"], "left")
    out = wr.groupBy(*keys).agg(F.avg(F.when(pred, F.col("w"))).alias("mean_w"))
    if empty is not None:
        out = out.withColumn("mean_w", F.coalesce(F.col("mean_w"), F.lit(float(empty))))
    return out


def mean_by_state(weights: DataFrame, states: DataFrame,
                  keys=("sample_id", "layer", "head")) -> DataFrame:
    """Mean weight per slot state (N / Up / Down), all three states (Q12)."""
    j = with_reading_pos(weights).join(states.select("sample_id", "pos", "state"),
                                       ["sample_id", "pos"])
    return j.groupBy(*keys, "state").agg(F.avg("w").alias("mean_w"), F.count("*").alias("n"))


def mean_in_range(weights: DataFrame, lo: int = 216, hi: int = DAY_SLOTS,
                  keys=("sample_id", "layer", "head"), empty: float | None = 0.0) -> DataFrame:
    """Mean weight over reading positions in [lo, hi) (Q10 for empty ranges)."""
    p = with_reading_pos(weights)
    inside = (F.col("pos") >= lo) & (F.col("pos") < hi)
    out = p.groupBy(*keys).agg(F.avg(F.when(inside, F.col("w"))).alias("mean_w"))
    if empty is not None:
        out = out.withColumn("mean_w", F.coalesce(F.col("mean_w"), F.lit(float(empty))))
    return out


def stage_embedding_mean(token_vecs: DataFrame, intervals: DataFrame, vec: str = "vec",
                         sample: str = "sample_id", tpos: str = "tpos") -> DataFrame:
    """Mean token vector inside a stage: token positions [s + 1, e + 1) (<cls> shift).

    ``token_vecs`` holds one array per token (sample, tpos, vec); result (sample, stage, vec
    ARRAY<DOUBLE>). A token meets its sample's intervals once, whatever its width, and vectors
    are summed as a whole.
    """
    iv = intervals.select(sample, "stage", (F.col("lo") + 1).alias("lo"), (F.col("hi") + 1).alias("hi"))
    j = segment_join(token_vecs.filter(F.col(vec).isNotNull()), iv, sample, tpos)
    means = j.groupBy(sample, "stage").agg(Summarizer.mean(array_to_vector(vec)).alias("_m"))
    return means.select(sample, "stage", vector_to_array("_m").alias("vec"))
