"""Registered queries: segments (J4, J5) and attention-weight averages."""

from __future__ import annotations

from pyspark.sql import functions as F

from glucoframe.functions.hashing import u, u_sql
from glucoframe.operators import segments as S
from glucoframe.plans.registry import query
from glucoframe.sources import bindings as B


def _weights(spark, sf_dir):
    return B.attention_weights(B.readings(spark, sf_dir), parts=B.sample_parts(spark, sf_dir))


def _intervals(spark, sf_dir):
    return S.stage_intervals(B.time_split(spark, sf_dir))


@query("stage_intervals", "SELECT sample_id, stage, seg, lo, hi FROM stage_intervals",
       views=("stage_intervals",))
def q_stage_intervals(spark, sf_dir):
    """Dawn / fasting / before-meal / after-meal intervals from the time split (Q8, Q9)."""
    return _intervals(spark, sf_dir)


@query("segment_join", """
    SELECT r.sample_id, i.stage, i.seg, r.pos, r.value
    FROM readings r JOIN stage_intervals i ON r.sample_id = i.sample_id AND r.pos >= i.lo AND r.pos < i.hi""",
       views=("readings", "stage_intervals"), round_cols=["value"])
def q_segment_join(spark, sf_dir):
    """Readings inside each stage interval of their sample (equi-join + range predicate)."""
    j = S.segment_join(B.readings(spark, sf_dir), _intervals(spark, sf_dir))
    return j.select("sample_id", "stage", "seg", "pos", "value")


@query("attention_received", f"""
    SELECT sample_id, layer, head, tpos,
           avg({u_sql(12, 'sample_id', 'tpos', 'layer', 'head', 'q')}) AS w
    FROM weights, (SELECT range AS q FROM range(3)) qs GROUP BY 1, 2, 3, 4""",
       views=("weights",), round_cols=["w"])
def q_attention_received(spark, sf_dir):
    """Raw weights with a query axis (3 queries) averaged over that axis."""
    w = _weights(spark, sf_dir).drop("w")
    raw = w.select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("q"))
    raw = raw.withColumn("w", u(12, "sample_id", "tpos", "layer", "head", "q"))
    return S.attention_received(raw)


@query("cls_vs_rest", """
    SELECT sample_id, layer, head, avg(CASE WHEN tpos = 0 THEN w END) AS cls_w,
           avg(CASE WHEN tpos > 0 THEN w END) AS rest_w
    FROM weights GROUP BY 1, 2, 3""", views=("weights",), round_cols=["cls_w", "rest_w"])
def q_cls_vs_rest(spark, sf_dir):
    """Weight on <cls> versus mean weight of the other positions."""
    return S.cls_vs_rest(_weights(spark, sf_dir))


@query("mean_where_value", """
    SELECT w.sample_id, w.layer, w.head, coalesce(avg(CASE WHEN r.value < 70 THEN w.w END), 0.0) AS mean_w
    FROM weights w LEFT JOIN readings r ON r.sample_id = w.sample_id AND r.pos = w.tpos - 1
    WHERE w.tpos > 0 GROUP BY 1, 2, 3""", views=("weights", "readings"), round_cols=["mean_w"])
def q_mean_where_value(spark, sf_dir):
    """Mean weight over positions whose reading is < 70 (<cls> shift; empty -> 0, Q10)."""
    return S.mean_where_value(_weights(spark, sf_dir), B.readings(spark, sf_dir))


@query("mean_by_state", """
    SELECT w.sample_id, w.layer, w.head, s.state, avg(w.w) AS mean_w, count(*) AS n
    FROM weights w JOIN slot_states s ON s.sample_id = w.sample_id AND s.pos = w.tpos - 1
    WHERE w.tpos > 0 GROUP BY 1, 2, 3, 4""", views=("weights", "slot_states"), round_cols=["mean_w"])
def q_mean_by_state(spark, sf_dir):
    """Mean weight per slot state N / Up / Down (all three, Q12)."""
    rd = B.readings(spark, sf_dir)
    return S.mean_by_state(B.attention_weights(rd, parts=B.sample_parts(spark, sf_dir)), B.slot_states(rd))


@query("mean_in_range", """
    SELECT sample_id, layer, head,
           coalesce(avg(CASE WHEN tpos - 1 >= 216 AND tpos - 1 < 288 THEN w END), 0.0) AS mean_w
    FROM weights WHERE tpos > 0 GROUP BY 1, 2, 3""", views=("weights",), round_cols=["mean_w"])
def q_mean_in_range(spark, sf_dir):
    """Mean weight over slots 216..287 (the evening), empty -> 0."""
    return S.mean_in_range(_weights(spark, sf_dir), 216, 288)


_SEG_WEIGHTS_SQL = """
    WITH wr AS (SELECT sample_id, layer, head, tpos - 1 AS pos, w FROM weights WHERE tpos > 0),
    hits AS (SELECT wr.sample_id, layer, head, stage, avg(w) AS mean
             FROM wr JOIN stage_intervals i ON wr.sample_id = i.sample_id AND wr.pos >= i.lo AND wr.pos < i.hi
             GROUP BY 1, 2, 3, 4),
    frame AS (SELECT g.sample_id, g.layer, g.head, s.stage
              FROM (SELECT DISTINCT sample_id, layer, head FROM wr) g
              JOIN (SELECT DISTINCT sample_id, stage FROM stage_intervals) s ON g.sample_id = s.sample_id)
    SELECT f.sample_id, f.layer, f.head, f.stage, coalesce(h.mean, 0.0) AS mean
    FROM frame f LEFT JOIN hits h ON f.sample_id = h.sample_id AND f.layer = h.layer AND f.head = h.head
      AND f.stage = h.stage"""


@query("mean_in_segment_weights", _SEG_WEIGHTS_SQL, views=("weights", "stage_intervals"),
       round_cols=["mean"])
def q_mean_in_segment_weights(spark, sf_dir):
    """A18 on attention weights: mean per (sample, layer, head, stage); empty stage -> 0."""
    wr = S.with_reading_pos(_weights(spark, sf_dir))
    out = S.mean_in_segment(wr, _intervals(spark, sf_dir), "w", group=["layer", "head"])
    return out.select("sample_id", "layer", "head", "stage", "mean")


@query("mean_in_segment_readings", """
    WITH hits AS (SELECT r.sample_id, stage, avg(value) AS mean
                  FROM readings r JOIN stage_intervals i ON r.sample_id = i.sample_id AND r.pos >= i.lo AND r.pos < i.hi
                  GROUP BY 1, 2),
    frame AS (SELECT DISTINCT s.sample_id, s.stage FROM stage_intervals s
              WHERE s.sample_id IN (SELECT sample_id FROM readings))
    SELECT f.sample_id, f.stage, coalesce(h.mean, 0.0) AS mean
    FROM frame f LEFT JOIN hits h ON f.sample_id = h.sample_id AND f.stage = h.stage""",
       views=("readings", "stage_intervals"), round_cols=["mean"])
def q_mean_in_segment_readings(spark, sf_dir):
    """A18 on readings: mean glucose per (sample, stage); empty stage -> 0."""
    rd = B.readings(spark, sf_dir).repartition(B.sample_parts(spark, sf_dir), "sample_id")
    out = S.mean_in_segment(rd, _intervals(spark, sf_dir), "value")
    return out.select("sample_id", "stage", "mean")


@query("stage_embedding_mean", f"""
    WITH tv AS (SELECT sample_id, tpos, d AS dim, {u_sql(13, 'sample_id', 'tpos', 'd')} AS x
                FROM (SELECT sample_id, tpos FROM weights WHERE layer = 0 AND head = 0) p,
                     (SELECT CAST(range AS INTEGER) AS d FROM range(4)) ds)
    SELECT tv.sample_id, i.stage, tv.dim, avg(x) AS m
    FROM tv JOIN stage_intervals i ON tv.sample_id = i.sample_id AND tv.tpos >= i.lo + 1 AND tv.tpos < i.hi + 1
    GROUP BY 1, 2, 3""", views=("weights", "stage_intervals"), round_cols=["m"])
def q_stage_embedding_mean(spark, sf_dir):
    """Mean 4-d token vector inside each stage (token positions shifted by <cls>)."""
    tokens = B.token_vectors(B.readings(spark, sf_dir), parts=B.sample_parts(spark, sf_dir))
    vec = S.stage_embedding_mean(tokens, _intervals(spark, sf_dir))
    return vec.select("sample_id", "stage", F.posexplode("vec").alias("dim", "m"))
