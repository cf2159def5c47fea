"""Registered queries: streaming twins (T1-T5) and sources / sinks round trips.

Streaming queries run with ``availableNow`` over the events file and return the
parquet sink as a batch frame; their oracles are the batch twins restricted to
windows the watermark has closed (max event time - 1 hour).
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from glucoframe.functions.hashing import u, u_sql
from glucoframe.operators import metrics as K
from glucoframe.plans.q_encode import tok_sql
from glucoframe.plans.registry import query
from glucoframe.session import ensure_checkpoint_dir
from glucoframe.sources import bindings as B
from glucoframe.sources import io as IO
from glucoframe.streaming import streams as T

_TS = "'%Y-%m-%d %H:%M:%S'"
_TSU = "'%Y-%m-%d %H:%M:%S.%f'"


def _fmt(c, micros=False):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS" if micros else "yyyy-MM-dd HH:mm:ss")


@query("stream_encode", f"""
    SELECT event_id, user_id AS person, CAST(hour(ts) * 12 + minute(ts) // 5 AS INTEGER) AS slot,
           {tok_sql('value')} AS token FROM events""")
def q_stream_encode(spark, sf_dir):
    """Stateless encoding of the reading stream (equals E1+E3+E4 in batch)."""
    out, _ = T.run_available_now(T.stream_encode(T.event_stream(spark, sf_dir)), "encode")
    return out


@query("stream_band_shares", f"""
    WITH mx AS (SELECT max(ts) - INTERVAL 1 HOUR AS wm FROM events)
    SELECT user_id AS person, strftime(date_trunc('day', ts), {_TS}) AS start,
           strftime(date_trunc('day', ts) + INTERVAL 1 DAY, {_TS}) AS "end",
           CAST(count_if(value < 70) AS BIGINT) AS n_low,
           CAST(count_if(value >= 70 AND value < 180) AS BIGINT) AS n_in_range,
           CAST(count_if(value >= 180) AS BIGINT) AS n_high, count(*) AS n
    FROM events, mx GROUP BY user_id, date_trunc('day', ts), wm
    HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= wm""")
def q_stream_band_shares(spark, sf_dir):
    """Band counts per person-day, emitted as each day closes (watermark 1 hour)."""
    out, _ = T.run_available_now(T.stream_band_shares(T.event_stream(spark, sf_dir)), "bands")
    return out.select("person", _fmt("start").alias("start"), _fmt("end").alias("end"),
                      "n_low", "n_in_range", "n_high", "n")


@query("stream_rolling_low", f"""
    WITH mx AS (SELECT max(ts) - INTERVAL 1 HOUR AS wm FROM events),
    w AS (SELECT user_id AS person, value, time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE AS start
          FROM events, (SELECT unnest([0, 1]) AS k) ks)
    SELECT person, strftime(start, {_TS}) AS start, strftime(start + INTERVAL 1 HOUR, {_TS}) AS "end",
           count(*) AS n, avg(CAST(value <= 70 AS DOUBLE)) AS low_share
    FROM w, mx GROUP BY person, w.start, wm HAVING w.start + INTERVAL 1 HOUR <= wm""",
       round_cols=["low_share"])
def q_stream_rolling_low(spark, sf_dir):
    """Share of readings <= 70 in 1-hour windows sliding by 30 minutes."""
    out, _ = T.run_available_now(T.stream_rolling_low(T.event_stream(spark, sf_dir)), "rolling")
    return out.select("person", _fmt("start").alias("start"), _fmt("end").alias("end"), "n", "low_share")


@query("stream_sessions", f"""
    WITH mx AS (SELECT max(ts) - INTERVAL 1 HOUR AS wm FROM events),
    e AS (SELECT user_id AS person, ts, value,
                 CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS brk
          FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(brk) OVER (PARTITION BY person ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM e),
    g AS (SELECT person, min(ts) AS st, max(ts) + INTERVAL 30 MINUTE AS en, count(*) AS n, avg(value) AS mean_value
          FROM s GROUP BY person, sid)
    SELECT person, strftime(st, {_TSU}) AS start, strftime(en, {_TSU}) AS "end", n, mean_value
    FROM g, mx WHERE en <= wm""", round_cols=["mean_value"])
def q_stream_sessions(spark, sf_dir):
    """T4: wear sessions split by 30-minute gaps (session windows, watermark 1 hour)."""
    out, _ = T.run_available_now(T.stream_sessions(T.event_stream(spark, sf_dir)), "sessions")
    return out.select("person", _fmt("start", True).alias("start"), _fmt("end", True).alias("end"),
                      "n", "mean_value")


@query("stream_wear_sessions", f"""
    WITH mx AS (SELECT max(ts) - INTERVAL 1 HOUR AS wm FROM events),
    e AS (SELECT user_id AS person, ts, value,
                 CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS brk
          FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(brk) OVER (PARTITION BY person ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM e),
    g AS (SELECT person, min(ts) AS st, max(ts) + INTERVAL 30 MINUTE AS en, count(*) AS n, avg(value) AS mean_value,
                 CAST(count_if(value <= 70) AS BIGINT) AS n_low
          FROM s GROUP BY person, sid)
    SELECT person, strftime(st, {_TSU}) AS start, strftime(en, {_TSU}) AS "end", n, mean_value, n_low
    FROM g, mx WHERE en <= wm""", round_cols=["mean_value"])
def q_stream_wear_sessions(spark, sf_dir):
    """T4 with own state (transformWithState, event-time timers, RocksDB): wear periods and low readings."""
    out, _ = T.run_available_now(T.stream_wear_sessions(T.event_stream(spark, sf_dir)), "wear", sink="batches")
    return out.select("person", _fmt("start", True).alias("start"), _fmt("end", True).alias("end"), "n", "mean_value", "n_low")


@query("stream_meal_features", """
    SELECT m.event_id AS meal_id, m.user_id AS person, r.event_id AS reading_id, r.value,
           (epoch(r.ts) - epoch(m.ts)) / 60.0 AS offset_min
    FROM events m JOIN events r ON m.user_id = r.user_id AND r.event_type <> 'purchase'
      AND r.ts >= m.ts - INTERVAL 20 MINUTE AND r.ts <= m.ts + INTERVAL 40 MINUTE
    WHERE m.event_type = 'purchase'""", round_cols=["value", "offset_min"])
def q_stream_meal_features(spark, sf_dir):
    """T5: readings from 20 minutes before to 40 minutes after each meal (stream-stream join)."""
    s_meals = T.event_stream(spark, sf_dir).filter(F.col("event_type") == "purchase")
    s_read = T.event_stream(spark, sf_dir).filter(F.col("event_type") != "purchase")
    out, _ = T.run_available_now(T.stream_meal_features(s_meals, s_read), "mealjoin")
    return out


# ---- sources and sinks -------------------------------------------------------------------------------
def _scratch(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/io/{name}-{uuid.uuid4().hex}"


@query("io_day_matrix", "SELECT sample_id, pos, value FROM readings", views=("readings",), round_cols=["value"])
def q_io_day_matrix(spark, sf_dir):
    """Readings written as a wide 288-slot CSV and read back with an explicit schema."""
    path = _scratch(spark, "daymatrix")
    IO.write_day_matrix(B.readings(spark, sf_dir), path)
    return IO.read_day_matrix(spark, path, key="sample_id").select(
        "sample_id", F.col("pos").cast("int"), "value")


@query("io_labels", "SELECT sample_id, p_id, types, hba1c, filled, fold FROM sample_labels",
       views=("sample_labels",), round_cols=["hba1c"])
def q_io_labels(spark, sf_dir):
    """Label table through CSV; the file has its columns in another order than the schema."""
    path = _scratch(spark, "labels")
    shuffled = B.sample_labels(spark, sf_dir).select("fold", "hba1c", "sample_id", "filled", "types", "p_id")
    shuffled.write.option("header", True).csv(path)
    schema = "sample_id string, p_id long, types string, hba1c double, filled boolean, fold int"
    return IO.read_labels(spark, path, schema)


@query("io_save_load", """
    SELECT r.sample_id, r.pos, r.value, p.fold FROM readings r JOIN persons p ON r.person = p.person""",
       views=("readings", "persons"), round_cols=["value"])
def q_io_save_load(spark, sf_dir):
    """A training table saved partitioned by fold, and all folds loaded again."""
    path = _scratch(spark, "saved")
    rd = B.readings(spark, sf_dir).join(B.persons(spark, sf_dir).select("person", "fold"), "person")
    IO.save(rd, path, partition_by=["fold"])
    return IO.load(spark, path).select("sample_id", "pos", "value", "fold")


@query("io_metrics", f"""
    WITH pr AS (SELECT *, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS y_pred FROM predictions),
    s AS (SELECT *, CASE WHEN {u_sql(80, 'doc_id')} < 0.5
                     THEN 'eval' ELSE 'test' END AS split FROM pr),
    m AS (SELECT 0 AS run, split, 'accuracy' AS metric, avg(CAST(y_true = y_pred AS DOUBLE)) AS value FROM s GROUP BY split
          UNION ALL SELECT 1, split, 'accuracy', avg(CAST(least(y_true, 1) = least(y_pred, 1) AS DOUBLE)) FROM s
                    WHERE split = 'eval' GROUP BY split)
    SELECT split || '_' || metric AS name, max_by(value, run) AS value, max(run) AS run FROM m GROUP BY 1""",
       views=("predictions",), round_cols=["value"])
def q_io_metrics(spark, sf_dir):
    """Two runs of metrics appended as JSON; read back and merged (later run wins)."""
    path = _scratch(spark, "metrics")
    p = B.predictions(spark, sf_dir).withColumn("y_pred", K.argmax_prediction("logits"))
    s = p.withColumn("split", F.when(u(80, "doc_id") < 0.5, F.lit("eval")).otherwise(F.lit("test")))
    r0 = s.groupBy("split").agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("value"))
    IO.write_metrics(r0.select(F.lit(0).cast("long").alias("run"), "split", F.lit("accuracy").alias("metric"),
                               "value"), path)
    r1 = s.filter("split = 'eval'").groupBy("split").agg(
        F.avg((F.least("y_true", F.lit(1)) == F.least("y_pred", F.lit(1))).cast("double")).alias("value"))
    IO.write_metrics(r1.select(F.lit(1).cast("long").alias("run"), "split", F.lit("accuracy").alias("metric"),
                               "value"), path)
    out = K.merge_metrics(IO.read_metrics(spark, path))
    return out.select("name", "value", F.col("run").cast("int").alias("run"))


@query("io_embeddings", """
    SELECT vec_id, label, CAST(i - 1 AS INTEGER) AS dim, vec[i] AS x FROM vectors, range(1, 65) AS r(i)""",
       views=("vectors",), round_cols=["x"])
def q_io_embeddings(spark, sf_dir):
    """Embeddings with labels written as d0..d63 CSV columns and read back."""
    path = _scratch(spark, "emb")
    v = B.vectors(spark, sf_dir)
    IO.write_embeddings(v, path, ["vec_id", "label"], 64)
    back = IO.read_embeddings(spark, path, [("vec_id", "long"), ("label", "int")], 64)
    return back.select("vec_id", "label", F.posexplode("vec").alias("dim", "x"))


@query("io_gene_counts", "SELECT cell, gene, n FROM gene_counts", views=("gene_counts",), round_cols=["n"])
def q_io_gene_counts(spark, sf_dir):
    """Count triples written as a directory of parquet files and read back as one table."""
    path = _scratch(spark, "genes")
    B.gene_counts(spark, sf_dir).write.parquet(path)
    return IO.read_gene_counts(spark, path)
