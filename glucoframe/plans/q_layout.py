"""Registered queries: flagship, layout (S), projections / filters (P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from glucoframe.functions.glucose import is_missing
from glucoframe.operators import shape, stats
from glucoframe.plans.registry import query
from glucoframe.sources import bindings as B

SHARES = ["share_low", "share_in_range", "share_high"]


# ---- flagship: time in each glucose band per class -------------------------------
@query("band_shares_by_class", """
    SELECT p.types, CAST(count_if(r.value < 70) AS BIGINT) AS n_low,
           CAST(count_if(r.value >= 70 AND r.value < 180) AS BIGINT) AS n_in_range,
           CAST(count_if(r.value >= 180) AS BIGINT) AS n_high, count(*) AS n,
           count_if(r.value < 70) / count(*) AS share_low,
           count_if(r.value >= 70 AND r.value < 180) / count(*) AS share_in_range,
           count_if(r.value >= 180) / count(*) AS share_high
    FROM readings r JOIN persons p ON r.person = p.person GROUP BY p.types""",
       views=("readings", "persons"), round_cols=SHARES)
def band_shares_by_class(spark, sf_dir):
    """A1 by class: band counts pre-aggregated per person (partial aggregation, so a very
    active person is reduced map-side), joined to the per-person label table, rolled up."""
    rd = B.readings(spark, sf_dir)
    per_person = stats.band_counts(rd, by="person").select("person", "n_low", "n_in_range", "n_high", "n")
    lab = B.persons(spark, sf_dir).select("person", "types")
    return stats.combine_band_counts(per_person.join(lab, "person"), by="types")


# ---- S3 / S4 / S5 / S7 --------------------------------------------------------------
@query("to_array", """
    SELECT sample_id, 288 AS n_slots, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS filled_pos,
           sum(value) AS sum_value
    FROM readings GROUP BY sample_id""", views=("readings",), round_cols=["sum_value"])
def q_to_array(spark, sf_dir):
    """Readings -> one 288-slot array per person-day (gaps null); digest per sample."""
    arr = shape.to_array(B.readings(spark, sf_dir), "sample_id")
    present = F.filter("input_ids", lambda x: ~is_missing(x))
    return arr.select("sample_id", F.size("input_ids").alias("n_slots"),
                      shape.filled_positions("input_ids", 288).alias("filled_pos"),
                      F.aggregate(present, F.lit(0.0), lambda a, x: a + x).alias("sum_value"))


@query("to_long", "SELECT sample_id, pos, value FROM readings", views=("readings",),
       round_cols=["value"])
def q_to_long(spark, sf_dir):
    """S3: array form back to one row per reading (round trip of S4)."""
    arr = shape.to_array(B.readings(spark, sf_dir), "sample_id")
    return shape.to_long(arr, "sample_id").select("sample_id", F.col("pos").cast("int"), "value")


@query("unpivot_slots", "SELECT sample_id, pos, value FROM readings", views=("readings",),
       round_cols=["value"])
def q_unpivot_slots(spark, sf_dir):
    """A wide day matrix (one column per slot, built by pivot) melted back to long."""
    rd = B.readings(spark, sf_dir)
    slots = [f"s{i}" for i in range(288)]
    wide = (rd.withColumn("slot", F.concat(F.lit("s"), F.col("pos").cast("string")))
            .groupBy("sample_id").pivot("slot", slots).agg(F.first("value")))
    return shape.unpivot_slots(wide, "sample_id", slots).select(
        "sample_id", F.col("pos").cast("int"), "value")


@query("assemble", """
    SELECT s.sample_id, l.p_id, l.types, l.hba1c, l.filled, count(*) AS n_filled
    FROM readings s JOIN sample_labels l ON s.sample_id = l.sample_id
    GROUP BY ALL""", views=("readings", "sample_labels"), round_cols=["hba1c"])
def q_assemble(spark, sf_dir):
    """Sequences + chosen label columns by key (strict: every sequence has one label row)."""
    arr = shape.to_array(B.readings(spark, sf_dir), "sample_id")
    lab = B.sample_labels(spark, sf_dir)
    j = shape.assemble(arr, lab, "sample_id", ["p_id", "types", "hba1c", "filled"], strict=True)
    return j.select("sample_id", "p_id", "types", "hba1c", "filled",
                    F.size(F.filter("input_ids", lambda x: ~is_missing(x))).cast("long").alias("n_filled"))


@query("concat_sources", """
    SELECT CASE WHEN l.fold = 0 THEN 1 ELSE 0 END AS src, r.sample_id, r.pos, r.value
    FROM readings r JOIN persons l ON r.person = l.person""",
       views=("readings", "persons"), round_cols=["value"])
def q_concat_sources(spark, sf_dir):
    """Train and test parts appended by column name with a source tag."""
    rd = B.readings(spark, sf_dir).join(B.persons(spark, sf_dir).select("person", "fold"), "person")
    train = rd.filter(F.col("fold") != 0).select("sample_id", "pos", "value")
    test = rd.filter(F.col("fold") == 0).select("sample_id", "pos", "value")
    return shape.concat_sources(train, test, tag="src").select(
        F.col("src").cast("int"), "sample_id", "pos", "value")


# ---- P1-P16 ---------------------------------------------------------------------------
@query("rename_label", "SELECT sample_id, hba1c AS label FROM sample_labels",
       views=("sample_labels",), round_cols=["label"])
def q_rename_label(spark, sf_dir):
    """P1 + P2: choose the target column, project the metadata."""
    lab = shape.keep_columns(B.sample_labels(spark, sf_dir), ["sample_id", "hba1c"])
    return shape.rename_label(lab, "hba1c", "label")


@query("drop_missing_target", "SELECT sample_id, hba1c FROM sample_labels WHERE hba1c IS NOT NULL",
       views=("sample_labels",), round_cols=["hba1c"])
def q_drop_missing_target(spark, sf_dir):
    """Drop null / NaN targets."""
    lab = B.sample_labels(spark, sf_dir).select("sample_id", "hba1c")
    return shape.drop_missing_target(lab, "hba1c")


@query("range_filter", "SELECT sample_id, hba1c FROM sample_labels WHERE hba1c BETWEEN 5.2 AND 6.2",
       views=("sample_labels",), round_cols=["hba1c"])
def q_range_filter(spark, sf_dir):
    """Keep targets inside a range."""
    lab = B.sample_labels(spark, sf_dir).select("sample_id", "hba1c")
    return shape.range_filter(lab, "hba1c", 5.2, 6.2)


@query("null_outside", """
    SELECT id, CASE WHEN HOMA_B BETWEEN 0 AND 400 THEN HOMA_B END AS HOMA_B,
           CASE WHEN HOMA_IS BETWEEN 0.2 AND 5 THEN HOMA_IS END AS HOMA_IS
    FROM clinical""", views=("clinical",), round_cols=["HOMA_B", "HOMA_IS"])
def q_null_outside(spark, sf_dir):
    """P5: out-of-range clinical values become null (HOMA-B 0..400, HOMA-IS 0.2..5)."""
    c = B.clinical(spark, sf_dir).select("id", "HOMA_B", "HOMA_IS")
    c = shape.null_outside(c, "HOMA_B", 0, 400)
    return shape.null_outside(c, "HOMA_IS", 0.2, 5)


@query("filter_by_values", """
    SELECT sample_id, p_id, types FROM sample_labels WHERE types IN ('NGT', 'T2D') AND filled = false""",
       views=("sample_labels",))
def q_filter_by_values(spark, sf_dir):
    """Keep rows whose columns are in given lists (a scalar is promoted to a list)."""
    lab = B.sample_labels(spark, sf_dir)
    return shape.filter_by_values(lab, {"types": ["NGT", "T2D"], "filled": False}).select(
        "sample_id", "p_id", "types")


@query("lookup", "SELECT sample_id, pos, value FROM readings WHERE person = 8",
       views=("readings",), round_cols=["value"])
def q_lookup(spark, sf_dir):
    """Rows of one key (all readings of person 8); the filter reaches the scan."""
    return shape.lookup(B.readings(spark, sf_dir), "person", 8).select("sample_id", "pos", "value")


@query("has_low", """
    SELECT sample_id, bool_or(value < 70) AS has_low, bool_or(value <= 70) AS has_low_incl
    FROM readings GROUP BY sample_id""", views=("readings",))
def q_has_low(spark, sf_dir):
    """Samples with a reading under 70 (strict and inclusive, Q2), array form."""
    arr = shape.to_array(B.readings(spark, sf_dir), "sample_id")
    return arr.select("sample_id", shape.has_low("input_ids").alias("has_low"),
                      shape.has_low("input_ids", inclusive=True).alias("has_low_incl"))


@query("drop_cluster", "SELECT vec_id, cluster FROM vectors WHERE is_ref AND cluster <> 'C0'",
       views=("vectors",))
def q_drop_cluster(spark, sf_dir):
    """Remove one reference cluster before matching."""
    v = B.vectors(spark, sf_dir).filter("is_ref").select("vec_id", "cluster")
    return shape.drop_cluster(v, "C0")


@query("merge_classes", """
    SELECT doc_id, CASE WHEN y_true = 2 THEN 1 ELSE y_true END AS y FROM predictions""",
       views=("predictions",))
def q_merge_classes(spark, sf_dir):
    """P10: class 2 -> 1 for a binary task."""
    p = B.predictions(spark, sf_dir)
    return p.select("doc_id", shape.merge_classes("y_true", {2: 1}).cast("int").alias("y"))


@query("add_scaled_target", """
    SELECT sample_id, hba1c, hba1c AS label,
           (hba1c - avg(hba1c) OVER ()) / stddev_pop(hba1c) OVER () AS label_std
    FROM sample_labels""", views=("sample_labels",), round_cols=["hba1c", "label", "label_std"])
def q_add_scaled_target(spark, sf_dir):
    """Copy of the target, and a standardised copy (one-row aggregate, broadcast)."""
    lab = B.sample_labels(spark, sf_dir).select("sample_id", "hba1c")
    out = shape.add_scaled_target(lab, "hba1c")
    return shape.add_scaled_target(out, "hba1c", "label_std", standardise=True)


@query("course_from_type", """
    SELECT id, split_part(id, '_', 2) AS type,
           CAST(CASE split_part(id, '_', 2) WHEN 'NGT' THEN 0.0 WHEN 'IGR' THEN 0.5
                WHEN 'T2D' THEN 1.0 WHEN 'T1D' THEN 1.0 END AS DOUBLE) AS course
    FROM clinical""", views=("clinical",), round_cols=["course"])
def q_course_from_type(spark, sf_dir):
    """Class from the second '_' part of the id, then its course value."""
    c = B.clinical(spark, sf_dir).select("id")
    t = shape.type_from_id("id")
    return c.select("id", t.alias("type"), shape.course_from_type(t).cast("double").alias("course"))


@query("fill_absent_columns", """
    SELECT id, fpg, 0 AS ins0, 0 AS cp120 FROM clinical""", views=("clinical",), round_cols=["fpg"])
def q_fill_absent_columns(spark, sf_dir):
    """Absent target columns are added with 0 (Q13)."""
    c = B.clinical(spark, sf_dir).select("id", "fpg")
    return shape.fill_absent_columns(c, ["fpg", "ins0", "cp120"], 0)


@query("wear_days_bmi", """
    SELECT id, RecordNum * TimeGap / 1440.0 AS RecordDay, wt / (ht * ht) AS bmi FROM clinical""",
       views=("clinical",), round_cols=["RecordDay", "bmi"])
def q_wear_days_bmi(spark, sf_dir):
    """P14 + P15: recorded days from readings x gap; BMI from weight and height."""
    c = B.clinical(spark, sf_dir)
    return c.select("id", shape.wear_days("RecordNum", "TimeGap").alias("RecordDay"),
                    shape.bmi("wt", "ht").alias("bmi"))


@query("compose_parse_id", """
    SELECT id, 'CohortB_' || type || '_' || replace(CAST(Rawid AS VARCHAR) || '_x', '_', '') AS new_id,
           split_part(id, '_', 1) AS cohort, split_part(id, '_', 2) AS type, split_part(id, '_', 3) AS raw
    FROM clinical""", views=("clinical",))
def q_compose_parse_id(spark, sf_dir):
    """Compose '<cohort>_<type>_<raw>' (raw id stripped of '_') and parse it back."""
    c = B.clinical(spark, sf_dir)
    raw = F.concat(F.col("Rawid").cast("string"), F.lit("_x"))
    parts = shape.parse_id("id")
    return c.select("id", shape.compose_id("CohortB", F.col("type"), raw, strip=True).alias("new_id"),
                    parts["cohort"].alias("cohort"), parts["type"].alias("type"),
                    parts["raw"].alias("raw"))
