"""Registered queries: clinical scaling and objectives (A25-A30, K15), meals and what-if
tables (D1-D7, X9, K14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from glucoframe.functions.hashing import u, u_sql
from glucoframe.operators import clinical as C
from glucoframe.operators import meals as D
from glucoframe.operators import metrics as K
from glucoframe.operators import shape
from glucoframe.plans.registry import query
from glucoframe.sources import bindings as B

TARGETS = ["fpg", "hba1c", "tg"]


def _mm_sql(cols, src="clinical", fit_where="TRUE"):
    b = ", ".join(f"min({c}) AS mn_{c}, max({c}) AS mx_{c}" for c in cols)
    sel = ", ".join(f"CASE WHEN mx_{c} - mn_{c} = 0 THEN NULL ELSE ({c} - mn_{c}) / (mx_{c} - mn_{c}) END AS {c}"
                    for c in cols)
    return b, sel


# ---- A25-A30, K15 ---------------------------------------------------------------------------
@query("minmax", """
    WITH c AS (SELECT id, fpg, hba1c, tg, 0 AS ins0 FROM clinical),
    b AS (SELECT min(fpg) AS a1, max(fpg) AS b1, min(hba1c) AS a2, max(hba1c) AS b2, min(tg) AS a3, max(tg) AS b3,
                 min(ins0) AS a4, max(ins0) AS b4 FROM c)
    SELECT id, (fpg - a1) / (b1 - a1) AS fpg, (hba1c - a2) / (b2 - a2) AS hba1c, (tg - a3) / (b3 - a3) AS tg,
           CASE WHEN b4 - a4 = 0 THEN NULL ELSE CAST((ins0 - a4) / (b4 - a4) AS DOUBLE) END AS ins0
    FROM c, b""", views=("clinical",), round_cols=["fpg", "hba1c", "tg", "ins0"])
def q_minmax(spark, sf_dir):
    """A25 (+P13, Q13): per-column min-max; an absent column filled with 0 scales to null."""
    c = shape.fill_absent_columns(B.clinical(spark, sf_dir).select("id", *TARGETS), ["ins0"], 0)
    return C.minmax(c, [*TARGETS, "ins0"]).select("id", *TARGETS, F.col("ins0").cast("double"))


@query("minmax_fit_apply", f"""
    WITH fit AS (SELECT * FROM clinical WHERE {u_sql(70, 'Rawid')} < 0.8),
    b AS (SELECT min(fpg) AS a1, max(fpg) AS b1, min(hba1c) AS a2, max(hba1c) AS b2 FROM fit)
    SELECT id, (fpg - a1) / (b1 - a1) AS fpg, (hba1c - a2) / (b2 - a2) AS hba1c
    FROM clinical, b WHERE {u_sql(70, 'Rawid')} >= 0.8""", views=("clinical",), round_cols=["fpg", "hba1c"])
def q_minmax_fit_apply(spark, sf_dir):
    """Scale the held-out rows with the bounds of the training rows."""
    c = B.clinical(spark, sf_dir).withColumn("_u", u(70, "Rawid"))
    fit, rest = c.filter("_u < 0.8"), c.filter("_u >= 0.8").select("id", "fpg", "hba1c")
    return C.minmax_fit_apply(fit, rest, ["fpg", "hba1c"])


@query("homa_ir", """
    SELECT id, h AS HOMA_IS, 1.0 / h AS HOMA_IR
    FROM (SELECT id, CASE WHEN HOMA_IS BETWEEN 0.2 AND 5 THEN HOMA_IS END AS h FROM clinical) c""",
       views=("clinical",), round_cols=["HOMA_IS", "HOMA_IR"])
def q_homa_ir(spark, sf_dir):
    """HOMA-IR = 1 / HOMA-IS after the 0.2..5 range cleaning."""
    c = shape.null_outside(B.clinical(spark, sf_dir).select("id", "HOMA_IS"), "HOMA_IS", 0.2, 5)
    return C.homa_ir(c)


def _objective_frame(spark, sf_dir):
    c = B.clinical(spark, sf_dir)
    c = c.withColumn("course", shape.course_from_type(shape.type_from_id("id")))
    c = C.minmax(c, TARGETS)
    for i, t in enumerate(TARGETS):
        c = c.withColumn(f"p_{t}", u(42 + i, "Rawid"))
    return c


@query("masked_weighted_mse", f"""
    WITH c AS (SELECT *, CASE split_part(id, '_', 2) WHEN 'NGT' THEN 0.0 WHEN 'IGR' THEN 0.5 ELSE 1.0 END AS course
               FROM clinical),
    b AS (SELECT min(fpg) AS a1, max(fpg) AS b1, min(hba1c) AS a2, max(hba1c) AS b2, min(tg) AS a3, max(tg) AS b3 FROM c),
    s AS (SELECT course, C, (fpg - a1) / (b1 - a1) AS fpg, (hba1c - a2) / (b2 - a2) AS hba1c, (tg - a3) / (b3 - a3) AS tg,
                 {u_sql(42, 'Rawid')} AS p1, {u_sql(43, 'Rawid')} AS p2, {u_sql(44, 'Rawid')} AS p3 FROM c, b),
    l AS (SELECT 0.4 AS w, course AS y, C AS p FROM s
          UNION ALL SELECT 0.2, fpg, p1 FROM s UNION ALL SELECT 0.2, hba1c, p2 FROM s
          UNION ALL SELECT 0.2, tg, p3 FROM s)
    SELECT sum(CASE WHEN y IS NOT NULL THEN w * (p - y) * (p - y) END) / count(y) AS loss, count(y) AS n_present FROM l""",
       views=("clinical",), round_cols=["loss"])
def q_masked_weighted_mse(spark, sf_dir):
    """Weighted squared error over present targets (course 0.4, others 0.6 / 3)."""
    c = _objective_frame(spark, sf_dir)
    return C.masked_weighted_mse(c, "id", ["course", *TARGETS], ["C", *[f"p_{t}" for t in TARGETS]])


@query("course_ordering_score", """
    WITH c AS (SELECT C AS s, CASE split_part(id, '_', 2) WHEN 'NGT' THEN 0.0 WHEN 'IGR' THEN 0.5 ELSE 1.0 END AS course
               FROM clinical),
    g1 AS (SELECT avg(b.s - a.s) AS gap FROM c a JOIN c b ON a.course = 0.0 AND b.course = 0.5),
    g2 AS (SELECT avg(b.s - a.s) AS gap FROM c a JOIN c b ON a.course = 0.5 AND b.course = 1.0)
    SELECT g1.gap AS gap_0_05, g2.gap AS gap_05_1, (1 - g1.gap) + (1 - g2.gap) AS loss FROM g1, g2""",
       views=("clinical",), round_cols=["gap_0_05", "gap_05_1", "loss"])
def q_course_ordering_score(spark, sf_dir):
    """Ordering loss of the score between course groups (oracle: brute-force pairs)."""
    c = B.clinical(spark, sf_dir)
    c = c.select(F.col("C").alias("score"), shape.course_from_type(shape.type_from_id("id")).alias("course"))
    return C.course_ordering_score(c)


@query("target_correlation", """
    SELECT 'fpg' AS target, corr(C, fpg) AS corr, count(fpg) AS n FROM clinical
    UNION ALL SELECT 'hba1c', corr(C, hba1c), count(hba1c) FROM clinical
    UNION ALL SELECT 'tg', corr(C, tg), count(tg) FROM clinical
    UNION ALL SELECT 'wt', corr(C, wt), count(wt) FROM clinical""", views=("clinical",), round_cols=["corr"])
def q_target_correlation(spark, sf_dir):
    """Correlation of the severity score with each clinical target."""
    return C.target_correlation(B.clinical(spark, sf_dir), "C", [*TARGETS, "wt"])


# ---- D1-D7, X9, K14 ----------------------------------------------------------------------------
_MEALS_SQL = """
    m AS (SELECT event_id AS meal_id, person, rank FROM event_series WHERE event_type = 'purchase'),
    o AS (SELECT unnest([-4, -3, -2, -1, 1, 2, 3, 4, 5, 6, 7, 8]) AS off),
    f AS (SELECT m.meal_id, CASE WHEN off < 0 THEN 'pre' ELSE 'post' END AS phase,
                 CAST(CASE WHEN off < 0 THEN off + 4 ELSE off - 1 END AS INTEGER) AS k, s.value
          FROM m CROSS JOIN o JOIN event_series s ON s.person = m.person AND s.rank = m.rank + o.off)"""


def _features(spark, sf_dir):
    s = B.event_series(spark, sf_dir)
    meals = s.filter(F.col("event_type") == "purchase").select(F.col("event_id").alias("meal_id"),
                                                               "person", "rank")
    return D.meal_features(s, meals), s


def _long_features(feat, cols=("pre", "post")):
    out = None
    for ph in cols:
        p = feat.select("meal_id", F.lit(ph).alias("phase"), F.posexplode(ph).alias("k", "value"))
        out = p if out is None else out.unionByName(p)
    return out.filter(F.col("value").isNotNull()).select("meal_id", "phase", F.col("k").cast("int"), "value")


@query("meal_features", f"WITH {_MEALS_SQL} SELECT meal_id, phase, k, value FROM f",
       views=("event_series",), round_cols=["value"])
def q_meal_features(spark, sf_dir):
    """4 readings before and 8 after every meal of a person's series (equi-joins on position)."""
    feat, _ = _features(spark, sf_dir)
    return _long_features(feat)


@query("minmax_global", f"""
    WITH {_MEALS_SQL}, b AS (SELECT min(value) AS mn, max(value) AS mx FROM f)
    SELECT meal_id, phase, k, (value - mn) / (mx - mn) AS value FROM f, b""",
       views=("event_series",), round_cols=["value"])
def q_minmax_global(spark, sf_dir):
    """One min / max over all pre- and post-meal readings; the inverse restores them."""
    feat, _ = _features(spark, sf_dir)
    scaled, _ = C.minmax_global(feat, ["pre", "post"])
    return _long_features(scaled)


@query("horizon_scores", f"""
    WITH {_MEALS_SQL},
    p AS (SELECT meal_id, value AS pred FROM f WHERE phase = 'pre' AND k = 3),
    y AS (SELECT f.k AS h, f.value AS y, p.pred FROM f JOIN p ON f.meal_id = p.meal_id WHERE f.phase = 'post')
    SELECT CAST(h AS INTEGER) AS h, count(*) AS n, avg((y - pred) * (y - pred)) AS mse, corr(y, pred) AS pearson
    FROM y GROUP BY h
    UNION ALL SELECT -1, count(*), avg((y - pred) * (y - pred)), NULL FROM y""",
       views=("event_series",), round_cols=["mse", "pearson"])
def q_horizon_scores(spark, sf_dir):
    """X9 + K14: persistence forecast (last pre-meal reading) scored per horizon step."""
    feat, _ = _features(spark, sf_dir)
    return K.horizon_scores(D.persistence_forecast(feat), "post", "pred")


@query("reallocate_macros", """
    SELECT meal_id, Heat * 4 / 10.0 / 4.0 AS Carbohydrate, Heat * 2 / 10.0 / 4.0 AS Protein,
           Heat * 4 / 10.0 / 9.0 AS Fat FROM nutrients""", views=("nutrients",),
       round_cols=["Carbohydrate", "Protein", "Fat"])
def q_reallocate_macros(spark, sf_dir):
    """Macros reallocated from energy with ratio (4, 2, 4)."""
    return D.reallocate_macros(B.nutrients(spark, sf_dir)).select("meal_id", "Carbohydrate", "Protein", "Fat")


@query("fiber_scenario", """
    SELECT meal_id, Heat * 4 / 10.0 / 4.0 * 0.03 AS fiber_h, Heat * 4 / 10.0 / 4.0 * 0.06 AS fiber_l FROM nutrients""",
       views=("nutrients",), round_cols=["fiber_h", "fiber_l"])
def q_fiber_scenario(spark, sf_dir):
    """D3: fiber = carbohydrate x 0.03 ('H') or x 0.06 ('L') after reallocation (Q7)."""
    n = D.reallocate_macros(B.nutrients(spark, sf_dir))
    h = D.fiber_scenario(n, 0.03).withColumnRenamed("DietaryFiber", "fiber_h")
    return D.fiber_scenario(h, 0.06).select("meal_id", "fiber_h", F.col("DietaryFiber").alias("fiber_l"))


_HIGH_HEAT_SQL = """SELECT meal_id, Heat * 1.2 AS Heat, Heat * 5 / 10.0 / 4.0 * 1.2 AS Carbohydrate,
           Heat * 3 / 10.0 / 9.0 * 1.2 AS Fat, Heat * 2 / 10.0 / 4.0 * 1.2 AS Protein,
           DietaryFiber * 1.2 AS DietaryFiber FROM nutrients"""
NUTR = ["Heat", "Carbohydrate", "Fat", "Protein", "DietaryFiber"]


@query("scale_scenario", _HIGH_HEAT_SQL, views=("nutrients",), round_cols=NUTR)
def q_scale_scenario(spark, sf_dir):
    """High-heat scenario: ratio 5:2:3, then every nutrient x 1.2."""
    return D.scenario(B.nutrients(spark, sf_dir), "HighHeat").select("meal_id", *NUTR)


@query("stack_scenarios", f"""
    WITH o AS (SELECT meal_id, Heat, Carbohydrate, Fat, Protein, DietaryFiber, false AS is_test FROM nutrients),
    s AS (SELECT *, true AS is_test FROM ({_HIGH_HEAT_SQL}) q),
    u AS (SELECT * FROM o UNION ALL SELECT * FROM s),
    b AS (SELECT {', '.join(f'min({c}) AS a_{c}, max({c}) AS b_{c}' for c in NUTR)} FROM o)
    SELECT meal_id, is_test, {', '.join(f'({c} - a_{c}) / (b_{c} - a_{c}) AS {c}' for c in NUTR)} FROM u, b""",
       views=("nutrients",), round_cols=NUTR)
def q_stack_scenarios(spark, sf_dir):
    """D5 + A26: original and high-heat rows stacked (flag = scored half), scaled with the
    bounds of the original rows."""
    n = B.nutrients(spark, sf_dir).select("meal_id", *NUTR)
    st = D.stack_scenarios(n, D.scenario(n, "HighHeat"))
    return C.minmax_fit_apply(n, st, NUTR).select("meal_id", "is_test", *NUTR)


@query("fold_select", f"""
    SELECT meal_id, Heat FROM nutrients WHERE CAST(floor({u_sql(61, 'meal_id')} * 5) AS INTEGER) = 2""",
       views=("nutrients",), round_cols=["Heat"])
def q_fold_select(spark, sf_dir):
    """Rows of repetition 2 of a five-flag test table."""
    n = B.nutrients(spark, sf_dir).select("meal_id", "Heat")
    f = F.floor(u(61, "meal_id") * 5).cast("int")
    folds = n.select("meal_id", *[(f == k).alias(f"test_{k}") for k in range(5)])
    return D.fold_select(n, folds, "meal_id", 2)


@query("autoregressive_inputs", f"""
    WITH {_MEALS_SQL},
    n AS (SELECT event_id AS meal_id, value * 10 AS Heat, value AS Carbohydrate FROM event_series
          WHERE event_type = 'purchase'),
    g AS (SELECT m.meal_id, o.k FROM m, (SELECT CAST(range AS INTEGER) AS k FROM range(4)) o)
    SELECT g.meal_id, g.k AS step, f.value AS glucose,
           CASE WHEN g.k = 3 THEN n.Heat ELSE 0.0 END AS Heat,
           CASE WHEN g.k = 3 THEN n.Carbohydrate ELSE 0.0 END AS Carbohydrate
    FROM g JOIN n ON g.meal_id = n.meal_id
    LEFT JOIN f ON f.meal_id = g.meal_id AND f.phase = 'pre' AND f.k = g.k""",
       views=("event_series",), round_cols=["glucose", "Heat", "Carbohydrate"])
def q_autoregressive_inputs(spark, sf_dir):
    """Four pre-meal steps; the meal's nutrients sit on the last step, zeros before."""
    feat, s = _features(spark, sf_dir)
    nut = s.filter(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("meal_id"), (F.col("value") * 10).alias("Heat"), F.col("value").alias("Carbohydrate"))
    ar = D.autoregressive_inputs(feat.join(nut, "meal_id"), nutrients=["Heat", "Carbohydrate"])
    return ar.select("meal_id", F.posexplode("steps").alias("step", "s")).select(
        "meal_id", F.col("step").cast("int"), "s.glucose", "s.Heat", "s.Carbohydrate")
