"""Bindings of the driver's test tables to the glucose data model.

The driver's tables hold no glucose data, so each binding derives a glucose
shaped table from them with Spark (and gives the identical DuckDB view, used
by the SQL oracles). Every binding grows with its source table.

Canonical sample = one person-day: ``sample_id = "<user>_<yyyy-mm-dd>"``;
positions are the 288 five-minute slots of the day; several readings in one
slot are averaged (a partial aggregation, so a hot person or day never lands
in one task unreduced).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glucoframe.functions.glucose import slot_of
from glucoframe.functions.hashing import u, u_sql

# label assignment of the synthetic cohort (fixed values of this binding)
CLASSES = ["NGT", "IGR", "T2D"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: events whose readings a task holds where each reading becomes many rows (per layer, head and query)
EVENTS_PER_TASK = 50_000


def sample_parts(spark: SparkSession, sf_dir: str) -> int:
    """Partitions that hold about ``EVENTS_PER_TASK`` events, one per core at least. Spark sizes partitions by the
    bytes it shuffles, which tell little where a short row is turned into many after the shuffle; the
    number of events comes from the footers of the files."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, "events").count() // EVENTS_PER_TASK))


def sample_key(person, day) -> F.Column:
    return F.concat_ws("_", person.cast("string"), F.date_format(day, "yyyy-MM-dd"))


# ---- readings (long form) ----------------------------------------------------
def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(person BIGINT, sample_id STRING, pos INT, value DOUBLE), one row per filled slot."""
    ev = table(spark, sf_dir, "events").select("user_id", "ts", "value")
    g = (ev.groupBy(F.col("user_id").alias("person"), F.to_date("ts").alias("day"),
                    slot_of("ts").alias("pos"))
         .agg(F.avg("value").alias("value")))
    return g.select("person", sample_key(F.col("person"), F.col("day")).alias("sample_id"),
                    "pos", "value")


def readings_15min(rd: DataFrame) -> DataFrame:
    """Three 5-minute slots averaged into one 15-minute slot (96 per day)."""
    return (rd.groupBy("sample_id", (F.col("pos") / 3).cast("int").alias("pos"))
            .agg(F.avg("value").alias("value")))


def month_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(person, sample_id, pos, value): a person's month as one series of three-hour blocks
    (248 at most; sample_id = "<user>_<yyyy-mm>"), dense enough for spectra and unit-root tests. The rows lie
    by sample (:func:`sample_parts`): what is made of a series, many rows per reading, stays there."""
    ev = table(spark, sf_dir, "events").select("user_id", "ts", "value")
    pos = ((F.dayofmonth("ts") - 1) * 8 + F.floor(F.hour("ts") / 3)).cast("int")
    g = ev.groupBy(F.col("user_id").alias("person"), F.date_format("ts", "yyyy-MM").alias("month"), pos.alias("pos")).agg(
        F.avg("value").alias("value"))
    out = g.select("person", F.concat_ws("_", F.col("person").cast("string"), "month").alias("sample_id"), "pos", "value")
    return out.repartition(sample_parts(spark, sf_dir), "sample_id")


def person_labels(person: F.Column) -> dict:
    """Label columns of a person: class, HbA1c target (some missing), filled flag, fold."""
    types = (F.when(person % 3 == 0, F.lit(CLASSES[0]))
             .when(person % 3 == 1, F.lit(CLASSES[1])).otherwise(F.lit(CLASSES[2])))
    hba1c = F.when(person % 14 == 0, F.lit(None).cast("double")).otherwise(
        F.lit(5.0) + (person % 17).cast("double") / F.lit(10.0))
    filled = (person % 7) == 3
    fold = F.floor(u(5, person) * 5).cast("int")
    return {"types": types, "hba1c": hba1c, "filled": filled, "fold": fold}


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(person, types, hba1c, filled, fold): one row per person of ``events``."""
    p = table(spark, sf_dir, "events").select(F.col("user_id").alias("person")).distinct()
    lab = person_labels(F.col("person"))
    return p.select("person", *[c.alias(n) for n, c in lab.items()])


def sample_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, p_id, types, hba1c, filled, fold) for every sample of ``readings``."""
    ev = table(spark, sf_dir, "events").select("user_id", "ts")
    s = ev.select(F.col("user_id").alias("person"), F.to_date("ts").alias("day")).distinct()
    lab = person_labels(F.col("person"))
    return s.select(sample_key(F.col("person"), F.col("day")).alias("sample_id"),
                    F.col("person").alias("p_id"),
                    *[c.alias(n) for n, c in lab.items()])


# ---- slot states, attention weights, meals, time split ----------------------
def slot_states(rd: DataFrame, delta: float = 5.0) -> DataFrame:
    """(sample_id, pos, state) with state Up / Down / N from the change since the previous reading."""
    from pyspark.sql import Window
    w = Window.partitionBy("sample_id").orderBy("pos")
    d = F.col("value") - F.lag("value").over(w)
    return rd.select("sample_id", "pos",
                     F.when(d > delta, "Up").when(d < -delta, "Down").otherwise("N").alias("state"))


def token_positions(rd: DataFrame, parts: int | None = None) -> DataFrame:
    """(sample_id, tpos): <cls> at 0 and every reading at pos + 1. The rows lie by sample: only
    (sample, position) pairs are shuffled, and what is derived from them per layer, head or
    dimension stays where the sample is, in ``parts`` partitions (:func:`sample_parts`; None: as
    many as Spark makes of the pairs' bytes)."""
    if parts:
        rd = rd.select("sample_id", "pos").repartition(parts, "sample_id")
    days = rd.groupBy("sample_id").agg(F.collect_list(F.col("pos") + 1).alias("_t"))
    return days.select("sample_id", F.explode(F.concat(F.array(F.lit(0)), "_t")).alias("tpos"))


def attention_weights(rd: DataFrame, layers: int = 4, heads: int = 2, parts: int | None = None) -> DataFrame:
    """(sample_id, tpos, layer, head, w): a weight at <cls> (tpos 0) and at every reading (pos + 1)."""
    k = F.explode(F.sequence(F.lit(0), F.lit(layers * heads - 1))).alias("k")
    p = token_positions(rd, parts).select("sample_id", "tpos", k)
    p = p.select("sample_id", "tpos", (F.col("k") / heads).cast("int").alias("layer"),
                 (F.col("k") % heads).cast("int").alias("head"))
    return p.withColumn("w", u(11, "sample_id", "tpos", "layer", "head"))


def token_vectors(rd: DataFrame, width: int = 4, seed: int = 13, parts: int | None = None) -> DataFrame:
    """(sample_id, tpos, vec): a vector of hash noise at every token position."""
    vec = F.array(*[u(seed, "sample_id", "tpos", F.lit(d)) for d in range(width)])
    return token_positions(rd, parts).withColumn("vec", vec)


def meal_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(person, sample_id, meal_id, slot): purchases are meals."""
    ev = table(spark, sf_dir, "events").filter(F.col("event_type") == "purchase")
    return ev.select(F.col("user_id").alias("person"),
                     sample_key(F.col("user_id"), F.to_date("ts")).alias("sample_id"),
                     F.col("event_id").alias("meal_id"), slot_of("ts").alias("slot"))


def time_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per sample: Fast/Dawn/Breakfast/Lunch/Dinner start and end slots (meals nullable).

    Breakfast / lunch / dinner = first meal in slots [60,132) / [132,192) / [192,264);
    a meal segment ends 24 slots (two hours) later, capped at 287; dawn is [36, 96];
    fasting runs from 0 to the breakfast start (or 96 without breakfast). The rows lie by sample, in
    as many partitions as weights of the same tables do (:func:`sample_parts`).
    """
    parts = sample_parts(spark, sf_dir)
    m = meal_events(spark, sf_dir)
    agg = m.groupBy("sample_id").agg(
        F.min(F.when((F.col("slot") >= 60) & (F.col("slot") < 132), F.col("slot"))).alias("Breakfast_s"),
        F.min(F.when((F.col("slot") >= 132) & (F.col("slot") < 192), F.col("slot"))).alias("Lunch_s"),
        F.min(F.when((F.col("slot") >= 192) & (F.col("slot") < 264), F.col("slot"))).alias("Dinner_s")).repartition(parts, "sample_id")
    s = sample_labels(spark, sf_dir).select("sample_id").repartition(parts, "sample_id").join(agg, "sample_id", "left")
    out = s.select(
        "sample_id",
        F.lit(0).alias("Fast_s"), F.coalesce(F.col("Breakfast_s"), F.lit(96)).alias("Fast_e"),
        F.lit(36).alias("Dawn_s"), F.lit(96).alias("Dawn_e"),
        *[e for meal in ("Breakfast", "Lunch", "Dinner") for e in (
            F.col(f"{meal}_s").cast("int").alias(f"{meal}_s"),
            F.least(F.col(f"{meal}_s") + 24, F.lit(287)).cast("int").alias(f"{meal}_e"))])
    return out


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(person, rank, event_id, event_type, value): each person's events in time order.

    The rank within a person is exact and skew-safe (range partitions plus
    per-partition offsets), so one very active person is never sorted in one task.
    """
    from glucoframe.operators.ranking import rank_within
    ev = table(spark, sf_dir, "events").select(F.col("user_id").alias("person"), "ts", "event_id",
                                               "event_type", "value")
    return rank_within(ev, ["person"], ["ts", "event_id"], out="rank").drop("ts")


# ---- vectors -----------------------------------------------------------------
def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, person, vec ARRAY<DOUBLE>, label, is_ref, cluster): embeddings split by a hash.

    A person owns four consecutive day vectors; reference vectors (hash < 0.3)
    carry the cluster name 'C<label>'.
    """
    e = table(spark, sf_dir, "embeddings")
    is_ref = u(3, "vec_id") < 0.3
    return e.select("vec_id", (F.col("vec_id") / 4).cast("long").alias("person"),
                    F.col("embedding").cast("array<double>").alias("vec"),
                    "label", is_ref.alias("is_ref"),
                    F.concat(F.lit("C"), F.col("label").cast("string")).alias("cluster"))


# ---- predictions -------------------------------------------------------------
def predictions(spark: SparkSession, sf_dir: str, n_classes: int = 3) -> DataFrame:
    """(doc_id, y_true, logits ARRAY<DOUBLE>, y_flags ARRAY<INT>, scores ARRAY<DOUBLE>).

    y_true = 2 when toxic else quality; logits are hash noise in [-2, 2) with a
    bonus of 1.5 on the true class and n_chars / 20000 on class 1; flags are
    (quality, toxic) with scores hash noise plus 1 on set flags.
    """
    lab = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    j = lab.join(docs, "doc_id", "left")
    y = F.when(F.col("toxic") == 1, F.lit(2)).otherwise(F.col("quality")).cast("int")
    j = j.withColumn("y_true", y)
    logits = F.array(*[
        u(20 + k, "doc_id") * 4.0 - 2.0
        + F.when(F.col("y_true") == k, F.lit(1.5)).otherwise(F.lit(0.0))
        + (F.coalesce(F.col("n_chars"), F.lit(0)) / F.lit(20000.0) if k == 1 else F.lit(0.0))
        for k in range(n_classes)])
    flags = F.array(F.col("quality").cast("int"), F.col("toxic").cast("int"))
    scores = F.array(*[u(30 + k, "doc_id") * 4.0 - 2.0
                       + F.when(F.col(c) == 1, F.lit(1.0)).otherwise(F.lit(0.0))
                       for k, c in enumerate(["quality", "toxic"])])
    return j.select("doc_id", "y_true", logits.alias("logits"), flags.alias("y_flags"),
                    scores.alias("scores"))


def reg_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, l_linenumber, y, p): y = extended price, p = 2100 x quantity."""
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("y"),
                     (F.col("l_quantity") * 2100.0).alias("p"))


# ---- meals / nutrients, clinical, gene counts ----------------------------------
def nutrients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meals with Heat, Carbohydrate, Fat, Protein, DietaryFiber from lineitem."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("meal_id"),
        F.col("l_orderkey").alias("person"),
        (F.col("l_extendedprice") / 100.0).alias("Heat"),
        F.col("l_quantity").alias("Carbohydrate"),
        (F.col("l_tax") * 100.0).alias("Fat"),
        (F.col("l_discount") * 100.0).alias("Protein"),
        (F.col("l_quantity") / 10.0).alias("DietaryFiber"))


def clinical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clinical table from customer: id, type, measurements with gaps, HOMA values, score C."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    typ = (F.when(k % 4 == 0, "NGT").when(k % 4 == 1, "IGR")
           .when(k % 4 == 2, "T2D").otherwise("T1D"))
    bal = F.col("c_acctbal")
    return c.select(
        F.concat_ws("_", F.lit("Cust"), typ, k.cast("string")).alias("id"),
        k.alias("Rawid"), typ.alias("type"),
        (F.col("c_nationkey") * 96 + 100).alias("RecordNum"), F.lit(15).alias("TimeGap"),
        (F.lit(1.5) + F.col("c_nationkey") / 100.0).alias("ht"),
        (F.lit(50.0) + (k % 50)).alias("wt"),
        F.when(k % 9 == 0, F.lit(None).cast("double")).otherwise(F.lit(5.0) + bal / 2000.0).alias("fpg"),
        F.when(k % 11 == 0, F.lit(None).cast("double")).otherwise(F.lit(6.0) + bal / 1500.0).alias("hba1c"),
        F.when(k % 13 == 0, F.lit(None).cast("double")).otherwise(bal / 100.0).alias("tg"),
        (bal / 20.0).alias("HOMA_B"), (bal / 1500.0).alias("HOMA_IS"),
        u(40, k).alias("C"))


def gene_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, gene, n): lineitem quantities per order (cell) and supplier (gene)."""
    li = table(spark, sf_dir, "lineitem")
    return (li.groupBy(F.col("l_orderkey").alias("cell"), F.col("l_suppkey").alias("gene"))
            .agg(F.sum("l_quantity").alias("n")))


def cell_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, filter_pass): orders with status F pass."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("cell"),
                    (F.col("o_orderstatus") == "F").cast("int").alias("filter_pass"))


# =============================================================================
# DuckDB twins (used by the SQL oracles); names match the functions above.
# =============================================================================
_SAMPLE_KEY = "CAST(user_id AS VARCHAR) || '_' || strftime(CAST(ts AS DATE), '%Y-%m-%d')"
_SLOT = "CAST(hour(ts) * 12 + minute(ts) // 5 AS INTEGER)"

SQL_VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "readings": (f"""
        SELECT person, sample_id, pos, value FROM (
          SELECT user_id AS person, {_SAMPLE_KEY} AS sample_id, {_SLOT} AS pos, avg(value) AS value
          FROM events GROUP BY 1, 2, 3) t""", ()),
    "month_series": ("""
        SELECT user_id AS person, CAST(user_id AS VARCHAR) || '_' || strftime(ts, '%Y-%m') AS sample_id,
               CAST((day(ts) - 1) * 8 + hour(ts) // 3 AS INTEGER) AS pos, avg(value) AS value
        FROM events GROUP BY 1, 2, 3""", ()),
    "sample_labels": (f"""
        SELECT sample_id, person AS p_id,
               CASE WHEN person % 3 = 0 THEN 'NGT' WHEN person % 3 = 1 THEN 'IGR' ELSE 'T2D' END AS types,
               CASE WHEN person % 14 = 0 THEN NULL ELSE 5.0 + CAST(person % 17 AS DOUBLE) / 10.0 END AS hba1c,
               (person % 7) = 3 AS filled,
               CAST(floor({u_sql(5, 'person')} * 5) AS INTEGER) AS fold
        FROM (SELECT DISTINCT user_id AS person, {_SAMPLE_KEY} AS sample_id FROM events) s""", ()),
    "grid": ("""
        SELECT s.sample_id, g.i AS pos, r.value
        FROM (SELECT DISTINCT sample_id FROM readings) s
        CROSS JOIN (SELECT CAST(range AS INTEGER) AS i FROM range(288)) g
        LEFT JOIN readings r ON r.sample_id = s.sample_id AND r.pos = g.i""", ("readings",)),
    "readings96": ("""
        SELECT sample_id, CAST(pos // 3 AS INTEGER) AS pos, avg(value) AS value
        FROM readings GROUP BY 1, 2""", ("readings",)),
    "grid96": ("""
        SELECT s.sample_id, g.i AS pos, r.value
        FROM (SELECT DISTINCT sample_id FROM readings) s
        CROSS JOIN (SELECT CAST(range AS INTEGER) AS i FROM range(96)) g
        LEFT JOIN readings96 r ON r.sample_id = s.sample_id AND r.pos = g.i""", ("readings", "readings96")),
    "persons": (f"""
        SELECT person,
               CASE WHEN person % 3 = 0 THEN 'NGT' WHEN person % 3 = 1 THEN 'IGR' ELSE 'T2D' END AS types,
               CASE WHEN person % 14 = 0 THEN NULL ELSE 5.0 + CAST(person % 17 AS DOUBLE) / 10.0 END AS hba1c,
               (person % 7) = 3 AS filled,
               CAST(floor({u_sql(5, 'person')} * 5) AS INTEGER) AS fold
        FROM (SELECT DISTINCT user_id AS person FROM events) p""", ()),
    "slot_states": ("""
        SELECT sample_id, pos,
               CASE WHEN d > 5.0 THEN 'Up' WHEN d < -5.0 THEN 'Down' ELSE 'N' END AS state
        FROM (SELECT sample_id, pos, value - lag(value) OVER (PARTITION BY sample_id ORDER BY pos) AS d
              FROM readings) t""", ("readings",)),
    "weights": (f"""
        SELECT sample_id, tpos, layer, head, {u_sql(11, 'sample_id', 'tpos', 'layer', 'head')} AS w
        FROM (SELECT sample_id, tpos, CAST(k // 2 AS INTEGER) AS layer, CAST(k % 2 AS INTEGER) AS head
              FROM (SELECT sample_id, CAST(pos + 1 AS INTEGER) AS tpos FROM readings
                    UNION ALL SELECT DISTINCT sample_id, 0 FROM readings) p,
                   (SELECT range AS k FROM range(8)) ks) t""", ("readings",)),
    "meal_events": (f"""
        SELECT user_id AS person, {_SAMPLE_KEY} AS sample_id, event_id AS meal_id, {_SLOT} AS slot
        FROM events WHERE event_type = 'purchase'""", ()),
    "time_split": ("""
        SELECT s.sample_id, 0 AS Fast_s, coalesce(b, 96) AS Fast_e, 36 AS Dawn_s, 96 AS Dawn_e,
               b AS Breakfast_s, CAST(least(b + 24, 287) AS INTEGER) AS Breakfast_e,
               l AS Lunch_s, CAST(least(l + 24, 287) AS INTEGER) AS Lunch_e,
               d AS Dinner_s, CAST(least(d + 24, 287) AS INTEGER) AS Dinner_e
        FROM sample_labels s LEFT JOIN (
          SELECT sample_id,
                 min(CASE WHEN slot >= 60 AND slot < 132 THEN slot END) AS b,
                 min(CASE WHEN slot >= 132 AND slot < 192 THEN slot END) AS l,
                 min(CASE WHEN slot >= 192 AND slot < 264 THEN slot END) AS d
          FROM meal_events GROUP BY sample_id) m ON s.sample_id = m.sample_id""",
                   ("sample_labels", "meal_events")),
    "stage_intervals": ("""
        SELECT sample_id, 'dawn' AS stage, 0 AS seg, Dawn_s AS lo, CAST(Dawn_e + 1 AS INTEGER) AS hi FROM time_split
        UNION ALL SELECT sample_id, 'fast', 0, Fast_s, Fast_e FROM time_split
        UNION ALL SELECT sample_id, 'before_meal', 0, CAST(greatest(Breakfast_s - 18, 0) AS INTEGER), Breakfast_s
                  FROM time_split WHERE Breakfast_s IS NOT NULL
        UNION ALL SELECT sample_id, 'before_meal', 1, CAST(greatest(Lunch_s - 18, 0) AS INTEGER), Lunch_s
                  FROM time_split WHERE Lunch_s IS NOT NULL
        UNION ALL SELECT sample_id, 'before_meal', 2, CAST(greatest(Dinner_s - 18, 0) AS INTEGER), Dinner_s
                  FROM time_split WHERE Dinner_s IS NOT NULL
        UNION ALL SELECT sample_id, 'after_meal', 0, CAST(Breakfast_e + 1 AS INTEGER), Lunch_s
                  FROM time_split WHERE Breakfast_e IS NOT NULL AND Lunch_s IS NOT NULL
        UNION ALL SELECT sample_id, 'after_meal', 1, CAST(Lunch_e + 1 AS INTEGER), Dinner_s
                  FROM time_split WHERE Lunch_e IS NOT NULL AND Dinner_s IS NOT NULL
        UNION ALL SELECT sample_id, 'after_meal', 2, CAST(Dinner_e + 1 AS INTEGER), 288
                  FROM time_split WHERE Dinner_e IS NOT NULL""", ("time_split",)),
    "event_series": ("""
        SELECT user_id AS person, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS rank,
               event_id, event_type, value
        FROM events""", ()),
    "vectors": (f"""
        SELECT vec_id, CAST(vec_id // 4 AS BIGINT) AS person, CAST(embedding AS DOUBLE[]) AS vec, label,
               {u_sql(3, 'vec_id')} < 0.3 AS is_ref, 'C' || CAST(label AS VARCHAR) AS cluster
        FROM embeddings""", ()),
    "predictions": (f"""
        SELECT doc_id, y_true,
               [{u_sql(20, 'doc_id')} * 4.0 - 2.0 + CASE WHEN y_true = 0 THEN 1.5 ELSE 0.0 END,
                {u_sql(21, 'doc_id')} * 4.0 - 2.0 + CASE WHEN y_true = 1 THEN 1.5 ELSE 0.0 END
                  + coalesce(n_chars, 0) / 20000.0,
                {u_sql(22, 'doc_id')} * 4.0 - 2.0 + CASE WHEN y_true = 2 THEN 1.5 ELSE 0.0 END] AS logits,
               [CAST(quality AS INTEGER), CAST(toxic AS INTEGER)] AS y_flags,
               [{u_sql(30, 'doc_id')} * 4.0 - 2.0 + CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END,
                {u_sql(31, 'doc_id')} * 4.0 - 2.0 + CASE WHEN toxic = 1 THEN 1.0 ELSE 0.0 END] AS scores
        FROM (SELECT l.doc_id, quality, toxic, d.n_chars,
                     CAST(CASE WHEN toxic = 1 THEN 2 ELSE quality END AS INTEGER) AS y_true
              FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id) t""", ()),
    "reg_predictions": ("""
        SELECT l_orderkey, l_linenumber, l_extendedprice AS y, l_quantity * 2100.0 AS p FROM lineitem""", ()),
    "nutrients": ("""
        SELECT l_orderkey * 8 + l_linenumber AS meal_id, l_orderkey AS person,
               l_extendedprice / 100.0 AS Heat, l_quantity AS Carbohydrate, l_tax * 100.0 AS Fat,
               l_discount * 100.0 AS Protein, l_quantity / 10.0 AS DietaryFiber
        FROM lineitem""", ()),
    "clinical": (f"""
        SELECT 'Cust_' || typ || '_' || CAST(c_custkey AS VARCHAR) AS id, c_custkey AS Rawid, typ AS type,
               c_nationkey * 96 + 100 AS RecordNum, 15 AS TimeGap,
               CAST(1.5 + c_nationkey / 100.0 AS DOUBLE) AS ht, CAST(50.0 + (c_custkey % 50) AS DOUBLE) AS wt,
               CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE 5.0 + c_acctbal / 2000.0 END AS fpg,
               CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 6.0 + c_acctbal / 1500.0 END AS hba1c,
               CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_acctbal / 100.0 END AS tg,
               c_acctbal / 20.0 AS HOMA_B, c_acctbal / 1500.0 AS HOMA_IS,
               {u_sql(40, 'c_custkey')} AS C
        FROM (SELECT *, CASE c_custkey % 4 WHEN 0 THEN 'NGT' WHEN 1 THEN 'IGR' WHEN 2 THEN 'T2D'
                            ELSE 'T1D' END AS typ FROM customer) c""", ()),
    "gene_counts": ("""
        SELECT l_orderkey AS cell, l_suppkey AS gene, sum(l_quantity) AS n
        FROM lineitem GROUP BY 1, 2""", ()),
    "cell_qc": ("""
        SELECT o_orderkey AS cell, CAST(o_orderstatus = 'F' AS INTEGER) AS filter_pass FROM orders""", ()),
}


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with the CTEs of the named DuckDB views (dependencies first)."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in SQL_VIEWS[n][1]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({SQL_VIEWS[n][0]})" for n in order)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
