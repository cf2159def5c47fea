"""Registered queries: encoding (E) and vocabularies (V)."""

from __future__ import annotations

from pyspark.sql import functions as F

from glucoframe.functions import glucose as G
from glucoframe.functions.glucose import is_missing
from glucoframe.operators import encode, shape, vocab
from glucoframe.plans.registry import query
from glucoframe.sources import bindings as B


def tok_sql(v: str) -> str:
    """DuckDB twin of ``encode_value``."""
    return (f"(CASE WHEN {v} IS NULL OR isnan({v}) THEN 264 "
            f"ELSE CAST(trunc(least(greatest({v}, 39), 301)) AS INTEGER) - 39 END)")


def _join(arr) -> F.Column:
    return F.array_join(F.transform(arr, lambda x: F.coalesce(x.cast("string"), F.lit("null"))), ",")


def _sum(arr) -> F.Column:
    return F.aggregate(arr, F.lit(0), lambda a, x: a + x)


def _day_arrays(spark, sf_dir):
    return shape.to_array(B.readings(spark, sf_dir), "sample_id")


def _arrays96(spark, sf_dir):
    return shape.to_array(B.readings_15min(B.readings(spark, sf_dir)), "sample_id", length=96)


# ---- E1-E4 (long form) -------------------------------------------------------------
@query("clip_readings", "SELECT sample_id, pos, least(greatest(value, 39), 301) AS value FROM readings",
       views=("readings",), round_cols=["value"])
def q_clip_readings(spark, sf_dir):
    """Clamp readings to 39..301."""
    rd = B.readings(spark, sf_dir)
    return rd.select("sample_id", "pos", G.clip_value("value").alias("value"))


@query("clip_by_threshold", """
    SELECT sample_id, pos, CASE WHEN t < 40 THEN 39 WHEN t > 300 THEN 301 ELSE t END AS token
    FROM (SELECT sample_id, pos, CAST(trunc(value) AS INTEGER) AS t FROM readings) r""",
       views=("readings",))
def q_clip_by_threshold(spark, sf_dir):
    """Older rule, truncate then < 40 -> 39, > 300 -> 301."""
    rd = B.readings(spark, sf_dir)
    return rd.select("sample_id", "pos", G.clip_by_threshold("value").alias("token"))


@query("encode_tokens", f"SELECT sample_id, pos, {tok_sql('value')} AS token FROM readings",
       views=("readings",))
def q_encode_tokens(spark, sf_dir):
    """E3 + E4 on long form: clip, truncate, vocabulary id."""
    return encode.encode_tokens_long(B.readings(spark, sf_dir)).select("sample_id", "pos", "token")


# ---- E1-E6 (array form) --------------------------------------------------------------
@query("encode_sequences", f"""
    SELECT sample_id, '265,' || string_agg(CAST({tok_sql('value')} AS VARCHAR), ',' ORDER BY pos) AS tokens,
           CAST(1 + count(value) AS INTEGER) AS n_attended
    FROM grid GROUP BY sample_id""", views=("grid",))
def q_encode_sequences(spark, sf_dir):
    """One projection from readings arrays to <cls> + token ids + attention mask."""
    enc = encode.encode_sequences(_day_arrays(spark, sf_dir))
    return enc.select("sample_id", _join(F.col("input_ids")).alias("tokens"),
                      _sum(F.col("attention_mask")).alias("n_attended"))


@query("upsample_pad", f"""
    SELECT sample_id,
           '265,' || string_agg(CAST({tok_sql('value')} AS VARCHAR) || ',264,264', ',' ORDER BY pos) AS tokens,
           CAST(1 + count(value) AS INTEGER) AS n_attended
    FROM grid96 GROUP BY sample_id""", views=("grid96",))
def q_upsample_pad(spark, sf_dir):
    """E7 (+E5/E6): 96 readings -> each token followed by two pads -> 288, then <cls>."""
    a = _arrays96(spark, sf_dir)
    tok = encode.prepend_cls(encode.upsample_pad("input_ids", 3, 288))
    out = a.select("sample_id", tok.alias("t"))
    return out.select("sample_id", _join(F.col("t")).alias("tokens"),
                      _sum(encode.attention_mask("t")).alias("n_attended"))


@query("upsample_interpolate", f"""
    WITH l AS (
      SELECT sample_id, pos, value AS x,
             lag(value, 1) OVER w AS x1, lag(value, 2) OVER w AS x2, lead(value, 1) OVER w AS xn
      FROM grid96 WINDOW w AS (PARTITION BY sample_id ORDER BY pos)),
    t AS (
      SELECT sample_id, pos,
             CASE WHEN pos = 0 THEN CAST({tok_sql('x')} AS VARCHAR)
             ELSE CAST({tok_sql('f')} AS VARCHAR) || ',' || CAST({tok_sql('s')} AS VARCHAR) || ','
                  || CAST({tok_sql('x')} AS VARCHAR) END AS piece
      FROM (SELECT *, CASE WHEN pos = 1 THEN (x1 + x) / 2.0 ELSE (x2 + x1 + x) / 3.0 END AS f,
                      CASE WHEN pos = 95 THEN (x1 + x) / 2.0 ELSE (x1 + x + xn) / 3.0 END AS s
            FROM l) q)
    SELECT sample_id, '265,' || string_agg(piece, ',' ORDER BY pos) || ',264,264' AS tokens
    FROM t GROUP BY sample_id""", views=("grid96",))
def q_upsample_interpolate(spark, sf_dir):
    """96 readings -> 3n - 2 = 286 interpolated tokens (Q15), right-padded to 288, <cls>."""
    a = _arrays96(spark, sf_dir)
    t = encode.upsample_interpolate("input_ids")
    t = F.concat(t, F.array_repeat(F.lit(G.PAD_ID), F.greatest(F.lit(288) - F.size(t), F.lit(0))))
    return a.select("sample_id", _join(encode.prepend_cls(t)).alias("tokens"))


@query("bucket_tokens", "SELECT sample_id, pos, CAST(floor((value - 30) / 10) AS INTEGER) AS bucket FROM readings",
       views=("readings",))
def q_bucket_tokens(spark, sf_dir):
    """Coarse vocabulary (v - 30) // 10."""
    rd = B.readings(spark, sf_dir)
    return rd.select("sample_id", "pos", G.bucket_value("value").alias("bucket"))


@query("rank_encode", """
    SELECT sample_id,
           string_agg(CAST(pos AS VARCHAR), ',' ORDER BY (value IS NULL), value, pos) AS asc_order,
           string_agg(CAST(pos AS VARCHAR), ',' ORDER BY (value IS NULL) DESC, value DESC, pos DESC) AS desc_order
    FROM grid GROUP BY sample_id""", views=("grid",))
def q_rank_encode(spark, sf_dir):
    """Stable argsort per row, missing last; descending reverses inside the row (Q1)."""
    a = encode.rank_order(_day_arrays(spark, sf_dir), "input_ids", "_asc")
    # descending = the ascending order reversed inside the row (evaluated once)
    return a.select("sample_id", _join(F.col("_asc")).alias("asc_order"),
                    _join(F.reverse("_asc")).alias("desc_order"))


@query("glucose_band", """
    SELECT sample_id, pos, CASE WHEN value < 70 THEN 0 WHEN value >= 180 THEN 2 ELSE 1 END AS band
    FROM readings""", views=("readings",))
def q_glucose_band(spark, sf_dir):
    """Low / in range / high as 0 / 1 / 2."""
    rd = B.readings(spark, sf_dir)
    return rd.select("sample_id", "pos", G.glucose_band("value").alias("band"))


# ---- E12-E15 ------------------------------------------------------------------------------
def _compact_tokens(spark, sf_dir):
    """Token ids of the present readings of a day, in slot order (variable length)."""
    a = _day_arrays(spark, sf_dir)
    return a.select("sample_id", encode.encode_array(
        F.filter("input_ids", lambda x: ~is_missing(x))).alias("input_ids"))


_COMPACT_SQL = f"""
    toks AS (SELECT sample_id, list({tok_sql('value')} ORDER BY pos) AS t FROM readings GROUP BY sample_id),
    tgt AS (SELECT CAST(ceil(max(len(t)) / 8.0) * 8 AS INTEGER) AS n FROM toks)"""


@query("pad_sequences", f"""
    WITH {_COMPACT_SQL}
    SELECT sample_id, CAST(n AS INTEGER) AS length,
           array_to_string(list_resize(t, n, 264), ',') AS tokens,
           CAST(len(t) AS INTEGER) AS n_attended, CAST(n - len(t) AS INTEGER) AS n_special
    FROM toks, tgt""", views=("readings",))
def q_pad_sequences(spark, sf_dir):
    """E12 + E13: pad to the longest sequence rounded up to a multiple of 8."""
    p = encode.pad_sequences(_compact_tokens(spark, sf_dir), strategy="longest", multiple_of=8)
    return p.select("sample_id", F.size("input_ids").alias("length"),
                    _join(F.col("input_ids")).alias("tokens"),
                    _sum(F.col("attention_mask")).alias("n_attended"),
                    _sum(F.col("special_tokens_mask")).alias("n_special"))


@query("special_tokens_mask", "SELECT sample_id, CAST(288 - count(value) AS INTEGER) AS n_special FROM grid GROUP BY sample_id",
       views=("grid",))
def q_special_tokens_mask(spark, sf_dir):
    """Count of <mask>/<pad> positions of encoded day sequences."""
    enc = encode.encode_sequences(_day_arrays(spark, sf_dir))
    return enc.select("sample_id", _sum(encode.special_tokens_mask("input_ids")).alias("n_special"))


@query("pad_concat", f"""
    WITH {_COMPACT_SQL},
    a AS (SELECT t.sample_id, 0 AS src, len(t.t) AS n FROM toks t JOIN sample_labels l ON t.sample_id = l.sample_id
          WHERE l.fold = 0),
    b AS (SELECT sample_id, 1 AS src, 96 AS n FROM (SELECT DISTINCT sample_id FROM grid96) g
          WHERE sample_id IN (SELECT sample_id FROM sample_labels WHERE fold <> 0)),
    u AS (SELECT * FROM a UNION ALL SELECT * FROM b),
    w AS (SELECT max(n) AS w FROM u)
    SELECT sample_id, src, CAST(w AS INTEGER) AS width, CAST(w - n AS INTEGER) AS n_fill FROM u, w""",
       views=("readings", "grid96", "sample_labels"))
def q_pad_concat(spark, sf_dir):
    """Union of two token tables of unequal width; short rows padded with -100."""
    fold = B.sample_labels(spark, sf_dir).select("sample_id", "fold")
    a = _compact_tokens(spark, sf_dir).join(fold, "sample_id").filter("fold = 0")
    b = _arrays96(spark, sf_dir).join(fold, "sample_id").filter("fold <> 0")
    a = a.select("sample_id", F.lit(0).alias("src"), "input_ids")
    b = b.select("sample_id", F.lit(1).alias("src"), encode.encode_array("input_ids").alias("input_ids"))
    out = encode.pad_concat(a, b, "input_ids", G.IGNORE_LABEL)
    return out.select("sample_id", "src", F.size("input_ids").alias("width"),
                      F.size(F.filter("input_ids", lambda x: x == G.IGNORE_LABEL)).alias("n_fill"))


@query("decode_tokens", """
    SELECT sample_id, CAST(pos + 1 AS INTEGER) AS tpos,
           CAST(trunc(least(greatest(value, 39), 301)) AS INTEGER) AS value
    FROM readings""", views=("readings",))
def q_decode_tokens(spark, sf_dir):
    """Encoded sequences back to mg/dL; specials (cls, pad) become null and are dropped."""
    enc = encode.encode_sequences(_day_arrays(spark, sf_dir))
    dec = enc.select("sample_id", F.posexplode(encode.decode_array("input_ids")).alias("tpos", "value"))
    return dec.filter(F.col("value").isNotNull()).select("sample_id", "tpos", "value")


# ---- E17-E19 --------------------------------------------------------------------------------
@query("gene_medians", """
    WITH tot AS (SELECT cell, sum(n) AS total FROM gene_counts GROUP BY cell)
    SELECT gene, median(n * 10000.0 / total) AS factor FROM gene_counts JOIN tot USING (cell) WHERE n > 0 GROUP BY gene""",
       views=("gene_counts",), round_cols=["factor"])
def q_gene_medians(spark, sf_dir):
    """Exact median of each gene's non-zero normalised counts over all cells."""
    return encode.gene_factors_median(encode.normalised_counts(B.gene_counts(spark, sf_dir)))


@query("tokenize_rank_values", """
    WITH qc AS (SELECT g.* FROM gene_counts g JOIN cell_qc q ON g.cell = q.cell WHERE q.filter_pass = 1),
    tot AS (SELECT cell, sum(n) AS total FROM qc GROUP BY cell),
    nrm AS (SELECT qc.cell, gene, n * 10000.0 / total AS norm FROM qc JOIN tot ON qc.cell = tot.cell),
    fac AS (SELECT gene, (quantile_disc(norm, 0.5) + -quantile_disc(-norm, 0.5)) / 2 AS factor FROM nrm WHERE norm > 0 GROUP BY gene),
    v AS (SELECT cell, nrm.gene, norm / factor AS v FROM nrm JOIN fac ON nrm.gene = fac.gene WHERE norm / factor > 0)
    SELECT cell, CAST(least(count(*), 2048) AS INTEGER) AS length,
           array_to_string(list_slice(list(gene ORDER BY v DESC, gene), 1, 2048), ',') AS tokens
    FROM v GROUP BY cell""", views=("gene_counts", "cell_qc"))
def q_tokenize_rank_values(spark, sf_dir):
    """QC filter, normalise by cell total and gene factor, rank genes per cell,
    truncate to 2048 with the length."""
    counts = B.gene_counts(spark, sf_dir)
    qc = encode.qc_pass(B.cell_qc(spark, sf_dir)).select("cell")
    counts = counts.join(qc, "cell", "left_semi")
    factors = encode.gene_factors_median(encode.normalised_counts(counts))
    t = encode.tokenize_rank_values(counts, factors, max_len=2048)
    return t.select("cell", "length", _join(F.col("input_ids")).alias("tokens"))


# ---- V1 / V2 ----------------------------------------------------------------------------------
@query("vocab_fixed", f"""
    WITH v AS (SELECT CAST(range AS VARCHAR) AS token, CAST(range - 39 AS INTEGER) AS id FROM range(39, 302)
               UNION ALL SELECT '<mask>', 263 UNION ALL SELECT '<pad>', 264 UNION ALL SELECT '<cls>', 265),
    c AS (SELECT {tok_sql('value')} AS id, count(*) AS n FROM readings GROUP BY 1)
    SELECT v.token, v.id, coalesce(c.n, 0) AS n_readings FROM v LEFT JOIN c ON v.id = c.id""",
       views=("readings",))
def q_vocab_fixed(spark, sf_dir):
    """V1: readings 39..301 -> 0..262, then <mask>, <pad>, <cls>; with the number of readings
    that encode to each id (token usage of the corpus; the 266-row table is broadcast)."""
    v = vocab.build_vocab_fixed(spark)
    used = encode.encode_tokens_long(B.readings(spark, sf_dir)).groupBy(F.col("token").alias("id")).agg(
        F.count("*").alias("n_readings"))
    out = used.join(F.broadcast(v), "id", "right")
    return out.select("token", "id", F.coalesce("n_readings", F.lit(0)).alias("n_readings"))


@query("vocab_learned", """
    WITH t AS (SELECT DISTINCT CAST(trunc(value) AS INTEGER) AS t FROM readings),
    b AS (SELECT CAST(t AS VARCHAR) AS token, CAST(row_number() OVER (ORDER BY t) - 1 AS INTEGER) AS id FROM t),
    m AS (SELECT coalesce(max(id), -1) AS top FROM b)
    SELECT * FROM b
    UNION ALL SELECT '<mask>', CAST(top + 1 AS INTEGER) FROM m
    UNION ALL SELECT '<pad>', CAST(top + 2 AS INTEGER) FROM m
    UNION ALL SELECT '<cls>', CAST(top + 3 AS INTEGER) FROM m""", views=("readings",))
def q_vocab_learned(spark, sf_dir):
    """V2: distinct integer readings, sorted and numbered; specials appended."""
    return vocab.build_vocab_learned(B.readings(spark, sf_dir), "value")
