"""One query per operator, over its whole tables, and the SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glucoframe.llm.decontam import contamination
from glucoframe.llm.hard_negatives import hard_negatives
from glucoframe.llm.html_main import main_texts
from glucoframe.llm.jaccard import jaccard_groups
from glucoframe.llm.lm import lm_scores
from glucoframe.llm.merkle import manifest
from glucoframe.llm.packing import packed
from glucoframe.llm.quality_model import quality_scores
from glucoframe.llm.quality_rules import judged
from glucoframe.llm.scratch import Scratch
from glucoframe.llm.secrets import secret_spans
from glucoframe.llm.token_files import token_digests
from glucoframe.llm.token_counts import TOKENIZERS, Rollup, changes_of, counted
from glucoframe.llm.toxicity import toxicity_scores

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f
    return keep


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_secret_scan")
def op1(spark, sf_dir):
    return secret_spans(_table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH now AS (
  SELECT d.source, d.lang, coalesce(CASE WHEN l.quality = 0 THEN regexp_replace(d.text, '[#*$%&|<>]+', '', 'g') ELSE d.text END, '') AS text
  FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)
  WHERE coalesce(l.toxic, 0) <> 1),
counted AS (
  SELECT source, lang, 'space@1' AS tokenizer, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n FROM now
  UNION ALL
  SELECT source, lang, 'alnum@1', len(regexp_extract_all(text, '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) FROM now)
SELECT source, lang, tokenizer, count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens FROM counted GROUP BY ALL
"""


@query("op2_token_counts", OP2_SQL)
def op2(spark, sf_dir):
    """All documents come in; those of low quality are revised (symbols go); toxic ones are
    deleted. Every batch is sent twice."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    marks = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    names = list(TOKENIZERS)
    scratch = Scratch(spark, "token-counts")
    counts = scratch.stored(counted(docs, names, ["doc_id"], n=F.col("text"), revised=F.regexp_replace("text", r"[#*$%&|<>]+", "")),
                            "snappy")
    marked = counts.join(marks.where("quality = 0 OR toxic = 1"), "doc_id")
    poor = marked.where("quality = 0")
    gone = marked.where("toxic = 1").withColumn("n", F.when(F.col("quality") == 0, F.col("revised")).otherwise(F.col("n")))
    rollup = Rollup(spark, f"{scratch.root}/rollup")
    for _ in range(2):
        rollup.commit("insert-1", changes_of(counts))
        rollup.commit("revise-1", changes_of(poor, "n", -1).unionByName(changes_of(poor, "revised")))
        rollup.commit("delete-1", changes_of(gone, "n", -1))
    return rollup.totals()


@query("op3_toxicity")
def op3(spark, sf_dir):
    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


OP4_SQL = r"""
WITH words AS (
  SELECT doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size,
         array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS ngram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS p FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM item_windows),
doc_windows AS (
  SELECT id, size, p, array_to_string(w[p:p + size - 1], ' ') AS ngram
  FROM (SELECT id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM words, sizes WHERE len(w) >= size)),
hits AS (SELECT d.id, d.p, d.size, i.item_id FROM doc_windows d JOIN item_windows i USING (size, ngram)),
hit_words AS (
  SELECT id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT id, unnest(range(p, p + size)) AS q FROM hits) GROUP BY id),
hit_items AS (
  SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY id)
SELECT w.id AS doc_id, coalesce(len(w.w), 0) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.list, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN hit_words h USING (id) LEFT JOIN hit_items i USING (id)
"""


@query("op4_decontaminate", OP4_SQL)
def op4(spark, sf_dir):
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query("op5_main_text")
def op5(spark, sf_dir):
    return main_texts(_table(spark, sf_dir, "pages"))


@query("op6_quality_rules")
def op6(spark, sf_dir):
    return judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query("op7_pack")
def op7(spark, sf_dir):
    return packed(_table(spark, sf_dir, "documents"), tokenizer_path())


@query("op8_lm_score")
def op8(spark, sf_dir):
    return lm_scores(_table(spark, sf_dir, "documents"))


@query("op9_quality_model")
def op9(spark, sf_dir):
    return quality_scores(_table(spark, sf_dir, "documents"))


@query("op10_jaccard_join")
def op10(spark, sf_dir):
    return jaccard_groups(_table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM rows a, rows r WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same AND vec_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
ranked AS (
  SELECT p.anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
   AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= 5
"""


@query("op11_hard_negatives", OP11_SQL)
def op11(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = _table(spark, sf_dir, "embeddings").withColumn("label", label)
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0)


@query("op12_token_files")
def op12(spark, sf_dir):
    return token_digests(_table(spark, sf_dir, "documents"), tokenizer_path())


def _merkle_sql(levels: int = 8, over: int = 3) -> str:
    """Trees of up to 8 ** levels leaves under up to 8 ** over languages, one step per level."""
    def tree(name: str, steps: int) -> list[str]:
        out = []
        for k in range(steps):
            run = f"PARTITION BY t, idx // 8 ORDER BY idx ROWS BETWEEN"
            out += [f"""{name}_side{k} AS (SELECT t, idx,
              coalesce(string_agg(digest, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
              coalesce(string_agg(digest, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k} WHERE h > {k})""",
                    f"""{name}{k + 1} AS (SELECT t, idx // 8 AS idx, any_value(h) AS h, sha256(string_agg(digest, '' ORDER BY idx)) AS digest
              FROM {name}{k} WHERE h > {k} GROUP BY t, idx // 8)"""]
        return out + [f"{name}_root AS ({' UNION ALL '.join(f'SELECT t, digest FROM {name}{k} WHERE h = {k}' for k in range(steps + 1))})"]

    def path(name: str, steps: int, place: str, start: int) -> list[str]:
        return [f"""path{start + k + 1} AS (SELECT p.* EXCLUDE (cur, proof), proof || coalesce(s.l || s.r, '') AS proof,
              CASE WHEN s.t IS NULL THEN cur ELSE sha256(s.l || cur || s.r) END AS cur
              FROM path{start + k} p LEFT JOIN {name}_side{k} s ON s.t = {'p.t' if name == 'node' else '0'} AND s.idx = {place} // {8 ** k})"""
                for k in range(steps)]

    height = "list_count(list_filter([8, 64, 512, 4096, 32768, 262144, 2097152, 16777216], lambda p: p < n)) + CAST(n > 1 AS INTEGER)"
    fields = [f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = "sha256({} || coalesce(strlen({}) || ':' || {}, '-'))"
    text = "CASE WHEN crc % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END"
    bits = "list_reduce(range(8), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, xor(c, b))"
    parts = [
        f"""marked AS (SELECT *, xor(list_reduce(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '-'), ''), lambda x: CAST(ascii(x) AS BIGINT)),
              lambda c, b: {bits}, 4294967295), 4294967295) AS crc FROM documents)""",
        f"leaves AS (SELECT doc_id, lang, {leaf.format(' || '.join(fields), 'text', 'text')} AS leaf, "
        f"{leaf.format(' || '.join(fields), 'changed', 'changed')} AS tampered FROM (SELECT *, {text} AS changed FROM marked))",
        "langs AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS t, n FROM (SELECT lang, count(*) AS n FROM leaves GROUP BY lang))",
        f"""placed AS (SELECT l.*, t, {height} AS h, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx
              FROM leaves l JOIN langs g ON l.lang IS NOT DISTINCT FROM g.lang)""",
        "node0 AS (SELECT t, idx, h, leaf AS digest FROM placed)", *tree("node", levels),
        f"over0 AS (SELECT 0 AS t, r.t AS idx, {height} AS h, digest FROM node_root r, (SELECT count(*) AS n FROM langs))", *tree("over", over),
        "path0 AS (SELECT doc_id, t, idx, leaf, tampered AS cur, '' AS proof FROM placed)",
        *path("node", levels, "p.idx", 0), *path("over", over, "p.t", levels)]
    return f"""WITH {", ".join(parts)}
SELECT doc_id, leaf, n.digest AS subroot, o.digest AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = o.digest AS verified
FROM path{levels + over} p JOIN node_root n USING (t), over_root o"""


@query("op13_merkle_manifest", _merkle_sql())
def op13(spark, sf_dir):
    return manifest(_table(spark, sf_dir, "documents"))
