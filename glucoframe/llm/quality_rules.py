"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule is a number per document that is larger for worse texts. A labelled
holdout shows how many good documents a cutoff would reject. For every stratum,
rule and cutoff of a fixed grid, the hypothesis "the true share of good documents
above the cutoff exceeds the limit" is tested with the exact binomial tail
P(Bin(n, limit) <= k); the limit of false rejection of a stratum is shared out
evenly over the rules (a union bound), and the level over all strata and rules
(Bonferroni). The cutoffs of one rule are tested from the mildest down and the
first failure ends the row (a fixed sequence, which needs no further correction;
as k grows from cutoff to cutoff, the passing ones are always the mildest). The
lowest cutoff that passes is used; a rule without one rejects nothing in that stratum. With probability 1 - ALPHA every stratum loses
at most RISK of its good documents to these rules.

Counts of a text come from array functions over its own words: windows that may
occur twice are neighbours in one sorted array of (hash, position) numbers, cut to 64
bits; those are sorted again by their words, so the counts are exact at any length.

Defined results: null text has no words; a null stratum is a stratum of its own;
a stratum without labels keeps all that the base rules keep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glucoframe.llm.scratch import Scratch

#: share of good documents that a stratum may lose, and the chance that any bound fails
RISK, ALPHA = 0.02, 0.05
#: rules and their grids of cutoffs; a document is rejected above the cutoff
GRIDS = {
    "symbols_per_word": tuple(i / 20 for i in range(1, 41)),
    "repeated_share": tuple(i / 20 for i in range(1, 20)),
    "dup_line_share": tuple(i / 20 for i in range(1, 20)),
    "word_chars_mean": tuple(float(i) for i in range(4, 24)),
}
LOG_SQRT_2PI = 0.9189385332046727

_SPACE = r"[\x20\x09-\x0D]+"
#: characters of the symbol count, a fixed value
_SYMBOLS = "#*$%&|<>"


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def counted(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and the base counts of each text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(*keep, text.alias("__t"))
    d = d.withColumn("__w", F.filter(F.split("__t", _SPACE), lambda x: x != ""))
    d = d.withColumn("n_words", F.size("__w").cast("long"))
    # hash and position of each 3-word window in one number: the position in the low bits
    bits = F.ceil(F.log2(F.col("n_words") + 1)).cast("int")
    packed = F.transform(F.sequence(F.lit(1), F.col("n_words").cast("int") - 2), _window)
    d = d.withColumn("__b", bits)
    d = d.withColumn("__s", F.when(F.col("n_words") >= 3, F.sort_array(packed)))
    # positions of the windows whose hash a neighbour shares
    alike = F.expr("""
        filter(transform(__s, (x, k) ->
            CASE WHEN (k > 0 AND shiftright(__s[k - 1], __b) = shiftright(x, __b))
                   OR (k < n_words - 3 AND shiftright(__s[k + 1], __b) = shiftright(x, __b))
                 THEN CAST(x & (shiftleft(1L, __b) - 1) AS INT) END), p -> p IS NOT NULL)""")
    d = d.withColumn("__c", alike)
    # only these are compared by their words, which hold no space
    d = d.withColumn("__v", F.expr("""
        sort_array(transform(__c, p -> named_struct('words', concat_ws(' ', __w[p - 1], __w[p], __w[p + 1]), 'p', p)))"""))
    same = F.expr("""
        filter(transform(__v, (x, k) ->
            CASE WHEN (k > 0 AND __v[k - 1].words = x.words) OR (k < size(__v) - 1 AND __v[k + 1].words = x.words)
                 THEN x.p END), p -> p IS NOT NULL)""")
    d = d.withColumn("__p", F.sort_array(same))
    # a window covers three words, but not those that the next one covers too
    repeat = F.expr("""
        CASE WHEN size(__p) > 0 THEN
            aggregate(__p, named_struct('n', 0L, 'to', 0L),
                (a, p) -> named_struct('n', a.n + p + 3 - greatest(a.to, p), 'to', p + 3L), a -> a.n)
        ELSE 0L END""")
    lines = F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("__l", lines)
    chars = F.length("__t")
    return d.select(
        *keep, "n_words",
        F.length(_without(F.col("__t"), " \t\n\x0b\x0c\r")).cast("long").alias("word_chars"),
        (chars - F.length(_without(F.col("__t"), _SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(repeat, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"))


def _window(i: Column) -> Column:
    h = F.xxhash64(F.element_at("__w", i), F.element_at("__w", i + 1), F.element_at("__w", i + 2))
    return F.call_function("shiftleft", h, F.col("__b")).bitwiseOR(i.cast("long"))


def rule_values() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "symbols_per_word": F.col("n_symbols") / words,
        "repeated_share": F.col("n_repeat_words") / words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        "word_chars_mean": F.col("word_chars") / words,
    }


def _stirling_error(x: Column) -> Column:
    """log(x!) less Stirling's formula for it, x >= 1 (error below 1e-12)."""
    y = x + 8
    steps = (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7) * (x + 8)
    near = _stirling_series(y) + (y + 0.5) * F.log(y) - y - F.log(steps) - (x + 0.5) * F.log(x) + x
    return F.when(x < 16, near).otherwise(_stirling_series(x))


def _stirling_series(x: Column) -> Column:
    return 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5)) - 1 / (1680 * F.pow(x, 7))


def _deviance(x: Column, mean: Column) -> Column:
    """x log(x / mean) + mean - x, also where both are large and near to each other."""
    e = (x - mean) / mean
    return mean * ((1 + e) * F.log1p(e) - e)


def binomial_tail(n: Column, k: Column, p: Column) -> Column:
    """P(Bin(n, p) <= k) for k < n p and p <= 1/2: the terms from k down, each a ratio of the
    one before. The i-th is at most exp(-i (i - 1) / (2 n p (1 - p))) of the first, so what
    follows ten standard deviations is below the rounding error and is not added up."""
    n, k = n.cast("double"), k.cast("double")
    x, y = F.greatest(k, F.lit(1.0)), F.greatest(n - k, F.lit(1.0))
    log_top = (_stirling_error(n) - _stirling_error(x) - _stirling_error(y)
               - _deviance(x, n * p) - _deviance(y, n * (1 - p)) + 0.5 * F.log(n / (x * y)) - LOG_SQRT_2PI)
    top = F.when(k > 0, F.exp(log_top)).otherwise(F.exp(n * F.log1p(-p)))
    odds = (1 - p) / p
    steps = F.least(k, F.ceil(10 * F.sqrt(n * p * (1 - p))) + 10)
    terms = F.aggregate(
        F.sequence(F.lit(0), steps.cast("int")),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")),
        lambda a, i: F.struct((a["term"] * F.greatest(k - i, F.lit(0.0)) / (n - k + i + 1) * odds).alias("term"),
                              (a["sum"] + a["term"]).alias("sum")),
        lambda a: a["sum"])
    return top * terms


def cutoffs(holdout: DataFrame, risk: float = RISK, alpha: float = ALPHA) -> DataFrame:
    """``holdout(stratum, good, <rule values>)`` -> (stratum, rule, cutoff), one row per stratum
    and rule that has a cutoff."""
    rules = list(GRIDS)
    grid = F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("value"),
                              F.array(*map(F.lit, GRIDS[r])).alias("grid")) for r in rules))
    # per document the number of cutoffs it is above; per stratum and rule a small histogram
    tall = holdout.where("good").select("stratum", F.inline(grid))
    above = tall.groupBy("stratum", "rule", "grid", F.size(F.filter("grid", lambda c: F.col("value") > c)).alias("above")).agg(
        F.count(F.lit(1)).alias("docs"))
    per = above.groupBy("stratum", "rule", "grid").agg(
        F.sum("docs").alias("n"), F.collect_list(F.struct("above", "docs")).alias("hist"))
    strata = F.count(F.lit(1)).over(Window.partitionBy("rule"))  # one row per stratum
    tried = per.withColumn("strata", strata).select(
        "stratum", "rule", "n", "hist", "strata", F.posexplode("grid").alias("at", "cutoff"))
    rejected = F.aggregate("hist", F.lit(0).cast("long"), lambda s, h: s + F.when(h["above"] > F.col("at"), h["docs"]).otherwise(0))
    tried = tried.withColumn("k", rejected)
    limit = F.lit(risk / len(rules))
    level = F.lit(alpha / len(rules)) / F.col("strata")
    good = (F.col("k") < F.col("n") * limit) & (binomial_tail(F.col("n"), F.col("k"), limit) <= level)
    return tried.where(good).groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """One row per document: base counts, base verdict, and whether it is kept."""
    rules = rule_values()
    d = counted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(stratum).alias("stratum")), ["doc_id", "stratum"])
    # a few numbers per document, counted once for the holdout and the verdict
    d = Scratch(docs.sparkSession, "quality-rules").stored(d, "snappy").select("*", *(v.alias(r) for r, v in rules.items()))
    quality = (labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
               .agg((F.min("quality") == 1).alias("good")))
    chosen = cutoffs(d.join(quality, "doc_id").where("n_words > 0"))
    wide = chosen.groupBy("stratum").agg(*(
        F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in rules))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    bad = F.lit(False)
    for r in rules:
        bad = bad | F.coalesce(F.col(r) > F.col(f"cut_{r}"), F.lit(False))
    w = wide.withColumnRenamed("stratum", "__stratum")
    return (d.join(w, F.col("stratum").eqNullSafe(F.col("__stratum")), "left")
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    base.alias("base_failed"), (~base & ~bad).alias("kept")))
