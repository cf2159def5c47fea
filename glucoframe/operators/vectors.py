"""Embedding vectors: pooling, cluster similarity / assignment, cross tables, MI.

Vectors are ``ARRAY<DOUBLE>`` columns of a fixed small width. Cross-row work
(means per sample, per person, per cluster) is an aggregate over whole vectors
with partial sums before the shuffle: one row per key and task, not one per dimension.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CLUSTERS = 10_000  # up to so many centroids are broadcast, more are joined in blocks
MAX_SIZES = 100_000  # up to so many class sizes are broadcast (adjusted MI), more are joined in blocks
MI_STEP = 10_000  # terms of the expected MI that one row expands into


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2norm(a) -> Column:
    return F.sqrt(dot(a, a))


def unit(a) -> Column:
    """a / |a|; the zero vector stays zero (its cosine with anything is 0).

    The norm is evaluated once per row (``array_repeat``), not once per element
    inside the lambda."""
    a = _c(a)
    return F.zip_with(a, F.array_repeat(l2norm(a), F.size(a)),
                      lambda x, n: F.when(n > 0, x / n).otherwise(F.lit(0.0)))


def mean_vectors(df: DataFrame, keys: Sequence[str], vec: str = "vec", out: str = "vec") -> DataFrame:
    """Per-key mean vector by an aggregate over whole arrays: partial sums per key before the
    shuffle, one row per key in it. Null vectors are left out."""
    m = df.filter(_c(vec).isNotNull()).groupBy(*keys).agg(Summarizer.mean(array_to_vector(_c(vec))).alias("_m"))
    return m.select(*keys, vector_to_array("_m").alias(out))


# ---- A20 / A31 ------------------------------------------------------------------------------
def sample_mean_pool(token_vecs: DataFrame, sample: str = "sample_id", tpos: str = "tpos",
                     vec: str = "vec", style: str = "mean",
                     exclude_cls: bool = False, pad_mask: DataFrame | None = None) -> DataFrame:
    """One vector per sample from token vectors (sample, tpos, vec).

    style 'mean' averages non-pad positions (``pad_mask`` rows (sample, tpos)
    mark pads; <cls> at tpos 0 is excluded with ``exclude_cls``); style 'cls'
    takes position 0 (Q16: the choice is explicit).
    """
    t = token_vecs
    if style == "cls":
        return t.filter(F.col(tpos) == 0).select(sample, vec)
    if exclude_cls:
        t = t.filter(F.col(tpos) > 0)
    if pad_mask is not None:
        t = t.join(pad_mask.select(sample, tpos), [sample, tpos], "left_anti")
    return mean_vectors(t, [sample], vec)


def two_layer_pool(first: DataFrame, second: DataFrame, sample: str = "sample_id", vec: str = "vec", **pool) -> DataFrame:
    """A20 (two-layer variant): the pooled vectors of two layers, one after the other."""
    return concat_layers(sample_mean_pool(first, sample, vec=vec, **pool), sample_mean_pool(second, sample, vec=vec, **pool), sample, vec)


def concat_layers(a: DataFrame, b: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    """A20 (two-layer variant): concatenate two pooled vectors of the same key."""
    return a.join(b.withColumnRenamed(vec, "_b"), key).select(key, F.concat(vec, "_b").alias(vec))


def merge_to_sample_level(day_vecs: DataFrame, person: str = "person", vec: str = "vec") -> DataFrame:
    """Several day vectors of one person -> their mean vector."""
    return mean_vectors(day_vecs, [person], vec)


# ---- A21 / A22 ------------------------------------------------------------------------------
def cluster_centroids(refs: DataFrame, cluster: str = "cluster", vec: str = "vec") -> DataFrame:
    """Mean of the unit reference vectors per cluster (k rows)."""
    return mean_vectors(refs.select(cluster, unit(vec).alias("u")), [cluster], "u", out="centroid")


def _blocks(df: DataFrame, most: int) -> int:
    """Number of blocks of about ``most`` rows, 1 or more."""
    return max(1, -(-df.count() // most))


def _scored(targets: DataFrame, refs: DataFrame, key: str, cluster: str, vec: str,
            max_clusters: int) -> DataFrame:
    """Targets with ``_sims`` = array of (cluster, mean cosine), one entry per cluster; beyond
    ``max_clusters`` one row per target and block of clusters."""
    cents = cluster_centroids(refs, cluster, vec)
    blocks = _blocks(cents, max_clusters)
    entries = F.collect_list(F.struct(F.col(cluster).alias("c"), F.col("centroid").alias("v"))).alias("_cents")
    t = targets.select(key, F.col(vec).alias("_t"), l2norm(vec).alias("_n"))
    if blocks == 1:
        t = t.crossJoin(F.broadcast(cents.agg(entries)))  # one row
    else:
        parts = cents.groupBy(F.pmod(F.xxhash64(cluster), F.lit(blocks)).alias("_block")).agg(entries)
        t = t.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(parts, "_block")
    # cos(t, centroid) = (t . centroid) / |t|; |t| once per row, dots once per centroid
    raw = F.transform("_cents", lambda c: F.struct(c["c"].alias("c"), dot("_t", c["v"]).alias("d")))
    block = ["_block"] if blocks > 1 else []
    t = t.select(key, *block, "_n", raw.alias("_raw"))
    sims = F.zip_with("_raw", F.array_repeat(F.col("_n"), F.size("_raw")), lambda r, n: F.struct(
        r["c"].alias(cluster), F.when(n > 0, r["d"] / n).otherwise(F.lit(0.0)).alias("sim")))
    return t.select(key, *block, sims.alias("_sims"))


def cluster_similarity(targets: DataFrame, refs: DataFrame, key: str = "vec_id",
                       cluster: str = "cluster", vec: str = "vec",
                       max_clusters: int = MAX_CLUSTERS) -> DataFrame:
    """Mean cosine of each target to the references of each cluster.

    No target x reference pairs: mean_r cos(t, r) = unit(t) . mean_r unit(r),
    so each target meets only the k cluster centroids. The k centroids are
    counted (size check) and broadcast as one row holding an array; every
    target row then scores them in place. More than ``max_clusters`` are dealt
    into blocks, and targets meet block by block. Output long (key, cluster, sim).
    """
    return _scored(targets, refs, key, cluster, vec, max_clusters).select(key, F.inline("_sims"))


def assign_cluster(targets: DataFrame, refs: DataFrame, key: str = "vec_id",
                   cluster: str = "cluster", vec: str = "vec",
                   max_clusters: int = MAX_CLUSTERS) -> DataFrame:
    """The cluster with the highest mean cosine per target; ties -> smallest name.

    The argmax runs inside each target row over its k scores (no shuffle). With
    more than ``max_clusters`` clusters the winners of the blocks meet in one
    grouped minimum, for which the key must be unique.
    """
    t = _scored(targets, refs, key, cluster, vec, max_clusters)
    best = F.aggregate(
        "_sims", F.get("_sims", F.lit(0)),
        lambda acc, x: F.when((x["sim"] > acc["sim"])
                              | ((x["sim"] == acc["sim"]) & (x[cluster] < acc[cluster])), x).otherwise(acc))
    won = t.select(key, best.alias("_b"))
    if "_block" in t.columns:
        won = won.groupBy(key).agg(F.min_by("_b", F.struct(-F.col("_b")["sim"], F.col("_b")[cluster])).alias("_b"))
    return won.select(key, F.col("_b")[cluster].alias(cluster), F.col("_b")["sim"].alias("sim"))


# ---- A23 / A24 ------------------------------------------------------------------------------
def crosstab(df: DataFrame, row: str, col: str, row_values: Sequence[str] | None = None,
             col_values: Sequence[str] | None = None) -> DataFrame:
    """Full count grid with zeros; rows/columns in the given orders (absent ones kept)."""
    g = df.groupBy(row).pivot(col, list(col_values) if col_values else None).count()
    if row_values is not None:
        rows = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(row_values)],
                                               f"{row} string, _ord int")
        g = rows.join(g, row, "left").orderBy("_ord").drop("_ord")
    value_cols = [c for c in g.columns if c != row]
    return g.select(row, *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in value_cols])


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mutual information (natural log) of two labelings and its arithmetic-mean
    normalisation, from contingency counts.

    One grouped aggregate gives the cells; marginals are windows over the cells of
    one class, n is a one-row aggregate that is broadcast.
    H(a) = -sum_cells (n_ij / n) ln(a_i / n), likewise H(b).
    """
    from pyspark.sql import Window
    cells = df.groupBy(a, b).agg(F.count("*").alias("_nij"))
    total = cells.agg(F.sum("_nij").alias("_n"))
    cells = (cells.withColumn("_ai", F.sum("_nij").over(Window.partitionBy(a)))
             .withColumn("_bj", F.sum("_nij").over(Window.partitionBy(b)))
             .crossJoin(F.broadcast(total)))
    p = F.col("_nij") / F.col("_n")
    out = cells.agg(F.sum(p * F.log(F.col("_n") * F.col("_nij") / (F.col("_ai") * F.col("_bj")))).alias("mi"),
                    F.sum(-p * F.log(F.col("_ai") / F.col("_n"))).alias("h_a"),
                    F.sum(-p * F.log(F.col("_bj") / F.col("_n"))).alias("h_b"))
    return out.select("mi", "h_a", "h_b",
                      F.try_divide(F.col("mi"), (F.col("h_a") + F.col("h_b")) / 2.0).alias("nmi"))


def log_factorial(n) -> Column:
    """ln(n!) as a column expression: exact below 10, Stirling series above
    (absolute error below 1e-12). Spark SQL has no log-gamma function."""
    import math
    c = _c(n).cast("double")
    small = None
    for k in range(10):
        v = F.lit(math.lgamma(k + 1))
        small = F.when(c == k, v) if small is None else small.when(c == k, v)
    stirling = (c * F.log(c) - c + 0.5 * F.log(2.0 * math.pi * c) + 1.0 / (12.0 * c)
                - 1.0 / (360.0 * c * c * c) + 1.0 / (1260.0 * F.pow(c, 5)) - 1.0 / (1680.0 * F.pow(c, 7)))
    return small.otherwise(stirling)


def adjusted_mutual_information(df: DataFrame, a: str, b: str,
                                max_sizes: int = MAX_SIZES, step: int = MI_STEP) -> DataFrame:
    """A24 (adjusted): AMI = (MI - E[MI]) / (mean(H(a), H(b)) - E[MI]) with E[MI] under
    the hypergeometric model of fixed marginals (arithmetic mean, as scikit-learn).

    E[MI] sums, for every pair of classes (i, j) of the two marginals, over
    n_ij = max(1, a_i + b_j - N) .. min(a_i, b_j). Classes of equal size share
    their terms, so only distinct sizes are paired: those of b are broadcast up to
    ``max_sizes``, beyond it joined in blocks. A row expands into at most ``step``
    terms at a time.
    """
    base = mutual_information(df, a, b)
    cells = df.groupBy(a, b).agg(F.count("*").alias("_nij"))
    ra = cells.groupBy(a).agg(F.sum("_nij").alias("_ai")).groupBy("_ai").agg(F.count("*").alias("_ma"))
    rb = cells.groupBy(b).agg(F.sum("_nij").alias("_bj")).groupBy("_bj").agg(F.count("*").alias("_mb"))
    n = cells.agg(F.sum("_nij").alias("_n"))  # one row
    blocks = _blocks(rb, max_sizes)
    if blocks == 1:
        pairs = ra.crossJoin(F.broadcast(rb))
    else:
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
        pairs = ra.withColumn("_block", every).join(
            rb.withColumn("_block", F.pmod(F.xxhash64("_bj"), F.lit(blocks))), "_block")
    pairs = pairs.crossJoin(F.broadcast(n))
    lo = F.greatest(F.lit(1).cast("long"), F.col("_ai") + F.col("_bj") - F.col("_n"))
    hi = F.least(F.col("_ai"), F.col("_bj"))
    fixed = ["_ai", "_bj", "_n", "_ma", "_mb"]
    starts = pairs.filter(lo <= hi).select(*fixed, hi.alias("_hi"), F.explode(F.sequence(lo, hi, F.lit(step).cast("long"))).alias("_from"))
    terms = starts.select(*fixed, F.explode(F.sequence("_from", F.least("_hi", F.col("_from") + (step - 1)))).alias("_k"))
    ai, bj, nn, k = F.col("_ai"), F.col("_bj"), F.col("_n"), F.col("_k")
    gln = (log_factorial(ai) + log_factorial(bj) + log_factorial(nn - ai) + log_factorial(nn - bj)
           - log_factorial(nn) - log_factorial(k) - log_factorial(ai - k) - log_factorial(bj - k)
           - log_factorial(nn - ai - bj + k))
    term = F.col("_ma") * F.col("_mb") * (k / nn) * (F.log(nn * k) - F.log(ai * bj)) * F.exp(gln)
    emi = terms.agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("emi"))
    out = base.crossJoin(emi)
    norm = (F.col("h_a") + F.col("h_b")) / 2.0
    den = norm - F.col("emi")
    eps = 2.220446049250313e-16
    den = F.when(den < 0, F.least(den, F.lit(-eps))).otherwise(F.greatest(den, F.lit(eps)))
    trivial = (F.col("h_a") == 0) & (F.col("h_b") == 0)
    ami = F.when(trivial, F.lit(1.0)).otherwise((F.col("mi") - F.col("emi")) / den)
    return out.select("mi", "emi", "nmi", ami.alias("ami"))
