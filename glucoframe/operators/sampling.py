"""Re-sampling, subsets, splits, batching and sharding.

All randomness is the stateless hash ``u(seed, keys)``; nothing depends on
partitioning or on the order rows arrive in. Re-sampling runs on long form:
each reading decides which derived samples it belongs to, so sparse days
cost what they hold, not 288 slots.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glucoframe.functions.glucose import DAY_SLOTS
from glucoframe.functions.hashing import u
from glucoframe.operators.ranking import global_rank, join_null_safe, rank_within


# ---- W1-W4: re-sampling of day series ----------------------------------------------------
def window_step(length: int, window: int, n: int) -> int:
    """Step of W1: (L - window) // (n - 1)."""
    return max((length - window) // max(n - 1, 1), 1)


def sliding_windows(rd: DataFrame, window: int = 96, n: int = 10, length: int = DAY_SLOTS,
                    sample: str = "sample_id", pos: str = "pos") -> DataFrame:
    """W1 (+W4): windows of ``window`` slots starting every (L - window)//(n - 1) slots.

    Long form: a reading at ``pos`` is emitted once for every window holding it,
    as (sample, win, offset = pos - start, ...other columns carried = W4).
    """
    step = window_step(length, window, n)
    n_win = (length - window) // step + 1
    wins = F.filter(F.sequence(F.lit(0), F.lit(n_win - 1)),
                    lambda w: (w * step <= F.col(pos)) & (F.col(pos) < w * step + window))
    out = rd.withColumn("win", F.explode(wins))
    return out.withColumn("offset", (F.col(pos) - F.col("win") * step).cast("int"))


def interval_sample(rd: DataFrame, n_parts: int = 96, n_draws: int = 10, length: int = DAY_SLOTS,
                    seed: int = 17, sample: str = "sample_id", pos: str = "pos") -> DataFrame:
    """``n_draws`` series, each with one reading drawn from every equal part.

    Part size = L // n_parts; in draw d the index drawn from part p is
    p*size + floor(u(seed, sample, d, p) * size). Long form: each reading is
    kept for the draws that pick it -> (sample, draw, part, value...).
    """
    size = length // n_parts
    out = rd.filter(F.col(pos) < n_parts * size).withColumn("part", (F.col(pos) / size).cast("int"))
    out = out.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))))
    pick = F.col("part") * size + F.floor(u(seed, sample, "draw", "part") * size).cast("int")
    return out.filter(F.col(pos) == pick)


def stride_sample(rd: DataFrame, window: int = 3, length: int = DAY_SLOTS,
                  sample: str = "sample_id", pos: str = "pos") -> DataFrame:
    """L // window sections (the first L mod sections hold one extra slot);
    sub-series k takes offset k of every section -> (sample, k, section, value...).

    Extra slots (offset >= window) are dropped, as in the reference.
    """
    n_sec = length // window
    q, r = length // n_sec, length % n_sec
    big = r * (q + 1)
    p = F.col(pos)
    sec = F.when(p < big, (p / (q + 1)).cast("int")).otherwise(
        (F.lit(r) + ((p - big) / q).cast("int")).cast("int"))
    start = sec * q + F.least(sec, F.lit(r))
    out = rd.filter((p >= 0) & (p < length)).withColumn("section", sec.cast("int"))
    out = out.withColumn("k", (p - start).cast("int"))
    return out.filter(F.col("k") < window)


# ---- W5-W9 -------------------------------------------------------------------------------------
def subset_n(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """First n rows of a seeded shuffle (TakeOrdered: a per-partition top-n, then merge)."""
    return df.orderBy(u(seed, key), F.col(key)).limit(n)


def stratified_split(df: DataFrame, label: str, frac: float, key: str, seed: int = 42,
                     out: str = "split") -> DataFrame:
    """Per class, the first floor(frac * n_class) rows of a seeded shuffle are 'test'.

    Ranks within the class are exact and skew-safe (see ``ranking``).
    """
    r = rank_within(df.withColumn("_u", u(seed, key)), [label], ["_u", key], out="_r")
    n = df.groupBy(label).agg(F.count("*").alias("_n"))
    r = join_null_safe(r, n, [label])  # a null class is a class of its own
    cut = F.floor(F.col("_n") * F.lit(frac))
    return (r.withColumn(out, F.when(F.col("_r") < cut, F.lit("test")).otherwise(F.lit("train")))
            .drop("_u", "_r", "_n"))


def random_split(df: DataFrame, frac: float, key: str, seed: int = 42, out: str = "split") -> DataFrame:
    """Stateless split, u(seed, key) < frac -> 'valid'."""
    return df.withColumn(out, F.when(u(seed, key) < frac, F.lit("valid")).otherwise(F.lit("train")))


def shuffle(df: DataFrame, key: str, seed: int = 42, num_partitions: int | None = None) -> DataFrame:
    """Seeded reorder: range partitions of u, sorted inside (no global single-task sort)."""
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    k = u(seed, key)
    return df.repartitionByRange(n, k, F.col(key)).sortWithinPartitions(k, F.col(key))


def fold_columns(df: DataFrame, key: str, fold: str = "fold", n_folds: int = 5, prefix: str = "CV_") -> DataFrame:
    """Boolean fold columns CV_1..CV_n (true: train) from one integer fold 0..n - 1."""
    return df.select(key, *[(F.col(fold) != k).alias(f"{prefix}{k + 1}") for k in range(n_folds)])


def cv_splits(seq: DataFrame, splits: DataFrame, key: str, folds: Sequence[str] | None = None) -> DataFrame:
    """One train and one test set per boolean fold column of ``splits`` (all but ``key`` by default).

    Rows of ``seq`` (all columns) once per fold, with ``fold`` (the column's name) and ``target``
    'train' or 'test'. A row with a null in a fold column, or without a row in ``splits``, is in neither
    set of that fold."""
    folds = list(folds) if folds is not None else [c for c in splits.columns if c != key]
    sides = F.array(*[F.struct(F.lit(c).alias("fold"), F.when(F.col(c), F.lit("train")).when(~F.col(c), F.lit("test")).alias("target"))
                      for c in folds])
    sets = splits.select(key, F.filter(sides, lambda s: s["target"].isNotNull()).alias("_sets"))
    return seq.join(sets, key).select(*seq.columns, F.inline("_sets"))


def save_cv_splits(split: DataFrame, path: str) -> None:
    """One folder per fold and target, as training runs read them."""
    split.write.mode("overwrite").partitionBy("fold", "target").parquet(path)


def load_cv_split(spark: SparkSession, path: str, fold: str, target: str) -> DataFrame:
    """One of the saved sets (only its folder is read)."""
    return spark.read.parquet(path).where((F.col("fold") == fold) & (F.col("target") == target)).drop("fold", "target")


# ---- W13 / W14 -----------------------------------------------------------------------------------
def length_grouped_batches(df: DataFrame, key: str, length: str, batch: int,
                           mega: int | None = None, seed: int = 42) -> DataFrame:
    """Seeded permutation, mega-batches of ``mega * batch`` rows sorted by length
    (descending, stable), the globally longest row swapped to the very front.

    Default ``mega`` = min(n // (4 * batch), 50), at least 1. Adds ``mega_id``,
    ``pos_in_mega`` and ``order`` (global position).
    """
    n = df.agg(F.count("*").alias("_n"))
    perm = global_rank(df.withColumn("_u", u(seed, key)), ["_u", key], out="_perm")
    if mega is None:
        mult = F.greatest(F.least((F.col("_n") / (batch * 4)).cast("long"), F.lit(50)), F.lit(1))
    else:
        mult = F.lit(mega)
    perm = perm.crossJoin(F.broadcast(n)).withColumn("_msize", mult * batch)
    perm = perm.withColumn("mega_id", (F.col("_perm") / F.col("_msize")).cast("long"))
    # inside a mega-batch (bounded: at most 50 * batch rows) sort by length desc, stable
    w = Window.partitionBy("mega_id").orderBy(F.col(length).desc(), F.col("_perm"))
    perm = perm.withColumn("pos_in_mega", (F.row_number().over(w) - 1).cast("long"))
    # mega-batch holding the longest first element (first one on ties)
    heads = perm.filter("pos_in_mega = 0").select("mega_id", key, F.col(length).alias("_len"))
    best = heads.agg(F.max(F.struct(F.col("_len").alias("l"), (-F.col("mega_id")).alias("m"))).alias("_b"))
    best = best.select((-F.col("_b").getField("m")).alias("_max_mega"))
    first0 = heads.filter("mega_id = 0").select(F.col(key).alias("_k0"))
    perm = perm.crossJoin(F.broadcast(best)).crossJoin(F.broadcast(first0))
    swap_key = F.col(key) == F.col("_k0")
    is_max_head = (F.col("mega_id") == F.col("_max_mega")) & (F.col("pos_in_mega") == 0)
    perm = perm.withColumn("mega_id", F.when(swap_key & (F.col("pos_in_mega") == 0), F.col("_max_mega"))
                           .when(is_max_head, F.lit(0).cast("long")).otherwise(F.col("mega_id")))
    perm = perm.withColumn("order", F.col("mega_id") * F.col("_msize") + F.col("pos_in_mega"))
    return perm.drop("_u", "_perm", "_n", "_msize", "_max_mega", "_k0")


def assign_shards(df: DataFrame, key: str, n_proc: int, batch: int, drop_last: bool = False,
                  seed: int | None = None, contiguous: bool = False) -> DataFrame:
    """Distribute rows to ``n_proc`` workers.

    Batch-wise round-robin (default): position j of the (wrapped) index list
    goes to worker (j // batch) mod n_proc at local position
    (j // (batch * n_proc)) * batch + j mod batch; the list is filled to a
    multiple of batch * n_proc by repeating its head (or cut with ``drop_last``).
    ``contiguous``: each worker takes one contiguous block of
    ceil(n / (batch * n_proc)) * batch positions.
    Order = ``seed`` shuffle or ``key`` order. Output rows: (key, j, worker, local_pos).
    """
    order = [u(seed, key), F.col(key)] if seed is not None else [F.col(key)]
    r = global_rank(df.select(key), order, out="_r")
    n = df.agg(F.count("*").alias("_n"))
    tbs = batch * n_proc
    if contiguous:
        per = (F.ceil(F.col("_n") / F.lit(tbs)) * batch).cast("long")
        total = per * n_proc
    elif drop_last:
        total = ((F.col("_n") / tbs).cast("long") * tbs).cast("long")
        per = total / n_proc
    else:
        total = (F.ceil(F.col("_n") / F.lit(tbs)) * tbs).cast("long")
        per = total / n_proc
    n = n.select("_n", total.alias("_total"), per.cast("long").alias("_per"))
    r = r.crossJoin(F.broadcast(n))
    copies = F.sequence(F.lit(0), F.greatest((F.ceil(F.col("_total") / F.col("_n")) - 1).cast("int"), F.lit(0)))
    r = r.withColumn("_m", F.explode(copies)).withColumn("j", F.col("_r") + F.col("_m") * F.col("_n"))
    r = r.filter(F.col("j") < F.col("_total"))
    if contiguous:
        worker = (F.col("j") / F.col("_per")).cast("int")
        local = F.col("j") % F.col("_per")
    else:
        worker = ((F.col("j") / batch).cast("long") % n_proc).cast("int")
        local = (F.col("j") / tbs).cast("long") * batch + F.col("j") % batch
    return r.select(key, F.col("j").cast("long").alias("j"), worker.alias("worker"),
                    local.cast("long").alias("local_pos"))
