"""Layout operators: wide / array / long conversions, metadata attachment, column choice.

Array form = one row per sample with a bounded array (<= one day); long form =
one row per reading. Cross-sample work always runs on long form.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glucoframe.functions.glucose import DAY_SLOTS, is_missing



def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---- S3 / S4 ------------------------------------------------------------------
def to_long(df: DataFrame, key: str | Sequence[str], arr: str = "input_ids",
            pos: str = "pos", value: str = "value", keep_missing: bool = False) -> DataFrame:
    """S3 (array form): one row per element (key..., pos, value); missing dropped unless asked."""
    keys = [key] if isinstance(key, str) else list(key)
    out = df.select(*keys, F.posexplode(arr).alias(pos, value))
    if not keep_missing:
        out = out.filter(~is_missing(value))
    return out


def unpivot_slots(df: DataFrame, key: str | Sequence[str], slots: Sequence[str],
                  pos: str = "pos", value: str = "value", keep_missing: bool = False) -> DataFrame:
    """S3 (wide form): one column per slot -> (key..., pos, value); slot order gives pos."""
    keys = [key] if isinstance(key, str) else list(key)
    entries = F.array(*[F.struct(F.lit(i).alias(pos), F.col(c).cast("double").alias(value))
                        for i, c in enumerate(slots)])
    out = df.select(*keys, F.inline(entries))
    if not keep_missing:
        out = out.filter(~is_missing(value))
    return out


def to_array(df: DataFrame, key: str | Sequence[str], pos: str = "pos", value: str = "value",
             length: int = DAY_SLOTS, out: str = "input_ids", out_of_range: str = "raise") -> DataFrame:
    """Long -> fixed-length array per key; missing positions are null.

    One ``groupBy(key)`` collects the (bounded, <= ``length``) positions and
    values of each key; the scatter into a dense day then runs per Arrow batch
    with numpy (``mapInArrow``): one vectorised pass, O(length) per key whatever
    the density. Spark's built-in alternatives look every slot up in a map or
    list (O(length x readings), boxed) or build a 288-column pivot that
    overflows generated code inside larger stages. A null position, a position
    outside [0, length) and a repeated position raise; ``out_of_range="drop"``
    leaves rows outside out (a key without other rows then has no array).
    """
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import types as T

    keys = [key] if isinstance(key, str) else list(key)
    fields = {f.name: f for f in df.schema.fields}
    vtype = fields[value].dataType
    if out_of_range not in ("raise", "drop"):
        raise ValueError("to_array: out_of_range is 'raise' or 'drop'")
    inside = df.filter((F.col(pos) >= 0) & (F.col(pos) < length)) if out_of_range == "drop" else df
    # one list of structs keeps positions and (possibly null) values aligned
    g = inside.groupBy(*keys).agg(F.collect_list(F.struct(F.col(pos).cast("int").alias("p"),
                                                          F.col(value).alias("v"))).alias("_pv"))
    schema = T.StructType([fields[k] for k in keys] + [T.StructField(out, T.ArrayType(vtype))])
    nk = len(keys)

    def scatter(batches):
        for b in batches:
            n = b.num_rows
            pv = b.column(nk)
            rows = np.repeat(np.arange(n, dtype=np.int64), np.diff(pv.offsets.to_numpy()))
            entries = pv.flatten()
            flat_v = entries.field("v")
            at = entries.field("p").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            if ((at < 0) | (at >= length)).any():
                raise ValueError(f"to_array: a position is null or outside 0..{length - 1}")
            idx = rows * length + at
            if len(idx) and np.bincount(idx).max() > 1:
                raise ValueError("to_array: a position repeats within a key")
            dense = np.zeros(n * length, dtype=flat_v.type.to_pandas_dtype())
            valid = np.zeros(n * length, dtype=bool)
            dense[idx] = flat_v.to_numpy(zero_copy_only=False)
            valid[idx] = flat_v.is_valid().to_numpy(zero_copy_only=False)
            offsets = pa.array(np.arange(0, n * length + 1, length, dtype=np.int32))
            arr = pa.ListArray.from_arrays(offsets, pa.array(dense, type=flat_v.type, mask=~valid))
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(nk)] + [arr],
                                             names=[*keys, out])
    return g.mapInArrow(scatter, schema)


def filled_positions(arr: str | Column, length: int | None = None) -> Column:
    """Comma list of the positions that hold a value (digest of an array)."""
    a = _c(arr)
    n = F.lit(length) if length else F.size(a)
    idx = F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~is_missing(F.element_at(a, i + 1)))
    return F.array_join(idx, ",")


# ---- S5 / J1 / J2 / J3 ------------------------------------------------------------
def unmatched_keys(left: DataFrame, right: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Keys of ``left`` with no partner in ``right`` (left anti join)."""
    keys = [key] if isinstance(key, str) else list(key)
    return left.select(*keys).join(right.select(*keys), keys, "left_anti")


def assemble(seq: DataFrame, labels: DataFrame, key: str | Sequence[str],
             cols: Iterable[str] | None = None, strict: bool = False) -> DataFrame:
    """Attach chosen label columns to sequences by key (never by row order).

    ``strict=True`` raises when a sequence has no label row (the reference
    asserts equal lengths); the check is one anti join and an ``isEmpty``.
    Duplicate label keys are an error too in strict mode.
    """
    keys = [key] if isinstance(key, str) else list(key)
    lab = labels.select(*keys, *(cols or [c for c in labels.columns if c not in keys]))
    if strict:
        if not unmatched_keys(seq, lab, keys).isEmpty():
            raise ValueError("assemble: sequences without a label row")
        if not lab.groupBy(*keys).count().filter("count > 1").isEmpty():
            raise ValueError("assemble: duplicate label keys")
    return seq.join(lab, keys, "inner")


def align(vec: DataFrame, label: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """Label rows for each vector key; a missing key is an error in strict mode."""
    return assemble(vec, label, key, strict=strict)


def attach_label(result: DataFrame, summary: DataFrame, key: str,
                 cols: Iterable[str] | None = None) -> DataFrame:
    """Left lookup of label columns by key (rows of ``result`` are all kept)."""
    lab = summary.select(key, *(cols or [c for c in summary.columns if c != key]))
    return result.join(lab, key, "left")


def hstack(*dfs: DataFrame, key: str | Sequence[str], strict: bool = False) -> DataFrame:
    """Column-wise concatenation on an explicit key (inner), never by row order.

    ``strict=True`` raises when a key repeats in any input (a duplicate would
    multiply rows)."""
    keys = [key] if isinstance(key, str) else list(key)
    if strict:
        for d in dfs:
            if not d.groupBy(*keys).count().filter("count > 1").isEmpty():
                raise ValueError("hstack: duplicate keys")
    out = dfs[0]
    for d in dfs[1:]:
        out = out.join(d, key, "inner")
    return out


# ---- S7 ---------------------------------------------------------------------------
def concat_sources(*dfs: DataFrame, tag: str | None = None) -> DataFrame:
    """Append rows by column name; ``tag`` adds the source number."""
    out = None
    for i, d in enumerate(dfs):
        if tag:
            d = d.withColumn(tag, F.lit(i))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


# ---- P1-P16: projections, filters, predicates ---------------------------------------
def rename_label(df: DataFrame, col: str, to: str = "label") -> DataFrame:
    """Choose which column is the target."""
    return df.withColumnRenamed(col, to)


def keep_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Column projection (Q14: a projection, never a row selection)."""
    return df.select(*cols)


def drop_missing_target(df: DataFrame, col: str) -> DataFrame:
    """Drop rows whose target is null or NaN."""
    return df.filter(~is_missing(col))


def range_filter(df: DataFrame, col: str, lo: float, hi: float) -> DataFrame:
    """Keep rows with lo <= col <= hi."""
    return df.filter(F.col(col).between(lo, hi))


def null_outside(df: DataFrame, col: str, lo: float, hi: float) -> DataFrame:
    """P5: values outside [lo, hi] become null."""
    return df.withColumn(col, F.when(F.col(col).between(lo, hi), F.col(col)))


def filter_by_values(df: DataFrame, spec: Mapping[str, object]) -> DataFrame:
    """Keep rows whose columns are in the given lists (scalars become lists)."""
    cond = F.lit(True)
    for c, v in spec.items():
        vals = list(v) if isinstance(v, (list, tuple, set)) else [v]
        cond = cond & F.col(c).isin(vals)
    return df.filter(cond)


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """Rows whose key equals a value."""
    return df.filter(F.col(key) == F.lit(value))


def has_low(arr: str | Column, threshold: float = 70.0, inclusive: bool = False) -> Column:
    """P8 (array form): any reading under the threshold (Q2: ``inclusive`` = <=)."""
    def test(x):
        return (x <= threshold) if inclusive else (x < threshold)
    return F.exists(_c(arr), lambda x: F.coalesce(test(x), F.lit(False)))


def drop_cluster(df: DataFrame, name: str, col: str = "cluster") -> DataFrame:
    """Remove one reference cluster."""
    return df.filter(F.col(col) != F.lit(name))


def merge_classes(col: str | Column, mapping: Mapping) -> Column:
    """P10: literal class map; unmapped values stay."""
    c = _c(col)
    out = None
    for k, v in mapping.items():
        out = (F.when(c == F.lit(k), F.lit(v)) if out is None
               else out.when(c == F.lit(k), F.lit(v)))
    return c if out is None else out.otherwise(c)


def fill_absent_columns(df: DataFrame, cols: Sequence[str], value=0) -> DataFrame:
    """Add target columns that are not present (Q13)."""
    for c in cols:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(value))
    return df


def add_scaled_target(df: DataFrame, col: str, out: str = "label", standardise: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Copy of a target as a new column, or (``standardise``) less its mean and divided by its
    population standard deviation, over all rows or per ``by`` group. Null targets stay null; a
    target without spread is null."""
    if not standardise:
        return df.withColumn(out, F.col(col))
    mom = df.groupBy(*by).agg(F.avg(col).alias("_m"), F.stddev_pop(col).alias("_s"))
    if by:
        right = mom.select(*[F.col(b).alias(f"_b_{b}") for b in by], "_m", "_s")
        same = F.lit(True)
        for b in by:
            same = same & F.col(b).eqNullSafe(F.col(f"_b_{b}"))
        df = df.join(right, same).drop(*[f"_b_{b}" for b in by])
    else:
        df = df.crossJoin(F.broadcast(mom))  # one row
    spread = F.when(F.col("_s") != 0, F.col("_s"))
    return df.withColumn(out, F.try_divide(F.col(col) - F.col("_m"), spread)).drop("_m", "_s")


# Course values per class (fixed values): NGT 0, IGR 0.5, T2D 1, T1D 1
COURSE = {"NGT": 0.0, "IGR": 0.5, "T2D": 1.0, "T1D": 1.0}


def type_from_id(id_col: str | Column) -> Column:
    """The class is the second '_' part of a sample id."""
    return F.split(_c(id_col), "_").getItem(1)


def course_from_type(type_col: str | Column) -> Column:
    """Course value of a class (null for unknown classes)."""
    return _course(_c(type_col))


def _course(c: Column) -> Column:
    out = None
    for k, v in COURSE.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out


def wear_days(n: str | Column, gap_min: str | Column) -> Column:
    """Recorded days = readings x gap minutes / 1440."""
    return _c(n).cast("double") * _c(gap_min) / F.lit(1440.0)


def bmi(wt: str | Column, ht: str | Column) -> Column:
    """Weight / height squared (null when height is 0 or missing)."""
    return F.try_divide(_c(wt).cast("double"), _c(ht) * _c(ht))


def compose_id(cohort: str, type_col: str | Column, raw: str | Column, strip: bool = False) -> Column:
    """P16: '<cohort>_<type>_<raw id>'; ``strip`` removes '_' from the raw id."""
    r = _c(raw).cast("string")
    if strip:
        r = F.regexp_replace(r, "_", "")
    return F.concat_ws("_", F.lit(cohort), _c(type_col), r)


def parse_id(id_col: str | Column) -> dict:
    """Cohort, type and raw parts of a composed id."""
    parts = F.split(_c(id_col), "_", 3)
    return {"cohort": parts.getItem(0), "type": parts.getItem(1), "raw": parts.getItem(2)}
