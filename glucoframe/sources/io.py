"""Sources and sinks (S1, S2, S6, S8-S10): explicit schemas, no inference, no driver data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glucoframe.functions.glucose import DAY_SLOTS
from glucoframe.operators.shape import unpivot_slots


def read_csv_by_name(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The columns of ``schema`` of CSV files, found by header name in any order; other columns are
    left out. A missing column, a malformed value and a file whose header differs from the
    first one's raise."""
    want = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = spark.read.csv(path, header=True).columns
    if missing := [f.name for f in want if f.name not in names]:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    types = {f.name: f.dataType for f in want}
    by_file = T.StructType([T.StructField(n, types.get(n, T.StringType())) for n in names])
    df = spark.read.csv(path, header=True, schema=by_file, enforceSchema=False, mode="FAILFAST")
    return df.select(*want.fieldNames())


def day_matrix_schema(key: str = "key", n_slots: int = DAY_SLOTS, prefix: str = "s") -> T.StructType:
    return T.StructType([T.StructField(key, T.StringType())]
                        + [T.StructField(f"{prefix}{i}", T.DoubleType()) for i in range(n_slots)])


def read_day_matrix(spark: SparkSession, path: str, key: str = "key", n_slots: int = DAY_SLOTS,
                    prefix: str = "s", long: bool = True) -> DataFrame:
    """Wide CSV with a key column and one column per slot, found by header name.

    ``long=True`` melts it to (key, pos, value) with missing slots dropped (S3)."""
    df = read_csv_by_name(spark, path, day_matrix_schema(key, n_slots, prefix))
    if not long:
        return df
    return unpivot_slots(df, key, [f"{prefix}{i}" for i in range(n_slots)])


def write_day_matrix(rd: DataFrame, path: str, key: str = "sample_id", pos: str = "pos",
                     value: str = "value", n_slots: int = DAY_SLOTS, prefix: str = "s") -> None:
    """Long readings -> wide CSV (pivot over the known slot list; no value discovery job)."""
    slots = [f"{prefix}{i}" for i in range(n_slots)]
    wide = (rd.withColumn("_slot", F.concat(F.lit(prefix), F.col(pos).cast("string")))
            .groupBy(key).pivot("_slot", slots).agg(F.first(value)))
    wide.write.mode("overwrite").option("header", True).csv(path)


def read_labels(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Label / clinical / split / cluster CSV; the declared columns by header name."""
    return read_csv_by_name(spark, path, schema)


def save(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Dataset persistence as parquet (optionally partitioned, e.g. by fold and split)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """Read a saved dataset (partition columns restored, filters prune directories)."""
    return spark.read.parquet(path)


def write_metrics(metrics: DataFrame, path: str, mode: str = "append") -> None:
    """Metrics rows (run, split, metric, value) appended as JSON lines."""
    metrics.write.mode(mode).json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    schema = "run long, split string, metric string, value double"
    return spark.read.schema(schema).json(path)


def write_embeddings(df: DataFrame, path: str, keys: Sequence[str], dim: int, vec: str = "vec",
                     fmt: str = "csv") -> None:
    """Embedding table with labels; the vector becomes columns d0..d{dim-1}."""
    cols = [F.element_at(vec, i + 1).alias(f"d{i}") for i in range(dim)]
    out = df.select(*keys, *cols)
    if fmt == "csv":
        out.write.mode("overwrite").option("header", True).csv(path)
    else:
        out.write.mode("overwrite").parquet(path)


def read_embeddings(spark: SparkSession, path: str, keys: Sequence[tuple[str, str]], dim: int,
                    vec: str = "vec") -> DataFrame:
    """Inverse of :func:`write_embeddings` for CSV: columns -> one array column."""
    schema = ", ".join([f"{k} {t}" for k, t in keys] + [f"d{i} double" for i in range(dim)])
    df = read_csv_by_name(spark, path, schema)
    return df.select(*[k for k, _ in keys], F.array(*[F.col(f"d{i}") for i in range(dim)]).alias(vec))


def read_gene_counts(spark: SparkSession, path: str) -> DataFrame:
    """Every file of a directory of long (cell, gene, n) triples."""
    return spark.read.schema("cell long, gene long, n double").parquet(path)
