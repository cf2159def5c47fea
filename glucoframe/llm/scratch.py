"""Intermediate tables in the shared folder that the cluster names.

``stored`` writes a DataFrame as Parquet below ``spark.checkpoint.dir`` and reads
it again: lineage is cut, and every executor (also one that replaces a lost one)
can read the files. A folder of our own is chosen only on a local master where
the setting is unset.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="llm-shared-")
    try:
        spark.conf.set("spark.checkpoint.dir", path)
    except Exception:  # noqa: BLE001 - a core setting that may be refused at run time
        spark.sparkContext.setCheckpointDir(path)
        spark.sparkContext._conf.set("spark.checkpoint.dir", path)
    return path


class Scratch:
    """Tables of one operator call; ``drop`` deletes those the result no longer needs."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.paths: dict[int, str] = {}

    def stored(self, df: DataFrame, compression: str = "zstd") -> DataFrame:
        """``df`` written and read again; small numbers in many files do better with snappy,
        which takes no native memory per file."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.option("compression", compression).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(t)))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
