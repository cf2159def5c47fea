"""Places in a global order without a task per group: rows are range partitioned and sorted,
each partition counts its groups, and a small table of (partition, group) offsets makes the
local place a global one. The partitioned rows are written first, so places are fixed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glucoframe.llm.scratch import Scratch


def partitions_of(df: DataFrame) -> int:
    """As many as the input has, a few at least."""
    return max(df.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism)


def placed(scratch: Scratch, df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "place") -> DataFrame:
    """``df`` with the place (from 0) of each row within its group by ``order``; rows that tie
    in all of it may stand in either order. ``name`` and the names with a leading ``_p_`` must
    not be columns."""
    ranged = (df.repartitionByRange(partitions_of(df), *group, *order).sortWithinPartitions(*group, *order)
              .select("*", F.spark_partition_id().alias("_p_part"), F.monotonically_increasing_id().alias("_p_row")))
    stored = scratch.stored(ranged)
    runs = stored.groupBy("_p_part", *group).agg(F.count(F.lit(1)).alias("_p_n"), F.min("_p_row").alias("_p_first"))
    before = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy("_p_part").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = runs.select("_p_part", *group, "_p_first", F.coalesce(F.sum("_p_n").over(before), F.lit(0)).alias("_p_start"))
    same = F.col("l._p_part") == F.col("r._p_part")
    for g in group:
        same &= F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}"))
    return (stored.alias("l").join(starts.alias("r"), same)
            .select("l.*", (F.col("r._p_start") + F.col("l._p_row") - F.col("r._p_first")).alias(name))
            .drop("_p_part", "_p_row"))
