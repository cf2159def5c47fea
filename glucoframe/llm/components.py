"""Connected components by repeated contraction.

Every round maps each vertex to the smallest vertex of its closed neighbourhood
and renames the edges; loops vanish, so the edge table shrinks quickly. The maps
are composed backwards at the end. Only grouped minima and joins are used: no
neighbour list is ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glucoframe.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges(a, b)`` -> ``(v, root)`` for every vertex of an edge; ``root`` is
    one vertex of its component, the same for all of them. Loops and repeated
    edges are allowed; an empty table gives an empty result."""
    cur = scratch.stored(edges.select("a", "b").where("a != b").distinct())
    maps: list[DataFrame] = []
    while not cur.isEmpty():
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = scratch.stored(both.groupBy(F.col("a").alias("v")).agg(
            F.least(F.col("v"), F.min("b")).alias("m")))
        maps.append(near)
        nxt = (cur.join(near.select(F.col("v").alias("a"), F.col("m").alias("ma")), "a")
               .join(near.select(F.col("v").alias("b"), F.col("m").alias("mb")), "b")
               .where("ma != mb")
               .select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).distinct())
        nxt = scratch.stored(nxt)
        scratch.drop(cur)
        cur = nxt
    if not maps:
        return cur.select(F.col("a").alias("v"), F.col("b").alias("root"))
    out = maps[-1].select("v", F.col("m").alias("root"))
    for near in reversed(maps[:-1]):
        out = scratch.stored(
            near.join(out.select(F.col("v").alias("m"), "root"), "m", "left")
            .select("v", F.coalesce("root", "m").alias("root")))
    return out
