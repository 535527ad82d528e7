"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import checkpointed


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (the smallest node that it reaches) for every node of an edge. Null ends are left out, loops and
    repeated edges count once.

    Each round hangs every node's larger neighbours on its smallest one, then its smaller ones, so that components turn
    into stars in about log n rounds; groups are only ever aggregated to their minimum, so a hub needs no large task.
    """
    star = checkpointed(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"`{a}` IS NOT NULL AND `{b}` IS NOT NULL AND u <> v").distinct())
    while True:
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("v1")).select("u", F.least("u", "v1").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_min, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        new = checkpointed(small)
        # done once every node hangs on one that hangs on nothing
        if new.join(new.select(F.col("u").alias("v")), "v", "left_semi").isEmpty() and new.groupBy("u").count().where("count > 1").isEmpty():
            break
        star = new
    return new.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(new.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
