"""Traversals: reachability, path queries, neighbourhoods, ancestors and descendants. Frontiers grow by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.lineage import saved


def reach(edges: DataFrame, starts: DataFrame | None = None, depth: int = 0) -> DataFrame:
    """(s, o): o is reached from s by one edge or more (at most `depth`, 0: any number); from the starts (column s) only,
    if given. Each round extends just the pairs that were new, so cycles end it."""
    step = saved(edges.select("s", "o").distinct())
    new = step if starts is None else step.join(starts.select("s").distinct(), "s", "left_semi")
    found = new = saved(new)
    hops = 1
    while (depth <= 0 or hops < depth) and not new.isEmpty():
        longer = new.select("s", F.col("o").alias("m")).join(step.select(F.col("s").alias("m"), "o"), "m").select("s", "o").distinct()
        new = saved(longer.join(found, ["s", "o"], "left_anti"))
        found = saved(found.unionByName(new))
        hops += 1
    return found


def path(quads: DataFrame, seeds: DataFrame, predicates: list[str] | None = None, depth: int = 0, reverse: bool = False) -> DataFrame:
    """The quads that a breadth-first walk from the seeds (column node) crosses, at most `depth` hops (0: all)."""
    own = quads if not predicates else quads.where(F.col("p").isin(predicates))
    here, there = ("o", "s") if reverse else ("s", "o")
    own = saved(own.select("s", "p", "o").distinct())
    seen = frontier = saved(seeds.select("node").distinct())
    out, hops = None, 0
    while (depth <= 0 or hops < depth) and not frontier.isEmpty():
        crossed = own.join(frontier.withColumnRenamed("node", here), here, "left_semi").select("s", "p", "o")
        out = crossed if out is None else out.unionByName(crossed)
        frontier = saved(crossed.select(F.col(there).alias("node")).distinct().join(seen, "node", "left_anti"))
        seen = saved(seen.unionByName(frontier))
        hops += 1
    return own.limit(0) if out is None else out.distinct()


def neighbourhood(quads: DataFrame, node: str) -> DataFrame:
    """The quads with the node at either end."""
    return quads.where((F.col("s") == node) | (F.col("o") == node)).select("s", "p", "o").distinct()
