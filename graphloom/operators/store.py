"""A quad store over a DataFrame (s, p, o): filters, set operations, text and vector searches, traversals, SPARQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import bounds, terms
from graphloom.operators import relations, similarity, traversal
from graphloom.operators.lineage import saved
from graphloom.sources import files
from graphloom.sources.files import BUCKET, of_predicates

#: Longer lists than this are joined, shorter ones are a pushed-down IN.
IN_LIST = 1000


class QuadStore:
    """A set of quads. Every method is lazy unless it walks the graph; mutation gives a new store."""

    def __init__(self, quads: DataFrame):
        self.quads = quads.select("s", "p", "o", *[c for c in quads.columns if c == BUCKET])

    # filters
    def filter(self, s: Sequence[str] | None = None, p: Sequence[str] | None = None, o: Sequence[str] | None = None) -> DataFrame:
        """Quads whose positions are in the lists; None is any, an empty list nothing."""
        out = self.quads
        for name, values in (("s", s), ("p", p), ("o", o)):
            if values is None:
                continue
            if name == "p" and values and len(values) <= IN_LIST:
                out = of_predicates(out, list(values))
            elif len(values) <= IN_LIST:
                out = out.where(F.col(name).isin(list(values)) if values else F.lit(False))
            else:
                wanted = out.sparkSession.createDataFrame([(v,) for v in values], f"{name} string").distinct()
                out = out.join(wanted, name, "left_semi")
        return out.select("s", "p", "o")

    def filter_subject(self, s: str) -> DataFrame:
        return self.filter(s=[s])

    def filter_predicate(self, p: str) -> DataFrame:
        return self.filter(p=[p])

    def filter_object(self, o: str) -> DataFrame:
        return self.filter(o=[o])

    def get_id(self, quad_id: int) -> DataFrame:
        return self.with_ids().where(F.col("id") == quad_id)

    def with_ids(self) -> DataFrame:
        return self.quads.select("s", "p", "o", F.xxhash64("s", "p", "o").alias("id"))

    def text_filter(self, p: str, text: str) -> DataFrame:
        """Quads of a predicate whose string object contains the text."""
        return self.quads.where((F.col("p") == p) & F.col("o").endswith("^^String") & terms.lexical(F.col("o")).contains(text))

    def distinct_objects(self, p: str) -> DataFrame:
        return self.quads.where(F.col("p") == p).select("o").distinct()

    def distinct_subjects(self, p: str) -> DataFrame:
        return self.quads.where(F.col("p") == p).select("s").distinct()

    # set operations
    def size(self) -> int:
        return self.quads.count()

    def is_empty(self) -> bool:
        return self.quads.isEmpty()

    def contains_all(self, other: DataFrame) -> bool:
        return other.select("s", "p", "o").join(self.quads, ["s", "p", "o"], "left_anti").isEmpty()

    def plus(self, other: DataFrame) -> QuadStore:
        return QuadStore(self.quads.select("s", "p", "o").unionByName(other.select("s", "p", "o")).dropDuplicates())

    add = plus

    def minus(self, other: DataFrame) -> QuadStore:
        return QuadStore(self.quads.join(other, ["s", "p", "o"], "left_anti"))

    def retain(self, other: DataFrame) -> QuadStore:
        return QuadStore(self.quads.join(other, ["s", "p", "o"], "left_semi"))

    def delete_object(self, node: str) -> QuadStore:
        """Without the node, all segments below it, and what is the same as any of them."""
        start = self.quads.sparkSession.createDataFrame([(node,)], "s string")
        below = traversal.reach(self.quads.where(F.col("p") == relations.SEGMENT_OF).select(F.col("o").alias("s"), F.col("s").alias("o")), start)
        gone = below.select(F.col("o").alias("x")).unionByName(start.withColumnRenamed("s", "x")).distinct()
        same = self.quads.where(F.col("p") == f"<{relations.SCHEMA}sameAs>").join(gone.withColumnRenamed("x", "o"), "o", "left_semi").select(F.col("s").alias("x"))
        gone = saved(gone.unionByName(same).distinct())
        return QuadStore(self.quads.join(gone.withColumnRenamed("x", "s"), "s", "left_anti").join(gone.withColumnRenamed("x", "o"), "o", "left_anti"))

    # vectors
    def knn(self, p: str, query: list[float], k: int, distance: str = "cosine", farthest: bool = False) -> DataFrame:
        return similarity.search(relations.vectors_of(self.quads, p), query, k, distance, farthest)

    def relevance_feedback(self, p: str, positives: list[str], negatives: list[str], k: int) -> DataFrame:
        """Top k by a classifier of example nodes (few, named in the request)."""
        rows = relations.vectors_of(self.quads, p)
        named = {r.s: r.v for r in rows.where(F.col("s").isin([*positives, *negatives])).collect()}
        return similarity.feedback(rows, [named[x] for x in positives if x in named], [named[x] for x in negatives if x in named], k)

    # traversals
    def path(self, seeds: list[str], predicates: list[str] | None = None, depth: int = 0, reverse: bool = False) -> DataFrame:
        return traversal.path(self.quads, self.quads.sparkSession.createDataFrame([(x,) for x in seeds], "node string"), predicates, depth, reverse)

    def neighbourhood(self, node: str) -> DataFrame:
        return traversal.neighbourhood(self.quads, node)

    def ancestors(self, node: str) -> DataFrame:
        """node, depth (from 1): what the node is a segment of, and so on up."""
        return self._chain(node, "s", "o")

    def descendants(self, node: str) -> DataFrame:
        """node, depth (from 1): the segments of the node, theirs, and so on down."""
        return self._chain(node, "o", "s")

    def _chain(self, node: str, here: str, there: str) -> DataFrame:
        edges = of_predicates(self.quads, [relations.SEGMENT_OF]).select(F.col(here).alias("node"), F.col(there).alias("next"))
        seen = frontier = self.quads.sparkSession.createDataFrame([(node, 0)], "node string, depth int")
        while not frontier.isEmpty():
            step = frontier.join(edges, "node").select(F.col("next").alias("node"), (F.col("depth") + 1).alias("depth")).distinct()
            frontier = saved(step.join(seen, "node", "left_anti"))
            seen = saved(seen.unionByName(frontier))
        return seen.where("depth > 0")

    def about(self, node: str) -> DataFrame:
        """part, s, p, o, rank, prefix: the quads that leave (out) and reach (in) a node, its ancestors by depth, and its direct
        segments by the area of their bounds, largest first; prefix is the namespace of the predicate."""
        none = F.lit(None).cast("double")
        own = traversal.neighbourhood(self.quads, node).withColumn("part", F.when(F.col("s") == node, "out").otherwise("in")).select("part", "s", "p", "o", none.alias("rank"))
        up = self.ancestors(node).select(F.lit("ancestor").alias("part"), F.lit(node).alias("s"), F.lit(relations.SEGMENT_OF).alias("p"), F.col("node").alias("o"), F.col("depth").cast("double").alias("rank"))
        boxes = of_predicates(self.quads, [relations.SEGMENT_BOUNDS]).select("s", bounds.area(bounds.parse(terms.lexical(F.col("o")))).alias("area"))
        down = of_predicates(self.quads, [relations.SEGMENT_OF]).where(F.col("o") == node).select("s", "p", "o").join(boxes, "s", "left")
        # one node's segments: ordered in one place
        order = F.row_number().over(Window.orderBy(F.desc_nulls_last("area"), "s")).cast("double")
        down = down.select(F.lit("segment").alias("part"), "s", "p", "o", order.alias("rank"))
        return own.unionByName(up).unionByName(down).withColumn("prefix", F.regexp_extract("p", r"^<(.*[/#])", 1))

    def resolve(self, node: str) -> DataFrame:
        """node, id, type: where a node's content is: of what it is the same as, if anything, the canonical id and type."""
        same = of_predicates(self.quads, [f"<{relations.SCHEMA}sameAs>"]).where(F.col("s") == node).select(F.col("o").alias("node"))
        start = self.quads.sparkSession.createDataFrame([(node,)], "node string").unionByName(same).distinct()
        fact = lambda p, n: of_predicates(self.quads, [f"<{relations.SCHEMA}{p}>"]).select(F.col("s").alias("node"), terms.lexical(F.col("o")).alias(n))
        return start.join(fact("canonicalId", "id"), "node").join(fact("canonicalMimeType", "type"), "node", "left")

    def add_files(self, path: str) -> QuadStore:
        """With the quads of the media files there; files whose content is known already add nothing."""
        new = files.media_quads(self.quads.sparkSession, path)
        known = of_predicates(self.quads, [f"<{relations.SCHEMA}rawId>"]).select("s")
        return self.plus(new.join(known, "s", "left_anti"))

    def dump(self, path: str, compression: str = "none") -> None:
        files.dump(self.quads.select("s", "p", "o"), path, compression=compression)

    def sparql(self, query: str) -> DataFrame:
        from graphloom.plans.sparql import select

        return select(query, self.quads)
