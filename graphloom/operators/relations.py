"""Virtual relations: computed from the graph when a query names their predicate, never stored."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import bounds, terms
from graphloom.operators import similarity

BASE = "http://graphloom.example/"
SCHEMA, IMPLICIT, DERIVED = BASE + "schema#", BASE + "implicit/", BASE + "derived/"
SEGMENT_OF, SEGMENT_BOUNDS, BOUNDS, EMBEDDING = f"<{SCHEMA}segmentOf>", f"<{SCHEMA}segmentBounds>", f"<{SCHEMA}bounds>", f"<{DERIVED}clipEmbedding>"


def vectors_of(quads: DataFrame, predicate: str) -> DataFrame:
    """Rows (s, v) of the vectors under a predicate."""
    return quads.where(F.col("p") == predicate).select("s", terms.elements(F.col("o")).alias("v")).where("v IS NOT NULL")


def together(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    """The inner join on the names, for frames of which each row meets many: neither is broadcast and partitions aren't merged,
    since the work goes by pairs and not by the size of the frames."""
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = lambda df: df.repartition(parts, *[F.col(f"`{n}`") for n in names])
    return spread(left).hint("merge").join(spread(right), names)


def _pairs(rows: DataFrame, test: Callable[[Callable, Callable], Column] | None = None) -> DataFrame:
    """Pairs (s, o) of different subjects of which rows (s, parent, ...) with one parent pass the test, each pair once. Two
    subjects with one row each meet once; only pairs with a subject of several rows have to be made distinct."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = rows.withColumn("rows", F.count(F.lit(1)).over(Window.partitionBy("s"))).repartition(parts, "parent")
    kept = [c for c in own.columns if c != "parent"]

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.select("parent", *[F.col(c).alias(f"other_{c}") for c in kept])
        both = a.hint("merge").join(b, "parent").where(F.col("s") != F.col("other_s"))
        if test is not None:
            both = both.where(test(F.col, lambda c: F.col(f"other_{c}")))
        return both

    end = [F.col("s"), F.col("other_s").alias("o")]
    once = met(own, own).where(F.col("rows") + F.col("other_rows") == 2).select(*end)
    several = own.where(F.col("rows") > 1)
    more = F.col("rows") + F.col("other_rows") > 2  # of the same columns as above, so that one shuffle serves both
    again = met(several, own).where(more).select(*end).unionByName(met(own, several).where(more).select(*end)).distinct()
    return once.unionByName(again)


def siblings(quads: DataFrame, predicate: str = SEGMENT_OF) -> DataFrame:
    """Pairs of different segments of one parent."""
    return _pairs(quads.where(F.col("p") == predicate).select("s", F.col("o").alias("parent")))


def _bounded(quads: DataFrame, bounds_of: str, fields: tuple[str, ...] = bounds.FIELDS) -> DataFrame:
    """Segments with their parent and these fields of their bounds: (s, parent, b)."""
    parent = quads.where(F.col("p") == SEGMENT_OF).select("s", F.col("o").alias("parent"))
    held = quads.where(F.col("p") == bounds_of).select("s", bounds.parse(terms.lexical(F.col("o")), fields).alias("b"))
    return parent.repartition("s").hint("merge").join(held.repartition("s"), "s")


def spatial(quads: DataFrame, name: str, compatible: bool = False) -> DataFrame:
    """Pairs of siblings whose bounds stand in the relation: an equi-join on the parent with a predicate on columns. The
    compatible meaning of a few relations is that of bounds.COMPATIBLE."""
    test = (bounds.COMPATIBLE if compatible else bounds.SPATIAL)[name]
    return _pairs(_bounded(quads, SEGMENT_BOUNDS), lambda a, b: test(a("b"), b("b")))


def temporal(quads: DataFrame, name: str, kind: str = "segment") -> DataFrame:
    """Pairs of siblings whose time bounds stand in the relation: those of the segments, or (kind object) those of the
    objects that they are."""
    own = _bounded(quads, SEGMENT_BOUNDS if kind == "segment" else BOUNDS, ("t0", "t1"))
    return _pairs(own, lambda a, b: bounds.interval(name, a("b")["t0"], a("b")["t1"], b("b")["t0"], b("b")["t1"]))


def same_prefix(quads: DataFrame, bound: str | None = None) -> DataFrame:
    """The ends of quads whose IRIs share everything up to their last slash; with a bound end, that end and every IRI subject
    that begins with its text up to there."""
    if bound is not None:
        near = quads.where(F.col("s").startswith(bound.rstrip(">").rpartition("/")[0] + "/") & terms.is_iri(F.col("s")))
        return near.select(F.lit(bound).alias("s"), F.col("s").alias("o")).distinct()
    head = lambda c: F.regexp_extract(c, r"^<(.*)/[^/]*>$", 1)
    return quads.where(terms.is_iri(F.col("s")) & terms.is_iri(F.col("o")) & (head(F.col("s")) != "") & (head(F.col("s")) == head(F.col("o")))).select("s", "o").distinct()


_RULES: list[tuple[re.Pattern, Callable[[DataFrame, re.Match], DataFrame]]] = [
    (re.compile(r"clip(\d+)nn$"), lambda q, m: similarity.knn_graph(vectors_of(q, EMBEDDING), int(m[1])).select("s", "o")),
    (re.compile(r"([1-9]\d*)nn/([a-zA-Z][a-zA-Z0-9]*)$"), lambda q, m: similarity.knn_graph(vectors_of(q, f"<{DERIVED}{m[2]}>"), int(m[1])).select("s", "o")),
    (re.compile(r"clipNearDuplicate$"), lambda q, m: similarity.near_pairs(vectors_of(q, EMBEDDING), 0.1).select("s", "o")),
    (re.compile(r"segmentSibling$"), lambda q, m: siblings(q)),
    (re.compile(r"samePrefix$"), lambda q, m: same_prefix(q)),
    (re.compile(r"spatial/(" + "|".join(bounds.SPATIAL) + r")$"), lambda q, m: spatial(q, m[1])),
    (re.compile(r"temporal/(object|segment)/(" + "|".join(bounds.TEMPORAL) + r")$"), lambda q, m: temporal(q, m[2], m[1])),
]


def register(pattern: str, make: Callable[[DataFrame, re.Match], DataFrame]) -> None:
    """Adds a virtual relation: make(quads, match) gives its pairs (s, o) when a query names an IRI of IMPLICIT whose rest
    matches the pattern. Later ones go first."""
    _RULES.insert(0, (re.compile(pattern), make))


def expand(quads: DataFrame, predicate: str, s: str | None = None, o: str | None = None) -> DataFrame | None:
    """The pairs (s, o) of a virtual predicate; None if it isn't one. s and o are ends that the query binds."""
    if predicate == f"<{IMPLICIT}samePrefix>" and (s or o):
        found = same_prefix(quads, s or o)
        return found if s else found.select(F.col("o").alias("s"), F.col("s").alias("o"))
    if predicate.startswith(f"<{IMPLICIT}"):
        name = predicate[len(IMPLICIT) + 1 : -1]
        for pattern, make in _RULES:
            if m := pattern.match(name):
                return make(quads, m)
    return None


def materialize(quads: DataFrame, predicate: str, derive: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The quads with a derived predicate added for subjects that lack it: derive gets those subjects (s) and returns (s, o)."""
    lacking = quads.select("s").distinct().join(quads.where(F.col("p") == predicate).select("s"), "s", "left_anti")
    return quads.select("s", "p", "o").unionByName(derive(lacking).select("s", F.lit(predicate).alias("p"), "o"))
