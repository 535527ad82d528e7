"""Queries over the test tables seen as a graph, and independent SQL over the tables themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import bounds, segments, terms
from graphloom.operators import derived, relations, similarity, traversal
from graphloom.operators.store import QuadStore
from graphloom.plans.sparql import plain, select
from graphloom.sources import tables as T

PREFIX = f"PREFIX t: <{T.EX}> PREFIX i: <{relations.IMPLICIT}> PREFIX s: <{relations.SCHEMA}> "
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _tail(c: str):
    """The key at an IRI's end, as a number."""
    return F.rtrim(F.substring_index(c, "/", -1), F.lit(">")).cast("long").alias(c)


def _sparql(name: str, tables: list[str], query: str, sql: str, cast: dict[str, str] | None = None) -> None:
    """A query whose variables become columns: "id" is an IRI's key, other names are casts."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = plain(select(PREFIX + query, T.quads(spark, sf_dir, *tables)))
        kinds = cast or {}
        return df.select(*[_tail(c) if kinds.get(c) == "id" else F.col(c).cast(kinds.get(c, "string")).alias(c) for c in df.columns])

    QUERIES[name], ORACLE[name] = run, sql


_sparql(
    "sparql_star", ["region", "nation", "customer"],
    "SELECT ?c ?name ?seg WHERE { ?c t:c_name ?name ; t:c_mktsegment ?seg ; t:c_nationkey ?n . ?n t:n_regionkey ?r . ?r t:r_name ?rn . FILTER(?rn = 'ASIA') }",
    "SELECT c_custkey AS c, c_name AS name, c_mktsegment AS seg FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'",
    {"c": "id"},
)
_sparql(
    "sparql_optional", ["documents", "labels"],
    "SELECT ?d ?lang ?q WHERE { ?d t:lang ?lang OPTIONAL { ?d t:quality ?q FILTER(?q > 0) } }",
    "SELECT d.doc_id AS d, lang, quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND quality > 0",
    {"d": "id", "q": "int"},
)
_sparql(
    "sparql_union", ["customer", "supplier"],
    "SELECT ?x ?b WHERE { { ?x t:c_acctbal ?b } UNION { ?x t:s_acctbal ?b } FILTER(?b < 0) }",
    "SELECT c_custkey AS x, c_acctbal AS b FROM customer WHERE c_acctbal < 0 UNION ALL SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal < 0",
    {"x": "id", "b": "double"},
)
_sparql(
    "sparql_minus", ["customer", "orders"],
    "SELECT ?c WHERE { ?c t:c_name ?n MINUS { ?o t:o_custkey ?c } }",
    "SELECT c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)",
    {"c": "id"},
)
_sparql(
    "sparql_exists", ["customer", "orders"],
    "SELECT ?c WHERE { ?c t:c_mktsegment 'BUILDING' FILTER EXISTS { ?o t:o_custkey ?c ; t:o_orderstatus 'F' } }",
    "SELECT c_custkey AS c FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    {"c": "id"},
)
_sparql(
    "sparql_not_exists", ["customer", "orders"],
    "SELECT ?c WHERE { ?c t:c_name ?n FILTER NOT EXISTS { ?o t:o_custkey ?c ; t:o_totalprice ?p FILTER(?p > 200000) } }",
    "SELECT c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)",
    {"c": "id"},
)
_sparql(
    "sparql_group", ["customer", "nation"],
    "SELECT ?name (COUNT(*) AS ?n) (COUNT(DISTINCT ?seg) AS ?segs) (MAX(?b) AS ?most) (MIN(?b) AS ?least) WHERE { ?c t:c_nationkey ?k ; t:c_acctbal ?b ; t:c_mktsegment ?seg . ?k t:n_name ?name } GROUP BY ?name HAVING(COUNT(*) > 1)",
    "SELECT n_name AS name, count(*) AS n, count(DISTINCT c_mktsegment) AS segs, max(c_acctbal) AS most, min(c_acctbal) AS least FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name HAVING count(*) > 1",
    {"n": "long", "segs": "long", "most": "double", "least": "double"},
)
_sparql(
    "sparql_sum_avg", ["events"],
    "SELECT ?t (ROUND(SUM(?u)) AS ?users) (ROUND(AVG(?u)) AS ?mean) WHERE { ?e t:event_type ?t ; t:user_id ?u } GROUP BY ?t",
    "SELECT event_type AS t, CAST(sum(user_id) AS BIGINT) AS users, CAST(floor(avg(user_id) + 0.5) AS BIGINT) AS mean FROM events WHERE user_id IS NOT NULL GROUP BY event_type",
    {"users": "long", "mean": "double"},
)
ORACLE["sparql_sum_avg"] = ORACLE["sparql_sum_avg"].replace("CAST(floor(avg(user_id) + 0.5) AS BIGINT)", "CAST(floor(avg(user_id) + 0.5) AS DOUBLE)")
_sparql(
    "sparql_order_slice", ["part"],
    "SELECT ?p ?price WHERE { ?p t:p_retailprice ?price ; t:p_size ?z FILTER(?z >= 10 && ?z < 40) } ORDER BY DESC(?price) ?p LIMIT 25 OFFSET 5",
    f"SELECT p_partkey AS p, p_retailprice AS price FROM part WHERE p_size >= 10 AND p_size < 40 ORDER BY p_retailprice DESC, '{T.EX}part/' || p_partkey LIMIT 25 OFFSET 5",
    {"p": "id", "price": "double"},
)
_sparql(
    "sparql_distinct", ["part"], "SELECT DISTINCT ?b ?z WHERE { ?p t:p_brand ?b ; t:p_size ?z }", "SELECT DISTINCT p_brand AS b, p_size AS z FROM part", {"z": "int"}
)
_sparql(
    "sparql_text", ["documents"],
    "SELECT ?d ?up ?n WHERE { ?d t:text ?x ; t:lang ?l FILTER(CONTAINS(LCASE(STR(?x)), 'license') && ?l IN ('en', 'fr')) BIND(UCASE(?l) AS ?up) BIND(STRLEN(?x) AS ?n) }",
    "SELECT doc_id AS d, upper(lang) AS up, length(text) AS n FROM documents WHERE contains(lower(text), 'license') AND lang IN ('en', 'fr')",
    {"d": "id", "n": "long"},
)
_sparql(
    "sparql_bind_window", ["part"],
    "SELECT ?p ?q WHERE { ?p t:p_brand ?b ; t:p_size ?z . ?q t:p_brand ?b ; t:p_size ?y . BIND(?z + 1 AS ?hi) FILTER(?y >= ?z - 1 && ?y <= ?hi && ?p != ?q) }",
    "SELECT a.p_partkey AS p, b.p_partkey AS q FROM part a JOIN part b ON a.p_brand = b.p_brand WHERE b.p_size BETWEEN a.p_size - 1 AND a.p_size + 1 AND a.p_partkey <> b.p_partkey",
    {"p": "id", "q": "id"},
)
_sparql(
    "sparql_values", ["nation", "region"],
    "SELECT ?n ?rn WHERE { VALUES ?rn { 'EUROPE' 'AFRICA' } ?x t:n_name ?n ; t:n_regionkey ?r . ?r t:r_name ?rn }",
    "SELECT n_name AS n, r_name AS rn FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('EUROPE', 'AFRICA')",
)
_sparql(
    "sparql_subselect", ["customer", "orders"],
    "SELECT ?c ?name ?n WHERE { ?c t:c_name ?name { SELECT ?c (COUNT(?o) AS ?n) WHERE { ?o t:o_custkey ?c } GROUP BY ?c } FILTER(?n > 12) }",
    "SELECT c_custkey AS c, c_name AS name, n FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey WHERE n > 12",
    {"c": "id", "n": "long"},
)
_sparql(
    "sparql_path_sequence", ["customer", "nation", "region"],
    "SELECT ?c ?r WHERE { ?c t:c_nationkey/t:n_regionkey/t:r_name ?r }",
    "SELECT c_custkey AS c, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    {"c": "id"},
)
_sparql(
    "sparql_path_alternative", ["customer", "supplier", "nation"],
    "SELECT ?x WHERE { ?n t:n_name 'FRANCE' . ?n ^(t:c_nationkey|t:s_nationkey) ?x }",
    "SELECT c_custkey AS x FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'FRANCE' UNION ALL SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'FRANCE'",
    {"x": "id"},
)
_sparql(
    "sparql_functions", ["orders"],
    "SELECT ?o ?y ?m ?w ?u WHERE { ?o t:o_orderdate ?d ; t:o_orderpriority ?p BIND(YEAR(?d) AS ?y) BIND(MONTH(?d) AS ?m) BIND(DAYOFWEEK(?d) AS ?w) BIND(IF(STRSTARTS(?p, '1'), SUBSTR(?p, 3), COALESCE(?none, 'other')) AS ?u) }",
    "SELECT o_orderkey AS o, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(isodow(o_orderdate) AS BIGINT) AS w, CASE WHEN starts_with(o_orderpriority, '1') THEN substr(o_orderpriority, 3) ELSE 'other' END AS u FROM orders",
    {"o": "id", "y": "long", "m": "long", "w": "long"},
)


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


@_query("SELECT c_custkey AS id, c_mktsegment AS o FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def quads_filter(spark, sf_dir):
    found = QuadStore(T.quads(spark, sf_dir, "customer")).filter(None, [f"<{T.EX}c_mktsegment>"], ["BUILDING^^String", "MACHINERY^^String"])
    return found.select(_tail("s").alias("id"), terms.lexical(F.col("o")).alias("o"))


@_query("SELECT doc_id AS id, count(*) AS n FROM documents WHERE contains(text, 'Licensed under') GROUP BY doc_id")
def quads_text_filter(spark, sf_dir):
    found = QuadStore(T.quads(spark, sf_dir, "documents")).text_filter(f"<{T.EX}text>", "Licensed under")
    return found.groupBy(_tail("s").alias("id")).agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT DISTINCT source AS o FROM documents")
def quads_distinct_objects(spark, sf_dir):
    return QuadStore(T.quads(spark, sf_dir, "documents")).distinct_objects(f"<{T.EX}source>").select(terms.lexical(F.col("o")).alias("o"))


@_query("SELECT p_partkey AS id, p_size AS size FROM part WHERE p_brand <> 'Brand#11' AND p_size IS NOT NULL")
def quads_set_operations(spark, sf_dir):
    store = QuadStore(T.quads(spark, sf_dir, "part"))
    sizes = store.filter_predicate(f"<{T.EX}p_size>")
    gone = sizes.join(store.filter(None, [f"<{T.EX}p_brand>"], ["Brand#11^^String"]).select("s"), "s", "left_semi")
    left = QuadStore(sizes).plus(sizes).minus(gone).quads
    return left.select(_tail("s").alias("id"), terms.number(F.col("o")).cast("int").alias("size"))


_COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"


@_query(f"SELECT b.vec_id AS id, round(CASE WHEN a.vec_id = b.vec_id THEN 0 ELSE 1 - {_COS} END, 6) AS distance FROM embeddings a, embeddings b WHERE a.vec_id = 3 ORDER BY distance, id LIMIT 10")
def knn_search(spark, sf_dir):
    query = [float(x) for x in spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id = 3").first().embedding]
    found = QuadStore(T.embeddings(spark, sf_dir)).knn(relations.EMBEDDING, query, 10)
    return found.select(_tail("s").alias("id"), F.round("distance", 6).alias("distance"))


@_query(f"SELECT a.vec_id AS id, b.vec_id AS other FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY 1 - {_COS}, b.vec_id) <= 5")
def knn_graph(spark, sf_dir):
    pairs = select(PREFIX + "SELECT ?a ?b WHERE { ?a <" + relations.IMPLICIT + "5nn/clipEmbedding> ?b }", T.embeddings(spark, sf_dir))
    return pairs.select(_tail("a").alias("id"), _tail("b").alias("other"))


@_query(f"SELECT a.vec_id AS id, b.vec_id AS other FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE 1 - {_COS} < 0.6")
def near_pairs(spark, sf_dir):
    found = similarity.near_pairs(relations.vectors_of(T.embeddings(spark, sf_dir), relations.EMBEDDING), 0.6)
    return found.select(_tail("s").alias("id"), _tail("o").alias("other"))


_BOX = """(SELECT k, parent, j * 7 % 50 AS x0, j * 7 % 50 + (j % 9 + 1) * CASE WHEN j % 3 = 0 THEN 4 ELSE 1 END AS x1, j * 13 % 40 AS y0, j * 13 % 40 + (j % 5 + 1) * CASE WHEN j % 3 = 0 THEN 6 ELSE 1 END AS y1
    FROM (SELECT p_partkey AS k, p_partkey // 20 AS parent, CASE WHEN p_partkey % 20 = 19 THEN p_partkey - 1 ELSE p_partkey END AS j FROM part))"""
_INSIDE = "{0}.x0 <= {1}.x0 AND {0}.x1 >= {1}.x1 AND {0}.y0 <= {1}.y0 AND {0}.y1 >= {1}.y1"
_SAME = "a.x0 = b.x0 AND a.x1 = b.x1 AND a.y0 = b.y0 AND a.y1 = b.y1"
_MEET = "greatest(a.x0, b.x0) <= least(a.x1, b.x1) AND greatest(a.y0, b.y0) <= least(a.y1, b.y1)"
_SPATIAL = {
    "contains": _INSIDE.format("a", "b"), "within": f"{_INSIDE.format('b', 'a')} AND NOT ({_SAME})", "covers": _INSIDE.format("a", "b"), "equals": _SAME, "above": "a.y0 > b.y1", "below": "a.y1 < b.y0", "left": "a.x1 < b.x0", "right": "a.x0 > b.x1",
    "beside": "(a.x1 < b.x0 OR a.x0 > b.x1)", "disjoint": f"NOT ({_MEET})", "intersects": _MEET, "overlaps": _MEET, "crosses": _MEET, "touches": "(a.x0 = b.x1 OR a.x1 = b.x0 OR a.y0 = b.y1 OR a.y1 = b.y0)",
}
for _name, _test in _SPATIAL.items():

    def _spatial(spark, sf_dir, name=_name):
        pairs = select(PREFIX + "SELECT ?a ?b WHERE { ?a <" + relations.IMPLICIT + f"spatial/{name}> ?b }}", T.segments(spark, sf_dir))
        return pairs.select(_tail("a").alias("id"), _tail("b").alias("other"))

    QUERIES[f"spatial_{_name}"] = _spatial
    ORACLE[f"spatial_{_name}"] = f"SELECT a.k AS id, b.k AS other FROM {_BOX} a JOIN {_BOX} b ON a.parent = b.parent AND a.k <> b.k WHERE {_test}"


@_query("SELECT a.p_partkey AS id, b.p_partkey AS other FROM part a JOIN part b ON a.p_partkey // 20 = b.p_partkey // 20 AND a.p_partkey <> b.p_partkey")
def segment_siblings(spark, sf_dir):
    pairs = select(PREFIX + "SELECT ?a ?b WHERE { ?a i:segmentSibling ?b }", T.segments(spark, sf_dir))
    return pairs.select(_tail("a").alias("id"), _tail("b").alias("other"))


for _name in bounds.TEMPORAL:
    _sql = {"after": "a.s >= b.e", "precedes": "a.e < b.s", "finishes": "a.e = b.e AND a.s > b.s", "meets": "(a.s = b.e OR a.e = b.s)", "starts": "a.s = b.s AND a.e < b.e", "contains": "a.s < b.s AND a.e > b.e", "equals": "a.s = b.s AND a.e = b.e", "overlaps": "((a.s < b.s AND b.s < a.e AND a.e < b.e) OR (b.s < a.s AND a.s < b.e AND b.e < a.e))"}[_name]
    for _kind, _more in (("segment", 1), ("object", 2)):

        def _temporal(spark, sf_dir, name=_name, kind=_kind):
            pairs = select(PREFIX + "SELECT ?a ?b WHERE { ?a <" + relations.IMPLICIT + f"temporal/{kind}/{name}> ?b }}", T.event_segments(spark, sf_dir))
            return pairs.select(_tail("a").alias("id"), _tail("b").alias("other"))

        _from = f"(SELECT event_id, user_id AS u, floor(epoch_us(ts) / 86400000000) AS s, floor(epoch_us(ts) / 86400000000) + event_id % 4 + {_more} AS e FROM events WHERE event_id IS NOT NULL AND ts IS NOT NULL)"
        QUERIES[f"temporal_{_kind}_{_name}"] = _temporal
        ORACLE[f"temporal_{_kind}_{_name}"] = f"SELECT DISTINCT a.event_id AS id, b.event_id AS other FROM {_from} a JOIN {_from} b ON a.u = b.u AND a.event_id <> b.event_id WHERE {_sql}"


@_query("SELECT DISTINCT a.conv_id || '-' || a.turn AS s, b.conv_id || '-' || b.turn AS o FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn < b.turn WHERE (SELECT count(DISTINCT c.turn) FROM conversations c WHERE c.conv_id = a.conv_id AND c.turn BETWEEN a.turn AND b.turn) = b.turn - a.turn + 1")
def path_closure(spark, sf_dir):
    found = traversal.reach(T.turns(spark, sf_dir))
    return found.select(*[F.regexp_extract(c, r"/([^/]*)>$", 1).alias(c) for c in ("s", "o")])


@_query("SELECT DISTINCT conv_id || '-' || turn AS s, conv_id || '-' || (turn + 1) AS o FROM conversations a WHERE turn < (SELECT min(turn) FROM conversations b WHERE b.conv_id = a.conv_id) + 3 AND EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn = a.turn + 1)")
def path_walk(spark, sf_dir):
    quads = T.turns(spark, sf_dir)
    seeds = quads.select(F.col("s").alias("node")).join(quads.select(F.col("o").alias("node")), "node", "left_anti")
    return traversal.path(quads, seeds, [f"<{T.EX}next>"], depth=3).select(*[F.regexp_extract(c, r"/([^/]*)>$", 1).alias(c) for c in ("s", "o")])


@_query("SELECT c_custkey AS id FROM customer WHERE c_nationkey = 7 UNION ALL SELECT s_suppkey FROM supplier WHERE s_nationkey = 7")
def neighbourhood_of_nation(spark, sf_dir):
    node = f"<{T.EX}nation/7>"
    return QuadStore(T.quads(spark, sf_dir, "customer", "supplier")).neighbourhood(node).select(_tail("s").alias("id"))


@_query("SELECT k AS id, CAST(x1 - x0 AS DOUBLE) AS width, CAST(y1 - y0 AS DOUBLE) AS height, CAST((x1 - x0) * (y1 - y0) AS DOUBLE) AS area FROM " + _BOX)
def bounds_accessors(spark, sf_dir):
    df = plain(select(PREFIX + "SELECT ?a (WIDTH(?b) AS ?width) (HEIGHT(?b) AS ?height) (BOUNDS_AREA(?b) AS ?area) WHERE { ?a s:segmentBounds ?b }", T.segments(spark, sf_dir)))
    return df.select(_tail("a").alias("id"), *[F.col(c).cast("double").alias(c) for c in ("width", "height", "area")])


@_query("SELECT event_type AS kind, count(value) AS count, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(stddev_pop(value), 6) AS std FROM events GROUP BY event_type")
def statistics(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumnRenamed("event_type", "kind")
    made = derived.statistics(e, "value", "kind")
    return made.select("kind", "count", "min", "max", *[F.round(c, 6).alias(c) for c in ("mean", "median", "p95", "p99", "std")])


@_query("SELECT round(regr_slope(log10(o_totalprice), log10(o_orderkey)), 9) AS slope FROM orders WHERE o_totalprice > 0 AND o_orderkey > 0")
def log_log_slope(spark, sf_dir):
    return derived.log_log_slope(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey", "o_totalprice").select(F.round("slope", 9).alias("slope"))


@_query("SELECT p_size AS image, round(sum((p_partkey % 7) / 7.0 * (p_partkey % 3) / 2.0) / greatest(sum((p_partkey % 3) / 2.0), 1), 9) AS r, round(sum((p_partkey % 3) / 2.0) / greatest(sum((p_partkey % 3) / 2.0), 1), 9) AS g, CAST(0 AS DOUBLE) AS b FROM part GROUP BY p_size")
def average_colors(spark, sf_dir):
    k = F.col("p_partkey")
    pixels = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_size").alias("image"), (k % 7 / 7.0).alias("r"), F.lit(1.0).alias("g"), F.lit(0.0).alias("b"), (k % 3 / 2.0).alias("alpha"))
    return derived.average_colors(pixels).select("image", *[F.round(c, 9).alias(c) for c in "rgb"])


@_query("SELECT doc_id AS id, substr(text, 3, 5) || '   ' || substr(text, 11, 10) AS part FROM documents WHERE length(text) >= 20")
def text_segments(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) >= 20")
    return docs.select(F.col("doc_id").alias("id"), segments.text_segment(F.col("text"), segments.interval_column(F.lit("2-7,10-20"))).alias("part"))


@_query(f"SELECT k AS id, CAST((x1 - x0) * (y1 - y0) AS DOUBLE) AS area FROM {_BOX}")
def segment_areas(spark, sf_dir):
    held = T.segments(spark, sf_dir).where(F.col("p") == relations.SEGMENT_BOUNDS)
    rect = F.regexp_replace(terms.lexical(F.col("o")), ",-,-,-,-$", "")
    return held.select(_tail("s").alias("id"), segments.described(F.lit("rect"), rect)["area"].alias("area"))


@_query(f"SELECT a.k AS id, b.k AS other FROM {_BOX} a JOIN {_BOX} b ON a.parent = b.parent AND a.k < b.k WHERE {_INSIDE.format('a', 'b')}")
def segment_contains(spark, sf_dir):
    own = T.segments(spark, sf_dir)
    held = own.where(F.col("p") == relations.SEGMENT_BOUNDS).select("s", F.regexp_replace(terms.lexical(F.col("o")), ",-,-,-,-$", "").alias("d"))
    of = held.join(own.where(F.col("p") == relations.SEGMENT_OF).select("s", F.col("o").alias("parent")), "s").select(_tail("s").alias("id"), "parent", "d")
    both = of.join(of.select(F.col("id").alias("other"), "parent", F.col("d").alias("e")), "parent").where("id < other")
    return both.where(segments.related("contains", F.lit("rect"), F.col("d"), F.lit("rect"), F.col("e"))).select("id", "other")


@_query("SELECT 'part/' || p_partkey AS s, 'part/' || (p_partkey // 20) AS o FROM part WHERE p_partkey // 20 IN (SELECT p_partkey FROM part) AND p_partkey // 20 <> p_partkey")
def same_prefix(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    known = part.select(F.col("p_partkey").alias("k"))
    edges = part.select("p_partkey", F.floor(F.col("p_partkey") / 20).alias("k")).join(known, "k").where("k <> p_partkey")
    quads = edges.select(T.node("part", "p_partkey").alias("s"), F.lit(f"<{T.EX}near>").alias("p"), T.node("part", "k").alias("o")).unionByName(T.quads(spark, sf_dir, "supplier"))
    found = select(PREFIX + "SELECT ?s ?o WHERE { ?s i:samePrefix ?o }", quads)
    return found.select(*[F.regexp_extract(c, r"/t/(.*)>$", 1).alias(c) for c in "so"])


@_query("SELECT 'nation' AS kind, n_nationkey AS id FROM nation")
def same_prefix_of_one(spark, sf_dir):
    found = select(PREFIX + "SELECT ?o WHERE { <" + T.EX + "nation/0> i:samePrefix ?o }", T.quads(spark, sf_dir, "nation", "region"))
    return found.select(F.regexp_extract("o", r"/t/(\w+)/", 1).alias("kind"), _tail("o").alias("id"))


@_query("SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 JOIN nation ON n_nationkey = c_nationkey WHERE n_name = 'FRANCE'")
def sparql_optional_between(spark, sf_dir):
    df = select(PREFIX + "SELECT ?c ?o WHERE { ?c t:c_name ?name OPTIONAL { ?o t:o_custkey ?c ; t:o_totalprice ?p FILTER(?p > 300000) } ?c t:c_nationkey ?n . ?n t:n_name 'FRANCE' }", T.quads(spark, sf_dir, "customer", "orders", "nation"))
    return df.select(_tail("c"), _tail("o"))


@_query("SELECT user_id AS u, CAST(sum(9007199254740993 + event_id) AS VARCHAR) AS total, CAST(max(9007199254740993 + event_id) AS VARCHAR) AS most FROM events WHERE user_id IS NOT NULL AND event_id IS NOT NULL GROUP BY user_id")
def sparql_exact_longs(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id IS NOT NULL AND event_id IS NOT NULL")
    s = T.node("event", "event_id")
    quads = e.select(s.alias("s"), F.lit(f"<{T.EX}big>").alias("p"), terms.long(F.col("event_id") + F.lit(9007199254740993)).alias("o")).unionByName(e.select(s.alias("s"), F.lit(f"<{T.EX}user>").alias("p"), terms.long(F.col("user_id")).alias("o")))
    df = plain(select(PREFIX + "SELECT ?u (SUM(?v) AS ?total) (MAX(?v) AS ?most) WHERE { ?e t:big ?v ; t:user ?u } GROUP BY ?u", quads))
    return df.select(F.col("u").cast("long").alias("u"), "total", "most")


@_query("SELECT p_partkey AS p, split_part(p_brand, '#', 1) AS a, regexp_replace(p_brand, 'BRAND', 'b', 'gi') AS b, list_aggregate(list_sort([p_type, p_brand]), 'string_agg', '|') AS c FROM part")
def sparql_strings(spark, sf_dir):
    q = "SELECT ?p (STRBEFORE(?x, ?h) AS ?a) (REPLACE(?x, 'BRAND', 'b', 'i') AS ?b) (GROUP_CONCAT(?v; SEPARATOR='|') AS ?c) WHERE { ?p t:p_brand ?x BIND('#' AS ?h) { ?p t:p_brand ?v } UNION { ?p t:p_type ?v } } GROUP BY ?p ?x ?h"
    df = plain(select(PREFIX + q, T.quads(spark, sf_dir, "part")))
    return df.select(_tail("p"), "a", "b", "c")


@_query(f"SELECT k AS id, CAST((x0 + x1) / 2.0 AS DOUBLE) AS x, CAST(x1 - x0 AS DOUBLE) AS w, CAST((x1 - x0) * (y1 - y0) AS DOUBLE) AS area FROM {_BOX}")
def accessors_of_nodes(spark, sf_dir):
    held = T.segments(spark, sf_dir)
    both = held.unionByName(held.where(F.col("p") == relations.SEGMENT_BOUNDS).withColumn("p", F.lit(relations.BOUNDS)))
    df = plain(select(PREFIX + "SELECT ?a (SEGMENT_CENTER(?a) AS ?x) (WIDTH(?a) AS ?w) (BOUNDS_AREA(?a) AS ?area) WHERE { ?a s:segmentOf ?p }", both))
    return df.select(_tail("a").alias("id"), F.substring_index("x", ",", 1).cast("double").alias("x"), F.col("w").cast("double").alias("w"), F.col("area").cast("double").alias("area"))


@_query("SELECT DISTINCT c_mktsegment AS m FROM customer")
def sparql_reduced(spark, sf_dir):
    return plain(select(PREFIX + "SELECT REDUCED ?m WHERE { ?c t:c_mktsegment ?m }", T.quads(spark, sf_dir, "customer")))


@_query("SELECT count(*) AS n FROM (SELECT * FROM customer LIMIT 7)")
def sparql_limit(spark, sf_dir):
    return select(PREFIX + "SELECT ?c WHERE { ?c t:c_name ?n } LIMIT 7", T.quads(spark, sf_dir, "customer")).agg(F.count("*").alias("n"))


@_query("SELECT n_regionkey AS r, count(*) AS n, TRUE AS known FROM nation GROUP BY n_regionkey")
def sparql_sample(spark, sf_dir):
    df = plain(select(PREFIX + "SELECT ?r (COUNT(*) AS ?n) (SAMPLE(?name) AS ?one) WHERE { ?x t:n_regionkey ?r ; t:n_name ?name } GROUP BY ?r", T.quads(spark, sf_dir, "nation")))
    names = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("one"), F.col("n_regionkey").alias("k"))
    return df.join(names, "one").select(_tail("r"), F.col("n").cast("long").alias("n"), (F.regexp_extract("r", r"(\d+)$", 1).cast("long") == F.col("k")).alias("known"))


@_query(f"SELECT b.vec_id AS id, round(1 - {_COS}, 6) AS distance FROM embeddings a, embeddings b WHERE a.vec_id = 3 ORDER BY round(1 - {_COS}, 9) DESC, 'vec/' || b.vec_id LIMIT 10")
def knn_farthest(spark, sf_dir):
    query = [float(x) for x in spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id = 3").first().embedding]
    return QuadStore(T.embeddings(spark, sf_dir)).knn(relations.EMBEDDING, query, 10, farthest=True).select(_tail("s").alias("id"), F.round("distance", 6).alias("distance"))


@_query("SELECT b.vec_id AS id, round(-list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance FROM embeddings a, embeddings b WHERE a.vec_id = 3 ORDER BY list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, 'vec/' || b.vec_id LIMIT 10")
def knn_dot(spark, sf_dir):
    query = [float(x) for x in spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id = 3").first().embedding]
    return QuadStore(T.embeddings(spark, sf_dir)).knn(relations.EMBEDDING, query, 10, distance="dot").select(_tail("s").alias("id"), F.round("distance", 6).alias("distance"))


@_query(f"SELECT b.vec_id AS id, round({_COS}, 6) AS sim FROM embeddings a, embeddings b WHERE a.vec_id = 3 AND b.vec_id <> 3")
def sparql_cosine(spark, sf_dir):
    q = "SELECT ?v (COSINE_SIM(?x, ?y) AS ?sim) WHERE { <" + T.EX + "vec/3> <" + relations.DERIVED + "clipEmbedding> ?x . ?v <" + relations.DERIVED + "clipEmbedding> ?y FILTER(?v != <" + T.EX + "vec/3>) }"
    df = plain(select(PREFIX + q, T.embeddings(spark, sf_dir)))
    return df.select(_tail("v").alias("id"), F.round(F.col("sim").cast("double"), 6).alias("sim"))


@_query("SELECT 'in' AS part, CAST(count(*) AS BIGINT) AS n FROM (SELECT c_custkey FROM customer WHERE c_nationkey = 7 UNION ALL SELECT s_suppkey FROM supplier WHERE s_nationkey = 7) HAVING count(*) > 0 UNION ALL SELECT 'out', 2 FROM nation WHERE n_nationkey = 7")
def about_node(spark, sf_dir):
    return QuadStore(T.quads(spark, sf_dir, "nation", "customer", "supplier")).about(f"<{T.EX}nation/7>").groupBy("part").agg(F.count("*").alias("n"))


@_query(f"SELECT k AS id, CAST(row_number() OVER (ORDER BY (x1 - x0) * (y1 - y0) DESC, 'part/' || k || '>') AS DOUBLE) AS rank FROM {_BOX} WHERE parent = 1")
def about_segments(spark, sf_dir):
    return QuadStore(T.segments(spark, sf_dir)).about(f"<{T.EX}sheet/1>").where("part = 'segment'").select(_tail("s").alias("id"), "rank")


@_query("SELECT CAST((SELECT count(*) FROM part) * 2 - 2 * (SELECT count(*) FROM part WHERE p_partkey // 20 = 1) AS BIGINT) AS n")
def delete_cascade(spark, sf_dir):
    return QuadStore(T.segments(spark, sf_dir)).delete_object(f"<{T.EX}sheet/1>").quads.agg(F.count("*").alias("n"))


@_query("SELECT p_partkey AS id, p_brand AS o FROM part WHERE p_brand = 'Brand#11' OR p_partkey = 3")
def quads_ends(spark, sf_dir):
    store = QuadStore(T.quads(spark, sf_dir, "part"))
    both = store.filter_object("Brand#11^^String").unionByName(QuadStore(store.filter_subject(f"<{T.EX}part/3>")).filter_predicate(f"<{T.EX}p_brand>")).distinct()
    return both.select(_tail("s").alias("id"), terms.lexical(F.col("o")).alias("o"))


def relevance_feedback(spark, sf_dir):
    """Vectors like those of label 1 and unlike those of label 2, from ten examples each. No SQL: the classifier is iterative;
    tests compare it with a plain one."""
    rank = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    examples = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("label IN (1, 2)").select("vec_id", "label", rank.alias("rank")).where("rank <= 10").collect()
    ids = {n: [f"<{T.EX}vec/{r.vec_id}>" for r in examples if r.label == n] for n in (1, 2)}
    return QuadStore(T.embeddings(spark, sf_dir)).relevance_feedback(relations.EMBEDDING, ids[1], ids[2], 20).select(_tail("s").alias("id"), "score")


QUERIES["relevance_feedback"] = relevance_feedback
