import math

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from graphloom.functions import bounds, terms
from graphloom.operators import relations, similarity
from graphloom.plans import queries as graph
from graphloom.plans.sparql import json_rows, select
from graphloom.sources import files

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", list(graph.ORACLE))
def test_query_equals_sql(spark, sf, duck, name):
    df = graph.QUERIES[name](spark, sf)
    want = duck.execute(graph.ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    rows = sorted(map(str, ({c: r[c] for c in sorted(columns)} for r in map(lambda r: r.asDict(), df.collect()))))
    expected = sorted(map(str, ({c: v for c, v in sorted(zip(columns, r))} for r in want.fetchall())))
    assert rows == expected


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


G = [("<e:a>", "<e:p>", "<e:b>"), ("<e:b>", "<e:p>", "<e:c>"), ("<e:c>", "<e:p>", "<e:a>"), ("<e:c>", "<e:q>", "5^^Long"), ("<e:a>", "<e:q>", "2.5^^Double"), ("<e:b>", "<e:q>", "x^^String"), ("<e:d>", "<e:p>", "<e:d>")]


def run(spark, q):
    df = spark.createDataFrame(G, "s string, p string, o string")
    return sorted(tuple(None if v is None else v for v in r) for r in select(q, df).collect()) if "ORDER" not in q else [tuple(r) for r in select(q, df).collect()]


def test_paths_and_cycles(spark):
    assert run(spark, "SELECT ?x WHERE { <e:a> <e:p>+ ?x }") == [("<e:a>",), ("<e:b>",), ("<e:c>",)]
    assert run(spark, "SELECT ?x WHERE { ?x <e:p>* <e:b> }") == [("<e:a>",), ("<e:b>",), ("<e:c>",)]
    assert run(spark, "SELECT ?x WHERE { <e:a> <e:p>? ?x }") == [("<e:a>",), ("<e:b>",)]
    assert run(spark, "SELECT ?x ?y WHERE { ?x !<e:q> ?y . ?x <e:p> ?x }") == [("<e:d>", "<e:d>")]
    assert run(spark, "SELECT ?x WHERE { ?x <e:p>/<e:p> ?y . ?y ^<e:p> ?z . ?z <e:q> 'x' }") == [("<e:a>",)]


def test_values_order_and_types(spark):
    assert run(spark, "SELECT ?o WHERE { ?s <e:q> ?o } ORDER BY ?o") == [("x^^String",), ("2.5^^Double",), ("5^^Long",)]
    assert run(spark, "SELECT (SUM(?o) AS ?t) (COUNT(?o) AS ?n) WHERE { ?s <e:q> ?o FILTER(isNumeric(?o)) }") == [("7.5^^Double", "2^^Long")]
    assert run(spark, "SELECT ?s (?o * 2 + 1 AS ?t) WHERE { ?s <e:q> ?o FILTER(?o > 1) }") == [("<e:a>", "6.0^^Double"), ("<e:c>", "11^^Long")]
    assert run(spark, "SELECT ?s ?o WHERE { ?s <e:p> ?t OPTIONAL { ?s <e:q> ?o FILTER(?o = 5.0) } FILTER(!BOUND(?o) || ?o = 5) VALUES (?s) { (<e:c>) (<e:d>) } }") == [("<e:c>", "5^^Long"), ("<e:d>", None)]
    assert run(spark, "SELECT ?a WHERE { VALUES (?a ?b) { (1 UNDEF) (2 'y') } FILTER(?a < 2) }") == [("1^^Long",)]
    df = select("SELECT ?s ?o WHERE { ?s <e:q> ?o FILTER(?o = 5) }", spark.createDataFrame(G, "s string, p string, o string"))
    assert "XMLSchema#long" in json_rows(df).first().binding


def test_files(spark, tmp_path):
    (tmp_path / "q.tsv").write_text('subject\tpredicate\tobject\n<e:a>\t<e:p>\tbad^^Long\n<e:a>\t<e:p>\t[1, x]^^FloatVector\n<e:a>\t<e:p>\tplain\n<e:a>\t<e:p>\tplain\n<e:a>\t<e:p>\t[1.0, 2.0]\n<e:a>\t<e:p>\t[x\n')
    got = sorted(r.o for r in files.read_tsv(spark, str(tmp_path / "q.tsv")).collect())
    assert got == ["0^^Long", "[1.0, 2.0]^^DoubleVector", "[]^^FloatVector", "[x^^String", "plain^^String"]
    df = files.read_tsv(spark, str(tmp_path / "q.tsv"))
    files.write_tsv(df, str(tmp_path / "out"), "bzip2")
    assert sorted(map(tuple, files.read_tsv(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, df.collect()))
    files.write_store(df, str(tmp_path / "store"))
    assert files.read_store(spark, str(tmp_path / "store")).count() == df.count()
    (tmp_path / "a b.txt").write_text("hi")
    assert {terms and r.p.split("#")[1] for r in files.media_quads(spark, str(tmp_path / "a b.txt")).collect()} == {"rawId>", "rawMimeType>", "mediaType>", "fileName>", "canonicalId>", "canonicalMimeType>"}


def test_bounds_text(spark):
    df = spark.createDataFrame([("0,1,2,3,-,-,-,-",)], "b string").select(bounds.parse(df_col("b")).alias("b"))
    r = df.select(bounds.text(df.b).alias("t"), bounds.center(df.b).alias("c"), bounds.area(df.b).alias("a"), bounds.relative(df.b).alias("r")).first()
    assert tuple(r) == ("0.0,1.0,2.0,3.0,-,-,-,-", "0.5,2.5,-,-", 1.0, False)


def df_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


WINDOW = "SELECT ?p ?q WHERE { ?p <e:b> ?b ; <e:z> ?z . ?q <e:b> ?b ; <e:z> ?y . BIND(?z + 1 AS ?hi) FILTER(?y >= ?z - 1 && ?y <= ?hi && ?p != ?q) }"
SIZES = ["5^^Long", "6^^Long", "6.5^^Double", "7^^Long", "-1^^Long", "0^^Long", "x^^String", "NaN^^Double", "Infinity^^Double", "-Infinity^^Double", "9007199254740993^^Long", "9007199254740994^^Long", "9007199254740995^^Long", "1.0E300^^Double", "<e:iri>"]


def test_window_meets_only_near_numbers(spark):
    quads = [q for i, o in enumerate(SIZES) for q in ((f"<e:{i}>", "<e:z>", o), (f"<e:{i}>", "<e:b>", "one^^String"))]
    df = spark.createDataFrame(quads, "s string, p string, o string")
    found = select(WINDOW, df)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "__bin" in plan
    # a function between makes no window: the filters alone decide
    plain_form = select(WINDOW.replace("?y . BIND(?z + 1 AS ?hi)", "?y0 . BIND(COALESCE(?y0) AS ?y) BIND(?z + 1 AS ?hi)"), df)
    assert "__bin" not in plain_form._jdf.queryExecution().optimizedPlan().toString()
    rows = sorted(map(tuple, found.collect()))
    assert rows == sorted(map(tuple, plain_form.collect()))
    assert ("<e:0>", "<e:1>") in rows and ("<e:1>", "<e:3>") in rows and ("<e:10>", "<e:11>") in rows and ("<e:10>", "<e:12>") not in rows and ("<e:4>", "<e:5>") in rows and ("<e:0>", "<e:3>") not in rows


def test_window_of_texts_is_left_to_the_filters(spark):
    df = spark.createDataFrame([("<e:1>", "<e:z>", "a^^String"), ("<e:1>", "<e:b>", "x^^String"), ("<e:2>", "<e:z>", "a^^String"), ("<e:2>", "<e:b>", "x^^String")], "s string, p string, o string")
    q = "SELECT ?p ?q WHERE { ?p <e:b> ?b ; <e:z> ?z . ?q <e:b> ?b ; <e:z> ?y . FILTER(?y >= ?z && ?y <= ?z && ?p != ?q) }"
    assert sorted(map(tuple, select(q, df).collect())) == [("<e:1>", "<e:2>"), ("<e:2>", "<e:1>")]


def _family(spark):
    """Subjects with one parent, with two, with a fact twice, and with two bounds."""
    of, box = relations.SEGMENT_OF, relations.SEGMENT_BOUNDS
    facts = [("a", "p"), ("b", "p"), ("b", "p"), ("c", "p"), ("c", "q"), ("d", "q"), ("d", "p"), ("e", "r")]
    spans = [("a", 0, 2), ("b", 1, 3), ("c", 1, 3), ("d", 0, 9), ("d", 1, 3), ("e", 0, 1)]
    quads = [(f"<e:{s}>", of, f"<e:{o}>") for s, o in facts] + [(f"<e:{s}>", box, f"{x},{y},{x},{y},-,-,{x},{y}^^String") for s, x, y in spans]
    return spark.createDataFrame(quads, "s string, p string, o string"), facts, spans


def test_sibling_pairs_come_once_without_a_distinct_of_all(spark):
    df, facts, spans = _family(spark)
    near = lambda test: sorted({(f"<e:{a}>", f"<e:{b}>") for a, p in facts for b, q in facts if p == q and a != b and test(a, b)})
    any_span = lambda test: lambda a, b: any(test(x, y) for x in spans for y in spans if x[0] == a and y[0] == b)
    cases = {
        "siblings": (relations.siblings(df), lambda a, b: True),
        "crosses": (relations.spatial(df, "crosses"), any_span(lambda x, y: x[1] <= y[2] and x[2] >= y[1])),
        "after": (relations.temporal(df, "after"), any_span(lambda x, y: x[1] >= y[2])),
        "overlaps": (relations.temporal(df, "overlaps"), any_span(lambda x, y: x[1] < y[1] < x[2] < y[2] or y[1] < x[1] < y[2] < x[2])),
    }
    for name, (found, test) in cases.items():
        assert sorted(map(tuple, found.collect())) == near(test), name
        plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
        assert plan[0].startswith("Union") and sum("Aggregate" in line for line in plan) == 1, name


def test_vector_pairs_over_several_blocks(spark, monkeypatch):
    """Against brute force, with copies (ties go to the smaller key as a number), a vector of zeros, tiny and huge ones, another
    length, and a name that occurs twice."""
    monkeypatch.setattr(similarity, "LEAST", 40)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 8))
    x[100:120], x[120:130], x[140], x[141], x[142], x[143] = x[:20], x[3], 0, x[5] * 1e-5, x[6] * 1e200, x[7] * 3
    names = [f"<e:vec/{i}>" for i in range(149)] + ["<e:vec/148>"]
    rows = [(n, v.tolist()) for n, v in zip(names, x)] + [("<e:vec/900>", [1.0, 2.0]), ("<e:vec/901>", [2.0, 1.0])]
    df = spark.createDataFrame(rows, "s string, v array<double>")

    def distance(a, b):
        dot = na = nb = 0.0
        for p, q in zip(a, b):
            dot, na, nb = dot + p * q, na + p * p, nb + q * q
        norm = math.sqrt(na) * math.sqrt(nb)
        d = 1 - dot / norm if norm >= 1e-6 else 1.0
        return d if math.isfinite(d) else 1.0

    pairs = [(distance(v, w), int(o[7:-1]), s, o) for s, v in rows for o, w in rows if s != o and len(v) == len(w)]
    near = sorted((s, o, d) for d, _, s, o in pairs if d < 0.6)
    got = sorted(map(tuple, similarity.near_pairs(df, 0.6).select("s", "o", "distance").collect()))
    assert [r[:2] for r in got] == [r[:2] for r in near] and np.allclose([r[2] for r in got], [r[2] for r in near])
    want = {}
    for s in dict.fromkeys(n for n, _ in rows):
        own = sorted((round(d, 12), n, o) for d, n, a, o in pairs if a == s)
        want[s] = [o for *_, o in own[:4]]
    found = {}
    for r in similarity.knn_graph(df, 4).orderBy("s", "rank").collect():
        found.setdefault(r.s, []).append(r.o)
    assert found == want


def test_accessors_spread_bounds_before_they_group_them(spark):
    box = f"<{relations.SCHEMA}bounds>"
    df = spark.createDataFrame([("<e:a>", "<e:p>", "<e:b>"), ("<e:c>", "<e:p>", "<e:d>"), ("<e:a>", box, "2,5,-,-,-,-,-,-^^String"), ("<e:a>", box, "1,5,-,-,-,-,-,-^^String")], "s string, p string, o string")
    found = select("SELECT ?a (WIDTH(?a) AS ?w) WHERE { ?a <e:p> ?b }", df)
    assert sorted(map(tuple, found.collect()), key=str) == [("<e:a>", "4.0^^Double"), ("<e:c>", None)]
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(plan) if "Aggregate" in line)
    assert "RepartitionByExpression" in plan[at + 1]
