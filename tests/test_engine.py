"""Behaviour beyond the table queries: SPARQL corner cases, stores, sources, derived relations."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import derived, relations, similarity
from graphloom.operators.store import QuadStore
from graphloom.plans import sparql
from graphloom.sources import files

S = "s string, p string, o string"


def ask(spark, quads, query):
    return sorted((tuple(r) for r in sparql.select(query, spark.createDataFrame(quads, S)).collect()), key=str)


def test_patterns_keep_their_order(spark):
    quads = [("<e:1>", "<e:p>", "<e:b>"), ("<e:2>", "<e:p>", "<e:b>"), ("<e:1>", "<e:q>", "<e:x>"), ("<e:c>", "<e:r>", "<e:x>"), ("<e:d>", "<e:r>", "<e:y>")]
    got = ask(spark, quads, "SELECT ?a ?c ?x WHERE { ?a <e:p> ?b OPTIONAL { ?a <e:q> ?x } ?c <e:r> ?x }")
    assert got == [("<e:1>", "<e:c>", "<e:x>"), ("<e:2>", "<e:c>", "<e:x>"), ("<e:2>", "<e:d>", "<e:y>")]


def test_exact_longs(spark):
    big = 9007199254740993
    quads = [("<e:a>", "<e:n>", f"{big}^^Long"), ("<e:b>", "<e:n>", f"{big - 1}^^Long")]
    assert ask(spark, quads, f"SELECT ?s WHERE {{ ?s <e:n> ?o FILTER(?o = {big}) }}") == [("<e:a>",)]
    assert ask(spark, quads, f"SELECT ?s WHERE {{ ?s <e:n> ?o FILTER(?o < {big}) }}") == [("<e:b>",)]
    assert ask(spark, quads[:1], "SELECT (SUM(?o) AS ?t) (?t + 1 AS ?u) WHERE { ?s <e:n> ?o }") == [(f"{big}^^Long", f"{big + 1}^^Long")]
    assert ask(spark, quads, "SELECT (MAX(?o) AS ?t) (SUM(?o) AS ?u) WHERE { ?s <e:n> ?o }") == [(f"{big}^^Long", f"{2 * big - 1}^^Long")]


def test_functions(spark):
    quads = [("<e:a>", "<e:v>", "ab-cd^^String"), ("<e:a>", "<e:h>", "-^^String"), ("<e:a>", "<e:t>", "2024-02-03T04:05:06+02:30^^String")]
    q = "SELECT (STRBEFORE(?v, ?h) AS ?a) (STRAFTER(?v, ?h) AS ?b) (REPLACE(?v, 'AB', 'x', 'i') AS ?c) (STRBEFORE(?v, '?') AS ?d) (TZ(?t) AS ?e) (TIMEZONE(?t) AS ?f) (STRDT('5', <http://www.w3.org/2001/XMLSchema#integer>) AS ?g) (STRLANG('x', 'en') AS ?i) WHERE { ?s <e:v> ?v ; <e:h> ?h ; <e:t> ?t }"
    assert ask(spark, quads, q) == [("ab^^String", "cd^^String", "x-cd^^String", "^^String", "+02:30^^String", "PT2H30M^^String", "5^^Long", "x^^String")]
    assert ask(spark, quads, "SELECT ?a WHERE { BIND(<http://www.w3.org/2001/XMLSchema#boolean>('true') AS ?a) FILTER(?a) }") == [("true^^String",)]
    assert ask(spark, quads, "SELECT (SHA1('a') AS ?x) (MD5('a') AS ?y) (ENCODE_FOR_URI('a b') AS ?z) WHERE { }")[0][2] == "a%20b^^String"
    with pytest.raises(ValueError):
        ask(spark, quads, "SELECT (CLIP_TEXT('x') AS ?a) WHERE { }")
    sparql.set_text_embedder(lambda xs: [[len(x), 1.5] for x in xs])
    sparql.register_function("twice", lambda x: F.concat(x, x))
    try:
        assert ask(spark, quads, "SELECT (CLIP_TEXT(?h) AS ?a) (TWICE(?h) AS ?b) WHERE { ?s <e:h> ?h }") == [("1.0,1.5^^String", "--^^String")]
    finally:
        sparql.FUNCTIONS.clear()


def test_rejected_forms(spark):
    for q in ("ASK { ?s ?p ?o }", "SELECT ?s WHERE { GRAPH <e:g> { ?s ?p ?o } }", "SELECT ?s WHERE { SERVICE <e:g> { ?s ?p ?o } }"):
        with pytest.raises(ValueError):
            ask(spark, [("<e:a>", "<e:p>", "<e:a>")], q)


def test_repeated_variable_and_group_concat(spark):
    quads = [("<e:a>", "<e:p>", "<e:a>"), ("<e:a>", "<e:p>", "<e:b>"), ("<e:b>", "<e:l>", "y^^String"), ("<e:b>", "<e:l>", "x^^String")]
    assert ask(spark, quads, "SELECT ?x WHERE { ?x <e:p> ?x }") == [("<e:a>",)]
    assert ask(spark, quads, "SELECT (GROUP_CONCAT(?l; SEPARATOR=',') AS ?t) WHERE { ?x <e:l> ?l }") == [("x,y^^String",)]
    assert ask(spark, quads, "SELECT ?x WHERE { ?x !(<e:l>) <e:b> }") == [("<e:a>",)]
    df = spark.createDataFrame(quads, S)
    made = json.loads(sparql.json_result(sparql.select("SELECT ?x ?l WHERE { ?x <e:l> ?l } ORDER BY ?l", df)))
    assert made["head"] == {"vars": ["x", "l"]} and made["results"]["bindings"][0]["l"] == {"type": "literal", "value": "x", "datatype": sparql.XSD + "string"}
    assert sparql.table(sparql.select("SELECT ?l WHERE { ?x <e:l> ?l } ORDER BY ?l", df)) == "l\n-\nx\ny"


def test_store_prunes_and_pushes_filters(spark, tmp_path):
    quads = spark.createDataFrame([(f"<e:{i}>", f"<e:p{i % 5}>", f"v{i}^^String") for i in range(50)], S)
    files.write_store(quads, str(tmp_path / "q"))
    store = QuadStore(files.read_store(spark, str(tmp_path / "q")))
    for df in (store.filter(p=["<e:p1>"]), store.sparql("SELECT ?s WHERE { ?s <e:p1> ?o FILTER(?o = 'v1') }"), store.sparql("SELECT ?s WHERE { ?s <e:p1> 'v1' }")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        scan = next(x for x in plan.split("\n") if "FileScan" in x)
        assert "PartitionFilters: [isnotnull(p_bucket" in scan and "EqualTo(p,<e:p1>)" in scan, scan
    assert "EqualTo(o,v1^^String)" in scan
    assert store.filter(p=["<e:p1>"]).count() == 10 and store.sparql("SELECT ?s WHERE { ?s <e:p1> 'v1' }").collect()[0][0] == "<e:1>"
    r = store.with_ids().first()
    assert store.get_id(r.id).collect() == [r] and not store.is_empty() and store.size() == 50 and store.contains_all(quads)
    assert store.filter(o=[]).count() == 0 and store.distinct_subjects("<e:p2>").count() == 10


def test_tsv_round_trip_import_and_dump(spark, tmp_path):
    quads = spark.createDataFrame([("<e:a>", "<e:p>", "l1\nl2\t\"q\"^^String"), ("<http://localhost/x>", "<e:p>", "1^^Long")], S)
    files.write_tsv(quads, str(tmp_path / "a"))
    assert sorted(map(tuple, files.read_tsv(spark, str(tmp_path / "a")).collect())) == sorted(map(tuple, quads.collect()))
    files.dump(quads, str(tmp_path / "b"))
    assert [r.s for r in files.read_tsv(spark, str(tmp_path / "b")).collect()] == ["<e:a>"]
    (tmp_path / "x.tsv").write_text("skip\tme\tplease\n<e:a b>\t<e:p>\t5^^Long\n<e:c>\t<e:p>\n")
    assert [tuple(r) for r in files.import_tsv(spark, str(tmp_path / "x.tsv"), skip=1).collect()] == [("<e:a_b>", "<e:p>", "5^^Long")]
    assert files.import_tsv(spark, str(tmp_path / "x.tsv"), keep_spaces=True).count() == 2


def test_tree_of_segments(spark):
    of, box = relations.SEGMENT_OF, relations.SEGMENT_BOUNDS
    quads = [("<e:b>", of, "<e:a>"), ("<e:c>", of, "<e:b>"), ("<e:d>", of, "<e:b>"), ("<e:c>", box, "0,1,0,1,-,-,-,-^^String"), ("<e:d>", box, "0,2,0,2,-,-,-,-^^String"), ("<e:x>", f"<{relations.SCHEMA}sameAs>", "<e:d>"), ("<e:z>", "<e:p>", "<e:a>")]
    quads += [("<e:d>", f"<{relations.SCHEMA}canonicalId>", "id^^String")]
    store = QuadStore(spark.createDataFrame(quads, S))
    assert sorted(map(tuple, store.ancestors("<e:c>").collect())) == [("<e:a>", 2), ("<e:b>", 1)]
    assert sorted(map(tuple, store.descendants("<e:a>").collect())) == [("<e:b>", 1), ("<e:c>", 2), ("<e:d>", 2)]
    about = store.about("<e:b>").collect()
    assert sorted((r.part, r.s, r.o, r["rank"]) for r in about if r.part in ("segment", "ancestor")) == [("ancestor", "<e:b>", "<e:a>", 1.0), ("segment", "<e:c>", "<e:b>", 2.0), ("segment", "<e:d>", "<e:b>", 1.0)]
    assert {r.prefix for r in about if r.part == "out"} == {relations.SCHEMA}
    assert [tuple(r) for r in store.resolve("<e:x>").collect()] == [("<e:d>", "id", None)]
    assert sorted(r.s for r in store.delete_object("<e:b>").quads.collect()) == ["<e:z>"]


def png(pixels):
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    rows = b"".join(b"\x00" + bytes(v for p in row for v in p) for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(pixels[0]), len(pixels), 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_derived_relations(spark):
    model = {"pictures": [{"self_ref": "#/pictures/0", "label": "picture", "prov": [{"page_no": 2, "bbox": {"l": 1, "t": 9, "r": 5, "b": 3}}], "captions": [{"$ref": "#/texts/0"}]}], "texts": [{"self_ref": "#/texts/0", "label": "caption", "text": "A cat", "prov": [{"page_no": 2, "bbox": {"l": 1, "t": 2, "r": 5, "b": 1}}]}, {"self_ref": "#/texts/1", "text": "no place", "prov": []}]}
    model["tables"] = [{"self_ref": "#/tables/0", "prov": [{"page_no": 1, "bbox": {"l": 0, "t": 1, "r": 1, "b": 0}}], "data": {"table_cells": [{"start_row_offset_idx": 1, "start_col_offset_idx": 0, "text": "c"}, {"start_row_offset_idx": 0, "start_col_offset_idx": 1, "text": 'b"'}, {"start_row_offset_idx": 0, "start_col_offset_idx": 0, "text": "a"}]}}]
    quads = spark.createDataFrame([("<e:pdf>", relations.BOUNDS, "-,-,-,-,-,-,0.0,3.0^^String"), ("<e:t2>", f"<{relations.DERIVED}text>", "old^^String")], S)
    image = png([[(255, 0, 0, 255), (0, 0, 255, 0)], [(255, 0, 0, 255), (0, 255, 0, 255)]])
    objects = spark.createDataFrame([("<e:pdf>", "application/pdf", b"%PDF"), ("<e:t>", "text/plain", "grün".encode()), ("<e:t2>", "text/plain", b"new"), ("<e:i>", "image/png", image), ("<e:bad>", "image/png", b"x"), ("<e:m>", "model/obj", b"v 0 0 0\nv -1 2 3.5\nf 1 2 1"), ("<e:n>", "text/plain", None)], "s string, mime string, content binary")
    assert [tuple(r) for r in derived.derive(quads, objects, "text").collect()] == [("<e:t>", f"<{relations.DERIVED}text>", "grün^^String")]
    pages = derived.derive(quads, objects, "page")
    assert sorted(r.o for r in pages.where(F.col("p").endswith("page>")).collect()) == [f"<e:pdf/segment/page/{i}-{i + 1}>" for i in range(3)] and pages.count() == 15
    color = [float(x) for x in derived.derive(quads, objects, "averageColor").collect()[0].o[1:].split("]")[0].split(",")]
    assert np.allclose(color, [2 / 3, 1 / 3, 0])
    assert derived.mesh_bounds(objects).collect()[0].o == "-1.0,0.0,0.0,2.0,0.0,3.5,-,-^^String"
    assert derived.derive(quads, objects, "clipEmbedding").count() == 0
    derived.set_model("clipEmbedding", lambda xs: [[len(x), 0.5] for x in xs])
    derived.set_model("documentModelJson", lambda xs: [json.dumps(model) for _ in xs])
    try:
        assert {r.s: r.o for r in derived.derive(quads, objects, "clipEmbedding").collect()}["<e:bad>"] == "[1.0, 0.5]^^FloatVector"
        all_ = derived.materialized(quads, objects, "documentModelJson")
        for name in ("figure", "table", "paragraph"):
            all_ = derived.materialized(all_, objects, name)
        rows = all_.where(F.col("p").contains("nlp#text")).collect()
        assert sorted(r.o for r in rows) == ['"a","b"""\n"c"^^String', "A cat^^String"]
        assert [(r.s, r.o) for r in derived.captions(all_).collect()] == [("<e:pdf/segment/page/2/segment/rect/1.0,5.0,3.0,9.0>", "<e:pdf/segment/page/2/segment/rect/1.0,5.0,1.0,2.0>")]
        assert derived.derive(all_, objects, "figure").count() == 0
    finally:
        for name in ("clipEmbedding", "documentModelJson"):
            derived.set_model(name, None)
    with pytest.raises(ValueError):
        derived.derive(quads, objects, "nonsense")


def test_virtual_relations_by_name(spark):
    vec = lambda *v: str([float(x) for x in v]) + "^^FloatVector"
    quads = [("<e:a>", relations.EMBEDDING, vec(1, 0)), ("<e:b>", relations.EMBEDDING, vec(1, 0.1)), ("<e:c>", relations.EMBEDDING, vec(0, 1))]
    assert ask(spark, quads, f"SELECT ?a ?b WHERE {{ ?a <{relations.IMPLICIT}clipNearDuplicate> ?b }}") == [("<e:a>", "<e:b>"), ("<e:b>", "<e:a>")]
    assert ask(spark, quads, f"SELECT ?b WHERE {{ <e:c> <{relations.IMPLICIT}clip1nn> ?b }}") == [("<e:b>",)]
    assert ask(spark, quads, f"SELECT ?a WHERE {{ ?a <{relations.IMPLICIT}1nn/clipEmbedding> <e:a> }}") == [("<e:b>",)]
    relations.register(r"self$", lambda q, m: q.select("s", F.col("s").alias("o")).distinct())
    try:
        assert len(ask(spark, quads, f"SELECT ?a WHERE {{ ?a <{relations.IMPLICIT}self> ?a }}")) == 3
    finally:
        relations._RULES.pop(0)


def test_relevance_feedback_equals_a_plain_classifier(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(1, 0.4, (30, 3)), rng.normal(-1, 0.4, (30, 3))])
    rows = spark.createDataFrame([(f"{i:02d}", v.tolist()) for i, v in enumerate(x)], "s string, v array<double>")
    got = similarity.feedback(rows, x[:5].tolist(), x[30:35].tolist(), 10).collect()
    # hinge loss with the same margin, by plain subgradient steps
    a, y, w = np.column_stack([x[[*range(5), *range(30, 35)]], np.ones(10)]), np.array([1] * 5 + [-1] * 5), np.zeros(4)
    best = (np.inf, w)
    for t in range(1, 20_000):
        w = w - (w - ((y * (a @ w) < 1) * y) @ a) / t
        best = min(best, (0.5 * w @ w + np.maximum(0, 1 - y * (a @ w)).sum(), w), key=lambda b: b[0])
    order = np.argsort(-(x @ best[1][:3]))[:10]
    assert len({r.s for r in got} & {f"{i:02d}" for i in order}) >= 9 and all(int(r.s) < 30 for r in got)
