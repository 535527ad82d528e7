import corpus_pipeline
from graphloom.llm import toxicity
from graphloom.llm.common import read


def test_stages_follow_each_other(spark, sf):
    docs = read(spark, sf, "documents")
    columns, before = docs.columns, None
    model = toxicity.train(docs, read(spark, sf, "labels"))
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, sf)
        rows = made.collect()
        if name == "packing":
            texts = {r.doc_id for r in before}
            assert {r.doc_id for r in rows} == texts
            for d in texts:
                own = sorted((r for r in rows if r.doc_id == d), key=lambda r: r.start)
                assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))] and sum(r.length for r in own) == own[0].doc_tokens
            break
        assert made.columns == columns
        ids = {r.doc_id for r in rows}
        if name == "toxicity":
            assert ids == {r.doc_id for r in toxicity.scored(docs, model).where("toxicity < 0.5").collect()}
        elif name == "near_duplicates":
            assert ids < {r.doc_id for r in before}
        else:
            assert ids == {r.doc_id for r in before}
        before, docs = rows, spark.createDataFrame(rows, made.schema)
