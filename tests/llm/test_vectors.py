import numpy as np

from graphloom.llm import queries, vectors


def brute(ids, x, qids, k):
    out = {}
    for i in qids:
        s = x @ x[ids.tolist().index(i)]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
        out[i] = ids[order].tolist(), s[order]
    return out


def test_recall_and_scores(spark, sf):
    d = sf.replace("sf0.001", "sf0.1")
    rows = spark.read.parquet(f"{d}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {}
    for r in sorted(queries.op5_nearest(spark, d).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(ids, x, [i for i in ids.tolist() if i % 20 == 0], 20)
    assert set(got) == set(want)
    hits = 0
    for q, (near, _) in want.items():
        own = got[q]
        assert [r for r, _, _ in own] == list(range(1, 21)) and own == sorted(own, key=lambda r: (-r[2], r[1]))
        at = {i: n for n, i in enumerate(ids.tolist())}
        assert np.allclose([s for _, _, s in own], [x[at[v]] @ x[at[q]] for _, v, _ in own], atol=1e-12)
        hits += len(set(near) & {v for _, v, _ in own})
    recall = hits / (20 * len(want))
    print("recall", recall)
    assert recall >= 0.93


def test_norms_vary(spark, monkeypatch):
    monkeypatch.setattr(vectors, "INDEX_ROWS", 700)
    rng = np.random.default_rng(0)
    x = rng.standard_normal((2000, 16)) * rng.uniform(0.1, 3, (2000, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in vectors.nearest(df, df.where("vec_id % 20 = 0"), 10).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute(np.arange(2000), x, list(range(0, 2000, 20)), 10)
    assert sum(len(set(n) & got[q]) for q, (n, _) in want.items()) / 1000 >= 0.93


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, []), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (None, [1.0, 1.0]), (40, [1.0]), (9, [-1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS block", "'' AS v")
    got = sorted(map(tuple, vectors.nearest(df, df.where("vec_id % 20 = 0"), 20).collect()))
    assert got == [(0, 1, 7, 1.0), (0, 2, 20, 1.0), (0, 3, 9, -1.0), (20, 1, 0, 1.0), (20, 2, 7, 1.0), (20, 3, 9, -1.0)]
    assert vectors.nearest(df.limit(0), df.limit(0)).count() == 0
