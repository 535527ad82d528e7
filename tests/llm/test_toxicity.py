import random
import time
from collections import Counter

import numpy as np

from graphloom.llm import queries, toxicity

from .cases import frame


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    s = np.asarray(score)[order]
    at = np.arange(1, len(s) + 1, dtype=float)
    for v in np.unique(s):
        at[s == v] = at[s == v].mean()
    rank[order] = at
    y = np.asarray(y)
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("sf0.001", "sf0.1")
    y = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op8_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == toxicity.fold(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.score, y[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in y]
    score, label, said = zip(*held)
    hit = sum(a and b for a, b in zip(label, said))
    print("held out", len(held), "auc", auc(score, label), "recall", hit / sum(label), "precision", hit / max(1, sum(said)))
    assert auc(score, label) > 0.9 and hit / sum(label) > 0.8 and hit / sum(said) > 0.9


def test_index_is_exact():
    rng = np.random.default_rng(1)
    full = np.where(rng.random((700, 90)) < np.linspace(0.005, 0.5, 90), rng.random((700, 90)) + 0.01, 0)
    full = full[full.any(axis=1)]
    full[::50] = full[0]  # ties
    full /= np.sqrt((full * full).sum(axis=1))[:, None]
    full = full.astype(np.float32).astype(float)
    row, terms = np.nonzero(full)
    starts = np.concatenate([[0], np.cumsum((full > 0).sum(axis=1))])
    index = toxicity.Index(starts, terms, full[row, terms], 90)
    assert (index.common >= 0).any() and (index.common < 0).any()
    for i in range(0, len(full), 7):
        cosine = full @ full[i]
        want = [e for e in np.lexsort((np.arange(len(full)), -cosine.round(12))) if cosine[e] > 0][:24]
        got, score = index.nearest(np.flatnonzero(full[i]), full[i][full[i] > 0], 24)
        assert np.allclose(score, cosine[want], atol=1e-9) and np.allclose(cosine[got], score, atol=1e-9)
        assert i % 50 or list(got[:5]) == want[:5]


def test_scores_and_evidence_equal_brute_force(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels)
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    held = {i: {} for i in texts}
    for i, x in texts.items():
        for chunk in x.split():
            for t in toxicity.terms_of(chunk):
                if t in model.terms:
                    held[i][t] = held[i].get(t, 0) + 1
    df = {t: sum(t in h for h in held.values()) for t in model.terms}
    toxic = {r.doc_id: r.toxic for r in labels.collect() if r.toxic in (0, 1) and not toxicity.fold(r.doc_id)}
    p = sum(toxic.values()) / len(toxic)

    def weigh(t):
        own = [toxic[i] for i in toxic if t in held[i]]
        z = (sum(own) - len(own) * p) / np.sqrt(len(own) * p * (1 - p) + 1)
        return (np.log((1 + len(texts)) / (1 + df[t])) + 1) * (1 + max(0, z - toxicity.PLAIN_Z))

    weight = {t: weigh(t) for t in model.terms}
    assert all(abs(model.weight[i] - weight[t]) < 1e-9 for t, i in model.terms.items())

    def unit(h):
        v = {t: (1 + np.log(n)) * weight[t] for t, n in h.items()}
        norm = np.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    vectors = {i: unit(h) for i, h in held.items() if h}
    examples = sorted(i for i in toxic if i in vectors)
    assert list(model.ids) == examples and list(model.labels) == [toxic[i] for i in examples]
    for r in toxicity.scored(docs, model).collect():
        if r.doc_id not in vectors:
            assert r.toxicity == model.base and not r.toxicity_evidence
            continue
        own = vectors[r.doc_id]
        cosine = np.array([sum(w * vectors[e].get(t, 0.0) for t, w in own.items()) for e in examples])
        near = sorted((c for c in cosine if c > 0), reverse=True)[: toxicity.NEIGHBOURS]
        assert np.allclose([e.cosine for e in r.toxicity_evidence], near, atol=1e-5)
        assert np.allclose([cosine[examples.index(e.doc_id)] for e in r.toxicity_evidence], near, atol=1e-5)
        got = [examples.index(e.doc_id) for e in r.toxicity_evidence]
        closeness = 1 / (1.05 - cosine[got])
        vote = (closeness @ np.array([toxic[examples[i]] for i in got]) + model.base) / (closeness.sum() + 1)
        assert abs(r.toxicity - np.interp(vote, *model.curve)) < 1e-3


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (5, 0), (77, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    for rows in (None, []):
        docs = frame(spark) if rows is None else frame(spark, [])
        model = toxicity.train(docs, labels)
        out = toxicity.scored(docs, model)
        assert out.columns == [*docs.columns, "toxicity", "toxicity_evidence"] and out.count() == docs.count()
        assert all(0 <= r.toxicity <= 1 for r in out.collect())
    assert toxicity.scored(frame(spark), toxicity.train(frame(spark), labels.limit(0))).where("toxicity = 0").count() == frame(spark).count()


def test_terms_of_many_texts_are_counted_at_once():
    """Of every text all terms, each as often as word by word, for less than half of what finding the words one by one costs."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyzéüßñ中", k=rng.randint(1, 11)))
    texts = [" ".join(word() for _ in range(500)) for _ in range(300)]
    odd = ["", " \n", "İstanbul ΟΔΟΣ ΟΔΟΣ. STRASSE ǅ", "a" * 31 + " " + "b" * 32 + " " + "c" * 33 + " " + "c" * 5000, "abcde abcdef_abcdef-ABCDEFG", "\x00x\x00X x1x"]
    texts = [x.encode() for x in [*odd, *texts, " ".join(odd)]]
    own = [Counter(t for c in x.split() for t in toxicity.terms_of(c)) for x in texts]
    model = toxicity.Model({t: i for i, t in enumerate(sorted({t for x in (*own[:60], own[-1]) for t in x}))}, np.zeros(0))
    list(model.counts(texts[:1]))  # builds the table
    costs = []
    for _ in range(3):
        began = time.process_time()
        runs = list(model.counts(texts))
        costs.append(time.process_time() - began)
    got = [(t[i:j], n[i:j]) for starts, t, n in runs for i, j in zip(starts, starts[1:])]
    assert len(got) == len(texts)
    for x, (t, n) in zip(own, got):
        want = sorted((model.terms[w], k) for w, k in x.items() if w in model.terms)
        assert list(zip(t.tolist(), n.tolist())) == want
    began = time.process_time()
    for x in texts:
        for c in x.split():
            toxicity.terms_of(c)
    assert min(costs) < 0.5 * (time.process_time() - began)
