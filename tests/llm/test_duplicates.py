import hashlib
import random
from collections import defaultdict

import pytest

from graphloom.llm import neardup, queries, substrings

from .cases import frame


def brute_near(docs, percent=85):
    sets = {}
    for d, x in docs.items():
        w = [bytes(c) for c in (x or "").encode().lower().split()]
        sets[d] = {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()
    up = {d: d for d in docs}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                n = len(x & y)
                if 100 * n >= percent * (len(x) + len(y) - n):
                    p, q = root(a), root(b)
                    up[max(p, q)] = min(p, q)
    return {(d, len(sets[d]), root(d), root(d) == d) for d in docs}


def brute_repeats(docs, window=50):
    first = {}
    words = {d: (x or "").encode().split() for d, x in docs.items()}
    for d in sorted(docs):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i : i + window]), d)
    out = set()
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        out.add((d, len(w), len(gone), hashlib.sha256(b" ".join([x for i, x in enumerate(w) if i not in gone])).hexdigest()))
    return out


def family(seed=0):
    rng = random.Random(seed)
    word = lambda: "w" + str(rng.randrange(4000))
    base = [word() for _ in range(400)]
    passage = [word() for _ in range(70)]
    docs, d = {}, 0
    for k in range(40):  # copies that differ by a few words, some in a chain
        x = list(base if k < 20 else docs[d - 1].split())
        for _ in range(rng.randrange(0, 12)):
            x[rng.randrange(len(x))] = word()
        docs[d] = " ".join(x)
        d += 1
    for k in range(30):  # a shared passage, whole or in part, inside own words
        own = [word() for _ in range(rng.randrange(0, 200))]
        cut = rng.randrange(0, 25)
        at = rng.randrange(len(own) + 1)
        docs[d] = "\n".join([*own[:at], *passage[cut:], *own[at:]])
        d += 1
    for k in range(6):
        docs[d] = " ".join(["In."] * (40 + 5 * k))
        d += 1
    for x in (None, "", "  ", "one", "One", "one two", "ONE two", docs[3], docs[3].upper(), docs[60]):
        docs[d] = x
        d += 1
    return docs


@pytest.mark.parametrize("which", ["family", "table"])
def test_near_duplicates(spark, sf, which):
    docs = family() if which == "family" else {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    df = frame(spark, list(docs.items())) if which == "family" else spark.read.parquet(f"{sf}/documents.parquet")
    got = {tuple(r)[:4] for r in neardup.near_duplicates(df).collect()}
    assert got == brute_near(docs)


@pytest.mark.parametrize("which", ["family", "table"])
def test_repeats(spark, sf, which, tmp_path):
    docs = family(1) if which == "family" else {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    df = frame(spark, list(docs.items()))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r)[:4] for r in queries.op4_repeats(spark, str(tmp_path)).collect()}
    assert got == brute_repeats(docs)


def test_deduplicated_keeps_rows_and_columns(spark):
    docs = family(2)
    df = frame(spark, [*docs.items(), (None, docs[0])])
    out = substrings.deduplicated(df)
    assert out.columns == df.columns
    got = defaultdict(list)
    for r in out.collect():
        got[r.doc_id].append(r.text)
    want = {d: (n, s) for d, _, n, s in brute_repeats(docs)}
    assert got.pop(None) == [docs[0]] and set(got) == set(docs)
    for d, (x,) in got.items():
        assert x == docs[d] if not want[d][0] else hashlib.sha256(x.encode()).hexdigest() == want[d][1]


def test_empty_and_odd(spark):
    assert neardup.near_duplicates(frame(spark, [])).count() == 0
    assert substrings.deduplicated(frame(spark, [])).count() == 0
    rows = [(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, "x y z q")]
    got = sorted(map(tuple, neardup.near_duplicates(frame(spark, rows)).select("doc_id", "component_id", "kept").collect()), key=str)
    assert got == [(1, 1, True), (1, 1, True), (2, 2, True), (None, None, True)]
    assert neardup.keep_one(frame(spark, rows)).count() == 4


def test_proposed_links_are_named_so(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join([*words[:k], f"x{k}", *words[k + 1 :]])) for k in range(6)]
    got = neardup.near_duplicates(frame(spark, rows, more=False))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept", "n_proposed_links"]
    assert {r.component_id for r in got.collect()} == {0} and all(1 <= r.n_proposed_links <= 5 for r in got.collect())
