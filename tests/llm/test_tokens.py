import hashlib
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from graphloom.llm import bpe, merges, packing, queries, tokens

from .cases import LONG, TEXTS, frame

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def key(r):
    return (r[0] is None, r[0] or 0, *map(str, r[1:]))


def test_counts_equal_the_library(spark):
    got = sorted(map(tuple, tokens.count_tokens(frame(spark), PATH).collect()), key=key)
    want = [(i, len((x or "").encode()), n := len(library(x)), n > 2048) for i, x in TEXTS]
    assert got == sorted(want, key=key)
    assert tokens.count_tokens(frame(spark, []), PATH).count() == 0


def test_own_bpe_equals_the_library(spark):
    t = Tokenizer.from_file(PATH)
    got = sorted(map(tuple, bpe.encode_decode(frame(spark), PATH).collect()), key=key)
    want = [(i, len(ids := library(x)), ids, t.decode(ids, skip_special_tokens=False)) for i, x in TEXTS]
    assert got == sorted(want, key=key)
    assert bpe.encode_decode(frame(spark, []), PATH).count() == 0


def test_bpe_query_over_the_table(spark, sf):
    t = Tokenizer.from_file(PATH)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op6_bpe(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = t.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_batch_merges_equal_the_library():
    rng = np.random.default_rng(5)
    letters = [*"abcdefghijklmnopqrstuvwxyz" * 4, *"éèßüñçøÉÑÄ", *"абвгдйщяЖЙ", "a" * 7, "ing", "th", "the", "ов"]
    words = ["".join(rng.choice(letters, rng.integers(1, 14))) for _ in range(20_000)] + ["a", "aa", "aaaa", "x" * 64, "y" * 65, "é" * 32, "ё", "fi-1", "ŷ"]
    known, ids, other = merges.Merges(PATH).known([w.encode() for w in words])
    assert set(other) >= {("y" * 65).encode(), "fi-1".encode(), "ŷ".encode()} and len(known) > 15_000
    assert dict(zip(known, ids)) == {w.encode(): np.asarray(library(w), "<u4").tobytes() for w in set(words) - {o.decode() for o in other}}
    assert merges.Merges(PATH).known([]) == ([], [], [])


def test_packing_covers_each_id_once(spark, sf):
    for df in (frame(spark, [*TEXTS[:8], TEXTS[10], (12, LONG + " end")]), spark.read.parquet(f"{sf}/documents.parquet")):
        docs = {r.doc_id: r.text for r in df.collect()}
        rows = packing.pack(df, PATH, shard_tokens=50_000).collect()
        by_doc, by_seq = {}, {}
        for r in rows:
            by_doc.setdefault(r.doc_id, []).append(r)
            by_seq.setdefault(r.sequence_id, []).append(r)
        assert set(by_doc) == set(docs)
        for d, own in by_doc.items():
            ids = np.asarray([*library(docs[d]), 2], "<u4")
            at = 0
            for r in sorted(own, key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(ids) and bytes(r.ids) == ids[at : at + r.length].tobytes()
                at += r.length
            assert at == len(ids)
        padding = 0
        for own in by_seq.values():
            at = 0
            for r in sorted(own, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at <= 4096
            padding += 0 if at & (at - 1) == 0 else 4096 - at
        assert padding <= 4096 * (2 + sum(r.length for r in rows) // 50_000 + 4)
    assert packing.pack(frame(spark, []), PATH).count() == 0


def test_packing_crc(spark, sf):
    r = queries.op7_packing(spark, sf).where("start = 0").first()
    text = spark.read.parquet(f"{sf}/documents.parquet").where(f"doc_id = {r.doc_id}").first().text
    assert r.ids_crc32 == zlib.crc32(np.asarray([*library(text), 2][: r.length], "<u4").tobytes())


def test_assign_balances_cost():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 9000, 400).tolist()
    found = packing.assign(lengths, 4096)
    cost, fill = {}, {}
    for d, s, n, q, o in found:
        fill[q] = fill.get(q, 0) + n
        cost[q] = cost.get(q, 0) + packing.LINEAR * n + packing.QUADRATIC * n * n
    assert sum(fill.values()) == sum(lengths) and sum(v < 4096 for v in fill.values()) <= 1
    whole = {q for d, s, n, q, o in found if n == 4096}
    rest = [c for q, c in cost.items() if q not in whole and fill[q] == 4096]
    assert max(rest) < 2.2 * min(rest)


def test_packing_cuts_only_what_fits_nowhere():
    rng = np.random.default_rng(3)
    cost = lambda n: packing.LINEAR * n + packing.QUADRATIC * n * n
    for lengths, capacity in ((np.minimum(4000, rng.lognormal(5.5, 1.2, 3000).astype(int) + 1), 4096), (rng.integers(1, 30, 400), 16), ([], 8), ([8, 16], 8)):
        lengths = [int(n) for n in lengths]
        room, spent, used = {}, {}, {}
        made = packing.assign(lengths, capacity)
        rest = sum(n % capacity for n in lengths)
        full = sum(n // capacity for n in lengths)
        for k in range(-(-rest // capacity)):
            room[full + k], spent[full + k], used[full + k] = min(capacity, rest - k * capacity), 0.0, 0
        want = [(d, k * capacity, capacity) for d, n in enumerate(lengths) for k in range(n // capacity)]
        want = [(*x, k, 0) for k, x in enumerate(want)]
        for n, d in sorted(((n % capacity, d) for d, n in enumerate(lengths) if n % capacity), key=lambda r: (-r[0], r[1])):
            start = lengths[d] - n
            while n:
                k = min((k for k in room if room[k] >= n), key=lambda k: (spent[k], k), default=None)
                k = min((k for k in room if room[k]), key=lambda k: (spent[k], k)) if k is None else k
                take = min(n, room[k])
                want.append((d, start, take, k, used[k]))
                used[k], room[k], spent[k], start, n = used[k] + take, room[k] - take, spent[k] + cost(take), start + take, n - take
        assert made == want


def test_parts_of_chunks_are_looked_up_once(monkeypatch):
    """Chunks that differ only in closing marks share one look-up, and the ids of texts equal the library's."""
    seen = []
    learn = tokens.ChunkCache.learn
    monkeypatch.setattr(tokens.ChunkCache, "learn", lambda self, chunks: learn(self, seen.append(list(chunks)) or seen[-1]))
    words = ["été", "Éa", "thing", "中文", "x1", "don't", "***", "a.b", "ß", "yyy" * 30, "<|endoftext|>", "ŷ", "ж", "п́"]
    texts = ["", " \n", *words, " ".join(w + t for w in words for t in ("", ".", "?!", "**", "%$|")), "a\x0bb\x0c\x1cc d.  "]
    cache = tokens.ChunkCache(PATH, True)
    ids, starts = cache.texts([x.encode() for x in texts])
    assert [ids[i:j].tolist() for i, j in zip(starts, starts[1:])] == [library(x) for x in texts]
    assert seen[-1].count(b"thing") == 1 and "été".encode() in seen[-1] and not {"été?!".encode(), b"thing."} & set(seen[-1])
    assert not len(cache.texts([b"", b" "])[0])


def test_own_bpe_merges_plain_words_together(monkeypatch):
    """Only what isn't a plain word is merged by itself; the ids and decoded texts equal the library's, and nothing goes to it."""
    alone, merge = [], bpe.WordBpe.merge
    monkeypatch.setattr(bpe.WordBpe, "merge", lambda self, word: merge(self, alone.append(word) or word))
    monkeypatch.setattr(tokens, "tokenizer", None)
    words = ["été", "Éa", "thing", "中文", "x1", "don't", "***", "a.b", "ß", "yyy" * 30, "<|endoftext|>", "ŷ", "ж", "п́"]
    texts = ["", " \n", *words, " ".join(w + t for w in words for t in ("", ".", "?!", "**", "%$|")), "a\x0bb\x0c\x1cc d.  "]
    cache = bpe.Cache(PATH)
    ids, starts = cache.texts([x.encode() for x in texts])
    assert [ids[i:j].tolist() for i, j in zip(starts, starts[1:])] == [library(x) for x in texts]
    assert cache.bpe.decode(ids, starts).to_pylist() == [LIBRARY.decode(library(x), skip_special_tokens=False) for x in texts]
    assert alone and not {"été".encode(), b"thing", "ж".encode()} & set(alone)
