"""Repeated passages: words covered by a window that also starts in an earlier document are removed.

Method: documents are reduced to sampled phrases (the winnowed PHRASE-grams: every window holds one that any other copy
of the window selects too). Phrases that texts of different content share are confirmed by aggregation; documents without
any are done. The others are spread over shards of bounded bytes; each shard compiles an Aho-Corasick automaton over word
ids of just the recurring phrases that occur in it and streams its documents through it, which locates every occurrence.
The windows around occurrences are then confirmed across all documents by 128-bit digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import checkpointed, claim, key_bitmap, mapped, maybe_in, raw_texts, release
from graphloom.llm.neardup import clear_words, mix, word_hashes

#: Words of a phrase: half a window, so that phrases shared by chance are rare and a window spans as many starts.
SHARD_WORDS = 400_000
_A, _B = np.uint64(0xD1342543DE82EF95), np.uint64(0xAEF17502108EF2D9)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least n of each."""
    known = _powers.get(int(base))
    if known is None or len(known[0]) < n:
        size = max(1 << 15, 1 << n.bit_length())
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        up, down = np.full(size, base, np.uint64), np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        known = _powers[int(base)] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return known


def rolling(h: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """A hash of every run of `size` words, from prefix sums."""
    n = len(h)
    up, down = powers(base, n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(h ^ base) * down[:n], out=total[1:])
    return mix((total[size:] - total[:-size]) * up[: n - size + 1])


def winnowed(h: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the phrases that some window selects: the first smallest of those that it holds."""
    g = rolling(h, phrase, _A)
    span = window - phrase + 1
    if len(g) < span:
        return np.empty(0, np.int64), g[:0]
    # the smallest of each span by doubling; then a start is selected where it is first with the smallest of a span
    low, reach = g, 1
    while reach * 2 <= span:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    rest = span - reach
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    at = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
    order = np.unique(np.concatenate([_first(g, low, at, span), _first(g, low, np.r_[at[1:] - 1, len(low) - 1], span)]))
    return order, g[order]


def _first(g: np.ndarray, low: np.ndarray, at: np.ndarray, span: int) -> np.ndarray:
    """For spans that begin at `at`, where their smallest phrase first is."""
    out = at.copy()
    todo = np.flatnonzero(g[out] != low[at])
    while len(todo):
        out[todo] += 1
        todo = todo[g[out[todo]] != low[at[todo]]]
    return out


def marks(starts: np.ndarray, n: int, window: int) -> np.ndarray:
    """Which of n words windows at these starts cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return np.cumsum(edge[:n]) > 0


def sketch(docs: DataFrame, id_col: str, text_col: str, window: int, phrase: int) -> DataFrame:
    """Per document: id, n_words, a digest of the word sequence (two longs), sha256 of the words joined by one space, and its selected phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("words", clear_words)
        for b in batches:
            n, d1, d2, sha, starts, hashes, lengths = [], [], [], [], [], [], []
            for x in raw_texts(b, "text"):
                words = x.split()
                joined = b" ".join(words)
                digest = xxhash.xxh3_128_digest(joined)
                n.append(len(words))
                d1.append(int.from_bytes(digest[:8], "little", signed=True))
                d2.append(int.from_bytes(digest[8:], "little", signed=True))
                sha.append(hashlib.sha256(joined).hexdigest())
                at, g = winnowed(word_hashes(words), window, phrase) if len(words) >= window else (np.empty(0, np.int64), np.empty(0, np.uint64))
                g, first = np.unique(g, return_index=True)
                starts.append(at[first].astype(np.int32))
                hashes.append(g.view(np.int64))
                lengths.append(len(g))
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sha, pa.string()),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(hashes))), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(starts))),
                ],
                names=["doc_id", "n_words", "d1", "d2", "sha", "phrases", "starts"],
            )

    return mapped(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")),
        run,
        "doc_id long, n_words long, d1 long, d2 long, sha string, phrases array<long>, starts array<int>",
    )


def windows(words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each window: together its digest."""
    h = word_hashes(words)
    return rolling(h, window, _A).view(np.int64), rolling(h, window, _B).view(np.int64)


def located(docs: pa.Table, seeds: pa.Table, window: int, phrase: int) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    """Of one shard: id, words and starts of the windows that hold a recurring phrase, for each document with any.
    The automaton runs over word ids; an id stands for one word of this shard."""
    texts = dict(zip(docs.column("doc_id").to_pylist(), raw_texts(docs.combine_chunks().to_batches()[0], "text"))) if docs.num_rows else {}
    split = {d: x.split() for d, x in texts.items()}
    number: dict[bytes, int] = {}
    coded = {d: [number.setdefault(w, len(number) + 1) for w in words] for d, words in split.items()}
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for d, s in zip(seeds.column("doc_id").to_pylist(), seeds.column("start").to_pylist()):
        if d in coded:
            automaton.add_word(tuple(coded[d][s : s + phrase]), True)
    if not len(automaton):
        return
    automaton.make_automaton()
    for d, codes in coded.items():
        ends = np.fromiter((e for e, _ in automaton.iter(tuple(codes))), np.int64) if len(codes) >= window else ()
        if len(ends):
            # a window that holds the phrase ending at e starts between e - window + 1 and e - phrase + 1
            edge = np.zeros(len(codes) + 1, np.int64)
            np.add.at(edge, np.maximum(ends - window + 1, 0), 1)
            np.add.at(edge, ends - phrase + 2, -1)
            inside = np.flatnonzero(np.cumsum(edge)[: len(codes) - window + 1] > 0)
            if len(inside):
                yield d, split[d], inside


def repeated(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(sketches of all documents, changes): changes has, for each document that loses words, doc_id, n_removed and kept
    (its remaining words joined by one space).

    Words are runs of bytes other than ASCII white space, unchanged. Windows are judged on the input. Null, empty and
    short texts lose nothing; rows of a null id neither lose words nor make others lose any. Rows that share an id are one
    document's: equal ids aren't smaller, so they don't make each other lose words; an id is expected to have one text.

    A document whose whole word sequence stands in an earlier one loses every word if it has a window at all; such copies
    are found by digest and take no further part, so groups of copies of any size cost one aggregation.
    """
    phrase = max(1, window // 2)
    base = checkpointed(sketch(docs, id_col, text_col, window, phrase))
    named = base.where(f"doc_id IS NOT NULL AND n_words >= {window}")
    first = named.groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size")
    copies = named.select("doc_id", "n_words", "d1", "d2").join(first, ["d1", "d2"]).where("doc_id > first").select("doc_id", "n_words")
    seen = named.select("doc_id", "d1", F.explode(F.arrays_zip("phrases", "starts")).alias("e")).select(F.col("e.phrases").alias("phrase"), "doc_id", "d1", F.col("e.starts").alias("start"))
    shared = seen.groupBy("phrase").agg(F.min("d1").alias("a"), F.max("d1").alias("b")).where("a <> b").select("phrase")
    hits = checkpointed(seen.join(shared, "phrase").join(copies.select("doc_id"), "doc_id", "left_anti").select("phrase", "doc_id", "start"))
    total = named.join(hits.select("doc_id").distinct(), "doc_id", "left_semi").agg(F.sum("n_words")).first()[0] or 0
    whole = copies.select("doc_id", F.col("n_words").alias("n_removed"), F.lit("").alias("kept"))
    if not total:
        return base, whole.distinct()
    shards = -(-total // SHARD_WORDS)
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(shards))
    own = hits.select("doc_id").distinct()
    near = maybe_in(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "doc_id", key_bitmap(own, "doc_id"))
    texts = checkpointed(near.join(own, "doc_id", "left_semi").dropDuplicates(["doc_id"]).withColumn("shard", shard))
    # of each phrase one place in every shard that has it: the automaton's words are read there
    seeds = hits.withColumn("shard", shard).groupBy("shard", "phrase").agg(F.min(F.struct("doc_id", "start")).alias("at")).select("shard", "at.doc_id", "at.start")

    def find(texts: pa.Table, seeds: pa.Table) -> pa.Table:
        claim("words", clear_words)
        ids, h1, h2 = [], [], []
        for d, words, inside in located(texts, seeds, window, phrase):
            a, b = windows(words, window)
            both = np.unique(np.stack([a[inside], b[inside]], 1), axis=0)
            ids.append(np.full(len(both), d, np.int64))
            h1.append(both[:, 0])
            h2.append(both[:, 1])
        release()
        join = lambda x: pa.array(np.concatenate(x) if x else np.empty(0, np.int64))
        return pa.table({"doc_id": join(ids), "h1": join(h1), "h2": join(h2)})

    found = checkpointed(texts.groupBy("shard").cogroup(seeds.groupBy("shard")).applyInArrow(find, "doc_id long, h1 long, h2 long"))
    earlier = found.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    late = found.join(earlier, ["h1", "h2"]).where("doc_id > first").select("doc_id", "h1", "h2").withColumn("shard", shard)

    def cut(texts: pa.Table, late: pa.Table) -> pa.Table:
        claim("words", clear_words)
        wanted: dict[int, set] = {}
        for d, a, b in zip(late.column("doc_id").to_pylist(), late.column("h1").to_pylist(), late.column("h2").to_pylist()):
            wanted.setdefault(d, set()).add((a, b))
        ids, removed, kept = [], [], []
        for d, x in zip(texts.column("doc_id").to_pylist(), texts.column("text").cast(pa.binary()).to_pylist()):
            if d in wanted:
                words = x.split()
                a, b = windows(words, window)
                own = wanted[d]
                starts = np.fromiter((i for i, p in enumerate(zip(a.tolist(), b.tolist())) if p in own), np.int64)
                gone = marks(starts, len(words), window)
                ids.append(d)
                removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g]).decode())
        release()
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.string())})

    changed = texts.groupBy("shard").cogroup(late.groupBy("shard")).applyInArrow(cut, "doc_id long, n_removed long, kept string")
    return base, changed.unionByName(whole.distinct())


def deduplicated(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with repeated passages removed; columns unchanged, rows all kept (a text may become empty), n_chars
    brought up to date where there is such a column. Texts that lose nothing stay as they are."""
    _, changes = repeated(docs, window, id_col, text_col)
    changes = checkpointed(changes)
    bitmap = key_bitmap(changes.select("doc_id"), "doc_id")
    names = {c: f"__graphloom_{i}" for i, c in enumerate(docs.columns)}
    touched = maybe_in(docs, id_col, bitmap).withColumnsRenamed(names).join(changes.select(F.col("doc_id").alias("__graphloom_key"), "kept", "n_removed"), F.col(names[id_col]) == F.col("__graphloom_key"), "left")
    gone = F.col("n_removed") > 0
    after = {
        c: F.when(gone, F.col("kept")).otherwise(F.col(n)) if c == text_col else F.when(gone, F.length("kept").cast(docs.schema[c].dataType)).otherwise(F.col(n)) if c == "n_chars" else F.col(n)
        for c, n in names.items()
    }
    return maybe_in(docs, id_col, bitmap, keep=False).unionByName(touched.select(*[x.alias(c) for c, x in after.items()]))
