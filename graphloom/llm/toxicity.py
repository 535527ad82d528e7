"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

The examples are a bounded sample of labelled rows outside the held-out fold, each with its own label and id. Terms are
all words and word beginnings that two examples or more hold; their document frequencies are counted over all documents,
and what the sample's labels mark as typical of toxic texts weighs more (supervised TF-IDF; every term keeps at least its
plain weight). Each worker holds the examples as an inverted index: postings of the rarer terms are added up text by text,
common terms are multiplied for many texts at once, always with all examples, so the neighbours are exact. Distance-weighted
votes are calibrated on the examples themselves, each left out of its own vote.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import checkpointed, claim, mapped, raw_texts
from graphloom.llm.tokens import groups

#: Labelled rows at most that are learned from: those of the smallest hash of the id.
SAMPLE = 4_096
#: Examples that must hold a term, so that it can bring two of them together.
LEAST_EXAMPLES = 2
#: A term whose frequency in toxic examples exceeds its overall rate by z > PLAIN_Z standard deviations weighs 1 + z - PLAIN_Z times as much.
PLAIN_Z = 4.0
#: Neighbours that vote; texts that are compared at once; share of the examples from which a term is common.
NEIGHBOURS, TOGETHER, COMMON, FOLDS = 24, 64, 1 / 16, 5
BEGINNINGS = (5,)
#: Letters of a word that is looked up by its hash; bytes of texts whose words are looked up at once.
LONGEST, GROUP_BYTES = 32, 1 << 18
_word = regex.compile(r"\p{L}+")


def terms_of(chunk: bytes) -> list[str]:
    """Terms of a white-space chunk: its lower-cased words, and their beginnings marked by ~."""
    out = []
    for w in _word.findall(chunk.decode().lower()):
        out.append(w)
        out += [f"{w[:n]}~" for n in BEGINNINGS if len(w) > n]
    return out


@cache
def _letters() -> np.ndarray:
    """Which code points _word takes."""
    table = np.zeros(0x110000, bool)
    for w in _word.finditer("".join(map(chr, range(len(table))))):
        table[w.start() : w.end()] = True
    return table


class _Words:
    """Term numbers of all words of many texts at once.

    A word's hash is the sum of its letters' random 64-bit numbers times powers of an odd number, read off running sums over
    the texts; a word beginning has the same sum of its letters and another salt. Terms have different hashes (else they are
    drawn again); a word that is no term is taken for one with a chance of about 1e-14. Words of more than LONGEST letters
    are looked up as they stand.
    """

    def __init__(self, terms: dict[str, int]):
        self.terms = terms
        self.power = self.inverse = np.ones(1, np.uint64)
        rng, short = np.random.default_rng(7), [t for t in terms if len(t) <= LONGEST]
        number = np.fromiter(map(terms.__getitem__, short), np.int32, len(short))
        begins = np.fromiter((t[-1] == "~" for t in short), bool, len(short))
        texts = [t.rstrip("~") for t in short]
        bits = max(10, (4 * len(short)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        while True:
            self.value = np.where(_letters(), rng.integers(1, 1 << 63, len(_letters()), np.uint64) * np.uint64(2) + np.uint64(1), np.uint64(0))
            self.salt = rng.integers(1, 1 << 63, max(LONGEST, *BEGINNINGS) + 2, np.uint64)
            _, starts, ends, sums = self._words(texts)
            length = ends - starts
            h = np.where(begins, self._hash(sums, starts, ends, 0), self._hash(sums, starts, ends, length))
            if len(np.unique(h)) == len(h):
                break
        self.keys, self.numbers = np.zeros(self.mask + 1, np.uint64), np.full(self.mask + 1, -1, np.int32)
        at = self._slot(h)
        while len(h):  # linear probing, one step of all that have no slot yet at a time
            free = np.flatnonzero(self.numbers[at] < 0)
            own = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[own]], self.numbers[at[own]] = h[own], number[own]
            rest = np.ones(len(h), bool)
            rest[own] = False
            h, number, at = h[rest], number[rest], (at[rest] + 1) & self.mask

    def _words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The code points of lower-cased texts, each after a line end; where words start and end; the running sums."""
        points = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le"), "<u4")
        if len(points) > len(self.power):
            n, odd = 1 << len(points).bit_length(), 0x9E3779B97F4A7C15
            step = np.ones((2, n), np.uint64)
            step[0, 1:], step[1, 1:] = odd, pow(odd, -1, 1 << 64)
            self.power, self.inverse = np.cumprod(step, axis=1, dtype=np.uint64)
        values = self.value[points]
        letter = values != 0
        edges = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        return points, edges[::2], edges[1::2], np.cumsum(values * self.power[: len(points)], dtype=np.uint64)

    def _hash(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
        return (sums[ends - 1] - sums[starts - 1]) * self.inverse[starts] + self.salt[salt]

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0xD6E8FEB86659FD93)) >> self.shift).astype(np.int64)

    def _numbers(self, h: np.ndarray) -> np.ndarray:
        """The term number of each hash, -1 where it has none."""
        at = self._slot(h)
        out, same = self.numbers[at], self.keys[at] == h
        todo = np.flatnonzero(~same & (out >= 0))
        out[~same] = -1
        at = at[todo]
        while len(todo):
            at = (at + 1) & self.mask
            found, same = self.numbers[at], self.keys[at] == h[todo]
            out[todo[same & (found >= 0)]] = found[same & (found >= 0)]
            more = ~same & (found >= 0)
            todo, at = todo[more], at[more]
        return out

    def counts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all texts, one after another: where the terms of each start (and the last end), the terms of each, ascending,
        and how often it has them."""
        lower = [x.decode().lower() for x in texts]
        points, starts, ends, sums = self._words(lower)
        text = np.repeat(np.arange(len(lower)), np.diff(np.searchsorted(starts, np.cumsum([1, *(len(x) + 1 for x in lower)]))))
        length = ends - starts
        t = self._numbers(self._hash(sums, starts, ends, np.minimum(length, LONGEST + 1)))
        for i in np.flatnonzero(length > LONGEST).tolist():
            t[i] = self.terms.get(points[starts[i] : ends[i]].tobytes().decode("utf-32-le"), -1)
        size = max(1, len(self.terms))
        found = [text[t >= 0] * size + t[t >= 0]]
        for n in BEGINNINGS:
            long = np.flatnonzero(length > n)
            t = self._numbers(self._hash(sums, starts[long], starts[long] + n, 0))
            found.append(text[long[t >= 0]] * size + t[t >= 0])
        keys = np.concatenate(found)
        keys.sort()
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        return np.searchsorted(keys[first], np.arange(len(lower) + 1) * size), keys[first] % size, np.diff(first, append=len(keys))


@dataclass
class Model:
    """Terms, their weights, the index of the examples and the calibration."""

    terms: dict[str, int]
    weight: np.ndarray
    index: Index | None = None
    labels: np.ndarray = field(default_factory=lambda: np.zeros(0))
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    base: float = 0.0
    curve: tuple[np.ndarray, np.ndarray] = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    _words: _Words | None = None
    _known: dict[bytes, tuple[float, np.ndarray, np.ndarray]] = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"_words": None, "_known": {}}

    def forget(self) -> None:
        """Clears the caches."""
        self._words, self._known = None, {}

    def counts(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """_Words.counts of runs of whole texts."""
        if self._words is None:
            self._words = _Words(self.terms)
        return map(self._words.counts, groups(texts, GROUP_BYTES))

    def vectors(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The unit TF-IDF vector of each whole text; empty where it has none of the terms."""
        for starts, terms, n in self.counts(texts):
            weights = (1 + np.log(n)) * self.weight[terms]
            for i, j in pairwise(starts.tolist()):
                w = weights[i:j]
                yield terms[i:j], w / np.sqrt(w @ w) if j > i else w

    def votes(self, vectors: list[tuple[np.ndarray, np.ndarray]], but: list[int] | None = None) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """For each vector the share of toxic among the nearest examples, weighted by closeness, and those examples with
        their cosines. `but` has for each vector the id of an example that has no vote."""
        found = self.index.nearest_all(vectors, NEIGHBOURS + (but is not None)) if self.index else [(np.zeros(0, np.int64), np.zeros(0))] * len(vectors)
        for i, (near, cosine) in enumerate(found):
            if but is not None:
                other = self.ids[near] != but[i]
                near, cosine = near[other][:NEIGHBOURS], cosine[other][:NEIGHBOURS]
            closeness = 1 / (1.05 - cosine)
            yield float((closeness @ self.labels[near] + self.base) / (closeness.sum() + 1)) if len(near) else self.base, near, cosine

    def scores(self, texts: list[bytes]) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """Calibrated score and evidence (example ids, cosines) of each text."""
        keys, fresh = [], {}
        for t, w in self.vectors(texts):
            keys.append(xxhash.xxh3_128_digest(t.tobytes() + w.tobytes()) if len(t) else b"")
            if len(t) and keys[-1] not in self._known:  # copies of a text come in large groups
                fresh[keys[-1]] = t, w
        if len(self._known) + len(fresh) > 4096:
            self._known = {k: self._known[k] for k in set(keys) & self._known.keys()}
        for key, (v, near, cosine) in zip(fresh, self.votes(list(fresh.values()))):
            self._known[key] = (float(np.interp(v, *self.curve)), self.ids[near], cosine)
        blank = self.base, np.zeros(0, np.int64), np.zeros(0)
        return (self._known[k] if k else blank for k in keys)


class Index:
    """Postings by term. Those of rare terms are kept as pairs of example and weight, 32 bits each; a common term has the
    weights of all examples side by side."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, weights: np.ndarray, size: int):
        """Examples as unit vectors: example i has terms[starts[i]:starts[i + 1]] and their weights; `size` terms in all."""
        self.size = n = len(starts) - 1
        row, weights = np.repeat(np.arange(n), np.diff(starts)), weights.astype(np.float32)
        often = np.bincount(terms, minlength=size)
        common = np.flatnonzero(often > max(64, COMMON * n))
        self.common = np.full(size, -1, np.int32)
        self.common[common] = np.arange(len(common))
        c = self.common[terms]
        self.dense = np.zeros((len(common), n), np.float32)
        self.dense[c[c >= 0], row[c >= 0]] = weights[c >= 0]
        rare = np.flatnonzero(c < 0)
        rare = rare[np.lexsort((row[rare], terms[rare]))]
        self.postings = np.column_stack([row[rare].astype(np.int32), weights[rare].view(np.int32)]).view(np.int64).ravel()
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(terms[rare], minlength=size))])

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the largest positive cosine (ties: smaller number), exact, and those cosines."""
        return self.nearest_all([(terms, weights)], k)[0]

    def nearest_all(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """`nearest` of many vectors."""
        out: list = [None] * len(vectors)
        # vectors whose strongest common term is the same are multiplied together (texts of one language, mostly): they share terms
        split = []
        for terms, weights in vectors:
            c = self.common[terms]
            split.append((terms[c < 0], weights[c < 0], c[c >= 0], weights[c >= 0]))
        order = sorted(range(len(vectors)), key=lambda i: split[i][2][split[i][3].argmax()] if len(split[i][2]) else -1)
        for i in range(0, len(order), TOGETHER):
            own = order[i : i + TOGETHER]
            used, column = np.unique(np.concatenate([split[j][2] for j in own]), return_inverse=True)
            queries = np.zeros((len(own), len(used)), np.float32)
            queries[np.repeat(np.arange(len(own)), [len(split[j][2]) for j in own]), column] = np.concatenate([split[j][3] for j in own])
            for j, sums in zip(own, queries @ self.dense[used]):
                out[j] = self._best(*split[j], sums, k)
        return out

    def _best(self, rare: np.ndarray, impacts: np.ndarray, often: np.ndarray, weights: np.ndarray, sums: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest of one vector, whose products with common terms are in `sums` in single precision: that chooses with
        a margin what double precision then compares."""
        first = self.starts[rare]
        length = self.starts[rare + 1] - first
        ends = np.cumsum(length)
        found = self.postings.take(np.repeat(first - (ends - length), length) + np.arange(int(length.sum()))).view(np.int32)
        base = np.bincount(found[::2], found.view(np.float32)[1::2] * np.repeat(impacts, length), minlength=self.size)
        made = base + sums
        least = np.partition(made, self.size - k)[self.size - k] if self.size > k else 0.0
        i = np.flatnonzero((made > 0) & (made >= least - 2e-5))
        score = base[i] + weights @ self.dense.take(often.astype(np.int64)[:, None] * self.size + i).astype(np.float64)
        top = np.lexsort((i, -score))[:k]
        return i[top], score[top]


def _term_counts(sample: DataFrame) -> pa.Table:
    """term, a (toxic examples that hold it), t (examples that do): those of two examples or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for b in batches:
            for x, y in zip(raw_texts(b, "text"), b.column("toxic").to_pylist()):
                counts[y].update({t for c in set(x.split()) for t in terms_of(c)})
            if sum(map(len, counts)) > 500_000:
                yield from out(counts)
                counts = (Counter(), Counter())
        yield from out(counts)

    def out(counts):
        for y, c in enumerate(counts):
            names, values = list(c), list(c.values())
            for i in range(0, len(names), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(names[i : i + 50_000]), pa.array([y] * len(names[i : i + 50_000]), pa.int32()), pa.array(values[i : i + 50_000], pa.int64())], names=["term", "toxic", "n"])

    found = mapped(sample, run, "term string, toxic int, n long")
    both = found.groupBy("term").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum("n").alias("t"))
    return both.where(F.col("t") >= LEAST_EXAMPLES).toArrow().sort_by("term")


def _frequencies(docs: DataFrame, text_col: str, model: Model) -> tuple[int, np.ndarray]:
    """Documents, and of them those that hold each term, over all documents. A task gives one row for each term that it
    met, as a word count does."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        claim("toxicity", m.forget)
        df = np.zeros(len(m.terms) + 1, np.int64)
        for b in batches:
            df[-1] += b.num_rows
            for _, terms, _ in m.counts(raw_texts(b, "text")):
                df[:-1] += np.bincount(terms, minlength=len(m.terms))
        t = np.flatnonzero(df)
        for i in range(0, len(t), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(t[i : i + 100_000]), pa.array(df[t[i : i + 100_000]])], names=["term", "n"])

    total = np.zeros(len(model.terms) + 1, np.int64)
    found = mapped(docs.select(F.col(text_col).alias("text")), run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    total[found.column("term").to_numpy()] = found.column("n").to_numpy()
    shared.destroy()
    return int(total[-1]), total[:-1]


def _isotonic(v: np.ndarray, y: np.ndarray, base: float) -> tuple[np.ndarray, np.ndarray]:
    """A non-decreasing curve from votes to the share of toxic examples (pool adjacent violators, smoothed to the base rate)."""
    order = np.argsort(v, kind="stable")
    pools: list[list[float]] = []  # sum of labels, count, sum of votes
    for i in order:
        pools.append([float(y[i]), 1.0, float(v[i])])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            a = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], a)]
    at = [p[2] / p[1] for p in pools]
    to = [(p[0] + base) / (p[1] + 1) for p in pools]
    # a slight slope keeps the order of votes within a pool
    return np.array([0.0, *at, 1.0]), np.clip(np.maximum.accumulate([min(base, to[0]) * 0.5 if to else 0.0, *to, max([*to, 0.0])]), 0, 1)


def in_fold(id_col: str):
    """Whether a row is held out: crc32 of its id as text is divisible by FOLDS. A null id isn't."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """A model from at most `sample` labelled documents that aren't held out.

    Labels that are null, or of no document, or of a null id aren't used; an id with several labels counts as toxic if one
    says so; of rows that share an id one is used (the first text in order, null last). Ids must be whole numbers or cast
    to such: others are left out. With no usable label of either kind (an empty table, too) the model scores every text by
    the base rate (0.0 without labels). Other columns, whatever their names, aren't read.
    """
    number = F.col(id_col).try_cast("long")
    chosen = (
        labels.where(F.col("toxic").isin(0, 1) & number.isNotNull() & ~in_fold(id_col))
        .groupBy(number.alias("doc_id"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    # at most `sample` rows of two numbers: broadcast; the texts of these rows are kept, so that the table is read once
    found = docs.select(number.alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = checkpointed(found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))
    n = {0: 0, 1: 0} | {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not n[0] or not n[1]:
        return Model({}, np.zeros(0), base=float(bool(n[1])))
    p = n[1] / (n[0] + n[1])
    terms = _term_counts(rows)
    a, t = terms.column("a").to_numpy(), terms.column("t").to_numpy()
    model = Model(dict(zip(terms.column("term").to_pylist(), range(terms.num_rows))), np.zeros(0))
    count, df = _frequencies(docs, text_col, model)
    z = (a - t * p) / np.sqrt(t * p * (1 - p) + 1)
    model.weight = (np.log((1 + count) / (1 + df)) + 1) * (1 + np.maximum(0.0, z - PLAIN_Z))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        claim("toxicity", m.forget)
        for b in batches:
            made = list(m.vectors(raw_texts(b, "text")))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(t) for t, _ in made])]).astype(np.int32))
            flat = lambda k, kind: pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([x[k] for x in made] or [np.zeros(0)]).astype(kind)))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), flat(0, np.int32), flat(1, np.float64)], names=["doc_id", "toxic", "terms", "weights"])

    made = mapped(rows.select("doc_id", "toxic", "text"), vectors, "doc_id long, toxic int, terms array<int>, weights array<double>").toArrow().sort_by("doc_id").combine_chunks()
    lengths = made.column("terms").combine_chunks().value_lengths().to_numpy()
    labels_, ids = made.column("toxic").to_numpy(), made.column("doc_id").to_numpy()
    # examples without any term stand for the texts without any
    blank = lengths == 0
    model.base = float((labels_[blank].sum() + p) / (blank.sum() + 1))
    starts = np.concatenate([[0], np.cumsum(lengths[~blank])])
    model.index = Index(starts, made.column("terms").combine_chunks().flatten().to_numpy(), made.column("weights").combine_chunks().flatten().to_numpy(), len(model.terms))
    model.labels, model.ids = labels_[~blank].astype(float), ids[~blank]
    shared.destroy()
    if len(model.ids):
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = shared.value
            claim("toxicity", m.forget)
            for b in batches:
                own = [(*x, i) for x, i in zip(m.vectors(raw_texts(b, "text")), b.column(0).to_pylist())]
                votes = m.votes([(t, w) for t, w, _ in own], but=[i for _, _, i in own])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v if len(t) else None for (v, _, _), (t, _, _) in zip(votes, own)], pa.float64())], names=["doc_id", "vote"])

        voted = mapped(rows.select("doc_id", "text"), left_out, "doc_id long, vote double").where("vote IS NOT NULL").toArrow().sort_by("doc_id")
        model.curve = _isotonic(voted.column("vote").to_numpy(), model.labels, model.base)
        shared.destroy()
    return model


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows with toxicity (score from 0 to 1) and toxicity_evidence (nearest examples: id, cosine) added; no shuffle.

    Whole texts; a text that is null, empty or without any term has the base rate of such examples and no evidence. Rows
    are independent: repeated rows get equal scores, an empty table stays empty; among examples of equal cosine the
    smaller id is nearer. Columns of these two names are replaced, all others pass through, whatever their names.
    """
    columns = [c for c in docs.columns if c not in ("toxicity", "toxicity_evidence")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        claim("toxicity", m.forget)
        for b in batches:
            made = list(m.scores(raw_texts(b, text_col)))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(i) for _, i, _ in made])]).astype(np.int32))
            flat = lambda k, kind: pa.array(np.concatenate([x[k] for x in made] or [np.zeros(0)]).astype(kind))  # noqa: E731, B023
            evidence = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([flat(1, np.int64), flat(2, np.float64)], ["doc_id", "cosine"]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([s for s, _, _ in made], pa.float64()), evidence], names=[*columns, "toxicity", "toxicity_evidence"])

    schema = T.StructType([*[docs.schema[c] for c in columns], T.StructField("toxicity", T.DoubleType()), T.StructField("toxicity_evidence", T.ArrayType(T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("cosine", T.DoubleType())])))])
    return mapped(docs.select(*[F.col(f"`{c}`") for c in columns]), run, schema)


def fold(doc_id: int) -> bool:
    """in_fold for one id."""
    return zlib.crc32(str(doc_id).encode()) % FOLDS == 0
