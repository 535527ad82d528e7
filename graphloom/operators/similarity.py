"""Vector operators over rows (s, v): k-NN searches, k-NN graphs, near pairs, relevance feedback."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.terms import cosine_distance, dot_distance

#: Vectors of a block at most, and those up to which there are no more blocks than BLOCKS: two blocks meet in one group.
BLOCK, BLOCKS, LEAST = 16384, 12, 1024
#: Rows of a block whose products with another block are held at once; pairs compared or given out at once; columns from
#: which a row's first bound comes; pairs that wait to be thinned out.
ROWS, PIECE, SOME, MOST = 1024, 1 << 18, 2048, 1 << 22


def search(vectors: DataFrame, query: list[float], k: int, distance: str = "cosine", farthest: bool = False) -> DataFrame:
    """The k nearest (or farthest) vectors of the query's length: s, distance; ties to the smaller s."""
    q = F.array(*[F.lit(float(x)) for x in query])
    d = (cosine_distance if distance == "cosine" else dot_distance)(F.col("v"), q)
    near = vectors.where(F.size("v") == len(query)).select("s", d.alias("distance"))
    return near.orderBy(F.desc("distance") if farthest else F.asc("distance"), "s").limit(k)


class _Vectors:
    """Vectors of one length: names, components by dimension, norms, and unit rows in single precision. Rows of norms that are
    no numbers, nearly zero or huge are bad: single precision says nothing about them."""

    def __init__(self, t: pa.Table):
        self.names = t.column("s").combine_chunks()
        rows = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(self.names), -1)
        self.parts = np.ascontiguousarray(rows.T)
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            square = np.zeros(len(rows))
            for x in self.parts:
                square += x * x
            self.norm = np.sqrt(square)
            self.bad = ~((self.norm >= 1e-3) & (self.norm <= 1e150))
            self.unit = np.where(self.bad[:, None], 0.0, rows / self.norm[:, None]).astype(np.float32)


def _distances(a: _Vectors, b: _Vectors, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosine distances of pairs, summed by dimension so that equal vectors have equal distances; 1 where the product of the
    norms is almost zero."""
    out = np.empty(len(i))
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        for at in range(0, len(i), PIECE):
            x, y = i[at : at + PIECE], j[at : at + PIECE]
            dot = np.zeros(len(x))
            for p, q in zip(a.parts, b.parts):
                dot += p[x] * q[y]
            norm = a.norm[x] * b.norm[y]
            d = 1 - dot / norm
            out[at : at + PIECE] = np.where((norm < 1e-6) | ~np.isfinite(d), 1.0, d)
    return out


def _rough(a: _Vectors, b: _Vectors, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of some rows of a and their cosines with all of b in single precision; 9 for bad rows, -9 for a name with itself."""
    if same:
        known = pa.compute.dictionary_encode(a.names).indices.to_numpy(zero_copy_only=False)
        order = np.argsort(known, kind="stable")
        first = np.searchsorted(known[order], known, "left")
        count = np.searchsorted(known[order], known, "right") - first
    for at in range(0, len(a.names), ROWS):
        rows = np.arange(at, min(at + ROWS, len(a.names)))
        c = a.unit[rows] @ b.unit.T
        c[:, b.bad] = 9
        c[a.bad[rows]] = 9
        if same:
            i = np.repeat(np.arange(len(rows)), count[rows])
            within = np.arange(len(i)) - np.repeat(np.cumsum(count[rows]) - count[rows], count[rows])
            c[i, order[np.repeat(first[rows], count[rows]) + within]] = -9
        yield rows, c


def _slack(dim: int) -> float:
    """What a cosine in single precision may be off."""
    return 1e-6 + 2.5e-7 * dim


def _found(a: _Vectors, b: _Vectors, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(i), PIECE):
        x, y = pa.array(i[at : at + PIECE]), pa.array(j[at : at + PIECE])
        yield pa.RecordBatch.from_arrays([a.names.take(x), b.names.take(y), pa.array(d[at : at + PIECE])], ["s", "o", "distance"])


def _met(vectors: DataFrame, pick: Callable[[_Vectors, _Vectors, bool], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Every two blocks of vectors of one length meet once, and every block itself, each in a group of its own; pick(a, b, same)
    gives the pairs of both directions. A group holds two blocks and the products of a few rows."""
    rows = vectors.where(F.col("v").isNotNull() & (F.size("v") > 0)).select(F.col("s"), F.col("v").cast("array<double>").alias("v"), F.size("v").alias("dim"))
    n = rows.count()
    count = max(1, -(-n // BLOCK), min(BLOCKS, -(-n // LEAST)))
    own = F.pmod(F.xxhash64("s"), F.lit(count))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    sent = rows.withColumn("own", own).withColumn("other", each).select("s", "v", "dim", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") <= F.col("other")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        a = _Vectors(t.filter(t.column("first")))
        if t.column("a")[0] == t.column("b")[0]:
            yield from pick(a, a, True)
        elif 0 < len(a.names) < t.num_rows:
            yield from pick(a, _Vectors(t.filter(pa.compute.invert(t.column("first")))), False)

    return sent.groupBy("a", "b", "dim").applyInArrow(run, "s string, o string, distance double")


def _nearest(k: int, names: pa.Array, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs of each i the k nearest; ties to the smaller name."""
    order = np.lexsort((d, i))
    i, j, d = i[order], j[order], d[order]
    # names decide only between pairs that are as far as the k-th: most often there are none beyond it
    start = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, int)
    length = np.diff(np.r_[start, len(i)])
    kth = d[start + np.minimum(length, k) - 1]
    keep = d <= np.repeat(kth, length)
    i, j, d = i[keep], j[keep], d[keep]
    text = names.take(pa.array(j))
    by_name = pa.compute.rank(text, tiebreaker="dense").to_numpy(zero_copy_only=False)
    order = np.lexsort((by_name, pa.compute.utf8_length(text).to_numpy(zero_copy_only=False), d, i))
    i, j, d = i[order], j[order], d[order]
    start = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, int)
    place = np.arange(len(i)) - np.repeat(start, np.diff(np.r_[start, len(i)]))
    return i[place < k], j[place < k], d[place < k]


def _best(c: np.ndarray, clean: np.ndarray, k: int) -> np.ndarray:
    """Of each row a bound that its k-th largest cosine reaches, from some columns of rows that aren't bad."""
    if len(clean) < k:
        return np.full(len(c), -8, np.float32)
    some = c[:, clean]
    return np.partition(some, len(clean) - k, axis=1)[:, len(clean) - k]


def knn_graph(vectors: DataFrame, k: int) -> DataFrame:
    """s, o, rank, distance: for every vector its k nearest others of its length; ties to the smaller o (the shorter, then by
    its letters, so that keys order as numbers). Single precision leaves out what is surely farther than the k-th; what it
    leaves is compared exactly."""

    def pick(a: _Vectors, b: _Vectors, same: bool) -> Iterator[pa.RecordBatch]:
        off = 2 * _slack(len(a.parts))
        clean_b = np.flatnonzero(~b.bad)[: max(SOME, 4 * k)]
        kept: list = []
        bound = held = None
        for rows, c in _rough(a, b, same):
            low = np.where(a.bad[rows], -8, _best(c, clean_b, k)) - off
            i, j = np.nonzero((c >= np.maximum(low, -8)[:, None]))
            yield from _found(a, b, *_nearest(k, b.names, rows[i], j, _distances(a, b, rows[i], j)))
            if same:
                continue
            if bound is None:
                bound = np.maximum(np.where(b.bad, -8, _best(np.ascontiguousarray(c.T), np.flatnonzero(~a.bad[rows]), k)) - off, -8)
            i, j = np.nonzero(c >= bound)
            kept.append((j, rows[i], _distances(a, b, rows[i], j)))
            held = sum(len(x[0]) for x in kept)
            if held > MOST + k * len(b.names):
                kept = [_nearest(k, a.names, *map(np.concatenate, zip(*kept)))]
        if kept:
            yield from _found(b, a, *_nearest(k, a.names, *map(np.concatenate, zip(*kept))))

    rank = F.row_number().over(Window.partitionBy("s").orderBy("distance", F.length("o"), "o"))
    return _met(vectors, pick).withColumn("rank", rank).where(F.col("rank") <= k).select("s", "o", "rank", "distance")


def near_pairs(vectors: DataFrame, most: float) -> DataFrame:
    """s, o, distance: both directions of every pair of different vectors nearer than `most`. Single precision leaves out what
    surely isn't."""

    def pick(a: _Vectors, b: _Vectors, same: bool) -> Iterator[pa.RecordBatch]:
        low = max(1 - most - _slack(len(a.parts)), -8)
        for rows, c in _rough(a, b, same):
            i, j = np.nonzero(c > low)
            i = rows[i]
            d = _distances(a, b, i, j)
            i, j, d = i[d < most], j[d < most], d[d < most]
            yield from _found(a, b, i, j, d)
            if not same:
                yield from _found(b, a, j, i, d)

    return _met(vectors, pick)


def feedback(vectors: DataFrame, positives: list[list[float]], negatives: list[list[float]], k: int, c: float = 1.0) -> DataFrame:
    """The k vectors with the largest product with the normal of a linear classifier of the examples: s, score."""
    x = np.array(positives + negatives, float)
    y = np.array([1.0] * len(positives) + [-1.0] * len(negatives))
    # dual coordinate descent of the linear support vector machine with hinge loss
    x1 = np.column_stack([x, np.ones(len(x))])
    alpha, w = np.zeros(len(x)), np.zeros(x1.shape[1])
    square = (x1 * x1).sum(1)
    for _ in range(1000):
        moved = 0.0
        for i in range(len(x)):
            old = alpha[i]
            alpha[i] = min(c, max(0.0, old - (y[i] * (w @ x1[i]) - 1) / max(square[i], 1e-12)))
            w += (alpha[i] - old) * y[i] * x1[i]
            moved = max(moved, abs(alpha[i] - old))
        if moved < 1e-6:
            break
    q = F.array(*[F.lit(float(v)) for v in w[:-1]])
    return vectors.where(F.size("v") == x.shape[1]).select("s", (-dot_distance(F.col("v"), q)).alias("score")).orderBy(F.desc("score"), "s").limit(k)
