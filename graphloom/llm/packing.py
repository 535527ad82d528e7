"""Packing: token ids of whole documents laid into sequences of a fixed length, balanced by attention cost."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import mapped, raw_texts
from graphloom.llm.tokens import chunk_cache, groups

#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n (projections grow with n, attention with its square).
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: Tokens that a task gathers before it packs them: 8 MB of ids. Only the last sequence of such a shard can be padded.
SHARD_TOKENS = 1 << 21


def assign(lengths: list[int], capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset). What a document has beyond full sequences goes, in descending
    order of cost, to the sequence of the lowest cost so far whose remaining capacity takes it; only where none does, the
    cheapest is filled and the rest goes on. There are as few sequences as the tokens need, so all but the last are full."""
    out, rest, sequence = [], [], 0
    for d, n in enumerate(lengths):
        full = n // capacity
        for k in range(full):
            out.append((d, k * capacity, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            rest.append((n % capacity, d, full * capacity))
    total = sum(n for n, _, _ in rest)
    if not total:
        return out
    bins = -(-total // capacity)
    room = [capacity] * (bins - 1) + [total - capacity * (bins - 1)]
    used = [0] * bins
    cost = lambda n: linear * n + quadratic * n * n
    # the sequences of each remaining capacity, cheapest first, and a tree over capacities with the cheapest of each range
    heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
    for k, r in enumerate(room):
        heaps[r].append((0.0, k))
    width = 1 << capacity.bit_length()
    none = (float("inf"), -1)
    tree = [none] * (2 * width)

    def update(r: int) -> None:
        i = r + width
        tree[i] = heaps[r][0] if heaps[r] else none
        while i > 1:
            i >>= 1
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def cheapest(least: int) -> tuple[float, int]:
        i = least + width
        best = tree[i]
        while i > 1:
            if not i & 1:
                best = min(best, tree[i + 1])
            i >>= 1
        return best

    for r in {capacity, room[-1]}:
        update(r)
    for n, d, start in sorted(rest, key=lambda r: (-r[0], r[1])):
        while n:
            spent, k = cheapest(n)
            if k < 0:
                spent, k = cheapest(1)
            r = room[k]
            heapq.heappop(heaps[r])
            update(r)
            take = min(n, r)
            out.append((d, start, take, sequence + k, used[k]))
            used[k] += take
            room[k] -= take
            n -= take
            start += take
            if room[k]:
                heapq.heappush(heaps[room[k]], (spent + cost(take), k))
                update(room[k])
    return out


def pack(
    docs: DataFrame, path: str, capacity: int = 4096, end_id: int | None = 2, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces: id, start (the document's ids before it), length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset (in the sequence; gapless from 0). Each id of each text, then end_id, lies in exactly one piece.

    Each task packs the documents of its own partition, a shard of about `shard_tokens` at a time; nothing is shuffled
    and no sequence is shared by tasks, so a lost task is redone alone. A null or empty text has only end_id (nothing
    and no row without end_id); repeated rows and null ids are packed like any other; a text longer than a shard is cut
    like any other. An empty table gives no rows. Other columns aren't read.
    """
    end = b"" if end_id is None else np.asarray([end_id], "<u4").tobytes()
    names = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = chunk_cache(path, True)
        first = TaskContext.get().partitionId() << 36
        keys, ids, held = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal first
            found = assign([len(x) // 4 for x in ids], capacity)
            for i in range(0, len(found), 512):
                part = found[i : i + 512]
                doc, start, length, seq, offset = zip(*part)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([keys[d] for d in doc], kind),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array([ids[d][4 * s : 4 * (s + n)] for d, s, n in zip(doc, start, length)], pa.binary()),
                        pa.array([len(ids[d]) // 4 for d in doc], pa.int64()),
                        pa.array([first + s for s in seq], pa.int64()),
                        pa.array(offset, pa.int64()),
                    ],
                    names=names,
                )
            first += 1 + max((s for _, _, _, s, _ in found), default=-1)

        kind = pa.int64()
        for b in batches:
            kind = b.schema.field(0).type
            at, own = 0, b.column(0).to_pylist()
            for part in groups(raw_texts(b, "text")):
                flat, bounds = cache.texts(part)
                for i, j in pairwise(bounds.tolist()):
                    x = flat[i:j].tobytes() + end
                    keys.append(own[at])
                    ids.append(x)
                    at += 1
                    held += len(x) // 4
                if held >= shard_tokens:
                    yield from flush()
                    keys, ids, held = [], [], 0
        if ids:
            yield from flush()

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return mapped(docs.select(F.col(id_col), F.col(text_col).alias("text")), run, schema)
