"""Token counts: a public tokenizer's lengths (and ids) of whole texts, in Arrow batches.

No token of the tokenizer spans white space and its normaliser never joins across it, so a text splits safely at
ASCII white space. Each worker encodes a distinct chunk once while its cache holds it, in batches of about equal bytes.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import CACHE_WORDS, claim, mapped, raw_texts
from graphloom.llm.merges import PAIRS, Merges

#: Bytes of a batch of chunks that the library encodes at once.
BATCH_BYTES = 1 << 18

_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """This worker's tokenizer; one thread, since the cluster's tasks are the parallelism."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _loaded[path] = t
    return _loaded[path]


def balanced(chunks: Iterable[bytes], most: int = BATCH_BYTES) -> Iterator[list[bytes]]:
    """Batches of at most about `most` bytes; a longer chunk is a batch alone."""
    batch: list[bytes] = []
    total = 0
    for c in chunks:
        if batch and total + len(c) > most:
            yield batch
            batch, total = [], 0
        batch.append(c)
        total += len(c)
    if batch:
        yield batch


#: ASCII marks that end many words; none of them is an apostrophe, so no contraction depends on them.
TAIL = b".,;:?!*&$#%|"
_TAILS = {bytes([x]) for x in TAIL}
_ALNUM = np.array([bytes([x]).isalnum() for x in range(256)])


def lowered(text: bytes) -> bytes:
    """A text with ASCII capitals lowered where that can't change the tokens: not beside special strings, which are matched
    as they stand, nor combining marks, which may compose with one case only."""
    return text if b"<|" in text or b"\xcc" in text or b"\xcd" in text else text.lower()


def chunks_of(text: bytes) -> list[bytes]:
    """The ASCII-white-space chunks of a text, lowered."""
    return lowered(text).split()


def cut_tail(chunk: bytes) -> int:
    """Where a chunk's closing marks begin if its tokens are those of the part before and of the marks, else 0."""
    core = chunk.rstrip(TAIL)
    n = len(core)
    if not n or n == len(chunk):
        return 0
    if core[-1] < 128:
        return n if core[-1:].isalnum() else 0
    return n if core.decode()[-1].isalpha() else 0


def without_tails(chunks: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Chunks without the closing marks that cut_tail cuts off, those marks, and which chunks have some. Marks after a letter
    that isn't in merges.PAIRS stay."""
    flat = lambda x: (np.frombuffer(x.buffers()[1], np.int32)[x.offset :][: len(x) + 1], np.frombuffer(x.buffers()[2] or b"", np.uint8))
    core = pc.ascii_rtrim(chunks, characters=TAIL.decode())
    (at, whole), (ends, data) = flat(chunks), flat(core)
    size, n = np.diff(at), np.diff(ends)
    has = (n > 0) & (n < size)
    i = ends[1:][has] - 1
    last = data[i]
    has[has] = _ALNUM[last] | ((n[has] > 1) & (PAIRS[data[np.maximum(i, 1) - 1].astype(np.uint16) << 8 | last] > 0))
    start, length = at[:-1][has] + n[has], (size - n)[has]
    ends = np.cumsum(length)
    marks = whole[np.repeat(start - (ends - length), length) + np.arange(int(length.sum()))]
    tails = pa.Array.from_buffers(pa.string(), len(length), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(marks)])
    return pc.if_else(pa.array(has), core, chunks), tails, has


class ChunkCache:
    """What the tokenizer makes of each chunk: its number of tokens, or its ids as little-endian 32-bit words. For ids, new
    words of plain letters are merged together, which is many times faster than the library word by word."""

    def __init__(self, path: str, ids: bool):
        self.path, self.ids, self.known = path, ids, {}
        self.merges = Merges(path) if ids else None

    def learn(self, chunks: Iterable[bytes]) -> dict[bytes, object]:
        """The cache, holding all of these chunks."""
        known, chunks = self.known, set(chunks)
        new = chunks.difference(known)
        if len(known) + len(new) > CACHE_WORDS and known:
            known.clear()
            new = chunks
        parts, later = {c for c in new if c.isalpha()}, []
        for c in new - parts:
            n = c[-1:] in _TAILS and cut_tail(c)
            if n:
                later.append((c, c[:n], c[n:]))
                parts.update(later[-1][1:])
            else:
                parts.add(c)
        fresh: Iterable[bytes] = parts.difference(known)
        if self.merges:
            words, ids, fresh = self.merges.known(list(fresh))
            known.update(zip(words, ids))
        known.update(self.encoded(fresh))
        known.update((c, known[a] + known[b]) for c, a, b in later)
        return known

    def encoded(self, chunks: Iterable[bytes]) -> Iterator[tuple[bytes, object]]:
        """Each chunk with what the library makes of it."""
        t = tokenizer(self.path)
        for batch in balanced(sorted(chunks, key=len)):
            made = t.encode_batch_fast([c.decode() for c in batch], add_special_tokens=False)
            yield from ((c, array("I", e.ids).tobytes() if self.ids else len(e)) for c, e in zip(batch, made))

    def texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where those of each start (and the last end). Each different part of
        the texts (a chunk, or closing marks and what stands before them) is looked up once; its places are numbers."""
        split = pc.ascii_split_whitespace(pa.array(map(lowered, texts), pa.binary()).cast(pa.string()))
        coded = split.flatten().dictionary_encode()
        cores, tails, has = without_tails(coded.dictionary)
        cores, tails = cores.dictionary_encode(), tails.dictionary_encode()
        parts = [x for d in (cores, tails) for x in d.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)]
        parts.append(b"")
        known = self.learn(parts)
        found = [known[c] for c in parts]
        length = np.fromiter(map(len, found), np.int32, len(found)) // 4
        of = np.full((len(has), 2), len(parts) - 1, np.int32)  # the two parts of each chunk
        of[:, 0] = cores.indices.to_numpy()
        of[has, 1] = tails.indices.to_numpy() + np.int32(len(cores.dictionary))
        at = of[coded.indices.to_numpy()].ravel()
        first, n = np.cumsum(length, dtype=np.int32) - length, length[at]
        ends = np.cumsum(n, dtype=np.int32)
        places = np.repeat(first[at] - (ends - n), n)
        places += np.arange(len(places), dtype=np.int32)
        return np.frombuffer(b"".join(found), "<u4")[places], np.concatenate([np.zeros(1, np.int32), ends])[2 * split.offsets.to_numpy()]


def chunk_cache(path: str, ids: bool) -> ChunkCache:
    """This worker's cache."""
    key = f"{path} {ids}"
    if key not in _loaded:
        _loaded[key] = ChunkCache(path, ids)
    claim(f"tokens {key}", _loaded[key].known.clear)
    return _loaded[key]


def groups(texts: list[bytes], most: int = 4 << 20) -> Iterator[list[bytes]]:
    """Runs of texts of about equal bytes, so that a batch of long texts needs no more memory than one of short ones."""
    part: list[bytes] = []
    total = 0
    for x in texts:
        part.append(x)
        total += len(x)
        if total >= most:
            yield part
            part, total = [], 0
    if part:
        yield part


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    Whole texts at any length; null is an empty text with 0 tokens. Rows are independent: repeated rows and null ids
    each give their own row, an empty table none. Other columns aren't read, so their names can't clash. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = chunk_cache(path, False)
        for b in batches:
            texts, counts = raw_texts(b, "text"), []
            for part in groups(texts):
                chunked = [chunks_of(x) for x in part]
                known = cache.learn(chain.from_iterable(chunked))
                counts += [sum(map(known.__getitem__, c)) for c in chunked]
            n = np.asarray(counts, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array(n), pa.array(n > limit)],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return mapped(docs.select(F.col(id_col), F.col(text_col).alias("text")), run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
