"""BPE encoding and decoding with an own merge loop over a public vocabulary file.

Encoding: a priority queue of merge ranks over a doubly linked list of symbols; an entry whose symbols have changed since
it was queued is stale and skipped. Words of plain letters are merged together in arrays instead, in the same order (merges).
Decoding: the vocabulary's strings, concatenated with the file's separator.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import CACHE_WORDS, OUT_BYTES, claim, mapped, raw_texts
from graphloom.llm.merges import byte_letters
from graphloom.llm.tokens import ChunkCache, groups

#: White space as the vocabulary's splitter knows it.
SPACE = "\t-\r \x85\xa0  -     　"

_caches: dict[str, "Cache"] = {}


class WordBpe:
    """A lower-casing, byte-level BPE with a word-end suffix, read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        letters = byte_letters()
        self.inner = [vocab.get(x) for x in letters]
        self.last = [vocab.get(x + self.suffix) for x in letters]
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + SPACE + r"\p{L}\p{N}]+")
        self.words: dict[str, list[int]] = {}
        self.table = pa.array([self.strings.get(i, "") for i in range(max(self.strings) + 1)], pa.string())

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word. A byte that the vocabulary lacks is left out, as there is no unknown token."""
        end = len(word) - 1
        symbols = [x for x in (self.last[b] if i == end else self.inner[b] for i, b in enumerate(word)) if x is not None]
        n = len(symbols)
        if n < 2:
            return symbols
        merges = self.merges
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = []
        for i in range(n - 1):
            m = merges.get((symbols[i], symbols[i + 1]))
            if m:
                queue.append((m[0], i, symbols[i], symbols[i + 1], m[1]))
        heapq.heapify(queue)
        while queue:
            _, i, a, b, made = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue  # stale: a neighbour was merged away since
            symbols[i], symbols[j] = made, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                m = merges.get((made, symbols[k]))
                if m:
                    heapq.heappush(queue, (m[0], i, made, symbols[k], m[1]))
            h = before[i]
            if h >= 0:
                m = merges.get((symbols[h], made))
                if m:
                    heapq.heappush(queue, (m[0], h, symbols[h], made, m[1]))
        out, i = [], 0
        while i >= 0:
            out.append(symbols[i])
            i = after[i]
        return out

    def normal(self, text: str) -> str:
        """NFC, then each character's own lower case (no final-sigma rule)."""
        text = unicodedata.normalize("NFC", text)
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()

    def encode(self, text: str) -> list[int]:
        """Ids of a text."""
        ids: list[int] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                for word in self.split.findall(self.normal(part)):
                    known = self.words.get(word)
                    if known is None:
                        if len(self.words) >= CACHE_WORDS:
                            self.words.clear()
                        known = self.words[word] = self.merge(word.encode())
                    ids += known
        return ids

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The texts that ids of several texts, one after another, stand for."""
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), self.table.take(pa.array(ids))), " ")


class Cache(ChunkCache):
    """The ids of each chunk: words of plain letters merged together, all others one by one. Nothing goes to the library."""

    def __init__(self, path: str):
        super().__init__(path, True)
        self.bpe = WordBpe(path)

    def encoded(self, chunks: Iterable[bytes]) -> Iterator[tuple[bytes, bytes]]:
        return ((c, np.asarray(self.bpe.encode(c.decode()), "<u4").tobytes()) for c in chunks)


def cache(path: str) -> Cache:
    """This worker's cache."""
    if path not in _caches:
        _caches[path] = Cache(path)
    c = _caches[path]
    claim(f"bpe {path}", lambda: (c.known.clear(), c.bpe.words.clear()))
    return c


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_tokens, ids (array of int) and decoded (the text that the ids stand for).

    Whole texts of any length; null is an empty text: no ids, decoded to an empty text. Repeated rows and null ids each
    give their own row, an empty table none. Other columns aren't read. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = cache(path)
        for b in batches:
            at = 0
            for part in groups(raw_texts(b, "text"), OUT_BYTES // 2):
                ids, offsets = own.texts(part)
                values = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.view("<i4")))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(part)), pa.array(np.diff(offsets).astype(np.int64)), values, own.bpe.decode(ids, offsets)],
                    names=[id_col, "n_tokens", "ids", "decoded"],
                )
                at += len(part)

    kind = docs.schema[id_col].dataType.simpleString()
    return mapped(docs.select(F.col(id_col), F.col(text_col).alias("text")), run, f"`{id_col}` {kind}, n_tokens long, ids array<int>, decoded string")
