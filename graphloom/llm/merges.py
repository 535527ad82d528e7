"""Merging many words at once: byte-level BPE over arrays of words of equal length.

In each round every word that still has a pair to merge merges its best one (lowest rank, then leftmost) and so gets one
symbol shorter, which is the order that a queue of merge ranks gives for one word. Words are regrouped by length after
each round, so a batch of words takes as many rounds as its longest word has letters.
"""

from __future__ import annotations

import json
from itertools import compress

import numpy as np
import regex

#: Longer words go to the library.
LONGEST = 64
#: Words of plain letters only, whatever their case: NFC and lower-casing change none of them beyond their own letters.
_letters = regex.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xd0[\x90-\xbf]|\xd1[\x80-\x8f])+")
_raised = regex.compile(rb"\xc3[\x80-\x9e]|\xd0[\x90-\xaf]")
#: Of each two bytes: 1 if they are one of those letters, 2 if it is a capital.
PAIRS = np.zeros(1 << 16, np.uint8)
for _lead in b"\xc3\xd0\xd1":
    for _next in range(0x80, 0xC0):
        if _letters.fullmatch(bytes([_lead, _next])):
            PAIRS[_lead << 8 | _next] = 2 if _raised.search(bytes([_lead, _next])) else 1


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = [""] * 256, 256
    for b in range(256):
        if b in shown:
            letters[b] = chr(b)
        else:
            letters[b] = chr(extra)
            extra += 1
    return letters


class Merges:
    """The merges of a tokenizer file as two hash tables over pairs of symbols; every pair is in one of them."""

    BITS = 18

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.many = max(vocab.values()) + 1
        self.none = len(pairs)
        key = np.array([vocab[a] * self.many + vocab[b] for a, b in pairs], np.uint64)
        rank = np.arange(len(pairs), dtype=np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        letters, suffix = byte_letters(), model.get("end_of_word_suffix") or ""
        self.inner = np.array([vocab.get(x, -1) for x in letters], np.int32)
        self.last = np.array([vocab.get(x + suffix, -1) for x in letters], np.int32)
        rng = np.random.default_rng(11)
        self.tables: list[tuple[np.uint64, np.ndarray, np.ndarray]] = []
        while len(key):  # what meets another key goes to the next table
            multiply = np.uint64(int(rng.integers(1 << 62)) * 2 + 1)
            at = self._slot(key, multiply)
            _, first = np.unique(at, return_index=True)
            keys, ranks = np.full(1 << self.BITS, np.uint64(2**64 - 1)), np.full(1 << self.BITS, self.none, np.int32)
            keys[at[first]], ranks[at[first]] = key[first], rank[first]
            self.tables.append((multiply, keys, ranks))
            rest = np.ones(len(key), bool)
            rest[first] = False
            key, rank = key[rest], rank[rest]

    def _slot(self, key: np.ndarray, multiply: np.uint64) -> np.ndarray:
        return ((key * multiply) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair; `none` where it isn't one to merge."""
        key = (a.astype(np.int64) * self.many + b).astype(np.uint64)
        out = None
        for multiply, keys, ranks in self.tables:
            at = self._slot(key, multiply)
            found = np.where(keys[at] == key, ranks[at], np.int32(self.none))
            out = found if out is None else np.minimum(out, found)
        return out if out is not None else np.full(a.shape, self.none, np.int32)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word (not empty, at most LONGEST bytes) as little-endian 32-bit words."""
        out: list[bytes] = [b""] * len(words)
        if not words:
            return out
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        letters = np.frombuffer(b"".join([words[i] for i in order.tolist()]), np.uint8)
        sizes = sizes[order]
        ends = np.cumsum(sizes)
        number, symbols, ranks = (None, None, None)
        for n in range(int(sizes[-1]), 0, -1):
            i, j = np.searchsorted(sizes, [n, n + 1])
            if j > i:
                own = letters[ends[i] - n : ends[j - 1]].reshape(j - i, n)
                s = self.inner[own]
                s[:, -1] = self.last[own[:, -1]]
                r = self.ranks(s[:, :-1], s[:, 1:])
                if number is None:
                    number, symbols, ranks = order[i:j], s, r
                else:
                    number, symbols, ranks = np.concatenate([number, order[i:j]]), np.concatenate([symbols, s]), np.concatenate([ranks, r])
            if number is None or not len(number):
                number = None
                continue
            if n > 1:
                best = ranks.argmin(axis=1)
                rank = np.take_along_axis(ranks, best[:, None], 1)[:, 0]
                done = rank == self.none
            else:
                done = np.ones(len(number), bool)
            if done.any():
                made, step = symbols[done].astype("<u4").tobytes(), 4 * n
                for k, w in enumerate(number[done].tolist()):
                    out[w] = made[k * step : k * step + step]
            go = ~done
            number = number[go]
            if not len(number):
                number = None
                continue
            symbols, ranks, best, rank = symbols[go], ranks[go], best[go], rank[go]
            row = np.arange(len(number))
            symbols[row, best] = self.made[rank]
            keep = np.ones(symbols.shape, bool)
            keep[row, best + 1] = False
            symbols = symbols[keep].reshape(len(row), n - 1)
            keep = np.ones(ranks.shape, bool)
            keep[row, best] = False
            ranks = ranks[keep].reshape(len(row), n - 2)
            if n > 2:
                left, right = np.flatnonzero(best > 0), np.flatnonzero(best < n - 2)
                ranks[left, best[left] - 1] = self.ranks(symbols[left, best[left] - 1], symbols[left, best[left]])
                ranks[right, best[right]] = self.ranks(symbols[right, best[right]], symbols[right, best[right] + 1])
        return out

    def known(self, chunks: list[bytes]) -> tuple[list[bytes], list[bytes], list[bytes]]:
        """Of chunks without line ends: the words of plain letters, the ids of each, and the other chunks."""
        if not chunks:
            return [], [], []
        data = np.frombuffer(b"\n".join([*chunks, b""]), np.uint8)
        pairs = PAIRS[data[:-1].astype(np.uint16) << 8 | data[1:]]
        fine = (data >= 97) & (data <= 122)
        fine[:-1] |= pairs > 0
        fine[1:] |= pairs > 0
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        starts = np.cumsum(sizes + 1) - sizes - 1
        plain = (np.add.reduceat(~fine, starts, dtype=np.int64) == 1) & (sizes > 0) & (sizes <= LONGEST)  # 1: the line end
        raised = np.add.reduceat(np.append(pairs == 2, False), starts, dtype=np.int64)[plain] > 0
        words, other = list(compress(chunks, plain.tolist())), list(compress(chunks, (~plain).tolist()))
        lower = list(words)
        for i in np.flatnonzero(raised).tolist():
            lower[i] = words[i].decode().lower().encode()
        return words, self.encode(lower), other
