"""Near-duplicate documents by min-max hashing.

Each permutation of a document's shingles gives both its smallest and its largest value, so half the hash evaluations
make a signature of the same length. Bands of the signature propose links; every link is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import CACHE_WORDS, bit_of, checkpointed, claim, drop_keys, key_bitmap, mapped, pieces, raw_texts
from graphloom.llm.components import connected

#: Permutations; each gives two values. Bands of ROWS values: a pair at similarity s shares none with probability
#: (1 - s**ROWS) ** BANDS: 2e-8 at s = 0.85.
PERMUTATIONS, ROWS = 48, 4
BANDS = 2 * PERMUTATIONS // ROWS
_rng = np.random.default_rng(20240607)
_MULTIPLY = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2)
_BAND = _rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_words: dict[bytes, int] = {}


clear_words = _words.clear


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, each distinct word hashed once while the cache holds it."""
    try:
        return np.array([_words[w] for w in words], np.uint64)
    except KeyError:
        if len(_words) > CACHE_WORDS:
            _words.clear()
        for w in words:
            if w not in _words:
                _words[w] = xxhash.xxh3_64_intdigest(w)
        return np.array([_words[w] for w in words], np.uint64)


def shingle_set(text: bytes, size: int = 3) -> np.ndarray:
    """Sorted distinct hashes of the shingles of `size` lower-cased words; with fewer words the whole sequence is the
    only one; without words there is none."""
    h = word_hashes(text.lower().split())
    if not len(h):
        return h
    k = min(size, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minimum and the maximum under each permutation, interleaved."""
    low = high = None
    step = 1 << 12
    for i in range(0, len(shingles), step):
        h = shingles[i : i + step, None] * _MULTIPLY + _ADD
        a, b = h.min(axis=0), h.max(axis=0)
        low, high = (a, b) if low is None else (np.minimum(low, a), np.maximum(high, b))
    return np.stack([low, high], 1).ravel()


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band."""
    return mix((mix(sig).reshape(BANDS, ROWS) * _BAND).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per document: id, n_shingles, a 128-bit digest of its whole set (two longs) and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("words", _words.clear)
        for b in batches:
            n, d1, d2, keys, lengths = [], [], [], [], []
            for x in raw_texts(b, "text"):
                s = shingle_set(x)
                n.append(len(s))
                digest = xxhash.xxh3_128_digest(s.tobytes())
                d1.append(int.from_bytes(digest[:8], "little", signed=True))
                d2.append(int.from_bytes(digest[8:], "little", signed=True))
                keys.append(band_keys(signature(s)) if len(s) else np.empty(0, np.int64))
                lengths.append(len(keys[-1]))
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
            bands = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), bands], names=["doc_id", "n", "d1", "d2", "bands"])

    return mapped(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, n long, d1 long, d2 long, bands array<long>")


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, bitmap: tuple[np.ndarray, int]) -> DataFrame:
    """Per document whose id may be in the bitmap: id and its full set of shingle hashes."""
    shared, bits = docs.sparkSession.sparkContext.broadcast(bitmap[0]), bitmap[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("words", _words.clear)
        for b in batches:
            h = b.column("bit").to_numpy(zero_copy_only=False)
            b = b.filter(pa.array(((shared.value[h >> 6] >> (h & 63)) & 1).astype(bool)))
            ids, sets = b.column(0), [shingle_set(x).view(np.int64) for x in raw_texts(b, "text")]
            for i, j in pieces([8 * len(s) for s in sets]):
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets[i:j]])]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets[i:j])))], names=["id", "shingles"])

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    return mapped(own.withColumn("bit", bit_of(F.col("id"), bits)), run, "id long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * |A ∩ B| >= percent * |A ∪ B| on the full sets. A hot id is split by adaptive execution."""
    both = (
        pairs.join(sets.withColumnsRenamed({"id": "b", "shingles": "sb"}), "b")
        .join(sets.withColumnsRenamed({"id": "a", "shingles": "sa"}), "a")
        .select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("x"), (F.size("sa") + F.size("sb")).alias("t"))
    )
    return both.where(F.lit(100) * F.col("x") >= F.lit(percent) * (F.col("t") - F.col("x"))).select("a", "b")


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id that confirmed links reach), kept (doc_id = component_id),
    n_proposed_links (confirmed ones of the links that were proposed for this document's own text, equal sets not counted: at
    most the number of its near texts, and dependent on which id is smallest).

    Words are runs of bytes other than ASCII white space, A-Z lowered; the set holds distinct 3-word shingles of the whole
    text. Texts that are null, empty or without words have n_shingles 0 and link with nothing. A null id is its own
    component (null) and is kept. Rows that share an id give equal rows each; their sets all belong to that id.

    Documents of equal sets are one class, aggregated by digest before anything else, so copies never meet in pairs. Members
    of a bucket of a band are proposed as link_buckets says.
    """
    sig = checkpointed(signatures(docs, id_col, text_col))
    classes = sig.where("n > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands"))
    members = checkpointed(
        classes.select("rep", "n", F.explode("bands").alias("key"))
        .join(
            classes.select(F.explode("bands").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("key"),
            "key",
        )
        .select("key", "rep", "n")
    )
    found = link_buckets(members, docs, percent, id_col, text_col)
    component = connected(found, "a", "b") if found is not None else None
    reps = sig.join(classes.select("d1", "d2", "n", "rep"), ["d1", "d2", "n"], "left")
    out = reps.select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"))
    if component is not None:
        links = found.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_proposed_links"))
        out = out.join(component.withColumnsRenamed({"node": "rep", "component": "c"}), "rep", "left").join(links, "rep", "left")
    else:
        out = out.withColumn("c", F.lit(None).cast("long")).withColumn("n_proposed_links", F.lit(None).cast("long"))
    return out.select(
        F.col("doc_id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "rep")).alias("component_id"),
        (F.col("doc_id").isNull() | (F.coalesce("c", "rep") == F.col("doc_id"))).alias("kept"),
        F.coalesce("n_proposed_links", F.lit(0)).alias("n_proposed_links"),
    )


def rare_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of members (rep, n, c) of different components c that may link: exact, by their rarest shingles.

    Of two sets that link, the n - ceil(p n / 100) + 1 rarest shingles of each (one order for all) have one in common; and
    with u shingles that no other member has, they share at most m = min(n - u, n' - u'), which must reach
    p (n + n') / (100 + p). The first that they share in that order leaves them no more to share than what follows it in
    either, which must suffice too: so most of what meets at a frequent shingle is dropped within the join. Copies of one original that each differ too much have mostly shingles of their own there, so
    they propose next to nothing, however many they are.
    """
    own = members.join(sets.withColumnRenamed("id", "rep"), "rep").select("rep", "n", "c", F.explode("shingles").alias("s"))
    often = own.groupBy("s").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    each = Window.partitionBy("rep")
    ranked = (
        own.join(often, "s", "left")
        .withColumn("k", F.coalesce("k", F.lit(1)))
        .withColumn("place", F.row_number().over(each.orderBy("k", "s")))
        .where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
        .withColumn("u", F.count_if(F.col("k") == 1).over(each))
        .where("k > 1")
    )
    rare = checkpointed(ranked.select("s", "rep", "n", "c", "u", (F.col("n") - F.col("place") + 1).alias("left")))
    other = rare.withColumnsRenamed({"rep": "m", "n": "mn", "c": "mc", "u": "mu", "left": "mleft"})
    p = F.lit(percent)
    return (
        rare.join(other, "s")
        .where((F.col("c") < F.col("mc")) & ((F.lit(100) + p) * F.least(F.col("n") - F.col("u"), F.col("mn") - F.col("mu"), F.col("left"), F.col("mleft")) >= p * (F.col("n") + F.col("mn"))))
        .select(F.least("rep", "m").alias("a"), F.greatest("rep", "m").alias("b"))
        .distinct()
    )


def link_buckets(members: DataFrame, docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame | None:
    """Confirmed links (a, b) that join everything that links inside buckets join.

    First every member of a bucket is proposed to its smallest id: copies of one original are then one component, with
    one or two distinct pairs each. The members of buckets that still hold several components are joined exactly by their
    rarest shingles, those of one component not among themselves. So no link between components is lost.
    """
    if members.isEmpty():
        return None
    own = members.select(F.col("rep").alias("id")).distinct()
    sets = checkpointed(shingle_sets(docs, id_col, text_col, key_bitmap(own, "id")).join(own, "id", "left_semi").dropDuplicates(["id"]))
    first = members.groupBy("key").agg(F.min_by(F.struct("rep", "n"), "rep").alias("m"))
    fits = F.lit(100) * F.least("n", "m.n") >= F.lit(percent) * F.greatest("n", "m.n")
    stars = members.join(first, "key").where((F.col("rep") != F.col("m.rep")) & fits).select(F.col("m.rep").alias("a"), F.col("rep").alias("b")).distinct()
    links = checkpointed(confirmed(stars, sets, percent))
    component = checkpointed(connected(links, "a", "b"))
    placed = members.join(component, members.rep == component.node, "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("c"))
    several = placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("key")
    rest = checkpointed(placed.join(several, "key", "left_semi").select("rep", "n", "c").distinct())
    if rest.isEmpty():
        return links
    return checkpointed(links.unionByName(confirmed(rare_pairs(rest, sets, percent), sets, percent)).distinct())


def keep_one(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without all but the first (smallest id) of each near-duplicate group; columns unchanged."""
    found = checkpointed(near_duplicates(docs, percent, id_col, text_col).where("NOT kept").select(id_col))
    return drop_keys(docs, id_col, found)
