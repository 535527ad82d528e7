"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A record batch that goes back to the JVM is cut near this many bytes.
OUT_BYTES = 8 << 20
#: Entries that a worker's word cache holds before it starts anew; words are Zipf-distributed, so the hot ones return at once.
CACHE_WORDS = 250_000


_holder: list = ["", lambda: None]


def claim(name: str, clear: Callable[[], None] = lambda: None) -> None:
    """Says whose caches this worker holds from now on: those of the operator that ran here before are cleared, as workers
    outlive stages and memory would add up over a pipeline."""
    if _holder[0] != name:
        _holder[1]()
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another libc: freed memory just stays with the process
            pass
    _holder[:] = [name, clear]


def release() -> None:
    """Clears this worker's caches and gives freed memory back: an idle worker must not hold what another task needs."""
    claim("")


#: Bytes of an Arrow batch on its way to a worker, where the session sets no bound of its own kind (its default is 64 MB or more).
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(run, schema) with batches bounded by bytes as well as by rows; a worker's caches end with its task."""
    df.sparkSession.conf.set(_BATCH, str(BATCH_BYTES))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(task, schema)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only in local mode, where there is one machine, may it be unset."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    return folder.rstrip("/") or os.path.join(tempfile.gettempdir(), "graphloom-checkpoint")


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame, written once to the reliable checkpoint folder (the one already set, else shared_folder)."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a text column; null is empty."""
    return [b"" if x is None else x for x in batch.column(name).cast(pa.binary()).to_pylist()]


def pieces(sizes: list[int], most: int = OUT_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum to about `most`."""
    start = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def bit_of(key: Column, bits: int) -> Column:
    """The bit of a bitmap of `bits` bits that a key sets."""
    return F.pmod(F.xxhash64(key), F.lit(bits))


def key_bitmap(keys: DataFrame, name: str, most_bits: int = 1 << 26) -> tuple[np.ndarray, int]:
    """A one-hash Bloom filter of a key column, as 64-bit words. Its size follows the number of keys up to `most_bits`
    (8 MB), a bound that holds at any scale; beyond it the filter lets more through and stays right."""
    n = keys.count()
    bits = min(most_bits, max(1 << 16, 1 << (32 * max(1, n) - 1).bit_length()))
    h = bit_of(F.col(name), bits)
    found = (
        keys.where(F.col(name).isNotNull())
        .select(h.alias("h"))
        .groupBy(F.shiftright("h", 6).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias("value"))
        .toArrow()
    )
    words = np.zeros(bits // 64, np.int64)
    words[found.column("word").to_numpy()] = found.column("value").to_numpy()
    return words, bits


def maybe_in(df: DataFrame, name: str, bitmap: tuple[np.ndarray, int], keep: bool = True) -> DataFrame:
    """The rows whose key may be among the bitmap's keys (keep), or surely isn't; no shuffle. A null key isn't."""
    words, bits = bitmap
    shared = df.sparkSession.sparkContext.broadcast(words)
    columns, schema = df.columns, df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in batches:
            h = b.column(len(columns)).fill_null(-1).to_numpy(zero_copy_only=False)
            hit = (h >= 0) & ((table[np.maximum(h, 0) >> 6] >> (np.maximum(h, 0) & 63)) & 1).astype(bool)
            out = b.select(list(range(len(columns)))).filter(pa.array(hit if keep else ~hit))
            if out.num_rows:
                yield out

    h = F.when(F.col(f"`{name}`").isNotNull(), bit_of(F.col(f"`{name}`"), bits))
    return mapped(df.select(*[F.col(f"`{c}`") for c in columns], h.alias("__graphloom_bit")), run, schema)


def drop_keys(df: DataFrame, name: str, keys: DataFrame) -> DataFrame:
    """The rows whose key isn't among `keys` (one column of that name). Only rows that the bitmap can't clear are shuffled."""
    bitmap = key_bitmap(keys, name)
    rest = maybe_in(df, name, bitmap).join(keys.select(name).distinct(), name, "left_anti").select(*df.columns)
    return maybe_in(df, name, bitmap, keep=False).unionByName(rest)
