"""Sources and sinks of quads: tab-separated files, Parquet, media files."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import terms

#: Namespace of the fixed vocabulary.
SCHEMA = "http://graphloom.example/schema#"

_TYPES = """image/png png|image/jpeg jpg jpeg jpe jfif|image/gif gif|image/webp webp|image/svg+xml svg|image/bmp bmp dib|image/tiff tif tiff|audio/mpeg mp3 mpga|audio/wav wav wave|audio/ogg ogg oga opus|audio/flac flac
audio/aac aac|audio/mp4 m4a|video/mp4 mp4 m4v mpg4|video/webm webm|video/x-matroska mkv|video/quicktime mov qt|video/x-msvideo avi|video/ogg ogv|video/mpeg mpeg mpg|text/plain txt text log|text/csv csv
text/html html htm|text/css css|text/markdown md|text/tab-separated-values tsv|text/yaml yaml yml|application/json json|application/xml xml|application/javascript js|application/pdf pdf|model/obj obj|model/gltf+json gltf|model/stl stl"""
MIME = {ending: kind for part in _TYPES.replace("\n", "|").split("|") for kind, *endings in [part.split()] for ending in endings}


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Quads of tab-separated files with the header subject, predicate, object; compressed files by their ending. Duplicates go."""
    raw = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"', multiLine=True, schema="subject string, predicate string, object string")
    rows = raw.where("subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL")
    return rows.select(*[terms.parse(F.col(c)).alias(n) for c, n in (("subject", "s"), ("predicate", "p"), ("object", "o"))]).dropDuplicates()


def import_tsv(spark: SparkSession, path: str, recursive: bool = False, keep_spaces: bool = False, skip: int = 0) -> DataFrame:
    """Quads of header-less lines split at tabs outside quotes, three fields at least; spaces inside <…> become _; the first
    `skip` lines of each file are left out (each file is then read whole by one task, as only that knows its first lines)."""
    lines = spark.read.text(path, recursiveFileLookup=recursive)
    if skip:
        files = spark.read.text(path, recursiveFileLookup=recursive, wholetext=True)
        lines = files.select(F.explode(F.slice(F.split("value", r"\r?\n"), skip + 1, 2**31 - 1)).alias("value"))
    parts = F.split("value", r"\t(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)")
    clean = lambda c: F.regexp_replace(F.trim(c), r'^"(.*)"$', "$1")
    spaced = lambda c: c if keep_spaces else F.when(c.startswith("<") & c.endswith(">"), F.translate(c, " ", "_")).otherwise(c)
    return lines.where(F.size(parts) >= 3).select(*[terms.parse(spaced(clean(parts[i]))).alias(n) for i, n in enumerate("spo")]).dropDuplicates()


def write_tsv(quads: DataFrame, path: str, compression: str = "none") -> None:
    """Tab-separated with header; fields with tabs, line ends or quotes are quoted."""
    quads.selectExpr("s AS subject", "p AS predicate", "o AS object").write.csv(path, sep="\t", header=True, quote='"', escape='"', compression=compression)


#: Column of a store's partitions, and their number.
BUCKET, BUCKETS = "p_bucket", 64


def _bucket(p: Column) -> Column:
    return F.pmod(F.xxhash64(p), F.lit(BUCKETS)).cast("int")


def of_predicates(quads: DataFrame, predicates: list[str]) -> DataFrame:
    """The quads of these predicates; of a stored frame only their partitions are read."""
    out = quads.where(F.col("p").isin(predicates) if len(predicates) != 1 else F.col("p") == predicates[0])
    if BUCKET in quads.columns:
        for_all = F.lit(False)
        for p in predicates:
            for_all = for_all | (F.col(BUCKET) == _bucket(F.lit(p)))
        out = out.where(for_all)
    return out


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """s, p, o and the partition column, by which queries of constant predicates prune."""
    return spark.read.parquet(path)


def dump(quads: DataFrame, path: str, local: str = "http://localhost/", compression: str = "none") -> None:
    """As write_tsv, without quads of subjects at a local host that isn't this store's own."""
    write_tsv(quads.where(~F.col("s").startswith(f"<{local}")), path, compression)


def write_store(quads: DataFrame, path: str, shards: int = 8) -> None:
    """Parquet by a hash of the predicate, so that a constant predicate reads one partition (of_predicates); many small ones
    share a partition, and a frequent one is written by `shards` tasks."""
    quads.withColumn(BUCKET, _bucket(F.col("p"))).repartition(F.col(BUCKET), F.pmod(F.xxhash64("s"), F.lit(shards))).write.partitionBy(BUCKET).parquet(path)


def media_quads(spark: SparkSession, path: str) -> DataFrame:
    """Metadata quads of media files; the id is the Base64 SHA3-256 of the content."""

    @F.pandas_udf("string")
    def content_id(x: pd.Series) -> pd.Series:
        import base64

        return x.map(lambda b: base64.urlsafe_b64encode(hashlib.sha3_256(b).digest()).decode().rstrip("="))

    mime = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    files = spark.read.format("binaryFile").load(path)
    rows = files.select(content_id("content").alias("id"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length"))
    kind = F.coalesce(mime[F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))], F.lit("application/octet-stream"))
    facts = {"rawId": F.col("id"), "rawMimeType": kind, "mediaType": F.upper(F.substring_index(kind, "/", 1)), "fileName": F.col("name"), "canonicalId": F.col("id"), "canonicalMimeType": kind}
    pairs = F.array(*[F.struct(F.lit(f"<{SCHEMA}{k}>").alias("p"), terms.string(v).alias("o")) for k, v in facts.items()])
    return rows.select(terms.iri(F.concat(F.lit("http://graphloom.example/object/"), "id")).alias("s"), F.explode(pairs).alias("e")).select("s", "e.p", "e.o").distinct()
