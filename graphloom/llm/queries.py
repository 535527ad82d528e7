"""The queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, jpeg, licenses, neardup, packing, pii, substrings, tokens, toxicity, vectors
from graphloom.llm.common import read

#: File of the public vocabulary; its folder is found at run time and is a parameter of each operator.
VOCABULARY = "word_bpe_49k.json"


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The session's setting of the surrogates' key. Who has the key can undo the replacements, so none stands here.
KEY_SETTING = "spark.graphloom.surrogate.key"


def surrogate_key(spark: SparkSession) -> bytes:
    """The key that the session names; where it names none, one drawn at random for this session, so that surrogates are
    consistent within it and nobody can undo them."""
    if not spark.conf.get(KEY_SETTING, ""):
        spark.conf.set(KEY_SETTING, secrets.token_hex(32))
    return spark.conf.get(KEY_SETTING).encode()


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = licenses.scan(read(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        F.size("licenses").cast("long").alias("n_licenses"),
        F.concat_ws(",", F.array_sort(F.array_distinct("licenses.license"))).alias("license_ids"),
        F.concat_ws("; ", F.flatten("licenses.differences")).alias("differences"),
    )


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pii.replaced(read(spark, sf_dir, "documents").select("doc_id", "text"), surrogate_key(spark), with_entities=True)
    return made.select("doc_id", "text", F.size("pii_entities").cast("long").alias("n_entities"), F.concat_ws(",", F.array_sort(F.array_distinct("pii_entities.type"))).alias("entity_types"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(read(spark, sf_dir, "documents"), vocabulary(), limit=2048)


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, changes = substrings.repeated(read(spark, sf_dir, "documents"), window=50)
    lost = changes.select("doc_id", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    return base.select("doc_id", "n_words", "sha").join(lost, "doc_id", "left").select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_ = read(spark, sf_dir, "embeddings")
    return vectors.nearest(all_, all_.where("vec_id % 20 = 0"), k=20)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = bpe.encode_decode(read(spark, sf_dir, "documents"), vocabulary())
    return made.select(
        "doc_id",
        "n_tokens",
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = packing.pack(read(spark, sf_dir, "documents"), vocabulary(), capacity=4096, end_id=2)
    return made.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    made = toxicity.scored(docs.select("doc_id", "text"), toxicity.train(docs, read(spark, sf_dir, "labels")))
    return made.select("doc_id", toxicity.in_fold("doc_id").alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"), percent=85)


def op10_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = jpeg.media(read(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.format_string("%dx%dx3:%08x", "height", "width", F.crc32("rgb")).alias("feature"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": op1_licenses,
    "op2_token_counts": op2_token_counts,
    "op3_surrogates": op3_surrogates,
    "op4_repeats": op4_repeats,
    "op5_nearest": op5_nearest,
    "op6_bpe": op6_bpe,
    "op7_packing": op7_packing,
    "op8_toxicity": op8_toxicity,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_progressive_jpeg": op10_progressive_jpeg,
}
ORACLE: dict[str, str] = {}
