"""The corpus pipeline: toxicity, near-duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() writes each stage's rows to
Parquet in the shared folder of spark.checkpoint.dir and reads them again for the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import neardup, packing, pii, substrings, toxicity
from graphloom.llm.common import read, shared_folder
from graphloom.llm.queries import surrogate_key, vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below one half. A null or empty text has the base rate and stays; repeated rows share
    one decision; an empty table stays empty; columns pass through, whatever their names. Without usable labels of both
    kinds nothing can be learned: all stay (or all go, if every label says toxic)."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).where("toxicity < 0.5").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group. Texts without words are in no group and stay, as do rows of a
    null id; rows of one id stay or go together; an empty table stays empty; columns pass through, whatever their names."""
    return neardup.keep_one(docs, percent=85)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 50 words or more that stand in an earlier one. Null and short texts and rows of a
    null id stay as they are; rows of one id don't count as earlier than each other; no row goes, an empty table stays empty."""
    return substrings.deduplicated(docs, window=50)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates in place of personal data. A null text stays null; equal rows stay equal; an empty
    table stays empty. The key is the session's (surrogate_key)."""
    return pii.replaced(docs, surrogate_key(spark))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens. A null or empty text is its end token alone; repeated rows and
    rows of a null id are packed like any other; an empty table gives no rows."""
    made = packing.pack(docs, vocabulary(), capacity=4096, end_id=2)
    return made.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeats),
    ("personal_data", replace_personal_data),
    ("packing", pack_sequences),
]

#: SQL can't express the tokenizer, the classifier or keyed surrogates.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage's rows are deleted once the next one's are written."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = read(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        at = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = at
    return docs
