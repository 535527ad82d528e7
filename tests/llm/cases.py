"""Small tables with the awkward cases that every operator must take."""

from pyspark.sql import types as T

LONG = " ".join(f"word{i % 97}" for i in range(30_000))
TEXTS = [
    (1, "The quick brown fox's 12 jumps!"),
    (2, None),
    (3, ""),
    (4, "   \t\n\x0b\x0c\r "),
    (5, LONG),
    (6, LONG),
    (7, "x" * 20_000),
    (8, "<|endoftext|>a<|startoftext|> İΣAS Σ café   \x1c\x85 힣가 'LL don't"),
    (8, "<|endoftext|>a<|startoftext|> İΣAS Σ café   \x1c\x85 힣가 'LL don't"),
    (None, "no id but text"),
    (9, "日本語の文 \U0001f600\U0001f600 á́ ẛ̣ ǅ ß Å"),
    (9, "H̱ K̨ The END. End,, (a). b\x22! 9. é. …, ﬁ! x’. don't!!! A̱**"),
    (10, "tie"),
    (11, "tie"),
]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def frame(spark, rows=TEXTS, more=True):
    df = spark.createDataFrame(rows, SCHEMA)
    if more:  # columns whose names operators use themselves
        for name in ("n_tokens", "n_words", "ids", "score", "kept", "h", "key", "bucket", "start", "component_id"):
            df = df.selectExpr("*", f"'x' AS {name}")
    return df
