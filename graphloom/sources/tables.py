"""The relational tables of a data folder as quads: the key is the subject, each column a predicate, keys of others edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import terms
from graphloom.operators.relations import BASE, BOUNDS, EMBEDDING, SEGMENT_BOUNDS, SEGMENT_OF

EX = BASE + "t/"


def node(kind: str, key: Column | str) -> Column:
    return terms.iri(F.concat(F.lit(f"{EX}{kind}/"), (F.col(key) if isinstance(key, str) else key).cast("string")))


#: table: (kind of node, key, columns as (name, how)); how is the literal's type or the kind of the node it points to.
MAPS: dict[str, tuple[str, str, dict[str, str]]] = {
    "region": ("region", "r_regionkey", {"r_name": "string"}),
    "nation": ("nation", "n_nationkey", {"n_name": "string", "n_regionkey": ">region"}),
    "customer": ("customer", "c_custkey", {"c_name": "string", "c_nationkey": ">nation", "c_acctbal": "double", "c_mktsegment": "string"}),
    "supplier": ("supplier", "s_suppkey", {"s_name": "string", "s_nationkey": ">nation", "s_acctbal": "double"}),
    "part": ("part", "p_partkey", {"p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "long", "p_retailprice": "double"}),
    "orders": ("order", "o_orderkey", {"o_custkey": ">customer", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "temporal", "o_orderpriority": "string"}),
    "events": ("event", "event_id", {"user_id": "long", "event_type": "string", "value": "double"}),
    "documents": ("document", "doc_id", {"text": "string", "lang": "string", "source": "string", "n_chars": "long"}),
    "labels": ("document", "doc_id", {"quality": "long", "toxic": "long"}),
}


def quads(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """Quads of these tables; only they, and of them only columns that a query's predicates leave, are read."""
    out = None
    for t in names:
        kind, key, columns = MAPS[t]
        df = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        for c, how in columns.items():
            o = node(how[1:], c) if how[0] == ">" else getattr(terms, how)(F.col(c))
            part = df.where(F.col(c).isNotNull()).select(node(kind, key).alias("s"), F.lit(f"<{EX}{c}>").alias("p"), o.alias("o"))
            out = part if out is None else out.unionByName(part)
    return out


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return df.select(node("vec", "vec_id").alias("s"), F.lit(EMBEDDING).alias("p"), terms.vector(F.col("embedding").cast("array<double>")).alias("o"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as rectangles: twenty consecutive keys share a parent; place and size follow from the key. A third of them is
    large, and the last of a parent lies where the one before does."""
    df = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey")
    j = k - (k % 20 == 19).cast("long")
    big = j % 3 == 0
    x, y = (j * 7 % 50).cast("double"), (j * 13 % 40).cast("double")
    box = F.concat_ws(",", x, x + (j % 9 + 1) * F.when(big, 4).otherwise(1), y, y + (j % 5 + 1) * F.when(big, 6).otherwise(1), F.lit("-"), F.lit("-"), F.lit("-"), F.lit("-"))
    s = node("part", k)
    parent = df.select(s.alias("s"), F.lit(SEGMENT_OF).alias("p"), node("sheet", F.floor(k / 20)).alias("o"))
    return parent.unionByName(df.select(s.alias("s"), F.lit(SEGMENT_BOUNDS).alias("p"), terms.string(box).alias("o")))


def event_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as segments of their user's time, in days: one to four from the day of the event. As objects they last a day
    longer."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id IS NOT NULL AND user_id IS NOT NULL AND ts IS NOT NULL")
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000).cast("double")
    span = lambda more: terms.string(F.concat(F.lit("-,-,-,-,-,-,"), day.cast("string"), F.lit(","), (day + F.col("event_id") % 4 + more).cast("string")))
    s = node("event", "event_id")
    facts = F.array(
        F.struct(F.lit(SEGMENT_OF).alias("p"), node("user", "user_id").alias("o")), F.struct(F.lit(SEGMENT_BOUNDS).alias("p"), span(1).alias("o")), F.struct(F.lit(BOUNDS).alias("p"), span(2).alias("o"))
    )
    return e.select(s.alias("s"), F.explode(facts).alias("e")).select("s", "e.p", "e.o")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as chains: each turn has a next one."""
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn").distinct()
    at = lambda t: node("turn", F.concat(F.col("conv_id").cast("string"), F.lit("-"), t.cast("string")))
    later = df.select("conv_id", (F.col("turn") - 1).alias("turn"))
    return df.join(later, ["conv_id", "turn"]).select(at(F.col("turn")).alias("s"), F.lit(f"<{EX}next>").alias("p"), at(F.col("turn") + 1).alias("o"))
