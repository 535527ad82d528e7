"""Terms: the string keys that stand for values in quads, and expressions over them.

A key is `<iri>`, or a lexical form with its type: `a^^String`, `5^^Long`, `2.5^^Double`, `2024-01-02T03:04:05Z^^Temporal`,
`[1.0, 2.0]^^DoubleVector` (LongVector, FloatVector). Equal keys are equal values, so joins are plain string joins.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPES = ("String", "Long", "Double", "Temporal", "DoubleVector", "LongVector", "FloatVector")
_SUFFIX = r"\^\^(String|Long|Double|Temporal|DoubleVector|LongVector|FloatVector)$"


def iri(x: Column | str) -> Column:
    return F.concat(F.lit("<"), x if isinstance(x, Column) else F.lit(x), F.lit(">"))


def string(x: Column) -> Column:
    return F.concat(x.cast("string"), F.lit("^^String"))


def long(x: Column) -> Column:
    return F.concat(x.cast("long").cast("string"), F.lit("^^Long"))


def double(x: Column) -> Column:
    return F.concat(x.cast("double").cast("string"), F.lit("^^Double"))


def temporal(x: Column) -> Column:
    """In UTC, with as many decimals of a second as there are."""
    stamp = F.date_format(F.to_utc_timestamp(x, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(stamp, r"\.0+$|(\.\d*?[1-9])0+$", "$1"), F.lit("Z^^Temporal"))


def vector(x: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(x.cast("array<string>"), ", "), F.lit("]^^DoubleVector"))


def is_iri(k: Column) -> Column:
    return k.startswith("<") & k.endswith(">")


def kind(k: Column) -> Column:
    """iri, or the type of a literal."""
    return F.when(is_iri(k), F.lit("iri")).otherwise(F.regexp_extract(k, _SUFFIX, 1))


def lexical(k: Column) -> Column:
    """The bare text: an IRI without brackets, a literal without type."""
    return F.when(is_iri(k), F.substring(k, 2, F.length(k) - 2)).otherwise(F.regexp_replace(k, _SUFFIX, ""))


def is_numeric(k: Column) -> Column:
    return k.endswith("^^Long") | k.endswith("^^Double")


def number(k: Column) -> Column:
    """The numeric value; null where it isn't a number."""
    return F.when(is_numeric(k), F.substring_index(k, "^^", 1).try_cast("double"))


def whole(k: Column) -> Column:
    """The value of a long, exact; null where it isn't one."""
    return F.when(k.endswith("^^Long"), F.substring_index(k, "^^", 1).try_cast("long"))


def elements(k: Column) -> Column:
    """The components of a vector literal; null where it isn't one or a component is bad."""
    inner = F.regexp_extract(k, r"^\[(.*)\]\^\^(?:Double|Long|Float)Vector$", 1)
    parts = F.transform(F.split(inner, r"\s*,\s*"), lambda x: F.trim(x).try_cast("double"))
    return F.when(inner != "", parts)


def parse(raw: Column) -> Column:
    """The key of a raw term: an unparsable long is 0, an unparsable double NaN, a vector with a bad component is empty;
    what has no type (and isn't a closed vector or an IRI) is a string."""
    body, t = F.regexp_replace(raw, _SUFFIX, ""), F.regexp_extract(raw, _SUFFIX, 1)
    bare = raw.startswith("[") & raw.endswith("]")
    inner = F.regexp_extract(body, r"^\[(.*)\]$", 1)
    values = F.transform(F.filter(F.split(inner, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).try_cast("double"))
    good = F.when(F.exists(values, lambda x: x.isNull()), F.array().cast("array<double>")).otherwise(values)
    name = F.when(bare, F.lit("DoubleVector")).otherwise(t)
    cast = F.when(name == "LongVector", F.array_join(good.cast("array<bigint>").cast("array<string>"), ", ")).otherwise(F.array_join(good.cast("array<string>"), ", "))
    return (
        F.when(raw.startswith("<") & raw.endswith(">"), raw)
        .when(t == "Long", long(F.coalesce(body.try_cast("long"), F.lit(0))))
        .when(t == "Double", double(F.coalesce(body.try_cast("double"), F.lit(float("nan")))))
        .when(t == "Temporal", temporal(F.coalesce(body.try_cast("timestamp"), F.timestamp_millis(body.try_cast("long")))))
        .when(name.isin("DoubleVector", "LongVector", "FloatVector"), F.concat(F.lit("["), cast, F.lit("]^^"), name))
        .otherwise(F.concat(F.when(t == "String", body).otherwise(raw), F.lit("^^String")))
    )


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine over the common length; 0 for equal vectors, 1 where a norm is (almost) zero or the result isn't a number."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, 1, n), F.slice(b, 1, n)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, e: s + e)
    dot, na, nb = total(F.zip_with(x, y, lambda p, q: p * q)), total(F.transform(x, lambda p: p * p)), total(F.transform(y, lambda p: p * p))
    norm = F.sqrt(na) * F.sqrt(nb)
    d = 1 - dot / norm
    return F.when(a == b, F.lit(0.0)).when(n < 1, F.lit(1.0)).when((norm < 1e-6) | F.isnan(norm), F.lit(1.0)).otherwise(F.when(F.isnan(d), F.lit(1.0)).otherwise(d))


def dot_distance(a: Column, b: Column) -> Column:
    """The negative inner product."""
    return -F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, e: s + e)
