"""Bounds: eight coordinates minX,maxX,minY,maxY,minZ,maxZ,minT,maxT; an absent dimension is null (printed as -)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("x0", "x1", "y0", "y1", "z0", "z1", "t0", "t1")
AXES = (("x0", "x1"), ("y0", "y1"), ("z0", "z1"), ("t0", "t1"))


def parse(text: Column, fields: tuple[str, ...] = FIELDS) -> Column:
    """The struct of a bounds text, or of some of its fields; parts that are no numbers are absent."""
    parts = F.split(text, ",")
    # the sign of an absent dimension isn't cast: each failing cast costs as much as several that succeed
    return F.struct(*[F.nullif(F.trim(F.get(parts, F.lit(i))), F.lit("-")).try_cast("double").alias(n) for i, n in enumerate(FIELDS) if n in fields])


def text(b: Column) -> Column:
    return F.concat_ws(",", *[F.coalesce(b[n].cast("string"), F.lit("-")) for n in FIELDS])


def _both(a: Column, b: Column, lo: str) -> Column:
    return a[lo].isNotNull() & b[lo].isNotNull()


def dimensions(b: Column) -> Column:
    return sum((F.when(b[lo].isNotNull(), 1).otherwise(0) for lo, _ in AXES), F.lit(0))


def contains(a: Column, b: Column) -> Column:
    """a has no more dimensions than b, and in each of its own reaches at least as far both ways."""
    test = dimensions(a) <= dimensions(b)
    for lo, hi in AXES:
        test = test & (a[lo].isNull() | F.coalesce((a[lo] <= b[lo]) & (a[hi] >= b[hi]), F.lit(False)))
    return test


def overlaps(a: Column, b: Column) -> Column:
    """Some common axis overlaps."""
    test = F.lit(False)
    for lo, hi in AXES:
        test = test | F.coalesce((a[lo] <= b[hi]) & (a[hi] >= b[lo]), F.lit(False))
    return test


def orthogonal(a: Column, b: Column) -> Column:
    """No common axis."""
    test = F.lit(True)
    for lo, _ in AXES:
        test = test & ~_both(a, b, lo)
    return test


def relative(b: Column) -> Column:
    return F.coalesce(F.greatest(*[b[n] for n in FIELDS]) <= 1, F.lit(True))


def extent(b: Column, axis: str) -> Column:
    return b[axis + "1"] - b[axis + "0"]


def center(b: Column) -> Column:
    return F.concat_ws(",", *[F.coalesce(((b[lo] + b[hi]) / 2).cast("string"), F.lit("-")) for lo, hi in AXES])


def area(b: Column) -> Column:
    """Of the first two dimensions that are there, in the order XY, YZ, XZ."""
    w = lambda ax: extent(b, ax)
    return F.coalesce(w("x") * w("y"), w("y") * w("z"), w("x") * w("z"))


def to_temporal(b: Column) -> Column:
    """Z becomes T."""
    f = {n: b[n] for n in FIELDS} | {"z0": F.lit(None).cast("double"), "z1": F.lit(None).cast("double"), "t0": b["z0"], "t1": b["z1"]}
    return F.struct(*[f[n].alias(n) for n in FIELDS])


def to_spatial(b: Column) -> Column:
    """T becomes Z."""
    f = {n: b[n] for n in FIELDS} | {"t0": F.lit(None).cast("double"), "t1": F.lit(None).cast("double"), "z0": b["t0"], "z1": b["t1"]}
    return F.struct(*[f[n].alias(n) for n in FIELDS])


def above(a: Column, b: Column) -> Column:
    return F.coalesce(a["y0"] > b["y1"], F.lit(False))


def below(a: Column, b: Column) -> Column:
    return F.coalesce(a["y1"] < b["y0"], F.lit(False))


def _depth(a: Column, b: Column) -> Column:
    return F.coalesce(~_both(a, b, "z0") | ((a["z1"] > b["z0"]) & (a["z0"] < b["z1"])), F.lit(False))


def left(a: Column, b: Column) -> Column:
    return F.coalesce(a["x1"] < b["x0"], F.lit(False)) & _depth(a, b)


def right(a: Column, b: Column) -> Column:
    return F.coalesce(a["x0"] > b["x1"], F.lit(False)) & _depth(a, b)


def touches(a: Column, b: Column) -> Column:
    return F.coalesce((a["x0"] == b["x1"]) | (a["x1"] == b["x0"]) | (a["y0"] == b["y1"]) | (a["y1"] == b["y0"]), F.lit(False))


def same(a: Column, b: Column) -> Column:
    test = F.lit(True)
    for n in FIELDS:
        test = test & a[n].eqNullSafe(b[n])
    return test


def shares(a: Column, b: Column) -> Column:
    """They have a common axis and overlap on each one that they have in common."""
    test = ~orthogonal(a, b)
    for lo, hi in AXES:
        test = test & (~_both(a, b, lo) | F.coalesce((a[lo] <= b[hi]) & (a[hi] >= b[lo]), F.lit(False)))
    return test


def alike(a: Column, b: Column) -> Column:
    """The same up to EPS."""
    test = F.lit(True)
    for n in FIELDS:
        test = test & F.coalesce(F.abs(a[n] - b[n]) < EPS, a[n].isNull() & b[n].isNull())
    return test


#: Difference below which coordinates are equal.
EPS = 1e-6
#: Relation name to predicate over (a, b); definitions by bounding box.
SPATIAL = {
    "contains": contains,
    "equals": alike,
    "intersects": shares,
    "within": lambda a, b: contains(b, a) & ~same(a, b),
    "covers": contains,
    "beside": lambda a, b: left(a, b) | right(a, b),
    "disjoint": lambda a, b: ~shares(a, b),
    "overlaps": shares,
    "above": above,
    "below": below,
    "left": left,
    "right": right,
    "crosses": shares,
    "touches": touches,
}
#: The older meaning of some: no common axis stands for intersection, and covers is covered-by.
COMPATIBLE = SPATIAL | {"intersects": orthogonal, "overlaps": orthogonal, "crosses": orthogonal, "disjoint": lambda a, b: ~orthogonal(a, b), "covers": lambda a, b: contains(b, a)}


def interval(name: str, s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """The temporal relation of two intervals; false where an end is null."""
    test = {
        "after": s1 >= e2,
        "precedes": e1 < s2,
        "finishes": (e1 == e2) & (s1 > s2),
        "meets": (s1 == e2) | (e1 == s2),
        "starts": (s1 == s2) & (e1 < e2),
        "contains": (s1 < s2) & (e1 > e2),
        "equals": (s1 == s2) & (e1 == e2),
        "overlaps": ((s1 < s2) & (s2 < e1) & (e1 < e2)) | ((s2 < s1) & (s1 < e2) & (e2 < e1)),
    }[name]
    return F.coalesce(test, F.lit(False))


TEMPORAL = ("after", "precedes", "finishes", "meets", "starts", "contains", "equals", "overlaps")
