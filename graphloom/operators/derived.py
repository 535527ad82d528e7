"""Derived relations: facts that are computed once for each node that lacks them, and then stored.

`derive(quads, objects, name)` gives the new quads of one relation for all nodes that lack it; `objects` has the stored
contents (s, mime, content). Relations that need a model are hooks: a function from a list of contents to a list of values,
set by `set_model`, called on Arrow batches; without one they derive nothing.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import terms
from graphloom.operators.relations import DERIVED, SCHEMA, SEGMENT_BOUNDS, SEGMENT_OF
from graphloom.sources.files import of_predicates

NLP = "http://graphloom.example/nlp#"
#: Relations with a model: kind of their value.
MODELS = {"clipEmbedding": "vector", "siglipEmbedding": "vector", "ocr": "string", "documentModelJson": "string"}
_models: dict[str, Callable[[list[bytes]], list]] = {}


def set_model(name: str, model: Callable[[list[bytes]], list] | None) -> None:
    """The function behind a relation of MODELS; None takes it away."""
    if name not in MODELS:
        raise ValueError(f"no such relation: {name}")
    _models.pop(name, None)
    if model is not None:
        _models[name] = model


def lacking(quads: DataFrame, objects: DataFrame, predicate: str) -> DataFrame:
    """The objects without the relation."""
    return objects.join(of_predicates(quads, [predicate]).select("s"), "s", "left_anti")


def derive(quads: DataFrame, objects: DataFrame, name: str) -> DataFrame:
    """New quads of a relation, one row for each node (or part of it) that lacks it."""
    predicate = f"<{DERIVED}{name}>"
    rest = lacking(quads, objects, predicate)
    if name in MODELS:
        return _modelled(rest, predicate, name)
    if name == "averageColor":
        return _colors(rest, predicate)
    if name == "text":
        return texts(rest, predicate)
    if name == "page":
        return pages(quads, rest, predicate)
    if name in ("figure", "table", "paragraph"):
        return document_parts(quads, predicate, name)
    raise ValueError(f"no such relation: {name}")


def materialized(quads: DataFrame, objects: DataFrame, name: str) -> DataFrame:
    """The quads with those of the relation added."""
    return quads.select("s", "p", "o").unionByName(derive(quads, objects, name)).dropDuplicates()


def _modelled(rest: DataFrame, predicate: str, name: str) -> DataFrame:
    model, kind = _models.get(name), MODELS[name]
    if model is None:
        return rest.select("s", F.lit(predicate).alias("p"), F.lit(None).cast("string").alias("o")).limit(0)

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        made = model([bytes(b) for b in x])
        return pd.Series([None if v is None else "[" + ", ".join(map(repr, map(float, v))) + "]^^FloatVector" if kind == "vector" else f"{v}^^String" for v in made])

    own = rest if name == "documentModelJson" else rest.where(F.col("mime").startswith("image/"))
    own = own.where("mime = 'application/pdf'") if name == "documentModelJson" else own
    return own.where("content IS NOT NULL").select("s", F.lit(predicate).alias("p"), run("content").alias("o")).where("o IS NOT NULL")


def png_pixels(data: bytes) -> np.ndarray | None:
    """Rows, columns and RGBA of a PNG with 8 bits a channel, not interlaced; None for other files."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    at, head, palette, clear, packed = 8, None, None, b"", []
    while at + 8 <= len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    if head is None or head[2] != 8 or head[6] or head[3] not in (0, 2, 3, 4, 6):
        return None
    width, height, channels = head[0], head[1], {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[head[3]]
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    except zlib.error:
        return None
    if len(raw) != height * (1 + width * channels):
        return None
    lines = raw.reshape(height, 1 + width * channels)
    out, before = np.zeros((height, width * channels), np.uint8), np.zeros(width * channels, np.int64)
    for y in range(height):
        kind, line = int(lines[y, 0]), lines[y, 1:].astype(np.int64)
        if kind in (0, 2):
            line = (line + (before if kind else 0)) & 255
        else:
            for x in range(len(line)):
                a, b, c = (line[x - channels] if x >= channels else 0), before[x], (before[x - channels] if x >= channels else 0)
                if kind == 1:
                    near = a
                elif kind == 3:
                    near = (a + b) // 2
                else:
                    near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                line[x] = (line[x] + near) & 255
        out[y] = before = line
    v = out.reshape(height, width, channels)
    rgba = np.full((height, width, 4), 255, np.uint8)
    if head[3] == 3:
        if palette is None or v.max(initial=0) >= len(palette):
            return None
        rgba[..., :3] = palette[v[..., 0]]
        alpha = np.full(256, 255, np.uint8)
        alpha[: len(clear)] = np.frombuffer(clear, np.uint8)
        rgba[..., 3] = alpha[v[..., 0]]
    else:
        rgba[..., :3] = v[..., :3] if channels >= 3 else v[..., :1]
        if channels in (2, 4):
            rgba[..., 3] = v[..., -1]
    return rgba


def average_color(rgba: np.ndarray) -> list[float]:
    """The mean colour from 0 to 1, each pixel weighing as much as it is opaque."""
    p = rgba.reshape(-1, 4).astype(float) / 255
    return ((p[:, :3] * p[:, 3:]).sum(axis=0) / max(p[:, 3].sum(), 1.0)).tolist()


def _colors(rest: DataFrame, predicate: str) -> DataFrame:
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        found = [png_pixels(bytes(b)) for b in x]
        return pd.Series([None if r is None else "[" + ", ".join(map(repr, average_color(r))) + "]^^FloatVector" for r in found])

    own = rest.where("mime = 'image/png' AND content IS NOT NULL")
    return own.select("s", F.lit(predicate).alias("p"), run("content").alias("o")).where("o IS NOT NULL")


def average_colors(pixels: DataFrame) -> DataFrame:
    """The same for pixels as rows (image, r, g, b, alpha; 0 to 1): image and the mean of each channel."""
    weight = F.greatest(F.sum("alpha"), F.lit(1.0))
    return pixels.groupBy("image").agg(*[(F.sum(F.col(c) * F.col("alpha")) / weight).alias(c) for c in "rgb"])


def texts(rest: DataFrame, predicate: str = f"<{DERIVED}text>") -> DataFrame:
    """The content of text files, as UTF-8 with bad bytes replaced."""
    own = rest.where(F.col("mime").startswith("text/") & F.col("content").isNotNull())
    return own.select("s", F.lit(predicate).alias("p"), terms.string(F.decode("content", "UTF-8")).alias("o"))


def pages(quads: DataFrame, rest: DataFrame, predicate: str = f"<{DERIVED}page>") -> DataFrame:
    """For each PDF a segment of each page, by the time bounds of the object (first page, page after the last): the relation
    to it and its own facts."""
    span = F.split(terms.lexical(F.col("o")), ",")
    held = of_predicates(quads, [f"<{SCHEMA}bounds>"]).select("s", F.get(span, F.lit(6)).try_cast("double").cast("long").alias("a"), F.get(span, F.lit(7)).try_cast("double").cast("long").alias("b"))
    one = rest.where("mime = 'application/pdf'").select("s").join(held.where("b > a"), "s").select("s", F.explode(F.sequence(F.col("a"), F.col("b") - 1)).alias("n"))
    label = F.concat(F.col("n").cast("string"), F.lit("-"), (F.col("n") + 1).cast("string"))
    node = F.concat(F.regexp_replace("s", ">$", "/segment/page/"), label, F.lit(">"))
    at = F.concat(F.lit("-,-,-,-,-,-,"), F.col("n").cast("double").cast("string"), F.lit(","), (F.col("n") + 1).cast("double").cast("string"))
    facts = F.array(
        F.struct(F.col("s").alias("s"), F.lit(predicate).alias("p"), node.alias("o")),
        F.struct(node.alias("s"), F.lit(SEGMENT_OF).alias("p"), F.col("s").alias("o")),
        F.struct(node.alias("s"), F.lit(f"<{SCHEMA}segmentType>").alias("p"), terms.string(F.lit("page")).alias("o")),
        F.struct(node.alias("s"), F.lit(f"<{SCHEMA}segmentDefinition>").alias("p"), terms.string(label).alias("o")),
        F.struct(node.alias("s"), F.lit(SEGMENT_BOUNDS).alias("p"), terms.string(at).alias("o")),
    )
    return one.select(F.explode(facts).alias("e")).select("e.s", "e.p", "e.o")


_PROV = "array<struct<page_no: long, bbox: struct<l: double, t: double, r: double, b: double>>>"
_CELL = "struct<start_row_offset_idx: int, start_col_offset_idx: int, text: string>"
_ITEM = f"struct<self_ref: string, label: string, text: string, prov: {_PROV}, captions: array<struct<`$ref`: string>>, data: struct<table_cells: array<{_CELL}>>>"
_LIST = {"figure": "pictures", "table": "tables", "paragraph": "texts"}


def document_parts(quads: DataFrame, predicate: str, name: str) -> DataFrame:
    """The figures, tables or paragraphs that a document's model (JSON of the relation documentModelJson) lists: each a
    rectangle on a page, with its reference, page, label, text (of a table: its cells as comma-separated rows) and the
    paragraph that is its caption. Items without a place are left out."""
    held = of_predicates(quads, [f"<{DERIVED}documentModelJson>"]).select(F.col("s").alias("doc"), terms.lexical(F.col("o")).alias("json"))
    rest = held.join(of_predicates(quads, [predicate]).select(F.col("s").alias("doc")), "doc", "left_anti")
    item = rest.select("doc", F.explode(F.from_json("json", f"struct<{_LIST[name]}: array<{_ITEM}>>")[_LIST[name]]).alias("i"))
    place = F.get("i.prov", F.lit(0))
    box = [place["bbox"][k].cast("string") for k in ("l", "r", "b", "t")]
    rect = F.concat_ws(",", *box)
    page = place["page_no"].cast("string")
    node = F.concat(F.regexp_replace("doc", ">$", "/segment/page/"), page, F.lit("/segment/rect/"), rect, F.lit(">"))
    cells = F.array_sort(F.col("i.data.table_cells"))
    rows = F.transform(
        F.array_distinct(F.transform(cells, lambda c: c["start_row_offset_idx"])),
        lambda r: F.array_join(F.transform(F.filter(cells, lambda c: c["start_row_offset_idx"] == r), lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c["text"], F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))), ","),
    )
    content = F.array_join(rows, "\n") if name == "table" else F.col("i.text")
    caption = F.get("i.captions", F.lit(0))["$ref"]
    fact = lambda p, o, s=node: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    text = lambda x: F.when(x.isNotNull(), terms.string(x))
    facts = F.array(
        fact(predicate, node, F.col("doc")), fact(SEGMENT_OF, F.col("doc")), fact(f"<{SCHEMA}segmentType>", terms.string(F.lit("rect"))), fact(f"<{SCHEMA}segmentDefinition>", terms.string(rect)),
        fact(SEGMENT_BOUNDS, terms.string(F.concat(rect, F.lit(",-,-,-,-")))), fact(f"<{NLP}page>", terms.long(place["page_no"])), fact(f"<{NLP}reference>", text(F.col("i.self_ref"))), fact(f"<{NLP}label>", text(F.col("i.label"))),
        fact(f"<{NLP}text>", text(content)), fact(f"<{NLP}captionReference>", text(caption)),
    )
    return item.where(place.isNotNull()).select(F.explode(facts).alias("e")).select("e.s", "e.p", "e.o").where("o IS NOT NULL").distinct()


def captions(quads: DataFrame) -> DataFrame:
    """The quads that link a part to the paragraph its caption's reference names, within one document."""
    of = of_predicates(quads, [SEGMENT_OF]).select("s", F.col("o").alias("doc"))
    wanted = of_predicates(quads, [f"<{NLP}captionReference>"]).select("s", F.col("o").alias("ref")).join(of, "s")
    named = of_predicates(quads, [f"<{NLP}reference>"]).select(F.col("s").alias("o"), F.col("o").alias("ref")).join(of.withColumnRenamed("s", "o"), "o")
    return wanted.join(named, ["doc", "ref"]).select("s", F.lit(f"<{NLP}caption>").alias("p"), "o").distinct()


def mesh_bounds(objects: DataFrame) -> DataFrame:
    """The bounds quads of mesh files in OBJ form, from their vertex lines; nothing for files without any."""
    lines = objects.where("mime = 'model/obj' AND content IS NOT NULL").select("s", F.explode(F.split(F.decode("content", "UTF-8"), r"\r?\n")).alias("line"))
    part = F.split(F.trim("line"), r"\s+")
    v = lines.where(F.trim("line").startswith("v ")).select("s", *[F.get(part, F.lit(k + 1)).try_cast("double").alias(c) for k, c in enumerate("xyz")]).where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
    ends = [f(c).cast("string") for c in "xyz" for f in (F.min, F.max)]
    made = v.groupBy("s").agg(F.concat_ws(",", *ends, F.lit("-"), F.lit("-")).alias("b"))
    return made.select("s", F.lit(f"<{SCHEMA}bounds>").alias("p"), terms.string(F.col("b")).alias("o"))


def statistics(samples: DataFrame, value: str, *keys: str) -> DataFrame:
    """Of each group: count, min, max, mean, median, p95, p99 (linear interpolation), population standard deviation."""
    q = lambda p: F.percentile(value, F.lit(p))
    return samples.groupBy(*keys).agg(
        F.count(value).alias("count"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), q(0.5).alias("median"), q(0.95).alias("p95"), q(0.99).alias("p99"), F.stddev_pop(value).alias("std")
    )


def log_log_slope(samples: DataFrame, x: str, y: str) -> DataFrame:
    """The slope of log y over log x by least squares: one row. Pairs that aren't both positive are left out."""
    return samples.where((F.col(x) > 0) & (F.col(y) > 0)).agg(F.regr_slope(F.log10(y), F.log10(x)).alias("slope"))
