"""Annotation XML of images: objects with upright boxes (bndbox) or rotated ones (robndbox: centre, size, angle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPRIGHT, ROTATED = ("xmin", "ymin", "xmax", "ymax"), ("cx", "cy", "w", "h", "angle")
SCHEMA = (
    "object ARRAY<STRUCT<type: STRING, name: STRING, truncated: INT, difficult: INT, "
    f"bndbox: STRUCT<{', '.join(f'{c}: DOUBLE' for c in UPRIGHT)}>, robndbox: STRUCT<{', '.join(f'{c}: DOUBLE' for c in ROTATED)}>>>"
)


def _tag(name: str, body: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), body, F.lit(f"</{name}>"))


def _text(value: Column) -> Column:
    """A value as XML text."""
    s = value.cast("string")
    for mark, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        s = F.replace(s, F.lit(mark), F.lit(code))
    return F.coalesce(s, F.lit(""))


def voc_documents(objects: DataFrame, doc: str, order: str) -> DataFrame:
    """(doc, xml): one document of each doc's objects in their order. objects: name, truncated, difficult, and xmin … ymax, or cx, cy, w, h, angle.

    An object with an angle is written as robndbox, any other as bndbox.
    """
    numbers = lambda names: F.concat(*[_tag(c, _text(F.col(c))) for c in names])
    rotated = F.col("angle").isNotNull()
    box = F.when(rotated, _tag("robndbox", numbers(ROTATED))).otherwise(_tag("bndbox", numbers(UPRIGHT)))
    head = F.concat(_tag("type", F.when(rotated, "robndbox").otherwise("bndbox")), *[_tag(c, _text(F.col(c))) for c in ("name", "truncated", "difficult")])
    each = objects.select(doc, F.struct(F.col(order).alias("o"), _tag("object", F.concat(head, box)).alias("x")).alias("_s"))
    g = each.groupBy(doc).agg(F.array_sort(F.collect_list("_s")).alias("_s"))
    return g.select(doc, _tag("annotation", F.array_join(F.transform("_s", lambda s: s["x"]), "")).alias("xml"))


def voc_objects(documents: DataFrame, xml: str = "xml") -> DataFrame:
    """documents once per object: its place from 0, type, name, truncated, difficult, and corners x1, y1 … x4, y4.

    Corners of an upright box run from (xmin, ymin) by (xmax, ymin); those of a rotated one are turned by angle about the
    centre. Documents without objects, null and broken ones have no rows; an object without a box has null corners.
    """
    own = [F.col(c) for c in documents.columns if c != xml]
    o = documents.select(*own, F.posexplode(F.from_xml(F.col(xml), SCHEMA)["object"]).alias("place", "_o"))
    b, r = F.col("_o.bndbox"), F.col("_o.robndbox")
    cos, sin = F.cos(r["angle"]), F.sin(r["angle"])
    corners = []
    for k, (right, low) in enumerate(((-1, -1), (1, -1), (1, 1), (-1, 1)), 1):
        dx, dy = r["w"] * F.lit(right / 2), r["h"] * F.lit(low / 2)
        corners.append(F.coalesce(r["cx"] + dx * cos - dy * sin, b["xmax" if right > 0 else "xmin"]).alias(f"x{k}"))
        corners.append(F.coalesce(r["cy"] + dx * sin + dy * cos, b["ymax" if low > 0 else "ymin"]).alias(f"y{k}"))
    fields = [F.col(f"_o.{c}").alias(c) for c in ("type", "name", "truncated", "difficult")]
    return o.select(*own, "place", *fields, *corners)
