"""Segment metadata: lines of 24 whole numbers and a quoted name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The numbers of a line, in order, and the parts of names that mean no neuron.
NUMBERS = (
    "nr flags r1 g1 b1 p1 r2 g2 b2 p2 anchor_x anchor_y anchor_z parent child prev next collapsed "
    "bbox_x1 bbox_y1 bbox_z1 bbox_x2 bbox_y2 bbox_z2"
).split()
ORGANELLES = ("phagosome",)


def label(name: Column) -> Column:
    """The name without its ``_<id>.swc`` or ``.swc`` tail and without brackets around it."""
    bare = F.trim(F.regexp_replace(F.trim(name), r"(_\d+)?\.swc$", ""))
    return F.trim(F.regexp_replace(bare, r"^\[(.*)\].*$", "$1"))


def parsed(lines: DataFrame) -> DataFrame:
    """One row per well-formed line; comments, blank and short lines drop out."""
    text = F.trim("line")
    rows = lines.select(text.alias("t")).filter("t <> '' and not startswith(t, '%') and instr(t, '\"') > 0")
    head = F.split(F.trim(F.substring_index("t", '"', 1)), r"\s+")
    name = F.regexp_replace(F.expr("substring(t, instr(t, '\"'))"), r'^"+|"+$', "")
    rows = rows.select(head.alias("h"), F.trim(name).alias("name")).filter(F.size("h") >= len(NUMBERS))
    numbers = [F.expr(f"try_cast(h[{k}] as bigint)").alias(c) for k, c in enumerate(NUMBERS)]
    out = rows.select(*numbers, "name", label(F.col("name")).alias("label"), F.startswith("name", F.lit("[")).alias("bracketed"))
    tail = F.expr(r"try_cast(nullif(regexp_extract(name, '_(\\d+)\\.swc$', 1), '') as bigint)")
    organelle = F.lower("label").rlike("|".join(ORGANELLES))
    kind = F.when(F.col("nr") == 0, "background").when(organelle, "organelle").otherwise("neuron")
    return out.withColumn("skeleton_id", tail).withColumn("kind", kind)


def find(segments: DataFrame, query: str) -> DataFrame:
    """Segments whose label or name contains the text, in any case; the text is no pattern."""
    q = F.lit(query.lower())
    return segments.filter(F.lower("label").contains(q) | F.lower("name").contains(q))


def bbox(segments: DataFrame, scale: int) -> DataFrame:
    """Bounding boxes in pixels of a mask that is ``scale`` times smaller, and the range of z."""
    corners = [F.expr(f"bbox_{c} div {scale}").alias(c) for c in ("x1", "y1", "x2", "y2")]
    return segments.select("nr", *corners, F.col("bbox_z1").alias("z1"), F.col("bbox_z2").alias("z2"))
