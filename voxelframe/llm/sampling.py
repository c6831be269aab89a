"""Bounded samples of rows to train on, the same in every run and for every partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_SPAN = (1 << 31) - 1


def fold(doc_id: str, n: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % n


def bounded(rows: DataFrame, group: str, at_most: int) -> DataFrame:
    """doc_id and group of the ``at_most`` doc_ids of each group that come first by a hash; a repeated
    doc_id counts once, a null one never.  Ids are counted over all rows, to one per cent, which is the same for every
    partitioning; the cut leaves a quarter more of them and 50, so that the order alone decides.  Counts are
    broadcast: one row per group, and each group (a class or a language) has its own part of a model that
    the driver holds anyway."""
    rows = rows.filter("doc_id is not null").select("doc_id", group).withColumn("_h", F.pmod(F.xxhash64("doc_id"), F.lit(_SPAN)))
    counts = rows.groupBy(F.col(group).alias("_g")).agg(F.approx_count_distinct("doc_id", 0.01).alias("_n"))
    below = F.col("_h") * F.col("_n") <= F.lit(float(_SPAN)) * (1.25 * at_most + 50)
    near = rows.join(F.broadcast(counts), F.col(group).eqNullSafe(F.col("_g"))).filter(below).select("doc_id", group, "_h").distinct()
    nth = F.row_number().over(Window.partitionBy(group).orderBy("_h", "doc_id"))
    return near.withColumn("_nth", nth).filter(F.col("_nth") <= at_most).select("doc_id", group)


def texts_of(docs: DataFrame, chosen: DataFrame, text: Column) -> DataFrame:
    """The columns of ``chosen`` and a text for each of its doc_ids: of several texts the first by a hash.
    What is broadcast is a sample by ``bounded``: its bound per group, of short rows; so no text is shuffled
    but those of the sample."""
    found = docs.select("doc_id", F.struct(F.xxhash64("text").alias("h"), text.alias("text")).alias("_t"))
    one = found.join(F.broadcast(chosen), "doc_id").groupBy(*chosen.columns).agg(F.min("_t").alias("_t"))
    return one.select(*chosen.columns, "_t.text")


def added(df: DataFrame, made: Column, names: list[str]) -> DataFrame:
    """The fields of ``made`` as columns ``names`` at the end; columns that had these names are gone."""
    return df.select(*(df[c] for c in df.columns if c not in names), *(made[n].alias(n) for n in names))
