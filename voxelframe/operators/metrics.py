"""Scores of one labelling against another, from their joint histogram."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def contingency(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("seg", "gt").agg(F.count("*").alias("n"))


def _marginals(table: DataFrame) -> DataFrame:
    """Adds the totals of seg and gt: windows over the small table, which is aggregated once."""
    total = lambda c: F.sum("n").over(Window.partitionBy(c))
    return table.withColumn("n_seg", total("seg")).withColumn("n_gt", total("gt"))


def variation_of_information(table: DataFrame, merge_weight: float | None = None) -> DataFrame:
    """voi_split H(seg|gt), voi_merge H(gt|seg), in bits; 0 for no pixels.  With a weight also the cost in
    which a merge counts so many times a split."""
    m = _marginals(table)
    n = F.sum("n")
    part = lambda c: F.coalesce(F.greatest(F.lit(0.0), -F.sum(F.col("n") * F.log2(F.col("n") / F.col(c))) / n), F.lit(0.0))
    out = m.agg(part("n_gt").alias("s"), part("n_seg").alias("m"), F.coalesce(n, F.lit(0)).alias("n_pixels"))
    cost = [] if merge_weight is None else [F.round(merge_weight * F.col("m") + F.col("s"), 6).alias("weighted")]
    return out.select(F.round("s", 6).alias("voi_split"), F.round("m", 6).alias("voi_merge"), F.round(F.col("s") + F.col("m"), 6).alias("voi"), "n_pixels", *cost)


def adapted_rand(table: DataFrame) -> DataFrame:
    """Pairs together in both, in seg, in gt; precision, recall and the adapted Rand error.  Sums of
    pairs are decimals, as counts squared outgrow 64 bits."""
    pairs = lambda c: F.sum(F.col(c).cast("decimal(19,0)") * (F.col(c) - 1).cast("decimal(19,0)"))
    # A seg's total is counted on its first row only, and a gt's.
    first = lambda c, o: F.row_number().over(Window.partitionBy(c).orderBy(o)) == 1
    m = _marginals(table).withColumn("n_seg", F.when(first("seg", "gt"), F.col("n_seg"))).withColumn("n_gt", F.when(first("gt", "seg"), F.col("n_gt")))
    one = m.agg(pairs("n").alias("both"), pairs("n_seg").alias("seg_pairs"), pairs("n_gt").alias("gt_pairs"))
    p, r = (F.try_divide(F.col("both").cast("double"), F.col(c).cast("double")) for c in ("seg_pairs", "gt_pairs"))
    f = F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r"))
    r9 = lambda c, name: F.round(c, 9).alias(name)
    return one.withColumn("p", p).withColumn("r", r).select(
        F.col("both").cast("double").alias("pairs"), r9(F.col("p"), "precision"), r9(F.col("r"), "recall"), r9(f, "f_score"), r9(1 - f, "are"),
        r9(1 - F.col("r"), "split_error"), r9(1 - F.col("p"), "merge_error"),
    )
