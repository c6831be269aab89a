"""Frame quality: signals, the flag rule, summaries, worst-first queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHAIN = ("neuron", "chain_idx")


def signals(frames: DataFrame) -> DataFrame:
    """area_ratio and temporal_iou against the previous row; NULL where either mask is empty."""
    w = Window.partitionBy(*CHAIN).orderBy("z")
    f = frames.withColumn("p_area", F.lag("area").over(w)).withColumn("p_x0", F.lag("x0").over(w))
    both = (F.col("area") > 0) & (F.col("p_area") > 0)
    shared = F.greatest(
        F.lit(0), F.least(F.col("x0") + F.col("area"), F.col("p_x0") + F.col("p_area")) - F.greatest("x0", "p_x0")
    )
    return f.withColumn("area_ratio", F.when(both, F.col("area") / F.col("p_area"))).withColumn(
        "temporal_iou", F.when(both, shared / (F.col("area") + F.col("p_area") - shared))
    ).drop("p_x0")


def flags(frames: DataFrame, pred_iou: float = 0.3, ratio=(0.5, 2.0), temporal: float = 0.3, queue_at: int = 2) -> DataFrame:
    """flag_count, flag, intervene (same as flag) and queue; a NULL signal abstains."""
    s = signals(frames)
    tests = (
        F.col("pred_iou") < pred_iou,
        (F.col("area_ratio") < ratio[0]) | (F.col("area_ratio") > ratio[1]),
        F.col("temporal_iou") < temporal,
        ~F.col("skeleton_contained"),
    )
    count = sum((F.coalesce(t, F.lit(False)).cast("int") for t in tests), F.lit(0))
    return (
        s.withColumn("flag_count", count)
        .withColumn("flag", F.col("flag_count") >= 1)
        .withColumn("intervene", F.col("flag_count") >= 1)
        .withColumn("queue", F.col("flag_count") >= queue_at)
    )


def summary(flagged: DataFrame) -> DataFrame:
    """One row per chain; a chain is flagged when any of its frames is queued.  The rate is rounded as the nearest
    whole number of ten-thousandths, as databases do; Spark's round goes by its printed digits, 57 / 800 up."""
    g = flagged.groupBy(*CHAIN).agg(
        F.count("*").alias("n_frames"),
        F.count_if("flag").alias("n_flagged"),
        F.count_if("queue").alias("n_queue"),
        F.count_if("intervene").alias("n_intervene"),
        F.count_if(~F.col("skeleton_contained")).alias("n_missing"),
        F.count_if(F.col("skeleton_contained").isNull()).alias("n_not_assessable"),
    )
    rate = F.round(F.col("n_flagged") / F.col("n_frames") * 10_000) / 10_000
    return g.withColumn("flag_rate", rate).withColumn("status", F.when(F.col("n_queue") >= 1, "flagged").otherwise("done"))


def worst(flagged: DataFrame, k: int = 10) -> DataFrame:
    """The k queued frames of each chain with most signals, then smallest z."""
    w = Window.partitionBy(*CHAIN).orderBy(F.desc("flag_count"), "z")
    return flagged.filter("queue").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def reasons(ratio=(0.5, 2.0), temporal: float = 0.3, pred_iou: float = 0.5) -> Column:
    """Tags of the signals of a frame, with their values; decimal ties go to the even digit."""
    area, overlap, score = (F.col(c) for c in ("area_ratio", "temporal_iou", "pred_iou"))
    tags = F.array(
        F.when(~F.col("skeleton_contained"), "noskel"),
        F.when((area < ratio[0]) | (area > ratio[1]), F.format_string("area x%.1f", F.bround(area, 1))),
        F.when(overlap < temporal, F.format_string("tIoU %.2f", F.bround(overlap, 2))),
        F.when(score < pred_iou, F.format_string("pIoU %.2f", F.bround(score, 2))),
    )
    return F.array_join(F.array_compact(tags), " ")


def failure(flagged: DataFrame) -> DataFrame:
    """Per chain the frame of most signals, that of the ratio furthest from 1 and that of the biggest jump
    of area against the area before plus one; the earliest on ties, -1 where no frame has the signal."""
    jump = F.abs(F.col("area") - F.col("p_area")) / (F.col("p_area") + 1)
    f = flagged.withColumn("jump", jump)
    at = lambda by: F.coalesce(F.max_by("z", F.when(by.isNotNull(), F.struct(by, -F.col("z")))), F.lit(-1))
    return f.groupBy(*CHAIN).agg(
        at(F.col("flag_count")).alias("flag_z"), at(F.abs(F.col("area_ratio") - 1)).alias("ratio_z"),
        at(F.col("jump")).alias("jump_z"), F.round(F.max("jump"), 9).alias("jump"),
    )
