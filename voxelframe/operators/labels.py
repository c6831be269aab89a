"""Frame labels: building and checking rows, samples of un-flagged frames, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FRAME = ["neuron", "chain_idx", "z"]
VERDICTS, ROLES = ("ok", "wrong"), ("anchor", "flagged", "sampled", "corrected")


def role(is_anchor: Column, flagged: Column) -> Column:
    """What a labelled frame was shown for."""
    return F.when(is_anchor, "anchor").when(flagged, "flagged").otherwise("sampled")


def checked(rows: DataFrame) -> DataFrame:
    """The rows; one with an unknown verdict or role stops the job."""
    known = F.col("verdict").isin(*VERDICTS) & F.col("role").isin(*ROLES)
    bad = F.raise_error(F.lit("unknown verdict or role"))
    return rows.withColumn("verdict", F.when(F.coalesce(known, F.lit(False)), F.col("verdict")).otherwise(bad))


def with_signals(rows: DataFrame, flagged: DataFrame) -> DataFrame:
    """Adds the frame's signals and whether the rule flagged it; null where the frame is not known."""
    signals = flagged.select(*FRAME, "area", "flag_count", "area_ratio")
    return rows.join(signals, FRAME, "left").withColumn("rule_flagged", F.col("flag_count") >= 1)


def latest(rows: DataFrame) -> DataFrame:
    """The last row per frame."""
    others = [c for c in rows.columns if c not in FRAME]
    last = F.max_by(F.struct(*others), F.struct("ts", "seq")).alias("r")
    return rows.groupBy(*FRAME).agg(last).select(*FRAME, *(F.col(f"r.{c}").alias(c) for c in others))


def sample_unflagged(flagged: DataFrame, n: int, seed: int, exclude: DataFrame | None = None) -> DataFrame:
    """At most n un-flagged frames per chain, in an order mixed from the seed, the chain and the section, so that
    chains draw different sections; a null flag is none."""
    free = flagged.filter("coalesce(flag, false) = false")
    if exclude is not None:
        free = free.join(exclude.select(*FRAME), FRAME, "left_anti")
    mix = F.md5(F.concat_ws(":", *FRAME, F.lit(str(seed))))
    order = Window.partitionBy("neuron", "chain_idx").orderBy(mix, "z")
    picked = free.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= n)
    return picked.select(*FRAME, F.lit("ok").alias("verdict"), F.lit("sampled").alias("role"))


def summary(rows: DataFrame) -> DataFrame:
    """Labels by role and verdict, with the number of chains they cover."""
    return rows.groupBy("role", "verdict").agg(F.count("*").alias("n"), F.countDistinct("neuron", "chain_idx").alias("n_chains"))


def expanded(actions: DataFrame, queued: DataFrame, frames: DataFrame, n: int = 8, seed: int = 0) -> DataFrame:
    """Labels that reviews of chains stand for.  ``actions`` are neuron, chain_idx, action (approve or reject),
    error_type and anchor_z; ``queued`` are frames shown for review; ``frames`` are the chains' frames with flag.

    Every queued frame of the chain is labelled ok or wrong, as anchor or flagged, and wrong ones have the
    error type.  Besides, n frames that were neither queued nor flagged are labelled ok, so that labels
    tell of silent errors too; a chain of which nothing was queued has only those."""
    verdict = F.when(F.col("action") == "approve", "ok").when(F.col("action") == "reject", "wrong")
    verdict = F.coalesce(verdict, F.raise_error(F.lit("an action is neither approve nor reject")))
    acts = actions.withColumn("verdict", verdict)
    shown = queued.select(*FRAME).distinct().join(acts, ["neuron", "chain_idx"])
    of = F.when(F.col("z") == F.col("anchor_z"), "anchor").otherwise("flagged")
    error = F.when(F.col("verdict") == "wrong", F.col("error_type"))
    shown = shown.select(*FRAME, "verdict", of.alias("role"), error.alias("error_type"), F.col("action").alias("source"))
    own = frames.join(acts.select("neuron", "chain_idx").distinct(), ["neuron", "chain_idx"], "left_semi")
    silent = sample_unflagged(own, n, seed, exclude=queued)
    none = F.lit(None).cast("string")
    return checked(shown.unionByName(silent.select(*FRAME, "verdict", "role", none.alias("error_type"), F.lit("sample").alias("source"))))
