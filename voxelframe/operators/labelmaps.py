"""Scores of a labelmap: masks of all neurons in one map, against the truth's map and along skeletons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.operators import graph, masks, metrics, registration, skeletons


def sampled(nodes: DataFrame, fit: DataFrame, runs: DataFrame, radius: int = 2) -> DataFrame:
    """The nodes with the label of the map where the registration puts them: the one that most pixels around
    have, 0 for the background, beyond the map and on sections without a map.  ``runs`` are slice, label, y, x0, x1
    of the map, which has one label a pixel; ``fit`` is in its pixels, a row per section."""
    at = registration.applied(nodes.drop("label"), fit, "x", "y")
    pixel = lambda c, name: F.bround(c).cast("long").alias(name)
    points = at.select(F.col("node_id").alias("id"), F.bround("z").cast("long").alias("slice"), pixel("rx", "px"), pixel("ry", "py"))
    found = masks.labels_at(points, runs.withColumnRenamed("label", "neuron"), F.col("neuron"), radius)
    return nodes.drop("label").join(found.withColumnRenamed("id", "node_id"), "node_id")


def run_length(nodes: DataFrame, fit: DataFrame, runs: DataFrame, *by: str, radius: int = 2, **tolerance) -> DataFrame:
    """Expected run length of the map along the skeletons, over all or ``by`` neuron."""
    classes = skeletons.classified(sampled(nodes, fit, runs, radius), **tolerance)
    return skeletons.run_lengths(classes, skeletons.runs(classes), *by)


def against_ceiling(nodes: DataFrame, fit: DataFrame, runs: DataFrame, radius: int = 2, **tolerance) -> DataFrame:
    """Per neuron, in micrometres: its run length along the map, the ceiling, which labels that equal the neurons
    would reach (the length of its edges), the share of it, and how many of its nodes lie on any label."""
    on = graph.cut(sampled(nodes, fit, runs, radius))
    classes = skeletons.classified(on, **tolerance)
    own = skeletons.run_lengths(classes, skeletons.runs(classes), "cell_name").select("cell_name", "erl")
    # Each neuron here is one tree, so under perfect labels all of its edges are one run.
    whole = classes.groupBy("cell_name").agg(F.sum("length").alias("ceiling"))
    hit = on.groupBy("cell_name").agg(F.avg((F.col("label") != 0).cast("int")).alias("hit"))
    um = lambda c, name: F.round(F.col(c) / 1000, 3).alias(name)
    share = F.round(F.try_divide(100 * F.col("erl"), F.col("ceiling")), 2).alias("pct_of_ceiling")
    return own.join(whole, "cell_name").join(hit, "cell_name").select("cell_name", um("erl", "erl_um"), um("ceiling", "ceiling_um"), share, F.round("hit", 6).alias("on_segment"))


def report(pred: DataFrame, truth: DataFrame, nodes: DataFrame, fit: DataFrame, label, radius: int = 2, **tolerance) -> DataFrame:
    """One row.  Masks that claim a pixel twice are counted, and the first neuron has it; pixels of the truth's
    foreground, with the background of the map as a segment of its own, give the variation of information and the
    adapted Rand error; nodes sampled from the map give the run length.  ``label`` numbers the neurons from 1."""
    composite, whole = masks.composite(pred), masks.composite(truth)
    theirs = whole.select("slice", "y", F.col("neuron").alias("gt"), F.col("x0").alias("t0"), F.col("x1").alias("t1"))
    both = masks.met(composite, theirs, ["slice", "y"], "t0", "t1")
    n = F.col("x1") - F.col("x0")
    on = both.groupBy(F.col("neuron").alias("seg"), "gt").agg(F.sum(F.least("x1", "t1") - F.greatest("x0", "t0")).alias("n"))
    all_ = whole.join(pred.select("slice").distinct(), "slice", "left_semi").groupBy(F.col("neuron").alias("gt")).agg(F.sum(n).alias("all"))
    rest = all_.join(on.groupBy("gt").agg(F.sum("n").alias("on")), "gt", "left").withColumn("n", F.col("all") - F.coalesce("on", F.lit(0)))
    table = graph.cut(on.unionByName(rest.filter("n > 0").select(F.lit("").alias("seg"), "gt", "n")))
    voi = metrics.variation_of_information(table).select("voi_split", "voi_merge")
    rand = metrics.adapted_rand(table).select("are", "split_error", "merge_error")
    lost = masks.collisions(pred).agg(F.coalesce(F.sum("collisions"), F.lit(0)).alias("collisions"))
    erl = run_length(nodes, fit, composite.withColumn("label", label).drop("neuron"), radius=radius, **tolerance).select("erl", "total_length")
    return erl.crossJoin(lost).crossJoin(voi).crossJoin(rand)  # one row each
