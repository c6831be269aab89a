"""Forests and graphs by pointer doubling: a few joins, never a walk node by node."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows to the checkpoint folder that all executors share and goes on from there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def tops(links: DataFrame) -> DataFrame:
    """node, top and depth of a forest given as node, up: a node without up, or whose up is no node, is a top.
    Each round doubles the way that a pointer spans, so the rounds are the logarithm of the depth.  A pointer that
    has come to its top leaves the loop: it is only looked up from then on, and no longer dealt by its top,
    which a whole tree may share."""
    known = links.select(F.col("node").alias("up"), F.lit(1).alias("known"))
    at = links.join(known, "up", "left")
    at = cut(at.select("node", F.when(F.col("known") == 1, F.col("up")).otherwise(F.col("node")).alias("top"), F.coalesce("known", F.lit(0)).cast("long").alias("depth")))
    done, open_, hung = at.filter("depth = 0"), at.filter("depth > 0"), None
    while True:
        # Pointers of all nodes that are no tops: those under way, and those at their end.
        look = open_ if hung is None else open_.unionByName(hung)
        look = look.select(F.col("node").alias("top"), F.col("top").alias("over"), F.col("depth").alias("more"))
        step = open_.join(look, "top", "left").select("node", F.coalesce("over", "top").alias("top"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("over").isNotNull().alias("moved"))
        step = cut(step)
        arrived = step.filter("not moved").drop("moved")
        hung = arrived if hung is None else hung.unionByName(arrived)
        open_ = step.filter("moved").drop("moved")
        if open_.isEmpty():
            return done.unionByName(hung)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node and component (its least node) of an undirected graph: edges u, v; nodes may have none.
    Every node takes the least root around it, then roots hang under the least that their nodes saw."""
    both = cut(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    at = cut(nodes.select("node", F.col("node").alias("root")))
    while True:
        near = both.join(at.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("root").alias("low")).withColumnRenamed("u", "node")
        seen = at.join(near, "node", "left").select("node", "root", F.least("root", F.coalesce("low", "root")).alias("low"))
        hung = seen.groupBy("root").agg(F.min("low").alias("over"))
        moved = seen.join(hung, "root").select("node", F.col("root").alias("was"), F.least("low", "over").alias("root"))
        up = moved.select(F.col("node").alias("root"), F.col("root").alias("up"))
        at = cut(moved.join(up, "root").select("node", "was", F.col("up").alias("root")))
        if at.filter("was <> root").isEmpty():
            return at.select("node", F.col("root").alias("component"))
        at = at.drop("was")
