"""Drift of a registration along the stack: how far registered nodes lie from the masks that followed them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelframe.operators import graph
from voxelframe.operators.quantiles import quantiles

KEY = ["neuron", "chain_idx", "z"]
#: A registration drifts when sections' common offset grows with the distance (correlation) and is large at the far end (pixels).
GROWS, FAR_OFFSET = 0.4, 15.0


def offsets(signals: DataFrame, nodes: DataFrame, states: DataFrame, scale: int, fit_z: int) -> DataFrame:
    """One row per frame of a chain that has a mask and nodes: from the mask's centroid to the mean of the
    chain's registered nodes on the section (offx, offy, dist), zoff from the section of the fit, whether the
    frame is of a second pass (tier2), and contained.

    ``signals`` are neuron, chain_idx, z, cx, cy, contained in the space of the mask: that of the model, or of
    the crop that the chain's state (neuron, chain_idx, crop_window) names, which is mapped back.  ``nodes``
    are neuron, chain_idx, z, xs, ys in the model's space."""
    mean = nodes.filter("xs is not null and ys is not null").groupBy(*KEY).agg(F.avg("xs").alias("nx"), F.avg("ys").alias("ny"))
    at = signals.filter("cx is not null and cy is not null").join(mean, KEY)
    at = at.join(states.select(*KEY[:2], "crop_window"), KEY[:2], "left")
    w = F.col("crop_window")
    back = lambda c, k: F.when(w.isNull(), F.col(c)).otherwise((F.col(c) * w["crop_scale"] + w["origin_tif"][k]) / scale)
    at = at.withColumns({"offx": F.col("nx") - back("cx", 0), "offy": F.col("ny") - back("cy", 1)})
    return at.select(*KEY, "offx", "offy", F.hypot("offx", "offy").alias("dist"), (F.col("z") - fit_z).alias("zoff"), w.isNotNull().alias("tier2"), "contained")


def _common() -> Column:
    return F.hypot(F.avg("offx"), F.avg("offy"))


def _corr(a: str, b: str) -> Column:
    """Correlation; null where either does not vary."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def bins(rows: DataFrame, width: int = 40) -> DataFrame:
    """Per bin of sections from the fit: n, the mean offset's length (common), the mean length, their ratio (near 1
    where all chains are off alike) and the share of frames known to contain their skeleton."""
    held = F.avg(F.coalesce(F.col("contained"), F.lit(False)).cast("int"))
    g = rows.groupBy((F.floor(F.col("zoff") / width) * width).alias("bin")).agg(
        F.count("*").alias("n"), F.avg("offx").alias("mean_x"), F.avg("offy").alias("mean_y"), _common().alias("common"), F.avg("dist").alias("mean_dist"), held.alias("contained"))
    return g.withColumn("coherence", F.col("common") / F.greatest("mean_dist", F.lit(1e-6)))


def report(rows: DataFrame, far: int = 30, least: int = 3) -> DataFrame:
    """One row: frames, chains; median and 90 % of the distances, and their median by pass; correlation of the
    distance with zoff (r_dist), and of the common offset of sections of ``least`` chains or more (r_common,
    null for three sections or fewer); the common offset of the last ``far`` sections; and whether it drifts."""
    rows = graph.cut(rows)
    whole = rows.agg(
        F.count("*").alias("n"), F.countDistinct("neuron", "chain_idx").alias("n_chains"), F.avg("dist").alias("mean"),
        F.avg(F.coalesce(F.col("contained"), F.lit(False)).cast("int")).alias("contained"), _corr("zoff", "dist").alias("r_dist"), F.max("z").alias("last"),
    )
    sections = rows.groupBy("z").agg(F.count("*").alias("k"), _common().alias("common")).filter(F.col("k") >= least)
    sections = sections.agg(F.count("*").alias("n_sections"), _corr("z", "common").alias("r_common"))
    sections = sections.withColumn("r_common", F.when(F.col("n_sections") > 3, F.col("r_common")))
    end = rows.crossJoin(F.broadcast(whole.select("last"))).filter(F.col("z") >= F.col("last") - far).agg(_common().alias("far_common"))  # one row
    tiers = quantiles(rows, "dist", ["tier2"], [0.5])
    tier = lambda second, name: F.max(F.when(F.col("tier2") == second, F.col("q0"))).alias(name)
    one = whole.crossJoin(sections).crossJoin(end).crossJoin(quantiles(rows, "dist", [], [0.5, 0.9]).select(F.col("q0").alias("median"), F.col("q1").alias("p90")))
    one = one.crossJoin(tiers.agg(tier(True, "median_crop"), tier(False, "median_full")))  # one row each
    return one.drop("last").withColumn("drifts", F.coalesce((F.col("r_common") > GROWS) & (F.col("far_common") > FAR_OFFSET), F.lit(False)))
