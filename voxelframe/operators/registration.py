"""Registration of sections: linear and affine least squares by sums of products, filling, smoothing, residuals.

Pairs are rows of z, sx, sy (skeleton) and gx, gy (truth).  A fit is one row of six parameters per section:
x = a*sx + b*sy + tx, y = c*sx + d*sy + ty.  What has a row per section is sent to the pairs, which stay where
they are: dealt by section, all pairs of one would meet in a task.  Sums are those of pairs centred on each section, for accuracy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelframe.operators import graph, masks
from voxelframe.operators.quantiles import quantiles

PARAMETERS = ("a", "b", "tx", "c", "d", "ty")
#: A pair is an outlier beyond this distance, or three medians if that is more.
OUTLIER = 40.0


def _solved(sums: DataFrame) -> DataFrame:
    """a, b, c, d from the sums of products of centred pairs; null where the points lie on a line."""
    det = F.col("xx") * F.col("yy") - F.col("xy") ** 2
    div = lambda e: F.try_divide(e, F.when(F.abs(det) > 1e-9, det))
    u = F.col
    return sums.withColumns({
        "a": div(u("gxx") * u("yy") - u("gxy") * u("xy")), "b": div(u("gxy") * u("xx") - u("gxx") * u("xy")),
        "c": div(u("gyx") * u("yy") - u("gyy") * u("xy")), "d": div(u("gyy") * u("xx") - u("gyx") * u("xy")),
    })


_PRODUCTS = {"xx": ("sx", "sx"), "yy": ("sy", "sy"), "xy": ("sx", "sy"), "gxx": ("gx", "sx"), "gxy": ("gx", "sy"), "gyx": ("gy", "sx"), "gyy": ("gy", "sy")}


def moments(pairs: DataFrame, *by: str) -> DataFrame:
    """Per section (or one row for all): n, the means m_* and the sums of products of the pairs centred on
    them, in one aggregate; the running covariances that it merges keep their accuracy far from the origin."""
    means = [F.avg(c).alias(f"m_{c}") for c in ("sx", "sy", "gx", "gy")]
    sums = [(F.covar_pop(p, q) * F.count("*")).alias(name) for name, (p, q) in _PRODUCTS.items()]
    return pairs.groupBy(*by).agg(F.count("*").alias("n"), *means, *sums)


def linear(pairs: DataFrame) -> DataFrame:
    """One row a, b, c, d: the linear part that all sections share."""
    return _solved(moments(pairs, "z").agg(*(F.sum(c).alias(c) for c in _PRODUCTS))).select("a", "b", "c", "d")


def offsets(pairs: DataFrame, model: DataFrame, least: int = 3) -> DataFrame:
    """Median residual per section after the linear part, where there are enough pairs."""
    r = pairs.crossJoin(F.broadcast(model))  # the model is one row
    rx, ry = F.col("gx") - F.col("a") * F.col("sx") - F.col("b") * F.col("sy"), F.col("gy") - F.col("c") * F.col("sx") - F.col("d") * F.col("sy")
    both = r.select("z", F.explode(F.array(F.struct(F.lit("tx").alias("name"), rx.alias("r")), F.struct(F.lit("ty").alias("name"), ry.alias("r")))).alias("p"))
    q = quantiles(both.select("z", "p.*"), "r", ["z", "name"], [0.5])
    of = lambda name: F.max(F.when(F.col("name") == name, F.col("q0"))).alias(name)
    return q.groupBy("z").agg(of("tx"), of("ty"), F.max("n").alias("n")).filter(F.col("n") >= least)


def _fit(pairs: DataFrame, *by: str) -> DataFrame:
    fit = _solved(moments(pairs, *by)).filter("n >= 4 and a is not null")
    return fit.select(
        *by, "n", "a", "b", (F.col("m_gx") - F.col("a") * F.col("m_sx") - F.col("b") * F.col("m_sy")).alias("tx"),
        "c", "d", (F.col("m_gy") - F.col("c") * F.col("m_sx") - F.col("d") * F.col("m_sy")).alias("ty"),
    )


def _by(fit: DataFrame) -> tuple[Column, Column]:
    """Where a fit, whose parameters are columns beside the pair's, puts the pair."""
    return F.col("a") * F.col("sx") + F.col("b") * F.col("sy") + F.col("tx"), F.col("c") * F.col("sx") + F.col("d") * F.col("sy") + F.col("ty")


def applied(rows: DataFrame, fit: DataFrame, x: str = "sx", y: str = "sy") -> DataFrame:
    """Adds rx, ry: the place in the truth's pixels by the section's fit; sections beyond the fitted ones take
    the nearest end."""
    ends = F.broadcast(fit.agg(F.min("z").alias("_lo"), F.max("z").alias("_hi")))  # one row
    at = rows.crossJoin(ends).withColumn("_z", F.greatest("_lo", F.least("_hi", F.bround("z").cast("long"))))
    at = at.join(F.broadcast(fit.select(F.col("z").alias("_z"), *PARAMETERS)), "_z")
    rx, ry = F.col("a") * F.col(x) + F.col("b") * F.col(y) + F.col("tx"), F.col("c") * F.col(x) + F.col("d") * F.col(y) + F.col("ty")
    return at.withColumn("rx", rx).withColumn("ry", ry).drop("_z", "_lo", "_hi", *PARAMETERS)


def residuals(pairs: DataFrame, fit: DataFrame) -> DataFrame:
    return applied(pairs, fit).withColumn("res", F.hypot(F.col("rx") - F.col("gx"), F.col("ry") - F.col("gy")))


def best(pairs: DataFrame, least: int = 4) -> DataFrame:
    """z, best: what each pair of a section with enough of them keeps under that section's own least squares, a
    lower bound for any affine per section.  Points on one line are fitted along it, which leaves no more."""
    sums = graph.cut(_solved(moments(pairs, "z")).filter(F.col("n") >= least))  # a row per section
    wide = F.col("xx") >= F.col("yy")
    along = lambda c, g, q, side: F.coalesce(c, F.when(side, F.try_divide(g, q)), F.lit(0.0))
    fit = sums.select(
        "z", *(f"m_{c}" for c in ("sx", "sy", "gx", "gy")),
        along(F.col("a"), F.col("gxx"), F.col("xx"), wide).alias("a"), along(F.col("b"), F.col("gxy"), F.col("yy"), ~wide).alias("b"),
        along(F.col("c"), F.col("gyx"), F.col("xx"), wide).alias("c"), along(F.col("d"), F.col("gyy"), F.col("yy"), ~wide).alias("d"),
    )
    u = {c: F.col(c) - F.col(f"m_{c}") for c in ("sx", "sy", "gx", "gy")}
    off = lambda p, q, v: F.col(p) * u["sx"] + F.col(q) * u["sy"] - u[v]
    return pairs.join(F.broadcast(fit), "z").select("z", F.hypot(off("a", "b", "gx"), off("c", "d", "gy")).alias("best"))


#: A residual is structured where the sections' own fits would lower its median by more than this share.
GAIN = 0.25


def diagnosis(pairs: DataFrame, fit: DataFrame) -> DataFrame:
    """One row.  coherence: median over sections of two pairs or more of the mean residual's length over the mean
    length, near 1 where sections are off as a whole.  median_model and median_best: of the residuals on sections
    of four pairs or more, under the fit and under each section's own; gain, the share that the latter would
    take off, and helps, whether that is worth it.  r_z: correlation of residual and section, null for five
    sections or fewer."""
    at = residuals(pairs, fit).select("z", "res", (F.col("rx") - F.col("gx")).alias("dx"), (F.col("ry") - F.col("gy")).alias("dy"))
    sections = graph.cut(at.groupBy("z").agg(F.count("*").alias("n"), (F.hypot(F.avg("dx"), F.avg("dy")) / F.greatest(F.avg("res"), F.lit(1e-6))).alias("coherence")))
    coherent = quantiles(sections.filter("n >= 2"), "coherence", [], [0.5]).select(F.col("q0").alias("coherence"))
    of = lambda df, c, kind: df.select(F.lit(kind).alias("kind"), F.col(c).alias("res"))
    many = at.join(F.broadcast(sections.filter("n >= 4").select("z")), "z", "left_semi")
    medians = quantiles(of(many, "res", "model").unionByName(of(best(pairs), "best", "best")), "res", ["kind"], [0.5])
    one = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("q0"))).alias(f"median_{kind}")
    gain = (F.col("median_model") - F.col("median_best")) / F.greatest("median_model", F.lit(1e-6))
    medians = medians.agg(one("model"), one("best")).withColumn("gain", gain).withColumn("helps", F.col("gain") > GAIN)
    r = F.try_divide(F.covar_pop("z", "res"), F.stddev_pop("z") * F.stddev_pop("res"))
    trend = at.agg(F.count("*").alias("n"), F.when(F.countDistinct("z") > 5, r).alias("r_z"))
    return trend.crossJoin(medians).join(coherent, F.lit(True), "left")  # one row each


def affine(pairs: DataFrame) -> DataFrame:
    """A fit per section of four pairs or more, with one round of rejecting outliers if four pairs stay."""
    first = graph.cut(_fit(pairs, "z"))  # a row per section; what follows reads it several times
    rx, ry = _by(first)
    res = pairs.join(F.broadcast(first.drop("n")), "z").withColumn("res", F.hypot(rx - F.col("gx"), ry - F.col("gy")))
    bound = quantiles(res, "res", ["z"], [0.5]).select("z", F.greatest(F.lit(OUTLIER), 3 * F.col("q0")).alias("bound"))
    kept = res.join(F.broadcast(bound), "z").filter("res <= bound").select(*pairs.columns)
    again = _fit(kept, "z").select("z", *(F.col(p).alias(f"{p}2") for p in PARAMETERS))
    both = first.join(again, "z", "left")
    return graph.cut(both.select("z", *(F.coalesce(f"{p}2", p).alias(p) for p in PARAMETERS)))


def correspondences(nodes: DataFrame, runs: DataFrame, segments: DataFrame, least: int = 1, spread: float = 400.0) -> DataFrame:
    """Pairs for a registration, one per section and label: z, label, n_nodes, sx, sy (mean of the label's nodes
    there) and gx, gy (centroid of its mask).

    ``nodes`` are label, z, x, y; ``runs`` are slice, segment, y, x0, x1; ``segments`` names the label of each
    segment, and a label's mask is the union of all of its segments.  Left out is where the pairing would be
    ambiguous: too few nodes, nodes in several places (sample spread beyond ``spread``), or a mask in more
    than one piece (pixels that meet at a corner only are apart)."""
    std = lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0))
    at = nodes.filter("x is not null and y is not null and z is not null").withColumn("z", F.col("z").cast("long"))
    at = at.groupBy("z", "label").agg(F.count("*").alias("n_nodes"), F.avg("x").alias("sx"), F.avg("y").alias("sy"), F.hypot(std("x"), std("y")).alias("spread"))
    at = at.filter((F.col("n_nodes") >= least) & (F.col("spread") <= spread)).drop("spread")
    own = runs.join(segments, "segment").select("slice", F.col("label").alias("neuron"), "y", "x0", "x1")
    own = own.join(at.select(F.col("z").alias("slice"), F.col("label").alias("neuron")), ["slice", "neuron"], "left_semi")
    whole = masks.labelled(masks.merged(own), corners=False)
    n = F.col("x1") - F.col("x0")
    mask = whole.groupBy(F.col("slice").alias("z"), F.col("neuron").alias("label")).agg(
        F.countDistinct("component").alias("pieces"),
        (F.sum(n * (F.col("x0") + F.col("x1") - 1)) / 2 / F.sum(n)).alias("gx"), (F.sum(n * F.col("y")) / F.sum(n)).alias("gy"),
    )
    return at.join(mask.filter("pieces = 1").drop("pieces"), ["z", "label"])


def filled(fit: DataFrame, low: int, high: int, columns=PARAMETERS) -> DataFrame:
    """A row per section from low to high: missing ones lie on the line between their neighbours, those
    beyond the ends repeat them.  Windows are per parameter, over the sections of one registration."""
    spine = fit.sparkSession.range(low, high + 1).withColumnRenamed("id", "z").join(fit, "z", "left")
    long = spine.select("z", F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("v")) for c in columns))).alias("p")).select("z", "p.*")
    w = Window.partitionBy("name").orderBy("z")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("v").isNotNull(), F.struct("z", "v"))
    long = long.withColumn("p", F.last(known, True).over(back)).withColumn("q", F.first(known, True).over(ahead))
    share = F.try_divide(F.col("z") - F.col("p.z"), F.col("q.z") - F.col("p.z"))
    line = F.col("p.v") + F.coalesce(share, F.lit(0.0)) * (F.col("q.v") - F.col("p.v"))
    long = long.withColumn("v", F.coalesce(line, "p.v", "q.v", F.lit(0.0)))
    return long.groupBy("z").pivot("name", list(columns)).agg(F.first("v")).select("z", *columns)


def smoothed(fit: DataFrame, window: int = 5, columns=PARAMETERS) -> DataFrame:
    """Rolling median over an odd number of sections; the ends repeat themselves beyond the first and last."""
    half = (window if window % 2 else window + 1) // 2
    w = Window.orderBy("z")  # the sections of one registration
    around = lambda c: F.array(*(F.coalesce(F.lag(c, k).over(w) if k > 0 else F.lead(c, -k).over(w) if k else F.col(c), F.col("_first" if k > 0 else "_last")[c]) for k in range(-half, half + 1)))
    ends = F.struct(*columns)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = fit.withColumn("_first", F.first(ends).over(whole)).withColumn("_last", F.last(ends).over(whole))
    return at.select("z", *(F.array_sort(around(c))[half].alias(c) for c in columns))


def scaled(fit: DataFrame, factor: float) -> DataFrame:
    return fit.select("z", *(F.col(p) * factor for p in PARAMETERS)).toDF("z", *PARAMETERS)


def landmarks(pairs: DataFrame) -> DataFrame:
    """One affine for all landmarks: scale, angle and residuals."""
    fit = graph.cut(_fit(pairs))
    rx, ry = _by(fit)
    r = pairs.crossJoin(F.broadcast(fit)).withColumn("res", F.hypot(rx - F.col("gx"), ry - F.col("gy")))  # one row
    r = r.agg(F.avg("res").alias("mean"), F.max("res").alias("max"), F.stddev_pop("res").alias("std"))
    shape = fit.select(*PARAMETERS, F.sqrt(F.col("a") ** 2 + F.col("c") ** 2).alias("scale"), F.degrees(F.atan2("c", "a")).alias("angle"))
    return shape.crossJoin(r)  # one row each
