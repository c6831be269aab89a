"""Algebra of run-length masks: half-open runs (slice, neuron, y, x0, x1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelframe.operators import graph

ROW = ("slice", "neuron", "y")
MASK = ["slice", "neuron"]
#: Runs meet within tiles of 2 ** TILE_BITS pixels of an image row.
TILE_BITS = 6


def tiled(runs: DataFrame, x0: str = "x0", x1: str = "x1") -> DataFrame:
    """A row for each tile that the interval [x0, x1) touches, an empty one none."""
    ends = F.shiftright(x0, TILE_BITS), F.shiftright(F.col(x1) - 1, TILE_BITS)
    return runs.filter(F.col(x0) < F.col(x1)).withColumn("tile", F.explode(F.sequence(*ends)))


def met(a: DataFrame, b: DataFrame, on: list[str], b0: str, b1: str) -> DataFrame:
    """Pairs of overlapping intervals, [x0, x1) of ``a`` and [b0, b1) of ``b``, of the same image row (``on``),
    each once: in the tile in which the overlap begins.  A row of many runs is dealt by its tiles, and a run
    meets only what its own tiles hold, so the work grows with the runs and not with their square."""
    begins = F.shiftright(F.greatest("x0", b0), TILE_BITS) == F.col("tile")
    return tiled(a).join(tiled(b, b0, b1), [*on, "tile"]).filter((F.col("x0") < F.col(b1)) & (F.col(b0) < F.col("x1")) & begins).drop("tile")


def merged(runs: DataFrame) -> DataFrame:
    """Union of each mask's runs: touching runs become one.  Windows are per image row of a mask."""
    w = Window.partitionBy(*ROW).orderBy("x0", "x1")
    before = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    r = runs.withColumn("_new", F.when(F.col("x0") <= before, 0).otherwise(1))
    r = r.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy(*ROW, "_island").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_island")


def moments(runs: DataFrame) -> DataFrame:
    """area and centroid per mask."""
    n = F.col("x1") - F.col("x0")
    return runs.groupBy("slice", "neuron").agg(
        F.sum(n).alias("area"),
        F.round(F.sum(n * F.col("y")) / F.sum(n), 9).alias("cy"),
        F.round(F.sum(n * (F.col("x0") + F.col("x1") - 1)) / 2 / F.sum(n), 9).alias("cx"),
    )


def region_counts(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """tp, fp, fn and areas per predicted (slice, neuron); runs meet on their image row only.  Neurons
    without any truth and slices that the truth does not have are left out; a slice where only the neuron's
    truth is empty counts, all of it false."""
    key = ["slice", "neuron"]
    scored = pred.join(truth.select("neuron").distinct(), "neuron", "left_semi").join(truth.select("slice").distinct(), "slice", "left_semi")
    t = truth.select(*ROW, F.col("x0").alias("t0"), F.col("x1").alias("t1"))
    inside = met(scored, t, [*ROW], "t0", "t1")
    tp = inside.groupBy(*key).agg(F.sum(F.least("x1", "t1") - F.greatest("x0", "t0")).alias("tp"))
    area = lambda d, name: d.groupBy(*key).agg(F.sum(F.col("x1") - F.col("x0")).alias(name))
    out = area(scored, "pred_area").join(area(truth, "gt_area"), key, "left").join(tp, key, "left").fillna(0, ["tp", "gt_area"])
    fp, fn = F.col("pred_area") - F.col("tp"), F.col("gt_area") - F.col("tp")
    return out.select(*key, "tp", fp.alias("fp"), fn.alias("fn"), "pred_area", "gt_area")


def rollup(counts: DataFrame, *by: str, timing: DataFrame | None = None) -> DataFrame:
    """Ratios of summed counts, and means of the slices' ratios; with a ``timing`` (by, seconds) also how long
    the group took and its slices per second, null where that is not known or nothing."""
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn")]
    tp, wrong = F.col("tp"), F.col("fp") + F.col("fn")
    macro = [
        F.round(F.avg(F.try_divide(tp.cast("double"), tp + wrong)), 9).alias("macro_iou"),
        F.round(F.avg(F.try_divide(2.0 * tp, 2 * tp + wrong)), 9).alias("macro_dice"),
    ]
    out = ratios(counts.groupBy(*by).agg(F.count("*").alias("n_slices"), *sums, *macro))
    if timing is None:
        return out
    rate = F.when(F.col("seconds") > 0, F.round(F.col("n_slices") / F.col("seconds"), 3))
    return out.join(timing.select(*by, "seconds"), list(by), "left").withColumn("slices_per_s", rate).withColumn("seconds", F.round("seconds", 2))


def skipped(pred: DataFrame, known: DataFrame) -> DataFrame:
    """Predicted neurons that the truth does not know at all."""
    return pred.select("neuron").distinct().join(known.distinct(), "neuron", "left_anti").withColumn("reason", F.lit("not in truth"))


def ratios(counts: DataFrame) -> DataFrame:
    """iou, dice, precision and recall from counts; NULL for a zero denominator."""
    div = lambda a, b: F.round(F.try_divide(a.cast("double"), b.cast("double")), 9)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        "*", div(tp, tp + fp + fn).alias("iou"), div(2 * tp, 2 * tp + fp + fn).alias("dice"),
        div(tp, tp + fp).alias("precision"), div(tp, tp + fn).alias("recall"),
    )


def pieces(runs: DataFrame) -> DataFrame:
    """Image rows cut at every end of a run: slice, y, x0, x1 of each piece that some run covers, with the
    first and last neuron on it and how many.  Runs of one neuron must not overlap."""
    row = ["slice", "y"]
    ends = runs.select(*row, F.explode(F.array("x0", "x1")).alias("s")).distinct()
    cuts = ends.withColumn("e", F.lead("s").over(Window.partitionBy(*row).orderBy("s"))).filter("e is not null")
    at = cuts.withColumn("tile", F.shiftright("s", TILE_BITS))  # no run ends within a piece: its start decides
    on = at.join(tiled(runs), [*row, "tile"]).filter("x0 <= s and s < x1")
    return on.groupBy(*row, F.col("s").alias("x0"), F.col("e").alias("x1")).agg(F.min("neuron").alias("first"), F.max("neuron").alias("last"), F.count("*").alias("n"))


def composite(runs: DataFrame, highest: bool = False) -> DataFrame:
    """One owner per pixel: the first neuron in order, or the last; touching pieces of an owner are one run."""
    owner = "last" if highest else "first"
    return merged(pieces(runs).select("slice", F.col(owner).alias("neuron"), "y", "x0", "x1"))


def collisions(runs: DataFrame) -> DataFrame:
    """Pixels per slice that a further neuron claims, once for each."""
    return pieces(runs).groupBy("slice").agg(F.sum((F.col("n") - 1) * (F.col("x1") - F.col("x0"))).alias("collisions"))


def shared(runs: DataFrame) -> DataFrame:
    """Per mask: area, and how many of its pixels other neurons claim too."""
    claimed = pieces(runs).filter("n > 1").select("slice", "y", F.col("x0").alias("c0"), F.col("x1").alias("c1"))
    both = met(runs, claimed, ["slice", "y"], "c0", "c1").groupBy(*MASK).agg(F.sum(F.least("x1", "c1") - F.greatest("x0", "c0")).alias("shared"))
    own = runs.groupBy(*MASK).agg(F.sum(F.col("x1") - F.col("x0")).alias("area"))
    return own.join(both, MASK, "left").fillna(0, ["shared"])


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """Pieces that only one of two masks has: slice, neuron, y, x0, x1, side (lost or gained)."""
    both = old.withColumn("side", F.lit("lost")).unionByName(new.withColumn("side", F.lit("gained")))
    ends = both.select(*ROW, F.explode(F.array("x0", "x1")).alias("s")).distinct()
    cuts = ends.withColumn("e", F.lead("s").over(Window.partitionBy(*ROW).orderBy("s"))).filter("e is not null")
    at = cuts.withColumn("tile", F.shiftright("s", TILE_BITS))
    on = at.join(tiled(both), [*ROW, "tile"]).filter("x0 <= s and s < x1").groupBy(*ROW, "s", "e")
    one = on.agg(F.min("side").alias("side"), F.count("*").alias("n")).filter("n = 1")
    return one.select(*ROW, F.col("s").alias("x0"), F.col("e").alias("x1"), "side")


def labelled(runs: DataFrame, corners: bool = True) -> DataFrame:
    """Adds component (by touching runs of adjacent image rows, over corners or not) to the runs of each mask,
    and the component's size and first pixel (first_y, first_x)."""
    at = graph.cut(runs.withColumn("node", F.monotonically_increasing_id()))
    below = at.select("slice", "neuron", (F.col("y") - 1).alias("y"), F.col("x0").alias("b0"), F.col("x1").alias("b1"), F.col("node").alias("v"))
    wider = int(corners)  # runs that touch over a corner overlap when both are longer by a pixel
    above = at.select(*ROW, "x0", (F.col("x1") + wider).alias("x1"), F.col("node").alias("u"))
    links = met(above, below.withColumn("b1", F.col("b1") + wider), [*ROW], "b0", "b1").select("u", "v")
    part = at.join(graph.components(at.select("node"), links), "node")
    first = F.min(F.struct("y", "x0")).alias("p")
    size = part.groupBy("component").agg(F.sum(F.col("x1") - F.col("x0")).alias("size"), first)
    return part.join(size.select("component", "size", F.col("p.y").alias("first_y"), F.col("p.x0").alias("first_x")), "component").drop("node")


def component_table(parts: DataFrame) -> DataFrame:
    """Per mask: number of components, size of the largest and its share."""
    c = parts.select(*MASK, "component", "size").distinct()
    return c.groupBy(*MASK).agg(F.count("*").alias("n_components"), F.max("size").alias("largest"), F.round(F.max("size") / F.sum("size"), 9).alias("largest_share"))


def largest(parts: DataFrame) -> DataFrame:
    """Runs of each mask's largest component, the one met first in the image on ties."""
    best = parts.groupBy(*MASK).agg(F.max_by("component", F.struct("size", -F.col("first_y"), -F.col("first_x"))).alias("component"))
    return parts.join(best, [*MASK, "component"]).select(*ROW, "x0", "x1")


def without_islands(parts: DataFrame, least: int) -> DataFrame:
    return parts.filter(F.col("size") >= least).select(*ROW, "x0", "x1")


CROSS = ((-1, 0), (0, 1), (1, 0))


def disk(radius: int) -> tuple:
    """Rows of a disk: offset and half width."""
    return tuple((dy, int((radius * radius - dy * dy) ** 0.5)) for dy in range(-radius, radius + 1))


def dilated(runs: DataFrame, shape=CROSS) -> DataFrame:
    spans = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in shape)))
    d = runs.withColumn("_s", spans)
    return merged(d.select("slice", "neuron", (F.col("y") + F.col("_s.dy")).alias("y"), (F.col("x0") - F.col("_s.dx")).alias("x0"), (F.col("x1") + F.col("_s.dx")).alias("x1")))


def clipped(runs: DataFrame, frame: tuple[int | Column, int | Column]) -> DataFrame:
    """Runs within a frame of (rows, columns)."""
    rows, columns = (F.lit(n) if isinstance(n, int) else n for n in frame)
    r = runs.filter((F.col("y") >= 0) & (F.col("y") < rows))
    return r.withColumns({"x0": F.greatest("x0", F.lit(0)), "x1": F.least("x1", columns)}).filter("x0 < x1")


def complement(runs: DataFrame, frame: tuple[int, int], pad: int = 0) -> DataFrame:
    """The pixels of the frame, grown by ``pad``, that each mask does not have.  Gaps lie between neighbouring
    runs of a row; a run of no length before and after each row gives the outer ones."""
    rows, columns = frame
    every = runs.select(*MASK).distinct().withColumn("y", F.explode(F.sequence(F.lit(-pad), F.lit(rows - 1 + pad))))
    edge = lambda x: every.select(*ROW, F.lit(x).alias("x0"), F.lit(x).alias("x1"))
    inside = runs.withColumns({"x0": F.greatest("x0", F.lit(-pad)), "x1": F.least("x1", F.lit(columns + pad))}).filter("x0 < x1").join(every, [*ROW], "left_semi")
    ends = inside.select(*ROW, "x0", "x1").unionByName(edge(-pad)).unionByName(edge(columns + pad))
    w = Window.partitionBy(*ROW).orderBy("x0", "x1")
    gaps = ends.withColumn("x2", F.lead("x0").over(w))
    return gaps.filter("x2 > x1").select(*ROW, F.col("x1").alias("x0"), F.col("x2").alias("x1"))


def eroded(runs: DataFrame, frame: tuple[int, int], shape=CROSS) -> DataFrame:
    """What stays when the outside, beyond the frame too, grows by the shape."""
    reach = max(max(abs(dy), dx) for dy, dx in shape)
    outside = graph.cut(dilated(complement(graph.cut(runs), frame, reach), shape))  # never empty, so no mask is lost
    return complement(outside, frame)


def opened(runs: DataFrame, frame: tuple[int, int], n: int = 1, shape=CROSS) -> DataFrame:
    for _ in range(n):
        runs = eroded(runs, frame, shape)
    for _ in range(n):
        runs = clipped(dilated(runs, shape), frame)
    return runs


def closed(runs: DataFrame, frame: tuple[int, int], n: int = 1, shape=CROSS) -> DataFrame:
    for _ in range(n):
        runs = clipped(dilated(runs, shape), frame)
    for _ in range(n):
        runs = eroded(runs, frame, shape)
    return runs


def filled(runs: DataFrame, frame: tuple[int, int], below: int | None = None) -> DataFrame:
    """Fills holes (parts of the outside that do not reach the border), or only those of fewer pixels."""
    rows, columns = frame
    parts = labelled(complement(runs, frame), corners=False)
    border = (F.col("y") == 0) | (F.col("y") == rows - 1) | (F.col("x0") == 0) | (F.col("x1") == columns)
    open_ = parts.filter(border).select("component").distinct()
    holes = parts.join(open_, "component", "left_anti")
    if below is not None:
        holes = holes.filter(F.col("size") < below)
    return merged(runs.select(*ROW, "x0", "x1").unionByName(holes.select(*ROW, "x0", "x1")))


def cleaned(runs: DataFrame, frame: tuple[int, int]) -> DataFrame:
    """Opened, closed, the largest component, its holes filled."""
    return filled(largest(labelled(closed(opened(runs, frame), frame))), frame)


def resampled(runs: DataFrame, frame: tuple[Column, Column], to: tuple[Column, Column]) -> DataFrame:
    """Nearest-neighbour scaling from a frame of (rows, columns) to another, both of which each row may have
    for itself: pixel t of the target shows pixel floor(t * from / to).  So a run, and an image row, covers the
    pixels from its start, scaled and rounded up, to its end, scaled and rounded up; the image rows that
    show nothing of it are left out."""
    (h, w), (h2, w2) = ([F.lit(c) if isinstance(c, int) else c for c in x] for x in (frame, to))
    up = lambda c, a, b: F.ceil(c * b / a)
    r = runs.withColumns({"_a": up(F.col("y"), h, h2), "_b": up(F.col("y") + 1, h, h2), "x0": up(F.col("x0"), w, w2), "x1": up(F.col("x1"), w, w2)})
    return r.filter("_a < _b and x0 < x1").withColumn("y", F.explode(F.sequence("_a", F.col("_b") - 1))).drop("_a", "_b")


def rescaled(runs: DataFrame, frame: tuple[int, int], to: tuple[int, int]) -> DataFrame:
    """All masks from one frame to another."""
    return resampled(runs, frame, to).select(*ROW, "x0", "x1")


def placed(runs: DataFrame, origin: tuple[int | Column, int | Column], frame: tuple[int | Column, int | Column]) -> DataFrame:
    """Runs of a crop put at its origin (row, column) in the full frame, without what lies outside; origin and
    frame may be columns."""
    return clipped(runs.withColumns({"y": F.col("y") + origin[0], "x0": F.col("x0") + origin[1], "x1": F.col("x1") + origin[1]}), frame)


def _extent(length: Column, scale: Column) -> Column:
    """Pixels of a stretch of full-resolution pixels at a scale, one at least; halves go to the even number."""
    return F.greatest(F.lit(1), F.bround(length / scale).cast("long"))


def remapped(runs: DataFrame, source: Column, target: Column) -> DataFrame:
    """Runs of crops in the grid of other windows.  A window is a struct of ``origin_tif`` (x, y), ``size_tif``
    (width, height) and ``crop_scale``, one per row: the source's crop is laid over the rectangle that it
    shows, at the target's scale, and clipped to the target."""
    s = F.col("_to.crop_scale")
    r = runs.withColumns({"_from": source, "_to": target})
    size = lambda window, k, scale: _extent(F.col(window)["size_tif"][k], scale)
    own = F.col("_from.crop_scale")
    r = resampled(r, (size("_from", 1, own), size("_from", 0, own)), (size("_from", 1, s), size("_from", 0, s)))
    at = lambda k: F.bround((F.col("_from.origin_tif")[k] - F.col("_to.origin_tif")[k]) / s).cast("long")
    return placed(r, (at(1), at(0)), (size("_to", 1, s), size("_to", 0, s))).drop("_from", "_to")


def unplaced(runs: DataFrame, states: DataFrame, frame: tuple[int, int], scale: int) -> DataFrame:
    """Runs of chains' masks (slice, neuron, chain_idx, y, x0, x1) in the full frame at the model's scale.  The
    saved state of a chain (neuron, chain_idx, crop_window) tells where its masks lie: a crop is scaled down to
    its window and put at the window's origin; without a window, or a state, masks are the full frame
    already.  Parts beyond the frame are clipped."""
    whole = F.struct(
        F.array(F.lit(0.0), F.lit(0.0)).alias("origin_tif"), F.array(*(F.lit(n * scale) for n in reversed(frame))).alias("size_tif"),
        F.lit(scale).alias("crop_scale"),
    )
    window = F.struct(*(F.col(f"crop_window.{c}").alias(c) for c in ("origin_tif", "size_tif", "crop_scale")))
    known = states.filter("crop_window is not null").select("neuron", "chain_idx", window.alias("_w"))
    at = runs.join(known, ["neuron", "chain_idx"], "left")
    return remapped(at, F.coalesce("_w", whole), whole).drop("_w")


def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    """The old masks, but the new one where there is one."""
    return old.join(new.select(*MASK).distinct(), MASK, "left_anti").unionByName(new)


def signals(runs: DataFrame) -> DataFrame:
    """Per mask of a neuron, in order of slices: area, centroid, and against the mask before (the row before,
    not the slice before) area_ratio, centroid_jump and temporal_iou."""
    m = runs.groupBy(*MASK).agg(
        F.sum(F.col("x1") - F.col("x0")).alias("area"),
        (F.sum((F.col("x1") - F.col("x0")) * F.col("y")) / F.sum(F.col("x1") - F.col("x0"))).alias("cy"),
        (F.sum((F.col("x1") - F.col("x0")) * (F.col("x0") + F.col("x1") - 1)) / 2 / F.sum(F.col("x1") - F.col("x0"))).alias("cx"),
    )
    w = Window.partitionBy("neuron").orderBy("slice")
    m = m.withColumns({f"p_{c}": F.lag(c).over(w) for c in ("slice", "area", "cy", "cx")})
    before = runs.select("neuron", F.col("slice").alias("p_slice"), "y", F.col("x0").alias("b0"), F.col("x1").alias("b1"))
    now = runs.join(m.select(*MASK, "p_slice"), MASK)
    shared = met(now, before, ["neuron", "p_slice", "y"], "b0", "b1").groupBy(*MASK).agg(F.sum(F.least("x1", "b1") - F.greatest("x0", "b0")).alias("shared"))
    m = m.join(shared, MASK, "left").withColumn("shared", F.when(F.col("p_area").isNotNull(), F.coalesce("shared", F.lit(0))))
    return m.select(
        *MASK, "area", "cy", "cx", (F.col("area") / F.greatest("p_area", F.lit(1))).alias("area_ratio"),
        F.when(F.col("p_cy").isNotNull(), F.hypot(F.col("cy") - F.col("p_cy"), F.col("cx") - F.col("p_cx"))).alias("centroid_jump"),
        (F.col("shared") / (F.col("area") + F.col("p_area") - F.col("shared"))).alias("temporal_iou"),
    )


def hits(points: DataFrame, runs: DataFrame, radius: int = 0) -> DataFrame:
    """Pairs of a point (id, slice, px, py) and a run within ``radius``, with the pixels of the run in the
    point's window; the point goes to the image rows around it, so the join has an equal key."""
    p = points.withColumn("y", F.explode(F.sequence(F.col("py") - radius, F.col("py") + radius)))
    p = p.withColumns({"w0": F.col("px") - radius, "w1": F.col("px") + radius + 1})
    on = met(runs.select("slice", "neuron", "y", "x0", "x1"), p, ["slice", "y"], "w0", "w1")
    return on.withColumn("pixels", F.least("x1", "w1") - F.greatest("x0", "w0")).drop("w0", "w1")


def by_pixel(points: DataFrame, *by: str) -> DataFrame:
    """Points of one pixel as one row with their number n, per ``by``.  Where only numbers of points are asked for,
    a join of these rows with runs grows with the picture and not with the points."""
    return points.groupBy(*by, "slice", "px", "py").agg(F.count("*").alias("n"))


def labels_at(points: DataFrame, runs: DataFrame, label, radius: int = 0) -> DataFrame:
    """The label most frequent in each point's window, the smallest on ties, 0 where there is none."""
    found = hits(points, runs, radius).withColumn("label", label).groupBy("id", "label").agg(F.sum("pixels").alias("n"))
    best = found.groupBy("id").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"))
    return points.select("id").join(best, "id", "left").fillna(0, ["label"])


def containment(masks: DataFrame, nodes: DataFrame, runs: DataFrame, radius: int) -> DataFrame:
    """Whether each mask covers the mean node of its neuron within the radius; null where it has no node."""
    mean = nodes.groupBy(*MASK).agg(*(F.bround(F.avg(c)).cast("long").alias(c) for c in ("px", "py")))
    at = mean.select(F.struct(*MASK).alias("id"), "slice", F.col("neuron").alias("own"), "px", "py")
    inside = hits(at, runs, radius).filter("neuron = own").select("slice", "neuron").distinct().withColumn("hit", F.lit(True))
    m = masks.select(*MASK).join(mean, MASK, "left").join(inside, MASK, "left")
    return m.select(*MASK, F.when(F.col("px").isNotNull(), F.coalesce("hit", F.lit(False))).alias("contained"))


def distances(nodes: DataFrame, runs: DataFrame) -> DataFrame:
    """Per mask with a node: how far (in a square window) the mean node is from the mask."""
    mean = nodes.groupBy(*MASK).agg(*(F.bround(F.avg(c)).cast("long").alias(c) for c in ("px", "py")))
    aside = F.greatest(F.lit(0), F.col("x0") - F.col("px"), F.col("px") - F.col("x1") + 1)
    return runs.join(mean, MASK).groupBy(*MASK).agg(F.min(F.greatest(aside, F.abs(F.col("y") - F.col("py")))).alias("dist"))


def box(runs: DataFrame, frame: tuple[int, int], pad: int = 4, share: float = 0.1) -> DataFrame:
    """Box of each mask's runs, padded by so many pixels or the share of its size, within the frame."""
    b = runs.groupBy(*MASK).agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"))
    grow = lambda a, z: F.greatest(F.lit(pad), F.floor(share * (F.col(z) - F.col(a))))
    b = b.withColumn("_px", grow("x0", "x1")).withColumn("_py", grow("y0", "y1"))
    low = lambda c, p: F.greatest(F.lit(0), F.col(c) - F.col(p)).alias(c)
    high = lambda c, p, n: F.least(F.lit(n), F.col(c) + F.col(p)).alias(c)
    return b.select(*MASK, low("x0", "_px"), low("y0", "_py"), high("x1", "_px", frame[1]), high("y1", "_py", frame[0]))


def union_box(runs: DataFrame, queued) -> DataFrame:
    """Box of a neuron's masks without the queued ones; of all where nothing else is left."""
    ends = (("x0", F.min, F.col("x0")), ("x1", F.max, F.col("x1")), ("y0", F.min, F.col("y")), ("y1", F.max, F.col("y") + 1))
    of = [F.coalesce(f(F.when(~queued, c)), f(c)).alias(name) for name, f, c in ends]
    return runs.groupBy("neuron").agg(*of)


def gate(parts: DataFrame, contained: DataFrame, area: tuple[int, int], share: float) -> DataFrame:
    """Whether each mask can serve as an anchor, and why not: bounds of its area, share of its largest
    component, and its node, if there is one, covered."""
    m = component_table(parts).join(parts.groupBy(*MASK).agg(F.sum(F.col("x1") - F.col("x0")).alias("area")), MASK).join(contained, MASK, "left")
    why = F.array_compact(F.array(
        F.when(F.col("area") < area[0], "too_small"), F.when(F.col("area") > area[1], "too_large"),
        F.when(F.col("largest_share") < share, "fragmented"), F.when(~F.col("contained"), "not_contained"),
    ))
    return m.select(*MASK, "area", "largest_share", "contained", F.size(why).alias("n_reasons"), F.array_join(why, ",").alias("reasons")).withColumn("passed", F.col("n_reasons") == 0)
