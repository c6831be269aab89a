"""Skeleton operators: edges, merge labels, edge classes, slices, coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelframe.operators import graph

#: Voxel size in nm.
RESOLUTION = (2.0, 2.0, 50.0)


def edges(nodes: DataFrame) -> DataFrame:
    """node joined to its parent; dangling parents and roots drop out."""
    parent = nodes.select(*(F.col(c).alias(f"p_{c}") for c in ("node_id", "x", "y", "z", "label", "cell_name")))
    rx, ry, rz = RESOLUTION
    length = F.sqrt(
        ((F.col("x") - F.col("p_x")) * rx) ** 2 + ((F.col("y") - F.col("p_y")) * ry) ** 2 + ((F.col("z") - F.col("p_z")) * rz) ** 2
    )
    return nodes.join(parent, nodes.parent_id == parent.p_node_id).withColumn("length", length)


def merge_labels(edge: DataFrame, min_count: int = 1, min_share: float = 0.0) -> DataFrame:
    """Labels that two or more neurons contribute to; only nodes on an edge count.  A neuron contributes with
    min_count of its nodes, or the share of the label's nodes if that is more.  ``neurons`` lists them, once each;
    where it is not asked for, Spark leaves it out."""
    own = F.struct("node_id", "label", "cell_name")
    parent = F.struct(F.col("p_node_id").alias("node_id"), F.col("p_label").alias("label"), F.col("p_cell_name").alias("cell_name"))
    ends = edge.select(F.explode(F.array(own, parent)).alias("e")).select("e.*").filter("label <> 0")
    counts = ends.distinct().groupBy("label", "cell_name").agg(F.count("*").alias("n"))
    need = F.lit(float(min_count))
    if min_share:
        need = F.greatest(need, min_share * F.sum("n").over(Window.partitionBy("label")))
    found = counts.withColumn("need", need).filter("n >= need").groupBy("label")
    return found.agg(F.count("*").alias("contributors"), F.sum("n").alias("n_nodes"), F.array_sort(F.collect_set("cell_name")).alias("neurons")).filter("contributors >= 2")


def edge_classes(edge: DataFrame, merged: DataFrame) -> DataFrame:
    """class per edge: background, merge, split or ok, tested in this order.  Background ends have no key, so
    they meet nothing and no task collects them."""
    m = merged.select(F.col("label").alias("m"), F.lit(True).alias("hit"))
    e = edge.withColumn("k_u", F.expr("nullif(label, 0)")).withColumn("k_v", F.expr("nullif(p_label, 0)"))
    e = e.join(m.select(F.col("m").alias("k_u"), F.col("hit").alias("m_u")), "k_u", "left")
    e = e.join(m.select(F.col("m").alias("k_v"), F.col("hit").alias("m_v")), "k_v", "left")
    kind = (
        F.when(F.col("k_u").isNull() | F.col("k_v").isNull(), "background")
        .when(F.col("m_u").isNotNull() | F.col("m_v").isNotNull(), "merge")
        .when(F.col("label") != F.col("p_label"), "split")
        .otherwise("ok")
    )
    return e.withColumn("class", kind).drop("k_u", "k_v", "m_u", "m_v")


def classified(nodes: DataFrame, **tolerance) -> DataFrame:
    """Edges with their class; merge labels are found over all neurons.  Edges are read three times from here on,
    so they are made once."""
    e = graph.cut(edges(nodes).select("node_id", "p_node_id", "cell_name", "p_cell_name", "label", "p_label", "length"))
    return edge_classes(e, merge_labels(e, **tolerance))


def runs(classes: DataFrame) -> DataFrame:
    """Error-free runs: run (its top node), cell_name, n_edges, length; those of no length are no runs.
    An edge's upper end belongs to a run even if it is in no lower end, so tops need no row of their own."""
    ok = classes.filter("class = 'ok'").select(F.col("node_id").alias("node"), F.col("p_node_id").alias("up"), "cell_name", "length")
    ok = graph.cut(ok)
    # A node whose parent is the lower end of no error-free edge hangs right under the run's top.
    top = graph.tops(ok.select("node", "up")).withColumnRenamed("top", "low")
    over = ok.select(F.col("node").alias("low"), F.col("up").alias("run"))
    found = ok.join(top, "node").join(over, "low").groupBy("run", "cell_name")
    return found.agg(F.count("*").alias("n_edges"), F.sum("length").alias("length")).filter("length > 0")


def run_lengths(classes: DataFrame, run: DataFrame, *by: str) -> DataFrame:
    """Expected run length: squares of the runs' lengths over the length of all edges, with counts."""
    n = lambda kind: F.count_if(F.col("class") == kind)
    totals = classes.groupBy(*by).agg(
        F.sum("length").alias("total_length"), n("split").alias("n_split_edges"), n("background").alias("n_bg_edges"), n("merge").alias("n_merge_edges")
    )
    squares = run.groupBy(*by).agg(F.sum(F.col("length") ** 2).alias("squares"), F.count("*").alias("n_runs"), F.max("length").alias("max_run"))
    out = totals.join(squares, list(by), "left") if by else totals.join(squares)  # both have one row
    out = out.fillna(0, ["squares", "n_runs", "max_run"])
    erl = F.coalesce(F.try_divide("squares", "total_length"), F.lit(0.0))
    r = lambda c: F.round(c, 4).alias(c)
    return out.select(*by, F.round(erl, 4).alias("erl"), r("total_length"), "n_runs", r("max_run"), "n_split_edges", "n_bg_edges", "n_merge_edges")


def of_neurons(nodes: DataFrame, neurons: DataFrame) -> DataFrame:
    """Nodes of the neurons given; edges to other nodes drop out with them."""
    return nodes.join(neurons.select("cell_name").distinct(), "cell_name", "left_semi")


def chains(nodes: DataFrame) -> DataFrame:
    """node_id, head, pos, origin: each node's chain, its place in it and the branch node that the chain comes
    from.  A chain starts at a root and at each child of a node with two children or more."""
    n = graph.cut(nodes.select("node_id", "parent_id", "cell_name"))
    known = n.select(F.col("node_id").alias("parent_id")).withColumn("known", F.lit(True))
    kids = n.groupBy("parent_id").agg(F.count("*").alias("kids"))
    at = n.join(known, "parent_id", "left").join(kids, "parent_id", "left")
    starts = F.col("known").isNull() | (F.col("kids") >= 2)
    at = graph.cut(at.select("node_id", "cell_name", F.when(~starts, F.col("parent_id")).alias("up"), F.when(F.col("known"), F.col("parent_id")).alias("origin")))
    placed = graph.tops(at.select(F.col("node_id").alias("node"), "up"))
    origin = at.filter("up is null").select(F.col("node_id").alias("head"), "origin")
    placed = placed.select(F.col("node").alias("node_id"), F.col("top").alias("head"), F.col("depth").alias("pos"))
    return at.select("node_id", "cell_name").join(placed, "node_id").join(origin, "head")


def chain_table(chain_nodes: DataFrame) -> DataFrame:
    """One row per chain, numbered per neuron by head; its nodes in order."""
    t = chain_nodes.groupBy("cell_name", "head").agg(
        F.array_sort(F.collect_list(F.struct("pos", "node_id"))).alias("n"), F.first("origin").alias("origin")
    )
    nodes = F.transform("n", lambda x: x["node_id"])
    nth = (F.row_number().over(Window.partitionBy("cell_name").orderBy("head")) - 1).cast("long")
    return t.select("cell_name", "head", nth.alias("chain_idx"), nodes.alias("nodes"), F.col("origin").alias("origin_branch"), F.col("origin").isNull().alias("is_root"))


def _cells(x: Column, y: Column, size: float, around: int = 0) -> Column:
    """Grid cells of the point, and of its neighbours up to ``around`` cells away, as an array of structs."""
    cx, cy = (F.floor(c / size) for c in (x, y))
    step = F.sequence(F.lit(-around), F.lit(around))
    return F.flatten(F.transform(step, lambda i: F.transform(step, lambda j: F.struct((cx + i).alias("cx"), (cy + j).alias("cy")))))


def within(points: DataFrame, nodes: DataFrame, radius: float) -> DataFrame:
    """Pairs of points (point, z, px, py) and nodes of the same slice at most ``radius`` apart, with dist."""
    p = points.withColumn("_c", F.explode(_cells(F.col("px"), F.col("py"), radius, 1))).select("*", "_c.*").drop("_c")
    n = nodes.select("node_id", "z", "x", "y").withColumn("_c", _cells(F.col("x"), F.col("y"), radius)[0]).select("*", "_c.*").drop("_c")
    dist = F.sqrt((F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2)
    return p.join(n, ["z", "cx", "cy"]).withColumn("dist", dist).filter(F.col("dist") <= radius)


def nearest(points: DataFrame, nodes: DataFrame, radius: float) -> DataFrame:
    """The nearest node of each point within the radius, null if there is none; the smaller id on ties."""
    best = within(points, nodes, radius).groupBy("point").agg(F.min(F.struct("dist", "node_id")).alias("b"))
    return points.join(best, "point", "left").select("point", "b.node_id", "b.dist")


def slices_at(nodes: DataFrame, by: list[str], share) -> DataFrame:
    """The slices of each group (by, z) at some places of its list of slices, in order: by, k, z.  ``share`` makes
    an array of places, from 0, of the list's length n; a group has few slices beside its nodes."""
    z = F.array_sort(F.collect_set("z"))
    at = nodes.filter("z is not null").groupBy(*by).agg(z.alias("zs"))
    at = at.select(*by, "zs", F.posexplode(share(F.size("zs"))).alias("k", "at"))
    return at.select(*by, "k", F.get("zs", F.col("at").cast("int")).alias("z"))


def middle_slice(nodes: DataFrame, by: list[str]) -> DataFrame:
    """The middle one of each group's slices, the later of two."""
    return slices_at(nodes, by, lambda n: F.array(F.floor(n / 2))).drop("k")


def even_slices(nodes: DataFrame, by: list[str], most: int) -> DataFrame:
    """``most`` slices of each group from its first to its last at even steps, rounded down; all if it has fewer."""
    steps = lambda n: F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda j: F.floor(j * (n - 1) / F.lit(float(max(1, most - 1)))))
    every = lambda n: F.transform(F.sequence(F.lit(0), n - 1), lambda j: j.cast("bigint"))
    return slices_at(nodes, by, lambda n: F.when(n >= most, steps(n)).otherwise(every(n)))


def crop_windows(boxes: DataFrame, image: tuple[int, int], pad: int, scale: int, longest: int, least: int = 0) -> DataFrame:
    """Adds to boxes x0, y0, x1, y1 the window in which to crop the image of (rows, columns): left, top, width, height
    and crop_scale.  The box is padded, to ``least`` pixels a side at least and the image's size at most, about
    its centre, and then clipped; the scale is coarser than ``scale`` where the longer side would have more than
    ``longest`` pixels."""
    extent = lambda c, size: F.least(F.lit(float(size)), F.greatest(F.col(f"{c}1") - F.col(f"{c}0") + 2 * pad, F.lit(float(least))))
    b = boxes.withColumns({"_w": extent("x", image[1]), "_h": extent("y", image[0])})
    ends = {}
    for c, side, size, low, length in (("x", "_w", image[1], "left", "width"), ("y", "_h", image[0], "top", "height")):
        middle = 0.5 * (F.col(f"{c}0") + F.col(f"{c}1"))
        ends[low] = F.greatest(F.lit(0), F.floor(middle - F.col(side) / 2))
        ends[length] = F.greatest(F.lit(1), F.least(F.lit(size), F.ceil(middle + F.col(side) / 2)) - ends[low])
    coarse = F.ceil(F.greatest("_w", "_h", F.lit(1.0)) / float(longest))
    return b.withColumns(ends | {"crop_scale": F.greatest(F.lit(scale), coarse)}).drop("_w", "_h")


def on_frames(members: DataFrame, states: DataFrame, scale: int, image: tuple[int, int]) -> DataFrame:
    """Nodes of chains (neuron, chain_idx, node_id, x, y, z, in full-resolution pixels) as points on the chains'
    frames: frame, px, py, and whether the point is inside the picture.

    A chain's state (neuron, chain_idx, frame_to_z, crop_window) says which section each frame shows, and of which
    window, scaled by its crop_scale; without a window it is the whole image of (rows, columns), scaled by
    ``scale``.  A node on a section of no frame has frame null, as have all nodes of a chain without a state."""
    of = F.map_entries("frame_to_z")
    shown = states.select("neuron", "chain_idx", F.explode(of).alias("e")).select("neuron", "chain_idx", F.col("e.value").alias("z"), F.col("e.key").alias("frame"))
    at = members.join(shown.groupBy("neuron", "chain_idx", "z").agg(F.max("frame").alias("frame")), ["neuron", "chain_idx", "z"], "left")
    at = at.join(states.select("neuron", "chain_idx", "crop_window"), ["neuron", "chain_idx"], "left")
    w = F.col("crop_window")
    point = lambda c, k: F.when(w.isNull(), F.col(c) / scale).otherwise((F.col(c) - w["origin_tif"][k]) / w["crop_scale"])
    size = lambda k: F.when(w.isNull(), F.lit(image[1 - k] / scale)).otherwise(F.bround(w["size_tif"][k] / w["crop_scale"]))
    at = at.withColumns({"px": point("x", 0), "py": point("y", 1)})
    inside = (F.col("px") >= 0) & (F.col("px") < size(0)) & (F.col("py") >= 0) & (F.col("py") < size(1))
    return at.select("neuron", "chain_idx", "node_id", "z", "frame", "px", "py", inside.alias("inside"))


#: Boxes of a level that form one of the next, as bits; the most boxes of a level, or slices, that are sent round.
FAN, SENT = 3, 100_000


def _interleaved(x: Column, y: Column) -> Column:
    """The bits of two numbers below 2 ** 31 by turns, so that what is near in the plane is mostly near in order."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x, y = (v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask)) for v in (x, y))
    return x.bitwiseOR(F.shiftleft(y, 1))


def _tree(nodes: DataFrame, k: int) -> tuple[DataFrame, list[DataFrame]]:
    """A packed tree of boxes over each slice's nodes: its places, z, x, y, ids (the k + 1 smallest there) and box, and
    its levels of boxes from the leaves up to one a slice: z, box, the corners x0, y0, x1, y1 of what it holds, and n (nodes, of
    one place k + 1 at most).

    Places are dealt by ranges along a curve through the slices and numbered in its order; a leaf is a stretch of
    more than k numbers, and a box of a higher level the next 2 ** FAN below it.  So crowds and lone places
    make boxes of as many, each place is dealt twice, and higher levels are made from the few boxes below."""
    at = nodes.select("node_id", "z", "x", "y").filter("x is not null and y is not null and z is not null")
    square = at.groupBy("z").agg(*(f(F.nanvl(c, F.lit(None).cast("double"))).alias(f"{c}{i}") for i, f in enumerate((F.min, F.max)) for c in "xy"))
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(1e-9)) * (1 + 1e-9)
    square = graph.cut(square.select("z", "x0", "y0", side.alias("side")))
    slices = square.count()
    # A place keeps as many ids as can ever be wanted of it; each task keeps its own smallest first.
    nth = F.row_number().over(Window.partitionBy("z", "x", "y").orderBy("node_id"))
    at = at.withColumn("_nth", nth).filter(F.col("_nth") <= k + 1).groupBy("z", "x", "y").agg(F.array_sort(F.collect_list("node_id")).alias("ids"))
    at = at.join(F.broadcast(square) if slices <= SENT else square, "z")
    most = 2**31
    at = at.withColumns({f"g{c}": F.least(F.floor((F.col(c) - F.col(f"{c}0")) / F.col("side") * most), F.lit(most - 1)) for c in "xy"})
    order = ["z", "along", "x", "y"]
    at = at.withColumn("along", _interleaved(F.col("gx"), F.col("gy"))).select(*order, "ids").repartitionByRange(*order).sortWithinPartitions(*order)
    places = graph.cut(at.select("z", "x", "y", "ids", F.monotonically_increasing_id().alias("number")))
    # The number of the partition and that within it, without the gap between them.
    within = F.col("number").bitwiseAND(F.lit((1 << 33) - 1))
    leaf = max(3, (k + 1).bit_length())
    bits = max(leaf, (places.agg(F.max(within)).first()[0] or 0).bit_length())
    number = F.shiftleft(F.shiftright("number", 33), bits).bitwiseOR(within)
    places = places.select("z", "x", "y", "ids", F.shiftright(number, leaf).alias("box"))
    corner = lambda x, y, n: [*(f(c).alias(f"{a}{i}") for i, f in enumerate((F.min, F.max)) for a, c in (("x", x[i]), ("y", y[i]))), F.sum(n).alias("n")]
    levels, base = [graph.cut(places.groupBy("z", "box").agg(*corner("xx", "yy", F.size("ids"))))], 0
    # The boxes of a slice are one on the level where their numbers' leading bits are the same.
    ends = levels[0].groupBy("z").agg(F.min("box").alias("low"), F.max("box").alias("high"))
    last, apart = ends.agg(F.max("high"), F.max(F.col("low").bitwiseXOR(F.col("high")))).first()
    heights = range(-(-(apart or 0).bit_length() // FAN) + 1)
    few = [slices + ((last or 0) >> FAN * h) <= SENT for h in heights]
    for h in heights[1:]:
        up = levels[base].groupBy("z", F.shiftright("box", FAN * (h - base)).alias("box")).agg(*corner(("x0", "x1"), ("y0", "y1"), "n"))
        if few[base]:  # the levels above one of few boxes are all made from it, where they are used
            levels.append(up)
        else:
            levels, base = [*levels, graph.cut(up)], h
    return places, [F.broadcast(v) if sent else v for v, sent in zip(levels, few)]


def candidates(points: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """Pairs of each point (point, z, px, py) and the places of its slice that its k nearest other nodes can lie in,
    with dist and the places' ids.

    From the whole slice on down, a point keeps the boxes that can matter: those that begin within its reach, which is
    the farthest corner of the box nearest by it among all met that hold k + 1 nodes.  So a point far from
    all others, or in a crowd, meets a few boxes of every level, and never a whole slice; and of the places
    in the leaves kept, only those within its reach go on.  Levels of few boxes are sent to the points, which stay."""
    places, levels = _tree(nodes, k)
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    front = points.select("point", "z", "px", "py").filter("px is not null and py is not null").repartition(tasks, "point")
    front = front.join(levels[-1].select("z", "box"), "z").withColumn("reach", F.lit(float("inf")))
    # dist and hypot round, and squares vanish, in ways of their own.  NaN is beyond all reach, but what is with it in a box is not.
    within = lambda c: F.isnan(c) | (F.col(c) <= F.col("reach") * (1 + 1e-12) + 1e-150)
    for level in levels[-2::-1]:
        below = level.withColumnRenamed("box", "_box").withColumn("box", F.shiftright("_box", FAN))
        front = front.join(below, ["z", "box"])
        aside = {c: F.greatest(F.col(f"{c}0") - F.col(f"p{c}"), F.col(f"p{c}") - F.col(f"{c}1"), F.lit(0.0)) for c in "xy"}
        beyond = {c: F.greatest(F.abs(F.col(f"{c}0") - F.col(f"p{c}")), F.abs(F.col(f"{c}1") - F.col(f"p{c}"))) for c in "xy"}
        front = front.withColumns({"close": F.hypot(aside["x"], aside["y"]), "far": F.when(F.col("n") > k, F.hypot(beyond["x"], beyond["y"]))}).filter(within("close"))
        front = front.select("point", "z", "px", "py", F.col("_box").alias("box"), "close", F.least("reach", F.min("far").over(Window.partitionBy("point"))).alias("reach"))
        front = front.filter(within("close")).drop("close")
    both = front.join(places, ["z", "box"]).withColumn("dist", F.sqrt((F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2))
    return both.filter(within("dist")).select("point", "ids", "dist")


def k_nearest(points: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """The k nearest other nodes (point is a node's id) of each point's slice, all if there are fewer: point, rank,
    node_id, dist; the smaller id comes first on ties.  Points of unknown place have none."""
    order = Window.partitionBy("point").orderBy("dist", "node_id")
    pairs = candidates(points, nodes, k).select("point", "dist", F.explode("ids").alias("node_id")).filter("node_id <> point")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("point", "rank", "node_id", "dist")


#: The affine from stack pixels to full-resolution pixels, and file z less stack z.
STACK_TO_FULL = ((1.11667, 0.03757), (-0.03641, 1.11909))
STACK_SHIFT = (-893.90, -427.09)
FILE_Z_LEAD = 7


def placed(nodes: DataFrame, scale: float = 4.0) -> DataFrame:
    """Adds full_x, full_y (affine), model_x, model_y (full / scale) and file_z."""
    (a, b), (c, d) = STACK_TO_FULL
    x, y = F.col("x"), F.col("y")
    full = nodes.withColumns({"full_x": x * a + y * b + STACK_SHIFT[0], "full_y": x * c + y * d + STACK_SHIFT[1]})
    return full.withColumns(
        {"model_x": F.col("full_x") / scale, "model_y": F.col("full_y") / scale, "file_z": F.col("z") + FILE_Z_LEAD}
    )


def from_nm(nodes: DataFrame) -> DataFrame:
    """x, y, z in nanometres become stack pixels."""
    return nodes.withColumns({c: F.col(c) / v for c, v in zip("xyz", RESOLUTION)})


def clipped(nodes: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """Nodes within the inclusive z bounds; either side may be open."""
    keep = F.lit(True)
    if low is not None:
        keep = keep & (F.col("z") >= low)
    if high is not None:
        keep = keep & (F.col("z") <= high)
    return nodes.filter(keep)


def with_virtual_nodes(nodes: DataFrame, allowance: int = 8) -> DataFrame:
    """Fills gaps of 1 to ``allowance`` missing slices between a node and its parent.

    Virtual nodes lie on the straight line and are chained from the child to the parent; the child
    hangs on the first.  Positions follow from the rank alone, so one join with the parents does all.
    """
    p = nodes.select(F.col("node_id").alias("parent_id"), *(F.col(c).alias(f"p_{c}") for c in "xyz"))
    own = nodes.join(p, "parent_id", "left").withColumn("dz", F.col("p_z") - F.col("z"))
    gap = F.abs("dz") - 1
    own = own.withColumn("missing", F.when((gap > 0) & (gap <= allowance), gap).otherwise(0).cast("int"))
    name = lambda k: F.concat_ws("_", F.lit("v"), F.col("node_id"), F.col("z") + F.signum("dz").cast("long") * k)
    parent = F.col("parent_id").cast("string")
    real = own.select(
        F.col("node_id").cast("string").alias("node_id"), F.when(F.col("missing") > 0, name(1)).otherwise(parent).alias("parent_id"),
        "cell_name", "x", "y", "z", F.lit(False).alias("is_virtual"),
    )
    rank = F.col("rank")
    share = rank / (F.col("missing") + 1)
    between = own.filter("missing > 0").withColumn("rank", F.explode(F.sequence(F.lit(1), F.col("missing"))))
    between = between.select(
        name(rank).alias("node_id"), F.when(rank < F.col("missing"), name(rank + 1)).otherwise(parent).alias("parent_id"), "cell_name",
        *((F.col(c) + share * (F.col(f"p_{c}") - F.col(c))).alias(c) for c in "xy"),
        (F.col("z") + F.signum("dz").cast("long") * rank).alias("z"), F.lit(True).alias("is_virtual"),
    )
    return real.unionByName(between)
