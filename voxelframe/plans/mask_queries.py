"""Composites, differences, components, morphology, signals and probes of masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelframe.operators import masks
from voxelframe.plans.base import query
from voxelframe.sources import lenses as L

FRAME = (40, 145)


def _pred(spark, sf):
    return masks.merged(L.raw_runs(spark, sf))


def _truth(spark, sf):
    return masks.merged(L.raw_runs(spark, sf, truth=True))


def _areas(runs):
    return runs.groupBy("slice", "neuron").agg(F.sum(F.col("x1") - F.col("x0")).alias("area"))


_PIECES = f"""{L.RUNS}, ends AS (SELECT slice, y, x0 AS s FROM pred UNION SELECT slice, y, x1 FROM pred), cuts AS (SELECT slice, y, s, lead(s) OVER (PARTITION BY slice, y ORDER BY s) AS e FROM ends),
pieces AS (SELECT slice, y, s, e, min(neuron) AS first, max(neuron) AS last, count(*) AS n FROM cuts JOIN pred USING (slice, y) WHERE x0 <= s AND e <= x1 GROUP BY ALL)"""


@query(f"WITH {_PIECES} SELECT slice, first AS neuron, sum(e - s)::BIGINT AS area FROM pieces GROUP BY ALL")
def composite_first(spark, sf):
    return _areas(masks.composite(_pred(spark, sf)))


@query(f"WITH {_PIECES} SELECT slice, last AS neuron, sum(e - s)::BIGINT AS area FROM pieces GROUP BY ALL")
def composite_max(spark, sf):
    return _areas(masks.composite(_pred(spark, sf), highest=True))


@query(f"WITH {_PIECES} SELECT slice, sum((n - 1) * (e - s))::BIGINT AS collisions FROM pieces GROUP BY ALL")
def overlap_collisions(spark, sf):
    return masks.collisions(_pred(spark, sf))


@query(f"""WITH {L.RUNS}, {L.TRUTH}, a AS (SELECT slice, neuron, sum(x1 - x0) AS n FROM pred GROUP BY ALL), b AS (SELECT slice, neuron, sum(x1 - x0) AS m FROM truth GROUP BY ALL),
t AS (SELECT slice, neuron, sum(least(p.x1, g.x1) - greatest(p.x0, g.x0)) AS tp FROM pred p JOIN truth g USING (slice, neuron, y) WHERE p.x0 < g.x1 AND g.x0 < p.x1 GROUP BY ALL),
d AS (SELECT slice, neuron, (coalesce(m, 0) - coalesce(tp, 0))::BIGINT AS lost, (coalesce(n, 0) - coalesce(tp, 0))::BIGINT AS gained FROM a FULL JOIN b USING (slice, neuron) LEFT JOIN t USING (slice, neuron))
FROM d WHERE lost + gained > 0""")
def mask_diff(spark, sf):
    d = masks.difference(_truth(spark, sf), _pred(spark, sf)).withColumn("n", F.col("x1") - F.col("x0"))
    side = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("n"))), F.lit(0)).alias(s)
    return d.groupBy("slice", "neuron").agg(side("lost"), side("gained"))


@query(f"""WITH {L.RUNS}, px AS (SELECT slice, neuron, y, unnest(range(x0, x1)) AS x FROM pred), c AS (SELECT *, count(*) OVER (PARTITION BY slice, y, x) AS n FROM px)
SELECT slice, neuron, count(*) AS area, count_if(n > 1) AS shared FROM c GROUP BY ALL""")
def neighbour_overlap(spark, sf):
    """How much of each mask its neighbours claim too."""
    return masks.shared(_pred(spark, sf))


_PARTS = f"""{L.RUNS}, n AS (SELECT *, row_number() OVER (ORDER BY slice, neuron, y, x0) AS id FROM pred),
e AS (SELECT a.id AS u, b.id AS v FROM n a JOIN n b ON a.slice = b.slice AND a.neuron = b.neuron AND b.y = a.y + 1 AND a.x0 <= b.x1 AND b.x0 <= a.x1), e2 AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
reach AS (SELECT id, id AS root FROM n UNION SELECT e2.v, reach.root FROM reach JOIN e2 ON e2.u = reach.id), comp AS (SELECT id, min(root) AS c FROM reach GROUP BY ALL),
parts AS (SELECT n.*, c, sum(x1 - x0) OVER (PARTITION BY c) AS size FROM n JOIN comp USING (id)),
tab AS (SELECT slice, neuron, count(DISTINCT c) AS n_components, max(size)::BIGINT AS largest, max(size) / sum(x1 - x0) AS share, arg_max(c, (size, -c)) AS best, sum(x1 - x0)::BIGINT AS area FROM parts GROUP BY ALL)"""


@query(f"WITH RECURSIVE {_PARTS} SELECT slice, neuron, n_components, largest, round(share, 9) AS largest_share FROM tab")
def mask_components(spark, sf):
    return masks.component_table(masks.labelled(_pred(spark, sf)))


@query(f"WITH RECURSIVE {_PARTS} SELECT slice, neuron, y, x0, x1 FROM parts JOIN tab USING (slice, neuron) WHERE c = best")
def mask_largest(spark, sf):
    return masks.largest(masks.labelled(_pred(spark, sf)))


@query(f"WITH RECURSIVE {_PARTS} SELECT slice, neuron, y, x0, x1 FROM parts WHERE size >= 30")
def mask_islands(spark, sf):
    return masks.without_islands(masks.labelled(_pred(spark, sf)), 30)


@query(f"""WITH RECURSIVE {_PARTS}, b AS (SELECT slice, neuron, min(x0) AS x0, max(x1) AS x1, min(y) AS y0, max(y) + 1 AS y1 FROM parts JOIN tab USING (slice, neuron) WHERE c = best GROUP BY ALL),
g AS (SELECT *, greatest(4, floor(0.1 * (x1 - x0)))::BIGINT AS px, greatest(4, floor(0.1 * (y1 - y0)))::BIGINT AS py FROM b)
SELECT slice, neuron, greatest(0, x0 - px) AS x0, greatest(0, y0 - py) AS y0, least(145, x1 + px) AS x1, least(40, y1 + py) AS y1 FROM g""")
def box_from_mask(spark, sf):
    return masks.box(masks.largest(masks.labelled(_pred(spark, sf))), FRAME)


@query(None)
def mask_open_close(spark, sf):
    runs = masks.clipped(_pred(spark, sf), FRAME)
    return masks.closed(masks.opened(runs, FRAME), FRAME)


@query(None)
def mask_smooth(spark, sf):
    runs, shape = masks.clipped(_pred(spark, sf), FRAME), masks.disk(2)
    return masks.opened(masks.closed(runs, FRAME, shape=shape), FRAME, shape=shape)


@query(None)
def mask_holes(spark, sf):
    return masks.filled(masks.clipped(_pred(spark, sf), FRAME), FRAME, below=64)


@query(None)
def mask_cleanup(spark, sf):
    return masks.cleaned(masks.clipped(_pred(spark, sf), FRAME), FRAME)


_MOM = f"""m AS (SELECT slice, neuron, sum(x1 - x0)::BIGINT AS area, sum((x1 - x0) * y) / sum(x1 - x0) AS cy, sum((x1 - x0) * (x0 + x1 - 1)) / 2 / sum(x1 - x0) AS cx FROM pred GROUP BY ALL),
q AS (SELECT *, lag(slice) OVER w AS ps, lag(area) OVER w AS pa, lag(cy) OVER w AS pcy, lag(cx) OVER w AS pcx FROM m WINDOW w AS (PARTITION BY neuron ORDER BY slice)),
o AS (SELECT q.slice, q.neuron, sum(greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0))) AS shared FROM q JOIN pred a ON a.slice = q.slice AND a.neuron = q.neuron JOIN pred b ON b.slice = q.ps AND b.neuron = q.neuron AND b.y = a.y GROUP BY ALL),
sig AS (SELECT slice, neuron, area, round(cy, 9) AS cy, round(cx, 9) AS cx, round(area / greatest(pa, 1), 9) AS area_ratio, round(sqrt((cy - pcy) ** 2 + (cx - pcx) ** 2), 6) AS centroid_jump,
 CASE WHEN pa IS NOT NULL THEN round(coalesce(shared, 0) / (area + pa - coalesce(shared, 0)), 9) END AS temporal_iou FROM q LEFT JOIN o USING (slice, neuron))"""


def _signals(spark, sf):
    r = lambda c, d: F.round(c, d).alias(c)
    return masks.signals(_pred(spark, sf)).select("slice", "neuron", "area", r("cy", 9), r("cx", 9), r("area_ratio", 9), r("centroid_jump", 6), r("temporal_iou", 9))


@query(f"WITH {L.RUNS}, {_MOM} SELECT slice, neuron, temporal_iou FROM sig")
def temporal_iou(spark, sf):
    return _signals(spark, sf).select("slice", "neuron", "temporal_iou")


@query(f"WITH {L.RUNS}, {_MOM} SELECT slice, neuron, area, area_ratio FROM sig")
def area_ratio(spark, sf):
    return _signals(spark, sf).select("slice", "neuron", "area", "area_ratio")


_PTS = """pts AS (SELECT c_custkey AS id, c_custkey % 20 AS slice, 'Brand#' || (1 + c_custkey % 5) || (1 + c_custkey // 5 % 5) AS neuron, c_custkey * 7 % 145 AS px, c_custkey * 3 % 40 AS py FROM customer),
mean AS (SELECT slice, neuron, round_even(avg(px), 0)::BIGINT AS px, round_even(avg(py), 0)::BIGINT AS py FROM pts GROUP BY ALL),
dist AS (SELECT slice, neuron, min(greatest(0, x0 - px, px - x1 + 1, abs(y - py))) AS dist FROM pred JOIN mean USING (slice, neuron) GROUP BY ALL)"""


def _points(spark, sf):
    return L.table(spark, sf, "customer").selectExpr("c_custkey as id", "c_custkey % 20 as slice", "concat('Brand#', 1 + c_custkey % 5, 1 + c_custkey div 5 % 5) as neuron", "c_custkey * 7 % 145 as px", "c_custkey * 3 % 40 as py")


_CONTAINED = "con AS (SELECT DISTINCT p.slice, p.neuron, CASE WHEN mean.px IS NOT NULL THEN dist <= 5 END AS contained FROM pred p LEFT JOIN mean USING (slice, neuron) LEFT JOIN dist USING (slice, neuron))"


def _contained(spark, sf):
    runs = _pred(spark, sf)
    return masks.containment(runs.select("slice", "neuron").distinct(), _points(spark, sf), runs, 5)


@query(f"WITH {L.RUNS}, {_PTS}, {_CONTAINED} FROM con")
def frame_containment(spark, sf):
    return _contained(spark, sf)


@query(f"WITH RECURSIVE {_PARTS}, {_MOM}, {_PTS}, {_CONTAINED} SELECT sig.*, n_components, contained FROM sig JOIN tab USING (slice, neuron) JOIN con USING (slice, neuron)")
def qc_signals(spark, sf):
    key = ["slice", "neuron"]
    parts = masks.component_table(masks.labelled(_pred(spark, sf))).select(*key, "n_components")
    return _signals(spark, sf).join(parts, key).join(_contained(spark, sf), key)


_GATE = f"gate AS (SELECT slice, neuron, area, share, contained, concat_ws(',', CASE WHEN area < 60 THEN 'too_small' END, CASE WHEN area > 180 THEN 'too_large' END, CASE WHEN share < 0.5 THEN 'fragmented' END, CASE WHEN NOT contained THEN 'not_contained' END) AS reasons FROM tab JOIN con USING (slice, neuron))"


def _gate(spark, sf):
    return masks.gate(masks.labelled(_pred(spark, sf)), _contained(spark, sf), (60, 180), 0.5)


@query(f"WITH RECURSIVE {_PARTS}, {_PTS}, {_CONTAINED}, {_GATE} SELECT slice, neuron, area, round(share, 9) AS largest_share, contained, reasons, reasons = '' AS passed FROM gate")
def anchor_gate(spark, sf):
    return _gate(spark, sf).drop("n_reasons")


@query(f"""WITH RECURSIVE {_PARTS}, {_PTS}, {_CONTAINED}, {_GATE} SELECT slice, neuron, concat_ws(';', CASE WHEN area = 0 THEN 'empty' END, nullif(reasons, ''), CASE WHEN area % 100 / 100 < 0.3 THEN 'low_score' END) AS why,
 reasons <> '' OR area % 100 / 100 < 0.3 AS poor FROM gate""")
def fallback_policy(spark, sf):
    """Poor anchors and why: an empty mask, a reason of the gate, a score below the floor."""
    low = F.col("area") % 100 / 100 < 0.3
    why = F.concat_ws(";", F.when(F.col("area") == 0, "empty"), F.expr("nullif(reasons, '')"), F.when(low, "low_score"))
    return _gate(spark, sf).select("slice", "neuron", why.alias("why"), (~F.col("passed") | low).alias("poor"))


@query(f"""WITH RECURSIVE {_PARTS}, {_PTS}, hit AS (SELECT DISTINCT p.id, r.slice, r.neuron FROM pts p JOIN pred r USING (slice) WHERE r.y = p.py AND r.x0 <= p.px AND p.px < r.x1),
pos AS (SELECT slice, min(id) AS id FROM pts GROUP BY ALL), f AS (SELECT t.slice, t.neuron, h.id IS NOT NULL AS con, n.slice IS NULL AS no_neg, t.area BETWEEN 60 AND 180 AS ok, share, t.area % 100 AS score
 FROM tab t LEFT JOIN (SELECT hit.* FROM hit JOIN pos USING (slice, id)) h USING (slice, neuron) LEFT JOIN (SELECT DISTINCT slice, neuron FROM hit ANTI JOIN pos USING (slice, id)) n USING (slice, neuron))
SELECT slice, arg_max(neuron, (con::INT, no_neg::INT, ok::INT, share, score, -substr(neuron, 7)::INT)) AS neuron FROM f GROUP BY ALL""")
def anchor_select(spark, sf):
    """The best candidate of each slice: it covers the positive point and no negative one, has a plain area,
    is in one piece, has a high score, comes first."""
    key = ["slice", "neuron"]
    points = _points(spark, sf).drop("neuron")
    first = points.groupBy("slice").agg(F.min("id").alias("first"))
    hit = masks.hits(points, _pred(spark, sf)).join(first, "slice").groupBy(*key).agg(F.bool_or(F.col("id") == F.col("first")).alias("con"), F.bool_or(F.col("id") != F.col("first")).alias("neg"))
    parts = masks.labelled(_pred(spark, sf))
    c = masks.component_table(parts).join(_areas(parts), key).join(hit, key, "left").fillna(False, ["con", "neg"])
    rank = F.struct("con", ~F.col("neg"), F.col("area").between(60, 180), "largest_share", F.col("area") % 100, -F.expr("cast(substring(neuron, 7) as int)"))
    return c.groupBy("slice").agg(F.max_by("neuron", rank).alias("neuron"))


@query(f"""WITH {_PIECES}, {_PTS}, w AS (SELECT id, substr(last, 7)::INT AS label, sum(least(e, px + 2) - greatest(s, px - 1)) AS n FROM pts JOIN pieces USING (slice) WHERE pieces.y BETWEEN py - 1 AND py + 1 AND s <= px + 1 AND e > px - 1 GROUP BY ALL),
b AS (SELECT id, arg_max(label, (n, -label)) AS label FROM w GROUP BY ALL) SELECT id, coalesce(label, 0) AS label FROM pts LEFT JOIN b USING (id)""")
def node_labels(spark, sf):
    raster = masks.composite(_pred(spark, sf), highest=True)
    return masks.labels_at(_points(spark, sf).drop("neuron"), raster, F.expr("cast(substring(neuron, 7) as int)"), 1)


_HIT = "hit AS (SELECT DISTINCT p.id, p.slice, p.neuron AS own, r.neuron FROM pts p JOIN pred r ON r.slice = p.slice AND r.y = p.py AND r.x0 <= p.px AND p.px < r.x1)"


@query(f"""WITH {L.RUNS}, {_PTS}, {_HIT}, s AS (SELECT * FROM pts WHERE slice IN (SELECT slice FROM pred)) SELECT neuron, count(*) AS n, count_if(id IN (SELECT id FROM hit WHERE own = neuron)) AS n_on,
 round(count_if(id IN (SELECT id FROM hit WHERE own = neuron)) / count(*), 9) AS rate FROM s GROUP BY ALL""")
def on_mask_rate(spark, sf):
    """How many nodes lie on their own neuron's mask, over all slices that have masks."""
    runs = _pred(spark, sf)
    points = _points(spark, sf).withColumnRenamed("neuron", "own").join(runs.select("slice").distinct(), "slice", "left_semi")
    points = masks.by_pixel(points, "own")
    pixel = ["own", "slice", "px", "py"]
    on = masks.hits(points, runs).filter("own = neuron").select(*pixel).distinct().withColumn("on", F.lit(True))
    g = points.join(on, pixel, "left").groupBy(F.col("own").alias("neuron")).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("on"), F.col("n"))), F.lit(0)).alias("n_on"))
    return g.withColumn("rate", F.round(F.col("n_on") / F.col("n"), 9))


@query(f"WITH {L.RUNS}, {_PTS}, {_HIT} SELECT slice, neuron, count(*) AS n_leaks FROM hit WHERE own <> neuron GROUP BY ALL")
def leak_nodes(spark, sf):
    """Nodes of other neurons that a mask has swallowed."""
    points = _points(spark, sf).withColumnRenamed("neuron", "own").distinct()
    found = masks.hits(masks.by_pixel(points, "own"), _pred(spark, sf)).filter("own <> neuron")
    return found.groupBy("slice", "neuron").agg(F.sum("n").alias("n_leaks"))


@query(f"""WITH {L.RUNS}, {_PTS}, r AS (SELECT unnest(range(0, 7)) AS radius), s AS (SELECT radius, count_if(dist > radius) AS noskel, count(*) AS n FROM dist, r GROUP BY ALL)
SELECT radius, noskel, round(noskel / n, 9) AS rate, coalesce(noskel <= lag(noskel) OVER (ORDER BY radius), true) AS falls FROM s""")
def dilation_sweep(spark, sf):
    """Masks that miss their node at each radius; one distance per mask serves all radii."""
    dist = masks.distances(_points(spark, sf), _pred(spark, sf))
    s = dist.withColumn("radius", F.explode(F.sequence(F.lit(0), F.lit(6)))).groupBy("radius").agg(F.count_if(F.expr("dist > radius")).alias("noskel"), F.count("*").alias("n"))
    falls = F.expr("coalesce(noskel <= lag(noskel) over (order by radius), true)")  # seven rows
    return s.select("radius", "noskel", F.round(F.col("noskel") / F.col("n"), 9).alias("rate"), falls.alias("falls"))


@query(f"WITH {L.RUNS} SELECT slice, count(DISTINCT neuron) AS n_masks, max(y) + 1 AS height, max(x1) AS width FROM pred GROUP BY ALL")
def mask_slices(spark, sf):
    return _pred(spark, sf).groupBy("slice").agg(F.countDistinct("neuron").alias("n_masks"), (F.max("y") + 1).alias("height"), F.max("x1").alias("width"))


@query(f"""WITH {L.RUNS}, q AS (SELECT *, slice % 3 = 0 OR neuron < 'Brand#13' AS queued FROM pred) SELECT neuron, coalesce(min(x0) FILTER (NOT queued), min(x0)) AS x0, coalesce(max(x1) FILTER (NOT queued), max(x1)) AS x1,
 coalesce(min(y) FILTER (NOT queued), min(y)) AS y0, coalesce(max(y) FILTER (NOT queued), max(y)) + 1 AS y1 FROM q GROUP BY ALL""")
def mask_union_box(spark, sf):
    return masks.union_box(_pred(spark, sf), F.expr("slice % 3 = 0 or neuron < 'Brand#13'"))


@query(f"""WITH {L.RUNS}, t AS (SELECT slice, neuron, sum(CASE WHEN y IN (0, 39) THEN x1 - x0 ELSE (x0 = 0)::INT + (x1 >= 130)::INT END)::BIGINT AS edge FROM pred GROUP BY ALL) SELECT neuron, count_if(edge > 0) AS n_frames, max(edge) AS max_edge FROM t GROUP BY ALL""")
def border_clip(spark, sf):
    edge = F.when(F.col("y").isin(0, 39), F.col("x1") - F.col("x0")).otherwise((F.col("x0") == 0).cast("int") + (F.col("x1") >= 130).cast("int"))
    t = _pred(spark, sf).groupBy("slice", "neuron").agg(F.sum(edge).alias("edge"))
    return t.groupBy("neuron").agg(F.count_if(F.expr("edge > 0")).alias("n_frames"), F.max("edge").alias("max_edge"))


@query(f"""WITH {L.RUNS}, ty AS (SELECT unnest(range(0, 60)) AS ty), tx AS (SELECT unnest(range(0, 218)) AS tx)
SELECT slice, neuron, ty AS y, min(tx) AS x0, max(tx) + 1 AS x1 FROM pred JOIN ty ON ty * 40 // 60 = y JOIN tx ON tx * 145 // 218 >= x0 AND tx * 145 // 218 < x1 GROUP BY slice, neuron, ty, x0, x1""")
def mask_rescale(spark, sf):
    return masks.rescaled(_pred(spark, sf), FRAME, (60, 218))


@query(f"""WITH {L.RUNS}, ty AS (SELECT unnest(range(0, 10)) AS ty), tx AS (SELECT unnest(range(0, 36)) AS tx), p AS (SELECT DISTINCT slice, neuron, ty + 5 AS y, tx + 7 AS x FROM pred JOIN ty ON ty * 40 // 10 = y JOIN tx ON tx * 145 // 36 >= x0 AND tx * 145 // 36 < x1)
SELECT slice, neuron, count(*) AS area, min(y) AS y0, min(x) AS x0 FROM p WHERE y < 12 AND x < 40 GROUP BY ALL""")
def window_place(spark, sf):
    """Masks of a crop in the full frame, at the frame's scale and the crop's origin."""
    runs = masks.placed(masks.merged(masks.rescaled(_pred(spark, sf), FRAME, (10, 36))), (5, 7), (12, 40))
    return runs.groupBy("slice", "neuron").agg(F.sum(F.col("x1") - F.col("x0")).alias("area"), F.min("y").alias("y0"), F.min("x0").alias("x0"))


@query(f"""WITH {L.RUNS}, {L.TRUTH}, new AS (SELECT * FROM truth WHERE slice % 2 = 0), a AS (SELECT * FROM pred ANTI JOIN new USING (slice, neuron) UNION ALL FROM new) SELECT slice, neuron, y, x0, x1 FROM a""")
def frames_merge(spark, sf):
    return masks.replaced(_pred(spark, sf), _truth(spark, sf).filter("slice % 2 = 0"))


_UNION = f"""{L.CHAIN_RUNS}, {L.CHAIN_STATES}, pos AS (SELECT r.*, coalesce(ox, 0) AS ox, coalesce(oy, 0) AS oy, coalesce(w, 145 * 8) AS w, coalesce(h, 40 * 8) AS h, coalesce(scale, 8) AS scale FROM chain_runs r LEFT JOIN chain_states USING (neuron, chain_idx)),
geo AS (SELECT *, round_even(w / scale, 0)::BIGINT AS fw, round_even(h / scale, 0)::BIGINT AS fh, greatest(1, round_even(w / 8, 0))::BIGINT AS tw, greatest(1, round_even(h / 8, 0))::BIGINT AS th, round_even(ox / 8, 0)::BIGINT AS px, round_even(oy / 8, 0)::BIGINT AS py FROM pos),
tx AS (SELECT unnest(range(0, 145)) AS tx), ty AS (SELECT unnest(range(0, 40)) AS ty),
pix AS (SELECT DISTINCT slice, neuron, ty + py AS y, tx + px AS x FROM geo JOIN ty ON ty < th AND ty * fh // th = y JOIN tx ON tx < tw AND tx * fw // tw >= x0 AND tx * fw // tw < x1 WHERE ty + py BETWEEN 0 AND 39 AND tx + px BETWEEN 0 AND 144)"""


def _chain_union(spark, sf):
    return masks.merged(masks.unplaced(L.chain_runs(spark, sf), L.chain_states(spark, sf), FRAME, 8))


@query(f"WITH {_UNION} SELECT slice, neuron, count(*) AS area, sum(x)::BIGINT AS sum_x, sum(y)::BIGINT AS sum_y, min(x) AS x0, max(x) + 1 AS x1, min(y) AS y0, max(y) + 1 AS y1 FROM pix GROUP BY ALL")
def chain_masks_union(spark, sf):
    """Masks of a neuron's chains, of whole frames and of crops at several scales, united in the full frame."""
    n = F.col("x1") - F.col("x0")
    return _chain_union(spark, sf).groupBy("slice", "neuron").agg(
        F.sum(n).alias("area"), F.expr("sum((x1 - x0) * (x0 + x1 - 1) div 2)").alias("sum_x"), F.sum(n * F.col("y")).alias("sum_y"),
        F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"),
    )
