"""Runs, chains, picks and neighbours of skeleton nodes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelframe.operators import labelmaps, masks, registration, skeletons
from voxelframe.plans import registration_queries
from voxelframe.plans.base import query
from voxelframe.sources import lenses as L


def _runs_sql(nodes: str = "nodes", least: int = 1, share: float = 0.0, label: str = "label") -> str:
    """Edges with class (k), error-free runs (runs) of the node table named."""
    return f"""edges AS (SELECT n.*, p.node_id AS p_node_id, p.{label} AS p_lab, n.{label} AS lab, p.cell_name AS p_cell_name,
  sqrt(((n.x - p.x) * 2.0) ** 2 + ((n.y - p.y) * 2.0) ** 2 + ((n.z - p.z) * 50.0) ** 2) AS length FROM {nodes} n JOIN {nodes} p ON n.parent_id = p.node_id),
ends AS (SELECT node_id, lab, cell_name FROM edges UNION SELECT p_node_id, p_lab, p_cell_name FROM edges),
cnt AS (SELECT lab, cell_name, count(*) AS n FROM ends WHERE lab <> 0 GROUP BY ALL), cnt2 AS (SELECT *, sum(n) OVER (PARTITION BY lab) AS tot FROM cnt),
merged AS (SELECT lab FROM cnt2 WHERE n >= greatest({least}, {share} * tot) GROUP BY lab HAVING count(*) >= 2),
k AS (SELECT *, CASE WHEN lab = 0 OR p_lab = 0 THEN 'background' WHEN lab IN (FROM merged) OR p_lab IN (FROM merged) THEN 'merge' WHEN lab <> p_lab THEN 'split' ELSE 'ok' END AS class FROM edges),
ok AS (SELECT node_id, p_node_id, cell_name, length FROM k WHERE class = 'ok'),
r AS (SELECT node_id, p_node_id AS run, cell_name, length FROM ok WHERE p_node_id NOT IN (SELECT node_id FROM ok)
  UNION ALL SELECT c.node_id, r.run, c.cell_name, c.length FROM ok c JOIN r ON c.p_node_id = r.node_id),
runs AS (SELECT run, cell_name, count(*) AS n_edges, sum(length) AS length FROM r GROUP BY ALL HAVING sum(length) > 0)"""


_COUNTS = "count_if(class = 'split') AS n_split_edges, count_if(class = 'background') AS n_bg_edges, count_if(class = 'merge') AS n_merge_edges"
_TOTAL = f"""SELECT round(coalesce((SELECT sum(length ** 2) FROM runs), 0) / sum(length), 4) AS erl, round(sum(length), 4) AS total_length,
 (SELECT count(*) FROM runs) AS n_runs, round((SELECT max(length) FROM runs), 4) AS max_run, {_COUNTS} FROM k"""
_BY_NEURON = f"""t AS (SELECT cell_name, sum(length) AS total, {_COUNTS} FROM k GROUP BY ALL),
s AS (SELECT cell_name, sum(length ** 2) AS sq, count(*) AS n_runs, max(length) AS max_run FROM runs GROUP BY ALL),
per AS (SELECT cell_name, round(coalesce(sq, 0) / total, 4) AS erl, round(total, 4) AS total_length, coalesce(n_runs, 0) AS n_runs,
 round(coalesce(max_run, 0), 4) AS max_run, n_split_edges, n_bg_edges, n_merge_edges FROM t LEFT JOIN s USING (cell_name))"""


@query(f"WITH RECURSIVE {L.NODES}, {_runs_sql()} SELECT run, cell_name, n_edges, round(length, 4) AS length FROM runs")
def erl_runs(spark, sf):
    return skeletons.runs(skeletons.classified(L.nodes(spark, sf))).withColumn("length", F.round("length", 4))


def _total(nodes, *by, **tolerance):
    classes = skeletons.classified(nodes, **tolerance)
    return skeletons.run_lengths(classes, skeletons.runs(classes), *by)


@query(f"WITH RECURSIVE {L.NODES}, {_runs_sql()} {_TOTAL}")
def erl_total(spark, sf):
    return _total(L.nodes(spark, sf))


@query(f"WITH RECURSIVE {L.NODES}, {_runs_sql(least=2, share=0.1)} {_TOTAL}")
def erl_total_tolerant(spark, sf):
    return _total(L.nodes(spark, sf), min_count=2, min_share=0.1)


@query(f"WITH RECURSIVE {L.NODES}, {_runs_sql()}, {_BY_NEURON} FROM per")
def erl_per_neuron(spark, sf):
    return _total(L.nodes(spark, sf), "cell_name")


@query(f"WITH RECURSIVE {L.NODES}, own AS (SELECT * FROM nodes WHERE cell_name LIKE '%3'), {_runs_sql('own')} {_TOTAL}")
def erl_subset(spark, sf):
    nodes = L.nodes(spark, sf)
    return _total(skeletons.of_neurons(nodes, nodes.filter("cell_name like '%3'")))


@query(f"""WITH RECURSIVE {L.NODES}, {_runs_sql()}, {_BY_NEURON}, c AS (SELECT cell_name, sum(length) AS ceiling FROM edges GROUP BY ALL),
h AS (SELECT cell_name, avg((label <> 0)::INT) AS hit FROM nodes GROUP BY ALL)
SELECT cell_name, round(erl / 1000, 3) AS erl_um, round(ceiling / 1000, 3) AS ceiling_um, round(100 * erl / ceiling, 2) AS pct_of_ceiling, round(hit, 6) AS on_segment,
 round(total_length / 1000, 3) AS length_um FROM per JOIN c USING (cell_name) JOIN h USING (cell_name)""")
def erl_report(spark, sf):
    """Worst neurons last.  The ceiling is the score of labels that equal the neurons."""
    nodes = L.nodes(spark, sf)
    perfect = nodes.withColumn("label", F.expr("1 + cast(substring(cell_name, 2) as bigint)"))
    ceiling = _total(perfect, "cell_name").select("cell_name", F.col("erl").alias("ceiling"))
    hit = nodes.groupBy("cell_name").agg(F.avg((F.col("label") != 0).cast("int")).alias("hit"))
    um = lambda c, name: F.round(F.col(c) / 1000, 3).alias(name)
    out = _total(nodes, "cell_name").join(ceiling, "cell_name").join(hit, "cell_name")
    return out.select(
        "cell_name", um("erl", "erl_um"), um("ceiling", "ceiling_um"), F.round(100 * F.col("erl") / F.col("ceiling"), 2).alias("pct_of_ceiling"),
        F.round("hit", 6).alias("on_segment"), um("total_length", "length_um"),
    ).orderBy(F.desc("erl_um"), "cell_name")


@query(f"""WITH RECURSIVE {L.NODES}, {_runs_sql()}, {_BY_NEURON}, g AS (SELECT cell_name, count(*) AS n_nodes, count(DISTINCT z) AS n_slices FROM nodes GROUP BY ALL)
SELECT cell_name, n_nodes, n_slices, erl, n_runs FROM g LEFT JOIN per USING (cell_name)""")
def neuron_report(spark, sf):
    nodes = L.nodes(spark, sf)
    table = nodes.groupBy("cell_name").agg(F.count("*").alias("n_nodes"), F.countDistinct("z").alias("n_slices"))
    return table.join(_total(nodes, "cell_name").select("cell_name", "erl", "n_runs"), "cell_name", "left")


_CHAINS = f"""{L.NODES}, kids AS (SELECT parent_id, count(*) AS kids FROM nodes GROUP BY ALL),
st AS (SELECT node_id, n.parent_id, cell_name, n.parent_id IS NULL OR kids >= 2 AS starts FROM nodes n LEFT JOIN kids USING (parent_id)),
w AS (SELECT node_id, node_id AS head, 0 AS pos, cell_name, parent_id AS origin FROM st WHERE starts
  UNION ALL SELECT s.node_id, w.head, w.pos + 1, w.cell_name, w.origin FROM st s JOIN w ON s.parent_id = w.node_id WHERE NOT s.starts),
ch AS (SELECT cell_name, head, row_number() OVER (PARTITION BY cell_name ORDER BY head) - 1 AS chain_idx, nodes, origin AS origin_branch, origin IS NULL AS is_root
  FROM (SELECT cell_name, head, list(node_id ORDER BY pos) AS nodes, any_value(origin) AS origin FROM w GROUP BY ALL))"""


def _chains(spark, sf):
    return skeletons.chain_table(skeletons.chains(L.nodes(spark, sf)))


@query(f"WITH RECURSIVE {_CHAINS} SELECT cell_name, head, array_to_string(nodes, ',') AS nodes, origin_branch, is_root FROM ch")
def decompose_chains(spark, sf):
    c = _chains(spark, sf)
    return c.select("cell_name", "head", F.array_join(c.nodes.cast("array<string>"), ",").alias("nodes"), "origin_branch", "is_root")


@query(f"WITH RECURSIVE {_CHAINS} SELECT cell_name, chain_idx, len(nodes) AS n_nodes FROM ch WHERE cell_name LIKE 'U1%'")
def chain_enumerate(spark, sf):
    return _chains(spark, sf).filter("cell_name like 'U1%'").select("cell_name", "chain_idx", F.size("nodes").cast("long").alias("n_nodes"))


@query(f"WITH RECURSIVE {_CHAINS} SELECT cell_name, chain_idx, len(nodes) AS n_nodes FROM ch WHERE cell_name IN (SELECT DISTINCT cell_name FROM nodes ORDER BY 1 LIMIT 7)")
def chains_first_n(spark, sf):
    nodes = L.nodes(spark, sf)
    first = nodes.select("cell_name").distinct().orderBy("cell_name").limit(7)
    own = skeletons.chain_table(skeletons.chains(skeletons.of_neurons(nodes, first)))
    return own.select("cell_name", "chain_idx", F.size("nodes").cast("long").alias("n_nodes"))


@query(f"WITH RECURSIVE {_CHAINS} SELECT cell_name, chain_idx, nodes[len(nodes) // 2 + 1] AS anchor FROM ch")
def anchor_node(spark, sf):
    return _chains(spark, sf).select("cell_name", "chain_idx", F.expr("element_at(nodes, cast(size(nodes) div 2 + 1 as int))").alias("anchor"))


_WINDOW = """wd AS (SELECT *, least(1000, greatest(x1 - x0 + 2 * {pad}, {least})) AS w_, least(1000, greatest(y1 - y0 + 2 * {pad}, {least})) AS h_, (x0 + x1) / 2 AS mx, (y0 + y1) / 2 AS my FROM b),
wi AS (SELECT *, greatest(0, floor(mx - w_ / 2))::BIGINT AS "left", greatest(0, floor(my - h_ / 2))::BIGINT AS top, greatest({scale}, ceil(greatest(w_, h_, 1) / {longest}.0))::BIGINT AS crop_scale FROM wd)
SELECT {keys}, "left", top, greatest(1, least(1000, ceil(mx + w_ / 2)) - "left")::BIGINT AS width, greatest(1, least(1000, ceil(my + h_ / 2)) - top)::BIGINT AS height, crop_scale FROM wi"""


def _windows(boxes, *keys, **sizes):
    return skeletons.crop_windows(boxes, (1000, 1000), **sizes).select(*keys, "left", "top", "width", "height", "crop_scale")


@query(f"""WITH RECURSIVE {_CHAINS}, c AS (SELECT cell_name, chain_idx, unnest(nodes) AS node_id FROM ch), b AS (SELECT c.cell_name, chain_idx, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM c JOIN nodes USING (node_id) GROUP BY ALL),
{_WINDOW.format(pad=20, least=90, scale=2, longest=256, keys='cell_name, chain_idx')}""")
def chain_window(spark, sf):
    """Window of each chain's nodes, padded, within the image, and the scale that keeps both sides below 256 px."""
    chain_nodes = skeletons.chains(L.nodes(spark, sf))
    ids = skeletons.chain_table(chain_nodes).select("head", "chain_idx")
    box = chain_nodes.join(L.nodes(spark, sf).select("node_id", "x", "y"), "node_id").groupBy("cell_name", "head").agg(
        *(f(c).alias(f"{c}{i}") for c in "xy" for i, f in enumerate((F.min, F.max))))
    return _windows(box.join(ids, "head"), "cell_name", "chain_idx", pad=20, least=90, scale=2, longest=256)


@query(f"""WITH {L.NODES}, mb AS (SELECT 'U' || c_custkey AS cell_name, min(c_custkey * 7 % 900)::DOUBLE AS x0, max(c_custkey * 7 % 900 + 60)::DOUBLE AS x1, min(c_custkey * 11 % 800)::DOUBLE AS y0, max(c_custkey * 11 % 800 + 30)::DOUBLE AS y1 FROM customer GROUP BY ALL),
u AS (SELECT cell_name, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM nodes GROUP BY ALL),
b AS (SELECT u.cell_name, least(u.x0, mb.x0) AS x0, greatest(u.x1, mb.x1) AS x1, least(u.y0, mb.y0) AS y0, greatest(u.y1, mb.y1) AS y1 FROM u LEFT JOIN mb USING (cell_name)), {_WINDOW.format(pad=12, least=0, scale=2, longest=300, keys='cell_name')}""")
def neuron_window(spark, sf):
    """Window of all of a neuron's nodes and, where it has masks already, of their box."""
    box = L.nodes(spark, sf).groupBy("cell_name").agg(*(f(c).alias(f"{c}{i}") for c in "xy" for i, f in enumerate((F.min, F.max))))
    mask = L.table(spark, sf, "customer").selectExpr("concat('U', c_custkey) as cell_name", "c_custkey * 7 % 900 as a", "c_custkey * 11 % 800 as b").groupBy("cell_name").agg(
        F.min("a").cast("double").alias("a0"), (F.max("a") + 60).cast("double").alias("a1"), F.min("b").cast("double").alias("b0"), (F.max("b") + 30).cast("double").alias("b1"))
    both = box.join(mask, "cell_name", "left").select("cell_name", F.least("x0", "a0").alias("x0"), F.greatest("x1", "a1").alias("x1"), F.least("y0", "b0").alias("y0"), F.greatest("y1", "b1").alias("y1"))
    return _windows(both, "cell_name", pad=12, scale=2, longest=300)


@query(f"WITH {L.NODES}, u AS (SELECT DISTINCT cell_name FROM nodes) SELECT cell_name, (row_number() OVER (ORDER BY cell_name) - 1) // 7 AS chunk FROM u")
def chunks(spark, sf):
    """Disjoint chunks of at most 7 neurons; the window is over the list of names only."""
    names = L.nodes(spark, sf).select("cell_name").distinct()
    return names.select("cell_name", F.expr("cast((row_number() over (order by cell_name) - 1) div 7 as bigint)").alias("chunk"))


_POINTS = "pts AS (SELECT node_id AS point, z, x + node_id % 7 AS px, y + node_id % 5 AS py FROM nodes WHERE node_id % 40 = 0)"


def _points(spark, sf):
    return L.nodes(spark, sf).filter("node_id % 40 = 0").selectExpr("node_id as point", "z", "x + node_id % 7 as px", "y + node_id % 5 as py")


@query(f"""WITH {L.NODES}, {_POINTS}, d AS (SELECT point, node_id, sqrt((x - px) ** 2 + (y - py) ** 2) AS dist FROM pts JOIN nodes USING (z)),
b AS (SELECT point, min(dist) AS dist, arg_min(node_id, (dist, node_id)) AS node_id FROM d WHERE dist <= 6 GROUP BY ALL)
SELECT point, node_id, round(dist, 6) AS dist FROM pts LEFT JOIN b USING (point)""")
def nearest_node(spark, sf):
    return skeletons.nearest(_points(spark, sf), L.nodes(spark, sf), 6.0).withColumn("dist", F.round("dist", 6))


@query(f"""WITH {L.NODES}, {_POINTS}, d AS (SELECT point, node_id, sqrt((x - px) ** 2 + (y - py) ** 2) AS dist FROM pts JOIN nodes USING (z) WHERE node_id <> point),
o AS (SELECT point, row_number() OVER (PARTITION BY point ORDER BY dist, node_id) AS rank, node_id, round(dist, 6) AS dist FROM d) FROM o WHERE rank <= 3""")
def knn_negatives(spark, sf):
    return skeletons.k_nearest(_points(spark, sf), L.nodes(spark, sf), 3).withColumn("dist", F.round("dist", 6))


@query(f"""WITH {L.NODES}, b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM nodes),
c AS (SELECT node_id, floor((x - x0) / (x1 - x0) * 12)::BIGINT AS cx, floor((y - y0) / (y1 - y0) * 12)::BIGINT AS cy FROM nodes, b)
SELECT cx, cy, arg_min(node_id, (node_id * 7919 % 10007, node_id)) AS node_id FROM c WHERE cx < 12 AND cy < 12 GROUP BY ALL""")
def grid_sample(spark, sf):
    """One node per cell that has any, the first by a seeded mix of its id; the far edges lie in no cell."""
    nodes = L.nodes(spark, sf)
    box = nodes.agg(*(f(c).alias(f"{c}{i}") for c in "xy" for i, f in enumerate((F.min, F.max))))
    cell = lambda c: F.floor((F.col(c) - F.col(f"{c}0")) / (F.col(f"{c}1") - F.col(f"{c}0")) * 12)
    c = nodes.join(F.broadcast(box)).select("node_id", cell("x").alias("cx"), cell("y").alias("cy"))  # the box is one row
    return c.filter("cx < 12 and cy < 12").groupBy("cx", "cy").agg(F.min_by("node_id", F.struct(F.expr("node_id * 7919 % 10007"), "node_id")).alias("node_id"))


@query(f"""WITH {L.NODES}, o AS (SELECT cell_name, node_id, row_number() OVER (PARTITION BY cell_name ORDER BY node_id) - 1 AS i, count(*) OVER (PARTITION BY cell_name) AS n FROM nodes)
SELECT cell_name, node_id, i FROM o WHERE i % greatest(1, n // 5) = 0 AND i // greatest(1, n // 5) < 5""")
def even_picks(spark, sf):
    """At most five nodes per neuron at an even stride."""
    w = Window.partitionBy("cell_name")
    o = L.nodes(spark, sf).select("cell_name", "node_id", (F.row_number().over(w.orderBy("node_id")) - 1).cast("long").alias("i"), F.count("*").over(w).alias("n"))
    return o.filter("i % greatest(1, n div 5) = 0 and i div greatest(1, n div 5) < 5").select("cell_name", "node_id", "i")


@query(f"WITH {L.NODES}, s AS (SELECT cell_name, max(z) - min(z) AS span, count(DISTINCT z) AS n_slices FROM nodes GROUP BY ALL) FROM s WHERE n_slices >= 10 ORDER BY span DESC, n_slices DESC, cell_name LIMIT 10")
def widest_span(spark, sf):
    s = L.nodes(spark, sf).groupBy("cell_name").agg((F.max("z") - F.min("z")).alias("span"), F.countDistinct("z").alias("n_slices"))
    return s.filter("n_slices >= 10").orderBy(F.desc("span"), F.desc("n_slices"), "cell_name").limit(10)


_W = {"x": (80, 160), "y": (160, 240)}


@query(f"""WITH {L.NODES}, c AS (SELECT node_id, (x - 80) / 2 AS crop_x, (y - 160) / 2 AS crop_y, x, y FROM nodes)
SELECT node_id, round(crop_x, 9) AS crop_x, round(crop_y, 9) AS crop_y, round((crop_x * 2 + 80) / 8, 9) AS model_x, round((crop_y * 2 + 160) / 8, 9) AS model_y,
 crop_x >= 0 AND crop_x < 80 AND crop_y >= 0 AND crop_y < 120 AS inside FROM c""")
def window_maps(spark, sf):
    """Points in a crop of origin (80, 160), size (160, 240) and scale 2, and through it in the model's space."""
    crop = {f"crop_{c}": (F.col(c) - origin) / 2 for c, (origin, _) in _W.items()}
    n = L.nodes(spark, sf).select("node_id", "x", "y").withColumns(crop)
    inside = F.lit(True)
    for c, (_, size) in _W.items():
        inside = inside & (F.col(f"crop_{c}") >= 0) & (F.col(f"crop_{c}") < size / 2)
    sam = [F.round((F.col(f"crop_{c}") * 2 + origin) / 8, 9).alias(f"model_{c}") for c, (origin, _) in _W.items()]
    return n.select("node_id", *(F.round(c, 9).alias(c) for c in crop), *sam, inside.alias("inside"))


@query(f"""WITH {L.NODES} SELECT node_id, least(greatest(x - 120, 0), 1000 - 240)::DOUBLE AS left_, least(greatest(y - 90, 0), 1000 - 180)::DOUBLE AS top_,
 240 AS width, 180 AS height, greatest(1, ceil(240 / 100.0))::BIGINT AS scale FROM nodes""")
def node_window(spark, sf):
    """A window of 240 x 180 centred on each node and slid into the image of 1000 x 1000."""
    slid = lambda c, size: F.least(F.greatest(F.col(c) - size / 2, F.lit(0.0)), F.lit(1000.0 - size))
    scale = F.greatest(F.lit(1), F.ceil(F.lit(240 / 100.0)))
    return L.nodes(spark, sf).select("node_id", slid("x", 240).alias("left_"), slid("y", 180).alias("top_"), F.lit(240).alias("width"), F.lit(180).alias("height"), scale.alias("scale"))


@query(f"""WITH {L.NODES}, w AS (SELECT node_id, floor(x) AS l, floor(y) AS t FROM nodes)
SELECT node_id, greatest(0, l - 30)::BIGINT AS left_, greatest(0, t - 30)::BIGINT AS top_, (least(1000, l + 130) - greatest(0, l - 30))::BIGINT AS width, (least(1000, t + 130) - greatest(0, t - 30))::BIGINT AS height FROM w""")
def grow_window(spark, sf):
    """Windows of 100 px grown by 30 on each side, within the image."""
    low = lambda c: F.greatest(F.lit(0), F.floor(c) - 30)
    high = lambda c: F.least(F.lit(1000), F.floor(c) + 130)
    return L.nodes(spark, sf).select("node_id", low("x").alias("left_"), low("y").alias("top_"), (high("x") - low("x")).alias("width"), (high("y") - low("y")).alias("height"))


_MAPS = f"""px AS (SELECT slice, y, unnest(range(x0, x1)) AS x, neuron AS lab FROM pred), gx AS (SELECT slice, y, unnest(range(x0, x1)) AS x, neuron AS lab FROM truth),
a AS (SELECT slice, y, x, min(lab) AS seg, count(*) AS n FROM px GROUP BY ALL), b AS (SELECT slice, y, x, min(lab) AS gt FROM gx GROUP BY ALL),
c AS (SELECT coalesce(seg, '') AS seg, gt, count(*) AS n FROM b LEFT JOIN a USING (slice, y, x) WHERE slice IN (SELECT slice FROM pred) GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY seg) AS n_seg, sum(n) OVER (PARTITION BY gt) AS n_gt FROM c),
v AS (SELECT -sum(n * log2(n / n_gt)) / sum(n) AS vs, -sum(n * log2(n / n_seg)) / sum(n) AS vm FROM m), pb AS (SELECT sum(n * (n - 1))::DOUBLE AS b FROM c),
ps AS (SELECT sum(q * (q - 1))::DOUBLE AS s FROM (SELECT sum(n) AS q FROM c GROUP BY seg)), pg AS (SELECT sum(q * (q - 1))::DOUBLE AS g FROM (SELECT sum(n) AS q FROM c GROUP BY gt))"""
#: Nodes through the smoothed registration, at an eighth of its scale, and the label that most pixels around have.
_ON_MAP = f"""at_px AS (SELECT node_id, n.z AS slice, round_even((a * x + b * y + tx) / 8, 0)::BIGINT AS px, round_even((c * x + d * y + ty) / 8, 0)::BIGINT AS py FROM nodes n JOIN smo ON smo.z = greatest(1, least(24, n.z))),
win5 AS (SELECT node_id, substr(seg, 7)::INT AS lab, count(*) AS n FROM at_px JOIN a ON a.slice = at_px.slice AND a.y BETWEEN py - 2 AND py + 2 AND a.x BETWEEN px - 2 AND px + 2 GROUP BY ALL),
most AS (SELECT node_id, arg_max(lab, (n, -lab)) AS lab FROM win5 GROUP BY ALL), on_map AS (SELECT n.* EXCLUDE (label), coalesce(lab, 0) AS label FROM nodes n LEFT JOIN most USING (node_id))"""


def _map_fit(spark, sf):
    return registration.scaled(registration_queries._model(spark, sf), 0.125)


_NUMBER = "cast(substring(neuron, 7) as int)"


@query(f"""WITH RECURSIVE {registration_queries._SMOOTH}, {L.NODES}, {L.RUNS}, {L.TRUTH}, {_MAPS}, {_ON_MAP}, {_runs_sql('on_map', 1, 0.1)}, tot AS ({_TOTAL})
SELECT erl, total_length, (SELECT sum(n - 1)::BIGINT FROM a) AS collisions, round(vs, 6) AS voi_split, round(vm, 6) AS voi_merge, round(1 - 2 * (b / s) * (b / g) / (b / s + b / g), 9) AS are,
 round(1 - b / g, 9) AS split_error, round(1 - b / s, 9) AS merge_error FROM tot, v, pb, ps, pg""")
def labelmap_report(spark, sf):
    """A map of all neurons' masks: pixels claimed twice, both partition scores over the truth's foreground, and the
    run length of the labels that registered nodes find in it."""
    pred, truth = (masks.merged(L.raw_runs(spark, sf, truth=t)) for t in (False, True))
    return labelmaps.report(pred, truth, L.nodes(spark, sf), _map_fit(spark, sf), F.expr(_NUMBER), min_count=1, min_share=0.1)


@query(f"""WITH {registration_queries._SMOOTH}, {L.NODES}, {L.RUNS}, {L.TRUTH}, {_MAPS}, {_ON_MAP} SELECT label, count(*) AS n, count(DISTINCT cell_name) AS n_cells FROM on_map GROUP BY ALL""")
def labelmap_nodes(spark, sf):
    """Nodes by the label that they find in the map of all neurons' masks."""
    runs = masks.composite(masks.merged(L.raw_runs(spark, sf))).withColumn("label", F.expr(_NUMBER)).drop("neuron")
    on = labelmaps.sampled(L.nodes(spark, sf), _map_fit(spark, sf), runs)
    return on.groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("cell_name").alias("n_cells"))


_FRAMES_SQL = f"""{L.NODES}, ch AS (SELECT cell_name AS neuron, node_id % 5 AS chain_idx, node_id, x, y, z, substr(cell_name, 2)::BIGINT AS u FROM nodes),
st AS (SELECT neuron, chain_idx, min(z) + 1 AS lo, max(z) AS hi, (u + chain_idx) % 3 <> 0 AS crop, 100 + 10 * chain_idx AS ox, 200 AS oy, 300 AS w, 400 AS h, 2 + chain_idx % 2 AS scale FROM ch GROUP BY ALL),
pt AS (SELECT neuron, chain_idx, CASE WHEN z BETWEEN lo AND hi THEN z - lo END AS frame, CASE WHEN crop THEN (x - ox) / scale ELSE x / 8 END AS px, CASE WHEN crop THEN (y - oy) / scale ELSE y / 8 END AS py,
 CASE WHEN crop THEN round_even(w / scale, 0) ELSE 1000 / 8 END AS pw, CASE WHEN crop THEN round_even(h / scale, 0) ELSE 1000 / 8 END AS ph FROM ch JOIN st USING (neuron, chain_idx))"""


def _chain_members(spark, sf):
    return L.nodes(spark, sf).selectExpr("cell_name as neuron", "node_id % 5 as chain_idx", "node_id", "x", "y", "z")


def _frame_states(spark, sf):
    """The saved state of each chain: its frames' sections, which leave out the first, and a crop window or none."""
    ends = _chain_members(spark, sf).groupBy("neuron", "chain_idx").agg((F.min("z") + 1).alias("lo"), F.max("z").alias("hi"))
    window = "named_struct('origin_tif', array(100D + 10 * chain_idx, 200D), 'size_tif', array(300, 400), 'crop_scale', cast(2 + chain_idx % 2 as int), 'sam_scale', 8)"
    frames = "if(lo > hi, map(), map_from_arrays(sequence(0L, hi - lo), sequence(lo, hi)))"
    crop = "(cast(substring(neuron, 2) as bigint) + chain_idx) % 3 <> 0"
    return ends.selectExpr("neuron", "chain_idx", f"cast({frames} as map<bigint,bigint>) as frame_to_z", f"if({crop}, {window}, null) as crop_window")


@query(f"""WITH {_FRAMES_SQL} SELECT neuron, chain_idx, frame, count(*) AS n_points, count_if(px >= 0 AND px < pw AND py >= 0 AND py < ph) AS n_inside, round(sum(px), 6) AS sum_x, round(sum(py), 6) AS sum_y FROM pt GROUP BY ALL""")
def frame_points(spark, sf):
    """Nodes of each chain as points on its frames, through its window; those of no frame have frame null."""
    p = skeletons.on_frames(_chain_members(spark, sf), _frame_states(spark, sf), 8, (1000, 1000))
    sums = [F.round(F.sum(f"p{c}"), 6).alias(f"sum_{c}") for c in "xy"]
    return p.groupBy("neuron", "chain_idx", "frame").agg(F.count("*").alias("n_points"), F.count_if(F.col("inside")).alias("n_inside"), *sums)


_ZS = f"{L.NODES}, zs AS (SELECT cell_name, list(DISTINCT z ORDER BY z) AS zs FROM nodes GROUP BY ALL)"


@query(f"WITH {_ZS} SELECT cell_name, zs[len(zs) // 2 + 1] AS z FROM zs")
def middle_slice(spark, sf):
    """The middle one of the slices that each neuron has nodes on."""
    return skeletons.middle_slice(L.nodes(spark, sf), ["cell_name"])


@query(f"""WITH {_ZS}, p AS (SELECT cell_name, zs, unnest(CASE WHEN len(zs) >= 4 THEN [floor(j * (len(zs) - 1) / 3)::BIGINT for j in range(0, 4)] ELSE range(0, len(zs)) END) AS pl FROM zs)
SELECT cell_name, row_number() OVER (PARTITION BY cell_name ORDER BY pl) - 1 AS k, zs[pl + 1] AS z FROM p""")
def even_slices(spark, sf):
    """Four slices of each neuron from its first to its last at even steps."""
    return skeletons.even_slices(L.nodes(spark, sf), ["cell_name"], 4)


@query(f"""WITH RECURSIVE {registration_queries._SMOOTH}, {L.NODES}, {L.RUNS}, {L.TRUTH}, {_MAPS}, {_ON_MAP}, {_runs_sql('on_map', 1, 0.1)}, {_BY_NEURON}, cl AS (SELECT cell_name, sum(length) AS ceiling FROM edges GROUP BY ALL),
h AS (SELECT cell_name, avg((label <> 0)::INT) AS hit FROM on_map GROUP BY ALL)
SELECT cell_name, round(erl / 1000, 3) AS erl_um, round(ceiling / 1000, 3) AS ceiling_um, round(100 * erl / ceiling, 2) AS pct_of_ceiling, round(hit, 6) AS on_segment FROM per JOIN cl USING (cell_name) JOIN h USING (cell_name)""")
def labelmap_erl(spark, sf):
    """Run length of each neuron along the map that its registered nodes find, against that of labels that equal the neurons."""
    runs = masks.composite(masks.merged(L.raw_runs(spark, sf))).withColumn("label", F.expr(_NUMBER)).drop("neuron")
    return labelmaps.against_ceiling(L.nodes(spark, sf), _map_fit(spark, sf), runs, min_count=1, min_share=0.1)
