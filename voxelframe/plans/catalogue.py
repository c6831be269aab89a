"""The registered queries and the SQL each is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelframe.functions import names
from voxelframe.operators import frames, ledgers, masks, metrics, skeletons
from voxelframe.plans.base import QUERIES, SQL, query
from voxelframe.sources import lenses as L

def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)


_EDGES = f"""WITH {L.NODES},
edges AS (SELECT n.*, p.node_id AS p_node_id, p.label AS p_label, p.cell_name AS p_cell_name,
  sqrt(((n.x - p.x) * 2.0) ** 2 + ((n.y - p.y) * 2.0) ** 2 + ((n.z - p.z) * 50.0) ** 2) AS length
  FROM nodes n JOIN nodes p ON n.parent_id = p.node_id)"""
_MERGED = f"""{_EDGES},
ends AS (SELECT node_id, label, cell_name FROM edges UNION SELECT p_node_id, p_label, p_cell_name FROM edges),
cnt AS (SELECT label, cell_name, count(*) AS n FROM ends WHERE label <> 0 GROUP BY ALL),
merged AS (SELECT label, count(*) AS contributors, sum(n)::BIGINT AS n_nodes, string_agg(cell_name, ',' ORDER BY cell_name) AS neurons FROM cnt WHERE n >= {{least}} GROUP BY label HAVING count(*) >= 2)"""
def _merged(least):
    return _MERGED.replace("{least}", str(least))


_FLAGS = f"""WITH {L.FRAMES},
sig AS (SELECT *, lag(area) OVER w AS p_area, lag(x0) OVER w AS p_x0 FROM frames WINDOW w AS (PARTITION BY neuron, chain_idx ORDER BY z)),
sig2 AS (SELECT *, area > 0 AND p_area > 0 AS both_, greatest(0, least(x0 + area, p_x0 + p_area) - greatest(x0, p_x0)) AS shared FROM sig),
sig3 AS (SELECT *, CASE WHEN both_ THEN area / p_area END AS area_ratio, CASE WHEN both_ THEN shared / (area + p_area - shared) END AS temporal_iou FROM sig2),
flags AS (SELECT *, coalesce(pred_iou < 0.3, false)::INT + coalesce(area_ratio < 0.5 OR area_ratio > 2, false)::INT
  + coalesce(temporal_iou < 0.3, false)::INT + coalesce(NOT skeleton_contained, false)::INT AS flag_count FROM sig3)"""


@query(f"{_EDGES} SELECT node_id, parent_id, cell_name, round(length, 6) AS length FROM edges")
def skel_edges(spark, sf):
    return skeletons.edges(L.nodes(spark, sf)).select("node_id", "parent_id", "cell_name", F.round("length", 6).alias("length"))


@query(f"{_merged(1)} SELECT * FROM merged")
def merge_labels(spark, sf):
    return skeletons.merge_labels(skeletons.edges(L.nodes(spark, sf))).withColumn("neurons", F.array_join("neurons", ","))


@query(f"{_merged(2)} SELECT * FROM merged")
def merge_labels_tolerant(spark, sf):
    return skeletons.merge_labels(skeletons.edges(L.nodes(spark, sf)), min_count=2).withColumn("neurons", F.array_join("neurons", ","))


@query(f"""{_merged(1)}, k AS (SELECT cell_name, length, CASE WHEN label = 0 OR p_label = 0 THEN 'background'
 WHEN label IN (SELECT label FROM merged) OR p_label IN (SELECT label FROM merged) THEN 'merge'
 WHEN label <> p_label THEN 'split' ELSE 'ok' END AS class FROM edges)
SELECT cell_name, class, count(*) AS n_edges, round(sum(length), 3) AS length FROM k GROUP BY ALL""")
def edge_classes(spark, sf):
    e = skeletons.edges(L.nodes(spark, sf))
    k = skeletons.edge_classes(e, skeletons.merge_labels(e))
    return k.groupBy("cell_name", "class").agg(F.count("*").alias("n_edges"), F.round(F.sum("length"), 3).alias("length"))


@query(f"WITH {L.NODES} SELECT node_id, cell_name, x, y, label FROM nodes WHERE z = 12")
def nodes_on_slice(spark, sf):
    return L.nodes(spark, sf).filter("z = 12").select("node_id", "cell_name", "x", "y", "label")


@query(f"""WITH {L.NODES} SELECT cell_name, count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1
FROM nodes GROUP BY cell_name""")
def skeleton_bbox(spark, sf):
    ends = [f(c).alias(f"{c}{i}") for c in "xyz" for i, f in enumerate((F.min, F.max))]
    return L.nodes(spark, sf).groupBy("cell_name").agg(F.count("*").alias("n"), *ends)


_COLS = ("neuron", "chain_idx", "z", "area", "flag_count")


@query(f"""{_FLAGS} SELECT neuron, chain_idx, z, area, flag_count, round(area_ratio, 9) AS area_ratio, round(temporal_iou, 9) AS temporal_iou,
 flag_count >= 1 AS flag, flag_count >= 1 AS intervene, flag_count >= 2 AS queue FROM flags""")
def qc_flags(spark, sf):
    r9 = [F.round(c, 9).alias(c) for c in ("area_ratio", "temporal_iou")]
    return frames.flags(L.frames(spark, sf)).select(*_COLS, *r9, "flag", "intervene", "queue")


@query(f"""{_FLAGS} SELECT neuron, chain_idx, count(*) AS n_frames, count_if(flag_count >= 1) AS n_flagged, count_if(flag_count >= 2) AS n_queue,
 count_if(flag_count >= 1) AS n_intervene, count_if(NOT skeleton_contained) AS n_missing, count_if(skeleton_contained IS NULL) AS n_not_assessable, round(count_if(flag_count >= 1) / count(*), 4) AS flag_rate,
 CASE WHEN count_if(flag_count >= 2) >= 1 THEN 'flagged' ELSE 'done' END AS status FROM flags GROUP BY ALL""")
def qc_summary(spark, sf):
    return frames.summary(frames.flags(L.frames(spark, sf)))


_REASONS = """trim(concat(CASE WHEN NOT skeleton_contained THEN 'noskel ' ELSE '' END,
 CASE WHEN area_ratio < 0.5 OR area_ratio > 2 THEN printf('area x%.1f ', round_even(area_ratio, 1)) ELSE '' END,
 CASE WHEN temporal_iou < 0.3 THEN printf('tIoU %.2f ', round_even(temporal_iou, 2)) ELSE '' END, CASE WHEN pred_iou < 0.5 THEN printf('pIoU %.2f', round_even(pred_iou, 2)) ELSE '' END))"""


@query(f"{_FLAGS} SELECT neuron, chain_idx, z, area, flag_count, {_REASONS} AS reasons FROM flags WHERE flag_count >= 2")
def triage_queue(spark, sf):
    q = frames.flags(L.frames(spark, sf)).filter("queue").withColumn("reasons", frames.reasons()).select(*_COLS, "reasons")
    return q.orderBy(F.desc("flag_count"), "neuron", "chain_idx", "z")


@query(f"""{_FLAGS}, r AS (SELECT neuron, chain_idx, z, flag_count, row_number() OVER (PARTITION BY neuron, chain_idx ORDER BY flag_count DESC, z) AS rank
 FROM flags WHERE flag_count >= 2) SELECT * FROM r WHERE rank <= 10""")
def worst_frames(spark, sf):
    return frames.worst(frames.flags(L.frames(spark, sf))).select("neuron", "chain_idx", "z", "flag_count", "rank")


@query(f"""{_FLAGS} SELECT neuron, chain_idx, arg_max(z, (flag_count, -z)) AS flag_z,
 coalesce(arg_max(z, (abs(area_ratio - 1), -z)) FILTER (area_ratio IS NOT NULL), -1) AS ratio_z,
 coalesce(arg_max(z, (abs(area - p_area) / (p_area + 1), -z)) FILTER (p_area IS NOT NULL), -1) AS jump_z,
 round(max(abs(area - p_area) / (p_area + 1)), 9) AS jump FROM flags GROUP BY ALL""")
def failure_frame(spark, sf):
    return frames.failure(frames.flags(L.frames(spark, sf)))


@query(f"WITH {L.PIXELS} SELECT seg, gt, count(*) AS n FROM pixels GROUP BY ALL")
def contingency(spark, sf):
    return metrics.contingency(L.pixels(spark, sf))


_TABLE = f"WITH {L.PIXELS}, c AS (SELECT seg, gt, count(*) AS n FROM pixels GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY seg) AS n_seg, sum(n) OVER (PARTITION BY gt) AS n_gt FROM c)"


@query(f"""{_TABLE}, v AS (SELECT -sum(n * log2(n / n_gt)) / sum(n) AS s, -sum(n * log2(n / n_seg)) / sum(n) AS m, sum(n)::BIGINT AS n_pixels FROM m)
SELECT round(s, 6) AS voi_split, round(m, 6) AS voi_merge, round(s + m, 6) AS voi, n_pixels, round(5 * m + s, 6) AS weighted FROM v""")
def voi_split_merge(spark, sf):
    return metrics.variation_of_information(metrics.contingency(L.pixels(spark, sf)), merge_weight=5.0)


@query(f"""{_TABLE}, b AS (SELECT sum(n * (n - 1))::DOUBLE AS b FROM c), s AS (SELECT sum(k * (k - 1))::DOUBLE AS s FROM (SELECT sum(n) AS k FROM c GROUP BY seg)),
g AS (SELECT sum(k * (k - 1))::DOUBLE AS g FROM (SELECT sum(n) AS k FROM c GROUP BY gt))
SELECT b AS pairs, round(b / s, 9) AS precision, round(b / g, 9) AS recall, round(2 * (b / s) * (b / g) / (b / s + b / g), 9) AS f_score, round(1 - 2 * (b / s) * (b / g) / (b / s + b / g), 9) AS are,
 round(1 - b / g, 9) AS split_error, round(1 - b / s, 9) AS merge_error FROM b, s, g""")
def adapted_rand(spark, sf):
    return metrics.adapted_rand(metrics.contingency(L.pixels(spark, sf)))


@query(f"WITH {L.PIXELS} SELECT slice, gt, count(*) AS n FROM pixels WHERE gt <> 0 GROUP BY ALL")
def present_segments(spark, sf):
    return L.pixels(spark, sf).filter("gt <> 0").groupBy("slice", "gt").agg(F.count("*").alias("n"))


@query(f"WITH {L.RUNS} SELECT * FROM pred")
def neuron_union(spark, sf):
    return masks.merged(L.raw_runs(spark, sf))


@query(f"""WITH {L.RUNS} SELECT slice, neuron, sum(x1 - x0)::BIGINT AS area, round(sum((x1 - x0) * y) / sum(x1 - x0), 9) AS cy,
 round(sum((x1 - x0) * (x0 + x1 - 1)) / 2 / sum(x1 - x0), 9) AS cx FROM pred GROUP BY ALL""")
def mask_moments(spark, sf):
    return masks.moments(masks.merged(L.raw_runs(spark, sf)))


_REGION = f"""WITH {L.RUNS}, {L.TRUTH},
a AS (SELECT slice, neuron, sum(x1 - x0)::BIGINT AS n_pred FROM pred GROUP BY ALL), b AS (SELECT slice, neuron, sum(x1 - x0)::BIGINT AS n_gt FROM truth GROUP BY ALL),
t AS (SELECT p.slice, p.neuron, sum(least(p.x1, g.x1) - greatest(p.x0, g.x0))::BIGINT AS tp FROM pred p JOIN truth g USING (slice, neuron, y)
  WHERE p.x0 < g.x1 AND g.x0 < p.x1 GROUP BY ALL),
k AS (SELECT slice, neuron, coalesce(tp, 0) AS tp, n_pred - coalesce(tp, 0) AS fp, coalesce(n_gt, 0) - coalesce(tp, 0) AS fn, n_pred AS pred_area, coalesce(n_gt, 0) AS gt_area
  FROM a LEFT JOIN b USING (slice, neuron) LEFT JOIN t USING (slice, neuron)
  WHERE neuron IN (SELECT neuron FROM truth) AND slice IN (SELECT slice FROM truth))"""
_RATIO = "round(tp / nullif(tp + fp + fn, 0), 9) AS iou, round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) AS dice, round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) AS recall"


def _counts(spark, sf):
    return masks.region_counts(masks.merged(L.raw_runs(spark, sf)), masks.merged(L.raw_runs(spark, sf, truth=True)))


@query(f"{_REGION} SELECT *, {_RATIO} FROM k")
def region_score(spark, sf):
    return masks.ratios(_counts(spark, sf))


@query(f"""{_REGION}, s AS (SELECT neuron, count(*) AS n_slices, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn,
 round(avg(tp / nullif(tp + fp + fn, 0)), 9) AS macro_iou, round(avg(2 * tp / nullif(2 * tp + fp + fn, 0)), 9) AS macro_dice FROM k GROUP BY ALL), tm AS (SELECT p_brand AS neuron, (count(*) % 7) / 4 AS seconds FROM part GROUP BY ALL)
SELECT s.*, {_RATIO}, round(seconds, 2) AS seconds, CASE WHEN seconds > 0 THEN round(n_slices / seconds, 3) END AS slices_per_s FROM s LEFT JOIN tm USING (neuron)""")
def neuron_rollup(spark, sf):
    timing = L.table(spark, sf, "part").groupBy(F.col("p_brand").alias("neuron")).agg((F.count("*") % 7 / 4).alias("seconds"))
    return masks.rollup(_counts(spark, sf), "neuron", timing=timing)


_LATEST = f"WITH {L.MANIFEST}, {L.REVIEWS}, latest AS (SELECT neuron, chain_idx, arg_max(review, (ts, seq)) AS review FROM reviews GROUP BY ALL)"


@query(f"{_LATEST} SELECT * FROM latest")
def ledger_upsert(spark, sf):
    return ledgers.latest(L.reviews(spark, sf), "review")


@query(f"""{_LATEST} SELECT m.* FROM manifest m ANTI JOIN (SELECT * FROM latest WHERE review IN ('approved', 'corrected', 'rejected')) USING (neuron, chain_idx) WHERE status = 'flagged'""")
def pending_queue(spark, sf):
    return ledgers.pending(L.manifest(spark, sf), L.reviews(spark, sf))


@query(f"{_LATEST} SELECT neuron, chain_idx, coalesce(review, status) AS badge FROM manifest LEFT JOIN latest USING (neuron, chain_idx)")
def chain_status(spark, sf):
    return ledgers.chain_status(L.manifest(spark, sf), L.reviews(spark, sf))


@query(f"""WITH {L.MANIFEST} SELECT *, status NOT IN ('done', 'flagged') AS runs, status NOT IN ('done', 'flagged', 'failed') AS runs_no_retry, true AS runs_forced,
 status = 'flagged' AS second_pass, status IN ('done', 'flagged') AS second_pass_all FROM manifest WHERE neuron < 'N5'""")
def worklist(spark, sf):
    chosen = L.manifest(spark, sf).filter("neuron < 'N5'")
    run = lambda **k: ledgers.should_run(F.col("status"), **k)
    again = lambda **k: ledgers.second_pass(F.col("status"), **k)
    return chosen.withColumns({
        "runs": run(retry_failed=True), "runs_no_retry": run(), "runs_forced": run(force=True), "second_pass": again(), "second_pass_all": again(everywhere=True)})


_S = """CASE c_custkey % 10 WHEN 0 THEN '[' || c_name || ']' WHEN 1 THEN c_name || '!' WHEN 2 THEN '[' || c_name || ']?!' WHEN 3 THEN '  ' || c_name || ' '
 WHEN 4 THEN '[' || c_name || '] note' WHEN 5 THEN c_name || ' !' WHEN 6 THEN '[' || c_name WHEN 7 THEN '[' || c_name || '!]' WHEN 8 THEN '[[' || c_name || ']]' ELSE c_name END"""


@query(f"""WITH r AS (SELECT c_custkey, trim({_S}) AS s FROM customer), c AS (SELECT c_custkey, CASE WHEN starts_with(s, '[') AND contains(s, ']')
 THEN substr(s, 2, length(s) - instr(reverse(s), ']') - 1) ELSE s END AS s FROM r) SELECT c_custkey, trim(rtrim(trim(s), '!?')) AS name FROM c""")
def name_normalize(spark, sf):
    return L.table(spark, sf, "customer").select("c_custkey", names.normalize_name(F.expr(_S)).alias("name"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN 'v_' || c_custkey || '_' || c_nationkey ELSE c_custkey::VARCHAR END AS node_id FROM customer")
def canon_id(spark, sf):
    raw = F.expr("case c_custkey % 3 when 0 then concat(c_custkey, '.0') when 1 then string(c_custkey) else concat('v_', c_custkey, '_', c_nationkey) end")
    return L.table(spark, sf, "customer").select("c_custkey", names.canon_id(raw).alias("node_id"))


@query(f"""WITH {L.NODES}, f AS (SELECT node_id, z, x * 1.11667::DOUBLE + y * 0.03757::DOUBLE - 893.9::DOUBLE AS fx, x * -0.03641::DOUBLE + y * 1.11909::DOUBLE - 427.09::DOUBLE AS fy FROM nodes)
SELECT node_id, round(fx, 10) AS full_x, round(fy, 10) AS full_y, round(fx / 4, 10) AS model_x, round(fy / 4, 10) AS model_y, round(fx / 4 * 4, 10) AS back_x, z + 7 AS file_z FROM f""")
def affine_apply(spark, sf):
    out = skeletons.placed(L.nodes(spark, sf))
    return out.select("node_id", *(F.round(c, 10).alias(c) for c in ("full_x", "full_y", "model_x", "model_y")), F.round(F.col("model_x") * 4, 10).alias("back_x"), "file_z")


@query(f"WITH {L.NODES} SELECT node_id, cell_name, round(x / 2, 9) AS x, round(y / 2, 9) AS y, round(z / 50, 9) AS z FROM nodes")
def node_shape(spark, sf):
    return skeletons.from_nm(L.nodes(spark, sf)).select("node_id", "cell_name", *(F.round(c, 9).alias(c) for c in "xyz"))


@query(f"WITH {L.NODES} SELECT node_id, cell_name, z FROM nodes WHERE z BETWEEN 5 AND 20")
def chains_clip(spark, sf):
    return skeletons.clipped(L.nodes(spark, sf), 5, 20).select("node_id", "cell_name", "z")


@query(f"""WITH {L.NODES}, o AS (SELECT n.*, p.x AS p_x, p.y AS p_y, p.z - n.z AS dz FROM nodes n LEFT JOIN nodes p ON n.parent_id = p.node_id),
m AS (SELECT *, CASE WHEN abs(dz) BETWEEN 2 AND 9 THEN abs(dz) - 1 ELSE 0 END AS missing FROM o),
v AS (SELECT *, unnest(range(1, missing + 1)) AS k FROM m WHERE missing > 0)
SELECT node_id::VARCHAR AS node_id, CASE WHEN missing > 0 THEN 'v_' || node_id || '_' || (z + sign(dz)::BIGINT) ELSE parent_id::VARCHAR END AS parent_id,
 cell_name, round(x, 9) AS x, round(y, 9) AS y, z, false AS is_virtual FROM m
UNION ALL SELECT 'v_' || node_id || '_' || (z + sign(dz)::BIGINT * k), CASE WHEN k < missing THEN 'v_' || node_id || '_' || (z + sign(dz)::BIGINT * (k + 1)) ELSE parent_id::VARCHAR END,
 cell_name, round(x + k / (missing + 1) * (p_x - x), 9), round(y + k / (missing + 1) * (p_y - y), 9), z + sign(dz)::BIGINT * k, true FROM v""")
def virtual_nodes(spark, sf):
    return skeletons.with_virtual_nodes(L.nodes(spark, sf)).withColumns({c: F.round(c, 9) for c in "xy"})


@query(f"{_REGION}, s AS (SELECT count(*) AS n_slices, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM k) SELECT *, {_RATIO} FROM s")
def region_overall(spark, sf):
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn")]
    return masks.ratios(_counts(spark, sf).agg(F.count("*").alias("n_slices"), *sums))


@query(f"WITH {L.RUNS}, {L.TRUTH} SELECT DISTINCT neuron, 'not in truth' AS reason FROM pred WHERE neuron NOT IN (SELECT neuron FROM truth WHERE slice = 3 AND y < 3)")
def skipped_labels(spark, sf):
    known = L.raw_runs(spark, sf, truth=True).filter("slice = 3 and y < 3").select("neuron")
    return masks.skipped(L.raw_runs(spark, sf), known)


@query(f"""WITH {L.PIXELS}, c AS (SELECT seg, gt, count(*) AS n FROM pixels WHERE gt <> 0 GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY seg) AS n_seg, sum(n) OVER (PARTITION BY gt) AS n_gt FROM c),
v AS (SELECT -sum(n * log2(n / n_gt)) / sum(n) AS s, -sum(n * log2(n / n_seg)) / sum(n) AS m, sum(n)::BIGINT AS n_pixels FROM m)
SELECT round(s, 6) AS voi_split, round(m, 6) AS voi_merge, round(s + m, 6) AS voi, n_pixels FROM v""")
def voi_ignore_bg(spark, sf):
    return metrics.variation_of_information(metrics.contingency(L.pixels(spark, sf).filter("gt <> 0")))


@query(f"""WITH {L.MANIFEST}, {L.REVIEWS} SELECT * FROM manifest
UNION ALL SELECT DISTINCT neuron, chain_idx, 'pending' FROM reviews ANTI JOIN manifest USING (neuron, chain_idx)""")
def manifest_seed(spark, sf):
    return ledgers.seeded(L.manifest(spark, sf), L.reviews(spark, sf))


@query(f"WITH {L.MANIFEST}, {L.REVIEWS} SELECT * FROM manifest ANTI JOIN reviews USING (neuron, chain_idx)")
def manifest_reset(spark, sf):
    return ledgers.without(L.manifest(spark, sf), L.reviews(spark, sf))


_PHASES = ["view", "click", "purchase", "error"]


@query("SELECT user_id AS neuron, user_id % 30 AS chain_idx, " + ", ".join(f"sum(event_id % 1000) FILTER (event_type = '{p}')::BIGINT AS \"{p}\"" for p in _PHASES) + " FROM events GROUP BY user_id")
def timing_pivot(spark, sf):
    rows = L.table(spark, sf, "events").selectExpr("user_id as neuron", "user_id % 30 as chain_idx", "event_type as phase", "event_id % 1000 as seconds")
    return ledgers.phase_seconds(rows, _PHASES)


from voxelframe.plans import label_queries, mask_queries, registration_queries, skeleton_queries, stream_queries  # noqa: E402, F401
