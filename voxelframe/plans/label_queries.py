"""Labels, ledgers, states, shards, segments, paths, campaign reports, scores of labellings."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, MapType, StringType, StructField, StructType
from pyspark.sql.window import Window

from voxelframe.operators import drift, frames, labels, ledgers, masks, metrics, segments
from voxelframe.plans.base import query
from voxelframe.plans.catalogue import _FLAGS, _LATEST, _TABLE
from voxelframe.sources import lenses as L


def _flags(spark, sf):
    return frames.flags(L.frames(spark, sf))


_ACTIONS = """acts AS (SELECT event_type AS neuron, user_id AS chain_idx, 1500 + event_id % 30 AS z, ts, event_id AS seq,
  CASE WHEN event_type = 'error' THEN 'wrong' ELSE 'ok' END AS verdict, event_id % 11 = 0 AS is_anchor FROM events)"""
_LABELS = f"""{_ACTIONS}, named AS (SELECT a.*, f.area, f.flag_count, round(f.area_ratio, 9) AS area_ratio, f.flag_count >= 1 AS rule_flagged,
  CASE WHEN is_anchor THEN 'anchor' WHEN f.flag_count >= 2 THEN 'flagged' ELSE 'sampled' END AS role FROM acts a LEFT JOIN flags f USING (neuron, chain_idx, z)),
lab AS (SELECT * EXCLUDE (ts, seq, is_anchor) FROM named QUALIFY row_number() OVER (PARTITION BY neuron, chain_idx, z ORDER BY ts DESC, seq DESC) = 1)"""


def _labels(spark, sf):
    acts = L.table(spark, sf, "events").selectExpr(
        "event_type as neuron", "user_id as chain_idx", "1500 + event_id % 30 as z", "ts", "event_id as seq",
        "if(event_type = 'error', 'wrong', 'ok') as verdict", "event_id % 11 = 0 as is_anchor")
    rows = labels.with_signals(acts, _flags(spark, sf))
    rows = rows.withColumn("role", labels.role(F.col("is_anchor"), F.coalesce(F.col("flag_count") >= 2, F.lit(False))))
    return labels.latest(labels.checked(rows)).drop("ts", "seq", "is_anchor").withColumn("area_ratio", F.round("area_ratio", 9))


@query(f"{_FLAGS}, {_LABELS} FROM lab")
def label_ledger(spark, sf):
    return _labels(spark, sf)


@query(f"{_FLAGS}, {_LABELS} SELECT role, verdict, count(*) AS n, count(DISTINCT (neuron, chain_idx)) AS n_chains FROM lab GROUP BY ALL")
def ledger_summary(spark, sf):
    return labels.summary(_labels(spark, sf))


@query(f"""{_FLAGS}, o AS (SELECT neuron, chain_idx, z, row_number() OVER (PARTITION BY neuron, chain_idx ORDER BY md5(neuron || ':' || chain_idx || ':' || z || ':5'), z) AS nth
 FROM flags WHERE flag_count < 1 AND z <> 1501) SELECT neuron, chain_idx, z, 'ok' AS verdict, 'sampled' AS role FROM o WHERE nth <= 8""")
def sample_unflagged(spark, sf):
    flagged = _flags(spark, sf)
    return labels.sample_unflagged(flagged, 8, 5, exclude=flagged.filter("z = 1501"))


@query(f"""{_LATEST} SELECT neuron, chain_idx, coalesce(review, status, 'unreviewed') AS badge FROM
 (SELECT neuron, chain_idx FROM manifest UNION SELECT neuron, chain_idx FROM latest) LEFT JOIN manifest USING (neuron, chain_idx) LEFT JOIN latest USING (neuron, chain_idx)""")
def chain_badge(spark, sf):
    manifest, last = L.manifest(spark, sf), ledgers.latest(L.reviews(spark, sf), "review")
    return manifest.join(last, ledgers.KEY, "full").select(*ledgers.KEY, F.coalesce("review", "status", F.lit("unreviewed")).alias("badge"))


@query(f"""{_LATEST} SELECT m.* FROM manifest m ANTI JOIN (SELECT * FROM latest WHERE review IN ('approved', 'corrected', 'rejected', 'in_review')) USING (neuron, chain_idx) WHERE status = 'flagged'""")
def pending_unclaimed(spark, sf):
    return ledgers.pending(L.manifest(spark, sf), L.reviews(spark, sf), claimed=False)


@query(f"WITH {L.MANIFEST}, a AS (SELECT 'N' || user_id AS neuron, max(event_id) AS seq FROM events WHERE event_type = 'click' GROUP BY ALL) SELECT neuron, chain_idx, 'approved' AS review, seq FROM manifest JOIN a USING (neuron)")
def neuron_disposition(spark, sf):
    """A disposition of a neuron becomes one of each of its chains."""
    acts = L.table(spark, sf, "events").filter("event_type = 'click'").groupBy(F.expr("concat('N', user_id)").alias("neuron")).agg(F.max("event_id").alias("seq"))
    return L.manifest(spark, sf).join(acts, "neuron").select("neuron", "chain_idx", F.lit("approved").alias("review"), "seq")


@query(f"WITH {L.MANIFEST} SELECT neuron, chain_idx, status, (chain_idx % 4)::BIGINT AS shard, CASE WHEN chain_idx % 4 = 3 THEN NULL ELSE chain_idx * 2 END AS peak FROM manifest WHERE chain_idx % 4 <> 2")
def shard_union(spark, sf):
    """Shards of the manifest; one is missing, one is of an older form without a column."""
    rows = L.manifest(spark, sf).withColumn("shard", F.expr("chain_idx % 4")).withColumn("peak", F.expr("chain_idx * 2"))
    return ledgers.of_shards([rows.filter("shard = 0"), rows.filter("shard = 1"), rows.filter("shard = 3").drop("peak")])


_STATE = StructType([
    StructField("neuron", StringType()), StructField("frame_to_z", MapType(StringType(), IntegerType())),
    StructField("qc_summary", StructType([StructField("n_flagged", IntegerType()), StructField("flag_rate", DoubleType())])),
    StructField("triage_frames", ArrayType(IntegerType())), StructField("phase_seconds", MapType(StringType(), DoubleType())), StructField("chain_crop", BooleanType()),
])
_JSON = """concat('{"neuron":"N', o_custkey, '","frame_to_z":{"0":', o_orderkey % 50, ',"1":', o_orderkey % 50 + 1, '},"qc_summary":',
 case when o_orderkey % 5 = 0 then 'null' else concat('{"n_flagged":', o_orderkey % 7, ',"flag_rate":0.', o_orderkey % 9, '}') end, ',"triage_frames":[', o_orderkey % 50, '],"phase_seconds":{"a":', o_orderkey % 13, ',"b":2.5},"chain_crop":', case when o_orderkey % 2 = 0 then 'true' else 'false' end, '}')"""


def _states(spark, sf):
    return ledgers.states(L.table(spark, sf, "orders").select("o_orderkey", F.expr(_JSON).alias("json")), _STATE)


_SF = "CASE WHEN o_orderkey % 5 = 0 THEN {d} ELSE {v} END"
_RATE = "('0.' || (o_orderkey % 9))::DOUBLE"


@query(f"""SELECT o_orderkey, 'N' || o_custkey AS neuron, {_SF.format(d='0', v='o_orderkey % 7')}::BIGINT AS n_flagged, {_SF.format(d='NULL', v=_RATE)} AS flag_rate,
 1 AS n_triage, o_orderkey % 50 AS first_z, o_orderkey % 50 + 1 AS last_z FROM orders""")
def state_json(spark, sf):
    s = _states(spark, sf)
    z = F.map_values("frame_to_z")
    return s.select("o_orderkey", "neuron", F.coalesce(s.qc_summary.n_flagged.cast("long"), F.lit(0)).alias("n_flagged"), s.qc_summary.flag_rate.alias("flag_rate"),
                    F.size("triage_frames").alias("n_triage"), F.array_min(z).cast("long").alias("first_z"), F.array_max(z).cast("long").alias("last_z"))


@query(f"SELECT o_orderkey, (o_orderkey % 13 + 2.5)::DOUBLE AS seconds, {_SF.format(d='NULL', v='o_orderkey % 7')}::BIGINT AS n_flagged, o_orderkey % 2 = 0 AS chain_crop FROM orders")
def run_summary(spark, sf):
    total = F.aggregate(F.map_values("phase_seconds"), F.lit(0.0), lambda a, b: a + b)
    s = _states(spark, sf)
    return s.select("o_orderkey", total.alias("seconds"), s.qc_summary.n_flagged.cast("long").alias("n_flagged"), "chain_crop")


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 4 WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 7 END::BIGINT AS n_flagged FROM orders")
def state_patch(spark, sf):
    """The summary of a new check replaces the saved one, chain by chain."""
    new = L.table(spark, sf, "orders").filter("o_orderkey % 3 = 0").groupBy("o_orderkey").agg(F.max(F.expr("o_orderkey % 4")).alias("new"))
    s = _states(spark, sf)
    return s.join(new, "o_orderkey", "left").select("o_orderkey", F.coalesce("new", s.qc_summary.n_flagged.cast("long")).alias("n_flagged"))


@query(f"""{_FLAGS}, m AS (SELECT neuron, chain_idx, z, z - 1500 AS frame_idx FROM frames WHERE z % 7 <> 0), x AS (SELECT neuron, chain_idx, count(*) AS n_masks, count(m.frame_idx) AS n_mapped,
 count(*) - count(m.frame_idx) AS n_unmapped, count_if(m.frame_idx IS NOT NULL AND flag_count >= 2) AS n_flagged FROM flags LEFT JOIN m USING (neuron, chain_idx, z) GROUP BY ALL) FROM x""")
def review_chain(spark, sf):
    """Masks of a chain joined to its frame map; masks without a frame are counted and dropped."""
    flagged = _flags(spark, sf)
    frame_map = L.frames(spark, sf).filter("z % 7 <> 0").select(*labels.FRAME, F.expr("z - 1500").alias("frame_idx"))
    n = F.count("frame_idx")
    return flagged.join(frame_map, labels.FRAME, "left").groupBy("neuron", "chain_idx").agg(
        F.count("*").alias("n_masks"), n.alias("n_mapped"), (F.count("*") - n).alias("n_unmapped"), F.count_if(F.expr("frame_idx is not null and queue")).alias("n_flagged"))


@query(f"{_FLAGS} SELECT 'N_' || neuron AS cell_name, chain_idx, z, flag_count FROM flags WHERE flag_count >= 1")
def triage_export(spark, sf):
    return _flags(spark, sf).filter("flag").select(F.concat(F.lit("N_"), "neuron").alias("cell_name"), "chain_idx", "z", "flag_count")


@query(f"""WITH {L.FRAMES}, u AS (SELECT DISTINCT z, z - 7 AS stack_z FROM frames WHERE z BETWEEN 1503 AND 1512) SELECT z, stack_z, row_number() OVER (ORDER BY z) - 1 AS frame_idx, 'frame_' || lpad(z::VARCHAR, 5, '0') AS key FROM u""")
def frame_range(spark, sf):
    """Slices in a range whose bounds may come in any order, with a dense index; the window is over slices only."""
    low, high = F.least(F.lit(1512), F.lit(1503)), F.greatest(F.lit(1512), F.lit(1503))
    u = L.frames(spark, sf).filter(F.col("z").between(low, high)).select("z").distinct()
    return u.select("z", (F.col("z") - 7).alias("stack_z"), (F.row_number().over(Window.orderBy("z")) - 1).cast("long").alias("frame_idx"), F.concat(F.lit("frame_"), F.lpad(F.col("z").cast("string"), 5, "0")).alias("key"))


@query(f"""{_FLAGS}, s AS (SELECT neuron, chain_idx, round(avg((NOT skeleton_contained)::INT), 9) AS rate, count(*) AS n_frames FROM flags GROUP BY ALL HAVING bool_or(skeleton_contained))
 FROM s WHERE rate > 0 ORDER BY rate DESC, neuron, chain_idx LIMIT 20""")
def suspects(spark, sf):
    """Chains with a contained frame whose skeleton is missed most often in the frames that can be judged."""
    s = _flags(spark, sf).groupBy("neuron", "chain_idx").agg(F.round(F.avg((~F.col("skeleton_contained")).cast("int")), 9).alias("rate"), F.count("*").alias("n_frames"), F.bool_or("skeleton_contained").alias("some"))
    return s.filter("some and rate > 0").orderBy(F.desc("rate"), "neuron", "chain_idx").limit(20).drop("some")


@query("SELECT event_type AS neuron, user_id AS chain_idx, round(avg(1 / (1 + exp(-(value - 50) / 10))), 6) AS conf, count(*) AS n FROM events WHERE value > 50 GROUP BY ALL")
def logit_conf(spark, sf):
    """Mean sigmoid of the positive logits."""
    e = L.table(spark, sf, "events").select(F.col("event_type").alias("neuron"), F.col("user_id").alias("chain_idx"), ((F.col("value") - 50) / 10).alias("logit"))
    return e.filter("logit > 0").groupBy("neuron", "chain_idx").agg(F.round(F.avg(1 / (1 + F.exp(-F.col("logit")))), 6).alias("conf"), F.count("*").alias("n"))


@query(f"""{_FLAGS}, c AS (SELECT chain_idx, count_if(flag_count >= 2) FILTER (neuron = 'view') AS a, count_if(flag_count >= 2) FILTER (neuron = 'click') AS b FROM flags WHERE neuron IN ('view', 'click') GROUP BY ALL HAVING count(DISTINCT neuron) = 2)
SELECT count_if(b < a) AS improved, count_if(b > a) AS regressed, count_if(a = b) AS unchanged, sum(b - a)::BIGINT AS net FROM c""")
def ab_paired(spark, sf):
    """Two modes of the same chains, side by side."""
    q = _flags(spark, sf).groupBy("neuron", "chain_idx").agg(F.count_if("queue").alias("n"))
    mode = lambda m, c: q.filter(F.col("neuron") == m).select("chain_idx", F.col("n").alias(c))
    both = mode("view", "a").join(mode("click", "b"), "chain_idx")
    return both.agg(F.count_if(F.expr("b < a")).alias("improved"), F.count_if(F.expr("b > a")).alias("regressed"), F.count_if(F.expr("a = b")).alias("unchanged"), F.sum(F.expr("b - a")).alias("net"))


@query(f"{_FLAGS} SELECT neuron AS config, count_if(flag_count >= 2) AS n_queue, count_if(area = 0) AS n_errors, count(DISTINCT chain_idx) AS n_chains FROM flags GROUP BY ALL")
def ab_ranking(spark, sf):
    g = _flags(spark, sf).groupBy(F.col("neuron").alias("config"))
    return g.agg(F.count_if("queue").alias("n_queue"), F.count_if(F.expr("area = 0")).alias("n_errors"), F.countDistinct("chain_idx").alias("n_chains")).orderBy("n_queue", "config")


#: Variants 1 to 4 of the masks: moved by so many pixels and without some; each is scored against the truth.
_SCREEN = f"""{L.TRUTH}, vr AS (SELECT unnest([1, 2, 3, 4]) AS variant), rw AS (SELECT variant, p_partkey % 20 AS slice, p_brand AS neuron, p_partkey // 20 % 40 AS y, p_partkey * 13 % 90 + variant - 1 AS x0, p_partkey * 13 % 90 + p_size + variant - 1 AS x1 FROM part, vr WHERE p_partkey % (variant + 4) <> 0),
fr AS (SELECT *, CASE WHEN x0 <= max(x1) OVER (PARTITION BY variant, slice, neuron, y ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM rw),
il AS (SELECT *, sum(f) OVER (PARTITION BY variant, slice, neuron, y ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS k FROM fr), vp AS (SELECT variant, slice, neuron, y, min(x0) AS x0, max(x1) AS x1 FROM il GROUP BY variant, slice, neuron, y, k),
va AS (SELECT variant, slice, neuron, sum(x1 - x0) AS a FROM vp GROUP BY ALL), vg AS (SELECT slice, neuron, sum(x1 - x0) AS g FROM truth GROUP BY ALL),
vt AS (SELECT variant, p.slice, p.neuron, sum(least(p.x1, t.x1) - greatest(p.x0, t.x0)) AS tp FROM vp p JOIN truth t ON p.slice = t.slice AND p.neuron = t.neuron AND p.y = t.y AND p.x0 < t.x1 AND t.x0 < p.x1 GROUP BY ALL),
s AS (SELECT variant, sum(coalesce(tp, 0)) / sum(a + coalesce(g, 0) - coalesce(tp, 0)) AS iou, count(*) AS n FROM va LEFT JOIN vg USING (slice, neuron) LEFT JOIN vt USING (variant, slice, neuron)
 WHERE neuron IN (SELECT neuron FROM truth) AND slice IN (SELECT slice FROM truth) GROUP BY ALL)"""


def _screen(spark, sf):
    """Overlap of each variant with the truth, over the pixels of all its neurons, from the score of its regions."""
    rows = L.table(spark, sf, "part").withColumn("variant", F.explode(F.sequence(F.lit(1), F.lit(4)))).filter("p_partkey % (variant + 4) <> 0")
    runs = rows.selectExpr(
        "p_partkey % 20 as slice", "concat(variant, '/', p_brand) as neuron", "p_partkey div 20 % 40 as y", "p_partkey * 13 % 90 + variant - 1 as x0", "p_partkey * 13 % 90 + p_size + variant - 1 as x1")
    truth = masks.merged(L.raw_runs(spark, sf, truth=True)).withColumn("variant", F.explode(F.sequence(F.lit(1), F.lit(4))))
    truth = truth.withColumn("neuron", F.concat_ws("/", "variant", "neuron")).drop("variant")
    counts = masks.region_counts(masks.merged(runs), truth)
    over = F.sum("tp").cast("double") / F.sum(F.col("tp") + F.col("fp") + F.col("fn"))
    return counts.groupBy(F.split("neuron", "/")[0].cast("int").alias("variant")).agg(over.alias("iou"), F.count("*").alias("n"))


@query(f"WITH {_SCREEN} SELECT s.variant, round(s.iou, 9) AS iou, round(s.iou - b.iou, 9) AS delta, s.n FROM s, (SELECT iou FROM s WHERE variant = 1) b")
def ab_deltas(spark, sf):
    """Variants against the baseline, which is one row."""
    s = _screen(spark, sf)
    base = s.filter("variant = 1").select(F.col("iou").alias("base"))
    return s.crossJoin(F.broadcast(base)).select("variant", F.round("iou", 9).alias("iou"), F.round(F.col("iou") - F.col("base"), 9).alias("delta"), "n")


@query(f"WITH {_SCREEN}, t AS (SELECT variant FROM s WHERE variant <> 1 ORDER BY iou DESC, variant LIMIT 2) FROM t UNION ALL SELECT 1")
def ab_winners(spark, sf):
    s = _screen(spark, sf)
    return s.filter("variant <> 1").orderBy(F.desc("iou"), "variant").limit(2).select("variant").unionByName(s.filter("variant = 1").select("variant"))


@query(f"""WITH {_SCREEN} SELECT '{{"variant":' || variant || ',"n":' || n || '}}' AS record FROM s""")
def measurement_log(spark, sf):
    return _screen(spark, sf).select(F.to_json(F.struct("variant", "n")).alias("record"))


@query(f"""{_TABLE}, v AS (SELECT -sum(n * log2(n / n_gt)) / sum(n) AS s, -sum(n * log2(n / n_seg)) / sum(n) AS m, sum(n)::BIGINT AS n_pixels FROM m),
b AS (SELECT sum(n * (n - 1))::DOUBLE AS b FROM c), s AS (SELECT sum(k * (k - 1))::DOUBLE AS s FROM (SELECT sum(n) AS k FROM c GROUP BY seg)), g AS (SELECT sum(k * (k - 1))::DOUBLE AS g FROM (SELECT sum(n) AS k FROM c GROUP BY gt))
SELECT round(v.s, 6) AS voi_split, round(v.m, 6) AS voi_merge, round(v.s + v.m, 6) AS voi, n_pixels, round(1 - 2 * (b / s.s) * (b / g) / (b / s.s + b / g), 9) AS are FROM v, b, s, g""")
def voi_arand(spark, sf):
    """Both scores from one joint histogram."""
    table = metrics.contingency(L.pixels(spark, sf))
    return metrics.variation_of_information(table).crossJoin(metrics.adapted_rand(table).select("are"))  # one row each


@query(f"""WITH {L.PIXELS}, p AS (SELECT seg, CASE WHEN gt IN (1, 2, 3, 5) THEN gt ELSE 0 END AS gt FROM pixels), c AS (SELECT seg, gt, count(*) AS n FROM p GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY seg) AS n_seg, sum(n) OVER (PARTITION BY gt) AS n_gt FROM c)
SELECT round(-sum(n * log2(n / n_gt)) / sum(n), 6) AS voi_split, round(-sum(n * log2(n / n_seg)) / sum(n), 6) AS voi_merge, round(-sum(n * log2(n / n_gt)) / sum(n) - sum(n * log2(n / n_seg)) / sum(n), 6) AS voi, sum(n)::BIGINT AS n_pixels FROM m""")
def voi_scored(spark, sf):
    """Truth outside the scored segments becomes background."""
    p = L.pixels(spark, sf).withColumn("gt", F.when(F.col("gt").isin(1, 2, 3, 5), F.col("gt")).otherwise(0))
    return metrics.variation_of_information(metrics.contingency(p))


@query(f"WITH {L.PIXELS} SELECT gt, string_agg(DISTINCT slice::VARCHAR, ',' ORDER BY slice::VARCHAR) AS slices FROM pixels WHERE gt <> 0 GROUP BY ALL")
def segment_slices(spark, sf):
    return L.pixels(spark, sf).filter("gt <> 0").groupBy("gt").agg(F.array_join(F.array_sort(F.collect_set(F.col("slice").cast("string"))), ",").alias("slices"))


@query("SELECT l_linenumber AS slice, (l_partkey % 100) // 4 AS y, (l_suppkey % 40) // 4 AS x, round(avg(l_quantity), 6) AS value FROM lineitem GROUP BY ALL")
def tile_downscale(spark, sf):
    """Mean of each block of 4 x 4 pixels."""
    px = L.table(spark, sf, "lineitem").selectExpr("l_linenumber as slice", "l_partkey % 100 as y", "l_suppkey % 40 as x", "l_quantity as v")
    return px.groupBy("slice", F.expr("y div 4").alias("y"), F.expr("x div 4").alias("x")).agg(F.round(F.avg("v"), 6).alias("value"))


_NAME = "CASE WHEN p_size % 7 = 0 THEN 'phagosome' || p_partkey WHEN p_size % 4 = 0 THEN '[' || p_brand || ']_' || p_partkey || '.swc' ELSE p_brand || '_' || p_partkey || '.swc' END"
_META = f"""seg AS (SELECT p_partkey AS nr, {_NAME} AS name, CASE WHEN p_size % 7 = 0 THEN 'phagosome' || p_partkey ELSE p_brand END AS label, p_size % 7 <> 0 AND p_size % 4 = 0 AS bracketed,
 CASE WHEN p_size % 7 <> 0 THEN p_partkey END AS skeleton_id, CASE WHEN p_size % 7 = 0 THEN 'organelle' ELSE 'neuron' END AS kind, p_size, p_partkey FROM part WHERE p_partkey % 50 <> 0)"""


def _segments(spark, sf):
    numbers = ", ' ', ".join(["p_partkey", *("p_size" for _ in range(17)), "p_partkey % 90", "p_partkey % 40", "p_size % 9", "p_partkey % 90 + p_size", "p_partkey % 40 + 5", "p_size % 9 + 3"])
    name = "case when p_size % 7 = 0 then concat('phagosome', p_partkey) when p_size % 4 = 0 then concat('[', p_brand, ']_', p_partkey, '.swc') else concat(p_brand, '_', p_partkey, '.swc') end"
    line = f"concat(if(p_partkey % 50 = 0, '% ', ''), {numbers}, ' \"', {name}, '\"')"
    return segments.parsed(L.table(spark, sf, "part").select(F.expr(line).alias("line")))


@query(f"WITH {_META} SELECT nr, name, label, bracketed, skeleton_id, kind, p_size AS flags FROM seg")
def segment_parse(spark, sf):
    return _segments(spark, sf).select("nr", "name", "label", "bracketed", "skeleton_id", "kind", "flags")


@query(f"WITH {_META} SELECT nr, label FROM seg WHERE contains(lower(label), 'brand#1') OR contains(lower(name), 'brand#1')")
def segment_find(spark, sf):
    return segments.find(_segments(spark, sf), "BRAND#1").select("nr", "label")


@query(f"WITH {_META} SELECT DISTINCT label FROM seg WHERE kind = 'neuron'")
def segment_kinds(spark, sf):
    return _segments(spark, sf).filter("kind = 'neuron'").select("label").distinct().orderBy("label")


@query(f"WITH {_META} SELECT nr, p_partkey % 90 // 4 AS x1, p_partkey % 40 // 4 AS y1, (p_partkey % 90 + p_size) // 4 AS x2, (p_partkey % 40 + 5) // 4 AS y2, p_size % 9 AS z1, p_size % 9 + 3 AS z2 FROM seg")
def segment_bbox(spark, sf):
    return segments.bbox(_segments(spark, sf), 4)


@query(f"WITH {_META}, px AS (SELECT l_linenumber AS slice, l_partkey AS nr, count(*) AS n FROM lineitem GROUP BY ALL) SELECT label, slice, sum(n)::BIGINT AS area, count(*) AS n_segments FROM seg JOIN px USING (nr) WHERE kind = 'neuron' GROUP BY ALL")
def gt_neuron_area(spark, sf):
    """Pixels of a neuron on a slice: all of its segments."""
    px = L.table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("slice"), F.col("l_partkey").alias("nr")).agg(F.count("*").alias("n"))
    own = _segments(spark, sf).filter("kind = 'neuron'").select("nr", "label")
    return own.join(px, "nr").groupBy("label", "slice").agg(F.sum("n").alias("area"), F.count("*").alias("n_segments"))


def _paths(spark, sf):
    path = "concat('/out/', c_name, '/chain_', lpad(string(c_custkey % 30), 2, '0'), '/masks/mask_', lpad(string(c_custkey), greatest(4, length(string(c_custkey))), '0'), '.png')"
    return L.table(spark, sf, "customer").select(ledgers.of_path(F.expr(path)).alias("p")).select("p.*")


@query("SELECT c_name AS neuron, c_custkey % 30 AS chain_idx, c_custkey AS z FROM customer")
def path_parse(spark, sf):
    return _paths(spark, sf)


@query("SELECT (c_custkey % 30)::BIGINT AS chain_idx, count(*) AS n_neurons, min(c_name) AS first FROM customer GROUP BY ALL")
def chains_on_disk(spark, sf):
    return _paths(spark, sf).select("neuron", "chain_idx").distinct().groupBy("chain_idx").agg(F.count("*").alias("n_neurons"), F.min("neuron").alias("first"))


_ACTS = """last AS (SELECT event_type AS neuron, user_id AS chain_idx, max(event_id) AS k FROM events GROUP BY ALL),
ra AS (SELECT neuron, chain_idx, CASE WHEN k % 2 = 0 THEN 'approve' ELSE 'reject' END AS action, CASE WHEN k % 3 = 0 THEN 'leak' ELSE 'drift' END AS error_type, 1500 + k % 5 AS anchor_z FROM last WHERE chain_idx % 4 <> 0)"""


@query(f"""{_FLAGS}, {_ACTS}, qd AS (SELECT f.neuron, f.chain_idx, f.z, CASE WHEN action = 'approve' THEN 'ok' ELSE 'wrong' END AS verdict, CASE WHEN z = anchor_z THEN 'anchor' ELSE 'flagged' END AS role,
 CASE WHEN action = 'reject' THEN error_type END AS error_type, action AS source FROM flags f JOIN ra USING (neuron, chain_idx) WHERE flag_count >= 2),
so AS (SELECT neuron, chain_idx, z, row_number() OVER (PARTITION BY neuron, chain_idx ORDER BY md5(neuron || ':' || chain_idx || ':' || z || ':3'), z) AS nth
 FROM flags JOIN ra USING (neuron, chain_idx) WHERE flag_count < 1)
FROM qd UNION ALL SELECT neuron, chain_idx, z, 'ok', 'sampled', NULL, 'sample' FROM so WHERE nth <= 8""")
def action_labels(spark, sf):
    """Approved and rejected chains as labels of their queued frames, and of a sample of the others."""
    last = L.table(spark, sf, "events").groupBy(F.col("event_type").alias("neuron"), F.col("user_id").alias("chain_idx")).agg(F.max("event_id").alias("k"))
    acts = last.filter("chain_idx % 4 <> 0").selectExpr(
        "neuron", "chain_idx", "if(k % 2 = 0, 'approve', 'reject') as action", "if(k % 3 = 0, 'leak', 'drift') as error_type", "1500 + k % 5 as anchor_z")
    shown = _flags(spark, sf).withColumn("flag", F.col("flag_count") >= 1)
    return labels.expanded(acts, shown.filter("flag_count >= 2"), shown, 8, 3)


@query(f"""WITH {L.CHAIN_STATES}, {L.MANIFEST}, sv AS (SELECT neuron, chain_idx, k FROM chain_k WHERE k % 4 = 0), wn AS (SELECT neuron, min(ox) AS ox, min(oy) AS oy, (max(ox + w) - min(ox))::INT AS w, (max(oy + h) - min(oy))::INT AS h FROM chain_states GROUP BY ALL),
na AS (SELECT neuron, CASE WHEN max(k) % 2 = 0 THEN 'approved' ELSE 'rejected' END AS review, min(k) + 5 AS seq FROM chain_k WHERE k % 3 = 1 GROUP BY ALL),
rv AS (SELECT neuron, chain_idx, review, seq FROM chain_k JOIN na USING (neuron) UNION ALL SELECT neuron, chain_idx, 'corrected', k FROM sv), lt AS (SELECT neuron, chain_idx, arg_max(review, (seq, review)) AS review FROM rv GROUP BY ALL)
SELECT k.neuron, k.chain_idx, review, CASE WHEN sv.k IS NOT NULL AND wn.ox IS NOT NULL THEN wn.ox ELSE c.ox END AS origin_x, CASE WHEN sv.k IS NOT NULL AND wn.ox IS NOT NULL THEN wn.w ELSE c.w END AS width,
 CASE WHEN sv.k IS NOT NULL AND wn.ox IS NOT NULL THEN greatest(4, ceil(greatest(wn.w, wn.h) / 200)) ELSE c.scale END::INT AS scale
FROM chain_k k LEFT JOIN chain_states c USING (neuron, chain_idx) LEFT JOIN sv USING (neuron, chain_idx) LEFT JOIN wn USING (neuron) LEFT JOIN lt USING (neuron, chain_idx)""")
def branch_saved(spark, sf):
    """Neurons approved or rejected as a whole, and branches saved on their own: dispositions and windows after."""
    states = L.chain_states(spark, sf)
    k = L.table(spark, sf, "customer").selectExpr("concat('Brand#', 1 + c_custkey % 5, 1 + c_custkey div 5 % 5) as neuron", "c_custkey % 7 as chain_idx", "c_custkey as k").groupBy("neuron", "chain_idx").agg(F.min("k").alias("k"))
    left, top, right, bottom = (f("crop_window.origin_tif")[i] for f, i in ((F.col, 0), (F.col, 1), (F.col, 0), (F.col, 1)))
    size = F.col("crop_window.size_tif")
    w = states.filter("crop_window is not null").groupBy("neuron").agg(F.min(left).alias("x0"), F.min(top).alias("y0"), F.max(right + size[0]).alias("x1"), F.max(bottom + size[1]).alias("y1"))
    windows = w.selectExpr("neuron", """named_struct('origin_tif', array(x0, y0), 'size_tif', array(cast(x1 - x0 as int), cast(y1 - y0 as int)),
        'crop_scale', cast(greatest(4, ceil(greatest(cast(x1 - x0 as int), cast(y1 - y0 as int)) / 200)) as int), 'sam_scale', 8) as crop_window""")
    now = F.lit(0).alias("ts")
    whole = k.filter("k % 3 = 1").groupBy("neuron").agg(F.max("k").alias("m"), (F.min("k") + 5).alias("seq"))
    whole = whole.select("neuron", F.expr("if(m % 2 = 0, 'approved', 'rejected')").alias("review"), now, "seq")
    states, corrected = ledgers.saved(states, k.filter("k % 4 = 0").select("neuron", "chain_idx", now, F.col("k").alias("seq")), windows)
    reviews = ledgers.of_neurons(k, whole).unionByName(corrected)
    last = reviews.groupBy("neuron", "chain_idx").agg(F.max_by("review", F.struct("seq", "review")).alias("review"))
    c = F.col("crop_window")
    return states.join(last, ["neuron", "chain_idx"], "left").select("neuron", "chain_idx", "review", c["origin_tif"][0].alias("origin_x"), c["size_tif"][0].alias("width"), c["crop_scale"].alias("scale"))


_DRIFT = f"""WITH {L.CHAIN_RUNS}, {L.CHAIN_STATES}, cen AS (SELECT neuron, chain_idx, slice AS z, sum((x1 - x0) * (x0 + x1 - 1)) / 2 / sum(x1 - x0) AS cx, sum((x1 - x0) * y) / sum(x1 - x0) AS cy,
 CASE WHEN slice % 3 = 0 THEN NULL ELSE (slice + chain_idx) % 4 <> 0 END AS contained FROM chain_runs GROUP BY ALL),
nd AS (SELECT 'Brand#' || (1 + c_custkey % 5) || (1 + c_custkey // 5 % 5) AS neuron, c_custkey % 7 AS chain_idx, c_custkey % 20 AS z, avg(c_custkey * 7 % 145) AS nx, avg(c_custkey * 3 % 40) AS ny FROM customer GROUP BY ALL),
o AS (SELECT *, nx - CASE WHEN scale IS NULL THEN cx ELSE (cx * scale + ox) / 8 END AS offx, ny - CASE WHEN scale IS NULL THEN cy ELSE (cy * scale + oy) / 8 END AS offy, z - 8 AS zoff FROM cen JOIN nd USING (neuron, chain_idx, z) LEFT JOIN chain_states USING (neuron, chain_idx)),
d AS (SELECT *, sqrt(offx ** 2 + offy ** 2) AS dist, scale IS NOT NULL AS tier2 FROM o)"""


def _drift(spark, sf):
    n = F.col("x1") - F.col("x0")
    cen = L.chain_runs(spark, sf).groupBy("neuron", "chain_idx", F.col("slice").alias("z")).agg(
        (F.sum(n * (F.col("x0") + F.col("x1") - 1)) / 2 / F.sum(n)).alias("cx"), (F.sum(n * F.col("y")) / F.sum(n)).alias("cy"))
    cen = cen.withColumn("contained", F.expr("if(z % 3 = 0, null, (z + chain_idx) % 4 <> 0)"))
    nodes = L.table(spark, sf, "customer").selectExpr(
        "concat('Brand#', 1 + c_custkey % 5, 1 + c_custkey div 5 % 5) as neuron", "c_custkey % 7 as chain_idx", "c_custkey % 20 as z", "c_custkey * 7 % 145 as xs", "c_custkey * 3 % 40 as ys")
    return drift.offsets(cen, nodes, L.chain_states(spark, sf), 8, 8)


@query(f"""{_DRIFT}, g AS (SELECT (floor(zoff / 4) * 4)::BIGINT AS bin, count(*) AS n, avg(offx) AS mx, avg(offy) AS my, avg(dist) AS md, avg(coalesce(contained, false)::INT) AS contained FROM d GROUP BY ALL)
SELECT bin, n, round(mx, 6) AS mean_x, round(my, 6) AS mean_y, round(sqrt(mx ** 2 + my ** 2), 6) AS common, round(md, 6) AS mean_dist, round(contained, 6) AS contained, round(sqrt(mx ** 2 + my ** 2) / greatest(md, 1e-6), 6) AS coherence FROM g""")
def drift_bins(spark, sf):
    """How far registered nodes lie from the masks that followed them, per bin of sections from the fit."""
    r = lambda c: F.round(c, 6).alias(c)
    return drift.bins(_drift(spark, sf), 4).select("bin", "n", r("mean_x"), r("mean_y"), r("common"), r("mean_dist"), r("contained"), r("coherence"))


@query(f"""{_DRIFT}, s AS (SELECT z, sqrt(avg(offx) ** 2 + avg(offy) ** 2) AS common FROM d GROUP BY z HAVING count(*) >= 3), f AS (SELECT sqrt(avg(offx) ** 2 + avg(offy) ** 2) AS common FROM d WHERE z >= (SELECT max(z) FROM d) - 5),
t AS (SELECT CASE WHEN count(*) > 3 THEN corr(z, common) END AS r, count(*) AS n FROM s)
SELECT count(*) AS n, count(DISTINCT (neuron, chain_idx)) AS n_chains, round(avg(dist), 6) AS mean, round(avg(coalesce(contained, false)::INT), 6) AS contained, round(corr(zoff, dist), 6) AS r_dist, (SELECT n FROM t) AS n_sections, (SELECT round(r, 6) FROM t) AS r_common,
 (SELECT round(common, 6) FROM f) AS far_common, round(quantile_cont(dist, 0.5), 6) AS median, round(quantile_cont(dist, 0.9), 6) AS p90, round(quantile_cont(dist, 0.5) FILTER (tier2), 6) AS median_crop, round(quantile_cont(dist, 0.5) FILTER (NOT tier2), 6) AS median_full,
 coalesce((SELECT r FROM t) > 0.4 AND (SELECT common FROM f) > 15, false) AS drifts FROM d""")
def drift_report(spark, sf):
    """Whether the registration drifts towards the far end of the stack."""
    one = drift.report(_drift(spark, sf), far=5)
    r = lambda c: F.round(c, 6).alias(c)
    return one.select("n", "n_chains", r("mean"), r("contained"), r("r_dist"), "n_sections", r("r_common"), r("far_common"), r("median"), r("p90"), r("median_crop"), r("median_full"), "drifts")
