"""Registration of sections, from pairs of centroids."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelframe.operators import graph
from voxelframe.operators import registration as R
from voxelframe.operators.quantiles import quantiles
from voxelframe.plans.base import query
from voxelframe.sources import lenses as L

_RAW = """SELECT 3 * l_linenumber AS z, l_suppkey AS neuron, (10 * l_quantity + l_partkey % 100)::DOUBLE AS sx, (7 * l_suppkey % 500)::DOUBLE AS sy, l_orderkey, l_partkey FROM lineitem WHERE l_linenumber <> 4 OR l_orderkey < 20"""
_PAIRS = f"""raw AS ({_RAW}), pairs AS (SELECT z, neuron, sx, sy, 1.1::DOUBLE * sx + 0.04::DOUBLE * sy - 89.4::DOUBLE + 3 * z + (l_orderkey % 11 - 5) * 0.5::DOUBLE + CASE WHEN l_orderkey % 97 = 0 THEN 200 ELSE 0 END AS gx,
 -0.036::DOUBLE * sx + 1.12::DOUBLE * sy - 42.7::DOUBLE - 2 * z + (l_partkey % 7 - 3) * 0.5::DOUBLE AS gy FROM raw)"""


def _pairs(spark, sf):
    raw = L.table(spark, sf, "lineitem").filter("l_linenumber <> 4 or l_orderkey < 20").selectExpr(
        "cast(3 * l_linenumber as bigint) as z", "l_suppkey as neuron", "cast(10 * l_quantity + l_partkey % 100 as double) as sx", "cast(7 * l_suppkey % 500 as double) as sy", "l_orderkey", "l_partkey")
    return raw.selectExpr("z", "neuron", "sx", "sy", "1.1D * sx + 0.04D * sy - 89.4D + 3 * z + (l_orderkey % 11 - 5) * 0.5D + if(l_orderkey % 97 = 0, 200, 0) as gx",
                          "-0.036D * sx + 1.12D * sy - 42.7D - 2 * z + (l_partkey % 7 - 3) * 0.5D as gy")


def _cross(prefix: str, rows: str, by: str = "") -> str:
    """Least squares by the engine's covariances: regr slopes of two variables."""
    g = f"GROUP BY {by}" if by else ""
    head = f"{by}, " if by else ""
    cov = ", ".join(f"covar_pop({a}, {b}) AS {n}" for n, a, b in (("xx", "sx", "sx"), ("yy", "sy", "sy"), ("xy", "sx", "sy"), ("gxx", "gx", "sx"), ("gxy", "gx", "sy"), ("gyx", "gy", "sx"), ("gyy", "gy", "sy")))
    return f"""{prefix}s AS (SELECT {head}count(*) AS n, avg(sx) AS msx, avg(sy) AS msy, avg(gx) AS mgx, avg(gy) AS mgy, {cov} FROM {rows} {g}),
{prefix}l AS (SELECT *, (gxx * yy - gxy * xy) / (xx * yy - xy * xy) AS a, (gxy * xx - gxx * xy) / (xx * yy - xy * xy) AS b, (gyx * yy - gyy * xy) / (xx * yy - xy * xy) AS c, (gyy * xx - gyx * xy) / (xx * yy - xy * xy) AS d FROM {prefix}s WHERE n >= 4),
{prefix} AS (SELECT {head}n, a, b, mgx - a * msx - b * msy AS tx, c, d, mgy - c * msx - d * msy AS ty FROM {prefix}l)"""


_CENTRED = "cen AS (SELECT sx - avg(sx) OVER (PARTITION BY z) AS sx, sy - avg(sy) OVER (PARTITION BY z) AS sy, gx - avg(gx) OVER (PARTITION BY z) AS gx, gy - avg(gy) OVER (PARTITION BY z) AS gy FROM pairs)"
_GLOBAL = f"{_PAIRS}, {_CENTRED}, {_cross('lin', 'cen')}"
_AFFINE = f"""{_PAIRS}, {_cross('f1', 'pairs', 'z')}, r1 AS (SELECT p.*, sqrt((a * sx + b * sy + tx - gx) ** 2 + (c * sx + d * sy + ty - gy) ** 2) AS res FROM pairs p JOIN f1 USING (z)),
k1 AS (SELECT * FROM r1 QUALIFY res <= greatest(40, 3 * median(res) OVER (PARTITION BY z))), {_cross('f2', 'k1', 'z')}, fit AS (SELECT z, f2.a, f2.b, f2.tx, f2.c, f2.d, f2.ty FROM f2)"""
_R = lambda cols, n: ", ".join(f"round({c}, {n}) AS {c}" for c in cols)


def _rounded(df, columns, n, *first):
    return df.select(*first, *(F.round(c, n).alias(c) for c in columns))


_SPREAD = 330
_CORR = f"""{L.NODES}, {L.SEGMENT_RUNS}, own AS (SELECT slice, label, y, x0, x1 FROM segment_runs JOIN segments USING (segment)),
fresh AS (SELECT *, CASE WHEN x0 <= max(x1) OVER (PARTITION BY slice, label, y ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM own),
isl AS (SELECT *, sum(f) OVER (PARTITION BY slice, label, y ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS k FROM fresh),
un AS (SELECT slice, label, y, min(x0) AS x0, max(x1) AS x1 FROM isl GROUP BY slice, label, y, k), id AS (SELECT *, row_number() OVER (ORDER BY slice, label, y, x0) AS id FROM un),
e AS (SELECT a.id AS u, b.id AS v FROM id a JOIN id b ON a.slice = b.slice AND a.label = b.label AND b.y = a.y + 1 AND a.x0 < b.x1 AND b.x0 < a.x1), e2 AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
reach AS (SELECT id, id AS root FROM id UNION SELECT e2.v, reach.root FROM reach JOIN e2 ON e2.u = reach.id), comp AS (SELECT id, min(root) AS c FROM reach GROUP BY ALL),
mask AS (SELECT slice AS z, label, sum((x1 - x0) * (x0 + x1 - 1)) / 2 / sum(x1 - x0) AS gx, sum((x1 - x0) * y) / sum(x1 - x0) AS gy FROM id JOIN comp USING (id) GROUP BY ALL HAVING count(DISTINCT c) = 1),
place AS (SELECT z, {L.NODE_LABEL_SQL} AS label, count(*) AS n_nodes, avg(x) AS sx, avg(y) AS sy FROM nodes GROUP BY ALL HAVING sqrt(coalesce(stddev_samp(x), 0) ** 2 + coalesce(stddev_samp(y), 0) ** 2) <= {_SPREAD})"""


@query(f"WITH RECURSIVE {_CORR} SELECT z, label, n_nodes, round(sx, 6) AS sx, round(sy, 6) AS sy, round(gx, 6) AS gx, round(gy, 6) AS gy FROM place JOIN mask USING (z, label)")
def correspondences(spark, sf):
    """Mean node and mask centroid of each label on each section where the two can be paired."""
    found = R.correspondences(L.labelled_nodes(spark, sf), L.segment_runs(spark, sf), L.segments(spark, sf), spread=_SPREAD)
    return _rounded(found, ("sx", "sy", "gx", "gy"), 6, "z", "label", "n_nodes")


@query(f"WITH {_GLOBAL} SELECT {_R('abcd', 9)} FROM lin")
def registration_global(spark, sf):
    return _rounded(R.linear(_pairs(spark, sf)), "abcd", 9)


@query(f"WITH {_GLOBAL} SELECT z, round(median(gx - a * sx - b * sy), 6) AS tx, round(median(gy - c * sx - d * sy), 6) AS ty, count(*) AS n FROM pairs, (SELECT a, b, c, d FROM lin) GROUP BY z HAVING count(*) >= 3")
def registration_offsets(spark, sf):
    pairs = _pairs(spark, sf)
    return _rounded(R.offsets(pairs, R.linear(pairs)), ("tx", "ty"), 6, "z", "n")


@query(f"WITH {_AFFINE} SELECT z, {_R(R.PARAMETERS, 6)} FROM fit")
def registration_affine(spark, sf):
    return _rounded(R.affine(_kept_pairs(spark, sf)), R.PARAMETERS, 6, "z")


_FILLED = f"""{_AFFINE}, sp AS (SELECT unnest(range(1, 25)) AS z), lo AS (SELECT sp.z, max(f.z) AS p, (SELECT min(z) FROM fit WHERE fit.z >= sp.z) AS q FROM sp LEFT JOIN fit f ON f.z <= sp.z GROUP BY sp.z),
fil AS (SELECT lo.z, {', '.join(f'coalesce(u.{c} + (CASE WHEN v.z > u.z THEN (lo.z - u.z) / (v.z - u.z) ELSE 0 END) * (v.{c} - u.{c}), u.{c}, v.{c}) AS {c}' for c in R.PARAMETERS)} FROM lo LEFT JOIN fit u ON u.z = lo.p LEFT JOIN fit v ON v.z = lo.q)"""


@query(f"WITH {_FILLED} SELECT z, {_R(R.PARAMETERS, 6)} FROM fil")
def registration_fill(spark, sf):
    return _rounded(R.filled(R.affine(_kept_pairs(spark, sf)), 1, 24), R.PARAMETERS, 6, "z")


_SMOOTH = f"{_FILLED}, e AS (SELECT min(z) AS lo, max(z) AS hi FROM fil), win AS (SELECT f.z, g.* EXCLUDE (z) FROM fil f, e, (SELECT unnest([-2, -1, 0, 1, 2]) AS k) JOIN fil g ON g.z = greatest(lo, least(hi, f.z + k))), smo AS (SELECT z, {', '.join(f'median({c}) AS {c}' for c in R.PARAMETERS)} FROM win GROUP BY z)"


@query(f"WITH {_SMOOTH} SELECT z, {_R(R.PARAMETERS, 6)} FROM smo")
def registration_smooth(spark, sf):
    return _rounded(_model(spark, sf), R.PARAMETERS, 6, "z")


def _kept_pairs(spark, sf):
    """The pairs, dealt over all cores once: they are read many times, and the file may be a single split."""
    return graph.cut(_pairs(spark, sf).repartition(spark.sparkContext.defaultParallelism))


def _model(spark, sf, pairs=None):
    return R.smoothed(R.filled(R.affine(pairs or _kept_pairs(spark, sf)), 1, 24), 5)


@query(f"WITH {_SMOOTH} SELECT z, {', '.join(f'round({c} / 4, 6) AS {c}' for c in R.PARAMETERS)} FROM smo")
def registration_scale(spark, sf):
    return _rounded(R.scaled(_model(spark, sf), 0.25), R.PARAMETERS, 6, "z")


_PLACED = f"WITH {_SMOOTH}, {L.NODES}, pl AS (SELECT node_id, cell_name, n.z, a * x + b * y + tx AS rx, c * x + d * y + ty AS ry FROM nodes n JOIN smo ON smo.z = greatest(1, least(24, n.z)))"


@query(f"{_PLACED} SELECT node_id, round(rx, 4) AS rx, round(ry, 4) AS ry FROM pl")
def registration_apply(spark, sf):
    return _rounded(R.applied(L.nodes(spark, sf), _model(spark, sf), "x", "y"), ("rx", "ry"), 4, "node_id")


@query(f"{_PLACED} SELECT cell_name, z, count(*) AS n_points, string_agg(node_id::VARCHAR, ',' ORDER BY node_id) AS nodes, round(sum(rx), 2) AS sum_x FROM pl GROUP BY ALL")
def chain_prompts(spark, sf):
    """Registered nodes of each neuron on each section, as prompts."""
    p = R.applied(L.nodes(spark, sf), _model(spark, sf), "x", "y")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("node_id")), lambda x: x.cast("string")), ",")
    return p.groupBy("cell_name", "z").agg(F.count("*").alias("n_points"), ids.alias("nodes"), F.round(F.sum("rx"), 2).alias("sum_x"))


_RES = f"WITH {_SMOOTH}, res AS (SELECT p.z, a * sx + b * sy + tx - gx AS dx, c * sx + d * sy + ty - gy AS dy, sqrt((a * sx + b * sy + tx - gx) ** 2 + (c * sx + d * sy + ty - gy) ** 2) AS res FROM pairs p JOIN smo USING (z))"


@query(f"{_RES} SELECT count(*) AS n, round(avg(res), 6) AS mean, round(median(res), 6) AS median, round(quantile_cont(res, 0.9), 6) AS p90, round(max(res), 6) AS max, (SELECT round(avg(res), 6) FROM r1) AS best_mean, (SELECT round(median(res), 6) FROM r1) AS best_median, (SELECT round(quantile_cont(res, 0.9), 6) FROM r1) AS best_p90 FROM res")
def residual_report(spark, sf):
    """Residuals under the model, and under the best affine that each section could have had."""
    pairs = _kept_pairs(spark, sf)
    of = lambda df, c, kind: df.select(F.lit(kind).alias("kind"), F.col(c).alias("res"))
    both = of(R.residuals(pairs, graph.cut(_model(spark, sf, pairs))), "res", "model").unionByName(of(R.best(pairs), "best", "best"))
    sums = both.groupBy("kind").agg(F.avg("res").alias("mean"), F.max("res").alias("most")).join(quantiles(both, "res", ["kind"], [0.5, 0.9]), "kind")
    one = lambda kind, c: F.round(F.max(F.when(F.col("kind") == kind, F.col(c))), 6)
    named = lambda kind, head: (one(kind, c).alias(head + name) for c, name in (("mean", "mean"), ("q0", "median"), ("q1", "p90")))
    return sums.agg(F.max(F.when(F.col("kind") == "model", F.col("n"))).alias("n"), *named("model", ""), one("model", "most").alias("max"), *named("best", "best_"))


@query(f"{_RES} SELECT z, count(*) AS n, round(sqrt(avg(dx) ** 2 + avg(dy) ** 2) / avg(res), 6) AS coherence FROM res GROUP BY z HAVING count(*) >= 4")
def residual_coherence(spark, sf):
    """Length of the mean residual over the mean length: near 1 where a section is off as a whole."""
    r = R.residuals(_pairs(spark, sf), _model(spark, sf)).withColumns({"dx": F.col("rx") - F.col("gx"), "dy": F.col("ry") - F.col("gy")})
    g = r.groupBy("z").agg(F.count("*").alias("n"), F.round(F.hypot(F.avg("dx"), F.avg("dy")) / F.avg("res"), 6).alias("coherence"))
    return g.filter("n >= 4")


@query(f"""{_RES}, sec AS (SELECT z, count(*) AS n, sqrt(avg(dx) ** 2 + avg(dy) ** 2) / greatest(avg(res), 1e-6) AS co FROM res GROUP BY z), mb AS (SELECT median(r1.res) AS b FROM r1 WHERE z IN (SELECT z FROM sec WHERE n >= 4)),
mm AS (SELECT median(res) AS m FROM res WHERE z IN (SELECT z FROM sec WHERE n >= 4))
SELECT count(*) AS n, CASE WHEN count(DISTINCT z) > 5 THEN round(corr(z, res), 6) END AS r_z, (SELECT round(m, 6) FROM mm) AS median_model, (SELECT round(b, 6) FROM mb) AS median_best, (SELECT round((m - b) / greatest(m, 1e-6), 6) FROM mm, mb) AS gain,
 (SELECT (m - b) / greatest(m, 1e-6) > 0.25 FROM mm, mb) AS helps, (SELECT round(median(co), 6) FROM sec WHERE n >= 2) AS coherence FROM res""")
def residual_verdict(spark, sf):
    """Whether the residuals have a structure that more of a model would take up."""
    pairs = _kept_pairs(spark, sf)
    return _rounded(R.diagnosis(pairs, graph.cut(_model(spark, sf, pairs))), ("r_z", "median_model", "median_best", "gain", "coherence"), 6, "n", "helps")


@query(f"""WITH {_PAIRS}, {_cross('one', 'pairs')}, r AS (SELECT sqrt((a * sx + b * sy + tx - gx) ** 2 + (c * sx + d * sy + ty - gy) ** 2) AS res FROM pairs, one)
SELECT {_R(R.PARAMETERS, 6)}, round(sqrt(a * a + c * c), 6) AS scale, round(degrees(atan2(c, a)), 6) AS angle, round((SELECT avg(res) FROM r), 6) AS mean, round((SELECT max(res) FROM r), 6) AS max, round((SELECT stddev_pop(res) FROM r), 6) AS std FROM one""")
def landmark_affine(spark, sf):
    return _rounded(R.landmarks(_pairs(spark, sf)), (*R.PARAMETERS, "scale", "angle", "mean", "max", "std"), 6)
