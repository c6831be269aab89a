"""Crop windows, dense image rows, pairs for registrations, drift, nearest nodes, quantiles: by brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelframe.operators import drift, labelmaps, masks, registration, skeletons
from voxelframe.operators.quantiles import quantiles

WINDOW = "struct<origin_tif:array<double>,size_tif:array<int>,crop_scale:int,sam_scale:int>"


def _runs_of(mask):
    edges = np.diff(np.pad(mask.astype(int), ((0, 0), (1, 1))))
    return [(int(y), int(a), int(b)) for y in range(len(mask)) for a, b in zip(*(np.flatnonzero(edges[y] == s) for s in (1, -1)))]


def _pixels(rows, shape):
    out = np.zeros(shape, int)
    for r in rows:
        out[r.y, r.x0 : r.x1] += 1
    return out


def _nearest(mask, h, w):
    ys, xs = np.arange(h) * mask.shape[0] // h, np.arange(w) * mask.shape[1] // w
    return mask[np.ix_(ys, xs)]


def _put(mask, y, x, shape):
    out = np.zeros(shape, bool)
    for j, i in zip(*np.nonzero(mask)):
        if 0 <= y + j < shape[0] and 0 <= x + i < shape[1]:
            out[y + j, x + i] = True
    return out


def _chains(rng):
    """Chains of crops at five scales, across all four sides of the frame, and two of the whole frame."""
    cases = [(None, (30, 44))] * 2
    for k, (ox, oy) in enumerate([(40.0, 40.0), (-33.5, 8.0), (300.0, 20.25), (100.0, -40.0), (96.0, 190.0), (-500.0, 0.0)]):
        scale, w, h = 1 + k % 5, 60 + 17 * k, 50 + 9 * k
        cases.append((([ox, oy], [w, h], scale, 8), (max(1, round(h / scale)), max(1, round(w / scale)))))
    return [(i, window, rng.random(shape) < 0.6) for i, (window, shape) in enumerate(cases)]


def test_crops_of_several_scales_in_one_frame(spark):
    rng, shape = np.random.default_rng(7), (30, 44)
    chains = _chains(rng)
    runs = spark.createDataFrame([(5, "A" if i % 2 else "B", i, *r) for i, _, m in chains for r in _runs_of(m)], "slice long, neuron string, chain_idx long, y long, x0 long, x1 long")
    states = spark.createDataFrame([("A" if i % 2 else "B", i, w) for i, w, _ in chains if i], f"neuron string, chain_idx long, crop_window {WINDOW}")
    got = masks.unplaced(runs, states, shape, 8).collect()
    union = masks.merged(masks.unplaced(runs, states, shape, 8)).collect()
    want = {"A": np.zeros(shape, bool), "B": np.zeros(shape, bool)}
    for i, window, m in chains:
        if window:
            (ox, oy), (w, h), _, s = window
            placed = _put(_nearest(m, max(1, round(h / s)), max(1, round(w / s))), round(oy / s), round(ox / s), shape)
        else:
            placed = m
        mine = [r for r in got if r.chain_idx == i]
        assert np.array_equal(_pixels(mine, shape), placed.astype(int)), i
        want["A" if i % 2 else "B"] |= placed
    for n, m in want.items():
        assert np.array_equal(_pixels([r for r in union if r.neuron == n], shape), m.astype(int))


def test_a_crop_in_another_window(spark):
    rng = np.random.default_rng(9)
    m = rng.random((20, 30)) < 0.5
    runs = spark.createDataFrame([(0, "A", *r) for r in _runs_of(m)], "slice long, neuron string, y long, x0 long, x1 long")
    window = lambda ox, oy, w, h, s: F.expr(f"named_struct('origin_tif', array({ox}D, {oy}D), 'size_tif', array({w}, {h}), 'crop_scale', {s})")
    for to in ((10, 20, 200, 160, 4), (90, 70, 50, 40, 3), (0, 0, 99, 77, 7)):
        got = masks.remapped(runs, window(40, 40, 120, 80, 4), window(*to)).collect()
        ox, oy, w, h, s = to
        shape = (round(h / s), round(w / s))
        want = _put(_nearest(m, round(80 / s), round(120 / s)), round((40 - oy) / s), round((40 - ox) / s), shape)
        assert np.array_equal(_pixels(got, shape), want.astype(int))


def test_a_dense_image_row_meets_linearly(spark):
    """20,000 runs in one image row: each meets what its tiles hold."""
    def rows(n, name, shift):
        return spark.range(n).selectExpr("1L as slice", f"'{name}' as neuron", "0L as y", f"3 * id + {shift} as x0", f"3 * id + {shift} + 2 as x1")

    met = []
    for n in (5_000, 20_000):
        a, b = rows(n, "A", 0), rows(n, "B", 1).select("slice", "y", F.col("x0").alias("b0"), F.col("x1").alias("b1"))
        met.append(masks.tiled(a).join(masks.tiled(b, "b0", "b1"), ["slice", "y", "tile"]).count())
        pairs = masks.met(a, b, ["slice", "y"], "b0", "b1")
        assert pairs.count() == pairs.distinct().count() == 2 * n - 1 - (n - 1)
    assert met[1] < 4.2 * met[0] and met[1] < 30 * 20_000
    both = rows(20_000, "A", 0).unionByName(rows(20_000, "B", 1))
    assert masks.collisions(both).first().collisions == 20_000
    c = {r.neuron: r.n for r in masks.composite(both).groupBy("neuron").agg(F.sum(F.col("x1") - F.col("x0")).alias("n")).collect()}
    assert c == {"A": 40_000, "B": 20_000}
    # One long run over many short ones, and negative places.
    long = spark.createDataFrame([(1, "L", 0, -70, 60_100)], "slice long, neuron string, y long, x0 long, x1 long")
    b = rows(20_000, "B", 1).select("slice", "y", F.col("x0").alias("b0"), F.col("x1").alias("b1"))
    assert masks.met(long, b, ["slice", "y"], "b0", "b1").count() == 20_000


@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles_are_exact(spark, by):
    rng = np.random.default_rng(5)
    rows = [(0, float(v)) for v in rng.normal(size=3000)] + [(0, 0.5)] * 900 + [(1, 2.0)] + [(2, float(v)) for v in (3, 1)] + [(3, None)]
    shares = [0.0, 0.1, 0.5, 0.9, 0.999, 1.0]
    got = quantiles(spark.createDataFrame(rows, "g int, v double").repartition(5), "v", by, shares).collect()
    groups = {g: [v for k, v in rows if v is not None and (k == g or not by)] for g in ((0, 1, 2) if by else (0,))}
    assert {(r.g if by else 0): r.n for r in got} == {g: len(v) for g, v in groups.items()}
    for r in got:
        assert np.allclose([r[f"q{k}"] for k in range(len(shares))], np.quantile(groups[r.g if by else 0], shares), atol=1e-12)
    assert quantiles(spark.createDataFrame([], "g int, v double"), "v", by, [0.5]).count() == 0


@pytest.mark.parametrize("few", [0, 50_000])
def test_quantiles_of_large_groups(spark, monkeypatch, few):
    from voxelframe.operators import quantiles as module

    monkeypatch.setattr(module, "FEW", few)
    rng = np.random.default_rng(6)
    groups = {g: np.round(rng.normal(size=n) ** 3, 4) for g, n in enumerate((40_000, 7001, 6000))}
    df = spark.createDataFrame([(g, float(v)) for g, values in groups.items() for v in values], "g int, v double").repartition(6)
    shares = [0.0, 0.003, 0.25, 0.5, 0.9, 0.9995, 1.0]
    for r in quantiles(df, "v", ["g"], shares).collect():
        assert np.allclose([r[f"q{k}"] for k in range(len(shares))], np.quantile(groups[r.g], shares), atol=1e-12) and r.n == len(groups[r.g])


def test_correspondences_leave_out_what_is_ambiguous(spark):
    nodes = [("A", 1, 10.0, 20.0), ("A", 1, 14.0, 22.0), ("A", 2, 0.0, 0.0), ("A", 2, 900.0, 900.0), ("A", 3, 5.0, 5.0), ("A", 4, 5.0, None), ("B", 1, 1.0, 1.0), ("C", 1, 2.0, 2.0)]
    runs = [
        (1, 7, 0, 2, 6), (1, 8, 1, 5, 9),  # A: two segments that touch, one piece
        (2, 7, 0, 2, 6), (3, 7, 0, 2, 6), (3, 7, 1, 6, 9),  # A: nodes far apart; two pieces that meet at a corner
        (1, 9, 4, 0, 2), (1, 9, 4, 5, 7), (4, 7, 0, 0, 1),  # B: two pieces
    ]
    got = registration.correspondences(
        spark.createDataFrame(nodes, "label string, z long, x double, y double"), spark.createDataFrame(runs, "slice long, segment long, y long, x0 long, x1 long"),
        spark.createDataFrame([(7, "A"), (8, "A"), (9, "B")], "segment long, label string"))
    r = got.collect()
    assert len(r) == 1 and (r[0].z, r[0].label, r[0].n_nodes, r[0].sx, r[0].sy, r[0].gx, r[0].gy) == (1, "A", 2, 12.0, 21.0, 5.0, 0.5)


def test_correspondences_feed_a_registration(spark):
    rng = np.random.default_rng(3)
    nodes, runs = [], []
    for k in range(12):
        x, y = rng.integers(10, 90, 2).tolist()
        gx, gy = 2 * x + 5, 3 * y - 4
        nodes.append((f"L{k}", 1, float(x), float(y)))
        runs += [(1, k, gy + d, gx - 1, gx + 2) for d in (-1, 0, 1)]
    pairs = registration.correspondences(
        spark.createDataFrame(nodes, "label string, z long, x double, y double"), spark.createDataFrame(runs, "slice long, segment long, y long, x0 long, x1 long"),
        spark.createDataFrame([(k, f"L{k}") for k in range(12)], "segment long, label string"))
    fit = registration.affine(pairs.select("z", "sx", "sy", "gx", "gy")).first()
    assert np.allclose([fit.a, fit.b, fit.tx, fit.c, fit.d, fit.ty], [2, 0, 5, 0, 3, -4], atol=1e-9)


def test_a_mask_that_changes_changes_the_run_length(spark):
    nodes = spark.createDataFrame([(i, i - 1 if i else None, "A", 2.0 + i, 3.0, 0, 99) for i in range(6)], "node_id long, parent_id long, cell_name string, x double, y double, z long, label long")
    fit = spark.createDataFrame([(0, 2.0, 0.0, 0.0, 0.0, 2.0, 0.0)], "z long, a double, b double, tx double, c double, d double, ty double")
    runs = lambda spans: spark.createDataFrame([(0, n, y, a, b) for n, a, b in spans for y in (5, 6, 7)], "slice long, label int, y long, x0 long, x1 long")
    at = lambda spans: {r.node_id: r.label for r in labelmaps.sampled(nodes, fit, runs(spans), 1).collect()}
    assert at([(4, 0, 40)]) == dict.fromkeys(range(6), 4) and at([(4, 0, 9), (5, 9, 40)]) == {0: 4, 1: 4, 2: 4, 3: 5, 4: 5, 5: 5}
    whole, cut, none = (labelmaps.run_length(nodes, fit, runs(s), radius=1).first() for s in ([(4, 0, 40)], [(4, 0, 9), (5, 9, 40)], [(4, 30, 40)]))
    assert (whole.erl, cut.n_split_edges, cut.erl, none.erl, none.n_bg_edges) == (10.0, 1, 3.2, 0.0, 5)


def _k_nearest(points, nodes, k):
    out = set()
    for p, z, px, py in points:
        near = sorted((np.sqrt((x - px) ** 2 + (y - py) ** 2), n) for n, nz, x, y in nodes if nz == z and n != p)
        out |= {(p, i + 1, n, round(float(d), 9)) for i, (d, n) in enumerate(near[:k])}
    return out


def test_nearest_nodes_of_clusters_far_apart(spark):
    rng = np.random.default_rng(2)
    nodes = [(i, 0, *(float(v) for v in rng.normal(0, 0.01, 2))) for i in range(300)]  # a crowd
    nodes += [(300 + i, 0, float(1e5 + 40 * i), float(i % 3)) for i in range(40)]  # loners far away
    nodes += [(400 + i, 0, 77.0, 77.0) for i in range(80)]  # one place
    nodes += [(500 + i, 1, float(i), 0.0) for i in range(3)] + [(600, 2, 1.0, 1.0), (601, 3, None, 1.0)]
    points = [n for n in nodes if n[0] % 3 == 0 and n[0] != 601] + [(900, 0, 5e4, -3.0), (901, 7, 0.0, 0.0)]
    table = lambda rows, c: spark.createDataFrame(rows, f"{c[0]} long, z long, {c[1]} double, {c[2]} double")
    p, n = table(points, ("point", "px", "py")), table(nodes, ("node_id", "x", "y"))
    for k in (1, 4):
        got = {(r.point, r.rank, r.node_id, round(r.dist, 9)) for r in skeletons.k_nearest(p, n, k).collect()}
        assert got == _k_nearest(points, [x for x in nodes if x[2] is not None], k)


def test_pairs_compared_grow_with_the_points(spark):
    """Pairs of far clusters, each with too few nodes to be served by itself, around a crowd."""
    def compared(n):
        rows = spark.range(n).selectExpr("id as node_id", "0L as z", "if(id % 2 = 0, id % 100 * 0.1, id * 1000.0) as x", "cast(if(id % 2 = 0, id div 100 * 0.1, id % 7) as double) as y")
        points = rows.selectExpr("node_id as point", "z", "x as px", "y as py")
        return skeletons.candidates(points, rows, 3).count()

    small, large = compared(1000), compared(4000)
    assert large < 6 * small and large < 150 * 4000


@pytest.mark.parametrize("sent", [0, 40, 100_000])
def test_nearest_nodes_by_boxes_made_once(spark, monkeypatch, sent):
    """Each node is put into its box once, however deep they lie, and meets points from around it only."""
    from voxelframe.operators import graph

    rng = np.random.default_rng(8)
    nodes = [(i, int(i % 7 == 0), *(float(v) for v in np.round(rng.exponential(30, 2), 1))) for i in range(2000)]
    nodes += [(2000 + i, 0, *(float(v) for v in 500 + rng.normal(0, 1e-4, 2))) for i in range(500)] + [(2500 + i, 0, 3.0, 4.0) for i in range(20)]
    points = [(n, z, x + n % 7, y - n % 5) for n, z, x, y in nodes if n % 4 == 0]
    p = spark.createDataFrame(points, "point long, z long, px double, py double").repartition(3)
    n = spark.createDataFrame(nodes, "node_id long, z long, x double, y double").repartition(3)
    cuts = []
    monkeypatch.setattr(graph, "cut", lambda df, cut=graph.cut: cuts.append(cut(df)) or cuts[-1])
    monkeypatch.setattr(skeletons, "SENT", sent, raising=False)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that the curve is cut into ranges
    try:
        got = {(r.point, r.rank, r.node_id, round(r.dist, 9)) for r in skeletons.k_nearest(p, n, 3).collect()}
        assert got == _k_nearest(points, nodes, 3)
        assert sum(c.count() for c in cuts) < 1.5 * len(nodes)
        assert skeletons.candidates(p, n, 3).count() < 50 * len(points)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_nearest_nodes_of_odd_places(spark):
    nan = float("nan")
    n = spark.createDataFrame([(i, 0, float(i), 0.0) for i in range(20)] + [(20, 0, nan, 0.0), (30, 1, 1.0, 1.0), (31, 1, nan, 1.0)], "node_id long, z long, x double, y double")
    p = spark.createDataFrame([(0, 0, 0.0, 0.0), (900, 0, None, 1.0), (901, 1, 1.0, 1.0)], "point long, z long, px double, py double")
    got = sorted((r.point, r.rank, r.node_id) for r in skeletons.k_nearest(p, n, 3).collect())
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (901, 1, 30), (901, 2, 31)]


def test_drift_of_a_stack(spark):
    rng = np.random.default_rng(1)
    signals, nodes, states = [], [], [("A", k, None if k % 2 else ([80.0, 40.0], [400, 400], 2, 8)) for k in range(5)]
    for k in range(5):
        for z in range(100, 180):
            cx, cy = rng.uniform(10, 40, 2)
            off = (z - 100) * 0.5
            signals.append(("A", k, z, *((cx, cy) if k % 2 else ((cx * 8 - 80) / 2, (cy * 8 - 40) / 2)), None if z % 3 else True))
            nodes += [("A", k, z, cx + off - 1, cy), ("A", k, z, cx + off + 1, cy)]
    signals.append(("A", 0, 999, 1.0, 1.0, True))  # no nodes there
    rows = drift.offsets(
        spark.createDataFrame([(n, k, z, float(a), float(b), c) for n, k, z, a, b, c in signals], "neuron string, chain_idx long, z long, cx double, cy double, contained boolean"),
        spark.createDataFrame([(n, k, z, float(a), float(b)) for n, k, z, a, b in nodes], "neuron string, chain_idx long, z long, xs double, ys double"),
        spark.createDataFrame(states, f"neuron string, chain_idx long, crop_window {WINDOW}"), 8, 120)
    r = drift.report(rows).first()
    assert (r.n, r.n_chains, r.n_sections, r.drifts) == (400, 5, 80, True) and np.allclose([r.r_dist, r.r_common, r.median, r.median_crop, r.median_full], [1, 1, 19.75, 19.75, 19.75])
    b = {x.bin: (x.n, round(x.common, 6), round(x.coherence, 6)) for x in drift.bins(rows).collect()}
    assert b == {-40: (100, 4.75, 1.0), 0: (200, 19.75, 1.0), 40: (100, 34.75, 1.0)}
    flat = rows.withColumns({"offx": F.lit(0.0), "offy": F.lit(0.0), "dist": F.lit(0.0)})
    assert drift.report(flat).first().drifts is False


def test_equal_runs_are_merged_once(spark):
    rng = np.random.default_rng(5)
    some = [(0, "A", int(y), int(x), int(x + n)) for y, x, n in zip(rng.integers(0, 3, 40), rng.integers(0, 90, 40), rng.integers(1, 5, 40))]
    runs = spark.createDataFrame(some * 60, "slice long, neuron string, y long, x0 long, x1 long").repartition(7)
    want = np.zeros((3, 100), bool)
    for _, _, y, a, b in some:
        want[y, a:b] = True
    assert sorted((r.y, r.x0, r.x1) for r in masks.merged(runs).collect()) == sorted(_runs_of(want))


def test_the_rate_on_masks_counts_every_slice(spark, tmp_path):
    from voxelframe.plans import catalogue

    # One neuron with nodes on four slices, and a run to the frame's end on each image row of them.
    spark.createDataFrame([(k, "Brand#11", 145) for k in range(0, 800, 5)], "p_partkey long, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    nodes = range(0, 4000, 25)
    spark.createDataFrame([(k,) for k in nodes], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    on = sum(k * 7 % 145 >= (k % 20 + 20 * (k * 3 % 40)) * 13 % 90 for k in nodes)
    (row,) = catalogue.queries()["on_mask_rate"](spark, str(tmp_path)).collect()
    assert (row.neuron, row.n, row.n_on) == ("Brand#11", len(nodes), on)


def test_leaks_grow_with_the_picture(spark, tmp_path):
    from voxelframe.plans import catalogue

    # Every pixel of the nodes holds 50 of them, and each node comes twice: the join meets a row per pixel.
    spark.createDataFrame([(k, "Brand#99", 145) for k in range(800)], "p_partkey long, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    nodes = [k * 145 * 400 for k in range(50)] * 2  # on slice 0, in its first image row and column
    spark.createDataFrame([(k,) for k in nodes], "c_custkey long").repartition(1).write.parquet(f"{tmp_path}/customer.parquet")
    met, hits = [], masks.hits
    with pytest.MonkeyPatch.context() as m:
        m.setattr(masks, "hits", lambda points, runs, radius=0: met.append(points) or hits(points, runs, radius))
        (row,) = catalogue.queries()["leak_nodes"](spark, str(tmp_path)).collect()
    assert (row.slice, row.neuron, row.n_leaks) == (0, "Brand#99", 50) and met[0].count() <= 5


@pytest.mark.parametrize("few", [3, 5000])
def test_values_and_pairs_stay_where_they_are(spark, monkeypatch, few):
    """A hot group, or section, is not dealt by its key: what belongs to it is sent to its rows."""
    from voxelframe.operators import graph, quantiles as q

    cuts = []
    monkeypatch.setattr(graph, "cut", lambda df, cut=graph.cut: cuts.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    monkeypatch.setattr(q, "FEW", few)
    values = spark.range(1000).selectExpr("id % 2 as k", "cast(id as double) as v")
    got = {r.k: (r.n, r.q0, r.q1) for r in q.quantiles(values, "v", ["k"], [0.5, 0.9]).collect()}
    want = {k: (500, *np.quantile(np.arange(k, 1000, 2), [0.5, 0.9])) for k in (0, 1)}
    assert all(got[k] == pytest.approx(want[k]) for k in want) and "strategy=broadcast" in cuts[0]
    pairs = spark.range(60).selectExpr("id % 3 as z", "cast(id % 7 as double) as sx", "cast(id % 5 as double) as sy", "cast(id % 7 as double) as gx", "cast(id % 5 + 1 as double) as gy")
    fit = spark.createDataFrame([(z, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0) for z in range(3)], "z long, a double, b double, tx double, c double, d double, ty double")
    for df, n in ((registration.residuals(pairs, fit), 2), (registration.best(pairs), 1)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") == n
    assert registration.residuals(pairs, fit).agg(F.min("res"), F.max("res")).first()[:] == (1.0, 1.0)
