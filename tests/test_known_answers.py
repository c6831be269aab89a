"""Known small answers: run lengths, labels, masks, morphology by brute force, files."""

import json
import struct
import time
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F
from voxelframe.functions import names
from voxelframe.operators import frames, graph, labels, ledgers, masks, metrics, registration, segments, skeletons
from voxelframe.sources import files, rasters, trees


def _line(spark, labels, name="A", start=0):
    return [(start + i, start + i - 1 if i else None, name, float(i) / 2, 0.0, 0, lab) for i, lab in enumerate(labels)]


def _erl(spark, rows, **tolerance):
    nodes = spark.createDataFrame(rows, "node_id long, parent_id long, cell_name string, x double, y double, z long, label long")
    classes = skeletons.classified(nodes, **tolerance)
    return skeletons.run_lengths(classes, skeletons.runs(classes)).first()


def test_run_lengths(spark):
    assert _erl(spark, _line(spark, [1] * 5)).erl == 4
    split = _erl(spark, _line(spark, [1, 1, 1, 2, 2]))
    assert (split.erl, split.n_split_edges, split.n_runs, split.max_run) == (1.25, 1, 2, 2)
    assert round(_erl(spark, _line(spark, [1, 1, 0, 3])).erl, 4) == 0.3333
    both = _line(spark, [7] * 6) + _line(spark, [7, 8, 8], "B", 10)
    assert round(_erl(spark, both).erl, 4) == round(1 / 7, 4)
    assert round(_erl(spark, both, min_count=2).erl, 4) == round(26 / 7, 4)
    assert _erl(spark, _line(spark, [5] * 3) + _line(spark, [5] * 3, "B", 10)).erl == 0


def test_chains_of_a_fork(spark):
    rows = [(1, None), (2, 1), (3, 2), (4, 2), (5, 4), (9, 77)]
    nodes = spark.createDataFrame([(a, b, "A") for a, b in rows], "node_id long, parent_id long, cell_name string")
    got = {r["head"]: (r["nodes"], r["origin_branch"], r["is_root"]) for r in skeletons.chain_table(skeletons.chains(nodes)).collect()}
    assert got == {1: ([1, 2], None, True), 3: ([3], 2, False), 4: ([4, 5], 2, False), 9: ([9], None, True)}


def test_gaps_up_and_down(spark):
    rows = [(1, None, 0.0, 0.0, 10), (2, 1, 4.0, 8.0, 14), (3, 2, 0.0, 0.0, 12)]
    nodes = spark.createDataFrame([(a, b, "A", x, y, z) for a, b, x, y, z in rows], "node_id long, parent_id long, cell_name string, x double, y double, z long")
    got = {r.node_id: (r.parent_id, r.x, r.y, r.z) for r in skeletons.with_virtual_nodes(nodes).collect() if r.is_virtual}
    assert got == {"v_2_13": ("v_2_12", 3, 6, 13), "v_2_12": ("v_2_11", 2, 4, 12), "v_2_11": ("1", 1, 2, 11), "v_3_13": ("2", 2, 4, 13)}


def test_components_of_a_graph(spark):
    nodes = spark.range(60).withColumnRenamed("id", "node")
    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i != 17] + [(50, 45), (45, 59)], "u long, v long")
    got = {r.node: r.component for r in graph.components(nodes, edges).collect()}
    assert got == {i: 0 if i <= 17 else 18 if i <= 40 else 45 if i in (45, 50, 59) else i for i in range(60)}


@pytest.mark.parametrize("raw,want", [("[IL2L]", "IL2L"), ("RMDVR!", "RMDVR"), ("[IL2L!]", "IL2L"), ("[A] note", "A"), ("A !", "A"), ("[A", "[A"), (" \tURYDR? ", "URYDR"), ("", "")])
def test_names(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "s string").select(names.normalize_name(F.col("s")).alias("n")).first().n == want


def test_partition_scores(spark):
    def scores(seg, gt):
        t = metrics.contingency(spark.createDataFrame(list(zip(seg, gt)), "seg int, gt int"))
        return metrics.variation_of_information(t, 5.0).first(), metrics.adapted_rand(t).first()

    v, r = scores([1, 1, 2, 2], [1, 1, 1, 1])
    assert (v.voi_split, v.voi_merge) == (1, 0) and (round(r.recall, 6), r.precision) == (0.333333, 1) and round(r.split_error, 6) == 0.666667
    v, r = scores([1, 1, 1, 1], [1, 1, 2, 2])
    assert (v.voi_split, v.voi_merge, v.weighted) == (0, 1, 5) and round(r.precision, 6) == 0.333333
    assert scores([], [])[0].voi == 0


def test_signals_and_failures(spark):
    rows = [("A", 0, 1, 10, 0, 0.9, True), ("A", 0, 2, 0, 0, None, None), ("A", 0, 3, 10, 0, 0.2, False), ("A", 0, 4, 25, 5, 0.9, None)]
    f = frames.flags(spark.createDataFrame(rows, "neuron string, chain_idx int, z int, area int, x0 int, pred_iou double, skeleton_contained boolean"))
    got = {r.z: (r.flag_count, r.area_ratio, r.why) for r in f.withColumn("why", frames.reasons()).collect()}
    assert got == {1: (0, None, ""), 2: (0, None, ""), 3: (2, None, "noskel pIoU 0.20"), 4: (2, 2.5, "area x2.5 tIoU 0.17")}
    r = frames.failure(f).first()
    assert (r.flag_z, r.ratio_z, r.jump_z, r.jump) == (3, 4, 3, 10)


def test_rates_at_a_decimal_tie(spark):
    n = {0: (57, 800), 1: (69, 800), 2: (1, 32), 3: (0, 5), 4: (7, 7), 5: (1, 3)}
    rows = spark.createDataFrame([("A", k, a, b) for k, (a, b) in n.items()], "neuron string, chain_idx long, a long, b long")
    frame = rows.selectExpr("neuron", "chain_idx", "explode(transform(sequence(1, b), i -> i <= a)) as flag").selectExpr("*", "flag as intervene", "flag as queue", "flag as skeleton_contained")
    got = {r.chain_idx: r.flag_rate for r in frames.summary(frame).collect()}
    assert got == {0: 0.0712, 1: 0.0862, 2: 0.0313, 3: 0.0, 4: 1.0, 5: 0.3333}


def test_resume_and_second_pass(spark):
    s = spark.createDataFrame([(x,) for x in ("pending", "running", "failed", "done", "flagged")], "status string")
    ask = lambda c: [r[0] for r in s.select(c).collect()]
    assert ask(ledgers.should_run(F.col("status"))) == [True, True, False, False, False]
    assert ask(ledgers.should_run(F.col("status"), retry_failed=True)) == [True, True, True, False, False]
    assert ask(ledgers.should_run(F.col("status"), force=True)) == [True] * 5
    assert ask(ledgers.second_pass(F.col("status"))) == [False, False, False, False, True]
    assert ask(ledgers.second_pass(F.col("status"), everywhere=True)) == [False, False, False, True, True]
    assert ask(ledgers.second_pass(F.col("status"), cropped=True, everywhere=True)) == [False] * 5


def _runs(spark, stack):
    rows = [(0, n, int(y), int(a), int(b)) for n, m in stack.items() for _, y, a, b in rasters.runs_of(m.astype(np.uint16))]
    return spark.createDataFrame(rows, "slice long, neuron string, y long, x0 long, x1 long")


def _pixels(runs, n, shape):
    out = np.zeros(shape, bool)
    for r in runs.filter(F.col("neuron") == n).collect():
        out[r.y, r.x0 : r.x1] = True
    return out


def _grown(m, shape):
    h, w = m.shape
    out = np.zeros_like(m)
    for dy, dx in shape:
        for x in range(-dx, dx + 1):
            ys, xs = np.nonzero(m)
            ys, xs = ys + dy, xs + x
            ok = (ys >= 0) & (ys < h) & (xs >= 0) & (xs < w)
            out[ys[ok], xs[ok]] = True
    return out


def _shrunk(m, shape):
    reach = 4
    return ~_grown(~np.pad(m, reach), shape)[reach:-reach, reach:-reach]


def test_morphology_by_brute_force(spark):
    rng = np.random.default_rng(4)
    shape = (14, 18)
    blob = np.zeros(shape, bool)
    blob[3:11, 4:14] = True
    blob[6, 8] = blob[0, 17] = False
    blob[1, 1] = blob[5:7, 0] = True
    stack = {"blob": blob, "noise": rng.random(shape) < 0.7, "edge": np.pad(np.ones((6, 6), bool), ((0, 8), (0, 12)))}
    runs = _runs(spark, stack)
    for n, m in stack.items():
        for ring in (masks.CROSS, masks.disk(2)):
            opened = _grown(_shrunk(m, ring), ring)
            assert np.array_equal(_pixels(masks.opened(runs, shape, shape=ring), n, shape), opened)
            assert np.array_equal(_pixels(masks.closed(runs, shape, shape=ring), n, shape), _shrunk(_grown(m, ring), ring))
    assert _pixels(masks.filled(runs, shape), "blob", shape)[6, 8] and _pixels(masks.filled(runs, shape, below=2), "blob", shape)[6, 8]
    assert not _pixels(masks.filled(runs, shape, below=1), "blob", shape)[6, 8]
    assert _pixels(masks.cleaned(runs, shape), "blob", shape).sum() == 80 - 4 and not _pixels(masks.cleaned(runs, shape), "blob", shape)[1, 1]
    parts = masks.labelled(runs)
    assert masks.component_table(parts).filter("neuron = 'blob'").first().n_components == 3
    assert _pixels(masks.without_islands(parts, 3), "blob", shape).sum() == 79


def test_composites_and_differences(spark):
    a, b = np.zeros((20, 20), bool), np.zeros((20, 20), bool)
    a[2:8, 2:8] = b[5:11, 5:11] = True
    runs = _runs(spark, {"A": a, "B": b})
    assert masks.collisions(runs).first().collisions == 9
    assert np.array_equal(_pixels(masks.composite(runs), "A", a.shape), a) and np.array_equal(_pixels(masks.composite(runs, highest=True), "B", a.shape), b)
    one = lambda m: _runs(spark, {"A": m})
    d = {(r.side, r.n) for r in masks.difference(one(a), one(b)).groupBy("side").agg(F.sum(F.col("x1") - F.col("x0")).alias("n")).collect()}
    assert d == {("lost", 27), ("gained", 27)}
    crop = np.zeros((120, 80), bool)
    crop[:, :] = True
    placed = _pixels(masks.placed(masks.merged(masks.rescaled(one(crop), (120, 80), (30, 20))), (20, 10), (60, 60)), "A", (60, 60))
    assert placed[20:50, 10:30].all() and placed.sum() == 600


def test_a_slice_without_truth_counts_as_false(spark):
    pred = spark.createDataFrame([(0, "A", 0, 0, 4), (1, "A", 0, 0, 4), (1, "B", 0, 0, 4), (2, "A", 0, 0, 4)], "slice long, neuron string, y long, x0 long, x1 long")
    truth = spark.createDataFrame([(0, "A", 0, 2, 6), (1, "C", 0, 0, 4)], pred.schema)
    got = {(r.slice, r.neuron): (r.tp, r.fp, r.fn) for r in masks.region_counts(pred, truth).collect()}
    assert got == {(0, "A"): (2, 2, 2), (1, "A"): (0, 4, 0)}


def test_segment_lines(spark):
    numbers = " ".join(map(str, range(1, 24)))
    lines = ["% comment", "", f'0 {numbers} "Background"', f'5 {numbers} "[AVAL]_or_x_12.swc"', f'6 {numbers} "[AVAR].swc"', f'7 {numbers} "Phagosome3"', '8 1 2 "short"', f"9 {numbers} noname"]
    got = {r.nr: (r.label, r.bracketed, r.skeleton_id, r.kind) for r in segments.parsed(spark.createDataFrame([(x,) for x in lines], "line string")).collect()}
    assert got == {0: ("Background", False, None, "background"), 5: ("AVAL", True, 12, "neuron"), 6: ("AVAR", True, None, "neuron"), 7: ("Phagosome3", False, None, "organelle")}


def _filtered(rows, kinds, step):
    """Rows of bytes as the five filters of PNG leave them, byte by byte."""
    out = []
    for y, (row, kind) in enumerate(zip(rows, kinds)):
        above, left = rows[y - 1] if y else bytes(len(row)), lambda r, i: r[i - step] if i >= step else 0
        line = bytearray([kind])
        for i, v in enumerate(row):
            a, b, c = left(row, i), above[i], left(above, i)
            paeth = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            line.append((v - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        out.append(bytes(line))
    return b"".join(out)


def _png(pixels, depth=8, kinds=None):
    h, w = pixels.shape
    rows = [row.astype(">u2" if depth == 16 else "u1").tobytes() for row in pixels]
    raw = _filtered(rows, kinds or [0] * h, depth // 8)
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_all_filters_of_png():
    rng = np.random.default_rng(0)
    for depth in (8, 16):
        for shape in ((1, 1), (1, 9), (9, 1), (13, 7), (7, 13), (40, 40)):
            grid = rng.integers(0, 1 << depth, shape)
            grid[rng.random(shape) < 0.5] = 3
            for kinds in ([0] * shape[0], [1, 2] * shape[0], [4] * shape[0], [3] * shape[0], rng.integers(0, 5, shape[0]).tolist()):
                assert np.array_equal(rasters.decoded(_png(grid, depth, kinds[: shape[0]])), grid)


def test_a_slice_with_filters_is_read_in_seconds():
    raw = np.random.default_rng(1).integers(0, 256, (600, 500, 2), dtype=np.uint8)
    start = time.time()
    rasters._unfiltered(np.full(600, 4), raw)
    assert time.time() - start < 5  # byte by byte this takes minutes


def test_trees_read_only_what_filters_leave(spark, tmp_path):
    for n in ("A", "B"):
        for k in (0, 3):
            folder = tmp_path / n / f"chain_{k:02d}" / "masks"
            folder.mkdir(parents=True)
            for z in (5, 6, 1500):
                (folder / f"mask_{z:04d}.png").write_bytes(_png(np.array([[0, 7, 7, 1]])))
    (tmp_path / "C").mkdir()
    (tmp_path / "C" / "11.png").write_bytes(_png(np.array([[9, 0, 0, 0]])))
    (tmp_path / "B" / "chain_03" / "masks" / "mask_1500.png").write_bytes(b"no picture")
    tree = trees.read(spark, str(tmp_path))
    one = tree.filter("neuron = 'A'")
    assert one.rdd.getNumPartitions() == 2 and one.count() == 6
    assert tree.filter("neuron in ('A', 'C') and slice <= 11").rdd.getNumPartitions() == 3
    assert sorted(map(tuple, tree.filter("neuron in ('A', 'C') and slice between 6 and 11").collect())) == [("A", 0, 6, 1, 0, 1, 4), ("A", 3, 6, 1, 0, 1, 4), ("C", 0, 11, 1, 0, 0, 1)]
    assert tree.filter("chain_idx = 3 and slice < 1500 and x1 > 0").count() == 4 and tree.filter("neuron = 'X'").count() == 0
    own = trees.read(spark, str(tmp_path), binary=False).filter("neuron = 'A' and slice = 5 and chain_idx = 0")
    assert sorted((r.label, r.x0, r.x1) for r in own.collect()) == [(1, 3, 4), (7, 1, 3)]
    with pytest.raises(Exception, match="no PNG"):
        tree.count()


def test_trees_are_written_and_read(spark, tmp_path):
    rows = [("A", 1, 7, 3, 0, 1, 4), ("A", 1, 7, 9, 0, 3, 6), ("A", 1, 7, 2, 2, -2, 1), ("A", 1, 9, 500, 1, 5, 99), ("B", 0, 2, 1, 0, 0, 6), ("B", 0, 99, 1, 0, 0, 6), ("B", 0, 2, 1, 7, 0, 6)]
    runs = spark.createDataFrame(rows, trees.SCHEMA)
    at = spark.createDataFrame([("A", 1, 7), ("A", 1, 8), ("A", 1, 9), ("B", 0, 2), ("C", 0, 1)], "neuron string, chain_idx long, slice long")
    for binary, labels_ in ((False, [3, 9, 2, 500, 1]), (True, [1] * 5)):
        root = f"{tmp_path}/{binary}"
        for _ in range(2):  # writing again replaces
            counts = {(r.neuron, r.chain_idx): (r.n_written, r.n_skipped) for r in trees.write(runs, at, root, (3, 6), binary).collect()}
        assert counts == {("A", 1): (2, 1), ("B", 0): (1, 0), ("C", 0): (0, 1)}
        got = sorted(tuple(r) for r in trees.read(spark, root, binary).collect())
        first = [("A", 1, 7, 3, 0, 1, 3), ("A", 1, 7, 9, 0, 3, 6)] if not binary else [("A", 1, 7, 1, 0, 1, 6)]
        assert got == sorted([*first, ("A", 1, 7, labels_[2], 2, 0, 1), ("A", 1, 9, labels_[3], 1, 5, 6), ("B", 0, 2, 1, 0, 0, 6)])


def test_reviews_become_labels(spark):
    frames_ = spark.createDataFrame([("A", k, z, z % 4 == 0) for k in (0, 1) for z in range(40)] + [("B", 0, 1, False)], "neuron string, chain_idx long, z long, flag boolean")
    acts = spark.createDataFrame([("A", 0, "approve", "leak", 4), ("A", 1, "reject", "leak", 99)], "neuron string, chain_idx long, action string, error_type string, anchor_z long")
    queued = frames_.filter("z in (4, 8, 9)")
    got = labels.expanded(acts, queued, frames_, n=5, seed=1).collect()
    shown = {(r.chain_idx, r.z): (r.verdict, r.role, r.error_type) for r in got if r.role != "sampled"}
    assert shown == {(0, 4): ("ok", "anchor", None), (0, 8): ("ok", "flagged", None), (0, 9): ("ok", "flagged", None)} | {(1, z): ("wrong", "flagged", "leak") for z in (4, 8, 9)}
    drawn = {k: {r.z for r in got if r.role == "sampled" and r.chain_idx == k} for k in (0, 1)}
    assert all(len(z) == 5 and not z & {4, 8, 9} and not any(x % 4 == 0 for x in z) for z in drawn.values()) and drawn[0] != drawn[1]
    with pytest.raises(Exception, match="neither approve nor reject"):
        labels.expanded(acts.withColumn("action", F.lit("maybe")), queued, frames_).collect()


def test_rasters(spark, tmp_path):
    grid = np.array([[0, 1, 1], [2, 300, 300]])
    (tmp_path / "gt").mkdir()
    (tmp_path / "gt" / "x_s007.png").write_bytes(_png(grid, 16))
    got = sorted((r.slice, r.label, r.y, r.x0, r.x1) for r in rasters.label_runs(spark, f"{tmp_path}/gt/*.png").collect())
    assert got == [(7, 1, 0, 1, 3), (7, 2, 1, 0, 1), (7, 300, 1, 1, 3)]
    for at in ("A/chain_02/masks/mask_0005.png", "B/11.png"):
        p = tmp_path / "tree" / at
        p.parent.mkdir(parents=True)
        p.write_bytes(_png(np.array([[0, 255, 9]])))
    got = sorted(tuple(r) for r in rasters.mask_tree(spark, f"{tmp_path}/tree").collect())
    assert got == [("A", 2, 5, 0, 1, 3), ("B", 0, 11, 0, 1, 3)]


def test_files(spark, tmp_path):
    (tmp_path / "n.csv").write_text("node_id,parent_id,cell_name,x,y,z\n1.0,,[A],1,2,3\n2,1.0,A!,,2,3\n3,1,A,1.5,x,3\n4,1,A?,1,2,4\n")
    assert sorted((r.node_id, r.parent_id, r.cell_name, r.z) for r in files.nodes(spark, f"{tmp_path}/n.csv").collect()) == [("1", None, "A", 3.0), ("4", "1", "A", 4.0)]
    for k, body in (("out/A/chain_01/state.json", {"frame_to_z": {"0": 5, "1": 6}}), ("out/B/chain_00/state.json", {"frame_to_z": None})):
        p = tmp_path / k
        p.parent.mkdir(parents=True)
        p.write_text(json.dumps(body))
    got = {(r.neuron_dir, r.chain_idx): r.frame_to_z for r in files.states(spark, f"{tmp_path}/out", "frame_to_z map<string,int>").collect()}
    assert got == {("A", 1): {0: 5, 1: 6}, ("B", 0): None}
    for k, body in (("A/chain_00", "{broken"), ("A/chain_02", json.dumps({"config": {"model_size": "large", "scale": 8}})), ("B/chain_01", json.dumps({"config": {"scale": 4}}))):
        (tmp_path / "runs" / k).mkdir(parents=True)
        (tmp_path / "runs" / k / "state.json").write_text(body)
    assert [tuple(r) for r in files.provenance(spark, f"{tmp_path}/runs").collect()] == [("large", 8, None, None, "A/chain_02")]
    fit = spark.createDataFrame([(4, 1.0, 0.0, 2.0, 0.0, 1.0, 3.0), (3, 1.0, 0.5, 1.0, 0.0, 1.0, 0.0)], "z long, a double, b double, tx double, c double, d double, ty double")
    files.write_registration(fit, fit.filter("z = 4").select("a", "b", "c", "d"), f"{tmp_path}/reg")
    assert sorted(map(tuple, files.registration_json(spark, f"{tmp_path}/reg").collect())) == sorted(map(tuple, fit.collect()))
    (tmp_path / "old.json").write_text(json.dumps({"A": [[2, 0], [0, 2]], "offsets": [[1, 1], [5, 6]], "z_min": 9}))
    assert sorted(map(tuple, files.registration_json(spark, f"{tmp_path}/old.json").collect())) == [(9, 2, 0, 1, 0, 2, 1), (10, 2, 0, 5, 0, 2, 6)]
    d = spark.createDataFrame([("A", '[[1,null,5,20,40,100],["2",1,5,2,4,50]]')], "cell_name string, rows string")
    assert sorted((r.node_id, r.parent_id, r.x, r.y, r.z) for r in files.pulled_nodes(d).collect()) == [("1", None, 10, 20, 2), ("2", "1", 1, 2, 1)]


def test_registration_finds_a_known_affine(spark):
    rng = np.random.default_rng(1)
    rows = []
    for z, n in ((3, 30), (5, 12), (6, 3)):
        for x, y in rng.uniform(0, 500, (n, 2)).tolist():
            rows.append((z, float(x), float(y), 1.1 * x + 0.04 * y + z, -0.03 * x + 1.2 * y - z))
    rows.append((3, 10.0, 10.0, 900.0, 900.0))  # an outlier
    pairs = spark.createDataFrame(rows, "z long, sx double, sy double, gx double, gy double")
    got = {r.z: r for r in registration.affine(pairs).collect()}
    assert set(got) == {3, 5} and all(np.allclose([r.a, r.b, r.tx, r.c, r.d, r.ty], [1.1, 0.04, z, -0.03, 1.2, -z]) for z, r in got.items())
    full = {r.z: r.tx for r in registration.filled(registration.affine(pairs), 2, 6).collect()}
    assert np.allclose([full[z] for z in range(2, 7)], [3, 3, 4, 5, 5])


def test_best_residual_is_least_squares_per_section(spark):
    rng = np.random.default_rng(2)
    rows = [(z, *map(float, rng.uniform(0, 500, 4))) for z, n in ((1, 3), (2, 4), (3, 25)) for _ in range(n)]
    rows += [(4, float(k), 0.0, float(k * k), float(-k)) for k in range(6)]  # on one line
    rows += [(5, 7.0, 7.0, float(k), 1.0) for k in range(5)]  # in one place
    got = registration.best(spark.createDataFrame(rows, "z long, sx double, sy double, gx double, gy double")).collect()
    assert {r.z for r in got} == {2, 3, 4, 5}
    for z in (2, 3, 4, 5):
        p = np.array([r[1:] for r in rows if r[0] == z])
        s = np.c_[p[:, :2], np.ones(len(p))]
        left = np.linalg.norm(s @ np.linalg.lstsq(s, p[:, 2:], rcond=None)[0] - p[:, 2:], axis=1)
        assert np.allclose(sorted(r.best for r in got if r.z == z), sorted(left), atol=1e-6)
