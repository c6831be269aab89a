"""Streams over several files: late rows, a stop between batches, a second run, a batch done twice."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelframe.operators import ledgers
from voxelframe.streaming import live

REVIEW = "neuron string, chain_idx long, review string, ts timestamp, seq long"
FRAME = "neuron string, chain_idx long, ts timestamp, seq long, area long"


def _reviews(rng, n, start):
    stamp = lambda i: f"2024-01-01 00:{i // 60 % 60:02d}:{i % 60:02d}"
    return [(f"N{rng.integers(0, 6)}", int(rng.integers(0, 4)), str(rng.choice(["approved", "rejected", "in_review"])), stamp(int(rng.integers(0, 3000))), start + i) for i in range(n)]


def _write(spark, rows, schema, path):
    spark.createDataFrame(rows, schema.replace("timestamp", "string")).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(path))


def _stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_a_ledger_goes_on_where_it_stopped(spark, tmp_path):
    rng, rows = np.random.default_rng(3), []
    at, source = str(tmp_path / "ledger"), tmp_path / "in"
    want = lambda: {tuple(r) for r in ledgers.latest(spark.read.schema(REVIEW).parquet(str(source)), "review").collect()}
    for k in range(3):
        _write(spark, _reviews(rng, 40, 100 * k), REVIEW, source)
        if k == 1:  # a crash: the rows of a batch are there, but not its pointer
            with pytest.raises(Exception, match="crash"):
                broken = live._swept
                live._swept = lambda *a: (_ for _ in ()).throw(RuntimeError("crash"))
                try:
                    live.merged_ledger(_stream(spark, source, REVIEW), "review", at, buckets=5)
                finally:
                    live._swept = broken
        got = live.merged_ledger(_stream(spark, source, REVIEW), "review", at, buckets=5)
        assert {tuple(r) for r in got.collect()} == want()
    # Nothing new: the same ledger, by another session as well.
    other = spark.newSession()
    again = live.merged_ledger(other.readStream.schema(REVIEW).parquet(str(source)), "review", at, buckets=5)
    assert {tuple(r) for r in again.collect()} == want()


def test_only_touched_buckets_are_written(spark, tmp_path):
    at, source = str(tmp_path / "ledger"), tmp_path / "in"
    _write(spark, [(f"N{i}", 0, "approved", "2024-01-01 00:00:00", i) for i in range(200)], REVIEW, source)
    live.merged_ledger(_stream(spark, source, REVIEW), "review", at, buckets=16)
    _write(spark, [("N7", 0, "rejected", "2024-01-01 00:00:01", 999)], REVIEW, source)
    got = {r.neuron: r.review for r in live.merged_ledger(_stream(spark, source, REVIEW), "review", at, buckets=16).collect()}
    assert got == {f"N{i}": "rejected" if i == 7 else "approved" for i in range(200)}
    assert len([n for n in live._names(spark, f"{at}/rows/1") if n.startswith("bucket=")]) == 1
    pointer = live._finished(spark, at)
    assert len(pointer) == 16 and sorted(pointer.values()) == [0] * 15 + [1]


def test_a_ledger_without_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert live.merged_ledger(_stream(spark, tmp_path / "in", REVIEW), "review", str(tmp_path / "l")).count() == 0


def test_late_frames_are_put_in_between(spark, tmp_path):
    live.with_map_state(spark)
    rng = np.random.default_rng(4)
    frames = [(n, c, f"2024-01-01 00:00:{i:02d}", 100 * c + i, int(rng.integers(0, 50))) for n in "AB" for c in (0, 1) for i in range(12)]
    order = rng.permutation(len(frames))
    source, at = tmp_path / "in", str(tmp_path / "state")
    parts = np.array_split(order, 4)
    for k, part in enumerate(parts[:2]):
        _write(spark, [frames[i] for i in part], FRAME, source)
    key = ["neuron", "chain_idx", "seq"]
    live.revised(live.ratios(_stream(spark, source, FRAME)), key, at)
    for part in parts[2:]:
        _write(spark, [frames[i] for i in part], FRAME, source)
    last = ("A", 0, "2024-01-01 00:00:05", 5, 40)  # comes twice, the second time with another area
    _write(spark, [last], FRAME, source)
    frames = [last if f[:2] + (f[3],) == ("A", 0, 5) else f for f in frames]
    got = {(r.neuron, r.chain_idx, r.seq): r.area_ratio for r in live.revised(live.ratios(_stream(spark, source, FRAME)), key, at).collect()}
    want = {}
    for n in "AB":
        for c in (0, 1):
            own = sorted(f for f in frames if f[:2] == (n, c))
            for before, f in zip([None, *own], own):
                want[n, c, f[3]] = f[4] / before[4] if before and before[4] > 0 and f[4] > 0 else None
    assert got.keys() == want.keys() and all((got[k] is None) == (v is None) and (v is None or abs(got[k] - v) < 1e-12) for k, v in want.items())


def test_old_frames_are_forgotten(spark, tmp_path):
    live.with_map_state(spark)
    source, at = tmp_path / "in", str(tmp_path / "state")
    for minute in (0, 1, 30, 31, 59):
        _write(spark, [("A", 0, f"2024-01-01 00:{minute:02d}:00", minute, 10 + minute)], FRAME, source)
    stream = _stream(spark, source, FRAME).withWatermark("ts", "1 minute")
    got = {r.seq: r.area_ratio for r in live.revised(live.ratios(stream, horizon=120_000), ["neuron", "chain_idx", "seq"], at).collect()}
    assert got == {0: None, 1: 11 / 10, 30: 40 / 11, 31: 41 / 40, 59: 69 / 41}


def test_appended_rows_come_once(spark, tmp_path):
    source, at = tmp_path / "in", str(tmp_path / "out")
    for k in range(3):
        _write(spark, _reviews(np.random.default_rng(k), 10, 10 * k), REVIEW, source)
        assert live.drained(_stream(spark, source, REVIEW).select("neuron", "seq"), at).count() == 10 * (k + 1)
    assert live._names(spark, f"{at}/none") == []


def test_a_chain_sends_its_frames_at_once():
    """The store gets one message per chain and batch, however many frames there are."""
    import pandas as pd

    sent, held = [], []

    class State:
        get = staticmethod(lambda: iter(held))
        put = staticmethod(lambda rows: (sent.append(len(rows)), held.clear(), held.extend(rows)))
        appendList = staticmethod(lambda rows: (sent.append(len(rows)), held.extend(rows)))

    class Handle:
        getListState = staticmethod(lambda name, schema: State)

    p = live._Ratios(None)
    p.init(Handle)
    frames = lambda seqs, area: pd.DataFrame({"ts": pd.to_datetime(list(seqs), unit="s"), "seq": list(seqs), "area": area})
    assert len(next(p.handleInputRows(("A", 0), iter([frames(range(0, 100, 2), 4)]), None))) == 50
    (late,) = p.handleInputRows(("A", 0), iter([frames([5], 8)]), None)
    assert list(zip(late["seq"], late["area_ratio"])) == [(5, 2.0), (6, 0.5)]
    (again,) = p.handleInputRows(("A", 0), iter([frames([5], 2)]), None)
    assert list(zip(again["seq"], again["area_ratio"])) == [(5, 0.5), (6, 2.0)] and sent == [50, 1, 51] and len(held) == 51
