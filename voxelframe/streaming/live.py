"""Live forms of the batch operators: Structured Streaming with file sources and sinks in the shared folder.

Each takes the folder ``at`` in which its state and results live.  A run that is called again with the same
folder, after its end or after a crash, goes on behind the last batch that was finished; a batch that had begun
is done again with the same outcome.  Without a folder a new one is made, for one run over all there is.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

KEY = ["neuron", "chain_idx"]
#: Parts of a ledger, by hash of the key; a batch rewrites those that it touches.
BUCKETS = 64


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; only a local master may go without one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base}/stream-{uuid.uuid4().hex}"


def _run(stream: DataFrame, at: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    run = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{at}/state").outputMode(mode)
    run.trigger(availableNow=True).start().awaitTermination()


def drained(stream: DataFrame, at: str | None = None) -> DataFrame:
    """Runs the stream over all there is and gives back all that it has appended, in this run and before."""
    spark, at = stream.sparkSession, at or shared_folder(stream.sparkSession)
    run = stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state")
    run.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def _names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing if there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in store.listStatus(folder)] if store.exists(folder) else []


def _finished(spark: SparkSession, at: str, before: int | None = None) -> dict[int, int]:
    """Where the ledger stands after the last finished batch (before a given one): the batch that wrote each
    bucket.  A batch is finished when its pointer is there whole; the ledger has one row of it per bucket."""
    done = [int(n) for n in _names(spark, f"{at}/pointers") if "_SUCCESS" in _names(spark, f"{at}/pointers/{n}")]
    done = [n for n in done if before is None or n < before]
    return {r.bucket: r.batch for r in spark.read.parquet(f"{at}/pointers/{max(done)}").collect()} if done else {}


def ledger(spark: SparkSession, at: str, schema: StructType, value: str) -> DataFrame:
    """The ledger as the last finished batch left it; empty before the first."""
    return _buckets(spark, at, _finished(spark, at), schema).select(*KEY, value)


def _buckets(spark: SparkSession, at: str, pointer: dict[int, int], schema: StructType) -> DataFrame:
    paths = [f"{at}/rows/{batch}/bucket={bucket}" for bucket, batch in sorted(pointer.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def merged_ledger(events: DataFrame, value: str, at: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """A ledger in which the latest row per key wins, by (ts, seq), brought up to date batch by batch.

    The keys lie in ``buckets`` (the number stays with the folder) by hash.  A batch reads and writes the
    buckets of its own keys only; then a pointer, kept per batch, says which batch holds each bucket.  A batch
    that is done again begins at the pointer before its own and writes the same again.  Buckets and pointers
    that neither the last nor the next to last pointer needs are removed."""
    spark, at = events.sparkSession, at or shared_folder(events.sparkSession)
    schema = events.select(*KEY, value, "ts", "seq").schema

    def merge(batch: DataFrame, number: int) -> None:
        pointer = _finished(spark, at, before=number)
        bucket = F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int")
        last = F.max_by(F.struct(value, "ts", "seq"), F.struct("ts", "seq")).alias("r")
        latest = lambda rows: rows.groupBy(*KEY).agg(last).select(*KEY, "r.*")
        new = latest(batch.select(*KEY, value, "ts", "seq")).persist()
        touched = sorted(r.b for r in new.select(bucket.alias("b")).distinct().collect())  # numbers below ``buckets``
        if not touched:
            new.unpersist()
            return
        old = _buckets(spark, at, {b: pointer[b] for b in touched if b in pointer}, schema)
        rows = latest(new.unionByName(old)).withColumn("bucket", bucket)
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{at}/rows/{number}")
        new.unpersist()
        now = pointer | dict.fromkeys(touched, number)
        spark.createDataFrame(sorted(now.items()), "bucket int, batch long").coalesce(1).write.mode("overwrite").parquet(f"{at}/pointers/{number}")
        _swept(spark, at, {*now.values(), *pointer.values(), number}, number)

    _run(events, at, merge)
    return ledger(spark, at, schema, value)


def _swept(spark: SparkSession, at: str, used: set[int], number: int) -> None:
    """Removes what neither the pointer of this batch nor the one before it needs."""
    pointers = sorted(int(n) for n in _names(spark, f"{at}/pointers"))
    stale = [f"{at}/pointers/{n}" for n in pointers if n < number][:-1]
    stale += [f"{at}/rows/{n}" for n in map(int, _names(spark, f"{at}/rows")) if n < number and n not in used]
    for path in stale:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


_FRAME = "ts long, seq long, area long"
#: Rows that ``ratios`` gives out.
RATIO = "neuron string, chain_idx long, ts long, seq long, area long, area_ratio double"


class _Ratios(StatefulProcessor):
    """Frames of a chain by their place (ts, seq).  A frame that comes late is put in between, and the one after
    it is given out again; a frame that comes twice counts as it came last."""

    def __init__(self, horizon: int | None):
        self.horizon = horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.frames = handle.getListState("frames", _FRAME)

    def _kept(self) -> list[tuple[tuple[int, int], int]]:
        return sorted(((int(f[0]), int(f[1])), int(f[2])) for f in self.frames.get())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        new = pd.concat(list(rows))
        stamps = new["ts"].astype("datetime64[us]").astype("int64")
        places = dict(zip(zip(stamps.tolist(), new["seq"].tolist()), new["area"].tolist()))
        kept = dict(self._kept())
        at = kept | places
        # One message to the store per chain, not per frame.
        if kept.keys() & places.keys():
            self.frames.put([(*place, area) for place, area in at.items()])
        else:
            self.frames.appendList([(*place, area) for place, area in places.items()])
        order = sorted(at)
        out = []
        for k, place in enumerate(order):
            before = order[k - 1] if k else None
            if place in places or before in places:
                ok = before is not None and at[before] > 0 and at[place] > 0
                out.append((key[0], key[1], *place, at[place], at[place] / at[before] if ok else None))
        if self.horizon is not None:
            self.handle.registerTimer(max(stamps) // 1000 + self.horizon)
        made = pd.DataFrame(out, columns=[c.split()[0] for c in RATIO.split(", ")])
        yield made.astype({"area_ratio": "Float64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        """Forgets the frames that nothing on time can come behind any more, but for the last of them."""
        until = (expiredTimerInfo.getExpiryTimeInMs() - self.horizon) * 1000
        kept = self._kept()
        late = len([f for f in kept if f[0][0] <= until][:-1])
        if late:
            self.frames.put([(*place, area) for place, area in kept[late:]])
        yield pd.DataFrame(columns=[c.split()[0] for c in RATIO.split(", ")])

    def close(self) -> None:
        pass


def ratios(frames: DataFrame, horizon: int | None = None) -> DataFrame:
    """area_ratio of each frame (neuron, chain_idx, ts, seq, area) against the one before it in its chain, null
    behind or on an empty one, as a stream of revisions: a frame is given out again when one that came late
    changes what it is measured against, or itself.

    With a ``horizon`` (milliseconds) and a watermark on ts, frames that far behind the watermark are
    forgotten by a timer; without, a chain's frames all stay in the state.  The state is a list per chain in
    the store that ``spark.sql.streaming.stateStore.providerClass`` names, which has to be RocksDB's."""
    grouped = frames.select(*KEY, "ts", "seq", "area").groupBy(*KEY)
    return grouped.transformWithStateInPandas(_Ratios(horizon), RATIO, "Update", "None" if horizon is None else "EventTime")


def revised(stream: DataFrame, keys: list[str], at: str | None = None) -> DataFrame:
    """Runs a stream of revisions over all there is; of each key the row given out last stands.  A batch writes
    its rows under its own number, so one that is done again replaces them."""
    spark, at = stream.sparkSession, at or shared_folder(stream.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows/batch={number}")

    _run(stream, at, write, "update")
    if not _names(spark, f"{at}/rows"):
        return spark.createDataFrame([], stream.schema)
    schema = StructType([*stream.schema.fields]).add("batch", "long")
    rows = spark.read.schema(schema).parquet(f"{at}/rows")
    rest = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return last.select(*keys, "r.*").select(*stream.columns)


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_map_state(spark: SparkSession) -> None:
    """Names the store that keeps maps as state, if the session has named none."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if not spark.conf.get(key, "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set(key, ROCKSDB)
