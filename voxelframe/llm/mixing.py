"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

Each source's rows form blocks of equal size.  With weight ``a / q`` (whole numbers in the exact ratio of
the weights given, ``q`` their sum), block ``b`` (from 0) of a source is released at slot ``floor(b*q/a)``
and due by slot ``ceil((b+1)*q/a)``.  Earliest deadline first meets every such window, so in any prefix of
slots no source is a whole block away from its weight, until a source runs out.  Nothing is rounded: a
float counts as the decimal that it prints as.

A block has the same share of all rows at any scale: BLOCKS blocks, or as many as there are rows, and one
more per source for its rest.  So the driver lays out, with whole numbers of any length, a number of
slots that is bounded whatever the input (five numbers, 40 bytes, a slot), and these are all it holds,
besides a weight and a count per source.

No row is dropped: a source with more blocks than its share goes on at its own slots after others ran
out.  ``in_target`` marks slots before the first source runs out, where the deviation bound holds; a
weighted source without rows has run out from the start.

Edge cases: a null source is a source of its own; texts don't matter; rows of a source go by a hash of
doc_id, then doc_id, then a hash of the whole row, so only rows that are equal throughout may change
places; weights of zero or less, or that are no numbers, stop the job, as do slots of over 63 bits; an
empty table gives an empty one; extra columns pass through ``mix``, but those named block, release,
deadline, slot or in_target, or beginning with ``_mix``, are replaced.
"""

from __future__ import annotations

import heapq
import math
from array import array
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Blocks that all rows make up; a block is the unit in which shares are kept.
BLOCKS = 100_000
#: Shares of a source's rows that are numbered side by side.
LANES = 512
#: Default weights: the row share of a source to this power.
TEMPERATURE = 0.5


def whole_weights(weights: dict) -> dict:
    """The least whole numbers in the exact ratio of the weights."""
    exact = {s: Fraction(str(w)) for s, w in weights.items()}
    if any(w <= 0 for w in exact.values()):
        raise ValueError("a weight is not above zero")
    scale = math.lcm(*(w.denominator for w in exact.values()))
    out = {s: int(w * scale) for s, w in exact.items()}
    common = math.gcd(*out.values())
    return {s: a // common for s, a in out.items()}


def layout(counts: list[int], blocks: list[int]) -> list[array]:
    """Source, block, slot, release and deadline of so many blocks per source: earliest deadline first
    among released blocks; of equal deadlines, the first source."""
    q = sum(counts)
    waiting = [(0, i, 0) for i in range(len(counts)) if blocks[i]]  # release, source, block
    ready, out, slot = [], [array("q") for _ in range(5)], 0
    heapq.heapify(waiting)
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            release, i, b = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(b + 1) * q // counts[i]), i, b, release))
        deadline, i, b, release = heapq.heappop(ready)
        for column, x in zip(out, (i, b, slot, release, deadline)):
            if x >= 1 << 63:
                raise ValueError("a slot exceeds 63 bits")
            column.append(x)
        if b + 1 < blocks[i]:
            heapq.heappush(waiting, ((b + 1) * q // counts[i], i, b + 1))
        slot += 1
    return out


def source_rows(docs: DataFrame) -> dict:
    """Rows per source: one small row per source reaches the driver, which holds a weight for each."""
    return {r["source"]: r["count"] for r in docs.groupBy("source").count().collect()}


def mix(docs: DataFrame, weights: dict | None = None, block_rows: int | None = None) -> DataFrame:
    """Adds block, release, deadline, slot, in_target.  A source not in ``weights`` stops the job."""
    spark = docs.sparkSession
    rows = source_rows(docs)
    block_rows = block_rows or max(1, -(-sum(rows.values()) // BLOCKS))
    if weights is None:
        weights = {s: float(n) ** TEMPERATURE for s, n in rows.items()}
    shares = whole_weights(weights) if weights else {}
    names = sorted(shares, key=lambda s: (s is None, str(s)))
    counts, q = [shares[s] for s in names], sum(shares.values())
    laid = layout(counts, [-(-rows.get(s, 0) // block_rows) for s in names])
    columns = ("_mix_k2", "_mix_b", "slot", "release", "deadline")
    slots = spark.createDataFrame(pa.table({c: np.frombuffer(x, np.int64) for c, x in zip(columns, laid)}))
    added = ("block", "release", "deadline", "slot", "in_target")
    kept = [c for c in docs.columns if c not in added and not c.startswith("_mix")]
    share = spark.createDataFrame([(s, k) for k, s in enumerate(names)], "_mix_source string, _mix_k long")
    # Both broadcasts are tables of the driver: one row per weight, and one per slot, at most BLOCKS and one per source.
    numbers = docs.select(*kept).join(F.broadcast(share), F.col("source").eqNullSafe(F.col("_mix_source")), "left").drop("_mix_source")
    unknown = F.raise_error(F.lit("a source has no weight")).cast("long")
    # Maps have no hash: rows that differ in them alone count as equal.
    plain = [c for c, t in docs.dtypes if c in kept and "map<" not in t]
    laned = numbers.withColumns({"_mix_k": F.coalesce("_mix_k", unknown), "_mix_lane": F.pmod(F.xxhash64("doc_id"), F.lit(LANES)), "_mix_h": F.xxhash64(*plain)})
    # Rows before each lane: a running sum over at most LANES counts per source.
    lane = ["_mix_k", "_mix_lane"]
    starts = laned.groupBy(*lane).agg(F.count("*").alias("_mix_n"))
    before = F.sum("_mix_n").over(Window.partitionBy("_mix_k").orderBy("_mix_lane")) - F.col("_mix_n")
    starts = starts.select(*lane, before.alias("_mix_start"))
    # Numbered and joined by the same keys, which are never null: whole rows are dealt once for both.
    order = Window.partitionBy(*lane).orderBy("doc_id", "_mix_h")
    numbered = laned.withColumn("_mix_i", F.row_number().over(order) - 1)
    numbered = numbered.join(starts, lane, "left").withColumn("block", F.expr(f"(_mix_start + _mix_i) div {block_rows}L"))
    placed = numbered.join(F.broadcast(slots), (F.col("_mix_k") == F.col("_mix_k2")) & (F.col("block") == F.col("_mix_b")), "left")
    # The first slot that some source can no longer fill.
    end = min((rows.get(s, 0) // block_rows * q // shares[s] for s in names), default=0)
    return placed.withColumn("in_target", F.col("slot") < F.lit(min(end, (1 << 63) - 1))).select(*kept, *added)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source"))
