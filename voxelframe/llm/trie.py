"""Prefix trie of conversations: which turns do many of them start with, and what would be saved by sharing?

``trie`` takes a path of turns per conversation and returns one row per distinct prefix.  Paths are dealt to
shards by ranges of (path, conv_id), so the members of a node are neighbours, in one shard or in shards that
follow each other.  Each shard lays its turn ids out as a padded matrix, sorts it by ``lexsort``, and marks
by OR-accumulated changes of columns where a node starts; ``reduceat`` over these starts gives the figures
of every node of a depth at once.  A shard also gets the last path of the shard before and the first path of
the shard after it.  So each node is counted by one shard only, every figure is a sum or a minimum over
shards, and a shard knows which of its nodes go on in another: these alone are put together by a grouping.

A turn is known by 128 bits of the SHA-256 of its role and text.

Edge cases of ``rebuilt``: a null role or text is empty; a null turn comes first; turns of equal number go
in the order of their digest, repeated rows are turns of their own; rows with a null conv_id belong to no
conversation and are left out; extra columns are left out.  Edge cases of ``trie``: a path without turns is
a member of the root alone; a repeated conv_id is a member once per row, in ``ends`` too; texts of any
length count whole; an empty table has no node at all, not even a root.  A conversation is one row (20 bytes
a turn), so its length, not its number of copies, has to fit into a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelframe.llm import shared

#: Turns that a shard is to have.
SHARD_TURNS = 1 << 20
#: Cells of the padded matrix that are laid out at once.
CELLS = 1 << 22
#: Rows of nodes that several shards share which may be sent to every executor (of about 50 bytes each).
SENT = 250_000
ID = 16

#: How many turns of its base a conversation takes, and which conversation is its base.
SPAN, TAKEN = 100, 6


def digest(role: Column, text: Column) -> Column:
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    whole = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    return F.unhex(F.substring(whole, 1, 2 * ID))


def paths(turns: DataFrame) -> DataFrame:
    """conv_id and turns, an array of (id, n): digest and code points of each turn, in order."""
    n = F.length(F.coalesce("text", F.lit(""))).alias("n")
    at = turns.filter("conv_id is not null").select("conv_id", F.struct("turn", digest(F.col("role"), F.col("text")).alias("id"), n).alias("t"))
    # Nulls sort first within structs.
    own = at.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return own.select("conv_id", F.transform("t", lambda x: F.struct(x.id.alias("id"), x.n.alias("n"))).alias("turns"))


def rebuilt(own: DataFrame) -> DataFrame:
    """Each conversation with the first turns of its base (that of the hundred it is in) instead of its own."""
    c = F.col("conv_id")
    own = own.select("conv_id", "turns", (c - c % SPAN).alias("base"), (F.crc32(c.cast("string")) % TAKEN).cast("int").alias("h"))
    base = own.filter("conv_id = base").select("base", F.slice("turns", 1, TAKEN - 1).alias("first"))
    both = own.join(base, "base", "left")
    none = F.array().cast(own.schema["turns"].dataType)
    taken = F.slice(F.coalesce("first", none), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.lit(0), F.size("turns") - F.col("h")))
    return both.select("conv_id", F.concat(taken, rest).alias("turns"))


NODE = "depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends string, key binary, parent_key binary"


class Shard:
    """Sorted paths of a shard, with the paths around it."""

    def __init__(self, side: np.ndarray, conv: np.ndarray, ids: list[bytes], sizes: np.ndarray, n: np.ndarray):
        length = sizes // ID
        flat = np.frombuffer(b"".join(ids), ">u8").reshape(-1, 2)
        # Ranks of the digests stand for them: equal and in the same order.
        order = np.lexsort((flat[:, 1], flat[:, 0]))
        fresh = np.ones(len(flat), bool)
        fresh[1:] = (flat[order[1:]] != flat[order[:-1]]).any(axis=1)
        rank = np.empty(len(flat), np.int32)
        rank[order] = np.cumsum(fresh) - 1
        self.first = np.cumsum(length) - length
        self.rank, self.n, self.length = rank, n, length
        order = self._sorted(side, conv, length)
        self.side, self.conv, self.length, self.first = side[order], conv[order], length[order], self.first[order]
        self.ids = ids, order
        self.width = int(self.length.max(initial=0))

    def _column(self, values: np.ndarray, rows: np.ndarray, d: int, pad: int) -> np.ndarray:
        out = np.full(len(rows), pad, np.int64)
        live = self.length[rows] > d
        out[live] = values[self.first[rows[live]] + d]
        return out

    def _strip(self, rows: np.ndarray, start: int, stop: int) -> np.ndarray:
        """The padded matrix of some columns."""
        return np.stack([self._column(self.rank, rows, d, -1) for d in range(start, stop)])

    def _sorted(self, side: np.ndarray, conv: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Rows by path and conv_id, strip by strip from the last columns; the path before comes first and
        the path after last, also where they equal paths of the shard."""
        rows, width = np.arange(len(length)), int(length.max(initial=0))
        order = np.lexsort((conv, side))
        step = max(1, CELLS // max(1, len(rows)))
        for start in reversed(range(0, width, step)):
            strip = self._strip(rows[order], start, min(width, start + step))
            order = order[np.lexsort(strip[::-1])]  # stable: what earlier strips decided stays for ties
        return order

    def path(self, row: int) -> bytes:
        ids, order = self.ids
        return ids[order[row]]

    def nodes(self) -> Iterator[pa.RecordBatch]:
        here = np.flatnonzero(self.side == 0)
        lo, hi = here[0], here[-1] + 1
        length, first, conv = self.length, self.first, self.conv
        total = np.zeros(len(length), np.int64)
        np.add.at(total, np.repeat(np.arange(len(length)), length), self.n[np.repeat(first - (np.cumsum(length) - length), length) + np.arange(length.sum())])
        same = self._same()  # same[r]: turns that row r shares with the row before it
        leaf = np.concatenate((same[1:], [0])) < length  # row r's whole path ends here: the next does not go on from it
        own = total.copy()  # what row r's path adds: the turns that it does not share with the row before
        for d in range(int(same.max(initial=0))):
            rows = np.flatnonzero(same > d)
            own[rows] -= self.n[first[rows] + d]
        before = np.zeros(len(length), np.int64)
        after = same[hi] if hi < len(length) else 0
        live = np.arange(lo, hi)
        parent = None
        for d in range(self.width + 1):
            live = live[length[live] >= d]
            if not len(live):
                return
            new = same[live] < d
            starts = np.flatnonzero(new | (live == lo))
            at, ends = live[starts], np.concatenate((starts[1:], [len(live)]))
            if d:  # code points of the turns above this depth
                before[live] += self.n[first[live] + d - 2] if d > 1 else 0
            adds = own[live]
            adds[new] = total[live[new]] - before[live[new]]
            kids = (length[live] > d) & (same[live] <= d)
            done = length[live] == d
            add = lambda x: np.add.reduceat(x.astype(np.int64), starts)
            open_ = np.zeros(len(starts), bool)
            open_[0] |= at[0] == lo and (d == 0 or same[lo] >= d)
            open_[-1] |= live[-1] == hi - 1 and (d == 0 or after >= d)
            least = np.minimum.reduceat(conv[live], starts)
            key = [self.path(at[k])[: ID * d] if open_[k] else None for k in range(len(at))] if open_.any() else [None] * len(at)
            if d:
                of = np.searchsorted(parent[0], at, "right") - 1
                up = pa.array(parent[1][of], pa.int64(), mask=parent[2][of])
                up_key = pa.array([self.path(parent[0][k])[: ID * (d - 1)] if parent[2][k] else None for k in of], pa.binary())
            else:
                up, up_key = pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.binary())
            listed = np.concatenate(([0], np.cumsum(add(done))))
            ids = pc.cast(pa.array(conv[live[done]], pa.int64()), pa.string())
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(listed, pa.int32()), ids), ",")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(at), d), pa.int64()), pa.array(least, pa.int64()), up, pa.array(ends - starts, pa.int64()),
                    pa.array(add(kids)), pa.array(add(leaf[live])), pa.array(add(total[live] - before[live]) - add(adds)), joined,
                    pa.array(key, pa.binary()), up_key,
                ],
                names=[c.split()[0] for c in NODE.split(", ")],
            )
            parent = at, least, open_

    def _same(self) -> np.ndarray:
        """How many turns each row shares with the row before it: columns before the first that changes."""
        same = np.zeros(len(self.length), np.int64)
        changed = np.zeros(len(self.length), bool)
        changed[:1] = True
        rows = np.arange(len(self.length))
        step = max(1, CELLS // max(1, len(rows)))
        for start in range(0, self.width, step):
            strip = self._strip(rows, start, min(self.width, start + step))
            for column in strip:
                changed[1:] |= column[1:] != column[:-1]
                same += ~changed
            if changed.all():
                break
        return np.minimum(same, np.minimum(self.length, np.concatenate(([0], self.length[:-1]))))


def _nodes(key: tuple, table: pa.Table) -> pa.Table:
    table = table.combine_chunks()
    paths, counts = table.column("path"), pc.list_flatten(table.column("n"))
    ids = [p.as_py() for p in paths]
    sizes = np.array([len(p) for p in ids], np.int64)
    shard = Shard(table.column("side").to_numpy(), table.column("conv_id").to_numpy(), ids, sizes, counts.to_numpy().astype(np.int64))
    return pa.Table.from_batches(list(shard.nodes()))


def trie(own: DataFrame) -> DataFrame:
    """Per distinct prefix of the paths (conv_id, turns): conv_id (its smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens and ends, the comma-joined ids of the members that end there.
    The node's last turn is turn number ``depth`` of conversation conv_id."""
    spark, at = own.sparkSession, shared.folder(own.sparkSession, "trie")
    slim = own.select("conv_id", F.array_join(F.transform("turns", lambda t: F.hex(t.id)), "").alias("path"), F.transform("turns", lambda t: t.n).alias("n"))
    slim = shared.written(slim.withColumn("path", F.unhex("path")), f"{at}/paths")
    n_turns = slim.agg(F.sum(F.size("n"))).first()[0] or 0
    n_shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_turns // SHARD_TURNS))
    dealt = slim.repartitionByRange(n_shards, "path", "conv_id").withColumn("shard", F.spark_partition_id())
    dealt = shared.written(dealt, f"{at}/shards")
    ends = dealt.groupBy("shard").agg(F.max(F.struct("path", "conv_id", "n")).alias("last"), F.min(F.struct("path", "conv_id", "n")).alias("first"))
    w = Window.orderBy("shard")  # one row per shard
    ends = ends.select("shard", F.lag("last").over(w).alias("before"), F.lead("first").over(w).alias("after"))
    around = F.array(*(F.struct(F.lit(k).alias("side"), F.col(c).alias("p")) for k, c in ((-1, "before"), (1, "after"))))
    around = ends.select("shard", F.explode(around).alias("a")).filter("a.p is not null").select("shard", "a.side", "a.p.conv_id", "a.p.path", "a.p.n")
    rows = dealt.select("shard", F.lit(0).alias("side"), "conv_id", "path", "n").unionByName(around)
    made = rows.groupBy("shard").applyInArrow(_nodes, NODE)
    made = shared.written(made.withColumn("key", F.when(F.col("key").isNotNull(), F.unhex(F.sha2("key", 256)))).withColumn("parent_key", F.when(F.col("parent_key").isNotNull(), F.unhex(F.sha2("parent_key", 256)))), f"{at}/nodes")
    return _whole(made)


def _whole(made: DataFrame) -> DataFrame:
    """Nodes of one shard as they are; those of several shards put together, one row per shard and node."""
    piece = F.when(F.col("ends") != "", F.struct(F.split("ends", ",")[0].cast("long").alias("first"), "ends"))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    open_ = made.filter("key is not null").groupBy("key", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.first("parent_key").alias("parent_key"), *sums,
        F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p.ends), ",").alias("ends"),
    )
    # A root without turns below it is a leaf.
    open_ = open_.withColumn("n_leaves", F.when((F.col("depth") == 0) & (F.col("n_children") == 0), 1).otherwise(F.col("n_leaves")))
    n_open = made.filter("key is not null").count()
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    whole = made.filter("key is null")
    up = open_.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    up = F.broadcast(up) if n_open <= SENT else up
    hung = whole.filter("parent_key is not null").drop("parent_conv_id", "key").unionByName(open_.filter("depth > 0").drop("key"))
    hung = hung.join(up, "parent_key").withColumnRenamed("above", "parent_conv_id").select(columns)
    root = open_.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")).select(columns)
    return whole.filter("parent_key is null").select(columns).unionByName(hung).unionByName(root)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return trie(rebuilt(paths(turns))).withColumn("ends_sha256", F.sha2("ends", 256)).drop("ends")


# DuckDB has no crc32: its bits are folded one by one; -1 stands for a shift, else a byte comes in.
_BYTES = "flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
_FOLD = "CASE WHEN e >= 0 THEN xor(a, e) ELSE xor(a >> 1, 3988292384 * (a & 1)) END"
_CRC = f"xor(list_reduce(list_concat([4294967295::BIGINT], {_BYTES}), lambda a, e: {_FOLD}), 4294967295)"
OP12_SQL = f"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k,
         {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS x
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(x ORDER BY k) AS xs FROM t GROUP BY conv_id),
ids AS (SELECT o.conv_id, o.xs, b.xs AS base, o.crc % {TAKEN} AS h FROM (SELECT *, {_CRC} AS crc FROM own) o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % {SPAN}),
c AS (SELECT conv_id, list_concat(coalesce(base[1:h], []), xs[h + 1:]) AS p FROM ids),
pre AS (SELECT conv_id, len(p) AS n, d, p[1:d] AS q FROM (SELECT conv_id, p, unnest(range(0, len(p) + 1)) AS d FROM c)),
node AS (
  SELECT q, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d) AS ends
  FROM pre GROUP BY q, d),
kids AS (SELECT q[1:depth - 1] AS q, depth - 1 AS depth, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY ALL),
full_ AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (q, depth)),
up AS (SELECT q[1:u] AS q, u AS depth, n_children = 0 AS leaf, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * length(q[d].text) END AS saved
       FROM (SELECT q, depth AS d, n_children, n_convs, unnest(range(0, depth + 1)) AS u FROM full_)),
sums AS (SELECT q, depth, count(*) FILTER (leaf) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM up GROUP BY q, depth)
SELECT f.conv_id, f.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
FROM full_ f JOIN sums s ON f.q = s.q AND f.depth = s.depth LEFT JOIN full_ p ON p.q = f.q[1:f.depth - 1] AND p.depth = f.depth - 1
"""
