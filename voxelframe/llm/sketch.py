"""Near-duplicate detection with HyperMinHash.

A document's set holds the 64-bit hashes of its distinct five-word shingles.  It is hashed into
REGISTERS buckets, one seeded hash per bucket; a bucket stores the leading-zero count of its minimum
and MANTISSA bits after the first one, 16 bits in all.  Bands of compressed registers give buckets of
candidates; the collision-corrected Jaccard estimate drops pairs far below the threshold, and full sets
confirm the rest.  Documents of equal sets are one node from the start: their sets are compared in full,
grouped by digest and set, and two unlike sets of one digest would stop the job.

No bucket emits all its pairs.  In each round a bucket compares its members with one pivot, only across
classes that are not yet joined; a pivot that has met its whole bucket leaves it, and a bucket that lies
within one class is done.  After PIVOT_ROUNDS, nodes whose buckets still hold several classes (texts that
share a common passage, say) get narrower buckets: one for each shingle of their rarest quarter.  Two sets
at the threshold always share one of these, whatever the order of shingles is, so nothing is lost, and
shingles of common passages come last in the order and make no bucket.  Pivot rounds run on these, then
what is left in buckets of several classes is compared in full, each distinct bucket once.

With 4 registers per band and 32 bands, a pair at the threshold is missed with chance (1-0.75^4)^32,
about 5 in a million, and above the threshold with less.

Edge cases: null, empty and white-space texts have no shingles and are linked with nothing; texts of
fewer than five words have one shingle; ties go to the smallest doc_id; a repeated doc_id is one
document per row, and a null doc_id is never the smallest unless a class has no other; an empty table
gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType

WORDS = 5
REGISTERS = 128
BAND_ROWS = 4
MANTISSA = 10
PERCENT = 75
#: Estimates this far below the threshold are dropped: over four and a half standard errors of 128 registers,
#: which a pair at the threshold exceeds with a chance of about 2 in a million.
SLACK = 0.18
#: Rounds of pivots in the buckets of bands, then in those of single shingles.
PIVOT_ROUNDS = 1
NARROW_ROUNDS = 2
#: Common shingles that come last in the order of shingles; sets the cost, not the result.
HOT = 200_000
#: Orders of rows by which bands choose their pivots: a round tries so many unlike pivots per group.
PIVOT_ORDERS = 4

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SEEDS = np.random.default_rng(20240229).integers(1, 2**63, size=(2, REGISTERS), dtype=np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    h = xxhash.xxh3_64_intdigest
    memo = {w: h(w) for w in set(words)}
    ids = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    n = len(ids) - WORDS + 1
    out = np.zeros(n, np.uint64)
    for k in range(WORDS):  # a polynomial of word hashes, finished by a mixer
        out = (out ^ ids[k : k + n]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def registers(hashes: np.ndarray) -> np.ndarray:
    """16 bits per register: leading zeros of the minimum (6 bits), then MANTISSA bits after its first one."""
    low = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        part = hashes[at : at + 1024]
        x = (part ^ (part >> np.uint64(31)))[None, :] * _SEEDS[0][:, None]
        x += _SEEDS[1][:, None]
        np.minimum(low, x.min(axis=1), out=low)
    return compress(low)


def compress(low: np.ndarray) -> np.ndarray:
    zeros = np.zeros(low.shape, np.uint64)
    x = low.copy()
    for step in (32, 16, 8, 4, 2, 1):
        empty = (x >> np.uint64(64 - step)) == 0
        zeros[empty] += np.uint64(step)
        x[empty] <<= np.uint64(step)
    after = x << np.uint64(1)
    return ((zeros << np.uint64(MANTISSA)) | (after >> np.uint64(64 - MANTISSA))).astype("<u2")


@lru_cache(maxsize=None)
def _collision(n_a: int, n_b: int) -> float:
    """Chance that the registers of two disjoint sets of these sizes agree: over all register values, the
    product of the chances that either minimum falls into the value's interval."""
    zeros = np.arange(64)[:, None]
    edges = (1 << MANTISSA) + np.arange((1 << MANTISSA) + 1)[None, :]
    bounds = np.log1p(-np.minimum(edges * 2.0 ** -(zeros + MANTISSA + 1.0), 1 - 2.0**-53))
    chance = lambda n: -np.diff(np.exp(n * bounds), axis=1)
    return float((chance(n_a) * chance(n_b)).sum())


def estimate(equal: float, n_a: int, n_b: int) -> float:
    """Jaccard from the share of equal registers, less the share that unlike minima make by chance.
    Sizes are taken to the nearest eighth of a power of two."""
    near = lambda n: int(round(2 ** (round(8 * np.log2(max(1, n))) / 8)))
    chance = _collision(near(n_a), near(n_b))
    return max(0.0, (equal - chance) / (1 - chance))


def _scratch(spark: SparkSession) -> str:
    """A new folder under the shared checkpoint folder that the session names.  Only a local master may
    go without one, as in tests: elsewhere executors would each write to their own disk."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="spark-")
    return f"{shared}/near-{uuid.uuid4().hex}"


def _kept(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _removed(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that nothing reads any more."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sketches(docs: DataFrame) -> DataFrame:
    """Adds n_shingles, digest (128 bits of the whole set; null without shingles) and sketch."""

    @F.arrow_udf("struct<n:bigint,digest:binary,sketch:binary>")
    def of(texts: pa.Array) -> pa.Array:
        n, digest, sketch = [], [], []
        for t in texts:
            s = shingles(t.as_py())
            n.append(len(s))
            digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            sketch.append(registers(s).tobytes() if len(s) else None)
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sketch, pa.binary())], ["n", "digest", "sketch"])

    made = docs.withColumn("_s", of("text"))
    return made.select(*docs.columns, F.col("_s.n").alias("n_shingles"), "_s.digest", "_s.sketch")


@F.arrow_udf(BinaryType())
def _set(texts: pa.Array) -> pa.Array:
    return pa.array([shingles(t.as_py()).tobytes() for t in texts], pa.binary())


@F.pandas_udf(BooleanType())
def _likely(a: pd.Series, b: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
    least = PERCENT / 100 - SLACK
    return pd.Series(
        [
            100 * min(m, n) >= PERCENT * max(m, n)
            and estimate(float((np.frombuffer(x, "<u2") == np.frombuffer(y, "<u2")).mean()), m, n) >= least
            for x, y, m, n in zip(a, b, n_a, n_b)
        ],
        dtype="bool",
    )


@F.pandas_udf(BooleanType())
def _confirmed(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b):
        p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = np.intersect1d(p, q, assume_unique=True).size
        out.append(100 * both >= PERCENT * (p.size + q.size - both))
    return pd.Series(out, dtype="bool")


@F.arrow_udf(ArrayType(LongType()))
def _bands(sketch: pa.Array) -> pa.Array:
    step = 2 * BAND_ROWS
    rows = []
    for v in sketch:
        raw = v.as_py()
        rows.append([xxhash.xxh3_64_intdigest(raw[i : i + step], i) - (1 << 63) for i in range(0, len(raw), step)])
    return pa.array(rows, pa.list_(pa.int64()))


def _common(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The HOT shingles that most sets hold and their counts, by shingle.  They only set the order of
    shingles, so counts may be low: a shingle counts where it occurs twice in a batch of rows."""

    def counted(batches):
        for b in batches:
            raw = b"".join(v.as_py() for v in b.column(0))
            found, n = np.unique(np.frombuffer(raw, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found[n > 1]), pa.array(n[n > 1].astype(np.int64))], ["shingle", "n"])

    counts = sets.select("set").mapInArrow(counted, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "shingle").limit(HOT).toArrow().sort_by("shingle")
    return tuple(top.column(c).to_numpy() for c in ("shingle", "n"))


def rarest(found: np.ndarray, hot: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first quarter of a set and one more, by count and shingle: two sets at the threshold share one."""
    n = len(found)
    at = np.minimum(np.searchsorted(hot, found), max(0, len(hot) - 1))
    known = np.where(hot[at] == found, counts[at], 0) if len(hot) else np.zeros(n, np.int64)
    order = np.lexsort((found, known))
    return found[order[: n - -(-PERCENT * n // 100) + 1]]


def _narrow(sets: DataFrame) -> DataFrame:
    """bucket, node, n, pos: one bucket per shingle among a set's rarest; n is the set's size, pos the shingle's place."""
    sent = sets.sparkSession.sparkContext.broadcast(_common(sets))  # HOT pairs of numbers at most

    @F.arrow_udf("array<bigint>")
    def prefix(packed: pa.Array) -> pa.Array:
        return pa.array([rarest(np.frombuffer(v.as_py(), np.int64), *sent.value) for v in packed], pa.list_(pa.int64()))

    n = F.expr("octet_length(set) div 8").alias("n")
    return sets.select("node", n, F.posexplode(prefix("set")).alias("pos", "bucket"))


def _unsent(buckets: DataFrame) -> DataFrame:
    """Buckets that are joined by sorting.  Spark reckons their size from before the explode, or from a file in
    which repeated values take no room, and would send them to all executors by way of the driver."""
    return buckets.hint("merge")


def _several(buckets: DataFrame) -> DataFrame:
    """The rows of buckets that hold more than one node."""
    several = buckets.groupBy("bucket").agg(F.count("*").alias("k")).filter("k > 1").select("bucket")
    return _unsent(buckets).join(several, "bucket")


#: Sets of n and n_v shingles that reach the threshold share ``least`` of them at least, so the first one that
#: they share, in the order of shingles, has as many from it on in either set.
_FITS = "pos + least <= n and pos_v + least <= n_v".replace("least", f"ceil({PERCENT} * (n + n_v) / {100 + PERCENT}D)")


def components(links: DataFrame, at: str) -> DataFrame:
    """node, root (the smallest node reachable) by neighbour minima and pointer jumps; every step is
    a table in the shared folder.  Aggregates combine map-side, so a hub costs no single task."""
    both = links.select(F.col("u").alias("node"), F.col("v").alias("other")).unionByName(
        links.select(F.col("v").alias("node"), F.col("u").alias("other"))
    )
    both = _kept(both, f"{at}/edges")
    roots = _kept(both.groupBy("node").agg(F.least("node", F.min("other")).alias("root")), f"{at}/roots0")
    step = 0
    while True:
        step += 1
        of_other = roots.select(F.col("node").alias("other"), F.col("root").alias("o_root"))
        low = both.join(of_other, "other").groupBy("node").agg(F.min("o_root").alias("low"))
        hung = roots.join(low, "node").select("node", F.col("root").alias("was"), F.least("root", "low").alias("root"))
        # A root also hangs under the least root that any of its members has seen, then one jump.
        over = hung.groupBy(F.col("was").alias("node")).agg(F.min("root").alias("over"))
        hung = hung.join(over, "node", "left").select("node", "was", F.least("root", F.coalesce("over", "root")).alias("root"))
        hung = _kept(hung, f"{at}/hung{step}")
        up = hung.select(F.col("node").alias("root"), F.col("root").alias("up"))
        jumped = hung.join(up, "root", "left").select("node", "was", F.coalesce("up", "root").alias("root"))
        jumped = _kept(jumped, f"{at}/roots{step}")
        roots = jumped.select("node", "root")
        if jumped.filter("was <> root").isEmpty():
            return roots


class _Classes:
    """Classes of nodes while links are found: tables in the shared folder, read again at each step."""

    def __init__(self, nodes: DataFrame, sets: DataFrame, at: str):
        self.nodes, self.sets, self.at, self.spark = nodes, sets, at, nodes.sparkSession
        self.roots = self.tried = self.opened = None
        self.step = 0

    def open(self, buckets: DataFrame) -> DataFrame:
        """bucket, node, n, pos, root of the buckets that hold more than one class."""
        if self.roots is None:
            here = buckets.withColumn("root", F.col("node"))
        else:
            here = buckets.join(self.roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        spread = here.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi")
        self.step += 1
        found = _kept(_unsent(here).join(spread.select("bucket"), "bucket"), f"{self.at}/open{self.step}")
        if self.opened:
            _removed(self.spark, self.opened)
        self.opened = f"{self.at}/open{self.step}"
        return found

    def compare(self, pairs: DataFrame) -> None:
        """Links the pairs u, v that reach the threshold, and joins their classes."""
        self.step += 1
        at = f"{self.at}/step{self.step}"
        pairs = pairs.distinct()
        if self.tried is not None:
            pairs = pairs.join(self.tried, ["u", "v"], "left_anti")
        pairs = _kept(pairs, f"{at}/pairs")
        self.tried = pairs if self.tried is None else self.tried.unionByName(pairs)
        of = lambda name, *columns: [F.col("node").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in columns)]
        sides = (self.nodes.select(*of(s, "n_shingles", "sketch")) for s in "uv")
        likely = pairs.join(next(sides), "u").filter("sketch_u is not null").join(next(sides), "v")
        likely = _kept(likely.filter(_likely("sketch_u", "sketch_v", "n_shingles_u", "n_shingles_v")).select("u", "v"), f"{at}/likely")
        sides = (self.sets.select(*of(s, "set")) for s in "uv")
        new = likely.join(next(sides), "u").join(next(sides), "v").filter(_confirmed("set_u", "set_v")).select("u", "v")
        new = _kept(new, f"{at}/links")
        if not new.isEmpty():
            if self.roots is not None:  # the classes so far, as stars, carry all earlier links
                new = new.unionByName(self.roots.filter("node <> root").select(F.col("root").alias("u"), F.col("node").alias("v")))
            self.roots = components(new, f"{at}/classes")
        _removed(self.spark, f"{at}/likely")

    def by_pivots(self, buckets: DataFrame, rounds: int) -> DataFrame:
        """Compares buckets with a pivot per round and gives back what is still open, without its pivots."""
        for turn in range(rounds):
            here = self.open(buckets)
            if here.isEmpty():
                return here
            # A set with few rare shingles is close to most: it goes first, in buckets of bands any.
            rank = F.struct((F.col("pos") / F.col("n")).alias("at"), F.xxhash64(F.lit(self.step), F.col("bucket") % PIVOT_ORDERS, "node").alias("h"), F.col("node").alias("p"), F.col("root").alias("p_root"), F.col("n").alias("n_v"), F.col("pos").alias("pos_v"))
            pivot = here.groupBy("bucket").agg(F.min(rank).alias("m")).select("bucket", "m.p", "m.p_root", "m.n_v", "m.pos_v")
            met = _unsent(here).join(pivot, "bucket")
            self.compare(met.filter(f"root <> p_root and {_FITS}").select(F.least("node", "p").alias("u"), F.greatest("node", "p").alias("v")))
            buckets = met.filter("node <> p").select(*buckets.columns)
        return self.open(buckets)

    def in_full(self, here: DataFrame) -> None:
        """Compares the pairs of unlike classes that meet early enough in a bucket.  Of buckets with the same
        members the first in the order of shingles will do."""
        member = F.xxhash64("node")
        same = here.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("k"), F.bit_xor(member).alias("x"), F.sum(F.shiftright(member, 8)).alias("s"), F.min("pos").alias("pos"))
        once = same.groupBy("lo", "hi", "k", "x", "s").agg(F.min_by("bucket", "pos").alias("bucket")).select("bucket")
        here = _unsent(here).join(once, "bucket")
        other = here.select("bucket", F.col("node").alias("v"), F.col("root").alias("v_root"), F.col("n").alias("n_v"), F.col("pos").alias("pos_v"))
        pairs = _unsent(here).join(other, "bucket").filter(f"node < v and root <> v_root and {_FITS}")
        self.compare(pairs.select(F.col("node").alias("u"), "v"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    at = _scratch(spark)
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    rows = _kept(sketches(docs).drop("text"), f"{at}/rows")
    # A document stands for all of its set: the smallest doc_id, and one of its texts.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    same = rows.filter("n_shingles > 0").groupBy("digest").agg(first, F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.count("*").alias("copies"))
    nodes = _kept(same.select(F.monotonically_increasing_id().alias("node"), "digest", "n_shingles", "sketch", "copies", "first.doc_id", "first.text_hash"), f"{at}/nodes")
    bands = nodes.select("node", F.col("n_shingles").alias("n"), F.posexplode(_bands("sketch")).alias("band", "key"))
    bands = bands.select("node", "n", F.lit(0).alias("pos"), F.xxhash64("band", "key").alias("bucket"))
    buckets = _kept(_several(bands), f"{at}/buckets")
    wanted = nodes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "text_hash")
    own = lambda ids: F.expr(f"doc_id <=> {ids}_id and text_hash <=> {ids}_hash")
    chosen = wanted.select("node", F.col("doc_id").alias("w_id"), F.col("text_hash").alias("w_hash"))
    sets = _kept(docs.join(chosen, own("w")).select("node", _set("text").alias("set")).dropDuplicates(["node"]), f"{at}/sets")
    # Copies: every digest must name one set.
    copied = rows.join(nodes.filter("copies > 1").select("digest"), "digest", "left_semi")
    copied = copied.select(F.col("doc_id").alias("c_id"), F.col("text_hash").alias("c_hash"), "digest").distinct()
    unlike = docs.join(copied, own("c")).select("digest", _set("text").alias("set")).groupBy("digest", "set").agg(F.lit(1).alias("one"))
    if not unlike.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        raise ValueError("two unlike sets share a digest of 128 bits")
    classes = _Classes(nodes, sets, at)
    left = classes.by_pivots(buckets, PIVOT_ROUNDS)
    if not left.isEmpty():
        unsure = sets.join(left.select("node").distinct(), "node", "left_semi")
        narrow = _kept(_several(_narrow(unsure)), f"{at}/narrow")
        left = classes.by_pivots(narrow, NARROW_ROUNDS)
        if not left.isEmpty():
            classes.in_full(left)
    named = nodes.select("node", "digest", "doc_id")
    named = named.withColumn("root", F.col("node")) if classes.roots is None else named.join(classes.roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    ids = _kept(named.join(least, "root").select("digest", "component_id"), f"{at}/ids")
    _removed(spark, *(f"{at}/{name}" for name in ("nodes", "buckets", "sets", "narrow", *(f"{kind}{k}" for k in range(1, classes.step + 1) for kind in ("open", "step")))))
    out = rows.select("doc_id", "n_shingles", "digest").join(ids, "digest", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
