"""Benchmark decontamination by a prefix-filtered set join, with DataFrame functions only.

A benchmark item is cut into windows of WINDOW consecutive words; an item of fewer words is one window.
The tokens of the join are shingles of up to SHINGLE words.  A document holds a window only if it holds
every shingle of it, so one shingle of each window is a sufficient prefix, and the rarest one in the corpus
is the cheapest.  One pass counts the shingles of the benchmark in the corpus, which orders them; a second
pass meets the documents' shingles with these prefixes.  The shingle's place in its window gives the place
of the window in the document, which has to lie within it (position and length), and the words there have
to be the window's, one by one.

Either pass leaves the texts where they are: what is sent round is the benchmark's side, while it has
SENT rows at most (checked), and else both sides are shuffled by the shingle, each document's with the few
words around it.  No hot passage meets itself: windows are distinct by their words, the items of a window
are looked up once for each distinct set of windows that documents have.

Edge cases: a null or empty text, or one without words, has no words and no hits, on either side; a null or
repeated doc_id gives a row like any other; rows of one item_id are one item, and what only rows with a null
item_id hold counts as hit but not as an item; windows that occur in several items count for each; texts of
any length are taken whole; empty tables give empty tables, an empty benchmark no hits; extra columns are
left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.llm import shared

WINDOW, SHINGLE = 10, 3
#: Rows of the benchmark's side that may be sent to every executor (of about 250 bytes each).
SENT = 250_000
#: Salts of a set of windows, at most 64: the most rows that one set sends to its last grouping.
SALTS = 64

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BETWEEN)
    return F.array_remove(parts, "")  # before the first word and after the last


def windows(items: DataFrame, item_id: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """item_id, window (its digest), words: one row per window of an item, repeated where the item repeats it."""
    w = items.select(F.col(item_id).alias("item_id"), words(F.col(text)).alias("w")).filter("size(w) > 0")
    at = w.withColumn("at", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - size + 1))))
    cut = at.select("item_id", F.slice("w", F.col("at"), F.lit(size)).alias("words"))
    return cut.select("item_id", F.unhex(F.sha2(F.array_join("words", " "), 256)).alias("window"), "words")


def _key(words: str, at: Column, n: Column | int) -> Column:
    """Hash of the shingle of n words from place ``at`` (from 0) on; hashes are only met, words decide."""
    n = n if isinstance(n, Column) else F.lit(n)
    word = [F.when(n > k, F.get(words, at + k)) for k in range(SHINGLE)]
    return F.xxhash64(n, *word)


def _shingles(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """Every place of every document with its shingles' keys, and a place after the last without any."""
    at = docs.select("*", F.posexplode_outer(F.concat("words", F.array(F.lit(None).cast("string")))).alias("at", "word"))
    keys = [F.when(F.col("at") + n <= F.col("n_words"), _key("words", F.col("at"), n)) for n in sizes]
    one = keys[0] if len(keys) == 1 else F.explode(F.array(*keys))
    return at.withColumn("key", one).drop("word")


def _side(df: DataFrame, rows: int) -> DataFrame:
    """The benchmark's side of a join: sent round where its size, which is known here, allows it."""
    return F.broadcast(df) if rows <= SENT else df


def find(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit and spans, the sorted places [start, stop) of the words of each
    window that it holds, with the window's digest."""
    spark = docs.sparkSession
    at = shared.folder(spark, "leaks")
    shared.written(windows(items, size=size), f"{at}/windows")
    held = spark.read.parquet(f"{at}/windows")
    w = shared.written(held.groupBy("window").agg(F.first("words").alias("words")), f"{at}/distinct")
    n_windows = w.count()
    n = F.least(F.lit(SHINGLE), F.size("words"))
    sizes = sorted(r.n for r in w.select(n.alias("n")).distinct().collect())  # SHINGLE values at most
    read = docs.select(F.col(doc_id).alias("doc_id"), words(F.col(text)).alias("words")).withColumn("n_words", F.size("words"))
    place = F.explode(F.sequence(F.lit(0), F.size("words") - n)).alias("place")
    tokens = w.select("window", "words", n.alias("n"), place).withColumn("key", _key("words", F.col("place"), F.col("n")))
    known = shared.written(tokens.select("key").distinct(), f"{at}/keys")
    if not sizes:
        none = F.array().cast("array<struct<start:int,stop:int,window:binary>>")
        return read.select("doc_id", F.col("n_words").cast("long"), F.lit(0).cast("long").alias("n_hit"), none.alias("spans"))
    seen = _shingles(read, sizes).filter("key is not null").select("key").join(_side(known, known.count()), "key").groupBy("key").agg(F.count("*").alias("seen"))
    rarest = F.min(F.struct("seen", "place", "key")).alias("r")  # what no document has comes first and meets nothing
    prefix = tokens.join(seen, "key", "left").fillna(0, ["seen"]).groupBy("window").agg(rarest, F.first("words").alias("words"))
    prefix = prefix.filter("r.seen > 0").select(F.col("r.key").alias("key"), F.col("r.place").alias("place"), "window", F.col("words").alias("theirs"))
    prefix = shared.written(prefix, f"{at}/prefix")
    base = F.col("at") == F.col("n_words")
    around = F.slice("words", F.greatest(F.lit(1), F.col("at") - size + 2), F.lit(2 * size)).alias("around")
    rows = _shingles(read.withColumn("row", F.monotonically_increasing_id()), sizes)
    rows = rows.select("row", "doc_id", "n_words", "at", "key", around)
    met = rows.join(_side(prefix, n_windows), "key", "left")
    start = F.col("at") - F.col("place")
    within = (start >= 0) & (start + F.size("theirs") <= F.col("n_words"))
    from_ = start - F.greatest(F.lit(0), F.col("at") - size + 1) + 1
    equal = F.slice("around", F.when(within, from_).otherwise(1), F.size("theirs")) == F.col("theirs")
    span = F.when(~base, F.struct(start.alias("start"), (start + F.size("theirs")).alias("stop"), "window"))
    met = met.filter(base | (within & equal)).select("row", "doc_id", F.col("n_words").cast("long").alias("n_words"), span.alias("span"))
    # A group is one document: as many spans as it has places, times the sizes of windows, at most.
    doc = met.groupBy("row", "doc_id", "n_words").agg(F.array_sort(F.collect_list("span")).alias("spans"))
    sums = F.aggregate(
        "spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("stop")),
        lambda a, s: F.struct((a.n + F.greatest(F.lit(0), s.stop - F.greatest(s.start, a.stop))).alias("n"), F.greatest(a.stop, s.stop).alias("stop")),
        lambda a: a.n.cast("long"),
    )
    found = doc.select("doc_id", "n_words", sums.alias("n_hit"), "spans")
    return shared.written(found, f"{at}/found")


def items_of(found: DataFrame, held: DataFrame) -> DataFrame:
    """``found`` with item_ids: the sorted ids, as strings, of the items whose windows each document holds.
    Documents with the same windows are looked up once; they meet in salted groups first."""
    at = shared.folder(found.sparkSession, "leaks")
    hit = found.filter("n_hit > 0").withColumn("_w", F.array_sort(F.array_distinct("spans.window")))
    hit = hit.withColumn("_set", F.sha2(F.array_join(F.transform("_w", F.hex), ","), 256))
    hit = shared.written(hit.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "n_words", F.col("spans.start")), F.lit(SALTS))), f"{at}/hit")
    salts = F.bit_or(F.expr("shiftleft(1L, cast(_salt as int))")).alias("_salts")
    sets = hit.groupBy("_set", "_salt").agg(F.first("_w").alias("_w")).groupBy("_set").agg(F.first("_w").alias("_w"), salts)
    one = held.filter("item_id is not null").select("item_id", "window").distinct()
    ids = sets.select("_set", F.explode("_w").alias("window")).join(one, "window").select("_set", F.col("item_id").cast("string").alias("i")).distinct()
    ids = ids.groupBy("_set").agg(F.array_sort(F.collect_list("i")).alias("item_ids"))
    present = F.expr(f"filter(sequence(0L, {SALTS - 1}L), s -> (shiftright(_salts, cast(s as int)) & 1L) = 1L)")
    ids = sets.select("_set", F.explode(present).alias("_salt")).join(ids, "_set")
    names = F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids")
    with_ids = hit.join(ids, ["_set", "_salt"], "left").select("doc_id", "n_words", "n_hit", "spans", names)
    return with_ids.unionByName(found.filter("n_hit = 0").select("*", F.array().cast("array<string>").alias("item_ids")))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = items_of(find(docs, items), windows(items))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^{_BETWEEN[1:]}')"
OP13_SQL = f"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[k : k + {WINDOW - 1}] AS x FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - {WINDOW - 2}))) AS k FROM i WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
n AS (SELECT DISTINCT len(x) AS n FROM win),
place AS (SELECT r, n, k, w[k : k + n - 1] AS x FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, n WHERE len(w) >= n)),
met AS (SELECT r, k, n, item_id FROM place JOIN win USING (x)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT r, k, n FROM met)) GROUP BY r),
it AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM met GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""
