"""A training corpus from documents: quality, exact copies, near copies, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again
as the next one's docs.  All but the last return the columns of documents.  Nulls, ties, empty tables
and extra columns are handled as the operators' docstrings state.

Rows are carried through each stage or have a key of their own, so a null or repeated doc_id is a row
like any other: quality, mixed and encoded return one row per row they keep, exact_dedup one per text
and near_dedup one per class.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelframe.llm import bpe, exact, lines_crf, mixing, sketch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field does not reject."""
    rows = docs.select("text", F.struct("*").alias("row"))
    scored = lines_crf.score(rows, lines_crf.trained_on(spark, sf_dir))
    return scored.filter(F.col("score") >= lines_crf.PREDICT_AT).select("row.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per text: that of the smallest doc_id."""
    return exact.keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per class of near copies: that of the smallest doc_id, null ids last, then the one read
    first.  Texts without words are linked with nothing and all stay."""
    keyed = docs.select(F.monotonically_increasing_id().alias("key"), F.struct("*").alias("row"))
    keyed = sketch._kept(keyed, f"{sketch._scratch(spark)}/keyed")
    near = sketch.near_duplicates(keyed.select(F.col("key").alias("doc_id"), "row.text"))
    near = near.select(F.col("doc_id").alias("key"), "component_id")
    first = F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("key").alias("key")))
    kept = keyed.select("key", F.col("row.doc_id").alias("id")).join(near, "key").groupBy("component_id").agg(first.alias("m"))
    return keyed.join(kept.select("m.key"), "key", "left_semi").select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, in the order of their slots: files and rows follow the schedule."""
    rows = docs.select("doc_id", "source", F.struct("*").alias("row"))
    return mixing.mix(rows).orderBy("slot", "doc_id").select("row.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of token ids and decoded bytes, and the position (from 0) of the row in the Parquet files
    read: by file number, file name and row, which is the order that ``mixed`` wrote."""
    file = (F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long"), F.col("_metadata.file_name"))
    rows = docs.select("doc_id", "text", F.struct(file[0].alias("n"), file[1].alias("name")).alias("_file"), F.col("_metadata.row_index").alias("_row"))
    # One small row per file is put in order.
    files = docs.select(F.struct(file[0].alias("n"), file[1].alias("name")).alias("_at")).groupBy("_at").agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = F.broadcast(files.select("_at", before.alias("_before")))
    placed = rows.join(files, F.col("_file").eqNullSafe(F.col("_at"))).withColumn("position", F.col("_before") + F.col("_row"))
    return bpe.roundtrip(placed.select("doc_id", "text", "position"), "position")


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixed", mixed),
    ("encoded", encoded),
]

#: The trained and the sketched stages have no SQL form; tests/llm holds the stages against brute force
#: on a few rows each and the whole run on the smallest tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:  # only tests on a local master may go without a folder that all executors share
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="spark-")
    at = f"{shared}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return docs
