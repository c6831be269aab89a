"""Exact dedup by skew-safe combining, with DataFrame functions only.

Texts are equal when identical after every run of white space (``[\\x20\\x09-\\x0D]+``) becomes one
space.  Copies meet first inside their task (the partial aggregate), then in salted groups, then the
winners of the salts meet once.  Each of these groups on the digest *and* the whole text, so no stage
trusts a digest alone.  The winner then goes back to every salt that its copies have, and rows join the
winner of their digests (320 bits) and salt.  By then the digests are proven to name one text each; two texts
that shared them would stop the job rather than merge.

Edge cases: a null text counts as empty, so null and empty texts form one group; ties go to the
smallest doc_id; a repeated doc_id counts once per row; a row with a null doc_id has a null ``kept`` in
``groups``, while ``keep_one`` always keeps one row per text; an empty table gives an empty one; extra
columns are ignored by ``groups`` and kept by ``keep_one``, which combines whole rows the same way and
so needs no way back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Salts of a digest, at most 64: the most rows that one text sends to the last stage.
SALTS = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


#: What makes two rows copies: the digests spare long comparisons, the text itself decides.
TEXT = ("text_sha256", "_h2", "_norm")


def _keyed(docs: DataFrame, doc_id: str, text: str, *more: Column) -> DataFrame:
    """doc_id, the text and its digests, the salt, and further columns."""
    return docs.select(F.col(doc_id).alias("doc_id"), normalised(F.col(text)).alias("_norm"), *more).withColumns({
        "text_sha256": F.sha2("_norm", 256), "_h2": F.xxhash64("_norm"), "_salt": F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(SALTS)),
    })


def salted(keyed: DataFrame, *of: Column) -> DataFrame:
    """Aggregates ``of`` per text and salt: copies meet inside their task, then in the salt's group.  The rows
    are dealt by the digest, so that a grouping by text which follows stays in place."""
    return keyed.groupBy(*TEXT, "_salt").agg(*of).repartition("text_sha256")


def winners(keyed: DataFrame) -> DataFrame:
    """One row per text and salt that its copies have: text_sha256, _h2, _salt, keep_id, group_size."""
    # Dealt once, by the digest; both groupings below and the next join's side stay in place.
    salts = F.bit_or(F.expr("shiftleft(1L, cast(_salt as int))")).alias("_salts")
    whole = salted(keyed, F.min("doc_id").alias("_first"), F.count("*").alias("_n")).groupBy(*TEXT).agg(
        F.min("_first").alias("keep_id"), F.sum("_n").alias("group_size"), salts
    )
    one = whole.groupBy("text_sha256", "_h2").agg(
        F.count("*").alias("_texts"), *(F.first(c).alias(c) for c in ("keep_id", "group_size", "_salts"))
    )
    clash = F.when(F.col("_texts") > 1, F.raise_error(F.lit("two different texts share their digests")).cast("long"))
    present = F.expr(f"filter(sequence(0L, {SALTS - 1}L), s -> (shiftright(_salts, cast(s as int)) & 1L) = 1L)")
    return one.select("text_sha256", "_h2", F.explode(present).alias("_salt"), F.coalesce(clash, F.col("keep_id")).alias("keep_id"), "group_size")


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256.  The way back joins slim rows with the
    winner of their digest and salt, so a hot text is dealt to as many tasks as it has salts."""
    keyed = _keyed(docs, doc_id, text)
    key = ["text_sha256", "_h2", "_salt"]
    found = keyed.select("doc_id", *key).join(winners(keyed), key)
    return found.select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256"
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One whole row per text: that of the smallest doc_id, null ids last.  Ties go to the smallest row,
    column by column (to any of them if a column holds maps).  Rows take the same salted way as the ids of
    ``winners``: each task keeps its first row of a text and salt, so a hot text sends one a task and salt."""
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_row")).alias("_at")
    rows = docs.select(F.col("doc_id"), F.col("text"), F.struct("*").alias("_row"))
    if "map<" in docs.schema.simpleString():
        least = F.min_by("_at", F.struct("_at.none", "_at.id")).alias("_at")
    else:
        least = F.min("_at").alias("_at")
    found = salted(_keyed(rows, "doc_id", "text", first), least).withColumn("_norm", normalised(F.col("_at._row.text")))  # so it isn't dealt again
    return found.groupBy(*TEXT).agg(least).select("_at._row.*")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


_NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"
OP5_SQL = f"""
WITH d AS (SELECT doc_id, {_NORM} AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""
