"""Language identification by compression.

Each language has a zstandard raw-content dictionary: SAMPLE_ROWS of its texts, whole, the
longest first: of a dictionary the end is found best, and many texts say more than one long one.  A text takes the language whose dictionary compresses it smallest.  When the best two sizes
differ by less than MARGIN bytes the answer is marked ``rejected``; the best guess still stands in
``lang_pred``.

Edge cases: null texts and texts without letters are ``und`` with score 0; equal sizes go to the first
language by name; texts are compressed whole at any length; repeated rows repeat their result, and a
repeated doc_id is learned from once; with nothing to learn from, every row is ``und``; an empty table
gives an empty one; columns named lang_pred, score or rejected are replaced, others stay.
"""

from __future__ import annotations

import math

import pyarrow as pa
import regex
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.llm.sampling import added, bounded, fold, texts_of

#: How many texts are learned from, per language.
SAMPLE_ROWS = 400
LEVEL = 3
MARGIN = 4
_LETTER = regex.compile(r"\p{L}")


class Compressors:
    def __init__(self, raw: dict[str, bytes]):
        self.raw = {k: raw[k] for k in sorted(raw)}
        self.ready: dict | None = None

    def __getstate__(self):
        return {"raw": self.raw, "ready": None}

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.raw or not _LETTER.search(text):
            return "und", 0.0, True
        if self.ready is None:
            self.ready = {}
            for lang, content in self.raw.items():
                words = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
                words.precompute_compress(level=LEVEL)
                self.ready[lang] = zstd.ZstdCompressor(level=LEVEL, dict_data=words, write_content_size=False)
        data = text.lower().encode("utf-8", "surrogatepass")
        sizes = sorted((len(c.compress(data)), lang) for lang, c in self.ready.items())
        if len(sizes) == 1:
            return sizes[0][1], 1.0, False
        margin = sizes[1][0] - sizes[0][0]
        return sizes[0][1], 1 - 0.5 * math.exp(-margin / 8), margin < MARGIN


def train(docs: DataFrame) -> Compressors:
    """From text and lang of the rows given; SAMPLE_ROWS texts per language reach the driver."""
    known = docs.filter("lang is not null and text rlike '\\\\p{L}'")
    raw: dict[str, list[bytes]] = {}
    for r in texts_of(known, bounded(known, "lang", SAMPLE_ROWS), F.col("text")).select("lang", "text").collect():
        raw.setdefault(r["lang"], []).append(r["text"].lower().encode("utf-8", "surrogatepass"))
    return Compressors({lang: b"\n".join(sorted(texts, key=lambda t: (-len(t), t))) for lang, texts in raw.items()})


def classify(docs: DataFrame, trained: Compressors, text: str = "text") -> DataFrame:
    """Adds lang_pred, score, rejected."""
    sent = docs.sparkSession.sparkContext.broadcast(trained)  # SAMPLE_ROWS texts per language

    @F.arrow_udf("struct<lang_pred:string,score:double,rejected:boolean>")
    def of(texts: pa.Array) -> pa.Array:
        rows = [sent.value.classify(t.as_py()) for t in texts]
        kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
        return pa.array([dict(zip(("lang_pred", "score", "rejected"), r)) for r in rows], kind)

    return added(docs, of(F.col(text)), ["lang_pred", "score", "rejected"])


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    trained = train(docs.filter(fold("doc_id", 4) != 2))
    out = classify(docs.select("doc_id", "text"), trained)
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
