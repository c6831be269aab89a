"""Quality rules: base counts of a text, then a calibrated logistic regression over hashed n-grams.

Features are hashed words and pairs of words, and trigrams of characters (code points, case kept), as
log counts of unit length.  The regression is trained on labelled quality rows, calibrated on rows held
back from it, and applied in Arrow batches, a matrix of ROWS texts at a time, against the fixed
threshold KEEP_AT.

Training reads a bounded sample (SAMPLE_ROWS per label); scoring reads every whole text.

Edge cases: null and empty texts have no words and fail the base; texts of any length are read whole;
repeated rows repeat their result, and a repeated doc_id is learned from once; with no labels the
verdict is to keep; empty tables give empty tables; columns that have the names of the results are
replaced, others stay.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.llm.lines_crf import platt
from voxelframe.llm.sampling import added, bounded, texts_of

SAMPLE_ROWS = 1500
DIMS = 4096
KEEP_AT = 0.5
#: Texts scored by one product.
ROWS = 256
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = _WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif _WORD.search(line):
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    counts: dict = {}
    for w in windows:
        counts[w] = counts.get(w, 0) + 1
    repeat = 0
    if len(counts) < len(windows):
        upto = 0  # words before it are counted already
        for i, w in enumerate(windows):
            if counts[w] > 1:
                repeat += i + 3 - max(i, upto)
                upto = i + 3
    return len(words), sum(map(len, words)), len(_SYMBOL.findall(text)), dup, repeat


def _hashed(codes: np.ndarray) -> np.ndarray:
    """Counts by the top bits of a multiplicative hash, over half of DIMS."""
    half = DIMS // 2
    return np.bincount((codes * _MIX) >> np.uint64(64 - (half.bit_length() - 1)), minlength=half)


def vectors(texts: list) -> np.ndarray:
    """Hashed log counts of words and word pairs (first half) and character trigrams (second half)."""
    half = DIMS // 2
    out = np.zeros((len(texts), DIMS), np.float32)
    memo: dict[str, int] = {}
    for row, text in zip(out, texts):
        text = text or ""
        words = _WORD.findall(text)
        for w in set(words).difference(memo):
            memo[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        row[:half] = _hashed(h) + _hashed(h[:-1] * np.uint64(3) + h[1:])
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        row[half:] = _hashed(c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:])
    np.log1p(out, out=out)
    for part in (out[:, :half], out[:, half:]):
        part /= np.maximum(1e-9, np.sqrt((part * part).sum(axis=1, keepdims=True)))
    return out


class Regression:
    def __init__(self, weights=None, bias=0.0, slope=1.0, offset=0.0):
        self.weights, self.bias, self.slope, self.offset = weights, bias, slope, offset

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, steps: int = 250, rate: float = 0.05) -> "Regression":
        if not len(y):
            return cls()
        fit, check = np.arange(len(y)) % 5 != 0, np.arange(len(y)) % 5 == 0
        xf, yf = x[fit], y[fit]
        w, b = np.zeros(x.shape[1], np.float32), 0.0
        m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
        for step in range(1, steps + 1):
            p = 1 / (1 + np.exp(-np.clip(xf @ w + np.float32(b), -50, 50)))
            d = ((p - yf) / max(1, len(yf))).astype(np.float32)
            grad = np.append(xf.T @ d + 1e-5 * w, d.sum())
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w, b = (w - move[:-1]).astype(np.float32), b - move[-1]
        slope, offset = platt(x[check] @ w + b, y[check])
        return cls(w, float(b), slope, offset)

    def probabilities(self, texts: list) -> np.ndarray:
        if self.weights is None:
            return np.ones(len(texts))
        z = [vectors(texts[k : k + ROWS]) @ self.weights + self.bias for k in range(0, len(texts), ROWS)]
        z = np.concatenate(z).astype(float) if z else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -50, 50)))


def train(docs: DataFrame, labels: DataFrame) -> Regression:
    """``docs`` and ``labels`` are what may be learned from; vectors of a bounded sample reach the driver."""
    marked = labels.filter("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))

    @F.arrow_udf("binary")
    def packed(texts: pa.Array) -> pa.Array:
        texts = texts.to_pylist()
        return pa.array([v.tobytes() for k in range(0, len(texts), ROWS) for v in vectors(texts[k : k + ROWS]).astype("<f2")], pa.binary())

    chosen = texts_of(docs, bounded(marked, "quality", SAMPLE_ROWS), F.col("text"))
    rows = chosen.select("doc_id", "quality", packed("text").alias("x")).collect()
    rows.sort(key=lambda r: (xxhash.xxh3_64_intdigest(str(r["doc_id"])), r["doc_id"]))
    x = np.array([np.frombuffer(r["x"], "<f2") for r in rows], np.float32).reshape(len(rows), DIMS)
    return Regression.fit(x, np.array([r["quality"] for r in rows], float))


def apply_rules(docs: DataFrame, model: Regression, text: str = "text") -> DataFrame:
    """Adds the counts, probability, base_failed and kept."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # DIMS weights
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    @F.arrow_udf("struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,probability:double>")
    def of(texts: pa.Array) -> pa.Array:
        texts = texts.to_pylist()
        counts = np.array([base_counts(t) for t in texts], np.int64).reshape(len(texts), len(names))
        return pa.StructArray.from_arrays([*(pa.array(c) for c in counts.T.copy()), pa.array(sent.value.probabilities(texts))], [*names, "probability"])

    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = added(docs, of(F.col(text)), [*names, "probability"]).drop("base_failed", "kept").withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= KEEP_AT))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return apply_rules(docs, train(docs, labels)).drop("text")
