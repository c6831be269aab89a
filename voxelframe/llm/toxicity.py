"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words is trained in numpy from confirmed toxic rows
plus unlabelled text.  The risk is the class-prior-corrected estimator: prior * loss of positives as
positive + max(0, loss of unlabelled as negative - prior * loss of positives as negative); when the
second part falls below zero its gradient is turned, as the non-negative method does.  The bias is then
set so that the mean score of the unlabelled sample is the prior.

Training reads a bounded sample (POSITIVES and UNLABELLED rows); scoring reads every whole text.

Edge cases: null and empty texts have no features and get the bias's score; repeated rows repeat their
score, and a repeated doc_id is learned from once; with no positive rows at all every score is that of
logit -50, with nothing unlabelled 0.5; texts are read whole at any length; empty tables give empty
tables; a column named score is replaced, others stay.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.llm.sampling import bounded, fold, texts_of

POSITIVES, UNLABELLED = 3000, 9000
HASH_BITS = 22
#: Hashes with the highest chi-square between the two samples.
FEATURES = 1024
PREDICT_AT = 0.7
_WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> set[int]:
    """Hashes of the distinct words of a text, case-folded."""
    words = set(_WORD.findall((text or "").casefold()))
    mask = (1 << HASH_BITS) - 1
    return {xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) & mask for w in words}


def risk(w: np.ndarray, b: float, x_p: np.ndarray, x_u: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The corrected risk of positive and unlabelled rows, not below that of the positive ones, and the way to
    go for weights and bias: its gradient, or away from a negative part that has fallen below zero."""
    w4 = w.astype(x_p.dtype)  # a wider vector would copy the matrices
    s_p, s_u = _sigmoid(x_p @ w4 + b), _sigmoid(x_u @ w4 + b)
    # Sigmoid loss as the method has it: l(z) = 1 - sigmoid(z) as positive, sigmoid(z) as negative.
    d_p, d_u = (s_p * (1 - s_p) / len(x_p)).astype(x_p.dtype), (s_u * (1 - s_u) / len(x_u)).astype(x_u.dtype)
    as_positive = np.append(-(x_p.T @ d_p), -d_p.sum())
    negative = np.append(x_u.T @ d_u, d_u.sum()) - prior * np.append(x_p.T @ d_p, d_p.sum())
    part = float(s_u.mean() - prior * s_p.mean())
    return float(prior * (1 - s_p).mean()) + max(0.0, part), prior * as_positive + negative if part >= 0 else -negative


class PULearner:
    def __init__(self, index: dict[int, int], weights: np.ndarray, bias: float):
        self.index, self.weights, self.bias = index, weights, bias

    @classmethod
    def fit(cls, positive: list[set], unlabelled: list[set], prior: float, steps: int = 600, rate: float = 0.05) -> "PULearner":
        if not positive:
            return cls({}, np.zeros(0), -50.0)
        if not unlabelled:
            return cls({}, np.zeros(0), 0.0)
        counts_p, counts_u = {}, {}
        for rows, counts in ((positive, counts_p), (unlabelled, counts_u)):
            for r in rows:
                for h in r:
                    counts[h] = counts.get(h, 0) + 1
        n_p, n_u = len(positive), len(unlabelled)
        score = {}
        for h, c in counts_p.items():
            if c >= max(2, 0.004 * n_p):
                p, u = c / n_p, counts_u.get(h, 0) / n_u
                mean = (c + counts_u.get(h, 0)) / (n_p + n_u)
                score[h] = (p - u) ** 2 / (mean * (1 - mean) + 1e-9)
        chosen = sorted(score, key=lambda h: (-score[h], h))[:FEATURES]
        index = {h: i for i, h in enumerate(chosen)}

        def dense(rows):
            x = np.zeros((len(rows), len(index)), np.float32)
            for i, r in enumerate(rows):
                for h in r:
                    j = index.get(h)
                    if j is not None:
                        x[i, j] = 1.0
            return x

        x_p, x_u = dense(positive), dense(unlabelled)
        w, b = np.zeros(len(index)), float(np.log(prior / (1 - prior)))
        m, v = np.zeros(len(index) + 1), np.zeros(len(index) + 1)
        for step in range(1, steps + 1):
            grad = risk(w, b, x_p, x_u, prior)[1] + 1e-5 * np.append(w, 0)
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad**2
            move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w, b = w - move[:-1], b - move[-1]
        return cls(index, w, float(b) + _shift((x_u @ w.astype(np.float32)).astype(float) + b, prior))

    def score(self, found: set[int]) -> float:
        index = self.index
        z = self.bias + sum(self.weights[index[h]] for h in found if h in index)
        return float(_sigmoid(np.float64(z)))


def _shift(z: np.ndarray, prior: float) -> float:
    """What to add to logits of unlabelled rows so that their mean probability is the class prior."""
    low, high = -20.0, 20.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if _sigmoid(z + middle).mean() < prior else (low, middle)
    return (low + high) / 2


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def train(docs: DataFrame, labels: DataFrame) -> PULearner:
    """``docs`` and ``labels`` are what may be learned from.  The class prior is the labels' toxic rate."""
    rates = labels.agg(F.avg(F.col("toxic").cast("double")).alias("p")).first()
    prior = min(0.95, max(0.005, rates["p"] or 0.0))
    marked = labels.filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = bounded(marked.filter("toxic = 1"), "toxic", POSITIVES)
    at = bounded(docs.select("doc_id").withColumn("any", F.lit(1)), "any", UNLABELLED)

    @F.arrow_udf("array<int>")
    def hashed(texts: pa.Array) -> pa.Array:
        return pa.array([sorted(features(t.as_py())) for t in texts], pa.list_(pa.int32()))

    def rows(ids):
        return [set(r[0]) for r in texts_of(docs, ids, F.col("text")).orderBy("doc_id").select(hashed("text")).collect()]

    return PULearner.fit(rows(chosen), rows(at), prior)


def score(docs: DataFrame, learner: PULearner, text: str = "text") -> DataFrame:
    """Adds ``score``."""
    sent = docs.sparkSession.sparkContext.broadcast(learner)  # at most FEATURES weights

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array([sent.value.score(features(t.as_py())) for t in texts], pa.float64())

    return docs.withColumn("score", scored(F.col(text)))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    learner = train(docs.filter(fold("doc_id", 3) != 1), labels.filter(fold("doc_id", 3) != 1))
    return score(docs, learner).select(
        "doc_id",
        (fold("doc_id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"),
    )
