"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad; its potentials use features of the line and of its two neighbours, and
adjacent lines share a transition.  Labels are of documents, so the lines' labels are latent: training
alternates between the field's own marginals and the gradient of the log-likelihood of the labels they
give, under the constraint that a good document is good for GOOD_SHARE of its length at least and a bad
one bad for BAD_SHARE of it.  A document's quality is the mean of the forward-backward marginals of its
lines, weighted by length, then mapped to a probability.

Training reads a bounded sample: SAMPLE_ROWS documents per label, whole, as chains of CHAIN lines.  Scoring
runs over all lines of every whole text.

Edge cases: null, empty and white-space texts have no lines and get the share of good labels in the
sample; repeated rows repeat their score, and a repeated doc_id is learned from once; with no labels
every score is 0.5; empty tables give empty tables; a column named score is replaced, others stay.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.llm.sampling import bounded, fold, texts_of

SAMPLE_ROWS = 1000
CHAIN = 32
GOOD_SHARE, BAD_SHARE = 0.8, 0.3
PREDICT_AT = 0.3
_N = 12
#: Kinds of characters that are counted: symbols, capitals, digits, brackets and marks of code, an
#: unusual mark after a letter, a mark repeated.
_COUNTED = [re.compile(p) for p in (r"[^\w\s.,;:'\"()-]", r"[A-ZÀ-Þ]", r"\d", r"[|<>{}\[\]=_\\]", r"\w[^\w\s.,;:'\")\]?!-]", r"([^\w\s.])\1")]
_LINES = re.compile(r"[\n\r\x0b\x0c]+")


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines, features) and line lengths; lines without a word are left out."""
    lines = [x for x in _LINES.split(text or "") if x.strip()]
    rows, seen = np.zeros((len(lines), _N)), set()
    for i, line in enumerate(lines):
        n, words = len(line), line.split()
        k = len(words)
        symbols, capitals, digits, code, after, twice = (len(p.findall(line)) for p in _COUNTED)
        rows[i] = (
            min(1.0, 8 * symbols / n), min(1.0, 3 * capitals / n), min(1.0, 4 * digits / n), min(1.0, 8 * code / n),
            min(1.0, 2 * after / k), min(1.0, 2 * twice / k), min(2.0, n / k / 8), float(line in seen),
            len(set(words)) / k, min(1.5, np.log1p(k) / 5), float(line.rstrip()[-1] in ".!?:\"'"), float(max(map(len, words)) > 30),
        )
        seen.add(line)
    return rows, np.array([len(x) for x in lines], float)


def with_neighbours(rows: np.ndarray) -> np.ndarray:
    n = len(rows)
    before, after = np.zeros_like(rows), np.zeros_like(rows)
    before[1:], after[:-1] = rows[:-1], rows[1:]
    edge = np.zeros((n, 3))
    edge[:, 0] = 1
    if n:
        edge[0, 1], edge[-1, 2] = 1, 1
    return np.hstack([rows, before, after, edge])


def chains(text: str | None) -> list[np.ndarray]:
    """All lines as chains of CHAIN lines at most: features of lines and neighbours, then length."""
    rows, lengths = line_features(text)
    table = np.hstack([with_neighbours(rows), lengths[:, None]]).astype(np.float32)
    return [table[at : at + CHAIN] for at in range(0, len(rows), CHAIN)]


class LineField:
    """Two labels (0 bad, 1 good): emission score of good over bad, and a 2 x 2 transition."""

    def __init__(self, weights, transition, slope=1.0, offset=0.0, empty=0.5):
        self.weights, self.transition, self.slope, self.offset, self.empty = weights, transition, slope, offset, empty

    def marginals(self, rows: np.ndarray) -> np.ndarray:
        """P(good) of every line of a table with neighbours, by forward-backward in scaled form."""
        e = np.exp(np.clip(rows @ self.weights, -30, 30)).tolist()
        (t00, t01), (t10, t11) = np.exp(self.transition).tolist()
        n = len(e)
        ahead = [0.0] * n
        p = e[0] / (1 + e[0])
        ahead[0] = p
        for i in range(1, n):
            good = ((1 - p) * t01 + p * t11) * e[i]
            p = good / (good + (1 - p) * t00 + p * t10)
            ahead[i] = p
        out = [0.0] * n
        q = 0.5
        for i in range(n - 1, -1, -1):
            good = ahead[i] * q
            out[i] = good / (good + (1 - ahead[i]) * (1 - q)) if good else 0.0
            # Back message to line i-1: over this line's labels.
            bad = t00 * (1 - q) + t01 * q * e[i]
            good = t10 * (1 - q) + t11 * q * e[i]
            q = good / (good + bad)
        return np.array(out)

    def raw(self, text: str | None) -> float | None:
        rows, lengths = line_features(text)
        return float(self.marginals(with_neighbours(rows)) @ lengths / lengths.sum()) if len(rows) else None

    def score(self, text: str | None) -> float:
        r = self.raw(text)
        if r is None:
            return self.empty
        return 1 / (1 + np.exp(-np.clip(self.slope * _logit(r) + self.offset, -50, 50)))

    @classmethod
    def fit(cls, documents: list[list[np.ndarray]], labels: list[int], steps: int = 200, rate: float = 0.1) -> "LineField":
        """From the chains of each document and its label."""
        d = 3 * _N + 3
        if not labels:
            return cls(np.zeros(d), np.zeros((2, 2)))
        field = cls(np.zeros(d), np.zeros((2, 2)), empty=float(np.mean(labels)))
        parts = [(c, y) for cs, y in zip(documents, labels) for c in cs]
        if not parts:
            return field
        x = np.zeros((len(parts), CHAIN, d), np.float32)
        size = np.zeros((len(parts), CHAIN))
        for k, (c, _) in enumerate(parts):
            x[k, : len(c)], size[k, : len(c)] = c[:, :d], c[:, d]
        label = np.array([y for _, y in parts])
        live = size > 0
        links = live[:, 1:]
        share = label.mean()
        cost = np.where(label == 1, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3)) / live.sum(1)
        y = np.repeat(label[:, None], CHAIN, 1).astype(float)  # the lines' labels, first those of documents
        theta = np.zeros(d + 4)
        # At first each line speaks for itself: else no line could differ from its document's label.
        alone, own = steps // 4, np.r_[np.ones(_N), np.zeros(2 * _N), 1, 0, 0, np.zeros(4)]
        m, v = np.zeros(d + 4), np.zeros(d + 4)
        for step in range(1, steps + 1):
            e = np.clip(x @ theta[:d].astype(np.float32), -30, 30)
            e = np.where(live, e, 0.0)
            t = theta[d:].reshape(2, 2)
            emit = np.stack([np.zeros_like(e), e], -1)
            a = np.empty_like(emit, dtype=float)
            b = np.zeros_like(a)
            a[:, 0] = emit[:, 0]
            for i in range(1, CHAIN):
                new = np.logaddexp(a[:, i - 1, :1] + t[0], a[:, i - 1, 1:] + t[1]) + emit[:, i]
                a[:, i] = np.where(live[:, i, None], new, a[:, i - 1])
            for i in range(CHAIN - 2, -1, -1):
                nxt = emit[:, i + 1] + b[:, i + 1]
                new = np.logaddexp(t[:, 0] + nxt[:, :1], t[:, 1] + nxt[:, 1:])
                b[:, i] = np.where(live[:, i + 1, None], new, 0.0)
            z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
            good = np.exp(a[..., 1] + b[..., 1] - z[:, None])
            if step >= alone and step % 10 == 0:
                y = line_labels(good, size, label)
            g_e = np.where(live, good - y, 0.0) * cost[:, None]
            g_t = np.zeros((2, 2))
            for j in range(2):
                for k in range(2):
                    both = np.exp(a[:, :-1, j] + t[j, k] + emit[:, 1:, k] + b[:, 1:, k] - z[:, None])
                    seen = (y[:, :-1] == j) & (y[:, 1:] == k)
                    g_t[j, k] = (np.where(links, both - seen, 0.0) * cost[:, None]).sum()
            grad = np.append(np.einsum("st,std->d", g_e.astype(np.float32), x), g_t.ravel()) / cost.sum()
            grad += 1e-3 * theta
            if step <= alone:
                grad *= own
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        field.weights, field.transition = theta[:d], theta[d:].reshape(2, 2)
        found = [(sum(float(field.marginals(c[:, :d]) @ c[:, d]) for c in cs) / sum(float(c[:, d].sum()) for c in cs), y) for cs, y in zip(documents, labels) if cs]
        field.slope, field.offset = platt(np.array([_logit(r) for r, _ in found]), np.array([y for _, y in found], float))
        return field


def line_labels(good: np.ndarray, size: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The likelier label of every line, but the lines most like the document's label have it until they
    make up the share that the constraint asks for."""
    towards = np.where(label[:, None] == 1, good, 1 - good)
    order = np.argsort(np.where(size > 0, -towards, 2.0), axis=1, kind="stable")
    ahead = np.take_along_axis(size, order, 1)
    ahead = np.cumsum(ahead, 1) - ahead  # length of the lines before it in this order
    need = np.where(label == 1, GOOD_SHARE, BAD_SHARE) * size.sum(1)
    bound = np.zeros(size.shape, bool)
    np.put_along_axis(bound, order, ahead < need[:, None], 1)
    return np.where(bound, label[:, None], good > 0.5).astype(float)


def _logit(p: float) -> float:
    p = min(1 - 1e-6, max(1e-6, p))
    return float(np.log(p / (1 - p)))


def platt(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not below 0) and offset of a one-variable logistic fit, by damped Newton steps."""
    a, b = 0.5, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -50, 50)))
        w = p * (1 - p) + 1e-6
        g = np.array([((p - y) * s).sum() + 1e-2 * a, (p - y).sum()])
        h = np.array([[(w * s * s).sum() + 1e-2, (w * s).sum()], [(w * s).sum(), w.sum() + 1e-2]])
        move = np.linalg.solve(h, g)
        a, b = a - np.clip(move[0], -1, 1), b - np.clip(move[1], -1, 1)
    return max(0.0, float(a)), float(b)


def train(docs: DataFrame, labels: DataFrame) -> LineField:
    """``docs`` and ``labels`` are what may be learned from; chains of a bounded sample reach the driver."""
    marked = labels.filter("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))

    @F.arrow_udf("array<binary>")
    def packed(texts: pa.Array) -> pa.Array:
        return pa.array([[c.tobytes() for c in chains(t.as_py())] for t in texts], pa.list_(pa.binary()))

    rows = texts_of(docs, bounded(marked, "quality", SAMPLE_ROWS), F.col("text"))
    rows = sorted((r["doc_id"], r["chains"], int(r["quality"])) for r in rows.select("doc_id", "quality", packed("text").alias("chains")).collect())
    made = [[np.frombuffer(c, np.float32).reshape(-1, 3 * _N + 4) for c in cs] for _, cs, _ in rows]
    return LineField.fit(made, [q for *_, q in rows])


def score(docs: DataFrame, field: LineField, text: str = "text") -> DataFrame:
    """Adds ``score``."""
    sent = docs.sparkSession.sparkContext.broadcast(field)  # some 50 numbers

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array([float(sent.value.score(t.as_py())) for t in texts], pa.float64())

    return docs.withColumn("score", scored(F.col(text)))


def trained_on(spark: SparkSession, sf_dir: str) -> LineField:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return train(docs.filter(fold("doc_id", 5) != 0), labels.filter(fold("doc_id", 5) != 0))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, trained_on(spark, sf_dir)).select(
        "doc_id",
        (fold("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"),
    )
