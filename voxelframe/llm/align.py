"""Alignment of two tokenizers over whole texts, and how often their ids meet.

Both tokenizers cut the same bytes, so a text's tokens are known by the offsets where they end.  A galloping
intersection finds the ends that both have: each end of the shorter list looks for its place in the longer
one by steps that double and then by halving.  Common ends cut the tokens into groups; the difference of the
places of two neighbouring ends is the range of tokens that the token between them overlaps, its links.

One pass tokenizes and aligns chunks of texts and writes, per chunk, the figures of its texts, its distinct
linked id pairs and which text has how many of each, as rows of a text or of PIECE pairs.  The counts of all
pairs are then grouped in Spark, joined with each chunk's pairs, and a second pass over the chunks sums them
up per text.  No table of pairs goes to every executor, no row, group or batch holds more than a chunk, and
nothing grows with the corpus but the number of chunks.

Edge cases: a null or empty text, and one that either tokenizer does not give back byte by byte (A after a
space, B by its own), has no tokens: zeros and an empty digest.  Repeated rows count each time; a null or
repeated doc_id gives a row like any other; texts of any length are taken whole; an empty table gives an
empty one; extra columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.llm import bpe, shared

#: Code points of a chunk's texts; a longer text is a chunk of its own.
CHUNK = 4_000_000
#: Ids of B below 2 ** BITS, so that a pair of ids is one number.
BITS = 20


def gallop(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each end of the shorter list (both ascending, equal at the last): the place of the first end of
    the longer list that is not smaller, and whether the two are equal.  All ends search in step: from the
    place at which the lists' lengths let expect it, by steps that double until the end is bracketed on
    that side, then by halving the bracket."""
    last = len(long) - 1
    guess = np.arange(1, len(short) + 1) * len(long) // max(1, len(short)) - 1
    down = long[guess] >= short  # the place is at the guess or before it
    low, high = np.where(down, -1, guess), np.where(down, guess, last)  # long[low] < short <= long[high]
    step, open_ = 1, np.arange(len(short))
    while len(open_):
        at = np.where(down[open_], guess[open_] - step, guess[open_] + step)
        inside = (at > low[open_]) & (at < high[open_])
        open_, at = open_[inside], at[inside]
        reached = long[at] >= short[open_]
        high[open_[reached]], low[open_[~reached]] = at[reached], at[~reached]
        open_ = open_[reached == down[open_]]  # not yet past the place
        step *= 2
    open_ = np.flatnonzero(high - low > 1)
    while len(open_):
        middle = (low[open_] + high[open_]) // 2
        reached = long[middle] >= short[open_]
        high[open_[reached]], low[open_[~reached]] = middle[reached], middle[~reached]
        open_ = open_[high[open_] - low[open_] > 1]
    return high, long[high] == short


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the common ends in both lists, and the linked tokens of both: pairs of places."""
    turned = len(ends_a) > len(ends_b)
    short, long = (ends_b, ends_a) if turned else (ends_a, ends_b)
    place, common = gallop(short, long)
    begin = np.concatenate(([0], place[:-1] + common[:-1]))
    n = place - begin + 1
    mine = np.repeat(np.arange(len(short)), n)
    other = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - begin, n)
    cuts = np.flatnonzero(common), place[common]
    return (*reversed(cuts), other, mine) if turned else (*cuts, mine, other)


class Pair:
    """Tokenizers A (byte-level, a ``tokenizers`` file and its ranks) and B (a ``sentencepiece`` model)."""

    def __init__(self, a: str, ranks: str, b: str):
        self.a = tokenizers.Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        with open(ranks, "rb") as file:
            table = {base64.b64decode(t): int(r) for t, r in map(bytes.split, file)}
        # The same ids, quicker; where classes of characters might differ between libraries, A itself is asked.
        self.quick = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        with open(a, encoding="utf-8") as file:
            spec = json.load(file)
        byte = {c: i for i, c in enumerate(bpe._byte_letters())}
        names = {i: t for t, i in spec["model"]["vocab"].items()}
        bytes_a = [bytes(byte[c] for c in names.get(i, "") if c in byte) for i in range(max(names) + 1)]
        if any(table.get(t, i) != i for i, t in enumerate(bytes_a)):
            self.quick = None
        self.bytes_a, self.bytes_b = bytes_a, [self._piece(i) for i in range(self.b.get_piece_size())]
        if len(self.bytes_b) > 1 << BITS:
            raise ValueError(f"{b}: more than {1 << BITS} pieces")
        self.length_a, self.length_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        table = lambda n, ends: np.array([f"{i}{e}" for i in range(n) for e in ends], object)
        self.text_a, self.text_b = table(len(bytes_a), ",|"), table(len(self.bytes_b), ",;")

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def ids(self, text: str) -> tuple[list[int], list[int]]:
        spaced = " " + text
        if self.quick is None or bpe._ODD.search(text):
            a = self.a.encode(spaced, add_special_tokens=False).ids
        else:
            a = self.quick.encode_ordinary(spaced)
        b = self.b.encode(text)
        whole = spaced.encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != whole or b"".join(map(self.bytes_b.__getitem__, b)) != whole:
            return [], []
        return a, b

    def aligned(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and B, places of the last tokens of each group in A and B, places of the links in A and B."""
        a, b = (np.array(x, np.int64) for x in (self.ids(text) if text else ([], [])))
        if not len(a):
            return (a, b, *(np.zeros(0, np.int64),) * 4)
        return (a, b, *overlaps(np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])))

    def groups(self, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> str:
        """``a1,a2|b1;a3|b2,b3``: the ids of each group."""
        mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        mark_a[cut_a], mark_b[cut_b] = 1, 1
        group_a, group_b = np.cumsum(mark_a) - mark_a, np.cumsum(mark_b) - mark_b
        out = np.empty(len(a) + len(b), object)
        out[np.arange(len(a)) + np.concatenate(([0], cut_b + 1))[group_a]] = self.text_a[2 * a + mark_a]
        out[np.arange(len(b)) + (cut_a + 1)[group_b]] = self.text_b[2 * b + mark_b]
        return "".join(out.tolist())[:-1]


_MADE: dict[tuple, Pair] = {}


def _pair(files: tuple) -> Pair:
    """One pair of tokenizers per Python worker."""
    if files not in _MADE:
        _MADE[files] = Pair(*files)
    return _MADE[files]


#: A row per text of a chunk: its figures, and its pairs by place, with counts, as packed 32-bit integers.
_TEXT = "chunk bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, place binary, times binary"
#: Besides, PIECE of a chunk's distinct pairs and their counts a row, from the place ``first`` on: a row is never as long as a chunk.
CHUNKS = f"{_TEXT}, first int, pairs array<bigint>, counts array<bigint>"
PIECE = 4096


def _arrow(schema: str) -> pa.Schema:
    types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([(n, types[t]) for n, t in (c.split() for c in schema.split(", "))])


def _chunk(pair: Pair, chunk: int, ids: list, texts: list) -> list[dict]:
    docs, held, times = [], [], []
    for doc_id, text in zip(ids, texts):
        a, b, cut_a, cut_b, link_a, link_b = pair.aligned(text)
        found, n = np.unique(a[link_a] << BITS | b[link_b], return_counts=True)
        digest = hashlib.sha256(pair.groups(a, b, cut_a, cut_b).encode()).hexdigest() if len(a) else ""
        docs.append({"chunk": chunk, "doc_id": doc_id, "n_a": len(a), "n_b": len(b), "n_groups": len(cut_a), "n_links": len(link_a), "groups_sha256": digest})
        held.append(found)
        times.append(n)
    pairs, place = np.unique(np.concatenate(held), return_inverse=True)
    counts = np.bincount(place, weights=np.concatenate(times), minlength=len(pairs)).astype(np.int64)
    ends = np.cumsum([len(found) for found in held])
    for doc, at, n in zip(docs, np.split(place.astype("<i4"), ends[:-1]), times):
        doc |= {"place": at.tobytes(), "times": n.astype("<i4").tobytes()}
    return docs + [{"chunk": chunk, "first": k, "pairs": pairs[k : k + PIECE], "counts": counts[k : k + PIECE]} for k in range(0, len(pairs), PIECE)]


def chunks(docs: DataFrame, files: tuple) -> DataFrame:
    """Rows of CHUNKS for the columns doc_id and text.  A chunk is a stretch of rows that one task reads, and
    is known by the task's partition and its place there."""
    schema = _arrow(CHUNKS)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, ids, texts, size, chunk = _pair(files), [], [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids.append(doc_id.as_py())
                texts.append(text.as_py())
                size += len(texts[-1] or "")
                if size >= CHUNK or len(ids) >= CHUNK // 64:
                    yield pa.RecordBatch.from_pylist(_chunk(pair, chunk, ids, texts), schema)
                    ids, texts, size, chunk = [], [], 0, chunk + 1
        if ids:
            yield pa.RecordBatch.from_pylist(_chunk(pair, chunk, ids, texts), schema)

    return docs.select("doc_id", "text").mapInArrow(made, CHUNKS)


def pair_counts(made: DataFrame) -> DataFrame:
    """pair, count and best: how many links of all texts join these ids, and whether no id of A has more with
    this id of B."""
    counts = made.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("count"))
    of_b = F.col("pair").bitwiseAND((1 << BITS) - 1)
    most = counts.groupBy(of_b.alias("b")).agg(F.max("count").alias("most"))
    return counts.hint("merge").join(most, of_b == F.col("b")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def looked_up(made: DataFrame) -> DataFrame:
    """in_chunk, at, count and best of each chunk's pairs.  Spark reckons with the size before the pairs are
    exploded, so it is told not to send them, nor their counts, to every executor."""
    mine = made.select(F.col("chunk").alias("in_chunk"), "first", F.posexplode("pairs").alias("pos", "pair")).withColumn("at", F.col("first") + F.col("pos"))
    return mine.hint("merge").join(pair_counts(made), "pair").select("in_chunk", "at", "count", "best")


_OUT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def _summed(texts: pa.Table, looked: pa.Table) -> pa.Table:
    """The texts of one chunk and the counts of its pairs."""
    at = looked["at"].to_numpy()
    by_place = np.empty((2, len(at)), np.int64)
    by_place[0, at], by_place[1, at] = looked["count"].to_numpy(), looked["best"].to_numpy()
    place, times = ([np.frombuffer(x.as_py(), "<i4") for x in texts[c]] for c in ("place", "times"))
    sums = np.array([by_place[:, p] @ t.astype(np.int64) for p, t in zip(place, times)], np.int64).reshape(-1, 2)
    columns = {c: texts[c] for c in _arrow(_OUT).names if c in texts.column_names}
    return pa.table(columns | {"count_sum": sums[:, 0], "n_best": sums[:, 1]}).select(_arrow(_OUT).names)


def align(docs: DataFrame, files: tuple) -> DataFrame:
    """Per text: n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.  ``Pair.aligned`` has the
    groups and links of a text themselves.  Chunks meet their counts by sorting, one at a time in memory."""
    made = shared.written(chunks(docs, files), f"{shared.folder(docs.sparkSession, 'align')}/chunks")
    texts = made.filter("pairs is null").select(*_arrow(_TEXT).names)
    return texts.groupBy("chunk").cogroup(looked_up(made).groupBy("in_chunk")).applyInArrow(_summed, _OUT)


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return align(docs, tuple(map(public_tokenizers.path, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))))
