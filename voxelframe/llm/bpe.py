"""Byte-level BPE: encoding, decoding and counting tokens of whole texts.

``encode`` resolves each pre-token in two tiers.  A minimal perfect hash over the vocabulary answers
for pre-tokens that are themselves tokens; every other one is merged with a heap over linked bytes.
``count_tokens`` runs the same heap over linked symbols but only subtracts merges, so no ids exist.

Edge cases: a null text counts as empty; an empty text has no ids, 0 tokens and decodes to ``b""``.
Texts of any length are taken whole (the work is per pre-token).  Rows are independent, so repeated
rows give repeated results, empty tables give empty tables and extra columns pass through untouched.
An output name that already exists is replaced by the new column.
"""

from __future__ import annotations

import base64
import json
import re
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries of each of the two generations of a worker's pre-token memo.  Bounds memory, not results.
MEMO_ENTRIES = 250_000
#: Ids decoded at once.
DECODE_IDS = 1 << 18

_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_LATIN = "A-Za-z\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u024f"
#: Characters of which the standard library's classes agree with the Unicode ones in PATTERN.
_ODD = re.compile(f"[^\\t-\\r -~{_LATIN[6:]}]")
_FAST = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^\\t-\\r {_LATIN}0-9]+|[\\t-\\r ]+(?![^\\t-\\r ])|[\\t-\\r ]+"
)
_FULL = regex.compile(public_tokenizers.PATTERN.replace("\\s+", f"[{_WHITE}]+").replace("\\S", f"[^{_WHITE}]").replace("^\\s", f"^{_WHITE}"))


def pre_tokens(text: str) -> list[str]:
    """The matches of the public pattern, with a quicker equal pattern for Latin texts."""
    return (_FULL if _ODD.search(text) else _FAST).findall(text)


class PerfectHash:
    """Minimal perfect hash by hash-and-displace: n keys take slots 0 to n - 1.

    Keys fall into buckets; a bucket's displacement sends all its keys to free slots.  Buckets of one
    key come last and store their slot itself, as a negative number.
    """

    def __init__(self, keys: list[bytes], ids: list[int]):
        self.n = len(keys)
        self.n_buckets = max(1, self.n // 2)
        buckets: list[list[int]] = [[] for _ in range(self.n_buckets)]
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        for i, h in enumerate(hashes):
            buckets[(h >> 44) % self.n_buckets].append(i)
        self.shift = [0] * self.n_buckets
        taken, slots = bytearray(self.n), [0] * self.n
        order = sorted(range(self.n_buckets), key=lambda b: -len(buckets[b]))
        free = 0
        for b in order:
            own = buckets[b]
            if len(own) == 1:
                while taken[free]:
                    free += 1
                taken[free], slots[free], self.shift[b] = 1, own[0], -free - 1
            elif own:
                d = 0
                while True:
                    at = {self._slot(hashes[i], d) for i in own}
                    if len(at) == len(own) and not any(taken[s] for s in at):
                        break
                    d += 1
                self.shift[b] = d
                for i in own:
                    s = self._slot(hashes[i], d)
                    taken[s], slots[s] = 1, i
        self.keys = [keys[i] for i in slots]
        self.ids = [ids[i] for i in slots]

    def _slot(self, h: int, d: int) -> int:
        return ((h & 0x3FFFFF) + d * (((h >> 22) & 0x3FFFFF) | 1)) % self.n

    def get(self, key: bytes) -> int | None:
        """The id of a key, or None.  One probe; the stored key settles membership."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[(h >> 44) % self.n_buckets]
        s = -d - 1 if d < 0 else self._slot(h, d)
        return self.ids[s] if self.keys[s] == key else None


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: a heap of adjacent pairs by rank over a doubly linked list of byte spans."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    get = ranks.get
    # A span is known by its start; ends[i] is its end, and also the start of the next span.
    ends, before, stamp = list(range(1, n + 1)), list(range(-1, n)), [0] * n
    heap = []
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapify(heap)
    while heap:
        _, i, stop = heappop(heap)
        j = ends[i]
        if stamp[i] or j == n or ends[j] != stop:  # one of the two spans has changed since
            continue
        ends[i], stamp[j] = stop, 1
        before[stop] = i
        if stop < n:
            r = get(piece[i : ends[stop]])
            if r is not None:
                heappush(heap, (r, i, ends[stop]))
        if i:
            p = before[i]
            r = get(piece[p:stop])
            if r is not None:
                heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return out


class Memo(dict):
    """What has been made for a pre-token, in two generations: when the younger is full, the older is
    forgotten and the younger takes its place; what is used again moves to the younger."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, token: str):
        made = self.older.get(token)
        if made is None:
            made = self.make(token)
        if len(self) >= MEMO_ENTRIES:
            self.older = dict(self)
            self.clear()
        self[token] = made
        return made


class Encoder:
    """A rank file's encoder and decoder.  Sent to the executors once, by a broadcast of a few MB."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        self.whole = PerfectHash(list(self.ranks), list(self.ranks.values()))
        self.memo = Memo(self._made)

    def __getstate__(self):
        return {"ranks": self.ranks, "whole": self.whole}

    def __setstate__(self, state):
        self.__dict__.update(state, memo=Memo(self._made))

    def ids_of(self, token: str) -> list[int]:
        piece = token.encode("utf-8", "surrogatepass")
        i = self.whole.get(piece)
        return [i] if i is not None else merge_bytes(piece, self.ranks)

    def _made(self, token: str) -> bytes:
        return array("i", self.ids_of(token)).tobytes()

    def packed(self, text: str) -> bytes:
        """Ids of a text as 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, pre_tokens(text)))


class Decoder:
    """Bytes of ids: all tokens lie in one pool, and ids gather their stretches of it."""

    def __init__(self, path: str):
        ranks = Encoder(path).ranks
        self.length = np.zeros(max(ranks.values(), default=-1) + 1, np.int32)
        for token, i in ranks.items():
            self.length[i] = len(token)
        ends = np.cumsum(self.length, dtype=np.int64)
        self.start = (ends - self.length).astype(np.int32)
        self.pool = np.frombuffer(b"".join(sorted(ranks, key=ranks.get)), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        n = self.length[ids]
        ends = np.cumsum(n)
        at = np.repeat(self.start[ids] - (ends - n).astype(np.int32), n)
        at += np.arange(len(at), dtype=np.int32)
        return self.pool[at]

    def rows(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The bytes of each row; row k has the ids from ends[k] to ends[k + 1]."""
        sizes = np.concatenate(([0], np.cumsum(self.length[ids], dtype=np.int64)))[ends]
        parts = [self.bytes_of(ids[k : k + DECODE_IDS]) for k in range(0, len(ids), DECODE_IDS)]
        data = np.concatenate(parts) if parts else np.empty(0, np.uint8)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(sizes), pa.py_buffer(data)])


def _ids(encoder: Encoder, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts in a row, and where each text's begin."""
    packed = [encoder.packed(t.as_py() or "") for t in texts]
    return np.frombuffer(b"".join(packed), "<i4"), np.cumsum([0, *(len(p) // 4 for p in packed)])


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the column ``ids``: the ids of each whole text by the rank file at ``path``."""
    encoder = df.sparkSession.sparkContext.broadcast(Encoder(path))

    @F.arrow_udf("array<int>")
    def ids_of(texts: pa.Array) -> pa.Array:
        found, ends = _ids(encoder.value, texts)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found))

    return df.withColumn(ids, ids_of(F.col(text)))


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the column ``decoded``: the bytes that the ids stand for (null ids: no bytes)."""
    decoder = df.sparkSession.sparkContext.broadcast(Decoder(path))

    @F.arrow_udf("binary")
    def bytes_of(rows: pa.Array) -> pa.Array:
        ends = np.concatenate(([0], np.cumsum(rows.value_lengths().fill_null(0).to_numpy())))
        return decoder.value.rows(rows.flatten().to_numpy(), ends.astype(np.int64)).cast(pa.binary())

    return df.withColumn(decoded, bytes_of(F.col(ids)))


def encode_and_decode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds ``ids`` and ``decoded``: encodes each whole text once and decodes these very ids, in one pass."""
    encoder = df.sparkSession.sparkContext.broadcast(Encoder(path))
    decoder = df.sparkSession.sparkContext.broadcast(Decoder(path))

    @F.arrow_udf("struct<ids:array<int>,decoded:binary>")
    def both(texts: pa.Array) -> pa.Array:
        found, ends = _ids(encoder.value, texts)
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found))
        return pa.StructArray.from_arrays([ids, decoder.value.rows(found, ends).cast(pa.binary())], ["ids", "decoded"])

    return df.withColumns({c: both(F.col(text))[c] for c in ("ids", "decoded")})


class Counter:
    """Counts the tokens of a ``tokenizers`` byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, before = spec["model"], spec["pre_tokenizer"]
        if spec["normalizer"] or model["type"] != "BPE" or before["type"] != "ByteLevel" or before["add_prefix_space"] or model.get("ignore_merges"):
            raise ValueError(f"{path}: not a plain byte-level BPE file")
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.split = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        vocab = model["vocab"]
        self.byte_ids = [vocab[c] for c in _byte_letters()]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault(vocab[a] << 20 | vocab[b], (rank, vocab[a + b]))
        self.memo = Memo(self.merged)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "memo"}

    def __setstate__(self, state):
        self.__dict__.update(state, memo=Memo(self.merged))

    def merged(self, token: str) -> int:
        """Initial symbols minus merges; the lowest-rank adjacent pair goes first, the leftmost on ties."""
        symbols = [self.byte_ids[b] for b in token.encode("utf-8", "surrogatepass")]
        n = len(symbols)
        if n == 1:
            return 1
        get = self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n))
        heap = []
        for i in range(n - 1):
            key = symbols[i] << 20 | symbols[i + 1]
            m = get(key)
            if m:
                heap.append((m[0], i, key, m[1]))
        heapify(heap)
        count = n
        while heap:
            _, i, key, made = heappop(heap)
            j = after[i]
            if j >= n or symbols[i] << 20 | symbols[j] != key:  # a merged-away symbol is -1
                continue
            k = after[j]
            symbols[i], symbols[j], after[i] = made, -1, k
            count -= 1
            if k < n:
                before[k] = i
                key = made << 20 | symbols[k]
                m = get(key)
                if m:
                    heappush(heap, (m[0], i, key, m[1]))
            p = before[i]
            if p >= 0:
                key = symbols[p] << 20 | made
                m = get(key)
                if m:
                    heappush(heap, (m[0], p, key, m[1]))
        return count

    def count(self, text: str) -> int:
        if self.split and self.split.search(text):
            parts = self.split.split(text)
            return len(parts) - 1 + sum(self._plain(p) for p in parts)
        return self._plain(text)

    def _plain(self, text: str) -> int:
        return sum(map(self.memo.__getitem__, pre_tokens(text)))


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte: itself, or the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def count_tokens(df: DataFrame, path: str, text: str = "text", n_tokens: str = "n_tokens") -> DataFrame:
    """Adds the column ``n_tokens`` (null text: 0)."""
    counter = df.sparkSession.sparkContext.broadcast(Counter(path))

    @F.arrow_udf("bigint")
    def n_of(texts: pa.Array) -> pa.Array:
        return pa.array([counter.value.count(t.as_py() or "") for t in texts], pa.int64())

    return df.withColumn(n_tokens, n_of(F.col(text)))


def op2_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roundtrip(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def roundtrip(docs: DataFrame, *extra: str) -> DataFrame:
    """Ids and decoded bytes of every text, as digests; the extra columns stay."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = encode_and_decode(docs.select("doc_id", "text", *extra), path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *extra,
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counted = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > 1024).alias("over_limit"),
    )
