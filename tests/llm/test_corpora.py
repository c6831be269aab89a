"""Decontamination, conversation tries and tokenizer alignment by brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from voxelframe.llm import align, leaks, trie

FILES = tuple(map(public_tokenizers.path, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")))
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_LOWER))


def _hits(docs, items):
    """Per document, by trying every window of every item at every place: n_words, n_hit, items."""
    out = []
    for doc_id, text in docs:
        w, hit, found = _words(text), set(), set()
        for item_id, theirs in items:
            theirs = _words(theirs)
            for i in range(max(1, len(theirs) - leaks.WINDOW + 1)) if theirs else ():
                x = theirs[i : i + leaks.WINDOW]
                for k in range(len(w) - len(x) + 1):
                    if w[k : k + len(x)] == x:
                        hit |= set(range(k, k + len(x)))
                        found |= {item_id} - {None}
        out.append((doc_id, len(w), len(hit), sorted(map(str, found))))
    return sorted(out, key=repr)


def _found(spark, docs, items):
    docs = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n_words", "2 as window", "'x' as key", "3 as row")
    items = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as words", "2 as window")
    got = leaks.items_of(leaks.find(docs, items), leaks.windows(items)).collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, list(r.item_ids)) for r in got), key=repr)


@pytest.mark.parametrize("sent", [leaks.SENT, 3])
def test_leaks_by_brute_force(spark, monkeypatch, sent):
    monkeypatch.setattr(leaks, "SENT", sent)  # both ways of joining
    rnd = random.Random(4)
    word = lambda: rnd.choice(("a", "b", "The", "É", "x1", "日本"))
    items = [(i, " ".join(word() for _ in range(rnd.choice((0, 1, 2, 5, 10, 11, 14))))) for i in range(25)]
    items += [(3, items[7][1]), (None, "only here " * 5), (90, None), (91, items[0][1]), (92, items[0][1])]
    docs = [(i, ", ".join(word() for _ in range(rnd.choice((0, 3, 9, 40))))) for i in range(40)]
    docs += [(50 + i, f"zz {items[i][1]}. yy {items[i][1].upper()} {items[i][1]}") for i in range(25)]
    docs += [(None, "q " + "only here " * 6), (None, None), (7, ""), (7, "!!"), (7, "a b " * 500)]
    assert _found(spark, docs, items) == _hits(docs, items)


def test_leaks_of_empty_tables(spark):
    assert _found(spark, [], [(1, "a b")]) == []
    assert _found(spark, [(1, "a b"), (2, None)], []) == _found(spark, [(1, "a b"), (2, None)], [(1, "!"), (2, None)]) == [(1, 2, 0, []), (2, 0, 0, [])]


def _nodes(convs):
    """The trie from every prefix of every path (conv_id to a list of turns with sizes)."""
    members = defaultdict(list)
    for c, p in convs:
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append((c, len(p)))
    out = []
    for q, m in members.items():
        under = [x for x in members if x[: len(q)] == q]
        kids = [x for x in under if len(x) == len(q) + 1]
        leaves = [x for x in under if not any(y[: len(x)] == x and len(y) > len(x) for y in under)]
        saved = sum((len(members[x]) - 1) * x[-1][1] for x in under if x)
        ends = ",".join(str(c) for c, n in sorted(m) if n == len(q))
        up = min(c for c, _ in members[q[:-1]]) if q else None
        out.append((min(c for c, _ in m), len(q), up, len(m), len(kids), len(leaves), saved, ends))
    return sorted(out, key=repr)


def _trie(spark, convs):
    rows = [(c, [(hashlib.sha256(t.encode()).digest()[:16], n) for t, n in p]) for c, p in convs]
    df = spark.createDataFrame(rows, "conv_id long, turns array<struct<id:binary,n:int>>")
    return sorted((tuple(r) for r in trie.trie(df).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends").collect()), key=repr)


@pytest.mark.parametrize("cells,sent", [(trie.CELLS, trie.SENT), (3, 0)])
def test_trie_by_brute_force(spark, monkeypatch, cells, sent):
    monkeypatch.setattr(trie, "CELLS", cells)
    monkeypatch.setattr(trie, "SENT", sent)
    rnd = random.Random(8)
    turn = lambda: rnd.choice([(t, len(t) * 7) for t in ("a", "bb", "ccc")])
    convs = [(c, [turn() for _ in range(rnd.choice((0, 1, 2, 3, 5)))]) for c in range(-30, 60)]
    convs += [(c, [("a", 7)] * 4) for c in range(100, 160)]  # a hot conversation, dealt over several shards
    convs += [(c, [("a", 7)] * 4 + [(f"x{c}", c)]) for c in range(200, 230)] + [(300, [("bb", 14)] * 40), (300, [])]
    assert _trie(spark, convs) == _nodes(convs)


def test_tries_of_few_rows(spark):
    assert _trie(spark, []) == []
    assert _trie(spark, [(5, [])]) == [(5, 0, None, 1, 0, 1, 0, "5")]
    assert _trie(spark, [(5, []), (4, [("a", 3)])]) == _nodes([(5, []), (4, [("a", 3)])])


def test_rebuilt_by_brute_force(spark):
    rnd = random.Random(1)
    rows = [(c, k, rnd.choice(("user", None)), rnd.choice(("x", "y", None))) for c in [*range(100, 130), 205, 206, 207, -100, -103] for k in range(rnd.choice((1, 3, 9)))]
    rows += [(205, None, "user", "first"), (None, 1, "user", "nobody's")]
    own = defaultdict(list)
    for c, k, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    want = {}
    for c in set(own) - {None}:
        h, base = zlib.crc32(str(c).encode()) % 6, c - int(np.fmod(c, 100))
        want[c] = own.get(base, [])[:h] + own[c][h:]
    digest = lambda t: hashlib.sha256(f"{len(t[0])}:{t[0]}{t[1]}".encode()).digest()[:16]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as t", "2 as turns", "3 as base", "4 as h")
    got = {r.conv_id: [(bytes(t.id), t.n) for t in r.turns] for r in trie.rebuilt(trie.paths(df)).collect()}
    assert got == {c: [(digest(t), len(t[1])) for t in p] for c, p in want.items()}


def test_gallop_finds_every_place():
    rnd = np.random.default_rng(3)
    for _ in range(400):
        last = int(rnd.integers(1, 300))
        ends = [np.union1d(rnd.integers(1, last + 1, int(rnd.integers(0, last))), [last]) for _ in range(2)]
        a, b = sorted(ends, key=len)
        place, common = align.gallop(a, b)
        assert np.array_equal(place, np.searchsorted(b, a)) and np.array_equal(common, np.isin(a, b))
        cut_a, cut_b, at_a, at_b = align.overlaps(*ends)
        x, y = ends
        assert np.array_equal(x[cut_a], y[cut_b]) and np.array_equal(x[cut_a], np.intersect1d(x, y))
        begin = lambda e: np.concatenate(([0], e[:-1]))
        want = {(i, j) for i in range(len(x)) for j in range(len(y)) if begin(x)[i] < y[j] and begin(y)[j] < x[i]}
        assert set(zip(at_a.tolist(), at_b.tolist())) == want and len(at_a) == len(want)


def test_alignment_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(align, "CHUNK", 2000)
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=FILES[2])
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    docs += [(None, "One text."), (None, None), (5, ""), (5, "One text."), (6, "has ▁ itself"), (7, "<|endoftext|> <s> x</s>"), (8, "日本 😀\u0085 \t\n é\x00z  "), (9, "aé" * 3000)]
    letters = {c: i for i, c in enumerate(align.bpe._byte_letters())}
    bytes_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    found, links = [], Counter()
    for doc_id, text in docs:
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        cut_a, cut_b = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a], [bytes_b(i) for i in ids_b]
        if not text or b"".join(cut_a) != (" " + text).encode() or b"".join(cut_b) != (" " + text).encode():
            found.append((doc_id, 0, 0, [], []))
            continue
        owner = lambda cut: [k for k, t in enumerate(cut) for _ in t]
        pairs = sorted(set(zip(owner(cut_a), owner(cut_b))))
        ends = lambda cut: set(np.cumsum([len(t) for t in cut]).tolist())
        both, groups = sorted(ends(cut_a) & ends(cut_b)), []
        inside = lambda ids, cut, lo, hi: [i for i, e in zip(ids, np.cumsum([len(t) for t in cut])) if lo < e <= hi]
        for lo, hi in zip([0, *both], both):
            groups.append(",".join(map(str, inside(ids_a, cut_a, lo, hi))) + "|" + ",".join(map(str, inside(ids_b, cut_b, lo, hi))))
        met = [(ids_a[i], ids_b[j]) for i, j in pairs]
        links.update(met)
        found.append((doc_id, len(ids_a), len(ids_b), groups, met))
    most = {}
    for (_, j), n in links.items():
        most[j] = max(n, most.get(j, 0))
    want = [
        (d, n_a, n_b, len(g), len(m), sum(links[x] == most[x[1]] for x in m), sum(links[x] for x in m), sha(";".join(g)) if n_a else "")
        for d, n_a, n_b, g, m in found
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as chunk", "2 as pairs", "3 as n_a").repartition(3)
    got = align.align(df, FILES).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert align.align(df.limit(0), FILES).count() == 0


def test_no_row_of_alignment_is_as_long_as_a_chunk(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    align.chunks(docs.coalesce(1), FILES).write.parquet(f"{tmp_path}/chunks")
    made = spark.read.parquet(f"{tmp_path}/chunks")
    rows = made.selectExpr("size(pairs) as n", "octet_length(place) as place", "first").collect()
    assert sum(r.place is not None for r in rows) == docs.count()
    pieces = sorted((r.first, r.n) for r in rows if r.place is None)
    assert len(pieces) > 1 and max(n for _, n in pieces) == align.PIECE and [k for k, _ in pieces] == [align.PIECE * i for i in range(len(pieces))]
    looked = align.looked_up(made)
    assert "Broadcast" not in looked._jdf.queryExecution().toString() and looked.groupBy("in_chunk", "at").count().filter("count > 1").isEmpty()
