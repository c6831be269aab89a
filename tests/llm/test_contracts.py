"""Queries against libraries and brute force, trained operators against held-out rows, edge cases of all."""

import base64
import hashlib
import random
import re
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from tests.llm.test_operators import ROWS, SCHEMA
from voxelframe.llm import bpe, exact, html, langid, lines_crf, mixing, rules, sampling, sketch, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "pages")}


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_op2_and_op9_equal_the_libraries(spark, tables):
    import tiktoken
    from tokenizers import Tokenizer

    texts = {r.doc_id: r.text or "" for r in tables["documents"].select("doc_id", "text").collect()}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    ref = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {}
    for i, t in texts.items():
        ids = ref.encode_ordinary(t)
        want[i] = (len(ids), sha(",".join(map(str, ids)).encode()), sha(t.encode()))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op2_bpe_roundtrip(spark, SF).collect()} == want
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in bpe.op9_token_counts(spark, SF).collect()}
    assert got == {i: (len(t.encode()), n[i], n[i] > 1024) for i, t in texts.items()}


def test_memo_of_two_generations_changes_no_result(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 3)
    encoder = bpe.Encoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    words = [random.Random(k).choice(["alpha", " beta", " gamma", " delta", " epsilon", " zeta", " eta"]) for k in range(200)]
    assert encoder.packed("".join(words)) == b"".join(bpe.array("i", encoder.ids_of(t)).tobytes() for t in bpe.pre_tokens("".join(words)))
    assert len(encoder.memo) <= 3 and len(encoder.memo.older) <= 3


@pytest.mark.parametrize("weights", [{"a": 0.9, "b": 0.05, "c": 0.03, "d": 0.02}, {"a": 1.0, "b": 1.0, "c": 1.0}, {"a": 0.61803398, "b": 0.31415926, "c": 0.0271828}])
def test_mix_deviates_less_than_a_block_over_50_000_slots(weights):
    names, total = sorted(weights), sum(Fraction(str(w)) for w in weights.values())
    share = {s: Fraction(str(w)) / total for s, w in weights.items()}
    whole = mixing.whole_weights(weights)
    blocks = [int(50_000 * share[s]) + 1 for s in names]
    source, block, slot, release, deadline = mixing.layout([whole[s] for s in names], blocks)
    end = min(b / share[s] for s, b in zip(names, blocks))
    seen = dict.fromkeys(names, 0)
    for t, (k, s) in enumerate(sorted(zip(slot, source))):
        if t + 1 > end:
            break
        assert k == t
        seen[names[s]] += 1
        assert all(abs(seen[x] - (t + 1) * share[x]) < 1 for x in names)
    assert t >= 49_990 and all(r <= k < d for k, r, d in zip(slot, release, deadline))


def test_mix_bounds_its_layout_by_equal_shares(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCKS", 50)
    df = spark.createDataFrame([(i, "a" if i % 3 else "b", i) for i in range(1000)], "doc_id long, source string, block long")
    got = mixing.mix(df).collect()
    assert len(got) == 1000 and {r.block for r in got if r.source == "b"} == set(range(17))
    assert max(sum(r.slot == k for r in got) for k in {r.slot for r in got}) == 20


def test_many_unlinked_texts_share_a_passage(spark, monkeypatch):
    rnd = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    texts = [" ".join(passage + [f"u{rnd.randrange(10**6)}" for _ in range(rnd.choice((14, 30, 60)))]) for _ in range(150)]
    base = [f"b{i}" for i in range(100)]
    for k in range(150):  # near a base, often not near each other
        words = list(base)
        for _ in range(k % 7):
            words[rnd.randrange(100)] = f"v{rnd.randrange(10**6)}"
        texts.append(" ".join(words))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    root = list(range(len(texts)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for j in range(len(texts)):
        for i in range(j):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    monkeypatch.setattr(sketch, "HOT", 20)  # the order of shingles decides on the work only
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in sketch.near_duplicates(df).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def test_near_takes_repeated_and_null_ids(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a), (6, a + " more"), (6, b), (9, b + " more"), (None, a), (None, "x y"), (7, None), (7, "")]
    got = sketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == [
        (0, 1, 0), (0, 36, 1), (1, 36, 1), (6, 36, 6), (6, 37, 1), (7, 0, 7), (7, 0, 7), (9, 37, 6)]


def test_rarest_shingles_of_a_pair_at_the_threshold_meet():
    rng = np.random.default_rng(11)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        both = rng.integers(0, 1 << 40, n)
        more = [rng.integers(1 << 41, 1 << 42, k) for k in (lambda k: (k, n // 3 - k))(int(rng.integers(0, n // 3 + 1)))]
        x, y = (np.unique(np.concatenate([both, m])) for m in more)
        common = np.unique(rng.choice(both, max(1, n // 2)))
        p, q = (sketch.rarest(s, common, np.arange(1, len(common) + 1)) for s in (x, y))
        assert 100 * len(np.intersect1d(x, y)) < 75 * len(np.union1d(x, y)) or len(np.intersect1d(p, q))


def test_estimate_takes_off_chance_collisions():
    rng = np.random.default_rng(2)
    n = 4000
    same = [np.mean(sketch.registers(rng.integers(0, 1 << 63, n).astype(np.uint64)) == sketch.registers(rng.integers(0, 1 << 63, n).astype(np.uint64))) for _ in range(30)]
    assert 0 < sketch._collision(n, n) < 0.001 and np.mean(same) < 0.004
    assert sketch.estimate(1.0, 10, 10) == 1.0 and sketch.estimate(0.0, 10, 10) == 0.0


def test_samples_and_models_do_not_depend_on_partitions(spark, tables):
    learn = tables["documents"].filter(sampling.fold("doc_id", 5) != 0)
    labels = tables["labels"]
    for train in (lines_crf.train, rules.train):
        a, b = (train(learn.repartition(k, "text"), labels.repartition(k, "quality")) for k in (2, 7))
        assert np.array_equal(a.weights, b.weights) and (a.slope, a.offset) == (b.slope, b.offset)
    a, b = (toxicity.train(learn.repartition(k, "text"), labels) for k in (2, 7))
    assert np.array_equal(a.weights, b.weights) and a.index == b.index
    assert langid.train(learn.repartition(2, "text")).raw == langid.train(learn.repartition(7, "text")).raw


def test_samples_are_exact(spark):
    rows = [(i, "a" if i < 900 else "b") for i in range(1000)] + [(5, "a")] * 50 + [(None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, g string")
    got = sampling.bounded(df, "g", 60).collect()
    assert sorted(r.g for r in got) == ["a"] * 60 + ["b"] * 60 and len({r.doc_id for r in got}) == 120
    assert sampling.bounded(df.filter("g = 'b'"), "g", 500).count() == 100
    many = spark.range(100_000).selectExpr("id % 1000 as doc_id", "'a' as g")  # 1,000 ids of 100 rows
    found = [r.doc_id for r in sampling.bounded(many, "g", 400).collect()]
    assert len(found) == len(set(found)) == 400
    assert sorted(found) == sorted(r.doc_id for r in sampling.bounded(many.distinct().repartition(3), "g", 400).collect())


def test_held_out_rows(spark, tables):
    """Learned from the folds of the contracts, measured on the others."""
    truth = {r.doc_id: r for r in tables["labels"].collect()}
    lang = {r.doc_id: r.lang for r in tables["documents"].select("doc_id", "lang").collect()}
    got = [(r.predicted, truth[r.doc_id].quality) for r in lines_crf.op6_quality_classifier(spark, SF).filter("held_out").collect() if r.doc_id in truth]
    assert len(got) > 50 and np.mean([a == b for a, b in got]) > 0.97
    got = [(r.lang_pred, lang[r.doc_id]) for r in langid.op4_language_id(spark, SF).filter("held_out").collect() if lang[r.doc_id]]
    assert len(got) > 200 and np.mean([a == b for a, b in got]) > 0.95
    got = [(r.score, truth[r.doc_id].toxic) for r in toxicity.op3_toxicity(spark, SF).filter("held_out").collect() if r.doc_id in truth]
    toxic, clean = [s for s, t in got if t], [s for s, t in got if not t]
    assert len(toxic) > 5 and np.mean([a > b for a in toxic for b in clean]) > 0.8 and np.mean([s >= 0.7 for s in clean]) < 0.02
    held = sampling.fold("doc_id", 5) == 0
    model = rules.train(tables["documents"].filter(~held), tables["labels"].filter(~held))
    got = [(r.probability >= 0.5, truth[r.doc_id].quality) for r in rules.apply_rules(tables["documents"].filter(held), model).collect() if r.doc_id in truth]
    assert len(got) > 50 and np.mean([a == b for a, b in got]) > 0.9


def test_lines_of_a_bad_document_need_not_all_be_bad():
    good, bad = "A plain line of words, that ends well.", "BAD### $$$ !!! %%% XX"
    texts = ["\n".join([good] * 6)] * 12 + ["\n".join([good, good, bad, bad, good, bad])] * 12
    field = lines_crf.LineField.fit([lines_crf.chains(t) for t in texts], [1] * 12 + [0] * 12)
    p = field.marginals(lines_crf.with_neighbours(lines_crf.line_features(texts[-1])[0]))
    assert p[0] > 0.5 > p[3] and field.score(texts[0]) > 0.5 > field.score(texts[-1])
    y = lines_crf.line_labels(np.full((2, 4), 0.5), np.array([[10, 10, 10, 10], [5, 5, 0, 0.0]]), np.array([0, 1]))
    assert (y[0] == 0).sum() == 4 and y[1, :2].tolist() == [1, 1]
    assert sum(map(len, lines_crf.chains("\n".join(f"line {i}" for i in range(5000))))) == 5000


def test_vectors_take_characters_whole():
    a, b = rules.vectors(["ééé x", "日本語 x"])
    half = rules.DIMS // 2
    assert (a[half:] > 0).sum() == 3 and (b[half:] > 0).sum() == 3 and not np.array_equal(a, b)
    assert (rules.vectors(["one two one two"])[0][:half] > 0).sum() == 4 and not rules.vectors([None, ""]).any()


def test_html_probes():
    text = html.main_text
    assert text('<div class="page with-sidebar"><article><p>one</p></article></div>') == "one"
    assert text("<article><header><h1>Title</h1></header><p>x</p><footer>no</footer></article>") == "Title\nx"
    assert text('<article><section class="social-history"><p>x y</p></section><div class="social-links">no</div></article>') == "x y"
    assert text('<p title="a>first</p>') == "first" and text("<p title=don't>one</p><p>it's</p>") == "one\nit's"
    assert text("<aside><article>no</article></aside><article>yes</article>") == "yes"
    assert text("<article>" + "<p>word</p>" * 20_000 + "</article>").count("word") == 20_000


def test_windows_match_brute_force():
    rnd = random.Random(3)
    for _ in range(300):
        n = rnd.randrange(1, 14)
        lengths = [rnd.choice((0, 5, 20, 60, 90, 400)) for _ in range(n)]
        sums = {i: sum(lengths[max(0, i) : max(0, i + html.WINDOW)]) for i in range(1 - html.WINDOW, n)}
        least = min(html.THRESHOLD, html.PEAK_SHARE * max(sums.values()))
        full = {k for i, s in sums.items() if least and s >= least for k in range(max(0, i), min(n, i + html.WINDOW))}
        got = html.running_text(lengths, [False] * n)
        # Lines kept lie in a full window and are not empty; long lines are never lost.
        assert set(got) <= {k for k in full if lengths[k]} and got == sorted(set(got))
        assert {k for k in range(n) if least and lengths[k] >= least} <= set(got)


NAMES = "score rejected lang_pred n_words kept probability block slot _norm _salt text_hash digest node _made _t ids decoded n_tokens held_out".split()


def test_names_that_clash(spark):
    df = spark.createDataFrame([(1, "One plain text of words.", "en", "s", *range(len(NAMES)))], "doc_id long, text string, lang string, source string" + "".join(f", {n} long" for n in NAMES))
    field, learner = lines_crf.LineField.fit([], []), toxicity.PULearner({}, np.zeros(0), 0.0)
    for out in (
        lines_crf.score(df, field), toxicity.score(df, learner), langid.classify(df, langid.Compressors({"en": b"one plain text"})),
        rules.apply_rules(df, rules.Regression()), mixing.mix(df), exact.keep_one(df), html.extract(df, "text", "score"),
        bpe.encode_and_decode(df, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")),
    ):
        row = out.collect()[0]
        assert len(set(out.columns)) == len(out.columns) and set(df.columns) <= set(out.columns) and row.held_out == len(NAMES) - 1
    assert exact.groups(df).count() == sketch.near_duplicates(df).count() == 1


def test_tables_without_rows_or_labels(spark, docs):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for d in (docs, none):
        assert {r.score for r in lines_crf.score(docs, lines_crf.train(d, labels)).collect()} == {0.5}
        assert {r.predicted for r in toxicity.score(docs, toxicity.train(d, labels)).selectExpr("score >= 0.7 as predicted").collect()} == {False}
        assert rules.apply_rules(docs, rules.train(d, labels)).filter("probability <> 1").count() == 0
    assert {r.lang_pred for r in langid.classify(docs, langid.train(none)).collect()} == {"und"}
    assert html.extract(none.selectExpr("text as html")).count() == 0
    for f in (lambda d: lines_crf.score(d, lines_crf.LineField.fit([], [])), lambda d: rules.apply_rules(d, rules.Regression()), exact.groups, mixing.mix):
        assert f(none).count() == 0


def test_very_long_texts(spark):
    long = "\n".join(f"Line {i} of a long text, with words." for i in range(20_000))
    df = spark.createDataFrame([(1, long, "en", "s"), (2, long + " x", "en", "s")], "doc_id long, text string, lang string, source string")
    assert {r.component_id for r in sketch.near_duplicates(df).collect()} == {1}
    assert rules.apply_rules(df, rules.Regression()).filter("n_words >= 160000").count() == 2
    assert lines_crf.score(df, lines_crf.LineField.fit([], [])).filter("score between 0 and 1").count() == 2
    assert {r.lang_pred for r in langid.classify(df, langid.Compressors({"de": b"das haus", "en": b"Line of a long text"})).collect()} <= {"de", "en"}


def test_pipeline_by_brute_force(spark):
    """Every stage of the whole run against what plain code makes of the same rows."""
    sf = "/root/testdata/sf0.001"
    docs = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    field = lines_crf.trained_on(spark, sf)
    docs = [d for d in docs if field.score(d["text"]) >= 0.3]
    first = {}
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", d["text"] or ""), d)
    docs = list(first.values())
    sets = []
    for d in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in d["text"] or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(docs)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for j in range(len(docs)):
        for i in range(j):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    docs = [d for k, d in enumerate(docs) if find(k) == k]
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id: r.decoded_sha256 for r in got} == {d["doc_id"]: hashlib.sha256((d["text"] or "").encode()).hexdigest() for d in docs}
    assert len(got) == len(docs) and sorted(r.position for r in got) == list(range(len(docs)))
    rows = spark.createDataFrame([(d["doc_id"], d["source"]) for d in docs], "doc_id long, source string")
    slot = {r.doc_id: r.slot for r in mixing.mix(rows).collect()}
    assert [r.doc_id for r in sorted(got, key=lambda r: r.position)] == sorted(slot, key=lambda i: (slot[i], i))


def test_risk_and_its_gradient_by_finite_differences():
    rng = np.random.default_rng(6)
    for prior, floor in ((0.05, False), (0.9, True)):
        x_p, x_u = rng.integers(0, 2, (7, 4)).astype(float), rng.integers(0, 2, (11, 4)).astype(float)
        w, b = rng.normal(size=4) + (2 if floor else 0), 1.0 if floor else 0.0
        if floor:  # unlabelled rows that look clean: the corrected negative part falls below zero
            x_u *= 0
            b = -3.0
        sig = lambda z: 1 / (1 + np.exp(-z))
        part = lambda v: np.mean([sig(v[:-1] @ r + v[-1]) for r in x_u]) - prior * np.mean([sig(v[:-1] @ r + v[-1]) for r in x_p])
        whole = lambda v: prior * np.mean([1 - sig(v[:-1] @ r + v[-1]) for r in x_p]) + max(0.0, part(v))
        at = np.append(w, b)
        value, way = toxicity.risk(w, b, x_p, x_u, prior)
        assert (part(at) < 0) == floor and abs(value - whole(at)) < 1e-12
        f = (lambda v: -part(v)) if floor else whole
        steps = np.eye(5) * 1e-6
        assert np.allclose(way, [(f(at + e) - f(at - e)) / 2e-6 for e in steps], atol=1e-7)


def test_sizes_by_the_library_and_ties():
    import zstandard as zstd

    raw = {"xx": b"uno dos tres cuatro cinco", "aa": b"one two three four five", "bb": b"one two three four five"}
    found = langid.Compressors(raw)
    for text in ("one two three four five", "Dos tres!", "none of them", "One " * 3000):
        sizes = {}
        for lang, content in raw.items():
            words = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            sizes[lang] = len(zstd.ZstdCompressor(level=langid.LEVEL, dict_data=words, write_content_size=False).compress(text.lower().encode()))
        best = min(sizes, key=lambda k: (sizes[k], k))
        lang, score, rejected = found.classify(text)
        gap = sorted(sizes.values())[1] - sizes[best]
        assert lang == best and rejected == (gap < langid.MARGIN) and 0.5 <= score <= 1
    assert found.classify("one two three four five")[::2] == ("aa", True)  # equal sizes: the first by name
