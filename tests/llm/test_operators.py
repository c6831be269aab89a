"""Small tests of the training-data operators: brute force, round trips and edge cases."""

import base64
import re

import pytest
import public_tokenizers

from voxelframe.llm import bpe, exact, html, langid, lines_crf, mixing, rules, sketch, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string"
ROWS = [
    (1, "a b  c\n", "en", "s", 6, "x"), (2, "a\tb c ", "en", None, 6, "x"), (3, None, None, "s", None, None),
    (4, "", "en", "t", 0, "x"), (5, " ".join(f"w{i}" for i in range(60)), "en", "s", 9, "x"),
    (6, "W0 " + " ".join(f"w{i}" for i in range(1, 59)) + " other", "en", "s", 9, "x"), (6, "a b c ", "en", "s", 9, "x"),
    (7, "é" * 5000 + "<|endoftext|> 日本", "fr", "t", 9, "x"),
]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact(docs, none):
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.groups(docs).collect())
    assert got == [(1, 1, 3, True), (2, 1, 3, False), (3, 3, 2, True), (4, 3, 2, False), (5, 5, 1, True), (6, 1, 3, False), (6, 6, 1, True), (7, 7, 1, True)]
    assert exact.groups(none).count() == 0
    assert exact.keep_one(docs).columns == docs.columns


def test_near(docs, none):
    got = {r.doc_id: r.component_id for r in sketch.near_duplicates(docs.filter("n_chars <> 6 or n_chars is null").filter("text <> 'a b c ' or text is null")).collect()}
    assert got == {3: 3, 4: 4, 5: 5, 6: 5, 7: 7}
    assert sketch.near_duplicates(none).count() == 0


def test_near_matches_brute_force(spark):
    import random

    rnd = random.Random(7)
    texts = []
    for _ in range(12):  # families whose members drift apart: chains of links, and pairs just below the threshold
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.choice((30, 80, 200)))]
        for _ in range(9):
            texts.append(" ".join(words))
            words = list(words)
            for _ in range(rnd.choice((0, 1, 1, 2, 4))):
                words[rnd.randrange(len(words))] = f"v{rnd.randrange(5000)}"
    rnd.shuffle(texts)
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
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in sketch.near_duplicates(df).collect()}
    assert got == {i: (len(sets[i]), find(i), find(i) == i) for i in range(len(texts))}


def test_near_links_one_shingle_at_any_length(spark):
    texts = [" ".join(["word"] * n) for n in (4, 5, 6, 50)] + ["a b c d e", "A  b c d\te", "a b c d e f"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in sketch.near_duplicates(df).collect()}
    assert got == {0: (1, 0), 1: (1, 1), 2: (1, 1), 3: (1, 1), 4: (1, 4), 5: (1, 4), 6: (2, 6)}


def test_bpe(docs, none):
    import tiktoken
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    ref = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in bpe.decode(bpe.encode(docs, path), path).collect():
        assert r.ids == ref.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    for r in bpe.count_tokens(docs, path).collect():
        assert r.n_tokens == len(tok.encode(r.text or "", add_special_tokens=False).ids)
    assert bpe.roundtrip(none).count() == 0


def test_mix(spark, docs, none):
    rows = [(i, s) for s, n in (("a", 300), ("b", 100), (None, 60)) for i in range(n)]
    df = spark.createDataFrame([(k, s) for k, (_, s) in enumerate(rows)], "doc_id long, source string")
    weights = {"a": 3.0, "b": 1.5, None: 0.7}
    got = mixing.mix(df, weights, block_rows=1).collect()
    assert len(got) == len(rows) and all(r.release <= r.slot < r.deadline for r in got)
    shares = mixing.whole_weights(weights)
    inside = [r for r in sorted(got, key=lambda r: r.slot) if r.in_target]
    assert [r.slot for r in inside] == list(range(len(inside))) and len(inside) > 50
    seen = dict.fromkeys(shares, 0)
    for t, r in enumerate(inside, 1):
        seen[r.source] += 1
        assert all(abs(seen[s] - t * shares[s] / 52) < 1 for s in shares)
    assert mixing.mix(docs).count() == len(ROWS) and mixing.mix(none).count() == 0


def test_mix_keeps_the_weights_given(spark):
    from fractions import Fraction

    many = {str(i): 1.0 for i in range(1199)} | {"hot": 981.0}  # hot: 45 %
    cases = [
        ({"a": 0.9, "b": 0.1}, {"a": 4500, "b": 500}),  # repeats after 10 slots
        ({"a": 7777**0.5, "b": 31**0.5, None: 2**0.5}, {"a": 4000, "b": 300, None: 70}),
        (many, {s: 900 if s == "hot" else 1 for s in many}),
    ]
    for weights, counts in cases:
        rows = [s for s, n in counts.items() for _ in range(n)]
        df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, source string")
        got = sorted(mixing.mix(df, weights, block_rows=1).collect(), key=lambda r: r.slot)
        assert len(got) == len(rows) == len({r.slot for r in got})
        total = sum(Fraction(str(w)) for w in weights.values())
        exact = {s: Fraction(str(w)) / total for s, w in weights.items()}
        for r in got:
            w = exact[r.source]
            assert (r.release, r.deadline) == (r.block // w, -(-(r.block + 1) // w)) and r.release <= r.slot < r.deadline
        inside = [r for r in got if r.in_target]
        assert [r.slot for r in inside] == list(range(len(inside))) and len(inside) > 800
        seen = dict.fromkeys(exact, 0)
        for t, r in enumerate(inside, 1):
            seen[r.source] += 1
            assert all(abs(seen[s] - t * exact[s]) < 1 for s in ({r.source} if weights is many else exact))
        assert all(abs(seen[s] - len(inside) * exact[s]) < 1 for s in exact)
    with pytest.raises(ValueError):
        mixing.whole_weights({"a": 1.0, "b": 0.0})


def test_html():
    page = (
        "<html><head><title>t</title></head><body><nav><ul><li><a href='/'>home</a></ul></nav><div class=\"ad\">buy</div>"
        "<article><h1>A &amp; B</h1><p>one\n two<br>three<div class='comments'>me too</div><p>x</article><footer>&copy;</footer>"
    )
    assert html.main_text(page) == "A & B\none two\nthree\nx"
    assert html.main_text(None) == html.main_text("") == "" and html.main_text("<p>a</p><p") == "a"
    assert html.main_text("<ul><li><a href=x>menu</a></li></ul><p>plain text</p>") == "plain text"


def test_html_with_tags_left_out():
    text = html.main_text
    assert text("<html><head><title>t</title><body><article><p>text</p></article>") == "text"
    assert text("<head><meta charset=x><title>t</title><p>text</p>") == text("<head><title>t</title>text") == "text"
    assert text("<p><svg class=i/>one</p><p>two</p>") == "one\ntwo"
    assert text("<p>a <svg><title/><path d=x><g><text>no</text></g></svg>b</p><svg><g>no<p>two</p>") == "a b\ntwo"
    assert text("<datalist><option value=x></datalist><p>two</p>") == "two"
    assert text("<select><option>no<option>no</select><p>one</p><select><option>no<p>two</p>") == "one\ntwo"
    assert text("<noscript><p>no</p></noscript><p>one</p><template><div>no</div></template>") == "one"
    assert text("<a name=top><p>one</p><p>two</p>") == "one\ntwo"
    assert text("<p>one more line <a href=x>not closed</p><p>two</p>") == "one more line not closed\ntwo"
    assert text("<a href=x><div>menu</div><div>menu</div></a><p>two</p>") == "two"
    assert text("<main> &nbsp; </main><p>text</p>") == "text"
    assert text("<script>if (a<b) '<p>no</p>'</script ><p>one</p><style>p{}") == "one"


def test_html_distribution_decides(monkeypatch):
    long = [f"{w} " * 30 for w in ("one", "two", "three", "four")]
    parts = ["Buy our nice things now", "<h2>Head</h2>", long[0], long[1], "short", "tiny", "brief", "small", long[2], long[3], "All rights reserved 2024"]
    page = "".join(f"<div><p>{t}</p></div>" for t in parts)
    words = lambda: [t.split()[0] for t in html.main_text(page).split("\n")]
    assert words() == ["Head", "one", "two", "short", "tiny", "brief", "small", "three", "four"]
    monkeypatch.setattr(html, "WINDOW", 1)
    assert words()[0] == "Buy" and words()[-1] == "All"  # a tenth of one line is the threshold
    monkeypatch.setattr(html, "WINDOW", 3)
    nav = page.replace("<div><p>tiny", "<nav>menu</nav><div><p>tiny")
    assert [t.split()[0] for t in html.main_text(nav).split("\n")] == ["Head", "one", "two", "three", "four"]
    assert "brief" in html.main_text(nav.replace("<p>brief", "<p>brief " + "b " * 40)) and "tiny" not in html.main_text(nav)
    monkeypatch.setattr(html, "THRESHOLD", 1)
    assert words() == ["Buy", "Head", "one", "two", "short", "tiny", "brief", "small", "three", "four", "All"]
    assert html.main_text("<nav>menu</nav>" + "".join(f"<p>line {k}</p>" for k in range(9))).count("line") == 9


def test_rules(docs, none):
    def brute(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        t = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        hit = {j for i, x in enumerate(t) if t.count(x) > 1 for j in range(i, i + 3)}
        lines = text.split("\n")
        dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)

    for text in ("a b c a b c d\nx\n\n\nx", "a a a a a", "", "# b\n# b\n  \n  "):
        assert rules.base_counts(text) == brute(text)
    assert rules.base_counts(None) == (0, 0, 0, 0, 0)
    model = rules.train(docs, docs.select("doc_id").limit(0).selectExpr("doc_id", "1 as quality"))
    assert rules.apply_rules(docs.select("doc_id", "text"), model).filter("kept").count() == 2
    assert rules.apply_rules(none.select("doc_id", "text"), model).count() == 0


def test_classifiers(spark, docs, none):
    texts = ["Good line here.\nAnd more."] * 8 + ["BAD*** ### $$$\n!! XX"] * 8
    field = lines_crf.LineField.fit([lines_crf.chains(t) for t in texts], [1] * 8 + [0] * 8)
    assert field.score("Good words there.\nAnd others.") > 0.5 > field.score("BAD$$$ *** ###\nXX !!")
    assert lines_crf.score(docs, field).filter("score between 0 and 1").count() == len(ROWS)
    learner = toxicity.PULearner.fit([{1, 5}, {1, 6}, {1}] * 4, [{2}, {3}, {2, 1}, {4}] * 4, 0.25)
    assert learner.score({1}) > 0.5 > learner.score({2})
    assert toxicity.score(docs, learner).filter("score between 0 and 1").count() == len(ROWS)
    packs = langid.Compressors({"en": b"the house and the garden " * 40, "de": b"das haus und der garten " * 40})
    assert packs.classify("the garden and the house")[0] == "en" and packs.classify("das haus und der garten")[0] == "de"
    assert packs.classify(None)[0] == packs.classify("12 !")[0] == "und"
    assert langid.classify(none, packs).count() == 0


def test_marginals_match_all_paths():
    import itertools

    import numpy as np

    rng = np.random.default_rng(3)
    field = lines_crf.LineField(rng.normal(size=39), rng.normal(size=(2, 2)))
    rows = rng.random((5, 12))
    e = lines_crf.with_neighbours(rows) @ field.weights
    total, good = 0.0, np.zeros(5)
    for p in itertools.product((0, 1), repeat=5):
        w = np.exp(sum(e[i] for i in range(5) if p[i]) + sum(field.transition[a, b] for a, b in zip(p, p[1:])))
        total, good = total + w, good + w * np.array(p)
    assert np.allclose(field.marginals(lines_crf.with_neighbours(rows)), good / total)
