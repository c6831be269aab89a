"""Row counts of the pipeline's stages with null and repeated ids."""

import hashlib
from collections import Counter

import corpus_pipeline
from tests.llm.test_operators import ROWS, SCHEMA
from voxelframe.llm import exact, mixing, sketch

LONG = [f"w{i}" for i in range(60)]
NEAR = " ".join([*LONG[:59], "other"])
MORE = [
    (None, "lone text", "en", "s", 9, "y"), (None, "a b c ", "en", "s", 6, "y"), (8, "x y", "en", "t", 3, "z"), (8, "x y", "en", "t", 3, "z"),
    (9, NEAR, "en", None, 9, "q"), (9, "nine", "en", "t", 4, "q"), (None, " ".join(LONG) + " more", "en", "t", 9, "q"),
    (None, "one two three four five six seven", "en", None, 9, "q"), (None, "one two three four five six seven", "en", None, 9, "r"),
]


def _rows(df):
    return Counter(map(tuple, df.collect()))


def test_exact_dedup_keeps_one_row_per_text(spark):
    docs = spark.createDataFrame(ROWS + MORE, SCHEMA).repartition(3)
    first = {}
    for r in sorted(ROWS + MORE, key=lambda r: (r[0] is None, r[0] or 0, [(x is not None, x) for x in r])):
        first.setdefault(" ".join((r[1] or "").replace("\t", " ").replace("\n", " ").replace("  ", " ").split(" ")), r)
    got = corpus_pipeline.exact_dedup(spark, docs, "")
    assert got.columns == docs.columns and _rows(got) == Counter(first.values())


def test_exact_dedup_combines_in_salted_groups(spark, monkeypatch):
    """The stage takes the operator's way: groups of a text and a salt first, then one per text."""
    calls = []
    salted = exact.salted
    monkeypatch.setattr(exact, "salted", lambda keyed, *of: calls.append(keyed.select(*exact.TEXT, "_salt")) or salted(keyed, *of))
    docs = spark.createDataFrame([(i, "a  copy" if i % 2 else "a copy", "en", "s", i, "x") for i in range(500)], SCHEMA).repartition(4)
    (kept,) = corpus_pipeline.exact_dedup(spark, docs, "").collect()
    assert (kept.doc_id, kept.text) == (0, "a copy")
    assert len(calls) == 1 and calls[0].distinct().count() > exact.SALTS // 2
    spark.createDataFrame([(1, "x", {"k": 1}), (None, "x", {"k": 2})], "doc_id long, text string, m map<string,int>").createOrReplaceTempView("maps")
    assert [r.m for r in exact.keep_one(spark.table("maps")).collect()] == [{"k": 1}]


def test_near_dedup_keeps_one_row_per_class(spark):
    rows = [r for r in ROWS + MORE if r[1] and len(r[1].split()) > 6]
    got = _rows(corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA).coalesce(1), ""))
    assert got == Counter([ROWS[4], MORE[7]])  # long texts are near copies of doc 5; the null ids share one text
    rows = [(9, " ".join(LONG), "en", "s", 1, "x"), (9, "nine", "en", "s", 1, "x"), (None, None, None, None, None, None)]
    assert _rows(corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "")) == Counter(rows)


def test_mixed_keeps_every_row_once(spark):
    rows = ROWS + MORE
    assert _rows(corpus_pipeline.mixed(spark, spark.createDataFrame(rows, SCHEMA), "")) == Counter(rows)


def _read_again(spark, df, tmp_path, name):
    df.write.parquet(f"{tmp_path}/{name}")
    return spark.read.parquet(f"{tmp_path}/{name}")


def test_positions_follow_the_slots(spark, tmp_path):
    rows = [(i, f"text {i}" + " word" * (i % 50), "en", s, 9, "x") for i, s in enumerate(["a"] * 700 + ["b"] * 200 + [None] * 100)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    slot = {r.doc_id: r.slot for r in mixing.mix(docs.select("doc_id", "source")).collect()}
    mixed = _read_again(spark, corpus_pipeline.mixed(spark, docs, ""), tmp_path, "mixed")
    got = {r.position: r for r in corpus_pipeline.encoded(spark, mixed, "").collect()}
    assert sorted(got) == list(range(len(rows)))
    assert [got[k].doc_id for k in range(len(rows))] == sorted(slot, key=lambda i: (slot[i], i))
    text = {r[0]: r[1] for r in rows}
    assert all(r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() for r in got.values())


def test_encoded_keeps_every_row_once(spark, tmp_path):
    docs = _read_again(spark, spark.createDataFrame(ROWS + MORE, SCHEMA).repartition(3), tmp_path, "rows")
    got = corpus_pipeline.encoded(spark, docs, "").collect()
    assert Counter((r.doc_id, r.decoded_sha256) for r in got) == Counter((r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in ROWS + MORE)


def test_columns_of_any_name_stay(spark):
    names = "score row key _row slot block _norm position id".split()
    schema = SCHEMA + "".join(f", {n} long" for n in names)
    rows = [(*r, *range(i, i + len(names))) for i, r in enumerate(ROWS[4:5] + MORE[:2])]
    docs = spark.createDataFrame(rows, schema)
    for stage in (corpus_pipeline.exact_dedup, corpus_pipeline.near_dedup, corpus_pipeline.mixed):
        got = stage(spark, docs, "")
        assert got.columns == docs.columns and _rows(got) == Counter(rows)


def test_stages_take_empty_tables(spark, tmp_path):
    none = _read_again(spark, spark.createDataFrame([], SCHEMA), tmp_path, "none")
    for stage in (corpus_pipeline.exact_dedup, corpus_pipeline.near_dedup, corpus_pipeline.mixed, corpus_pipeline.encoded):
        assert stage(spark, none, "").count() == 0


def test_stages_take_empty_tables_and_clashing_names(spark, monkeypatch):
    from voxelframe.llm import lines_crf

    monkeypatch.setattr(lines_crf, "trained_on", lambda spark, sf_dir: lines_crf.LineField.fit([], []))
    names = "row score key id component_id slot block lang_pred _norm _h2 _nth _row _mix_k ids decoded position digest node"
    schema = SCHEMA + "".join(f", {n} long" for n in names.split())
    rows = [(*r, *range(len(names.split()))) for r in (ROWS[4], ROWS[7], MORE[4])]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for df, n in ((docs, 3), (docs.limit(0), 0)):
            out = stage(spark, df, "")
            assert out.count() == n - (name == "near_dedup" and n > 0) and out.columns == df.columns, name


def test_buckets_are_not_sent_through_the_driver(spark, monkeypatch, tmp_path):
    made = spark.createDataFrame([(0, [1, 2, 3]), (1, [3, 4, 4]), (2, [2, 9, 3])], "node long, keys array<long>").selectExpr("node", "3L as n", "0 as pos", "explode(keys) as bucket")
    several = sketch._several(made)
    assert "Broadcast" not in several._jdf.queryExecution().toString()
    assert sorted((r.bucket, r.node) for r in several.collect()) == [(2, 0), (2, 2), (3, 0), (3, 1), (3, 2), (4, 1), (4, 1)]
    plans = []
    monkeypatch.setattr(sketch, "_kept", lambda df, path, kept=sketch._kept: plans.append(df._jdf.queryExecution().toString()) or kept(df, path))
    found = sketch._Classes(made.select("node").distinct(), None, str(tmp_path)).open(several)
    assert found.count() == 5 and "Broadcast" not in plans[0]
