"""The stages of the pipeline, each on its own input."""

import duckdb

import corpus_pipeline
from tilewright.llm import language, oracles
from tilewright.llm.quality import quality
from tilewright.plans.staging import stage


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "language id", "near dedup", "packing"]
    for name, step in corpus_pipeline.STAGES:
        out = stage(step(spark, docs, sf), "test")
        before, after = {r.doc_id for r in docs.select("doc_id").collect()}, {r.doc_id for r in out.select("doc_id").collect()}
        assert after <= before
        whole = {tuple(r) for r in docs.select(*corpus_pipeline.COLUMNS).collect()}
        if name == "quality rules":
            con = duckdb.connect()
            con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
            assert after == {i for (i,) in con.sql(f"SELECT doc_id FROM ({oracles.quality()}) WHERE kept").fetchall()}
        if name == "language id":
            found = language.identify(docs, language.train(docs))
            assert after == {r.doc_id for r in found.where("lang_pred <> 'und' and score >= 0.2").collect()}
            assert len(after) > 0.95 * len(before)
        if name == "near dedup":
            from tests.llm.test_operators import jaccard_components, texts

            assert after == {d for d, (_, c) in jaccard_components(texts(docs), 5, 80).items() if d == c}
        if name == "packing":
            assert after == before
        else:
            assert out.columns == corpus_pipeline.COLUMNS
            # what stays is as it was, texts and all
            assert {tuple(r) for r in out.collect()} == {r for r in whole if r[0] in after}
        docs = out


def test_stages_without_labels_or_rows(spark):
    """Without a lang in any row nothing is learned: the base rules alone judge, and no document goes for its language."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    bare = stage(docs.selectExpr("doc_id", "text", "cast(null as string) as lang", "source", "n_chars"), "bare")
    assert bare.where("lang is not null").count() == 0
    ids = lambda d: sorted(r.doc_id for r in d.select("doc_id").collect())
    assert ids(corpus_pipeline.quality_rules(spark, bare, sf)) == ids(quality(bare, references={}).where("not base_failed"))
    assert ids(corpus_pipeline.language_id(spark, bare, sf)) == ids(bare)
    none = docs.limit(0)
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, none, sf)
        assert out.count() == 0, name


def test_near_dedup_of_null_and_repeated_ids(spark):
    def words(start, n=60):
        return " ".join(f"w{i}" for i in range(start, start + n))

    near = words(0) + " other"
    known = [
        (3, words(0)), (5, near), (5, words(1000)), (6, words(2000)), (7, words(3000)), (7, words(3000) + " more"), (7, words(3000)),
        (8, words(2000)), (8, words(4000)), (9, ""), (9, ""), (9, None), (None, words(5000)), (None, words(0)), (None, words(0)), (None, None),
    ]
    docs = spark.createDataFrame([(i, t, "en", None, len(t or "")) for i, t in known], "doc_id long, text string, lang string, source string, n_chars long")
    out = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    sevens = [x for x in out if x[0] == 7]
    assert len(sevens) == 1 and sevens[0] in known
    want = [(3, words(0)), (5, words(1000)), (6, words(2000)), (8, words(4000)), (9, ""), (9, None), (None, words(5000)), (None, words(0)), (None, words(0)), (None, None)]
    assert sorted((x for x in out if x[0] != 7), key=str) == sorted(want, key=str)


def test_language_id_rejects_what_was_not_learned(spark):
    from tests.llm.test_operators import ITALIAN, letters

    strange = {1: ITALIAN, 2: letters(480), 3: letters(60), 4: "Старик каждое утро смотрел на море из окна своего дома.", 5: "日本語の文章です。海を見ていました。"}
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(*corpus_pipeline.COLUMNS)
    added = spark.createDataFrame([(-i, t, None, None, len(t)) for i, t in strange.items()], real.schema)
    after = {r.doc_id for r in corpus_pipeline.language_id(spark, real.union(added), "").select("doc_id").collect()}
    assert not any(i < 0 for i in after)
    assert len(after) > 0.97 * real.count()


def test_quality_rules_learn_from_all_texts(spark):
    from tests.llm.test_operators import labelled_beyond_a_sample

    d, _, _ = labelled_beyond_a_sample(spark)
    assert 9999 in {r.doc_id for r in corpus_pipeline.quality_rules(spark, d, "").select("doc_id").collect()}
