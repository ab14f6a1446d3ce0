import corpus_pipeline
import pytest

from squelch.llm import neardup, quality, substring


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    docs, found = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, sf).write.parquet(path)
        out = spark.read.parquet(path)
        found.append((docs, out))
        docs = out
    return found


def test_columns(stages):
    for _, out in stages[:-1]:
        assert tuple(out.columns) == corpus_pipeline.DOCUMENT


def test_decisions_take_effect(stages):
    (docs, good), (_, once), (_, clean), (before, mixed), (_, packed) = stages
    kept = {r.doc_id for r in quality.judged(docs.select("doc_id", "text")).filter("kept").select("doc.doc_id").collect()}
    assert {r.doc_id for r in good.collect()} == kept
    classes = neardup.classes(good.select("doc_id", "text"))
    assert {r.doc_id for r in once.collect()} == {r.class_id for r in classes.collect()}
    removed = {r.doc_id: r.n_removed for r in substring.remove_repeats(once.select("doc_id", "text")).collect()}
    texts = {r.doc_id: r.text for r in once.collect()}
    for r in clean.collect():
        assert (r.text == texts[r.doc_id]) == (removed[r.doc_id] == 0)
        assert r.n_chars == len(r.text)
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in before.collect()}
    assert packed.filter("piece = 0").count() == mixed.count()


def test_run_is_the_stages(spark, sf, stages):
    assert corpus_pipeline.run(spark, sf).count() == stages[-1][1].count()
