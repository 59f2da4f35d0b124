"""The pipeline's stages, each held against what its operator decides."""

import corpus_pipeline
from docspark.llm import mixing, toxicity
from tests.llm.test_models import brute_components
from tests.llm.test_texts import brute_hits


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    path = corpus_pipeline.stored
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(path(stage(spark, seen[-1], sf), f"test-{name}"))
        assert seen[-1].columns == docs.columns and 0 < seen[-1].count() <= seen[-2].count()
    rows = [{r.doc_id: r.text for r in x.collect()} for x in seen]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out(labels.doc_id, 0)))
    assert set(rows[1]) == {r.doc_id for r in toxicity.score(docs, model).collect() if r.score < 0.5}
    assert set(rows[2]) == set(rows[1]) and any(rows[2][i] != rows[1][i] for i in rows[1])
    assert set(rows[3]) == {c for _, c in brute_components(list(rows[2].items())).values()}
    assert all(h == 0 for _, (_, h, _, _) in brute_hits(list(rows[4].items()), items))
    clean = {i for i, (_, h, _, _) in brute_hits(list(rows[3].items()), items) if not h}
    assert all(rows[4][i] == rows[3][i] for i in clean)
    last = corpus_pipeline.STAGES[-1][1](spark, seen[-1], sf).collect()
    taken = {r.doc_id for r in mixing.mix_sources(seen[-1]).collect() if r.taken}
    assert {r.doc_id for r in last} == taken and all(r.n_times >= 1 for r in last)


def test_stages_take_nulls_and_clashing_columns(spark, sf):
    rows = [(1, None, None, None, None, "a"), (None, "some text of a few words here", "en", "s", 5, "b"), (2, "", "en", "s", 0, "c"), (3, "word " * 5000, "en", None, 1, "d"), (3, "word " * 5000, "en", None, 1, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rank string")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert set(docs.columns) <= set(out.columns)
        assert out.count() <= 5
        assert stage(spark, docs.limit(0), sf).count() == 0
