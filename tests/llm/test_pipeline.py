"""The pipeline: each stage on its predecessor's rows, against the operators' brute-force versions."""

import corpus_pipeline
from rolescape.llm import rules
from tests.llm.test_operators import brute_components, brute_removed


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "near_duplicates", "repeated_passages", "best_fit_packing"]


def test_stages_keep_columns_and_take_effect(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    first = corpus_pipeline.quality_rules(spark, docs, folder)
    kept = {r["doc_id"] for r in rules.quality_rules(docs).where("kept").collect()}
    assert first.columns == docs.columns and {r["doc_id"] for r in first.collect()} == kept
    one = corpus_pipeline.near_duplicates(spark, first, folder)
    items = [(r["doc_id"], r["text"]) for r in first.collect()]
    assert {r["doc_id"] for r in one.collect()} == {k for k, _, c in brute_components(items) if k == c}
    items = [(r["doc_id"], r["text"]) for r in one.collect()]
    cut = {r["doc_id"]: r for r in corpus_pipeline.repeated_passages(spark, one, folder).collect()}
    assert one.columns == docs.columns and len(cut) == len(items)
    for (k, x), (_, n, removed, *_) in zip(items, brute_removed(items), strict=True):
        assert len(cut[k]["text"].encode()) <= n - removed and (removed or cut[k]["text"] == x) and cut[k]["n_chars"] == len(cut[k]["text"])


def test_run_packs_what_is_left(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").toPandas()
    assert len(out) and out.groupby("sequence_id")["length"].sum().max() <= 2048


def test_stages_on_hard_rows(spark, clashing, none):
    """Nulls, empty and long texts, repeated rows and clashing columns; an empty table."""
    folder = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, clashing, folder)
        if name != "best_fit_packing":
            assert out.schema.names == clashing.columns
        rows = out.collect()
        if name == "quality_rules":
            assert {r["doc_id"] for r in rows}.isdisjoint({1, 2, 3, 4, 5, 6, 15})
        elif name == "near_duplicates":
            assert sorted(r["doc_id"] for r in rows if r["doc_id"] in (1, 2, 3, 7, 8, 10, 11)) == [1, 2, 3, 7, 10]
        elif name == "repeated_passages":
            assert len(rows) == clashing.count() and next(r["text"] for r in rows if r["doc_id"] == 1) is None
        elif name == "best_fit_packing":
            assert sum(r["start"] == 0 for r in rows) == clashing.count()
        assert stage(spark, none, folder).count() == 0


def brute_score(net, text):
    from tests.llm.test_operators import forward

    return forward(net, (text or "").encode())


def test_the_classifier_keeps_what_a_plain_forward_pass_keeps(spark):
    from rolescape.llm import classifier

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    net = classifier.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    kept = {r["doc_id"] for r in corpus_pipeline.quality_classifier(spark, docs, folder).collect()}
    for r in docs.collect():
        s = brute_score(net, r["text"])
        assert abs(s - classifier.THRESHOLD) < 1e-4 or (s >= classifier.THRESHOLD) == (r["doc_id"] in kept)
