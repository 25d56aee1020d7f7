import compare

import corpus_pipeline as pipeline
from test_near_copies import plain_kept
from tidemark.llm import exact_dedup, language, packing, quality
from tidemark.llm.common import table, written


def test_stages_take_effect_in_order(spark):
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "language_id", "exact_dedup", "near_dedup", "packing"]
    docs = table(spark, compare.SF, "documents")
    columns, before = docs.columns, docs
    rules = quality.assess(docs, quality.train(docs, table(spark, compare.SF, "labels")), ["doc_id"])
    want = {r["doc_id"] for r in rules.where("kept").collect()}
    for name, stage in pipeline.STAGES[:-1]:
        after = written(stage(spark, before, compare.SF), name)
        assert after.columns == columns
        ids = sorted(r["doc_id"] for r in after.collect())
        if name == "language_id":
            said = language.predict(before, language.train_on_documents(before), ["doc_id"])
            want = {r["doc_id"] for r in said.where("NOT ambiguous").collect()}
        if name == "exact_dedup":
            want = {r["doc_id"] for r in exact_dedup.exact_dedup(before).where("kept").collect()}
        if name == "near_dedup":
            want = {i for i, _ in plain_kept([(r["doc_id"], r["text"]) for r in before.collect()])}
        assert ids == sorted(want)
        before = after
    pieces = pipeline.run(spark, compare.SF).collect()
    assert {r["doc_id"] for r in pieces} == want
    assert sorted(map(tuple, pieces)) == sorted(map(tuple, packing.pack(before, pipeline.public_tokenizers.path("byte_bpe_50k.json")).collect()))


def test_clean_documents_stay_and_broken_ones_go(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    kept = pipeline.quality_rules(spark, docs, sf).join(labels, "doc_id").groupBy("quality").count().collect()
    kept = {r["quality"]: r["count"] for r in kept}
    long = {r["quality"]: r["count"] for r in labels.join(docs, "doc_id").where("size(split(text, '\\\\s+')) >= 55").groupBy("quality").count().collect()}
    assert kept[1] >= 0.97 * long[1] and kept.get(0, 0) <= 0.03 * long[0]


def test_odd_rows(spark, odd_docs, no_docs):
    for name, stage in pipeline.STAGES:
        for docs in (odd_docs, no_docs):
            out = written(stage(spark, docs, compare.SF), f"odd-{name}")
            assert name == "packing" or out.columns == docs.columns
            assert out.count() <= docs.count() * 400
