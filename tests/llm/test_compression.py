import compare
from pyspark.sql import functions as F

from tidemark.llm import compression, queries

SF = "/root/testdata/sf0.01"


def test_held_out_labels(spark):
    rows = queries.op11_compression_quality(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    by_id = {r["doc_id"]: r for r in rows}
    marks = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if by_id[r["doc_id"]]["held_out"]]
    assert len(marks) > 60
    assert sum(by_id[r["doc_id"]]["predicted"] == r["quality"] for r in marks) >= 0.88 * len(marks)  # 60 bad texts to learn from at this size
    good, bad = ([by_id[r["doc_id"]]["score"] for r in marks if r["quality"] == y] for y in (1, 0))
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) >= 0.9 * len(good) * len(bad)


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(compression.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = compression.train(docs, labels), compression.train(docs, turned)
    assert (a.bad, a.good, a.bias) == (b.bad, b.good, b.bias)


def test_difference_by_the_library(spark):
    import zstandard

    good, bad = [b"the cat sat on the mat and looked at the dog %d" % i for i in range(300)], [b"BUY!! NOW!! $$$ CHEAP!! %d" % i for i in range(300)]
    by = compression.pair_of_dictionaries(bad, good)
    text = "the cat sat on the mat " * 100  # three blocks
    sizes = []
    for content in by:
        c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content), level=compression.LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False)
        sizes.append(sum(len(c.compress(text.encode()[i : i + 1024])) for i in (0, 1024, 2048)))
    difference, size = compression.measures(text, *by)
    assert difference == (sizes[0] - sizes[1]) / sum(sizes) > 0
    assert compression.measures("BUY!! NOW!! CHEAP!!", *by)[0] < 0
    assert compression.spread(b"x" * 10_000, 4) == [b"x" * 1024] * 4 and compression.blocks(b"") == [b""]


def test_odd_rows(spark, odd_docs, no_docs):
    docs, labels = spark.read.parquet(f"{compare.SF}/documents.parquet"), spark.read.parquet(f"{compare.SF}/labels.parquet")
    odd_labels = labels.unionByName(labels.limit(1)).unionByName(spark.createDataFrame([(None, 1, 0), (1, None, 0)], labels.schema))
    model = compression.train(docs, odd_labels)
    rows = compression.assess(odd_docs, model, ["doc_id", "score"]).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r[2] <= 1 for r in rows)
    same = {r[2] for r in rows if r["doc_id"] in (3, 4)}
    assert len(same) == 1  # null and empty
    assert len({r[2] for r in rows if r["doc_id"] == 5}) == 1
    assert compression.train(no_docs, labels) is None and compression.train(docs, labels.where("quality = 1")) is None
    assert {r[1] for r in compression.assess(odd_docs, None, ["doc_id"]).collect()} == {0.5}
    assert compression.assess(no_docs, model, ["doc_id"]).count() == 0
