import re
from collections import defaultdict

import compare
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, queries


def test_query_matches_sql(spark):
    assert compare.check(spark, queries.op5_exact_dedup, queries.OP5_SQL) > 1


def groups(docs):
    found = defaultdict(list)
    for r in docs.collect():
        found[re.sub(r"[ \t-\r]+", " ", r["text"] or "")].append(r["doc_id"])
    return sorted((min((i for i in ids if i is not None), default=None), len(ids)) for ids in found.values())


def test_odd_rows(spark, odd_docs, no_docs):
    rows = exact_dedup.exact_dedup(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    kept = [r for r in rows if r["kept"]]
    assert sorted((r["keep_id"], r["group_size"]) for r in kept) == groups(odd_docs)
    assert all(r["keep_id"] == r["doc_id"] for r in kept)
    assert exact_dedup.exact_dedup(no_docs).count() == 0
    left = exact_dedup.keep_first(odd_docs)
    assert left.columns == odd_docs.columns and left.count() == len(kept)
    assert exact_dedup.keep_first(no_docs).count() == 0


def test_texts_with_one_digest_are_told_apart(spark, odd_docs):
    weak = lambda text: F.substring(F.unhex(F.sha2(F.substring(text, 1, 1), 256)), 1, 1)
    rows = exact_dedup.exact_dedup(odd_docs, digest=weak).collect()
    assert len(rows) == odd_docs.count()
    assert sorted((r["keep_id"], r["group_size"]) for r in rows if r["kept"]) == groups(odd_docs)


def test_state_grows_over_batches(spark, tmp_path):
    rows = [(i, f"text {i % 7}") for i in range(70)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5).write.parquet(path)
    out = exact_dedup.exact_dedup(spark.read.parquet(path), files_per_batch=1).collect()
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in out} == {(i, i % 7, 10, i < 7) for i in range(70)}


def test_no_python_on_the_executors(spark):
    plan = queries.op5_exact_dedup(spark, compare.SF)._jdf.queryExecution().toString() + queries.op3_chat_formatting(spark, compare.SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_rows_made_of_one_file_row_are_told_apart(spark, tmp_path):
    """Exploded, joined and united frames repeat rows of a file; one of each text stays all the same."""
    spark.createDataFrame([(i, f"text {i % 3}") for i in range(9)], "doc_id bigint, text string").repartition(2).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    twice = docs.selectExpr("doc_id", "explode(array(text, text)) AS text")
    joined = docs.join(spark.range(3).withColumnRenamed("id", "more"))
    for df in (docs, twice, joined, docs.union(docs), docs.where("doc_id > 2").selectExpr("doc_id", "text")):
        left = exact_dedup.keep_first(df)
        assert left.columns == df.columns and sorted(r["text"] for r in left.collect()) == ["text 0", "text 1", "text 2"]
        rows = exact_dedup.exact_dedup(df).collect()
        assert len(rows) == df.count() and sum(r["kept"] for r in rows) == 3 and {r["group_size"] for r in rows} == {df.count() // 3}


def test_state_meets_the_rows_of_later_batches(spark, tmp_path):
    spark.createDataFrame([(i, f"text {i % 5}") for i in range(40)], "doc_id bigint, text string").repartition(8).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    landing = docs.selectExpr("struct(false AS no_id, doc_id AS id, doc_id AS at) AS row", "unhex(sha2(text, 256)) AS digest").repartition(7)
    landing.write.parquet(str(tmp_path / "l"))
    landing = spark.read.parquet(str(tmp_path / "l"))
    for files in (None, 1, 100):
        found = exact_dedup.first_seen(landing, str(tmp_path / "l"), files).collect()
        assert sorted((r["keep"]["id"], r["n"]) for r in found) == [(i, 8) for i in range(5)]


def test_paths_named_twice(spark, tmp_path):
    """A path twice, or a folder beside its own file, gives each row twice; one row of each text stays."""
    path = str(tmp_path / "t")
    spark.createDataFrame([(i, f"text {i % 2}") for i in range(4)], "doc_id bigint, text string").coalesce(1).write.parquet(path)
    part = next((tmp_path / "t").glob("*.parquet"))
    assert exact_dedup.plain_scan(spark.read.parquet(path).where("doc_id > 0").select("text"))
    for paths in ((path, path), (path, str(part)), (str(part), path + "/")):
        docs = spark.read.parquet(*paths)
        assert docs.count() == 8 and not exact_dedup.plain_scan(docs)
        left = exact_dedup.keep_first(docs).collect()
        assert sorted(map(tuple, left)) == [(0, "text 0"), (1, "text 1")]
        rows = exact_dedup.exact_dedup(docs).collect()
        assert len(rows) == 8 and sum(r["kept"] for r in rows) == 2 and {r["group_size"] for r in rows} == {4}
