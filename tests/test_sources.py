from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidemark.sources import files as S


def test_names():
    assert S.clean_names(["Unit Price ($)", "unit_price", "", "  ", "A--B", "a b", "ünit", "_x_"]) == ["unit_price", "unit_price_2", "column", "column_2", "a_b", "a_b_2", "nit", "x"]


def test_csv(spark, tmp_path):
    (tmp_path / "Sales Data.csv").write_text("Product,Region ,Revenue\nA,N,1.5\nB,S,2\n", encoding="utf-8")
    (tmp_path / "bare.csv").write_text("1,2\n3,4\n")
    (tmp_path / "latin.csv").write_bytes("name\ncaf\xe9\n".encode("latin-1"))
    df = S.ingest_csv(spark, str(tmp_path / "Sales Data.csv"))
    assert df.columns == ["product", "region", "revenue"] and [tuple(r) for r in df.orderBy("product").collect()] == [("A", "N", 1.5), ("B", "S", 2.0)]
    bare = S.ingest_csv(spark, str(tmp_path / "bare.csv"))
    assert bare.columns == ["col_0", "col_1"] and sorted(tuple(r) for r in bare.collect()) == [(1, 2), (3, 4)]
    assert S.ingest_csv(spark, str(tmp_path / "latin.csv")).first()[0] == "café"
    tables = S.ingest_csv_dir(spark, [str(tmp_path / x) for x in ("Sales Data.csv", "bare.csv", "none.csv")])
    assert set(tables) == {"sales_data", "bare"} and spark.table("sales_data").count() == 2


def test_corpus(spark, tmp_path):
    schema = StructType([StructField("id", LongType()), StructField("question", StringType())])
    for name, text in (("many", '[{"id": 1, "question": "a"}, {"id": 2}]'), ("one", '{"id": 3, "question": "c"}'), ("bad", '[{"id": 1,')):
        (tmp_path / f"{name}.json").write_text(text)
    read = lambda n: sorted((r["id"], r["question"]) for r in S.read_corpus(spark, str(tmp_path / f"{n}.json"), schema).collect())
    assert read("many") == [(1, "a"), (2, None)] and read("one") == [(3, "c")] and read("bad") == [] and read("missing") == []


def test_splits_and_preview(spark, tmp_path):
    df = spark.range(100).selectExpr("id", "CASE WHEN id < 70 THEN 'train' ELSE 'val' END AS split")
    for _ in range(2):
        S.write_splits(df, str(tmp_path / "out"))
    assert S.read_split(spark, str(tmp_path / "out"), "val").count() == 30
    shown, more = S.preview(df, 100)
    assert shown.count() == 100 and not more and S.preview(df, 99)[1]


def test_merges_touch_their_own_source(spark, tmp_path):
    base = [(i, f"s{i % 3}" if i % 4 else None) for i in range(40)]
    table = S.SourceTable(spark, str(tmp_path / "t"))
    table.load(spark.createDataFrame(base, "id long, source string"))
    rows = lambda: sorted(((r["id"], r["source"]) for r in table.read().collect()), key=str)
    files = lambda: {(f, f.stat().st_mtime_ns) for f in (tmp_path / "t" / "rows").rglob("*.parquet")}
    assert rows() == sorted(base, key=str)
    before, new = files(), spark.createDataFrame([(100, 1.5), (101, 2.5)], "id long, extra double")
    assert table.merge(new, "s1") and before < files()
    after = files()
    want = sorted([x for x in base if x[1] != "s1"] + [(100, "s1"), (101, "s1")], key=str)
    assert rows() == want and "extra" in table.read().columns
    assert not table.merge(new.orderBy("id", ascending=False), "s1") and files() == after  # the same rows again
    table.load(spark.createDataFrame(base, "id long, source string").where("source = 's2'"))
    assert files() == after and rows() == want
    assert table.merge(new.where("false"), "s2") and rows() == [x for x in want if x[1] != "s2"]
    assert table.merge(new, "s2") and {i for i, s in rows() if s == "s2"} == {100, 101}
