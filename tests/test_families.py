import random

from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import families as Y
from tidemark.operators import noise as N


def plain_families(rows):
    root = {k: k for k, *_ in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    seen = {}
    for k, *values in rows:
        for i, v in enumerate(values):
            if v is not None:
                a, b = find(k), find(seen.setdefault((i, v), k))
                root[max(a, b)] = min(a, b)
    return {k: find(k) for k in root}


def test_families_match_union_find(spark):
    r = random.Random(2)
    rows = [(i, r.choice([None, *"abcdefghij" * 3, *map(str, range(80))]), r.choice([None, *map(str, range(150))])) for i in range(200)]
    got = {x["k"]: x["family"] for x in Y.families(spark.createDataFrame(rows, "k long, a string, b string"), "k", ["a", "b"]).collect()}
    assert got == plain_families(rows) and 3 < len(set(got.values())) < 150


def test_long_chains_and_common_values(spark):
    chain = [(i, f"x{i // 2}", f"y{(i + 1) // 2}") for i in range(65)]
    star = [(100 + i, "same", None) for i in range(500)]
    got = {x["k"]: x["family"] for x in Y.families(spark.createDataFrame(chain + star, "k long, a string, b string"), "k", ["a", "b"]).collect()}
    assert got == plain_families(chain + star) and set(got.values()) == {0, 100}


def test_noisy_variants_stay_with_their_question(spark):
    asked = spark.createDataFrame([(i, f"Show all orders with total above {i % 150} from the customer") for i in range(200)] + [(900, None)], "id long, question string")
    noisy = N.augment(asked, "id", "question", seed=3)
    rows = asked.withColumn("variant", F.lit(-1)).unionByName(noisy).withColumn("row", F.concat_ws("/", "id", "variant"))
    got = Y.family_split(rows, "row", ["id", X.clean_question(F.col("question"))]).collect()
    assert len(got) == rows.count() > 500 and all(r["split"] in ("train", "val", "test") for r in got)
    for of in (lambda r: r["id"], lambda r: r["family"], lambda r: r["id"] % 150 if r["id"] < 200 else -1):  # the same question was asked twice
        splits = {}
        for r in got:
            splits.setdefault(of(r), set()).add(r["split"])
        assert {len(s) for s in splits.values()} == {1}
    assert len({r["split"] for r in got}) == 3


def test_no_rows(spark):
    none = spark.createDataFrame([], "k long, a string")
    assert Y.family_split(none, "k", ["a"]).count() == 0
    assert [tuple(r) for r in Y.families(spark.createDataFrame([(1, None), (2, "a")], "k long, a string"), "k", ["a"]).orderBy("k").collect()] == [(1, None, 1), (2, "a", 2)]
