from pyspark.sql import functions as F

from tidemark.operators import noise as N
from tidemark.operators import matching as M
from tidemark.operators import relational as R
from tidemark.operators.ranges import number_in_groups


def test_did_you_mean(spark):
    cities = spark.createDataFrame([("Mumbai",), ("Delhi",), ("Pune",), ("Chennai",), (None,)], "v string")
    typed = spark.createDataFrame([("Mumabi",), ("mumbai",), ("Xyzzqk",), (None,)], "t string")
    got = M.did_you_mean(typed, cities).collect()
    assert {(r["typed"], r["value"]) for r in got if r["rank"] == 1} == {("Mumabi", "Mumbai")}
    roles = spark.createDataFrame([("Chief",), ("Administration",), ("Manager",)], "v string")
    best = {r["typed"]: r["value"] for r in M.did_you_mean(spark.createDataFrame([("Cheif",), ("Adminstration",)], "t string"), roles, top=1).collect()}
    assert best == {"Cheif": "Chief", "Adminstration": "Administration"}


def test_ratios():
    assert M.ratio("abc", "abc") == 100 and M.ratio("", "") == 100 and M.ratio("ab", "cd") == 0 and M.ratio("abcd", "abxd") == 75
    assert M.partial_ratio("bc", "abcd") == 100 and M.common_length("AGGTAB", "GXTXAYB") == 4


def test_not_in_with_nulls(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    assert R.not_in(df, "x", spark.createDataFrame([(1,), (None,)], "y int")).count() == 0
    assert [r[0] for r in R.not_in(df, "x", spark.createDataFrame([(1,)], "y int")).collect()] == [2]
    assert R.not_in(df, "x", spark.createDataFrame([], "y int")).count() == 2


def test_numbers_in_groups(spark):
    df = spark.range(1000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN NULL ELSE id % 3 END AS g")
    rows = number_in_groups(df, ["g"], [F.desc("id")]).collect()
    for g in (None, 1, 2):
        own = sorted((r["number"], r["id"]) for r in rows if r["g"] == g)
        assert [n for n, _ in own] == list(range(len(own))) and [i for _, i in own] == sorted((i for _, i in own), reverse=True)


def test_noise(spark):
    asked = [(i, f"Show all orders with total above {i} from the customer number {i}") for i in range(400)]
    df = spark.createDataFrame([*asked, (900, None), (901, "")], "id int, question string")
    rows = N.augment(df, "id", "question", seed=3).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, N.augment(df.repartition(7), "id", "question", seed=3).collect()))
    assert sorted(map(tuple, rows)) != sorted(map(tuple, N.augment(df, "id", "question", seed=4).collect()))
    by = {}
    for r in rows:
        by.setdefault(r["id"], []).append(r["question"].lower())
    assert all(len(v) == len(set(v)) <= 3 and dict(asked)[i].lower() not in v for i, v in by.items()) and len(by) > 350
    given = [r["question"] for r in rows if r["question"].startswith(("give me ", "tell me "))]
    assert given and not any("show " in q for q in given)  # what the new beginning stands for is gone


def test_letters_are_edited_as_named(spark):
    draws = N.Draws(F.col("id"))
    df = spark.range(4000).withColumn("word", F.lit("Water"))
    got = {r["w"] for r in df.select(N.edited(F.col("word"), draws, F.lit(0)).alias("w")).collect()}
    word, near = "Water", {"W": "QE", "a": "sq", "t": "ry", "e": "wr"}
    want = {word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(4)} | {word[:i] + word[i + 1 :] for i in range(4)} | {word[:i] + word[i] + word[i:] for i in range(4)}
    assert got == want | {word[:i] + c + word[i + 1 :] for i in range(4) for c in near[word[i]]}


def test_at_most_two_words_without_known_misspellings_are_edited(spark):
    df = spark.range(500).withColumn("q", F.lit(" ".join(["lantern"] * 30)))
    got = [r["q"].lower().split() for r in df.select(N.misspelt(F.col("q"), N.Draws(F.col("id"))).alias("q")).collect()]
    assert {sum(w not in ("lantern", "plz", "pls", "plese", "can", "u", "i", "want", "gimme") for w in ws) for ws in got} == {0, 1, 2}


def test_containment(spark):
    words = " ".join(f"w{i}" for i in range(40))
    items = spark.createDataFrame([(1, words), (2, words + " x"), (3, "w1 w2"), (4, "nope")], "item_id int, text string")
    docs = spark.createDataFrame([("start " + words + " end",), (None,), ("",)], "text string")
    got = {r["item_id"]: r["contained"] for r in M.contained_in(items, "item_id", "text", docs, "text").collect()}
    assert got == {1: True, 2: False, 3: True, 4: False}


def test_containment_matches_plain_search(spark):
    import random

    r = random.Random(4)
    texts = [" ".join(r.choices("abc", k=r.randint(0, 30))) for _ in range(60)]
    items = [" ".join(r.choices("abc", k=r.randint(1, 14))) for _ in range(150)] + [t[3:-2] for t in texts if len(t) > 12]
    rows = M.contained_in(spark.createDataFrame(list(enumerate(items)), "item_id int, text string"), "item_id", "text", spark.createDataFrame([(t,) for t in texts], "text string"), "text").collect()
    assert {r["item_id"]: r["contained"] for r in rows} == {i: any(x in t for t in texts) for i, x in enumerate(items)}


def test_containment_of_odd_items_in_several_automata(spark, monkeypatch):
    monkeypatch.setattr(M, "AUTOMATON_CHARS", 20)
    items = spark.createDataFrame([(1, "abc"), (2, ""), (3, None), (4, "bc d"), (5, "zz"), (6, "abc"), (7, "é\n日"), (8, "x" * 50)], "k int, t string")
    docs = spark.createDataFrame([("xabc d",), (None,), ("é\n日本",), ("",)], "d string")
    got = {r["k"]: r["contained"] for r in M.contained_in(items, "k", "t", docs, "d").collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: False, 6: True, 7: True, 8: False}
    plan = M.contained_in(items, "k", "t", docs, "d")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
