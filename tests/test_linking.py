import math
import random

from tidemark.operators import matching as M


def plain_links(questions, targets, top):
    """Cosines of all pairs."""

    def grams(text):
        w = [x for x in text.split() if len(x) > 1]
        return w + [f"{a} {b}" for a, b in zip(w, w[1:])]

    df = {}
    for _, t in targets:
        for g in set(grams(t)):
            df[g] = df.get(g, 0) + 1
    idf = {g: math.log((1 + len(targets)) / (1 + n)) + 1 for g, n in df.items()}

    def vector(text):
        v = {}
        for g in grams(text):
            if g in idf:
                v[g] = v.get(g, 0) + idf[g]
        n = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / n for g, x in v.items()}

    vs, out = [(n, vector(t)) for n, t in targets], set()
    for k, q in questions:
        q = vector(q)
        scored = sorted(((round(sum(x * v.get(g, 0) for g, x in q.items()), 6), n) for n, v in vs), key=lambda r: (-r[0], r[1]))
        out |= {(k, n, s, i + 1) for i, (s, n) in enumerate(scored[:top]) if s > 0}
    return out


def test_links_match_all_pairs(spark, monkeypatch):
    r = random.Random(5)
    words = ["the"] * 30 + [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    targets, questions = [(i, text(r.randint(1, 12))) for i in range(120)], [(i, text(r.randint(0, 25))) for i in range(60)]
    tf, qf = spark.createDataFrame(targets, "name int, text string"), spark.createDataFrame([*questions, (99, None)], "k long, text string")
    for rows, top in ((200_000, 1), (200_000, 3), (150, 3)):  # the last in several indexes
        monkeypatch.setattr(M, "INDEX_ROWS", rows)
        got = {tuple(x) for x in M.tfidf_link(qf, "k", "text", tf, "name", "text", top=top).collect()}
        assert got == plain_links(questions, targets, top)


def test_long_lists_are_not_read():
    index = M.TermIndex([("the", n, 0.01, 1.0) for n in range(10_000)] + [(f"w{n}", n, 1.0, 5.0) for n in range(10)])
    got = dict((n, s) for s, n in index.best(index.weighted(["the", "w1", "w2", "w3"]), 3))
    assert set(got) == {1, 2, 3} and abs(got[1] - 5.01) < 1e-12


def test_schema_links(spark):
    schema = spark.createDataFrame([("orders", "order_id"), ("orders", "amount"), ("customers", "name"), ("customers", "city"), ("customers", "amount"), ("customers", None), ("a", "b1"), (None, "x")], "table string, column string")
    asked = spark.createDataFrame([(1, "the amount of orders"), (2, "nothing known"), (3, None)], "k int, q string")
    rows = M.link_schema(asked, "k", "q", schema, top=2).collect()
    first = {(r["k"], r["table_rank"], r["column_rank"]): (r["table"], r["column"]) for r in rows}
    assert first[1, 1, 1] == ("orders", "amount") and first[2, 1, 1] == ("a", "b1") and first[2, 2, 1] == ("customers", "amount") and first[3, 1, 1] == ("a", "b1")
    confident = {r["confidence"] for r in rows if r["k"] == 1 and r["table"] == "orders"}
    scores = [r["column_score"] for r in rows if r["k"] == 1 and r["table"] == "orders"]
    assert len(confident) == 1 and abs(confident.pop() - sum(scores) / 2) < 1e-6 and scores[0] > 0
