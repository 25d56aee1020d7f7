from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import words as W


def values(spark, rows, *columns):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def plain_hints(text, legacy=False):
    """Phrases from the longest, each at its first occurrence, unless it overlaps one with another keyword."""
    import re

    body = text.lower() if legacy else " " + re.sub(r"[^\w]", " ", text.lower()) + " "
    spans, found = [], set()
    for p in sorted(W.KEYWORDS, key=len, reverse=True):
        at = body.find(p if legacy else f" {p} ")
        k = W.KEYWORDS[p]
        if at >= 0 and not any(at < e and at + len(p) > b and k != o for b, e, o in spans):
            spans.append((at, at + len(p), k))
            found.add(k)
    return sorted(found)


QUESTIONS = [
    "Show all staff where salary above 40000",
    "How many orders per city with their totals",
    "total rows in orders",
    "Top 5 products ordered by price, or the lowest",
    "list employees not more than 30 and at least 3 in order",
    "Which of them cost less than 20?",
    "Give the average, maximum and minimum of each department",
    "",
]


def test_keyword_hints(spark):
    got = values(spark, QUESTIONS, X.keyword_hints(F.col("t")), X.keyword_hints(F.col("t"), legacy=True))
    assert got == [(plain_hints(q), plain_hints(q, True)) for q in QUESTIONS]
    assert "ORDER BY" not in got[1][0] and "ORDER BY" in got[1][1]  # "order" in "orders" counts only as a substring


def test_hint_intents(spark):
    got = values(spark, QUESTIONS, X.hint_intent(X.keyword_hints(F.col("t"))))
    assert [g[0] for g in got] == ["SELECT_WHERE", "SELECT_JOIN", "SELECT_AGGREGATE", "SELECT", "SELECT", "SELECT", "SELECT_GROUP", "SELECT"]


def test_follow_ups(spark):
    said = ["how many of them are there", "sort them by price", "now only those from Pune", "also show the city", "but only managers", "those with price above 10", "show me those", "list all hotels"]
    got = values(spark, said, X.follow_up(F.col("t"), F.lit(False)), X.follow_up(F.col("t"), F.lit(True)))
    assert [g[0] for g in got] == ["aggregate", "sort_add", "filter_add", "filter_add", "filter_refine", "filter_add", "full_reference", "independent"]
    assert {g[1] for g in got} == {"independent"}


def test_cleaning(spark):
    got = values(spark, ["  What's\tUP?! .", "Really...!?", "é É ?", None], X.clean_question(F.col("t")), X.clean_question(F.col("t"), True), X.normalize(F.col("t")))
    assert got == [("what's up?!", "what's up", "what is up"), ("really...", "really", "really"), ("é é", "é é", "é é"), (None, None, None)]


def test_sql_tokens(spark):
    got = values(spark, ["Select a.B,count(*) from T where x>='It s' and y!=3 group by z", "x ! y 'open end"], X.tokenize_sql(F.col("t")))
    assert got[0][0] == ["SELECT", "a.b", ",", "COUNT", "(", "*", ")", "FROM", "t", "WHERE", "x", ">=", "'It s'", "AND", "y", "!=", "3", "group", "by", "z"]
    assert got[1][0] == ["x", "!", "y", "'open end"]


def test_sql_intents(spark):
    rows = ["SELECT a FROM ADMINISTRATION", "SELECT a FROM t WHERE x IN (SELECT y FROM u)", "SELECT a FROM t GROUP BY a HAVING a > 1", "SELECT a FROM t GROUP BY a"]
    got = values(spark, rows, *[X.sql_intent(F.col("t"), r) for r in "abc"])
    assert got == [("SELECT_AGGREGATE",) * 3, ("SELECT_WHERE", "SELECT_WHERE", "COMPLEX"), ("SELECT", "COMPLEX", "SELECT_GROUP"), ("SELECT", "SELECT", "SELECT_GROUP")]
