import pytest

LONG = "word " * 60_000 + "end"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, columns whose names the operators use themselves."""
    rows = [
        (1, "The same text.", "en", "a", 14),
        (2, "The  same\ttext.", "en", "b", 15),
        (3, None, None, None, None),
        (4, "", "fr", "a", 0),
        (5, LONG, "en", "a", len(LONG)),
        (5, LONG, "en", "a", len(LONG)),
        (None, "The same text.", "en", "a", 14),
        (None, None, None, None, None),
        (6, " \n\t ", "de", None, 4),
        (7, "12 34 !!", None, "a", 8),
        (8, "ünï 日本 \U0001f600 \x00 mixed", "de", "c", 20),
        (9, "x", "en", "a", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for c in ("at", "fp", "id", "keep", "digest", "row", "n", "kept", "score", "gone", "component_id", "file"):
        df = df.selectExpr("*", f"'extra' AS `{c}`")
    return df


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
