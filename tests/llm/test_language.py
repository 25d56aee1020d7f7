import math

import compare
import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import language, queries


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = queries.op1_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 100
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_held_out_rows_are_those_whose_checksum_divides_by_five(spark):
    import zlib

    rows = spark.range(200).select("id", language.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)


def test_predictions_depend_on_the_text_alone(spark):
    docs = spark.read.parquet(f"{compare.SF}/documents.parquet")
    model = language.train_on_documents(docs)
    shuffled = docs.select((F.col("doc_id") + 7).alias("doc_id"), "text", F.lit("xx").alias("lang"), F.lit("s").alias("source"))
    a = {r["text"]: r["lang_pred"] for r in language.predict(docs, model, ["text"]).collect()}
    assert a == {r["text"]: r["lang_pred"] for r in language.predict(shuffled, model, ["text"]).collect()}


def test_odd_rows(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{compare.SF}/documents.parquet")
    model = language.train_on_documents(docs)
    rows = language.predict(odd_docs, model, ["doc_id", "text"]).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters)
        assert letters or (r["score"], r["ambiguous"]) == (0.0, True)
    kept = language.keep_known(odd_docs, model)
    assert kept.columns == odd_docs.columns
    nothing = language.train_on_documents(no_docs)
    assert nothing.languages == [] and {r["lang_pred"] for r in language.predict(docs, nothing, ["doc_id"]).collect()} == {"und"}
    assert language.predict(no_docs, model, ["doc_id"]).count() == 0


def test_codewords_stay_apart():
    for k in (2, 3, 4, 7, 12, 50):
        code = language.codewords(k)
        gaps = [(code[i] != code[j]).sum() for i in range(k) for j in range(i)]
        assert len(np.unique(code, axis=0)) == k and min(gaps) >= (1 if k < 3 else code.shape[1] // 4)


def plain_margins(text, model):
    """The bits' margins from n-grams counted in a dictionary."""
    data, counts, mask = (" " + text.lower() + " ").encode(), {}, 0xFFFFFFFF
    for n in language.ORDERS:
        for i in range(len(data) - n + 1):
            h = data[i] + n * 0x01000193
            for k in range(1, n):
                h = (h * 0x9E3779B1 + data[i + k]) & mask
            h = ((h ^ h >> 15) * 0x85EBCA6B & mask) >> (33 - language.DIM.bit_length())
            counts[h] = counts.get(h, 0) + 1
    total = sum(counts.values())
    return [sum(math.sqrt(c / total) * float(model.weights[h, b]) for h, c in counts.items()) + float(model.bias[b]) for b in range(model.code.shape[1])]


def test_predictions_match_a_plain_decoding(spark):
    """Codewords by definition, bits by plain n-gram counts, then the codeword with the smallest sum of logistic losses."""
    docs = spark.read.parquet(f"{compare.SF}/documents.parquet").where("n_chars < 3000")
    model = language.train_on_documents(docs)
    k = len(model.languages)
    assert k > 2 and model.code.tolist() == [[1 if c == 0 or not (b + 1) & (1 << (c - 1)) else -1 for b in range(2 ** (k - 1) - 1)] for c in range(k)]
    for r in language.predict(docs, model, ["doc_id", "text"]).collect():
        if not any(map(str.isalpha, r["text"] or "")):
            assert r["lang_pred"] == "und"
            continue
        margins = plain_margins(r["text"], model)
        loss = [sum(math.log1p(math.exp(-c * m)) for c, m in zip(word, margins)) for word in model.code.tolist()]
        share = sorted((math.exp(min(loss) - x) for x in loss), reverse=True)
        assert r["lang_pred"] == model.languages[loss.index(min(loss))] and math.isclose(r["score"], share[0] / sum(share), rel_tol=1e-3)
        assert r["ambiguous"] == ((share[0] - share[1]) / sum(share) < model.ambiguous_below)


def test_clashing_names(spark):
    docs = spark.read.parquet(f"{compare.SF}/documents.parquet")
    model = language.train_on_documents(docs)
    odd = docs.selectExpr("doc_id AS `a.b`", "text", "1 AS said", "2 AS `_said`", "3 AS score")
    out = language.predict(odd, model, ["a.b", "said", "_said", "score"])
    assert out.columns == ["a.b", "said", "_said", "score", "lang_pred", "score", "ambiguous"] and out.count() == docs.count()


def test_one_key_on_many_rows_gives_one_training_text(spark):
    rows = [(1, "ein kleiner Text mit Worten", "de")] * 500 + [(i, f"a small text with words {i}", "en") for i in range(2, 20)]
    model = language.train(spark.createDataFrame(rows, "k bigint, text string, lang string"), "k", "text", "lang", 10)
    assert model.languages == ["de", "en"] and model.predict("ein Text mit Worten")[0] == "de"
