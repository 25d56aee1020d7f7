import re
from collections import Counter

import compare
from pyspark.sql import functions as F

from tidemark.llm import quality, queries


def plain_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_base_matches_brute_force(spark):
    docs = spark.read.parquet(f"{compare.SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = [r for r in queries.op2_quality_rules(spark, compare.SF).collect() if r["doc_id"] in texts]
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r[c] for c in COLUMNS) == plain_statistics(texts[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])


def test_kinds_of_text(spark):
    for t in ("a b c a b c", "a b c d", "a\x1cb c\x85d é", "x\n\nx\n \nx", "", None, "aa " * 30 + "b c d e f g", "a b a b a b a", "##$ <a> |"):
        data = (t or "").encode()
        assert quality.statistics(data, len(t or ""), data.split()) == plain_statistics(t)


def test_held_out_verdicts(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.train(docs, labels.where("doc_id % 3 <> 0"))
    rows = quality.assess(docs, model, ["doc_id"]).join(labels.where("doc_id % 3 = 0"), "doc_id").where(~F.col("base_failed")).collect()
    assert len(rows) > 60
    assert sum(r["kept"] == (r["quality"] == 1) for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["probability"] <= 1 for r in rows)


def test_odd_rows(spark, odd_docs, no_docs):
    docs, labels = spark.read.parquet(f"{compare.SF}/documents.parquet"), spark.read.parquet(f"{compare.SF}/labels.parquet")
    model = quality.train(docs, labels.unionByName(labels.limit(1)).unionByName(spark.createDataFrame([(None, 1, 0), (1, None, 0)], labels.schema)))
    rows = quality.assess(odd_docs, model, ["doc_id"]).collect()
    assert len(rows) == odd_docs.count()
    assert all(r["n_words"] == 0 and r["base_failed"] for r in rows if r["doc_id"] in (3, 4, 6))
    assert {r["base_failed"] for r in rows if r["doc_id"] == 5} == {True}  # one word again and again
    left = quality.keep_good(odd_docs, model)
    assert left.columns == odd_docs.columns and left.count() == 0
    assert quality.train(no_docs, labels) is None and quality.train(docs, labels.where("false")) is None
    assert quality.assess(no_docs, model, ["doc_id"]).count() == 0
    assert quality.keep_good(docs, None).count() == sum(not plain_statistics(r["text"])[-1] for r in docs.collect())


def test_verdicts_match_plain_ngrams(spark):
    """The model's probability from n-grams counted in dictionaries, over code points and not bytes."""
    import math
    import zlib

    sf, mask, shift = "/root/testdata/sf0.01", 0xFFFFFFFF, 33 - quality.DIM.bit_length()
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, labels)
    some = docs.where("n_chars between 300 and 2500").limit(40)
    texts = {r["doc_id"]: r["text"] for r in some.collect()}
    for r in quality.assess(some, model, ["doc_id"]).where("probability is not null").collect():
        text = texts[r["doc_id"]]
        words, points = [zlib.crc32(w.encode()) for w in re.findall(r"[^\x20\x09-\x0D]+", text)], [ord(c) for c in text]
        by_word = Counter((w * 0x9E3779B1 & mask) >> shift for w in words)
        by_word.update(((((a * 0x85EBCA6B & mask) + b) & mask) * 0xC2B2AE35 & mask) >> shift for a, b in zip(words, words[1:]))
        by_char = Counter()
        for n in quality.ORDERS:
            for i in range(len(points) - n + 1):
                h = points[i] + n * 0x01000193
                for k in range(1, n):
                    h = (h * 0x9E3779B1 + points[i + k]) & mask
                by_char[((h ^ h >> 15) * 0x85EBCA6B & mask) >> shift] += 1
        z = model.bias + sum(math.sqrt(c / sum(by.values())) * float(model.weights[h + base]) for by, base in ((by_word, 0), (by_char, quality.DIM)) for h, c in by.items())
        p = 1 / (1 + math.exp(-model.slope * z - model.offset))
        assert math.isclose(p, r["probability"], rel_tol=1e-3, abs_tol=1e-6) and r["kept"] == (r["probability"] >= 0.5)


def test_sparse_rows_become_the_dense_ones_they_were():
    import numpy as np
    import pyarrow as pa

    from tidemark.llm import linear

    r = np.random.default_rng(2)
    x = (r.random((700, 40)) * (r.random((700, 40)) < 0.2)).astype(np.float32)
    at, v = zip(*map(linear.sparse, x))
    rows = pa.concat_tables([pa.table({"at": pa.array([a.tolist() for a in at[i : i + 300]], pa.list_(pa.int32())), "v": pa.array([b.tolist() for b in v[i : i + 300]], pa.list_(pa.float32()))}) for i in range(0, 700, 300)])
    assert np.array_equal(linear.dense(rows, 40), x)
