import random

import compare
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidemark.llm import queries, simhash


def plain_fingerprint(text):
    """The contract, word by word."""
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Smallest id that each id reaches over links of two bits or fewer, pair by pair."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_query_matches_brute_force(spark):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op10_simhash_near_dedup(spark, compare.SF).collect()}
    prints = {i: plain_fingerprint(t) for i, t in spark.read.parquet(f"{compare.SF}/documents.parquet").select("doc_id", "text").collect()}
    parts = plain_components(prints)
    assert got == {i: (f"{p:016x}", parts[i]) for i, p in prints.items()}


def test_dense_groups_and_chains(spark):
    r = random.Random(3)
    prints = []
    for _ in range(12):
        base = r.getrandbits(64)
        for _ in range(40):  # a dense cloud, so that every cell holds many
            x = base
            for b in r.sample(range(64), r.randint(0, 3)):
                x ^= 1 << b
            prints.append(x)
        x = r.getrandbits(64)
        for _ in range(25):  # a chain of two-bit steps
            prints.append(x)
            for b in r.sample(range(64), 2):
                x ^= 1 << b
    prints += [0, 2**64 - 1, 2**64 - 4, 1 << 63, 3 << 62, 7 << 61]
    signed = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    df = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    roots = {row["a"]: row["root"] for row in simhash.components(simhash.links(simhash.near_on_grid(df))).collect()}
    want = plain_components({p: p & (2**64 - 1) for p in signed})
    assert {p: roots.get(p, p) for p in signed} == want


def test_counts_bound_the_hamming_distance(spark):
    r = random.Random(5)
    rows = [(a - (1 << 63), (a ^ (1 << r.randrange(63)) ^ (1 << r.randrange(63))) - (1 << 63)) for a in (r.getrandbits(63) * 2 for _ in range(200))]
    df = spark.createDataFrame(rows, "a bigint, b bigint")
    digits = lambda c: [F.shiftrightunsigned(simhash.popcounts(F.col(c)), i).bitwiseAND(F.lit(3)) for i in range(0, 64, 2)]
    apart = sum((F.abs(x - y) for x, y in zip(digits("a"), digits("b"))), F.lit(0))
    for row in df.select("a", F.array(*digits("a")).alias("c"), apart.alias("d"), F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("h")).collect():
        assert row["d"] <= row["h"] <= 2
        bits = row["a"] & (2**64 - 1)
        assert row["c"] == [(bits >> i & 3).bit_count() for i in range(0, 64, 2)]


def test_odd_rows(spark, odd_docs, no_docs):
    rows = simhash.simhash_groups(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    zero = [r for r in rows if r["fp"] == 0]
    assert len(zero) == 4 and {r["component_id"] for r in zero} == {3}  # null, empty and blank texts
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    left = simhash.keep_one(odd_docs)
    assert left.columns == odd_docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in left.where("doc_id is not null").select("doc_id", "text").collect())) == sorted({(r["doc_id"], r["text"]) for r in odd_docs.where("doc_id in (1, 3, 5, 7, 8, 9)").select("doc_id", "text").collect()})
    assert left.where("doc_id is null").count() == 2
    assert simhash.simhash_groups(no_docs).count() == 0 and simhash.keep_one(no_docs).count() == 0


def test_long_texts_are_hashed_whole():
    words = [str(i) for i in range(70_000)]
    assert simhash.fingerprint(" ".join(words)) & (2**64 - 1) == plain_fingerprint(" ".join(words))


def test_rows_are_kept_one_by_one(spark):
    text = " ".join(f"a{i}" for i in range(60))
    docs = [(1, text), (2, text), (2, " ".join(f"b{i}" for i in range(60))), (3, text), (3, text), (4, " ".join(f"c{i}" for i in range(60)))]
    left = [tuple(r) for r in simhash.keep_one(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()]
    assert sorted(left) == sorted([docs[0], docs[2], docs[5]])
