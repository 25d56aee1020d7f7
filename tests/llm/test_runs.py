import random
from hashlib import sha256
from zlib import crc32

import compare
import numpy as np

from tidemark.llm import ntt, queries, runs


def plain_runs(words):
    """(start, length, period) of every run, by comparing the text with itself at every distance."""
    known, n, best = {}, len(words), {}
    w = np.array([known.setdefault(x, len(known)) for x in words], np.int64)
    for q in range(1, n // 2 + 1):
        same = np.concatenate([[0], (w[q:] == w[:-q]).astype(np.int8), [0]])
        edges = np.flatnonzero(np.diff(same))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            length = b - a + q
            if length >= max(12, 2 * q):
                best.setdefault((a, length), q)
    return sorted([(s, n, q) for (s, n), q in best.items()], key=lambda r: (r[0], r[2]))


def expected(key, text):
    words = [x for x in (text or "").encode().split()]
    h, n = crc32(str(key).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    top = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    longest = (top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4
    return len(found), *longest, sha256(lines.encode()).hexdigest(), sha256(kept).hexdigest()


COLUMNS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_query_matches_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{compare.SF}/documents.parquet").collect()}
    rows = queries.op12_periodic_runs(spark, compare.SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        assert tuple(r[c] for c in COLUMNS) == expected(r["doc_id"], docs[r["doc_id"]]), r["doc_id"]
    assert sum(r["n_runs"] > 0 for r in rows) > len(rows) / 20


def test_random_texts_of_few_words():
    rng = random.Random(7)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(0, 6)):
            n, k = rng.choice([0, 1, 11, 12, 40, 200]), rng.randint(1, 6)
            words = [b"%d" % rng.randrange(k) for _ in range(n)]
            if n > 10 and rng.random() < 0.5:
                a = rng.randrange(n)
                p = 1 + rng.randrange(max(1, (n - a) // 2))
                words = words[:a] + [words[a + i % p] for i in range(n - a)]
            texts.append(words)
        assert [[tuple(r) for r in f.tolist()] for f in runs.runs(texts)] == [plain_runs(t) for t in texts]


def test_words_that_repeat_in_patterns():
    thue, fib = b"a", [b"a", b"b"]
    for _ in range(10):
        thue += thue.translate(bytes.maketrans(b"ab", b"ba"))
    for _ in range(13):
        fib.append(fib[-1] + fib[-2])
    for text in (thue, fib[-1], b"a" * 700, b"ab" * 300 + b"a", b"a" * 50 + b"b" + b"a" * 50 + b"b" + b"a" * 50, b"abc" * 4, b"abc" * 3 + b"ab", b"abcdef" * 2):
        words = [bytes([c]) for c in text]
        assert [tuple(r) for r in runs.runs([words])[0].tolist()] == plain_runs(words)


def test_long_repeats_take_little_work():
    assert runs.runs([[b"a"] * 100_000])[0].tolist() == [[0, 100_000, 1]]
    assert runs.runs([[b"%d" % (i % 30_000) for i in range(90_000)]])[0].tolist() == [[0, 90_000, 30_000]]  # sums beyond one prime


def test_transforms_are_exact():
    rng = np.random.default_rng(3)
    for p, root in ntt.PRIMES:
        blocks, windows = rng.integers(0, p, (3, 5)), np.zeros((3, 16), np.int64)
        windows[:, :12] = rng.integers(0, p, (3, 12))
        got = ntt.correlations(blocks.astype(np.uint64), windows.astype(np.uint64), p, root)
        for r in range(3):
            for t in range(8):
                assert int(got[r, t]) == sum(int(blocks[r, i]) * int(windows[r, t + i]) for i in range(5)) % p
    assert len(ntt.primes_for(10**9)) == 1 and len(ntt.primes_for(10**12)) == 2


def test_odd_rows(spark, odd_docs, no_docs):
    rows = runs.find_runs(odd_docs).collect()
    assert len(rows) == odd_docs.count() and rows[0].__fields__[:3] == ["doc_id", "runs", "collapsed"]
    long = [r for r in rows if r["doc_id"] == 5]
    assert len(long) == 2 and long[0] == long[1]
    assert [tuple(x) for x in long[0]["runs"]] == [(0, 60_000, 1)] and long[0]["collapsed"] == "word end"
    empty = sha256(b"").hexdigest()
    for r in rows:
        if r["doc_id"] in (3, 4, 6):
            assert (r["n_words"], r["n_runs"], r["start"], r["runs_sha256"], r["collapsed_sha256"]) == (0, 0, None, empty, empty)
    assert runs.describe_runs(no_docs).count() == 0 and runs.describe_runs(odd_docs, plant=True).count() == odd_docs.count()
