from fractions import Fraction
from math import floor

import compare
import numpy as np

from tidemark.llm import queries, whitening


def plain(vectors):
    """n, sums, whole entries of each id, covariance, by whole numbers."""
    x = {k: [floor(64 * c) + 1_000_000 for c in map(float, v)] for k, v in vectors.items()}
    fit = sorted({tuple(v) for v in x.values()})
    n, dim = len(fit), len(fit[0])
    s = [sum(v[j] for v in fit) for j in range(dim)]
    z = np.array([[n * a - b for a, b in zip(v, s)] for v in fit], object)
    covariance = (z.T @ z) / Fraction(n) ** 3
    return n, s, x, covariance.astype(float)


def check(rows, vectors, components=16):
    n, s, x, covariance = plain(vectors)
    values, axes = np.linalg.eigh(covariance)
    order = np.argsort(-values)[:components]
    values, axes, trace = values[order], axes[:, order], np.trace(covariance)
    got = {}
    for r in rows:
        got.setdefault(r["vec_id"], {})[r["component"]] = r
    assert set(got) == set(x)
    signs = None
    for key, by in got.items():
        assert sorted(by) == [*range(1, len(values) + 1)]
        deviation = sum((n * a - b) ** 2 for a, b in zip(x[key], s))
        z = np.array([float(Fraction(n * a - b, n)) for a, b in zip(x[key], s)])
        want, have = z @ axes / np.sqrt(values), np.array([by[i]["whitened"] for i in sorted(by)])
        signs = np.sign(want * have) if signs is None else signs
        assert np.allclose(signs * have, want, rtol=1e-8, atol=1e-8)
        assert {r["n"] for r in by.values()} == {n} and {r["deviation"] for r in by.values()} == {deviation}
        assert np.allclose([by[i]["explained"] for i in sorted(by)], values / trace, rtol=1e-9)
        assert all(r["identity_error"] < 1e-9 for r in by.values())


def test_query_matches_brute_force(spark):
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{compare.SF}/embeddings.parquet").collect()}
    check(queries.op13_whitening(spark, compare.SF).collect(), vectors)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 7), float(i * i % 11) / 3, i / 50.0]) for i in range(40)]
    odd = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, nan, 2.0]), (103, [1.0, -inf, 2.0]), (104, []), (105, [1.0]), (106, [1.0, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame(rows + odd + rows[:5] + [(None, rows[3][1])], "vec_id bigint, embedding array<float>").selectExpr("*", "1 AS x", "2 AS said", "3 AS component", "4 AS n", "5 AS place")
    got = whitening.whiten(df).collect()
    assert len(got) == 3 * 46  # repeated rows and the null id have rows of their own
    check([r for r in got if r["vec_id"] is not None], {k: np.array(v, np.float32) for k, v in rows})
    assert whitening.whiten(df.where("false")).columns == whitening.whiten(df).columns
    assert whitening.whiten(df.where("false")).count() == whitening.whiten(df.where("vec_id > 102 and vec_id < 105")).count() == 0
    one = whitening.whiten(df.where("vec_id = 1")).collect()
    assert len(one) == 6 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one} == {(1, 0, None, None, None)}


def test_entries_without_variance_and_large_ones(spark):
    rows = [(i, [1.0, float(i % 5), float(i % 5) * 2.0]) for i in range(20)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert all((r["whitened"] is None) == (r["component"] > 1) and r["identity_error"] < 1e-9 for r in got)
    assert {r["explained"] for r in got if r["component"] > 1} == {0.0}
    far = [(i, [1e9 * i, 1e300 if i == 3 else -1e9 * (i % 3)]) for i in range(8)]
    got = whitening.whiten(spark.createDataFrame(far, "vec_id bigint, embedding array<double>")).collect()
    assert len(got) == 16 and all(r["identity_error"] < 1e-9 and r["deviation"] is None for r in got)


def test_products_are_exact_in_every_form(spark):
    rows = [(i, [float(i), 3e6 * (i % 3), -7.0 * i * i]) for i in range(50)]  # products beyond 2^53
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").select(whitening.whole_entries(whitening.F.col("embedding")).alias("x"))
    x = [[floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    n, s = whitening.sums(df, 3)
    assert (n, s) == (50, [sum(v[j] for v in x) for j in range(3)])
    centre = [c // n for c in s]
    assert whitening.products(df, 3, centre) == [[sum((v[i] - centre[i]) * (v[j] - centre[j]) for v in x) for j in range(3)] for i in range(3)]


def test_clustered_eigenvalues():
    rng = np.random.default_rng(5)
    for values in (np.linspace(1, 64, 64), np.r_[np.full(5, 10), 10 + np.arange(5) * 1e-9, 10 + np.arange(5) * 1e-13, np.linspace(1, 3, 49)], np.r_[np.zeros(40), np.linspace(1, 2, 24)], [3.0], 10.0 ** -np.arange(20)):
        q, eye = np.linalg.qr(rng.normal(size=(len(values), len(values))))[0].astype(np.longdouble), np.eye(len(values))
        for _ in range(3):
            q = q + q @ (eye - q.T @ q) / 2
        a = q @ np.diag(np.array(values, np.longdouble)) @ q.T
        a = (a + a.T) / 2
        e, x = whitening.eigen(a)
        assert np.abs(e - np.sort(values)[::-1]).max() < 1e-16 * max(values)
        assert np.abs(a @ x - x * e).max() < 1e-16 * max(values) and np.abs(x.T @ x - eye).max() < 1e-17
    assert np.array_equal(whitening.eigen(np.zeros((3, 3), np.longdouble))[1], np.eye(3))
