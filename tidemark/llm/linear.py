"""Hashed n-gram vectors and binary logistic regressions, in numpy."""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 20


def ngrams(units: np.ndarray, orders: tuple[int, ...], dim: int) -> np.ndarray:
    """Counts of hashed n-grams of a whole text's bytes or code points, in chunks of bounded memory."""
    counts = np.zeros(dim, np.float64)
    most = max(orders)
    for i in range(0, max(len(units), 1), CHUNK):
        b = units[i : i + CHUNK + most - 1].astype(np.uint32)
        for n in orders:
            m = min(len(b) - n + 1, CHUNK)
            if m <= 0:
                continue
            h = b[:m] + np.uint32(n * 0x01000193)
            for k in range(1, n):
                h = h * np.uint32(0x9E3779B1) + b[k : m + k]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x85EBCA6B)
            counts += np.bincount(h >> np.uint32(32 - dim.bit_length() + 1), minlength=dim)
    return counts


def word_ngrams(words: list[bytes], dim: int) -> np.ndarray:
    """Counts of hashed words and word pairs."""
    counts = np.zeros(dim, np.float64)
    for i in range(0, len(words), CHUNK):
        part = words[i : i + CHUNK + 1]
        h = np.fromiter(map(crc32, part), np.uint32, len(part))
        one = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - dim.bit_length() + 1)
        counts += np.bincount(one[:CHUNK], minlength=dim)
        if len(h) > 1:
            two = (h[:-1] * np.uint32(0x85EBCA6B) + h[1:]) * np.uint32(0xC2B2AE35)
            counts += np.bincount(two >> np.uint32(32 - dim.bit_length() + 1), minlength=dim)
    return counts


def unit(counts: np.ndarray) -> np.ndarray:
    """Square roots of the shares, a vector of length one (zero stays zero)."""
    total = counts.sum()
    return np.sqrt(counts / total).astype(np.float32) if total else counts.astype(np.float32)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 0.5, l2: float = 1e-5, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of a logistic regression for each column of y (+1, -1), by Adam on all rows."""
    n, d = x.shape
    k = y.shape[1]
    w, b = np.zeros((d, k), np.float32), np.zeros(k, np.float32)
    weight = np.ones((n, 1), np.float32) if weight is None else weight.reshape(n, 1).astype(np.float32)
    weight = weight / weight.sum()
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for t in range(1, rounds + 1):
        g = -y / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30))) * weight
        for p, m, v, q in ((w, mw, vw, x.T @ g + l2 * w), (b, mb, vb, g.sum(0))):
            m *= 0.9
            m += 0.1 * q
            v *= 0.99
            v += 0.01 * q * q
            p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    return w, b


def bounded(rows: DataFrame, by: Column, key: Column, most: int) -> DataFrame:
    """The rows of about `most` keys at most of each value of by, chosen by the hash of key.

    The counts of the values of by go to the driver, so there must be few of them.
    """
    sizes = {r["k"]: r["n"] for r in rows.groupBy(by.alias("k")).agg(F.approx_count_distinct(key).alias("n")).collect()}
    if not sizes:
        return rows.where(F.lit(False))
    every = F.lit(1)
    for k, n in sizes.items():
        every = F.when(by == F.lit(k), F.lit(max(1, n // most))).otherwise(every)
    return rows.where(F.pmod(F.xxhash64(key), every) == 0)


def sparse(vector: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(vector)
    return at.astype(np.int32), vector[at].astype(np.float32)


def dense(vectors: pa.Table, dim: int) -> np.ndarray:
    """The rows (at, v) of an Arrow table as a matrix, filled row by row."""
    x, i = np.zeros((vectors.num_rows, dim), np.float32), 0
    for batch in vectors.select(["at", "v"]).to_batches():
        for at, v in zip(batch.column("at"), batch.column("v")):
            x[i, at.values.to_numpy()] = v.values.to_numpy()
            i += 1
    return x
