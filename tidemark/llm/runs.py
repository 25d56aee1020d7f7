"""Periodic runs of words, by block convolution.

Of a run with period q, the words that come again q words later are q at least, so at the dyadic scale
b with 2b <= q < 4b they hold a whole aligned block of b words, and that block comes again without a
mismatch q words later. At each scale, number-theoretic transforms give the exact sums of squared
differences of a block and every place of the window that follows it; sums of zero are its occurrences.
Their distances are seeds: consecutive blocks with one distance are joined and extended word by word.

The texts of a batch are set end to end with a word of its own after each, which no run can hold, so all
blocks of a scale are rows of one transform.
"""

from __future__ import annotations

from hashlib import sha256
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ntt
from .common import text_batches

#: Least words of a run, and least periods it holds.
LEAST_WORDS, LEAST_PERIODS = 12, 2
#: Block of the first scale, which finds all periods below that of the next: a stretch of LEAST_WORDS less such a period holds a block.
FIRST_BLOCK = 2
#: Entries of the windows that are transformed at once.
ENTRIES = 1 << 20


def end_to_end(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of all texts, where each text begins, and for each place how far it is to the same word of the same text (far where there is none).

    Equal words of a text have equal numbers, as small as the text allows; before, between and after the
    texts stand numbers that come once.
    """
    rows, least = [], 0
    for words in texts:
        known: dict[bytes, int] = {}
        rows.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
        least = max(least, len(known))
    sizes = np.array([len(r) for r in rows], np.int64)
    begin = np.cumsum(sizes + 1) - sizes
    w = np.empty(int(sizes.sum()) + len(rows) + 1, np.int64)
    owner = np.zeros(len(w), np.int64)
    w[0] = least
    for i, (at, row) in enumerate(zip(begin.tolist(), rows)):
        w[at : at + len(row)], w[at + len(row)] = row, least + i + 1
        owner[at : at + len(row) + 1] = i
    order = np.argsort(owner * (int(w.max()) + 1) + w, kind="stable")
    again = np.full(len(w), len(w), np.int64)
    same = (w[order[1:]] == w[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    again[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return w, begin, again


class Known:
    """Runs found so far, ordered by start: for a place, the end and period of the one that reaches farthest of those that begin at it or before."""

    def __init__(self, start: np.ndarray, length: np.ndarray, period: np.ndarray):
        end, at = start + length, np.arange(len(start))
        farthest = np.maximum.accumulate(end)
        best = np.maximum.accumulate(np.where(end == farthest, at, 0)) if len(end) else at
        self.start, self.end, self.period = start, end[best], period[best]

    def at(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.start):
            return np.zeros(len(place), np.int64), np.ones(len(place), np.int64)
        i = np.searchsorted(self.start, place, "right") - 1
        return np.where(i < 0, 0, self.end[i]), self.period[i]


def occurrences(w: np.ndarray, again: np.ndarray, known: Known, block: int, nearest: int, farthest: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of an aligned block and distance, for every place nearest to farthest words on where it comes again.

    Blocks with a word that doesn't come again within the farthest distance can't do so, and aren't transformed.
    Nor are blocks that a known run of at most their size holds with their window: they come again at
    multiples of its period only. Such multiples inside a known run give that run again, and are left out.
    """
    n = len(w) // block
    candidates = np.flatnonzero(again[: n * block].reshape(n, block).max(axis=1) <= farthest)
    end, period = known.at(candidates * block)
    candidates = candidates[(end < candidates * block + farthest + block) | (period > block)]
    places = farthest - nearest + 1
    columns = 1 << (places + block - 2).bit_length()
    own = int(w.max()) + 1  # stands after the end and differs from every word
    primes = ntt.primes_for(block * own * own)
    found, steps, offsets = [], max(1, ENTRIES // columns), np.arange(places + block - 1)
    for i in range(0, len(candidates), steps):
        begin = candidates[i : i + steps] * block
        blocks = w[begin[:, None] + np.arange(block)]
        at = begin[:, None] + nearest + offsets
        windows = np.full((len(begin), columns), own, np.int64)
        windows[:, : len(offsets)] = np.where(at < len(w), w[np.minimum(at, len(w) - 1)], own)
        zero = np.ones((len(begin), places), bool)
        for p, root in primes:
            squares = np.cumsum(windows[:, : len(offsets)] ** 2 % p, axis=1)
            sums = squares[:, block - 1 :] + (blocks**2 % p).sum(axis=1, keepdims=True)
            sums[:, 1:] -= squares[:, :-block]
            products = ntt.correlations(blocks.astype(np.uint64), windows.astype(np.uint64), p, root)[:, :places].astype(np.int64)
            zero &= (sums - 2 * products) % p == 0  # the sums of squared differences
        row, place = np.nonzero(zero)
        found.append((candidates[i : i + steps][row], place + nearest))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    number, distance = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    end, period = known.at(number * block)
    new = (end < number * block + block + distance) | (distance % period != 0)
    return number[new], distance[new]


def agreeing(w: np.ndarray, at: np.ndarray, far: np.ndarray, step: int) -> np.ndarray:
    """For each place the words from it on, in steps of 1 or -1, that equal those far words on. Ever longer stretches are compared."""
    length, todo, width = np.zeros(len(at), np.int64), np.arange(len(at)), 8
    while len(todo):
        going = []
        slices = max(1, ENTRIES // width)
        for i in range(0, len(todo), slices):
            part = todo[i : i + slices]
            here = at[part, None] + step * (length[part, None] + np.arange(width))
            here = np.clip(here, 0, len(w) - 1)
            equal = w[here] == w[np.minimum(here + far[part, None], len(w) - 1)]
            first = np.where(equal.all(axis=1), width, equal.argmin(axis=1))
            length[part] += first
            going.append(part[first == width])
        todo, width = np.concatenate(going), min(width * 4, 1 << 16)
    return length


def seeds_extended(w: np.ndarray, block: int, number: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of the runs of occurrences (not always the smallest period)."""
    order = np.lexsort((number, distance))
    number, distance = number[order], distance[order]
    new = np.ones(len(number), bool)
    new[1:] = (distance[1:] != distance[:-1]) | (number[1:] != number[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(number))[: len(first)] - 1
    period, begin, end = distance[first], number[first] * block, (number[last] + 1) * block
    begin = begin - agreeing(w, begin - 1, period, -1)
    end = end + agreeing(w, end, period, 1) + period
    length = end - begin
    enough = (length >= LEAST_WORDS) & (length >= LEAST_PERIODS * period)
    return begin[enough], length[enough], period[enough]


def runs(texts: list[list[bytes]]) -> list[np.ndarray]:
    """For each text its runs as rows start, length, period, ordered by start, then period.

    A run is a stretch of words with smallest period q and LEAST_WORDS or more of them, LEAST_PERIODS q or more,
    that no neighbouring word extends. Memory grows with the words of the batch.
    """
    w, begin, again = end_to_end(texts)
    longest = max((len(t) for t in texts), default=0)
    block, nearest = FIRST_BLOCK, 1
    start, length, period = found = (np.zeros(0, np.int64),) * 3
    while nearest * LEAST_PERIODS <= longest:
        farthest = 4 * block - 1
        more = seeds_extended(w, block, *occurrences(w, again, Known(*found), block, nearest, farthest))
        start, length, period = (np.concatenate(both) for both in zip(found, more))
        order = np.lexsort((period, length, start))
        start, length, period = start[order], length[order], period[order]
        new = np.ones(len(start), bool)  # of one stretch the smallest period counts
        new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
        start, length, period = found = start[new], length[new], period[new]
        block, nearest = 2 * block, 4 * block
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    own = np.searchsorted(begin, start, "right") - 1
    rows = np.stack([start - begin[own], length, period], axis=1) if len(start) else np.zeros((0, 3), np.int64)
    return np.split(rows, np.searchsorted(own, np.arange(1, len(texts)))) if texts else []


def collapsed(words: list[bytes], found: np.ndarray) -> list[bytes]:
    """The words without those of a run after its first period."""
    if not len(found):
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, found[:, 0] + found[:, 2], 1)
    np.add.at(edges, found[:, 0] + found[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]


RUNS = "n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
LISTED = "array<struct<start:bigint,length:bigint,period:bigint>>"


def described(words: list[bytes], found: np.ndarray) -> tuple:
    """The values of RUNS: those of the run with the greatest length (ties: smallest start, then period), or nulls."""
    longest = (None,) * 4
    if len(found):
        s, n, p = found[np.lexsort((found[:, 2], found[:, 0], -found[:, 1]))[0]].tolist()
        longest = (s, n, p, 1000 * n // p)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in found.tolist())
    return len(words), len(found), *longest, sha256(lines.encode()).hexdigest(), sha256(b" ".join(collapsed(words, found))).hexdigest()


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def planted(words: list[bytes], key: object) -> list[bytes]:
    """words, of which a tenth of the ids have a stretch at the end made periodic, by the rule of op12's contract."""
    h, n = crc32(str(key).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False) -> DataFrame:
    """<id_col>, runs (start, length, period of each), collapsed (the text without repeats), and RUNS, of every row.

    Words are runs of anything but ASCII white space; a null text has none. plant puts periodic stretches into
    a tenth of the texts first (planted; rows with a null id are left as they are). Whole texts: very long ones
    take memory in proportion. Each row is searched alone, so repeated rows give equal rows; an empty table
    gives an empty result; other columns, whatever their names, aren't read.
    """

    @F.pandas_udf(f"runs {LISTED}, collapsed string, {RUNS}")
    def of(key: pd.Series, text: pd.Series) -> pd.DataFrame:
        texts = [planted(split(t), k) if plant and k is not None else split(t) for k, t in zip(key, text)]
        out = []
        for words, found in zip(texts, runs(texts)):
            listed = [{"start": s, "length": n, "period": p} for s, n, p in found.tolist()]
            out.append((listed, b" ".join(collapsed(words, found)).decode("utf-8", "surrogatepass"), *described(words, found)))
        names = ["runs", "collapsed", *[c.split()[0] for c in RUNS.split(", ")]]
        whole = {c: "Int64" for c in ("n_words", "n_runs", "start", "length", "period", "exponent_milli")}
        return pd.DataFrame(out, columns=names).astype(whole)

    return _searched(docs, id_col, text_col, of)


def describe_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False) -> DataFrame:
    """<id_col> and RUNS of find_runs, without the texts and lists."""

    @F.pandas_udf(RUNS)
    def of(key: pd.Series, text: pd.Series) -> pd.DataFrame:
        texts = [planted(split(t), k) if plant and k is not None else split(t) for k, t in zip(key, text)]
        out = [described(words, found) for words, found in zip(texts, runs(texts))]
        names = [c.split()[0] for c in RUNS.split(", ")]
        return pd.DataFrame(out, columns=names).astype({c: "Int64" for c in names[:6]})

    return _searched(docs, id_col, text_col, of)


def _searched(docs: DataFrame, id_col: str, text_col: str, of) -> DataFrame:
    key: Column = F.col(f"`{id_col}`")
    rows = text_batches(docs).select(F.struct(key.alias(id_col)).alias("row"), of(key.cast("string"), F.col(f"`{text_col}`")).alias("said"))
    return rows.select("row.*", "said.*")
