"""Whitening of embeddings with mixed-precision principal components.

The covariance is added up over the partitions exactly: entries become whole numbers, are centred at the
whole number next to their mean, and the remainder of less than one half is taken off at the end, in whole
numbers too. Its eigenvectors are found in float32 and corrected by matrix multiplications in extended
precision, by the iteration of Ogita and Aishima, which doubles the right digits each time; eigenvectors
whose eigenvalues lie too close to be told apart by it are turned by small eigenproblems of their own,
shifted to the cluster, so that its width, not the largest eigenvalue, sets the precision.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh_name, text_batches, written

#: An entry c counts as floor(STEPS c) + SHIFT, and is held within FARTHEST steps of zero.
STEPS, SHIFT, FARTHEST = 64, 1_000_000, 1 << 40
COMPONENTS = 16
#: Corrections of the eigenvectors at most.
ROUNDS = 10
#: Eigenvalues closer than this part of the largest are a cluster in any case: the square root of the extended precision.
NEAR = 1e-9
WIDE = np.longdouble


def whole_entries(vector: Column) -> Column:
    """The entries as whole numbers; null where the vector or an entry is null or not finite."""
    finite = F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    held = lambda e: F.greatest(F.least(F.floor(F.greatest(F.least(e.cast("double"), F.lit(2.0**34)), F.lit(-(2.0**34))) * STEPS), F.lit(FARTHEST)), F.lit(-FARTHEST))
    return F.when(finite, F.transform(vector, lambda e: (held(e) + SHIFT).cast("long")))


def usual_size(rows: DataFrame, x: str) -> int:
    """How many entries most vectors have (ties: the larger number); none: 0."""
    sizes = rows.where(F.col(x).isNotNull() & (F.size(x) > 0)).groupBy(F.size(x).alias("size")).count()
    top = sizes.orderBy(F.desc("count"), F.desc("size")).first()
    return top["size"] if top else 0


def matrices(batches, dim: int):
    """The column x of Arrow batches as matrices of whole numbers."""
    for batch in batches:
        if batch.num_rows:
            yield batch.column("x").flatten().to_numpy().reshape(-1, dim)


def added_up(fit: DataFrame, dim: int, parts) -> dict[int, int]:
    """Sums over all tasks of what parts (matrices to pairs of a small integer key and a whole number) gives in each."""

    def run(batches):
        for keys, numbers in parts(matrices(batches, dim)):
            values = pa.array([Decimal(v) for v in numbers], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), values], names=["k", "v"])

    found = text_batches(fit).mapInArrow(run, "k long, v decimal(38,0)").groupBy("k").agg(F.sum("v").alias("v"))
    return {r["k"]: int(r["v"]) for r in found.collect()}  # at most dim (dim + 1) / 2


def sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """How many vectors there are, and the sum of each entry."""

    def parts(found):
        for m in found:
            yield range(dim + 1), [*map(int, m.sum(axis=0)), len(m)]

    total = added_up(fit, dim, parts)
    return total[dim], [total[j] for j in range(dim)]


def products(fit: DataFrame, dim: int, centre: list[int]) -> list[list[int]]:
    """The sums of products of the entries less centre, exactly."""
    upper = np.triu_indices(dim)
    keys, at = upper[0] * dim + upper[1], np.array(centre, np.int64)

    def parts(found):
        total, room = np.zeros((dim, dim), np.int64), 0
        for m in found:
            d = m - at
            bound = len(d) * int(np.abs(d).max()) ** 2
            if bound >= 1 << 53:  # a float64 product wouldn't be exact
                wide = d.astype(object)
                yield keys, (wide.T @ wide)[upper]
                continue
            if room + bound >= 1 << 62:
                yield keys, total[upper].tolist()
                total[:], room = 0, 0
            as_floats = d.astype(np.float64)
            total += (as_floats.T @ as_floats).astype(np.int64)
            room += bound
        yield keys, total[upper].tolist()

    total = added_up(fit, dim, parts)
    return [[total[min(i, j) * dim + max(i, j)] for j in range(dim)] for i in range(dim)]


def wide(value: Fraction):
    """A fraction in extended precision."""
    high = float(value)
    return WIDE(high) + WIDE(float(value - Fraction(high)))


def clusters(values: np.ndarray, least_gap: float) -> list[np.ndarray]:
    """Places of values, falling, that follow one another by least_gap or less; two or more each."""
    order = np.argsort(-values, kind="stable")
    cuts = np.flatnonzero(-np.diff(values[order]) > least_gap) + 1
    return [c for c in np.split(order, cuts) if len(c) > 1]


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix in extended precision."""
    size = np.abs(a).max()
    if not size:
        return np.zeros(len(a), WIDE), np.eye(len(a), dtype=WIDE)
    a = a / size
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(WIDE)
    norm, before = np.linalg.norm(a.astype(np.float64), 2), np.inf
    for _ in range(ROUNDS):
        r = np.eye(len(a), dtype=WIDE) - x.T @ x
        s = x.T @ (a @ x)
        s = (s + s.T) / 2
        values = np.diag(s) / (1 - np.diag(r))
        off = (s - np.diag(values)).astype(np.float64)
        least_gap = max(2 * (np.linalg.norm(off, 2) + norm * np.linalg.norm(r.astype(np.float64), 2)), NEAR * norm)
        gaps = values[None, :] - values[:, None]
        apart = np.abs(gaps) > least_gap
        e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gaps, 1), r / 2)
        x = x + x @ e
        for c in clusters(values, least_gap):
            mine = x[:, c]
            small = mine.T @ (a @ mine - values[c].mean() * mine)
            width = np.abs(small).max()
            if width:
                x[:, c] = mine @ np.linalg.eigh((small / width).astype(np.float64))[1].astype(WIDE)
        now = float(np.abs(e).max())
        if now < 1e-18 or (before < 1e-12 and now > before / 2):
            break
        before = now
    for _ in range(2):  # right angles, to the last digit
        x = x + x @ (np.eye(len(a), dtype=WIDE) - x.T @ x) / 2
    values = (x * (a @ x)).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    x, values = x[:, order], values[order]
    x = x * np.sign(x[np.abs(x).argmax(axis=0), np.arange(len(a))])
    return values * size, x


@dataclass
class Whitening:
    """What vectors are whitened by: how many distinct ones it was fitted on, the sum of each entry, the whole
    number next to each mean, eigenvalues and unit eigenvectors (columns) of the covariance, and its trace."""

    n: int
    sums: list[int]
    centre: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    #: Largest entry of the covariance of the whitened vectors less the identity.
    identity_error: float | None = None

    def rest(self) -> np.ndarray:
        return np.array([float(Fraction(s - self.n * c, self.n)) for s, c in zip(self.sums, self.centre)])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows of whole entries, whitened; nan for components without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            by = np.where(self.values > 0, self.vectors / np.sqrt(self.values), np.nan).astype(np.float64)
        return (x - np.array(self.centre, np.int64) - self.rest()) @ by

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum over entries of (n x - sum) squared, exactly."""
        d, t = x - np.array(self.centre, np.int64), [s - self.n * c for s, c in zip(self.sums, self.centre)]
        largest = self.n * int(np.abs(d).max(initial=0)) + max(map(abs, t))
        if x.shape[1] * largest**2 < 1 << 62:
            return ((self.n * d - np.array(t, np.int64)) ** 2).sum(axis=1).tolist()
        return ((self.n * d.astype(object) - np.array(t, object)) ** 2).sum(axis=1).tolist()


def fitted(rows: DataFrame, dim: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of rows' vectors x, each distinct one counted once; None where there are none."""
    fit = written(rows.select("x").distinct(), "whitening-fit")
    if not dim or not fit.limit(1).count():
        return None
    n, total = sums(fit, dim)
    centre = [(2 * s + n) // (2 * n) for s in total]
    g, t = products(fit, dim, centre), [s - n * c for s, c in zip(total, centre)]
    covariance = np.array([[wide(Fraction(n * g[i][j] - t[i] * t[j], n * n)) for j in range(dim)] for i in range(dim)], WIDE)
    values, vectors = eigen(covariance)
    trace = np.diag(covariance).sum()
    values = np.where(values > len(values) * np.finfo(np.float64).eps * values.max(), values, 0)
    out = Whitening(n, total, centre, values[:components], vectors[:, :components], float(trace))
    out.identity_error = identity_error(fit, dim, out)
    discard(fit)
    return out


def identity_error(fit: DataFrame, dim: int, whitening: Whitening) -> float | None:
    """How far the covariance of the whitened vectors is from the identity; None without a component that has variance."""
    shared, k = fit.sparkSession.sparkContext.broadcast(whitening), int((whitening.values > 0).sum())
    if not k:
        return None

    def run(batches):
        total, mean = np.zeros((k, k)), np.zeros(k)
        for m in matrices(batches, dim):
            y = shared.value.whitened(m)[:, :k]
            total += y.T @ y
            mean += y.sum(axis=0)
        numbers = np.concatenate([total.ravel(), mean])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(numbers)), pa.int64()), pa.array(numbers)], names=["k", "v"])

    found = {r["k"]: r["v"] for r in text_batches(fit).mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()}
    total, mean = np.array([found[i] for i in range(k * k)]).reshape(k, k) / whitening.n, np.array([found[k * k + i] for i in range(k)]) / whitening.n
    return float(np.abs(total - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """<id_col>, component, n, deviation, whitened, explained, identity_error: a row for each vector and component.

    Null vectors and those with a null or non-finite entry are left out, and so are those with another number
    of entries than most have (ties: the larger number). Entries beyond 2^34 count as 2^34. Components are numbered from 1
    by falling eigenvalue; those without variance (as when there are fewer distinct vectors than entries)
    have a null whitened and an explained of 0, or null if no entry varies; deviation is null beyond a long.
    Repeated rows each get their rows and count once in the fit; null ids are kept; an empty table gives an
    empty result; other columns, whatever their names, aren't read. The driver holds matrices of the square
    of the number of entries.
    """
    rows = vectors.select(F.col(f"`{id_col}`").alias(id_col), whole_entries(F.col(f"`{vector_col}`")).alias("x" if id_col.lower() != "x" else "_x"))
    x = rows.columns[1]
    dim = usual_size(rows, x)
    rows = rows.where(F.size(x) == dim)
    found = fitted(rows.select(F.col(x).alias("x")), dim, components)
    if found is None:
        empty = "component int, n long, deviation long, whitened double, explained double, identity_error double"
        return vectors.sparkSession.createDataFrame([], f"`{id_col}` {dict(vectors.dtypes)[id_col]}, {empty}")
    shared = vectors.sparkSession.sparkContext.broadcast(found)

    @F.pandas_udf("deviation string, whitened array<double>")
    def of(x: pd.Series) -> pd.DataFrame:
        m = np.stack(x.to_list()) if len(x) else np.zeros((0, dim), np.int64)
        y = shared.value.whitened(m)
        return pd.DataFrame({"deviation": [str(d) for d in shared.value.deviations(m)], "whitened": [*y]})

    share = [None if not found.trace else float(v / found.trace) for v in found.values]
    said, pos = fresh_name(rows, "said"), fresh_name(rows, "place")
    each = text_batches(rows).select(id_col, of(F.col(x)).alias(said)).select(id_col, F.col(f"{said}.deviation").alias(said), F.posexplode(f"{said}.whitened").alias(pos, "whitened"))
    return each.select(
        id_col,
        (F.col(pos) + 1).cast("int").alias("component"),
        F.lit(found.n).cast("long").alias("n"),
        F.col(said).try_cast("decimal(38,0)").try_cast("long").alias("deviation"),
        F.when(~F.isnan("whitened"), F.col("whitened")).alias("whitened"),
        F.element_at(F.lit(share).cast("array<double>"), F.col(pos) + 1).alias("explained"),
        F.lit(found.identity_error).cast("double").alias("identity_error"),
    )
