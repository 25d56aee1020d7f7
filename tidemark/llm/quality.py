"""Quality rules: text statistics with fixed limits, then a logistic regression on hashed word and
character n-grams, trained on labelled rows by MLlib's L-BFGS and calibrated to probabilities, scored in Arrow batches."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import linear
from .common import batch_by_batch, discard, fresh_name, text_batches, written

DIM = 8192
ORDERS = (2, 3)
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
#: Labelled rows of each class that training reads, about.
ROWS_PER_CLASS = 2000
#: Rounds of L-BFGS at most, the change at which they end, and the weight of the penalty on squared weights.
ROUNDS, TOLERANCE, PENALTY = 40, 1e-4, 1e-4
#: Probability of good quality from which a text is kept.
KEEP_FROM = 0.5
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that occur twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    h = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    key = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[inverse] > 1)  # equal windows have equal keys; the words decide
    if not len(at):
        return 0
    windows = [tuple(words[i : i + 3]) for i in at.tolist()]
    times = Counter(windows)
    covered = np.zeros(len(words), bool)
    for i, w in zip(at.tolist(), windows):
        if times[w] > 1:
            covered[i : i + 3] = True
    return int(covered.sum())


def statistics(data: bytes, chars: int, words: list[bytes]) -> tuple[int, int, int, int, int, bool]:
    in_words = sum(map(len, words))
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    n, repeats = len(words), repeated_words(words)
    return (
        n,
        chars - (len(data) - in_words),  # white space is one byte each
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeats,
        n < MIN_WORDS or 100 * repeats > 50 * n,
    )


def vector(text: str, words: list[bytes]) -> np.ndarray:
    """Word n-grams, then n-grams of code points, DIM dimensions each."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.concatenate([linear.unit(linear.word_ngrams(words, DIM)), linear.unit(linear.ngrams(points, ORDERS, DIM))])


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def probability(self, text: str, words: list[bytes]) -> float:
        z = float(vector(text, words) @ self.weights) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -30, 30))))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows_per_class: int = ROWS_PER_CLASS) -> QualityModel | None:
    """A calibrated model from about rows_per_class labelled rows of each class; None unless both classes have rows.

    A fifth of the rows, by crc32 of the id, is held back to fit the calibration. Ids with both labels
    aren't used; of rows with one id the smallest text is; null texts, null ids and texts too short for the
    base rules aren't; very long texts are read whole; a table without rows gives None. The vectors are
    written once and stay in the tasks: the driver gets sums of gradients, and two numbers of each row held back.
    """
    marks = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("key")).agg(F.min(label_col).alias("y"), F.max(label_col).alias("most"))
    marks = marks.where(F.col("y") == F.col("most")).select("key", "y")
    picked = linear.bounded(marks, F.col("y"), F.col("key"), rows_per_class)
    texts = text_batches(docs).where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(picked), "key")  # two classes of about rows_per_class ids
    rows = rows.groupBy("key", "y").agg(F.min("text").alias("text"))

    def vectors(batches):
        for pdf in batches:
            out = []
            for key, text, y in zip(pdf["key"], pdf["text"], pdf["y"]):
                words = text.encode("utf-8", "surrogatepass").split()
                if len(words) >= MIN_WORDS:  # shorter texts never reach the model
                    out.append((crc32(str(key).encode()) % 5 == 0, int(y), *linear.sparse(vector(text, words))))
            if out:
                yield pd.DataFrame(out, columns=["held", "y", "at", "v"])

    entries = F.udf(lambda at, v: Vectors.sparse(2 * DIM, at, v), VectorUDT())
    # Written in between, so that no task has two kinds of Python workers at once.
    arrays = written(rows.mapInPandas(vectors, "held boolean, y int, at array<int>, v array<double>"), "quality-entries")
    found = written(arrays.select("held", F.col("y").cast("double").alias("label"), entries("at", "v").alias("features")), "quality-vectors")
    discard(arrays)
    counts = {(r["held"], r["label"]): r["count"] for r in found.groupBy("held", "label").count().collect()}
    sides = [{y for (h, y) in counts if h == held} for held in (False, True)]
    if len(sides[0] | sides[1]) < 2:
        return None
    apart = all(len(s) == 2 for s in sides)
    fitted, judged = (found.where("NOT held"), found.where("held")) if apart else (found, found)
    of = lambda y: sum(n for (h, c), n in counts.items() if c == y and not (apart and h))
    weighted = fitted.withColumn("weight", F.when(F.col("label") == 1, 1 / of(1)).otherwise(1 / of(0)))
    model = LogisticRegression(weightCol="weight", maxIter=ROUNDS, regParam=PENALTY, tol=TOLERANCE, standardization=False).fit(weighted)
    margins = model.transform(judged).select("label", vector_to_array("rawPrediction")[1].alias("z")).toPandas()
    y = np.where(margins["label"] == 1, 1, -1).astype(np.float32)
    slope, offset = linear.fit(margins[["z"]].to_numpy(np.float32), y[:, None], rounds=200, rate=0.05, l2=1e-3)
    discard(found)
    return QualityModel(model.coefficients.toArray().astype(np.float32), float(model.intercept), max(float(slope[0, 0]), 1e-3), float(offset[0]))


def assess(docs: DataFrame, model: QualityModel | None, keep: list[str], text_col: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """keep's columns, then n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, probability, kept.

    Words are runs of anything but ASCII white space; a null text has none, and fails. probability is
    that of good quality (null where the base rules fail, or without a model, which then keeps).
    Whole texts; each row is judged alone, so repeated rows are judged alike; an empty table gives an
    empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 x DIM floats

    @F.pandas_udf(f"{BASE}, probability double, kept boolean")
    def of(text: pd.Series) -> pd.DataFrame:
        out = []
        for t in text:
            data = (t or "").encode("utf-8", "surrogatepass")
            words = data.split()
            base = statistics(data, len(t or ""), words)
            p = None if base[-1] or shared.value is None else shared.value.probability(t, words)
            out.append((*base, p, not base[-1] and (p is None or p >= keep_from)))
        names = [c.split()[0] for c in f"{BASE}, probability double, kept boolean".split(", ")]
        return pd.DataFrame(out, columns=names).astype({"probability": "float64"})

    kept, said = [F.col(f"`{c}`") for c in keep], fresh_name(docs, "said")
    return text_batches(docs).select(*kept, of(F.col(f"`{text_col}`")).alias(said)).select(*kept, f"{said}.*")


def keep_good(docs: DataFrame, model: QualityModel | None, text_col: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of docs that assess keeps, with docs' columns, whatever their names.

    Null, empty and short texts fail the base rules and go; very long texts are read whole; repeated rows
    share their fate; an empty table gives an empty result. Without a model the base rules decide alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def one(t):
        data = (t or "").encode("utf-8", "surrogatepass")
        words = data.split()
        if statistics(data, len(t or ""), words)[-1]:
            return False
        return shared.value is None or shared.value.probability(t, words) >= keep_from

    @F.pandas_udf("boolean")
    def good(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return batch_by_batch(texts, lambda text: pd.Series([one(t) for t in text], dtype="bool"))

    return text_batches(docs).where(good(F.col(f"`{text_col}`")))
