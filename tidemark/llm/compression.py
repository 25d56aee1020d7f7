"""Quality by compression: Zstandard dictionaries built from good and from bad labelled texts. A text that
the good one makes smaller than the bad one reads like a good text; the difference of the two sizes,
over their sum, becomes a calibrated score, together with how small the text gets at all (what repeats
itself is small with either).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import linear
from .common import text_batches

#: Bytes of a dictionary at most, level of the compressor, and bytes of a text that are compressed at once, so that the dictionary counts to its end.
DICTIONARY, LEVEL, BLOCK = 110 << 10, 3, 1 << 10
#: Labelled rows of each class that training reads, about, and blocks of each, spread over the whole text, that dictionaries are built from.
ROWS_PER_CLASS, BLOCKS_PER_ROW = 2000, 4
#: Parts of the training rows, each of which is measured with dictionaries built from the others.
FOLDS = 3
#: Score from which label 1 is predicted.
ONE_FROM = 0.7


def held_out(key: Column) -> Column:
    """Whether labels of a row mustn't be learnt: crc32 of its id, as text, leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def blocks(data: bytes) -> list[bytes]:
    """The whole of data in blocks; nothing is one empty block."""
    return [data[i : i + BLOCK] for i in range(0, max(len(data), 1), BLOCK)]


def spread(data: bytes, most: int) -> list[bytes]:
    """Up to so many blocks, evenly spread over data."""
    found = blocks(data)
    return [found[i * len(found) // most] for i in range(most)] if len(found) > most else found


def dictionary(samples: list[bytes]) -> bytes:
    """A dictionary from samples; where they are too few to train one, the samples themselves, the last ones nearest."""
    whole = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(max(min(DICTIONARY, whole // 4), 256), samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:] or b" " * 8


def pair_of_dictionaries(bad: list[bytes], good: list[bytes]) -> tuple[bytes, bytes]:
    """Dictionaries from as many bytes of either class, so that neither is richer."""
    most = min(sum(map(len, bad)), sum(map(len, good)))

    def first(samples: list[bytes]) -> list[bytes]:
        ends = np.cumsum([len(s) for s in samples])
        return samples[: int(np.searchsorted(ends, most, "left")) + 1]

    return dictionary(first(bad)), dictionary(first(good))


@lru_cache(maxsize=2 * (FOLDS + 1))
def compressor(content: bytes) -> zstandard.ZstdCompressor:
    """One for each dictionary in a worker; only the sizes of what it makes are used."""
    shared = zstandard.ZstdCompressionDict(content)
    shared.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=shared, level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False)


def measures(text: str | None, bad: bytes, good: bytes) -> tuple[float, float]:
    """(bad - good) / (bad + good) of the whole text's compressed sizes, and the logarithm of the smaller over the text's own bytes."""
    data = (text or "").encode("utf-8", "surrogatepass")
    by_bad, by_good = (sum(len(compressor(d).compress(b)) for b in blocks(data)) for d in (bad, good))
    return (by_bad - by_good) / (by_bad + by_good), float(np.log(min(by_bad, by_good) / (len(data) + 16)))


@dataclass
class CompressionModel:
    bad: bytes
    good: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        z = (np.array(measures(text, self.bad, self.good)) - self.mean) / self.scale @ self.weights + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows_per_class: int = ROWS_PER_CLASS
) -> CompressionModel | None:
    """A calibrated model from about rows_per_class labelled rows of each class, none held out; None unless both classes have rows.

    The driver gets BLOCKS_PER_ROW blocks of each row (8 MB a class) and two numbers of each. Those numbers come
    from the whole text, with dictionaries built from other rows. Ids with both labels aren't used; of rows
    with one id the smallest text is; null texts and null ids aren't; very long texts are measured whole; a table
    without rows gives None.
    """
    key = F.col(f"`{id_col}`")
    marks = labels.where(F.col(label_col).isin(0, 1) & key.isNotNull() & ~held_out(key)).groupBy(key.alias("key")).agg(F.min(label_col).alias("y"), F.max(label_col).alias("most"))
    picked = linear.bounded(marks.where("y = most").select("key", "y"), F.col("y"), F.col("key"), rows_per_class)
    texts = text_batches(docs).where(F.col(f"`{text_col}`").isNotNull()).select(key.alias("key"), F.col(f"`{text_col}`").alias("text"))
    rows = texts.join(F.broadcast(picked), "key").groupBy("key", "y").agg(F.min("text").alias("text"))  # two classes of about rows_per_class ids

    def fold(key) -> int:
        return crc32(str(key).encode()) // 4 % FOLDS

    def sampled(batches):
        for pdf in batches:
            data = [t.encode("utf-8", "surrogatepass") for t in pdf["text"]]
            yield pd.DataFrame({"key": pdf["key"].astype(str), "y": pdf["y"], "blocks": [spread(d, BLOCKS_PER_ROW) for d in data]})

    found = rows.mapInPandas(sampled, "key string, y int, blocks array<binary>").toPandas()
    if set(found["y"]) != {0, 1}:
        return None
    found = found.sort_values("key", key=lambda s: s.map(lambda k: crc32(k.encode() + b"order")))  # the same at every run
    of = lambda y, left_out: [b for k, c, bs in zip(found["key"], found["y"], found["blocks"]) if c == y and fold(k) != left_out for b in bs]
    halves = {f: (of(0, f), of(1, f)) for f in (*range(FOLDS), FOLDS)}  # the last leaves nothing out
    pairs = {f: pair_of_dictionaries(*half if all(half) else halves[FOLDS]) for f, half in halves.items()}
    shared = docs.sparkSession.sparkContext.broadcast(pairs)

    def measured(batches):
        for pdf in batches:
            out = [(int(y), *measures(t, *shared.value[fold(k)])) for k, y, t in zip(pdf["key"], pdf["y"], pdf["text"])]
            yield pd.DataFrame(out, columns=["y", "difference", "size"])

    sizes = rows.mapInPandas(measured, "y int, difference double, size double").toPandas()
    x, y = sizes[["difference", "size"]].to_numpy(), np.where(sizes["y"] == 1, 1, -1).astype(np.float32)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    w, b = linear.fit(((x - mean) / scale).astype(np.float32), y[:, None], rounds=500, rate=0.1, l2=1e-3)
    return CompressionModel(*pairs[FOLDS], mean, scale, w[:, 0].astype(float), float(b[0]))


def assess(docs: DataFrame, model: CompressionModel | None, keep: list[str], text_col: str = "text", one_from: float = ONE_FROM) -> DataFrame:
    """keep's columns, then score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= one_from, else 0).

    A null text counts as the empty one, which has a score like any other; very long texts are compressed
    whole, block by block. Each row is judged alone, so repeated rows are judged alike; an empty table gives an
    empty result; other columns, whatever their names, aren't read. Without a model every score is 0.5.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries

    @F.pandas_udf("double")
    def of(text: pd.Series) -> pd.Series:
        m = shared.value
        return pd.Series([0.5 if m is None else m.score(t) for t in text], dtype="float64")

    kept = [F.col(f"`{c}`") for c in keep]
    scored = text_batches(docs).select(F.struct(*kept).alias("row"), of(F.col(f"`{text_col}`")).alias("score"))
    return scored.select("row.*", "score", (F.col("score") >= one_from).cast("int").alias("predicted"))
