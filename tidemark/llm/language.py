"""Language ID by error-correcting output codes.

Each language has a codeword of bits; one binary classifier on hashed byte n-grams predicts each bit.
Decoding takes the codeword with the smallest sum of the bits' logistic losses, and flags a text whose
second-best codeword is nearly as good.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import linear
from .common import batch_by_batch, fresh_name, text_batches

DIM = 4096
ORDERS = (1, 2, 3)
#: Labelled rows of each language that training reads, about.
ROWS_PER_LANGUAGE = 400
UNKNOWN = "und"


def codewords(classes: int) -> np.ndarray:
    """A row of +1 and -1 for each class: all splits of up to 7 classes, beyond that 64 bits or more from a fixed seed."""
    if classes <= 7:
        bits = max(1, 2 ** (classes - 1) - 1)
        return np.array([[1 if c == 0 or (b + 1) >> (c - 1) & 1 == 0 else -1 for b in range(bits)] for c in range(classes)], np.float32)
    bits = max(64, 12 * classes.bit_length())
    return np.random.default_rng(7).choice(np.array([-1, 1], np.float32), (classes, bits))


def vector(text: str) -> np.ndarray:
    data = (" " + text.lower() + " ").encode("utf-8", "surrogatepass")
    return linear.unit(linear.ngrams(np.frombuffer(data, np.uint8), ORDERS, DIM))


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    ambiguous_below: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, ambiguous."""
        if text is None or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        margin = vector(text) @ self.weights + self.bias
        loss = np.logaddexp(0, -self.code * margin).sum(1)
        share = np.exp(loss.min() - loss)
        share /= share.sum()
        best = int(loss.argmin())
        second = np.delete(share, best).max(initial=0.0)
        return self.languages[best], float(share[best]), bool(share[best] - second < self.ambiguous_below)


def train(labelled: DataFrame, key_col: str, text_col: str, lang_col: str, rows_per_language: int = ROWS_PER_LANGUAGE, ambiguous_below: float = 0.1) -> LanguageModel:
    """A model from labelled rows with text and language; about rows_per_language rows of each are read.

    Each row gives its whole text and a passage of 12 words, so that short texts are known too. Of rows with
    one key and language the smallest text is read.
    """
    rows = text_batches(labelled).where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(key_col).alias("key"), F.col(text_col).alias("text"))
    picked = linear.bounded(rows, F.col("lang"), F.col("key"), rows_per_language)
    picked = picked.groupBy("lang", "key").agg(F.min("text").alias("text")).select("lang", "text")

    def vectors(batches):
        for pdf in batches:
            out = []
            for lang, text in zip(pdf["lang"], pdf["text"]):
                words = text.split()
                for t in (text, " ".join(words[len(words) // 2 :][:12])):
                    if any(map(str.isalpha, t)):
                        out.append((lang, *linear.sparse(vector(t))))
            if out:
                yield pd.DataFrame(out, columns=["lang", "at", "v"])

    found = picked.mapInPandas(vectors, "lang string, at array<int>, v array<float>").toArrow()
    names = found["lang"].to_pylist()
    languages = sorted(set(names))
    code = codewords(len(languages))
    if not languages:
        return LanguageModel([], code, np.zeros((DIM, 1), np.float32), np.zeros(1, np.float32), ambiguous_below)
    x = linear.dense(found, DIM)
    of = np.array([languages.index(c) for c in names])
    size = np.bincount(of, minlength=len(languages))
    w, b = linear.fit(x, code[of], weight=1.0 / size[of])
    return LanguageModel(languages, code, w, b, ambiguous_below)


def predict(docs: DataFrame, model: LanguageModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep's columns and lang_pred, score (0 to 1), ambiguous of every row of docs, from the whole text.

    Null text, or text without a letter: und, 0, ambiguous. Very long texts are read in chunks. Only
    text_col is read beside keep, whose names may be any (those of the three new columns then come twice);
    repeated rows each get a row; an empty table gives an empty result.
    With no labelled row to learn from, every prediction is und.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x DIM floats at most

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def of(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in text], columns=["lang_pred", "score", "ambiguous"])

    kept, said = [F.col(f"`{c}`") for c in keep], fresh_name(docs, "said")
    return text_batches(docs).select(*kept, of(F.col(f"`{text_col}`")).alias(said)).select(*kept, f"{said}.*")


def held_out(key: Column) -> Column:
    """Whether a row is kept from training: crc32 of its id as text divides by five."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def train_on_documents(docs: DataFrame) -> LanguageModel:
    return train(docs.where(~held_out(F.col("doc_id"))), "doc_id", "text", "lang")


def keep_known(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of docs whose language is known and not ambiguous, with docs' columns, whatever their names.

    Null texts and those without a letter go; very long texts are read whole; repeated rows share their
    fate; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def known(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return batch_by_batch(texts, lambda text: pd.Series([not shared.value.predict(t)[2] for t in text], dtype="bool"))

    return text_batches(docs).where(known(F.col("text")))
