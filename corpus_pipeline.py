"""The training-data pipeline: stages over documents, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last
return the columns of docs, whatever these are; the last returns the pieces of packed sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import exact_dedup, language, near_copies, packing, quality
from tidemark.llm.common import discard, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or that the model, trained on labels, finds poor.

    Null, empty and short texts fail; very long ones are read whole; repeated rows share their fate; null
    ids are judged by their text like any other; an empty table gives an empty one; other columns are handed
    on. Without labels the base rules decide alone.
    """
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no known language or of an ambiguous one.

    Null texts and those without a letter go; very long ones are read whole; repeated rows share their fate;
    null languages aren't learnt from; with none to learn from, every document goes; an empty table gives an
    empty one; other columns are handed on.
    """
    return language.keep_known(docs, language.train_on_documents(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, leaves the row with the smallest doc_id.

    Null and empty texts are equal; a null id comes after all others; of rows repeated with one id the first
    by file and row stays; very long texts are compared whole; an empty table gives an empty one; other
    columns, whatever their names, are handed on.
    """
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word Jaccard of 0.8 or more), leaves the row with the smallest doc_id.

    The SimHash grid links the nearest copies, and prefixes of the shingle sets find the rest. Null and
    empty texts are copies of one another; rows with a null id stay; of rows repeated with one id the first by
    file and row stays; very long texts are read whole; an empty table gives an empty one; other columns,
    whatever their names, are handed on.
    """
    return near_copies.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 1024 tokens.

    Null and empty texts are the end id alone; null ids come first; rows repeated with one id go by text;
    very long texts are cut into many pieces; an empty table gives no pieces; other columns aren't read.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("packing", packed)]
#: The learned stages and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents."""
    docs = before = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, before, sf_dir), f"pipeline-{name}")
        if name != STAGES[0][0]:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
