"""Families of rows: what shares a key with what, directly or through others, and splits that keep families whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .corpus import split_of


def linked(rows: DataFrame, key: str, shared: Sequence[str | Column]) -> DataFrame:
    """high, low: each row with the smallest key of those that share a value with it. A value of n rows makes n - 1 links; nulls link nothing."""
    out = None
    for s in shared:
        one = rows.select(F.col(key).alias("high"), (F.col(s) if isinstance(s, str) else s).alias("value")).where("high IS NOT NULL AND value IS NOT NULL")
        least = one.groupBy("value").agg(F.min("high").alias("low"), F.max("high").alias("most")).where("low < most")
        found = one.join(least, "value").where("high > low").select("high", "low")
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def components(links: DataFrame) -> DataFrame:
    """member, root of links high > low: the smallest member of its connected component, for every member but the smallest itself.

    In a round each node's larger neighbours are hung on its smallest neighbour, then its smaller ones; every
    round halves the longest way to the root, about. Links of a round are written, so a lost executor costs a round.
    """

    def hung(e: DataFrame, up: bool) -> DataFrame:
        around = e.select(F.col("high").alias("at"), F.col("low").alias("other"))
        if up:
            around = around.unionByName(e.select(F.col("low").alias("at"), F.col("high").alias("other")))
        least = around.groupBy("at").agg(F.min("other").alias("least")).withColumn("least", F.least("at", "least"))
        moved = around.join(least, "at").where(F.col("other") > F.col("at") if up else F.lit(True)).select(F.col("other").alias("high"), F.col("least").alias("low"))
        return (moved if up else moved.unionByName(least.select(F.col("at").alias("high"), F.col("least").alias("low")))).where("high <> low").distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("high", "low"))).first())

    links = written(links, "family-links")
    before = mark(links)
    while before[0]:
        links = written(hung(hung(links, True), False), "family-links")
        now = mark(links)
        if now == before:
            break
        before = now
    return links.select(F.col("high").alias("member"), F.col("low").alias("root"))


def families(rows: DataFrame, key: str, shared: Sequence[str | Column], name: str = "family") -> DataFrame:
    """rows with the smallest key of its family: the rows that share a value of one of `shared` with it, directly or through others."""
    roots = components(linked(rows, key, shared)).select(F.col("member").alias("_member"), F.col("root").alias(name))
    return rows.join(roots, F.col(key) == F.col("_member"), "left").withColumn(name, F.coalesce(name, key)).drop("_member")


def family_split(rows: DataFrame, key: str, shared: Sequence[str | Column], train: int = 70, val: int = 15) -> DataFrame:
    """rows with family and split: train, val or test drawn from the family, so that no family is in two. Rows with a null key share a split."""
    return families(rows, key, shared).withColumn("split", split_of(F.coalesce(F.col("family").cast("string"), F.lit("")), train, val))
