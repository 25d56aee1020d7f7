"""Keyed tables that a stream's micro-batches change: upserts that may be run again, expiry, compaction.

Each micro-batch writes the rows of the keys that it changed under its own number; a batch that runs again
overwrites what it wrote and reads the table as it was before it. So the state of a fold is a table that any
executor can read, and its order within a batch comes from Spark's sort, which spills; no key's rows are
gathered in memory.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class KeyedTable:
    """One row for each value of keys, in a folder that driver and executors share. columns is a schema, keys included."""

    spark: SparkSession
    path: str
    columns: str
    keys: tuple[str, ...]

    def upsert(self, rows: DataFrame, batch: int) -> None:
        """Puts rows, at most one for a key, in the place of those with their keys."""
        rows.write.mode("overwrite").parquet(f"{self.path}/changes/batch={batch}")

    def _numbers(self, label: str) -> list[int]:
        try:
            return sorted(r[0] for r in self.spark.read.schema("n bigint").parquet(f"{self.path}/{label}").collect())
        except AnalysisException:
            return []

    def _changes(self, before: int | None) -> tuple[DataFrame, int]:
        """All rows (with batch) that count, of batches below `before`, and the batch through which they were compacted (-1: none)."""
        done = max([n for n in self._numbers("compacted") if before is None or n < before], default=-1)
        schema = f"{self.columns}, batch bigint"
        found = self.spark.createDataFrame([], schema)
        try:
            found = self.spark.read.schema(schema).parquet(f"{self.path}/changes").where(F.col("batch") > done)
        except AnalysisException:  # no batch so far
            pass
        if before is not None:
            found = found.where(F.col("batch") < before)
        if done >= 0:
            found = found.unionByName(self.spark.read.schema(schema).parquet(f"{self.path}/base-{done}"))
        return found, done

    def read(self, before: int | None = None, changed: bool = False) -> DataFrame:
        """The table as it is, or as it was before a batch; changed adds `batch`, the one that changed a row last."""
        found, _ = self._changes(before)
        rest = [c for c in found.columns if c not in (*self.keys, "batch")]
        newest = found.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r"), F.max("batch").alias("batch"))
        return newest.select(*self.keys, "_r.*", *["batch"] * changed)

    def compact(self, through: int, keep: Column | None = None, idle: int | None = None) -> None:
        """Rewrites what batches up to `through` left as one base, without rows that keep refuses or that didn't change for idle batches.

        The base counts once its number is written, so a compaction that is cut short changes nothing.
        """
        rows = self.read(through + 1, changed=True)
        if keep is not None:
            rows = rows.where(keep)
        if idle is not None:
            rows = rows.where(F.col("batch") > through - idle)
        rows.write.mode("overwrite").parquet(f"{self.path}/base-{through}")
        self.spark.range(1).select(F.lit(through).cast("bigint").alias("n")).write.mode("append").parquet(f"{self.path}/compacted")


@dataclass
class Fold:
    """A fold for foreachBatch: what a batch emits goes to out, and what it leaves for later batches to state.

    step takes the batch and the state of its keys and gives both. With compact_every, the state is compacted after so many batches;
    keys that no batch touched for idle batches are then forgotten.
    """

    state: KeyedTable
    out: str
    step: callable
    compact_every: int | None = None
    idle: int | None = None

    def __call__(self, batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        before = self.state.read(before=number)
        mine = before.join(batch.select(*self.state.keys).distinct(), list(self.state.keys), "left_semi")
        emitted, left = self.step(batch, mine)
        emitted.write.mode("overwrite").parquet(f"{self.out}/batch={number}")
        self.state.upsert(left, number)
        batch.unpersist()
        if self.compact_every and number % self.compact_every == self.compact_every - 1:
            self.state.compact(number, idle=self.idle)

    def emitted(self, columns: str) -> DataFrame:
        return self.state.spark.read.schema(columns).parquet(f"{self.out}/batch=*")
