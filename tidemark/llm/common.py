"""Helpers shared by the text-corpus operators: tables, the shared folder, written intermediates."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one, on a local master only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder, which outlives any executor."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table made by written(), when nothing will read it again."""
    spark, files = df.sparkSession, df.inputFiles()
    if not files or not files[0].rpartition("/")[0].rpartition("/")[0].rstrip("/").endswith(shared_dir(spark).rpartition(":")[2].lstrip("/")):
        return
    jvm, path = spark.sparkContext._jvm, files[0].rpartition("/")[0]
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def setting(spark: SparkSession, **conf: str):
    """Session settings (dots written as __) that hold inside the block."""
    keys = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def few_of_many(spark: SparkSession):
    """Inside the block, a shuffled join of a large table with the few rows of a stored one that a comparison
    leaves drops most other rows before it shuffles, by Spark's own runtime Bloom filter. The filter has a fixed
    size of 1 MB; where more keys than it tells apart come, more rows are shuffled, and the join decides as ever."""
    bloom = "spark__sql__optimizer__runtime__bloomFilter__"
    return setting(spark, spark__sql__autoBroadcastJoinThreshold="-1", **{f"{bloom}enabled": "true", f"{bloom}applicationSideScanSizeThreshold": "0", f"{bloom}creationSideThreshold": "1t"})


#: So many places (a file's name and a number each, about 20 MB) are broadcast at most.
FEW_PLACES = 100_000


def without(rows: DataFrame, at: str, gone: DataFrame) -> DataFrame:
    """rows but those whose place is among gone, a table of places. Few enough are broadcast, so that no text is shuffled."""
    gone = written(gone.select(F.col(gone.columns[0]).alias(at)), "places-gone")
    few = gone.limit(FEW_PLACES + 1).count() <= FEW_PLACES
    return rows.join(F.broadcast(gone) if few else gone.hint("merge"), at, "left_anti")


#: Rows and bytes of an Arrow batch that carries whole texts or pages: Spark's default of 10,000 rows may be hundreds of megabytes.
TEXT_BATCH, TEXT_BATCH_BYTES = 500, 16 << 20


def text_batches(df: DataFrame) -> DataFrame:
    """df; its session hands rows to Python in batches of few rows and bytes (where none smaller are set).

    The settings last: df is run later, by whoever asked for it. They don't change results.
    """
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", TEXT_BATCH), ("maxBytesPerBatch", TEXT_BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        if not 0 < in_bytes(conf.get(key)) <= most:
            conf.set(key, str(most))
    return df


@lru_cache(maxsize=1)
def trim() -> Callable[[int], int]:
    """The C library's malloc_trim; where it has none, nothing."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def give_back() -> None:
    """Returns free memory to the system. A worker lives on after its task, and would else keep what its largest batch took."""
    pa.default_memory_pool().release_unused()
    trim()(0)


def batch_by_batch(batches: Iterator, of: Callable) -> Iterator:
    """of(batch) of each batch of a task; at the end, or where the task ends early, its memory is given back."""
    try:
        yield from map(of, batches)
    finally:
        give_back()


def in_bytes(value: str) -> int:
    """A number as Spark writes it, with b, kb, mb or gb after it or not."""
    number, unit = re.fullmatch(r"(-?\d+)\s*([a-z]*)", value.strip().lower()).groups()
    return int(number) << {"": 0, "b": 0, "k": 10, "kb": 10, "m": 20, "mb": 20, "g": 30, "gb": 30}.get(unit, 40)


def fresh_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it until no column of df has it (compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def normalised(text):
    """Text with each run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), ASCII_SPACE, " ")
