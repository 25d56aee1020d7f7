"""Reading uploaded CSV files and corpora, writing splits, previews."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .records import read_records, typed


def clean_names(names: Sequence[str]) -> list[str]:
    """Lower case, other characters as one underscore, none at the ends; empty: column; repeats get _2, _3."""
    out, seen = [], {}
    for name in names:
        c = re.sub(r"_+", "_", re.sub(r"[^a-z0-9_]", "_", name.strip().lower())).strip("_") or "column"
        seen[c] = seen.get(c, 0) + 1
        while seen[c] > 1 and f"{c}_{seen[c]}" in seen:
            seen[c] += 1
        final = c if seen[c] == 1 else f"{c}_{seen[c]}"
        seen.setdefault(final, 1)
        out.append(final)
    return out


def _number(name: str) -> bool:
    try:
        float(name)
        return True
    except ValueError:
        return False


def ingest_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """A CSV file, or a folder of them, with clean column names and inferred types.

    A first row of numbers is data, and the columns are col_0, col_1, ... Bytes that aren't UTF-8 make
    the file be read as Latin-1. Quotes in quoted fields are doubled. Large files are split for reading,
    also where quoted fields hold line breaks (records).
    """

    def read(header: bool, charset: str) -> DataFrame:
        return spark.read.option("header", header).option("inferSchema", True).option("encoding", charset).option("escape", '"').option("multiLine", wide).csv(path)

    wide = encoding.upper().startswith(("UTF-16", "UTF-32"))  # their line ends aren't single bytes, so no file is split
    raw = spark.read.text(path)
    if encoding == "UTF-8" and raw.where(~F.is_valid_utf8("value")).limit(1).count():
        encoding = "ISO-8859-1"
    found = None if wide else read_records(spark, path, encoding)
    if found:
        texts, head = found
        if head and all(map(_number, head)):
            texts = texts.unionByName(spark.createDataFrame([head], texts.schema))
            return typed(texts).toDF(*[f"col_{i}" for i in range(len(head))])
        return typed(texts).toDF(*clean_names(head))
    df = read(True, encoding)
    if df.columns and all(_number(c) for c in spark.read.option("header", False).csv(path).first() or ["x"]):
        df = read(False, encoding)
        return df.toDF(*[f"col_{i}" for i in range(len(df.columns))])
    return df.toDF(*clean_names(df.columns))


def ingest_csv_dir(spark: SparkSession, paths: Sequence[str]) -> dict[str, DataFrame]:
    """A temporary view for each file, named by the file's stem; missing files are skipped, another load replaces."""
    tables = {}
    for path in paths:
        stem = clean_names([re.sub(r"\.[^.]*$", "", path.rstrip("/").rpartition("/")[2])])[0]
        try:
            tables[stem] = ingest_csv(spark, path)
        except AnalysisException:
            continue
        tables[stem].createOrReplaceTempView(stem)
    return tables


def read_corpus(spark: SparkSession, path: str, schema: StructType, lines: bool = False) -> DataFrame:
    """The records of a JSON array (or of one object); a missing or malformed file has none.

    With lines, each line is a record, which lets Spark split large files; malformed lines are left out.
    """
    try:
        df = spark.read.schema(StructType([*schema.fields]).add("_broken", "string")).option("multiLine", not lines).option("columnNameOfCorruptRecord", "_broken").json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return df.where(F.col("_broken").isNull()).drop("_broken")


def write_splits(df: DataFrame, folder: str, split_col: str = "split") -> None:
    """One output for each split, in place of what was there."""
    df.write.partitionBy(split_col).mode("overwrite").parquet(folder)


def read_split(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """One split: only its own files are read."""
    return spark.read.parquet(folder).where(F.col("split") == split).drop("split")


def preview(df: DataFrame, n: int = 1000) -> tuple[DataFrame, bool]:
    """The first n rows, and whether there are more, found by fetching n + 1."""
    return df.limit(n), df.limit(n + 1).count() > n


@dataclass
class SourceTable:
    """A table whose rows are replaced source by source, in a folder that driver and executors share.

    A manifest says for each source which write holds its rows; so a merge writes the rows of its own source and leaves all
    other files as they are, and counts once its line of the manifest is written. There are few sources.
    """

    spark: SparkSession
    path: str
    source_col: str = "source"

    def _newest(self) -> dict:
        try:
            lines = self.spark.read.schema("source string, number bigint, place string, digest string").parquet(f"{self.path}/manifest")
        except AnalysisException:
            return {}
        return {r["source"]: r for r in lines.groupBy("source").agg(F.max_by(F.struct("number", "place", "digest"), "number").alias("l")).select("source", "l.*").collect()}

    def _write(self, rows: DataFrame, digests: dict, known: dict) -> None:
        place, number = uuid.uuid4().hex[:12], 1 + max([r["number"] for r in known.values()], default=-1)
        rows.write.partitionBy(self.source_col).parquet(f"{self.path}/rows/{place}")
        lines = [(s, number, place, d) for s, d in digests.items()]
        self.spark.createDataFrame(lines, "source string, number bigint, place string, digest string").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def _digests(self, rows: DataFrame) -> dict:
        """What the rows of each source are, however they are ordered."""
        h = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])
        found = rows.groupBy(F.col(self.source_col).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("t"))
        return {r["s"]: f"{r['n']}/{r['x']}/{r['t']}" for r in found.collect()}

    def load(self, rows: DataFrame) -> None:
        """Puts rows in the place of those of all their sources."""
        digests, known = self._digests(rows), self._newest()
        changed = {s: d for s, d in digests.items() if s not in known or known[s]["digest"] != d}
        if changed:
            named = [s for s in changed if s is not None]
            hit = F.col(self.source_col).isin(named) | (F.col(self.source_col).isNull() if None in changed else F.lit(False))
            self._write(rows.where(hit), changed, known)

    def merge(self, incoming: DataFrame, source: str) -> bool:
        """Puts incoming in the place of the source's rows; merging the same rows again writes nothing, and gives False."""
        rows, known = incoming.withColumn(self.source_col, F.lit(source)), self._newest()
        digest = self._digests(rows).get(source, "none")
        if source in known and known[source]["digest"] == digest:
            return False
        self._write(rows, {source: digest}, known)
        return True

    def read(self) -> DataFrame:
        """The rows of all sources. Of each write only the sources that it still holds are read."""
        by_place: dict[str, list] = {}
        for source, line in self._newest().items():
            if line["digest"] != "none":
                by_place.setdefault(line["place"], []).append(source)
        frames = []
        for place, sources in sorted(by_place.items()):
            c = F.col(self.source_col)
            hit = c.isin([s for s in sources if s is not None]) | (c.isNull() if None in sources else F.lit(False))
            with_text = self.spark.read.option("basePath", f"{self.path}/rows/{place}").parquet(f"{self.path}/rows/{place}").withColumn(self.source_col, c.cast("string"))
            frames.append(with_text.where(hit))
        if not frames:
            raise ValueError("no source has rows")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
