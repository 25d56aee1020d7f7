"""Records of CSV files whose quoted fields hold line breaks, found without giving up that large files are split.

What a line does to "inside a quoted field" is a function of two states, and so is what a split of a file
does, which is its lines' functions composed. So every split is read by itself, the functions of the splits
of a file are composed in order, and then each split knows whether it begins inside a quoted field. Only the
pieces of records that cross from one split to the next are put together afterwards.
"""

from __future__ import annotations

import csv
import io
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import written

QUOTE = '"'
#: Types that a column of text may have, from narrow to wide: a type, and what its texts look like.
TYPES = (
    ("int", r"^[+-]?\d{1,10}\z"),
    ("bigint", r"^[+-]?\d{1,19}\z"),
    ("double", r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z|^NaN\z|^-?Infinity\z"),
    ("date", r"^\d{4}-\d{2}-\d{2}\z"),
    ("timestamp", r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}.*\z"),
    ("boolean", r"^(?i:true|false)\z"),
)


def scan(line: str, inside: bool, separator: str = ",") -> tuple[bool, list[int]]:
    """Whether a line that begins inside a quoted field (or not) ends inside one, and where in it records end at a lone carriage return.

    A field is quoted if a quote is its first character; two quotes in it are one of its characters; after the
    closing quote, and in other fields, quotes mean nothing up to the next separator.
    """
    i, n, ends = 0, len(line), []
    while True:
        if not inside and line.startswith(QUOTE, i):
            inside, i = True, i + 1
        if inside:
            j = line.find(QUOTE, i)
            while j >= 0 and line.startswith(QUOTE, j + 1):
                j = line.find(QUOTE, j + 2)
            if j < 0:
                return True, ends
            inside, i = False, j + 1
        comma, turn = line.find(separator, i), line.find("\r", i)
        if 0 <= turn < n - 1 and (comma < 0 or turn < comma):  # the last one belongs to the line's end
            ends.append(turn)
            i = turn + 1
        elif comma < 0:
            return False, ends
        else:
            i = comma + len(separator)


def lines_of(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """value, file, block of each line, in the order of its split."""
    lines = spark.read.option("lineSep", "\n").text(path)
    value = F.col("value") if encoding == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)
    return lines.select(value.alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def effects(lines: DataFrame, separator: str = ",") -> DataFrame:
    """file, block, from_outside, from_inside, opens of splits with quotes: in which state a split ends from either, and whether a line break
    lies in quotes if it begins outside them."""

    def run(batches: Iterator[pa.RecordBatch]):
        splits: dict[tuple[str, int], list[bool]] = {}
        for batch in batches:
            for value, file, block in zip(*(batch.column(c).to_pylist() for c in ("value", "file", "block"))):
                ends = splits.setdefault((file, block), [False, True, False])
                same = ends[0] == ends[1]
                ends[0] = scan(value, ends[0], separator)[0]
                ends[1] = ends[0] if same else scan(value, ends[1], separator)[0]
                ends[2] |= ends[0]
        columns = [*zip(*((*k, *v) for k, v in splits.items()))] or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()))], names=["file", "block", "from_outside", "from_inside", "opens"])

    quoted = lines.where(F.contains("value", F.lit(QUOTE)))  # another line leaves either state as it is
    return quoted.mapInArrow(run, "file string, block bigint, from_outside boolean, from_inside boolean, opens boolean")


def beginning_inside(found: DataFrame) -> set[tuple[str, int]]:
    """The places (file, where a quoted split ended before) after which splits begin inside quotes, up to the next such place.

    The state after some splits is that of the last one that leaves no choice, turned over by each swap since then.
    """
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swaps = F.sum(F.when(F.col("from_outside") & ~F.col("from_inside"), 1).otherwise(0)).over(before)
    counted = found.withColumn("swaps", swaps)
    fixed = F.last(F.when(F.col("from_outside") == F.col("from_inside"), F.struct("from_outside", "swaps")), ignorenulls=True).over(before)
    state = counted.withColumn("fixed", fixed).select("file", "block", ((F.coalesce(F.col("fixed.from_outside").cast("int"), F.lit(0)) + F.col("swaps") - F.coalesce("fixed.swaps", F.lit(0))) % 2 == 1).alias("inside"))
    return {(r["file"], r["block"], r["inside"]) for r in state.collect()}


def pieces(lines: DataFrame, after: set, separator: str = ",") -> DataFrame:
    """file, block, number, record, begun, open: the records of each split, of which the first may have begun before it and the last may go on
    after it. after tells the state behind each split that has quotes; the driver holds one entry for each, as it does for the plan of the scan."""
    by_file: dict[str, list[tuple[int, bool]]] = {}
    for file, block, inside in sorted(after):
        by_file.setdefault(file, []).append((block, inside))
    shared = lines.sparkSession.sparkContext.broadcast(by_file)

    def starts_inside(file: str, block: int) -> bool:
        known = shared.value.get(file, [])
        i = bisect_left(known, (block, False)) - 1
        return i >= 0 and known[i][1]

    types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]):
        split = None
        for batch in batches:
            out = []
            for value, file, block in zip(*(batch.column(c).to_pylist() for c in ("value", "file", "block"))):
                if (file, block) != split:
                    if split and held:
                        out.append((*split, number, "\n".join(held), begun, True))
                    split, number, held = (file, block), 0, []
                    inside = begun = starts_inside(file, block)
                    value = value.removeprefix("\ufeff") if not block else value
                inside, ends = scan(value, inside, separator)
                at = 0
                for end in ends:
                    out.append((*split, number, "\n".join([*held, value[at:end]]), begun, False))
                    at, held, number, begun = end + 1, [], number + 1, False
                held.append(value[at:])
                if not inside:
                    out.append((*split, number, "\n".join(held).removesuffix("\r"), begun, False))
                    held, number, begun = [], number + 1, False
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, types)], names=["file", "block", "number", "record", "begun", "open"])
        if split and held:
            last = (*split, number, "\n".join(held), begun, True)
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(last, types)], names=["file", "block", "number", "record", "begun", "open"])

    return lines.mapInArrow(run, "file string, block bigint, number bigint, record string, begun boolean, open boolean")


def whole_records(found: DataFrame) -> DataFrame:
    """file, block, number, record from pieces: those of one record are put together; two at most of a split belong to a record of another."""
    whole = found.where("NOT begun AND NOT open").select("file", "block", "number", "record")
    parts = found.where("begun OR open")
    order = Window.partitionBy("file").orderBy("block", "number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.withColumn("of", F.sum((~F.col("begun")).cast("int")).over(order))
    piece = F.struct("block", "number", "record")
    joined = parts.groupBy("file", "of").agg(F.sort_array(F.collect_list(piece)).alias("all"))
    joined = joined.select("file", F.col("all")[0]["block"].alias("block"), F.col("all")[0]["number"].alias("number"), F.array_join(F.transform("all", lambda p: p["record"]), "\n").alias("record"))
    return whole.unionByName(joined.withColumn("record", F.regexp_replace("record", r"\r\z", "")))


def typed(texts: DataFrame) -> DataFrame:
    """texts with each column of the narrowest type that fits all its values; without values, text."""
    fits = lambda c, t, look: F.when(c.isNull(), True).otherwise(c.rlike(look) & c.try_cast(t).isNotNull())
    checks = [F.min(fits(F.col(f"`{c}`"), t, look)).alias(f"{i}_{t}") for i, c in enumerate(texts.columns) for t, look in TYPES]
    some = [F.count(F.col(f"`{c}`")).alias(f"{i}_n") for i, c in enumerate(texts.columns)]
    seen = texts.agg(*checks, *some).first()
    kinds = [next((t for t, _ in TYPES if seen[f"{i}_n"] and seen[f"{i}_{t}"]), "string") for i in range(len(texts.columns))]
    return texts.select(*[F.col(f"`{c}`").try_cast(k).alias(c) for c, k in zip(texts.columns, kinds)])


def read_records(spark: SparkSession, path: str, encoding: str = "UTF-8", separator: str = ",") -> tuple[DataFrame, list[str]] | None:
    """The rows of the CSV files at path as texts, with their quoted line breaks, and the fields of the first file's
    first record, which counts as a header and is no row; None where no quoted field has a line break.

    Each file has its own header. A record of few fields has nulls at its end, and fields beyond the header's
    are left out, as Spark's reader does; empty lines between records are no records, and empty fields are null.
    A quote that is never closed holds all that follows in its file.
    """
    lines = lines_of(spark, path, encoding)
    found = written(effects(lines, separator), "csv-quotes")
    if not found.where("opens").limit(1).count():
        return None
    records = written(whole_records(pieces(lines, beginning_inside(found), separator)).where(F.trim("record") != ""), "csv-records")
    place = F.struct("block", "number")
    heads = records.groupBy("file").agg(F.min_by("record", place).alias("head"), F.min(place).alias("first"))
    head = heads.agg(F.min_by("head", "file").alias("head")).first()["head"]
    names = next(csv.reader(io.StringIO(head, newline=""), delimiter=separator))
    rows = records.join(heads.select("file", "first"), "file").where(place != F.col("first"))
    fields = ", ".join(f"_c{i} string" for i in range(len(names)))
    return rows.select(F.from_csv("record", fields, {"sep": separator, "quote": QUOTE, "escape": QUOTE}).alias("r")).select("r.*"), names
