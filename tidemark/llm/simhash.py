"""SimHash near-dedup over a segment-popcount embedding.

A fingerprint of 64 bits maps to 32 counts, the set bits of each segment of two. The Manhattan
distance of two such vectors is at most the Hamming distance of their fingerprints, so fingerprints
within two bits lie within distance two on the grid of counts, and then share a grid cell that is at
most one step from either. A range join on cells leaves each fingerprint with the cells that another one
reaches too; these rows are then verified exactly on the bits.

Nothing here makes all pairs of a dense group: cells are pre-aggregated to a smallest and a largest
fingerprint, and in a cell fingerprints are compared with the smallest one around the bit pattern, one
bit from either, through which they may be linked.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import discard, few_of_many, text_batches, without, written
from .exact_dedup import located

SEED = 42
CHUNK = 1 << 15


def fingerprint(text: str | None, words: int = 3) -> int:
    """The SimHash of a text's word shingles, as a signed 64-bit integer; no words: zero."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    line, n = b" ".join(w), len(w) - words + 1
    if n <= 1:
        return int(np.uint64(xxh64_intdigest(line, SEED)).astype(np.int64))
    ends = list(accumulate(len(x) + 1 for x in w))
    starts = [0, *ends]
    counts = np.zeros(64, np.int64)
    for i in range(0, n, CHUNK):
        k = min(CHUNK, n - i)
        h = np.fromiter((xxh64_intdigest(line[a : b - 1], SEED) for a, b in zip(starts[i : i + k], ends[i + words - 1 : i + k + words - 1])), np.uint64, k)
        bits = np.unpackbits(h.view(np.uint8).reshape(k, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.int64)[0])


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of hashes, as a signed 64-bit integer: bits set in over half of them."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = hashes[i : i + CHUNK]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """<id_col>, fp of every row; whole texts, Arrow batches."""

    @F.pandas_udf("long")
    def of(text: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words) for t in text], dtype="int64")

    return text_batches(docs).select(F.col(f"`{id_col}`").alias("id"), of(F.col(f"`{text_col}`")).alias("fp"))


def popcounts(fp: Column) -> Column:
    """The 32 segment counts of a fingerprint, two bits (0 to 2) each."""
    odd, right = F.lit(0x5555555555555555), F.shiftrightunsigned(fp, 1)
    one, both = fp.bitwiseXOR(right).bitwiseAND(odd), fp.bitwiseAND(right).bitwiseAND(odd)
    return one.bitwiseOR(F.shiftleft(both, 1))


def cells(counts: Column) -> Column:
    """The grid cells at most one step from a vector of counts: 0 and 1 differ by binary 01, 1 and 2 by 11."""
    near = [counts]
    for i in range(0, 64, 2):
        digit = F.shiftrightunsigned(counts, i).bitwiseAND(F.lit(3))
        near.append(F.when(digit != 2, counts.bitwiseXOR(F.shiftleft(F.lit(1).cast("long"), i))))
        near.append(F.when(digit != 0, counts.bitwiseXOR(F.shiftleft(F.lit(3).cast("long"), i))))
    return F.array_compact(F.array(*near))


def midpoints(fp: Column, cell: Column) -> Column:
    """The patterns at most one bit from a fingerprint whose counts are those of a cell at most one step from it: two at most."""
    step = popcounts(fp).bitwiseXOR(cell)
    low = step.bitwiseOR(F.shiftrightunsigned(step, 1)).bitwiseAND(F.lit(0x5555555555555555))
    either = F.array_distinct(F.array(fp.bitwiseXOR(low), fp.bitwiseXOR(F.shiftleft(low, 1))))
    return F.filter(either, lambda p: popcounts(p) == cell)


def near_on_grid(distinct: DataFrame) -> DataFrame:
    """fp, cell, the range join: each fingerprint with the cells, at most one step from its counts, that another one reaches too.

    Cells are counted first; then probes of the few that several reach are all that is shuffled."""
    spark = distinct.sparkSession
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a row makes some fifty probes
    probes = distinct.repartition(spread, "fp").select("fp", F.explode(cells(popcounts(F.col("fp")))).alias("cell"))
    reached = written(probes.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-cells")
    with few_of_many(spark):
        met = written(probes.join(reached.where("n > 1").hint("merge"), "cell", "left_semi"), "simhash-met")
    discard(reached)
    return met


def links(met: DataFrame) -> DataFrame:
    """Links a > b of fingerprints within two bits, from the rows of near_on_grid, that join every such pair, directly or through a third.

    Two fingerprints within two bits are both at most one bit from some pattern, and so meet in its cell.
    There they are verified against the smallest fingerprint at that pattern; 65 at most share one.
    """
    at = met.select("fp", F.explode(midpoints(F.col("fp"), F.col("cell"))).alias("pattern"))
    near = at.groupBy("pattern").agg(F.collect_set("fp").alias("fps"))
    star = near.where(F.size("fps") > 1).select(F.explode("fps").alias("a"), F.array_min("fps").alias("b"))
    return star.where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Edges a > b to a, root: the smallest member of each connected component, by alternating stars.

    A round links every larger neighbour of a node to its smallest neighbour, then every smaller one;
    rounds end when the links no longer change. Each round's links are checkpointed.
    """

    def star(e: DataFrame, both: bool) -> DataFrame:
        around = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both else e
        least = around.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        to = around.join(least, "a")
        kept = to.where(F.col("b") > F.col("a")) if both else to
        out = kept.select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not both:
            out = out.unionByName(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def mark(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    edges = edges.checkpoint()
    before = mark(edges)
    while before[0]:
        edges = star(star(edges, True), False).checkpoint()
        now = mark(edges)
        if now == before:
            break
        before = now
    return edges.select("a", F.col("b").alias("root"))


def rooted(links: DataFrame, name: str) -> DataFrame:
    """name, root of all nodes that have a link."""
    roots = components(links)
    return roots.unionByName(roots.select(F.col("root").alias("a"), "root").distinct()).withColumnRenamed("a", name)


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """<id_col>, fp, component_id of every row of docs.

    Words are runs of anything but ASCII white space, after A-Z become a-z; a shingle is `words` words
    joined by spaces (a text with fewer: all of them). A text with no words, or null, has fingerprint
    zero, which is linked like any other. Fingerprints link at two or fewer differing bits;
    component_id is the smallest id that can be reached (null ids don't count; null if there is no
    other). Repeated rows each get a row. An empty table gives an empty result. Only the two columns
    named are read.
    """
    prints = written(fingerprints(docs, id_col, text_col, words), "simhash-prints")
    classes = written(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-classes")
    roots = rooted(links(near_on_grid(classes.select("fp"))), "fp")
    linked = classes.join(roots, "fp")
    smallest = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = linked.join(smallest, "root").select("fp", "component_id")
    labels = written(classes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "simhash-labels")
    return prints.join(labels, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def without_copies(rows: DataFrame, at: str, id_col: str, groups: DataFrame) -> DataFrame:
    """rows (located: at names each) without those that come after another of their group (groups: at, root).

    The row with the smallest id stays, of several the first by file and row; rows with a null id stay and
    don't count.
    """
    place = F.col(f"`{at}`")
    placed = rows.where(F.col(f"`{id_col}`").isNotNull()).select(F.struct(F.col(f"`{id_col}`").alias("id"), place.alias("at")).alias("row"), place.alias("at"))
    grouped = written(placed.join(groups, "at").select("row", "root"), "grouped")
    least = grouped.groupBy("root").agg(F.min("row").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    dropped = grouped.join(least, "root").where(F.col("row") != F.col("least")).select(F.col("row.at").alias(at))
    return without(rows, at, dropped)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """docs with one row of each group of fingerprints that links reach, with docs' columns, whatever their names.

    The row with the smallest id stays, of several the first by file and row; rows with a null id stay and
    don't count. Null and empty texts are alike; very long ones are read whole; an empty table gives an empty
    result.
    """
    rows, at = located(docs)
    prints = written(fingerprints(rows, at, text_col, words), "simhash-prints")
    roots = rooted(links(near_on_grid(prints.select("fp").distinct())), "fp")
    groups = prints.join(roots, "fp", "left").select(F.col("id").alias("at"), F.coalesce("root", "fp").alias("root"))
    return without_copies(rows, at, id_col, groups).select(*[F.col(f"`{c}`") for c in docs.columns])
