"""Near copies by the Jaccard similarity of their word shingles, exactly: SimHash near-dedup's grid first,
then what it can't reach.

Fingerprints of the shingle sets are linked on the grid of segment counts (simhash), and each link is
verified on all shingles. That joins the nearest copies. Two sets of similarity SHARE may still lie many
bits apart, so the rest is found by prefixes: they share a shingle among the first ones of both, in any
one order of all shingles: of n, the first n - ceil(SHARE n) + 1. Nothing is estimated: every pair of
SHARE or more is linked, directly or through others, and no other.

Groups of copies don't make all their pairs. Of the sets that share a first shingle, each is compared with
two of them: one drawn for that shingle, and the one that has it at the earliest place, which is mostly the text
nearest to what the group has in common. Sets that this leaves outside the largest component are compared with two
of that in the same way. Then only sets of different components are compared, where sizes,
places and the parity of the sets' hashed shingles leave it open whether they can reach SHARE. Whole
shingle sets travel only for pairs that a parity as fine as their size leaves open too. The order
of shingles is that of their hashes, except that those a sample of the documents finds often come last.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import simhash
from .common import batch_by_batch, discard, few_of_many, text_batches, without, written
from .exact_dedup import located
from .simhash import SEED

#: Least similarity of a link, as a fraction, and words of a shingle.
SHARE, WORDS = (4, 5), 5
#: Documents, about, whose shingles are counted, the least count of an often found one, and the most such.
SAMPLE, OFTEN, MOST = 2000, 5, 20_000
#: Bits of a set's parity, of which no more differ between two sets than shingles do; a fine one has so many for each shingle.
PARITY, FINE = 1024, 4
#: Draws of the set that others are compared with: shingles deal them out, so a set meets so many of a group, about.
DRAWS = 8


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of a text's distinct shingles in order; a text with fewer words has one of all of them.

    Words are runs of anything but ASCII white space, after A-Z become a-z.
    """
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    line, n = b" ".join(w), max(len(w) - words + 1, 1)
    ends = [*accumulate(len(x) + 1 for x in w)]
    starts = [0, *ends]
    last = [*ends[words - 1 :]] if len(w) >= words else [len(line) + 1]
    return np.unique(np.fromiter((xxh64_intdigest(line[a : b - 1], SEED) for a, b in zip(starts[:n], last)), np.uint64, n))


def prefix(found: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The shingles of which two similar sets must share one."""
    late = np.isin(found, often)
    a, b = SHARE
    return np.concatenate([found[~late], found[late]])[: len(found) - -(-a * len(found) // b) + 1]


def parity(found: np.ndarray, bits: int = PARITY) -> np.ndarray:
    """For each of so many classes of hashes, whether an odd number of the shingles falls there, in 64-bit words."""
    odd = np.bincount((found % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def fine_bits(size: int) -> int:
    return max(PARITY, 1 << (FINE * size - 1).bit_length())


def differing(a: Column, b: Column) -> Column:
    """How many bits of two parities differ."""
    out = F.bit_count(a[0].bitwiseXOR(b[0]))
    for i in range(1, PARITY // 64):
        out = out + F.bit_count(a[i].bitwiseXOR(b[i]))
    return out


def finely_differing(a: Column, b: Column) -> Column:
    """The same of two fine parities; one may have twice as many bits, and then the sum of its halves is taken."""
    n = F.least(F.size(a), F.size(b))
    half = lambda x: F.when(F.size(x) > n, F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, n + 1, n), lambda p, q: p.bitwiseXOR(q))).otherwise(x)
    return F.aggregate(F.zip_with(half(a), half(b), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda k, c: k + c)


def often_found(rows: DataFrame, at: str, text_col: str, words: int) -> np.ndarray:
    """The shingles that many documents of a sample have, at most MOST."""

    @F.pandas_udf("array<long>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return batch_by_batch(texts, lambda text: pd.Series([shingles(t, words).view(np.int64) for t in text]))

    every = max(1, rows.count() // SAMPLE)
    sample = text_batches(rows.where(F.pmod(F.xxhash64(f"`{at}`"), F.lit(every)) == 0)).select(F.explode(of(F.col(f"`{text_col}`"))).alias("shingle"))
    counts = sample.groupBy("shingle").count().where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "shingle").limit(MOST)
    return np.array([r["shingle"] for r in counts.collect()], np.int64).view(np.uint64)


def shingle_sets(rows: DataFrame, at: str, text_col: str, words: int) -> DataFrame:
    """at, set (hash of the shingles, the same for equal sets), fp, size, first, parity of every row."""
    often = rows.sparkSession.sparkContext.broadcast(often_found(rows, at, text_col, words))  # bounded

    def one(text: pd.Series) -> pd.DataFrame:
        out = []
        for t in text:
            s = shingles(t, words)
            name = int(np.uint64(xxh64_intdigest(s.tobytes(), SEED)).astype(np.int64))
            out.append((name, simhash.majority(s), len(s), prefix(s, often.value).view(np.int64), parity(s)))
        return pd.DataFrame(out, columns=["set", "fp", "size", "first", "parity"])

    @F.pandas_udf("set long, fp long, size int, first array<long>, parity array<long>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return batch_by_batch(texts, one)

    return text_batches(rows).select(F.col(f"`{at}`").alias("at"), of(F.col(f"`{text_col}`")).alias("_s")).select("at", "_s.*")


def side(rows: DataFrame, tag: str) -> DataFrame:
    return rows.select(*[F.col(c).alias(c if c == "shingle" else f"{c}_{tag}") for c in rows.columns])


def reachable(placed: bool) -> Column:
    """Whether sizes, and the places of a shared shingle, leave two sets a similarity of SHARE."""
    n, d = SHARE
    sizes = F.least("size_a", "size_b") * d >= F.greatest("size_a", "size_b") * n
    if not placed:
        return sizes
    left = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
    return sizes & (left * (n + d) >= (F.col("size_a") + F.col("size_b")) * n)


def even_enough(bits: Column | None = None) -> Column:
    """Whether the parities, of which so many bits differ, leave two sets a similarity of SHARE: that many shingles may differ."""
    n, d = SHARE
    bits = differing(F.col("parity_a"), F.col("parity_b")) if bits is None else bits
    return bits * (n + d) <= (F.col("size_a") + F.col("size_b")) * (d - n)


@dataclass
class Texts:
    """Rows whose shingles are read again where pairs are verified: their place column, text column and words a shingle."""

    rows: DataFrame
    at: str
    text_col: str
    words: int

    def of(self, members: DataFrame) -> DataFrame:
        """set, all (its shingles), fine (their parity) for members: set, at, pairs (how many, one at least)."""
        words = self.words

        def one(text: pd.Series) -> pd.DataFrame:
            found = [shingles(t, words) for t in text]
            return pd.DataFrame({"all": [s.view(np.int64) for s in found], "fine": [parity(s, fine_bits(len(s))) for s in found]})

        @F.pandas_udf("struct<all:array<bigint>,fine:array<bigint>>")
        def whole(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            return batch_by_batch(texts, one)

        place = F.col(f"`{self.at}`")
        with few_of_many(self.rows.sparkSession):
            spots = written(members.select(F.xxhash64("at").alias("spot"), "at", "set", "pairs"), "near-members")
            met = self.rows.select(F.xxhash64(place).alias("spot"), place.alias("place"), F.col(f"`{self.text_col}`").alias("text")).join(spots.where("pairs > 0").hint("merge"), "spot").where(F.col("place") == F.col("at"))
            return written(text_batches(met).select("set", whole(F.col("text")).alias("_w")).select("set", "_w.*"), "near-full")


def verified(pairs: DataFrame, sets: DataFrame, texts: Texts, label: str) -> DataFrame:
    """Links a > b: the pairs set_a, set_b whose sets have a similarity of SHARE or more, on all their shingles."""
    n, d = SHARE
    short = sets.select("set", "size", "parity")
    pairs = pairs.join(side(short, "a"), "set_a").join(side(short, "b"), "set_b").where(reachable(False) & even_enough())
    pairs = written(pairs.select("set_a", "set_b", "size_a", "size_b"), label)
    members = pairs.select(F.explode(F.array("set_a", "set_b")).alias("set")).groupBy("set").agg(F.count(F.lit(1)).alias("pairs"))
    full = texts.of(members.join(sets.select("set", "at"), "set"))
    fine, whole = full.select("set", "fine"), full.select("set", "all")
    close = pairs.join(side(fine, "a"), "set_a").join(side(fine, "b"), "set_b").where(even_enough(finely_differing(F.col("fine_a"), F.col("fine_b"))))
    close = written(close.select("set_a", "set_b"), f"{label}-close")
    near = written(close.select(F.explode(F.array("set_a", "set_b")).alias("set")).groupBy("set").agg(F.count(F.lit(1)).alias("pairs")), f"{label}-near")
    with few_of_many(sets.sparkSession):  # whole sets travel for these only
        whole = written(whole.join(near.where("pairs > 0").hint("merge"), "set").select("set", "all"), f"{label}-whole")
    both, either = F.size(F.array_intersect("all_a", "all_b")), F.size("all_a") + F.size("all_b")
    similar = close.join(side(whole, "a"), "set_a").join(side(whole, "b"), "set_b").where(both * (n + d) >= either * n)  # both / (either - both) >= n / d
    found = similar.select(F.greatest("set_a", "set_b").alias("a"), F.least("set_a", "set_b").alias("b")).checkpoint()
    for done in (pairs, full, close, near, whole):
        discard(done)
    return found


def grid_pairs(sets: DataFrame) -> DataFrame:
    """Pairs set_a, set_b that the SimHash grid puts within two bits, through the smallest set of each fingerprint."""
    heads = written(sets.groupBy("fp").agg(F.min("set").alias("head")), "near-prints")
    near = simhash.links(simhash.near_on_grid(heads.select("fp")))
    across = near.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("set_a")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("set_b")), "b")
    same = sets.join(heads, "fp").where(F.col("set") != F.col("head")).select(F.col("set").alias("set_a"), F.col("head").alias("set_b"))
    return across.select("set_a", "set_b").unionByName(same)


def chosen(rows: DataFrame, turn: int) -> DataFrame:
    """shingle, ones: two of the sets that have a shingle, one drawn (anew in each turn) and one that has it at the earliest place."""
    draw = F.xxhash64("set", F.pmod("shingle", F.lit(DRAWS)), F.lit(turn)).alias("draw")
    both = rows.groupBy("shingle").agg(F.min(F.struct(draw, "set", "size", "place")).alias("drawn"), F.min(F.struct("place", draw, "set", "size")).alias("early"))
    return both.select("shingle", F.array_distinct(F.array(*[F.struct(*[F.col(f"{one}.{c}").alias(c) for c in ("set", "size", "place")]) for one in ("drawn", "early")])).alias("ones"))


def with_chosen(rows: DataFrame, ones: DataFrame) -> DataFrame:
    """Pairs set_a, set_b of rows with the ones of their shingles, where sizes and places leave a similarity of SHARE."""
    met = rows.join(ones, "shingle").select("set", "size", "place", F.explode("ones").alias("one")).where("set <> one.set")
    met = met.select(*[F.col(c).alias(f"{c}_a") for c in ("set", "size", "place")], *[F.col(f"one.{c}").alias(f"{c}_b") for c in ("set", "size", "place")])
    return met.where(reachable(True)).select("set_a", "set_b")


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("set_a", "set_b").alias("set_a"), F.least("set_a", "set_b").alias("set_b")).distinct()


def mixed_buckets(shared: DataFrame, found: DataFrame) -> DataFrame:
    """shingle, set, size, place, root, outside (of the bucket's largest component) where sets of several components, by the links found, share a shingle."""
    roots = simhash.rooted(found, "set")
    left = written(shared.where("n > 2").select("shingle", "set", "size", "place").join(roots, "set", "left").withColumn("root", F.coalesce("root", "set")), "near-left")
    parts = left.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("members"))
    mixed = parts.groupBy("shingle").agg(F.max_by("root", F.struct("members", "root")).alias("largest"), F.count(F.lit(1)).alias("roots")).where("roots > 1").drop("roots")
    out = written(left.join(mixed, "shingle").withColumn("outside", F.col("root") != F.col("largest")).drop("largest"), "near-mixed")
    discard(left)
    return out


def near_links(sets: DataFrame, texts: Texts) -> DataFrame:
    """Links a > b of distinct sets that join all sets of similarity SHARE or more, directly or through others."""
    spark = sets.sparkSession
    heads = sets.select("set", "size", F.posexplode("first").alias("place", "shingle"))
    counts = written(heads.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "near-counts")
    with few_of_many(spark):  # most shingles are of one set
        shared = written(heads.join(counts.where("n > 1").hint("merge"), "shingle"), "near-shared")
    found = verified(ordered(with_chosen(shared, chosen(shared, 0)).unionByName(grid_pairs(sets))), sets, texts, "near-first")

    # What is left: members of one bucket that are in different components so far. At least one of such a pair is outside the
    # bucket's largest component, so members of that one, of which there may be many, aren't paired with one another.
    left = mixed_buckets(shared, found)
    more = verified(ordered(with_chosen(left.where("outside"), chosen(left.where("NOT outside"), 1))), sets, texts, "near-second")
    if not more.isEmpty():
        discard(left)
        found = found.unionByName(more).checkpoint()
        left = mixed_buckets(shared, found)
    # The rest of these pairs, all of them.
    mixed, left = left, written(left.join(sets.select("set", "parity"), "set"), "near-apart")
    once = ~F.col("outside_b") | (F.col("set_a") > F.col("set_b"))
    apart = (F.col("root_a") != F.col("root_b")) & once & reachable(True) & even_enough()
    across = side(left.where("outside"), "a").join(side(left, "b"), "shingle").where(apart)
    every = found.unionByName(verified(ordered(across), sets, texts, "near-third"))
    for done in (counts, shared, mixed, left):
        discard(done)
    return every


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """docs with one row of each group of near copies, with docs' columns.

    Rows are linked where the Jaccard similarity of their shingles is SHARE or more, and texts without
    words (null or empty ones too) with each other; groups are what links reach. The row with the smallest
    id stays, of several the first by file and row; rows with a null id stay and don't count. Very long
    texts are read whole. An empty table gives an empty result; other columns, whatever their names, are
    handed on.
    """
    rows, at = located(docs)
    prints = written(shingle_sets(rows, at, text_col, words), "near-prints")
    same = prints.groupBy("set").agg(F.min("at").alias("one"), F.count(F.lit(1)).alias("n")).where("n > 1")
    others = prints.select("set", "at").join(same, "set").where("at <> one").select("at")  # their first shingles and parities needn't travel
    sets = written(without(prints, "at", others), "near-sets")
    roots = simhash.rooted(near_links(sets, Texts(rows, at, text_col, words)), "set")
    discard(sets)
    groups = prints.select("at", "set").join(roots, "set", "left").select("at", F.coalesce("root", "set").alias("root"))
    return simhash.without_copies(rows, at, id_col, groups).select(*[F.col(f"`{c}`") for c in docs.columns])
