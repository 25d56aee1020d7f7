"""Vocabularies of token arrays, encoding to ids and back, padding."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .ranges import place

SPECIALS = ("<pad>", "<sos>", "<eos>", "<unk>")
PAD, SOS, EOS, UNKNOWN = range(4)
#: Of a vocabulary, tokens of so many letters in all (and 16 for each token) are broadcast, the first ones; they are counted by blocks.
BROADCAST_LETTERS, BLOCK = 16_000_000, 4096


def build_vocab(tokens: DataFrame, column: str = "tokens", min_freq: int = 1, force: Sequence[str] = ()) -> DataFrame:
    """token, idx, freq: specials first, then forced tokens in order, then by falling frequency (ties by token)."""
    spark = tokens.sparkSession
    counts = written(tokens.select(F.explode(column).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("freq")), "vocab-counts")
    forced = [t for t in sorted(set(force)) if t not in SPECIALS]
    fixed = spark.createDataFrame([(t, i) for i, t in enumerate([*SPECIALS, *forced])], "token string, idx bigint")
    learnt = counts.where((F.col("freq") >= min_freq) & ~F.col("token").isin(*SPECIALS, *forced))
    learnt = place(learnt, [F.desc("freq"), F.asc("token")], "idx").select("token", (F.col("idx") - 1 + len(SPECIALS) + len(forced)).alias("idx"), "freq")
    return fixed.join(counts, "token", "left").select("token", "idx", F.coalesce("freq", F.lit(0)).alias("freq")).unionByName(learnt)


def broadcast_part(vocab: DataFrame) -> tuple[int, bool]:
    """The idx below which tokens are broadcast, and whether these are all."""
    blocks = vocab.groupBy(F.floor(F.col("idx") / BLOCK).alias("block")).agg(F.coalesce(F.sum(F.length("token") + 16), F.lit(0)).alias("n"))
    letters = 0
    for r in blocks.orderBy("block").collect():  # one row for each block
        letters += r["n"]
        if letters > BROADCAST_LETTERS:
            return r["block"] * BLOCK, False
    return 0, True


def shared_pair(known: DataFrame):
    """A broadcast of the two columns of a small table as Arrow arrays."""
    table = known.toArrow()
    return known.sparkSession.sparkContext.broadcast((table.column(0).combine_chunks(), table.column(1).combine_chunks()))


def looked_up(rows: DataFrame, key: str, column: str, name: str, known: DataFrame, default: object) -> DataFrame:
    """key, name: each row's array with every entry replaced by what known (two columns, a small table) says, or by default; null arrays are empty."""
    kind = known.dtypes[1][1]
    shared = shared_pair(known)
    values = F.coalesce(F.col(column), F.array().cast(dict(rows.dtypes)[column]))

    def run(batches: Iterator[pa.RecordBatch]):
        names, meanings = shared.value
        for batch in batches:
            lists = batch.column(1)
            found = pc.fill_null(meanings.take(pc.index_in(lists.flatten(), value_set=names)), default)
            offsets = pc.subtract(lists.offsets, lists.offsets[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, found)], names=[key, name])

    return rows.select(F.col(key), values.alias(name)).mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, `{name}` array<{kind}>")


def listed(lists: pa.ListArray, values: pa.Array) -> pa.ListArray:
    """values in lists as long as those of lists."""
    return pa.ListArray.from_arrays(pc.subtract(lists.offsets, lists.offsets[0]), values)


def completed(values: pa.Array, lists: pa.ListArray, asked: pa.Array, found: pa.Array, default: object) -> pa.Array:
    """values, the entries of lists, with null ones replaced by what their row's pairs in found say of the next of asked, or by default."""
    gaps = pc.is_null(values)
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))[gaps.to_numpy(zero_copy_only=False)]
    says = [{tuple(d.values())[0]: tuple(d.values())[1] for d in pairs or ()} for pairs in found.to_pylist()]
    return pc.replace_with_mask(values, gaps, pa.array([says[r].get(x, default) for r, x in zip(row, asked.to_pylist())], values.type))


def with_found(rows: DataFrame, key: str, asked: DataFrame, rest: DataFrame) -> DataFrame:
    """rows with _found, the pairs of rest (two columns) whose first is among what is asked for (key, and that column) under the row's key."""
    name = rest.columns[0]
    pairs = asked.join(rest, name).groupBy(F.col(key).alias("_key")).agg(F.collect_list(F.struct(*rest.columns)).alias("_found"))
    return rows.join(pairs, rows[key].eqNullSafe(pairs["_key"]), "left").drop("_key")


def encode(rows: DataFrame, vocab: DataFrame, key: str, column: str = "tokens", name: str = "ids") -> DataFrame:
    """key, ids: the array of ids of each row's tokens, unknown ones as <unk>; rows without tokens get an empty array.

    Tokens of BROADCAST_LETTERS letters are broadcast, the most frequent ones, and arrays are encoded where they are
    read. Only what is left of a larger vocabulary is joined with the few tokens that this leaves open.
    """
    most, whole = broadcast_part(vocab)
    if whole:
        return looked_up(rows, key, column, name, vocab.select("token", "idx"), UNKNOWN)
    shared = shared_pair(vocab.where(F.col("idx") < most).select("token", F.col("idx").cast("int")))

    def first(batches: Iterator[pa.RecordBatch]):
        names, meanings = shared.value
        for batch in batches:
            lists = batch.column(1)
            tokens = lists.flatten()
            ids = meanings.take(pc.index_in(tokens, value_set=names))
            open_ = pc.is_null(ids)
            before = np.concatenate([[0], np.cumsum(open_.to_numpy(zero_copy_only=False))])[pc.subtract(lists.offsets, lists.offsets[0]).to_numpy()]
            rare = pa.ListArray.from_arrays(pa.array(before, pa.int32()), tokens.filter(open_))
            yield pa.RecordBatch.from_arrays([batch.column(0), listed(lists, ids), rare], names=[key, "_ids", "_rare"])

    def second(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            lists = batch.column(1)
            ids = completed(lists.flatten(), lists, batch.column(2).flatten(), batch.column(3), UNKNOWN)
            yield pa.RecordBatch.from_arrays([batch.column(0), listed(lists, ids.cast(pa.int64()))], names=[key, name])

    kind = dict(rows.dtypes)[key]
    values = F.coalesce(F.col(column), F.array().cast(dict(rows.dtypes)[column]))
    coded = rows.select(F.col(key), values.alias(name)).mapInArrow(first, f"`{key}` {kind}, _ids array<int>, _rare array<string>")
    asked = coded.select(key, F.explode(F.array_distinct("_rare")).alias("token"))
    return with_found(coded, key, asked, vocab.where(F.col("idx") >= most).select("token", "idx")).mapInArrow(second, f"`{key}` {kind}, `{name}` array<bigint>")


def decode(rows: DataFrame, vocab: DataFrame, key: str, column: str = "ids", name: str = "tokens") -> DataFrame:
    """key, tokens: encode's way back; ids that the vocabulary lacks become <unk>, rows without ids get an empty array."""
    most, whole = broadcast_part(vocab)
    if whole:
        return looked_up(rows, key, column, name, vocab.select("idx", "token"), SPECIALS[UNKNOWN])
    shared = shared_pair(vocab.where(F.col("idx") < most).select("idx", "token"))

    def run(batches: Iterator[pa.RecordBatch]):
        names, meanings = shared.value
        for batch in batches:
            lists = batch.column(1)
            ids = lists.flatten()
            tokens = meanings.take(pc.index_in(ids, value_set=names))
            tokens = completed(tokens, lists, ids.filter(pc.is_null(tokens)), batch.column(2), SPECIALS[UNKNOWN])
            yield pa.RecordBatch.from_arrays([batch.column(0), listed(lists, tokens)], names=[key, name])

    ids = rows.select(F.col(key), F.coalesce(F.col(column), F.array().cast(dict(rows.dtypes)[column])).cast("array<bigint>").alias("_ids"))
    asked = ids.select(key, F.explode(F.array_distinct(F.filter("_ids", lambda x: x >= most))).alias("idx"))
    return with_found(ids, key, asked, vocab.where(F.col("idx") >= most).select("idx", "token")).mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, `{name}` array<string>")


def padded_source(ids: Column, length: int = 128) -> tuple[Column, Column]:
    """ids cut or padded with zeros to length, and the true length after cutting."""
    cut = F.slice(ids, 1, length)
    return F.concat(cut, F.array_repeat(F.lit(PAD).cast("bigint"), F.lit(length) - F.size(cut))), F.size(cut)


def padded_target(ids: Column, length: int = 128) -> tuple[Column, Column]:
    """Start, ids, end, cut so that the end stays last, then padded; and the true length."""
    one = lambda x: F.array(F.lit(x).cast("bigint"))
    framed = F.concat(one(SOS), F.slice(ids, 1, length - 2), one(EOS))
    return F.concat(framed, F.array_repeat(F.lit(PAD).cast("bigint"), F.lit(length) - F.size(framed))), F.size(framed)


def not_empty(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows in which none of the id arrays is empty or null."""
    for c in columns:
        rows = rows.where(F.size(c) > 0)
    return rows
