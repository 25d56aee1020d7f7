"""Token ids in binary files: blocks of whole documents, coded with a shared static table.

A folder has `table.freq` (frequencies as unsigned 32-bit integers), shards `*.ids`, whose names sort by
document id, and `manifest`, a Parquet table of the shards that belong to it. A shard is a row of blocks, then an index (a JSON list of [offset, size, block number,
documents, ids]), its length as 8 bytes, and the magic. A block is a header of seven 32-bit integers
(documents, ids, checkpoints, words, CRC-32 of what follows, of the table, of the ids), then document
ids, a byte for each that is 1 for a null id, lengths, checkpoint states and places, and the stream of words. All numbers are little-endian.
"""

from __future__ import annotations

import json
import struct
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rans
from .common import discard, text_batches, written
from .files import new_file, stored_file, tasks
from .pieces import in_groups
from .tokens import encoder

MAGIC = b"IDSRANS2"
HEAD = struct.Struct("<7I")
BLOCK = 1 << 18
END = 0


def pack_block(doc_ids: list, lengths: np.ndarray, ids: np.ndarray, table: rans.Table) -> bytes:
    states, places, stream = rans.encode(ids, table)
    none = np.array([d is None for d in doc_ids], bool)
    numbers = np.array([0 if d is None else d for d in doc_ids], np.int64)
    body = b"".join(np.asarray(a).astype(t).tobytes() for a, t in ((numbers, "<i8"), (none, "<u1"), (lengths, "<u4"), (states, "<u8"), (places, "<u4"), (stream, "<u4")))
    own = crc32(table.freq.astype("<u4").tobytes())
    return HEAD.pack(len(doc_ids), len(ids), len(states), len(stream), crc32(body), own, crc32(ids.astype("<u4").tobytes())) + body


def unpack_block(data: bytes, table: rans.Table) -> tuple[pd.Series, np.ndarray, np.ndarray]:
    """Document ids, lengths, ids; raises ValueError where a checksum or a length is wrong."""
    docs, n, checks, words, body_crc, table_crc, ids_crc = HEAD.unpack_from(data)
    body = memoryview(data)[HEAD.size :]
    if crc32(body) != body_crc or crc32(table.freq.astype("<u4").tobytes()) != table_crc:
        raise ValueError("a block's checksum is wrong")
    parts, at = [], 0
    for count, kind in ((docs, "<i8"), (docs, "<u1"), (docs, "<u4"), (checks * rans.LANES, "<u8"), (checks, "<u4"), (words, "<u4")):
        parts.append(np.frombuffer(body, kind, count, at))
        at += parts[-1].nbytes
    numbers, none, lengths, states, places, stream = parts
    ids = rans.decode(n, states.reshape(-1, rans.LANES), places, stream, table)
    if at != len(body) or lengths.sum(dtype=np.int64) != n or crc32(ids.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("a block's lengths or ids are wrong")
    return pd.Series(numbers, dtype="Int64").mask(none.astype(bool)), lengths, ids


def tokenised(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Blocks of whole documents in ascending order of id: part, block, doc_ids, lengths, ids (packed).

    A block closes with the document that fills it. Null text: the end id alone.
    """
    rows = text_batches(docs).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", "text")

    def blocks(batches):
        coder, part, number = encoder(tokenizer), TaskContext.get().partitionId(), 0
        held_ids, held, size = [], [], 0

        def flush():
            nonlocal number, held_ids, held, size
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "block": pa.array([number], pa.int32()), "doc_ids": pa.array([held_ids], pa.list_(pa.int64())), "lengths": pa.array([[len(x) for x in held]], pa.list_(pa.int64())), "ids": pa.array([np.concatenate(held).tobytes()], pa.binary())})
            number, held_ids, held, size = number + 1, [], [], 0
            return row

        for batch in batches:
            ids, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
            for a, b in in_groups(texts):
                for doc, found in zip(ids[a:b], coder.encode(texts[a:b])):
                    held_ids.append(doc)
                    held.append(np.append(found, coder.dtype.type(END)))
                    size += len(held[-1])
                    if size >= block:
                        yield flush()
        if held:
            yield flush()

    return rows.mapInArrow(blocks, "part int, block int, doc_ids array<bigint>, lengths array<bigint>, ids binary")


def frequencies(blocks: DataFrame, tokenizer: str) -> np.ndarray:
    """Counts of every id over all blocks; as many rows as the vocabulary reach the driver."""

    def count(batches):
        kind, total = encoder(tokenizer).dtype, np.zeros(1, np.int64)
        for batch in batches:
            for ids in batch.column("ids"):
                got = np.bincount(np.frombuffer(ids.as_buffer(), kind))
                total = np.pad(total, (0, max(0, len(got) - len(total))))
                total[: len(got)] += got
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(used, pa.int64()), "n": pa.array(total[used], pa.int64())})

    found = blocks.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(found["id"].max()) + 1 if len(found) else 1, np.int64)
    counts[found["id"].to_numpy(np.int64)] = found["n"]
    return counts


@lru_cache(maxsize=2)
def stored_table(folder: str) -> rans.Table:
    with stored_file(f"{folder}/table.freq") as f:
        return rans.Table(np.frombuffer(f.read(), "<u4"))


def write_ids(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> None:
    """Writes docs' token ids, each document's followed by the end id, to a folder of the shared file system.

    Documents go by ascending id (null ids first), rows repeated with one id by text; null text is
    the end id alone; very long documents make a large block; an empty table writes a table and no
    shards. Other columns aren't read. A task that runs again writes shards under new names, and the
    manifest names those of the attempts that counted.
    """
    blocks = written(tokenised(docs, tokenizer, id_col, text_col, block), "token-blocks", compression="zstd")
    table = rans.Table.of(frequencies(blocks, tokenizer))
    with new_file(f"{folder}/table.freq") as f:
        f.write(table.freq.astype("<u4").tobytes())

    def shards(batches):
        table, kind = stored_table(folder), encoder(tokenizer).dtype
        done, stack, name, attempt = [], None, "", TaskContext.get().taskAttemptId()

        def close():
            nonlocal stack
            if stack:
                out, holder, index = stack
                tail = json.dumps(index).encode()
                out.write(tail + struct.pack("<Q", len(tail)) + MAGIC)
                holder.__exit__(None, None, None)
                done.append((name, len(index)))
                stack = None

        last, at = None, 0
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("part", "block", "doc_ids", "lengths", "ids"))):
                part, number = row[0].as_py(), row[1].as_py()
                if last != (part, number - 1):
                    close()
                    name, at = f"{folder}/part-{part:06d}-{number:08d}-{attempt}.ids", 0
                    holder = new_file(name)
                    stack = (holder.__enter__(), holder, [])
                last = (part, number)
                doc_ids = row[2].as_py()
                ids = np.frombuffer(row[4].as_buffer(), kind)
                data = pack_block(doc_ids, np.array(row[3].as_py(), np.int64), ids, table)
                stack[0].write(data)
                stack[2].append([at, len(data), number, len(doc_ids), len(ids)])
                at += len(data)
        close()
        yield pa.RecordBatch.from_pydict({"shard": pa.array([d[0] for d in done], pa.string()), "blocks": pa.array([d[1] for d in done], pa.int64())})

    blocks.mapInArrow(shards, "shard string, blocks bigint").write.parquet(f"{folder}/manifest")
    discard(blocks)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("shard string, blocks bigint").parquet(f"{folder}/manifest")


def blocks_of(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks of a folder from the shards' indexes: shard, part, offset, size, block, n_docs, n_ids, start."""
    shards = manifest(spark, folder)
    shards = shards.repartition(tasks(shards.count()))

    def index(frames):
        for pdf in frames:
            out = []
            for name in pdf["shard"]:
                with stored_file(name) as f:
                    size = f.size()
                    f.seek(size - 16)
                    (n,), magic = struct.unpack("<Q", f.read(8)), f.read(8)
                    if magic != MAGIC:
                        raise ValueError(f"{name} is no shard of token ids")
                    f.seek(size - 16 - n)
                    part = int(name.rpartition("/part-")[2].split("-")[0])
                    out += [(name, part, *x) for x in json.loads(f.read(n))]
            yield pd.DataFrame(out, columns=["shard", "part", "offset", "size", "block", "n_docs", "n_ids"])

    rows = written(shards.mapInPandas(index, "shard string, part int, offset bigint, size bigint, block bigint, n_docs bigint, n_ids bigint"), "token-index")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(F.sum("n_ids").alias("all"))  # a row for each part
    parts = parts.select("part", F.coalesce(F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("inside", inside).join(parts, "part").withColumn("start", F.col("inside") + F.col("part_start")).drop("inside", "part_start")


def read_ids(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """doc_id, start (ids before it), n_tokens and ids (or, with digest, ids_crc32) of every document of a folder.

    Only shards of the manifest are read; a folder written from an empty table gives an empty result.
    Raises ValueError where a block's checksums or lengths are wrong.
    """
    blocks = blocks_of(spark, folder).repartition(tasks(manifest(spark, folder).count()), "shard", "block")

    def read(frames):
        table = stored_table(folder)
        for pdf in frames:
            for shard, offset, size, start in zip(pdf["shard"], pdf["offset"], pdf["size"], pdf["start"]):
                with stored_file(shard) as f:
                    f.seek(offset)
                    doc_ids, lengths, ids = unpack_block(f.read(size), table)
                ends = np.cumsum(lengths, dtype=np.int64)
                starts = ends - lengths
                parts = [ids[a:b].astype("<u4") for a, b in zip(starts, ends)]
                out = pd.DataFrame({"doc_id": doc_ids, "start": starts + start, "n_tokens": lengths.astype(np.int64)})
                out["value"] = [crc32(p.tobytes()) for p in parts] if digest else [p.astype(np.int64) for p in parts]
                yield out

    kind, name = ("bigint", "ids_crc32") if digest else ("array<bigint>", "ids")
    return blocks.select("shard", "offset", "size", "start").mapInPandas(read, f"doc_id bigint, start bigint, n_tokens bigint, value {kind}").withColumnRenamed("value", name)
