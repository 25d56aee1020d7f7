"""Packing documents into sequences of bounded length, in order, by dynamic programming over cuts.

The ids of a partition's documents form one stream. A sequence ends at a document's or a sentence's end;
only a stretch of ids longer than a sequence without any may be cut inside, at spare places. The program
chooses the ends that minimise padding plus what each cut truncates: nothing at a document's end, COST
elsewhere. With g(i) = f(i) + i, the best f(j) over the window of starts i >= j - capacity is
min g(i) + capacity - j, kept in a monotone queue; sequences whose length is a power of two need no
padding and are tried apart.
"""

from __future__ import annotations

from collections import deque
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, text_batches
from .pieces import in_groups
from .tokens import encoder

CAPACITY = 1024
END = 0
#: What a cut truncates, in tokens of padding: at a document's end, after a sentence, inside one.
COST = (0, 2, 16)
KINDS = ("document", "sentence", "inside")
#: Characters of the texts whose pieces are looked up at once, and pieces that a worker remembers.
GROUP_CHARS, PIECES = 500_000, 600_000
#: What each sequence costs besides, so that short ones aren't taken for the sake of a power of two.
EACH = 24
#: Spare places stand so many ids apart in a stretch that no sentence or document ends.
SPARE = 32
#: Ids that one run of the program covers, at least.
SEGMENT = 1 << 17


@lru_cache(maxsize=2)
def sentence_ends(tokenizer: str) -> np.ndarray:
    """For each id, whether its token ends a sentence or a line."""
    coder = encoder(tokenizer, PIECES).tokenizer
    return np.array([coder.decode([i], skip_special_tokens=False).rstrip(" ").endswith((".", "!", "?", "\n", "…", "。")) for i in range(coder.get_vocab_size())], bool)


def places(doc_end: np.ndarray, sentence_end: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Places for cuts (from 0 to n) and what each costs, from flags of the ids that end a document or a sentence."""
    n = len(doc_end)
    cost = np.full(n + 1, 255, np.uint8)
    cost[1:][sentence_end] = COST[1]
    cost[1:][doc_end] = COST[0]
    cost[[0, n]] = 0
    at = np.flatnonzero(cost < 255)
    for i in np.flatnonzero(np.diff(at) > capacity).tolist():
        cost[at[i] + SPARE : at[i + 1] : SPARE] = COST[2]
    at = np.flatnonzero(cost < 255)
    return at, cost[at].astype(np.int64)


def exact_starts(at: np.ndarray, capacity: int) -> list[list[int]]:
    """For each place, the places that a power of two, at most capacity, lies before it."""
    index = np.full(int(at[-1]) + 1, -1, np.int64)
    index[at] = np.arange(len(at))
    out: list[list[int]] = [[] for _ in at]
    size = 1
    while size <= capacity:
        j = np.flatnonzero(at >= size)
        i = index[at[j] - size]
        for a, b in zip(j[i >= 0].tolist(), i[i >= 0].tolist()):
            out[a].append(b)
        size *= 2
    return out


def best_cuts(at: np.ndarray, cost: np.ndarray, capacity: int = CAPACITY) -> list[int]:
    """The cheapest increasing list of cuts from at[0] to at[-1] with steps of at most capacity."""
    places, prices = at.tolist(), cost.tolist()
    f, back = [0] * len(places), [0] * len(places)
    queue = deque([(0, 0, 0)])  # (g, index, place), g rising
    for j, (p, price, exact) in enumerate(zip(places, prices, exact_starts(at, capacity))):
        if not j:
            continue
        while queue[0][2] < p - capacity:
            queue.popleft()
        best, i, _ = queue[0]
        best += capacity - p
        for k in exact:
            if f[k] < best:
                best, i = f[k], k
        best += price + EACH
        f[j], back[j] = best, i
        best += p
        while queue and queue[-1][0] >= best:
            queue.pop()
        queue.append((best, j, p))
    cuts, j = [], len(places) - 1
    while j:
        cuts.append(places[j])
        j = back[j]
    return [places[0], *reversed(cuts)]


class Packer:
    """Takes documents in order and gives pieces: (document, start, length, crc32, tokens, sequence, offset, how it ends)."""

    def __init__(self, ends: np.ndarray, capacity: int = CAPACITY, segment: int = SEGMENT):
        self.ends, self.capacity, self.segment = ends, capacity, segment
        self.docs: list[tuple[object, np.ndarray, int]] = []  # key, ids, ids already cut off
        self.size = self.sequence = 0

    def add(self, key, ids: np.ndarray):
        self.docs.append((key, ids, 0))
        self.size += len(ids)
        if self.size >= self.segment:
            yield from self.cut(False)

    def cut(self, last: bool):
        """Cuts what is held; but for the last time, the end stays for the next run."""
        if not self.size:
            return
        stream = np.concatenate([ids[done:] for _, ids, done in self.docs])
        over = np.zeros(len(stream), bool)
        over[np.cumsum([len(ids) - done for _, ids, done in self.docs]) - 1] = True
        sentence = self.ends[np.minimum(stream, len(self.ends) - 1)]
        cuts = best_cuts(*places(over, sentence, self.capacity), self.capacity)
        if not last:
            cuts = [c for c in cuts if c <= len(stream) - 4 * self.capacity] or cuts[:1]
        doc, at = 0, 0
        for begin, end in zip(cuts, cuts[1:]):
            pos = begin
            while pos < end:
                key, ids, done = self.docs[doc]
                take = min(end - pos, len(ids) - done)
                yield key, done, take, crc32(ids[done : done + take].astype("<u4").tobytes()), len(ids), self.sequence, pos - begin, KINDS[0 if done + take == len(ids) else 1 if sentence[pos + take - 1] else 2]
                pos += take
                if done + take == len(ids):
                    doc += 1
                else:
                    self.docs[doc] = (key, ids, done + take)
            self.sequence += 1
            at = end
        del self.docs[:doc]
        self.size -= at


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: <id_col>, start, length, ids_crc32, doc_tokens, sequence_id, offset, ends_at.

    Documents go by id (null ids first), rows repeated with one id by text, each its ids and the end id; null or empty text is
    the end id alone. Very long documents are cut into many pieces. ends_at says whether the piece ends with its document, after a
    sentence, or inside one. Partitions of the id range are packed apart, so each has one last sequence that may be short.
    sequence_id is unique over all. An empty table gives an empty result; other columns aren't read.
    """
    rows = text_batches(docs).select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["id"]
    # ids travel as text: a number beside a null would become a float on the way
    rows = rows.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", "text").select(F.col("id").cast("string").alias("id"), "text")
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ends_at"]

    def pieces(frames):
        coder, base = encoder(tokenizer, PIECES), TaskContext.get().partitionId() << 40
        packer = Packer(sentence_ends(tokenizer), capacity)

        def frame(found):
            pdf = pd.DataFrame(found, columns=names)
            pdf["sequence_id"] += base
            return pdf

        for pdf in frames:
            keys, texts, found = pdf["id"].tolist(), pdf["text"].tolist(), []
            for a, b in in_groups(texts, GROUP_CHARS):
                for key, ids in zip(keys[a:b], coder.encode(texts[a:b])):
                    found.extend(packer.add(key, np.append(ids, coder.dtype.type(END))))
            if found:
                yield frame(found)
        found = list(packer.cut(True))
        if found:
            yield frame(found)
        give_back()

    packed = rows.mapInPandas(pieces, "id string, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ends_at string")
    return packed.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)
