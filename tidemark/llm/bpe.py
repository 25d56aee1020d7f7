"""Byte-level BPE by rank files: pre-tokenisation as a scan of transition functions, cached pair merging,
and decoding by token offsets.

The pattern that separates pieces,
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
is an automaton of eight states over classes of code points, where a class also knows what follows (a
space before something else, an apostrophe before a contraction's letters). Each code point is a
function from state to state; composing functions is associative, so blocks are composed side by side,
the blocks' functions are scanned, and each block then runs from its known state.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, text_batches
from .pieces import PieceTable, by_text, code_points, in_groups, places

#: Classes: letter, number, lone space before something, other white space before something, white space
#: before white space or the end, anything else, apostrophe before one or two letters of a contraction.
LETTER, NUMBER, LEAD, LAST, MIDDLE, OTHER, ONE, TWO = range(8)
#: States: after a break, in letters, in numbers, after a leading space, in white space, in others, one or two letters to come.
BREAK, IN_L, IN_N, IN_LEAD, IN_W, IN_O, TO_1, TO_2 = range(8)
#: White space as the pattern's \s has it.
SPACES = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
BLOCK = 128


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a piece begins, by class and state; classes from 8 on begin a text."""
    step, begins = np.zeros((16, 8), np.uint8), np.zeros((16, 8), bool)
    for s in range(8):
        step[LETTER, s] = {TO_2: TO_1, TO_1: BREAK}.get(s, IN_L)
        begins[LETTER, s] = s not in (IN_L, IN_LEAD, TO_1, TO_2)
        step[NUMBER, s], begins[NUMBER, s] = IN_N, s not in (IN_N, IN_LEAD)
        step[LEAD, s], begins[LEAD, s] = IN_LEAD, True
        step[LAST, s], begins[LAST, s] = BREAK, True
        step[MIDDLE, s], begins[MIDDLE, s] = IN_W, s != IN_W
        inside = s in (IN_O, IN_LEAD)
        for c, then in ((OTHER, IN_O), (ONE, TO_1), (TWO, TO_2)):
            step[c, s], begins[c, s] = (IN_O if inside else then), not inside
    step[8:], begins[8:] = step[:8, :1], True
    return step, begins


STEP, BEGINS = _automaton()


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """LETTER, NUMBER, OTHER, or LAST for white space, of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            table[c] = LETTER
        elif k == "N":
            table[c] = NUMBER
    table[SPACES] = LAST
    return table


def classes(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The class of each code point of texts set end to end; first holds where each text begins."""
    kind = kinds()[points]
    ends = np.append(first[1:], len(points)) - 1
    after = np.append(points[1:], 0)
    after[ends] = 0
    then = np.append(after[1:], 0)
    then[ends] = 0
    white = kind == LAST
    white_next = np.append(white[1:], True)
    white_next[ends] = True
    out = kind
    out[white & white_next] = MIDDLE
    out[white & ~white_next & (points == 32)] = LEAD
    for i in np.flatnonzero(points == 39).tolist():  # apostrophes are few
        a, b = chr(after[i]), chr(then[i])
        if a in "stmd" and a != "\0":
            out[i] = ONE
        elif a + b in ("re", "ve", "ll"):
            out[i] = TWO
    out[first] += 8
    return out


def begins(cls: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each code point."""
    n = len(cls)
    rows = -(-n // BLOCK)
    padded = np.full(rows * BLOCK, LAST + 8, np.uint8)
    padded[:n] = cls
    by_step = np.ascontiguousarray(padded.reshape(rows, BLOCK).T)
    flat, flags = STEP.ravel(), BEGINS.ravel()
    # each block's function, its code points composed one after another
    f = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for c in by_step:
        f = flat[(c << 3)[:, None] + f]
    # inclusive scan over the blocks by doubling
    d = 1
    while d < rows:
        f[d:] = np.take_along_axis(f[d:], f[:-d], axis=1)
        d *= 2
    state = np.concatenate([[BREAK], f[:-1, BREAK]]).astype(np.uint8)
    out = np.empty((BLOCK, rows), bool)
    for t, c in enumerate(by_step):
        at = (c << 3) + state
        out[t] = flags[at]
        state = flat[at]
    return np.ascontiguousarray(out.T).reshape(-1)[:n]


class Ranks:
    """A rank file: token bytes by rank, and merging."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.bytes, self.begin = np.frombuffer(b"".join(self.tokens), np.uint8), np.cumsum(self.sizes) - self.sizes
        self.dtype = np.dtype("<u4" if len(self.tokens) > 65536 else "<u2")
        self.table = PieceTable(self._learn, self.dtype)

    def _learn(self, pieces: list[str]) -> list[np.ndarray]:
        return [np.array(self.merge(p.encode("utf-8", "surrogatepass")), self.dtype) for p in pieces]

    def merge(self, piece: bytes) -> list[int]:
        """The pair of neighbours with the lowest rank (leftmost first) is merged until none has a rank."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) > 64:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        best = [ranks.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
        while best:
            low = min(best)
            if low == 1 << 30:
                break
            i = best.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del best[i]
            if i:
                best[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 30)
            if i < len(best):
                best[i] = ranks.get(parts[i] + parts[i + 1], 1 << 30)
        return [ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap, for pieces of any length."""
        n, ranks = len(piece), self.ranks
        end = list(range(1, n + 1))  # of the part that begins here; 0: merged away
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, mid, stop = heapq.heappop(heap)
            if end[i] != mid or mid >= n or end[mid] != stop:
                continue
            end[i], end[mid] = stop, 0
            if stop < n:
                before[stop] = i
                r = ranks.get(piece[i : end[stop]])
                if r is not None:
                    heapq.heappush(heap, (r, i, stop, end[stop]))
            if before[i] >= 0:
                r = ranks.get(piece[before[i] : stop])
                if r is not None:
                    heapq.heappush(heap, (r, before[i], i, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        text, points, bounds = code_points(texts)
        if not len(points):
            return [np.zeros(0, self.dtype)] * len(texts)
        first = bounds[:-1][np.diff(bounds) > 0]
        starts = np.flatnonzero(begins(classes(points, first)))
        ids, sizes = self.table.ids(text, points, starts)
        return by_text(ids, sizes, starts, bounds)

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Where each token's bytes begin in the text, and the text's length in bytes."""
        return np.concatenate([[0], np.cumsum(self.sizes[ids])])

    def decode(self, ids: np.ndarray, offsets: np.ndarray | None = None) -> bytes:
        """The tokens' bytes, each put at its offset; offsets are those that encoding gave, or a slice of them with one more than ids."""
        offsets = self.offsets(ids) if offsets is None else offsets
        sizes = np.diff(offsets)
        if len(offsets) != len(ids) + 1 or not (sizes == self.sizes[ids]).all():
            raise ValueError("the offsets aren't those of the ids")
        return self.bytes[places(self.begin[ids], sizes)].tobytes()


@lru_cache(maxsize=2)
def ranks(path: str) -> Ranks:
    return Ranks(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """<id_col>, ids, offsets (bytes before each token, then the text's bytes) of every row.

    Null text counts as empty: no ids. Very long texts are one group of their own; repeated rows each
    get a row; an empty table gives an empty result; other columns aren't read.
    """

    @F.pandas_udf("ids array<int>, offsets array<bigint>")
    def of(text: pd.Series) -> pd.DataFrame:
        coder, texts, out = ranks(path), [t or "" for t in text], []
        for a, b in in_groups(texts):
            out += [(ids.astype(np.int32), coder.offsets(ids)) for ids in coder.encode(texts[a:b])]
        return pd.DataFrame(out, columns=["ids", "offsets"])

    key, said = F.col(f"`{id_col}`"), fresh_name(docs, "said")
    return text_batches(docs).select(key, of(F.col(f"`{text_col}`")).alias(said)).select(key, f"{said}.*")


def decode(coded: DataFrame, path: str, ids_col: str = "ids", offsets_col: str = "offsets") -> DataFrame:
    """coded's columns and text: the decoded bytes, by the offsets that encode gave.

    Null ids give null; no ids give no bytes; repeated rows each get a row; an empty table gives an empty
    result; coded's other columns are handed on, and one named text besides stays before the new one.
    """

    @F.pandas_udf("binary")
    def of(ids: pd.Series, offsets: pd.Series) -> pd.Series:
        return pd.Series([None if i is None else ranks(path).decode(np.asarray(i, np.int64), np.asarray(o, np.int64)) for i, o in zip(ids, offsets)], dtype=object)

    return coded.select("*", of(F.col(f"`{ids_col}`"), F.col(f"`{offsets_col}`")).alias("text"))


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """<id_col>, n_tokens, ids_sha256, decoded_sha256: encoding and decoding in one task, so that ids needn't leave it.

    Null and empty texts have no tokens; very long ones are encoded whole; repeated rows and null ids each get a row; an empty
    table gives an empty result; other columns, whatever their names, aren't read.
    """

    @F.pandas_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    def of(text: pd.Series) -> pd.DataFrame:
        coder, texts, out = ranks(path), [t or "" for t in text], []
        for a, b in in_groups(texts):
            for ids in coder.encode(texts[a:b]):
                listed = ",".join(map(str, ids.tolist())).encode()
                decoded = coder.decode(ids, coder.offsets(ids))
                out.append((len(ids), sha256(listed).hexdigest(), sha256(decoded).hexdigest()))
        return pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    key, said = F.col(f"`{id_col}`"), fresh_name(docs, "said")
    return text_batches(docs).select(key, of(F.col(f"`{text_col}`")).alias(said)).select(key, f"{said}.*")
