"""A table of text pieces and their packed token ids, looked up for a whole batch of texts at once.

Pieces are found by a 64-bit hash from prefix sums over the batch's code points. A hash proves nothing:
every hit is compared code point by code point, within the batch and with what the table holds. Only
pieces that the table lacks are cut out as strings and encoded.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX = 0xC2B2AE3D27D4EB4F
#: Pieces after which the table starts anew.
LIMIT = 2_000_000
_powers = {BASE: np.ones(1, np.uint64), INVERSE: np.ones(1, np.uint64)}


def powers(base: int, n: int) -> np.ndarray:
    if len(_powers[base]) < n:
        row = np.full(n, base, np.uint64)
        row[0] = 1
        _powers[base] = np.multiply.accumulate(row)
    return _powers[base][:n]


def hashes(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of each piece of code points that begins at one of starts and ends at the next."""
    x = (points + np.uint64(1)) * np.uint64(MIX)
    x ^= x >> np.uint64(29)
    x *= powers(BASE, len(points))
    np.cumsum(x, out=x)
    total = np.concatenate([[np.uint64(0)], x])
    h = (total[np.append(starts[1:], len(points))] - total[starts]) * powers(INVERSE, len(points))[starts]
    h ^= h >> np.uint64(32)
    return h


def places(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each run, set end to end."""
    ends = np.cumsum(sizes)
    return np.repeat(begins - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def merged(old: tuple, new: tuple) -> tuple:
    """Two levels as one, by the order of their keys."""
    where = np.searchsorted(old[0], new[0])
    return tuple(np.insert(a, where, b) for a, b in zip(old, new))


def held(pool: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """pool with more put in from `used` on, made longer where need be."""
    if used + len(more) > len(pool):
        pool = np.concatenate([pool, np.zeros(max(len(more), len(pool)), pool.dtype)])
    pool[used : used + len(more)] = more
    return pool


class PieceTable:
    """learn gives the token ids of pieces as strings; size bounds the table."""

    def __init__(self, learn: Callable[[list[str]], list[np.ndarray]], dtype: np.dtype, limit: int = LIMIT):
        self.learn, self.dtype, self.limit = learn, dtype, limit
        self.clear()

    def clear(self) -> None:
        none = np.zeros(0, np.int64)
        #: Two levels of (keys in order, places of the ids in the pool, how many, places of the letters, how many): new pieces go to the second, small one.
        self.levels = [(np.zeros(0, np.uint64), none, none, none, none)] * 2
        self.pool, self.used = np.zeros(1 << 16, self.dtype), 0
        self.letters, self.spelt = np.zeros(1 << 16, np.uint32), 0

    def __len__(self) -> int:
        return sum(len(level[0]) for level in self.levels)

    def add(self, key: np.ndarray, ids: list[np.ndarray], points: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Puts in new keys, in ascending order; gives the places and sizes of their ids."""
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.pool = held(self.pool, self.used, np.concatenate(ids))
        self.letters = held(self.letters, self.spelt, points[places(begins, lengths)])
        new = (key, self.used + np.cumsum(sizes) - sizes, sizes, self.spelt + np.cumsum(lengths) - lengths, lengths)
        self.used += int(sizes.sum())
        self.spelt += int(lengths.sum())
        main, recent = self.levels
        recent = merged(recent, new)
        if len(recent[0]) > max(50_000, len(main[0]) // 4):
            main, recent = merged(main, recent), tuple(x[:0] for x in recent)
        self.levels = [main, recent]
        return new[1], sizes

    def find(self, key: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Places and sizes of ids and letters of keys, and which keys are in the table."""
        out = [np.zeros(len(key), np.int64) for _ in range(4)]
        known = np.zeros(len(key), bool)
        for level in self.levels:
            if len(level[0]):
                row = np.minimum(np.searchsorted(level[0], key), len(level[0]) - 1)
                hit = level[0][row] == key
                for x, values in zip(out, level[1:]):
                    x[hit] = values[row[hit]]
                known |= hit
        return out, known

    def ids(self, text: str, points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all pieces in order, and how many each has. points are text's code points, starts begin with 0."""
        key, index, inverse = np.unique(hashes(points, starts), return_index=True, return_inverse=True)
        if len(key) > self.limit:
            return self.plain(text, points, starts)
        long = np.diff(np.append(starts, len(points)))
        begins, lengths = starts[index], long[index]
        # every piece is spelt like the first one with its hash
        if not (long == lengths[inverse]).all() or not (points[places(begins[inverse], long)] == points).all():
            return self.plain(text, points, starts)
        (place, size, spelling, letters), known = self.find(key)
        if len(self) + len(key) - int(known.sum()) > self.limit:
            self.clear()
            known[:] = False
        # and like the one in the table
        if not (letters[known] == lengths[known]).all() or not (self.letters[places(spelling[known], letters[known])] == points[places(begins[known], lengths[known])]).all():
            return self.plain(text, points, starts)
        new = np.flatnonzero(~known)
        if len(new):
            a, b = begins[new], begins[new] + lengths[new]
            place[new], size[new] = self.add(key[new], self.learn([text[i:j] for i, j in zip(a.tolist(), b.tolist())]), points, a, lengths[new])
        sizes = size[inverse]
        return self.pool[places(place[inverse], sizes)], sizes

    def plain(self, text: str, points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same without the table, where two pieces share a hash or don't fit."""
        ids = self.learn([text[i:j] for i, j in zip(starts.tolist(), np.append(starts[1:], len(points)).tolist())])
        return np.concatenate(ids), np.fromiter(map(len, ids), np.int64, len(ids))


def code_points(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """Texts set end to end, their code points, and where each text begins (and the end)."""
    text = "".join(texts)
    return text, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum([0, *map(len, texts)])


def by_text(ids: np.ndarray, sizes: np.ndarray, starts: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The ids of each text, given how many each piece has and where pieces and texts begin."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    at = ends[np.searchsorted(starts, bounds)].tolist()
    return [ids[a:b] for a, b in zip(at, at[1:])]


def in_groups(texts, most_chars: int = 2_000_000):
    """Slices of texts of bounded total length (one text at least)."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most_chars:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)
