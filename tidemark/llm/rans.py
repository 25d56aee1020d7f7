"""Range asymmetric numeral system over token ids, with numpy lanes side by side.

A block codes its ids in LANES interleaved lanes: lane k has ids k, k + LANES, ... All lanes share one
static table of frequencies (out of 2**SCALE). Each lane's state is 64 bits and gives or takes 32 bits at
a time; the words of all lanes form one stream. Every CHECKPOINT steps the states and the place in the
stream are kept, so that decoding can begin there.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SCALE = 20
LANES = 1024
CHECKPOINT = 128
LOW = np.uint64(1 << 31)
U = np.uint64


@dataclass
class Table:
    """Frequencies that sum to 2**SCALE, at least one for each id that occurs."""

    freq: np.ndarray

    def __post_init__(self):
        self.freq = self.freq.astype(np.uint64)
        ends = np.cumsum(self.freq)
        self.first = ends - self.freq
        self.symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))

    @classmethod
    def of(cls, counts: np.ndarray) -> Table:
        counts = counts.astype(np.float64)
        used = counts > 0
        if not used.any():
            return cls(np.zeros(len(counts)))
        room = (1 << SCALE) - int(used.sum())
        share = np.floor(counts / counts.sum() * room).astype(np.int64)
        freq = share + used
        freq[int(counts.argmax())] += (1 << SCALE) - int(freq.sum())
        return cls(freq)


def encode(ids: np.ndarray, table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """States (checkpoints x LANES), the place in the stream at each checkpoint, and the stream."""
    steps = -(-len(ids) // LANES)
    x = np.full(LANES, LOW, np.uint64)
    words, states, counts = [], [], []
    for t in range(steps - 1, -1, -1):
        s = ids[t * LANES : (t + 1) * LANES]
        f, lane = table.freq[s], x[: len(s)]
        full = lane >= f << U(31 - SCALE + 32)
        words.append((lane[full] & U(0xFFFFFFFF)).astype(np.uint32))
        lane[full] >>= U(32)
        q = lane // f
        lane[:] = (q << U(SCALE)) + (lane - q * f) + table.first[s]
        counts.append(len(words[-1]))
        if t % CHECKPOINT == 0:
            states.append(x.copy())
    words.reverse()
    before = np.concatenate([[0], np.cumsum(counts[::-1])]).astype(np.uint32)
    stream = np.concatenate(words) if words else np.zeros(0, np.uint32)
    return np.array(states[::-1], np.uint64).reshape(-1, LANES), before[:-1][::CHECKPOINT], stream


def decode(n: int, states: np.ndarray, places: np.ndarray, stream: np.ndarray, table: Table, start: int = 0) -> np.ndarray:
    """Ids from checkpoint `start` (id start * CHECKPOINT * LANES) to the n-th. What lies between checkpoints is decoded side by side."""
    left = n - start * CHECKPOINT * LANES
    if left <= 0:
        return np.empty(0, np.uint32)
    x, at = states[start:].copy(), places[start:].astype(np.int64)
    out = np.empty((len(x), CHECKPOINT, LANES), np.uint32)
    mask, whole = U((1 << SCALE) - 1), (len(x) - 1) * CHECKPOINT * LANES
    for t in range(min(CHECKPOINT, -(-left // LANES))):
        last = min(LANES, left - whole - t * LANES)  # lanes of the last part that have an id in this step
        rows = len(x) - (last <= 0)
        lane = x[:rows]
        slot = lane & mask
        s = table.symbol[slot]
        out[:rows, t] = s
        lane[:] = table.freq[s] * (lane >> U(SCALE)) + slot - table.first[s]
        short = lane < LOW
        if 0 < last < LANES:
            short[-1, last:] = False
        word = at[:rows, None] + np.cumsum(short, axis=1) - 1
        lane[short] = (lane[short] << U(32)) | stream[word[short]]
        at[:rows] += short.sum(axis=1)
    return out.reshape(-1)[:left]
