"""Token ids of whole texts by the tokenizers library, which sees each distinct piece once.

The byte-level pre-tokenizer always begins a new piece at a space or line feed that stands alone between
two characters that aren't white space, after such a line feed, and at a mark after a letter; and nothing
before changes what follows. So texts are cut there, and cuts go through a table. A cut that is nothing
but letters, perhaps with marks at its end, is also known to be one piece of letters and one of marks; the
library's model then encodes the letters without pre-tokenising them again.

The library takes its file's added tokens out of a text before all this; so texts that hold one go to the
library whole.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

from .pieces import LIMIT, PieceTable, by_text, code_points

MARKS = ".,;:!?%$#&*|"
GROUP = 2000


@lru_cache(maxsize=1)
def white() -> np.ndarray:
    """Whether each code point is white space, for Python or for the pattern of the pre-tokenizer."""
    table = np.zeros(0x110000, bool)
    table[[c for c in range(0x3001) if chr(c).isspace()]] = True
    return table


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=1)
def mark_points() -> np.ndarray:
    table = np.zeros(128, bool)
    table[[ord(c) for c in MARKS]] = True
    return table


class Encoder:
    """Ids of a byte-level BPE file of the tokenizers library; special tokens aren't added.

    find_added: the file's added tokens are found in texts, as the library does unless it is told to spell them out.
    """

    def __init__(self, path: str, find_added: bool = True, limit: int = LIMIT):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not find_added
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if find_added else []
        self.dtype = np.dtype("<u4" if self.tokenizer.get_vocab_size() > 65536 else "<u2")
        # The file's model alone, for letters that are set in the byte-level alphabet already.
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        letters = set(pre_tokenizers.ByteLevel.alphabet())  # printable bytes stand for themselves, the others follow in order
        others = iter(sorted(letters - {chr(b) for b in range(256)}))
        self.alphabet = {b: chr(b) if chr(b) in letters else next(others) for b in range(256)}
        self.space, line_feed = self.alphabet[32], self.alphabet[10]
        feed = self._ids(["\n"])[0]
        self.feed = feed[0] if len(feed) == 1 else None
        self.alphabet[10] = f" {line_feed} "
        self.table = PieceTable(self._learn, self.dtype, limit)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of words of letters, each perhaps after a space; the id of a line feed marks where each ends."""
        groups = [words[i : i + GROUP] for i in range(0, len(words), GROUP)]
        lines = ["\n".join(g).encode().decode("latin-1").translate(self.alphabet) for g in groups]
        out = []
        for e in self.letters.encode_batch_fast(lines, add_special_tokens=False):
            ids = np.array(e.ids, self.dtype)
            ends = np.flatnonzero(ids == self.feed).tolist()
            out += [ids[a:b] for a, b in zip([0, *(x + 1 for x in ends)], [*ends, len(ids)])]
        return out

    def _learn(self, pieces: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(pieces)
        words, marked, rest = [], [], []
        for i, p in enumerate(pieces):
            word = p.rstrip(MARKS)
            if self.feed is not None and word[word.startswith(" ") :].isalpha():
                words.append(word)
                marked.append((i, p[len(word) :]))
            else:
                rest.append(i)
        marks = list({m for _, m in marked if m})
        marks = dict(zip(marks, (np.array(x, self.dtype) for x in self._ids(marks)))) if marks else {}
        for (i, m), ids in zip(marked, self._words(words), strict=True):
            out[i] = np.concatenate([ids, marks[m]]) if m else ids
        for k in range(0, len(rest), GROUP):
            part = rest[k : k + GROUP]
            for i, ids in zip(part, self._ids([pieces[i] for i in part])):
                out[i] = np.array(ids, self.dtype)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        whole = [i for i, t in enumerate(texts) if any(a in t for a in self.added)]
        if not whole:
            return self._cut(texts)
        apart = set(whole)
        out = list(self._cut(["" if i in apart else t for i, t in enumerate(texts)]))
        for i in whole:
            out[i] = np.array(self._ids([texts[i]])[0], self.dtype)
        return out

    def _cut(self, texts: list[str]) -> list[np.ndarray]:
        text, points, bounds = code_points(texts)
        if not len(points):
            return [np.zeros(0, self.dtype)] * len(texts)
        blank = white()[points]
        cut = np.zeros(len(points), bool)
        cut[1:-1] = (points[1:-1] == 32) & ~blank[:-2] & ~blank[2:]
        begins = bounds[:-1][np.diff(bounds) > 0]
        feed = np.zeros(len(points), bool)
        feed[1:-1] = (points[1:-1] == 10) & ~blank[:-2] & ~blank[2:]
        cut[begins[1:] - 1] = feed[begins[1:] - 1] = False  # a text's last character has nothing after it
        feed[begins] = False
        cut |= feed
        cut[1:] |= feed[:-1] | (mark_points()[np.minimum(points[1:], 127)] & letters()[points[:-1]])
        cut[begins] = True
        starts = np.flatnonzero(cut)
        ids, sizes = self.table.ids(text, points, starts)
        return by_text(ids, sizes, starts, bounds)


@lru_cache(maxsize=4)
def encoder(path: str, limit: int = LIMIT) -> Encoder:
    """One encoder for each worker process and file, whose table holds up to so many pieces; one thread, as Spark runs several tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path, limit=limit)
