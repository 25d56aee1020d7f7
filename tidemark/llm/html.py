"""Main text of web pages by a recurrent block labeller.

A page becomes a sequence of leaf blocks, each with its tag path and its text. A bidirectional LSTM in
numpy reads a vector for each (hashed path parts, hashed words, a few shares) and decides for every
block, with the whole page as context, whether it belongs to the article.

The model is trained here, on the blocks of a bounded sample of pages. Their labels come from the
pages' own structure (article or main, outside menus, adverts and the like); each sampled page is also
laid out anew in random layouts, so that other names for the same regions are known too.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, text_batches

BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
#: Elements whose content is no text of the page. Without an end those of RAW reach to the end of the page; those of SHUT are ordinary tags then.
RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
SHUT = frozenset("template svg head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an opening tag closes when it is the innermost open block.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
#: A comment ends at --> or --!>, or at once. A value is quoted only right after its equals sign; a quote that nothing closes ends with the tag.
TAG = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)(?:>|\Z)", re.S)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PARTS = re.compile(r"[a-z]+")

PATH_DIM, WORD_DIM, MORE = 192, 64, 6
DIM = PATH_DIM + WORD_DIM + MORE
WHERE = DIM - 3  # the share of the page before a block
HIDDEN = 16
#: Pages that training reads, about, and the most blocks of each that it uses.
TRAIN_PAGES, TRAIN_BLOCKS = 250, 120


class Node:
    """An open element with those around it. A node knows its parent only, so deep pages take no more room than long ones."""

    __slots__ = ("parent", "step", "children", "trail", "leaf", "out", "inside")
    made = 0

    def __init__(self, parent: Node | None, step: str):
        self.parent, self.step, self.children, self.trail, self.leaf = parent, step, {}, None, None
        Node.made += 1
        self.out, self.inside = (parent.out, parent.inside) if parent else (False, False)
        if step:
            tag, *names = step.split(" ")
            self.out = self.out or tag in _OUT or bool({p for w in names for p in PARTS.findall(w)} & _OUT_NAMES)
            self.inside = self.inside or tag in ("article", "main")

    def below(self, step: str) -> Node:
        found = self.children.get(step)
        if found is None:
            found = self.children[step] = Node(self, step)
        return found

    def vector(self) -> np.ndarray:
        """Hashed tags and name parts of the path, each twice; the innermost ones also as such."""
        if self.leaf is None:
            open_, node = [], self
            while node.trail is None:
                if node.parent is None:
                    node.trail = np.zeros(PATH_DIM, np.float32)
                else:
                    open_.append(node)
                    node = node.parent
            for node in reversed(open_):
                node.trail = np.maximum(node.parent.trail, step_vectors(node.step)[0])
            self.leaf = np.maximum(self.trail, step_vectors(self.step)[1]) if self.step else self.trail
        return self.leaf


_root: list[Node] = []


def root() -> Node:
    """The node around every page. Pages share nodes, until so many are made that the next page begins a tree of its own."""
    if not _root or Node.made > 50_000:
        Node.made = 0
        _root[:] = [Node(None, "")]
    return _root[0]


def node_of(path: str) -> Node:
    node = root()
    for step in path.split("/") if path else []:
        node = node.below(step)
    return node


@dataclass
class Block:
    node: Node
    text: str
    linked: int  # characters inside links

    @property
    def path(self) -> str:
        steps, node = [], self.node
        while node.parent is not None:
            steps.append(node.step)
            node = node.parent
        return "/".join(reversed(steps))


def blocks(html: str) -> list[Block]:
    """The leaf blocks with text, in page order. White space is collapsed and references are decoded."""
    out: list[Block] = []
    stack: list[tuple[str, Node]] = [("", root())]
    opened: Counter = Counter()  # how often each tag is on the stack
    parts: list[str] = []
    link_depth = linked = 0

    def close() -> None:
        nonlocal linked
        text = " ".join(unescape("".join(parts)).split())
        if text:
            out.append(Block(stack[-1][1], text, min(linked, len(text))))
        parts.clear()
        linked = 0

    at, n, endless = 0, len(html), set()
    while at < n:
        m = TAG.search(html, at)
        if not m:
            parts.append(html[at:])
            break
        if m.start() > at:
            parts.append(html[at : m.start()])
            if link_depth:
                linked += m.start() - at
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCKS:
                close()
                if opened[tag]:
                    last = ""
                    while last != tag:
                        last = stack.pop()[0]
                        opened[last] -= 1
                    link_depth = 0
            elif tag == "a":
                link_depth = max(0, link_depth - 1)
        elif (tag in RAW or tag in SHUT) and not m[3].endswith("/"):
            close() if tag == "head" else None
            end = None if tag in endless else _ends(tag).search(html, at)
            if end:
                at = end.end()
            elif tag in RAW:
                at = n
            else:
                endless.add(tag)  # there is none further on either
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCKS:
            close()
            shut = CLOSES.get(tag, {"p"})
            while stack[-1][0] in shut:
                opened[stack.pop()[0]] -= 1
            if tag not in VOID:
                names = " ".join(a or b or c for a, b, c in NAMES.findall(m[3])).lower() if m[3] else ""
                stack.append((tag, stack[-1][1].below(f"{tag} {names}" if names else tag)))
                opened[tag] += 1
        elif tag == "a":
            link_depth += 1
    close()
    return out


@lru_cache(maxsize=64)
def _ends(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*>|(?=<body)" if tag == "head" else rf"</{tag}\b[^>]*>", re.I)


@lru_cache(maxsize=65536)
def step_vectors(step: str) -> tuple[np.ndarray, np.ndarray]:
    """What an element adds to the path vectors of all that it holds, and what to its own."""
    own, leaf = np.zeros(PATH_DIM, np.float32), np.zeros(PATH_DIM, np.float32)
    tag, *names = step.split(" ")
    # names go by their letters: side-bar and sidebar_2 share parts
    for f in {tag + "<", *(p + "." for w in names for p in PARTS.findall(w)), *("".join(PARTS.findall(w)) + "." for w in names)}:
        for salt in ("a", "b"):
            own[crc32((salt + f).encode()) % PATH_DIM] = 1
        leaf[crc32(("leaf" + f).encode()) % PATH_DIM] = 1
    return own, leaf


def vectors(page: list[Block]) -> np.ndarray:
    x = np.zeros((len(page), DIM), np.float32)
    for i, b in enumerate(page):
        x[i, :PATH_DIM] = b.node.vector()
        words = b.text.lower().encode("utf-8", "surrogatepass").split()
        h = np.fromiter(map(crc32, words), np.uint32, len(words)) % WORD_DIM
        x[i, PATH_DIM : PATH_DIM + WORD_DIM] = np.sqrt(np.bincount(h, minlength=WORD_DIM) / len(words))
        n = len(b.text)
        x[i, -MORE:] = (np.log1p(n) / 8, b.linked / n, min(len(words), 50) / 50, i / len(page), i == 0, b.text[-1] in ".!?")
    return x


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Labeller:
    """A bidirectional LSTM with one output: weights by name."""

    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int = 11) -> Labeller:
        r = np.random.default_rng(seed)
        p = {}
        for d in "fb":
            p["x" + d] = (r.standard_normal((DIM, 4 * HIDDEN)) * 0.1).astype(np.float32)
            p["h" + d] = (r.standard_normal((HIDDEN, 4 * HIDDEN)) * 0.2).astype(np.float32)
            p["c" + d] = np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)
        p["o"] = (r.standard_normal(2 * HIDDEN) * 0.2).astype(np.float32)
        p["bias"] = np.zeros(1, np.float32)
        return cls(p)

    def run(self, z: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states (steps, pages, HIDDEN) from the inputs' part of the gates, and what backward needs."""
        steps, n, _ = z.shape
        h, c, kept = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32), []
        out = np.empty((steps, n, HIDDEN), np.float32)
        for t in range(steps):
            g = z[t] + h @ self.p["h" + d]
            s = sigmoid(g[:, : 3 * HIDDEN])
            i, f, o, a = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(g[:, 3 * HIDDEN :])
            before, last = c, h
            c = f * c + i * a
            w = np.tanh(c)
            h = o * w
            out[t] = h
            if keep:
                kept.append((i, f, o, a, before, last, w))
        return out, kept

    def forward(self, x: np.ndarray, lengths: np.ndarray, keep: bool = False):
        """Logits (steps, pages) of padded pages (steps, pages, DIM)."""
        back = reversal(x.shape[0], lengths)
        cols = np.arange(x.shape[1])
        hf, kf = self.run(x @ self.p["xf"] + self.p["cf"], "f", keep)
        hb, kb = self.run(x[back, cols] @ self.p["xb"] + self.p["cb"], "b", keep)
        both = np.concatenate([hf, hb[back, cols]], axis=2)
        return both @ self.p["o"] + self.p["bias"], (both, kf, kb, back, cols)

    def gradients(self, x: np.ndarray, lengths: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        logits, (both, kf, kb, back, cols) = self.forward(x, lengths, True)
        d = (sigmoid(logits) - y) * weight
        grads = {"o": np.einsum("tn,tnk->k", d, both), "bias": d.sum(keepdims=True).reshape(1)}
        dh = d[:, :, None] * self.p["o"]
        for way, kept, inputs, dout in (("f", kf, x, dh[:, :, :HIDDEN]), ("b", kb, x[back, cols], dh[:, :, HIDDEN:][back, cols])):
            grads |= self._backward(way, kept, inputs, dout)
        return grads

    def _backward(self, d: str, kept: list, x: np.ndarray, dout: np.ndarray) -> dict[str, np.ndarray]:
        wh = self.p["h" + d]
        gh, dz = np.zeros_like(wh), np.empty((*x.shape[:2], 4 * HIDDEN), np.float32)
        dh_next = dc_next = np.zeros((x.shape[1], HIDDEN), np.float32)
        for t in range(x.shape[0] - 1, -1, -1):
            i, f, o, a, before, last, w = kept[t]
            dh = dout[t] + dh_next
            dc = dc_next + dh * o * (1 - w * w)
            g = np.concatenate([dc * a * i * (1 - i), dc * before * f * (1 - f), dh * w * o * (1 - o), dc * i * (1 - a * a)], axis=1)
            dz[t] = g
            gh += last.T @ g
            dh_next, dc_next = g @ wh.T, dc * f
        return {"x" + d: np.tensordot(x, dz, ([0, 1], [0, 1])), "h" + d: gh, "c" + d: dz.sum((0, 1))}

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For each page's vectors, whether each block belongs to the article; pages of like length run together."""
        out = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        begin = 0
        while begin < len(order):
            end = begin + 1
            while end < len(order) and end - begin < 256 and len(pages[order[end]]) * (end - begin + 1) <= 20_000:
                end += 1
            x, lengths = padded([pages[i] for i in order[begin:end]])
            logits, _ = self.forward(x, lengths)
            for k, i in enumerate(order[begin:end]):
                out[i] = logits[: lengths[k], k] > 0
            begin = end
        return out


def reversal(steps: int, lengths: np.ndarray) -> np.ndarray:
    """Steps in reverse within each page's length, its own inverse."""
    t = np.arange(steps)[:, None]
    return np.where(t < lengths, lengths - 1 - t, t)


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(p) for p in pages])
    x = np.zeros((lengths.max(), len(pages), pages[0].shape[1]), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k] = p
    return x, lengths


#: Names of regions, for the structural labels and for new layouts.
ARTICLE = "article|main|div content|div article-body|div post-content|section entry-content|div story|div id-main|div page-content|div text|section post|div main-content|td content|div article|main content".split("|")
AROUND = "nav|ul menu|div navbar|div navigation|div topnav|nav breadcrumb|div breadcrumbs|header|div header|div masthead|div site-header|footer|div footer|div site-footer|div copyright|aside|div sidebar|div widget|div side-bar|div related|section related-posts|div recommended|div ad|div ads|div advert|div advertisement|div banner|div sponsored|div promo|div cookie-notice|div cookie|div consent|div notice|div gdpr|div alert|form|form search|form newsletter|div newsletter|div subscribe|div signup|div login|div comments|section comments|div comment-list|ol comments|div reader-comments|div comment|div replies|div disqus|div social|div share|div tags|div pagination|div popup|div modal|div skip-link|div disclaimer|dialog|div promo-box|div toolbar".split("|")
IN_ARTICLE = "aside|div ad|div advert|div share|div comments|section comments|div related|form|div newsletter|nav|div promo|div author-bio-widget|footer|header ad|div sidebar|div notice".split("|")
_OUT = frozenset("nav header footer aside form menu select search dialog button".split())
_OUT_NAMES = frozenset(p for r in AROUND for p in PARTS.findall(r.partition(" ")[2])) - {"id", "main", "content", "site", "list", "side", "box", "top", "link", "bar", "reader", "page", "posts", "section", "text", "post"}


def by_structure(b: Block) -> bool:
    """The label that a page's own structure gives: inside article or main, under nothing that stands around."""
    return b.node.inside and not b.node.out


def laid_out(text: list[Block], other: list[Block], r: np.random.Generator) -> tuple[list[Block], list[bool]]:
    """Blocks of an article and of what stands around it, in a random layout, and their labels."""
    pick = lambda names: names[r.integers(len(names))]
    step = lambda name: name.replace(" id-", " ", 1)
    root = "html/body" + ("", "/div wrapper", "/div container/div row", "/div page", "/table/tbody/tr")[r.integers(5)]
    out, labels = [], []
    around = lambda: [(f"{root}/{step(pick(AROUND))}" + pick(["", "", "/div", "/p", "/ul/li", "/div/p", "/ol/li", "/section/div"]), b) for b in (other[r.integers(len(other))] for _ in range(r.integers(1, 7)))]

    def put(rows, label):
        for path, b in rows:
            out.append(Block(node_of(path), b.text, b.linked))
            labels.append(label)

    for _ in range(r.integers(1, 4)):
        put(around(), False)
    home = f"{root}/{step(pick(ARTICLE))}"
    inner = pick(["", "", "/div", "/section", "/div body", "/article"])
    for i, b in enumerate(text):
        leaf = pick(["/h1", "/header/h1"] if r.random() < 0.15 else ["/h1", "/h2"]) if i == 0 and "header" not in home else pick(["/p", "/p", "/p", "/p", "/div", "/blockquote/p", "/ul/li", "/h2", "", "/pre", "/table/tr/td"])
        leaf = leaf.replace("/header/h1", "/h1")
        put([(home + inner + leaf, b)], True)
        if r.random() < 0.06:
            put([(home + inner + "/" + step(pick(IN_ARTICLE)) + pick(["", "/p", "/div"]), (other + text)[r.integers(len(other) + len(text))])], False)
    for _ in range(r.integers(1, 4)):
        # reader comments and the like are prose too
        put([(p, (b if r.random() < 0.6 else text[r.integers(len(text))])) for p, b in around()], False)
    return out, labels


def spread(n: int) -> np.ndarray:
    """The places of the blocks of a page of n that training reads: all, or TRAIN_BLOCKS from its first to its last."""
    return np.arange(n) if n <= TRAIN_BLOCKS else np.linspace(0, n - 1, TRAIN_BLOCKS).round().astype(int)


def train(pages: DataFrame, key_col: str = "page_id", html_col: str = "html", train_pages: int = TRAIN_PAGES, epochs: int = 14) -> Labeller:
    """A labeller from about train_pages pages, chosen by the hash of their key; with no page, an untrained one."""
    every = max(1, pages.count() // train_pages)
    picked = pages.where(F.col(html_col).isNotNull() & (F.pmod(F.xxhash64(key_col), F.lit(every)) == 0)).select(F.xxhash64(key_col).alias("k"), F.col(html_col).alias("html"))
    r, sequences = np.random.default_rng(5), []
    for row in picked.orderBy("k").limit(2 * train_pages).toLocalIterator():
        whole = blocks(row["html"])
        at = spread(len(whole))
        page = [whole[i] for i in at]
        labels = [by_structure(b) for b in page]
        text, other = [b for b, c in zip(page, labels) if c], [b for b, c in zip(page, labels) if not c]
        if page:
            x = vectors(page)
            x[:, WHERE] = at / len(whole)
            sequences.append((x, np.array(labels, np.float32)))
        if text and other:
            for _ in range(3):
                p, y = laid_out(text, other, r)
                sequences.append((vectors(p), np.array(y, np.float32)))
    model = Labeller.fresh()
    if not sequences:
        return model
    sequences.sort(key=lambda s: len(s[0]))
    batches = [sequences[i : i + 24] for i in range(0, len(sequences), 24)]
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(w) for k, w in model.p.items()}
    t = 0
    for epoch in range(epochs):
        for b in r.permutation(len(batches)):
            x, lengths = padded([s[0] for s in batches[b]])
            y = np.zeros(x.shape[:2], np.float32)
            for k, s in enumerate(batches[b]):
                y[: len(s[1]), k] = s[1]
            weight = (np.arange(len(x))[:, None] < lengths).astype(np.float32)
            grads = model.gradients(x, lengths, y, weight / weight.sum())
            t += 1
            for k, g in grads.items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                model.p[k] -= 0.02 * 0.85**epoch * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-6)
    return model


def extract(pages: DataFrame, model: Labeller, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """<id_col>, <url_col>, text, n_chars, n_blocks, n_kept of every row of pages.

    text joins the article's blocks by line feeds (empty if there is none, or for null or empty html);
    n_chars counts its code points. Whole pages are read, of any length; repeated rows each get a row; an empty table gives
    an empty result; other columns aren't read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)  # fixed size

    @F.pandas_udf("text string, n_chars bigint, n_blocks bigint, n_kept bigint")
    def of(html: pd.Series) -> pd.DataFrame:
        out, held, size = [], [], 0

        def flush():
            nonlocal held, size
            for page, keep in zip(held, shared.value.label([vectors(p) for p in held])):
                text = "\n".join(b.text for b, k in zip(page, keep) if k)
                out.append((text, len(text), len(page), int(keep.sum())))
            held, size = [], 0

        for h in html:
            held.append(blocks(h or ""))
            size += len(h or "")
            if size >= 1_000_000:
                flush()
        flush()
        return pd.DataFrame(out, columns=["text", "n_chars", "n_blocks", "n_kept"])

    kept, said = [F.col(f"`{id_col}`"), F.col(f"`{url_col}`")], fresh_name(pages, "said")
    return text_batches(pages).select(*kept, of(F.col(f"`{html_col}`")).alias(said)).select(*kept, f"{said}.*")
