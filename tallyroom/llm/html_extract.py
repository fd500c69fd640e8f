"""Operator 2: main text of HTML pages by a linear-chain conditional random field.

A page becomes a sequence of leaf blocks (runs of text between block-level
tags). Features are the ancestors' tags and the words of their class, id and
role, and measures of the text. The chain has two labels, main text and the
rest; it is trained on labelled pages by L-BFGS on the exact likelihood
(forward-backward) and decoded by Viterbi, many pages at a time.

Labelled pages are made by a seeded author (`html_blocks.Author`) in many
layouts. A bounded sample of the table's own pages joins them where the markup
labels itself: pages with one article or main element.

Defined results: null and empty pages, and pages without main text, have the
empty text; rows that repeat give equal rows; white space inside a block is one
space, blocks are joined by one newline; nothing else is dropped or cut. Script,
style, title and form controls are never text; a head ends where something
stands that cannot be in a head, and a hidden element without an end tag at the
next block. A page counts whole, however long; decoding holds a bounded number
of blocks, or one page. An empty table gives an empty table; input columns named
text or n_chars are replaced, all others pass through. Pages are not shuffled.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_clashes, minimise, slices, smallest
from .html_blocks import _AD, _FOOT, _FORM, _HEAD, _MAIN, _NAV, _NOTICE, _SHARE, _SIDE, _TALK, Block, blocks, labelled

DIM = 1 << 14
#: Words of names, by the part of a page that they tell of. Only the telling words of a name, so that "main-menu" is a menu.
_KINDS = {kind: frozenset(w for name in names for w in re.findall("[a-z]+", name)) - frozenset("main site page top bottom left right more text body list buttons column box user form stories story subscribe message links".split()) for kind, names in (("ad", _AD), ("foot", _FOOT), ("head", _HEAD), ("nav", _NAV), ("notice", _NOTICE), ("share", _SHARE), ("side", _SIDE), ("talk", _TALK), ("form", _FORM))} | {"main": frozenset("content article post story entry main text storytext".split()), "form": frozenset("form search login newsletter signup subscription contact".split())}
_SENTENCE = re.compile(r"[.!?…](?:\s|$)")
_slots: dict[str, int] = {}


def _slot(name: str) -> int:
    if name not in _slots:
        h = 1469598103934665603
        for c in name.encode():
            h = ((h ^ c) * 1099511628211) % (1 << 64)
        _slots[name] = (h >> 20) % DIM
        if len(_slots) > 200_000:
            _slots.clear()
            return _slot(name)
    return _slots[name]


def _step(x: float) -> int:
    return int(np.log2(x + 1) * 1.5)


def features(page: list[Block]) -> list[list[int]]:
    out = []
    n = len(page)
    for k, b in enumerate(page):
        t, size = b.text, len(b.text)
        names = set(b.names)
        f = ["*", f"parent {b.tags[-1] if b.tags else ''}", f"size {_step(size)}", f"links {int(4 * min(1, b.links / size))}", f"sentences {min(6, len(_SENTENCE.findall(t)))}", f"end {t[-1] if not t[-1].isalnum() else 'x'}",
             f"place {int(5 * k / n)}", f"commas {min(4, t.count(','))}", f"words {min(8, _step(t.count(' ')))}"]
        f += [f"in {x}" for x in set(b.tags)]
        f += [f"name {x}" for x in names]
        kinds = [kind for kind, words in _KINDS.items() if names & words]
        f += [f"kind {x}" for x in kinds]
        if kinds and kinds != ["main"]:
            f.append("kind of rest")
        if k == 0 or k == n - 1:
            f.append("edge")
        if "©" in t:
            f.append("mark")
        out.append([_slot(x) for x in f])
    return out


class Chain:
    """Weights of the features (for label 1 against 0) and of the label pairs."""

    def __init__(self):
        self.w, self.trans, self.start = np.zeros(DIM), np.zeros((2, 2)), np.zeros(2)


class _Batch:
    """Pages side by side: emissions[t, page]."""

    def __init__(self, pages: list[list[list[int]]], labels: list[list[int]] | None = None):
        self.sizes = np.array([len(p) for p in pages])
        self.longest = int(self.sizes.max(initial=0))
        flat = [f for p in pages for f in p]
        self.col = np.fromiter((x for f in flat for x in f), np.int32)
        self.cut = np.cumsum([0] + [len(f) for f in flat])
        self.row = np.repeat(np.arange(len(flat)), np.diff(self.cut))
        page = np.repeat(np.arange(len(pages)), self.sizes)
        self.place = (np.arange(len(flat)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes), page)
        self.real = np.arange(self.longest)[:, None] < self.sizes[None]
        if labels is not None:
            self.y = np.zeros((self.longest, len(pages)), np.int64)
            self.y[self.place] = [v for p in labels for v in p]

    def emissions(self, w: np.ndarray) -> np.ndarray:
        e = np.zeros((self.longest, len(self.sizes), 2))
        e[self.place[0], self.place[1], 1] = np.bincount(self.row, w[self.col], len(self.place[0])) if len(self.col) else 0
        return e


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def likelihood(b: _Batch, w: np.ndarray, trans: np.ndarray, start: np.ndarray):
    """Negative log-likelihood and its gradients, by forward-backward."""
    e = b.emissions(w)
    n, pages = b.longest, len(b.sizes)
    alpha, beta = np.zeros_like(e), np.zeros_like(e)
    alpha[0] = start + e[0]
    for t in range(1, n):
        new = _lse(alpha[t - 1][:, :, None] + trans[None], 1) + e[t]
        alpha[t] = np.where(b.real[t][:, None], new, alpha[t - 1])
    z = _lse(alpha[-1], 1)
    for t in range(n - 2, -1, -1):
        new = _lse(trans[None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        beta[t] = np.where(b.real[t + 1][:, None], new, 0)
    # a page's backward values are 0 at its own last block
    post = np.exp(alpha + beta - z[None, :, None]) * b.real[:, :, None]
    pair = np.zeros((2, 2))
    gold = np.zeros((2, 2))
    if n > 1:
        both = np.exp(alpha[:-1, :, :, None] + trans[None, None] + (e[1:] + beta[1:])[:, :, None, :] - z[None, :, None, None]) * b.real[1:, :, None, None]
        pair = both.sum((0, 1))
        np.add.at(gold, (b.y[:-1][b.real[1:]], b.y[1:][b.real[1:]]), 1)
    y = b.y
    score = np.take_along_axis(e, y[:, :, None], 2)[:, :, 0][b.real].sum() + start[y[0]].sum() + (gold * trans).sum()
    diff = (post[:, :, 1] - y)[b.place]
    first = np.bincount(y[0], minlength=2)
    return z.sum() - score, np.bincount(b.col, diff[b.row], DIM), pair - gold, post[0].sum(0) - first


def train(pages: list[tuple[list[Block], list[int]]], l2: float = 0.5, rounds: int = 60) -> Chain:
    pages = [p for p in pages if p[0]]
    b = _Batch([features(p) for p, _ in pages], [y for _, y in pages])

    def value(x):
        loss, gw, gt, gs = likelihood(b, x[:DIM], x[DIM : DIM + 4].reshape(2, 2), x[DIM + 4 :])
        return loss + 0.5 * l2 * x @ x, np.concatenate((gw, gt.reshape(-1), gs)) + l2 * x

    x = minimise(value, np.zeros(DIM + 6), rounds, 1e-6)
    out = Chain()
    out.w, out.trans, out.start = x[:DIM].astype(np.float32), x[DIM : DIM + 4].reshape(2, 2), x[DIM + 4 :]
    return out


def decode(chain: Chain, pages: list[list[Block]], places: int = 1 << 16) -> list[list[int]]:
    """The likeliest labels of each page (Viterbi). Pages of like length go side by side, at most `places` places at once or one page."""
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: -len(pages[i]))
    out: list[list[int]] = [[] for _ in pages]
    at = 0
    while at < len(order):
        pick = order[at : at + max(1, places // len(pages[order[at]]))]
        at += len(pick)
        b = _Batch([features(pages[i]) for i in pick])
        e = b.emissions(chain.w)
        best = chain.start + e[0]
        back = np.zeros((b.longest, len(pick), 2), np.int8)
        for t in range(1, b.longest):
            s = best[:, :, None] + chain.trans[None]
            back[t] = s.argmax(1)
            best = np.where(b.real[t][:, None], s.max(1) + e[t], best)
        now = best.argmax(1)
        labels = np.zeros((b.longest, len(pick)), np.int8)
        for t in range(b.longest - 1, -1, -1):
            labels[t] = now
            prev = back[t][np.arange(len(pick)), now]
            now = np.where(b.real[t], prev, now)
        for k, i in enumerate(pick):
            out[i] = labels[: len(pages[i]), k].tolist()
    return out


def self_labelled(page: str) -> tuple[list[Block], list[int]] | None:
    """Blocks and labels of a page whose markup names its main text: one article or main element."""
    if len(re.findall(r"<article\b", page, re.I)) + len(re.findall(r"<main\b", page, re.I)) != 1:
        return None
    got = blocks(page)
    inner = {"nav", "aside", "footer", "form"}
    return got, [int(bool({"article", "main"} & set(b.tags)) and not inner & set(b.tags)) for b in got]


def extract_main_text(pages: DataFrame, *, html: str = "html", made_pages: int = 1500, own_pages: int = 150, max_chars: int = 100_000, seed: int = 2) -> DataFrame:
    """pages with text and n_chars. own_pages: at most so many of the table's pages, of at most max_chars, join the training."""
    pages = drop_clashes(pages, ["text", "n_chars"])
    some = smallest(pages.where(F.length(html) <= max_chars).select(html), F.xxhash64(F.lit(seed), html), own_pages).collect()
    chain = train(labelled(seed, made_pages) + [x for r in some if (x := self_labelled(r[0]))])
    names = pages.columns

    def run(batches):
        for batch in batches:
            for part in slices(batch, html, 4 << 20):
                split = [blocks(p) if p else [] for p in part.column(html).to_pylist()]
                texts = ["\n".join(b.text for b, y in zip(p, labels) if y) for p, labels in zip(split, decode(chain, split))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    return pages.mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
