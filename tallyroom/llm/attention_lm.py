"""Operator 9: language-model scoring.

Words are lower-cased (A-Z) and cut into subword ids by a public tokenizer. The
model is causal self-attention in numpy: an id has a vector whose projections
are query, key and value, and a direct vector; scores have a bias by distance.
The sum of the attended and the direct vector gives, through a rectifier, the
probability of the next id in two steps: first a cluster of ids, then the id in
its cluster. The most frequent ids are in clusters of `size`, those that begin a
word apart from those that go on; all others are in buckets, where an id has its
share of the bucket's counts. A document is read in overlapping windows: each
window scores its second half with the first half as context, so every token is
scored once, in batches with a causal mask.

Training: windows tile every training document, so that each token is a target
once. Documents are dealt out to rounds, and in a round to shards whose number grows
with the corpus. A shard streams its documents through Adam steps; tasks sum up
the shards' weights, and their mean begins the next round. Small first rounds
settle where all shards begin. Ids, clusters and buckets come from the counts of
all tokens of all training documents.

Base: the unigram model over whole words and an end, with counts of all
training documents. Words that make up at least a `hot` share of all (so at
most 1 / hot of them) are looked up in the tasks, all others meet their counts
in a join by hash.

Defined results: null and empty texts are the end alone; rows without doc_id
are learned from and not held out; each row is a document, also where rows or
ids repeat; a text of any length counts whole; without training documents all
counts are 0 and the model is uniform in its clusters; an empty table gives an
empty table; columns other than the id and the text do not matter, whatever
their names.
"""

from __future__ import annotations

import base64
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, mix64, slices, stage

CONTEXT = STRIDE = 8
SPAN = CONTEXT + STRIDE


@lru_cache(maxsize=2)
def _tokenizer(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), len(ranks)


class Subwords:
    """Ids of words in a table by the word's hash, a word a slot: a word takes the first of its two slots if that is empty; one that finds others in both is encoded again and takes the second. `keep` ids are kept, then the table starts again."""

    def __init__(self, tokenizer: tuple[str, str], keep: int = 1 << 23, slots: int = 1 << 22):
        self.encode, self.end = _tokenizer(*tokenizer)
        self.keep, self.slots = keep, slots
        self._clear()

    def _clear(self) -> None:
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.keys, self.at, self.sizes = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int32), np.zeros(self.slots, np.int32)

    def _encoded(self, w: Words, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in `flat` and number of the ids of words, encoded now."""
        raw, encode = w.data.tobytes(), self.encode.encode_ordinary
        lists = [encode(" " + raw[a:b].decode("utf-8", "replace")) for a, b in zip(w.starts[words].tolist(), w.ends[words].tolist())]
        sizes = np.fromiter(map(len, lists), np.int32, len(lists))
        total = int(sizes.sum())
        if self.used + total > len(self.flat):
            self.flat = np.concatenate((self.flat[: self.used], np.zeros(self.used + total, np.int32)))
        self.flat[self.used : self.used + total] = np.fromiter((i for x in lists for i in x), np.int32, total)
        at = (self.used + np.cumsum(sizes) - sizes).astype(np.int32)
        self.used += total
        return at, sizes

    def ids(self, w: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of ids of each word)."""
        if self.used > self.keep:
            self._clear()
        slot = (hashes & np.uint64(self.slots - 1)).astype(np.int64)
        miss = np.flatnonzero(self.keys[slot] != hashes)
        slot[miss] = ((hashes[miss] >> np.uint64(32)) & np.uint64(self.slots - 1)).astype(np.int64)
        miss = miss[self.keys[slot[miss]] != hashes[miss]]
        a, n = self.at[slot].astype(np.int64), self.sizes[slot].astype(np.int64)
        if len(miss):
            unique, first, back = np.unique(hashes[miss], return_index=True, return_inverse=True)
            at, size = self._encoded(w, miss[first])
            a[miss], n[miss] = at[back], size[back]
            own = (unique & np.uint64(self.slots - 1)).astype(np.int64)
            own = np.where(self.keys[own] == 0, own, slot[miss[first]])
            self.keys[own], self.at[own], self.sizes[own] = unique, at, size
        off = np.cumsum(n) - n
        return self.flat[np.repeat(a - off, n) + np.arange(int(n.sum()))], n


@lru_cache(maxsize=1)
def subwords(tokenizer: tuple[str, str]) -> Subwords:
    """The table of this process: Python workers go from task to task, and so do the words that they know."""
    return Subwords(tokenizer)


def streams(w: Words, ids: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """end, ids, end of every row, after each other; and where rows start (one more entry)."""
    n = len(w.first) - 1
    run = np.concatenate(([0], np.cumsum(sizes)))
    tokens = run[w.first]
    starts = tokens + 2 * np.arange(n + 1)
    out = np.full(starts[-1], end, np.int32)
    row = np.repeat(np.arange(n), np.diff(tokens))
    out[np.arange(len(ids)) + 2 * row + 1] = ids
    return out, starts


@lru_cache(maxsize=2)
def _places(n: int, d: int) -> np.ndarray:
    return np.arange(n * d).reshape(n, d)


def _add_rows(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of values by row number."""
    out = np.zeros(n * values.shape[1], values.dtype)
    np.add.at(out, _places(n, values.shape[1]).take(rows, 0, mode="clip").reshape(-1), values.reshape(-1))
    return out.reshape(n, -1)


def _exp(x: np.ndarray) -> np.ndarray:
    """e**x in place; values above 60 count as 60."""
    if x.size and not x.max() <= 60:
        np.minimum(x, np.float32(60), out=x)
    return np.exp(x, out=x)


class Model:
    """count: of each id, first: whether the id begins a word. The `known` most frequent ids have vectors of their own, all others share one."""

    def __init__(self, count: np.ndarray, first: np.ndarray, known: int = 2048, clusters: int = 32, size: int = 32, buckets: int = 8, dim: int = 16, seed: int = 9):
        count = np.asarray(count, float)
        order = np.lexsort((np.arange(len(count)), -count))
        order = order[count[order] > 0]
        self.dense = np.full(len(count), len(order[:known]), np.uint16)
        self.dense[order[:known]] = np.arange(len(order[:known]))
        top = order[: clusters * size]
        top = top[np.argsort(~first[top], kind="stable")]
        self.clusters = n = -(-len(top) // size)
        self.cls, self.place = np.empty(len(count), np.int16), np.zeros(len(count), np.int16)
        self.cls[top], self.place[top] = np.arange(len(top)) // size, np.arange(len(top)) % size
        rest = np.setdiff1d(np.arange(len(count)), top)
        rest = rest[np.argsort(-count[rest], kind="stable")]
        mass = np.cumsum(count[rest] + 0.5)
        if len(rest):
            self.cls[rest] = n + np.minimum(buckets - 1, (mass / mass[-1] * buckets).astype(np.int16))
        total = np.bincount(self.cls[rest], count[rest] + 0.5, n + buckets)
        self.inside = np.zeros(len(count), np.float32)
        self.inside[rest] = np.log((count[rest] + 0.5) / total[self.cls[rest]])
        rng = np.random.default_rng(seed)
        some = np.bincount(self.cls, count, n + buckets) + 1
        share = np.full((n, size), 1e-9)
        share[self.cls[top], self.place[top]] = count[top]
        rows = len(order[:known]) + 1
        params = {
            "u": rng.normal(0, 0.5, (rows, dim)), "e": rng.normal(0, 0.3, (rows, dim)), "m": rng.normal(0, 0.5 / math.sqrt(dim), (dim, 3 * dim)), "g": np.zeros(dim), "b": -0.1 * np.arange(SPAN),
            "w": rng.normal(0, 0.1, (dim, n + buckets)), "o": np.log(some / some.sum()), "w2": rng.normal(0, 0.1, (n, dim, size)), "o2": np.log(share / np.maximum(1e-9, share.sum(1, keepdims=True))),
        }
        self.params = {k: v.astype(np.float32) for k, v in params.items()}
        self.scale = np.float32(1 / math.sqrt(dim))
        far = np.arange(SPAN)[:, None] - np.arange(SPAN)[None]
        self.far, self.ahead = np.maximum(far, 0), far < 0

    def attend(self, x: np.ndarray, ask: int, hidden: np.ndarray | None = None):
        """x: (batch, SPAN) dense ids; the last `ask` places ask; no place sees what follows it, nor what is hidden. Returns what the backward pass needs."""
        p = self.params
        d = p["u"].shape[1]
        asks = x[:, SPAN - ask :]
        if x.size > 4 * len(p["u"]):  # many places: an id's projections are made once
            u, all_three = None, p["u"] @ p["m"]
            q, kv = all_three[:, :d].take(asks, 0, mode="clip"), all_three[:, d:].take(x, 0, mode="clip")
            k, v = kv[..., :d], kv[..., d:]
        else:
            u = p["u"].take(x, 0, mode="clip")
            all_three = (u.reshape(-1, d) @ p["m"]).reshape(*x.shape, 3 * d)
            q, k, v = all_three[:, SPAN - ask :, :d], all_three[..., d : 2 * d], all_three[..., 2 * d :]
        bias = p["b"][self.far]
        bias[self.ahead] = -1e9
        a = np.matmul(q, k.transpose(0, 2, 1))
        a *= self.scale
        a += bias[SPAN - ask :]
        if hidden is not None and hidden.any():
            at = np.flatnonzero(hidden.any(1))
            a[at] -= np.float32(1e9) * hidden[at][:, None, :]
        _exp(a)
        a /= np.matmul(a, np.ones((SPAN, 1), a.dtype))
        z = np.matmul(a, v)
        z += (p["e"] + p["g"]).take(asks, 0, mode="clip")
        return u, q, k, v, a, z

    def _probs(self, h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unnormed probabilities and their sums. w: weights, and the bias as their last row."""
        out = _exp(np.matmul(h, w))
        return out, np.matmul(out, np.ones(out.shape[-1], out.dtype))

    def _rectified(self, z: np.ndarray) -> np.ndarray:
        """What the output sees of z, and a one for the bias; one more row, of zeros."""
        n, d = z.size // z.shape[-1], z.shape[-1]
        h = np.empty((n + 1, d + 1), z.dtype)
        np.maximum(z.reshape(n, d), 0, out=h[:n, :d])
        h[:n, d], h[n] = 1, 0
        return h

    def _tiled(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Targets of one cluster fill tiles of 32 places, or of 64 if there are many. From the targets' clusters: which target a place has (their number: none), the tiles' clusters, where each cluster's tiles begin, and the place of each target (one past the last: none, its cluster has no vectors)."""
        size = 64 if len(c) > 128 * self.clusters else 32
        order = np.argsort(np.minimum(c, self.clusters).astype(np.uint16), kind="stable")
        n = np.bincount(np.minimum(c, self.clusters), minlength=self.clusters + 1)[:-1]
        tiles = -(-n // size)
        begin = np.append(0, np.cumsum(tiles))
        order = order[: n.sum()]
        to = np.arange(len(order)) + np.repeat(size * begin[:-1] - np.cumsum(n) + n, n)
        which = np.full(begin[-1] * size, len(c))
        which[to] = order
        places = np.full(len(c), len(which))
        places[order] = to
        return which.reshape(-1, size), np.repeat(np.arange(self.clusters), tiles), begin, places

    def log_probs(self, x: np.ndarray, targets: np.ndarray, hidden: np.ndarray | None = None) -> np.ndarray:
        """Natural log of the probability of the target ids at the last places. x: (batch, SPAN) ids."""
        p = self.params
        c, place = self.cls[targets].reshape(-1), self.place[targets].reshape(-1)
        h = self._rectified(self.attend(self.dense[x], targets.shape[1], hidden)[-1])
        prob, total = self._probs(h[:-1], np.vstack((p["w"], p["o"])))
        ratio = prob[np.arange(len(c)), c] / total
        which, tiles, _, places = self._tiled(c)
        prob, total = self._probs(h.take(which, 0, mode="clip"), np.concatenate((p["w2"], p["o2"][:, None]), 1)[tiles])
        own = np.flatnonzero(places < which.size)
        at = places[own]
        ratio[own] *= prob.reshape(-1, prob.shape[-1])[at, place[own]] / total.reshape(-1)[at]
        return np.log(np.maximum(ratio, np.float32(1e-30))).reshape(targets.shape) + self.inside[targets]

    def gradient(self, x: np.ndarray, targets: np.ndarray, real: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean loss over the real places of windows of ids; what is not real follows all that is."""
        p, x = self.params, self.dense[x]
        u, q, k, v, a, z = self.attend(x, SPAN)
        d = z.shape[2]
        c, place = self.cls[targets].reshape(-1), self.place[targets].reshape(-1)
        h = self._rectified(z)
        weight = np.append(real.reshape(-1) / max(1, real.sum()), 0).astype(h.dtype)
        first = np.vstack((p["w"], p["o"]))
        prob, total = self._probs(h[:-1], first)
        prob *= (weight[:-1] / total)[:, None]
        prob[np.arange(len(c)), c] -= weight[:-1]
        both = h[:-1].T @ prob
        g = {"w": both[:d], "o": both[d]}
        dh = prob @ p["w"].T
        which, tiles, begin, places = self._tiled(c)
        second = np.concatenate((p["w2"], p["o2"][:, None]), 1)
        h2, weight2 = h.take(which, 0, mode="clip"), weight.take(which)
        prob, total = self._probs(h2, second[tiles])
        prob *= (weight2 / total)[..., None]
        own = np.flatnonzero(places < which.size)
        prob.reshape(-1, prob.shape[-1])[places[own], place[own]] -= weight[own]
        both = np.zeros_like(second)
        flat, probs = h2.reshape(-1, d + 1), prob.reshape(-1, prob.shape[-1])
        cut = (begin * which.shape[1]).tolist()
        for j in range(self.clusters):
            if cut[j] < cut[j + 1]:
                np.matmul(flat[cut[j] : cut[j + 1]].T, probs[cut[j] : cut[j + 1]], out=both[j])
        g["w2"], g["o2"] = both[:, :d], both[:, d]
        back = np.zeros((which.size + 1, d), h.dtype)
        np.matmul(prob, p["w2"][tiles].transpose(0, 2, 1), out=back[:-1].reshape(*which.shape, d))
        dh += back.take(places, 0, mode="clip")
        dh *= h[:-1, :d] > 0
        g["g"] = np.ones(len(dh), dh.dtype) @ dh
        dz = dh.reshape(z.shape)
        ds = np.matmul(dz, v.transpose(0, 2, 1))
        ds *= a
        ds -= a * np.matmul(ds, np.ones((SPAN, 1), ds.dtype))
        by_place = (np.ones(len(ds), ds.dtype) @ ds.reshape(len(ds), -1)).reshape(SPAN, SPAN)
        g["b"] = np.bincount(self.far.reshape(-1), np.where(self.ahead, 0, by_place).reshape(-1), SPAN).astype(p["b"].dtype)
        ds *= self.scale
        all_three = np.empty((*x.shape, 3 * d), ds.dtype)
        np.matmul(ds, k, out=all_three[..., :d])
        np.matmul(ds.transpose(0, 2, 1), q, out=all_three[..., d : 2 * d])
        np.matmul(a.transpose(0, 2, 1), dz, out=all_three[..., 2 * d :])
        all_three = all_three.reshape(-1, 3 * d)
        u = p["u"].take(x, 0, mode="clip") if u is None else u
        g["m"] = u.reshape(-1, d).T @ all_three
        both = np.empty((len(dh), 2 * d), dh.dtype)
        np.matmul(all_three, p["m"].T, out=both[:, :d])
        both[:, d:] = dh
        both = _add_rows(x.reshape(-1), both, len(p["u"]))
        g["u"], g["e"] = both[:, :d], both[:, d:]
        return g

    def learn(self, chunks, steps: int, batch: int, rate: float, seed: int, expected: int) -> int:
        """Adam over all windows of chunks of (rows of ids, how many of them are real), at least `steps` steps: the first windows repeat if there are fewer. Returns the number of windows."""
        rng = np.random.default_rng(seed)
        shapes = {k: v.shape for k, v in self.params.items()}
        flat = np.concatenate([v.reshape(-1) for v in self.params.values()])
        cuts = np.cumsum([v.size for v in self.params.values()])[:-1]
        self.params = {k: v.reshape(n) for (k, n), v in zip(shapes.items(), np.split(flat, cuts))}
        m, s, root = np.zeros_like(flat), np.zeros_like(flat), np.empty_like(flat)  # moments, 10 and 100 times as large
        total, t, seen = max(steps, -(-expected // batch)), 0, 0

        def step(x: np.ndarray, n: np.ndarray) -> None:
            nonlocal t
            t += 1
            g = self.gradient(x[:, :-1], x[:, 1:], np.arange(SPAN)[None] < (n - 1)[:, None])
            g = np.concatenate([g[k].reshape(-1) for k in shapes])
            lr = rate * min(1.0, t / 20) * max(0.05, 1 - t / (total + 1))  # a shard with more windows than expected still learns
            np.multiply(m, np.float32(0.9), out=m)
            np.add(m, g, out=m)
            np.multiply(g, g, out=g)
            np.multiply(s, np.float32(0.99), out=s)
            np.add(s, g, out=s)
            np.sqrt(s, out=root)
            size = 10 * math.sqrt(1 - 0.99**t)
            np.add(root, np.float32(1e-8 * size), out=root)
            np.divide(m, root, out=root)
            np.multiply(root, np.float32(lr * 0.1 * size / (1 - 0.9**t)), out=root)
            np.subtract(flat, root, out=flat)

        kept: list[tuple[np.ndarray, np.ndarray]] = []
        rest = (np.zeros((0, SPAN + 1), np.int32), np.zeros(0, np.int64))
        for windows, sizes in chunks:
            if seen < steps * batch:
                kept.append((windows, sizes))
            seen += len(windows)
            order = rng.permutation(len(windows))
            windows, sizes = np.concatenate((rest[0], windows[order])), np.concatenate((rest[1], sizes[order]))
            full = len(windows) // batch * batch
            for at in range(0, full, batch):
                step(windows[at : at + batch], sizes[at : at + batch])
            rest = windows[full:], sizes[full:]
        if len(rest[0]):
            step(*rest)
        if seen and t < steps:
            windows, sizes = (np.concatenate(x) for x in zip(*kept))
            while t < steps:
                order = rng.permutation(len(windows))
                for at in range(0, min(len(order), (steps - t) * batch), batch):
                    step(windows[order[at : at + batch]], sizes[order[at : at + batch]])
        return seen

    def pack(self) -> bytes:
        return b"".join(self.params[k].astype(np.float32).tobytes() for k in sorted(self.params))

    def unpack(self, flat: np.ndarray) -> None:
        at = 0
        for k in sorted(self.params):
            n = self.params[k].size
            self.params[k] = flat[at : at + n].astype(np.float32).reshape(self.params[k].shape)
            at += n


def tiles(tokens: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows of SPAN + 1 tokens, how many are real) over all rows of `streams`: every token after a row's first is a target once."""
    pieces = -(-(np.diff(starts) - 1) // SPAN)
    row = np.repeat(np.arange(len(pieces)), pieces)
    first = starts[row] + SPAN * (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    sizes = np.minimum(starts[row + 1] - first, SPAN + 1)
    place = np.arange(SPAN + 1)[None]
    windows = np.where(place < sizes[:, None], tokens[np.minimum(first[:, None] + place, max(0, len(tokens) - 1))], 0)
    return windows.astype(np.int32), sizes


SUBWORD, WORD, WINDOWS = 0, 1, 2


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    cut = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[cut], np.add.reduceat(n, cut) if len(cut) else n


def _tallies(batches, tokenizer, rounds: tuple[int, ...], most: int = 2_000_000):
    """(kind, key, n): counts of all subword ids (and ends), of the hashes of all words, and the number of windows by round."""
    sub, ids_seen, windows = None, None, np.zeros(len(rounds), np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        sub = sub or subwords(tokenizer)
        ids_seen = np.zeros(sub.end + 1, np.int64) if ids_seen is None else ids_seen
        for part in slices(batch, "text"):
            w = Words(part.column("text"), lower=True)
            ids, sizes = sub.ids(w, w.hashes)
            ids_seen += np.bincount(ids, minlength=sub.end + 1)
            ids_seen[sub.end] += part.num_rows
            tokens = np.diff(np.append(0, np.cumsum(sizes))[w.first]) + 1
            windows += np.bincount(part.column("round").to_numpy(), -(-tokens // SPAN), len(rounds)).astype(np.int64)
            held.append(_summed(w.hashes, np.ones(len(w), np.int64)))
            size += len(held[-1][0])
            if size > most:
                held = [_summed(*map(np.concatenate, zip(*held)))]
                size = len(held[0][0])
                if size > most // 2:
                    yield _tally(WORD, held[0][0].view(np.int64), held[0][1])
                    held, size = [], 0
    if held:
        h, n = _summed(*map(np.concatenate, zip(*held)))
        yield _tally(WORD, h.view(np.int64), n)
    if sub:
        some = np.flatnonzero(ids_seen)
        yield _tally(SUBWORD, some, ids_seen[some])
        yield _tally(WINDOWS, np.arange(len(rounds)), windows)


def _tally(kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys, pa.int64()), pa.array(n, pa.int64())], names=["kind", "key", "n"])


def _sums(tallies: DataFrame, kind: int) -> dict[int, int]:
    """Sums of a kind whose keys are few: subword ids or rounds."""
    return {r["key"]: r["n"] for r in tallies.where(F.col("kind") == kind).groupBy("key").agg(F.sum("n").alias("n")).collect()}


def _learned(batches, model: Model, tokenizer, steps: int, batch: int, rate: float, seed: int, expected: int):
    sub = subwords(tokenizer)

    def chunks():
        for b in batches:
            for part in slices(b, "text"):
                w = Words(part.column("text"), lower=True)
                yield tiles(*streams(w, *sub.ids(w, w.hashes), sub.end))

    n = model.learn(chunks(), steps, batch, rate, seed, expected)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([model.pack()], pa.binary()), pa.array([n], pa.int64())], names=["params", "n"])


def _mean(batches):
    """The mean of packed weights by their numbers of windows, one after the other."""
    total, windows = None, 0
    for batch in batches:
        for params, n in zip(batch.column("params"), batch.column("n").to_pylist()):
            flat = np.frombuffer(params.as_buffer(), np.float32) * float(n)
            total = flat if total is None else total + flat
            windows += n
    if windows:
        yield pa.RecordBatch.from_arrays([pa.array([(total / windows).astype(np.float32).tobytes()], pa.binary()), pa.array([windows], pa.int64())], names=["params", "n"])


def _scores(batches, model: Model, tokenizer, hot: np.ndarray, counts: np.ndarray):
    """A row for each document: its score, what the hot words give to the base, and the hashes and numbers of its other words."""
    sub = None
    logs = np.log10(counts + 0.5)
    for batch in batches:
        sub = sub or subwords(tokenizer)
        for part in slices(batch, "text"):
            n = part.num_rows
            w = Words(part.column("text"), lower=True)
            h, rare = w.hashes, np.ones(len(w), bool)
            base, known = np.zeros(n), np.zeros(n)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
                ok = hot[at] == h
                base, known, rare = np.bincount(w.doc[ok], logs[at[ok]], n), np.bincount(w.doc[ok], minlength=n), ~ok
            tokens, starts = streams(w, *sub.ids(w, h), sub.end)
            score = np.zeros(n)
            pieces = -(-(np.diff(starts) - 1) // STRIDE)
            row = np.repeat(np.arange(n), pieces)
            first = starts[row] + STRIDE * (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
            views = np.lib.stride_tricks.sliding_window_view(np.concatenate((np.zeros(CONTEXT, np.int32), tokens, np.zeros(STRIDE, np.int32))), SPAN + 1)
            for i in range(0, len(row), 1024):
                r, f = row[i : i + 1024], first[i : i + 1024]
                x, hidden = views[f], np.zeros((len(r), SPAN), bool)
                hidden[f == starts[r], :CONTEXT] = True
                asked = np.arange(STRIDE) < (starts[r + 1] - 1 - f)[:, None]
                lp = np.where(asked, model.log_probs(x[:, :-1], x[:, CONTEXT + 1 :], hidden), 0).sum(1)
                score += np.bincount(r, lp, n)
            doc, h = w.doc[rare], h[rare]
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))) if len(h) else np.zeros(0, np.int64)
            times = np.diff(np.append(new, len(h))).astype(np.int32)
            cut = pa.array(np.searchsorted(doc[new], np.arange(n + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cut, pa.array(x)) for x in (h[new].view(np.int64), times)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("rid"), part.column("held_out"), pa.array(w.counts + 1), pa.array(base), pa.array(known.astype(np.int64)), pa.array(score / math.log(10)), *lists], names=["doc_id", "rid", "held_out", "n_tokens", "hot_base", "hot_known", "score", "words", "times"])


def lm_scores(
    docs: DataFrame, tokenizer: tuple[str, str], *, doc_id: str = "doc_id", text: str = "text", hot: float = 1e-5, rounds: tuple[int, ...] = (1, 5, 10), shard_windows: int = 131_072, steps: int = 200, batch: int = 256, rate: float = 0.02, seed: int = 9,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. tokenizer: path of a tiktoken rank file that all machines have, and its pattern. rounds: shares of the training documents."""
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    base = base.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False)))
    order = F.xxhash64(F.lit(seed), "doc_id", "text")
    turn = F.pmod(order, F.lit(sum(rounds)))
    number = sum(((turn >= sum(rounds[: k + 1])).cast("int") for k in range(len(rounds) - 1)), F.lit(0))
    own = base.where("NOT held_out").select("doc_id", "text", number.alias("round"))

    tallies = stage(own.mapInArrow(lambda it: _tallies(it, tokenizer, rounds), "kind int, key long, n long"))
    encoding, end = _tokenizer(*tokenizer)
    count = np.zeros(end + 1)
    for k, n in _sums(tallies, SUBWORD).items():
        count[k] = n
    ends = int(count[end])
    windows = _sums(tallies, WINDOWS)
    first = np.array([k == end or encoding.decode_single_token_bytes(k)[:1] == b" " for k in range(end + 1)])
    seen = stage(tallies.where(F.col("kind") == WORD).groupBy(F.col("key").alias("h")).agg(F.sum("n").alias("c")))
    vocabulary, total = seen.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    train_tokens, vocabulary = int(total) + ends, vocabulary + (ends > 0)
    below = math.log10(train_tokens + 0.5 * (vocabulary + 1))
    often = sorted((np.uint64(r["h"] % 2**64), r["c"]) for r in seen.where(F.col("c") >= max(2.0, hot * total)).collect())  # at most 1 / hot rows
    table, hots = np.array([h for h, _ in often], np.uint64), np.array([c for _, c in often], np.int64)

    model = Model(count, first)
    for k in range(len(rounds)):
        n = windows.get(k, 0)
        if not n:
            continue
        now, shards = model, -(-n // shard_windows)
        shard = F.pmod(F.xxhash64(order, F.lit(k)), F.lit(shards))
        dealt = own.where(F.col("round") == k).select("text", order.alias("order"), shard.alias("shard")).repartition(shards, "shard").sortWithinPartitions("shard", "order")
        learned = dealt.mapInArrow(lambda it: _learned(it, now, tokenizer, steps, batch, rate / (1 + k / 2), seed + k, -(-n // shards)), "params binary, n long")
        means = learned.repartition(math.isqrt(shards)).mapInArrow(_mean, "params binary, n long")
        got = sorted(means.collect(), key=lambda r: (r["n"], r["params"]))  # the root of the number of shards, about half a MB each
        if got:
            model.unpack(np.average([np.frombuffer(r["params"], np.float32) for r in got], axis=0, weights=[r["n"] for r in got]))

    numbered = base.withColumn("rid", F.monotonically_increasing_id())  # of the table as it is written below
    scored = stage(numbered.mapInArrow(lambda it: _scores(it, model, tokenizer, table, hots), "doc_id long, rid long, held_out boolean, n_tokens long, hot_base double, hot_known long, score double, words array<long>, times array<int>"))
    rare = scored.select("rid", F.explode(F.arrays_zip("words", "times")).alias("w")).select("rid", F.col("w.words").alias("h"), F.col("w.times").alias("n"))
    rare = rare.join(seen, "h", "left").groupBy("rid").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare_base"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"))
    return scored.drop("words", "times").join(rare, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("hot_known") + F.coalesce("rare_known", F.lit(0)) + F.lit(int(ends > 0))).cast("long").alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("hot_base") + F.coalesce("rare_base", F.lit(0.0)) + F.lit(math.log10(ends + 0.5)) - F.col("n_tokens") * F.lit(below)).alias("base_score"), "score")
