"""Operator 4: quality classifier by co-training.

Two views of a document: its text (which words and word beginnings occur, the
symbols that words end in, and shares of capitals, digits, symbols, repeats and
line lengths, in bins) and its metadata (source, language, size, in bins). Each
view has a logistic classifier, first fitted to labelled rows.

In every round all other documents of the table are the pool. A task scores
them by both views; what a view is sure about, by its calibrated probability,
and the other not sure against, becomes a training row of the other view. Pseudo-labelled rows
are not gathered: tasks add up, by feature, the gradient of their logistic loss
at the present weights and its quadratic bound (for rows of ones, x x' is at
most |x| diag(x), so |x| / 4 by feature bounds the curvature), and the other
view is fitted to its labelled rows and this bound together. So each round
covers the whole table in one pass, and what reaches the driver is bounded by
the number of features.

In the end both views are calibrated on labelled rows held apart, others than
those whose calibration chose pseudo-labels, a logistic combination of the two
is fitted there, and all documents are scored.

Only the labelled rows are bounded: `max_labelled`, those with the smallest
seeded hash of the id. Their feature numbers, not their texts, go to the
driver. A pass reads every document once and shuffles sums by feature alone.

Defined results: a good document has quality 1 and is not toxic; labels that
repeat an id count as their worst; labels without an id or a quality are left
out; null texts and null metadata are values of their own; where labels of one
kind only, or none, are found, every document gets their share of good ones
(0.5 without labels) as its score. Rows that repeat are scored alike and count
each in the pool; texts of any length count whole, a slice of rows or one long
text at a time; an empty table gives an empty table; input columns named as a
result column are replaced, all others pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PUNCT_BYTES, Words, distinct, drop_clashes, minimise, mix64, slices, smallest, stage

DIM, META_DIM = 1 << 18, 1 << 12
#: Bytes of the word beginnings that count as features beside whole words: a stem has many endings.
STEMS = (4, 5, 6)
#: Features per share, so that the penalty on weights binds the few shares less than the many words.
COPIES = 8
RESULT = ["text_score", "meta_score", "score", "keep"]


def text_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs, each once, ordered by row."""
    n = len(texts)
    w = Words(texts, separators=PUNCT_BYTES, lower=True)
    hs = w.hashes
    raw = Words(texts)
    off = raw.offsets

    def share(mask: np.ndarray) -> np.ndarray:
        run = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=run[1:])
        return (run[off[1:]] - run[off[:-1]]) / np.maximum(1, np.diff(off))

    d = raw.data
    upper, lower = (d >= 65) & (d <= 90), (d >= 97) & (d <= 122)
    symbol = PUNCT_BYTES[d] & (d > 32) & (d != 44) & (d != 46)
    key = distinct((w.doc.astype(np.uint64) << np.uint64(40)) | (hs >> np.uint64(24)))
    n_distinct = np.bincount((key >> np.uint64(40)).astype(np.int64), minlength=n)
    lines = share(d == 10) * np.maximum(1, np.diff(off)) + 1
    # shares in steps of a factor of two; the last steps are fine, to tell all from most
    step = lambda x: np.clip(np.round(np.log2(np.maximum(x, 1 / 1024)) * 2) + 20, 0, 63).astype(np.int64)
    stats = [step(share(upper)), step(share(lower)), step(share((d >= 48) & (d <= 57))), step(share(symbol)), step(share(d == 33)), step(share(d >= 128)), step(n_distinct / np.maximum(1, w.counts)), step(w.counts / 1024), step(np.diff(off) / np.maximum(1, raw.counts) / 64), step(raw.counts / lines / 1024)]
    ends = symbol[raw.ends - 1] if len(raw) else np.zeros(0, bool)
    stats.append(step(np.bincount(raw.doc, ends, n) / np.maximum(1, raw.counts)))
    top = DIM - 64 * COPIES * len(stats)
    rows = [(key >> np.uint64(40)).astype(np.int64)]
    feats = [((key & np.uint64((1 << 40) - 1)) % np.uint64(top)).astype(np.int64)]
    for size in STEMS:
        row, h = w.prefixes(size)
        rows.append(row)
        feats.append((mix64(h, size) % np.uint64(top)).astype(np.int64))
    row, h = raw.suffixes(2, ends)
    rows.append(row)
    feats.append((mix64(h, 99) % np.uint64(top)).astype(np.int64))
    for k, s in enumerate(stats * COPIES):
        rows.append(np.arange(n))
        feats.append(top + 64 * k + s)
    both = distinct(np.concatenate(rows) * DIM + np.concatenate(feats))
    return both // DIM, both % DIM


def meta_features(batch: pa.RecordBatch, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs: a feature per column, strings as they are and numbers by magnitude."""
    n = batch.num_rows
    feats = []
    for k, c in enumerate(columns):
        v = batch.column(c)
        if pa.types.is_integer(v.type) or pa.types.is_floating(v.type):
            x = np.nan_to_num(np.asarray(v.cast(pa.float64()).fill_null(-1.0)), nan=-1.0, posinf=-1.0, neginf=-1.0)
            h = np.where(x < 0, 0, np.round(np.log2(np.maximum(x, 0) + 1) * 2) + 1).astype(np.uint64)
        else:
            s = v.cast(pa.string())
            words = Words(s.fill_null("\x01null"), separators=np.zeros(256, bool))
            h = np.zeros(n, np.uint64)
            h[words.doc] = words.hashes
        feats.append((mix64(h, k + 1) % np.uint64(META_DIM)).astype(np.int64))
    rows = np.repeat(np.arange(n), len(columns))
    return rows, np.stack(feats, 1).reshape(-1) if columns else np.zeros(0, np.int64)


def _logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Rows:
    """Sparse rows of ones: feature numbers after each other, and where each row starts."""

    def __init__(self, col: np.ndarray, starts: np.ndarray, dim: int):
        self.col, self.starts, self.n, self.dim = col, starts, len(starts) - 1, dim
        self.sizes = np.diff(starts)

    @classmethod
    def of(cls, lists: list[np.ndarray], dim: int) -> "Rows":
        return cls(np.concatenate([np.zeros(0, np.int32), *lists]).astype(np.int32), np.cumsum([0, *map(len, lists)]), dim)

    def _blocks(self):
        """Products go block by block: their temporary arrays stay small."""
        for a in range(0, self.n, 1000):
            b = min(a + 1000, self.n)
            yield a, b, self.col[self.starts[a] : self.starts[b]], np.repeat(np.arange(b - a), self.sizes[a:b])

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(np.bincount(row, w[col], b - a) for a, b, col, row in self._blocks())])

    def back(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros(self.dim)
        for a, b, col, row in self._blocks():
            out += np.bincount(col, g[a:b][row], self.dim)
        return out


class Bound:
    """A quadratic bound on the loss of pseudo-labelled rows: around `at`, gradient `slope` and curvature `bend`, the intercept last in each."""

    def __init__(self, at: np.ndarray, slope: np.ndarray, bend: np.ndarray):
        self.at, self.slope, self.bend = at, slope, bend


def fit(x: Rows, y: np.ndarray, l2: float, rounds: int = 60, start: np.ndarray | None = None, pseudo: Bound | None = None) -> np.ndarray:
    """Logistic weights, the last is the intercept, on the whole of x and the bound of pseudo-labelled rows, from `start` if given."""

    def value(w):
        z = x.times(w[:-1]) + w[-1]
        loss = np.sum(np.logaddexp(0, z) - y * z) + 0.5 * l2 * np.dot(w[:-1], w[:-1])
        g = _sigmoid(z) - y
        grad = np.append(x.back(g) + l2 * w[:-1], g.sum())
        if pseudo:
            step = w - pseudo.at
            loss += step @ pseudo.slope + 0.5 * (step * step) @ pseudo.bend
            grad += pseudo.slope + pseudo.bend * step
        return loss, grad

    return minimise(value, np.zeros(x.dim + 1) if start is None else start, rounds)


def calibrate(scores: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients (intercept last) that turn columns of scores into log-odds: Newton steps on a lightly bound logistic fit."""
    x = np.column_stack((scores, np.ones(len(scores))))
    c = np.zeros(x.shape[1])
    for _ in range(50):
        p = _sigmoid(x @ c)
        h = x.T @ (x * (p * (1 - p))[:, None]) + np.eye(len(c)) * 1e-2
        step = np.linalg.solve(h, x.T @ (p - y) + 1e-2 * c)
        c -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return c


class Model:
    """Weights and calibration of both views, and of their combination."""

    def __init__(self, prior: float):
        self.prior, self.w, self.cal, self.both = prior, {}, {}, None

    def raw(self, text: tuple[np.ndarray, np.ndarray], meta: tuple[np.ndarray, np.ndarray], n: int) -> dict[str, np.ndarray]:
        """Scores of n rows by view, from (row, feature) pairs."""
        return {v: np.bincount(rows, self.w[v][:-1][feats], n) + self.w[v][-1] for v, (rows, feats) in (("text", text), ("meta", meta))}

    def logits(self, raw: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        return {v: self.cal[v][0] * z + self.cal[v][1] for v, z in raw.items()}

    def scores(self, raw: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities by text, by metadata and by both."""
        z = self.logits(raw)
        both = self.both[0] * np.clip(z["text"], -15, 15) + self.both[1] * np.clip(z["meta"], -15, 15) + self.both[2]
        return _sigmoid(z["text"]), _sigmoid(z["meta"]), _sigmoid(both)


DIMS = {"text": DIM, "meta": META_DIM}
VIEWS = ("text", "meta")


def pseudo_sums(model: Model, text: tuple, meta: tuple, n: int, free: np.ndarray, sure: float) -> dict[str, tuple[np.ndarray, np.ndarray, int]]:
    """Of the rows that are free: for each view the gradient and the bound by feature (intercept last) of the rows that the other view labels, and their number."""
    raw = model.raw(text, meta, n)
    p = {v: _sigmoid(z) for v, z in model.logits(raw).items()}
    out = {}
    for view, other, (rows, feats) in (("text", "meta", text), ("meta", "text", meta)):
        good = free & (p[other] >= sure) & (1 - p[view] < sure)
        bad = free & (1 - p[other] >= sure) & (p[view] < sure)
        taken = good | bad
        g = np.where(taken, _sigmoid(raw[view]) - good, 0.0)
        size = np.where(taken, np.bincount(rows, minlength=n) + 1, 0) / 4
        slope, bend = (np.append(np.bincount(feats, x[rows], DIMS[view]), x.sum()) for x in (g, size))
        out[view] = slope, bend, int(taken.sum())
    return out


def _features(batches, text: str, meta: list[str]):
    """Labelled rows with their features as bytes of int32."""
    for batch in batches:
        for part in slices(batch, text):
            n = part.num_rows
            out = []
            for rows, feats in (text_features(part.column(text)), meta_features(part, meta)):
                at, flat = np.searchsorted(rows, np.arange(n + 1)), feats.astype(np.int32)
                out.append(pa.array([flat[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary()))
            yield pa.RecordBatch.from_arrays([part.column("__id"), part.column("__good"), *out], names=["id", "good", "text", "meta"])


def _pooled(batches, model: Model, text: str, meta: list[str], ids: np.ndarray, sure: float):
    """(view, feature, slope, bend) sums over the task's rows that are not among `ids`; the feature after the last is the intercept, the next one the number of rows."""
    total = {v: [np.zeros(DIMS[v] + 1), np.zeros(DIMS[v] + 1), 0] for v in VIEWS}
    for batch in batches:
        for part in slices(batch, text):
            own = part.column("__id")
            free = ~np.isin(own.fill_null(0).to_numpy(), ids) | np.asarray(own.is_null())
            got = pseudo_sums(model, text_features(part.column(text)), meta_features(part, meta), part.num_rows, free, sure)
            for v in VIEWS:
                for k in range(3):
                    total[v][k] += got[v][k]
    for k, v in enumerate(VIEWS):
        slope, bend, n = total[v]
        at = np.flatnonzero(bend)
        out = [np.full(len(at) + 1, k), np.append(at, DIMS[v] + 1), np.append(slope[at], 0.0), np.append(bend[at], n)]
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), pa.array(out[2]), pa.array(out[3])], names=["view", "feature", "slope", "bend"])


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str, text: str, meta: list[str], max_labelled: int, rounds: int, sure: float, trust: float, l2: float, seed: int) -> Model:
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("__id"))
    known = known.agg(F.min(F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0)).alias("__good"))
    chosen = stage(smallest(known, F.xxhash64(F.lit(seed), "__id"), max_labelled))  # at most max_labelled rows: small enough to broadcast
    pool = docs.select(F.col(doc_id).cast("long").alias("__id"), text, *meta)
    # one row of each id, that of the smallest hash, so that a repeated id brings no more than one row here
    hashed = F.min(F.struct(F.xxhash64(text, *meta).alias("__hash"), text, *meta)).alias("__row")
    single = pool.join(F.broadcast(chosen), "__id").groupBy("__id", "__good").agg(hashed).select("__id", "__good", "__row.*")
    labelled = stage(single.select("__id", "__good", text, *meta).mapInArrow(lambda it: _features(it, text, meta), "id long, good int, text binary, meta binary"))
    rows = sorted(map(tuple, labelled.toLocalIterator()))  # an order of its own, partition after partition
    ids = np.array([r[0] for r in rows], np.int64)
    good = np.array([r[1] for r in rows], float)
    part = mix64(ids.view(np.uint64), seed) % np.uint64(10)  # 0: chooses pseudo-labels, 1: final calibration, others: weights
    model = Model(float(good.mean()) if len(good) else 0.5)
    places = [np.flatnonzero(part > 1), np.flatnonzero(part == 0), np.flatnonzero(part == 1)]
    if any(len(set(good[at])) < 2 for at in places):
        return model
    own, choose, final = ({v: Rows.of([np.frombuffer(rows[i][2 + k], np.int32) for i in at], DIMS[v]) for k, v in enumerate(VIEWS)} for at in places)
    del rows
    y, y_choose, y_final = (good[at] for at in places)
    for v in VIEWS:
        model.w[v] = fit(own[v], y, l2)

    def score(x: dict[str, Rows]) -> dict[str, np.ndarray]:
        return {v: x[v].times(model.w[v][:-1]) + model.w[v][-1] for v in VIEWS}

    for _ in range(rounds):
        model.cal = {v: calibrate(z[:, None], y_choose) for v, z in score(choose).items()}
        now = model
        sums = pool.mapInArrow(lambda it: _pooled(it, now, text, meta, ids, sure), "view int, feature int, slope double, bend double").groupBy("view", "feature").agg(F.sum("slope").alias("slope"), F.sum("bend").alias("bend")).toPandas()  # bounded by the number of features
        for k, v in enumerate(VIEWS):
            mine = sums[sums["view"] == k].sort_values("feature")
            feature, slope, bend = (mine[c].to_numpy() for c in ("feature", "slope", "bend"))
            n = bend[feature == DIMS[v] + 1].sum()
            if not n:
                continue
            at, share = feature[feature <= DIMS[v]], trust * len(y) / max(n, trust * len(y))  # all pseudo-labelled rows together weigh `trust` times the labelled ones at most
            full = np.zeros((2, DIMS[v] + 1))
            full[:, at] = np.stack((slope, bend))[:, : len(at)] * share
            model.w[v] = fit(own[v], y, l2, start=model.w[v], pseudo=Bound(model.w[v], *full))
    z = score(final)
    model.cal = {v: calibrate(z[v][:, None], y_final) for v in VIEWS}
    model.both = calibrate(np.column_stack([np.clip(x, -15, 15) for x in model.logits(z).values()]), y_final)
    model.w = {v: w.astype(np.float32) for v, w in model.w.items()}
    return model


def quality_scores(
    docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", meta: tuple[str, ...] = ("source", "lang", "n_chars"), max_labelled: int = 16_000,
    rounds: int = 2, sure: float = 0.97, trust: float = 0.5, l2: float = 0.03, threshold: float = 0.5, seed: int = 4,
) -> DataFrame:
    """docs with text_score, meta_score and score (probabilities of a good document by text, by metadata, by both) and keep (score >= threshold)."""
    docs = drop_clashes(docs, RESULT)
    meta = [c for c in meta if c in docs.columns]
    model = train(docs, labels, doc_id=doc_id, text=text, meta=meta, max_labelled=max_labelled, rounds=rounds, sure=sure, trust=trust, l2=l2, seed=seed)
    columns = docs.columns

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                n = part.num_rows
                got = (np.full(n, model.prior),) * 3 if model.both is None else model.scores(model.raw(text_features(part.column(text)), meta_features(part, meta), n))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x) for x in got), pa.array(got[2] >= threshold)], names=columns + RESULT)

    fields = [T.StructField(c, T.DoubleType()) for c in RESULT[:3]] + [T.StructField("keep", T.BooleanType())]
    return docs.mapInArrow(run, T.StructType(docs.schema.fields + fields))
