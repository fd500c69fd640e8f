"""Operator 6: near-duplicate documents by DartMinHash.

Darts: each shingle of weight w owns the region [0, w) x [0, inf) of weight and
rank. A hash seeded by the shingle throws darts on it, a Poisson process of unit
intensity, in weight cells [2^v - 1, 2^(v+1) - 1) so that any weight has a
prefix of the same process. Darts below a rank limit are kept; each falls on
one of k coordinates and every coordinate keeps its earliest dart. About
k ln k + 2k darts a document serve, however long it is; a document with an
empty coordinate doubles its limit. Two documents agree on a coordinate with
the probability of their weighted Jaccard similarity.

Joining: coordinates are hashed in bands. Documents of equal shingle sets are
one class first. In each bucket all classes meet the bucket's smallest class,
and the exact similarity decides. Buckets that these links leave in several
components get longer signatures (`long` coordinates), which tasks compare
block by block: first every class without a link to its bucket's head meets its
likeliest partner in each other component, then, after joining, all partners
that the estimate does not put 4.5 standard errors below the limit, nor the
distances to the head beyond it (the Jaccard distance is a metric). The exact
similarity decides again. So the pairs of a group stay linear in its size but
for classes at its very edge, and no bucket pair that could join components is left out.

Defined results: shingles are `width` consecutive words (A-Z lower-cased), of
weight 1, or of as much as they occur (`weighted`); a
text of fewer words, but not none, is one shingle; null and wordless texts are
one document each and link with nothing; the class id is the smallest doc_id
of the component; rows without an id take no part and keep themselves.
Rows that repeat an id are one document: they share a class and are kept or
dropped together (`drop_near_duplicates` keeps one row of a class also then). A
text of any length counts whole; an empty table gives an empty table; columns
other than the id and the text do not matter, whatever their names. At the
default 20 bands of 4, a pair at exactly 0.8 is missed with
probability 3e-5, one at 0.85 with 1e-7.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, mix64, slices, stage
from .graph import components

_U = 2.0**-53


def _unit(h: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1) from 64 bits."""
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * _U


def shingles(texts: pa.Array, width: int, weighted: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, weight) of the distinct shingles, ordered by row and hash; weight 1, or the count in the row."""
    w = Words(texts, lower=True)
    hs = w.hashes
    at, grams = w.grams(hs, width)
    rows = w.doc[at]
    for i in np.flatnonzero((w.counts > 0) & (w.counts < width)):
        h = np.zeros(1, np.uint64)
        for x in hs[w.first[i] : w.first[i + 1]]:
            h = h * np.uint64(0xD6E8FEB86659FD93) + x
        rows, grams = np.append(rows, i), np.append(grams, mix64(h, int(w.counts[i])))
    order = np.lexsort((grams, rows))
    rows, grams = rows[order], grams[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (grams[1:] != grams[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(rows))).astype(float)
    return rows[at], grams[at], count if weighted else np.ones(len(at))


def darts(elements: np.ndarray, weights: np.ndarray, limits: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the element, dart id, rank) of all darts inside [0, weight) x [0, limit)."""
    out = []
    cell = 0
    live = np.flatnonzero(weights > 0)
    while len(live):
        low, width = 2.0**cell - 1, 2.0**cell
        key = mix64(elements[live], seed * 64 + cell)
        rank = np.zeros(len(live))
        idx, j = live, 0
        while len(idx):
            h = mix64(key, 2 * j + 1)
            rank = rank - np.log(_unit(h)) / width
            inside = rank < limits[idx]
            idx, key, rank, h = idx[inside], key[inside], rank[inside], h[inside]
            place = low + width * _unit(mix64(h, 7))
            hit = place < weights[idx]
            out.append((idx[hit], mix64(h[hit], 11), rank[hit]))
            j += 1
        cell += 1
        live = live[weights[live] > 2.0**cell - 1]
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out))


def signatures(rows: np.ndarray, elements: np.ndarray, weights: np.ndarray, n: int, k: int, seed: int) -> np.ndarray:
    """k coordinates for each of n rows; rows without elements have zeros."""
    sig = np.zeros((n, k), np.uint64)
    total = np.bincount(rows, weights, n)
    limit = np.where(total > 0, (k * np.log(k) + 2 * k) / np.maximum(total, 1e-300), 0.0)
    todo = np.arange(len(rows))
    while len(todo):
        idx, dart, rank = darts(elements[todo], weights[todo], limit[rows[todo]], seed)
        cell = rows[todo][idx] * k + (dart % np.uint64(k)).astype(np.int64)
        order = np.lexsort((dart, rank, cell))
        cell, dart = cell[order], dart[order]
        first = np.ones(len(cell), bool)
        first[1:] = cell[1:] != cell[:-1]
        cell, dart = cell[first], dart[first]
        sig.reshape(-1)[cell] = dart
        full = np.bincount(cell // k, minlength=n) == k
        todo = todo[~full[rows[todo]]]
        limit *= 2
    return sig


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _sketch(batches, width: int, weighted: bool, bands: int, depth: int, seed: int):
    for batch in batches:
        for part in slices(batch, "text"):
            rows, grams, weights = shingles(part.column("text"), width, weighted)
            n = part.num_rows
            sig = signatures(rows, grams, weights, n, bands * depth, seed)
            key = np.zeros((n, bands), np.uint64)
            for j in range(depth):
                key = mix64(key * np.uint64(0xD6E8FEB86659FD93) + sig[:, j::depth], j)
            key = mix64(key + np.arange(bands, dtype=np.uint64), 3)
            # 128 bits of the whole set: sums of mixed elements, so that equal sets are one class
            size = np.bincount(rows, minlength=n)
            at = np.searchsorted(rows, np.arange(n + 1))
            sums = []
            for s in (101, 102):
                run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(mix64(grams, s) + weights.astype(np.uint64)), dtype=np.uint64)))
                sums.append(run[at[1:]] - run[at[:-1]])
            keys = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), _signed(key.reshape(-1)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size.astype(np.int64)), _signed(sums[0]), _signed(sums[1]), keys], names=["doc_id", "n", "s1", "s2", "keys"])


def _similarity(batches, width: int, weighted: bool):
    for batch in batches:
        for part in slices(batch, "left"):
            n = part.num_rows
            r1, g1, w1 = shingles(part.column("left"), width, weighted)
            r2, g2, w2 = shingles(part.column("right"), width, weighted)
            r, g, w = np.concatenate((r1, r2)), np.concatenate((g1, g2)), np.concatenate((w1, w2))
            order = np.lexsort((g, r))
            r, g, w = r[order], g[order], w[order]
            same = (r[1:] == r[:-1]) & (g[1:] == g[:-1])
            both = np.bincount(r[1:][same], np.minimum(w[1:], w[:-1])[same], n)
            union = np.bincount(r, w, n) - both
            sim = np.divide(both, union, out=np.zeros(n), where=union > 0)
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(sim)], names=["a", "b", "sim"])


def _long_signatures(batches, width: int, weighted: bool, long: int, seed: int):
    """One byte of each coordinate of a long signature."""
    for batch in batches:
        for part in slices(batch, "text"):
            rows, grams, weights = shingles(part.column("text"), width, weighted)
            sig = (signatures(rows, grams, weights, part.num_rows, long, seed + 1) >> np.uint64(56)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([part.column("rep"), pa.array([r.tobytes() for r in sig], pa.binary())], names=["rep", "sig"])


def _likely(batches, least: float, near: float, best: bool):
    """Pairs (a, b) to compare exactly: classes away from their head, and partners of another component."""

    def pairs(t: pa.Table):
        loose = t.column("loose").to_numpy(zero_copy_only=False)
        rep, part, far = (t.column(c).to_numpy() for c in ("rep", "part", "far"))
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(len(rep), -1)
        keys = np.asarray(t.column("keys").combine_chunks().flatten()).reshape(len(rep), -1)
        here = t.column("key")[0].as_py()
        others, out = np.flatnonzero(~loose), [[], []]
        for i in np.flatnonzero(loose):
            may = others[(part[others] != part[i]) & (np.abs(far[others] - far[i]) <= near)]
            shared = keys[may] == keys[i]
            may = may[(keys[i][shared.argmax(1)] == here) | ~shared.any(1)]  # a pair counts in the first bucket that it shares (an id with several texts: in all)
            est = (sig[may] == sig[i]).mean(1)
            may, est = may[est >= least], est[est >= least]
            if best and len(may):  # the likeliest of each component
                order = np.lexsort((rep[may], -est, part[may]))
                may = may[order][np.append(True, np.diff(part[may][order]) != 0)]
            out[0] += [rep[i]] * len(may)
            out[1] += rep[may].tolist()
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b"])

    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        key = np.stack([batch.column(c).to_numpy() for c in ("key", "lb", "ob")], 1)
        cut = np.append(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, len(key)) if len(key) else []
        at = 0
        for to in cut:
            if held and tuple(key[at]) != last:
                yield from pairs(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(at, to - at))
            last = tuple(key[at])
            at = to
    if held:
        yield from pairs(pa.Table.from_batches(held))


def near_duplicates(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 5, min_similarity: float = 0.8, weighted: bool = False, bands: int = 20, depth: int = 4, long: int = 512, block: int = 4096, seed: int = 6,
) -> DataFrame:
    """One row per row of docs: doc_id, class_id (smallest doc_id of the component) and keep (doc_id = class_id).

    weighted: shingles count as often as they occur (weighted Jaccard); else once.
    """
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sketch = base.where("doc_id IS NOT NULL").mapInArrow(lambda it: _sketch(it, width, weighted, bands, depth, seed), "doc_id long, n long, s1 long, s2 long, keys array<long>")
    sketch = stage(sketch.where("n > 0"))
    classes = stage(sketch.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep")))
    same = sketch.select("doc_id", "n", "s1", "s2").join(classes, ["n", "s1", "s2"]).select("doc_id", "rep")
    members = stage(same)
    # one row per class and band; equal sets have equal keys, so the smallest id carries them
    reps = sketch.join(classes, ["n", "s1", "s2"]).where("doc_id = rep").dropDuplicates(["rep", "s1", "s2"]).select("rep", "n", F.explode("keys").alias("key"))
    buckets = reps.groupBy("key").agg(F.min("rep").alias("head"), F.max("rep").alias("last")).where("head < last").select("key", "head")
    placed = stage(reps.join(buckets, "key").select("key", "rep", "head"))

    def verify(pairs: DataFrame) -> DataFrame:
        # texts by id; an id that repeats with several texts joins with each, the best pair counts
        left = pairs.join(base.select(F.col("doc_id").alias("a"), F.col("text").alias("left")), "a")
        both = left.join(base.select(F.col("doc_id").alias("b"), F.col("text").alias("right")), "b").select("a", "b", "left", "right")
        return stage(both.mapInArrow(lambda it: _similarity(it, width, weighted), "a long, b long, sim double"))

    star = verify(placed.where("rep <> head").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct())
    links = star.where(F.col("sim") >= min_similarity).select("a", "b")
    # rows that repeat an id tie its classes together
    links = stage(links.union(members.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))).distinct())
    groups = components(links)
    far = star.groupBy(F.col("a").alias("head"), F.col("b").alias("rep")).agg((1 - F.max("sim")).alias("far"))
    known = placed.join(groups, F.col("rep") == F.col("node"), "left").select("key", "rep", "head", F.coalesce("component", "rep").alias("part"))
    known = known.join(far, ["head", "rep"], "left").withColumn("far", F.coalesce("far", F.lit(0.0)))
    near = 1 - min_similarity + 1e-9
    known = stage(known)
    mixed = known.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count("*").alias("in")).where("p < q").withColumn("g", F.ceil(F.col("in") / block)).select("key", "g")
    left_over = stage(known.join(mixed, "key").select("key", "rep", "part", "far", "g", ((F.col("rep") != F.col("head")) & (F.col("far") > near)).alias("away")))
    some = left_over.select("rep").distinct().join(base.select(F.col("doc_id").alias("rep"), "text"), "rep")
    sigs = stage(some.mapInArrow(lambda it: _long_signatures(it, width, weighted, long, seed), "rep long, sig binary").dropDuplicates(["rep"]))
    every_key = sketch.join(classes, ["n", "s1", "s2"]).where("doc_id = rep").dropDuplicates(["rep"]).select("rep", "keys")
    sigs = stage(sigs.join(every_key, "rep"))
    least = min_similarity - 4.5 * (min_similarity * (1 - min_similarity) / long) ** 0.5
    for best in (True, False):
        now = left_over.join(groups.select(F.col("node").alias("rep"), F.col("component").alias("c")), "rep", "left").withColumn("part", F.coalesce("c", "rep")).drop("c")
        still = now.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("key")
        now = now.join(still, "key", "left_semi").withColumn("b", F.pmod(F.xxhash64(F.lit(seed), "rep"), F.col("g")))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1))
        asks = now.where("away").select("key", F.col("b").alias("lb"), every.alias("ob"), "rep", "part", "far", F.lit(True).alias("loose"))
        gives = now.select("key", every.alias("lb"), F.col("b").alias("ob"), "rep", "part", "far", F.lit(False).alias("loose"))
        dealt = asks.unionByName(gives).join(sigs, "rep").repartition("key", "lb", "ob").sortWithinPartitions("key", "lb", "ob", "loose", "rep")
        likely = dealt.mapInArrow(lambda it: _likely(it, least, near, best), "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        more = verify(likely).where(F.col("sim") >= min_similarity).select("a", "b")
        links = stage(links.union(more))
        groups = components(links)
    final = groups
    out = base.select("doc_id").join(final, F.col("doc_id") == F.col("node"), "left")
    out = out.select("doc_id", F.coalesce("component", "doc_id").alias("class_id"))
    return out.withColumn("keep", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with one row of each class: that of the smallest id, of equal ids any. Rows without words are classes of their own.

    Where an id repeats or is null, rows are told apart by a number of their own.
    """
    odd = not docs.groupBy(doc_id).agg(F.count("*").alias("n")).where(F.col(doc_id).isNull() | (F.col("n") > 1)).isEmpty()
    if not odd:
        gone = stage(near_duplicates(docs, doc_id=doc_id, text=text, **options).where(~F.col("keep")).select(F.col("doc_id").alias("__gone")).distinct())
        return docs.join(gone, F.col(doc_id) == F.col("__gone"), "left_anti")
    rows = stage(docs.withColumn("__row", F.monotonically_increasing_id()))  # numbers of the table as it is written
    classes = near_duplicates(rows, doc_id="__row", text=text, **options).select(F.col("doc_id").alias("__row"), "class_id")
    ids = rows.select("__row", F.struct(F.col(doc_id).isNull(), F.col(doc_id), F.col("__row").alias("row")).alias("__first"))
    kept = ids.join(classes, "__row").groupBy("class_id").agg(F.min("__first").alias("__first")).select(F.col("__first.row").alias("__row"))
    return rows.join(kept, "__row", "left_semi").select(*docs.columns)
