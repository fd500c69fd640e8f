"""Operator 7: near-duplicate embeddings by randomised-rotation binary codes.

Vectors that are equal under one label are one class first. Each class is
turned by seeded random rotations (signs and Hadamard transforms). The signs of
a turned vector are its binary code, and the stored factor
f = <code / sqrt(D), turned vector> corrects the estimate
<x, y> ~ <code_x / sqrt(D), turned y> / f, which is unbiased over rotations,
with an error under sqrt((1 - f^2) / f^2 / (D - 1)) * sigmas. The codes of
several rotations are averaged. A pair whose upper confidence bound is under the limit is
dropped; all others are computed again exactly, in double precision.

Which pairs meet: the largest coordinate of a turned vector names a cell.
`concat` cells make a bucket, and pairs of one label meet in the buckets of
`tables` independent tables. Both numbers follow from the data: concat so that
a bucket has few unrelated vectors, tables so that a pair at the very limit is
missed with probability `miss`. A pair is counted in the first table in which
it meets. Buckets above `block` rows are dealt out in pairs of blocks, so one
task holds two blocks at most; pairs are never emitted as rows, a task returns
link counts and a spanning forest of its links.

Defined results: a vector that is null, empty, zero, or holds a null or a
non-finite number, and one with a null label, links with nothing; vectors of
different lengths do not link; each row is a vector, also where rows repeat (equal
rows link with each other); a row without vec_id links and counts, and has the
smallest known id of its component; a vector counts whole, however long; an
empty table gives an empty table; columns other than the id, the vector and the
label do not matter, whatever their names; labels that aren't whole numbers are
told apart by a 64-bit hash of their text.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import mix64, stage
from .graph import components

CODES = 2


def turn(x: np.ndarray, seed: int, rotation: int) -> np.ndarray:
    """Rows of x (padded to a power of two) under a random rotation: three rounds of signs and a Hadamard transform."""
    n, d = x.shape
    rng = np.random.default_rng([seed, rotation, d])
    for _ in range(3):
        x = x * rng.choice([-1.0, 1.0], d)
        h = 1
        while h < d:
            x = x.reshape(n, d // (2 * h), 2, h)
            x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), 2).reshape(n, d)
            h *= 2
        x = x / math.sqrt(d)
    return x


def _units(vectors: pa.ListArray) -> np.ndarray:
    v = np.asarray(vectors.flatten(), np.float64).reshape(len(vectors), -1)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _padded(u: np.ndarray) -> np.ndarray:
    d = max(2, 1 << (u.shape[1] - 1).bit_length())
    return np.pad(u, ((0, 0), (0, d - u.shape[1])))


def meeting_chance(dim: int, cosine: float, seed: int = 7, trials: int = 20_000) -> float:
    """Chance that two vectors at this cosine have the same largest coordinate after a random rotation."""
    rng = np.random.default_rng([seed, dim])
    d = max(2, 1 << (dim - 1).bit_length())
    hits = 0
    for n in [500] * (trials // 500):
        a, b = rng.standard_normal((n, d)), rng.standard_normal((n, d))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b -= (a * b).sum(1, keepdims=True) * a
        b = cosine * a + math.sqrt(max(0.0, 1 - cosine * cosine)) * b / np.linalg.norm(b, axis=1, keepdims=True)
        i, j = np.abs(a).argmax(1), np.abs(b).argmax(1)
        r = np.arange(n)
        hits += int(((i == j) & (np.sign(a[r, i]) == np.sign(b[r, i]))).sum())
    return max(hits / trials, 0.02)


def cells(u: np.ndarray, tables: int, concat: int, seed: int) -> np.ndarray:
    out = np.zeros((len(u), tables * concat), np.int32)
    r = np.arange(len(u))
    for t in range(tables * concat):
        y = turn(u, seed, CODES + t)
        i = np.abs(y).argmax(1)
        out[:, t] = 2 * i + (y[r, i] > 0)
    return out


def _place(batches, tables: int, concat: int, seed: int):
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            dims = part.column("dim").to_numpy()
            for d in np.unique(dims):
                own = part.filter(pa.array(dims == d))
                c = cells(_padded(_units(own.column("vector"))), tables, concat, seed)
                group = mix64(own.column("label").cast(pa.int64()).to_numpy().astype(np.uint64) * np.uint64(0x10001) + np.uint64(d))
                keys = np.zeros((own.num_rows, tables), np.uint64)
                for j in range(concat):
                    keys = mix64(keys * np.uint64(0xD6E8FEB86659FD93) + c[:, j::concat].astype(np.uint64), j)
                keys = mix64(keys ^ group[:, None], 5) + np.arange(tables, dtype=np.uint64)
                n = own.num_rows
                yield pa.RecordBatch.from_arrays(
                    [own.column("rep"), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * tables), pa.array(mix64(keys, 9).reshape(-1).view(np.int64))), pa.array([x.tobytes() for x in c.astype(np.uint16)], pa.binary())], names=["rep", "keys", "cells"])


def pairs_within(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j), i < j, of rows that stand in consecutive groups of these sizes."""
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    last = np.repeat(np.cumsum(sizes), sizes)
    at = np.arange(len(first))
    n = last - at - 1
    i = np.repeat(at, n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + i + 1


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index linked to each of n rows."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        keep = root[a] != root[b]
        a, b = a[keep], b[keep]
    while (up := root[root]) is not None and (up != root).any():
        root = up
    return root


def _links(batches, cosine: float, tables: int, concat: int, seed: int, sigmas: float):
    def solve(t: pa.Table):
        """Whole groups, in order: link counts and forest edges."""
        key = np.stack([t.column(c).to_numpy() for c in ("key", "lo", "hi")], 1)
        cut = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1)))
        sizes = np.diff(np.append(cut, len(key)))
        rep, mult, sub, dim = (t.column(c).to_numpy() for c in ("rep", "mult", "sub", "dim"))
        table = t.column("table").to_numpy()
        vectors, named = t.column("vector").combine_chunks(), t.column("cells").combine_chunks()
        split = key[:, 1] != key[:, 2]
        at = 0
        while at < len(sizes):
            to = at + 1
            work = int(sizes[at]) ** 2
            while to < len(sizes) and work + int(sizes[to]) ** 2 <= 1_000_000:
                work += int(sizes[to]) ** 2
                to += 1
            lo, hi = cut[at], cut[at] + sizes[at:to].sum()
            u = None
            if len(np.unique(dim[lo:hi])) == 1:
                u = _padded(_units(vectors.slice(lo, hi - lo)))
                yield from pairs(u, named.slice(lo, hi - lo), sizes[at:to], rep[lo:hi], mult[lo:hi], sub[lo:hi], split[lo:hi], table[lo:hi])
            else:  # groups have one length each: by length
                for g in range(at, to):
                    a, b = cut[g], cut[g] + sizes[g]
                    yield from pairs(_padded(_units(vectors.slice(a, b - a))), named.slice(a, b - a), sizes[g : g + 1], rep[a:b], mult[a:b], sub[a:b], split[a:b], table[a:b])
            at = to

    def pairs(u, named, sizes, rep, mult, sub, split, table):
        d = u.shape[1]
        c = np.frombuffer(b"".join(named.to_pylist()), np.uint16).reshape(len(u), tables, concat)
        turned = [turn(u, seed, r) for r in range(CODES)]
        signs = [y > 0 for y in turned]
        factors = [np.abs(y).sum(1) / math.sqrt(d) for y in turned]
        gi, gj = pairs_within(sizes)
        n = np.zeros(len(u))
        la, lb = [], []
        for s in range(0, len(gi), 100_000):
            i, j = gi[s : s + 100_000], gj[s : s + 100_000]
            ok = ~split[i] | (sub[i] != sub[j])
            i, j = i[ok], j[ok]
            same = (c[i] == c[j]).all(2)
            ok = same.argmax(1) == table[i]  # counted where it meets first
            i, j = i[ok], j[ok]
            est, var = np.zeros(len(i)), np.zeros(len(i))
            for y, b, f in zip(turned, signs, factors):
                est += (np.where(b[i], y[j], -y[j]).sum(1) / math.sqrt(d)) / f[i] / CODES
                var += np.maximum(0.0, 1 / (f[i] * f[i]) - 1) / (d - 1) / CODES**2
            ok = est + sigmas * np.sqrt(var) >= cosine - 1e-9
            i, j = i[ok], j[ok]
            ok = (u[i] * u[j]).sum(1) >= cosine
            i, j = i[ok], j[ok]
            n += np.bincount(i, mult[j], len(u)) + np.bincount(j, mult[i], len(u))
            la.append(i)
            lb.append(j)
        # one row of a class in a group, but a class can be in several groups of the chunk
        a, b = np.concatenate(la or [np.zeros(0, int)]), np.concatenate(lb or [np.zeros(0, int)])
        hit = np.flatnonzero(n)
        if len(hit):
            order = np.argsort(rep, kind="stable")
            back = np.empty_like(order)
            back[order] = np.arange(len(order))
            root = rep[order][_forest(back[a], back[b], len(u))][back]
            yield pa.RecordBatch.from_arrays([pa.array(rep[hit]), pa.array(root[hit]), pa.array(n[hit].astype(np.int64))], names=["rep", "root", "n"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        t = pa.Table.from_batches(held)
        if t.num_rows < 4096:
            continue
        key = np.stack([t.column(c).to_numpy() for c in ("key", "lo", "hi")], 1)
        last = np.flatnonzero((key != key[-1]).any(1))
        if len(last):
            yield from solve(t.slice(0, last[-1] + 1))
            held = t.slice(last[-1] + 1).combine_chunks().to_batches()
    if held:
        yield from solve(pa.Table.from_batches(held))


def _label_key(vectors: DataFrame, label: str) -> Column:
    """Whole numbers stand for themselves, other labels for a hash of their text."""
    if isinstance(vectors.schema[label].dataType, IntegralType):
        return F.col(label).cast("long")
    return F.when(F.col(label).isNotNull(), F.xxhash64(F.col(label).cast("string")))


def near_vectors(
    vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.93, miss: float = 1e-6, sigmas: float = 6.0, block: int = 512, seed: int = 7,
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), _label_key(vectors, label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    good = F.col("label").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    usable = rows.where(F.coalesce(good, F.lit(False)))
    # a class is a label and a vector; its number is its place in the table that `stage` writes, and rows find it by 128 bits of hashes
    names = {f"h{k}": F.xxhash64(F.lit(seed + k), "label", "vector") for k in (1, 2)}
    classes = usable.groupBy("label", "vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("mult"))
    classes = classes.withColumns(names).withColumn("rep", F.monotonically_increasing_id()).withColumn("dim", F.size("vector"))
    classes = stage(classes)
    shape = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).agg(F.max("n").alias("n"), F.min("dim").alias("low"), F.max("dim").alias("high")).first()
    if shape["n"] is None:
        tables = concat = 1
    else:
        size = 1 << max(1, (shape["low"] - 1).bit_length())
        concat = max(1, math.ceil(math.log(shape["n"]) / math.log(2 * size)))
        chance = min(meeting_chance(d, cosine, seed) for d in {shape["low"], shape["high"]})
        tables = math.ceil(math.log(miss) / math.log(1 - min(0.999, chance**concat)))

    placed = classes.select("rep", "label", "dim", "vector").mapInArrow(lambda it: _place(it, tables, concat, seed), "rep long, keys array<long>, cells binary")
    named = stage(placed)
    placed = named.select("rep", F.posexplode("keys").alias("table", "key"))
    sizes = placed.groupBy("key").agg(F.count("*").alias("in")).where("in > 1").withColumn("blocks", F.ceil(F.col("in") / block).cast("int"))
    shared = placed.join(sizes, "key").withColumn("sub", F.pmod(F.xxhash64(F.lit(seed), "rep"), F.col("blocks")).cast("int"))
    dealt = shared.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("rep", "table", "key", "sub", F.least("sub", "other").alias("lo"), F.greatest("sub", "other").alias("hi"))
    full = dealt.join(classes.select("rep", "mult", "dim", "vector").join(named.select("rep", "cells"), "rep"), "rep")
    full = full.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "rep")
    found = full.select("key", "lo", "hi", "rep", "mult", "sub", "dim", "table", "vector", "cells").mapInArrow(lambda it: _links(it, cosine, tables, concat, seed, sigmas), "rep long, root long, n long")
    found = stage(found)
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    parts = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    labelled = classes.select("rep", *names, "least", "mult").join(parts, F.col("rep") == F.col("node"), "left").withColumn("part", F.coalesce("component", "rep"))
    lowest = labelled.groupBy("part").agg(F.min("least").alias("component_id"))
    labelled = labelled.join(lowest, "part").join(counts, "rep", "left").select(*names, "component_id", (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    out = rows.select("vec_id", *[F.when(F.coalesce(good, F.lit(False)), h).alias(n) for n, h in names.items()])
    out = out.join(stage(labelled), list(names), "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").cast("long").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
