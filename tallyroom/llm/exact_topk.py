"""Operator 13: exact search of the highest integer inner products.

Components are made integers, floor(scale * x); a vector is the sparse row of
those that aren't 0. Candidates stand in blocks: a block has postings (places,
weights) for each component, and a query scatters its weighted postings into
a dense array of the block's scores, term after term. A partition finds the
block's best, and the best of all blocks are merged by query.

Defined results: a vector that is null or holds a null or non-finite component
takes no part, neither as query nor as candidate; zero and empty vectors take
part and score 0; components past the end of the shorter vector count as 0;
each row is a candidate and, where its id is divisible, a query of its own,
also where rows repeat: an equal other row is a candidate, and equal queries have
equal results; a row without id is no query, and comes after all ids where
scores tie; a score that no long holds is the nearest long; fewer candidates
than `k` give fewer rows; an empty table gives an empty table. Only the two
named columns are read, so others may have any name.

Rows that repeat are counted first and meet as one. Blocks of candidates meet
blocks of queries, both of about `block` different rows, so no task holds more,
whatever repeats; nothing is broadcast or collected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

_LEAST, _MOST = -(2**63), 2**63 - 1
_KEY = ["id", "h1", "h2"]


def integers(vectors: list[np.ndarray], scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, component, value) of the sparse rows floor(scale * x). Values are Python integers where sums of products might not fit a long."""
    lengths = np.array([len(v) for v in vectors], np.int64)
    flat = np.concatenate([*vectors, np.zeros(0)])
    component = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    if lengths.max(initial=0) >= 2**16 or np.abs(flat).max(initial=0) >= 2**23 / scale:
        value = np.array([math.floor(Fraction(x) * Fraction(scale)) for x in flat.tolist()] + [None], object)[:-1]
    else:
        value = np.floor(flat * scale).astype(np.int64)
    some = value != 0
    row = np.repeat(np.arange(len(vectors)), lengths)[some]
    return np.searchsorted(row, np.arange(len(vectors) + 1)), component[some], value[some]


class Block:
    """Postings of a block of candidates."""

    def __init__(self, vectors: list[np.ndarray], scale: float):
        first, component, value = integers(vectors, scale)
        self.size, self.kind = len(vectors), value.dtype
        row = np.repeat(np.arange(self.size), np.diff(first))
        order = np.argsort(component, kind="stable")
        terms, start = np.unique(component[order], return_index=True)
        self.postings: dict[int, tuple[np.ndarray | slice, np.ndarray]] = {}
        for t, a, b in zip(terms.tolist(), start, np.append(start[1:], len(order))):
            at, weight = row[order[a:b]], value[order[a:b]]
            if 2 * len(at) > self.size:  # in most rows: zeros for the others cost less than places
                full = np.zeros(self.size, self.kind)
                full[at] = weight
                at, weight = slice(None), full
            self.postings[t] = at, weight

    def scores(self, component: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Inner products of a sparse query with all rows of the block."""
        exact = object in (self.kind, value.dtype)
        score = np.zeros(self.size, object if exact else np.int64)
        for t, v in zip(component.tolist(), value.tolist()):
            if t in self.postings:
                at, weight = self.postings[t]
                score[at] += weight.astype(score.dtype, copy=False) * v
        return np.array([min(max(int(s), _LEAST), _MOST) for s in score], np.int64) if exact else score


def best(score: np.ndarray, copies: np.ndarray, k: int) -> Iterator[tuple[int, int]]:
    """(place, how often) of the k highest scores, ties to the smaller place. A place counts as often as it has copies."""
    some = np.flatnonzero(copies > 0)
    if len(some) > k:
        s = score[some]
        least = np.partition(s, len(s) - k)[len(s) - k]
        above = some[s > least]
        some = np.concatenate((above, some[s == least][: k - len(above)]))
    for at in some[np.lexsort((some, -score[some].astype(object)))].tolist():
        n = min(k, int(copies[at]))
        k -= n
        if n:
            yield at, n


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [x for chunk in column.chunks for x in np.split(chunk.flatten().to_numpy(), np.cumsum(chunk.value_lengths().to_numpy())[:-1])]


def _meet(asked: pa.Table, candidates: pa.Table, k: int, scale: float) -> Iterator[tuple[int, int | None, int, int]]:
    """(query's place, vec_id, how often, score) of a block's best for each query."""
    candidates = candidates.sort_by([("id", "ascending"), ("h1", "ascending"), ("h2", "ascending")])  # null ids are last
    keys = list(zip(*(candidates[c].to_pylist() for c in _KEY)))
    place = {key: at for at, key in enumerate(keys)}
    copies = candidates["copies"].to_numpy()
    block = Block(_arrays(candidates["v"]), scale)
    first, component, value = integers(_arrays(asked["v"]), scale)
    for q, key in enumerate(zip(*(asked[c].to_pylist() for c in _KEY))):
        others = copies
        if key in place:
            others = copies.copy()
            others[place[key]] -= 1
        score = block.scores(component[first[q] : first[q + 1]], value[first[q] : first[q + 1]])
        for at, n in best(score, others, k):
            yield q, keys[at][0], n, int(score[at])


def exact_top_k(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", k: int = 5, scale: float = 256.0, every: int = 50, block: int = 16_384) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each row whose id is divisible by `every`."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL")
    sound = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    known = sound.groupBy("id", "v").agg(F.count("*").alias("copies")).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(13), "v")})
    known = stage(known)
    asking = known.where(F.col("id") % every == 0)
    parts, groups = (max(1, math.ceil(df.count() / block)) for df in (known, asking))
    deal = F.xxhash64("h1", "id", "h2")
    among = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = known.select("*", F.pmod(deal, F.lit(parts)).cast("int").alias("part"), among(groups).alias("group"))
    queries = asking.select("*", F.pmod(deal, F.lit(groups)).cast("int").alias("group"), among(parts).alias("part"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = list(_meet(left, right, k, scale)) if left.num_rows and right.num_rows else []
        q, ids, times, score = (pa.array([x[i] for x in found], pa.int64()) for i in range(4))
        own = left.select([*_KEY, "copies"]).take(q)
        return own.append_column("vec_id", ids).append_column("times", times).append_column("score", score)

    met = queries.groupBy("part", "group").cogroup(candidates.groupBy("part", "group"))
    found = met.applyInArrow(run, "id long, h1 long, h2 long, copies long, vec_id long, times long, score long")
    best_first = Window.partitionBy(*_KEY).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    few = found.withColumn("n", F.row_number().over(best_first)).where(F.col("n") <= k)  # k rows of each block at most reach the shuffle
    before = F.sum("times").over(best_first.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("times")
    ranks = F.sequence(F.col("before") + 1, F.least(F.col("before") + F.col("times"), F.lit(k).cast("long")))
    ranked = few.withColumn("before", before).where(F.col("before") < k).withColumn("rank", F.explode(ranks)).withColumn("rank", F.col("rank").cast("int"))
    each = F.when(F.col("copies") > 1, F.sequence(F.lit(1).cast("long"), F.col("copies"))).otherwise(F.array(F.lit(1).cast("long")))
    return ranked.select("id", "rank", "vec_id", "score", F.explode(each)).select(F.col("id").alias("query_id"), "rank", "vec_id", "score")
