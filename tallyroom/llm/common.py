"""Helpers shared by the training-data operators.

Python code in tasks works on Arrow batches a slice at a time (`slices`), so
memory follows the slice and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_folder

#: A word is a maximal run of characters other than these six.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z, all other characters as they are (unlike lower())."""
    return F.translate(c, UPPER, LOWER)


_mine: ContextVar[list[str] | None] = ContextVar("stages", default=None)


def stage(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, and gives the planner a known size."""
    path = new_folder(df.sparkSession, "stage")
    df.write.parquet(path)
    mine = _mine.get()
    if mine is not None:
        mine.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Bound the Arrow batches that this session hands to Python by bytes, unless it has a bound of its own.

    A batch of each task is held in the executor and in its Python worker; with
    Spark's bound of 64 MB, 10,000 documents of the check tool's table are one
    batch of 34 MB. How rows are cut into batches changes no result.
    """
    if spark.conf.get(_BATCH_BYTES, None) in (None, "67108864b", "64m", "64MB"):
        spark.conf.set(_BATCH_BYTES, size)


@contextmanager
def own_stages() -> Iterator[list[str]]:
    """The folders that `stage` writes in this block, in this thread: other runs have lists of their own."""
    mine: list[str] = []
    token = _mine.set(mine)
    try:
        yield mine
    finally:
        _mine.reset(token)


def clear_stages(spark: SparkSession, folders: list[str], keep: int = 0) -> None:
    """Remove the folders, but for the last `keep`: once a result is written, nothing reads what it was made from."""
    gone = folders[: len(folders) - keep]
    del folders[: len(folders) - keep]
    for path in gone:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def smallest(df: DataFrame, order: Column, n: int, rows: int | None = None) -> DataFrame:
    """The n rows of df with the smallest values of a 64-bit hash.

    Rows far above the n-th smallest are left out first, so that no more than a
    few times n rows, and not n from each partition, reach the last sort.
    """
    rows = df.count() if rows is None else rows
    if rows > 8 * n:
        few = df.where(order < int(-(2**63) + 2**64 * 4 * n / rows))
        if few.count() >= n:
            df = few
    return df.orderBy(order, *df.columns).limit(n)


def drop_clashes(df: DataFrame, names: list[str]) -> DataFrame:
    """Columns that an operator is about to add replace input columns of the same name."""
    return df.drop(*[c for c in df.columns if c.lower() in {n.lower() for n in names}])


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose text has about max_bytes bytes (one row at least)."""
    if not batch.num_rows:
        return
    column_ = batch.column(column)
    sizes = column_.cast(pa.large_binary() if pa.types.is_binary(column_.type) or pa.types.is_large_binary(column_.type) else pa.large_string())
    off = np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset : sizes.offset + len(sizes) + 1]
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(off, off[at] + max_bytes, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars.encode("latin-1"))] = True
    return t


BLANK_BYTES = _table(BLANKS)
#: Bytes that end an alphanumeric word: ASCII other than 0-9, A-Z and a-z. All bytes of non-ASCII characters belong to words.
PUNCT_BYTES = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
LOWER_BYTES = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)

_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 21, 1 << (n - 1).bit_length())
        out = np.ones(size, np.uint64)
        done = 1
        while done < size:  # doubling: the second half is the first times base**done
            out[done : 2 * done] = out[:done] * np.uint64(pow(base, done, 1 << 64))
            done *= 2
        _powers[base] = have = out
    return have[:n]


def mix64(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser on uint64."""
    h = h + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in order; by sorting, which is many times faster on integers than np.unique's hash table."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


class Words:
    """Words of a string column, found on its UTF-8 bytes without Python objects.

    starts, ends: byte places in `data`; doc: row of each word; first: number of
    words before each row (one more entry than rows); hashes: 64 bits a word.
    """

    def __init__(self, texts: pa.Array, separators: np.ndarray = BLANK_BYTES, lower: bool = False):
        texts = texts.cast(pa.large_string())
        n = len(texts)
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and n else np.zeros(0, np.uint8)
        self.offsets = off - off[0] if n else np.zeros(1, np.int64)
        self.data = LOWER_BYTES[data] if lower else data
        word = ~separators[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[self.offsets] = True
        before = np.concatenate(([False], word[:-1])) if len(word) else word
        after = np.concatenate((word[1:], [False])) if len(word) else word
        self.starts = np.flatnonzero(word & (~before | cut[:-1]))
        self.ends = np.flatnonzero(word & (~after | cut[1:])) + 1
        self.first = np.searchsorted(self.starts, self.offsets).astype(np.int64)
        self.doc = np.repeat(np.arange(n), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @cached_property
    def _sums(self) -> np.ndarray:
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _power(_P, len(self.data)), out=total[1:])
        return total

    def _span_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((self._sums[ends] - self._sums[starts]) * _power(_PINV, len(self.data) + 1)[starts])

    @cached_property
    def hashes(self) -> np.ndarray:
        return self._span_hashes(self.starts, self.ends)

    def prefixes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, hash) of the first `size` bytes of the longer words."""
        at = self.ends - self.starts > size
        return self.doc[at], self._span_hashes(self.starts[at], self.starts[at] + size)

    def suffixes(self, size: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, hash) of the last `size` bytes of the words chosen by the mask, less where words are shorter."""
        ends = self.ends[at]
        return self.doc[at], self._span_hashes(np.maximum(self.starts[at], ends - size), ends)

    def grams(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of k consecutive words in one row, and their hashes."""
        n = len(hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = np.zeros(n, np.uint64)
        for j in range(k):
            h = h * np.uint64(0xD6E8FEB86659FD93) + hashes[j : j + n]
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return at, mix64(h[at])


def minimise(value, x: np.ndarray, rounds: int, tolerance: float = 1e-7, memory: int = 8) -> np.ndarray:
    """The minimum of value(x) -> (loss, gradient), from x, by L-BFGS with backtracking."""
    old, grad = value(x)
    past: list[tuple] = []
    for _ in range(rounds):
        q, alphas = grad.copy(), []
        for s, t, r in reversed(past):
            alphas.append(r * (s @ q))
            q -= alphas[-1] * t
        q *= past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.abs(grad).sum() ** 0.5)
        for (s, t, r), a in zip(past, reversed(alphas)):
            q += s * (a - r * (t @ q))
        length, slope = 1.0, grad @ q
        while True:
            now, g = value(x - length * q)
            if now <= old - 1e-4 * length * slope or length < 1e-6:
                break
            length /= 2
        s, t = -length * q, g - grad
        if s @ t > 1e-12:
            past = [*past[1 - memory :], (s, t, 1 / (s @ t))]
        done = abs(old - now) <= tolerance * max(1.0, abs(old))
        x, old, grad = x + s, now, g
        if done:
            break
    return x
