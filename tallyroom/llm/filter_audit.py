"""Operator 12: how quality filters interact.

Each document gets a mask of the filters that it fails, and from it a 32-bit
word with a bit for each subset of the five filters: set where the document
survives that subset. Positional popcounts of the words, by carry-save adders,
give the survivors of every subset per part and label; each figure of each order
of the filters is a difference of such counts.

Filters (a document fails where it has): A fewer than `min_words` words; B fewer
than half as many distinct words as words; C more than 3 % of A-Z among its code
points; D one of #$%&*|; E the text of a document with a smaller doc_id.

Defined results: a null text is an empty one; a null part is the empty string;
each row is one document, also where rows or ids repeat, so equal rows have no
smaller doc_id among themselves; a row without doc_id fails nothing by E and makes
no other fail, and has no label; a document is good (toxic) if any label row of
its id says so; texts count whole, however long; an empty table gives an empty
table. Only the named columns are read, so others may have any name.

Texts are read once and not shuffled: a digest of 256 bits stands for each in
the join that finds E, which Spark can split where one text is very common.
"""

from __future__ import annotations

import hashlib
import math
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, stage

FILTERS = "ABCDE"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SIGNS = b"#$%&*|"
#: Bytes that go on with a character of UTF-8.
_CONTINUED = bytes(range(0x80, 0xC0))
RESULT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

#: Word of each mask of failed filters: bit s is set if none of the subset s is failed.
SURVIVAL = [sum(1 << s for s in range(32) if not s & failed) for failed in range(32)]


def failed_alone(text: bytes, min_words: int = 200) -> int:
    """Bits of the filters A to D that a text fails, as UTF-8; bytes.split() parts at the six blanks."""
    words = text.split()
    n = len(words)
    points = len(text.translate(None, _CONTINUED))
    shouted = len(text) - len(text.translate(None, _UPPER))
    signs = len(text.translate(None, _SIGNS)) < len(text)
    return (n < min_words) | (100 * len(set(words)) < 50 * n) << 1 | (100 * shouted > 3 * points) << 2 | signs << 3


def document_masks(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", part: str = "lang", min_words: int = 200) -> DataFrame:
    """(doc_id, part, digest, mask) of each row; mask has the filters A to D."""
    cols = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))

    def run(batches):
        for batch in batches:
            for some in slices(batch, "text"):
                texts = some.column("text").to_pylist()
                digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
                masks = pa.array([failed_alone(t, min_words) for t in texts], pa.int32())
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("part"), digests, masks], names=["doc_id", "part", "digest", "mask"])

    return cols.mapInArrow(run, T.StructType([cols.schema["doc_id"], T.StructField("part", T.StringType()), T.StructField("digest", T.BinaryType()), T.StructField("mask", T.IntegerType())]))


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit words have each of the 32 bits set.

    Carry-save adders turn three words of one weight into a word of sums of that
    weight and one of carries of the next, so all 32 places are added at once and
    only the few words left of each weight are looked at bit by bit.
    """
    total, weight = np.zeros(32, np.int64), 1
    words = words.astype(np.uint32)
    while len(words):
        carries = []
        while len(words) > 2:
            third = len(words) // 3
            a, b, c = words[:third], words[third : 2 * third], words[2 * third : 3 * third]
            half = a ^ b
            carries.append((a & b) | (half & c))
            words = np.concatenate((half ^ c, words[3 * third :]))
        for w in words.tolist():
            total += weight * np.array([w >> s & 1 for s in range(32)], np.int64)
        words = np.concatenate(carries) if carries else np.zeros(0, np.uint32)
        weight *= 2
    return total


def subset_survivors(words: DataFrame) -> DataFrame:
    """(part, label, n): words (part, label, word) to the survivors of each subset; partial counts of a slice, to be summed."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            parts = table.column("part").combine_chunks().dictionary_encode()
            labels = table.column("label").to_numpy()
            group = parts.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 4 + labels
            order = np.argsort(group, kind="stable")
            word = table.column("word").to_numpy().astype(np.int64).astype(np.uint32)[order]
            ends = np.flatnonzero(np.append(np.diff(group[order]), 1)) + 1
            keys = group[order][ends - 1]
            counts = [positional_popcount(word[a:b]) for a, b in zip(np.append(0, ends[:-1]), ends)]
            yield pa.RecordBatch.from_arrays([
                parts.dictionary.take(pa.array(keys // 4)), pa.array(keys % 4, pa.int32()), pa.array(counts, pa.list_(pa.int64())),
            ], names=["part", "label", "n"])

    return words.select("part", "label", "word").mapInArrow(run, "part string, label int, n array<long>")


def filter_audit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", part: str = "lang", quality: str = "quality", toxic: str = "toxic", min_words: int = 200) -> DataFrame:
    """A row for each part, order of the five filters and step, with RESULT; see the module for the filters and odd rows."""
    known = stage(document_masks(docs, doc_id=doc_id, text=text, part=part, min_words=min_words))
    first = known.groupBy("digest").agg(F.min("doc_id").alias("first"))
    said = labels.groupBy(F.col(doc_id).alias("doc_id")).agg(F.max((F.col(quality) == 1).cast("int")).alias("good"), F.max((F.col(toxic) == 1).cast("int")).alias("bad"))
    rows = known.join(first, "digest").join(said, "doc_id", "left")
    copied = F.coalesce((F.col("first") < F.col("doc_id")).cast("int"), F.lit(0))
    label = F.coalesce("good", F.lit(0)) + 2 * F.coalesce("bad", F.lit(0))
    word = F.element_at(F.array(*[F.lit(w) for w in SURVIVAL]), F.col("mask") + 16 * copied + 1)
    counts = subset_survivors(rows.select("part", label.alias("label"), word.alias("word")))
    return _orders(counts)


def _orders(counts: DataFrame) -> DataFrame:
    """Every order and step, from the survivors of each subset."""

    def sums(of: Column) -> Column:
        return F.array(*[F.sum(F.when(of, F.get("n", F.lit(s))).otherwise(0)) for s in range(32)])

    survive = counts.groupBy("part").agg(sums(F.lit(True)).alias("all"), sums(F.col("label") % 2 == 1).alias("good"), sums(F.col("label") >= 2).alias("toxic"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = survive.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(5))))
    so_far = "aggregate(sequence(1, step), 0, (m, i) -> m | shiftleft(1, ascii(substr(filter_order, i, 1)) - 65))"
    steps = steps.withColumns({"now": F.expr(so_far), "own": F.expr("shiftleft(1, ascii(substr(filter_order, step, 1)) - 65)")})
    steps = steps.withColumn("before", F.col("now").bitwiseXOR(F.col("own")))
    at = lambda which, subset: F.get(which, subset)
    lost = lambda which: at(which, F.col("before")) - at(which, F.col("now"))
    removed = lost("all")
    # a filter follows the set s in |s|! (4 - |s|)! of the orders
    orders_after = F.array(*[F.lit(math.factorial(k) * math.factorial(4 - k) if k < 5 else 0) for k in (s.bit_count() for s in range(32))])
    gain = lambda total, s: total + F.when(s.bitwiseAND(F.col("own")) == 0, F.get(orders_after, s) * (at("all", s) - at("all", s.bitwiseOR(F.col("own"))))).otherwise(0)
    return steps.select(
        "part", "filter_order", "step", at("all", F.col("now")).alias("kept"), removed.alias("removed"), (at("all", F.lit(0)) - at("all", F.col("own")) - removed).alias("redundant"),
        (at("all", F.lit(31).bitwiseXOR(F.col("own"))) - at("all", F.lit(31))).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"),
        F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("long"), gain).alias("shapley"),
    )
