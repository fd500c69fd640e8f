"""Operator 11: phrases of two to four words that belong together, by Toivonen's mining.

A sample of the documents proposes phrases. One full pass counts exactly, over all
texts, the proposed phrases and their negative border: what isn't proposed while
its parts (without the first and without the last word) are. Single words have
no parts, so all are counted. A frequent phrase on the border means that longer
ones may have been left out; then a further pass counts what newly stands on frequent parts, and
takes what it counts for parts too, until no frequent phrase is left whose
extensions weren't counted. So the sample decides what is counted when, and no result.

Defined results: a null language is `und`, and so is the language named so; a null
text is empty; each row is one document, also where rows or ids repeat; texts
count whole: long ones are cut between pieces, over which no phrase reaches; a
language without frequent phrases has no row; an empty table gives an empty
table. Only the two named columns are read, so others may have any name.

In tasks a slice of text is a number a word, and phrases are counted within the
slice before they are shuffled, as hashes of their words; a word's hash is 64
bits, and the pass is made again with another seed if two words share one. Which phrases
are proposed travels as bits at the places of their hashes, `filter_bits` at
most, so its size doesn't follow the corpus; two phrases at one place, or a full filter, make
the pass count more, never less.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER_BYTES, mix64, slices, small_batches, stage

LONGEST = 4
W = [f"w{i}" for i in range(1, LONGEST + 1)]
_PIECE = b".,;:!?\n\x0b\x0c\r"
_PIECE_BYTES, _WORD_BYTES = np.zeros(256, bool), np.ones(256, bool)
_PIECE_BYTES[list(_PIECE)] = True
_WORD_BYTES[list(_PIECE + b" \t")] = False
_piece = re.compile(rb"[.,;:!?\n\x0b\x0c\r]")
_SLICE = 5 << 20


def place(words: np.ndarray, bits: int) -> np.ndarray:
    """The place of each phrase, a row of word hashes with 0 after its end, among 2**bits."""
    h = np.zeros(len(words), np.uint64)
    for j in range(words.shape[1]):
        h = mix64(h ^ words[:, j], j + 1)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


class Filter:
    """Bits at the places of phrases: all phrases that were put in are members, and few others."""

    def __init__(self, chunks: dict[int, bytes], bits: int):
        self.bits = bits
        size = (1 << min(bits, 20)) // 8
        self.data = np.frombuffer(b"".join(chunks.get(k, bytes(size)) for k in range(max(1, 1 << max(0, bits - 20)))), np.uint8)

    def member(self, words: np.ndarray) -> np.ndarray:
        at = place(words, self.bits)
        return (self.data[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def make_filter(phrases: DataFrame, bits: int) -> Filter:
    """The filter of phrases (w1 to w4), with 32 bits for each but no more than 2**bits. Only its bits, never the phrases, reach the driver."""
    bits = max(13, min(bits, (32 * phrases.count()).bit_length()))

    def places(batches):
        for b in batches:
            at = place(_matrix(b), bits)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 20, pa.int64()), pa.array(at & ((1 << 20) - 1), pa.int64())], names=["chunk", "at"])

    def chunk(key: tuple[pa.Scalar, ...], batches: pa.Table) -> pa.Table:
        field = np.zeros(1 << min(bits, 20), bool)
        field[batches["at"].to_numpy()] = True
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int64()), "data": pa.array([np.packbits(field, bitorder="little").tobytes()], pa.binary())})

    got = phrases.select(*W).mapInArrow(places, "chunk long, at long").distinct().groupBy("chunk").applyInArrow(chunk, "chunk long, data binary")
    return Filter({r[0]: bytes(r[1]) for r in got.toLocalIterator()}, bits)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in W], axis=1).view(np.uint64)


def _number(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    d = values.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def _blobs(batches, size: int = _SLICE) -> Iterator[list[tuple[str, bytes]]]:
    """Lists of (lang, bytes) of about `size` bytes in all; a longer text is cut after a piece."""
    have, n = [], 0
    for b in batches:
        for some in slices(b, "text"):
            for lang, text in zip(some.column("lang").to_pylist(), some.column("text").to_pylist()):
                at = 0
                while at < len(text):
                    end = len(text)
                    if end - at > size:
                        m = _piece.search(text, at + size)
                        end = m.end() if m else end
                    have.append((lang, text[at:end]))
                    n, at = n + end - at, end
                    if n >= size:
                        yield have
                        have, n = [], 0
    if have:
        yield have


class Slice:
    """Some texts as numbers: `word` of each place, `piece` of each place, and for each number its language, word and hash."""

    def __init__(self, rows: list[tuple[str, bytes]], seed: int):
        data = LOWER_BYTES[np.frombuffer(b"\n".join(t for _, t in rows), np.uint8)]
        word = _WORD_BYTES[data]
        starts = np.flatnonzero(word & ~np.append(False, word[:-1])).astype(np.int32)
        self.piece = np.cumsum(_PIECE_BYTES[data], dtype=np.int32)[starts]
        sizes = np.append(np.cumsum(word, dtype=np.int32)[starts] - 1, np.int32(word.sum()))  # where each word begins if only words stood there
        bare, texts = _number(pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(sizes.astype(np.int32)), pa.py_buffer(data[word])]))
        del data, word, sizes
        first = np.cumsum([0] + [len(t) + 1 for _, t in rows])
        lang, langs = _number(pa.array([x for x, _ in rows], pa.string()))
        key = lang[np.searchsorted(first, starts, "right") - 1] * len(texts) + bare
        word, keys = _number(pa.array(key, pa.int64()))
        self.word, keys = word.astype(np.int32), keys.to_numpy()
        del word, key, bare, starts
        self.lang = langs.take(pa.array(keys // max(1, len(texts))))
        self.text = texts.take(pa.array(keys % max(1, len(texts)))).cast(pa.string())
        seeds = [xxhash.xxh3_64_intdigest(x.encode(), seed) for x in langs.to_pylist()]
        every = texts.to_pylist()
        self.hash = np.array([xxhash.xxh3_64_intdigest(every[k % len(every)], seeds[k // len(every)]) or 1 for k in keys.tolist()], np.uint64)

    def phrases(self, proposed: Filter | None, known: Filter | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, rows of word numbers, counts) of what a pass counts.

        The first pass: what has both parts counted and in `proposed`; without it, all.
        The pass after it: what has both parts in `known` or newly counted, and wasn't counted by the first.
        """
        n = len(self.word)
        # number of the phrase that begins at each place, -1: none; of each phrase its word numbers, and whether the first pass and this one count it
        at, rows = self.word, np.arange(len(self.hash), dtype=np.int32)[:, None]
        before, now = np.ones(len(rows), bool), np.full(len(rows), known is None)
        if known is None:
            yield 1, rows, np.bincount(at, minlength=len(rows))
        for k in range(2, LONGEST + 1):
            if n < k or not len(rows):
                return
            hashes = np.zeros((len(rows), LONGEST), np.uint64)
            hashes[:, : k - 1] = self.hash[rows]
            part = before & proposed.member(hashes) if proposed else before
            if known is not None:
                ahead = known.member(hashes) | now
            del hashes
            start = np.flatnonzero((self.piece[: n - k + 1] == self.piece[k - 1 :]) & (at[: n - k + 1] >= 0) & (at[1 : n - k + 2] >= 0))
            left, right = at[start], at[start + 1]
            first = part[left] & part[right]
            if known is None:
                start, first = start[first], first[first]
                fresh = first
            else:
                both = ahead[left] & ahead[right]
                start, first = start[both], first[both]
                fresh = ~first
            del left, right
            number, key = _number(pa.array(at[start].astype(np.int64) << 32 | self.word[start + k - 1], pa.int64()))
            key = key.to_numpy()
            rows = np.concatenate((rows[key >> 32], (key & 0xFFFFFFFF).astype(np.int32)[:, None]), axis=1)
            del key
            at = np.full(n, -1, np.int32)
            at[start] = number
            before, now = np.zeros(len(rows), bool), np.zeros(len(rows), bool)
            before[number], now[number] = first, fresh
            some = np.flatnonzero(now)
            yield k, rows[some], np.bincount(number, minlength=len(rows))[some]


def _count(texts: DataFrame, seed: int, proposed=None, known=None, words: bool = True) -> DataFrame:
    """(w1 to w4, lang, word, n): exact counts; lang and word stand with single words only, and only if asked for."""

    def run(batches):
        for rows in _blobs(batches):
            s = Slice(rows, seed)
            for k, found, n in s.phrases(proposed and proposed.value, known and known.value):
                for a in range(0, len(found), 200_000):
                    part = found[a : a + 200_000]
                    hashes = np.zeros((len(part), LONGEST), np.uint64)
                    hashes[:, :k] = s.hash[part]
                    single = k == 1 and words
                    own = pa.array(part[:, 0]) if single else None
                    none = pa.nulls(len(part), pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(hashes[:, j].view(np.int64)) for j in range(LONGEST)), s.lang.take(own) if single else none, s.text.take(own) if single else none, pa.array(n[a : a + 200_000], pa.int64())],
                        names=[*W, "lang", "word", "n"],
                    )

    counted = texts.mapInArrow(run, ", ".join(f"{w} long" for w in W) + ", lang string, word string, n long")
    return counted.groupBy(*W, "lang", "word").agg(F.sum("n").alias("n"))


def frequent_phrases(docs: DataFrame, *, text: str = "text", lang: str = "lang", support: int = 30, sample: int = 16, seed: int = 11, filter_bits: int = 28) -> tuple[DataFrame, DataFrame]:
    """(w1, lang, word, n) of all words, and (w1 to w4, n) of all phrases of 1 to 4 words found `support` times or more.

    One in `sample` documents, by a hash, proposes; its threshold is lower than
    its share of `support`, so that few frequent phrases are left to the border.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("text")).where(F.length("text") > 0)
    send = docs.sparkSession.sparkContext.broadcast
    for at in range(seed, seed + 16):
        some = texts.where(F.pmod(F.xxhash64("text", F.lit(at)), F.lit(sample)) == 0)
        proposed = stage(_count(some, at, words=False).where(F.col("n") >= max(2, support // (2 * sample))).select(*W))
        sent = send(make_filter(proposed, filter_bits))
        counted = stage(_count(texts, at, sent).where((F.col("n") >= support) | (F.col("w2") == 0)))
        words = counted.where("w2 = 0").select("w1", "lang", "word", "n")
        if words.groupBy("w1").agg(F.count("*").alias("k")).where("k > 1").isEmpty():
            break
    else:
        raise RuntimeError("words share a hash under every seed")
    frequent = counted.where(F.col("n") >= support).select(*W, "n")
    if not _outside(frequent, sent).isEmpty():
        # what this pass counts it takes for parts itself, so no frequent phrase can be missing after it
        more = _count(texts, at, sent, send(make_filter(frequent, filter_bits)), words=False)
        frequent = frequent.unionByName(stage(more.where(F.col("n") >= support).select(*W, "n")))
    return words, frequent


def _outside(frequent: DataFrame, sent) -> DataFrame:
    """Frequent phrases, shorter than the longest, that the filter doesn't have: the border has failed at these."""

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(~sent.value.member(_matrix(b))))

    return frequent.where("w4 = 0").select(*W).mapInArrow(run, ", ".join(f"{w} long" for w in W))


def _parts(*rows: tuple[int, ...]) -> Column:
    """An array of phrases of up to three of the words w1 to w4, by place; 0 where there is none."""
    return F.array(*[F.struct(*[(F.col(f"w{i}") if i else F.lit(0).cast("long")).alias(f"p{j}") for j, i in enumerate(r, 1)]) for r in rows])


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", support: int = 30, inside_percent: int = 80, top: int = 2000, sample: int = 16, filter_bits: int = 28) -> DataFrame:
    """The `top` phrases of each language: lang, rank, phrase, a, l, r, n, score; see the module and `frequent_phrases`.

    A phrase scores floor(2000000 a / (l + r)) at its worst cut into two parts
    found l and r times; ties go to the first cut. Phrases go that stand in a longer
    frequent one with `inside_percent` of their count. Order: score, then a,
    both descending, then the phrase by its bytes.
    """
    words, frequent = frequent_phrases(docs, text=text, lang=lang, support=support, sample=sample, filter_bits=filter_bits)
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    found = frequent.where("w2 <> 0").withColumnRenamed("n", "a")
    parts = frequent.where("w4 = 0").select(F.struct(*[F.col(f"w{j}").alias(f"p{j}") for j in (1, 2, 3)]).alias("part"), "n")
    cuts = found.withColumn("cut", F.explode(F.arrays_zip(_parts((1, 0, 0), (1, 2, 0), (1, 2, 3)).alias("left"), _parts((2, 3, 4), (3, 4, 0), (4, 0, 0)).alias("right"), F.array(F.lit(1), F.lit(2), F.lit(3)).alias("k"))))
    cuts = cuts.select(*W, "a", "cut.*").where("right.p1 <> 0")
    cuts = cuts.join(parts.select(F.col("part").alias("left"), F.col("n").alias("l")), "left").join(parts.select(F.col("part").alias("right"), F.col("n").alias("r")), "right")
    cuts = cuts.withColumn("whole", F.col("l") + F.col("r")).withColumn("score", F.call_function("div", exact("a") * 2_000_000, exact("whole")))
    worst = cuts.groupBy(*W, "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select(*W, "a", "x.score", "x.l", "x.r")

    longer = frequent.where("w3 <> 0").select("n", F.explode(F.concat(_parts((1, 2, 0), (2, 3, 0)), F.when(F.col("w4") != 0, _parts((3, 4, 0), (1, 2, 3), (2, 3, 4))).otherwise(F.slice(_parts((1, 2, 0)), 1, 0)))).alias("part"))
    longer = longer.groupBy("part").agg(F.max("n").alias("longer"))
    worst = worst.withColumn("part", F.when(F.col("w4") == 0, F.struct(*[F.col(f"w{j}").alias(f"p{j}") for j in (1, 2, 3)])))
    kept = worst.join(longer, "part", "left").where(F.col("longer").isNull() | (exact("longer") * 100 < exact("a") * inside_percent)).drop("part", "longer")

    names = words.where(F.col("n") >= support).select("w1", "lang", "word")
    kept = kept.join(names.select("w1", "lang"), "w1")
    by_score = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    first = kept.withColumn("rank", F.rank().over(by_score)).where(F.col("rank") <= top)  # ties at the end included
    own = ["lang", *W, "a", "l", "r", "score"]
    spelled = first.select(*own, F.posexplode(F.array(*W)).alias("at", "w")).where("w <> 0").join(names.select(F.col("w1").alias("w"), "word"), "w")
    spelled = spelled.groupBy(*own).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    by_all = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    ranked = spelled.withColumn("rank", F.row_number().over(by_all).cast("long")).where(F.col("rank") <= top).join(totals, "lang")
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
