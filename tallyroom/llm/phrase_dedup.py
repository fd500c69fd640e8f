"""Operator 3: repeated passages, by repeated-phrase automata.

A window is `width` consecutive words. Each window names the smallest hash
among its runs of `gram` words; equal windows name equal grams, so a gram seen
in one document only rules out all windows that name it. What is left is cut
into segments, the windows that name one gram, and dealt out by the gram, so
each shard holds every occurrence of its windows.

A shard takes whole grams until it has `shard` segments (the automaton looks
through the words that can follow one after the other, so many small ones are
faster than a large one): windows that start in
two documents or more are confirmed word for word, they are compiled into an
Aho-Corasick automaton whose values are the smallest doc_id, and all segments
stream through it. A hit from a smaller doc_id marks its words. Inside an
automaton a word is one character, and every shard has an alphabet of its own.
A gram with more than `piece` segments goes to no shard: its windows
meet word for word in an aggregation, combined before the shuffle, and a join,
so a shard's windows and words are bounded by a shard and a piece.

Defined results: words are runs of characters other than ASCII blanks,
unchanged; null has none; windows are judged on the input; rows with equal
doc_id do not remove each other's words; rows without doc_id keep all their
words and remove none; kept words are joined by one space; a text of any length
counts whole; an empty table gives an empty table; columns other than the id
and the text do not matter, whatever their names.

Shuffles: the grams' hashes twice, once pre-aggregated and once to meet the
recurring ones; the texts once, compressed, all joins by document use it; the
segments of recurring grams, and the windows of very common ones.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, mix64, slices, small_batches, stage

_BASE = 0x10000
_CHARS = 0x110000 - _BASE


def named_grams(w: Words, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that name one gram: row, first and last window (numbers of their first words in `w`) and the gram's hash."""
    n = len(w) - width + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return empty, empty, empty, empty
    hashes = w.hashes
    g = np.zeros(len(w) - gram + 1, np.uint64)
    for j in range(gram):
        g = g * np.uint64(0xD6E8FEB86659FD93) + hashes[j : j + len(g)]
    g ^= g >> np.uint64(31)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(29)
    best, at = g[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, width - gram + 1):
        new = g[j : j + n]
        less = new < best
        best[less] = new[less]
        at[less] = j
    at += np.arange(n)
    inside = np.flatnonzero(w.doc[:n] == w.doc[width - 1 :])
    at, best, doc = at[inside], best[inside], w.doc[inside]
    new = np.ones(len(inside), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(inside)) - 1
    return doc[first], inside[first], inside[last], best[first].view(np.int64)


def _gram_rows(batches, width: int, gram: int):
    """(hash, doc_id, tag): the tag is the row's tag and the place of the first window in the row."""
    for batch in batches:
        for part in slices(batch, "text"):
            w = Words(part.column("text"))
            row, first, _, h = named_grams(w, width, gram)
            tag = (part.column("tag").to_numpy()[row] << 32) | (first - w.first[row])
            yield pa.RecordBatch.from_arrays([pa.array(h), part.column("doc_id").take(pa.array(row)), pa.array(tag)], names=["h", "doc_id", "at"])


def _pack(batches, columns: list[str]):
    """Texts as zstd frames, so that less is shuffled."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        for part in slices(batch, "text"):
            frames = [None if t is None else pack(t.encode()) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(frames, pa.binary())], names=[*columns, "frame"])


def _unpacked(batch: pa.RecordBatch, max_bytes: int = 1 << 18):
    """Runs of rows whose frames have about max_bytes bytes, with their texts."""
    unpack = zstandard.ZstdDecompressor().decompress
    for part in slices(batch, "frame", max_bytes):
        yield part, pa.array([None if f is None else unpack(f).decode() for f in part.column("frame").to_pylist()], pa.large_string())


def _segments(batches, width: int, gram: int):
    """(hash, doc_id, tag and place, words) of the runs whose place is in `places`."""
    for batch in batches:
        for part, text in _unpacked(batch):
            w = Words(text)
            row, first, last, h = named_grams(w, width, gram)
            places = part.column("places")
            counts = np.diff(np.frombuffer(places.buffers()[1], np.int32)[places.offset : places.offset + len(places) + 1])
            wanted = (np.repeat(np.arange(part.num_rows), counts) << 32) | (places.flatten().to_numpy() & 0xFFFFFFFF)
            hit = np.isin((row << 32) | (first - w.first[row]), wanted)
            row, first, last, h = row[hit], first[hit], last[hit], h[hit]
            a, b = w.starts[first], w.ends[last + width - 1]
            size = b - a
            off = np.concatenate(([0], np.cumsum(size)))
            data = w.data[np.repeat(a - off[:-1], size) + np.arange(off[-1])]
            text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(a), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(data)])
            tag = (part.column("tag").to_numpy()[row] << 32) | (first - w.first[row])
            yield pa.RecordBatch.from_arrays([pa.array(h), part.column("doc_id").take(pa.array(row)), pa.array(tag), text.cast(pa.binary())], names=["h", "doc_id", "at", "words"])


def _hot_windows(batches, width: int, gram: int):
    """(doc_id, tag, place, words joined by one space) of each window of the runs whose place is in `places`."""
    for batch in _segments(batches, width, gram):
        for doc, at, text in zip(batch.column("doc_id").to_pylist(), batch.column("at").to_pylist(), batch.column("words").to_pylist()):
            words = text.split()
            n = len(words) - width + 1
            place = (at & 0xFFFFFFFF) + np.arange(n)
            windows = [b" ".join(words[i : i + width]) for i in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, doc)), pa.array(np.full(n, at >> 32)), pa.array(place), pa.array(windows, pa.binary())], names=["doc_id", "tag", "start", "words"])


def coded(w: Words) -> np.ndarray:
    """A number for each word, equal for equal words."""
    inside = np.zeros(len(w.data) + 1, np.int8)
    inside[w.starts] += 1
    inside[w.ends] -= 1  # where a row's first word follows another row's last one, both hold
    data = w.data[np.cumsum(inside[:-1], dtype=np.int8) > 0]
    ends = np.cumsum(np.append(0, w.ends - w.starts))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(w), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode().indices.to_numpy()


def recurring(codes: np.ndarray, at: np.ndarray, docs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, smallest document) of one window of each kind that starts in two documents or more. at: places of windows of n codes, docs: their documents."""
    if not len(at):
        return at, docs
    h = np.zeros(len(codes) - n + 1, np.uint64)
    for j in range(n):
        h = mix64(h * np.uint64(0xD6E8FEB86659FD93) + codes[j : j + len(h)].astype(np.uint64))
    order = np.argsort(h[at], kind="stable")
    new = np.append(True, np.diff(h[at][order]) != 0)
    head = at[order][np.flatnonzero(new)[np.cumsum(new) - 1]]
    if any((codes[at[order] + j] != codes[head + j]).any() for j in range(n)):  # equal hashes of unlike windows: sort by the words
        order = np.lexsort([codes[at + j] for j in range(n)])
        new = np.append(True, np.any([np.diff(codes[at[order] + j]) != 0 for j in range(n)], 0))
    cut = np.flatnonzero(new)
    low, high = np.minimum.reduceat(docs[order], cut), np.maximum.reduceat(docs[order], cut)
    return at[order][cut][low < high], low[low < high]


def marks(texts: pa.Array, docs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, from, to): runs of words of the segments that windows of smaller documents cover."""
    w = Words(texts)
    none = np.zeros(0, np.int64)
    if len(w) < width:
        return none, none, none
    codes = coded(w)
    at = np.flatnonzero(w.doc[: len(w) - width + 1] == w.doc[width - 1 :])
    place, origin = recurring(codes, at, docs[w.doc[at]], width)
    if not len(place):
        return none, none, none
    # one string: a character a word, and one that no window holds after each segment
    codes = np.insert(codes.astype(np.int64) + _BASE + 1, w.first[1:], _BASE)
    string = codes.astype("<u4").tobytes().decode("utf-32-le")
    auto = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, p in enumerate((place + w.doc[place]).tolist()):
        auto.add_word(string[p : p + width], k)
    auto.make_automaton()
    ends, found = np.array(list(auto.iter(string)), np.int64).T
    row = np.searchsorted(w.first + np.arange(len(w.first)), ends, "right") - 1
    hit = origin[found] < docs[row]
    ends, row = ends[hit] + 1, row[hit]
    if not len(ends):
        return none, none, none
    new = np.append(True, (np.diff(ends) > width) | (np.diff(row) != 0))
    first, last = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(ends)) - 1
    row, start = row[first], w.first[row[first]] + row[first]
    return row, ends[first] - width - start, ends[last] - start


def _shards(batches, width: int, shard: int):
    """(doc_id, tag, from, to): words to remove. A shard is closed after the gram in which it reaches `shard` segments."""

    def solve(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        docs, where = rows.column("doc_id").to_numpy(), rows.column("at").to_numpy()
        texts = rows.column("words").combine_chunks().cast(pa.string())
        row, start, end = marks(texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts, docs, width)
        place = where[row] & 0xFFFFFFFF
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (docs[row], where[row] >> 32, place + start, place + end)], names=["doc_id", "tag", "start", "end"])

    held: list[pa.RecordBatch] = []
    size, step = 0, min(shard, 4096)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            held.append(batch.slice(at, step))
            size += held[-1].num_rows
            if size < shard:
                continue
            rows = pa.Table.from_batches(held)
            h = rows.column("h").to_numpy()
            tail = int(np.flatnonzero(h != h[-1])[-1] + 1) if h[0] != h[-1] else 0  # the last gram may go on
            if tail:
                yield solve(rows.slice(0, tail))
            held = rows.slice(tail).to_batches()
            size -= tail
    if held:
        yield solve(pa.Table.from_batches(held))


def _cut(batches):
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        for frame, spans in zip(batch.column("frame").to_pylist(), batch.column("spans").to_pylist()):
            words = unpack(frame).split() if frame else []
            n = len(words)
            if spans:
                out, at = [], 0
                for s in sorted(spans):
                    a, b = s >> 32, s & 0xFFFFFFFF
                    if a > at:
                        out += words[at:a]
                    at = max(at, b)
                words = out + words[at:]
            n_words.append(n)
            n_removed.append(n - len(words))
            kept.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept), pa.array([hashlib.sha256(k.encode()).hexdigest() for k in kept])], names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])


def dedup_phrases(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 13, gram: int = 4, shard: int = 1_000, piece: int = 20_000) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_text, kept_sha256."""
    small_batches(docs.sparkSession)
    piece = min(piece, (_CHARS - 1) // (2 * (2 * width - gram)))  # a shard has a character for each of its words
    base = docs.select(doc_id, text)
    if (doc_id, text, base.schema[doc_id].dataType.simpleString()) != ("doc_id", "text", "bigint"):  # a new name makes the two left sides below look different
        base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # rows that repeat an id are told apart by a hash of their text
    repeats = not base.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    keys = ["doc_id", "tag"] if repeats else ["doc_id"]
    tag = F.xxhash64("text").bitwiseAND(0x7FFFFFFF) if repeats else F.lit(0).cast("long")
    known = base.where("doc_id IS NOT NULL")
    if repeats:
        known = known.withColumn("tag", tag)
    tagged = (lambda df: df) if repeats else (lambda df: df.withColumn("tag", tag))
    grams = tagged(known).mapInArrow(lambda it: _gram_rows(it, width, gram), "h long, doc_id long, at long")
    # a document names a gram once in each task's output or more: counts of rows are at least counts of documents
    common = stage(grams.select("h").groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    hot = F.col("n") > piece
    hits = grams.join(common, "h").select("doc_id", F.shiftright("at", 32).alias("tag"), F.col("at").bitwiseAND(0xFFFFFFFF).cast("int").alias("place"), hot.alias("hot"))
    places = hits.groupBy(*keys).agg(F.collect_list(F.when(~F.col("hot"), F.col("place"))).alias("cold"), F.collect_list(F.when(F.col("hot"), F.col("place"))).alias("hot"))
    some_hot = not common.where(hot).isEmpty()
    if some_hot:  # both kinds are read
        places = stage(places)
    pack = lambda df, names: df.select(*names, "text").mapInArrow(lambda it: _pack(it, names), T.StructType([*(df.schema[c] for c in names), T.StructField("frame", T.BinaryType())]))
    packed = pack(known, keys)

    def found(kind: str) -> DataFrame:
        some = places.where(F.size(kind) > 0).select(*keys, F.col(kind).alias("places"))
        # all joins by document have the same left side, so its texts are shuffled once
        return tagged(packed.join(some, keys)).select("doc_id", "frame", "tag", F.col("places").cast("array<long>").alias("places"))

    segments = found("cold").mapInArrow(lambda it: _segments(it, width, gram), "h long, doc_id long, at long, words binary")
    segments = segments.repartition("h").sortWithinPartitions("h", "doc_id")
    marked = segments.mapInArrow(lambda it: _shards(it, width, min(shard, piece)), "doc_id long, tag long, start long, end long")
    if some_hot:
        windows = found("hot").mapInArrow(lambda it: _hot_windows(it, width, gram), "doc_id long, tag long, start long, words binary")
        origins = windows.groupBy("words").agg(F.min("doc_id").alias("origin"), F.max("doc_id").alias("last")).where("origin < last")
        again = windows.join(origins, "words").where("origin < doc_id")
        marked = marked.unionByName(again.select("doc_id", "tag", "start", (F.col("start") + width).alias("end")))
    spans = marked.groupBy(*keys).agg(F.collect_list(F.shiftleft("start", 32).bitwiseOR(F.col("end"))).alias("spans"))
    out = packed.join(spans, keys, "left").select("doc_id", "frame", "spans")
    out = out.unionByName(pack(base.where("doc_id IS NULL"), ["doc_id"]).withColumn("spans", F.lit(None).cast("array<long>")))
    return out.mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")
