"""Operator 10: benchmark decontamination.

One Aho-Corasick automaton holds all windows of the normalised benchmark
items; each document is read once and hits map back to places in its original
text. Inside the automaton a word is two characters of separate alphabets, so
windows match whole words only, of any number of distinct words.

Defined results: null and wordless texts have no words; an item of fewer words
than a window, but not none, is one window; repeated items of one id are one
item; an empty benchmark hits nothing. Items without an id take no part in
`items` but their windows hit. Rows that repeat are scanned alike; a text counts
whole, however long; an empty table gives an empty table; input columns named
as a result column are replaced, all others pass through.

The benchmark travels to the tasks with the code, so its size is checked
first: above `max_chars` it is split into parts of at most that, with an
automaton and a pass each. Documents are not shuffled while there is one part.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_clashes, stage

#: Words: runs of 0-9, a-z (after lower-casing A-Z) and all characters beyond ASCII.
_word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: The same on UTF-8 bytes: A-Z lower-cased, what parts words is a blank; all bytes of characters beyond ASCII stay.
_bytes = bytes(i if i > 127 or chr(i).isalnum() else 32 for i in range(256)).lower()
#: A word is two characters, of the first and of the second kind, so that a node of the automaton has few children and windows match whole words only.
_FIRST, _SECOND = 0x10000, 0x90000
_NONE = "\0\0"
_built: dict[int, tuple] = {}


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_bytes).split() if text else []


def build(items: list[tuple[str | None, str]], window: int) -> tuple[dict[bytes, str], ahocorasick.Automaton | None]:
    """Word -> its two characters, and the automaton whose values are (words in the window, item ids)."""
    split = [(item, words(text)) for item, text in items]
    found = dict.fromkeys(x for _, w in split for x in w)
    base = math.isqrt(len(found)) + 1
    code = {x: chr(_FIRST + k // base) + chr(_SECOND + k % base) for k, x in enumerate(found)}
    owners: dict[str, set] = defaultdict(set)
    for item, w in split:
        s = "".join([code[x] for x in w])
        for i in range(max(1, len(w) - window + 1) if w else 0):
            owners[s[2 * i : 2 * (i + window)]].add(item)
    if not owners:
        return code, None
    auto = ahocorasick.Automaton()
    for phrase, ids in owners.items():
        auto.add_word(phrase, (len(phrase) // 2, tuple(x for x in ids if x is not None)))
    auto.make_automaton()
    return code, auto


def scan(text: str | None, code: dict[bytes, str], auto) -> tuple[int, list[tuple[int, int]], set]:
    """Number of words, hit runs of words [from, to), and ids of the items hit."""
    w = words(text)
    if auto is None or not w:
        return len(w), [], set()
    runs: list[list[int]] = []
    found: set = set()
    get = code.get
    for end, (n, ids) in auto.iter("".join([get(x, _NONE) for x in w])):
        found.update(ids)
        b = end // 2 + 1
        a = b - n
        while runs and a <= runs[-1][1]:
            last = runs.pop()
            a, b = min(a, last[0]), max(b, last[1])
        runs.append([a, b])
    return len(w), [tuple(r) for r in runs], found


SCHEMA = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()),
    T.StructField("contaminated", T.BooleanType()), T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
])
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]


def _parts(benchmark: DataFrame, item_id: str, text: str, max_chars: int) -> Iterator[list[tuple[str | None, str]]]:
    """The benchmark, in lists of at most max_chars characters (or one item)."""
    part, size = [], 0
    for r in benchmark.select(F.col(item_id).cast("string"), F.col(text)).where(F.col(text).isNotNull()).distinct().toLocalIterator():
        if part and size + len(r[1]) > max_chars:
            yield part
            part, size = [], 0
        part.append((r[0], r[1]))
        size += len(r[1])
    yield part


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, max_chars: int = 32_000_000) -> DataFrame:
    """docs with n_words, n_hit (words inside a window), n_items, items_sha256, contaminated, items (ids, sorted) and spans (code points [start, end) of the original text)."""
    out = drop_clashes(docs, SCHEMA.names)
    for k, part in enumerate(_parts(benchmark, item_id, item_text, max_chars)):
        # a part is a job of its own, so that no worker holds more than one part's automaton
        out = _pass(stage(out) if k else out, part, text, window, merge=k > 0)
    return out


def _pass(docs: DataFrame, items: list, text: str, window: int, merge: bool) -> DataFrame:
    key = hash((tuple(items), window))
    keep = [c for c in docs.columns if c not in SCHEMA.names]

    def run(batches):
        if key not in _built:
            _built.clear()
            _built[key] = build(items, window)
        code, auto = _built[key]
        for batch in batches:
            rows: list[list] = [[] for _ in SCHEMA.names]
            was = zip(*(batch.column(c).to_pylist() for c in ("spans", "items"))) if merge else ((None, None) for _ in range(batch.num_rows))
            for s, (spans, old) in zip(batch.column(text).to_pylist(), was):
                n, runs, found = scan(s, code, auto)
                places = []
                if runs or spans:
                    at = [(m.start(), m.end()) for m in _word.finditer(s.encode().lower().decode())]
                    hit = {i for a, b in runs for i in range(a, b)}
                    for x in spans or ():
                        i = bisect_left(at, (x["start"], 0))
                        while i < len(at) and at[i][1] <= x["end"]:
                            hit.add(i)
                            i += 1
                    for i in sorted(hit):
                        if places and places[-1][2] == i - 1:
                            places[-1][1:] = [at[i][1], i]
                        else:
                            places.append([at[i][0], at[i][1], i])
                    n_hit = len(hit)
                else:
                    n_hit = 0
                ids = sorted(found | set(old or ()))
                for c, v in zip(rows, (n, n_hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), n_hit > 0, ids, [{"start": a, "end": b} for a, b, _ in places])):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(c, t) for c, t in zip(rows, _TYPES)], names=keep + SCHEMA.names)

    return docs.mapInArrow(run, T.StructType([docs.schema[c] for c in keep] + SCHEMA.fields))
