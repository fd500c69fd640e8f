"""Operators 11 to 13 against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import math
import random
import re
from collections import Counter
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest

from tallyroom.llm import collocations, exact_topk, filter_audit

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, n long, rank int, score string, word string, part int"


def rows_of(texts):
    return [(i if i % 17 else None, t, [None, "en", "de", "und"][i % 4], 1, 2, "s", "w", 3) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)] + ["Tür", "éa", "A\x00b"]
    common = ["new york city hall", "in spite of", "aa aa aa aa aa"]
    some = []
    for _ in range(150):
        words = rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(len(vocabulary))], k=rng.randint(1, 60))
        for _ in range(rng.randint(0, 3)):
            words.insert(rng.randint(0, len(words)), rng.choice(common))
        some.append("".join(w + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "!x"]) for w in words))
    some += [None, "", " \t", "...", some[3], some[3], "Same TEXT", "same text", "long " * 30_000 + "end of it", "A# b$ c", "X" * 50]
    return [*some, *some[:4]]


# 11 -----------------------------------------------------------------------


def mined(rows, support, inside, top):
    found = {}
    for _, t, lang, *_ in rows:
        count = found.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3, 4):
                count.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in found.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        frequent = {p: a for p, a in f.items() if len(p) > 1 and a >= support}
        kept = []
        for p, a in frequent.items():
            if any(len(q) > len(p) and 100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in frequent.items()):
                continue
            score, k = min((math.floor(Fraction(2_000_000 * a, f[p[:k]] + f[p[k:]])), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for r, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, r, p.decode(), -a, left, right, n, -s))
    return sorted(out)


@pytest.mark.parametrize("support,inside,top,sample", [(8, 80, 2000, 4), (3, 60, 15, 4), (20, 80, 2000, 1), (5, 80, 40, 1_000_000)])
def test_collocations(spark, texts, monkeypatch, support, inside, top, sample):
    monkeypatch.setattr(collocations, "_SLICE", 3000)
    rows = rows_of(texts)
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = collocations.collocations(docs, support=support, inside_percent=inside, top=top, sample=sample)
    assert sorted(map(tuple, got.collect())) == mined(rows, support, inside, top)


def test_no_sample_finds_all_and_bits_change_nothing(spark, texts):
    """A filter of so few bits that nearly all phrases are members, and one of a bit a phrase, give the same rows."""
    rows = rows_of(texts)
    docs = spark.createDataFrame(rows, DOCS)
    got = collocations.collocations(docs, support=6, filter_bits=13)
    assert sorted(map(tuple, got.collect())) == mined(rows, 6, 80, 2000)


def test_words_that_share_a_hash_are_told_apart(spark, monkeypatch):
    real = collocations.xxhash.xxh3_64_intdigest
    monkeypatch.setattr(collocations.xxhash, "xxh3_64_intdigest", lambda x, seed=0: 77 if x in (b"one", b"two") else real(x, seed))
    s = collocations.Slice([("en", b"one two three")], 1)
    assert s.hash[0] == s.hash[1] != s.hash[2]


def test_score_beyond_64_bits(spark):
    a = 9 * 10**13
    x = spark.createDataFrame([(a, 2 * a)], "a long, whole long").selectExpr("cast(a as decimal(20,0)) * 2000000 div cast(whole as decimal(20,0)) AS s").first()[0]
    assert x == 2_000_000 * a // (2 * a) and 2_000_000 * a > 2**63


def test_collocations_empty(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).collect() == []
    assert collocations.collocations(spark.createDataFrame(rows_of([None, "", "a b"]), DOCS)).collect() == []


# 12 -----------------------------------------------------------------------


def audited(rows, labels):
    ids = {}
    for d, t, *_ in rows:
        if d is not None:
            ids[t or ""] = min(ids.get(t or "", d), d)
    good = {d for d, q, _ in labels if q == 1}
    bad = {d for d, _, x in labels if x == 1}
    masks = {}
    for d, t, lang, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and ids[t] < d}
        masks.setdefault(lang or "", []).append(({f for f in fails if fails[f]}, d is not None and d in good, d is not None and d in bad))
    out = []
    for part, docs in masks.items():
        removed_at = {}
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                gone = [x for x in docs if f in x[0] and not x[0] & set(order[: step - 1])]
                removed_at[order, step] = gone
        shapley = {f: sum(len(g) for (o, s), g in removed_at.items() if o[s - 1] == f) for f in "ABCDE"}
        for (order, step), gone in removed_at.items():
            f = order[step - 1]
            kept = sum(not x[0] & set(order[:step]) for x in docs)
            out.append((part, "".join(order), step, kept, len(gone), sum(f in x[0] for x in docs) - len(gone), sum(x[0] == {f} for x in docs), sum(x[1] for x in gone), sum(x[2] for x in gone), shapley[f]))
    return sorted(out)


def test_filter_audit(spark, texts):
    rows = rows_of(texts + [" ".join(f"v{i}" for i in range(250))] * 3)
    labels = [(i, i % 3 == 0, i % 5 == 0) for i in range(0, 150, 2)] + [(4, 1, None), (4, 0, 1), (None, 1, 1), (6, None, None)]
    labels = [(d, None if q is None else int(q), None if x is None else int(x)) for d, q, x in labels]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    got = filter_audit.filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got.columns == filter_audit.RESULT
    assert sorted(map(tuple, got.collect())) == audited(rows, labels)


def test_filter_audit_empty(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(docs, labels).collect() == []
    one = filter_audit.filter_audit(spark.createDataFrame([(None, None, None, 1, 1, "", "", 1)], DOCS), labels).collect()
    assert len(one) == 600 and {r["part"] for r in one} == {""}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 1000, 4099])
def test_positional_popcount(n):
    words = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
    assert filter_audit.positional_popcount(words).tolist() == [int((words >> s & 1).sum()) for s in range(32)]


# 13 -----------------------------------------------------------------------


def searched(rows, every, k=5, scale=256):
    sound = [(i, [math.floor(Fraction(x) * scale) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, v) in enumerate(sound):
        if q is not None and q % every == 0:
            scores = [(-min(max(sum(x * y for x, y in zip(v, w)), -(2**63)), 2**63 - 1), i is None, i or 0) for b, (i, w) in enumerate(sound) if a != b]
            out += [(q, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [7, 64, 16_384])
def test_top_k(spark, block):
    rng = np.random.default_rng(3)
    vectors = [rng.normal(size=8).round(2).tolist() for _ in range(60)] + [[0.25] * 8] * 6 + [[0.0] * 8, [], [1.0], [-1.0] * 9]
    vectors += [[1e30] * 8, [-3e25, 5.0], [1e300, 1.0], [0.001] * 3, None, [1.0, None], [math.nan], [math.inf, 1.0]]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(None, vectors[0]), (None, vectors[0]), (10, vectors[10]), (10, vectors[10]), (10, [0.5] * 8), (-10, vectors[1])]
    table = spark.createDataFrame([(i, v, "x", 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, label string, rank int, score double").repartition(4)
    got = exact_topk.exact_top_k(table, every=5, block=block)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == searched(rows, 5)


def test_top_k_few_and_empty(spark):
    kind = "vec_id long, embedding array<float>"
    assert exact_topk.exact_top_k(spark.createDataFrame([], kind)).collect() == []
    assert exact_topk.exact_top_k(spark.createDataFrame([(0, [1.0])], kind)).collect() == []
    assert sorted(map(tuple, exact_topk.exact_top_k(spark.createDataFrame([(0, [1.0]), (50, [0.5]), (7, [-0.001])], kind)).collect())) == [(0, 1, 50, 32768), (0, 2, 7, -256), (50, 1, 0, 32768), (50, 2, 7, -128)]


def test_long_vector(spark):
    long = np.zeros(70_000)
    long[[1, 69_999]] = 0.5, 2.0
    got = exact_topk.exact_top_k(spark.createDataFrame([(0, long.tolist()), (1, long.tolist())], "vec_id long, embedding array<double>"))
    assert list(map(tuple, got.collect())) == [(0, 1, 1, 128 * 128 + 512 * 512)]
