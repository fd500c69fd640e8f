"""Training-data operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tallyroom.llm import attention_lm, binary_codes, common, cotrain, dart_minhash, decontaminate, graph, html_blocks, html_extract, licenses, line_dedup, mixing, phrase_dedup, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans(common.UPPER, common.LOWER)
DOCS = "doc_id long, text string, source string, lang string, n_chars long, keep string, n_lines string, size int"


def words(text):
    return WORD.findall(text or "")


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.integers(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Unlike and like texts, odd ones, a repeated row, and columns whose names clash with results."""
    rng = np.random.default_rng(1)
    texts = [sentence(rng, int(rng.integers(5, 120))) for _ in range(40)]
    passage = sentence(rng, 30)
    texts += [sentence(rng, 20) + " " + passage + "\n" + sentence(rng, 15) for _ in range(6)]
    base = sentence(rng, 100).split()
    for k in range(8):
        near = list(base)
        near[k * 7] = "changed"
        texts.append(" ".join(near))
    texts += [texts[0], "Same line\n" + texts[1], *(f"{sentence(rng, 5)}\n same LINE \n\n{sentence(rng, 4)}" for _ in range(12))]
    texts += [None, "", " \t\n", "one", "héé wörld x\u0085y \x1c z", "A " * 5000, sentence(rng, 30_000), "a\n\n\nb\n"]
    rows = [(i, t, ["b", "a", None, "é", "A"][i % 5], "en", None if t is None else len(t), "k", "l", 3) for i, t in enumerate(texts)]
    return [*rows, rows[3]]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_words_equal_regex(corpus):
    texts = pa.array([r[1] for r in corpus])
    w = common.Words(texts)
    raw = w.data.tobytes()
    got = [[] for _ in corpus]
    for d, a, b in zip(w.doc, w.starts, w.ends):
        got[d].append(raw[a:b].decode())
    assert got == [words(r[1]) for r in corpus]
    seen = {}
    for x, h in zip((x for g in got for x in g), w.hashes.tolist()):
        assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)


# 1 ------------------------------------------------------------------------


def targets(sizes, weights, total, cap):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out, free = total * sum(sizes.values()), {}, set(sizes)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if cap * sizes[s] < level * weight[s]}
        if not full:
            return out | {s: level * weight[s] for s in free}
        out |= {s: cap * sizes[s] for s in full}
        left -= sum(cap * sizes[s] for s in full)
        free -= full
    return out


@pytest.mark.parametrize("options", [{}, {"block_words": 16, "shard_words": 700}, {"share": 0.3}])
def test_mix(docs, corpus, options):
    got = mixing.mix_sources(docs, **options).collect()
    assert len(got) == len(corpus)
    sizes = Counter()
    for r in corpus:
        sizes[r[2]] += len(words(r[1]))
    want = targets(sizes, (5, 2, 1), options.get("share", 1.5), 2.0)
    taken = Counter()
    for r in got:
        assert r["size"] == len(words(r["text"])) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert r["taken"] == sum((s["end"] - s["start"]) * s["times"] for s in r["spans"])
        assert all(0 <= s["start"] < s["end"] <= r["size"] for s in r["spans"])
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(80, 0.02 * want[s])
    again = mixing.mix_sources(docs.repartition(5), **options).collect()
    assert Counter((r["doc_id"], r["taken"]) for r in got) == Counter((r["doc_id"], r["taken"]) for r in again)


def test_sainte_lague(spark):
    votes = {"a": 53.0, "b": 24.0, "c": 23.0, "d": 0.0, "e": 3.3}
    df = spark.createDataFrame([(k, v, 25) for k, v in votes.items()], "k string, v double, seats long")
    got = {r["k"]: r["quota"] for r in mixing._sainte_lague(df, [], ["k"], "v", "seats").collect()}
    quotients = sorted(((-v / (i - 0.5), k) for k, v in votes.items() for i in range(1, 60) if v))[:25]
    assert got == {k: sum(q == k for _, q in quotients) for k in votes}


def test_mix_empty(empty):
    assert mixing.mix_sources(empty).count() == 0


# 2 ------------------------------------------------------------------------


def test_crf_on_held_out_pages():
    chain = html_extract.train(html_blocks.labelled(1, 250), rounds=30)
    pages = html_blocks.labelled(99, 100)
    got = html_extract.decode(chain, [p for p, _ in pages])
    right = [a == b for labels, (_, want) in zip(got, pages) for a, b in zip(labels, want)]
    assert np.mean(right) > 0.97


def test_viterbi_and_gradient_by_brute_force():
    from itertools import product

    rng = np.random.default_rng(0)
    pages = html_blocks.labelled(5, 6)
    pages = [(p[:5], y[:5]) for p, y in pages]
    chain = html_extract.Chain()
    chain.w, chain.trans, chain.start = rng.normal(size=html_extract.DIM), rng.normal(size=(2, 2)), rng.normal(size=2)

    def score(page, y):
        e = [sum(chain.w[f] for f in fs) for fs in html_extract.features(page)]
        return chain.start[y[0]] + sum(v * s for v, s in zip(y, e)) + sum(chain.trans[a, b] for a, b in zip(y, y[1:]))

    best = [max(product((0, 1), repeat=len(p)), key=lambda y: score(p, y)) for p, _ in pages]
    assert [tuple(y) for y in html_extract.decode(chain, [p for p, _ in pages])] == best
    b = html_extract._Batch([html_extract.features(p) for p, _ in pages], [y for _, y in pages])
    loss, gw, gt, gs = html_extract.likelihood(b, chain.w, chain.trans, chain.start)
    want = sum(math.log(sum(math.exp(score(p, y)) for y in product((0, 1), repeat=len(p)))) - score(p, labels) for p, labels in pages)
    assert loss == pytest.approx(want)
    t = chain.trans.copy()
    t[0, 1] += 1e-5
    assert (html_extract.likelihood(b, chain.w, t, chain.start)[0] - loss) / 1e-5 == pytest.approx(gt[0, 1], abs=1e-3)


def test_extract_pages(spark):
    body = "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav><div class='ad'>Buy now.</div><article><h1>A &amp; B&#39;s</h1><p>First  line\n of text, long enough to be read.<p>Second &lt;b&gt; line &eacute;.</article><div id='comments'><p>Nice post!</p></div><footer>&copy; 2020 Site</footer>"
    rows = [(1, "u", f"<html><body>{body}</body></html>"), (2, "u", None), (3, "u", ""), (4, "u", "<script>x()</script><style>p{}</style>"), (1, "u", f"<html><body>{body}</body></html>"), (5, "u", body[: body.index("</article>")])]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html_extract.extract_main_text(df, made_pages=300).collect()]
    main = "A & B's\nFirst line of text, long enough to be read.\nSecond <b> line é."
    assert sorted(got) == sorted([(1, main, len(main)), (1, main, len(main)), (2, "", 0), (3, "", 0), (4, "", 0), (5, main, len(main))])
    assert html_extract.extract_main_text(df.limit(0), made_pages=30).count() == 0


# 3 ------------------------------------------------------------------------


def phrases(rows, n=13):
    first = {}
    for r in rows:
        w = words(r[1])
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            if r[0] is not None:
                first[k] = min(first.get(k, r[0]), r[0])
    out = []
    for r in rows:
        w = words(r[1])
        gone = {j for i in range(len(w) - n + 1) if r[0] is not None and first[tuple(w[i : i + n])] < r[0] for j in range(i, i + n)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("piece", [20_000, 3])
def test_phrases(spark, corpus, piece):
    texts = [r[1] for r in corpus]
    rows = [*corpus, (500, texts[40], *corpus[0][2:]), (7, texts[45], *corpus[0][2:]), (None, texts[41], *corpus[0][2:])]  # an id that repeats with another text, a null id
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    got = phrase_dedup.dedup_phrases(df, piece=piece).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=repr) == phrases(rows)


def test_phrases_unique_ids(docs, corpus, empty):
    rows = corpus[:-1]
    got = phrase_dedup.dedup_phrases(docs.dropDuplicates(["doc_id"])).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=repr) == phrases(rows)
    assert phrase_dedup.dedup_phrases(empty).count() == 0


# 4 ------------------------------------------------------------------------


def test_cotrain(spark):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(900):
        good = i % 3 != 0
        text = sentence(rng, 40) + ("" if good else " rotten" + "abcde"[i % 5] + " !!! ###")
        rows.append((i, text if i != 11 else None, "s1" if rng.random() < (0.9 if good else 0.1) else None, "en", len(text), "clash", None, 1))
        if i % 2:
            labels.append((i, int(good), 0 if i % 7 else int(not good)))
    labels += [(5, 1, 0), (5, 0, 0), (None, 1, 0), (9999, 0, 0), (13, None, 0)]
    df = spark.createDataFrame(rows, DOCS)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in cotrain.quality_scores(df, lab, meta=("source", "lang")).collect()}
    assert len(got) == 900 and np.mean([got[i]["keep"] == (i % 3 != 0) for i in range(0, 900, 2)]) > 0.97
    assert all(0 <= got[i][c] <= 1 for i in got for c in ("text_score", "meta_score", "score"))
    none = cotrain.quality_scores(df, lab.limit(0)).collect()
    assert len(none) == 900 and {r["score"] for r in none} == {0.5}
    assert cotrain.quality_scores(df.limit(0), lab).count() == 0


def test_logistic_gradient_descends():
    rng = np.random.default_rng(0)
    lists = [np.unique(rng.integers(0, 50, 8)) for _ in range(200)]
    y = np.array([float(3 in x or 7 in x) for x in lists])
    w = cotrain.fit(cotrain.Rows.of(lists, 50), y, 0.1)
    z = cotrain.Rows.of(lists, 50).times(w[:-1]) + w[-1]
    assert np.mean((z > 0) == y) == 1


def _dense(model, text, meta):
    """Scores by plain loops over sets of features."""
    out = {}
    for v, sets in (("text", text), ("meta", meta)):
        out[v] = np.array([sum(float(model.w[v][f]) for f in s) + float(model.w[v][-1]) for s in sets])
    return out


def test_cotrain_by_brute_force(spark):
    """Pseudo-label sums and scores against loops over single documents."""
    rng = np.random.default_rng(7)
    texts = [None, "", "same text", "same text", *(sentence(rng, int(rng.integers(1, 60))) for _ in range(40)), "long " * 40_000]
    rows = [(i, t, ["a", None, "b"][i % 3], "en", i, "x", "y", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[5], (None, *rows[6][1:])], DOCS)
    batch = pa.RecordBatch.from_pylist([{"text": r["text"], "source": r["source"], "lang": r["lang"]} for r in df.collect()], schema=pa.schema([("text", pa.string()), ("source", pa.string()), ("lang", pa.string())]))
    n = batch.num_rows
    got = {"text": cotrain.text_features(batch.column("text")), "meta": cotrain.meta_features(batch, ["source", "lang"])}
    sets = {v: [set(f[r == i].tolist()) for i in range(n)] for v, (r, f) in got.items()}
    for i in range(n):  # a document's features do not depend on the rows beside it
        one = cotrain.text_features(batch.column("text").slice(i, 1))
        assert set(one[1].tolist()) == sets["text"][i]
    model = cotrain.Model(0.5)
    model.w = {v: rng.normal(0, scale, cotrain.DIMS[v] + 1) for v, scale in (("text", 0.05), ("meta", 1.0))}
    model.cal, model.both = {v: np.array([1.5, 0.1]) for v in cotrain.VIEWS}, np.array([0.7, 0.4, -0.1])
    free = np.arange(n) % 4 != 0
    sums = cotrain.pseudo_sums(model, got["text"], got["meta"], n, free, 0.6)
    raw = _dense(model, sets["text"], sets["meta"])
    p = {v: 1 / (1 + np.exp(-(1.5 * z + 0.1))) for v, z in raw.items()}
    for view, other in (("text", "meta"), ("meta", "text")):
        slope, bend, count = np.zeros(cotrain.DIMS[view] + 1), np.zeros(cotrain.DIMS[view] + 1), 0
        for i in np.flatnonzero(free):
            label = 1 if p[other][i] >= 0.6 and 1 - p[view][i] < 0.6 else 0 if 1 - p[other][i] >= 0.6 and p[view][i] < 0.6 else None
            if label is not None:
                count += 1
                for f in [*sets[view][i], cotrain.DIMS[view]]:
                    slope[f] += 1 / (1 + np.exp(-raw[view][i])) - label
                    bend[f] += (len(sets[view][i]) + 1) / 4
        assert count == sums[view][2] > 0
        assert np.allclose(slope, sums[view][0]) and np.allclose(bend, sums[view][1])
    text, meta, both = model.scores(raw)
    assert np.allclose(text, p["text"]) and np.allclose(meta, p["meta"])
    assert np.allclose(both, 1 / (1 + np.exp(-(0.7 * np.clip(1.5 * raw["text"] + 0.1, -15, 15) + 0.4 * np.clip(1.5 * raw["meta"] + 0.1, -15, 15) - 0.1))))


def test_pseudo_bound_is_above_the_loss():
    rng = np.random.default_rng(9)
    lists = [np.unique(rng.integers(0, 40, 6)) for _ in range(50)]
    x, y, at = cotrain.Rows.of(lists, 40), (np.arange(50) % 2).astype(float), rng.normal(size=41)
    loss = lambda w: np.sum(np.logaddexp(0, x.times(w[:-1]) + w[-1]) - y * (x.times(w[:-1]) + w[-1]))
    g = 1 / (1 + np.exp(-(x.times(at[:-1]) + at[-1]))) - y
    size = (np.array([len(f) for f in lists]) + 1) / 4
    slope, bend = np.append(x.back(g), g.sum()), np.append(x.back(size), size.sum())
    for _ in range(50):
        step = rng.normal(size=41)
        assert loss(at + step) <= loss(at) + step @ slope + 0.5 * (step * step) @ bend + 1e-9


# 5 ------------------------------------------------------------------------


@pytest.mark.parametrize("min_docs, min_key", [(10, 1), (2, 3), (1, 1)])
def test_lines(docs, corpus, empty, min_docs, min_key):
    key = lambda x: x.strip(common.BLANKS).translate(LOW)
    seen = Counter(k for r in corpus for k in {key(x) for x in (r[1] or "").split("\n")} if len(k) >= min_key)
    want = []
    for r in corpus:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if seen[key(x)] < min_docs or len(key(x)) < min_key]
        want.append((r[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    got = line_dedup.dedup_lines(docs, min_docs=min_docs, min_key_chars=min_key).collect()
    assert sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got) == sorted(want)
    assert line_dedup.dedup_lines(empty).count() == 0


# 6 ------------------------------------------------------------------------


def grams(text, weighted, n=5):
    w = [x.translate(LOW) for x in words(text)]
    got = Counter(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else Counter()
    return got if weighted else Counter(set(got))


def near_classes(rows, weighted=False, least=0.8):
    sets = {}
    for r in rows:
        sets.setdefault(r[0], []).append(grams(r[1], weighted))
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if any(x and y and (x & y).total() / (x | y).total() >= least for x in sets[a] for y in sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("weighted", [True, False])
def test_near_duplicates(spark, corpus, empty, weighted):
    twice = " ".join(f"p{i}" for i in range(40))
    rows = [*corpus, (700, twice, *corpus[0][2:]), (701, twice + " " + twice, *corpus[0][2:])]  # equal sets but for the seam, other weights
    got = dart_minhash.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(3), weighted=weighted).collect()
    want = near_classes(rows, weighted)
    assert len(got) == len(rows) and {r["doc_id"]: r["class_id"] for r in got} == want
    assert (want[700] == want[701]) == (not weighted)
    assert all(r["keep"] == (r["doc_id"] == r["class_id"]) for r in got)
    assert dart_minhash.near_duplicates(empty, weighted=weighted).count() == 0


def test_drop_near_duplicates(spark, corpus, empty):
    """One row of each class stays, also of rows that repeat and of rows without an id; documents without words stay."""
    rows = corpus[:-1]
    kept = dart_minhash.drop_near_duplicates(spark.createDataFrame(rows, DOCS))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, c in near_classes(rows).items() if i == c)
    odd = [*corpus, corpus[5], *[(None, *corpus[6][1:])] * 2, *[(None, "a text of its own without any id at all", *corpus[0][2:])] * 3, *[(None, None, *corpus[0][2:])] * 2]
    kept = dart_minhash.drop_near_duplicates(spark.createDataFrame(odd, DOCS).repartition(4))
    assert kept.columns == DOCS.replace(",", "").split()[::2]
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    classes = near_classes(rows)
    want = Counter((r[0], r[1]) for r in rows if classes[r[0]] == r[0]) + Counter({(None, odd[-3][1]): 1, (None, None): 2})
    assert got == want
    assert dart_minhash.drop_near_duplicates(empty).count() == 0


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(2)
    a, b = rng.uniform(0, 9, 60), rng.uniform(0, 9, 60)
    b[:40] = a[:40]
    el = rng.integers(0, 2**63, 60).astype(np.uint64)
    rows, elements, weights = np.repeat([0, 1], 60), np.concatenate((el, el)), np.concatenate((a, b))
    hits = np.mean([np.mean(s[0] == s[1]) for s in (dart_minhash.signatures(rows, elements, weights, 2, 128, seed) for seed in range(20))])
    assert hits == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.04)


def test_components(spark):
    rng = np.random.default_rng(4)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, int(x)) for x in range(101, 160)] + [tuple(map(int, rng.integers(200, 400, 2))) for _ in range(120)]
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: root(x) for p in pairs for x in p if p[0] != p[1]}


# 7 ------------------------------------------------------------------------


def test_vectors(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(30):
        center = rng.normal(size=24)
        rows += [(len(rows), [float(x) for x in (center + rng.normal(size=24) * 0.22).astype(np.float32)], g % 3) for _ in range(8)]
    rows += [(1000, rows[0][1], rows[0][2]), (1001, rows[0][1], 2), (1002, rows[0][1], None), (1003, None, 1), (1004, [0.0] * 24, 1), (1005, [float("nan")] * 24, 1), (1006, [None] + [1.0] * 23, 1), (1007, [1.0, 2.0], 0), (1008, [2.0, 4.0], 0), (1009, [], 0), (1010, [float("inf")] + [1.0] * 23, 1), rows[2]]
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<float>, label int, n_links int")

    def ok(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(rows)
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            a, b = rows[i], rows[j]
            if i != j and ok(a[1], a[2]) and ok(b[1], b[2]) and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                link[i, j] = x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.93
    comp = [r[0] for r in rows]
    for _ in range(n):
        comp = [min([comp[i]] + [comp[j] for j in np.flatnonzero(link[i])]) for i in range(n)]
    want = sorted((rows[i][0], int(link[i].sum()), comp[i], rows[i][0] == comp[i]) for i in range(n))
    for block in (512, 5):
        got = binary_codes.near_vectors(df, block=block).collect()
        assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == want
    assert binary_codes.near_vectors(df.limit(0)).count() == 0
    texts = df.selectExpr("vec_id", "embedding", "'class ' || label AS label")
    got = binary_codes.near_vectors(texts).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == want


def test_vectors_without_id_and_long_vectors(spark):
    long = [float(x) for x in np.random.default_rng(6).normal(size=20_000)]
    rows = [(5, long, 1), (None, [2 * x for x in long], 1), (3, [-x for x in long], 1), (None, None, 1), (None, [1.0, 0.0], 2), (8, [1.0, -0.0], 2), (9, [1.0, 0.0], None)]
    got = binary_codes.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=repr) == sorted([(5, 1, 5), (None, 1, 5), (3, 0, 3), (None, 0, None), (None, 1, 8), (8, 1, 8), (9, 0, 9)], key=repr)


def test_code_estimates_are_unbiased():
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(2, 64))
    x, y = x / np.linalg.norm(x), y / np.linalg.norm(y)
    est = []
    for r in range(400):
        a, b = binary_codes.turn(np.stack((x, y)), 1, r)
        est.append(np.where(a > 0, b, -b).sum() / np.abs(a).sum())
    assert np.mean(est) == pytest.approx(x @ y, abs=0.02)


# 8 ------------------------------------------------------------------------


def test_licenses(spark, empty):
    mit = dict(licenses.LICENSES)["MIT"]
    odd = "MIT Licence\n\nCopyright (c) 2019 Some One\nAll rights reserved.\n\n" + mit.replace("sublicense", "sub-license").upper().replace(",", " ,  ")
    named = "Copyright The Example Authors\r\nCopyright (c) Some Body\r\n" + mit.replace("\n", "\r\n")
    wrapped = mit.replace("copyright notice and", "\ncopyright notice and").replace("COPYRIGHT HOLDERS", "\n  COPYRIGHT HOLDERS")
    rows = [(1, mit), (2, odd), (3, mit + " And more."), (4, None), (5, ""), (6, "Text.\nreleased under the MIT LICENCE\nEnd\nReleased under the MIT License."), (1, mit), (7, "x " * 50_000), (8, named), (9, wrapped), (10, "one\nAll rights reserved.\nLicensed under CC BY-NC 4.0.")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, digest string")
    got = sorted(((r["doc_id"], r["license_id"], r["n_notices"], r["notices"]) for r in licenses.scan_licenses(df, licenses.known_licenses(spark)).collect()), key=repr)
    want = [(1, "MIT", 0, ""), (1, "MIT", 0, ""), (10, None, 2, "CC-BY-NC-4.0,Proprietary"), (2, "MIT", 1, "Proprietary"), (3, None, 0, ""), (4, None, 0, ""), (5, None, 0, ""), (6, None, 2, "MIT"), (7, None, 0, ""), (8, "MIT", 0, ""), (9, "MIT", 0, "")]
    assert got == sorted(want, key=repr)
    assert licenses.scan_licenses(empty.select("doc_id", "text"), licenses.known_licenses(spark)).count() == 0


def test_long_licenses(spark, tmp_path):
    """Entire public licences, where this machine has them, are known by digest; names and years do not matter, terms do."""
    from pathlib import Path

    here = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    texts = {v: Path("/usr/share/common-licenses", k).read_text() for k, v in here.items() if Path("/usr/share/common-licenses", k).exists()}
    if not texts:
        pytest.skip("no licence texts on this machine")
    rows = [(k, "Copyright (c) 2020 A. Person\n\n" + t) for k, t in texts.items()] + [("no", t[: len(t) // 2]) for t in texts.values()]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "name string, text string"), licenses.known_licenses(spark)).collect()
    assert sorted(((r["name"], r["license_id"]) for r in got), key=repr) == sorted(((k, None if k == "no" else k) for k, _ in rows), key=repr)


# 9 ------------------------------------------------------------------------


def test_lm(spark, corpus, empty):
    rows = [*corpus, corpus[3], corpus[3], (None, "a null id", *corpus[0][2:]), (None, "a null id", *corpus[0][2:])]
    got = attention_lm.lm_scores(spark.createDataFrame(rows, DOCS), queries.public_tokenizer(), steps=20).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    tokens = [[*words((r[1] or "").translate(LOW)), None] for r in rows]
    c = Counter(x for r, t in zip(rows, tokens) if not held(r[0]) for x in t)  # every row counts, also where rows repeat
    n, v = sum(c.values()), len(c)
    want = sorted(((r[0], held(r[0]), len(t), sum(c[x] > 0 for x in t), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)) for r, t in zip(rows, tokens)), key=repr)
    rest = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), key=repr)
    assert [w[:5] for w in want] == [r[:5] for r in rest]
    assert [w[5] for w in want] == pytest.approx([r[5] for r in rest], rel=1e-9)
    assert all(r["score"] < 0 for r in got)
    assert attention_lm.lm_scores(empty, queries.public_tokenizer()).count() == 0


def small_lm(rng):
    model = attention_lm.Model(np.array([50 - i if i < 40 else 0 for i in range(60)]), np.arange(60) % 2 == 0, known=30, clusters=3, size=8, buckets=3, dim=4)
    for k in ("w", "w2"):
        model.params[k] = rng.normal(size=model.params[k].shape).astype(np.float32)
    return model


def test_lm_scores_window_by_window():
    """Scores of the operator's task against loops over single tokens: context, mask, both steps of the output."""
    rng = np.random.default_rng(4)
    texts = [None, "", "one", *(sentence(rng, n) for n in (2, 3, 9, 31, 200)), "Zwölf  Wörter\n\tund mehr " * 9]
    tokenizer = queries.public_tokenizer()
    sub = attention_lm.Subwords(tokenizer)
    count = np.zeros(sub.end + 1)
    streams = []
    for t in texts:
        ids = [i for x in words((t or "").translate(LOW)) for i in sub.encode.encode_ordinary(" " + x)]
        streams.append([sub.end, *ids, sub.end])
        np.add.at(count, streams[-1][1:], 1)
    model = attention_lm.Model(count, np.arange(len(count)) % 3 == 0, known=40, clusters=4, size=8, buckets=3, dim=4)
    for k in ("w", "w2", "m"):
        model.params[k] = rng.normal(size=model.params[k].shape).astype(np.float32)
    p = {k: v.astype(float) for k, v in model.params.items()}

    def token(stream, at, start):
        """log10 probability of stream[at + 1], seeing stream[start..at]."""
        q, k, v = np.split(p["u"][model.dense[stream]] @ p["m"], 3, 1)
        a = np.array([q[at] @ k[j] / 2 + p["b"][at - j] for j in range(start, at + 1)])
        a = np.exp(a - a.max())
        h = np.maximum((a / a.sum()) @ v[start : at + 1] + p["e"][model.dense[stream[at]]] + p["g"], 0)
        y = stream[at + 1]
        first = h @ p["w"] + p["o"]
        out = first[model.cls[y]] - np.log(np.exp(first).sum()) + model.inside[y]
        if model.cls[y] < model.clusters:
            second = h @ p["w2"][model.cls[y]] + p["o2"][model.cls[y]]
            out += second[model.place[y]] - np.log(np.exp(second).sum())
        return out / math.log(10)

    want = [sum(token(s, at, max(0, at // attention_lm.STRIDE * attention_lm.STRIDE - attention_lm.CONTEXT)) for at in range(len(s) - 1)) for s in streams]
    batch = pa.RecordBatch.from_pylist([{"doc_id": i, "rid": i, "held_out": False, "text": t or ""} for i, t in enumerate(texts)])
    got = pa.Table.from_batches(attention_lm._scores([batch], model, tokenizer, np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    assert got.column("score").to_pylist() == pytest.approx(want, rel=1e-3)


def test_lm_gradient_mask_and_total():
    rng = np.random.default_rng(8)
    model = small_lm(rng)
    span, stride = attention_lm.SPAN, attention_lm.STRIDE
    x = rng.integers(0, 60, (2, span))
    hidden = np.arange(span)[None] < np.array([[0], [5]])
    total = sum(np.exp(model.log_probs(x, np.full((2, stride), t), hidden)) for t in range(60))
    assert np.allclose(total, 1, atol=1e-3)  # a distribution over all ids
    y = rng.integers(0, 60, (2, stride))
    later, before = x.copy(), x.copy()
    later[:, -1] = (later[:, -1] + 1) % 60
    before[1, :5] = (before[1, :5] + 1) % 60
    assert np.allclose(model.log_probs(x, y)[:, :-1], model.log_probs(later, y)[:, :-1])  # no look at what follows
    assert np.allclose(model.log_probs(x, y, hidden), model.log_probs(before, y, hidden))  # nor at what is hidden
    targets = rng.integers(0, 60, x.shape)
    real = np.arange(span)[None] < np.array([[span], [span - 5]])
    model.params = {k: v.astype(np.float64) for k, v in model.params.items()}

    def loss():
        z = model.attend(model.dense[x], span)[-1]
        h, c = np.maximum(z, 0), model.cls[targets]
        first = h @ model.params["w"] + model.params["o"]
        out = np.log(np.exp(first).sum(2)) - np.take_along_axis(first, c[:, :, None].astype(int), 2)[:, :, 0]
        for i, j in np.argwhere(c < model.clusters):
            second = h[i, j] @ model.params["w2"][c[i, j]] + model.params["o2"][c[i, j]]
            out[i, j] += np.log(np.exp(second).sum()) - second[model.place[targets[i, j]]]
        return (out * real).sum() / real.sum()

    g = model.gradient(x, targets, real)
    places = [("u", (model.dense[x[0, 5]], 1)), ("e", (model.dense[x[1, 4]], 3)), ("m", (1, 2)), ("m", (2, 6)), ("m", (0, 10)), ("w", (1, 2)), ("o", (1,)), ("b", (3,)), ("g", (2,)), ("w2", (0, 1, 2)), ("o2", (1, 3))]
    for name, at in places:
        keep = model.params[name][at]
        model.params[name][at] = keep + 1e-5
        up = loss()
        model.params[name][at] = keep - 1e-5
        down = loss()
        model.params[name][at] = keep
        assert (up - down) / 2e-5 == pytest.approx(g[name][at], rel=1e-3, abs=1e-6)


# 10 -----------------------------------------------------------------------


def test_more_words_than_characters():
    """A benchmark of more distinct words than there are characters."""
    n = 1_150_000
    items = [(str(k), " ".join(f"x{i}" for i in range(k, k + 50_000))) for k in range(0, n, 50_000)]
    code, auto = decontaminate.build(items, 60_000)
    assert len(code) == n and len(set(code.values())) == n
    w = [f"X{i}" for i in range(1_099_900, 1_150_010)]
    assert decontaminate.scan("y " + ", ".join(w) + " y", code, auto)[1:] == ([(101, 50_101)], {"1100000"})


NORMAL = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def leaks(rows, items, n=10):
    norm = lambda x: NORMAL.findall((x or "").translate(LOW))
    out = []
    for r in rows:
        w = norm(r[1])
        hit, found, places = set(), set(), {}
        for a, x in enumerate(w):
            places.setdefault(x, []).append(a)
        for i, text in items:
            q = norm(text)
            for k in range(max(1, len(q) - n + 1) if q else 0):
                win = q[k : k + n]
                for a in places.get(win[0], ()):
                    if w[a : a + len(win)] == win:
                        hit |= set(range(a, a + len(win)))
                        found.add(str(i))
        out.append((r[0], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("max_chars", [32_000_000, 60])
def test_decontaminate(spark, corpus, max_chars):
    rows = corpus
    items = [(10, " ".join(rows[2][1].split()[3:20])), (2, rows[4][1].upper().replace(" ", ", ")), (3, "héé wörld"), (4, None), (5, "..."), (6, "never seen words here"), (10, " ".join(rows[2][1].split()[3:20])), (7, "one")]
    df = spark.createDataFrame(rows, DOCS).withColumnRenamed("keep", "n_hit")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(df, bench, max_chars=max_chars).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got), key=repr) == leaks(rows, items)
    for r in got:
        for s in r["spans"]:
            assert 0 <= s["start"] < s["end"] <= len(r["text"])
    span = next(r for r in got if r["doc_id"] == 2)
    assert any(r["text"][s["start"] : s["end"]] == " ".join(rows[2][1].split()[3:20]) for r in [span] for s in r["spans"])
    assert not any(r["contaminated"] for r in decontaminate.decontaminate(df, bench.limit(0)).collect())
    assert decontaminate.decontaminate(df.limit(0), bench).count() == 0
