"""Training-data operators do the whole job: long texts, hot groups and odd markup."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tallyroom.llm import attention_lm, common, phrase_dedup, queries


@pytest.fixture(scope="module")
def long_texts():
    rng = np.random.default_rng(11)
    return [" ".join(f"word{rng.integers(3000)}" for _ in range(n)) for n in (4000, 31, 32, 33, 1)] + ["", None]


def test_lm_counts_all_subwords_of_long_texts(spark, long_texts):
    tok = queries.public_tokenizer()
    encode, end = attention_lm._tokenizer(*tok)
    want = Counter()
    for t in long_texts:
        want[end] += 1
        for x in (t or "").split():
            want.update(encode.encode_ordinary(" " + x))
    df = spark.createDataFrame([(i, t or "") for i, t in enumerate(long_texts)], "round int, text string").repartition(3)
    spans = Counter({i: -(-(sum(len(encode.encode_ordinary(" " + x)) for x in (t or "").split()) + 1) // attention_lm.SPAN) for i, t in enumerate(long_texts)})
    for most in (2_000_000, 50):  # one table of words at the end, or several
        tallies = df.mapInArrow(lambda it: attention_lm._tallies(it, tok, (1,) * 7, most), "kind int, key long, n long")
        assert attention_lm._sums(tallies, attention_lm.SUBWORD) == want
        assert attention_lm._sums(tallies, attention_lm.WINDOWS) == spans
        counts = sorted(attention_lm._sums(tallies, attention_lm.WORD).values())
        assert counts == sorted(Counter(x for t in long_texts for x in (t or "").split()).values())


def test_lm_ids_of_words_that_share_slots(long_texts):
    """A table of few slots that starts again gives the ids that the tokenizer gives."""
    tok = queries.public_tokenizer()
    sub = attention_lm.Subwords(tok, keep=500, slots=16)
    texts = ["ünlike wörds", "\x00 a", *long_texts] * 2
    for k in range(0, len(texts), 3):
        w = common.Words(pa.array(texts[k : k + 3], pa.string()), lower=True)
        ids, n = sub.ids(w, w.hashes)
        raw = w.data.tobytes()
        want = [sub.encode.encode_ordinary(" " + raw[a:b].decode()) for a, b in zip(w.starts, w.ends)]
        assert n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_lm_windows_tile_whole_texts(long_texts):
    tok = queries.public_tokenizer()
    sub = attention_lm.Subwords(tok)
    w = common.Words(pa.array(long_texts), lower=True)
    tokens, starts = attention_lm.streams(w, *sub.ids(w, w.hashes), sub.end)
    windows, sizes = attention_lm.tiles(tokens, starts)
    got = [int(y) for x, n in zip(windows, sizes) for y in x[1:n]]
    assert got == [int(y) for a, b in zip(starts, starts[1:]) for y in tokens[a + 1 : b]]
    before = [int(y) for x, n in zip(windows, sizes) for y in x[: n - 1]]
    assert before == [int(y) for a, b in zip(starts, starts[1:]) for y in tokens[a : b - 1]]


def test_lm_learns_from_every_window(monkeypatch):
    rng = np.random.default_rng(2)
    model = attention_lm.Model(np.where(np.arange(60) < 40, 9, 0), np.arange(60) % 2 == 0, clusters=2, size=8, buckets=3, dim=4)
    seen = Counter()
    gradient = attention_lm.Model.gradient
    monkeypatch.setattr(attention_lm.Model, "gradient", lambda self, x, y, real: (seen.update(x[:, 0].tolist()), gradient(self, x, y, real))[1])
    windows = rng.integers(0, 60, (50, attention_lm.SPAN + 1)).astype(np.int32)
    windows[:, 0] = np.arange(50)
    full = np.full(50, attention_lm.SPAN + 1)
    assert model.learn(((windows[a : a + 17], full[a : a + 17]) for a in range(0, 50, 17)), 1, 8, 0.02, 9, 50) == 50
    assert seen == Counter(range(50))


def test_lm_words_that_share_a_slot_are_encoded_once():
    sub = attention_lm.Subwords(queries.public_tokenizer(), slots=1 << 14)
    text = pa.array([" ".join(f"word{i}" for i in range(400))])
    w = common.Words(text, lower=True)
    first = (w.hashes & np.uint64(sub.slots - 1)).tolist()
    assert len(set(first)) < len(first)  # some words share their first slot
    sub.ids(w, w.hashes)
    sub.ids(w, w.hashes)  # a word whose slot another took in the same call is encoded once more
    used = sub.used
    sub.ids(w, w.hashes)
    assert sub.used == used


def test_lm_targets_fill_tiles_of_their_cluster():
    rng = np.random.default_rng(3)
    model = attention_lm.Model(np.where(np.arange(60) < 40, 9, 0), np.arange(60) % 2 == 0, clusters=3, size=8, buckets=3, dim=4)
    for n in (0, 1, 33, 500):  # the last in tiles of 64
        c = model.cls[rng.integers(0, 60, n)]
        which, tiles, begin, places = model._tiled(c)
        has = which < n
        assert sorted(which[has].tolist()) == np.flatnonzero(c < model.clusters).tolist()
        assert all((c[w[h]] == t).all() for w, h, t in zip(which, has, tiles))
        assert [tiles[a:b].tolist() for a, b in zip(begin, begin[1:])] == [[j] * (b - a) for j, (a, b) in enumerate(zip(begin, begin[1:]))]
        own = places < which.size
        assert (own == (c < model.clusters)).all() and (which.reshape(-1)[places[own]] == np.flatnonzero(own)).all()


def test_lm_many_and_few_windows_give_the_same_log_probs():
    """Projections by id and by place, tiles of both sizes, logits above 60."""
    rng = np.random.default_rng(5)
    model = attention_lm.Model(np.where(np.arange(60) < 40, 9, 0), np.arange(60) % 2 == 0, clusters=3, size=8, buckets=3, dim=4)
    model.params = {k: (v + rng.normal(size=v.shape)).astype(np.float32) for k, v in model.params.items()}
    x = rng.integers(0, 60, (300, attention_lm.SPAN + 1))
    for w in (1, 40):
        model.params["w"] *= w
        whole = model.log_probs(x[:, :-1], x[:, attention_lm.CONTEXT + 1 :])
        assert np.isfinite(whole).all()
        assert np.allclose(whole, np.concatenate([model.log_probs(r[:, :-1], r[:, attention_lm.CONTEXT + 1 :]) for r in np.split(x, 300)]), rtol=1e-3, atol=1e-3)


def test_recurring_windows_survive_colliding_hashes(monkeypatch):
    rng = np.random.default_rng(2)
    codes, docs = rng.integers(0, 3, 400), np.repeat(np.arange(8), 50)
    at = np.flatnonzero(docs[:-3] == docs[3:])
    seen = {}
    for i in at:
        seen.setdefault(tuple(codes[i : i + 4]), set()).add(int(docs[i]))
    want = sorted((k, min(v)) for k, v in seen.items() if len(v) > 1)
    for mixed in (phrase_dedup.mix64, lambda h: h & np.uint64(1)):
        monkeypatch.setattr(phrase_dedup, "mix64", mixed)
        place, low = phrase_dedup.recurring(codes, at, docs[at], 4)
        assert sorted((tuple(codes[i : i + 4]), d) for i, d in zip(place, low)) == want


def test_phrases_of_a_hot_gram(spark, monkeypatch):
    """A stock phrase with other neighbours in every document: no shard sees more than two pieces of it."""
    piece = 20
    for k in range(300):  # until the stock phrase is the gram that most documents name
        rng = np.random.default_rng(6)
        rows = [(i, " ".join([*(f"v{rng.integers(60)}" for _ in range(12)), f"s{k} bb cc dd", *(f"v{rng.integers(60)}" for _ in range(12))])) for i in range(80)]
        rows += [(100 + i, rows[i % 9][1].replace(" ", "\t ")) for i in range(30)]
        named = phrase_dedup.named_grams(common.Words(pa.array([t for _, t in rows])), 13, 4)[3]
        if np.unique(named, return_counts=True)[1].max() >= 5 * piece:
            break
    else:
        pytest.fail("no hot gram")
    marks, shards = phrase_dedup.marks, phrase_dedup._shards

    def bounded(texts, docs, width):
        assert len(docs) <= 2 * piece
        return marks(texts, docs, width)

    def watched(batches, width, size):
        phrase_dedup.marks = bounded
        yield from shards(batches, width, size)

    monkeypatch.setattr(phrase_dedup, "_shards", watched)
    first = {}
    for d, t in rows:
        w = t.split()
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            first[k] = min(first.get(k, d), d)
    want = {}
    for d, t in rows:
        w = t.split()
        want[d] = len({j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d for j in range(i, i + 13)})
    got = phrase_dedup.dedup_phrases(spark.createDataFrame(rows, "doc_id long, text string"), piece=piece).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == want and sum(want.values())
