"""The pipeline on the smallest tables, stage by stage, against plain Python."""

from collections import Counter

import corpus_pipeline
from tallyroom.llm import decontaminate
from tallyroom.llm.common import BLANKS, LOWER, UPPER

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = {r["doc_id"]: r for r in docs.collect()}
    for name, step in corpus_pipeline.STAGES:
        out = corpus_pipeline.stage(step(spark, docs, SF))
        got = {r["doc_id"]: r for r in out.collect()}
        assert set(got) <= set(rows) and len(got) == out.count()
        if name != "mixture":
            assert out.columns == columns
        if name == "quality":
            labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
            good = [r["doc_id"] for r in labels if r["quality"] == 1 and r["toxic"] == 0]
            assert sum(i in got for i in good) >= 0.95 * len(good)
        if name == "lines":
            assert set(got) == set(rows)
            key = lambda x: x.strip(BLANKS).translate(str.maketrans(UPPER, LOWER))
            seen = Counter(k for r in rows.values() for k in {key(x) for x in (r["text"] or "").split("\n")})
            assert {i: r["text"] for i, r in got.items()} == {i: "\n".join(x for x in (r["text"] or "").split("\n") if not key(x) or seen[key(x)] < 10) for i, r in rows.items()}
        if name == "benchmark":
            items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            code, auto = decontaminate.build(items, 10)
            assert set(got) == {i for i, r in rows.items() if not decontaminate.scan(r["text"], code, auto)[1]}
        if name == "mixture":
            assert all(r["taken"] > 0 for r in got.values())
        docs, rows = out, got


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_odd_tables(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, rows without an id, and columns named as what operators add: each stage gives the columns it got, with their values."""
    import numpy as np

    rng = np.random.default_rng(1)
    text = lambda n: " ".join(f"w{rng.integers(500)}" for _ in range(n))
    names = ["score", "keep", "items", "n_hit", "n_lines", "n_dropped", "spans", "__row", "blocks", "shards", "quota"]
    rows = [(i, t, "en", ["s", None][i % 2], len(t or "")) for i, t in enumerate([text(40) for _ in range(30)] + [None, "", " ", text(20_000), "x\n" * 50])]
    rows += [rows[0], rows[0], (None, text(30), None, None, None), (None, rows[3][1], "en", "s", 9)]
    rows += [(100 + i, "common line\n" + text(20), "en", "s", 5) for i in range(12)]
    rows = [(*r, *(f"{n} {r[0]}" for n in names)) for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    for n in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{n}.parquet").write.parquet(str(tmp_path / f"{n}.parquet"))
    for part in (rows, rows[:0]):
        docs = spark.createDataFrame(part, schema)
        for name, step in corpus_pipeline.STAGES:
            out = corpus_pipeline.stage(step(spark, docs, str(tmp_path)))
            got = out.collect()
            if name != "mixture":
                assert out.columns == docs.columns
                assert all(r[n] == f"{n} {r['doc_id']}" for r in got for n in names)
            if name == "near_copies":
                assert not part or sum(r["text"] == rows[0][1] for r in got) <= 1
            docs = out if name != "quality" else docs  # the later stages get all rows
        assert len(got) <= len(part)
