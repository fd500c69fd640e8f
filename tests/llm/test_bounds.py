"""Hot ids and repeated rows: what reaches one task or the driver stays bounded."""

import os

import numpy as np
import pyarrow as pa
import pytest

from tallyroom.llm import collocations, common, cotrain, mixing, phrase_dedup


@pytest.fixture
def counted(monkeypatch):
    """Rows and columns of every table that an operator writes in between."""
    seen = []

    def spy(module):
        real = module.stage

        def stage(df):
            out = real(df)
            seen.append((tuple(out.columns), out.count()))
            return out

        monkeypatch.setattr(module, "stage", stage)
        return seen

    return spy


def texts(n, seed=0):
    rng = np.random.default_rng(seed)
    return [" ".join(f"w{k}" for k in rng.integers(0, 300, 60)) for _ in range(n)]


def test_one_labelled_id_of_many_rows(spark, counted):
    """A thousand documents of one labelled id send one row to the driver."""
    rows = [(7, t, "s", "en", 9) for t in texts(1000)] + [(100 + i, t, "s", "en", 9) for i, t in enumerate(texts(60, 1))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").repartition(4)
    labels = spark.createDataFrame([(7, 1, 0)] + [(100 + i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    seen = counted(cotrain)
    out = cotrain.quality_scores(docs, labels)
    staged = [n for columns, n in seen if "meta" in columns]
    assert staged == [61] and out.count() == 1060
    again = cotrain.quality_scores(docs.repartition(3), labels)
    assert sorted(r["score"] for r in out.collect()) == sorted(r["score"] for r in again.collect())


@pytest.mark.parametrize("hot", [None, 5])
def test_rows_of_no_id_or_one_id_are_spread(spark, counted, hot):
    """A thousand rows without an id, or of one, are in many shards; reruns take as many words of equal rows."""
    rows = [(hot, t, "a") for t in texts(1000)] + [(hot, texts(1)[0], "a")] * 2 + [(i, t, None) for i, t in enumerate(texts(50, 2))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    seen = counted(mixing)
    out = mixing.mix_sources(docs, shard_words=2000)
    shards = max(n for columns, n in seen if "__quota" in columns)
    assert shards >= 25
    got = out.collect()
    assert sorted((r["text"], r["taken"]) for r in got) == sorted((r["text"], r["taken"]) for r in mixing.mix_sources(docs.repartition(7), shard_words=2000).collect())
    for source in ("a", None):
        of = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in of) - of[0]["target"]) <= 0.03 * of[0]["target"] + 64
        assert all(r["taken"] <= 2 * r["size"] for r in of)


def test_runs_have_their_own_stages(spark, tmp_path):
    """A run that ends removes its folders and no other's."""
    path = lambda df: df.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
    with common.own_stages() as first:
        one = common.stage(spark.range(3))
        with common.own_stages() as second:
            two = common.stage(spark.range(4))
            common.clear_stages(spark, second)
        three = common.stage(spark.range(5))
        assert len(first) == 2 and not os.path.exists(path(two))
        common.clear_stages(spark, first, keep=1)
    assert not os.path.exists(path(one)) and three.count() == 5
    outside = common.stage(spark.range(2))
    assert len(first) == 1 and outside.count() == 2


@pytest.fixture
def default_batches(spark):
    """The session as Spark starts it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    yield key
    spark.conf.unset(key)


def test_phrase_dedup_hands_out_small_batches(spark, default_batches):
    """24 MB of texts in one task come as batches of some 4 MB; a bound that the session has stays."""

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], names=["bytes"])

    docs = spark.range(3000, numPartitions=1).selectExpr("id AS doc_id", "repeat(concat('w', id, ' '), 1500) AS text")
    phrase_dedup.dedup_phrases(docs.limit(20))
    got = [r[0] for r in docs.mapInArrow(sizes, "bytes long").collect()]
    assert sum(got) > 16_000_000 and max(got) < 5_000_000
    spark.conf.set(default_batches, "1m")
    common.small_batches(spark)
    assert spark.conf.get(default_batches) == "1m"


def test_collocations_hand_out_small_batches(spark, default_batches):
    """24 MB of texts in one task come as batches of some 4 MB."""

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], names=["bytes"])

    docs = spark.range(3000, numPartitions=1).selectExpr("'en' AS lang", "repeat(concat('w', id, ' '), 1500) AS text")
    collocations.frequent_phrases(docs.limit(20))
    got = [r[0] for r in docs.mapInArrow(sizes, "bytes long").collect()]
    assert sum(got) > 16_000_000 and max(got) < 5_000_000
