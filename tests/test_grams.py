"""The trigram index: the same rows as a scan, and few parts read for a rare term."""

import random

import pytest
from pyspark.sql import functions as F
from test_years import files_read

from tallyroom.operators import filters
from tallyroom.sources.grams import GramTable, grams_of, write_grams

WORDS = ["road", "bridge", "school", "clinic", "ÉCOLE", "x", "flood wall", "a%b_", "😀lake", "drain", "pier", "market"]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(4))), rng.choice(["Cebu", "Iloilo", None, ""])) for i in range(3000)]
    rows += [(5000 + i, "same text for a third of all rows", "Cebu") for i in range(1500)]
    rows += [(9000, "one Zeppelin hangar", "Bohol"), (9001, None, None), (9002, "zeppelin", "Zeppelin"), (9003, "long " * 5000 + "needle", "Cebu")]
    df, path = spark.createDataFrame(rows, "id long, name string, place string").repartition(6), str(tmp_path_factory.mktemp("g"))
    write_grams(df, path, ["name", "place"], rows_a_part=100)
    return df, GramTable(spark, path, df)


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


@pytest.mark.parametrize("term", ["zeppelin", "ROAD", "needle", "x", "", "École", "a%b_", "😀la", "d wall", "third of all", "absent term", "ng Needle"])
def test_same_rows_as_the_scan(table, term):
    df, grams = table
    assert ids(filters.filter_lines(grams.with_terms({"name": term}), {"name": term})) == ids(filters.filter_lines(df, {"name": term}))
    assert ids(filters.search_all_words(grams.with_words(["name", "place"], term + " ceb"), ["name", "place"], term + " ceb")) == ids(filters.search_all_words(df, ["name", "place"], term + " ceb"))
    values = lambda d: [r["value"] for r in filters.prefix_values(d, "name", term, 50).collect()]
    assert values(grams.with_prefix("name", term)) == values(df)


def test_a_rare_term_reads_few_parts(table):
    df, grams = table
    whole = files_read(grams.lines)
    assert whole >= 40
    assert 1 <= files_read(grams.with_terms({"name": "zeppelin"})) <= 2
    assert files_read(grams.with_words(["name", "place"], "zeppelin bohol")) == 1
    assert files_read(grams.with_prefix("name", "zep")) == 1
    assert files_read(grams.with_terms({"name": "absent term"})) == 0
    sizes = [r["count"] for r in grams.lines.groupBy("gram_part").count().collect()]
    assert max(sizes) < 4 * 100  # the common text fills several parts


def test_empty_table_and_odd_columns(spark, tmp_path):
    df = spark.createDataFrame([], "id long, name string, gram string, part int")
    write_grams(df, str(tmp_path), ["name"])
    assert GramTable(spark, str(tmp_path), df).with_terms({"name": "road"}).count() == 0
    df = spark.createDataFrame([(1, "road", "g", 2), (2, None, "h", 3)], df.schema)
    write_grams(df, str(tmp_path), ["name"])
    got = GramTable(spark, str(tmp_path), df).with_terms({"name": "oad"})
    assert got.columns == df.columns and got.where(F.col("name") == "road").count() == 1


def test_grams_of():
    assert grams_of("abcab") == ["abc", "bca", "cab"] and grams_of("ab") == [] and grams_of("ab", prefix=True) == ["\u0002ab"]
