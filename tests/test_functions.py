"""Hand-computed values, and similarity joins against brute force."""

import difflib
import re

import pytest
from pyspark.sql import functions as F

from tallyroom.functions import columns as C
from tallyroom.operators import duplicates, entities, matching, trends
from tallyroom.sources import pages, tables
from tallyroom.streaming import ingest


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("args, score", [((9, 9, 10, 10), 100), ((0, 0, 1, 1), 0), ((5, 10, 0, 0), 70), ((5, 10, 0, 7), 50), ((5, 10, 10, 20), 50)])
def test_duplicate_score(spark, args, score):
    assert value(spark, C.duplicate_score(*[F.lit(a) for a in args])) == score


def test_distances_and_amounts(spark):
    lit = F.lit
    assert value(spark, C.haversine_km(lit(1.0), lit(2.0), lit(1.0), lit(2.0))) == 0
    assert round(value(spark, C.haversine_km(lit(0.0), lit(0.0), lit(1.0), lit(0.0))), 2) == 111.19
    assert value(spark, C.amount_score(lit(100), lit(100))) == 1
    assert round(value(spark, C.amount_score(lit(100), lit(99))), 6) == 0.8
    assert value(spark, C.amount_score(lit(100), lit(95))) == pytest.approx(0, abs=1e-9)
    assert value(spark, C.growth(lit(5.0), lit(0.0))) == 0
    assert value(spark, C.money(lit("₱1,234.50"))) == 1234.5
    assert value(spark, C.money(lit("n/a"))) == 0


@pytest.mark.parametrize("name, variant, norm", [("X CORPORATION", "substring", "X ORATION"), ("X CORPORATION", "token", "X"), ("A & B Trading Corp.", "token", "A AND B TRADING"), ("The Firm Inc.", "suffix", "Firm"), ("Province of Cavite", "place", "OF CAVITE")])
def test_standard_names(spark, name, variant, norm):
    assert value(spark, C.standard_name(F.lit(name), variant)) == norm


@pytest.mark.parametrize("name, parts", [
    ("ALPHA BUILDERS / BETA TRADING INC.", ["ALPHA BUILDERS", "BETA TRADING INC."]), ("NEW NAME CORP (FORMERLY: OLD NAME CORP)", ["NEW NAME CORP", "OLD NAME CORP"]), ("NEW NAME (FORMERLY OLD NA", ["NEW NAME", "OLD NA"]),
    ("SUPPLY / BUILD", []), ("ALPHA & SONS", ["ALPHA & SONS"]), ("ACME / JV", ["ACME"]), ("", []),
])
def test_split_names(spark, name, parts):
    assert value(spark, C.split_names(F.lit(name))) == parts


@pytest.mark.parametrize("metric", ["levenshtein", "gestalt"])
def test_similar_names_lose_no_pair(spark, metric):
    names = [f"{a} {b}{c}" for a in ("RED", "BLUE", "READ", "") for b in ("RING", "RINGS", "GEAR", "BOLT") for c in (" CO", "", "S")]
    a, b = names[::2], names[1::2] + ["", "RED RING CO"]

    def lev(x, y):
        prev = list(range(len(y) + 1))
        for i, p in enumerate(x, 1):
            prev = _row(prev, p, y, i)
        return prev[-1]

    def _row(prev, p, y, i):
        row = [i]
        for j, q in enumerate(y, 1):
            row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (p != q)))
        return row

    def ratio(x, y):
        if metric == "gestalt":
            return difflib.SequenceMatcher(None, x, y).ratio()
        return 1 - lev(x, y) / max(len(x), len(y)) if x or y else 1.0

    want = {(x, y) for x in set(a) for y in set(b) if ratio(x, y) >= 0.8}
    got = matching.similar_names(spark.createDataFrame([(x,) for x in a], "a string"), spark.createDataFrame([(y,) for y in b], "b string"), "a", "b", 0.8, metric)
    assert {(r["a"], r["b"]) for r in got.collect()} == want


def test_greedy_names(spark):
    spark.sparkContext.setCheckpointDir("/tmp/tallyroom-test-checkpoints")
    df = lambda *x: spark.createDataFrame([(v,) for v in x], "name string")
    got = matching.greedy_new_names(df("AAAAAAAAAA", "AAAAAAAAAB", "ZZZZZZZZZZ", "QQQQQQQQQQ"), "name", df("QQQQQQQQQR"), "name")
    assert sorted(r["name"] for r in got.collect()) == ["AAAAAAAAAA", "ZZZZZZZZZZ"]


def test_tiers_and_empty_tables(spark):
    schema = "sorder long, dsc string, amt_coarse decimal(20,2), agency long, department long, fundcd long, uacs_exp_cd long, operunit long, uacs_reg_id long"
    same = spark.createDataFrame([(1, "a", 1, 1, 1, 1, 1, 1, 1), (2, "a", 1, 1, 1, 1, 1, 1, 1), (3, "a", 1, 2, 2, 2, 2, 2, 2), (4, None, 1, 1, 1, 1, 1, 1, 1)], schema.replace("decimal(20,2)", "long"))
    assert {r["sorder"]: r["tier"] for r in duplicates.tiered_duplicates(same, "sorder").collect()} == {1: "9", 2: "9", 3: "2"}
    assert duplicates.duplicate_groups(same.limit(0), ["dsc"], "amt_coarse").count() == 0
    assert trends.risk(spark.createDataFrame([], "level string")).first()["level"] == "LOW"


def test_registry_records(spark):
    text = "x\nCompany Name\nA CORP\n\nSEC Number\nCS1\n\nDate Registered\nMarch 3, 2011\n\nStatus\nRegistered\n\nAddress\nStreet 1\n"
    r = entities.registry_records(spark.createDataFrame([(text,)], "value string")).first()
    assert (r["contractor_name"], r["sec_number"], str(r["date_registered"]), r["status"], r["address"]) == ("A CORP", "CS1", "2011-03-03", "Registered", "Street 1")


def test_ingest_reads_each_file_and_key_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a_0001.json").write_text('[{"id": "1", "fiscal_year": "2025", "amount": 5}, {"id": "2", "fiscal_year": "2025", "amount": 7}]')
    run = lambda: ingest.ingest(spark, str(src), str(tmp_path / "out"), str(tmp_path / "cp"), summary=str(tmp_path / "sum")).awaitTermination()
    run()
    (src / "a_0002.json").write_text('[{"id": "2", "fiscal_year": "2025", "amount": 9}, {"id": "3", "fiscal_year": "2026", "amount": 1}]')
    run()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1", "2", "3"]
    assert {r["fiscal_year"]: r["total_records"] for r in ingest.read_summary(spark, str(tmp_path / "sum")).collect()} == {"2025": 2, "2026": 1}
    assert tables.read_batches(spark, str(src / "*.json")).count() == 4


def test_a_batch_reads_its_own_buckets_alone(spark, tmp_path):
    """Keys in other buckets cost a batch nothing, however many they are."""
    target, rows = str(tmp_path / "t"), spark.range(4000).select(F.col("id").cast("string").alias("id"), F.lit("2025").alias("fiscal_year"))
    write = lambda df, epoch: df.withColumns({"bucket": ingest.bucket_of("id", 16), "epoch": F.lit(epoch)}).write.mode("append").partitionBy("bucket", "epoch").parquet(target)
    write(rows.where("id < 500"), 0)
    own = [rows.where("id = 7").select(ingest.bucket_of("id", 16)).first()[0]]
    read = lambda: ingest.earlier_keys(spark, target, "id", "string", own, 5)
    before = sorted(read().inputFiles()), read().count()
    write(rows.where((F.col("id") >= 500) & (ingest.bucket_of("id", 16) != own[0])), 1)
    plan = read()._jdf.queryExecution().executedPlan().toString()
    assert read().count() == before[1] > 0 and re.search(r"PartitionFilters: \[[^]]*bucket#\d+ = \d+\)", plan) and "ReadSchema: struct<id:string>" in plan
    assert ingest.earlier_keys(spark, str(tmp_path / "none"), "id", "string", own, 5) is None


def test_ingest_takes_the_first_by_file_and_place(spark, tmp_path):
    """Repeats that differ: within a file the first line, over files the first name, over epochs the earlier; a rerun gives equal rows."""
    src = tmp_path / "in"
    src.mkdir()
    line = lambda i, a: f'{{"id": {i if i is None else chr(34) + i + chr(34)}, "fiscal_year": "2025", "amount": {a}}}'.replace("None", "null") + "\n"
    (src / "b.json").write_text(line("1", 10) + line("2", 20) + line("2", 21) + line("3", 30))
    (src / "a.json").write_text(line("9", 90) + line("2", 25) + line("2", 26) + line(None, 1) + line("9", 91))
    run = lambda name: ingest.ingest(spark, str(src), str(tmp_path / f"{name}-t"), str(tmp_path / f"{name}-c"), multi_line=False, buckets=4, summary=str(tmp_path / f"{name}-s")).awaitTermination()
    rows = lambda name: {r["id"]: float(r["amount"]) for r in spark.read.parquet(str(tmp_path / f"{name}-t")).collect()}
    run("one")
    (src / "0.json").write_text(line("1", 99) + line("4", 40))
    run("one")
    assert rows("one") == {"1": 10.0, "2": 25.0, "3": 30.0, "9": 90.0, "4": 40.0}
    assert {r["fiscal_year"]: (r["total_records"], float(r["total_amount"])) for r in ingest.read_summary(spark, str(tmp_path / "one-s")).collect()} == {"2025": (5, 195.0)}
    run("two")
    assert rows("two") == {"1": 99.0, "2": 25.0, "3": 30.0, "9": 90.0, "4": 40.0}


def test_pages_of_files(spark, tmp_path):
    """One page a file: records, notices, empty files and other text are told apart and counted."""
    record = "x\nCOMPANY DETAILS\nCompany Name\n{}\n\nSEC Number\nCS1\n\nDate Registered\n{}\n\nStatus\nRegistered\n\nAddress\nStreet\n"
    for name, text in {"a": record.format("A CORP", "March 3, 2011"), "b": record.format("B CORP", "2012-01-01"), "c c": "", "d": "\n", "e": "No Record found", "f f": "busy", "g": record.format("C CORP", "soon")}.items():
        (tmp_path / f"{name}.txt").write_text(text)
    got = pages.read_pages(spark, str(tmp_path))
    assert got.count() == 7 and {r["state"]: r["n"] for r in pages.page_counts(got).collect()} == {"record": 3, "empty": 2, "no_record": 1, "other": 1}
    assert [(r["contractor_name"], str(r["date_registered"])) for r in entities.registry_records(got).collect()] == [("B CORP", "2012-01-01")]


def test_year_scan_refuses_bad_years(spark):
    with pytest.raises(ValueError):
        tables.year_scan(spark.range(1), "20x5")
