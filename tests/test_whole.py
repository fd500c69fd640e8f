"""Queries do the whole job: nothing is left out of tables, texts or groups."""

import difflib
import importlib
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyroom import plans
from tallyroom.operators import duplicates, matching, rollups
from tallyroom.plans.proxies import read

SF = "/root/testdata/sf0.001"


def test_band_counts_of_whole_tables(spark):
    rng = np.random.default_rng(3)
    a = [(i % 50, float(x)) for i, x in enumerate(np.round(rng.uniform(-5, 400, 70), 1))] + [(7, None), (60, 100.0), (61, 1e6)]
    b = [(float(x),) for x in np.round(rng.uniform(-5, 400, 90), 1)] + [(100.0,), (95.0,), (105.0,), (None,), (0.0,)]
    want = {}
    for k, x in a:
        n = sum(x is not None and y is not None and x > 0 and y > 0 and abs(x - y) / max(x, y) <= 0.05 for (y,) in b)
        if n:
            want[k] = want.get(k, 0) + n
    got = matching.band_counts(spark.createDataFrame(a, "k long, x double"), spark.createDataFrame(b, "y double"), "k", "x", "y", 5.0)
    assert {r["k"]: r["n"] for r in got.collect()} == want


def test_band_join_whole_is_not_cut_by_ids(spark):
    sf = SF
    amounts = [(r["id"], float(r["amount"])) for r in read(spark, sf, "contract").select("id", "amount").collect()]
    costs = np.array([float(r["cost"]) for r in read(spark, sf, "project").select("cost").collect()])
    want = {i: int((np.abs(x - costs) / np.maximum(x, costs) <= 0.05).sum()) for i, x in amounts}
    assert {r["contract_id"]: r["n"] for r in plans.QUERIES["j4_band_join_whole"](spark, sf).collect()} == {i: n for i, n in want.items() if n}


def ratio(a, b, metric):
    if metric == "gestalt":
        return difflib.SequenceMatcher(None, a, b).ratio()
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return 1 - row[-1] / max(1, len(a), len(b))


@pytest.mark.parametrize("metric", ["levenshtein", "gestalt"])
@pytest.mark.parametrize("least", [0.6, 0.8, 0.9])
def test_similar_names_lose_no_pair(spark, metric, least):
    """Names of all lengths, with repeats of letters, swaps and cuts, against all pairs."""
    rng = np.random.default_rng(int(least * 10))
    base = ["", "a", "ab", "aab", "MAGUINDANAO DEL NORTE", "MAGUINDANAO DEL SUR", "aaaaaaaaaa", "ababababab", "JOSE & SONS", "JOSE AND SONS", None]
    names = base + ["".join(rng.choice(list("abcd "), int(rng.integers(1, 30)))) for _ in range(30)]
    for x in [n for n in names if n][:25]:
        w = list(x)
        for _ in range(int(rng.integers(1, 4))):
            k = int(rng.integers(0, len(w) + 1))
            w[k : k + int(rng.integers(0, 2))] = list(rng.choice(list("abcd"), int(rng.integers(0, 2))))
        names.append("".join(w))
    left, right = names[::2] + base, names[1::2] + base
    a, b = (spark.createDataFrame([(x,) for x in n], "n string") for n in (left, right))
    got = {(r["a"], r["b"]): r["ratio"] for r in matching.similar_names(a, b, "n", "n", least, metric).collect()}
    want = {(x, y): ratio(x, y, metric) for x in set(left) - {None} for y in set(right) - {None}}
    want = {k: v if any(k) else 1.0 for k, v in want.items() if v >= least or not any(k)}
    assert set(got) == set(want) and all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_few_pairs_of_unlike_names_meet(spark):
    """Of names that share no more than chance, few pairs are compared."""
    rng = np.random.default_rng(3)
    names = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 24)) for _ in range(300)]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    one, two = df.select(F.col("n").alias("a")), df.select(F.col("n").alias("b"))
    pairs = matching.likely_pairs(one, two, 0.85).where("a < b").count()
    assert pairs < 0.05 * 300 * 299 / 2


def test_containing_names(spark):
    a, b = ["quezon city", "city", "x", "ab", ""], ["city", "quezon", "ab", "abc", "x"]
    got = matching.containing(spark.createDataFrame([(x,) for x in a], "a string"), spark.createDataFrame([(x,) for x in b], "b string"), "a", "b").collect()
    assert sorted(map(tuple, got)) == sorted((x, y) for x in a for y in b if y in x)


def _names(spark, which):
    keep = (0, 4) if which else (1, 2, 3, 5)
    return sorted({r["contractor_name"] for r in read(spark, SF, "contractor_name").collect() if r["id"] % 6 in keep})


def test_membership_by_gestalt(spark):
    from tallyroom.functions.columns import standard_name

    norm = lambda names: {r["n"]: r["s"] for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", standard_name(F.col("n"), "token").alias("s")).collect()}
    registry, fresh = norm(_names(spark, True)), norm(_names(spark, False))
    want = {n: any(ratio(s, f, "gestalt") >= 0.9 for f in fresh.values()) for n, s in registry.items()}
    assert {r["contractor_name"]: r["seen"] for r in plans.QUERIES["e6_membership_gestalt"](spark, SF).collect()} == want


def test_match_by_place_by_gestalt(spark):
    """Places that difflib calls alike link, also where none holds the other."""
    c = spark.createDataFrame([(1, 100.0, "MAGUINDANAO DEL SOR", "A"), (2, 100.0, "CEBU CITY", "A"), (3, 100.0, "ILOILO", "A")], "id long, amount double, area_of_delivery string, awardee string")
    p = spark.createDataFrame([(7, 100.0, "MAGUINDANAO DEL NORTE", "A"), (8, 100.5, "CEBU", "A"), (9, 100.0, "BOHOL", "A")], "id long, cost double, province string, contractor string")
    got = {(r["contract_id"], r["project_id"]) for r in matching.match_by_place(c, p, metric="gestalt").collect()}
    assert got == {(1, 7), (2, 8)}
    plan = matching.match_by_place(c, p, metric="gestalt")._jdf.queryExecution().optimizedPlan().toString()
    assert "CartesianProduct" not in plan


def test_numbers_over_a_whole_order(spark):
    rng = np.random.default_rng(5)
    rows = [(int(g), None if x == 7 else int(x), i) for i, (g, x) in enumerate(zip(rng.integers(0, 3, 900), rng.integers(0, 60, 900)))]
    df = spark.createDataFrame(rows, "g int, x int, i int").repartition(7)
    order = lambda r: (r[1] is not None, r[1] or 0, r[2])
    got = {r["i"]: r["position"] for r in rollups.numbered(df, "x", "i", parts=8).collect()}
    assert got == {r[2]: k for k, r in enumerate(sorted(rows, key=order), 1)}
    got = {r["i"]: r["position"] for r in rollups.numbered(df, "x", "i", partition=("g",), parts=8).collect()}
    assert got == {r[2]: k for g in range(3) for k, r in enumerate(sorted((r for r in rows if r[0] == g), key=order), 1)}
    assert rollups.numbered(df.limit(0), "x").count() == 0


def test_neighbour_pairs(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("a", 2), ("b", 1), (None, 4), (None, 5)], "k string, i int")
    got = sorted((r["k"], r["i"], r["other"]) for r in duplicates.neighbour_pairs(df, ["k"], "i").collect())
    assert got == [("a", 1, 2), ("a", 2, 3)]


def test_invalid_descriptions_are_no_duplicates(spark):
    df = spark.createDataFrame([(1, "INVALID", 5.0), (2, "INVALID", 5.0), (3, "road", 5.0), (4, "road", 5.0), (5, "road", 6.0)], "sorder int, dsc string, amt_coarse double")
    assert sorted(r["sorder"] for r in duplicates.tiered_duplicates(df, "sorder").collect()) == [3, 4]


def test_entry_without_the_llm_folder(monkeypatch):
    """Without the subpackage the other queries load, also where corpus_pipeline.py is left."""
    import __spark_entry__ as e

    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith("tallyroom.llm") else real(name, *a))
    monkeypatch.delitem(sys.modules, "corpus_pipeline", raising=False)
    assert set(e.queries()) == set(plans.QUERIES) and set(e.oracle_sql()) == set(plans.ORACLES)
