"""Matching, duplicates and quantiles against brute force, and how much work their plans do."""

import difflib
import math
import random
from collections import Counter
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyroom import plans
from tallyroom.functions.columns import standard_name
from tallyroom.operators import duplicates, matching, rollups
from tallyroom.plans.proxies import read

SF, SF2 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def edit_ratio(a, b):
    if not a and not b:
        return 1.0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return 1 - row[-1] / max(len(a), len(b))


RATIO = {"levenshtein": edit_ratio, "gestalt": lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()}


def normal(spark, names, variant, upper=False):
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", standard_name(F.col("n"), variant).alias("s")).collect()
    return {r["n"]: r["s"].upper() if upper else r["s"] for r in got}


def contractors(spark, which, sf=SF):
    keep = (0, 4) if which else (1, 2, 3, 5)
    return sorted({r["contractor_name"] for r in read(spark, sf, "contractor_name").collect() if r["id"] % 6 in keep})


# J4 -------------------------------------------------------------------------


def test_band_ends_are_those_of_the_test(spark):
    """The ends are the outermost doubles that pass, bit for bit."""
    rng = np.random.default_rng(1)
    amounts = [*np.round(rng.uniform(0.01, 1e9, 300), 2).tolist(), *rng.uniform(1e-9, 1e15, 300).tolist(), 1.0, 2.0, 1024.0, 0.95, 1 / 3]
    for percent in (5.0, 1.0, 0.0, 50.0, 33.3):
        low, high = matching._band_ends(F.col("x"), percent)
        passes = lambda x, y: abs(x - y) / max(x, y) <= percent / 100
        for r in spark.createDataFrame([(x,) for x in amounts], "x double").select("x", low.alias("low"), high.alias("high")).collect():
            assert passes(r["x"], r["low"]) and not passes(r["x"], math.nextafter(r["low"], 0))
            assert passes(r["x"], r["high"]) and not passes(r["x"], math.nextafter(r["high"], math.inf))


def test_band_counts_make_no_pairs(spark):
    """A thousand equal amounts on both sides are a million pairs, and no join has that many rows."""
    a = spark.createDataFrame([(i, 100.0) for i in range(1000)] + [(5000, math.nan), (5001, math.inf), (5002, -1.0), (5003, None), (5004, 1e-300)], "k long, x double")
    got = matching.band_counts(a, a.withColumnRenamed("x", "y"), "k", "x", "y", 5.0)
    assert {(r["k"], r["n"]) for r in got.collect()} == {(i, 1000) for i in range(1000)} | {(5004, 1)}
    with pytest.raises(ValueError):
        matching.band_counts(a, a, "k", "x", "x", 60.0)


def test_running_totals_of_a_frequent_first_value(spark):
    rows = [(1 if i % 3 else i % 50, i * 7919 % 1000, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "x int, y int, n int").repartition(6)
    got = {r["n"]: r["running"] for r in rollups.running_total(df, F.col("n"), "x", "y", "n", parts=16).collect()}
    total, want = 0, {}
    for r in sorted(rows):
        total += r[2]
        want[r[2]] = total
    assert got == want
    counts = df.withColumn("range", rollups._ranges(df, ("x", "y", "n"), 16)).groupBy("range").count().collect()
    assert len(counts) > 8 and max(r["count"] for r in counts) < 600  # two thirds of the rows have the same x


# J6 -------------------------------------------------------------------------


@pytest.mark.parametrize("metric", ["levenshtein", "gestalt"])
def test_few_of_all_real_names_meet(spark, metric):
    """Names that share their endings: below 5 % of all pairs are compared, and none that is alike is missing."""
    a, b = contractors(spark, False, SF2), contractors(spark, True, SF2)
    x, y = spark.createDataFrame([(n,) for n in a], "a string"), spark.createDataFrame([(n,) for n in b], "b string")
    met = {tuple(r) for r in matching.likely_pairs(x, y, 0.8, metric).collect()}
    assert len(met) < 0.05 * len(a) * len(b)
    if metric == "gestalt":
        assert {(p, q) for p in a for q in b if RATIO[metric](p, q) >= 0.8} <= met


@pytest.mark.parametrize("least", [0.5, 0.7, 0.85])
@pytest.mark.parametrize("metric", ["levenshtein", "gestalt"])
def test_no_pair_is_lost(spark, metric, least):
    """Edits at all places of names of all lengths, and letters beyond the basic plane."""
    rng = random.Random(int(least * 100))
    base = ["ACME BUILDERS", "Ñandú", "a", "ab", "abc", "😀😀b", "x" * 40, "AB" * 15] + ["".join(rng.choices("abc", k=rng.randint(1, 25))) for _ in range(25)]
    names = set(base)
    for n in base:
        for _ in range(3):
            w = list(n)
            for _ in range(rng.randint(1, max(1, len(w) // 3))):
                k = rng.randint(0, len(w))
                w[k : k + rng.randint(0, 1)] = rng.choices("abcX", k=rng.randint(0, 1))
            names.add("".join(w))
    a, b = sorted(names)[::2], sorted(names)[1::2] + base
    got = matching.similar_names(spark.createDataFrame([(n,) for n in a], "n string"), spark.createDataFrame([(n,) for n in b], "n string"), "n", "n", least, metric)
    want = {(p, q) for p in a for q in set(b) if (p or q) and RATIO[metric](p, q) >= least and (p == q or p and q)}
    assert {(r["a"], r["b"]) for r in got.collect()} == want


# E7 to E10 ------------------------------------------------------------------


@pytest.mark.parametrize("ranges", [1, 7])
def test_a_long_chain_decides(spark, ranges):
    """n00001 - n00002 - ...: every second is kept, however long the chain, in no more rounds than ranges."""
    n = 10_000
    nodes = spark.range(n).select(F.format_string("n%05d", "id").alias("name"))
    links = spark.range(1, n).select(F.format_string("n%05d", "id").alias("name"), F.format_string("n%05d", F.col("id") - 1).alias("other"))
    got = {r["name"] for r in matching.first_independent(nodes, links, names_a_range=-(-n // ranges)).collect()}
    assert got == {f"n{i:05d}" for i in range(0, n, 2)}


@pytest.mark.parametrize("seed", range(3))
def test_first_independent_names_of_random_links(spark, seed):
    rng = random.Random(seed)
    names = [f"{rng.randrange(10**6):06d}é" for _ in range(300)]
    names = sorted(set(names))
    links = {tuple(sorted(rng.sample(names, 2), reverse=True)) for _ in range(500)} | {(x, names[0]) for x in names[1:150]}
    kept = []
    for x in names:
        if not any((x, y) in links for y in kept):
            kept.append(x)
    got = matching.first_independent(spark.createDataFrame([(x,) for x in names], "name string"), spark.createDataFrame(sorted(links), "name string, other string"), names_a_range=40)
    assert sorted(r["name"] for r in got.collect()) == kept


@pytest.mark.parametrize("query,metric", [("e7_greedy_new_names", "levenshtein"), ("e7_greedy_new_names_gestalt", "gestalt")])
def test_greedy_new_names_by_brute_force(spark, query, metric):
    fresh, old = normal(spark, contractors(spark, False), "substring"), set(normal(spark, contractors(spark, True), "substring").values())
    like = RATIO[metric]
    kept = []
    for n in sorted(fresh):
        if not any(like(fresh[n], o) >= 0.85 for o in old) and not any(like(fresh[n], fresh[k]) >= 0.85 for k in kept):
            kept.append(n)
    assert sorted(r["name"] for r in plans.QUERIES[query](spark, SF).collect()) == kept


def test_best_registry_match_by_gestalt(spark):
    fresh, old = (normal(spark, contractors(spark, k), "suffix", upper=True) for k in (False, True))
    want = {}
    for n, s in fresh.items():
        for k, t in old.items():
            r = RATIO["gestalt"](s, t)
            if s == t or r > 0.9 or (r > 0.8 and len(set(s.split()) & set(t.split())) >= 2):
                want[n] = min(want.get(n, (9, "")), (-r, k))
    got = {r["name"]: (r["match"], r["ratio"]) for r in plans.QUERIES["e8_best_registry_match_gestalt"](spark, SF).collect()}
    assert got == {n: (k, round(-r, 2)) for n, (r, k) in want.items()} and got


def title_ratio(a, b, like):
    return like(a, b) if a and b else 0.0


def best_by_amount(contracts, projects, titles, like):
    best = {}
    for c in contracts:
        for p in projects:
            if c["amount"] is None or c["amount"] <= 0 or c["amount"] != p["cost"]:
                continue
            t = max(title_ratio(titles[c[x]], titles[p["project_name"]], like) for x in ("award_title", "notice_title"))
            x, y = c["awardee"].strip().upper(), p["contractor"].strip().upper()
            n = 1.0 if x == y else 0.9 if x in y or y in x else like(x, y)
            score = round((t * 0.6 + n * 0.4) * 100, 2)
            if score >= 60:
                best[c["id"]] = min(best.get(c["id"], (0, 0)), (-score, p["id"]))
    return {k: (p, -s) for k, (s, p) in best.items()}


def test_match_by_amount_by_gestalt(spark):
    contracts, projects = read(spark, SF, "contract").collect(), read(spark, SF, "project").collect()
    names = {x for c in contracts for x in (c["award_title"], c["notice_title"])} | {p["project_name"] for p in projects}
    want = best_by_amount(contracts, projects, normal(spark, names, "title"), RATIO["gestalt"])
    got = {r["contract_id"]: (r["project_id"], r["score"]) for r in plans.QUERIES["e9_match_by_amount_gestalt"](spark, SF).collect()}
    assert got == want and got


@pytest.mark.parametrize("metric", ["levenshtein", "gestalt"])
def test_titles_that_say_nothing_match_nothing(spark, metric):
    """Equal amounts alone link no projects: empty titles have a likeness of 0, not 1."""
    c = [(1, 5.0, "ROAD CONSTRUCTION", None, "ABC"), (2, 5.0, None, None, "XYZ"), (3, 5.0, "Flood wall at Pasig", "", "XYZ"), (4, 5.0, "", "BRIDGE PROJECT", "QQ"), (3, 5.0, "Flood wall at Pasig", "", "XYZ"), (None, 5.0, "Flood wall at Pasig", "", "XYZ")]
    p = [(7, 5.0, "BRIDGE PROJECT", "DEFG"), (8, 5.0, None, "HIJK"), (9, 5.0, "Flood wall at Pasig", "XYZ"), (6, 5.0, "Flood wall at Pasig", "XYZ"), (5, 6.0, "Flood wall at Pasig", "XYZ")]
    contracts = spark.createDataFrame(c, "id long, amount double, award_title string, notice_title string, awardee string")
    projects = spark.createDataFrame(p, "id long, cost double, project_name string, contractor string")
    got = [(r["contract_id"], r["project_id"], r["score"]) for r in matching.match_by_amount(contracts, projects, metric=metric).collect()]
    assert sorted(got, key=repr) == sorted([(3, 6, 100.0), (3, 6, 100.0), (None, 6, 100.0)], key=repr)


def test_match_by_place_query_by_gestalt(spark):
    like = RATIO["gestalt"]
    contracts, projects = read(spark, SF, "contract").collect(), read(spark, SF, "project").collect()
    place = normal(spark, {c["area_of_delivery"] for c in contracts} | {p["province"] for p in projects}, "place")
    costs = sorted((float(p["cost"]), p["id"], place[p["province"]], p["contractor"].strip().upper()) for p in projects)
    best = {}
    for c in contracts:
        money, area, who = float(c["amount"]), place[c["area_of_delivery"]], c["awardee"].strip().upper()
        for cost, pid, prov, con in costs:
            off = abs(money - cost) / max(money, cost) * 100
            if money <= 0 or cost <= 0 or off > 1:
                continue
            by_amount = 1.0 if money == cost else 1.0 - off / 5.0
            at = 1.0 if area and prov and (area in prov or prov in area) and len(prov) > 3 else like(area, prov)
            if by_amount < 0.8 or at < 0.8:
                continue
            r = like(who, con)
            names = 1.0 if who == con else 0.9 if who in con or con in who else r if r > 0.6 else 0.0
            score = round((at * 0.5 + by_amount * 0.4 + names * 0.1) * 100, 2)
            if score >= 85:
                best[c["id"]] = min(best.get(c["id"], (0, 0)), (-score, pid))
    got = {r["contract_id"]: (r["project_id"], r["score"]) for r in plans.QUERIES["e10_match_by_place_gestalt"](spark, SF).collect()}
    assert got.keys() == best.keys() and sum(got[k] == (p, -s) for k, (s, p) in best.items()) >= len(best) - 2  # last places of rounded halves


def half_up(x):
    return float(Decimal(repr(x)).quantize(Decimal("0.01"), ROUND_HALF_UP))


def best_by_place(contracts, projects, metric):
    """Names of places are as they are after normalising."""
    like, best = RATIO[metric], {}
    near = lambda a, b: 1.0 if (a in b or b in a) and len(b) > 3 else like(a, b)
    for i, money, area, who in contracts:
        for j, cost, place, con in projects:
            if not (money and cost and math.isfinite(money) and money > 0 and area and place) or abs(money - cost) / max(money, cost) > 0.01:
                continue
            by_amount, at = 1.0 if money == cost else 1.0 - abs(money - cost) / max(money, cost) * 100 / 5.0, near(area, place)
            if metric == "gestalt":
                r = like(who or "", con or "")
            else:
                r = 0.0 if None in (who, con) and (who or con or who == con) else like(who or "", con or "")  # as lev_ratio has it
            names = 1.0 if None not in (who, con) and who == con else 0.9 if None not in (who, con) and (who in con or con in who) else r if r > 0.6 else 0.0
            score = half_up((at * 0.5 + by_amount * 0.4 + names * 0.1) * 100)
            if at >= 0.8 and by_amount >= 0.8 and score >= 85:
                best[i] = min(best.get(i, (0, 0)), (-score, -1 if j is None else j))
    return {i: (None if j == -1 else j, -s) for i, (s, j) in best.items()}


@pytest.mark.parametrize("metric", ["levenshtein", "gestalt"])
@pytest.mark.parametrize("rings", [None, [0.01 / 64, 0.01 / 8, 0.01]])
def test_match_by_place_by_brute_force(spark, monkeypatch, metric, rings):
    """Crowded amounts, names alike, held, missing and empty, places alike and held, ids and rows that come twice."""
    rng = random.Random(8)
    place = lambda: rng.choice(["SAMAR", "NORTH SAMAR", "SAMAR NORD", "SOUTH SAMAR", "CEBU", "CEBU", "CEBO", "LUZ", "", None])
    name = lambda: rng.choice([None, "", "ABC", "ABC BUILDERS", "É BAU"] + [f"FIRM {rng.choice('0123')}{rng.choice('0123')}{rng.choice('01234567')}" for _ in range(14)])
    money = lambda: rng.choice([100.0, 100.0, 101.0, 99.0, round(rng.uniform(97, 103), 2), round(rng.uniform(99.9, 100.1), 4), round(1e6 * rng.uniform(0.98, 1.02), 2)])
    contracts = [(i % 230, money(), place(), name()) for i in range(260)] + [(900, None, "CEBU", "ABC"), (901, -5.0, "CEBU", "ABC"), (902, math.nan, "CEBU", "ABC"), (903, math.inf, "CEBU", "ABC"), (904, 0.0, "CEBU", "ABC")]
    projects = [(i % 320 + 1, money(), place(), name()) for i in range(340)] + [(None, 100.0, "CEBU", "FIRM 000"), (990, math.inf, "CEBU", "ABC"), (991, None, "CEBU", "ABC"), (992, math.nan, "CEBU", "ABC")]
    contracts, projects = contracts + contracts[:5], projects + projects[:5]
    c = spark.createDataFrame(contracts, "id long, amount double, area_of_delivery string, awardee string").repartition(3)
    p = spark.createDataFrame(projects, "id long, cost double, province string, contractor string").repartition(3)
    if rings:
        monkeypatch.setattr(matching, "_rings", lambda there, percent: [*rings])
    want = best_by_place(contracts, [x for x in projects if x[1] is not None and math.isfinite(x[1])], metric)
    got = {r["contract_id"]: (r["project_id"], r["score"]) for r in matching.match_by_place(c, p, metric=metric).collect()}
    assert got == want and len(want) > 120


def shuffled(spark, run):
    """Rows that all stages of run() sent through shuffles."""
    gateway = spark.sparkContext._gateway
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    known = {stages().apply(i).stageId() for i in range(stages().size())}
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    now = stages()
    return sum(now.apply(i).shuffleWriteRecords() for i in range(now.size()) if now.apply(i).stageId() not in known)


@pytest.mark.parametrize("metric", ["levenshtein", "gestalt"])
def test_match_by_place_sends_no_pairs(spark, metric):
    """2,000 contracts and 2,000 projects of one place within 1 % are four million pairs; no shuffle has them."""
    rng = random.Random(9)
    c = spark.createDataFrame([(i, rng.uniform(1000, 1009), "CEBU", f"FIRM {rng.randrange(10**6):06d}") for i in range(2000)], "id long, amount double, area_of_delivery string, awardee string")
    p = spark.createDataFrame([(i, rng.uniform(1000, 1009), "CEBU", f"FIRM {rng.randrange(10**6):06d}") for i in range(2000)], "id long, cost double, province string, contractor string")
    got = []
    assert shuffled(spark, lambda: got.extend(matching.match_by_place(c, p, metric=metric).collect())) < 100_000
    assert len(got) == 2000


def test_gestalt_ratio_is_that_of_difflib(spark):
    """Short and long texts of few letters, which tie often, in both orders; from 200 letters on difflib leaves out common ones."""
    rng = random.Random(10)
    text = lambda al, n: "".join(rng.choice(al) for _ in range(rng.randrange(n)))
    pairs = [(text(al, n), text(al, m)) for al in ("ab", "abcd", "ABCDEFG 0123", "é漢𝄞a") for n in (3, 25, 230) for m in (3, 25, 230) for _ in range(40)]
    pairs += [(None, "a"), (None, None), ("", ""), ("a" * 300, "a" * 199), ("a" * 199, "a" * 300)]
    got = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a string, b string").select("k", matching.gestalt_ratio("a", "b").alias("r")).collect()
    assert {r["k"]: r["r"] for r in got} == {k: RATIO["gestalt"](a or "", b or "") for k, (a, b) in enumerate(pairs)}
    calls = []
    one = difflib.SequenceMatcher
    try:
        difflib.SequenceMatcher = lambda *a: calls.append(a) or one(*a)
        matching.gestalt_ratio.func(*(pd.Series([f"FIRM {k + j}" for k in range(1000)]) for j in (0, 7)))
    finally:
        difflib.SequenceMatcher = one
    assert not calls  # names are compared many at a time


# D3 -------------------------------------------------------------------------


def test_tiers_by_brute_force(spark):
    rng = random.Random(2)
    cols = ["agency", "department", "fundcd", "uacs_exp_cd", "operunit", "uacs_operdiv_id", "uacs_reg_id"]
    pick = lambda: rng.choice([1, 2, 3, 4, 5, None])
    rows = [(i % 250, rng.choice(["road", "bridge", "INVALID", None, ""]), rng.choice([1.0, 2.0, None]), *[pick() for _ in cols]) for i in range(300)]
    rows += [(1000 + i, "hot", 9.0, i, i % 7, None, 3, i % 3, None, None) for i in range(200)] + [rows[5]] * 3
    known = [dict(zip(["sorder", "dsc", "amt", *cols], r)) for r in rows]
    good = [r for r in known if r["dsc"] not in (None, "", "INVALID") and r["amt"] is not None]
    want = []
    for r in good:
        for name, keys in duplicates.TIERS:
            if all(r[k] is not None for k in keys) and sum(all(o[k] == r[k] for k in ["dsc", "amt", *keys]) for o in good) > 1:
                want.append((r["sorder"], name))
                break
    df = spark.createDataFrame(rows, "sorder int, dsc string, amt double, " + ", ".join(f"{c} int" for c in cols)).repartition(4)
    got = duplicates.tiered_duplicates(df, "sorder", "dsc", "amt")
    assert sorted((r["sorder"], r["tier"]) for r in got.collect()) == sorted(want)
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def tiers_of(rows, cols, left_out=()):
    """(sorder, tier) of rows (sorder, dsc, amt, *cols) by brute force."""
    known = [r for r in (dict(zip(["sorder", "dsc", "amt", *cols], r)) for r in rows) if r["dsc"] not in (None, "", "INVALID") and r["amt"] is not None]
    seen = [Counter(tuple(r[k] for k in ["dsc", "amt", *keys]) for r in known) for keys in ([k for k in keys if k not in left_out] for _, keys in duplicates.TIERS)]
    found = []
    for r in known:
        for (name, keys), n in zip(duplicates.TIERS, seen):
            key = tuple(r[k] for k in ["dsc", "amt", *[k for k in keys if k not in left_out]])
            if None not in key and n[key] > 1:
                found.append((r["sorder"], name))
                break
    return found


@pytest.mark.parametrize("left_out", [(), ("department",), ("agency", "uacs_reg_id"), ("agency", "department")])
@pytest.mark.parametrize("size, most", [(1 << 17, 1 << 20), (40, 1 << 20), (40, 60)])
def test_tiers_in_batches_by_brute_force(spark, left_out, size, most):
    """Also with groups longer than what a task takes at a time or at all, with one hot row, and with codes that change places with nulls."""
    rng = random.Random(11)
    cols = ["agency", "department", "fundcd", "uacs_exp_cd", "operunit", "uacs_operdiv_id", "uacs_reg_id"]
    pick = lambda *x: rng.choice([*x, None])
    rows = [(rng.choice(["road", "bridge", "dam", "INVALID"]), rng.choice([1.0, 2.0, 3.0]), pick("A", "B", "C"), pick(1, 2, 3, 4), pick(1, 2, 3), pick(1, 2, 3), pick(*range(9)), pick(1, 2), pick(1, 2)) for _ in range(500)]
    rows += [("hot", 9.0, "A", 1, k % 7, k % 5, k % 90, None, k % 3) for k in range(400)] + [("hot", 9.0, "A", 2, 1, 1, 1, 1, 1)] * 300 + [("hot", 8.0, None, None, 1, 1, 1, 1, 1)] * 150
    rows += [("swap", 1.0, None, 5, 1, 7, 1, 1, 1), ("swap", 1.0, "5", None, 2, None, 7, 1, 1), ("swap", 1.0, None, 5, 3, 8, 1, 1, None), ("alone", 1.0, "A", 1, 1, 1, 1, 1, 1)]
    rows = [(i, *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "sorder int, dsc string, amt double, agency string, " + ", ".join(f"{c} int" for c in cols[1:])).repartition(5).drop(*left_out)
    want = tiers_of(rows, cols, left_out)
    got = duplicates.tiered_duplicates(df, "sorder", "dsc", "amt", size=size, most=most)
    assert sorted((r["sorder"], r["tier"]) for r in got.collect()) == sorted(want)
    sizes = {r["tier"]: (r["n"], r["score"]) for r in duplicates.tier_sizes(df, "dsc", "amt", size=size, most=most).collect()}
    assert sizes == {t: (n, round(int(t[0]) / 9 * 100, 1)) for t, n in Counter(t for _, t in want).items()}


def test_tier_query_sends_a_row_once(spark):
    """Of 20,000 rows each is sent to those of its description, amount, agency and department; no row is sent for each tier."""
    rng = random.Random(12)
    cols = ["agency", "department", "fundcd", "uacs_exp_cd", "operunit", "uacs_reg_id"]
    rows = [(i, rng.choice(["road", "bridge", "dam"]), rng.choice([1.0, 2.0]), *[rng.randrange(5) for _ in cols]) for i in range(20_000)]
    df = spark.createDataFrame(rows, "sorder int, dsc string, amt_coarse double, " + ", ".join(f"{c} int" for c in cols)).repartition(4).checkpoint()
    got = []
    assert shuffled(spark, lambda: got.extend(duplicates.tier_sizes(df).collect())) < 40_000
    assert sum(r["n"] for r in got) == 20_000
    import __spark_entry__ as e

    assert shuffled(spark, lambda: e.queries()["d3_tiered_duplicates"](spark, SF).collect()) < 60_000  # of 6,000 rows


# G25 ------------------------------------------------------------------------


@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.9, 1.0])
def test_exact_quantiles(spark, q):
    """Also with a coarse sketch, so that the bracket matters, with ties, and with groups of one row."""
    rng = np.random.default_rng(4)
    groups = {"a": rng.normal(size=5000).round(3), "b": np.repeat([1.0, 2.0], [1500, 1500]), "c": [7.0], "d": rng.exponential(size=333) ** 4, None: rng.integers(0, 9, 2001).astype(float)}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("e", None), ("e", math.nan), ("a", None)]
    got = rollups.exact_quantile(spark.createDataFrame(rows, "g string, x double").repartition(5), ["g"], "x", q, accuracy=50)
    got = {r["g"]: r["quantile"] for r in got.collect()}
    assert set(got) == set(groups) and all(abs(got[g] - np.quantile(xs, q)) < 1e-9 for g, xs in groups.items())
