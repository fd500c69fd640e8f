"""Proximity within equal cost: all pairs and their sums against brute force, over the date line, at the poles and for one very common cost."""

import math
import random

import pytest

from tallyroom.operators import geo

SCHEMA = "id long, cost decimal(12,2), lat double, lng double"


def distance(a, b):
    (p, x), (q, y) = ((math.radians(v) for v in r[2:4]) for r in (a, b))
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin((y - x) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(min(1.0, h)))


def brute(rows, km):
    ok = [r for r in rows if None not in r and -90 <= r[2] <= 90]
    return sorted((a[0], b[0], round(d, 6)) for a in ok for b in ok if a[1] == b[1] and a[0] < b[0] and (d := distance(a, b)) <= km)


def around(rng, n, lat, lng, spread):
    return [(lat + rng.uniform(-1, 1) * spread, lng + rng.uniform(-1, 1) * spread / max(0.02, math.cos(math.radians(min(89.0, abs(lat)))))) for _ in range(n)]


@pytest.mark.parametrize("km, block", [(10.0, 1024), (10.0, 16), (300.0, 16), (9000.0, 1024)])
def test_pairs_and_sums(spark, km, block):
    rng = random.Random(3)
    places = [p for at in ((14.6, 121.0), (0.0, 180.0), (-0.01, -180.0), (89.99, 10.0), (-89.98, 0.0), (65.0, 179.99), (-65.0, -179.99), (45.0, 0.0)) for p in around(rng, 22, *at, 0.12)]
    places = [(max(-90.0, min(90.0, a)), (b + 180) % 360 - 180) for a, b in places]
    rows = [(i, rng.choice([5, 5, 5, 7]), *p) for i, p in enumerate(places)]
    rows += [(900, 5, 14.6, 121.0), (900, 5, 14.6, 121.0), (901, 5, 14.6, 481.0), (902, None, 14.6, 121.0), (903, 5, None, 121.0), (904, 5, 14.6, None), (905, 5, 95.0, 0.0), (906, 7, 14.6, 121.0)]
    from decimal import Decimal

    df = spark.createDataFrame([(i, None if c is None else Decimal(c), a, b) for i, c, a, b in rows], SCHEMA).repartition(5)
    want = brute(rows, km)
    assert len(want) > 300
    got = geo.near_same_cost(df, km=km).collect()
    assert sorted((r["a_id"], r["b_id"], round(r["km"], 6)) for r in got) == want
    s = geo.near_summary(df, km=km, block=block).first()
    d = [x[2] for x in want]
    bands = [sum(a <= x < b for x in d) for a, b in zip(geo.BANDS, geo.BANDS[1:])]
    assert s["pairs"] == len(d) and [s[c] for c in ("km_0_1", "km_1_2", "km_2_5", "km_5_7", "km_7_10")] == bands
    assert s["least_km"] == pytest.approx(min(d), abs=1e-5) and s["most_km"] == pytest.approx(max(d), abs=1e-5) and s["mean_km"] == pytest.approx(sum(d) / len(d), abs=1e-5)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert geo.near_same_cost(df).count() == 0
    s = geo.near_summary(df).first()
    assert s["pairs"] == 0 and s["km_0_1"] == 0 and s["least_km"] is None


def test_one_cost_at_one_place_makes_no_pair_rows(spark):
    """3,000 rows of one cost within 10 km are 4.5 million pairs; a row is copied once for each block that it meets, a block has some 256 homes and as many guests."""
    rng = random.Random(4)
    df = spark.createDataFrame([(i, 5.0, *p) for i, p in enumerate(around(rng, 3000, 14.6, 121.0, 0.02))], "id long, cost double, lat double, lng double").repartition(4)
    met = geo._dealt(geo._placed(df, "cost", 10.0, ()), 256)
    assert met.count() < 3000 * 2 * 13 * 3
    assert met.groupBy("cost", "cy", "cx", "u", "w").count().agg({"count": "max"}).first()[0] < 2 * 2 * 256
    assert geo.near_summary(df, block=256).first()["pairs"] == 3000 * 2999 // 2
    plan = geo.near_summary(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # with the sizes of the cells
