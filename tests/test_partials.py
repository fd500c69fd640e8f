"""Partial aggregates that are merged equal a recount, also after one year was refreshed."""

import random

from tallyroom.operators import partials


def recount(rows, years):
    out = {}
    for scope in [*years, None]:
        of = [r for r in rows if r[0] in years and scope in (None, r[0])]
        if of:
            out["all_years" if scope is None else str(scope)] = (len(of), sum(r[1] for r in of if r[1] is not None), len({r[2] for r in of} - {None}), len({r[3] for r in of} - {None}))
    return out


def test_merged_equals_recount(spark, tmp_path):
    rng = random.Random(1)
    make = lambda years, n: [(rng.choice(years), rng.choice([1, 5, None]), rng.choice(["a", "b", "", None, "INVALID", *map(str, range(40))]), rng.randrange(500)) for _ in range(n)]
    schema, path = "y int, amt int, d string, k int", str(tmp_path / "p")
    rows = make([2019, 2020, 2021], 3000) + [(None, 1, "x", 1)]
    store = lambda r: partials.refresh(spark.createDataFrame(r, schema).repartition(3), path, year="y", amount="amt", distinct=["d", "k"])

    def got(years=None):
        return {r["scope"]: (r["n"], int(r["total"] or 0), r["d"], r["k"]) for r in partials.merged(spark, path, ["d", "k"], years).collect()}

    store(rows)
    assert got() == recount(rows, [2019, 2020, 2021])
    fresh = make([2020], 700) + make([2024], 1)
    store(fresh)  # 2020 changes, 2024 is new, the others are as they were
    rows = [r for r in rows if r[0] != 2020] + fresh
    assert got() == recount(rows, [2019, 2020, 2021, 2024])
    assert got([2019, 2024]) == recount(rows, [2019, 2024])
    about = {r["scope"]: r["about_k"] for r in partials.merged(spark, path, ["d", "k"]).collect()}
    assert abs(about["all_years"] - recount(rows, [2019, 2020, 2021, 2024])["all_years"][3]) <= 0.05 * 500
