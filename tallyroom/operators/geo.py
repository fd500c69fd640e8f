"""Co-location screens."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import haversine_km


DEGREE = 111.0  # km a degree of latitude, rounded down so that cells are rather too large


def _reach(lat: Column, km: float) -> Column:
    """Degrees of longitude that a place within km can be away; near a pole, all of them."""
    step = math.radians(km / DEGREE)
    room = F.radians(F.abs(lat)) + step < math.pi / 2
    return F.when(room, F.degrees(F.asin(F.least(F.lit(1.0), math.sin(min(step, math.pi / 2)) / F.cos(F.radians(lat)))))).otherwise(360.0)


def _columns(cy: Column, km: float) -> Column:
    """Cells of a band of latitude: each as wide as the reach at the band's end nearer to a pole; one where three don't fit."""
    step = km / DEGREE
    end = F.greatest(F.abs(cy * step - 90), F.abs((cy + 1) * step - 90))
    n = F.floor(360 / _reach(F.least(F.lit(90.0), end), km))
    return F.when(n >= 3, n).otherwise(1)


def _placed(df: DataFrame, cost: str, km: float, columns: tuple[str, ...]) -> DataFrame:
    """Rows by cost and cell of the globe, so that those of equal cost within km meet exactly once.

    A row is at home in its cell and visits the cells after it (to the east in its
    own band, all within reach in the next), so that of two neighbours one visits the
    other. Guests of a cell are its visitors and its homes once more ("again"). Longitudes wrap.
    Rows without id, cost or place, and latitudes beyond 90, meet nothing.
    """
    step = km / DEGREE
    lat, lng = F.col("lat").cast("double"), F.col("lng").cast("double")
    keep = list(dict.fromkeys(["id", "lat", "lng", *columns]))
    base = df.where(F.col(cost).isNotNull() & F.col("id").isNotNull() & lat.between(-90, 90) & (F.abs(lng) < float("inf")))
    base = base.select(F.col(cost).alias("cost"), F.struct(*keep).alias("row"), lat.alias("lat"), F.pmod(lng + 180, F.lit(360.0)).alias("east"), F.floor((lat + 90) / step).alias("cy"))
    base = base.withColumns({"n": _columns(F.col("cy"), km), "n2": _columns(F.col("cy") + 1, km), "reach": _reach(F.col("lat"), km)})
    cell = lambda x, n: F.floor(x * F.col(n) / 360)
    base = base.withColumns({"cx": F.pmod(cell(F.col("east"), "n"), F.col("n")), "last": cell(F.col("east") + F.col("reach"), "n"), "low": cell(F.col("east") - F.col("reach"), "n2"), "high": cell(F.col("east") + F.col("reach"), "n2")})
    at = lambda y, x, kind: F.struct(y.alias("cy"), x.cast("long").alias("cx"), F.lit(kind).alias("kind"))
    home = F.array(at(F.col("cy"), F.col("cx"), "home"), at(F.col("cy"), F.col("cx"), "again"))
    beside = F.when((F.col("n") > 1) & (F.col("last") > F.col("cx")), F.array(at(F.col("cy"), F.pmod(F.col("cx") + 1, F.col("n")), "visitor"))).otherwise(F.array().cast("array<struct<cy:bigint,cx:bigint,kind:string>>"))
    above = F.transform(F.sequence(F.col("low"), F.least("high", F.col("low") + F.col("n2") - 1)), lambda x: at(F.col("cy") + 1, F.pmod(x, F.col("n2")), "visitor"))
    return base.select("cost", "row", F.explode(F.concat(home, beside, above)).alias("at")).select("cost", "row", "at.*")


def _dealt(placed: DataFrame, block: int) -> DataFrame:
    """Homes and guests of each cell in blocks by a hash of the id; each block of homes meets each block of guests under a key of its own: cost, cy, cx, u, w."""
    cell = ["cost", "cy", "cx"]
    sizes = placed.groupBy(*cell).agg(F.count_if(F.col("kind") == "home").alias("homes"), F.count_if(F.col("kind") != "home").alias("guests"))
    hot = sizes.where(F.greatest("homes", "guests") > block).select(*cell, F.ceil(F.col("homes") / block).cast("int").alias("us"), F.ceil(F.col("guests") / block).cast("int").alias("ws"))
    is_home = F.col("kind") == "home"
    blocks, across = (F.coalesce(F.greatest(F.when(is_home, F.col(x)).otherwise(F.col(y)), F.lit(1)), F.lit(1)) for x, y in (("us", "ws"), ("ws", "us")))
    got = placed.join(hot, cell, "left").withColumn("mine", F.pmod(F.xxhash64(F.lit(1), "row.id"), blocks).cast("int"))
    got = got.withColumn("other", F.explode(F.sequence(F.lit(0), across - 1)))
    return got.select(*cell, F.when(is_home, F.col("mine")).otherwise(F.col("other")).alias("u"), F.when(is_home, F.col("other")).otherwise(F.col("mine")).alias("w"), "kind", "row")


def near_same_cost(df: DataFrame, *, cost: str = "cost", km: float = 10.0, columns: tuple[str, ...] = ()) -> DataFrame:
    """Pairs a < b of equal cost within km of each other, with the distance (`_placed` says how they meet). A plain join: Spark can split a hot cell."""
    met, key = _placed(df, cost, km, columns), ["cost", "cy", "cx"]
    homes = met.where("kind = 'home'").select(*key, F.col("row").alias("p"))
    guests = met.where("kind <> 'home'").select(*key, "kind", F.col("row").alias("q"))
    got = homes.join(guests, key).where(F.when(F.col("kind") == "again", F.col("p.id") < F.col("q.id")).otherwise(F.col("p.id") != F.col("q.id")))
    first = F.col("p.id") < F.col("q.id")
    got = got.select("cost", F.when(first, F.col("p")).otherwise(F.col("q")).alias("a"), F.when(first, F.col("q")).otherwise(F.col("p")).alias("b"))
    keep = list(dict.fromkeys(["id", "lat", "lng", *columns]))
    got = got.select("cost", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in keep])
    got = got.withColumn("km", haversine_km(F.col("a_lat"), F.col("a_lng"), F.col("b_lat"), F.col("b_lng")))
    return got.where(F.col("km") <= km)


BANDS = (0, 1, 2, 5, 7.5, 10)  # km
_SUMS = "pairs long, least double, most double, km double, cost double, " + ", ".join(f"band{i} long" for i in range(len(BANDS) - 1))


def _pair_sums(batches: Iterator[pa.RecordBatch], most_km: float, at_once: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A row of sums for the pairs of each run of whole groups; groups are sorted, homes before guests."""
    key = ("cost", "cy", "cx", "u", "w")

    def solve(t: pa.Table, starts: np.ndarray) -> tuple:
        group = np.zeros(t.num_rows, np.int64)
        group[starts[1:]] = 1
        group = np.cumsum(group)
        ids, amount = t["id"].to_numpy(), t["amount"].to_numpy()
        lat, lng, side = np.radians(t["lat"].to_numpy()), np.radians(t["lng"].to_numpy()), t["side"].to_numpy()
        left = np.flatnonzero(side == 0)
        homes = np.bincount(group[left], minlength=len(starts))
        rows = np.bincount(group, minlength=len(starts))
        each, first = (rows - homes)[group[left]], (starts + homes)[group[left]]  # guests of each home, and the first of them
        done, sums = np.concatenate([[0], np.cumsum(each)]), []
        begin = 0
        while begin < len(left):
            end = max(begin + 1, int(np.searchsorted(done, done[begin] + at_once, "right")) - 1)
            n = each[begin:end]
            a = np.repeat(left[begin:end], n)
            b = np.arange(done[end] - done[begin]) - np.repeat(done[begin:end] - done[begin], n) + np.repeat(first[begin:end], n)
            ok = np.where(side[b] == 1, ids[a] < ids[b], ids[a] != ids[b])
            a, b = a[ok], b[ok]
            h = np.sin((lat[b] - lat[a]) / 2) ** 2 + np.cos(lat[a]) * np.cos(lat[b]) * np.sin((lng[b] - lng[a]) / 2) ** 2
            d = 2 * 6371.0 * np.arcsin(np.sqrt(np.minimum(1.0, h)))
            near = d <= most_km
            d, a = d[near], a[near]
            if len(d):
                sums.append((len(d), d.min(), d.max(), d.sum(), amount[a].sum(), *[int(((d >= x) & (d < y)).sum()) for x, y in zip(BANDS, BANDS[1:])]))
            begin = end
        return sums

    held: list[pa.RecordBatch] = []

    def flush(t: pa.Table, starts: np.ndarray):
        sums = solve(t, starts)
        if sums:
            c = list(zip(*sums))
            types = [pa.int64(), *[pa.float64()] * 4, *[pa.int64()] * (len(BANDS) - 1)]
            yield pa.RecordBatch.from_arrays([pa.array(x, ty) for x, ty in zip(c, types)], names=[x.split()[0] for x in _SUMS.split(", ")])

    def starts_of(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for c in key:
            x = t[c].combine_chunks()
            new[1:] |= pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False)
        return np.flatnonzero(new)

    for batch in batches:
        held.append(batch)
        t = pa.Table.from_batches(held)
        starts = starts_of(t)
        if len(starts) > 1:  # the last group may go on
            yield from flush(t.slice(0, starts[-1]), starts[:-1])
            held = t.slice(starts[-1]).combine_chunks().to_batches()
    if held:
        t = pa.Table.from_batches(held)
        if t.num_rows:
            yield from flush(t, starts_of(t))


def near_summary(df: DataFrame, *, cost: str = "cost", km: float = 10.0, block: int = 1024) -> DataFrame:
    """One row on the pairs that `near_same_cost` would give: their number, distances and bands. Tasks add the pairs of their blocks up in place; no pair is a row."""
    met = _dealt(_placed(df, cost, km, ()), block).withColumns({"side": F.when(F.col("kind") == "home", 0).when(F.col("kind") == "again", 1).otherwise(2), "amount": F.col("cost").cast("double"), "cost": F.col("cost").cast("string")})
    key = ["cost", "cy", "cx", "u", "w"]
    met = met.select(*key, "side", "amount", F.col("row.id").cast("long").alias("id"), F.col("row.lat").cast("double").alias("lat"), F.col("row.lng").cast("double").alias("lng"))
    met = met.repartition(*key).sortWithinPartitions(*key, "side")
    sums = met.mapInArrow(lambda it: _pair_sums(it, km), _SUMS)
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0))
    names = ("km_0_1", "km_1_2", "km_2_5", "km_5_7", "km_7_10")
    return sums.agg(
        whole("pairs").alias("pairs"), F.min("least").alias("least_km"), F.max("most").alias("most_km"), (F.sum("km") / F.sum("pairs")).alias("mean_km"), (F.sum("cost") / F.sum("pairs")).alias("mean_cost"),
        *[whole(f"band{i}").alias(n) for i, n in enumerate(names)],
    )


def classify_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs within 1 km: the same work entered twice, the same work over years, or different works."""
    same, year = F.col("a_contractor") == F.col("b_contractor"), F.col("a_infra_year") == F.col("b_infra_year")
    kind = F.when(same & year & (F.col("a_project_name") == F.col("b_project_name")), "duplicate_entry").when(same & ~year, "multi_year_tracking").otherwise("different_projects")
    return pairs.where("km <= 1").withColumns({"kind": kind, "same_contractor": same.cast("int"), "year_gap": F.abs(F.col("a_infra_year") - F.col("b_infra_year"))})


def vertical_lines(df: DataFrame, *, more_than: int = 1, spread: float = 0.01, digits: int | None = None, known: tuple[tuple[float, float], ...] = ()) -> DataFrame:
    """Longitudes that several works at several latitudes share, ranges in `known` left out."""
    lng = F.round("lng", digits) if digits is not None else F.col("lng")
    got = df.where(F.col("lat").isNotNull() & F.col("lng").isNotNull()).groupBy(lng.alias("lng")).agg(F.count("*").alias("n"), F.count_distinct(F.round("lat", 6)).alias("places"), F.min("lat").alias("low"), F.max("lat").alias("high"))
    got = got.where((F.col("n") > more_than) & (F.col("places") > 1) & (F.col("high") - F.col("low") > spread))
    for a, b in known:
        got = got.where(~F.col("lng").between(a, b))
    return got.withColumn("km", (F.col("high") - F.col("low")) * 111)


def shared_points(df: DataFrame, n: int | None = None) -> DataFrame:
    """Exact points of several works, and their share of all points."""
    known = df.where(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    got = known.groupBy("lat", "lng").agg(F.count("*").alias("n"), F.min("id").alias("sample")).where("n > 1")
    got = got.crossJoin(F.broadcast(known.agg(F.count("*").alias("whole")))).withColumn("percent", 100.0 * F.col("n") / F.col("whole")).drop("whole")
    return got.orderBy(F.desc("n"), "lat", "lng").limit(n) if n else got
