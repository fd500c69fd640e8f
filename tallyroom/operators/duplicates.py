"""Duplicate lines and inconsistent codes."""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import duplicate_score, severity
from ..sources.shared import stored

# Key columns beside description and amount, from the strictest tier to the loosest.
TIERS = [
    ("9", ["agency", "department", "fundcd", "uacs_exp_cd", "operunit", "uacs_operdiv_id", "uacs_reg_id"]),
    ("8a", ["agency", "department", "fundcd", "uacs_exp_cd", "operunit", "uacs_operdiv_id"]),
    ("8b", ["agency", "department", "fundcd", "uacs_exp_cd", "operunit", "uacs_reg_id"]),
    ("7", ["agency", "department", "fundcd", "uacs_exp_cd", "operunit"]),
    ("6a", ["agency", "department", "fundcd", "uacs_exp_cd"]),
    ("6b", ["agency", "department", "fundcd", "operunit"]),
    ("6c", ["agency", "department", "uacs_exp_cd", "operunit"]),
    ("5a", ["agency", "department", "fundcd"]),
    ("5b", ["agency", "department", "uacs_exp_cd"]),
    ("5c", ["agency", "department", "operunit"]),
    ("4a", ["agency", "department"]),
    ("4b", ["agency", "fundcd"]),
    ("4c", ["department", "fundcd"]),
    ("3a", ["agency"]),
    ("3b", ["department"]),
    ("3c", ["fundcd"]),
    ("2", []),
]


def known_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))


def described(df: DataFrame, description: str = "dsc") -> DataFrame:
    """Rows whose description says something: duplicates of INVALID ones mean nothing."""
    return df.where(F.col(description).isNotNull() & ~F.col(description).isin("", "INVALID"))


def duplicate_groups(df: DataFrame, keys: list[str], amount: str) -> DataFrame:
    """Groups of more than one row with equal, known keys."""
    got = known_keys(df, keys).groupBy(*keys).agg(F.count("*").alias("n"), F.sum(amount).alias("total")).where("n > 1")
    return got.withColumn("severity", F.when(F.col("n") >= 3, "high").otherwise("medium"))


def scored_duplicates(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each group of more than one, with the group's size: one shuffle for count and rank."""
    group = Window.partitionBy(*keys)
    got = known_keys(df, keys).withColumns({"n": F.count("*").over(group), "rank": F.row_number().over(group.orderBy(*order))})
    return got.where((F.col("n") > 1) & (F.col("rank") == 1)).drop("rank")


def group_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of groups of more than one."""
    return known_keys(df, keys).withColumn("n", F.count("*").over(Window.partitionBy(*keys))).where("n > 1")


def neighbour_pairs(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Pairs of rows next to each other in a group: a group of n rows gives n - 1 pairs, whatever n is."""
    w = Window.partitionBy(*keys).orderBy(order)
    got = known_keys(df, keys).withColumn("other", F.lead(order).over(w))
    return got.where(F.col("other").isNotNull() & (F.col("other") != F.col(order)))


def row_pairs(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Pairs a < b of rows with equal keys. Meant for strict keys: a group of n rows gives n (n - 1) / 2 pairs."""
    a = known_keys(df, keys).select(*keys, *[F.col(c).alias(f"a_{c}") for c in [order, *columns]])
    b = known_keys(df, keys).select(*keys, *[F.col(c).alias(f"b_{c}") for c in [order, *columns]])
    return a.join(b, keys).where(F.col(f"a_{order}") < F.col(f"b_{order}"))


def _hashes(columns: list[str], names: tuple[str, str]) -> list[Column]:
    """128 bits that stand for the values of columns; a null counts by its place."""
    there = [F.col(c).isNull() for c in columns]
    return [F.xxhash64(F.lit(-1), *columns, *there).alias(names[0]), F.xxhash64(*there, *columns, F.lit(-1)).alias(names[1])]


def _groups(batches, columns: list[str], size: int, most: int):
    """(table, whether it has its groups whole) of batches in the order of p1, p2 and g. Equal rows of a long group count as one; of one that is still longer than `most`, the parts come as they are."""
    key, held, n, limit, parted = ["p1", "p2", "g"], [], 0, size, None
    ends = lambda t: [tuple(t[k][i].as_py() for k in key) for i in (0, len(t) - 1)]
    starts = lambda t: np.flatnonzero(np.any([np.diff(t[k].to_numpy()) != 0 for k in key], axis=0)) + 1

    def whole(t):
        cut = int(starts(t)[0]) if len(starts(t)) else len(t)
        cut = cut if ends(t)[0] == parted else 0  # what is left of a parted group
        yield from ((x, k) for x, k in ((t[:cut], False), (t[cut:], True)) if len(x))

    for batch in batches:
        t = pa.Table.from_batches([batch])
        held.append(t.append_column("n", pa.array(np.ones(len(t), np.int64))))
        n += len(t)
        if n < limit:
            continue
        t = pa.concat_tables(held).combine_chunks()
        if len(starts(t)):
            yield from whole(t[: int(starts(t)[-1])])
            t = t[int(starts(t)[-1]) :]
        elif ends(t)[0] != parted:
            t = t.group_by([*key, *columns]).aggregate([("n", "sum")]).rename_columns([*key, *columns, "n"])
        if len(t) > most or ends(t)[0] == parted:
            parted = ends(t)[0]
            yield t, False
            t = t[:0]
        held, n, limit = [t], len(t), max(size, 2 * len(t))
    if n:
        yield from whole(pa.concat_tables(held).combine_chunks())


def _strictest_here(batches, columns: list[str], tiers: list[list[str]], size: int, most: int):
    """(p1, p2, columns, n, t): t is the first tier in which rows of a group share all keys, which are known, null where there is none, and -1 in groups too long to be compared here."""
    for table, whole in _groups(batches, columns, size, most):
        t = np.full(len(table), -1 if not whole else len(tiers), np.int32)
        if whole:
            n = table["n"].to_numpy()
            here = np.zeros(len(table), np.int64)
            here[1:] = np.cumsum(np.any([np.diff(table[k].to_numpy()) != 0 for k in ("p1", "p2", "g")], axis=0))
            codes = {}
            for c in columns:
                x = pc.dictionary_encode(table[c]).combine_chunks()
                codes[c] = pc.fill_null(x.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1, len(x.dictionary) + 1
            for k, keys in enumerate(tiers):
                key, many, known = here, int(here[-1]) + 1, t == len(tiers)
                for code, of in (codes[c] for c in keys):
                    if many * of >= 1 << 62:
                        key = np.unique(key, return_inverse=True)[1]
                        many = int(key.max()) + 1
                    key, many, known = key * of + code, many * of, known & (code > 0)
                if known.any():
                    place = np.unique(key, return_inverse=True)[1]
                    t[known & (np.bincount(place, n)[place] > 1)] = k
        out = table.select(["p1", "p2", *columns, "n"]).append_column("t", pa.array(t, mask=t == len(tiers)))
        yield from out.to_batches()


def _strictest_by_digests(classes: DataFrame, columns: list[str], tiers: dict[int, list[str]]) -> DataFrame:
    """(c1, c2, t) of classes (p1, p2, columns, n) that share all keys, which are known, of a tier with another row: t is the first such tier. Keys are counted by 128-bit hashes, so that no task gets a group whole."""
    digest = lambda t, keys: [F.xxhash64("p1", F.lit(t), *keys).alias("h1"), F.xxhash64("p2", *keys, F.lit(~t)).alias("h2")]
    all_known = lambda keys: reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.lit(True))
    keys_of = [F.struct(F.lit(t).alias("t"), *digest(t, keys), all_known(keys).alias("known")) for t, keys in tiers.items()]
    member = classes.select(*_hashes(["p1", "p2", *columns], ("c1", "c2")), "n", F.inline(F.array(*keys_of))).where("known").drop("known")
    shared = member.groupBy("t", "h1", "h2").agg(F.sum("n").alias("all")).where(F.col("all") > 1).select("t", "h1", "h2")
    return member.join(shared.hint("shuffle_hash"), ["t", "h1", "h2"], "left_semi").groupBy("c1", "c2").agg(F.min("t").alias("t"))


def _tiered(df: DataFrame, description: str, amount: str, apart: bool, size: int, most: int) -> tuple[DataFrame, list[str]]:
    """(p1, p2, columns, n, t) of rows in a tier, and the columns. apart: all key columns, so that a row finds its class; else those that the last tiers need.

    The first tiers all have agency and department among their keys, so rows are sent once, to the others of
    their description, amount, agency and department, and compared there. What
    has no tier then is compared in the last tiers with the counts by agency, department and fund. Groups too long
    for one task are counted by hashes of each tier's keys.
    """
    keys = [[c for c in cols if c in df.columns] for _, cols in TIERS]
    columns = list(dict.fromkeys(c for k in keys for c in k))
    group = [c for c in ("agency", "department") if c in columns]
    first = next((t for t, k in enumerate(keys) if not set(group) <= set(k)), len(keys))
    last = [c for c in columns if c in group or any(c in k for k in keys[first:])]
    rows = known_keys(described(df, description), [description, amount])
    rows = rows.select(F.xxhash64(description, amount).alias("p1"), F.xxhash64(description, amount, F.lit(1)).alias("p2"), *columns).withColumn("g", _hashes(group, ("g", ""))[0])
    parts = max(128, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartition(parts, "p1", "p2", "g").sortWithinPartitions("p1", "p2", "g")
    schema = T.StructType([*(f for f in rows.schema if f.name != "g"), T.StructField("n", T.LongType()), T.StructField("t", T.IntegerType())])
    found = dealt.mapInArrow(partial(_strictest_here, columns=columns, tiers=keys[:first], size=size, most=most), schema)
    kept = columns if apart else [*last, *[F.when(F.col("t") == -1, F.col(c)).alias(c) for c in columns if c not in last]]
    found = stored(found.groupBy("p1", "p2", *kept, "t").agg(F.sum("n").alias("n")), "tiers")
    own = lambda x, cols: x.withColumns(dict(zip(("c1", "c2"), _hashes(["p1", "p2", *cols], ("c1", "c2")))))
    long = found.where("t = -1").drop("t")
    if not long.isEmpty():
        strict = _strictest_by_digests(long, columns, dict(enumerate(keys[:first])))
        found = stored(found.where("t IS NULL OR t >= 0").unionByName(own(long, columns).join(strict, ["c1", "c2"], "left").drop("c1", "c2")), "tiers")
    done, open_ = found.where("t >= 0"), found.where("t IS NULL").drop("t")
    if first < len(keys) and not open_.isEmpty():
        near = found.join(open_.select("p1", "p2").distinct(), ["p1", "p2"], "left_semi").groupBy("p1", "p2", *last).agg(F.sum("n").alias("n"))
        loose = _strictest_by_digests(near, last, {t: keys[t] for t in range(first, len(keys))})
        done = done.unionByName(own(open_, last).join(loose, ["c1", "c2"]).drop("c1", "c2"))
    return done, columns


def _scored(df: DataFrame) -> DataFrame:
    """df with tier and score in place of the tier's number t."""
    tier = F.element_at(F.array(*[F.lit(name) for name, _ in TIERS]), F.col("t") + 1)
    return df.withColumn("tier", tier).withColumn("score", F.round(F.regexp_extract("tier", r"\d", 0).cast("double") / 9 * 100, 1)).drop("t")


def tiered_duplicates(df: DataFrame, row: str, description: str = "dsc", amount: str = "amt_coarse", size: int = 1 << 17, most: int = 1 << 20) -> DataFrame:
    """Each row in its strictest tier of duplicates: (row, tier, score). Columns that the table lacks are left out of the keys.

    A task compares groups of up to `most` different rows, about `size` rows at a time (`_tiered`).
    """
    done, columns = _tiered(df, description, amount, True, size, most)
    rows = known_keys(described(df, description), [description, amount])
    rows = rows.select(row, *columns, F.xxhash64(description, amount).alias("p1"), F.xxhash64(description, amount, F.lit(1)).alias("p2"))
    strictest = done.select(*_hashes(["p1", "p2", *columns], ("c1", "c2")), "t")
    return _scored(rows.select(row, *_hashes(["p1", "p2", *columns], ("c1", "c2"))).join(strictest.hint("shuffle_hash"), ["c1", "c2"]).select(row, "t"))


def tier_sizes(df: DataFrame, description: str = "dsc", amount: str = "amt_coarse", size: int = 1 << 17, most: int = 1 << 20) -> DataFrame:
    """(tier, score, n): how many rows `tiered_duplicates` has in each tier, without sending rows back to their classes."""
    return _scored(_tiered(df, description, amount, False, size, most)[0].groupBy("t").agg(F.sum("n").alias("n")))


def score_pairs(pairs: DataFrame, columns: list[str], amount: str, weight: float = 20.0) -> DataFrame:
    """score and severity of pairs with columns a_x and b_x."""
    matched = reduce(lambda a, b: a + b, [F.equal_null(F.col(f"a_{c}"), F.col(f"b_{c}")).cast("int") for c in columns])
    got = pairs.withColumn("score", duplicate_score(matched, F.lit(len(columns)), F.col(f"a_{amount}"), F.col(f"b_{amount}"), weight))
    return got.withColumn("severity", severity(F.col("score")))


def inconsistent_codes(df: DataFrame, pairs: list[tuple[str, str]], many: int = 5) -> DataFrame:
    """Descriptions with several codes, for all (description, code) column pairs in one pass."""
    there = [(d, c) for d, c in pairs if d in df.columns and c in df.columns]
    cells = F.explode(F.array(*[F.struct(F.lit(f"{d}/{c}").alias("pair"), F.col(d).alias("description"), F.col(c).cast("string").alias("code")) for d, c in there]))
    long = df.select(cells.alias("x")).select("x.*").where("description IS NOT NULL AND description NOT IN ('', 'INVALID') AND code IS NOT NULL")
    got = long.groupBy("pair", "description").agg(F.collect_set("code").alias("__codes"), F.count("*").alias("n"))
    got = got.where(F.size("__codes") > 1).select("pair", "description", F.size("__codes").cast("long").alias("n_codes"), F.array_join(F.sort_array("__codes"), ", ").alias("codes"), "n")
    return got.withColumn("severity", F.when(F.col("n_codes") > many, "High").otherwise("Medium"))
