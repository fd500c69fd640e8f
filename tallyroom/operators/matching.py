"""Joins by amount and by similar names."""

from __future__ import annotations

import difflib
import functools
import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import amount_score, lev_ratio, standard_name, words
from ..sources.shared import checkpointed, stored
from .rollups import running_total


def _matched(pairs: list[tuple[str, str]], cells: int = 1 << 18) -> np.ndarray:
    """How many letters difflib matches in each pair of texts, of which the second has fewer than 200 letters: the longest common run, the earliest of several, then the same left and right of it."""
    sides = [[p[k] for p in pairs] for k in (0, 1)]
    flat = [np.frombuffer("".join(x).encode("utf-32-le", "surrogatepass"), np.int32) for x in sides]
    sizes = [np.fromiter(map(len, x), np.int64, len(x)) for x in sides]
    starts = [np.cumsum(n) - n for n in sizes]
    found = np.zeros(len(pairs), np.int64)
    of = np.flatnonzero((sizes[0] > 0) & (sizes[1] > 0))
    todo = [np.stack([of, starts[0][of], sizes[0][of], starts[1][of], sizes[1][of]])] if len(of) else []
    while todo:
        work = np.concatenate(todo, 1)
        work, todo = work[:, np.argsort(work[2] * 256 + work[4], kind="stable")], []
        while work.shape[1]:
            n = max(1, cells // (int(work[2, : 1 << 12].max()) * int(work[4, : 1 << 12].max())))
            (of, i, p, j, q), work = work[:, : min(n, 1 << 12)], work[:, min(n, 1 << 12) :]
            w, h = np.arange(p.max()), np.arange(q.max())
            x = np.where(w < p[:, None], flat[0][np.minimum(i[:, None] + w, len(flat[0]) - 1)], -1)
            y = np.where(h < q[:, None], flat[1][np.minimum(j[:, None] + h, len(flat[1]) - 1)], -2)
            run = (x[:, :, None] == y[:, None, :]).astype(np.uint8)  # then as long as the common run that ends here
            for k in range(1, len(w)):
                run[:, k, 1:] *= run[:, k - 1, :-1] + np.uint8(1)
            run = run.reshape(len(of), -1)
            end = run.argmax(1)
            size = run[np.arange(len(of)), end].astype(np.int64)
            found += np.bincount(of, size, len(found)).astype(np.int64)
            a, b = end // len(h) - size + 1, end % len(h) - size + 1
            todo += [np.stack([of, i, a, j, b])[:, (size > 0) & (a > 0) & (b > 0)]]
            a, b = a + size, b + size
            todo += [np.stack([of, i + a, p - a, j + b, q - b])[:, (size > 0) & (a < p) & (b < q)]]
        todo = [x for x in todo if x.shape[1]]
    return found


@F.pandas_udf(T.DoubleType())
def gestalt_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio of two names; argument order counts. Runs on candidate pairs only."""
    pairs = [(x or "", y or "") for x, y in zip(a, b)]
    short = [k for k, (x, y) in enumerate(pairs) if len(y) < 200]  # in longer ones difflib leaves out common letters
    out = np.array([0.0 if len(y) < 200 else difflib.SequenceMatcher(None, x, y).ratio() for x, y in pairs])
    if short:
        lengths = np.array([len(pairs[k][0]) + len(pairs[k][1]) for k in short])
        out[short] = np.where(lengths == 0, 1.0, 2.0 * _matched([pairs[k] for k in short]) / np.maximum(lengths, 1))
    return pd.Series(out)


def band_join(a: DataFrame, b: DataFrame, amount_a: str, amount_b: str, percent: float) -> DataFrame:
    """Pairs of positive amounts with |a - b| / max(a, b) <= percent %: buckets of log amounts, the neighbours too, then the exact test."""
    width = -math.log(1 - percent / 100) * (1 + 1e-9)
    x = a.where(F.col(amount_a) > 0).withColumn("__k", F.floor(F.log(F.col(amount_a).cast("double")) / width))
    y = b.where(F.col(amount_b) > 0).withColumn("__k", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.log(F.col(amount_b).cast("double")) / width) + d)))
    p, q = F.col(amount_a).cast("double"), F.col(amount_b).cast("double")
    return x.join(y, "__k").where(F.abs(p - q) / F.greatest(p, q) <= percent / 100).drop("__k")


def _band_ends(x: Column, percent: float) -> tuple[Column, Column]:
    """The least and the largest double within percent % of x, as the floating-point test has it.

    Up to 50 % the difference is exact and the test monotone in the other
    amount, so the end is the outermost of the doubles around the rounded
    one that passes; half steps of the last place meet each of them.
    """
    share = percent / 100
    step = lambda y: F.transform(F.sequence(F.lit(-32), F.lit(32)), lambda i: y + i * (y * 2.0**-53))
    low = F.array_min(F.filter(step(x * (1 - share)), lambda y: (y > 0) & ((y >= x) | ((x - y) / x <= share))))
    high = F.array_max(F.filter(step(x / (1 - share)), lambda y: (y <= x) | ((y - x) / y <= share)))
    return low, high


def band_counts(a: DataFrame, b: DataFrame, key: str, amount_a: str, amount_b: str, percent: float) -> DataFrame:
    """(key, n): the rows of b within percent % (50 at most) of the amounts of each key of a that has any.

    No pair is made: the amounts of b and the ends of the bands of a stand in
    one order, and a band has what the running count at its upper end is above that at its lower.
    """
    if not 0 <= percent <= 50:
        raise ValueError(f"not between 0 and 50 %: {percent}")
    sound = lambda df, c: df.withColumn("__x", F.col(c).cast("double")).where((F.col("__x") > 0) & (F.col("__x") < float("inf")))
    x = sound(a, amount_a)
    low, high = _band_ends(F.col("__x"), percent)
    ends = x.select("__x").distinct().select(F.explode(F.array(F.struct(low.alias("at"), F.lit(0).alias("kind"), F.col("__x").alias("of")), F.struct(high.alias("at"), F.lit(2).alias("kind"), F.col("__x").alias("of")))).alias("e"))
    there = sound(b, amount_b).groupBy(F.col("__x").alias("at")).agg(F.count("*").alias("n"))
    line = there.select("at", F.lit(1).alias("kind"), F.lit(None).cast("double").alias("of"), "n").unionByName(ends.select("e.*", F.lit(0).cast("long").alias("n")))
    so_far = running_total(checkpointed(line), F.col("n"), "at", "kind", name="total")
    found = so_far.where("kind <> 1").groupBy("of").agg(F.sum(F.when(F.col("kind") == 2, F.col("total")).otherwise(-F.col("total"))).alias("n")).where("n > 0")
    return x.join(found, F.col("__x") == F.col("of")).groupBy(key).agg(F.sum("n").alias("n"))


# Names that are alike: an index gives pairs of names, counts of common parts leave few of these, and only then are strings compared.


def _common_letters(a: Column, b: Column) -> Column:
    """How many letters two names share, each as often as both have it."""
    many = lambda s, x: F.length(s) - F.length(F.replace(s, x, F.lit("")))
    return F.aggregate(F.array_distinct(F.split(a, "")), F.lit(0), lambda t, x: t + F.when(x == "", 0).otherwise(F.least(many(a, x), many(b, x))))


def _pieces(n: Column, least: float) -> Column:
    """Into how many pieces an indexed name of n letters is cut: one more than the most edits that a name as similar can be away."""
    return (F.floor(F.floor(n / least + 1e-9) * (1 - least) + 1e-9) + 1).cast("int")


def _piece(n: Column, m: Column, i: Column) -> tuple[Column, Column]:
    """(start, length) of the i-th of m pieces of a name of n letters; the last pieces are the longer ones."""
    size, more = F.floor(n / m).cast("int"), n - F.floor(n / m).cast("int") * m
    return (i - 1) * size + F.greatest(F.lit(0), i - 1 - (m - more)) + 1, size + (i > m - more).cast("int")


def _indexed(names: DataFrame, least: float) -> DataFrame:
    """(name, token): the pieces of each name; the letters of names with fewer letters than pieces."""
    name, n, m = F.col("name"), F.length("name"), F.col("m")

    def token(i: Column) -> Column:
        start, size = _piece(n, m, i)
        return F.concat_ws(":", n, i, F.substr(name, start, size))

    letters = F.transform(F.array_distinct(F.split(name, "")), lambda x: F.concat_ws(":", n, F.lit("any"), x))
    tokens = F.when(n >= m, F.transform(F.sequence(F.lit(1), m), token)).otherwise(letters)
    return names.withColumn("m", _pieces(n, least)).select("name", F.explode(tokens).alias("token"))


def _probes(names: DataFrame, least: float) -> DataFrame:
    """(name, token): the runs of each name that can be a piece of an indexed one.

    If two names are k edits apart, one of the k + 1 pieces is whole in the
    other, moved by no more than the pieces before it and after it can be
    edited: the i-th by i - 1 counted from the left, and by m - i from the right.
    """
    name, n, other, m, i = F.col("name"), F.length("name"), F.col("other"), F.col("m"), F.col("i")
    lengths = names.withColumn("other", F.explode(F.sequence(F.ceil(n * least - 1e-9).cast("int"), F.floor(n / least + 1e-9).cast("int"))))
    cut = lengths.withColumn("m", _pieces(other, least)).where("other > 0")
    short = cut.where("other < m").select("name", F.explode(F.transform(F.array_distinct(F.split(name, "")), lambda x: F.concat_ws(":", "other", F.lit("any"), x))).alias("token"))
    runs = cut.where("other >= m").withColumn("i", F.explode(F.sequence(F.lit(1), m)))
    start, size = _piece(other, m, i)
    runs = runs.withColumns({"start": start, "size": size})
    start, size, shift = F.col("start"), F.col("size"), n - other
    first, last = F.greatest(F.lit(1), start - (i - 1), start + shift - (m - i)), F.least(n - size + 1, start + (i - 1), start + shift + (m - i))
    runs = runs.withColumns({"first": first, "last": last}).where("first <= last")
    token = lambda p: F.concat_ws(":", "other", "i", F.substr(name, p, size))
    return runs.select("name", F.explode(F.array_distinct(F.transform(F.sequence("first", "last"), token))).alias("token")).union(short)


def _tokens(names: DataFrame, size: int) -> DataFrame:
    """names with a row for each run of `size` letters, each with how often it has come: sets of these tokens share what the names share."""
    n = F.greatest(F.lit(1), F.length("name") - (size - 1))
    runs = names.select("*", F.posexplode(F.transform(F.sequence(F.lit(1), n), lambda i: F.substr("name", i, F.lit(size)))).alias("__at", "__run"))
    nth = F.row_number().over(Window.partitionBy("name", "__run").orderBy("__at"))
    return runs.withColumn("token", F.concat(F.lit(f"{size} "), "__run", nth.cast("string"))).drop("__at", "__run")


def _common_runs(whole: Column, size: int, least: float) -> Column:
    """How many runs of `size` letters two names of `whole` letters together share at least, if difflib finds them so similar.

    Half of least times the whole is matched; each letter without a match parts
    one block from the next at most, and a block has size - 1 fewer runs than letters.
    """
    matched = F.ceil(whole * least / 2 - 1e-9)
    return matched - (size - 1) * (whole - 2 * matched + 1)


def _prefixes(names: DataFrame, least: float) -> DataFrame:
    """(name, size, token, place, n): the rarest of the n tokens of each name, by place, enough that similar names share one.

    Tokens are runs of two letters, where all partners are sure to have one in
    common, else single letters; names whose partners may be such short ones have both.
    """
    n, parts = F.length("name"), []
    shortest, longest = F.ceil(n * least / (2 - least) - 1e-9), F.floor(n * (2 - least) / least + 1e-9)
    sure = [k for k in range(1, 2000) if all(_runs_of(k + j, 2, least) >= 1 for j in range(math.ceil(k * least / (2 - least) - 1e-9), math.floor(k * (2 - least) / least + 1e-9) + 1))]
    unsure = max(set(range(1, 2000)) - set(sure))
    pairs = unsure < 1999
    reach = F.lit(unsure * (2 - least) / least + 1e-9) if pairs else F.lit(float("inf"))
    for size in (2, 1) if pairs else (1,):
        own = names.where(~n.isin(*(set(range(1, unsure + 1)) - set(sure)))) if size == 2 else names.where(n <= reach)
        need = F.greatest(F.lit(1), F.array_min(F.transform(F.sequence(shortest, longest), lambda other: _common_runs(n + other, size, least))))
        parts.append(_tokens(own.select("name", F.lit(size).alias("size"), need.alias("need")), size))
    tokens = reduce(DataFrame.unionByName, parts)
    rarity = tokens.groupBy("token").agg(F.count("*").alias("seen"))
    w = Window.partitionBy("name", "size")
    got = tokens.join(rarity, "token").withColumns({"place": F.row_number().over(w.orderBy("seen", "token")), "n": F.count("*").over(w)})
    return got.where(F.col("place") <= F.col("n") - F.col("need") + 1).select("name", "size", "token", "place", "n")


def _runs_of(whole: int, size: int, least: float) -> int:
    matched = math.ceil(whole * least / 2 - 1e-9)
    return matched - (size - 1) * (whole - 2 * matched + 1)


def likely_pairs(x: DataFrame, y: DataFrame, least: float, metric: str = "levenshtein") -> DataFrame:
    """(a, b) of the distinct, non-empty names `a` of x and `b` of y that may be so similar; those that are are among them."""
    x, y = x.where("a <> ''"), y.where("b <> ''")
    short, long = F.least(F.length("a"), F.length("b")), F.greatest(F.length("a"), F.length("b"))
    if metric == "levenshtein":
        index = _indexed(y.select(F.col("b").alias("name")), least).withColumnRenamed("name", "b")
        pairs = _probes(x.select(F.col("a").alias("name")), least).withColumnRenamed("name", "a").join(index, "token").select("a", "b").distinct()
        return pairs.where(_common_letters(F.col("a"), F.col("b")) >= long - F.floor(long * (1 - least) + 1e-9))
    side = lambda df, c: df.select(F.col(c).alias("name"), F.lit(c).alias("side"))
    both = side(x, "a").union(side(y, "b"))
    tokens = checkpointed(_prefixes(both.select("name").distinct(), least))
    ta, tb = (tokens.join(df.select(F.col(c).alias("name")), "name").select(F.col("name").alias(c), "size", "token", F.col("place").alias(f"place_{c}"), F.col("n").alias(f"n_{c}")) for df, c in ((x, "a"), (y, "b")))
    whole = F.length("a") + F.length("b")
    met = ta.join(tb, ["token", "size"]).where(short >= F.ceil(whole * least / 2 - 1e-9))
    # tokens shared in the prefixes, and as many as can follow the last of these: below the bound, strings needn't meet
    summed = met.groupBy("a", "b", "size").agg(F.count("*").alias("shared"), F.min(F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))).alias("rest"))
    need = F.when(F.col("size") == 2, _common_runs(whole, 2, least)).otherwise(_common_runs(whole, 1, least))
    enough = summed.where(F.col("shared") + F.col("rest") >= need).select("a", "b").distinct()
    return enough.where(_common_letters(F.col("a"), F.col("b")) >= F.ceil(whole * least / 2 - 1e-9))


def similar_names(a: DataFrame, b: DataFrame, col_a: str, col_b: str, least: float, metric: str = "levenshtein") -> DataFrame:
    """(a, b, ratio) of the distinct names at least so similar. No pair is lost (`likely_pairs`). Empty names equal each other."""
    x = a.select(F.col(col_a).alias("a")).where("a IS NOT NULL").distinct()
    y = b.select(F.col(col_b).alias("b")).where("b IS NOT NULL").distinct()
    ratio = lev_ratio(F.col("a"), F.col("b")) if metric == "levenshtein" else gestalt_ratio(F.col("a"), F.col("b"))
    got = likely_pairs(x, y, least, metric).withColumn("ratio", ratio).where(F.col("ratio") >= least)
    empty = x.where("a = ''").join(y.where("b = ''"), F.col("a") == F.col("b")).withColumn("ratio", F.lit(1.0))
    return got.unionByName(empty)


def containing(a: DataFrame, b: DataFrame, col_a: str, col_b: str) -> DataFrame:
    """(a, b) of names of which a contains b: the parts of a that are as long as a name of b, joined to it."""
    s = F.col(col_a)
    lengths = b.agg(F.collect_set(F.length(col_b)).alias("__lengths"))  # one row, a number for each length
    cut = a.crossJoin(F.broadcast(lengths)).withColumn("__k", F.explode(F.filter("__lengths", lambda k: (k > 0) & (k <= F.length(s)))))
    parts = cut.select(col_a, F.explode(F.transform(F.sequence(F.lit(1), F.length(s) - F.col("__k") + 1), lambda i: F.substr(s, i, F.col("__k")))).alias(col_b)).distinct()
    return parts.join(b.select(col_b).distinct(), col_b).select(col_a, col_b)


def membership(registry: DataFrame, name: str, sources: dict[str, DataFrame], least: float = 0.9, metric: str = "levenshtein", variant: str = "token") -> DataFrame:
    """registry with a boolean per source: whether a name of the source is as similar, after normalising."""
    out = registry.withColumn("__norm", standard_name(F.col(name), variant))
    for flag, names in sources.items():
        source = names.select(standard_name(F.col(names.columns[0]), variant).alias("s"))
        hits = similar_names(out, source, "__norm", "s", least, metric).select(F.col("a").alias("__norm")).distinct().withColumn(flag, F.lit(True))
        out = out.join(hits, "__norm", "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    return out.drop("__norm")


def first_independent(nodes: DataFrame, links: DataFrame, names_a_range: int = 200_000) -> DataFrame:
    """Of nodes (name) and links (name, other) with other < name: the names that have no link to a smaller one that is kept.

    Names stand in ranges of their order. A round decides in each range, from its
    smallest name on, all that depends on no undecided name of another range; as links only
    lead to smaller names, the first range with undecided names is decided whole. So there are no more
    rounds than ranges, however long a chain is, and few where chains are short. A task
    keeps the names of a range, not their links, which stream past in order.
    """
    ranges = max(1, -(-nodes.count() // names_a_range))
    state = nodes.repartitionByRange(ranges, "name").select("name", F.spark_partition_id().alias("part"), F.lit(0).alias("state"))  # 0 open, 1 kept, 2 dropped
    state = checkpointed(state)
    links = checkpointed(links.join(state.select("name", "part"), "name").join(state.select(F.col("name").alias("other"), F.col("part").alias("other_part")), "other"))
    for _ in range(ranges):
        known = links.join(state.select(F.col("name").alias("other"), F.col("state").alias("other_state")), "other")
        outside = known.where("part <> other_part OR other_state <> 0").groupBy("name").agg(F.max((F.col("other_state") == 1).cast("int")).alias("hit"), F.max((F.col("other_state") == 0).cast("int")).alias("wait"))
        open_ = state.where("state = 0").join(outside, "name", "left").select("part", "name", F.lit(None).cast("string").alias("other"), F.coalesce("hit", F.lit(0)).alias("hit"), F.coalesce("wait", F.lit(0)).alias("wait"))
        inside = known.where("part = other_part AND other_state = 0").select("part", "name", "other", F.lit(0).alias("hit"), F.lit(0).alias("wait"))
        dealt = open_.unionByName(inside).repartition("part").sortWithinPartitions("part", "name", F.asc_nulls_first("other"))
        decided = dealt.mapInPandas(_decide, "name string, state int")
        state = checkpointed(state.where("state <> 0").unionByName(state.where("state = 0").select("name", "part").join(decided, "name")))
        links = checkpointed(links.join(state.where("state = 0").select("name"), "name", "left_semi"))  # links of decided names say no more
        if links.isEmpty():
            break
    return state.where("state = 1").select("name")


def _decide(frames):
    """(name, state) of rows (part, name, other, hit, wait) in order: a name's row of its own, then its links within the part."""
    part, name, kept, dropped, now = None, None, set(), set(), 0
    for frame in frames:
        out = []
        for p, n, other, hit, wait in frame.itertuples(index=False):
            if n != name or p != part:
                if name is not None:
                    out.append((name, now))
                    (kept.add if now == 1 else dropped.add if now == 2 else lambda _: None)(name)
                if p != part:
                    kept, dropped = set(), set()
                part, name, now = p, n, 2 if hit else 0 if wait else 1
            elif other in kept:
                now = 2
            elif now == 1 and other not in dropped:
                now = 0
        yield pd.DataFrame(out, columns=["name", "state"])
    if name is not None:
        yield pd.DataFrame([(name, now)], columns=["name", "state"])


def greedy_new_names(new: DataFrame, name: str, existing: DataFrame, existing_name: str, least: float = 0.85, metric: str = "levenshtein") -> DataFrame:
    """New names to accept, in code-point order: those like no existing name and like no smaller accepted one. Names equal after normalising are alike."""
    norm = lambda df, c: df.select(F.col(c).alias("name"), standard_name(F.col(c), "substring").alias("norm")).where("name IS NOT NULL").distinct()
    fresh, old = norm(new, name), norm(existing, existing_name)
    taken = similar_names(fresh, old, "norm", "norm", least, metric).select(F.col("a").alias("norm")).distinct()
    open_ = checkpointed(fresh.join(taken, "norm", "left_anti"))
    like = similar_names(open_, open_, "norm", "norm", least, metric).select("a", "b")
    links = open_.select("name", F.col("norm").alias("a")).join(like, "a").join(open_.select(F.col("name").alias("other"), F.col("norm").alias("b")), "b").where("other < name").select("name", "other")
    return first_independent(open_.select("name"), links)


def best_registry_match(names: DataFrame, name: str, registry: DataFrame, registry_name: str, *, sure: float = 0.9, fair: float = 0.8, shared: int = 2, metric: str = "levenshtein") -> DataFrame:
    """The best registry name of each name: equal after normalising, above `sure`, or above `fair` with enough words in common. Ties go to the smaller registry name."""
    a = names.select(F.col(name).alias("name"), standard_name(F.col(name), "suffix").alias("norm")).distinct().withColumn("norm", F.upper("norm"))
    b = registry.select(F.col(registry_name).alias("match"), standard_name(F.col(registry_name), "suffix").alias("norm")).distinct().withColumn("norm", F.upper("norm"))
    like = similar_names(a, b, "norm", "norm", fair, metric)
    got = a.withColumnRenamed("norm", "a").join(like, "a").join(b.withColumnRenamed("norm", "b"), "b")
    common = F.size(F.array_intersect(words(F.col("a")), words(F.col("b"))))
    got = got.where((F.col("a") == F.col("b")) | (F.col("ratio") > sure) | ((F.col("ratio") > fair) & (common >= shared)))
    w = Window.partitionBy("name").orderBy(F.desc("ratio"), "match")
    return got.withColumn("rank", F.row_number().over(w)).where("rank = 1").select("name", "match", "ratio")


def match_by_amount(contracts: DataFrame, projects: DataFrame, least: float = 60.0, metric: str = "levenshtein") -> DataFrame:
    """The best project of each contract of exactly its amount, by title (0.6) and contractor (0.4). Ties go to the smallest project id.

    A title that is null or has only words that say nothing is like no other.
    Likeness is computed once for each pair of different titles and contractors of one amount.
    """
    title = lambda x: standard_name(F.col(x), "title")
    c = contracts.select(F.col("id").alias("contract_id"), F.col("amount").alias("money"), title("award_title").alias("award"), title("notice_title").alias("notice"), F.upper(F.trim("awardee")).alias("awardee"))
    p = projects.select(F.col("id").alias("project_id"), F.col("cost").alias("money"), title("project_name").alias("project"), F.upper(F.trim("contractor")).alias("contractor"))
    sides = ["money", "award", "notice", "awardee"], ["money", "project", "contractor"]
    different = c.where("money > 0").select(*sides[0]).distinct().join(p.groupBy(*sides[1]).agg(F.min("project_id").alias("project_id")), "money")
    ratio = lev_ratio if metric == "levenshtein" else gestalt_ratio
    alike = lambda x: F.when((F.col(x) == "") | (F.col("project") == ""), 0.0).otherwise(ratio(F.col(x), F.col("project")))
    names = F.when(F.col("awardee") == F.col("contractor"), 1.0).when(F.contains("awardee", "contractor") | F.contains("contractor", "awardee"), 0.9).otherwise(ratio(F.col("awardee"), F.col("contractor")))
    got = different.withColumn("score", F.round((F.greatest(alike("award"), alike("notice")) * 0.6 + names * 0.4) * 100, 2)).where(F.col("score") >= least)
    w = Window.partitionBy(*sides[0]).orderBy(F.desc("score"), "project_id")
    best = got.withColumn("rank", F.row_number().over(w)).where("rank = 1").select(*[F.col(x).alias(f"of_{x}") for x in sides[0]], "project_id", "score")
    same = reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(f"of_{x}")) for x in sides[0]])
    return c.join(best, same).select("contract_id", "project_id", "score", F.when(F.col("score") >= 80, "excellent").when(F.col("score") >= 70, "good").otherwise("fair").alias("quality"))


@F.pandas_udf(T.StructType([T.StructField("letters", T.LongType()), T.StructField("runs", T.LongType())]))
def _marks(names: pd.Series) -> pd.DataFrame:
    """Two marks of 64 bits: of a name's letters, with how often each has come, and of its runs of two. A bit that another name's mark lacks stands for something that the other lacks."""

    @functools.cache
    def marks(name):
        come, letters, runs, last = {}, 0, 0, None
        for x in map(ord, name):
            k = come[x] = come.get(x, 0) + 1
            letters |= 1 << (x + 29 * k & 63)
            if last is not None:
                runs |= 1 << (x + 37 * last & 63)
            last = x
        return [v - (v >> 63 << 64) for v in (letters, runs)]

    return pd.DataFrame([marks(x or "") for x in names], columns=["letters", "runs"])


def _most_alike(metric: str) -> Column:
    """No less than the contractor's part of the score, by lengths and marks: 0.9 where one name may hold the other, else what the marks leave of the likeness.

    An edit takes away and adds one letter and two runs of two at most; difflib's ratio counts common letters alone.
    """
    letters, runs = (F.bit_count(F.col(x).bitwiseXOR(F.col(f"{x}_there"))) for x in ("letters", "runs"))
    n, m = F.col("length"), F.col("length_there")
    if metric == "levenshtein":
        like = 1 - F.ceil(F.greatest(letters / 2, runs / 4)) / F.greatest(n, m)
    else:
        like = 1 - letters / (n + m)
    both = F.col("letters").bitwiseAND(F.col("letters_there"))
    held = (both == F.col("letters")) | (both == F.col("letters_there"))  # also where a name is missing or empty
    return F.when(held, 1.0).when(like > 0.6 - 1e-9, like).otherwise(0.0)


def match_by_place(contracts: DataFrame, projects: DataFrame, least: float = 85.0, percent: float = 1.0, metric: str = "levenshtein") -> DataFrame:
    """The best project of each contract by place (0.5), amount (0.4) and contractor (0.1). Ties go to the smallest project id.

    A match needs an amount score of 0.8 or more, so amounts differ by 1 % at most. Different contracts look for different projects in the
    rings of amounts around theirs, from narrow to wide; a project that
    cannot reach the best score so far by its amount and the marks of its contractor's name is not compared,
    and a contract for which the next ring holds none looks no further. No pair is stored or sent.
    """
    sound = lambda df, x: df.withColumn(x, F.col(x).cast("double")).where((F.col(x) > 0) & (F.col(x) < float("inf")))
    c = sound(contracts.select(F.col("id").alias("contract_id"), F.col("amount").alias("money"), standard_name(F.col("area_of_delivery"), "place").alias("area"), F.upper(F.trim("awardee")).alias("awardee")), "money")
    p = sound(projects.select(F.col("id").alias("project_id"), F.col("cost").alias("cost"), standard_name(F.col("province"), "place").alias("place"), F.upper(F.trim("contractor")).alias("contractor")), "cost")
    # places meet on the small table of distinct names first
    ratio = (lambda a, b: lev_ratio(a, b)) if metric == "levenshtein" else gestalt_ratio
    areas, places = c.select("area").where("area <> ''").distinct(), p.select("place").where("place <> ''").distinct()
    inside = containing(areas, places, "area", "place").union(containing(places, areas, "place", "area").select("area", "place")).where(F.length("place") > 3).distinct()
    like = similar_names(areas, places, "area", "place", 0.8, metric).select(F.col("a").alias("area"), F.col("b").alias("place"), "ratio")
    near = stored(inside.withColumn("at", F.lit(1.0)).unionByName(like.withColumnRenamed("ratio", "at")).groupBy("area", "place").agg(F.max("at").alias("at")).where("at >= 0.8"))
    sides = ["money", "area", "awardee"], ["place", "contractor", "cost"]
    marked = lambda df, name, end: df.withColumn("__m", _marks(F.col(name))).select("*", F.length(F.coalesce(name, F.lit(""))).alias(f"length{end}"), F.col("__m.letters").alias(f"letters{end}"), F.col("__m.runs").alias(f"runs{end}")).drop("__m")
    asked = stored(marked(c.join(near.select("area").distinct(), "area").select(*sides[0]).distinct(), "awardee", "").withColumn("who", F.monotonically_increasing_id()))
    first = F.min(F.struct("project_id")).getField("project_id")
    there = stored(marked(p.join(near.select("place").distinct(), "place").groupBy(*sides[1]).agg(first.alias("project_id")), "contractor", "_there"))
    # the places most like an area come first: others seldom reach what is found there
    near = stored(near.join(near.groupBy("area").agg(F.max("at").alias("most")), "area").select("area", "place", "at", (F.col("at") == F.col("most")).alias("main")))
    rings = _rings(there, percent)
    best = None
    for places in ("main", "NOT main"):
        if best is None or not near.where(places).isEmpty():
            for inner, ring in zip([-1.0, *rings], rings):
                found = _best_in_ring(asked, there, near.where(places), best, inner, ring, least, percent, metric, ratio)
                best = stored(found if best is None else best.unionByName(found).groupBy("who").agg(F.min("best").alias("best")))
    same = (c["money"] == asked["money"]) & (c["area"] == asked["area"]) & c["awardee"].eqNullSafe(asked["awardee"])
    got = c.join(asked, same).select("contract_id", "who").join(best, "who").groupBy("contract_id").agg(F.min("best").alias("best"))
    return got.select("contract_id", "best.project_id", (-F.col("best.below")).alias("score"))


def _rings(there: DataFrame, percent: float, few: int = 8) -> list[float]:
    """Shares by which amounts differ, up to percent %: each eight times the one before, the first so small that a contract meets few projects within it."""
    bucket = F.floor(F.log("cost") / -math.log(1 - percent / 100))
    met = there.groupBy("place", bucket.alias("k")).agg(F.count("*").alias("n")).agg(2 * F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 0
    ends = [percent / 100]
    while met > few:
        ends.insert(0, ends[0] / 8)
        met /= 8
    return ends


def _best_in_ring(asked: DataFrame, there: DataFrame, near: DataFrame, best: DataFrame | None, inner: float, ring: float, least: float, percent: float, metric: str, ratio) -> DataFrame:
    """(who, best) of those for whom a project whose amount differs by more than `inner` and at most `ring` has at least the best score so far."""
    open_ = asked.withColumn("floor", F.lit(least)) if best is None else asked.join(best.select("who", (-F.col("best.below")).alias("score")), "who", "left").withColumn("floor", F.coalesce("score", F.lit(least))).drop("score")
    lowest = F.col("floor") - 0.0051  # what rounds to the floor
    # the amount's part of the score falls from 40 to 0 over 5 %
    room = F.col("at") * 50 + 40 - lowest
    reach = F.least(F.lit(ring), (room + 10) / 800 + 1e-9)
    width = -math.log(1 - ring) * (1 + 1e-9)
    open_ = open_.join(near, "area").withColumns({"room": room + 1e-6, "reach": reach}).where((F.col("reach") > 0) & (F.col("reach") > inner))
    log, span = F.log("money"), -F.log(1 - F.col("reach")) + 1e-9
    x = open_.withColumn("__k", F.explode(F.sequence(F.floor((log - span) / width), F.floor((log + span) / width)))).drop("area", "reach", "floor", "main")
    y = there.withColumn("__k", F.floor(F.log("cost") / width)).hint("merge")
    p, q = F.col("money"), F.col("cost")
    off = F.abs(p - q) / F.greatest(p, q)
    # little code in the join, so that the JVM compiles it
    met = x.join(y, ["place", "__k"]).where((off > inner) & (off <= ring) & (off * 800 - _most_alike(metric) * 10 <= F.col("room")))
    by_amount = amount_score(p, q)
    if percent > 1:
        met = met.where(by_amount >= 0.8)
    a, b = F.col("awardee"), F.col("contractor")
    names = F.when(a == b, 1.0).when(F.contains(a, b) | F.contains(b, a), 0.9).when(F.col("like") > 0.6, F.col("like")).otherwise(0.0)
    score = F.round((F.col("at") * 0.5 + by_amount * 0.4 + names * 0.1) * 100, 2)
    return met.withColumn("like", ratio(a, b)).select("who", F.struct((-score).alias("below"), "project_id").alias("best")).groupBy("who").agg(F.min("best").alias("best")).where(F.col("best.below") <= -least)
