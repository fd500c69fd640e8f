"""Operator 1: mixing sources to target weights.

Targets: every source gets words in proportion to its weight, up to `cap` times
its own size; what a source cannot take is shared out again by weight. In
closed form target = min(cap * size, level * weight) for one level, found from
running sums over the sources.

Sainte-Lague: the words of a source are cut into blocks of equal size. Blocks
go to sources by the highest quotients votes / (k - 1/2), then the blocks of a
source go to its shards in the same way, so every shard has an integer quota.
A shard takes all its blocks quota // blocks times and one more of the first
quota % blocks in a seeded order of its blocks.

A shard holds some hundred documents, chosen by a seeded hash of the id and the text; a
source of a third of all rows has a third of all shards. Only counts per source
and per shard are ranked, never documents; the number of shards is bounded by
`max_shards` (then shards grow).

Defined results: size is the number of words, 0 for a null or blank text; a
null source is a source of its own and last in the order; rows that repeat are
documents of their own; rows without doc_id, or of one id, are dealt out by their
texts, and only those with equal texts too stand in one shard; documents of no words take 0; a text counts whole,
however long; an empty table gives an empty table; input columns named as a
result column are replaced, all others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, drop_clashes, stage

#: Odd primes above any number of blocks in a shard, so that i -> (p * i + c) mod n permutes 0..n-1.
_PRIMES = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543, 2147483497)


def _level(by: DataFrame, total: float, cap: float) -> DataFrame:
    """by (source, none, size, weight) with its target; total: share of all sizes to hand out."""
    w = Window.orderBy(F.col("size") / F.col("weight"), "none", "source")
    run = by.withColumns({
        "ratio": F.col("size") / F.col("weight"),
        "full": F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * F.lit(cap),
        "open": F.sum("weight").over(w.rowsBetween(0, Window.unboundedFollowing)),
        "all": F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    })
    # the first source whose level stays under its cap sets the level of all from there on
    run = run.withColumn("level", (F.col("all") * F.lit(total) - F.col("full")) / F.col("open"))
    first = F.min(F.when(F.col("level") <= F.col("ratio") * F.lit(cap), F.struct("ratio", "none", "source", "level"))).over(Window.partitionBy(F.lit(1)))
    run = run.withColumn("set", first["level"])
    return run.withColumn("target", F.when(F.col("set").isNull(), F.col("size") * F.lit(cap)).otherwise(F.least(F.col("size") * F.lit(cap), F.col("set") * F.col("weight"))).cast("double"))


def _sainte_lague(cells: DataFrame, group: list[str], order: list[str], votes: str, seats: str) -> DataFrame:
    """cells with `quota`: the seats of each group (column `seats`, the same in all its cells) by the highest quotients votes / (k - 1/2).

    All cells get the seats that no order of quotients can take from them; only
    the last few of each cell are ranked, about three a cell.
    """
    all_of = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    share = F.when(F.col("__all") > 0, F.col(votes) / F.col("__all")).otherwise(0.0)
    base = cells.withColumn("__all", F.sum(votes).over(all_of)).withColumn("__share", share).withColumn("__mid", F.round(F.col(seats) * F.col("__share")).cast("long"))
    base = base.withColumn("__off", F.abs(F.sum("__mid").over(all_of) - F.col(seats)))
    wide = (F.ceil(F.col("__off") * F.col("__share")) + 1).cast("long")
    base = base.withColumns({"__low": F.greatest(F.lit(0).cast("long"), F.col("__mid") - wide), "__high": F.col("__mid") + wide})
    base = base.withColumn("__left", F.col(seats) - F.sum("__low").over(all_of))
    ks = base.withColumn("__k", F.explode(F.expr("if(__high > __low, sequence(__low + 1, __high), array())"))).where(F.col(votes) > 0)
    best = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    won = ks.withColumn("__rank", F.row_number().over(best.orderBy(F.desc(F.col(votes) / (F.col("__k") - 0.5)), *order, "__k"))).where(F.col("__rank") <= F.col("__left"))
    keys = list(dict.fromkeys([*group, *order]))
    won = won.groupBy(*keys).agg(F.count("*").alias("__won"))
    out = base.join(won, keys, "left").withColumn("quota", F.col("__low") + F.coalesce("__won", F.lit(0)))
    return out.select(*cells.columns, "quota")


def mix_sources(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0,
    block_words: int = 64, shard_words: int = 65_536, max_shards: int = 100_000, seed: int = 1,
) -> DataFrame:
    """docs with size, source_size, target (of the source), taken (words, repeats counted) and spans (runs [from, to) of words and how many times each is taken).

    weights repeat over the sources in code-point order.
    """
    names = ["size", "source_size", "target", "taken", "spans"]
    docs = drop_clashes(docs, names)
    sized = docs.withColumns({"size": F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"), "__src": F.coalesce(F.col(source).cast("string"), F.lit("")), "__none": F.col(source).isNull(), "__text": F.xxhash64(text)})
    by = sized.groupBy(F.col("__src").alias("source"), F.col("__none").alias("none")).agg(F.sum("size").alias("size"))
    turn = (F.row_number().over(Window.orderBy("none", "source")) - 1) % len(weights)
    by = by.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), turn))
    by = _level(by, share, cap)
    per_shard = F.greatest(F.lit(shard_words), F.ceil(F.col("all") / max_shards))
    by = stage(by.select("source", "none", F.col("size").alias("source_size"), "target", F.greatest(F.lit(1), F.ceil(F.col("size") / per_shard)).cast("long").alias("__shards")))

    key = ["__src", "__none"]
    named = by.withColumnsRenamed({"source": "__src", "none": "__none"})
    placed = sized.join(named, key).withColumns({"__order": F.xxhash64(F.lit(seed), doc_id, "__text"), "__shard": F.pmod(F.xxhash64(F.lit(seed + 1), doc_id, "__text"), F.col("__shards"))})
    cells = placed.groupBy(*key, "__shard").agg(F.sum("size").alias("n")).withColumn("blocks", F.ceil(F.col("n") / block_words).cast("long"))
    cells = stage(cells)
    seats = named.join(cells.groupBy(*key).agg(F.sum("blocks").alias("blocks")), key)
    seats = seats.withColumn("votes", F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0))
    seats = seats.withColumn("total", F.round(F.sum("votes").over(Window.partitionBy(F.lit(0)))).cast("long"))
    seats = _sainte_lague(seats, [], key, "votes", "total").withColumn("given", F.least("quota", F.round(F.col("blocks") * cap).cast("long")))
    shards = cells.join(seats.select(*key, "given"), key).withColumn("votes", F.col("blocks").cast("double"))
    shards = _sainte_lague(shards, key, [*key, "__shard"], "votes", "given")
    p = F.get(F.array(*[F.lit(x) for x in _PRIMES]), F.pmod(F.xxhash64(F.lit(seed + 2), *key, "__shard"), F.lit(len(_PRIMES))).cast("int"))
    shards = stage(shards.select(*key, "__shard", F.greatest("n", F.lit(1)).alias("__n"), F.greatest("blocks", F.lit(1)).alias("__blocks"), F.least("quota", F.floor(F.col("blocks") * cap)).alias("__quota"), p.alias("__p"), F.pmod(F.xxhash64(F.lit(seed + 3), *key, "__shard"), F.greatest("blocks", F.lit(1))).alias("__c")))

    at = Window.partitionBy(*key, "__shard").orderBy("__order", doc_id, "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = placed.withColumn("__end", F.sum("size").over(at)).join(shards, [*key, "__shard"])
    rows = rows.withColumn("__start", F.col("__end") - F.col("size"))

    def begins(i: Column) -> Column:
        """The first word of block i: blocks of a shard differ by one word at most."""
        return F.floor(i * F.col("__n") / F.col("__blocks"))

    def times(i: Column) -> Column:
        again = F.pmod(F.col("__p") % F.col("__blocks") * i + F.col("__c"), F.col("__blocks")) < F.col("__quota") % F.col("__blocks")
        return F.floor(F.col("__quota") / F.col("__blocks")) + F.when(again, 1).otherwise(0)

    def span(i: Column) -> Column:
        a, b = F.greatest(begins(i), F.col("__start")), F.least(begins(i + 1), F.col("__end"))
        return F.struct((a - F.col("__start")).cast("long").alias("start"), (b - F.col("__start")).cast("long").alias("end"), times(i).cast("long").alias("times"))

    # the blocks around the place that the document's ends have, one more on either side for rounding
    near = F.sequence(F.greatest(F.lit(0).cast("long"), F.floor(F.col("__start") * F.col("__blocks") / F.col("__n")) - 1), F.least(F.col("__blocks") - 1, F.floor(F.col("__end") * F.col("__blocks") / F.col("__n")) + 1))
    spans = F.filter(F.transform(near, span), lambda s: (s["start"] < s["end"]) & (s["times"] > 0))
    rows = rows.withColumn("spans", F.when(F.col("size") > 0, spans).otherwise(F.expr("cast(array() AS array<struct<start: bigint, end: bigint, times: bigint>>)")))
    rows = rows.withColumn("taken", F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + (s["end"] - s["start"]) * s["times"]))
    return rows.select(*docs.columns, *names)
