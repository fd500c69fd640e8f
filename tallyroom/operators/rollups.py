"""Statistics, distributions, facets and catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def measures(amount: str) -> list[Column]:
    a = F.col(amount)
    return [F.count("*").alias("n"), F.sum(a).alias("total")]


def full_measures(amount: str) -> list[Column]:
    a = F.col(amount)
    return [*measures(amount), (F.sum(a).cast("double") / F.count(a)).alias("mean"), F.min(a).alias("least"), F.max(a).alias("most")]


def top_by(df: DataFrame, label: str, amount: str, n: int = 10, extra: list[Column] | None = None) -> DataFrame:
    """Groups with the highest sums; labels that say nothing take no part."""
    known = df.where(F.col(label).isNotNull() & ~F.col(label).cast("string").isin("", "INVALID"))
    return known.groupBy(F.col(label).alias("label")).agg(*measures(amount), *(extra or [])).orderBy(F.desc("total"), "label").limit(n)


def overview(df: DataFrame, year: str, amount: str) -> DataFrame:
    """Rows per year and one for all years, in one pass."""
    return df.rollup(year).agg(*measures(amount), F.grouping_id().alias("g")).select(F.when(F.col("g") == 1, "all_years").otherwise(F.col(year).cast("string")).alias("scope"), "n", "total")


def shares(df: DataFrame, label: str, amount: str, n: int | None = None, of: str = "rows", order: str = "n") -> DataFrame:
    """(label, n, total, percent): percent of all rows, null labels included, or of the whole sum of known labels."""
    known = df.where(F.col(label).isNotNull())
    whole = df.agg(F.count("*").cast("double").alias("whole")) if of == "rows" else known.agg(F.sum(amount).cast("double").alias("whole"))
    got = known.groupBy(F.col(label).alias("label")).agg(*measures(amount)).crossJoin(F.broadcast(whole))  # one row
    part = F.col("n") if of == "rows" else F.col("total").cast("double")
    got = got.select("label", "n", "total", F.round(100 * part / F.col("whole"), 2).alias("percent"))
    return got.orderBy(F.desc(order), "label").limit(n) if n else got


def ranked(df: DataFrame, *order: Column, name: str = "rank", partition: list[str] | None = None) -> DataFrame:
    w = Window.partitionBy(*partition) if partition else Window.partitionBy(F.lit(0))
    return df.withColumn(name, F.row_number().over(w.orderBy(*order)))


def _ranges(df: DataFrame, order: tuple[str, ...], parts: int) -> Column:
    """The range of each row, of about `parts` over the whole order (null first), by bounds from a bounded sample of rows. All columns of the order count, so a frequent first value is more than one range."""
    some = df.select(*order).orderBy(F.rand(7)).limit(parts * 16).collect()
    known = sorted({tuple(r) for r in some}, key=lambda r: tuple((x is not None, x) for x in r))
    bounds = [known[i] for i in sorted({len(known) * k // parts for k in range(1, parts)}) if i < len(known)]
    if not bounds:
        return F.lit(0)
    kinds = [df.schema[c].dataType for c in order]
    literal = lambda row: F.struct(*[F.lit(x).cast(k).alias(c) for x, k, c in zip(row, kinds, order)])
    own = F.struct(*order)
    return F.size(F.filter(F.array(*map(literal, bounds)), lambda b: b < own))


def running_total(df: DataFrame, amount: Column, *order: str, name: str = "running", partition: tuple[str, ...] = (), parts: int = 64) -> DataFrame:
    """df with the sum of amount so far over the whole order, or in each partition of it, without one task for all rows.

    Rows are dealt out by ranges of the order; the sum is that in the row's
    range and of the ranges before. The bounds balance the tasks, and change no sum.
    """
    dealt = df.withColumns({"__range": _ranges(df, order, parts), "__amount": amount})
    sums = dealt.groupBy(*partition, "__range").agg(F.sum("__amount").alias("__sum"))  # `parts` rows a partition
    before = Window.partitionBy(*partition) if partition else Window.partitionBy(F.lit(0))
    sums = sums.withColumn("__before", F.sum("__sum").over(before.orderBy("__range")) - F.col("__sum")).drop("__sum")
    own = Window.partitionBy(*partition, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = dealt.withColumn("__own", F.sum("__amount").over(own)).join(sums, [*partition, "__range"])
    return got.withColumn(name, F.col("__own") + F.col("__before")).drop("__own", "__before", "__range", "__amount")


def numbered(df: DataFrame, *order: str, name: str = "position", partition: tuple[str, ...] = (), parts: int = 64) -> DataFrame:
    """df with row numbers over the whole order, or in each partition of it: running totals of one a row."""
    return running_total(df, F.lit(1).cast("long"), *order, name=name, partition=partition, parts=parts)


def exact_quantile(df: DataFrame, group: list[str], amount: str, q: float = 0.5, accuracy: int = 10_000) -> DataFrame:
    """group and `quantile`, with linear interpolation, exactly, without a group's amounts in one place. Null and NaN amounts take no part.

    A first pass gives each group's size and, by a sketch whose error is at most
    1 / accuracy of its rows, two amounts with the sought places between them. A second
    counts what is below, and the different amounts between, of which only a
    few in `accuracy` rows are left. Groups of up to 4 * accuracy rows are between their ends.
    """
    x = F.col(amount).cast("double")
    known = df.select(*group, x.alias("__x")).where(F.col("__x").isNotNull() & ~F.isnan("__x"))
    near = [max(0.0, q - 2 / accuracy), min(1.0, q + 2 / accuracy)]
    ends = known.groupBy(*group).agg(F.count("*").alias("__n"), F.min("__x").alias("__least"), F.max("__x").alias("__most"), F.percentile_approx("__x", near, accuracy).alias("__near"))
    small = F.col("__n") <= 4 * accuracy
    ends = ends.select(*[F.col(c).alias(f"__of_{c}") for c in group], "__n", F.when(small, F.col("__least")).otherwise(F.col("__near")[0]).alias("__low"), F.when(small, F.col("__most")).otherwise(F.col("__near")[1]).alias("__high"))
    same = [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in group]
    # amounts below the bracket count as one that is
    between = known.join(ends, same).where(F.col("__x") <= F.col("__high")).withColumn("__x", F.when(F.col("__x") >= F.col("__low"), F.col("__x")))
    counts = between.groupBy(*group, "__n", "__x").agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(*group).orderBy(F.asc_nulls_first("__x")))
    place = q * (F.col("__n") - 1)
    first, second = F.floor(place) + 1, F.ceil(place) + 1
    counts = counts.withColumn("__upto", upto)
    at = lambda k: F.min(F.when(F.col("__x").isNotNull() & (F.col("__upto") >= k), F.col("__x")))
    found = counts.groupBy(*group, "__n").agg(at(first).alias("__a"), at(second).alias("__b"))
    return found.select(*group, (F.col("__a") + (F.col("__b") - F.col("__a")) * (place - F.floor(place))).alias("quantile"))


def regional_profile(df: DataFrame, label: str, amount: str, least_rows: int) -> DataFrame:
    """Statistics of the labels with `least_rows` rows or more, and the exact median."""
    named = df.withColumn("label", F.col(label))
    middle = exact_quantile(named, ["label"], amount).select(F.col("label").alias("__label"), F.col("quantile").alias("median"))
    got = named.groupBy("label").agg(*full_measures(amount)).where(F.col("n") >= least_rows)
    return got.join(middle, F.col("label").eqNullSafe(F.col("__label")), "left").drop("__label")


def long_values(df: DataFrame, columns: list[str], skip: tuple[str, ...] = ("", "INVALID"), keep: tuple[str, ...] = ()) -> DataFrame:
    """(column_name, value) of the known values of all columns, with the columns to keep: one scan for all of them."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns]))
    known = df.select(*keep, pairs.alias("x")).select(*keep, "x.*").where(F.col("value").isNotNull())
    return known.where(~F.col("value").isin(*skip)) if skip else known


def keyword_statistics(df: DataFrame, label: str, amount: str, order: list[str], top: int = 5) -> DataFrame:
    """Statistics of each label, and the sum of its `top` largest amounts: only those are ranked."""
    first = ranked(df, F.desc(amount), *[F.col(c) for c in order], partition=[label]).where(F.col("rank") <= top)
    first = first.groupBy(label).agg(F.sum(amount).alias(f"top{top}"))
    return df.groupBy(label).agg(*full_measures(amount)).join(first, label, "left")


def value_catalog(df: DataFrame, columns: list[str], per_column: int | None = None) -> DataFrame:
    got = long_values(df, columns, ("", "INVALID", "-1")).groupBy("column_name", "value").agg(F.count("*").alias("n"))
    if per_column:
        got = ranked(got, F.desc("n"), F.col("value"), partition=["column_name"]).where(F.col("rank") <= per_column).drop("rank")
    return got


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, nulls, zeros, blanks) in one pass."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in columns]))
    c = df.select(cells.alias("x")).select("x.*")
    return c.groupBy("column_name").agg(F.count_if(F.col("v").isNull()).alias("nulls"), F.count_if(F.col("v").try_cast("double") == 0).alias("zeros"), F.count_if(F.trim("v") == "").alias("blanks"))


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.trim(F.col(c).cast("string")).alias("v")) for c in columns]))
    got = df.select(cells.alias("x")).select("x.*").groupBy("column_name").agg(F.count_if(F.length("v") > 0).alias("filled"), F.count("*").alias("n"))
    return got.withColumn("percent", F.round(100.0 * F.col("filled") / F.col("n"), 2))


def overlap(df: DataFrame, a: str, b: str, c: str) -> DataFrame:
    """The seven regions of three flags, and their totals."""
    x, y, z = F.col(a), F.col(b), F.col(c)
    return df.agg(
        F.count_if(x & ~y & ~z).alias("only_a"), F.count_if(~x & y & ~z).alias("only_b"), F.count_if(~x & ~y & z).alias("only_c"), F.count_if(x & y & ~z).alias("ab"), F.count_if(x & ~y & z).alias("ac"), F.count_if(~x & y & z).alias("bc"),
        F.count_if(x & y & z).alias("abc"), F.count_if(x).alias("all_a"), F.count_if(y).alias("all_b"), F.count_if(z).alias("all_c"),
    )


def dense_grid(got: DataFrame, rows: DataFrame, columns: DataFrame, keys: list[str]) -> DataFrame:
    """got, with zeros for the pairs that it lacks; rows and columns are short lists of keys."""
    return rows.crossJoin(F.broadcast(columns)).join(got, keys, "left").na.fill(0)
