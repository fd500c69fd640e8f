"""Growth, anomaly screens and risk."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import growth


def pivot_years(df: DataFrame, label: str, year: str, amount: str, years: list[int]) -> DataFrame:
    """A row per label with a sum per year, and the percent change to each year from the one before."""
    got = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).pivot(year, years).agg(F.sum(amount))
    got = got.select("label", *[F.coalesce(F.col(str(y)).cast("double"), F.lit(0.0)).alias(f"y{y}") for y in years])
    got = got.withColumns({f"g{b}": growth(F.col(f"y{b}"), F.col(f"y{a}")) for a, b in zip(years, years[1:])})
    return got.withColumn("total", reduce(lambda a, b: a + b, [F.col(f"y{y}") for y in years]))


def yearly_growth(df: DataFrame, year: str, amount: str, alert: float = 20.0) -> DataFrame:
    """Total per year, growth from the year before, and whether it is an alert. A few rows, one per year."""
    totals = df.groupBy(F.col(year).alias("year")).agg(F.sum(amount).cast("double").alias("total"))
    got = totals.withColumn("growth", growth(F.col("total"), F.lag("total").over(Window.orderBy("year"))))
    return got.withColumn("alert", (F.col("growth") >= alert).cast("int"))


def against_mean(df: DataFrame, label: Column, year: str, amount: str, latest: int) -> DataFrame:
    """Latest sum per label against the mean of the earlier years (years with a positive sum) and the last one."""
    per = df.groupBy(label.alias("label"), F.col(year).alias("year")).agg(F.sum(amount).cast("double").alias("total"))
    got = per.groupBy("label").agg(
        F.sum(F.when(F.col("year") == latest, F.col("total"))).alias("latest"), F.avg(F.when((F.col("year") < latest) & (F.col("total") > 0), F.col("total"))).alias("mean"), F.sum(F.when(F.col("year") == latest - 1, F.col("total"))).alias("last"),
    ).na.fill(0.0, ["latest", "mean", "last"])
    return got.withColumns({"over_mean": growth(F.col("latest"), F.col("mean")), "over_last": growth(F.col("latest"), F.col("last"))})


def sudden_rise(now: DataFrame, before: DataFrame, label: str, amount: str, least: float = 0.0, new_least: float = 0.0, alert: float = 50.0) -> DataFrame:
    """Groups of `now` against `before`: growth of count and amount; groups that are new have no growth and status NEW."""
    a = now.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"), F.sum(amount).cast("double").alias("total"))
    b = before.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n_before"), F.sum(amount).cast("double").alias("before"))
    got = a.join(b, "label", "left").withColumn("is_new", F.col("before").isNull())
    got = got.withColumns({"growth": F.when(~F.col("is_new"), growth(F.col("total"), F.col("before"))), "n_growth": F.when(~F.col("is_new"), growth(F.col("n"), F.col("n_before"))), "increase": F.col("total") - F.coalesce("before", F.lit(0.0))})
    status = F.when(F.col("is_new") & (F.col("total") >= new_least), "NEW").when((F.col("growth") >= alert) & (F.col("total") >= least), "ALERT").otherwise("OK")
    return got.withColumn("status", status).na.fill(0, ["n_before", "before"])


def new_large_items(now: DataFrame, before: DataFrame, keys: list[str], amount: str, least: float, n: int, on: str) -> DataFrame:
    """The n largest items of `now`, then those of which the description is absent in `before`. The limit comes first."""
    top = now.where(F.col(amount) >= least).groupBy(*keys).agg(F.count("*").alias("n")).withColumn("total", F.col(amount).cast("double") * F.col("n"))
    top = top.orderBy(F.desc(amount), *keys).limit(n)
    return top.join(before.select(on).distinct(), on, "left_anti")


def concentration(df: DataFrame, label: str, amount: str, top: int = 3, within: int | None = None) -> DataFrame:
    """Share of rows and of amount that the first `top` groups hold, of all groups or of the first `within`."""
    got = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"), F.sum(amount).cast("double").alias("total"))
    if within:
        got = got.orderBy(F.desc("total"), "label").limit(within)
    first = got.orderBy(F.desc("total"), "label").limit(top).agg(F.sum("n").alias("n_first"), F.sum("total").alias("first"))
    whole = got.agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.count("*").alias("groups"))
    out = whole.crossJoin(F.broadcast(first))  # one row each
    out = out.select((100.0 * F.col("n_first") / F.col("n")).alias("row_share"), (100.0 * F.col("first") / F.col("total")).alias("amount_share"), "groups")
    return out.withColumn("flag", F.when(F.col("amount_share") >= 60, "HIGH").when(F.col("amount_share") >= 48, "MODERATE").otherwise("LOW"))


def risk(indicators: DataFrame) -> DataFrame:
    """Rows (indicator, level) to a score (HIGH 3, MODERATE 1) and a level."""
    got = indicators.agg(F.coalesce(F.sum(F.when(F.col("level") == "HIGH", 3).when(F.col("level") == "MODERATE", 1).otherwise(0)), F.lit(0)).alias("score"), F.count("*").alias("indicators"))
    return got.withColumn("level", F.when(F.col("score") >= 6, "CRITICAL").when(F.col("score") >= 3, "HIGH").when(F.col("score") >= 1, "MODERATE").otherwise("LOW"))
