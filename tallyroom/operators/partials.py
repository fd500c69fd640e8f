"""Summaries from stored partial aggregates (S13, G4, G5): years that changed are counted again, all others are merged from what is stored.

`path/sums/year=Y` has a row for each year: rows, sum and, for each column whose
different values are counted, a HyperLogLog sketch. `path/values/year=Y` has the
values themselves with their rows, for exact counts over any years.
Both merge: sums add up, sketches unite, values meet by value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rollups import long_values


def refresh(df: DataFrame, path: str, *, year: str, amount: str, distinct: list[str]) -> None:
    """Store the partial aggregates of the years that df has, whole, in place of those years' earlier ones."""
    known = df.where(F.col(year).isNotNull()).withColumn("year", F.col(year).cast("long"))
    sketches = [F.hll_sketch_agg(F.col(c).cast("string")).alias(f"sketch_{c}") for c in distinct]
    sums = known.groupBy("year").agg(F.count("*").alias("n"), F.sum(F.col(amount).cast("decimal(28,2)")).alias("total"), *sketches)
    values = long_values(known.select("year", *distinct), distinct, skip=(), keep=("year",)).groupBy("year", "column_name", "value").agg(F.count("*").alias("n"))
    for part, got in (("sums", sums), ("values", values)):
        got.repartition("year").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(f"{path}/{part}")


def merged(spark: SparkSession, path: str, distinct: list[str], years: list[int] | None = None) -> DataFrame:
    """(scope, n, total, a count of different values for each column, and about_<column> from its sketch) for each year and for all of them."""
    sums, values = (spark.read.parquet(f"{path}/{part}") for part in ("sums", "values"))
    if years is not None:
        sums, values = (df.where(F.col("year").isin(years)) for df in (sums, values))
    scope = F.when(F.grouping("year") == 1, "all_years").otherwise(F.col("year").cast("string")).alias("scope")
    about = [F.hll_sketch_estimate(F.hll_union_agg(f"sketch_{c}")).alias(f"about_{c}") for c in distinct]
    totals = sums.rollup("year").agg(scope, F.sum("n").alias("n"), F.sum("total").alias("total"), *about).drop("year")
    # a year has each value once; over the years values are made different first
    each = values.groupBy(F.col("year").cast("string").alias("of"), "column_name").agg(F.count("*").alias("k"))
    whole = values.select("column_name", "value").distinct().groupBy(F.lit("all_years").alias("of"), "column_name").agg(F.count("*").alias("k"))
    wide = each.unionByName(whole).groupBy("of").pivot("column_name", distinct).agg(F.first("k"))
    got = totals.join(wide, F.col("scope") == F.col("of"), "left").where("n IS NOT NULL").drop("of")
    return got.na.fill(0, distinct)
