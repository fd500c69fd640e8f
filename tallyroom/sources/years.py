"""Tables with a folder for each year (S1, S2): scans read the years they ask for and no others.

A table is `path/year=Y/` and, beside it, the catalog `path-years` with the years' rows.
A year that a query names is pruned when the plan is made (partition filters);
years that follow from data, like the one before the latest, are pruned when the join's small side,
rows of the catalog, is known (dynamic partition pruning).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import year_scan


def write_years(df: DataFrame, path: str, year: str = "year", rows_a_file: int = 5_000_000) -> None:
    """Overwrite the years that df has, and no others. A year's rows go to as many files, and tasks, as it needs, however uneven the years are."""
    counts = df.groupBy(year).agg(F.count("*").alias("rows")).where(F.col(year).isNotNull())
    files = F.greatest(F.lit(1), F.ceil(F.col("__rows") / rows_a_file)).cast("int")
    dealt = df.join(F.broadcast(counts.withColumnRenamed("rows", "__rows")), year)  # a row for each year
    dealt = dealt.withColumn("__file", F.pmod(F.xxhash64(*df.columns), files)).repartition(year, "__file").drop("__rows", "__file")
    option = lambda w: w.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_a_file).partitionBy(year)
    option(dealt.write).parquet(path)
    option(counts.coalesce(1).write).parquet(f"{path}-years")


class YearTable:
    """A table that `write_years` wrote; schema without the year."""

    def __init__(self, spark: SparkSession, path: str, schema: str, year: str = "year"):
        self.year = year
        self.lines = spark.read.schema(f"{schema}, {year} long").parquet(path)
        self.catalog = spark.read.schema(f"rows long, {year} long").parquet(f"{path}-years")

    def of(self, year: str | int) -> DataFrame:
        """Rows of one year, named in the query. What isn't four digits is an error, an absent year gives no rows."""
        return year_scan(self.lines, year, self.year)

    def between(self, first: int, last: int) -> DataFrame:
        return self.lines.where(F.col(self.year).between(first, last))

    def among(self, years: DataFrame) -> DataFrame:
        """Rows of the years in the first column of a small table, mostly rows of the catalog."""
        return self.lines.join(years.select(F.col(years.columns[0]).alias(self.year)).distinct(), self.year)

    def before(self, year: int, n: int = 1) -> DataFrame:
        """Rows of the n latest years before one, of those that have rows."""
        there = self.catalog.where((F.col(self.year) < year) & (F.col("rows") > 0))
        return self.among(there.orderBy(F.desc(self.year)).limit(n).select(self.year))
