"""Comparing sources: schema drift, full outer compares, reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rollups import numbered


def canonical(gaa: DataFrame, nep: DataFrame) -> DataFrame:
    """Enacted and proposed lines in one schema; region codes are two digits, 0 and -1 are none."""
    a = gaa.select(
        F.lit("GAA").alias("source"), F.col("sorder").cast("string").alias("id"), F.col("year").cast("long").alias("fiscal_year"), F.col("amt").cast("decimal(20,2)").alias("amount"), F.col("dsc").alias("description"),
        F.lpad(F.when(F.col("operunit") > 0, F.col("operunit").cast("string")), 12, "0").alias("org_code"), F.lpad(F.when(F.col("uacs_reg_id") > 0, F.col("uacs_reg_id").cast("string")), 2, "0").alias("region_code"),
        F.when(F.col("fundcd") > 0, F.col("fundcd").cast("string")).alias("funding_code"), F.when(F.col("uacs_sobj_cd") > 0, F.col("uacs_sobj_cd").cast("string")).alias("object_code"),
    )
    b = nep.select(
        F.lit("NEP").alias("source"), F.col("record_id").alias("id"), F.col("fiscal_year").cast("long").alias("fiscal_year"), F.col("amount").cast("decimal(20,2)").alias("amount"), "description", F.col("org_uacs_code").alias("org_code"),
        F.when(~F.col("region_code").isin("00", "-1"), F.col("region_code")).alias("region_code"), F.col("funding_uacs_code").alias("funding_code"), F.col("object_uacs_code").alias("object_code"),
    )
    return a.unionByName(b)


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, type, nulls, distinct values) in one pass over the rows."""
    kinds = dict(df.dtypes)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(kinds[c]).alias("kind"), F.col(c).cast("string").alias("v")) for c in columns]))
    return df.select(cells.alias("x")).select("x.*").groupBy("column_name", "kind").agg(F.count_if(F.col("v").isNull()).alias("nulls"), F.count_distinct("v").alias("values"), F.count("*").alias("n"))


def schema_drift(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Each column of two tables: missing on a side, of another type, of another profile, or the same."""
    x = column_profile(a, [c for c in columns if c in a.columns]).withColumnsRenamed({"kind": "kind_a", "nulls": "nulls_a", "values": "values_a", "n": "n_a"})
    y = column_profile(b, [c for c in columns if c in b.columns]).withColumnsRenamed({"kind": "kind_b", "nulls": "nulls_b", "values": "values_b", "n": "n_b"})
    got = x.join(y, "column_name", "full")
    status = F.when(F.col("kind_a").isNull(), "missing_in_a").when(F.col("kind_b").isNull(), "missing_in_b").when(F.col("kind_a") != F.col("kind_b"), "type_changed")
    same = (F.col("values_a") == F.col("values_b")) & (F.col("nulls_a") / F.col("n_a") == F.col("nulls_b") / F.col("n_b"))
    return got.select("column_name", status.when(same, "same").otherwise("profile_changed").alias("status"), "values_a", "values_b", "nulls_a", "nulls_b")


def full_compare(a: DataFrame, b: DataFrame, key: str, amount_a: str, amount_b: str) -> DataFrame:
    """Counts and sums by key on both sides, a missing side is 0; null is a key of its own. Both sides are aggregated first."""
    x = a.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n_a"), F.sum(amount_a).cast("double").alias("total_a"))
    y = b.groupBy(F.col(key).alias("other")).agg(F.count("*").alias("n_b"), F.sum(amount_b).cast("double").alias("total_b"))
    got = x.withColumn("in_a", F.lit(True)).join(y.withColumn("in_b", F.lit(True)), F.col("key").eqNullSafe(F.col("other")), "full")
    got = got.select(F.when(F.col("in_a"), F.col("key")).otherwise(F.col("other")).alias("key"), "n_a", "total_a", "n_b", "total_b", F.coalesce("in_a", F.lit(False)).alias("in_a"), F.coalesce("in_b", F.lit(False)).alias("in_b"))
    got = got.na.fill(0, ["n_a", "total_a", "n_b", "total_b"])
    return got.withColumn("difference", F.col("total_a") - F.col("total_b"))


def reconcile(files: DataFrame, table: DataFrame, key: str, amount: str, tolerance: float = 1.0) -> DataFrame:
    """Per key: MATCH, MISMATCH, or on which side it is MISSING."""
    got = full_compare(files, table, key, amount, amount)
    status = F.when(~F.col("in_b"), "MISSING_IN_TABLE").when(~F.col("in_a"), "MISSING_IN_FILES").when((F.col("n_a") == F.col("n_b")) & (F.abs("difference") < tolerance), "MATCH").otherwise("MISMATCH")
    return got.withColumn("status", status)


def coverage(files: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Rows of files, of which are in the table, missing ones, and percent covered."""
    there = table.select(key).distinct().withColumn("there", F.lit(1))
    got = files.join(there, key, "left").agg(F.count("*").alias("files"), F.count("there").alias("loaded"))
    return got.select("files", "loaded", (F.col("files") - F.col("loaded")).alias("missing"), (100.0 * F.col("loaded") / F.col("files")).alias("percent"))


def paired_rows(a: DataFrame, b: DataFrame, group: list[str], order: list[str], amount: str) -> DataFrame:
    """Rows of both sides at the same place of an explicit order, and the difference of their amounts."""
    x = numbered(a, *order, partition=tuple(group)).select(*group, "position", F.col(amount).cast("double").alias("a"))
    y = numbered(b, *order, partition=tuple(group)).select(*group, "position", F.col(amount).cast("double").alias("b"))
    return x.join(y, [*group, "position"]).withColumn("difference", F.round(F.abs(F.col("a") - F.col("b")), 2))


def difference_bands(pairs: DataFrame) -> DataFrame:
    """Six bands of the difference, with rows, percent, mean and largest."""
    d = F.col("difference")
    band = F.when(d < 0.01, "0 none").when(d < 1, "1 under 1").when(d < 100, "2 under 100").when(d < 1000, "3 under 1000").when(d < 10000, "4 under 10000").otherwise("5 more")
    got = pairs.withColumn("band", band).groupBy("band").agg(F.count("*").alias("n"), F.avg("difference").alias("mean"), F.max("difference").alias("most"))
    return got.crossJoin(F.broadcast(pairs.agg(F.count("*").alias("whole")))).select("band", "n", (100.0 * F.col("n") / F.col("whole")).alias("percent"), "mean", "most")
