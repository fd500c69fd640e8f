"""Scans, loads and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import org_parts

BATCH_SCHEMA = "id string, budget_type string, fiscal_year string, amount decimal(20,2), description string, prexc_fpap_id string, org_uacs_code string, region_code string, funding_uacs_code string, object_uacs_code string, funding_conversion_type string"
CONTRACT_SCHEMA = "reference_id string, contract_no string, award_title string, notice_title string, awardee_name string, organization_name string, area_of_delivery string, business_category string, contract_amount decimal(20,2), award_date date, award_status string"
PROJECT_SCHEMA = "GlobalID string, ProjectDescription string, InfraYear string, Region string, Province string, Municipality string, TypeofWork string, Contractor string, ContractCost string, DistrictEngineeringOffice string, LegislativeDistrict string, ContractID string, ProjectID string, Latitude string, Longitude string, _geo struct<lat: double, lng: double>"


def year_scan(df: DataFrame, year: str | int, column: str = "year") -> DataFrame:
    """Rows of one year; a year that is not four digits is an error, an absent one gives no rows."""
    if not (str(year).isdigit() and len(str(year)) == 4):
        raise ValueError(f"not a year: {year!r}")
    return df.where(F.col(column) == int(year))


def all_years(tables: dict[int, DataFrame | None]) -> DataFrame:
    """The tables of the years that exist, with their year; columns that a year lacks are null."""
    there = [df.drop("year").withColumn("year", F.lit(y).cast("long")) for y, df in sorted(tables.items()) if df is not None]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), there)


def read_batches(spark: SparkSession, glob: str, schema: str = BATCH_SCHEMA) -> DataFrame:
    """JSON array files, with the name of their file."""
    df = spark.read.schema(schema).option("recursiveFileLookup", True).json(glob, multiLine=True)
    return df.select("*", F.col("_metadata.file_name").alias("source_file"))


def write_batches(df: DataFrame, path: str, rows: int = 5000) -> None:
    """JSON array files of about `rows` rows each."""
    n = max(1, -(-df.count() // rows))
    dealt = df.select(F.pmod(F.xxhash64(*df.columns), F.lit(n)).alias("__file"), F.struct(*df.columns).alias("__row")).groupBy("__file").agg(F.to_json(F.collect_list("__row")).alias("value"))
    dealt.write.mode("overwrite").partitionBy("__file").text(path)  # a folder and a file for each array


def read_contracts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CONTRACT_SCHEMA).csv(path, header=True, multiLine=True, escape='"')


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROJECT_SCHEMA).json(path)


def new_records(batch: DataFrame, target: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows to append: one per key (the first in the order), of keys that the target lacks."""
    w = Window.partitionBy(key).orderBy(*order)
    first = batch.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")
    return first.join(target.select(key).distinct(), key, "left_anti")


def without_headers(df: DataFrame, description: str = "description") -> DataFrame:
    """Rows less headings: descriptions of five letters or more that do not begin like a heading."""
    d = F.lower(F.trim(description))
    return df.where((F.length(d) >= 5) & ~F.startswith(d, F.lit("region ")) & ~F.startswith(d, F.lit("department")) & ~F.startswith(d, F.lit("agency")))


def decomposed(df: DataFrame, org: str = "org_uacs_code") -> DataFrame:
    """Proposal rows in the enacted table's code columns."""
    return df.select("*", *org_parts(F.col(org)), F.col("region_code").try_cast("long").alias("uacs_reg_id"), F.col("funding_uacs_code").try_cast("long").alias("fundcd"), F.col("object_uacs_code").try_cast("long").alias("uacs_sobj_cd"))


def reload(df: DataFrame, path: str, partition: str = "year") -> None:
    """Overwrite the partitions that df has, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def write_summary(df: DataFrame, path: str, kind: str = "json") -> None:
    df.write.mode("overwrite").format(kind).save(path)


def export(df: DataFrame, path: str, kind: str = "json") -> None:
    """A search result as JSON or CSV, whole."""
    if kind not in ("json", "csv"):
        raise ValueError(kind)
    w = df.write.mode("overwrite").format(kind)
    (w.option("header", True) if kind == "csv" else w).save(path)
