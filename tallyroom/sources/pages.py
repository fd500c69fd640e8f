"""Registry pages: text files of labels and values, most of which hold no record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What a page with and one without a record says.
BLOCK, NOTHING = "COMPANY DETAILS", "No Record found"
STATES = ["record", "no_record", "empty", "other"]


def read_pages(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """(file, value): a row for each file, or for each page of files that hold several, parted by `separator`. Empty files are rows too."""
    reader = spark.read.option("recursiveFileLookup", True)
    pages = reader.option("lineSep", separator).text(path) if separator else reader.text(path, wholetext=True)
    pages = pages.select(F.col("_metadata.file_path").alias("path"), "value")
    if not separator:
        # scans leave out files of no bytes, which the driver has listed with the others
        plain = F.url_decode(F.regexp_replace("path", r"^(\w+):/+", "$1:/"))  # the two spell paths differently
        listed = spark.createDataFrame([(p,) for p in pages.inputFiles()], "path string").withColumn("path", plain)
        pages = listed.join(pages.withColumn("path", plain), "path", "left").na.fill("", ["value"])
    return pages.select(F.element_at(F.split("path", "/"), -1).alias("file"), "value")


def write_pages(df: DataFrame, path: str, separator: str, text: str = "value") -> None:
    df.select(F.col(text).alias("value")).write.mode("overwrite").option("lineSep", separator).text(path)


def page_state(text: Column) -> Column:
    """What a page is: a record, the notice that there is none, nothing (a character at most), or other text."""
    return F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) <= 1, "empty").when(F.contains(text, F.lit(BLOCK)), "record").when(F.contains(text, F.lit(NOTHING)), "no_record").otherwise("other")


def page_counts(pages: DataFrame, text: str = "value") -> DataFrame:
    """(state, n): pages of each state that occurs."""
    return pages.groupBy(page_state(F.col(text)).alias("state")).agg(F.count("*").alias("n"))
