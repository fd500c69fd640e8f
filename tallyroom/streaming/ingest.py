"""Incremental ingest of batch files (K1, K2)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.tables import BATCH_SCHEMA

#: Where a record stood: file, the split's start in it, and the place in the split.
_PLACE = ["__file", "__start", "__at"]


def summary_by_year(df: DataFrame, year: str = "fiscal_year", amount: str = "amount") -> DataFrame:
    return df.groupBy(year).agg(F.count("*").alias("total_records"), F.sum(amount).alias("total_amount"))


def read_summary(spark: SparkSession, summary: str, year: str = "fiscal_year") -> DataFrame:
    """The yearly summary of all epochs; its parts are as long as the years times the epochs, not as the target."""
    return spark.read.parquet(summary).groupBy(year).agg(F.sum("total_records").alias("total_records"), F.sum("total_amount").alias("total_amount"))


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def first_of_each_key(batch: DataFrame, key: str) -> DataFrame:
    """The record of each key that comes first by file name and place in the file: the same whenever the batch runs. Records without a key are left out."""
    rest = [c for c in batch.columns if c not in (key, *_PLACE)]
    first = F.min_by(F.struct(*rest), F.struct(*_PLACE)).alias("__r")
    return batch.where(F.col(key).isNotNull()).groupBy(key).agg(first).select(key, "__r.*")


def earlier_keys(spark: SparkSession, target: str, key: str, kind: str, buckets: list[int], epoch: int) -> DataFrame | None:
    """The keys that earlier epochs have in these buckets, None where there is no target yet. No other bucket and no other column is read."""
    try:
        there = spark.read.schema(f"{key} {kind}, bucket int, epoch long").parquet(target)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return there.where(F.col("bucket").isin(buckets) & (F.col("epoch") < epoch)).select(key, "bucket")


def ingest(
    spark: SparkSession, folder: str, target: str, checkpoint: str, *, key: str = "id", schema: str = BATCH_SCHEMA, year: str = "fiscal_year", amount: str = "amount",
    summary: str | None = None, multi_line: bool = True, buckets: int = 256,
) -> StreamingQuery:
    """Read the files that are new in the folder once, keep one record per key over all runs, and append them to the target.

    The stream keeps no state of keys. The target has a folder for each of
    `buckets` hashes of the key, and in it one for each epoch; a micro-batch compares
    its keys with those in the folders of its own keys' hashes, so a small batch reads a
    small part of a large target. `buckets` is set once for a target. Of records of
    one key the first by file and place is taken, and an epoch that runs again
    replaces its own records, so reruns give equal rows. With `summary`,
    each micro-batch writes its part of the yearly summary; `read_summary` sums the parts.
    """
    records = spark.readStream.schema(schema).option("multiLine", multi_line).json(folder)
    stream = records.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.file_block_start").alias("__start"))

    def write(batch: DataFrame, epoch: int) -> None:
        placed = batch.withColumn("__at", F.monotonically_increasing_id())  # grows with the place in a split
        new = first_of_each_key(placed, key).withColumns({"bucket": bucket_of(key, buckets), "epoch": F.lit(epoch).cast("long")}).persist()
        try:
            own = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # `buckets` numbers at most
            old = earlier_keys(spark, target, key, dict(batch.dtypes)[key], own, epoch)
            left = new if old is None else new.join(old, ["bucket", key], "left_anti")
            order = [*[c for c in new.columns if c not in ("bucket", "epoch")], "bucket", "epoch"]
            out = left.select(*order).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            out.partitionBy("bucket", "epoch").parquet(target)
            if summary:
                written = spark.read.schema(new.schema).parquet(target).where((F.col("epoch") == epoch) & F.col("bucket").isin(own))
                summary_by_year(written, year, amount).write.mode("overwrite").parquet(f"{summary}/epoch={epoch}")
        finally:
            new.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
