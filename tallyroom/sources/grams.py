"""Substring search without a full scan (P3, P8, P10): an index of trigrams says which parts of a table can hold a term.

`path/lines/gram_part=K/` are the rows, ordered by the indexed fields so that rows with like texts
share parts, each part one file; `path/grams` has a row for each
(field, gram, gram_part). A text's grams are its runs of three characters, lower-cased, with
a mark in front, so that prefixes have grams of their own. A part that lacks a gram of a
term in every field is not read (dynamic partition pruning); what is read takes the exact test,
so results equal those of the scan. Terms too short for a gram are searched for in all parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PART = "gram_part"
START = "\u0002"  # in front of each text


def grams_of(term: str, prefix: bool = False) -> list[str]:
    """Grams that every text with this (lower-cased) term holds."""
    term = START + term if prefix else term
    return sorted({term[i : i + 3] for i in range(len(term) - 2)})


def write_grams(df: DataFrame, path: str, fields: list[str], rows_a_part: int = 500_000) -> None:
    """Write the table and its index. Equal texts are spread by a hash of the row, so that a very common one fills parts of the same size."""
    parts = max(1, -(-df.count() // rows_a_part))
    order = [*fields, F.xxhash64(*df.columns)]
    dealt = df.repartitionByRange(parts, *order).withColumn(PART, F.spark_partition_id()).sortWithinPartitions(PART, *order)
    dealt.write.mode("overwrite").partitionBy(PART).parquet(f"{path}/lines")
    lines = df.sparkSession.read.schema(_schema(df)).parquet(f"{path}/lines")
    text = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.concat(F.lit(START), F.lower(F.col(c).cast("string"))).alias("text")) for c in fields])).alias("x")
    texts = lines.select(PART, text).select(PART, "x.*").where("text IS NOT NULL").distinct()  # a text counts once a part
    chars = texts.withColumn("chars", F.split("text", ""))
    gram = F.transform("chars", lambda c, i: F.concat(c, F.get("chars", i + 1), F.get("chars", i + 2)))
    grams = chars.select("field", PART, F.explode(F.array_distinct(gram)).alias("gram")).where("gram IS NOT NULL").distinct()
    grams.repartitionByRange("field", "gram", PART).sortWithinPartitions("field", "gram", PART).write.mode("overwrite").parquet(f"{path}/grams")


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", {PART} int"


class GramTable:
    """A table that `write_grams` wrote; like is a table with its columns."""

    def __init__(self, spark: SparkSession, path: str, like: DataFrame):
        self.spark = spark
        self.lines = spark.read.schema(_schema(like)).parquet(f"{path}/lines")
        self.grams = spark.read.schema(f"field string, {PART} int, gram string").parquet(f"{path}/grams")

    def parts_with(self, terms: list[tuple[str, list[str]]], prefix: bool = False) -> DataFrame | None:
        """Parts in which each (term, fields) can occur in one of its fields; None if no term has a gram."""
        wanted = [(k, field, g, len(grams)) for k, (term, fields) in enumerate(terms) if (grams := grams_of(term, prefix)) for g in grams for field in fields]
        if not wanted:
            return None
        look = self.spark.createDataFrame(sorted(set(wanted)), "term int, field string, gram string, need int")
        found = self.grams.where(F.col("field").isin(sorted({w[1] for w in wanted})) & F.col("gram").isin(sorted({w[2] for w in wanted})))
        held = found.join(F.broadcast(look), ["field", "gram"]).groupBy("term", "field", PART, "need").agg(F.count("*").alias("n")).where("n = need")
        return held.groupBy(PART).agg(F.count_distinct("term").alias("terms")).where(F.col("terms") == len({w[0] for w in wanted})).select(PART)

    def _read(self, parts: DataFrame | None) -> DataFrame:
        # a row for each part at most: no larger than the list of the table's files
        return (self.lines if parts is None else self.lines.join(F.broadcast(parts), PART)).drop(PART)

    def with_terms(self, terms: dict[str, str]) -> DataFrame:
        """Candidates for rows whose field contains its term, for each (field, term)."""
        return self._read(self.parts_with([(str(v).strip().lower(), [c]) for c, v in terms.items()]))

    def with_words(self, fields: list[str], query: str) -> DataFrame:
        """Candidates for rows of which the fields together contain each word: a word has no blank, so it lies in one field."""
        return self._read(self.parts_with([(w, fields) for w in query.lower().split()]))

    def with_prefix(self, field: str, prefix: str) -> DataFrame:
        """Candidates for rows whose field begins with prefix."""
        return self._read(self.parts_with([(prefix.lower(), [field])], prefix=True))
