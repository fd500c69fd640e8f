"""A training-corpus pipeline over `documents`: five stages, each one operator of tallyroom.llm.

Each stage is written as Parquet and read again before the next, so a lost
executor costs a stage at most; what a stage was made from is removed then. All
stages but the last return the columns of documents, with the values that they
had (but for the text and its length after `lines`), whatever their names:
columns that an operator would replace are set aside under other names.

In every stage null texts are empty documents, rows that repeat and rows
without doc_id are documents of their own, texts count whole, and an empty
table gives an empty table. What each decides on these is said at its function.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroom.llm import cotrain, dart_minhash, decontaminate, line_dedup, mixing
from tallyroom.llm.common import clear_stages, own_stages, stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _aside(docs: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """operator(docs) with the columns that only the pipeline knows set aside, and its own results last."""
    other = {c: f"__own_{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text", "source", "lang", "n_chars")}
    return operator(docs.withColumnsRenamed(other)).withColumnsRenamed({v: f"__of_{k}" for k, v in other.items()})


def _columns(docs: DataFrame) -> list:
    """The columns of docs in the result of `_aside`, under their own names."""
    own = ("doc_id", "text", "source", "lang", "n_chars")
    return [F.col(c) if c in own else F.col(f"__of_{c}").alias(c) for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that the co-trained classifier rejects go. Equal rows have equal scores and go together; a null text is scored as such."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _aside(docs, lambda d: cotrain.quality_scores(d, labels)).where("keep").select(*_columns(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: lines found in ten documents or more go; n_chars follows the text. No document goes: one of which all lines go, or whose text was null, has an empty text."""
    out = _aside(docs, line_dedup.dedup_lines)
    changed = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return (out.withColumn("n_chars", changed) if "n_chars" in docs.columns else out).select(*_columns(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: one document of each group of near copies stays, that of the smallest doc_id; of rows that repeat one. Documents without words all stay."""
    return _aside(docs, dart_minhash.drop_near_duplicates).select(*_columns(docs))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that hold a benchmark passage go. Documents without words stay, and all where the benchmark is empty."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _aside(docs, lambda d: decontaminate.decontaminate(d, items)).where("NOT contaminated").select(*_columns(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: the mix to target weights: documents of which words are taken, with the runs of words and how often each is taken. Documents without words give nothing and go; a null source is a source; columns named as a result are replaced."""
    return mixing.mix_sources(docs).where("taken > 0")


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("benchmark", benchmark), ("mixture", mixture)]

#: SQL can't express the trained classifier, nor the seeded choice of blocks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with own_stages() as mine:
        for _, step in STAGES:
            docs = stage(step(spark, docs, sf_dir))
            clear_stages(spark, mine, keep=1)
    return docs
