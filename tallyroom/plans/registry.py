"""Registered queries: a Spark form, a list of typed columns, and an equivalent SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.grams import GramTable, write_grams
from ..sources.shared import new_folder
from ..sources.years import YearTable, write_years
from .proxies import duck, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_SPARK = {"s": "string", "i": "long", "d": "double", "b": "boolean"}
_DUCK = {"s": "CAST({c} AS VARCHAR)", "i": "CAST({c} AS BIGINT)", "d": "round(CAST({c} AS DOUBLE), 2)", "b": "CAST({c} AS BOOLEAN)", "m": "round(CAST({c} AS DOUBLE), 4)"}


_by_year: dict[tuple, YearTable] = {}
_by_gram: dict[tuple, GramTable] = {}


def folder(t: Tables) -> str:
    """A new folder that driver and executors share."""
    return new_folder(t.spark)


class Tables:
    """Tables of one scale folder by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return read(self.spark, self.sf_dir, name)

    def by_year(self, name: str, year: str = "year") -> YearTable:
        """A table with a folder for each year, written once a session."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _by_year:
            df, path = self(name), new_folder(self.spark, "years")
            write_years(df, path, year)
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != year)
            _by_year[key] = YearTable(self.spark, path, schema, year)
        return _by_year[key]

    def by_gram(self, name: str, fields: list[str], rows_a_part: int = 500_000) -> GramTable:
        """A table with an index of the trigrams of its fields, written once a session."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name, *fields)
        if key not in _by_gram:
            df, path = self(name), new_folder(self.spark, "grams")
            write_grams(df, path, fields, rows_a_part)
            _by_gram[key] = GramTable(self.spark, path, df)
        return _by_gram[key]


def query(name: str, columns: str, sql: str | None = None):
    """Register f(tables) under a name. columns: "name kind, ..."; kinds are s (text), i (integer), d (number, two decimals), m (four decimals), b (boolean)."""
    spec = [c.split() for c in columns.split(",")]

    def register(f: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(Tables(spark, sf_dir))
            return df.select(*[(F.round(F.col(c).cast("double"), {"d": 2, "m": 4}[k]) if k in "dm" else F.col(c).cast(_SPARK[k])).alias(c) for c, k in spec])

        QUERIES[name] = run
        if sql:
            ORACLES[name] = duck("WITH answer AS (" + sql.strip() + ") SELECT " + ", ".join(_DUCK[k].format(c=c) + f" AS {c}" for c, k in spec) + " FROM answer")
        return f

    return register
