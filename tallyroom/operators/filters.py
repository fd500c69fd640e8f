"""Predicates over budget lines, projects and semi-structured rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMERIC_KEYS = ("department", "agency", "uacs_reg_id")


def _all(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def valid_lines(df: DataFrame, *, amount: str = "amt", detail_level: int = 7, with_agency: bool = True) -> DataFrame:
    """Detail lines with a positive amount and known codes; a test applies only where its column exists."""
    conds = [F.col(amount) > 0]
    if "prexc_level" in df.columns:
        conds.append(F.col("prexc_level") == detail_level)
    for c in ("sorder", "department", *(("agency",) if with_agency else ())):
        if c in df.columns:
            conds.append(F.col(c).isNotNull() & (F.col(c) != -1))
    return df.where(_all(conds))


def valid_proposals(df: DataFrame, amount: str = "amount") -> DataFrame:
    return df.where(F.col(amount) > 0)


def filter_lines(df: DataFrame, filters: dict, amount: str = "amt") -> DataFrame:
    """amt_min and amt_max bound the amount; code keys compare as integers (other values are ignored); other keys are case-insensitive substrings."""
    conds = []
    for key, value in filters.items():
        value = str(value).strip() if value is not None else ""
        if not value:
            continue
        if key in ("amt_min", "amt_max"):
            try:
                bound = float(value)
            except ValueError:
                continue
            conds.append(F.col(amount) >= bound if key == "amt_min" else F.col(amount) <= bound)
        elif key in NUMERIC_KEYS:
            if key in df.columns and value.lstrip("-").isdigit():
                conds.append(F.col(key) == int(value))
        elif key in df.columns:
            conds.append(F.contains(F.lower(F.col(key)), F.lit(value.lower())))
    return df.where(_all(conds))


def filter_projects(df: DataFrame, *, search: str = "", **equal: str) -> DataFrame:
    conds = [F.col(k) == v for k, v in equal.items() if v]
    if search:
        conds.append(F.contains(F.lower("project_name"), F.lit(search.lower())))
    return df.where(_all(conds))


def filter_facets(df: DataFrame, facets: dict[str, str]) -> DataFrame:
    return df.where(_all([F.col(k) == v for k, v in facets.items() if v]))


def filter_raw(df: DataFrame, predicate: str) -> DataFrame:
    return df.where(F.expr(predicate))


def matched_categories(text: Column, categories: dict[str, list[str]]) -> Column:
    """Names of the categories of which a keyword occurs in the text; a row can be in several."""
    low = F.lower(text)
    hit = [F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(k.lower())) for k in words]), F.lit(name)) for name, words in categories.items()]
    return F.filter(F.array(*hit), lambda x: x.isNotNull())


def by_category(df: DataFrame, text: str, categories: dict[str, list[str]]) -> DataFrame:
    return df.withColumn("category", F.explode(matched_categories(F.col(text), categories)))


def prefix_values(df: DataFrame, field: str, prefix: str, limit: int = 10) -> DataFrame:
    return df.where(F.startswith(F.lower(F.col(field)), F.lit(prefix.lower()))).select(F.col(field).alias("value")).distinct().orderBy("value").limit(limit)


def search_all_words(df: DataFrame, fields: list[str], query: str) -> DataFrame:
    """Rows of which the fields together contain each word of the query."""
    text = F.lower(F.concat_ws(" ", *fields))
    return df.where(_all([F.contains(text, F.lit(w)) for w in query.lower().split()]))


def in_box(df: DataFrame, lat: tuple[float, float] = (15.0, 16.6), lng: tuple[float, float] = (120.0, 121.2)) -> DataFrame:
    return df.where(F.col("lat").between(*lat) & F.col("lng").between(*lng))


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page in a total order."""
    return df.orderBy(*order).offset(offset).limit(limit)
