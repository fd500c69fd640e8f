"""Contractor names and registry rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import name_issues, split_names, standard_name


def standardise(df: DataFrame, name: str, variant: str) -> DataFrame:
    """(norm, n, names): raw names under each normalised one."""
    return df.groupBy(standard_name(F.col(name), variant).alias("norm")).agg(F.count("*").alias("n"), F.count_distinct(name).alias("names"))


def split_all(df: DataFrame, name: str) -> DataFrame:
    """Distinct single names out of joint ventures and former names."""
    return df.select(F.explode(split_names(F.col(name))).alias("name")).distinct()


def audit(df: DataFrame, name: str) -> DataFrame:
    split, bad = name_issues(F.col(name))
    got = df.withColumns({"split_issues": F.array_join(split, ","), "invalid_issues": F.array_join(bad, ",")})
    return got.withColumn("class", F.when(F.col("split_issues") != "", "needs_split").when(F.col("invalid_issues") != "", "invalid").otherwise("clean"))


def json_clean_name(name: Column) -> Column:
    """The name in what is left of a JSON record; null where there is none, the name itself where there is no JSON."""
    lead = r"^[\",]+"
    whole = F.regexp_extract(name, r'"name":\s*"([^"]+)"', 1)
    cut = lambda mark: F.trim(F.regexp_replace(F.substring_index(name, mark, 1), lead, ""))
    body = F.trim(F.regexp_replace(F.trim(F.regexp_extract(name, r"^[./\s]*(.*?)[\"']\s*,\s*[\"'](nameAbbreviation|logoUrl)", 1)), r"[)\"'\s]+$", ""))
    head = F.regexp_replace(F.trim(F.regexp_extract(name, r"^([^\"'{]*)", 1)), r"[.,/)]+$", "")
    long = lambda c: F.when(F.length(c) >= 3, c)
    return (
        F.when(F.startswith(name, F.lit('{"id":')), F.when(whole != "", whole)).when(F.startswith(name, F.lit('", ')), F.lit(None)).when(F.contains(name, F.lit('", "nameAbbreviation":')) | F.contains(name, F.lit('", "logoUrl":')), long(F.when(body != "", body).otherwise(cut('", "'))))
        .when(name.rlike(r'^"[^"]*"$'), F.regexp_replace(name, '"', "")).when(F.endswith(name, F.lit("}")), long(head)).otherwise(name)
    )


def clean_fragments(df: DataFrame, row: str, name: str) -> DataFrame:
    """Rows with cleaned names, one row per name: rows that were clean come first, then the smallest id."""
    got = df.withColumn("clean", json_clean_name(F.col(name))).where("clean IS NOT NULL")
    w = Window.partitionBy("clean").orderBy((F.col("clean") != F.col(name)).cast("int"), row)
    return got.withColumn("rank", F.row_number().over(w)).where("rank = 1").select(row, F.col("clean").alias(name))


def consolidate(df: DataFrame) -> DataFrame:
    """One row per name: smallest id, all sources (not 'unknown') sorted, and the number of the smallest row that has one."""
    tags = df.groupBy("contractor_name").agg(F.min("id").alias("id"), F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.split(F.coalesce("source", F.lit("")), ","))))).alias("tags"), F.min_by("sec_number", F.when(F.col("sec_number").isNotNull(), F.col("id"))).alias("sec_number"), F.count("*").alias("n"))
    return tags.select("id", "contractor_name", F.array_join(F.filter("tags", lambda t: ~t.isin("", "unknown")), ",").alias("source"), "sec_number", "n")


def merge_tag(registry: DataFrame, names: DataFrame, tag: str) -> DataFrame:
    """registry (contractor_name, source) with the tag appended for the names, which are added where absent."""
    new = names.select(F.col(names.columns[0]).alias("name")).where("name IS NOT NULL").distinct()
    got = registry.select("contractor_name", "source").join(new, F.col("contractor_name") == F.col("name"), "full")
    tags = F.filter(F.split(F.coalesce("source", F.lit("")), ","), lambda t: t != "")
    tags = F.when(F.col("name").isNotNull(), F.array_union(tags, F.array(F.lit(tag)))).otherwise(tags)
    return got.select(F.coalesce("contractor_name", "name").alias("contractor_name"), F.array_join(tags, ",").alias("source"))


def source_flags(df: DataFrame, tags: tuple[str, ...] = ("flood", "dime", "philgeps")) -> DataFrame:
    return df.withColumns({f"has_{t}": F.contains(F.lower(F.coalesce("source", F.lit(""))), F.lit(t)) for t in tags})


def split_and_replace(df: DataFrame) -> DataFrame:
    """Rows of names to keep: splits point to the row they come from; a split row without a number goes."""
    parts = df.withColumn("part", F.explode(split_names(F.col("contractor_name")))).where(F.col("part") != F.col("contractor_name"))
    fresh = parts.groupBy("part").agg(F.min("id").alias("former_id")).join(df.select(F.col("contractor_name").alias("part")).distinct(), "part", "left_anti")
    gone = parts.join(fresh, "part").select("id").distinct()
    kept = df.join(gone.withColumn("gone", F.lit(True)), "id", "left").where(F.col("gone").isNull() | F.col("sec_number").isNotNull())
    return kept.select("contractor_name", F.lit(None).cast("long").alias("former_id")).union(fresh.select("part", F.col("former_id").cast("long")))


def drop_unsplit(df: DataFrame) -> DataFrame:
    sign = F.col("contractor_name").rlike(r"(?i)[/()]|\b(FORMERLY|FORMER|PREVIOUSLY|PREV)\b")
    return df.where(~(sign & F.col("sec_number").isNull()))


def bridge(df: DataFrame) -> DataFrame:
    """Distinct (project, contractor, role) of main contractors and joint-venture partners."""
    roles = F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.trim(F.col(c)).alias("name")) for r, c in (("main", "contractor"), ("jv_partner1", "jv_partner1"), ("jv_partner2", "jv_partner2"))]))
    return df.select("id", roles.alias("x")).select(F.col("id").alias("project_id"), "x.name", "x.role").where("name IS NOT NULL AND name <> ''").distinct()


def array_names(df: DataFrame, column: str) -> DataFrame:
    """Distinct names in an array column; elements can be JSON objects with a name."""
    x = F.explode(column)
    return df.select(x.alias("x")).select(F.coalesce(F.when(F.try_parse_json("x").isNotNull(), F.get_json_object("x", "$.name")), F.col("x")).alias("name")).where("name IS NOT NULL").distinct()


_RECORD = r"Company Name\s*\n+\s*([^\n]+)\n+\s*SEC Number\s*\n+\s*([^\n]+)\n+\s*Date Registered\s*\n+\s*([^\n]+)\n+\s*Status\s*\n+\s*([^\n]+)\n+\s*Address\s*\n+\s*([^\n]+)"


def registry_records(pages: DataFrame, text: str = "value") -> DataFrame:
    """Registry records of text pages (labels and values on successive lines), the last one per number."""
    got = pages.select(F.explode(F.regexp_extract_all(F.regexp_replace(F.col(text), "\r", ""), F.lit(_RECORD), F.lit(0))).alias("r"))
    part = lambda k: F.trim(F.regexp_extract("r", _RECORD, k))
    date = F.coalesce(*[F.try_to_timestamp(part(3), F.lit(f)) for f in ("MMMM d, yyyy", "MM/dd/yyyy", "yyyy-MM-dd")]).cast("date")
    got = got.select(part(1).alias("contractor_name"), part(2).alias("sec_number"), date.alias("date_registered"), part(4).alias("status"), part(5).alias("address"))
    last = F.max(F.struct("date_registered", "contractor_name", "address", "status")).alias("x")  # null dates are least
    return got.groupBy("sec_number").agg(last).select("x.contractor_name", "sec_number", "x.date_registered", "x.status", "x.address")
