"""Operator 5: repeated lines.

Explode the lines, normalise and hash them, count documents per hash, drop the
lines of frequent hashes and put the rest together by position.

Defined results: each row is one document, also where rows or ids repeat; a
null or empty text is one empty line; a line's key is 128 bits of hash of the
line, trimmed of ASCII blanks and with A-Z lower-cased; keys of fewer than
`min_key_chars` code points are never dropped; when all lines go, the text is
empty; a text counts whole, however long; an empty table gives an empty table. Other columns pass through, but for
those named as a result column, which the result replaces.

Only (id, position, hash) rows meet the frequent hashes, in a join that Spark
can split when one line is very common; texts are shuffled once, on the row's
key, to meet the positions to drop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, drop_clashes, lower_ascii


def _key(line: Column) -> Column:
    return lower_ascii(F.trim(line, F.lit(BLANKS)))


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(5), key, F.lit(5)).alias("h2")]


def frequent_lines(docs: DataFrame, *, text: str = "text", min_docs: int = 10, min_key_chars: int = 1) -> DataFrame:
    """Hashes (h1, h2) of the keys found in at least min_docs rows."""
    keys = docs.select(F.explode(F.array_distinct(F.transform(_lines(F.col(text)), _key))).alias("key"))
    return keys.where(F.length("key") >= min_key_chars).select(*_hashes(F.col("key"))).groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("h1", "h2")


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_docs: int = 10, min_key_chars: int = 1) -> DataFrame:
    """docs with `text` less its repeated lines, and n_lines (before) and n_dropped."""
    docs = drop_clashes(docs, ["n_lines", "n_dropped"])
    common = frequent_lines(docs, text=text, min_docs=min_docs, min_key_chars=min_key_chars)
    own = [F.col(doc_id).alias("__id"), F.xxhash64(F.col(text)).alias("__th")]
    lines = docs.select(*own, F.posexplode(_lines(F.col(text))).alias("pos", "line")).withColumn("key", _key(F.col("line")))
    lines = lines.where(F.length("key") >= min_key_chars).select("__id", "__th", "pos", *_hashes(F.col("key")))
    hits = lines.join(common, ["h1", "h2"], "left_semi").groupBy("__id", "__th").agg(F.sort_array(F.collect_set("pos")).alias("__drop"))
    joined = docs.join(hits, F.col(doc_id).eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(text)) == F.col("__th")), "left")
    lines_, drop = _lines(F.col(text)), F.col("__drop")

    def gap(i: Column) -> Column:
        """The lines between one dropped place and the next."""
        start = F.when(i == 0, F.lit(0)).otherwise(F.get(drop, i - 1) + 1)
        end = F.when(i == F.size(drop), F.size(lines_)).otherwise(F.get(drop, i))
        return F.slice(F.col("__lines"), start + 1, end - start)

    joined = joined.withColumns({"__lines": lines_})
    kept = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(drop)), gap)), "\n")
    out = joined.withColumns({
        "n_lines": F.size("__lines").cast("long"),
        "n_dropped": F.coalesce(F.size(drop), F.lit(0)).cast("long"),
        text: F.when(drop.isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(kept),
    })
    return out.drop("__id", "__th", "__drop", "__lines")
