"""Column functions: cleansing, codes, growth, scores, distances, names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Single words that are no contractor name by themselves.
GENERIC_WORDS = [
    "SUPPLY", "SUPPLIES", "CONSTRUCTION", "BUILDERS", "BUILDER", "TRADING", "ENTERPRISE", "ENTERPRISES", "INC", "CORP", "CORPORATION", "CO", "COMPANY",
    "LTD", "LIMITED", "THE", "AND", "FOR", "OF", "GENERAL", "SERVICES", "DEVELOPMENT", "CONTRACTOR", "CONTRACTORS", "ENGINEERING", "DESIGN",
    "MAINTENANCE", "BUILD", "CONST", "MERCHANDISE",
]
# Substrings that the substring normaliser removes, in this order.
SUBSTRINGS = ["INC.", "INC", "CORP.", "CORP", "CO.", "CO", "LTD.", "LTD", "CORPORATION", "INCORPORATED", "COMPANY", "LIMITED", "CONSTRUCTION", "TRADING", "ENTERPRISES", "DEVELOPMENT", "BUILDERS", "CONTRACTOR", "CONTRACTORS", "SERVICES", "GEN.", "GENERAL", "AND", "&"]
# Words that the token normaliser removes.
SUFFIX_WORDS = ["CORPORATION", "CORP", "INC", "INCORPORATED", "CO", "COMPANY", "LTD", "LIMITED", "ENTERPRISES", "ENTERPRISE"]
# Words that say nothing in a project title.
TITLE_WORDS = ["CONSTRUCTION", "OF", "THE", "PROJECT", "REHABILITATION", "REPAIR", "MAINTENANCE", "PHASE", "PACKAGE", "AND", "AT", "IN", "FLOOD", "CONTROL", "DRAINAGE", "ROAD", "BRIDGE"]
# Words that say nothing in a place name, removed in this order.
PLACE_WORDS = ["PROVINCE", "PROVINCE OF", "CITY OF", "MUNICIPALITY OF", "BARANGAY"]
FORMER = r"(?i)^(.+?)\s*\(?\s*\b(FORMERLY|FORMER|FOR|PREVIOUSLY|PREV)\b[\s:]*(.*)$"


def money(text: Column) -> Column:
    """A money string as a number; what does not read as one is 0."""
    return F.coalesce(F.translate(text, "₱, ", "").try_cast("double"), F.lit(0.0))


def coordinate(text: Column) -> Column:
    return F.trim(text).try_cast("double")


def org_parts(code: Column) -> list[Column]:
    """Department, agency and operating unit of a 12-digit organisation code."""
    c = F.lpad(code.cast("string"), 12, "0")
    return [F.substring(c, 1, 2).cast("long").alias("department"), F.substring(c, 3, 3).cast("long").alias("agency"), c.cast("long").alias("operunit")]


def no_sentinel(c: Column) -> Column:
    """Codes -1 and 0 mean that there is none."""
    return F.when(c.cast("long") > 0, c)


def growth(now: Column, before: Column) -> Column:
    """Percent change, 0 where the base is not positive."""
    return F.when(before > 0, (now - before) / before * 100).otherwise(F.lit(0.0))


def duplicate_score(matched: Column, total: Column, a: Column, b: Column, weight: float = 20.0) -> Column:
    """Share of matching columns in percent, and weight more where the amounts are equal; at most 100."""
    a, b = a.cast("double"), b.cast("double")
    bonus = F.when(a == b, F.lit(weight)).otherwise(F.lit(0.0)) if weight > 0 else F.lit(0.0)
    return F.when(total == 0, F.lit(0.0)).otherwise(F.round(F.least(F.lit(100.0), matched / total * 100 + bonus), 1))


def severity(score: Column) -> Column:
    return F.when(score >= 80, "high").when(score >= 60, "medium").otherwise("low")


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def amount_score(a: Column, b: Column, percent: float = 5.0) -> Column:
    """1 for equal amounts, down to 0 at `percent` difference and for a zero amount."""
    a, b = a.cast("double"), b.cast("double")
    off = F.abs(a - b) / F.greatest(a, b) * 100
    return F.when((a == 0) | (b == 0), 0.0).when(a == b, 1.0).when(off <= percent, 1.0 - off / percent).otherwise(0.0)


def lev_ratio(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def words(c: Column) -> Column:
    return F.filter(F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " "), lambda w: w != "")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def standard_name(name: Column, variant: str = "token") -> Column:
    """Normalised contractor name. Variants: token, substring, suffix, title, place, registry."""
    up = F.upper(F.coalesce(name, F.lit("")))
    if variant == "substring":
        for s in SUBSTRINGS:
            up = F.replace(up, F.lit(s), F.lit(""))
        return squeeze(F.regexp_replace(up, r"[^A-Z0-9\s]", ""))
    if variant == "suffix":
        c = F.regexp_replace(F.coalesce(name, F.lit("")), r"(?i)\s*(corp|corporation|inc|incorporated|ltd|limited|co|company|llc|llp)\.?\s*$", "")
        return squeeze(F.regexp_replace(c, r"(?i)^\s*(the\s+)?", ""))
    if variant == "registry":
        c = F.regexp_replace(F.coalesce(name, F.lit("")), r"(?i)\s*(INC|CORP|CORPORATION|LTD|LLC|JV|JOINT VENTURE)\s*$", "")
        c = F.upper(squeeze(F.regexp_replace(c, r"(?i)^\s*(THE)\s+", "")))
        return F.regexp_replace(c, r"[^A-Z0-9\s]", "")
    if variant == "place":
        c = F.trim(up)
        for s in PLACE_WORDS:
            c = F.replace(c, F.lit(s), F.lit(""))
        return squeeze(c)
    drop = TITLE_WORDS if variant == "title" else SUFFIX_WORDS
    if variant == "token":
        up = F.replace(F.translate(up, ".,-", "   "), F.lit("&"), F.lit("AND"))
    left = F.filter(words(up), lambda w: ~w.isin(drop))
    return F.when((F.size(left) > 0) | F.lit(variant == "title"), F.array_join(left, " ")).otherwise(squeeze(up))


def valid_name(name: Column) -> Column:
    """More than one word, or one that is not generic."""
    return F.coalesce((F.size(words(name)) > 1) | ((F.length(name) > 0) & ~F.upper(name).isin(GENERIC_WORDS)), F.lit(False))


def former_parts(name: Column) -> tuple[Column, Column]:
    """(current name, former name or null)."""
    has = F.regexp_extract(name, FORMER, 2) != ""
    old = F.regexp_replace(F.trim(F.regexp_extract(name, FORMER, 3)), r"^\s*[:;,\s]+", "")
    old = F.trim(F.regexp_replace(old, r"\)?\s*$", ""))
    main = F.trim(F.regexp_replace(name, r"\((.*?)\)", ""))
    plain = F.when(F.length(main) > 3, main).otherwise(F.trim(name))
    return F.when(has, F.trim(F.regexp_extract(name, FORMER, 1))).otherwise(plain), F.when(has & valid_name(old), old)


def split_names(name: Column) -> Column:
    """Names of a joint venture and former names, as an array; empty where there are signs of several names but none is valid."""
    current, former = former_parts(name)

    def part(p: Column) -> Column:
        p = F.trim(F.regexp_replace(F.trim(p), r"(?i)\b(?:JOINT\s+VENTURE|JV)\b", ""))
        return F.trim(F.regexp_replace(p, r"\s*\([^)]*\)", ""))

    many = F.filter(F.transform(F.split(current, "/"), part), lambda p: (p != "") & valid_name(p))
    now = F.when(F.contains(current, F.lit("/")), many).when(current != "", F.array(current)).otherwise(F.array().cast("array<string>"))
    both = F.concat(now, F.when(former.isNotNull(), F.array(former)).otherwise(F.array().cast("array<string>")))
    signs = F.contains(name, F.lit("/")) | F.contains(name, F.lit("(")) | name.rlike(r"(?i)\b(FORMERLY|FORMER|FOR|PREVIOUSLY|PREV)\b")
    return F.when(F.coalesce(name, F.lit("")) == "", F.array().cast("array<string>")).when((F.size(both) > 0) | signs, both).otherwise(F.array(F.trim(name)))


# Signs of several names in one, with the tag of each; the first of a group that holds counts.
SPLIT_SIGNS = [
    [("HAS_FORMER_NAME", r"(?i)\b(FORMERLY|FORMER|PREVIOUSLY|PREV)\b")],
    [("HAS_JV_SLASH", r"/")],
    [("HAS_PAREN_FORMER", r"(?i)\([^)]*(?:FORMERLY|FORMER)[^)]*\)"), ("HAS_LONG_PAREN", r"\([^)]{10,}\)")],
]
# Text that shows a fragment of JSON.
JSON_SIGNS = ['", "', "logoUrl", "nameAbbreviation"]


def name_issues(name: Column) -> tuple[Column, Column]:
    """(signs of several names, signs of an invalid name), as arrays of tags."""
    w, up = words(name), F.upper(name)
    tags = []
    for group in SPLIT_SIGNS:
        tags.append(F.coalesce(*[F.when(name.rlike(pattern), F.lit(tag)) for tag, pattern in group]))
    split = F.array(*tags)
    bad = F.array(
        F.when(F.length(name) < 5, F.lit("TOO_SHORT")), F.when(F.size(w) == 1, F.when(up.isin(GENERIC_WORDS), F.lit("SINGLE_COMMON_WORD")).otherwise(F.lit("SINGLE_WORD"))),
        F.when((F.size(w) > 0) & F.forall(w, lambda x: F.upper(x).isin(GENERIC_WORDS)), F.lit("ALL_COMMON_WORDS")),
        F.when(reduce(lambda a, b: a | b, [F.contains(name, F.lit(x)) for x in JSON_SIGNS]), F.lit("JSON_FRAGMENT")),
    )
    keep = lambda a: F.filter(a, lambda x: x.isNotNull())
    return keep(split), keep(bad)
