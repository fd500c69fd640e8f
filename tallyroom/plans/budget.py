"""Queries over budget lines: scans, filters, rollups, duplicates, trends, reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import money
from ..operators import duplicates as D
from ..operators import filters as P
from ..operators import partials as Q
from ..operators import reconcile as R
from ..operators import rollups as G
from ..operators import trends as T
from ..sources import tables as S
from .registry import folder, query

YEAR, BEFORE = 2000, 1999
YEARS = [1996, 1997, 1998, 1999, 2000, 2001]
VALID = "amt > 0 AND prexc_level = 7 AND sorder <> -1 AND department <> -1 AND agency <> -1"
V = f"(SELECT * FROM {{budget_line}} WHERE {VALID})"
NV = "(SELECT * FROM {nep_line} WHERE amount > 0)"
# Overlapping on purpose: "hot" and "cold" are in two categories each.
CATEGORIES = {"metal": ["bolt", "anvil", "gear"], "colour": ["red", "blue"], "warm": ["hot", "red"], "cool": ["cold", "blue"]}
CAT_SQL = " UNION ALL ".join(f"SELECT '{c}' AS category, b.* FROM {{src}} b WHERE " + " OR ".join(f"lower(dsc) LIKE '%{k}%'" for k in ks) for c, ks in CATEGORIES.items())
LINE = "sorder, dsc, amt, year"
LINE_T = "sorder i, dsc s, amt d, year i"


def v(t):
    return P.valid_lines(t("budget_line"))


def now(t):
    """Valid lines of the latest year: its folder alone is read."""
    return P.valid_lines(t.by_year("budget_line").of(YEAR))


def before(t):
    """Valid lines of the latest year before it that the catalog has: the scan waits for the catalog's answer."""
    return P.valid_lines(t.by_year("budget_line").before(YEAR))


def nv(t):
    return P.valid_proposals(t("nep_line"))


# Scans and loads

query("s1_year_scan", LINE_T, f"SELECT {LINE} FROM {{budget_line}} WHERE year = {YEAR}")(lambda t: t.by_year("budget_line").of(YEAR))


@query("s2_all_years", "year i, sorder i, amt d, fundcd i", "SELECT year, sorder, amt, CASE WHEN year <> 1997 THEN fundcd END AS fundcd FROM {budget_line} WHERE year BETWEEN 1996 AND 1998")
def s2(t):
    b = t.by_year("budget_line")
    years = {y: b.of(y).drop("year") for y in (1996, 1997, 1998)}
    return S.all_years(years | {1997: years[1997].drop("fundcd"), 1990: None})


@query("s6_canonical_lines", "source s, id s, fiscal_year i, amount d, description s, org_code s, region_code s, funding_code s, object_code s", """
SELECT 'GAA' AS source, CAST(sorder AS VARCHAR) AS id, year AS fiscal_year, amt AS amount, dsc AS description, lpad(CASE WHEN operunit > 0 THEN CAST(operunit AS VARCHAR) END, 12, '0') AS org_code,
 lpad(CASE WHEN uacs_reg_id > 0 THEN CAST(uacs_reg_id AS VARCHAR) END, 2, '0') AS region_code, CASE WHEN fundcd > 0 THEN CAST(fundcd AS VARCHAR) END AS funding_code, CASE WHEN uacs_sobj_cd > 0 THEN CAST(uacs_sobj_cd AS VARCHAR) END AS object_code FROM {budget_line}
UNION ALL SELECT 'NEP', record_id, fiscal_year, amount, description, org_uacs_code, CASE WHEN region_code NOT IN ('00', '-1') THEN region_code END, funding_uacs_code, object_uacs_code FROM {nep_line}""")
def s6(t):
    return R.canonical(t("budget_line"), t("nep_line"))


@query("s7_new_records", "event_id i, user_id i, value d", """
SELECT event_id, user_id, value FROM (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY event_id ORDER BY f) AS r FROM (SELECT *, 1 AS f FROM {events} WHERE event_id % 2 = 0 UNION ALL SELECT *, 2 FROM {events} WHERE event_id % 3 = 0) x)
WHERE r = 1 AND event_id NOT IN (SELECT event_id FROM {events} WHERE event_id % 5 = 0)""")
def s7(t):
    e = t("events")
    batch = e.where("event_id % 2 = 0").withColumn("f", F.lit(1)).unionByName(e.where("event_id % 3 = 0").withColumn("f", F.lit(2)))
    return S.new_records(batch, e.where("event_id % 5 = 0"), "event_id", ["f"])


@query("s8_without_headers", "sorder i, d s", "SELECT sorder, d FROM (SELECT sorder, CASE sorder % 4 WHEN 0 THEN 'Region ' || dsc WHEN 1 THEN 'Dept' ELSE dsc END AS d FROM {budget_line}) x WHERE length(trim(d)) >= 5 AND lower(trim(d)) NOT LIKE 'region %' AND lower(trim(d)) NOT LIKE 'department%' AND lower(trim(d)) NOT LIKE 'agency%'")
def s8(t):
    df = t("budget_line").withColumn("d", F.expr("CASE sorder % 4 WHEN 0 THEN 'Region ' || dsc WHEN 1 THEN 'Dept' ELSE dsc END"))
    return S.without_headers(df, "d")


@query("s9_decomposed_codes", "record_id s, department i, agency i, operunit i, uacs_reg_id i, fundcd i, uacs_sobj_cd i", """
SELECT record_id, CAST(substr(org_uacs_code, 1, 2) AS BIGINT) AS department, CAST(substr(org_uacs_code, 3, 3) AS BIGINT) AS agency, CAST(org_uacs_code AS BIGINT) AS operunit, CAST(region_code AS BIGINT) AS uacs_reg_id, CAST(funding_uacs_code AS BIGINT) AS fundcd, CAST(object_uacs_code AS BIGINT) AS uacs_sobj_cd FROM {nep_line}""")
def s9(t):
    path = folder(t)
    rows = S.decomposed(t("nep_line")).select("fiscal_year", "record_id", "department", "agency", "operunit", "uacs_reg_id", "fundcd", "uacs_sobj_cd")
    S.reload(rows, path, "fiscal_year")
    S.reload(rows, path, "fiscal_year")  # whole years take the place of what is there
    return t.spark.read.schema(rows.schema).parquet(path)


# Filters

query("p1_valid_lines", LINE_T, f"SELECT {LINE} FROM {V} b")(v)
query("p2_valid_proposals", "record_id s, amount d", f"SELECT record_id, amount FROM {NV} n")(nv)
SEARCHED = ["project_name", "province"]
FILTERS = {"amt_min": "20000", "amt_max": "60000", "department": "3", "agency": "not a number", "dsc": "RED", "uacs_fundsubcat_dsc": " "}
query("p3_filter_map", LINE_T, f"SELECT {LINE} FROM {{budget_line}} WHERE amt >= 20000 AND amt <= 60000 AND department = 3 AND contains(lower(dsc), 'red')")(lambda t: P.filter_lines(t("budget_line"), FILTERS))
query("p3_filter_map_indexed", LINE_T, f"SELECT {LINE} FROM {{budget_line}} WHERE amt >= 20000 AND amt <= 60000 AND department = 3 AND contains(lower(dsc), 'red')")(lambda t: P.filter_lines(t.by_gram("budget_line", ["dsc"]).with_terms({"dsc": FILTERS["dsc"]}), FILTERS))
query("p4_project_filter", "id i, project_name s", "SELECT id, project_name FROM {project} WHERE status = 'Completed' AND region = 'ASIA' AND lower(project_name) LIKE '%building%'")(lambda t: P.filter_projects(t("project"), search="BUILDING", status="Completed", region="ASIA"))
query("p5_facet_filter", "id i", "SELECT id FROM {project} WHERE city = 'MACHINERY' AND office = '1-URGENT'")(lambda t: P.filter_facets(t("project"), {"city": "MACHINERY", "office": "1-URGENT", "region": ""}))
query("p6_raw_predicate", LINE_T, f"SELECT {LINE} FROM {{budget_line}} WHERE amt > 50000 AND (agency = 3 OR dsc = 'red ring')")(lambda t: P.filter_raw(t("budget_line"), "amt > 50000 AND (agency = 3 OR dsc = 'red ring')"))
query("p7_keyword_categories", "category s, sorder i, amt d", f"SELECT category, sorder, amt FROM ({CAT_SQL.replace('{src}', '{budget_line}')}) x")(lambda t: P.by_category(t("budget_line"), "dsc", CATEGORIES))
query("p8_prefix_values", "value s", "SELECT DISTINCT province AS value FROM {project} WHERE lower(province) LIKE 'nation_1%' ORDER BY value LIMIT 10")(lambda t: P.prefix_values(t("project"), "province", "nation_1"))
query("p8_prefix_values_indexed", "value s", "SELECT DISTINCT province AS value FROM {project} WHERE lower(province) LIKE 'nation_1%' ORDER BY value LIMIT 10")(lambda t: P.prefix_values(t.by_gram("project", SEARCHED).with_prefix("province", "nation_1"), "province", "nation_1"))


@query("p9_linked_rows", "id i, status s, contract_id i, amount d, rank i", """
SELECT id, status, contract_id, amount, rank FROM (SELECT p.id, p.status, c.id AS contract_id, c.amount, row_number() OVER (PARTITION BY p.contractor ORDER BY c.amount DESC, c.id, p.id) AS rank FROM {project} p JOIN {contract} c ON c.id = p.id) x WHERE rank <= 10""")
def p9(t):
    c = t("contract").select(F.col("id").alias("contract_id"), "amount")
    got = t("project").join(c, F.col("id") == F.col("contract_id"))
    return G.ranked(got, F.desc("amount"), F.col("contract_id"), F.col("id"), partition=["contractor"]).where("rank <= 10")


query("p10_all_words_search", "id i", "SELECT id FROM {project} WHERE contains(lower(project_name || ' ' || province), 'works') AND contains(lower(project_name || ' ' || province), 'nation_7')")(lambda t: P.search_all_words(t("project"), ["project_name", "province"], "Works NATION_7"))
query("p10_all_words_search_indexed", "id i", "SELECT id FROM {project} WHERE contains(lower(project_name || ' ' || province), 'works') AND contains(lower(project_name || ' ' || province), 'nation_7')")(lambda t: P.search_all_words(t.by_gram("project", SEARCHED).with_words(SEARCHED, "Works NATION_7"), SEARCHED, "Works NATION_7"))
query("p11_bounding_box", "id i, lat d, lng d", "SELECT id, lat, lng FROM {project} WHERE lat BETWEEN 15.0 AND 16.6 AND lng BETWEEN 120.0 AND 121.2")(lambda t: P.in_box(t("project")))


@query("p12_typed_cleansing", "id i, cost d, lat d, bad_cost i", """
SELECT id, coalesce(TRY_CAST(replace(replace(c, '₱', ''), ',', '') AS DOUBLE), 0) AS cost, TRY_CAST(l AS DOUBLE) AS lat, CASE WHEN TRY_CAST(replace(replace(c, '₱', ''), ',', '') AS DOUBLE) IS NULL THEN 1 ELSE 0 END AS bad_cost
FROM (SELECT id, CASE WHEN id % 7 = 0 THEN 'n/a' ELSE '₱' || CAST(cost AS VARCHAR) END AS c, CASE WHEN id % 5 = 0 THEN '' ELSE CAST(lat AS VARCHAR) END AS l FROM {project}) x""")
def p12(t):
    x = t("project").select("id", F.expr("CASE WHEN id % 7 = 0 THEN 'n/a' ELSE '₱' || CAST(cost AS STRING) END").alias("c"), F.expr("CASE WHEN id % 5 = 0 THEN '' ELSE CAST(lat AS STRING) END").alias("l"))
    return x.select("id", money(F.col("c")).alias("cost"), F.trim("l").try_cast("double").alias("lat"), F.translate("c", "₱, ", "").try_cast("double").isNull().cast("int").alias("bad_cost"))


# Rollups

FULL = "count(*) AS n, sum({a}) AS total, CAST(sum({a}) AS DOUBLE)/count({a}) AS mean, min({a}) AS least, max({a}) AS most"
query("g1_year_statistics", "n i, total d, mean d, least d, most d", f"SELECT {FULL.replace('{a}', 'amt')} FROM {V} b WHERE year = {YEAR}")(lambda t: S.year_scan(v(t), YEAR).agg(*G.full_measures("amt")))
for key, col in (("departments", "uacs_dpt_dsc"), ("agencies", "uacs_agy_dsc"), ("expenses", "uacs_exp_dsc"), ("regions", "uacs_reg_dsc")):
    query(f"g2_top_{key}", "label s, n i, total d", f"SELECT {col} AS label, count(*) AS n, sum(amt) AS total FROM {V} b WHERE year = {YEAR} AND {col} IS NOT NULL AND {col} NOT IN ('', 'INVALID') GROUP BY {col} ORDER BY total DESC, label LIMIT 10")(lambda t, col=col: G.top_by(S.year_scan(v(t), YEAR), col, "amt"))
for key, col in (("organisations", "org_uacs_code"), ("regions", "region_code"), ("objects", "object_uacs_code")):
    query(f"g3_top_proposed_{key}", "label s, n i, total d", f"SELECT {col} AS label, count(*) AS n, sum(amount) AS total FROM {NV} x WHERE {col} IS NOT NULL GROUP BY {col} ORDER BY total DESC, label LIMIT 10")(lambda t, col=col: G.top_by(nv(t), col, "amount"))
query("g4_overview_year", "n i, total d, departments i, agencies i", f"SELECT count(*) AS n, CAST(sum(amt) AS DOUBLE) / 1000 AS total, count(DISTINCT department) AS departments, count(DISTINCT uacs_agy_dsc) AS agencies FROM {{budget_line}} WHERE year = {YEAR}")(lambda t: S.year_scan(t("budget_line"), YEAR).agg(F.count("*").alias("n"), (F.sum("amt").cast("double") / 1000).alias("total"), F.count_distinct("department").alias("departments"), F.count_distinct("uacs_agy_dsc").alias("agencies")))
OVER = "SELECT 'all_years' AS scope, count(*) AS n, sum({a}) AS total FROM {t} UNION ALL SELECT CAST({y} AS VARCHAR), count(*), sum({a}) FROM {t} GROUP BY {y}"
query("g5_overview_all_years", "scope s, n i, total d", OVER.replace("{a}", "amt").replace("{y}", "year").replace("{t}", "{budget_line}"))(lambda t: G.overview(t("budget_line"), "year", "amt"))
query("s13_summary_table", "scope s, n i, total d", OVER.replace("{a}", "amount").replace("{y}", "fiscal_year").replace("{t}", "{nep_line}"))(lambda t: G.overview(t("nep_line"), "fiscal_year", "amount"))
PARTS = ["department", "uacs_agy_dsc", "uacs_exp_dsc"]


def partial_summary(t, years=None):
    """Partial aggregates of all years, then one year refreshed alone, then merged."""
    path, lines = folder(t), t("budget_line")
    Q.refresh(lines, path, year="year", amount="amt", distinct=PARTS)
    Q.refresh(S.year_scan(lines, YEAR), path, year="year", amount="amt", distinct=PARTS)
    return Q.merged(t.spark, path, PARTS, years)


RECOUNT = "SELECT {s} AS scope, count(*) AS n, sum(amt) AS total, " + ", ".join(f"count(DISTINCT {c}) AS {c}" for c in PARTS) + " FROM {budget_line}"
query("s13_merged_partials", "scope s, n i, total d, department i, uacs_agy_dsc i, uacs_exp_dsc i", RECOUNT.replace("{s}", "'all_years'") + " UNION ALL " + RECOUNT.replace("{s}", "CAST(year AS VARCHAR)") + " GROUP BY year")(partial_summary)
query("g4_overview_from_partials", "n i, total d, departments i, agencies i", f"SELECT count(*) AS n, CAST(sum(amt) AS DOUBLE) / 1000 AS total, count(DISTINCT department) AS departments, count(DISTINCT uacs_agy_dsc) AS agencies FROM {{budget_line}} WHERE year = {YEAR}")(
    lambda t: partial_summary(t, [YEAR]).where("scope = 'all_years'").select("n", (F.col("total").cast("double") / 1000).alias("total"), F.col("department").alias("departments"), F.col("uacs_agy_dsc").alias("agencies")))
query("g6_top_organisation", "label s, total d", f"SELECT org_uacs_code AS label, sum(amount) AS total FROM {NV} x GROUP BY 1 ORDER BY total DESC, label LIMIT 1")(lambda t: G.top_by(nv(t), "org_uacs_code", "amount", 1))
query("g7_last_updated", "last s", "SELECT strftime(max(updated_at), '%Y-%m-%d') AS last FROM {nep_line}")(lambda t: t("nep_line").agg(F.date_format(F.max("updated_at"), "yyyy-MM-dd").alias("last")))
query("g8_yearly_totals", "fiscal_year i, n i, total d", f"SELECT fiscal_year, count(*) AS n, sum(amount) AS total FROM {NV} x GROUP BY 1")(lambda t: nv(t).groupBy("fiscal_year").agg(*G.measures("amount")))
query("g9_top_programs", "label s, n i, total d", f"SELECT description AS label, count(*) AS n, sum(amount) AS total FROM {NV} x GROUP BY 1 ORDER BY total DESC, label LIMIT 20")(lambda t: G.top_by(nv(t), "description", "amount", 20))


@query("g10_enacted_vs_proposed", "year i, enacted d, proposed d", f"SELECT coalesce(a.year, b.year) AS year, coalesce(a.s, 0) AS enacted, coalesce(b.s, 0) AS proposed FROM (SELECT year, sum(amt) AS s FROM {V} x GROUP BY year) a FULL JOIN (SELECT fiscal_year AS year, sum(amount) AS s FROM {NV} y WHERE fiscal_year >= 1998 GROUP BY 1) b ON a.year = b.year")
def g10(t):
    a = v(t).groupBy("year").agg(F.sum("amt").cast("double").alias("enacted"))
    b = nv(t).where("fiscal_year >= 1998").groupBy(F.col("fiscal_year").alias("year")).agg(F.sum("amount").cast("double").alias("proposed"))
    return a.join(b, "year", "full").na.fill(0.0)


CATALOG = ["uacs_dpt_dsc", "uacs_agy_dsc", "dsc", "uacs_fundsubcat_dsc", "uacs_exp_dsc", "uacs_sobj_dsc", "uacs_reg_dsc", "uacs_reg_id"]
CATALOG_SQL = " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {{src}} WHERE {c} IS NOT NULL AND CAST({c} AS VARCHAR) NOT IN ('', 'INVALID', '-1') GROUP BY {c}" for c in CATALOG)
query("g22_value_catalog", "column_name s, value s, n i", CATALOG_SQL.replace("{src}", "{budget_line}"))(lambda t: G.value_catalog(t("budget_line"), CATALOG))
query("g23_cascading_options", "column_name s, value s, n i", f"SELECT column_name, value, n FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS r FROM ({CATALOG_SQL.replace('{src}', '(SELECT * FROM {budget_line} WHERE department = 3) x')}) y) z WHERE r <= 1000")(lambda t: G.value_catalog(P.filter_lines(t("budget_line"), {"department": 3}), CATALOG, 1000))
query("g24_table_metadata", "n i, columns i, files i", "SELECT count(*) AS n, max(len(json_keys(to_json(b)))) AS columns, count(DISTINCT source_file) AS files FROM {budget_line} b")(lambda t: (b := t("budget_line")).agg(F.count("*").alias("n"), F.lit(len(b.columns)).alias("columns"), F.count_distinct("source_file").alias("files")))
query("g25_regional_profile", "label s, n i, mean d, median d, least d, most d, total d", f"SELECT uacs_reg_dsc AS label, count(*) AS n, CAST(sum(amt) AS DOUBLE)/count(*) AS mean, quantile_cont(CAST(amt AS DOUBLE), 0.5) AS median, min(amt) AS least, max(amt) AS most, sum(amt) AS total FROM {V} b GROUP BY 1 HAVING count(*) >= 10")(
    lambda t: G.regional_profile(v(t), "uacs_reg_dsc", "amt", 10))
query("g26_department_concentration", "label s, n i, total d, mean d, most d, regions i", f"SELECT uacs_dpt_dsc AS label, count(*) AS n, sum(amt) AS total, CAST(sum(amt) AS DOUBLE)/count(*) AS mean, max(amt) AS most, count(DISTINCT uacs_reg_id) AS regions FROM {V} b GROUP BY 1 ORDER BY total DESC, label LIMIT 20")(
    lambda t: v(t).groupBy(F.col("uacs_dpt_dsc").alias("label")).agg(*G.full_measures("amt"), F.count_distinct("uacs_reg_id").alias("regions")).orderBy(F.desc("total"), "label").limit(20))
query("g27_keyword_statistics", "category s, n i, total d, mean d, top5 d", f"""SELECT category, count(*) AS n, sum(amt) AS total, CAST(sum(amt) AS DOUBLE)/count(*) AS mean, sum(CASE WHEN r <= 5 THEN amt END) AS top5
FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY amt DESC, sorder) AS r FROM ({CAT_SQL.replace('{src}', V)}) x) y GROUP BY category""")(
    lambda t: G.keyword_statistics(P.by_category(v(t), "dsc", CATEGORIES), "category", "amt", ["sorder"]))


@query("g28_category_years", "category s, year i, n i, total d", f"""SELECT c.category, y.year, coalesce(g.n, 0) AS n, coalesce(g.total, 0) AS total FROM (SELECT unnest({list(CATEGORIES)}) AS category) c CROSS JOIN (SELECT unnest({YEARS}) AS year) y
LEFT JOIN (SELECT category, year, count(*) AS n, sum(amt) AS total FROM ({CAT_SQL.replace('{src}', V)}) x GROUP BY 1, 2) g ON g.category = c.category AND g.year = y.year""")
def g28(t):
    got = P.by_category(v(t), "dsc", CATEGORIES).groupBy("category", "year").agg(*G.measures("amt")).withColumn("total", F.col("total").cast("double"))
    s = t.spark
    return G.dense_grid(got, s.createDataFrame([(c,) for c in CATEGORIES], "category string"), s.createDataFrame([(y,) for y in YEARS], "year long"), ["category", "year"])


@query("g29_repeated_descriptions", "description s, amount d, n i, regions i, ids s", "SELECT description, amount, count(*) AS n, count(DISTINCT region_code) AS regions, string_agg(record_id, ',' ORDER BY record_id) AS ids FROM (SELECT description, region_code, record_id, CAST(floor(amount / 500) * 500 AS DECIMAL(20,2)) AS amount FROM {nep_line}) x GROUP BY description, amount HAVING count(*) > 1")
def g29(t):
    lines = t("nep_line").withColumn("amount", (F.floor(F.col("amount") / 500) * 500).cast("decimal(20,2)"))
    return lines.groupBy("description", "amount").agg(F.count("*").alias("n"), F.count_distinct("region_code").alias("regions"), F.array_join(F.sort_array(F.collect_list("record_id")), ",").alias("ids")).where("n > 1")


query("g30_source_files", "source_file s, n i, total d", "SELECT source_file, count(*) AS n, sum(amount) AS total FROM {nep_line} GROUP BY 1")(lambda t: t("nep_line").groupBy("source_file").agg(*G.measures("amount")))
Q31 = ["region_code", "amount", "description"]
query("g31_quality_counters", "column_name s, nulls i, zeros i, blanks i", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(*) FILTER (WHERE TRY_CAST({c} AS DOUBLE) = 0) AS zeros, count(*) FILTER (WHERE trim(CAST({c} AS VARCHAR)) = '') AS blanks FROM {{nep_line}}" for c in Q31))(lambda t: G.null_counts(t("nep_line"), Q31))
query("g32_field_completeness", "column_name s, filled i, percent d", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE length(trim(CAST({c} AS VARCHAR))) > 0) AS filled, 100.0 * count(*) FILTER (WHERE length(trim(CAST({c} AS VARCHAR))) > 0) / count(*) AS percent FROM {{nep_line}}" for c in Q31))(lambda t: G.completeness(t("nep_line"), Q31))
query("g35_duplicate_keys", "sorder i, n i", "SELECT sorder, count(*) AS n FROM {budget_line} GROUP BY 1 HAVING count(*) > 1")(lambda t: t("budget_line").groupBy("sorder").agg(F.count("*").alias("n")).where("n > 1"))

# Duplicates

K5 = ["dsc", "uacs_sobj_dsc", "uacs_exp_dsc", "department", "agency"]
K7 = ["dsc", "agency", "department", "uacs_exp_cd", "fundcd", "uacs_sobj_cd", "amt_coarse"]
K9 = ["dsc", "amt_coarse", "agency", "department", "fundcd", "uacs_exp_cd", "operunit", "uacs_reg_id"]
csv = lambda k: ", ".join(k)
query("d1_groups_5_keys", "dsc s, uacs_sobj_dsc s, uacs_exp_dsc s, department i, agency i, n i, total d, severity s", f"SELECT {csv(K5)}, count(*) AS n, sum(amt) AS total, CASE WHEN count(*) >= 3 THEN 'high' ELSE 'medium' END AS severity FROM {V} b GROUP BY {csv(K5)} HAVING count(*) > 1")(lambda t: D.duplicate_groups(v(t), K5, "amt"))
query("d2_groups_7_keys", "dsc s, agency i, department i, amt_coarse d, n i", f"SELECT {csv(K7)}, count(*) AS n FROM {V} b WHERE dsc <> 'INVALID' GROUP BY {csv(K7)} HAVING count(*) > 1 ORDER BY n DESC, {csv(K7)} LIMIT 10")(lambda t: D.duplicate_groups(D.described(v(t)), K7, "amt").orderBy(F.desc("n"), *K7).limit(10))
_tiers = [(n, ["dsc", "amt_coarse", *[c for c in cols if c != "uacs_operdiv_id"]]) for n, cols in D.TIERS]
query("d3_tiered_duplicates", "tier s, n i, score d", "SELECT tier, count(*) AS n, min(score) AS score FROM (SELECT tier, round(CAST(substr(tier, 1, 1) AS DOUBLE) / 9 * 100, 1) AS score FROM (SELECT CASE " + " ".join(f"WHEN count(*) OVER (PARTITION BY {csv(k)}) > 1 THEN '{n}'" for n, k in _tiers) + f" END AS tier FROM {V} b WHERE dsc <> 'INVALID') x WHERE tier IS NOT NULL) y GROUP BY tier")(
    lambda t: D.tier_sizes(v(t)))
ORDER9 = ["sorder", "amt", "uacs_sobj_dsc", "year"]
query("d4_scored_duplicates", "sorder i, dsc s, amt_coarse d, n i", f"SELECT sorder, dsc, amt_coarse, n FROM (SELECT *, count(*) OVER (PARTITION BY {csv(K9)}) AS n, row_number() OVER (PARTITION BY {csv(K9)} ORDER BY {csv(ORDER9)}) AS r FROM {V} b) x WHERE n > 1 AND r = 1")(lambda t: D.scored_duplicates(v(t), K9, ORDER9))
query("d5_pair_scores", "severity s, n i, mean d", f"""SELECT severity, count(*) AS n, avg(score) AS mean FROM (SELECT score, CASE WHEN score >= 80 THEN 'high' WHEN score >= 60 THEN 'medium' ELSE 'low' END AS severity FROM (
SELECT round(least(100, (CAST(a.fundcd = b.fundcd AS INT) + CAST(a.uacs_exp_cd = b.uacs_exp_cd AS INT) + CAST(a.uacs_sobj_cd = b.uacs_sobj_cd AS INT) + CAST(a.operunit = b.operunit AS INT)) / 4.0 * 100 + CASE WHEN a.amt = b.amt THEN 20 ELSE 0 END), 1) AS score
FROM {V} a JOIN {V} b ON a.dsc = b.dsc AND a.department = b.department AND a.agency = b.agency AND a.amt_coarse = b.amt_coarse AND a.year = b.year AND a.sorder < b.sorder) x) y GROUP BY severity""")(
    lambda t: D.score_pairs(D.row_pairs(v(t), ["dsc", "department", "agency", "amt_coarse", "year"], "sorder", ["fundcd", "uacs_exp_cd", "uacs_sobj_cd", "operunit", "amt"]), ["fundcd", "uacs_exp_cd", "uacs_sobj_cd", "operunit"], "amt").groupBy("severity").agg(F.count("*").alias("n"), F.avg("score").alias("mean")))
PAIRS7 = [("uacs_dpt_dsc", "department"), ("uacs_agy_dsc", "agency"), ("uacs_exp_dsc", "uacs_exp_cd"), ("uacs_sobj_dsc", "uacs_sobj_cd"), ("uacs_div_dsc", "uacs_operdiv_id"), ("uacs_oper_dsc", "operunit"), ("uacs_fundsubcat_dsc", "fundcd")]
query("d7_inconsistent_codes", "pair s, description s, n_codes i, codes s, severity s", " UNION ALL ".join(f"SELECT '{d}/{c}' AS pair, {d} AS description, count(DISTINCT {c}) AS n_codes, string_agg(DISTINCT CAST({c} AS VARCHAR), ', ' ORDER BY CAST({c} AS VARCHAR)) AS codes, CASE WHEN count(DISTINCT {c}) > 5 THEN 'High' ELSE 'Medium' END AS severity FROM {{budget_line}} WHERE {d} NOT IN ('', 'INVALID') GROUP BY {d} HAVING count(DISTINCT {c}) > 1" for d, c in PAIRS7 if d not in ("uacs_div_dsc", "uacs_oper_dsc")))(lambda t: D.inconsistent_codes(t("budget_line"), PAIRS7))
query("d8_duplicate_count", "n i", f"SELECT count(*) AS n FROM (SELECT 1 FROM {V} b GROUP BY {csv(K9)} HAVING count(*) > 1) x")(lambda t: D.duplicate_groups(v(t), K9, "amt").agg(F.count("*").alias("n")))
query("j1_group_rows", "sorder i, dsc s, n i", f"SELECT sorder, dsc, n FROM (SELECT *, count(*) OVER (PARTITION BY {csv(K7)}) AS n FROM {V} b) x WHERE n > 1")(lambda t: D.group_rows(v(t), K7))
query("j2_row_pairs", "a_sorder i, b_sorder i", f"SELECT a.sorder AS a_sorder, b.sorder AS b_sorder FROM {V} a JOIN {V} b ON " + " AND ".join(f"a.{k} = b.{k}" for k in K7) + " AND a.sorder < b.sorder")(lambda t: D.row_pairs(v(t), K7, "sorder", []))
query("w1_row_number", "sorder i, rank i", f"SELECT sorder, row_number() OVER (PARTITION BY {csv(K9)} ORDER BY {csv(ORDER9)}) AS rank FROM {V} b")(lambda t: G.ranked(v(t), *[F.col(c) for c in ORDER9], partition=K9))
query("w4_page", LINE_T, f"SELECT {LINE} FROM {V} b ORDER BY amt DESC, sorder, dsc, year LIMIT 50 OFFSET 100")(lambda t: P.page(v(t), [F.desc("amt"), F.col("sorder"), F.col("dsc"), F.col("year")], 100, 50))
query("w5_top_k", LINE_T, f"SELECT {LINE} FROM {V} b ORDER BY amt DESC, sorder, dsc, year LIMIT 25")(lambda t: P.page(v(t), [F.desc("amt"), F.col("sorder"), F.col("dsc"), F.col("year")], 0, 25))
query("w6_nulls_last", "region_code s, n i, position i", "SELECT region_code, n, row_number() OVER (ORDER BY region_code DESC NULLS LAST) AS position FROM (SELECT region_code, count(*) AS n FROM {nep_line} GROUP BY 1) x")(lambda t: G.ranked(t("nep_line").groupBy("region_code").agg(F.count("*").alias("n")), F.desc_nulls_last("region_code"), name="position"))
query("u1_union_all", "source s, n i, total d", "SELECT 'enacted' AS source, count(*) AS n, sum(amt) AS total FROM {budget_line} UNION ALL SELECT 'proposed', count(*), sum(amount) FROM {nep_line}")(lambda t: t("budget_line").agg(F.lit("enacted").alias("source"), *G.measures("amt")).unionByName(t("nep_line").agg(F.lit("proposed").alias("source"), *G.measures("amount"))))

# Trends

@query("t1_department_trend", ", ".join(["label s", *[f"y{y} d" for y in YEARS], *[f"g{y} d" for y in YEARS[1:]]]), f"""SELECT label, {", ".join(f"y{y}" for y in YEARS)}, {", ".join(f"CASE WHEN y{a} > 0 THEN (y{b} - y{a}) / y{a} * 100 ELSE 0 END AS g{b}" for a, b in zip(YEARS, YEARS[1:]))}
FROM (SELECT uacs_dpt_dsc AS label, {", ".join(f"CAST(coalesce(sum(CASE WHEN year = {y} THEN amt END), 0) AS DOUBLE) AS y{y}" for y in YEARS)} FROM {V} b GROUP BY 1) x ORDER BY {" + ".join(f"y{y}" for y in YEARS)} DESC, label LIMIT 20""")
def t1(t):
    return T.pivot_years(v(t), "uacs_dpt_dsc", "year", "amt", YEARS).orderBy(F.desc("total"), "label").limit(20)


TOTALS = f"SELECT year, CAST(sum(amt) AS DOUBLE) AS total FROM {V} b GROUP BY year"
GROW = "CASE WHEN coalesce(lag(total) OVER (ORDER BY year), 0) > 0 THEN (total - lag(total) OVER (ORDER BY year)) / lag(total) OVER (ORDER BY year) * 100 ELSE 0 END"
query("t2_yearly_growth", "year i, total d, growth d, alert i", f"SELECT year, total, growth, CAST(growth >= 20 AS INT) AS alert FROM (SELECT year, total, {GROW} AS growth FROM ({TOTALS}) x) y")(lambda t: T.yearly_growth(v(t), "year", "amt"))
query("w3_yearly_delta", "year i, delta d", f"SELECT year, total - lag(total) OVER (ORDER BY year) AS delta FROM ({TOTALS}) x")(lambda t: v(t).groupBy("year").agg(F.sum("amt").cast("double").alias("total")).select("year", F.expr("total - lag(total) OVER (ORDER BY year)").alias("delta")))
MEAN = """SELECT label, latest, mean, CASE WHEN mean > 0 THEN (latest - mean) / mean * 100 ELSE 0 END AS over_mean, CASE WHEN last > 0 THEN (latest - last) / last * 100 ELSE 0 END AS over_last FROM (
SELECT label, coalesce(sum(CASE WHEN year = 2000 THEN total END), 0) AS latest, coalesce(avg(CASE WHEN year < 2000 AND total > 0 THEN total END), 0) AS mean, coalesce(sum(CASE WHEN year = 1999 THEN total END), 0) AS last FROM ({src}) x GROUP BY label) y"""
query("t3_against_mean", "label s, latest d, mean d, over_mean d, over_last d", MEAN.replace("{src}", f"SELECT uacs_reg_dsc AS label, year, CAST(sum(amt) AS DOUBLE) AS total FROM {V} b GROUP BY 1, 2"))(lambda t: T.against_mean(v(t), F.col("uacs_reg_dsc"), "year", "amt", YEAR))
RISE = f"""SELECT a.label, a.n, a.total, b.label IS NULL AS is_new, CASE WHEN b.label IS NOT NULL THEN CASE WHEN b.total > 0 THEN (a.total - b.total) / b.total * 100 ELSE 0 END END AS growth, a.total - coalesce(b.total, 0) AS increase,
CASE WHEN b.label IS NULL AND a.total >= 1000 THEN 'NEW' WHEN b.label IS NOT NULL AND CASE WHEN b.total > 0 THEN (a.total - b.total) / b.total * 100 ELSE 0 END >= 50 AND a.total >= 0 THEN 'ALERT' ELSE 'OK' END AS status
FROM (SELECT uacs_agy_dsc AS label, count(*) AS n, CAST(sum(amt) AS DOUBLE) AS total FROM {V} x WHERE year = {YEAR} GROUP BY 1) a LEFT JOIN (SELECT uacs_agy_dsc AS label, CAST(sum(amt) AS DOUBLE) AS total FROM {V} y WHERE year = {BEFORE} AND agency <> 4 GROUP BY 1) b ON a.label = b.label"""
query("t4_sudden_rise", "label s, n i, total d, is_new b, growth d, increase d, status s", RISE)(
    lambda t: T.sudden_rise(now(t), before(t).where("agency <> 4"), "uacs_agy_dsc", "amt", 0, 1000))
query("j10_later_left_join", "label s, total d, increase d", f"SELECT label, total, increase FROM ({RISE}) r")(
    lambda t: T.sudden_rise(now(t), before(t).where("agency <> 4"), "uacs_agy_dsc", "amt"))


@query("t5_category_rise", "label s, latest d, mean d, over_mean d, status s", f"SELECT label, latest, mean, over_mean, CASE WHEN over_last >= 30 OR over_mean >= 50 THEN 'ALERT' WHEN over_last >= 21 OR over_mean >= 35 THEN 'WATCH' ELSE 'OK' END AS status FROM ({MEAN.replace('{src}', f'''SELECT category AS label, year, CAST(sum(amt) AS DOUBLE) AS total FROM ({CAT_SQL.replace('{src}', V)}) c GROUP BY 1, 2''')}) z")
def t5(t):
    got = T.against_mean(P.by_category(v(t), "dsc", CATEGORIES), F.col("category"), "year", "amt", YEAR)
    return got.withColumn("status", F.expr("CASE WHEN over_last >= 30 OR over_mean >= 50 THEN 'ALERT' WHEN over_last >= 21 OR over_mean >= 35 THEN 'WATCH' ELSE 'OK' END"))


NEW_KEYS = ["dsc", "amt", "uacs_reg_id", "operunit"]
query("t6_new_large_items", "dsc s, amt d, n i, total d", f"SELECT dsc, amt, n, CAST(amt AS DOUBLE) * n AS total FROM (SELECT {csv(NEW_KEYS)}, count(*) AS n FROM {V} a WHERE year = {YEAR} AND amt >= 30000 GROUP BY {csv(NEW_KEYS)} ORDER BY amt DESC, {csv(NEW_KEYS)} LIMIT 100) x WHERE dsc NOT IN (SELECT dsc FROM {V} b WHERE year = {BEFORE} AND operunit < 3 AND dsc IS NOT NULL)")(
    lambda t: T.new_large_items(now(t), before(t).where("operunit < 3"), NEW_KEYS, "amt", 30000, 100, "dsc"))
CONC = f"""SELECT 100.0 * sum(CASE WHEN r <= 3 THEN n END) / sum(n) AS row_share, 100.0 * sum(CASE WHEN r <= 3 THEN total END) / sum(total) AS amount_share, count(*) AS groups FROM (SELECT *, row_number() OVER (ORDER BY total DESC, label) AS r FROM (SELECT uacs_reg_dsc AS label, count(*) AS n, CAST(sum(amt) AS DOUBLE) AS total FROM {V} b GROUP BY 1) x) y"""
query("t7_concentration", "row_share d, amount_share d, groups i, flag s", f"SELECT *, CASE WHEN amount_share >= 60 THEN 'HIGH' WHEN amount_share >= 48 THEN 'MODERATE' ELSE 'LOW' END AS flag FROM ({CONC}) z")(lambda t: T.concentration(v(t), "uacs_reg_dsc", "amt"))
PROFILE = f"SELECT uacs_agy_dsc AS label, CAST(sum(amt) AS DOUBLE)/count(*) AS mean FROM {V} b GROUP BY 1 HAVING count(*) >= 10"
query("t8_disparity", "ratio d, flag b", f"SELECT max(mean) / min(mean) AS ratio, max(mean) / min(mean) >= 2.5 AS flag FROM ({PROFILE}) x")(lambda t: v(t).groupBy("uacs_agy_dsc").agg(*G.full_measures("amt")).where("n >= 10").agg((F.max("mean") / F.min("mean")).alias("ratio"), (F.max("mean") / F.min("mean") >= 2.5).alias("flag")))
query("t9_high_value_list", LINE_T, f"SELECT {LINE} FROM {V} b WHERE amt > 90000 ORDER BY amt DESC, sorder, dsc, year LIMIT 100")(lambda t: v(t).where("amt > 90000").orderBy(F.desc("amt"), "sorder", "dsc", "year").limit(100))


@query("t10_risk_level", "score i, indicators i, level s", f"""SELECT score, indicators, CASE WHEN score >= 6 THEN 'CRITICAL' WHEN score >= 3 THEN 'HIGH' WHEN score >= 1 THEN 'MODERATE' ELSE 'LOW' END AS level FROM (SELECT coalesce(sum(CASE level WHEN 'HIGH' THEN 3 WHEN 'MODERATE' THEN 1 ELSE 0 END), 0) AS score, count(*) AS indicators FROM (
SELECT CASE WHEN amount_share >= 60 THEN 'HIGH' WHEN amount_share >= 48 THEN 'MODERATE' ELSE 'LOW' END AS level FROM ({CONC}) a
UNION ALL SELECT CASE WHEN max(mean) / min(mean) >= 2.5 THEN 'HIGH' ELSE 'LOW' END FROM ({PROFILE}) b
UNION ALL SELECT CASE WHEN growth >= 20 THEN 'HIGH' ELSE 'LOW' END FROM (SELECT year, {GROW} AS growth FROM ({TOTALS}) x) c) i) s""")
def t10(t):
    a = T.concentration(v(t), "uacs_reg_dsc", "amt").select(F.lit("concentration").alias("indicator"), F.col("flag").alias("level"))
    b = v(t).groupBy("uacs_agy_dsc").agg(*G.full_measures("amt")).where("n >= 10").agg(F.when(F.max("mean") / F.min("mean") >= 2.5, "HIGH").otherwise("LOW").alias("level")).select(F.lit("disparity").alias("indicator"), "level")
    c = T.yearly_growth(v(t), "year", "amt").select(F.lit("growth").alias("indicator"), F.when(F.col("alert") == 1, "HIGH").otherwise("LOW").alias("level"))
    return T.risk(a.unionByName(b).unionByName(c))


# Comparisons and reconciliation

query("j8_absent_descriptions", "dsc s, n i", f"SELECT dsc, count(*) AS n FROM {V} a WHERE year = {YEAR} AND lower(dsc) NOT IN (SELECT lower(dsc) FROM {V} b WHERE year = {BEFORE} AND operunit < 3 AND dsc IS NOT NULL) GROUP BY 1")(
    lambda t: now(t).withColumn("k", F.lower("dsc")).join(before(t).where("operunit < 3").select(F.lower("dsc").alias("k")).distinct(), "k", "left_anti").groupBy("dsc").agg(F.count("*").alias("n")))
DRIFT = ["dsc", "amt", "fundcd", "uacs_reg_dsc", "uacs_exp_cd"]


@query("j9_schema_drift", "column_name s, status s, values_a i, values_b i", "SELECT column_name, CASE WHEN column_name = 'fundcd' THEN 'missing_in_b' WHEN column_name = 'uacs_exp_cd' THEN 'type_changed' WHEN va = vb AND na = nb THEN 'same' ELSE 'profile_changed' END AS status, va AS values_a, vb AS values_b FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT CASE WHEN year = {BEFORE} THEN {c} END) AS va, {'NULL' if c == 'fundcd' else f'count(DISTINCT CASE WHEN year = {YEAR} THEN {c} END)'} AS vb, 0 AS na, 0 AS nb FROM {{budget_line}}" for c in DRIFT) + ") x")
def j9(t):
    a, b = S.year_scan(t("budget_line"), BEFORE), S.year_scan(t("budget_line"), YEAR)
    return R.schema_drift(a, b.drop("fundcd").withColumn("uacs_exp_cd", F.col("uacs_exp_cd").cast("string")), DRIFT)


SIDES = "SELECT coalesce(a.k, b.k) AS key, coalesce(a.n, 0) AS n_a, coalesce(a.s, 0) AS total_a, coalesce(b.n, 0) AS n_b, coalesce(b.s, 0) AS total_b, coalesce(a.s, 0) - coalesce(b.s, 0) AS difference FROM (SELECT {ka} AS k, count(*) AS n, CAST(sum({aa}) AS DOUBLE) AS s FROM {ta} GROUP BY 1) a FULL JOIN (SELECT {kb} AS k, count(*) AS n, CAST(sum({ab}) AS DOUBLE) AS s FROM {tb} GROUP BY 1) b ON a.k IS NOT DISTINCT FROM b.k"
SIDE_T = "key s, n_a i, total_a d, n_b i, total_b d, difference d"


def sides(**x):
    out = SIDES
    for k, val in x.items():
        out = out.replace("{" + k + "}", val)
    return out


query("j11_compare_regions", SIDE_T, sides(ka="region_code", aa="amount", ta="{nep_line}", kb="CASE WHEN uacs_reg_id > 0 THEN lpad(CAST(uacs_reg_id AS VARCHAR), 2, '0') END", ab="amt", tb="{budget_line}"))(
    lambda t: R.full_compare(t("nep_line").withColumn("k", F.col("region_code")), t("budget_line").withColumn("k", F.lpad(F.when(F.col("uacs_reg_id") > 0, F.col("uacs_reg_id").cast("string")), 2, "0")), "k", "amount", "amt"))
query("j12_compare_organisations", SIDE_T, sides(ka="CAST(org_uacs_code AS BIGINT)", aa="amount", ta="{nep_line}", kb="operunit", ab="amt", tb="{budget_line}"))(
    lambda t: R.full_compare(t("nep_line").withColumn("k", F.col("org_uacs_code").cast("long")), t("budget_line").withColumn("k", F.col("operunit")), "k", "amount", "amt"))
PART = "(SELECT * FROM {nep_line} WHERE NOT (fiscal_year = 1997 AND record_id LIKE '%7') AND fiscal_year <> 1999) "


def part(t):
    return t("nep_line").where("NOT (fiscal_year = 1997 AND record_id LIKE '%7') AND fiscal_year <> 1999")


query("r1_reconcile_years", "key s, n_a i, n_b i, difference d, status s", f"SELECT *, CASE WHEN n_b = 0 THEN 'MISSING_IN_TABLE' WHEN n_a = 0 THEN 'MISSING_IN_FILES' WHEN n_a = n_b AND abs(difference) < 1 THEN 'MATCH' ELSE 'MISMATCH' END AS status FROM ({sides(ka='fiscal_year', aa='amount', ta='{nep_line}', kb='fiscal_year', ab='amount', tb=PART + 'p')}) x")(lambda t: R.reconcile(t("nep_line"), part(t), "fiscal_year", "amount"))
query("r2_coverage", "files i, loaded i, missing i, percent d", f"SELECT count(*) AS files, count(p.record_id) AS loaded, count(*) - count(p.record_id) AS missing, 100.0 * count(p.record_id) / count(*) AS percent FROM {{nep_line}} n LEFT JOIN (SELECT DISTINCT record_id FROM {PART} y) p ON p.record_id = n.record_id")(lambda t: R.coverage(t("nep_line"), part(t), "record_id"))
query("r3_side_by_side", "source s, n i, total d, mean d, least d, most d", f"SELECT 'enacted' AS source, {FULL.replace('{a}', 'amt')} FROM {V} a UNION ALL SELECT 'proposed', {FULL.replace('{a}', 'amount')} FROM {NV} b")(lambda t: v(t).agg(F.lit("enacted").alias("source"), *G.full_measures("amt")).unionByName(nv(t).agg(F.lit("proposed").alias("source"), *G.full_measures("amount"))))
POS = "SELECT fiscal_year, row_number() OVER (PARTITION BY fiscal_year ORDER BY record_id) AS position, CAST(amount AS DOUBLE) AS v FROM {t}"
PAIRED = f"SELECT a.fiscal_year, a.position, round(abs(a.v - b.v), 2) AS difference FROM ({POS.replace('{t}', '{nep_line}')}) a JOIN ({POS.replace('{t}', PART + 'q')}) b ON a.fiscal_year = b.fiscal_year AND a.position = b.position"
query("j17_paired_rows", "fiscal_year i, position i, difference d", PAIRED)(lambda t: R.paired_rows(t("nep_line"), part(t), ["fiscal_year"], ["record_id"], "amount"))
query("r4_difference_bands", "band s, n i, percent d, mean d, most d", f"SELECT band, count(*) AS n, 100.0 * count(*) / max(whole) AS percent, avg(difference) AS mean, max(difference) AS most FROM (SELECT difference, count(*) OVER () AS whole, CASE WHEN difference < 0.01 THEN '0 none' WHEN difference < 1 THEN '1 under 1' WHEN difference < 100 THEN '2 under 100' WHEN difference < 1000 THEN '3 under 1000' WHEN difference < 10000 THEN '4 under 10000' ELSE '5 more' END AS band FROM ({PAIRED}) x) y GROUP BY band")(
    lambda t: R.difference_bands(R.paired_rows(t("nep_line"), part(t), ["fiscal_year"], ["record_id"], "amount")))


@query("r6_load_verification", "scope s, key s, n i, total d", " UNION ALL ".join(f"SELECT '{c}' AS scope, CAST({c} AS VARCHAR) AS key, count(*) AS n, sum(amount) AS total FROM {{nep_line}} GROUP BY {c}" for c in ("budget_type", "fiscal_year", "source_file")))
def r6(t):
    x = t("nep_line").groupingSets([["budget_type"], ["fiscal_year"], ["source_file"]], "budget_type", "fiscal_year", "source_file").agg(*G.measures("amount"), F.grouping("budget_type").alias("a"), F.grouping("fiscal_year").alias("b"))
    return x.select(F.when(F.col("a") == 0, "budget_type").when(F.col("b") == 0, "fiscal_year").otherwise("source_file").alias("scope"), F.coalesce("budget_type", F.col("fiscal_year").cast("string"), "source_file").alias("key"), "n", "total")
