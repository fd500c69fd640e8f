"""Queries over projects, contractors and code hierarchies; ingest of batch files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import GENERIC_WORDS, SUBSTRINGS, SUFFIX_WORDS, TITLE_WORDS, former_parts, standard_name, valid_name
from ..operators import entities as E
from ..operators import filters as P
from ..operators import geo as X
from ..operators import hierarchy as H
from ..operators import matching as M
from ..operators import rollups as G
from ..sources import pages as N
from ..sources import tables as S
from ..streaming import ingest as K
from .registry import folder, query

# Project statistics

query("g11_project_statistics", "n i, total d, mean d, regions i, ongoing i", "SELECT count(*) AS n, sum(cost) AS total, CAST(sum(cost) AS DOUBLE)/count(*) AS mean, count(DISTINCT region) AS regions, count(*) FILTER (WHERE status = 'Ongoing') AS ongoing FROM {project}")(
    lambda t: t("project").agg(*G.full_measures("cost"), F.count_distinct("region").alias("regions"), F.count_if(F.col("status") == "Ongoing").alias("ongoing")))
SHARE = "SELECT label, n, total, 100.0 * {of} AS percent FROM (SELECT {c} AS label, count(*) AS n, sum(cost) AS total FROM {project} WHERE {c} IS NOT NULL GROUP BY 1) x"
ROWS, SUMS = "n / (SELECT count(*) FROM {project})", "CAST(total AS DOUBLE) / (SELECT CAST(sum(cost) AS DOUBLE) FROM {project})"
share = lambda c, of: SHARE.replace("{c}", c).replace("{of}", of)
query("g12_status_distribution", "label s, n i, total d, percent d", share("status", ROWS))(lambda t: G.shares(t("project"), "status", "cost"))
query("g12_city_top6", "label s, n i, percent d", share("city", ROWS) + " ORDER BY n DESC, label LIMIT 6")(lambda t: G.shares(t("project"), "city", "cost", 6))
query("g13_top_regions", "region s, total d, n i, mean d", "SELECT region, sum(cost) AS total, count(*) AS n, CAST(sum(cost) AS DOUBLE)/count(*) AS mean FROM {project} GROUP BY 1 ORDER BY total DESC, region LIMIT 10")(lambda t: t("project").groupBy("region").agg(*G.full_measures("cost")).orderBy(F.desc("total"), "region").limit(10))
query("g14_top_first_office", "office s, n i, total d", "SELECT office, count(*) AS n, sum(cost) AS total FROM {project} GROUP BY 1 ORDER BY total DESC, office LIMIT 10")(
    lambda t: t("project").withColumn("offices", F.array("office", "contractor")).where(F.size("offices") > 0).groupBy(F.get("offices", F.lit(0)).alias("office")).agg(*G.measures("cost")).orderBy(F.desc("total"), "office").limit(10))
query("g15_by_start_year", "year i, n i, total d", "SELECT year(date_started) AS year, count(*) AS n, sum(cost) AS total FROM {project} GROUP BY 1")(lambda t: t("project").groupBy(F.year("date_started").alias("year")).agg(*G.measures("cost")))
query("g16_share_of_sum", "label s, total d, percent d", share("office", SUMS) + " ORDER BY total DESC, label LIMIT 5")(lambda t: G.shares(t("project"), "office", "cost", 5, of="sum", order="total"))
BAND = "CASE status WHEN 'Completed' THEN '100%' WHEN 'Ongoing' THEN '1-99%' ELSE '0%' END"
query("g17_progress_bands", "label s, n i, percent d", f"SELECT {BAND} AS label, count(*) AS n, 100.0 * count(*) / (SELECT count(*) FROM {{project}}) AS percent FROM {{project}} GROUP BY 1")(lambda t: G.shares(t("project").withColumn("band", F.expr(BAND)), "band", "cost"))
PLACE = ["region", "province", "city", "barangay"]
for name, order in (("amount", "total"), ("count", "n")):
    query(f"g18_places_by_{name}", "rank i, region s, province s, city s, barangay s, n i, total d, mean m, least d, most d, percent d", f"""SELECT row_number() OVER (ORDER BY {order} DESC, region, province, city, barangay) AS rank, * FROM (SELECT region, province, city, barangay, count(*) AS n, sum(cost) AS total, CAST(sum(cost) AS DOUBLE)/count(*) AS mean, min(cost) AS least, max(cost) AS most,
100.0 * count(*) / (SELECT count(*) FROM {{project}}) AS percent FROM {{project}} WHERE barangay <> 'N/A' GROUP BY 1, 2, 3, 4) x ORDER BY rank LIMIT 100""")(
        lambda t, order=order: G.ranked(t("project").where("barangay <> 'N/A'").groupBy(*PLACE).agg(*G.full_measures("cost")).crossJoin(F.broadcast(t("project").agg(F.count("*").alias("whole")))).withColumn("percent", 100.0 * F.col("n") / F.col("whole")).orderBy(F.desc(order), *PLACE).limit(100), F.desc(order), *[F.col(c) for c in PLACE]))
query("w2_rank_by_position", "rank i, region s, total d", "SELECT row_number() OVER (ORDER BY total DESC, region) AS rank, region, total FROM (SELECT region, sum(cost) AS total FROM {project} GROUP BY 1) x")(lambda t: G.ranked(t("project").groupBy("region").agg(F.sum("cost").alias("total")), F.desc("total"), F.col("region")))
FACETS = ["region", "infra_year", "city", "contractor"]


@query("g19_facet_statistics", "facet s, value s, n i", " UNION ALL ".join(f"SELECT '{c}' AS facet, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {{project}} WHERE CAST({c} AS VARCHAR) <> '' GROUP BY {c}" for c in FACETS[:3]) + " UNION ALL SELECT * FROM (SELECT 'contractor', contractor, count(*) AS n FROM {project} GROUP BY contractor ORDER BY n DESC, contractor LIMIT 50) c UNION ALL SELECT 'all', 'rows', count(*) FROM {project} UNION ALL SELECT 'all', 'contractors', count(DISTINCT contractor) FROM {project}")
def g19(t):
    p = t("project")
    got = G.long_values(p, FACETS).groupBy(F.col("column_name").alias("facet"), "value").agg(F.count("*").alias("n"))
    most = got.where("facet = 'contractor'").orderBy(F.desc("n"), "value").limit(50)
    got = got.where("facet <> 'contractor'").unionByName(most)
    whole = p.agg(F.count("*").alias("rows"), F.count_distinct("contractor").alias("contractors"))
    return got.unionByName(whole.select(F.lit("all").alias("facet"), F.stack(F.lit(2), F.lit("rows"), "rows", F.lit("contractors"), "contractors").alias("value", "n")))


query("g20_facet_counts", "value s, n i", "SELECT city AS value, count(*) AS n FROM {project} WHERE region = 'ASIA' GROUP BY 1")(lambda t: P.filter_facets(t("project"), {"region": "ASIA"}).groupBy(F.col("city").alias("value")).agg(F.count("*").alias("n")))
query("g21_distinct_values", "column_name s, value s", " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS column_name, {c} AS value FROM {{project}} WHERE {c} IS NOT NULL AND {c} <> ''" for c in ("status", *PLACE)))(lambda t: G.long_values(t("project"), ["status", *PLACE]).distinct())
query("g33_source_overlap", "only_a i, only_b i, only_c i, ab i, ac i, bc i, abc i, all_a i", """SELECT count(*) FILTER (WHERE a AND NOT b AND NOT c) AS only_a, count(*) FILTER (WHERE NOT a AND b AND NOT c) AS only_b, count(*) FILTER (WHERE NOT a AND NOT b AND c) AS only_c, count(*) FILTER (WHERE a AND b AND NOT c) AS ab, count(*) FILTER (WHERE a AND NOT b AND c) AS ac,
count(*) FILTER (WHERE NOT a AND b AND c) AS bc, count(*) FILTER (WHERE a AND b AND c) AS abc, count(*) FILTER (WHERE a) AS all_a FROM (SELECT contains(source, 'flood') AS a, contains(source, 'dime') AS b, contains(source, 'philgeps') AS c FROM {contractor_name}) x""")(lambda t: G.overlap(E.source_flags(t("contractor_name")), "has_flood", "has_dime", "has_philgeps"))
query("g34_registry_summary", "n i, with_number i, without i, suspicious i", "SELECT count(*) AS n, count(sec_number) AS with_number, count(*) - count(sec_number) AS without, count(*) FILTER (WHERE status = 'NO_SEC_RESULTS') AS suspicious FROM {contractor_name}")(
    lambda t: t("contractor_name").agg(F.count("*").alias("n"), F.count("sec_number").alias("with_number"), (F.count("*") - F.count("sec_number")).alias("without"), F.count_if(F.col("status") == "NO_SEC_RESULTS").alias("suspicious")))
query("g39_top_region_per_year", "infra_year i, region s, n i, total d", "SELECT infra_year, region, n, total FROM (SELECT *, row_number() OVER (PARTITION BY infra_year ORDER BY n DESC, region) AS r FROM (SELECT infra_year, region, count(*) AS n, CAST(sum(cost) AS DOUBLE) / 1000000 AS total FROM {project} GROUP BY 1, 2) x) y WHERE r = 1")(
    lambda t: G.ranked(t("project").groupBy("infra_year", "region").agg(F.count("*").alias("n"), (F.sum("cost").cast("double") / 1e6).alias("total")), F.desc("n"), F.col("region"), partition=["infra_year"]).where("rank = 1"))
query("g40_correlation_summary", "infra_year i, n i, total d, top_region s, percent d", "SELECT infra_year, sum(n) AS n, sum(total) AS total, max(CASE WHEN r = 1 THEN region END) AS top_region, 100.0 * max(CASE WHEN r = 1 THEN n END) / sum(n) AS percent FROM (SELECT *, row_number() OVER (PARTITION BY infra_year ORDER BY n DESC, region) AS r FROM (SELECT infra_year, region, count(*) AS n, sum(cost) AS total FROM {project} GROUP BY 1, 2) x) y GROUP BY 1")(
    lambda t: G.ranked(t("project").groupBy("infra_year", "region").agg(*G.measures("cost")), F.desc("n"), F.col("region"), partition=["infra_year"]).groupBy("infra_year").agg(F.sum("n").alias("rows"), F.sum("total").alias("total"), F.max(F.when(F.col("rank") == 1, F.col("region"))).alias("top_region"), F.max(F.when(F.col("rank") == 1, F.col("n"))).alias("m")).withColumn("percent", 100.0 * F.col("m") / F.col("rows")).withColumnRenamed("rows", "n"))
query("g41_unprocessed_contractors", "contractor s, n i", "SELECT contractor, count(*) AS n FROM {project} WHERE contractor NOT IN (SELECT c_name FROM {customer} WHERE c_custkey % 3 = 0) GROUP BY 1 ORDER BY n DESC, contractor LIMIT 100")(
    lambda t: t("project").join(t("customer").where("c_custkey % 3 = 0").select(F.col("c_name").alias("contractor")), "contractor", "left_anti").groupBy("contractor").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "contractor").limit(100))
PRIORITY = "CASE WHEN contractor LIKE '%7' THEN 0 WHEN contractor LIKE '%3' THEN 1 ELSE 2 END"
query("w7_priority_order", "position i, contractor s, n i", f"SELECT * FROM (SELECT row_number() OVER (ORDER BY {PRIORITY}, n DESC, contractor) AS position, contractor, n FROM (SELECT contractor, count(*) AS n FROM {{project}} GROUP BY 1) x) y WHERE position <= 50")(lambda t: G.ranked(t("project").groupBy("contractor").agg(F.count("*").alias("n")), F.expr(PRIORITY), F.desc("n"), F.col("contractor"), name="position").where("position <= 50"))
query("j7_contractor_counts", "c_name s, n i", "SELECT c_name, count(DISTINCT o_orderkey) AS n FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey GROUP BY 1")(lambda t: t("customer").join(t("orders"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_name").agg(F.count_distinct("o_orderkey").alias("n")))
query("u2_name_difference", "contractor s", "SELECT contractor FROM {project} WHERE infra_year = 1996 EXCEPT SELECT contractor FROM {project} WHERE infra_year = 1997")(lambda t: t("project").where("infra_year = 1996").select("contractor").subtract(t("project").where("infra_year = 1997").select("contractor")))
query("u2_name_intersection", "contractor s", "SELECT contractor FROM {project} WHERE infra_year = 1996 INTERSECT SELECT contractor FROM {project} WHERE infra_year = 1997")(lambda t: t("project").where("infra_year = 1996").select("contractor").intersect(t("project").where("infra_year = 1997").select("contractor")))
query("u3_distinct_keys", "key s", "SELECT region_code AS key FROM {nep_line} UNION SELECT region FROM {project}")(lambda t: t("nep_line").select(F.col("region_code").alias("key")).union(t("project").select("region")).distinct())

# Places

KM = "2 * 6371 * asin(sqrt(least(1, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2))))"
NEAR = f"SELECT * FROM (SELECT a.cost_coarse AS cost, a.id AS a_id, b.id AS b_id, a.contractor AS ac, b.contractor AS bc, a.infra_year AS ay, b.infra_year AS by_, a.project_name AS an, b.project_name AS bn, {KM} AS km FROM {{project}} a JOIN {{project}} b ON a.cost_coarse = b.cost_coarse AND a.id < b.id) x WHERE km <= 10"
near = lambda t, km=10.0: X.near_same_cost(t("project"), cost="cost_coarse", km=km, columns=("contractor", "infra_year", "project_name"))
query("j5_near_same_cost", "cost d, a_id i, b_id i, km d", f"SELECT cost, a_id, b_id, km FROM ({NEAR}) p")(near)
bands = ((0, 1, "km_0_1"), (1, 2, "km_1_2"), (2, 5, "km_2_5"), (5, 7.5, "km_5_7"), (7.5, 10, "km_7_10"))
query("x2_distance_summary", "pairs i, least_km d, most_km d, mean_km d, km_0_1 i, km_1_2 i, km_2_5 i, km_5_7 i, km_7_10 i", "SELECT count(*) AS pairs, min(km) AS least_km, max(km) AS most_km, avg(km) AS mean_km, " + ", ".join(f"count(*) FILTER (WHERE km >= {a} AND km < {b}) AS {n}" for a, b, n in bands) + f" FROM ({NEAR}) p")(lambda t: X.near_summary(t("project"), cost="cost_coarse"))
query("x3_pair_classes", "kind s, n i, same i, gap d", f"SELECT kind, count(*) AS n, sum(same) AS same, avg(gap) AS gap FROM (SELECT CASE WHEN ac = bc AND ay = by_ AND an = bn THEN 'duplicate_entry' WHEN ac = bc AND ay <> by_ THEN 'multi_year_tracking' ELSE 'different_projects' END AS kind, CAST(ac = bc AS INT) AS same, abs(ay - by_) AS gap FROM ({NEAR}) p WHERE km <= 1) q GROUP BY kind")(
    lambda t: X.classify_pairs(near(t, 1.0)).groupBy("kind").agg(F.count("*").alias("n"), F.sum("same_contractor").alias("same"), F.avg("year_gap").alias("gap")))
LINES = "SELECT {lng} AS lng, count(*) AS n, count(DISTINCT round(lat, 6)) AS places, min(lat) AS low, max(lat) AS high FROM {project} {where} GROUP BY 1 HAVING count(*) > {n} AND count(DISTINCT round(lat, 6)) > 1 AND max(lat) - min(lat) > 0.01"
query("x4_vertical_lines", "lng d, n i, places i, km d", "SELECT *, (high - low) * 111 AS km FROM (" + LINES.replace("{lng}", "lng").replace("{where}", "").replace("{n}", "1") + ") x WHERE NOT lng BETWEEN 120.5 AND 120.6")(lambda t: X.vertical_lines(t("project"), known=((120.5, 120.6),)))
query("x5_aligned_in_area", "lng d, n i, km d", "SELECT *, (high - low) * 111 AS km FROM (" + LINES.replace("{lng}", "round(lng, 4)").replace("{where}", "WHERE lat BETWEEN 10 AND 18 AND lng BETWEEN 118 AND 122").replace("{n}", "5") + ") x")(lambda t: X.vertical_lines(P.in_box(t("project"), (10, 18), (118, 122)), more_than=5, digits=4))
query("x7_coordinate_listing", "position i, id i, lng d, lat d", "SELECT row_number() OVER (ORDER BY lng, lat, id) AS position, id, lng, lat FROM {project} WHERE province = 'NATION_3'")(
    lambda t: G.numbered(t("project").where("province = 'NATION_3'"), "lng", "lat", "id"))
query("g36_shared_points", "lat d, lng d, n i, percent d", "SELECT lat, lng, count(*) AS n, 100.0 * count(*) / (SELECT count(*) FROM {project}) AS percent FROM {project} GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY n DESC, lat, lng LIMIT 20")(lambda t: X.shared_points(t("project"), 20))

# Hierarchy: nation -> region, supplier -> nation, line -> supplier


def levels(t):
    n, r, s = t("nation"), t("region"), t("supplier").where("s_nationkey <> 7")
    up = H.edges(n, r, F.col("n_regionkey"), F.col("r_regionkey"), F.concat(F.lit("N"), "n_nationkey"), F.concat(F.lit("R"), "r_regionkey"), "BELONGS_TO")
    mid = H.edges(s, n, F.col("s_nationkey"), F.col("n_nationkey"), F.concat(F.lit("S"), "s_suppkey"), F.concat(F.lit("N"), "n_nationkey"), "IN_AGENCY")
    facts = H.edges(t("lineitem"), s, F.col("l_suppkey"), F.col("s_suppkey"), F.concat(F.lit("L"), F.col("l_orderkey") * 10 + F.col("l_linenumber")), F.concat(F.lit("S"), "s_suppkey"), "BY_UNIT")
    return up, mid, facts


EDGE_UP = "SELECT 'N' || n_nationkey AS src, 'R' || r_regionkey AS dst, 'BELONGS_TO' AS type FROM {nation} JOIN {region} ON n_regionkey = r_regionkey"
EDGE_MID = "SELECT 'S' || s_suppkey AS src, 'N' || n_nationkey AS dst, 'IN_AGENCY' AS type FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey WHERE s_nationkey <> 7"
EDGE_FACT = "SELECT DISTINCT 'L' || (l_orderkey * 10 + l_linenumber) AS src, 'S' || s_suppkey AS dst, 'BY_UNIT' AS type FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey WHERE s_nationkey <> 7"
query("j13_hierarchy_edges", "src s, dst s, type s", f"{EDGE_UP} UNION ALL {EDGE_MID}")(lambda t: levels(t)[0].union(levels(t)[1]))
query("j14_fact_edges", "src s, dst s, type s", EDGE_FACT)(lambda t: levels(t)[2])
query("j15_hierarchy_chain", "n0 s, n1 s, n2 s", f"SELECT a.src AS n0, a.dst AS n1, b.dst AS n2 FROM ({EDGE_MID}) a JOIN ({EDGE_UP}) b ON a.dst = b.src")(lambda t: H.chain([levels(t)[1], levels(t)[0]]))
query("j16_orphans", "src s", f"SELECT 'S' || s_suppkey AS src FROM {{supplier}} WHERE 'S' || s_suppkey NOT IN (SELECT src FROM ({EDGE_MID}) e)")(lambda t: H.orphans(t("supplier").withColumn("k", F.concat(F.lit("S"), "s_suppkey")), levels(t)[1], "k"))
query("g37_edge_coverage", "type s, linked i, percent d", f"SELECT 'BY_UNIT' AS type, count(DISTINCT src) AS linked, 100.0 * count(DISTINCT src) / (SELECT count(DISTINCT l_orderkey * 10 + l_linenumber) FROM {{lineitem}}) AS percent FROM ({EDGE_FACT}) e")(lambda t: H.edge_coverage(t("lineitem").withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber")), levels(t)[2], "k"))
query("g37_edge_counts", "type s, n i", f"SELECT type, count(*) AS n FROM ({EDGE_UP} UNION ALL {EDGE_MID} UNION ALL {EDGE_FACT}) e GROUP BY 1")(lambda t: H.edge_counts(levels(t)[0].union(levels(t)[1]).union(levels(t)[2])))
query("g38_star_rollup", "region s, nation s, n i, total d", "SELECT r_name AS region, n_name AS nation, count(*) AS n, sum(CAST(l_extendedprice AS DECIMAL(20,2))) AS total FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey GROUP BY 1, 2 ORDER BY total DESC, region, nation LIMIT 10")(
    lambda t: G.ranked(t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("region"), F.col("n_name").alias("nation")).agg(F.count("*").alias("n"), F.sum(F.col("l_extendedprice").cast("decimal(20,2)")).alias("total")).orderBy(F.desc("total"), "region", "nation").limit(10), F.desc("total")))

# Names: the SQL spells the rules out once more

sub = "upper(contractor_name)"

for w in SUBSTRINGS:
    sub = f"replace({sub}, '{w}', '')"
sub = f"trim(regexp_replace(regexp_replace({sub}, '[^A-Z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'))"
sql_list = lambda x: ", ".join(f"'{w}'" for w in x)
tok = "list_filter(string_split(trim(regexp_replace(replace(translate(upper({c}), '.,-', '   '), '&', 'AND'), '\\s+', ' ', 'g')), ' '), lambda w: w <> '')"
token_sql = lambda c: f"CASE WHEN len(list_filter({tok.replace('{c}', c)}, lambda w: w NOT IN ({sql_list(SUFFIX_WORDS)}))) > 0 THEN array_to_string(list_filter({tok.replace('{c}', c)}, lambda w: w NOT IN ({sql_list(SUFFIX_WORDS)})), ' ') ELSE array_to_string({tok.replace('{c}', c)}, ' ') END"
suffix_sql = lambda c: f"upper(trim(regexp_replace(regexp_replace({c}, '(?i)\\s*(corp|corporation|inc|incorporated|ltd|limited|co|company|llc|llp)\\.?\\s*$', ''), '\\s+', ' ', 'g')))"
valid_sql = lambda c: f"(len(list_filter(string_split(trim({c}), ' '), lambda w: w <> '')) > 1 OR (length({c}) > 0 AND upper({c}) NOT IN ({sql_list(GENERIC_WORDS)})))"
query("e1_standard_names_substring", "norm s, n i, names i", f"SELECT {sub} AS norm, count(*) AS n, count(DISTINCT contractor_name) AS names FROM {{contractor_name}} GROUP BY 1")(lambda t: E.standardise(t("contractor_name"), "contractor_name", "substring"))
query("e1_standard_names_token", "norm s, n i, names i", f"SELECT {token_sql('contractor_name')} AS norm, count(*) AS n, count(DISTINCT contractor_name) AS names FROM {{contractor_name}} GROUP BY 1")(lambda t: E.standardise(t("contractor_name"), "contractor_name", "token"))
query("e1_standard_names_suffix", "norm s, n i", f"SELECT {suffix_sql('contractor_name')} AS norm, count(*) AS n FROM {{contractor_name}} GROUP BY 1")(lambda t: t("contractor_name").groupBy(F.upper(standard_name(F.col("contractor_name"), "suffix")).alias("norm")).agg(F.count("*").alias("n")))
query("e2_valid_names", "id i, valid b", f"SELECT id, {valid_sql('contractor_name')} AS valid FROM {{contractor_name}}")(lambda t: t("contractor_name").withColumn("valid", valid_name(F.col("contractor_name"))))
CUR = "CASE WHEN contains(contractor_name, '(FORMERLY') THEN trim(split_part(contractor_name, ' (FORMERLY', 1)) ELSE contractor_name END"
OLD = "CASE WHEN contains(contractor_name, '(FORMERLY') THEN trim(replace(split_part(contractor_name, 'FORMERLY: ', 2), ')', '')) END"
query("e3_former_names", "id i, current s, former s", f"SELECT id, {CUR} AS current, {OLD} AS former FROM {{contractor_name}}")(lambda t: t("contractor_name").select("id", former_parts(F.col("contractor_name"))[0].alias("current"), former_parts(F.col("contractor_name"))[1].alias("former")))
SPLIT = f"SELECT id, unnest(CASE WHEN contains(contractor_name, '(FORMERLY') THEN [{CUR}, {OLD}] WHEN contains(contractor_name, ' / ') THEN [trim(split_part(contractor_name, '/', 1)), trim(split_part(contractor_name, '/', 2))] ELSE [contractor_name] END) AS name FROM {{contractor_name}}"
query("e4_split_names", "name s", f"SELECT DISTINCT name FROM ({SPLIT}) x")(lambda t: E.split_all(t("contractor_name"), "contractor_name"))
query("e5_name_audit", "id i, class s, split_issues s, invalid_issues s", "SELECT id, CASE WHEN contains(contractor_name, ' / ') OR contains(contractor_name, '(FORMERLY') THEN 'needs_split' WHEN contractor_name = 'SUPPLY' THEN 'invalid' ELSE 'clean' END AS class, CASE WHEN contains(contractor_name, ' / ') THEN 'HAS_JV_SLASH' WHEN contains(contractor_name, '(FORMERLY') THEN 'HAS_FORMER_NAME,HAS_PAREN_FORMER' ELSE '' END AS split_issues, CASE WHEN contractor_name = 'SUPPLY' THEN 'SINGLE_COMMON_WORD,ALL_COMMON_WORDS' ELSE '' END AS invalid_issues FROM {contractor_name}")(lambda t: E.audit(t("contractor_name"), "contractor_name"))
DIRTY = "CASE id % 3 WHEN 0 THEN '{\"id\": 1, \"name\": \"' || contractor_name || '\"}' WHEN 1 THEN '\"' || contractor_name || '\"' ELSE contractor_name END"
query("e13_json_fragments", "id i, name s", f"SELECT min_by(id, (CAST(d <> contractor_name AS INT), id)) AS id, contractor_name AS name FROM (SELECT id, contractor_name, {DIRTY} AS d FROM {{contractor_name}}) x GROUP BY contractor_name")(lambda t: E.clean_fragments(t("contractor_name").withColumn("name", F.expr(DIRTY)), "id", "name"))
query("e14_consolidated_names", "id i, contractor_name s, source s, sec_number s, n i", "SELECT min(id) AS id, contractor_name, coalesce(string_agg(DISTINCT tag, ',' ORDER BY tag) FILTER (WHERE tag NOT IN ('', 'unknown')), '') AS source, min_by(sec_number, CASE WHEN sec_number IS NOT NULL THEN id END) AS sec_number, count(DISTINCT id) AS n FROM (SELECT *, unnest(string_split(source, ',')) AS tag FROM {contractor_name}) x GROUP BY contractor_name")(lambda t: E.consolidate(t("contractor_name")))
REG = "(SELECT contractor_name, min(source) AS source FROM {contractor_name} WHERE id % 6 IN (0, 4) GROUP BY 1)"
query("e15_merged_tags", "contractor_name s, source s", f"SELECT coalesce(a.contractor_name, b.name) AS contractor_name, CASE WHEN b.name IS NULL THEN a.source WHEN a.source IS NULL THEN 'dime' WHEN list_contains(string_split(a.source, ','), 'dime') THEN a.source ELSE a.source || ',dime' END AS source FROM {REG} a FULL JOIN (SELECT DISTINCT contractor_name AS name FROM {{contractor_name}} WHERE id % 6 IN (1, 4)) b ON a.contractor_name = b.name")(
    lambda t: E.merge_tag(t("contractor_name").where("id % 6 IN (0, 4)").groupBy("contractor_name").agg(F.min("source").alias("source")), t("contractor_name").where("id % 6 IN (1, 4)").select("contractor_name"), "dime"))
query("e16_source_flags", "id i, has_flood b, has_dime b, has_philgeps b", "SELECT id, contains(source, 'flood') AS has_flood, contains(source, 'dime') AS has_dime, contains(source, 'philgeps') AS has_philgeps FROM {contractor_name}")(lambda t: E.source_flags(t("contractor_name")))
query("e17_split_and_replace", "contractor_name s, former_id i", f"WITH p AS (SELECT s.id, s.name FROM ({SPLIT}) s JOIN {{contractor_name}} c ON c.id = s.id WHERE s.name <> c.contractor_name), f AS (SELECT name, min(id) AS former_id FROM p WHERE name NOT IN (SELECT contractor_name FROM {{contractor_name}}) GROUP BY name) SELECT contractor_name, CAST(NULL AS BIGINT) AS former_id FROM {{contractor_name}} WHERE sec_number IS NOT NULL OR id NOT IN (SELECT p.id FROM p JOIN f USING (name)) UNION ALL SELECT name, former_id FROM f")(lambda t: E.split_and_replace(t("contractor_name")))
query("e18_drop_unsplit", "id i", "SELECT id FROM {contractor_name} WHERE NOT ((contains(contractor_name, ' / ') OR contains(contractor_name, '(FORMERLY')) AND sec_number IS NULL)")(lambda t: E.drop_unsplit(t("contractor_name")))
JV = "SELECT id, contractor, CASE WHEN id % 4 = 0 THEN office END AS jv_partner1, CASE WHEN id % 8 = 0 THEN ' ' ELSE city END AS jv_partner2 FROM {project}"
query("e20_bridge", "project_id i, name s, role s", f"SELECT DISTINCT * FROM (SELECT id AS project_id, contractor AS name, 'main' AS role FROM ({JV}) a UNION ALL SELECT id, jv_partner1, 'jv_partner1' FROM ({JV}) b UNION ALL SELECT id, jv_partner2, 'jv_partner2' FROM ({JV}) c) x WHERE trim(name) <> ''")(
    lambda t: E.bridge(t("project").selectExpr("id", "contractor", "CASE WHEN id % 4 = 0 THEN office END AS jv_partner1", "CASE WHEN id % 8 = 0 THEN ' ' ELSE city END AS jv_partner2")))
query("e21_array_names", "name s", "SELECT DISTINCT unnest([contractor, office]) AS name FROM {project}")(lambda t: E.array_names(t("project").select(F.array(F.concat(F.lit('{"name": "'), "contractor", F.lit('"}')), "office").alias("names")), "names"))


# Pages of all kinds, written as files and read back: a third hold no record, some are empty or hold other text
PAGE = """CASE WHEN id % 3 = 1 THEN 'Search results' || chr(10) || 'No Record found for ' || contractor_name WHEN id % 11 = 0 THEN '' WHEN id % 13 = 0 THEN 'Service is not available'
ELSE 'COMPANY DETAILS' || chr(10) || chr(10) || 'Company Name' || chr(10) || contractor_name || chr(10) || chr(10) || 'SEC Number' || chr(10) || coalesce(sec_number, 'none') || chr(10) || chr(10) || 'Date Registered' || chr(10)
|| CASE WHEN id % 2 = 0 THEN 'March 3, 2011' ELSE '2009-07-21' END || chr(10) || chr(10) || 'Status' || chr(10) || status || chr(10) || chr(10) || 'Address' || chr(10) || 'Main Street ' || CAST(id AS VARCHAR(20)) || chr(10) END"""
RECORDS = "(SELECT contractor_name, coalesce(sec_number, 'none') AS sec_number, status, CASE WHEN id % 2 = 0 THEN '2011-03-03' ELSE '2009-07-21' END AS date_registered, 'Main Street ' || CAST(id AS VARCHAR) AS address FROM {contractor_name} WHERE id % 3 <> 1 AND id % 11 <> 0 AND id % 13 <> 0)"


def registry_pages(t):
    path = folder(t)
    N.write_pages(t("contractor_name").select(F.expr(PAGE).alias("value")), path, "\f")
    return N.read_pages(t.spark, path, "\f")


query("e19_registry_records", "contractor_name s, sec_number s, status s, date_registered s", f"SELECT contractor_name, sec_number, status, date_registered FROM (SELECT *, row_number() OVER (PARTITION BY sec_number ORDER BY date_registered DESC, contractor_name DESC, address DESC, status DESC) AS r FROM {RECORDS} x) y WHERE r = 1")(
    lambda t: E.registry_records(registry_pages(t).where(N.page_state(F.col("value")) == "record")))
query("e19_registry_pages", "state s, n i", "SELECT CASE WHEN id % 3 = 1 THEN 'no_record' WHEN id % 11 = 0 THEN 'empty' WHEN id % 13 = 0 THEN 'other' ELSE 'record' END AS state, count(*) AS n FROM {contractor_name} GROUP BY 1")(
    lambda t: N.page_counts(registry_pages(t)))


# Similar names and matches

FRESH, KNOWN = "(SELECT DISTINCT contractor_name AS n FROM {contractor_name} WHERE id % 6 NOT IN (0, 4))", "(SELECT DISTINCT contractor_name AS n FROM {contractor_name} WHERE id % 6 IN (0, 4))"
ratio_sql = lambda a, b: f"(1 - CAST(levenshtein({a}, {b}) AS DOUBLE) / greatest(length({a}), length({b})))"
fresh = lambda t: t("contractor_name").where("id % 6 NOT IN (0, 4)").select("contractor_name").distinct()
known = lambda t: t("contractor_name").where("id % 6 IN (0, 4)").select("contractor_name").distinct()
query("j6_similar_names", "a s, b s, ratio d", f"SELECT a.n AS a, b.n AS b, {ratio_sql('a.n', 'b.n')} AS ratio FROM {FRESH} a JOIN {KNOWN} b ON {ratio_sql('a.n', 'b.n')} >= 0.8")(lambda t: M.similar_names(fresh(t), known(t), "contractor_name", "contractor_name", 0.8))
query("j6_similar_names_gestalt", "a s, b s, ratio d")(lambda t: M.similar_names(fresh(t), known(t), "contractor_name", "contractor_name", 0.8, "gestalt"))
query("e6_membership", "contractor_name s, seen b", f"SELECT k.n AS contractor_name, EXISTS (SELECT 1 FROM {FRESH} f WHERE {ratio_sql(token_sql('f.n'), token_sql('k.n'))} >= 0.9) AS seen FROM {KNOWN} k")(lambda t: M.membership(known(t), "contractor_name", {"seen": fresh(t)}))
# the same by difflib's ratio, which SQL does not have
query("e6_membership_gestalt", "contractor_name s, seen b")(lambda t: M.membership(known(t), "contractor_name", {"seen": fresh(t)}, metric="gestalt"))
query("e7_greedy_new_names_gestalt", "name s")(lambda t: M.greedy_new_names(fresh(t), "contractor_name", known(t), "contractor_name", metric="gestalt"))
query("e8_best_registry_match_gestalt", "name s, match s, ratio d")(
    lambda t: M.best_registry_match(fresh(t), "contractor_name", known(t), "contractor_name", metric="gestalt"))
query("e9_match_by_amount_gestalt", "contract_id i, project_id i, score d")(lambda t: M.match_by_amount(t("contract"), t("project"), metric="gestalt"))
query("e10_match_by_place_gestalt", "contract_id i, project_id i, score d")(lambda t: M.match_by_place(t("contract"), t("project"), metric="gestalt"))
query("e7_greedy_new_names", "name s")(lambda t: M.greedy_new_names(fresh(t), "contractor_name", known(t), "contractor_name"))
query("e8_best_registry_match", "name s, match s, ratio d", f"""SELECT name, match, ratio FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ratio DESC, match) AS r FROM (SELECT f.n AS name, k.n AS match, {ratio_sql(suffix_sql('f.n'), suffix_sql('k.n'))} AS ratio, len(list_intersect(string_split({suffix_sql('f.n')}, ' '), string_split({suffix_sql('k.n')}, ' '))) AS common, {suffix_sql('f.n')} = {suffix_sql('k.n')} AS same
FROM {FRESH} f JOIN {KNOWN} k ON {ratio_sql(suffix_sql('f.n'), suffix_sql('k.n'))} >= 0.8) x WHERE same OR ratio > 0.9 OR (ratio > 0.8 AND common >= 2)) y WHERE r = 1""")(lambda t: M.best_registry_match(fresh(t), "contractor_name", known(t), "contractor_name"))
query("j3_exact_amount_join", "contract_id i, project_id i", "SELECT c.id AS contract_id, p.id AS project_id FROM {contract} c JOIN {project} p ON c.amount = p.cost")(lambda t: t("contract").select(F.col("id").alias("contract_id"), F.col("amount").alias("cost")).join(t("project").select(F.col("id").alias("project_id"), "cost"), "cost"))
BAND_SQL = """SELECT c.id AS contract_id, count(*) AS n FROM {contract} c JOIN {project} p ON c.amount > 0 AND p.cost > 0
AND abs(CAST(c.amount AS DOUBLE) - CAST(p.cost AS DOUBLE)) / greatest(CAST(c.amount AS DOUBLE), CAST(p.cost AS DOUBLE)) <= 0.05 GROUP BY 1"""


def band_counts(t):
    contracts = t("contract").select(F.col("id").alias("contract_id"), "amount")
    return M.band_counts(contracts, t("project").select("cost"), "contract_id", "amount", "cost", 5.0)


query("j4_band_join", "contract_id i, n i", BAND_SQL)(band_counts)
query("j4_band_join_whole", "contract_id i, n i", BAND_SQL)(band_counts)  # an earlier name of the same query
same_sql = f"CASE WHEN upper(c.awardee) = upper(p.contractor) THEN 1.0 ELSE {ratio_sql('upper(c.awardee)', 'upper(p.contractor)')} END"
norm_title = lambda c: f"array_to_string(list_filter(string_split(trim(regexp_replace(upper(coalesce({c}, '')), '\\s+', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN ({sql_list(TITLE_WORDS)})), ' ')"
alike_sql = lambda a, b: f"CASE WHEN {norm_title(a)} = '' OR {norm_title(b)} = '' THEN 0.0 ELSE {ratio_sql(norm_title(a), norm_title(b))} END"
title_sql = f"greatest({alike_sql('c.award_title', 'p.project_name')}, {alike_sql('c.notice_title', 'p.project_name')})"
query("e9_match_by_amount", "contract_id i, project_id i, score d", f"SELECT contract_id, project_id, score FROM (SELECT *, row_number() OVER (PARTITION BY contract_id ORDER BY score DESC, project_id) AS r FROM (SELECT c.id AS contract_id, p.id AS project_id, round(({title_sql} * 0.6 + {same_sql} * 0.4) * 100, 2) AS score FROM {{contract}} c JOIN {{project}} p ON c.amount = p.cost AND c.amount > 0) x WHERE score >= 60) y WHERE r = 1")(lambda t: M.match_by_amount(t("contract"), t("project")))
am = "abs(CAST(c.amount AS DOUBLE) - CAST(p.cost AS DOUBLE)) / greatest(CAST(c.amount AS DOUBLE), CAST(p.cost AS DOUBLE)) * 100"
amt_sql = f"CASE WHEN c.amount = p.cost THEN 1.0 WHEN {am} <= 5 THEN 1.0 - {am} / 5.0 ELSE 0 END"
place_sql = f"CASE WHEN (contains(c.area_of_delivery, p.province) OR contains(p.province, c.area_of_delivery)) THEN 1.0 ELSE {ratio_sql('c.area_of_delivery', 'p.province')} END"
near_sql = f"CASE WHEN upper(c.awardee) = upper(p.contractor) THEN 1.0 WHEN {ratio_sql('upper(c.awardee)', 'upper(p.contractor)')} > 0.6 THEN {ratio_sql('upper(c.awardee)', 'upper(p.contractor)')} ELSE 0 END"
query("e10_match_by_place", "contract_id i, project_id i, score d", f"SELECT contract_id, project_id, score FROM (SELECT *, row_number() OVER (PARTITION BY contract_id ORDER BY score DESC, project_id) AS r FROM (SELECT c.id AS contract_id, p.id AS project_id, round(({place_sql} * 0.5 + {amt_sql} * 0.4 + {near_sql} * 0.1) * 100, 2) AS score FROM {{contract}} c JOIN {{project}} p ON abs(CAST(c.amount AS DOUBLE) - CAST(p.cost AS DOUBLE)) <= 0.01 * greatest(CAST(c.amount AS DOUBLE), CAST(p.cost AS DOUBLE)) WHERE {place_sql} >= 0.8 AND {amt_sql} >= 0.8) x WHERE score >= 85) y WHERE r = 1")(lambda t: M.match_by_place(t("contract"), t("project")))

# Files and streams: batch files written from the events, read and ingested again


EVENT = "event_id long, user_id long, event_type string, value double"


@query("s3_json_batches", "id s, budget_type s, fiscal_year s, amount d, description s, org_uacs_code s, region_code s, funding_uacs_code s, object_uacs_code s",
       "SELECT record_id AS id, budget_type, CAST(fiscal_year AS VARCHAR) AS fiscal_year, amount, description, org_uacs_code, region_code, funding_uacs_code, object_uacs_code FROM {nep_line}")
def s3(t):
    path = folder(t)
    rows = t("nep_line").select(F.col("record_id").alias("id"), "budget_type", F.col("fiscal_year").cast("string").alias("fiscal_year"), "amount", "description",
                                "org_uacs_code", "region_code", "funding_uacs_code", "object_uacs_code")
    S.write_batches(rows, path)
    return S.read_batches(t.spark, path)


@query("s4_csv_contracts", "reference_id s, award_title s, notice_title s, awardee_name s, area_of_delivery s, contract_amount d",
       "SELECT CAST(id AS VARCHAR) AS reference_id, award_title, notice_title, awardee AS awardee_name, area_of_delivery, amount AS contract_amount FROM {contract}")
def s4(t):
    path = folder(t)
    null = lambda name, kind="string": F.lit(None).cast(kind).alias(name)
    rows = t("contract").select(F.col("id").cast("string").alias("reference_id"), null("contract_no"), "award_title", "notice_title", F.col("awardee").alias("awardee_name"), null("organization_name"),
                                "area_of_delivery", null("business_category"), F.col("amount").alias("contract_amount"), null("award_date", "date"), null("award_status"))
    S.export(rows, path, "csv")
    return S.read_contracts(t.spark, path)


@query("s5_semi_structured", "ProjectID s, cost d, lat d", "SELECT CAST(id AS VARCHAR) AS ProjectID, cost, lat FROM {project}")
def s5(t):
    path = folder(t)
    p = t("project")
    p.select(F.col("id").cast("string").alias("ProjectID"), F.col("cost").cast("string").alias("ContractCost"), F.struct("lat", "lng").alias("_geo")).write.json(path)
    return S.read_projects(t.spark, path).select("ProjectID", F.col("ContractCost").cast("decimal(20,2)").alias("cost"), F.col("_geo.lat").alias("lat"))


@query("s10_summary_sink", "fiscal_year i, n i, total d", "SELECT fiscal_year, count(*) AS n, sum(amount) AS total FROM {nep_line} GROUP BY 1")
def s10(t):
    path = folder(t)
    S.write_summary(t("nep_line").groupBy("fiscal_year").agg(*G.measures("amount")), path, "json")
    return t.spark.read.schema("fiscal_year long, n long, total decimal(30,2)").json(path)


@query("s11_search_export", "id i, project_name s", "SELECT id, project_name FROM {project} WHERE contains(lower(project_name), 'building')")
def s11(t):
    path = folder(t)
    S.export(P.search_all_words(t("project").select("id", "project_name"), ["project_name"], "building"), path, "csv")
    return t.spark.read.schema("id long, project_name string").csv(path, header=True)


def _ingested(t):
    src, base = folder(t), folder(t)
    e = t("events").select("event_id", "user_id", "event_type", "value")
    e.write.json(src)
    e.where("event_id % 3 = 0").write.mode("append").json(src)  # keys that come again
    K.ingest(t.spark, src, f"{base}/table", f"{base}/state", key="event_id", schema=EVENT, year="event_type", amount="value", summary=f"{base}/summary", multi_line=False, buckets=16).awaitTermination()
    return base


query("k1_incremental_ingest", "event_id i, user_id i, event_type s", "SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_id) AS r FROM {events}) x WHERE r = 1")(
    lambda t: t.spark.read.parquet(f"{_ingested(t)}/table"))
query("k2_refreshed_summary", "event_type s, n i", "SELECT event_type, count(*) AS n FROM (SELECT event_id, min(event_type) AS event_type FROM {events} GROUP BY 1) x GROUP BY 1")(
    lambda t: K.read_summary(t.spark, f"{_ingested(t)}/summary", "event_type").withColumnRenamed("total_records", "n"))
