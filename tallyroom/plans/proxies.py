"""Stand-ins for the public-finance tables, derived from the driver tables.

One SQL text serves Spark and DuckDB; {name} stands for a table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

SQL = {
    "budget_line": """
SELECT CAST(l.l_orderkey*10 + l.l_linenumber AS BIGINT) AS sorder,
       CASE WHEN l.l_orderkey % 101 = 0 THEN CAST(-1 AS BIGINT) ELSE CAST(s.s_nationkey AS BIGINT) END AS department,
       n.n_name AS uacs_dpt_dsc, CAST(l.l_suppkey % 10 AS BIGINT) AS agency, s.s_name AS uacs_agy_dsc,
       CASE WHEN l.l_returnflag = 'N' THEN 6 ELSE 7 END AS prexc_level,
       CASE WHEN p.p_partkey % 97 = 0 THEN 'INVALID' ELSE p.p_name END AS dsc,
       CAST(l.l_suppkey AS BIGINT) AS operunit, CAST(n.n_regionkey AS BIGINT) AS uacs_reg_id, r.r_name AS uacs_reg_dsc,
       CAST(l.l_linenumber AS BIGINT) AS fundcd, l.l_linestatus AS uacs_fundsubcat_dsc,
       CAST(p.p_size % 5 AS BIGINT) AS uacs_exp_cd, p.p_type AS uacs_exp_dsc, CAST(p.p_partkey % 7 AS BIGINT) AS uacs_sobj_cd, p.p_brand AS uacs_sobj_dsc,
       CASE WHEN l.l_orderkey % 103 = 0 THEN CAST(-0.01 AS DECIMAL(20,2)) ELSE CAST(l.l_extendedprice AS DECIMAL(20,2)) END AS amt,
       CAST(floor(l.l_extendedprice/20000)*20000 AS DECIMAL(20,2)) AS amt_coarse,
       CAST(year(l.l_shipdate) AS BIGINT) AS year, CONCAT('gaa_', CAST(year(l.l_shipdate) AS VARCHAR(4)), '_batch_', CAST(l.l_orderkey % 4 AS VARCHAR(1)), '.json') AS source_file
FROM {lineitem} l JOIN {supplier} s ON l.l_suppkey=s.s_suppkey JOIN {nation} n ON s.s_nationkey=n.n_nationkey
JOIN {region} r ON n.n_regionkey=r.r_regionkey JOIN {part} p ON l.l_partkey=p.p_partkey""",
    "nep_line": """
SELECT CONCAT('NEP-', CAST(o.o_orderkey AS VARCHAR(20))) AS record_id, CAST(year(o.o_orderdate) AS BIGINT) AS fiscal_year,
       CAST(o.o_totalprice AS DECIMAL(20,2)) AS amount, CONCAT(c.c_mktsegment, ' ', o.o_orderpriority) AS description,
       lpad(CAST(c.c_custkey AS VARCHAR(12)), 12, '0') AS org_uacs_code,
       CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE lpad(CAST(n.n_regionkey AS VARCHAR(2)), 2, '0') END AS region_code,
       lpad(CAST(o.o_orderkey % 9 AS VARCHAR(8)), 8, '1') AS funding_uacs_code, lpad(CAST(o.o_orderkey % 7 AS VARCHAR(10)), 10, '5') AS object_uacs_code,
       CASE WHEN o.o_orderkey % 2 = 0 THEN 'NEP' ELSE 'BESF' END AS budget_type, o.o_orderdate AS updated_at,
       CONCAT('nep_', CAST(year(o.o_orderdate) AS VARCHAR(4)), '_batch_', CAST(o.o_orderkey % 3 AS VARCHAR(1)), '.json') AS source_file
FROM {orders} o JOIN {customer} c ON o.o_custkey=c.c_custkey JOIN {nation} n ON c.c_nationkey=n.n_nationkey""",
    "project": """
SELECT o.o_orderkey AS id, CONCAT('Works ', c.c_mktsegment, ' ', CAST(o.o_orderkey % 50 AS VARCHAR(5))) AS project_name,
       CASE o.o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Ongoing' ELSE 'Not Yet Started' END AS status,
       CAST(o.o_totalprice AS DECIMAL(20,2)) AS cost, CAST(floor(o.o_totalprice/5000)*5000 AS DECIMAL(20,2)) AS cost_coarse,
       r.r_name AS region, n.n_name AS province, c.c_mktsegment AS city,
       CASE WHEN c.c_custkey % 40 = 0 THEN 'N/A' ELSE CONCAT('Brgy ', CAST(c.c_custkey % 40 AS VARCHAR(5))) END AS barangay,
       CAST(o.o_orderdate AS DATE) AS date_started, o.o_orderpriority AS office, c.c_name AS contractor,
       CAST(5 + (c.c_custkey*37 % 1500)/CAST(100 AS DOUBLE) AS DOUBLE) AS lat,
       CAST(117 + (o.o_orderkey*53 % 1000)/CAST(100 AS DOUBLE) AS DOUBLE) AS lng, CAST(year(o.o_orderdate) AS BIGINT) AS infra_year
FROM {orders} o JOIN {customer} c ON o.o_custkey=c.c_custkey JOIN {nation} n ON c.c_nationkey=n.n_nationkey JOIN {region} r ON n.n_regionkey=r.r_regionkey""",
    "contractor_name": """
SELECT p.p_partkey AS id,
       CASE p.p_partkey % 6 WHEN 0 THEN CONCAT(upper(p.p_name), ' CONSTRUCTION CORP.') WHEN 1 THEN CONCAT(upper(p.p_name), ' CONSTRUCTION CORPORATION')
         WHEN 2 THEN CONCAT(upper(p.p_name), ' BUILDERS / ', upper(p.p_type), ' TRADING INC.') WHEN 3 THEN CONCAT(upper(p.p_name), ' SUPPLY (FORMERLY: ', upper(p.p_type), ' TRADING)')
         WHEN 4 THEN CONCAT(upper(p.p_name), ' ENTERPRISES') ELSE 'SUPPLY' END AS contractor_name,
       CASE WHEN p.p_partkey % 4 = 0 THEN NULL ELSE CONCAT('CS', lpad(CAST(p.p_partkey AS VARCHAR(9)), 9, '0')) END AS sec_number,
       CASE p.p_partkey % 5 WHEN 0 THEN 'flood' WHEN 1 THEN 'flood,dime' WHEN 2 THEN 'philgeps' WHEN 3 THEN 'unknown' ELSE 'dime,philgeps' END AS source,
       CASE WHEN p.p_partkey % 10 = 0 THEN 'NO_SEC_RESULTS' ELSE 'Registered' END AS status
FROM {part} p""",
    "contract": """
SELECT p.id AS id, CASE WHEN p.id % 2 = 0 THEN CAST(p.cost * 1.005 AS DECIMAL(20,2)) ELSE p.cost END AS amount, p.province AS area_of_delivery, p.contractor AS awardee,
       CONCAT('Supply ', p.city) AS award_title, p.project_name AS notice_title FROM {project} p WHERE p.id % 3 = 0""",
}
_NEEDS = re.compile(r"\{(\w+)\}")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, or a stand-in."""
    if name not in SQL:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    parts = {n: read(spark, sf_dir, n) for n in _NEEDS.findall(SQL[name])}
    return spark.sql(SQL[name], **parts)


def duck(query: str) -> str:
    """A DuckDB query over {name} tables, with the stand-ins it needs in front."""
    found: dict[str, str] = {}

    def add(text: str) -> None:
        for n in _NEEDS.findall(text):
            if n in SQL and n not in found:
                add(SQL[n])
                found[n] = _NEEDS.sub(r"\1", SQL[n])

    add(query)
    body = _NEEDS.sub(r"\1", query)
    if not found:
        return body
    ctes = ", ".join(f"{n} AS ({q})" for n, q in found.items())
    head = body.lstrip()
    return f"WITH RECURSIVE {ctes}, {head[5:].lstrip()}" if head.upper().startswith("WITH ") else f"WITH {ctes} {body}"
