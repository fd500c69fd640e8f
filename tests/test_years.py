"""Year folders: what is read, and that reloads leave other years alone."""

import pytest
from pyspark.sql import functions as F

from tallyroom import plans
from tallyroom.sources.years import YearTable, write_years

SF = "/root/testdata/sf0.001"


def files_read(df):
    """Files of the table that the scans of a finished plan have read."""
    df.collect()
    out, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(p.plan())
        elif name == "FileSourceScanExec" and p.relation().location().rootPaths().head().toString().endswith("/lines"):
            out += p.metrics().apply("numFiles").value()
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


@pytest.fixture
def table(spark, tmp_path):
    rows = spark.range(700).select((F.col("id") % 7 + 1995).alias("year"), F.col("id"), (F.col("id") * 2).alias("amt"))
    write_years(rows.where("year <> 1998"), f"{tmp_path}/lines", rows_a_file=60)
    return YearTable(spark, f"{tmp_path}/lines", "id long, amt long")


def files_of(tmp_path, *years):
    return sum(len(list((tmp_path / "lines" / f"year={y}").glob("*.parquet"))) for y in years)


def test_a_named_year_reads_its_files_alone(table, tmp_path):
    got = table.of(1999)
    assert got.count() == 100 and "PartitionFilters: [isnotnull(year" in got._jdf.queryExecution().executedPlan().toString()
    whole = files_read(table.lines.where("id >= 0"))
    assert whole == files_of(tmp_path, *range(1995, 2002)) >= 6
    assert files_read(got) == files_of(tmp_path, 1999) < whole and files_read(table.between(1995, 1996)) == files_of(tmp_path, 1995, 1996)
    assert table.of(1990).count() == 0
    with pytest.raises(ValueError):
        table.of("199x")


def test_years_that_follow_from_data_are_pruned(table, tmp_path):
    got = table.before(2000)
    assert {r["year"] for r in got.collect()} == {1999}
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString()
    assert files_read(table.before(2000)) == files_of(tmp_path, 1999)
    assert {r["year"] for r in table.before(1999).collect()} == {1997}  # 1998 has no rows


def test_reload_of_one_year(spark, table, tmp_path):
    write_years(spark.createDataFrame([(1999, 1, 1), (2010, 2, 2)], "year long, id long, amt long"), f"{tmp_path}/lines")
    again = YearTable(spark, f"{tmp_path}/lines", "id long, amt long")
    assert {r["year"]: r["count"] for r in again.lines.groupBy("year").count().collect()} == {1995: 100, 1996: 100, 1997: 100, 1999: 1, 2000: 100, 2001: 100, 2010: 1}
    assert {r["year"]: r["rows"] for r in again.catalog.collect()} == {1995: 100, 1996: 100, 1997: 100, 1999: 1, 2000: 100, 2001: 100, 2010: 1}


@pytest.mark.parametrize("name", ["t4_sudden_rise", "t6_new_large_items", "j8_absent_descriptions"])
def test_queries_prune_years(spark, name):
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "dynamicpruning" in plan
