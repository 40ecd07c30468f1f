"""Plans keep their promises: one scan, early combining, pruned columns, no pairwise joins."""

import pytest
from pyspark.sql import functions as F

from veracol.operators import checks as Q, clean as C, profile as P
from veracol.plans import catalog as L, mart, measures as M, reports as R
from workload import ORACLES, QUERIES, inputs

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def lines(spark):
    return spark.read.parquet(f"{SF}/lineitem.parquet")


def test_row_local_checks_share_one_pruned_scan(lines):
    rules = {"l_quantity": {"min": 1, "max": 40}, "l_tax": {"max": 0.05}}
    plan = plan_of(Q.count_probes(lines, Q.range_probes(lines, rules)))
    assert plan.count("FileScan") == 1
    assert "ReadSchema: struct<l_quantity:double,l_tax:double>" in plan


def test_filters_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    star = mart.star_schema(inputs.gov(spark, SF))
    plan = plan_of(R.sliced_evaluations(star, "1996-01-01", "1996-12-31"))
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan


def test_top_values_are_cut_before_the_shuffle(lines):
    plan = plan_of(P.top_values(lines, ["l_returnflag", "l_linestatus"]))
    assert plan.count("WindowGroupLimit") == 2


def test_keep_first_combines_before_the_shuffle(lines):
    plan = plan_of(C.duplicates.drop_duplicate_rows(lines, ["l_suppkey"], order_by="l_orderkey"))
    assert "partial_min_by" in plan and plan.count("Exchange") == 1


@pytest.mark.parametrize("name", ["m28_all_measures", "r03_remediation_list", "r15_issue_resolution", "l11_report_with_issues", "l16_cascade_delete", "g11_relationships"])
def test_no_pairwise_joins(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_each_measure_base_is_scanned_for_needed_columns_only(spark):
    star = mart.star_schema(inputs.gov(spark, SF))
    plan = plan_of(M.measures(star, ["Total Datasets"]))
    assert "FileScan" in plan and plan.count("FileScan") == 1
    assert "customer.parquet" in plan and "orders.parquet" not in plan


def test_queries_have_comparison_sql():
    assert set(ORACLES) == set(QUERIES)
    assert len(QUERIES) > 140


def test_hot_key(spark):
    """A third of the rows share one key."""
    rows = 30_000
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 7000).cast("string")))
    df = spark.range(rows).select("id", key.alias("key"), (F.col("id") % 11).alias("v"))
    distinct = df.select("key").distinct().count()
    kept = C.duplicates.drop_duplicate_rows(df, ["key"], order_by="id")
    assert kept.count() == distinct and kept.where("key = 'hot'").first()["id"] == 0
    assert Q.key_duplicate_counts(df, ["key"]).first()["affected_count"] == df.groupBy("key").count().where("count > 1").agg(F.sum("count")).first()[0]
    top = P.top_values(df, ["key"], 1).first()
    assert (top["value"], top["n"]) == ("hot", rows // 3)


def test_report_that_owns_most_issues(spark):
    reports = spark.createDataFrame([(1, 10, 90.0), (2, 20, 80.0), (3, 30, 70.0)], "id bigint, version_id bigint, overall_score double")
    issues = spark.range(3000).select(F.when(F.col("id") < 2900, 1).otherwise(3).cast("bigint").alias("report_id"), F.lit("MISSING").alias("category"), F.lit("INFO").alias("severity"), F.lit("c").alias("column_name"), F.lit(1).cast("bigint").alias("affected_count"))
    found = L.report_with_issues(reports, issues, reports.where("id < 3")).groupBy("report_id").agg(F.count("category").alias("n")).collect()
    assert {r["report_id"]: r["n"] for r in found} == {1: 2900, 2: 0}


def test_large_customers_are_numbered_alike(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    plain, split = inputs._versions(orders), inputs._versions(orders, large=12)
    assert plain.count() == split.count() == orders.count()
    assert plain.exceptAll(split).count() == 0
