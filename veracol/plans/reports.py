"""Governance report queries over the star schema."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import count_where, row_count
from .measures import DIMENSION_MEASURES, evaluations, measures

BENCHMARK = 80.0
# Target per dimension.
DIMENSION_BENCHMARKS = {"Completeness": 95.0, "Validity": 90.0, "Uniqueness": 98.0, "Consistency": 90.0}
GOVERNANCE_FLOOR = 70.0
SCORES = ("completeness_score", "validity_score", "uniqueness_score", "consistency_score")

Star = Mapping[str, DataFrame]


def _latest_evaluations(star: Star) -> DataFrame:
    return evaluations(star).where("latest = 1")


def _average_scores(condition: Column | None = None) -> list[Column]:
    return [F.avg(F.col(s) if condition is None else F.when(condition, F.col(s))).alias(f"avg_{s}") for s in SCORES]


def datasets_per_grade(star: Star) -> DataFrame:
    return _latest_evaluations(star).groupBy("grade").agg(F.count_distinct("dataset_id").alias("datasets"))


def dimension_scorecard(star: Star, benchmarks: Mapping[str, float] | None = None) -> DataFrame:
    """Average of each dimension over the latest versions, against a benchmark (80 unless given)."""
    scores = measures(star, list(DIMENSION_MEASURES.values()))
    target = None
    for name, measure in DIMENSION_MEASURES.items():
        level = (benchmarks or {}).get(name, BENCHMARK)
        hit = F.col("measure") == measure
        target = F.when(hit, F.lit(level)) if target is None else target.when(hit, F.lit(level))
    name = F.regexp_extract("measure", "^Avg (.*) Score$", 1)
    return scores.select(name.alias("dimension"), F.col("value").alias("score"), target.alias("benchmark")).withColumn("gap", F.col("score") - F.col("benchmark"))


def benchmark_gaps(star: Star) -> DataFrame:
    return dimension_scorecard(star, DIMENSION_BENCHMARKS)


def remediation_list(star: Star, limit: int | None = None) -> DataFrame:
    """Datasets with grade, latest score and critical issues over all versions, worst first."""
    # Issues are counted per report before they meet reports and datasets.
    per_report = star["Fact_QualityIssues"].where("severity_code = 'CRITICAL'").groupBy("report_id").agg(row_count().alias("n"))
    evaluated = evaluations(star).select("report_id", "dataset_id", "grade", "overall_score", "latest")
    per_dataset = (
        evaluated.join(per_report, "report_id", "left")
        .groupBy("dataset_id")
        .agg(
            F.max(F.when(F.col("latest") == 1, F.col("grade"))).alias("grade"),
            F.avg(F.when(F.col("latest") == 1, F.col("overall_score"))).alias("score"),
            F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("critical_issues"),
        )
        .where("score is not null")
    )
    named = per_dataset.join(star["Dim_Dataset"].select("dataset_id", "dataset_name"), "dataset_id")
    ordered = named.orderBy("score", F.desc("critical_issues"), "dataset_id").select("dataset_id", "dataset_name", "grade", "score", "critical_issues")
    return ordered if limit is None else ordered.limit(limit)


def scores_over_time(star: Star) -> DataFrame:
    """Average dimension scores per day, of the versions that are latest now."""
    daily = _latest_evaluations(star).groupBy(F.col("date_key").cast("int").alias("DateKey")).agg(*_average_scores())
    return daily.join(star["Dim_Date"].select("DateKey", "FullDate"), "DateKey").orderBy("FullDate")


def scores_by_dataset(star: Star) -> DataFrame:
    scored = _latest_evaluations(star).groupBy("dataset_id").agg(*_average_scores())
    return scored.join(star["Dim_Dataset"].select("dataset_id", "dataset_name"), "dataset_id").select("dataset_id", "dataset_name", *[f"avg_{s}" for s in SCORES])


def version_matrix(star: Star) -> DataFrame:
    """Scores by dataset and version with subtotals per dataset and overall (null labels)."""
    labels = star["Dim_Version"].select("version_id", "version_label")
    rows = evaluations(star).join(labels, "version_id")
    latest = F.col("latest") == 1
    matrix = rows.rollup("dataset_id", "version_label").agg(F.grouping_id().cast("int").alias("level"), F.avg("overall_score").alias("avg_overall_score"), *_average_scores(latest))
    return matrix


def issue_pareto(star: Star) -> DataFrame:
    """Issues per category with the running share, most frequent first. The window sees one row per category."""
    counts = star["Fact_QualityIssues"].groupBy("issue_category").agg(row_count().alias("issues"))
    running = Window.orderBy(F.desc("issues"), "issue_category").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(F.lit(1))
    return counts.withColumn("cumulative_percent", F.sum("issues").over(running) * F.lit(100.0) / F.sum("issues").over(whole))


def affected_columns(star: Star, limit: int | None = 10) -> DataFrame:
    """Columns by affected rows."""
    totals = star["Fact_QualityIssues"].groupBy("column_name").agg(F.sum("affected_count").cast("bigint").alias("affected_rows"))
    ordered = totals.orderBy(F.desc("affected_rows"), "column_name")
    return ordered if limit is None else ordered.limit(limit)


def defect_log(star: Star, category: str | None = None, column: str | None = None, severity: str | None = None) -> DataFrame:
    """Issue rows, cross-filtered by category, column and severity."""
    rows = star["Fact_QualityIssues"]
    for name, wanted in (("issue_category", category), ("column_name", column), ("severity_code", severity)):
        if wanted is not None:
            rows = rows.where(F.col(name) == wanted)
    return rows.select("severity_code", "issue_category", "column_name", "description", "affected_count")


def raw_versus_cleaned(star: Star) -> DataFrame:
    """Average score of the first and of the latest cleaned version per dataset."""
    first = F.avg(F.when(F.col("version_number") == 1, F.col("overall_score")))
    cleaned = F.avg(F.when((F.col("version_number") > 1) & (F.col("latest") == 1), F.col("overall_score")))
    scores = evaluations(star).groupBy("dataset_id").agg(first.alias("raw_score"), cleaned.alias("cleaned_score"))
    named = scores.join(star["Dim_Dataset"].select("dataset_id", "dataset_name"), "dataset_id")
    return named.select("dataset_id", "dataset_name", "raw_score", "cleaned_score", (F.col("cleaned_score") - F.col("raw_score")).alias("lift"))


def audit_trail(star: Star) -> DataFrame:
    """Cleaning jobs with dataset name and the labels of both versions."""
    labels = star["Dim_Version"].select("version_id", "version_label")
    source = labels.select(F.col("version_id").alias("source_version_id"), F.col("version_label").alias("source_version"))
    target = labels.select(F.col("version_id").alias("target_version_id"), F.col("version_label").alias("target_version"))
    jobs = star["Fact_CleaningJobs"].join(source, "source_version_id").join(target, "target_version_id")
    named = jobs.join(star["Dim_Dataset"].select("dataset_id", "dataset_name"), "dataset_id")
    return named.select("cleaning_job_id", "dataset_name", "created_at", "source_version", "target_version", "total_operations", "rows_modified", "quality_score_delta")


def sliced_evaluations(star: Star, start: str | None = None, end: str | None = None, file_format: str | None = None, grades: Sequence[str] | None = None) -> DataFrame:
    """Evaluations within a date range (inclusive days), of one file format and of some grades.

    Filters sit on the scans of the tables that own the column, before the join.
    """
    rows, owners = star["Fact_QualityEvaluation"], star["Dim_Dataset"]
    if start is not None:
        rows = rows.where(F.col("created_at") >= F.lit(start).cast("timestamp"))
    if end is not None:
        rows = rows.where(F.col("created_at") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp"))
    if grades:
        rows = rows.where(F.col("grade").isin(*grades))
    if file_format is not None:
        owners = owners.where(F.col("file_format_type") == file_format)
    return rows.join(owners.select("dataset_id", "file_format_type"), "dataset_id")


def new_datasets_since(star: Star, now: datetime, days: int = 7) -> DataFrame:
    """Datasets created within the days before a reference time, and all datasets."""
    moment = F.lit(now)
    recent = (F.col("created_at") >= moment - F.make_dt_interval(F.lit(days))) & (F.col("created_at") <= moment)
    return star["Dim_Dataset"].agg(count_where(recent).alias("new_datasets"), row_count().alias("total_datasets"))


def issue_resolution(star: Star) -> DataFrame:
    """Issues of a version that its cleaned successor no longer has, by category and column.

    Issues are reduced to distinct keys per version before the joins.
    """
    keys = star["Fact_QualityIssues"].groupBy("version_id", "issue_category", "column_name").agg(row_count().alias("n")).drop("n")
    follow = star["Dim_Version"].where("parent_version_id is not null").select(F.col("version_id").alias("next_version"), F.col("parent_version_id").alias("version_id"))
    # Only successors that were evaluated can show that an issue is gone.
    judged = star["Fact_QualityEvaluation"].select(F.col("version_id").alias("next_version"))
    before = keys.join(follow.join(judged, "next_version"), "version_id")
    after = keys.select(F.col("version_id").alias("next_version"), "issue_category", "column_name", F.lit(1).alias("still"))
    marked = before.join(after, ["next_version", "issue_category", "column_name"], "left")
    totals = marked.agg(row_count().alias("issues_before"), count_where(F.col("still").isNull()).alias("issues_resolved"))
    return totals.withColumn("resolution_rate", F.coalesce(F.try_divide("issues_resolved", "issues_before"), F.lit(0.0)))


def average_missing_rate(star: Star) -> DataFrame:
    """Mean share of missing cells over the latest versions, in percent."""
    return _latest_evaluations(star).agg(F.avg(F.lit(100.0) - F.col("completeness_score")).alias("average_missing_rate"))


def unclean_datasets(star: Star, floor: float = GOVERNANCE_FLOOR) -> DataFrame:
    """Datasets whose latest score is below the governance floor."""
    return _latest_evaluations(star).agg(F.count_distinct(F.when(F.col("overall_score") < floor, F.col("dataset_id"))).alias("unclean_datasets"))


STEP_LOG = "array<struct<step_number:int,operation:string,target_column:string,rows_affected:bigint>>"


def remediated_volume(jobs: DataFrame) -> DataFrame:
    """Affected rows per operation over the step logs of all jobs (column ``execution_log_json``)."""
    steps = jobs.select(F.explode(F.from_json("execution_log_json", STEP_LOG)).alias("step"))
    return steps.groupBy(F.col("step.operation").alias("operation")).agg(F.sum("step.rows_affected").cast("bigint").alias("rows_affected"), row_count().alias("steps"))
