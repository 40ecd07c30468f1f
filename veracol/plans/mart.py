"""Governance star schema: five dimensions, three facts and a flat table over the catalogue."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from ..functions.frames import small_table

from .catalog import latest_versions

# The literal dimensions.
SEVERITIES = [("CRITICAL", "Critical", 3, "#EF4444"), ("WARNING", "Warning", 2, "#F59E0B"), ("INFO", "Informational", 1, "#38BDF8")]
GRADES = [
    ("A", "Grade A (Excellent)", 90.0, 100.0, 1, "#10B981"),
    ("B", "Grade B (Good)", 80.0, 89.9, 1, "#38BDF8"),
    ("C", "Grade C (Caution)", 70.0, 79.9, 0, "#F59E0B"),
    ("D", "Grade D (Poor)", 60.0, 69.9, 0, "#F97316"),
    ("F", "Grade F (Untrusted)", 0.0, 59.9, 0, "#EF4444"),
]
CALENDAR_PADDING_DAYS = 14
BYTES_PER_MB = 1024.0 * 1024.0


def date_key(column: Column) -> Column:
    return F.date_format(column, "yyyyMMdd")


def dim_dataset(datasets: DataFrame) -> DataFrame:
    name = F.lower("original_filename")
    file_format = F.when(name.endswith(".csv"), "CSV").when(name.endswith(".xlsx") | name.endswith(".xls"), "Excel").otherwise("Other")
    return datasets.select(
        F.col("id").alias("dataset_id"), F.col("name").alias("dataset_name"), "original_filename", file_format.alias("file_format_type"), "user_id", "created_at", "updated_at"
    )


def dim_version(versions: DataFrame) -> DataFrame:
    """Versions with label, size and latest flag.

    The flag joins the latest version ids back on the version id, which is unique on both sides,
    so a dataset with very many versions does not pile up in one task.
    """
    newest = latest_versions(versions).select(F.col("version_id").alias("__newest"))
    number = F.col("version_number").cast("string")
    label = F.concat(F.lit("v"), number, F.when(F.col("version_number") == 1, " (Raw)").otherwise(" (Cleaned)"))
    return versions.join(newest, versions["id"] == F.col("__newest"), "left").select(
        F.col("id").alias("version_id"),
        "dataset_id",
        "version_number",
        label.alias("version_label"),
        "parent_version_id",
        "file_format",
        "row_count",
        "column_count",
        "file_size_bytes",
        F.round(F.col("file_size_bytes") / F.lit(BYTES_PER_MB), 3).alias("file_size_mb"),
        F.when(F.col("__newest").isNotNull(), 1).otherwise(0).alias("is_latest_version"),
        "created_at",
    )


def dim_severity(spark: SparkSession) -> DataFrame:
    return small_table(spark, SEVERITIES, "severity_code string, severity_name string, severity_weight int, color_hex string")


def dim_grade(spark: SparkSession) -> DataFrame:
    return small_table(spark, GRADES, "grade string, grade_name string, min_score double, max_score double, is_trustworthy int, color_hex string")


def event_timestamps(datasets: DataFrame, versions: DataFrame, reports: DataFrame) -> DataFrame:
    """Distinct creation times over datasets, versions and reports."""
    parts = [table.select("created_at") for table in (datasets, versions, reports)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


def dim_date(events: DataFrame) -> DataFrame:
    """Daily calendar around the events (column ``created_at``), padded by two weeks; empty for no events."""
    first = F.to_date(F.min("created_at"))
    newest = F.max("created_at")
    last = F.when(newest > F.to_date(newest).cast("timestamp"), F.date_add(F.to_date(newest), 1)).otherwise(F.to_date(newest))
    span = events.agg(F.date_sub(first, CALENDAR_PADDING_DAYS).alias("low"), F.date_add(last, CALENDAR_PADDING_DAYS).alias("high"))
    day = F.col("FullDate")
    quarter = F.concat(F.lit("Q"), F.quarter(day).cast("string"))
    return span.select(F.explode(F.sequence("low", "high")).alias("FullDate")).select(
        day,
        F.date_format(day, "yyyyMMdd").cast("int").alias("DateKey"),
        F.year(day).alias("Year"),
        quarter.alias("Quarter"),
        F.concat(F.year(day).cast("string"), F.lit("-"), quarter).alias("YearQuarter"),
        F.month(day).alias("MonthNumber"),
        F.date_format(day, "MMMM").alias("MonthName"),
        F.date_format(day, "MMM").alias("MonthShort"),
        F.date_format(day, "yyyy-MM").alias("YearMonth"),
        F.dayofmonth(day).alias("DayOfMonth"),
        F.date_format(day, "EEEE").alias("DayOfWeek"),
        F.when(F.weekday(day) >= 5, 1).otherwise(0).alias("IsWeekend"),
    )


def fact_evaluations(reports: DataFrame, versions: DataFrame) -> DataFrame:
    """One row per report; trusted by flag or by a score of 80."""
    size = versions.select(F.col("id").alias("version_id"), "dataset_id", "row_count", "column_count", "file_size_bytes")
    trusted = F.when(F.col("is_trustworthy") | (F.col("overall_score") >= 80.0), 1).otherwise(0)
    return reports.join(size, "version_id").select(
        F.col("id").alias("report_id"),
        "version_id",
        "dataset_id",
        date_key(F.col("created_at")).alias("date_key"),
        "created_at",
        "overall_score",
        "grade",
        "completeness_score",
        "validity_score",
        "uniqueness_score",
        "consistency_score",
        trusted.alias("is_trustworthy"),
        "row_count",
        "column_count",
        "file_size_bytes",
    )


def fact_issues(issues: DataFrame, reports: DataFrame, versions: DataFrame) -> DataFrame:
    """One row per issue with its version and dataset; report and version ids are joined first."""
    owners = reports.select(F.col("id").alias("report_id"), "version_id").join(versions.select(F.col("id").alias("version_id"), "dataset_id"), "version_id")
    severity = F.upper("severity")
    return issues.join(owners.hint("shuffle_hash"), "report_id").select(
        F.col("id").alias("issue_id"),
        "report_id",
        "version_id",
        "dataset_id",
        date_key(F.col("created_at")).alias("date_key"),
        "created_at",
        F.upper("category").alias("issue_category"),
        severity.alias("severity_code"),
        F.coalesce("column_name", F.lit("(Dataset Level)")).alias("column_name"),
        "description",
        "affected_count",
        "affected_percentage",
        F.when(severity == "CRITICAL", 3).when(severity == "WARNING", 2).otherwise(1).alias("severity_weight"),
    )


def fact_jobs(jobs: DataFrame, versions: DataFrame, reports: DataFrame) -> DataFrame:
    """One row per cleaning job with both of its versions and, where scored, their scores."""
    source = versions.select(F.col("id").alias("source_version_id"), F.col("row_count").alias("source_row_count"))
    target = versions.select(F.col("id").alias("target_version_id"), "dataset_id", F.col("row_count").alias("target_row_count"))
    before = reports.select(F.col("version_id").alias("source_version_id"), F.col("overall_score").alias("source_score"))
    after = reports.select(F.col("version_id").alias("target_version_id"), F.col("overall_score").alias("target_score"))
    joined = jobs.join(source, "source_version_id").join(before, "source_version_id", "left").join(target, "target_version_id").join(after, "target_version_id", "left")
    return joined.select(
        F.col("id").alias("cleaning_job_id"),
        "source_version_id",
        "target_version_id",
        "dataset_id",
        date_key(F.col("created_at")).alias("date_key"),
        "created_at",
        "total_operations",
        "rows_modified",
        "quality_score_delta",
        "source_row_count",
        "target_row_count",
        (F.col("source_row_count") - F.col("target_row_count")).alias("rows_removed"),
        "source_score",
        "target_score",
    )


def flat_table(datasets: DataFrame, versions: DataFrame, reports: DataFrame) -> DataFrame:
    """Datasets, versions and reports in one table; newest dataset first, versions in order.

    Reports and versions meet on unique ids before the join on the dataset.
    """
    scored = versions.select(
        F.col("id").alias("version_id"), "dataset_id", "version_number", "row_count", "column_count", "file_size_bytes"
    ).join(reports.withColumnRenamed("id", "report_id").withColumnRenamed("created_at", "evaluated_at"), "version_id")
    owner = datasets.select(F.col("id").alias("dataset_id"), F.col("name").alias("dataset_name"), "original_filename", F.col("created_at").alias("__created"))
    return (
        scored.join(owner, "dataset_id")
        .orderBy(F.desc("__created"), "dataset_id", "version_number")
        .select(
            "dataset_id",
            "dataset_name",
            "original_filename",
            "version_id",
            "version_number",
            F.concat(F.lit("v"), F.col("version_number").cast("string")).alias("version_label"),
            "report_id",
            "evaluated_at",
            "overall_score",
            "grade",
            "completeness_score",
            "validity_score",
            "uniqueness_score",
            "consistency_score",
            "is_trustworthy",
            "row_count",
            "column_count",
            F.round(F.col("file_size_bytes") / F.lit(BYTES_PER_MB), 2).alias("file_size_mb"),
        )
    )


class StarSchema(Mapping):
    """The nine tables of the mart by name; a table is planned when it is first asked for."""

    def __init__(self, tables: Mapping[str, DataFrame]):
        self._tables = tables
        self._planned: dict[str, DataFrame] = {}
        t = tables
        self._plans = {
            "Dim_Dataset": lambda: dim_dataset(t["datasets"]),
            "Dim_Version": lambda: dim_version(t["versions"]),
            "Dim_Severity": lambda: dim_severity(t["datasets"].sparkSession),
            "Dim_Grade": lambda: dim_grade(t["datasets"].sparkSession),
            "Dim_Date": lambda: dim_date(event_timestamps(t["datasets"], t["versions"], t["reports"])),
            "Fact_QualityEvaluation": lambda: fact_evaluations(t["reports"], t["versions"]),
            "Fact_QualityIssues": lambda: fact_issues(t["issues"], t["reports"], t["versions"]),
            "Fact_CleaningJobs": lambda: fact_jobs(t["jobs"], t["versions"], t["reports"]),
            "Platform_Quality_Analytics_Flat": lambda: flat_table(t["datasets"], t["versions"], t["reports"]),
        }

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._planned:
            self._planned[name] = self._plans[name]()
        return self._planned[name]

    def __iter__(self):
        return iter(self._plans)

    def __len__(self) -> int:
        return len(self._plans)


def star_schema(tables: Mapping[str, DataFrame]) -> StarSchema:
    """The mart over the catalogue tables."""
    return StarSchema(tables)


# Fact column -> dimension column; the last edge is the inactive (source version) one.
RELATIONSHIPS = [
    ("Fact_QualityEvaluation", "dataset_id", "Dim_Dataset", "dataset_id", True),
    ("Fact_QualityEvaluation", "version_id", "Dim_Version", "version_id", True),
    ("Fact_QualityEvaluation", "grade", "Dim_Grade", "grade", True),
    ("Fact_QualityEvaluation", "date_key", "Dim_Date", "DateKey", True),
    ("Fact_QualityIssues", "dataset_id", "Dim_Dataset", "dataset_id", True),
    ("Fact_QualityIssues", "version_id", "Dim_Version", "version_id", True),
    ("Fact_QualityIssues", "severity_code", "Dim_Severity", "severity_code", True),
    ("Fact_QualityIssues", "date_key", "Dim_Date", "DateKey", True),
    ("Fact_CleaningJobs", "dataset_id", "Dim_Dataset", "dataset_id", True),
    ("Fact_CleaningJobs", "target_version_id", "Dim_Version", "version_id", True),
    ("Fact_CleaningJobs", "date_key", "Dim_Date", "DateKey", True),
    ("Fact_CleaningJobs", "source_version_id", "Dim_Version", "version_id", False),
]


def check_relationships(star: Mapping[str, DataFrame]) -> DataFrame:
    """Rows without a partner per relationship: (from_table, from_column, to_table, to_column, active, orphans).

    Keys are counted per distinct value before they are joined.
    """
    checked = None
    for child, child_key, parent, parent_key, active in RELATIONSHIPS:
        keys = star[child].groupBy(F.col(child_key).cast("string").alias("key")).count()
        known = star[parent].select(F.col(parent_key).cast("string").alias("key")).distinct()
        orphans = keys.join(known, "key", "left_anti").agg(F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("orphans"))
        labels = [F.lit(v).alias(n) for n, v in (("from_table", child), ("from_column", child_key), ("to_table", parent), ("to_column", parent_key), ("active", active))]
        row = orphans.select(*labels, "orphans")
        checked = row if checked is None else checked.unionByName(row)
    return checked
