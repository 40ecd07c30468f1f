"""Governance mart (G), measure (M) and report (R) queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from veracol.plans import mart, measures as M, reports as R

from .inputs import GOV, gov
from .registry import query, union_all

MART = (
    f"{GOV}, newest AS (SELECT dataset_id, max(version_number) AS top FROM gov_versions GROUP BY dataset_id), "
    "dim_dataset AS (SELECT id AS dataset_id, name AS dataset_name, original_filename, CASE WHEN lower(original_filename) LIKE '%.csv' THEN 'CSV' WHEN lower(original_filename) LIKE '%.xlsx' OR lower(original_filename) LIKE '%.xls' THEN 'Excel' ELSE 'Other' END AS file_format_type, user_id, created_at, updated_at FROM gov_datasets), "
    "dim_version AS (SELECT v.id AS version_id, v.dataset_id, v.version_number, 'v' || v.version_number || CASE WHEN v.version_number = 1 THEN ' (Raw)' ELSE ' (Cleaned)' END AS version_label, v.parent_version_id, v.file_format, v.row_count, v.column_count, v.file_size_bytes, "
    "round(v.file_size_bytes / 1048576.0::DOUBLE, 3) AS file_size_mb, CASE WHEN v.version_number = n.top THEN 1 ELSE 0 END AS is_latest_version, v.created_at FROM gov_versions v LEFT JOIN newest n ON n.dataset_id = v.dataset_id), "
    "fact_eval AS (SELECT r.id AS report_id, r.version_id, v.dataset_id, strftime(r.created_at, '%Y%m%d') AS date_key, r.created_at, r.overall_score, r.grade, r.completeness_score, r.validity_score, r.uniqueness_score, r.consistency_score, "
    "CASE WHEN r.is_trustworthy OR r.overall_score >= 80.0 THEN 1 ELSE 0 END AS is_trustworthy, v.row_count, v.column_count, v.file_size_bytes FROM gov_reports r JOIN gov_versions v ON v.id = r.version_id), "
    "fact_issues AS (SELECT i.id AS issue_id, i.report_id, r.version_id, v.dataset_id, strftime(i.created_at, '%Y%m%d') AS date_key, upper(i.category) AS issue_category, upper(i.severity) AS severity_code, coalesce(i.column_name, '(Dataset Level)') AS column_name, i.description, i.affected_count, i.affected_percentage, "
    "CASE upper(i.severity) WHEN 'CRITICAL' THEN 3 WHEN 'WARNING' THEN 2 ELSE 1 END AS severity_weight FROM gov_issues i JOIN gov_reports r ON r.id = i.report_id JOIN gov_versions v ON v.id = r.version_id), "
    "fact_jobs AS (SELECT j.id AS cleaning_job_id, j.source_version_id, j.target_version_id, t.dataset_id, strftime(j.created_at, '%Y%m%d') AS date_key, j.created_at, j.total_operations, j.rows_modified, j.quality_score_delta, s.row_count AS source_row_count, t.row_count AS target_row_count, "
    "s.row_count - t.row_count AS rows_removed, rs.overall_score AS source_score, rt.overall_score AS target_score FROM gov_jobs j JOIN gov_versions s ON s.id = j.source_version_id JOIN gov_versions t ON t.id = j.target_version_id LEFT JOIN gov_reports rs ON rs.version_id = s.id LEFT JOIN gov_reports rt ON rt.version_id = t.id), "
    "ev AS (SELECT f.*, d.version_number, d.is_latest_version AS latest FROM fact_eval f JOIN dim_version d USING (version_id))"
)


def star(spark, sf_dir):
    return mart.star_schema(gov(spark, sf_dir))


# -- mart ----------------------------------------------------------------------------------


@query("g01_dim_dataset", f"{MART} SELECT dataset_id, dataset_name, original_filename, file_format_type, user_id FROM dim_dataset")
def dim_dataset(spark, sf_dir):
    return star(spark, sf_dir)["Dim_Dataset"].drop("created_at", "updated_at")


@query("g02_dim_version", f"{MART} SELECT * EXCLUDE (created_at) FROM dim_version")
def dim_version(spark, sf_dir):
    return star(spark, sf_dir)["Dim_Version"].drop("created_at")


_EVENTS_SQL = "SELECT created_at FROM gov_datasets UNION SELECT created_at FROM gov_versions UNION SELECT created_at FROM gov_reports"


@query("g05_event_timestamps", f"{GOV} SELECT strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM ({_EVENTS_SQL})")
def event_timestamps(spark, sf_dir):
    tables = gov(spark, sf_dir)
    events = mart.event_timestamps(tables["datasets"], tables["versions"], tables["reports"])
    return events.select(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


_CALENDAR = (
    f"SELECT CAST(day AS DATE) AS day FROM (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS day FROM (SELECT min(created_at)::DATE - INTERVAL 14 DAY AS lo, "
    f"CASE WHEN max(created_at) > max(created_at)::DATE THEN max(created_at)::DATE + INTERVAL 15 DAY ELSE max(created_at)::DATE + INTERVAL 14 DAY END AS hi FROM ({_EVENTS_SQL})))"
)


@query(
    "g06_dim_date",
    f"{GOV} SELECT strftime(day, '%Y-%m-%d') AS \"FullDate\", CAST(strftime(day, '%Y%m%d') AS INTEGER) AS \"DateKey\", CAST(year(day) AS INTEGER) AS \"Year\", 'Q' || quarter(day) AS \"Quarter\", year(day) || '-Q' || quarter(day) AS \"YearQuarter\", CAST(month(day) AS INTEGER) AS \"MonthNumber\", "
    f"monthname(day) AS \"MonthName\", strftime(day, '%b') AS \"MonthShort\", strftime(day, '%Y-%m') AS \"YearMonth\", CAST(day(day) AS INTEGER) AS \"DayOfMonth\", dayname(day) AS \"DayOfWeek\", CASE WHEN isodow(day) >= 6 THEN 1 ELSE 0 END AS \"IsWeekend\" FROM ({_CALENDAR})",
)
def dim_date(spark, sf_dir):
    return star(spark, sf_dir)["Dim_Date"].withColumn("FullDate", F.date_format("FullDate", "yyyy-MM-dd"))


@query("g07_fact_evaluations", f"{MART} SELECT * EXCLUDE (created_at) FROM fact_eval")
def fact_evaluations(spark, sf_dir):
    return star(spark, sf_dir)["Fact_QualityEvaluation"].drop("created_at")


@query("g08_fact_issues", f"{MART} SELECT * FROM fact_issues")
def fact_issues(spark, sf_dir):
    return star(spark, sf_dir)["Fact_QualityIssues"].drop("created_at")


@query("g09_fact_cleaning_jobs", f"{MART} SELECT * EXCLUDE (created_at) FROM fact_jobs")
def fact_cleaning_jobs(spark, sf_dir):
    return star(spark, sf_dir)["Fact_CleaningJobs"].drop("created_at")


@query(
    "g10_flat_table",
    f"{GOV} SELECT d.id AS dataset_id, d.name AS dataset_name, d.original_filename, v.id AS version_id, v.version_number, 'v' || v.version_number AS version_label, r.id AS report_id, r.overall_score, r.grade, r.completeness_score, r.validity_score, r.uniqueness_score, r.consistency_score, "
    "r.is_trustworthy, v.row_count, v.column_count, round(v.file_size_bytes / 1048576.0::DOUBLE, 2) AS file_size_mb FROM gov_datasets d JOIN gov_versions v ON v.dataset_id = d.id JOIN gov_reports r ON r.version_id = v.id",
)
def flat_table(spark, sf_dir):
    return star(spark, sf_dir)["Platform_Quality_Analytics_Flat"].drop("evaluated_at")


_SQL_TABLES = {"Fact_QualityEvaluation": "fact_eval", "Fact_QualityIssues": "fact_issues", "Fact_CleaningJobs": "fact_jobs", "Dim_Dataset": "dim_dataset", "Dim_Version": "dim_version"}
_KNOWN = {
    "Dim_Grade": "(VALUES ('A'), ('B'), ('C'), ('D'), ('F')) g(grade)",
    "Dim_Severity": "(VALUES ('CRITICAL'), ('WARNING'), ('INFO')) s(severity_code)",
    "Dim_Date": f"(SELECT strftime(day, '%Y%m%d') AS \"DateKey\" FROM ({_CALENDAR}))",
}


@query(
    "g11_relationships",
    f"{MART} "
    + union_all(
        [
            f"SELECT '{child}' AS from_table, '{key}' AS from_column, '{parent}' AS to_table, '{pkey}' AS to_column, {str(active).lower()} AS active, count(*) AS orphans FROM {_SQL_TABLES[child]} WHERE {key} NOT IN (SELECT {pkey if parent != 'Dim_Date' else chr(34) + pkey + chr(34)} FROM {_SQL_TABLES.get(parent) or _KNOWN[parent]})"
            for child, key, parent, pkey, active in mart.RELATIONSHIPS
        ]
    ),
)
def relationships(spark, sf_dir):
    return mart.check_relationships(star(spark, sf_dir))


# -- measures ------------------------------------------------------------------------------

_NUMBERS = {
    "Total Datasets": "SELECT count(DISTINCT dataset_id) FROM dim_dataset",
    "Total Versions Analyzed": "SELECT count(*) FROM dim_version",
    "Total Records Monitored": "SELECT sum(row_count) FROM ev WHERE latest = 1",
    "Avg Quality Score": "SELECT avg(overall_score) FROM fact_eval",
    "Latest Quality Score": "SELECT avg(overall_score) FROM ev WHERE latest = 1",
    "Trustworthy Datasets": "SELECT count(DISTINCT dataset_id) FROM ev WHERE latest = 1 AND is_trustworthy = 1",
    "Trustworthy Rate %": "SELECT (SELECT count(DISTINCT dataset_id) FROM ev WHERE latest = 1 AND is_trustworthy = 1)::DOUBLE / (SELECT count(DISTINCT dataset_id) FROM dim_dataset)",
    "Avg Completeness Score": "SELECT avg(completeness_score) FROM ev WHERE latest = 1",
    "Avg Validity Score": "SELECT avg(validity_score) FROM ev WHERE latest = 1",
    "Avg Uniqueness Score": "SELECT avg(uniqueness_score) FROM ev WHERE latest = 1",
    "Avg Consistency Score": "SELECT avg(consistency_score) FROM ev WHERE latest = 1",
    "Total Issues Detected": "SELECT count(*) FROM fact_issues",
    "Critical Issues": "SELECT count(*) FROM fact_issues WHERE severity_code = 'CRITICAL'",
    "Warning Issues": "SELECT count(*) FROM fact_issues WHERE severity_code = 'WARNING'",
    "Info Issues": "SELECT count(*) FROM fact_issues WHERE severity_code = 'INFO'",
    "Critical Issue Rate %": "SELECT count(*) FILTER (WHERE severity_code = 'CRITICAL')::DOUBLE / count(*) FROM fact_issues",
    "Total Defective Rows": "SELECT sum(affected_count) FROM fact_issues",
    "Total Cleaning Jobs": "SELECT count(*) FROM fact_jobs",
    "Total Rows Remediated": "SELECT sum(rows_modified) FROM fact_jobs",
    "Total Duplicates Removed": "SELECT sum(rows_removed) FROM fact_jobs",
    "Avg Quality Score Delta": "SELECT avg(quality_score_delta) FROM fact_jobs",
    "Raw Quality Score": "SELECT avg(overall_score) FROM ev WHERE version_number = 1",
    "Cleaned Quality Score": "SELECT avg(overall_score) FROM ev WHERE version_number > 1 AND latest = 1",
    "Cleaning Net Lift %": "SELECT avg(overall_score) FILTER (WHERE version_number > 1 AND latest = 1) - avg(overall_score) FILTER (WHERE version_number = 1) FROM ev",
}
_LOWEST = "least(c, v, u, s)"
_LABELS = {
    "Weakest Dimension": f"SELECT CASE {_LOWEST} WHEN c THEN printf('Completeness (%.1f%%)', c) WHEN v THEN printf('Validity (%.1f%%)', v) WHEN u THEN printf('Uniqueness (%.1f%%)', u) ELSE printf('Consistency (%.1f%%)', s) END "
    "FROM (SELECT avg(completeness_score) AS c, avg(validity_score) AS v, avg(uniqueness_score) AS u, avg(consistency_score) AS s FROM ev WHERE latest = 1)",
    "Grade Color Hex": "SELECT CASE WHEN s >= 90 THEN '#10B981' WHEN s >= 80 THEN '#38BDF8' WHEN s >= 70 THEN '#F59E0B' WHEN s >= 60 THEN '#F97316' ELSE '#EF4444' END FROM (SELECT avg(overall_score) AS s FROM ev WHERE latest = 1)",
    "Trust Status Badge": f"SELECT CASE WHEN avg(overall_score) >= 80 THEN '{M.TRUSTED_BADGE}' ELSE '{M.UNTRUSTED_BADGE}' END FROM ev WHERE latest = 1",
}
_ORDER = [
    "Total Datasets", "Total Versions Analyzed", "Total Records Monitored", "Avg Quality Score", "Latest Quality Score", "Trustworthy Datasets", "Trustworthy Rate %",
    "Avg Completeness Score", "Avg Validity Score", "Avg Uniqueness Score", "Avg Consistency Score", "Weakest Dimension", "Total Issues Detected", "Critical Issues",
    "Warning Issues", "Info Issues", "Critical Issue Rate %", "Total Defective Rows", "Total Cleaning Jobs", "Total Rows Remediated", "Total Duplicates Removed",
    "Avg Quality Score Delta", "Raw Quality Score", "Cleaned Quality Score", "Cleaning Net Lift %", "Grade Color Hex", "Trust Status Badge",
]


def _measure(name: str):
    column = "label" if name in _LABELS else "value"

    def run(spark, sf_dir):
        shown = F.col("label") if name in _LABELS else F.round("value", 6).alias("value")
        return M.measures(star(spark, sf_dir), [name]).select("measure", shown)

    sql = f"{MART} SELECT '{name}' AS measure, " + (f"({_LABELS[name]}) AS {column}" if name in _LABELS else f"round(CAST(({_NUMBERS[name]}) AS DOUBLE), 6) AS value")
    return run, sql


for _position, _name in enumerate(_ORDER, start=1):
    _run, _sql = _measure(_name)
    _slug = _name.lower().replace(" %", " percent").replace(" ", "_")
    query(f"m{_position:02d}_{_slug}", _sql)(_run)


@query(
    "m28_all_measures",
    f"{MART} "
    + union_all(
        [f"SELECT '{n}' AS measure, round(CAST(({sql}) AS DOUBLE), 6) AS value, CAST(NULL AS VARCHAR) AS label" for n, sql in _NUMBERS.items()]
        + [f"SELECT '{n}', NULL, ({sql})" for n, sql in _LABELS.items()]
    ),
)
def all_measures(spark, sf_dir):
    """Every measure at once: each base table is scanned once."""
    return M.measures(star(spark, sf_dir)).withColumn("value", F.round("value", 6))


# -- reports -------------------------------------------------------------------------------


@query("r01_datasets_per_grade", f"{MART} SELECT grade, count(DISTINCT dataset_id) AS datasets FROM ev WHERE latest = 1 GROUP BY grade")
def datasets_per_grade(spark, sf_dir):
    return R.datasets_per_grade(star(spark, sf_dir))


def _scorecard_sql(benchmarks: dict[str, float]) -> str:
    parts = [f"SELECT '{n}' AS dimension, round(avg({n.lower()}_score), 6) AS score, CAST({b} AS DOUBLE) AS benchmark, round(avg({n.lower()}_score) - {b}, 6) AS gap FROM ev WHERE latest = 1" for n, b in benchmarks.items()]
    return f"{MART} {union_all(parts)}"


def _rounded(df, *columns: str, digits: int = 6):
    for column in columns:
        df = df.withColumn(column, F.round(column, digits))
    return df


@query("r02_dimension_scorecard", _scorecard_sql(dict.fromkeys(R.DIMENSION_BENCHMARKS, 80.0)))
def dimension_scorecard(spark, sf_dir):
    return _rounded(R.dimension_scorecard(star(spark, sf_dir)), "score", "gap")


@query(
    "r03_remediation_list",
    f"{MART}, crit AS (SELECT dataset_id, count(*) AS n FROM fact_issues WHERE severity_code = 'CRITICAL' GROUP BY dataset_id) SELECT d.dataset_id, d.dataset_name, max(e.grade) AS grade, round(avg(e.overall_score), 6) AS score, coalesce(max(c.n), 0) AS critical_issues "
    "FROM ev e JOIN dim_dataset d USING (dataset_id) LEFT JOIN crit c ON c.dataset_id = d.dataset_id WHERE e.latest = 1 GROUP BY d.dataset_id, d.dataset_name",
)
def remediation_list(spark, sf_dir):
    return _rounded(R.remediation_list(star(spark, sf_dir)), "score")


_AVERAGES = ", ".join(f"round(avg({s}), 6) AS avg_{s}" for s in R.SCORES)
_AVERAGE_NAMES = [f"avg_{s}" for s in R.SCORES]


@query("r04_scores_over_time", f"{MART} SELECT CAST(date_key AS INTEGER) AS \"DateKey\", strftime(min(created_at), '%Y-%m-%d') AS \"FullDate\", {_AVERAGES} FROM ev WHERE latest = 1 GROUP BY date_key")
def scores_over_time(spark, sf_dir):
    return _rounded(R.scores_over_time(star(spark, sf_dir)), *_AVERAGE_NAMES).withColumn("FullDate", F.date_format("FullDate", "yyyy-MM-dd"))


@query("r05_scores_by_dataset", f"{MART} SELECT dataset_id, dataset_name, {_AVERAGES} FROM ev JOIN dim_dataset USING (dataset_id) WHERE latest = 1 GROUP BY dataset_id, dataset_name")
def scores_by_dataset(spark, sf_dir):
    return _rounded(R.scores_by_dataset(star(spark, sf_dir)), *_AVERAGE_NAMES)


@query(
    "r06_version_matrix",
    f"{MART} SELECT dataset_id, version_label, CAST(grouping_id(dataset_id, version_label) AS INTEGER) AS level, round(avg(overall_score), 6) AS avg_overall_score, "
    + ", ".join(f"round(avg({s}) FILTER (WHERE latest = 1), 6) AS avg_{s}" for s in R.SCORES)
    + " FROM (SELECT ev.*, dv.version_label FROM ev JOIN dim_version dv USING (version_id)) GROUP BY ROLLUP (dataset_id, version_label)",
)
def version_matrix(spark, sf_dir):
    return _rounded(R.version_matrix(star(spark, sf_dir)), "avg_overall_score", *_AVERAGE_NAMES)


@query(
    "r07_issue_pareto",
    f"{MART} SELECT issue_category, issues, round(sum(issues) OVER (ORDER BY issues DESC, issue_category ROWS UNBOUNDED PRECEDING)::DOUBLE * 100 / sum(issues) OVER ()::DOUBLE, 6) AS cumulative_percent FROM (SELECT issue_category, count(*) AS issues FROM fact_issues GROUP BY issue_category)",
)
def issue_pareto(spark, sf_dir):
    return _rounded(R.issue_pareto(star(spark, sf_dir)), "cumulative_percent")


@query("r08_affected_columns", f"{MART} SELECT column_name, CAST(sum(affected_count) AS BIGINT) AS affected_rows FROM fact_issues GROUP BY column_name ORDER BY affected_rows DESC, column_name LIMIT 10")
def affected_columns(spark, sf_dir):
    return R.affected_columns(star(spark, sf_dir))


@query("r09_defect_log", f"{MART} SELECT severity_code, issue_category, column_name, description, affected_count FROM fact_issues WHERE issue_category = 'OUTLIER' AND severity_code = 'WARNING'")
def defect_log(spark, sf_dir):
    return R.defect_log(star(spark, sf_dir), category="OUTLIER", severity="WARNING")


@query(
    "r10_raw_versus_cleaned",
    f"{MART}, p AS (SELECT dataset_id, avg(overall_score) FILTER (WHERE version_number = 1) AS r, avg(overall_score) FILTER (WHERE version_number > 1 AND latest = 1) AS c FROM ev GROUP BY dataset_id) "
    "SELECT dataset_id, dataset_name, round(r, 6) AS raw_score, round(c, 6) AS cleaned_score, round(c - r, 6) AS lift FROM p JOIN dim_dataset USING (dataset_id)",
)
def raw_versus_cleaned(spark, sf_dir):
    return _rounded(R.raw_versus_cleaned(star(spark, sf_dir)), "raw_score", "cleaned_score", "lift")


@query(
    "r11_audit_trail",
    f"{MART} SELECT j.cleaning_job_id, d.dataset_name, strftime(j.created_at, '%Y-%m-%d %H:%M:%S') AS created_at, s.version_label AS source_version, t.version_label AS target_version, j.total_operations, j.rows_modified, j.quality_score_delta "
    "FROM fact_jobs j JOIN dim_version s ON s.version_id = j.source_version_id JOIN dim_version t ON t.version_id = j.target_version_id JOIN dim_dataset d ON d.dataset_id = j.dataset_id",
)
def audit_trail(spark, sf_dir):
    return R.audit_trail(star(spark, sf_dir)).withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


@query(
    "r12_slicers",
    f"{MART} SELECT report_id, dataset_id, grade, overall_score, file_format_type FROM fact_eval JOIN dim_dataset USING (dataset_id) WHERE file_format_type = 'Excel' AND grade IN ('A', 'B') AND fact_eval.created_at >= DATE '1996-01-01' AND fact_eval.created_at < DATE '1998-01-01'",
)
def slicers(spark, sf_dir):
    sliced = R.sliced_evaluations(star(spark, sf_dir), "1996-01-01", "1997-12-31", "Excel", ["A", "B"])
    return sliced.select("report_id", "dataset_id", "grade", "overall_score", "file_format_type")


@query("r13_benchmark_gaps", _scorecard_sql(R.DIMENSION_BENCHMARKS))
def benchmark_gaps(spark, sf_dir):
    return _rounded(R.benchmark_gaps(star(spark, sf_dir)), "score", "gap")


@query("r14_new_datasets", f"{MART} SELECT count(*) FILTER (WHERE created_at BETWEEN TIMESTAMP '1994-12-27' AND TIMESTAMP '1995-01-03') AS new_datasets, count(*) AS total_datasets FROM dim_dataset")
def new_datasets(spark, sf_dir):
    return R.new_datasets_since(star(spark, sf_dir), datetime(1995, 1, 3))


@query(
    "r15_issue_resolution",
    f"{MART}, k AS (SELECT DISTINCT version_id, issue_category, column_name FROM fact_issues), f AS (SELECT version_id AS nxt, parent_version_id AS version_id FROM dim_version WHERE parent_version_id IS NOT NULL AND version_id IN (SELECT version_id FROM fact_eval)), "
    "m AS (SELECT f.nxt, k.issue_category, k.column_name, EXISTS (SELECT 1 FROM k n WHERE n.version_id = f.nxt AND n.issue_category = k.issue_category AND n.column_name = k.column_name) AS still FROM k JOIN f USING (version_id)) "
    "SELECT count(*) AS issues_before, count(*) FILTER (WHERE NOT still) AS issues_resolved, round(count(*) FILTER (WHERE NOT still)::DOUBLE / count(*), 6) AS resolution_rate FROM m",
)
def issue_resolution(spark, sf_dir):
    return _rounded(R.issue_resolution(star(spark, sf_dir)), "resolution_rate")


@query("r15_average_missing_rate", f"{MART} SELECT round(avg(100 - completeness_score), 6) AS average_missing_rate FROM ev WHERE latest = 1")
def average_missing_rate(spark, sf_dir):
    return _rounded(R.average_missing_rate(star(spark, sf_dir)), "average_missing_rate")


@query("r16_unclean_datasets", f"{MART} SELECT count(DISTINCT dataset_id) AS unclean_datasets FROM ev WHERE latest = 1 AND overall_score < 70")
def unclean_datasets(spark, sf_dir):
    return R.unclean_datasets(star(spark, sf_dir))


@query(
    "r17_remediated_volume",
    f"{GOV} SELECT operation, CAST(sum(n) AS BIGINT) AS rows_affected, count(*) AS steps FROM (SELECT 'strip_whitespace' AS operation, row_count % 500 AS n FROM gov_versions WHERE parent_version_id IS NOT NULL "
    "UNION ALL SELECT CASE WHEN id % 2 = 0 THEN 'fill_mean' ELSE 'drop_duplicates' END, id % 97 FROM gov_versions WHERE parent_version_id IS NOT NULL) GROUP BY operation",
)
def remediated_volume(spark, sf_dir):
    return R.remediated_volume(gov(spark, sf_dir)["jobs"])
