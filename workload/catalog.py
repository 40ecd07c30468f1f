"""Catalogue, version and lineage queries (L)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from veracol.functions.frames import small_table
from veracol.operators.clean import CleaningRules
from veracol.plans import catalog as L, jobs
from veracol.plans.catalog import Catalog
from veracol.plans.folder_ingest import ingest_folder
from veracol.session import scratch_path
from veracol.sources.landing import screen_files
from veracol.sources.sinks import CSV_OPTIONS

from .checks import GRADE_SQL, WEIGHTS, dimension_sql, EXACT_SQL, MISSING_SQL, CASE_SQL, _gone
from .inputs import DIRTY, DIRTY_COLUMNS, DIRTY_TEXTS, GOV, dirty, gov
from .registry import query, union_all
from .sources import LANDING_SQL, landing_files

_SCORES = "overall_score, grade, completeness_score, validity_score, uniqueness_score, consistency_score, is_trustworthy"


@query("l01_register_files", f"WITH files AS ({LANDING_SQL}) SELECT dataset_name AS name, file_name AS original_filename, 'default_user' AS user_id FROM files WHERE accepted")
def register_files(spark, sf_dir):
    """Rows for the accepted files; ids and times differ per run and are left out."""
    return L.new_datasets(screen_files(landing_files(spark, sf_dir))).select("name", "original_filename", "user_id")


@query("l02_next_version", f"{GOV} SELECT d.id AS dataset_id, CAST(coalesce(max(v.version_number), 0) + 1 AS BIGINT) AS next_version FROM gov_datasets d LEFT JOIN gov_versions v ON v.dataset_id = d.id GROUP BY d.id")
def next_version(spark, sf_dir):
    tables = gov(spark, sf_dir)
    return L.next_version_numbers(tables["datasets"], tables["versions"])


@query(
    "l03_create_version",
    f"{DIRTY} SELECT CAST(1 AS BIGINT) AS version_number, count(*) AS row_count, CAST(7 AS BIGINT) AS column_count, false AS has_parent, true AS has_bytes, count(DISTINCT id) AS stored_ids FROM dirty "
    "UNION ALL SELECT 2, count(*), 7, true, true, count(DISTINCT id) FROM dirty WHERE balance IS NOT NULL",
)
def create_version(spark, sf_dir):
    """Two snapshots of one dataset, with what the catalogue records and what the files hold."""
    catalog = Catalog(spark, scratch_path(spark, "catalog"))
    dataset_id = catalog.register("dirty customer", "dirty_customer.csv")
    first = catalog.create_version(dataset_id, dirty(spark, sf_dir))
    second = catalog.create_version(dataset_id, catalog.load_version(first.id).where("balance is not null"), first.id)
    stored = None
    for version in (first, second):
        ids = catalog.load_version(version.id).agg(F.count_distinct("id").alias("stored_ids")).withColumn("id", F.lit(version.id))
        stored = ids if stored is None else stored.unionByName(ids)
    recorded = catalog.history(dataset_id)
    return recorded.join(stored, "id").select(
        "version_number", "row_count", "column_count", F.col("parent_version_id").isNotNull().alias("has_parent"), (F.col("file_size_bytes") > 0).alias("has_bytes"), "stored_ids"
    )


@query("l04_save_reports", f"{GOV} SELECT version_id, {_SCORES} FROM gov_scorecards WHERE version_id NOT IN (SELECT version_id FROM gov_reports)")
def save_reports(spark, sf_dir):
    """Scorecards that may be saved: their version has no report yet."""
    tables = gov(spark, sf_dir)
    return L.unreported(tables["scorecards"], tables["reports"]).select("version_id", *_SCORES.split(", "))


@query("l05_save_issues", f"{GOV} SELECT report_id, category, severity, column_name, affected_count FROM gov_issues WHERE report_id IN (SELECT id FROM gov_reports)")
def save_issues(spark, sf_dir):
    tables = gov(spark, sf_dir)
    return L.issues_of_reports(tables["issues"], tables["reports"]).select("report_id", "category", "severity", "column_name", "affected_count")


@query("l06_job_totals", "SELECT l_orderkey AS job_id, count(*) AS total_operations, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS rows_affected FROM lineitem GROUP BY l_orderkey")
def job_totals(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return L.job_totals(lines.select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("step_number"), F.col("l_quantity").cast("bigint").alias("rows_affected")))


@query("l08_version_history", f"{GOV} SELECT v.id, v.dataset_id, v.version_number, v.parent_version_id, v.row_count, {', '.join('r.' + c for c in _SCORES.split(', '))} FROM gov_versions v LEFT JOIN gov_reports r ON r.version_id = v.id")
def version_history(spark, sf_dir):
    tables = gov(spark, sf_dir)
    return L.version_history(tables["versions"], tables["reports"]).select("id", "dataset_id", "version_number", "parent_version_id", "row_count", *_SCORES.split(", "))


@query(
    "l09_dataset_listing",
    f"{GOV}, s AS (SELECT v.dataset_id, arg_max(r.overall_score, v.version_number) AS latest_quality_score, arg_max(r.grade, v.version_number) AS latest_grade FROM gov_versions v JOIN gov_reports r ON r.version_id = v.id GROUP BY v.dataset_id), "
    "c AS (SELECT dataset_id, count(*) AS total_versions, max(version_number) AS latest_version_number FROM gov_versions GROUP BY dataset_id) "
    "SELECT d.id, d.name, d.original_filename, d.user_id, coalesce(c.total_versions, 0) AS total_versions, c.latest_version_number, s.latest_quality_score, s.latest_grade "
    "FROM gov_datasets d LEFT JOIN c ON c.dataset_id = d.id LEFT JOIN s ON s.dataset_id = d.id",
)
def dataset_listing(spark, sf_dir):
    tables = gov(spark, sf_dir)
    return L.dataset_listing(tables["datasets"], tables["versions"], tables["reports"]).drop("description", "created_at", "updated_at")


@query("l10_latest_versions", f"{GOV} SELECT dataset_id, arg_max(id, version_number) AS version_id, max(version_number) AS version_number FROM gov_versions GROUP BY dataset_id")
def latest_versions(spark, sf_dir):
    return L.latest_versions(gov(spark, sf_dir)["versions"])


@query(
    "l11_report_with_issues",
    f"{GOV}, newest AS (SELECT arg_max(id, version_number) AS version_id FROM gov_versions GROUP BY dataset_id) SELECT r.id AS report_id, r.version_id, r.overall_score, i.category, i.severity, i.column_name, i.affected_count "
    "FROM gov_reports r JOIN newest USING (version_id) LEFT JOIN gov_issues i ON i.report_id = r.id",
)
def report_with_issues(spark, sf_dir):
    tables = gov(spark, sf_dir)
    return L.report_with_issues(tables["reports"], tables["issues"], L.latest_versions(tables["versions"]))


@query("l12_visible_datasets", f"{GOV} SELECT id, name, user_id FROM gov_datasets WHERE user_id IS NULL OR user_id = '' OR user_id = 'user_7'")
def visible_datasets(spark, sf_dir):
    return L.visible_to(gov(spark, sf_dir)["datasets"], "user_7").select("id", "name", "user_id")


@query(
    "l13_score_deltas",
    f"{GOV} SELECT v.id AS version_id, v.dataset_id, round(r.overall_score - coalesce(p.overall_score, 0.0), 2) AS score_delta FROM gov_versions v JOIN gov_reports r ON r.version_id = v.id "
    "LEFT JOIN gov_reports p ON p.version_id = v.parent_version_id WHERE v.parent_version_id IS NOT NULL",
)
def score_deltas(spark, sf_dir):
    tables = gov(spark, sf_dir)
    return L.score_deltas(tables["versions"], tables["reports"]).select("version_id", "dataset_id", F.round("score_delta", 2).alias("score_delta"))


def _plain_score(source: str, cte: str) -> str:
    """Dimension scores of a table analysed without rules, as the jobs do."""
    defects = union_all(
        [
            f"SELECT category, affected_count AS n FROM ({MISSING_SQL})",
            f"SELECT category, n FROM ({EXACT_SQL})",
            f"SELECT 'INCONSISTENT_CATEGORY', affected_count FROM ({CASE_SQL})",
        ]
    ).replace("dirty", source)
    rows, cells = f"(SELECT count(*) FROM {source})", f"(SELECT count(*) * {len(DIRTY_COLUMNS)} FROM {source})"
    dims = union_all([dimension_sql(n, f"{source}_defects", rows, cells) for n in WEIGHTS])
    return f"{cte}, {source}_defects AS ({defects}), {source}_dims AS ({dims}), {source}_overall AS (SELECT round(sum(weighted_score), 2) AS s FROM {source}_dims)"


@query(
    "l14_ingest_job",
    f"{_plain_score('dirty', DIRTY)} SELECT dimension, score, passed_items, total_evaluated, defects_count FROM dirty_dims UNION ALL SELECT 'Overall', s, NULL, NULL, NULL FROM dirty_overall",
)
def ingest_job(spark, sf_dir):
    """Screen a landing folder, ingest the CSV files found, and show the saved scores."""
    landing = scratch_path(spark, "landing")
    dirty(spark, sf_dir).coalesce(1).write.options(**CSV_OPTIONS).csv(landing)
    catalog = Catalog(spark, scratch_path(spark, "catalog"))
    results, _ = jobs.ingest_landing(catalog, landing)
    scores = [result.score.to_frame(spark) for result in results]
    return reduce(DataFrame.unionByName, scores).drop("weight", "weighted_score", "grade", "is_trustworthy")


_FILES = 12
_BY_FILE = " UNION ALL ".join(
    [f"SELECT g, 'MISSING' AS category, count(*) FILTER (WHERE {_gone(c)}) AS n FROM d GROUP BY g" for c in DIRTY_COLUMNS]
    + [f"SELECT g, 'DUPLICATE', sum(n - 1) FROM (SELECT g, count(*) AS n FROM d GROUP BY g, {', '.join(DIRTY_COLUMNS)}) GROUP BY g"]
    + [f"SELECT g, 'INCONSISTENT_CATEGORY', sum(n) FROM (SELECT g, count(*) AS n FROM d WHERE {c} IS NOT NULL GROUP BY g, lower(trim({c})) HAVING count(DISTINCT trim({c})) > 1) GROUP BY g" for c in DIRTY_TEXTS]
)


@query(
    "l14_many_files",
    f"{DIRTY}, d AS (SELECT *, id % {_FILES} AS g FROM dirty), n AS ({_BY_FILE}), r AS (SELECT g, CAST(count(*) AS BIGINT) AS rows FROM d GROUP BY g), "
    f"t AS (SELECT r.g, rows, rows * {len(DIRTY_COLUMNS)} AS cells, coalesce(sum(n) FILTER (category = 'MISSING'), 0) AS missing, coalesce(sum(n) FILTER (category = 'DUPLICATE'), 0) AS copies, "
    "coalesce(sum(n) FILTER (category = 'INCONSISTENT_CATEGORY'), 0) AS mixed FROM r LEFT JOIN n ON n.g = r.g GROUP BY ALL), "
    "s AS (SELECT g, rows, round(CAST(greatest(0, cells - missing) AS DOUBLE) / cells * 100, 2) AS completeness, 100.0::DOUBLE AS validity, greatest(0.0, round((1.0 - CAST(copies AS DOUBLE) / rows) * 100, 2)) AS uniqueness, "
    "greatest(0.0, round((1.0 - CAST(mixed AS DOUBLE) / cells) * 100, 2)) AS consistency FROM t) "
    "SELECT CAST(g AS BIGINT) AS file, rows AS row_count, completeness AS completeness_score, validity AS validity_score, uniqueness AS uniqueness_score, consistency AS consistency_score, "
    "round(round(completeness * 0.3::DOUBLE, 2) + round(validity * 0.3::DOUBLE, 2) + round(uniqueness * 0.2::DOUBLE, 2) + round(consistency * 0.2::DOUBLE, 2), 2) AS overall_score FROM s",
)
def ingest_many_files(spark, sf_dir):
    """A folder of twelve files, each a dataset: read, checked and scored together, and read back from the catalogue."""
    landing = scratch_path(spark, "landing")
    parted = dirty(spark, sf_dir).withColumn("file", F.col("id") % _FILES)
    parted.repartition("file").write.options(**CSV_OPTIONS).partitionBy("file").csv(landing)
    catalog = Catalog(spark, scratch_path(spark, "catalog"))
    results, _ = ingest_folder(catalog, landing)
    files = small_table(spark, [(r.version.id, int(r.path.split("/file=")[1].split("/")[0])) for r in results], "version_id string, file bigint")
    versions = catalog.table("versions").select(F.col("id").alias("version_id"), "row_count")
    scores = [c for c in _SCORES.split(", ") if c.endswith("_score")]
    return catalog.table("reports").join(versions, "version_id").join(files, "version_id").select("file", "row_count", *scores)


_JOB_CTE = (
    f"{DIRTY.replace('dirty AS', 'raw AS')}, tidy AS (SELECT DISTINCT id, trim(name) AS name, trim(email) AS email, upper(segment) AS segment, balance, trim(note) AS note, trim(joined) AS joined FROM raw), "
    "fixed AS (SELECT id, name, email, segment, coalesce(balance, (SELECT quantile_cont(balance, 0.5) FROM tidy)) AS balance, note, joined FROM tidy)"
)


@query(
    "l15_clean_job",
    f"{_plain_score('fixed', _plain_score('raw', _JOB_CTE))} SELECT CAST(2 AS BIGINT) AS version_number, (SELECT count(*) FROM fixed) AS row_count, a.s AS overall_score, {GRADE_SQL.format(s='a.s')} AS grade, round(a.s - b.s, 2) AS quality_score_delta "
    "FROM fixed_overall a, raw_overall b",
)
def clean_job(spark, sf_dir):
    """Ingest a table, clean its latest version into a new one, and show what was recorded."""
    catalog = Catalog(spark, scratch_path(spark, "catalog"))
    ingested = jobs.ingest_table(catalog, dirty(spark, sf_dir), "dirty customer", "dirty_customer.csv")
    rules = CleaningRules(casing_rules={"segment": "upper"}, drop_duplicates_subset=True, missing_strategies={"balance": {"strategy": "median"}})
    done = jobs.clean_latest(catalog, ingested.dataset_id, rules)
    recorded = catalog.table("jobs").where(F.col("id") == done.job_id).select(F.col("target_version_id").alias("id"), "quality_score_delta")
    return catalog.history(ingested.dataset_id).join(recorded, "id").select("version_number", "row_count", "overall_score", "grade", "quality_score_delta")


_GONE = "(SELECT id FROM gov_datasets WHERE user_id = 'user_3')"


@query(
    "l16_cascade_delete",
    f"{GOV}, gd AS {_GONE}, gv AS (SELECT id FROM gov_versions WHERE dataset_id IN (SELECT id FROM gd)), gr AS (SELECT id FROM gov_reports WHERE version_id IN (SELECT id FROM gv)) "
    "SELECT 'datasets' AS table_name, count(*) AS rows FROM gov_datasets WHERE id NOT IN (SELECT id FROM gd) "
    "UNION ALL SELECT 'versions', count(*) FROM gov_versions WHERE id NOT IN (SELECT id FROM gv) "
    "UNION ALL SELECT 'reports', count(*) FROM gov_reports WHERE id NOT IN (SELECT id FROM gr) "
    "UNION ALL SELECT 'issues', count(*) FROM gov_issues WHERE report_id NOT IN (SELECT id FROM gr) "
    "UNION ALL SELECT 'jobs', count(*) FROM gov_jobs WHERE source_version_id NOT IN (SELECT id FROM gv) AND target_version_id NOT IN (SELECT id FROM gv)",
)
def cascade_delete(spark, sf_dir):
    tables = gov(spark, sf_dir)
    left = L.cascade_delete(tables, tables["datasets"].where("user_id = 'user_3'"))
    counted = None
    for name in ("datasets", "versions", "reports", "issues", "jobs"):
        row = left[name].agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        counted = row if counted is None else counted.unionByName(row)
    return counted


@query(
    "l17_lineage",
    f"{GOV}, chain AS (SELECT id, dataset_id, version_number FROM gov_versions) SELECT c.id AS version_id, arg_min(a.id, a.version_number) AS root_version_id, count(*) - 1 AS depth FROM chain c JOIN chain a ON a.dataset_id = c.dataset_id AND a.version_number <= c.version_number GROUP BY c.id",
)
def lineage(spark, sf_dir):
    return L.lineage(gov(spark, sf_dir)["versions"])


@query(
    "l17_lineage_chain",
    f"{GOV}, longest AS (SELECT arg_max(dataset_id, version_number * 1000000000000 - id) AS dataset_id FROM gov_versions) SELECT id AS version_id, (SELECT max(version_number) FROM gov_versions WHERE dataset_id = (SELECT dataset_id FROM longest)) - version_number AS distance "
    "FROM gov_versions WHERE dataset_id = (SELECT dataset_id FROM longest)",
)
def lineage_chain(spark, sf_dir):
    """Ancestors of the version that has the most of them."""
    versions = gov(spark, sf_dir)["versions"]
    deepest = versions.orderBy(F.desc("version_number"), "id").first()["id"]
    return L.lineage_chain(versions, deepest)
