"""Catalogue of datasets, versions, reports, issues and cleaning jobs.

The first half are frame -> frame functions over the five tables. ``Catalog`` stores the tables
as Parquet: appends go to the current generation of a table, deletes write the next generation.
There is one writer at a time; readers may run alongside.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..functions.columns import data_fields, row_count
from ..functions.frames import small_table
from ..operators.checks import QualityReport
from ..operators.clean import CleaningResult
from ..operators.score import ScoreResult
from ..session import cut_lineage
from ..sources.sinks import without_row_id, write_snapshot

SCHEMAS = {
    "datasets": "id string, name string, description string, original_filename string, user_id string, created_at timestamp, updated_at timestamp",
    "versions": "id string, dataset_id string, version_number bigint, parent_version_id string, storage_path string, file_format string, "
    "row_count bigint, column_count bigint, file_size_bytes bigint, created_at timestamp",
    "reports": "id string, version_id string, overall_score double, grade string, grade_label string, completeness_score double, validity_score double, "
    "uniqueness_score double, consistency_score double, is_trustworthy boolean, created_at timestamp",
    "issues": "id string, report_id string, category string, severity string, column_name string, description string, affected_count bigint, "
    "affected_percentage double, suggested_action string, created_at timestamp",
    "jobs": "id string, source_version_id string, target_version_id string, total_operations bigint, rows_modified bigint, quality_score_delta double, "
    "execution_log_json string, created_at timestamp",
}
SCORES = ("overall_score", "grade", "completeness_score", "validity_score", "uniqueness_score", "consistency_score", "is_trustworthy")


# -- frame operators -----------------------------------------------------------------------


def new_datasets(screened: DataFrame, user_id: str = "default_user", description: str = "") -> DataFrame:
    """Dataset rows for the accepted files of a landing screen."""
    now = F.current_timestamp()
    return screened.where("accepted").select(
        F.expr("uuid()").alias("id"),
        F.col("dataset_name").alias("name"),
        F.lit(description).alias("description"),
        F.col("file_name").alias("original_filename"),
        F.lit(user_id).alias("user_id"),
        now.alias("created_at"),
        now.alias("updated_at"),
    )


def next_version_numbers(datasets: DataFrame, versions: DataFrame) -> DataFrame:
    """1 + the highest version per dataset; counted per dataset before the join."""
    highest = versions.groupBy("dataset_id").agg(F.max("version_number").alias("highest"))
    joined = datasets.select(F.col("id").alias("dataset_id")).join(highest, "dataset_id", "left")
    return joined.select("dataset_id", (F.coalesce("highest", F.lit(0)) + 1).cast("bigint").alias("next_version"))


def unreported(scorecards: DataFrame, reports: DataFrame) -> DataFrame:
    """Scorecards whose version has no report yet (one report per version)."""
    return scorecards.join(reports.select("version_id"), "version_id", "left_anti")


def issues_of_reports(issues: DataFrame, reports: DataFrame) -> DataFrame:
    """Issue rows of the given reports."""
    return issues.join(reports.select(F.col("id").alias("report_id")), "report_id", "left_semi")


def job_totals(steps: DataFrame) -> DataFrame:
    """Operations per cleaning job from its step rows (job_id, step_number, rows_affected)."""
    return steps.groupBy("job_id").agg(row_count().alias("total_operations"), F.sum("rows_affected").cast("bigint").alias("rows_affected"))


def version_history(versions: DataFrame, reports: DataFrame) -> DataFrame:
    """Versions with their scores, unscored ones included, in version order."""
    scores = reports.select(F.col("version_id").alias("__version"), *SCORES)
    joined = versions.join(scores, versions["id"] == F.col("__version"), "left").drop("__version")
    return joined.orderBy("dataset_id", "version_number")


def dataset_listing(datasets: DataFrame, versions: DataFrame, reports: DataFrame) -> DataFrame:
    """Datasets, newest first, with version count, latest version and the latest score and grade.

    The latest scored version comes from one ``max_by`` per dataset, not from a query per row.
    """
    scored = versions.join(
        reports.select(F.col("version_id").alias("id"), "overall_score", "grade", F.lit(True).alias("scored")), "id", "left"
    )
    at = F.when(F.col("scored"), F.col("version_number"))
    per_dataset = scored.groupBy(F.col("dataset_id").alias("id")).agg(
        row_count().alias("total_versions"),
        F.max("version_number").alias("latest_version_number"),
        F.max_by("overall_score", at).alias("latest_quality_score"),
        F.max_by("grade", at).alias("latest_grade"),
    )
    listed = datasets.join(per_dataset, "id", "left")
    return listed.withColumn("total_versions", F.coalesce("total_versions", F.lit(0))).orderBy(F.desc("created_at"), "id")


def latest_versions(versions: DataFrame) -> DataFrame:
    """(dataset_id, version_id, version_number) of each dataset's highest version."""
    return versions.groupBy("dataset_id").agg(F.max_by("id", "version_number").alias("version_id"), F.max("version_number").alias("version_number"))


def report_with_issues(reports: DataFrame, issues: DataFrame, version_ids: DataFrame) -> DataFrame:
    """Report and issue rows of the given versions (column ``version_id``); reports without issues stay.

    An outer join could not split a report that owns very many issues. The issues meet their
    reports in an inner join instead, and reports without any are added.
    """
    chosen = reports.join(version_ids.select("version_id"), "version_id", "left_semi").select(F.col("id").alias("report_id"), "version_id", "overall_score")
    detail = issues.select("report_id", "category", "severity", "column_name", "affected_count")
    with_issues = detail.join(chosen, "report_id")
    reported = issues.groupBy("report_id").agg(row_count().alias("n")).select("report_id")
    return with_issues.unionByName(chosen.join(reported, "report_id", "left_anti"), allowMissingColumns=True)


def visible_to(datasets: DataFrame, requester: str | None) -> DataFrame:
    """Datasets a requester may see: unowned ones, their own, or all when nobody is named."""
    if not requester:
        return datasets
    owner = F.col("user_id")
    return datasets.where(owner.isNull() | (owner == "") | (owner == requester))


def score_deltas(versions: DataFrame, reports: DataFrame) -> DataFrame:
    """Score of a version minus that of its parent (0 if unscored). Both joins are on unique version ids."""
    scores = reports.select("version_id", "overall_score")
    scored = versions.select(F.col("id").alias("version_id"), "dataset_id", "version_number", "parent_version_id").where("parent_version_id is not null").join(scores, "version_id")
    before = scores.select(F.col("version_id").alias("parent_version_id"), F.col("overall_score").alias("previous_score"))
    joined = scored.join(before, "parent_version_id", "left")
    return joined.withColumn("score_delta", F.col("overall_score") - F.coalesce("previous_score", F.lit(0.0)))


def cascade_delete(tables: Mapping[str, DataFrame], dataset_ids: DataFrame) -> dict[str, DataFrame]:
    """The five tables without the given datasets (column ``id``) and everything hanging on them."""
    gone = dataset_ids.select("id").distinct()
    datasets, versions, reports = tables["datasets"], tables["versions"], tables["reports"]
    gone_versions = versions.join(gone.select(F.col("id").alias("dataset_id")), "dataset_id", "left_semi").select("id")
    gone_reports = reports.join(gone_versions.select(F.col("id").alias("version_id")), "version_id", "left_semi").select("id")
    kept = versions.join(gone_versions, "id", "left_anti")
    # First versions have no parent; kept out of the join, their nulls do not meet in one task.
    orphan = gone_versions.select(F.col("id").alias("parent_version_id"), F.lit(True).alias("__gone"))
    pointed = kept.where("parent_version_id is not null").join(orphan, "parent_version_id", "left")
    cleared = pointed.withColumn("parent_version_id", F.when(F.col("__gone").isNull(), F.col("parent_version_id")))
    kept_versions = kept.where("parent_version_id is null").select(*versions.columns).unionByName(cleared.select(*versions.columns))
    jobs = tables["jobs"]
    for end in ("source_version_id", "target_version_id"):
        jobs = jobs.join(gone_versions.select(F.col("id").alias(end)), end, "left_anti")
    return {
        "datasets": datasets.join(gone, "id", "left_anti").select(*datasets.columns),
        "versions": kept_versions,
        "reports": reports.join(gone_reports, "id", "left_anti").select(*reports.columns),
        "issues": tables["issues"].join(gone_reports.select(F.col("id").alias("report_id")), "report_id", "left_anti").select(*tables["issues"].columns),
        "jobs": jobs.select(*tables["jobs"].columns),
    }


def lineage(versions: DataFrame) -> DataFrame:
    """Root version and depth of every version: (version_id, root_version_id, depth).

    Parent pointers are doubled each round, so a chain of n versions needs log2(n) joins on
    version ids. Each round is stored, because the plan would double as well.
    """
    state = versions.select(
        F.col("id").alias("version_id"),
        F.col("parent_version_id").alias("pointer"),
        F.coalesce("parent_version_id", "id").alias("root_version_id"),
        F.when(F.col("parent_version_id").isNull(), 0).otherwise(1).cast("bigint").alias("depth"),
    )
    state = cut_lineage(state)
    while True:
        ancestors = state.select(
            F.col("version_id").alias("pointer"),
            F.col("pointer").alias("far"),
            F.col("root_version_id").alias("far_root"),
            F.col("depth").alias("far_depth"),
        )
        moving, settled = state.where("pointer is not null"), state.where("pointer is null")
        if moving.isEmpty():
            return state.select("version_id", "root_version_id", "depth")
        stepped = moving.join(ancestors, "pointer", "left").select(
            "version_id",
            F.col("far").alias("pointer"),
            F.coalesce("far_root", "root_version_id").alias("root_version_id"),
            (F.col("depth") + F.coalesce("far_depth", F.lit(0))).cast("bigint").alias("depth"),
        )
        state = cut_lineage(settled.unionByName(stepped))


def lineage_chain(versions: DataFrame, version_id: Any) -> DataFrame:
    """One version and all its ancestors: (version_id, distance).

    Jump tables of 1, 2, 4, ... steps are applied to everything reached so far, so a chain of n
    versions needs log2(n) rounds.
    """
    jump = versions.where("parent_version_id is not null").select(F.col("id").alias("version_id"), F.col("parent_version_id").alias("up"))
    reached = versions.where(F.col("id") == F.lit(version_id)).select(F.col("id").alias("version_id"), F.lit(0).cast("bigint").alias("distance"))
    step = 1
    while True:
        further = cut_lineage(reached.join(jump, "version_id").select(F.col("up").alias("version_id"), (F.col("distance") + step).alias("distance")))
        if further.isEmpty():
            return reached
        reached = cut_lineage(reached.unionByName(further))
        onward = jump.select(F.col("version_id").alias("up"), F.col("up").alias("far"))
        jump = cut_lineage(jump.join(onward, "up").select("version_id", F.col("far").alias("up")))
        step *= 2


# -- storage -------------------------------------------------------------------------------


def _now() -> datetime:
    return datetime.now(timezone.utc)


@dataclass
class Version:
    id: str
    dataset_id: str
    version_number: int
    parent_version_id: str | None
    storage_path: str
    row_count: int
    column_count: int
    file_size_bytes: int


class Catalog:
    """The five metadata tables and the snapshots, below one shared folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # Tables are folders of generations; the highest finished generation is current.

    def _filesystem(self, path: str):
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _generation(self, table: str) -> int:
        filesystem, path = self._filesystem(f"{self.root}/meta/{table}")
        if not filesystem.exists(path):
            return 0
        found = [int(status.getPath().getName().split("=")[1]) for status in filesystem.listStatus(path) if self._finished(status.getPath().toString())]
        return max(found, default=0)

    def _finished(self, folder: str) -> bool:
        filesystem, path = self._filesystem(f"{folder}/_SUCCESS")
        return filesystem.exists(path)

    def _folder(self, table: str, generation: int) -> str:
        return f"{self.root}/meta/{table}/gen={generation}"

    def table(self, name: str) -> DataFrame:
        folder = self._folder(name, self._generation(name))
        if not self._finished(folder):
            return small_table(self.spark, [], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(folder)

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in SCHEMAS}

    def append(self, name: str, rows: DataFrame) -> None:
        columns = [part.split()[0] for part in SCHEMAS[name].split(", ")]
        rows.select(*columns).write.mode("append").parquet(self._folder(name, self._generation(name)))

    def _append_rows(self, name: str, rows: list[tuple]) -> None:
        self.append(name, small_table(self.spark, rows, SCHEMAS[name]))

    def append_batches(self, batches: dict[str, list[tuple]]) -> None:
        """Rows of several tables, one write and one file for each, whatever their number; parents first."""
        for name in SCHEMAS:
            if name in batches:
                self.append(name, small_table(self.spark, batches[name], SCHEMAS[name]).coalesce(1))

    # Entities.

    def register(self, name: str, original_filename: str, description: str = "", user_id: str | None = None) -> str:
        dataset_id, now = str(uuid.uuid4()), _now()
        self._append_rows("datasets", [(dataset_id, name, description, original_filename, user_id, now, now)])
        return dataset_id

    def register_files(self, screened: DataFrame, user_id: str = "default_user") -> None:
        """Register every accepted file of a landing screen in one write."""
        self.append("datasets", new_datasets(screened, user_id))

    def create_version(self, dataset_id: str, df: DataFrame, parent_version_id: str | None = None) -> Version:
        """Write an immutable snapshot and record it. Rows are counted while they are written."""
        taken = self.table("versions").where(F.col("dataset_id") == dataset_id)
        number = taken.agg(F.coalesce(F.max("version_number"), F.lit(0)) + 1).first()[0]
        version_id = str(uuid.uuid4())
        path = f"{self.root}/snapshots/ds_{dataset_id[:8]}_v{number}_{version_id[:8]}.parquet"
        watch = Observation()
        write_snapshot(without_row_id(df).observe(watch, row_count().alias("rows")), path)
        rows = watch.get["rows"]
        size = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
        version = Version(version_id, dataset_id, number, parent_version_id, path, rows, len(data_fields(df)), size)
        self._append_rows("versions", [(version.id, dataset_id, number, parent_version_id, path, "parquet", rows, version.column_count, size, _now())])
        return version

    def load_version(self, version_id: str) -> DataFrame:
        row = self.table("versions").where(F.col("id") == version_id).select("storage_path").first()
        if row is None:
            raise FileNotFoundError(f"version '{version_id}' is not in the catalogue")
        path = row["storage_path"]
        if not self._finished(path) and not self._finished(path.rsplit("/", 1)[0]):  # a batch finishes as a whole
            raise FileNotFoundError(f"snapshot '{row['storage_path']}' is missing")
        return self.spark.read.parquet(row["storage_path"])

    def save_report(self, version_id: str, result: ScoreResult, report: QualityReport | None = None) -> str:
        if not self.table("reports").where(F.col("version_id") == version_id).isEmpty():
            raise ValueError(f"version '{version_id}' already has a report")
        report_id, now, d = str(uuid.uuid4()), _now(), result.dimensions
        scores = tuple(d[key].score for key in ("completeness", "validity", "uniqueness", "consistency"))
        self._append_rows("reports", [(report_id, version_id, result.overall_score, result.grade, result.grade_label, *scores, result.is_trustworthy, now)])
        if report is not None and report.issues:
            self._append_rows(
                "issues",
                [(str(uuid.uuid4()), report_id, i.category, i.severity, i.column, i.description, i.affected_count, i.affected_percentage, i.suggested_action, now) for i in report.issues],
            )
        return report_id

    def record_job(self, source_version_id: str, target_version_id: str, result: CleaningResult, score_delta: float = 0.0) -> str:
        job_id, delta = str(uuid.uuid4()), result.delta
        modified = delta["rows_removed"] + delta["missing_cells_resolved"]
        log = json.dumps([step.__dict__ for step in result.steps], default=str)
        self._append_rows("jobs", [(job_id, source_version_id, target_version_id, len(result.steps), modified, float(score_delta), log, _now())])
        return job_id

    def dataset(self, dataset_id: str) -> dict[str, Any] | None:
        row = self.table("datasets").where(F.col("id") == dataset_id).first()
        return row.asDict() if row else None

    def history(self, dataset_id: str) -> DataFrame:
        return version_history(self.table("versions").where(F.col("dataset_id") == dataset_id), self.table("reports"))

    def latest_version(self, dataset_id: str) -> dict[str, Any]:
        row = self.history(dataset_id).orderBy(F.desc("version_number")).first()
        if row is None:
            raise FileNotFoundError(f"dataset '{dataset_id}' has no version")
        return row.asDict()

    def listing(self) -> DataFrame:
        return dataset_listing(self.table("datasets"), self.table("versions"), self.table("reports"))

    def delete_datasets(self, dataset_ids: list[str]) -> None:
        """Write the next generation of every table without the datasets; snapshots stay on disk."""
        gone = small_table(self.spark, [(i,) for i in dataset_ids], "id string")
        survivors = cascade_delete(self.tables(), gone)
        generations = {name: self._generation(name) + 1 for name in survivors}
        # Children first: a reader that sees a new parent table never sees rows pointing past it.
        for name in ("issues", "jobs", "reports", "versions", "datasets"):
            survivors[name].write.mode("overwrite").parquet(self._folder(name, generations[name]))

