"""Ingest and clean jobs: the operators composed over a catalogue.

Every step after the snapshot reads the snapshot, so the scan is columnar and the row order and
values are the same in each of them.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import data_fields
from ..functions.together import run_together
from ..operators.checks import CheckRules, QualityReport, analyze
from ..operators.clean import CleaningResult, CleaningRules, clean
from ..operators.duplicates import duplicate_counts
from ..operators.profile import TableProfile, profile
from ..operators.score import ScoreResult, score_report
from ..sources.csv_source import read_csv
from ..sources.landing import read_landing, screen_files
from ..sources.row_order import read_parquet_in_order
from ..sources.sinks import write_safe_csv
from .catalog import Catalog, Version


@dataclass
class IngestResult:
    dataset_id: str
    version: Version
    profile: TableProfile
    report: QualityReport
    score: ScoreResult


@dataclass
class CleanResult:
    version: Version
    cleaning: CleaningResult
    report: QualityReport
    score: ScoreResult
    score_delta: float
    job_id: str


def ingest_table(catalog: Catalog, df: DataFrame, name: str, filename: str, user_id: str | None = None, rules: CheckRules | None = None) -> IngestResult:
    """Register, snapshot, profile, analyse, score and save one table."""
    dataset_id = catalog.register(name, filename, user_id=user_id)
    version = catalog.create_version(dataset_id, df)
    stored = read_parquet_in_order(catalog.spark, version.storage_path)
    # The widest shuffle, whole-row duplicates, is run once for both.
    copies = duplicate_counts(stored).first()["duplicate_rows"] if data_fields(stored) else 0
    described, report = run_together(
        catalog.spark, lambda: profile(stored, duplicate_rows=copies), lambda: analyze(stored, rules, duplicate_rows=copies)
    )
    result = score_report(report)
    catalog.save_report(version.id, result, report)
    return IngestResult(dataset_id, version, described, report, result)


def ingest_landing(catalog: Catalog, folder: str, user_id: str | None = None, multiline: bool | None = None) -> tuple[list[IngestResult], DataFrame]:
    """Screen a folder and ingest its accepted CSV files; returns the results and the screen.

    Each file is a dataset of its own schema, hence one chain of jobs per file.
    """
    screened = screen_files(read_landing(catalog.spark, folder, None), None)
    results = []
    for row in screened.where(F.col("accepted") & F.lower("file_name").endswith(".csv")).orderBy("path").toLocalIterator():
        table = read_csv(catalog.spark, row["path"], multiline)
        results.append(ingest_table(catalog, table, row["dataset_name"], row["file_name"], user_id))
    return results, screened


def clean_latest(catalog: Catalog, dataset_id: str, rules: CleaningRules | None = None) -> CleanResult:
    """Clean the latest version into a new one, score it and record the job."""
    source: dict[str, Any] = catalog.latest_version(dataset_id)
    catalog.load_version(source["id"])  # fails early when the snapshot is gone
    cleaning = clean(read_parquet_in_order(catalog.spark, source["storage_path"]), rules)
    version = catalog.create_version(dataset_id, cleaning.cleaned, parent_version_id=source["id"])
    stored = read_parquet_in_order(catalog.spark, version.storage_path)
    cleaning.stored = stored
    report = analyze(stored, duplicate_rows=cleaning.after_stats["duplicate_rows"])
    result = score_report(report)
    catalog.save_report(version.id, result, report)
    delta = round(result.overall_score - float(source["overall_score"] or 0.0), 2)
    job_id = catalog.record_job(source["id"], version.id, cleaning, delta)
    return CleanResult(version, cleaning, report, result, delta, job_id)


def export_latest(catalog: Catalog, dataset_id: str, path: str, version_id: str | None = None) -> None:
    """Formula-safe CSV of a version, the latest by default."""
    chosen = version_id or catalog.latest_version(dataset_id)["id"]
    write_safe_csv(catalog.load_version(chosen), path)
