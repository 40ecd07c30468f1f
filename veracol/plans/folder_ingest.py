"""Ingest of a folder: files of one header and one set of types are one table, keyed by dataset.

Every accepted CSV file is a dataset of its own, with its own types, snapshot, profile, report and scores. Files are not
taken one by one: headers come from one scan, types from one grouping by file, and files alike in both are read, written, profiled and checked
together by groupings on the dataset. The number of jobs depends on the number of different headers and types, not of files,
and every catalogue table is written once. What reaches the driver is one row for each file and issue.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text
from ..functions.columns import ROW_ID, as_text, cell, chunks, count_where, data_fields, fields_of, groupable, kind, ref, row_count
from ..functions.frames import small_table
from ..operators import checks
from ..operators.checks import CATEGORY, DUPLICATE, MISSING, OUTLIER, Issue, QualityReport
from ..operators.profile import percent
from ..operators.quantiles import grouped_quantiles
from ..operators.score import ScoreResult, score_report
from ..operators.value_counts import unpivot_cells
from ..session import cut_lineage
from ..sources.csv_source import apply_types, grouped_types, read_csv_files
from ..sources.landing import file_headers, read_landing, screen_files
from ..sources.sinks import write_snapshot
from .catalog import Catalog, Version, _now

DATASET = "__dataset"
SHOWN = 5  # groups of spellings, and spellings of a group, that a report names


@dataclass
class FileResult:
    """One ingested file."""

    path: str
    dataset_id: str
    version: Version
    report: QualityReport
    score: ScoreResult
    profile: dict[str, dict] = field(default_factory=dict)


def ingest_folder(catalog: Catalog, folder: str, user_id: str | None = None, multiline: bool | None = None, max_bytes: int | None = None) -> tuple[list[FileResult], DataFrame]:
    """Screen a folder and ingest all its accepted CSV files at once; returns a result for each file and the screen."""
    spark = catalog.spark
    screened = cut_lineage(screen_files(read_landing(spark, folder, max_bytes), max_bytes))
    accepted = {row["path"]: row for row in screened.where(F.col("accepted") & F.lower("file_name").endswith(".csv")).collect()}
    by_header: dict[str, list[str]] = defaultdict(list)
    for path, header in file_headers(spark, sorted(accepted)).items():
        by_header[header].append(path)
    results, batch = [], uuid.uuid4().hex[:8]
    for number, paths in enumerate(by_header.values()):
        raw = read_csv_files(spark, paths, multiline)
        types = grouped_types(raw)
        alike: dict[tuple, list[str]] = defaultdict(list)
        for path in paths:
            alike[tuple(types.get(path, dict.fromkeys((c for c in raw.columns if c not in (ROW_ID, "__path")), "double")).items())].append(path)
        for part, (kinds, members) in enumerate(alike.items()):
            table = raw if len(alike) == 1 else read_csv_files(spark, members, multiline)
            ids = {path: str(uuid.uuid4()) for path in members}
            store = f"{catalog.root}/snapshots/batch_{batch}_{number}_{part}"
            named = F.broadcast(small_table(spark, list(ids.items()), f"__path string, {DATASET} string"))  # one row per file, as the scan's own listing
            typed = apply_types(table, dict(kinds)).join(named, "__path").drop("__path")
            typed.write.partitionBy(DATASET).parquet(store)
            columns = [name for name, _ in kinds]
            sizes = _sizes(spark, store)
            stored = spark.read.schema(typed.schema).parquet(store) if sizes else typed  # nothing but headers leaves no file
            if len(sizes) < len(members):  # files without rows share an empty snapshot
                write_snapshot(spark.createDataFrame([], typed.drop(DATASET, ROW_ID).schema), f"{store}_empty")
            found = keyed_reports(stored.select(*[ref(c) for c in columns], ROW_ID, DATASET))
            for path in members:
                report, profile = found.get(ids[path], (QualityReport(0, len(columns), []), {}))
                location = f"{store}/{DATASET}={ids[path]}" if ids[path] in sizes else f"{store}_empty"
                version = Version(str(uuid.uuid4()), ids[path], 1, None, location, report.total_rows, len(columns), sizes.get(ids[path], 0))
                results.append(FileResult(path, ids[path], version, report, score_report(report), profile))
    results.sort(key=lambda r: r.path)
    _record(catalog, results, accepted, user_id)
    return results, screened


def _sizes(spark, store: str) -> dict[str, int]:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(store).select("path", "length")
    dataset = F.regexp_extract("path", f"{DATASET}=([^/]+)", 1).alias("dataset")
    return {row["dataset"]: row["n"] for row in files.groupBy(dataset).agg(F.sum("length").alias("n")).collect()}


def _record(catalog: Catalog, results: Sequence[FileResult], accepted: dict, user_id: str | None) -> None:
    """Everything the catalogue keeps of a batch, one write for each table."""
    now, rows = _now(), {name: [] for name in ("datasets", "versions", "reports", "issues")}
    for r in results:
        v, s, d, report_id = r.version, r.score, r.score.dimensions, str(uuid.uuid4())
        rows["datasets"].append((r.dataset_id, accepted[r.path]["dataset_name"], "", accepted[r.path]["file_name"], user_id, now, now))
        rows["versions"].append((v.id, v.dataset_id, v.version_number, None, v.storage_path, "parquet", v.row_count, v.column_count, v.file_size_bytes, now))
        scores = [d[key].score for key in ("completeness", "validity", "uniqueness", "consistency")]
        rows["reports"].append((report_id, v.id, s.overall_score, s.grade, s.grade_label, *scores, s.is_trustworthy, now))
        rows["issues"] += [(str(uuid.uuid4()), report_id, i.category, i.severity, i.column, i.description, i.affected_count, i.affected_percentage, i.suggested_action, now) for i in r.report.issues]
    catalog.append_batches({name: part for name, part in rows.items() if part})


def keyed_reports(df: DataFrame) -> dict[str, tuple[QualityReport, dict[str, dict]]]:
    """(report, profile) of every dataset in a table keyed by ``DATASET``; default checks, as for a single table."""
    fields = [f for f in data_fields(df) if f.name != DATASET]
    names = [f.name for f in fields]
    plain = _plain_figures(df, fields)
    copies = {row[DATASET]: row["n"] for row in _copies(df, fields).collect()}
    counts = cut_lineage(_value_counts(df, [f.name for f in fields]))
    distinct, tops = _distinct_and_top(counts)
    spellings = _spellings(counts, [f.name for f in fields_of(df.drop(DATASET), "text")])
    numeric = [f for f in fields if kind(f.dataType) == "numeric"]
    quartiles, outliers = _outliers(df, numeric)
    found = {}
    for dataset, figures in plain.items():
        rows, issues, profile = figures["rows"], [], {}
        for name in names:
            n = figures[name]["missing"]
            if n:
                share = percent(n, rows)
                severity = checks.CRITICAL if share >= checks.CRITICAL_MISSING_PERCENT else checks.WARNING
                issues.append(Issue(MISSING, severity, name, f"{n:,} values of '{name}' are missing ({share}%).", n, share, [], "Fill with mode, median or a default, or drop the rows."))
        n = copies.get(dataset, 0)
        if n:
            issues.append(Issue(DUPLICATE, checks.WARNING, None, f"{n:,} rows repeat an earlier row exactly ({percent(n, rows)}%).", n, percent(n, rows), [], "Remove the copies, keeping the first."))
        for name in names:
            if (dataset, name) in spellings:
                n, shown = spellings[dataset, name]
                issues.append(Issue(CATEGORY, checks.INFO, name, f"'{name}' mixes spellings that differ by case: {'; '.join(shown)}.", n, percent(n, rows), shown, "Choose one casing for the column."))
        for name in names:
            n = outliers.get((dataset, name), 0)
            if n:
                issues.append(Issue(OUTLIER, checks.INFO, name, f"{n:,} values of '{name}' are outliers (IQR).", n, percent(n, rows), [], "Review; an outlier need not be an error."))
        for f in fields:
            profile[f.name] = figures[f.name] | {"unique": distinct.get((dataset, f.name), 0), "top_values": tops.get((dataset, f.name), {})} | quartiles.get((dataset, f.name), {})
        found[dataset] = (QualityReport(rows, len(names), issues), profile)
    return found


def _plain_figures(df: DataFrame, fields) -> dict[str, dict]:
    """Row-local figures of all columns and datasets, 60 aggregates a pass."""
    probes = {p.column: p.offends for p in checks.missing_probes(df.drop(DATASET)) if p.category == MISSING}
    measures = []
    for f in fields:
        value, family = cell(f), kind(f.dataType)
        wanted = {"missing": count_where(probes[f.name]), "nulls": count_where(value.isNull())}
        if family == "numeric":
            number = value.cast("double")
            wanted |= {"min": F.min(number), "max": F.max(number), "mean": F.avg(number), "std": F.stddev_samp(number)}
        elif family in ("text", "boolean"):
            length = F.length(as_text(f))
            wanted |= {"min_length": F.min(length), "max_length": F.max(length), "avg_length": F.avg(length)}
        measures += [(f.name, key, measure) for key, measure in wanted.items()]
    found: dict[str, dict] = defaultdict(dict)
    for part in chunks(measures, 60):
        for row in df.groupBy(DATASET).agg(row_count().alias("rows"), *[m.alias(f"m{i}") for i, (_, _, m) in enumerate(part)]).collect():
            figures = found[row[DATASET]]
            figures["rows"] = row["rows"]
            for i, (name, key, _) in enumerate(part):
                figures.setdefault(name, {})[key] = row[f"m{i}"]
    return found


def _copies(df: DataFrame, fields) -> DataFrame:
    """Rows beyond the first of equal rows, for each dataset."""
    keys = [groupable(f).alias(f"k{i}") for i, f in enumerate(fields)]
    grouped = df.select(DATASET, *keys).groupBy(DATASET, *[f"k{i}" for i in range(len(keys))]).agg(row_count().alias("n"))
    return grouped.groupBy(DATASET).agg(F.sum(F.col("n") - 1).alias("n"))


def _value_counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(dataset, column_name, value, n, first_seen) of all non-null values as text."""
    by_name = {f.name: f for f in data_fields(df)}
    long = unpivot_cells(df, [(name, as_text(by_name[name])) for name in names], [DATASET, ROW_ID])
    return long.groupBy(DATASET, "column_name", "value").agg(row_count().alias("n"), F.min(ROW_ID).alias("first_seen"))


def _distinct_and_top(counts: DataFrame) -> tuple[dict, dict]:
    distinct = {(r[DATASET], r["column_name"]): r["n"] for r in counts.groupBy(DATASET, "column_name").agg(row_count().alias("n")).collect()}
    order = Window.partitionBy(DATASET, "column_name").orderBy(F.desc("n"), "first_seen", "value")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= SHOWN).collect()
    tops: dict = defaultdict(dict)
    for r in sorted(top, key=lambda r: r["rank"]):
        tops[r[DATASET], r["column_name"]][r["value"]] = r["n"]
    return distinct, tops


def _spellings(counts: DataFrame, names: Sequence[str]) -> dict[tuple[str, str], tuple[int, list[str]]]:
    """(affected rows, first groups as ``{A, a}``) of columns whose trimmed values differ by case only.

    At most ``SHOWN`` groups, with ``SHOWN`` spellings each, reach the driver, however many there are.
    """
    keys = [DATASET, "column_name"]
    trimmed = counts.where(F.col("column_name").isin(*names)).groupBy(*keys, text.strip(F.col("value")).alias("value")).agg(F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"))
    group = Window.partitionBy(*keys, "folded")
    spelled = trimmed.withColumn("folded", F.lower("value"))
    groups = cut_lineage(spelled.groupBy(*keys, "folded").agg(row_count().alias("spellings"), F.sum("n").alias("rows"), F.min("first_seen").alias("seen")).where("spellings > 1"))
    totals = {(r[DATASET], r["column_name"]): r["rows"] for r in groups.groupBy(*keys).agg(F.sum("rows").cast("bigint").alias("rows")).collect()}
    first = Window.partitionBy(*keys).orderBy("seen", "folded")
    chosen = groups.withColumn("place", F.row_number().over(first)).where(F.col("place") <= SHOWN).select(*keys, "folded", "place", "spellings")
    members = spelled.join(chosen, [*keys, "folded"]).withColumn("at", F.row_number().over(group.orderBy("first_seen", "value"))).where(F.col("at") <= SHOWN)
    shown: dict = defaultdict(lambda: defaultdict(list))
    more: dict = {}
    for r in sorted(members.collect(), key=lambda r: (r["place"], r["at"])):
        shown[r[DATASET], r["column_name"]][r["place"]].append(r["value"])
        more[r[DATASET], r["column_name"], r["place"]] = r["spellings"]
    listed = lambda key, place, values: "{" + ", ".join(values) + (f" and {more[*key, place] - len(values):,} more" if more[*key, place] > len(values) else "") + "}"
    return {key: (n, [listed(key, place, values) for place, values in sorted(shown[key].items())]) for key, n in totals.items()}


def _outliers(df: DataFrame, numeric) -> tuple[dict, dict]:
    """Quartiles, and the number of values beyond the fences, of every dataset and numeric column."""
    if not numeric:
        return {}, {}
    keys = [DATASET, "column_name"]
    long = unpivot_cells(df, [(f.name, cell(f).cast("double")) for f in numeric], [DATASET]).select(*keys, F.col("value").alias("v"))
    found = cut_lineage(grouped_quantiles(long, keys, [0.25, 0.5, 0.75]))
    q25, q75 = F.col("quantiles")[0], F.col("quantiles")[2]
    spread = checks.FENCE * (q75 - q25)
    fences = found.where((F.col("n") >= checks.OUTLIER_MIN_VALUES) & (q75 > q25)).select(*keys, (q25 - spread).alias("low"), (q75 + spread).alias("high"))
    beyond = long.join(fences, keys).where("v < low OR v > high").groupBy(*keys).agg(row_count().alias("n"))
    quartiles = {(r[DATASET], r["column_name"]): dict(zip(("q25", "median", "q75"), r["quantiles"], strict=True)) for r in found.collect()}
    return quartiles, {(r[DATASET], r["column_name"]): r["n"] for r in beyond.collect()}
