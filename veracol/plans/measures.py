"""Governance measures: 27 named aggregates over the star schema.

Each measure is declared once, as an aggregate over one base table or as arithmetic on other
measures. Asking for any set of them scans each needed base table once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import aggregate_long, count_where, row_count

TRUST_THRESHOLD = 80.0
# Colour per score band, and the badge texts.
GRADE_COLORS = [(90.0, "#10B981"), (80.0, "#38BDF8"), (70.0, "#F59E0B"), (60.0, "#F97316")]
LOWEST_COLOR = "#EF4444"
TRUSTED_BADGE = "🟢 TRUSTED FOR PRODUCTION"
UNTRUSTED_BADGE = "🔴 UNTRUSTED / NEEDS CLEANING"


def evaluations(star: Mapping[str, DataFrame]) -> DataFrame:
    """Evaluations with version number and latest flag; the join is on unique version ids."""
    flags = star["Dim_Version"].select("version_id", "version_number", F.col("is_latest_version").alias("latest"))
    return star["Fact_QualityEvaluation"].join(flags, "version_id")


_BASES = {
    "datasets": lambda star: star["Dim_Dataset"],
    "versions": lambda star: star["Dim_Version"],
    "evaluations": evaluations,
    "issues": lambda star: star["Fact_QualityIssues"],
    "jobs": lambda star: star["Fact_CleaningJobs"],
}


def _latest(column: str) -> Column:
    return F.when(F.col("latest") == 1, F.col(column))


_AGGREGATES = {
    "Total Datasets": ("datasets", lambda: F.count_distinct("dataset_id")),
    "Total Versions Analyzed": ("versions", lambda: row_count()),
    "Total Records Monitored": ("evaluations", lambda: F.sum(_latest("row_count"))),
    "Avg Quality Score": ("evaluations", lambda: F.avg("overall_score")),
    "Latest Quality Score": ("evaluations", lambda: F.avg(_latest("overall_score"))),
    "Trustworthy Datasets": ("evaluations", lambda: F.count_distinct(F.when((F.col("latest") == 1) & (F.col("is_trustworthy") == 1), F.col("dataset_id")))),
    "Avg Completeness Score": ("evaluations", lambda: F.avg(_latest("completeness_score"))),
    "Avg Validity Score": ("evaluations", lambda: F.avg(_latest("validity_score"))),
    "Avg Uniqueness Score": ("evaluations", lambda: F.avg(_latest("uniqueness_score"))),
    "Avg Consistency Score": ("evaluations", lambda: F.avg(_latest("consistency_score"))),
    "Total Issues Detected": ("issues", lambda: row_count()),
    "Critical Issues": ("issues", lambda: count_where(F.col("severity_code") == "CRITICAL")),
    "Warning Issues": ("issues", lambda: count_where(F.col("severity_code") == "WARNING")),
    "Info Issues": ("issues", lambda: count_where(F.col("severity_code") == "INFO")),
    "Total Defective Rows": ("issues", lambda: F.sum("affected_count")),
    "Total Cleaning Jobs": ("jobs", lambda: row_count()),
    "Total Rows Remediated": ("jobs", lambda: F.sum("rows_modified")),
    "Total Duplicates Removed": ("jobs", lambda: F.sum("rows_removed")),
    "Avg Quality Score Delta": ("jobs", lambda: F.avg("quality_score_delta")),
    "Raw Quality Score": ("evaluations", lambda: F.avg(F.when(F.col("version_number") == 1, F.col("overall_score")))),
    "Cleaned Quality Score": ("evaluations", lambda: F.avg(F.when(F.col("version_number") > 1, _latest("overall_score")))),
}
DIMENSION_MEASURES = {name: f"Avg {name} Score" for name in ("Completeness", "Validity", "Uniqueness", "Consistency")}


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def _weakest(*scores: Column) -> Column:
    """Name and value of the lowest dimension; the earlier one on ties."""
    lowest = F.least(*scores)
    named = None
    for name, score in zip(DIMENSION_MEASURES, scores):
        shown = F.concat(F.lit(f"{name} ("), F.format_string("%.1f%%", score), F.lit(")"))
        named = F.when(lowest == score, shown) if named is None else named.when(lowest == score, shown)
    return named


def _color(score: Column) -> Column:
    bands = None
    for floor, color in GRADE_COLORS:
        bands = F.when(score >= floor, color) if bands is None else bands.when(score >= floor, color)
    return bands.otherwise(LOWEST_COLOR)


def _badge(score: Column) -> Column:
    return F.when(score >= TRUST_THRESHOLD, TRUSTED_BADGE).otherwise(UNTRUSTED_BADGE)


_DERIVED = {
    "Trustworthy Rate %": (("Trustworthy Datasets", "Total Datasets"), _ratio),
    "Critical Issue Rate %": (("Critical Issues", "Total Issues Detected"), _ratio),
    "Cleaning Net Lift %": (("Cleaned Quality Score", "Raw Quality Score"), lambda cleaned, raw: cleaned - raw),
}
_TEXTS = {
    "Weakest Dimension": (tuple(DIMENSION_MEASURES.values()), _weakest),
    "Grade Color Hex": (("Latest Quality Score",), _color),
    "Trust Status Badge": (("Latest Quality Score",), _badge),
}
MEASURES = [*_AGGREGATES, *_DERIVED, *_TEXTS]


def measures(star: Mapping[str, DataFrame], names: Sequence[str] | None = None) -> DataFrame:
    """(measure, value, label): numbers in ``value``, texts in ``label``; all measures by default."""
    names = list(names) if names is not None else MEASURES
    needed: dict[str, None] = {}
    for name in names:
        sources = _DERIVED.get(name) or _TEXTS.get(name)
        for part in sources[0] if sources else (name,):
            needed[part] = None
    frames = []
    for base, frame in _BASES.items():
        items = [({"measure": name}, {"value": _AGGREGATES[name][1]().cast("double")}) for name in needed if _AGGREGATES[name][0] == base]
        if items:
            frames.append(aggregate_long(frame(star), items))
    long = reduce(DataFrame.unionByName, frames)
    slots = {name: F.col(f"m{i}") for i, name in enumerate(needed)}
    # The base values, one row each, become one row so that measures can refer to each other.
    wide = long.agg(*[F.max(F.when(F.col("measure") == name, F.col("value"))).alias(f"m{i}") for i, name in enumerate(needed)])
    rows = []
    for name in names:
        value, label = F.lit(None).cast("double"), F.lit(None).cast("string")
        if name in _TEXTS:
            parts, build = _TEXTS[name]
            label = build(*[slots[part] for part in parts])
        elif name in _DERIVED:
            parts, build = _DERIVED[name]
            value = build(*[slots[part] for part in parts])
        else:
            value = slots[name]
        rows.append(F.struct(F.lit(name).alias("measure"), value.alias("value"), label.alias("label")))
    return wide.select(F.inline(F.array(*rows)))
