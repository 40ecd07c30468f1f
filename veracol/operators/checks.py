"""Quality checks.

All row-local checks are conditional counts over one scan. Outliers need the column statistics
first and then join the same kind of scan. Duplicates and casing variants each cost one grouped
shuffle with partial aggregation. Only counts, a handful of sample values and the finished issue
list (columns x checks rows) reach the driver.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field as dataclass_field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import casts, dates, text
from ..functions.columns import ROW_ID, aggregate_long, as_text, cell, count_where, data_fields, field_map, fields_of, groupable, kind, row_count
from ..functions.frames import small_table
from ..functions.together import run_together
from ..session import cut_lineage
from ..sources.row_order import with_row_order
from . import duplicates, value_counts as vc
from .profile import percent
from .quantiles import BUCKETS, exact_quantiles

# Named formats. Letters and digits of any script match \w and \d.
PATTERNS = {
    "email": r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$",
    "phone": r"^\+?[0-9\s\-()]{7,20}$",
    "iso_date": r"^\d{4}-\d{2}-\d{2}$",
    "postal_code": r"^[A-Za-z0-9][A-Za-z0-9 \-]{2,9}$",
}

MISSING, DUPLICATE, FORMAT, RANGE, CATEGORY, TYPE, OUTLIER = (
    "MISSING",
    "DUPLICATE",
    "INVALID_FORMAT",
    "INVALID_RANGE",
    "INCONSISTENT_CATEGORY",
    "INVALID_TYPE",
    "OUTLIER",
)
CRITICAL, WARNING, INFO = "CRITICAL", "WARNING", "INFO"

CRITICAL_MISSING_PERCENT = 20.0
OUTLIER_MIN_VALUES = 10
FENCE = 1.5
Z_LIMIT = 3.0
# Allowed-value lists up to this length become an IN set; longer ones a join.
INLINE_SET = 1_000
MOST_SPELLINGS = 100


@dataclass
class CheckRules:
    """What to check beyond missing values, duplicate rows, casing and outliers."""

    id_columns: Sequence[str | Sequence[str]] = ()
    range_rules: Mapping[str, Mapping[str, float]] = dataclass_field(default_factory=dict)
    format_rules: Mapping[str, str] = dataclass_field(default_factory=dict)
    category_rules: Mapping[str, Sequence[str]] = dataclass_field(default_factory=dict)
    type_rules: Mapping[str, str] = dataclass_field(default_factory=dict)


# -- row-local checks ----------------------------------------------------------------------


@dataclass
class Probe:
    """One row-local check: which cells offend, and the value to show for them."""

    category: str
    column: str
    rule: str
    offends: Column
    shown: Column


def missing_probes(df: DataFrame) -> list[Probe]:
    """Null, or a text of white space only."""
    probes = []
    for field in data_fields(df):
        value = cell(field)
        gone = value.isNull() | text.is_blank(value) if kind(field.dataType) == "text" else value.isNull()
        probes.append(Probe(MISSING, field.name, "missing", gone, F.lit(None).cast("string")))
    return probes


def format_pattern(rule: str) -> str | None:
    """Regex of a named format, or the rule itself as a start-anchored regex; None if it is invalid."""
    named = PATTERNS.get(rule.lower())
    if named is not None:
        return "(?U)" + named if rule.lower() in ("phone", "iso_date") else named
    try:
        re.compile(rule)
    except re.error:
        return None
    named_groups = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", rule).replace("(?P<", "(?<")
    pattern = f"(?U)^(?:{named_groups})"
    session = SparkSession.getActiveSession()
    try:
        if session is not None:
            session.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:  # noqa: BLE001 - valid in Python only: the rule is skipped like an invalid one
        return None
    return pattern


def format_probes(df: DataFrame, rules: Mapping[str, str]) -> list[Probe]:
    """Trimmed values that do not match; null is no value, blank is a bad one."""
    fields, probes = field_map(df), []
    for name, rule in rules.items():
        pattern = format_pattern(rule)
        if name not in fields or pattern is None:
            continue
        value = text.strip(as_text(fields[name]))
        probes.append(Probe(FORMAT, name, rule, value.isNotNull() & ~value.rlike(pattern), value))
    return probes


def range_probes(df: DataFrame, rules: Mapping[str, Mapping[str, float]]) -> list[Probe]:
    """Numbers below min or above max; the bounds belong to the range."""
    fields, probes = field_map(df), []
    for name, bounds in rules.items():
        if name not in fields or kind(fields[name].dataType) not in ("numeric", "boolean"):
            continue
        value = cell(fields[name])
        if kind(fields[name].dataType) == "boolean":
            value = value.cast("int")
        low, high = bounds.get("min"), bounds.get("max")
        outside, parts = F.lit(False), []
        if low is not None:
            outside, parts = outside | (value < F.lit(low)), [*parts, f"< {low}"]
        if high is not None:
            outside, parts = outside | (value > F.lit(high)), [*parts, f"> {high}"]
        probes.append(Probe(RANGE, name, " or ".join(parts), outside, value.cast("string")))
    return probes


def allowed_probes(df: DataFrame, rules: Mapping[str, Sequence[str]]) -> list[Probe]:
    """Trimmed text values outside the allowed list (case matters)."""
    fields, probes = field_map(df), []
    for name, allowed in rules.items():
        if name in fields and kind(fields[name].dataType) == "text" and len(set(allowed)) <= INLINE_SET:
            value = text.strip(cell(fields[name]))
            inside = value.isin(*sorted(set(allowed))) if allowed else F.lit(False)
            probes.append(Probe(CATEGORY, name, "allowed", value.isNotNull() & ~inside, value))
    return probes


def type_probes(df: DataFrame, rules: Mapping[str, str]) -> list[Probe]:
    """Text that should read as int, float, datetime or boolean but does not."""
    fields, probes = field_map(df), []
    for name, wanted in rules.items():
        if name not in fields or kind(fields[name].dataType) != "text":
            continue
        value, dtype = cell(fields[name]), fields[name].dataType
        filled = value.isNotNull() & ~text.is_blank(value)
        reads = {
            "int": casts.to_double(value, dtype).isNotNull() & ~casts.is_fractional(value, dtype),
            "float": casts.to_double(value, dtype).isNotNull(),
            "datetime": dates.parse_mixed_text(value).isNotNull(),
            "boolean": F.lower(text.strip(value)).isin("true", "false"),
        }[wanted]
        probes.append(Probe(TYPE, name, wanted, filled & ~reads, value))
    return probes


def count_probes(df: DataFrame, probes: Sequence[Probe]) -> DataFrame:
    """Offending rows per probe, all from one scan: (category, column_name, rule, affected_count, total_rows)."""
    items = [
        ({"category": p.category, "column_name": p.column, "rule": p.rule}, {"affected_count": count_where(p.offends), "total_rows": row_count()})
        for p in probes
    ]
    return aggregate_long(df, items)


def sample_values(df: DataFrame, probes: Sequence[Probe], limit: int = 5, order_by: str | None = None) -> DataFrame:
    """First offending values of each probe in row order: (category, column_name, rule, sample_values).

    Each task keeps at most ``limit`` rows per probe before the shuffle.
    """
    ordered = with_row_order(df, order_by)
    marks = [F.when(p.offends, p.shown) for p in probes]
    offending = ordered.where(F.coalesce(*marks).isNotNull())  # before each row becomes one per probe
    found = vc.unpivot_cells(offending, [(str(i), mark) for i, mark in enumerate(marks)], [ROW_ID])
    first = Window.partitionBy("column_name").orderBy(ROW_ID)
    kept = found.withColumn("at", F.row_number().over(first)).where(F.col("at") <= limit)
    listed = kept.groupBy("column_name").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("pairs"))
    keys = F.array(*[F.struct(F.lit(p.category).alias("category"), F.lit(p.column).alias("column_name"), F.lit(p.rule).alias("rule")) for p in probes])
    probe = F.get(keys, F.col("column_name").cast("int"))
    values = F.transform("pairs", lambda pair: pair["value"])
    return listed.select(probe.alias("probe"), values.alias("sample_values")).select("probe.*", "sample_values")


# -- checks that group or need statistics --------------------------------------------------


def key_duplicate_counts(df: DataFrame, keys: Sequence[str | Sequence[str]]) -> DataFrame | None:
    """All rows whose key is shared, per key: (category, column_name, affected_count, total_rows)."""
    fields, frames = field_map(df), None
    for key in keys:
        names = [key] if isinstance(key, str) else list(key)
        if any(name not in fields for name in names):
            continue
        counted = duplicates.duplicate_counts(df, names).select(
            F.lit(DUPLICATE).alias("category"), F.lit(",".join(names)).alias("column_name"), F.col("affected_rows").alias("affected_count"), "total_rows"
        )
        frames = counted if frames is None else frames.unionByName(counted)
    return frames


def key_duplicate_samples(df: DataFrame, key: Sequence[str], limit: int = 5, order_by: str | None = None) -> DataFrame:
    """Keys of the first ``limit`` colliding rows in row order.

    The first ``limit`` colliding rows have, between them, at most ``limit`` keys, and those are
    the keys with the earliest copies; so only these are joined back.
    """
    fields = field_map(df)
    ordered = with_row_order(df, order_by)
    names = [f"k{i}" for i in range(len(key))]
    keyed = ordered.select(*[groupable(fields[name]).alias(alias) for name, alias in zip(key, names)], ROW_ID)
    earliest = keyed.groupBy(*names).agg(row_count().alias("n"), F.min(ROW_ID).alias("seen")).where("n > 1").orderBy("seen").limit(limit)
    match = None
    for alias in names:
        same = F.col(f"a.{alias}").eqNullSafe(F.col(f"b.{alias}"))
        match = same if match is None else match & same
    hits = keyed.alias("a").join(F.broadcast(earliest.alias("b")), match, "left_semi")  # at most `limit` keys
    return hits.orderBy(ROW_ID).limit(limit).select(*[F.col(alias).cast("string").alias(name) for alias, name in zip(names, key)], ROW_ID)


def case_variants(df: DataFrame, columns: Sequence[str] | None = None, order_by: str | None = None, grouping: str = "exact") -> DataFrame:
    """Groups of trimmed values that differ by case only: (column_name, folded, spellings, affected_count, first_seen).

    Grouped by fingerprint, a value is the MD5 of its folded text followed by its own.
    """
    names = list(columns) if columns is not None else [f.name for f in fields_of(df, "text")]
    if grouping == "fingerprint":
        counts = vc.value_counts(df, names, order_by, transform=lambda c: F.concat(F.md5(F.lower(text.strip(c))), F.md5(text.strip(c))))
        folded = F.substring("value", 1, 32)
    else:
        counts = vc.value_counts(df, names, order_by, transform=text.strip)
        folded = F.lower("value")
    groups = counts.groupBy("column_name", folded.alias("folded")).agg(
        row_count().alias("spellings"), F.sum("n").alias("affected_count"), F.min("first_seen").alias("first_seen")
    )
    return groups.where("spellings > 1")


def case_variant_counts(df: DataFrame, columns: Sequence[str] | None = None, order_by: str | None = None, grouping: str = "exact") -> DataFrame:
    variants = case_variants(df, columns, order_by, grouping)
    return variants.groupBy("column_name").agg(row_count().alias("groups"), F.sum("affected_count").cast("bigint").alias("affected_count"))


def case_variant_report(
    df: DataFrame, columns: Sequence[str], limit: int = 5, order_by: str | None = None, grouping: str = "exact", most_spellings: int = MOST_SPELLINGS
) -> dict[str, tuple[int, list[str]]]:
    """(affected rows, first groups as ``{A, a}``) per column that has variants.

    Spellings and groups come in first-seen order. A group shows its first ``most_spellings``, and how many more there are
    as ``{A, a, ... 3 more}``; each task sends no more than that, and so does the cluster to the driver. The variant groups are stored once, so the value
    counts are shuffled once; the spellings of the at most ``limit`` shown groups per column come
    from a scan that keeps only their values.
    """
    groups = cut_lineage(case_variants(df, columns, order_by, grouping))
    totals = groups.groupBy("column_name").agg(F.sum("affected_count").cast("bigint").alias("affected_count")).collect()
    if not totals:
        return {}
    first = Window.partitionBy("column_name").orderBy("first_seen", "folded")
    chosen = groups.withColumn("place", F.row_number().over(first)).where(F.col("place") <= limit).select("column_name", "folded", "place", "spellings").collect()
    fields, varied = field_map(df), [row["column_name"] for row in totals]
    cells = vc.unpivot_cells(with_row_order(df, order_by), [(name, text.strip(cell(fields[name]))) for name in varied], [ROW_ID])
    listed = F.broadcast(small_table(df.sparkSession, [tuple(row) for row in chosen], "column_name string, folded string, place int, spellings bigint"))
    folded = F.md5(F.lower("value")) if grouping == "fingerprint" else F.lower("value")
    spelled = cells.withColumn("folded", folded).join(listed, ["column_name", "folded"])
    seen = spelled.groupBy("column_name", "place", "spellings", "value").agg(F.min(ROW_ID).alias("seen"))
    earliest = Window.partitionBy("column_name", "place").orderBy("seen", "value")
    shown = seen.withColumn("nth", F.row_number().over(earliest)).where(F.col("nth") <= most_spellings).orderBy("column_name", "place", "nth").collect()
    listed_values: dict[str, dict[int, list[str]]] = {name: {} for name in varied}
    for row in shown:
        values = listed_values[row["column_name"]].setdefault(row["place"], [])
        values.append(row["value"])
        if row["nth"] == most_spellings < row["spellings"]:
            values.append(f"... {row['spellings'] - most_spellings} more")
    return {row["column_name"]: (row["affected_count"], ["{" + ", ".join(values) + "}" for values in listed_values[row["column_name"]].values()]) for row in totals}


def unlisted_counts(df: DataFrame, column: str, allowed: DataFrame) -> DataFrame:
    """Allowed-value check against a table of any size; ``allowed`` has one column ``value``."""
    counts = vc.value_counts(df, [column], transform=text.strip)
    unknown = counts.join(allowed.select("value").distinct(), "value", "left_anti")
    return unknown.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("affected_count"))


def unlisted_samples(df: DataFrame, column: str, allowed: DataFrame, limit: int = 5, order_by: str | None = None) -> DataFrame:
    """The first values in row order that the table ``allowed`` does not list: (value); each task keeps ``limit`` rows."""
    value = text.strip(cell(field_map(df)[column]))
    values = with_row_order(df, order_by).select(F.col(ROW_ID), value.alias("value")).where(F.col("value").isNotNull())
    return values.join(allowed.select("value").distinct(), "value", "left_anti").orderBy(ROW_ID).limit(limit).select("value")


@dataclass
class Fence:
    """Bounds outside which a value of the column is an outlier."""

    column: str
    low: float | None = None
    high: float | None = None
    mean: float | None = None
    std: float | None = None

    def offends(self, value: Column) -> Column:
        if self.std is not None:
            return F.abs((value - F.lit(self.mean)) / F.lit(self.std)) > F.lit(Z_LIMIT)
        if self.low is None or self.high is None:
            return F.lit(False)
        return (value < F.lit(self.low)) | (value > F.lit(self.high))


def outlier_fences(df: DataFrame, method: str = "iqr", columns: Sequence[str] | None = None, buckets: int = BUCKETS) -> list[Fence]:
    """Fences of the numeric columns with enough values and spread: a few numbers per column."""
    fields = field_map(df)
    names = list(columns) if columns is not None else [f.name for f in fields_of(df, "numeric")]
    if not names:
        return []
    values = {name: cell(fields[name]).cast("double") for name in names}
    measures = []
    for i, name in enumerate(names):
        measures.append(F.count(values[name]).alias(f"n{i}"))
        if method != "iqr":
            measures += [F.avg(values[name]).alias(f"a{i}"), F.stddev_samp(values[name]).alias(f"s{i}")]
    row = df.agg(*measures).first()
    enough = [name for i, name in enumerate(names) if row[f"n{i}"] >= OUTLIER_MIN_VALUES]
    if method != "iqr":
        place = {name: i for i, name in enumerate(names)}
        stats = {name: (row[f"a{place[name]}"], row[f"s{place[name]}"]) for name in enough}
        # Infinite values leave no usable deviation (and NaN compares as largest in Spark).
        return [Fence(name, mean=mean, std=std) for name, (mean, std) in stats.items() if std and math.isfinite(std)]
    quartiles = exact_quantiles(df, enough, [0.25, 0.75], {name: row[f"n{names.index(name)}"] for name in enough}, buckets)
    fences = []
    for name in enough:
        q25, q75 = quartiles[name]
        if q25 is None or q75 is None or not q75 - q25 > 0:
            continue
        spread = q75 - q25
        low, high = q25 - FENCE * spread, q75 + FENCE * spread
        fences.append(Fence(name, low, high) if low == low and high == high else Fence(name))
    return fences


def outlier_probes(df: DataFrame, fences: Sequence[Fence]) -> list[Probe]:
    fields = field_map(df)
    probes = []
    for fence in fences:
        value = cell(fields[fence.column])
        probes.append(Probe(OUTLIER, fence.column, "z-score" if fence.std is not None else "iqr", fence.offends(value.cast("double")), value.cast("string")))
    return probes


# -- the whole report ----------------------------------------------------------------------


@dataclass
class Issue:
    category: str
    severity: str
    column: str | None
    description: str
    affected_count: int
    affected_percentage: float
    sample_values: list[str] = dataclass_field(default_factory=list)
    suggested_action: str | None = None

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)


ISSUE_SCHEMA = (
    "category string, severity string, column_name string, description string, affected_count bigint, "
    "affected_percentage double, sample_values array<string>, suggested_action string"
)


@dataclass
class QualityReport:
    total_rows: int
    total_columns: int
    issues: list[Issue]

    @property
    def issues_by_category(self) -> dict[str, int]:
        return self._rolled_up("category")

    @property
    def issues_by_severity(self) -> dict[str, int]:
        return self._rolled_up("severity")

    @property
    def total_issues_count(self) -> int:
        return sum(issue.affected_count for issue in self.issues)

    def _rolled_up(self, key: str) -> dict[str, int]:
        totals: dict[str, int] = {}
        for issue in self.issues:
            totals[getattr(issue, key)] = totals.get(getattr(issue, key), 0) + issue.affected_count
        return totals

    def with_severity(self, severity: str = "ALL") -> list[Issue]:
        wanted = severity.upper()
        return [issue for issue in self.issues if wanted == "ALL" or issue.severity == wanted]

    def to_frame(self, spark) -> DataFrame:
        rows = [(i.category, i.severity, i.column, i.description, i.affected_count, i.affected_percentage, i.sample_values, i.suggested_action) for i in self.issues]
        return small_table(spark, rows, ISSUE_SCHEMA)

    def to_dict(self) -> dict[str, Any]:
        return {
            "total_rows": self.total_rows,
            "total_columns": self.total_columns,
            "total_issues_count": self.total_issues_count,
            "issues_by_category": self.issues_by_category,
            "issues_by_severity": self.issues_by_severity,
            "issues": [issue.to_dict() for issue in self.issues],
        }

    def to_json(self, indent: int = 2) -> str:
        return json.dumps(self.to_dict(), indent=indent, default=str, ensure_ascii=False)


def issue_rollup(issues: DataFrame, by: str) -> DataFrame:
    """Affected rows summed per category or severity (not the number of issues)."""
    return issues.groupBy(by).agg(F.sum("affected_count").cast("bigint").alias("affected_count"))


def filter_severity(issues: DataFrame, severity: str = "ALL") -> DataFrame:
    return issues if severity.upper() == "ALL" else issues.where(F.upper("severity") == severity.upper())


def analyze(
    df: DataFrame,
    rules: CheckRules | None = None,
    critical_missing_threshold: float = CRITICAL_MISSING_PERCENT,
    outlier_method: str = "iqr",
    sample_limit: int = 5,
    order_by: str | None = None,
    grouping: str = "exact",
    duplicate_rows: int | None = None,
) -> QualityReport:
    """Run every check and compile the report, in the order missing, duplicate, format, range, category, outlier.

    ``grouping='fingerprint'`` groups rows and texts by 128-bit digests instead of shuffling them.
    ``duplicate_rows`` hands in a whole-row duplicate count that is already known.
    """
    rules = rules or CheckRules()
    fields = data_fields(df)
    if not fields:
        return QualityReport(0, 0, [])
    texts = [f.name for f in fields_of(df, "text")]
    fences, copies, key_issues, variants = run_together(
        df.sparkSession,
        lambda: outlier_fences(df, outlier_method),
        lambda: duplicates.duplicate_counts(df, method=grouping).first()["duplicate_rows"] if duplicate_rows is None else duplicate_rows,
        lambda: _key_collisions(df, rules.id_columns, sample_limit, order_by),
        lambda: case_variant_report(df, texts, sample_limit, order_by, grouping) if texts else {},
    )
    probes = [
        *missing_probes(df),
        *format_probes(df, rules.format_rules),
        *range_probes(df, rules.range_rules),
        *type_probes(df, rules.type_rules),
        *allowed_probes(df, rules.category_rules),
        *outlier_probes(df, fences),
    ]
    shown_probes = [p for p in probes if p.category != MISSING]
    counts, sampled, unlisted = run_together(
        df.sparkSession,
        lambda: count_probes(df, probes).collect(),
        lambda: sample_values(df, shown_probes, sample_limit, order_by).collect() if shown_probes and sample_limit else [],
        lambda: _long_lists(df, rules.category_rules, texts, sample_limit, order_by),
    )
    rows = counts[0]["total_rows"]
    if rows == 0:
        return QualityReport(0, len(fields), [])
    affected = {(c["category"], c["column_name"], c["rule"]): c["affected_count"] for c in counts}
    samples = {(s["category"], s["column_name"], s["rule"]): s["sample_values"] for s in sampled}

    def hits(category: str):
        for p in probes:
            key = (p.category, p.column, p.rule)
            if p.category == category and affected[key]:
                yield p, affected[key], percent(affected[key], rows), list(samples.get(key, []))

    issues: list[Issue] = []
    for p, n, share, _ in hits(MISSING):
        severity = CRITICAL if share >= critical_missing_threshold else WARNING
        issues.append(Issue(MISSING, severity, p.column, f"{n:,} values of '{p.column}' are missing ({share}%).", n, share, [], "Fill with mode, median or a default, or drop the rows."))

    if copies:
        share = percent(copies, rows)
        issues.append(Issue(DUPLICATE, WARNING, None, f"{copies:,} rows repeat an earlier row exactly ({share}%).", copies, share, [], "Remove the copies, keeping the first."))
    for label, n, shown in key_issues:
        issues.append(Issue(DUPLICATE, CRITICAL, label, f"{n:,} rows share a value of the key '{label}'.", n, percent(n, rows), shown, "Check how the key is made, or deduplicate on it."))
    for p, n, share, shown in hits(FORMAT):
        issues.append(Issue(FORMAT, WARNING, p.column, f"{n:,} values of '{p.column}' do not match the format '{p.rule}'.", n, share, shown, f"Correct the values to follow '{p.rule}'."))
    for p, n, share, shown in hits(RANGE):
        issues.append(Issue(RANGE, WARNING, p.column, f"{n:,} values of '{p.column}' are out of range ({p.rule}).", n, share, shown, "Clamp to the bounds or set to null."))
    for p, n, share, shown in hits(TYPE):
        issues.append(Issue(TYPE, WARNING, p.column, f"{n:,} values of '{p.column}' do not read as {p.rule}.", n, share, shown, f"Convert to {p.rule} or set to null."))
    found = {p.column: (n, shown) for p, n, _, shown in hits(CATEGORY)} | unlisted
    issues += _category_issues(texts, variants, found, rows)
    for p, n, share, shown in hits(OUTLIER):
        issues.append(Issue(OUTLIER, INFO, p.column, f"{n:,} values of '{p.column}' are outliers ({outlier_method.upper()}).", n, share, shown, "Review; an outlier need not be an error."))
    return QualityReport(rows, len(fields), issues)


def _key_collisions(df: DataFrame, keys, limit: int, order_by: str | None) -> list[tuple[str, int, list[str]]]:
    """(key, rows sharing a key value, first such values) per key that collides."""
    counted = key_duplicate_counts(df, keys)
    found = {row["column_name"]: row["affected_count"] for row in counted.collect()} if counted is not None else {}
    collisions = []
    for key in keys:
        names = [key] if isinstance(key, str) else list(key)
        n = found.get(",".join(names), 0)
        if n:
            sampled = key_duplicate_samples(df, names, limit, order_by).collect()
            collisions.append((",".join(names), n, [", ".join(str(value) for value in row[: len(names)]) for row in sampled]))
    return collisions


def _long_lists(df: DataFrame, rules: Mapping[str, Sequence[str]], texts: Sequence[str], limit: int, order_by: str | None) -> dict[str, tuple[int, list[str]]]:
    """Counts and first offending values for allowed-value lists that are too long for a set in an expression."""
    found = {}
    for name, values in rules.items():
        if name in texts and len(set(values)) > INLINE_SET:
            listed = small_table(df.sparkSession, [(value,) for value in set(values)], "value string")
            n = unlisted_counts(df, name, listed).first()["affected_count"]
            if n:
                found[name] = (n, [row["value"] for row in unlisted_samples(df, name, listed, limit, order_by).collect()])
    return found


def _category_issues(texts: Sequence[str], variants, unlisted, rows: int) -> list[Issue]:
    issues = []
    for name in texts:
        if name in variants:
            n, shown = variants[name]
            issues.append(Issue(CATEGORY, INFO, name, f"'{name}' mixes spellings that differ by case: {'; '.join(shown)}.", n, percent(n, rows), shown, "Choose one casing for the column."))
        if name in unlisted:
            n, shown = unlisted[name]
            issues.append(Issue(CATEGORY, WARNING, name, f"{n:,} values of '{name}' are not among the allowed categories.", n, percent(n, rows), shown, "Map unknown categories to known ones or to 'Other'."))
    return issues
