"""Row-local rules on a streaming DataFrame.

The transforms and check predicates are plain column expressions, so they apply to a stream as
they are. Whole-table operators (duplicates, quantiles, imputation) stay with batch jobs; run
them on each micro-batch with ``foreachBatch`` if a per-batch answer is wanted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import fields_of
from ..operators import checks
from ..operators.checks import CheckRules
from ..operators.clean import CleaningRules, apply_casing, enforce_ranges, map_categories, normalize_dates, normalize_headers, trim_strings


def clean_rows(stream: DataFrame, rules: CleaningRules | None = None) -> DataFrame:
    """Headers, trimming, casing, mapping, dates and ranges, in the order of the batch job."""
    rules = rules or CleaningRules()
    if rules.normalize_column_names:
        stream = normalize_headers(stream, rules.header_style)
    if rules.strip_whitespace:
        stream = trim_strings(stream, collapse=rules.collapse_whitespace)
    stream = apply_casing(stream, rules.casing_rules)
    stream = map_categories(stream, rules.categorical_mappings)
    stream = normalize_dates(stream, rules.date_columns, rules.day_first, rules.date_format)
    return enforce_ranges(stream, {f.name: rules.range_rules[f.name] for f in fields_of(stream, "numeric") if f.name in rules.range_rules})


def flag_rows(stream: DataFrame, rules: CheckRules | None = None) -> DataFrame:
    """Add ``violations``: the row-local checks each row breaks, as ``CATEGORY:column`` texts."""
    rules = rules or CheckRules()
    probes = [
        *checks.missing_probes(stream),
        *checks.format_probes(stream, rules.format_rules),
        *checks.range_probes(stream, rules.range_rules),
        *checks.type_probes(stream, rules.type_rules),
        *checks.allowed_probes(stream, rules.category_rules),
    ]
    marks = [F.when(p.offends, F.lit(f"{p.category}:{p.column}")) for p in probes]
    return stream.withColumn("violations", F.array_compact(F.array(*marks)))
