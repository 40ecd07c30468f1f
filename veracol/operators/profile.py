"""Table profile: one fused pass for the counters, one shuffle of value counts for the rest.

Every operator below is a lazy DataFrame -> DataFrame function; ``profile`` composes them and
brings back only rows per column.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field as dataclass_field
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import casts, dates, text
from ..functions.columns import (
    AGGREGATES_PER_PASS,
    ROW_ID,
    aggregate_long,
    as_text,
    cell,
    chunks,
    count_where,
    data_fields,
    field_map,
    fields_of,
    kind,
    ratio_percent,
    row_count,
)
from ..functions.frames import small_table
from ..functions.together import run_together
from ..sources.row_order import with_row_order
from . import duplicates, value_counts as vc
from .quantiles import BUCKETS, exact_quantiles

# With probe='first', a text column is probed for dates only up to this many values, on the first PROBED of them.
DATE_PROBE_LIMIT = 500
DATE_PROBED = 50
DATE_SHARE = 0.8
FIXED_BYTES = {"boolean": 1, "numeric": 8, "datetime": 8}


# -- dataset level -------------------------------------------------------------------------


def table_shape(df: DataFrame) -> DataFrame:
    columns = len(data_fields(df))
    rows = row_count()
    return df.agg(
        rows.alias("total_rows"),
        F.lit(columns).cast("bigint").alias("total_columns"),
        (rows * F.lit(columns)).cast("bigint").alias("total_cells"),
    )


def missing_cells(df: DataFrame) -> DataFrame:
    """Missing cells of the whole table and their share; the per-column counts are summed."""
    nulls = column_nulls(df)
    return nulls.agg(
        F.coalesce(F.sum("null_count"), F.lit(0)).cast("bigint").alias("missing_cells"),
        F.coalesce(F.sum("total_count"), F.lit(0)).cast("bigint").alias("total_cells"),
    ).withColumn("missing_percentage", ratio_percent(F.col("missing_cells"), F.col("total_cells")))


def footprint(df: DataFrame) -> DataFrame:
    """Approximate bytes: text lengths plus fixed widths. Not the in-memory size of any library."""
    items = []
    for field in data_fields(df):
        family = kind(field.dataType)
        if family in FIXED_BYTES:
            size = row_count() * F.lit(FIXED_BYTES[family])
        else:
            size = F.coalesce(F.sum(F.octet_length(as_text(field))), F.lit(0))
        items.append(({"column_name": field.name}, {"bytes": size.cast("bigint")}))
    return aggregate_long(df, items)


# -- per column ----------------------------------------------------------------------------


def column_nulls(df: DataFrame) -> DataFrame:
    """Null count and share of every column, from one pass."""
    items = [
        ({"column_position": i, "column_name": field.name}, {"null_count": count_where(cell(field).isNull()), "total_count": row_count()})
        for i, field in enumerate(data_fields(df))
    ]
    return aggregate_long(df, items).withColumn("null_percentage", ratio_percent(F.col("null_count"), F.col("total_count")))


def column_distincts(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct non-null values per column and their share of all rows."""
    names = [field.name for field in data_fields(df)]
    counted = vc.distinct_counts(df, names, approximate)
    totals = column_nulls(df).select("column_name", "total_count")
    joined = counted.join(F.broadcast(totals), "column_name")  # one row per column
    return joined.select("column_name", "unique_count", ratio_percent(F.col("unique_count"), F.col("total_count")).alias("unique_percentage"))


def numeric_stats(df: DataFrame, columns: Sequence[str] | None = None, counts: Mapping[str, int] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """min, max, mean, median, sample std (0 for one value), quartiles; rounded to 4 digits."""
    return _number_stats(df, columns, {"q25": 0.25, "median": 0.5, "q75": 0.75}, counts, buckets)


def _number_stats(df: DataFrame, columns: Sequence[str] | None, ranks: Mapping[str, float], counts: Mapping[str, int] | None = None, buckets: int = BUCKETS) -> DataFrame:
    fields = field_map(df)
    names = list(columns) if columns is not None else [f.name for f in fields_of(df, "numeric")]
    found = exact_quantiles(df, names, list(ranks.values()), counts, buckets)
    items = []
    for name in names:
        value = cell(fields[name]).cast("double")
        quantiles = {key: _constant(F.round(F.lit(q).cast("double"), 4)) for key, q in zip(ranks, found[name], strict=True)}
        measures = {
            "value_count": F.count(value),
            "min": F.min(value),
            "max": F.max(value),
            "mean": F.round(F.avg(value), 4),
            "median": quantiles.pop("median"),
            "std": F.when(F.count(value) > 0, F.coalesce(F.round(F.stddev_samp(value), 4), F.lit(0.0))),
            **quantiles,
        }
        items.append(({"column_name": name}, measures))
    return aggregate_long(df, items)


def _constant(value: Column) -> Column:
    """A literal next to aggregates."""
    return F.max(value)


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std, min, median and max of the numeric columns."""
    stats = _number_stats(df, columns, {"median": 0.5})
    return stats.select("column_name", "value_count", "mean", "std", "min", "median", "max")


def text_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Shortest, longest and mean length of text and boolean values."""
    fields = field_map(df)
    names = list(columns) if columns is not None else [f.name for f in fields_of(df, "text", "boolean")]
    items = []
    for name in names:
        length = F.length(as_text(fields[name]))
        measures = {"min_length": F.min(length), "max_length": F.max(length), "avg_length": F.round(F.avg(length), 2)}
        items.append(({"column_name": name}, measures))
    return aggregate_long(df, items)


def date_shapes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, shape, n, dates, min_date, max_date) over all values of text columns, from one grouping.

    ``shape`` is the way a value is written (null: none of the known ones), ``dates`` how many of the n values are dates.
    Each task sends one row for each column and shape.
    """
    fields = field_map(df)
    long = vc.unpivot_cells(df, [(name, cell(fields[name])) for name in columns])
    read = long.select("column_name", dates.shape_of(text.strip(F.col("value"))).alias("shape"), dates.parse_mixed_text(F.col("value")).alias("at"))
    return read.groupBy("column_name", "shape").agg(row_count().alias("n"), F.count("at").alias("dates"), F.min("at").alias("min_date"), F.max("at").alias("max_date"))


def datetime_stats(df: DataFrame, columns: Sequence[str], formats: str = "all") -> DataFrame:
    """Earliest and latest date of the columns; a text column counts every value that is a date, however it is written.

    With ``formats='first'`` a text column is read in the one format its first value has, and other dates are left out.
    """
    fields = field_map(df)
    texts = [name for name in columns if kind(fields[name].dataType) == "text"]
    if formats == "all" and texts:
        shapes = date_shapes(df, texts).groupBy("column_name").agg(F.min("min_date").alias("min_date"), F.max("max_date").alias("max_date"))
        listed = small_table(df.sparkSession, [(name,) for name in texts], "column_name string")
        found = listed.join(shapes, "column_name", "left")
        rest = [name for name in columns if name not in texts]
        return found.unionByName(datetime_stats(df, rest)) if rest else found
    firsts = _first_values(df, texts)
    items = []
    for name in columns:
        value = cell(fields[name])
        if name in firsts:
            shape, day_first = firsts[name]
            value = dates.parse_like(value, F.lit(shape), F.lit(day_first))
        else:
            value = value.cast("timestamp")
        items.append(({"column_name": name}, {"min_date": F.min(value), "max_date": F.max(value)}))
    return aggregate_long(df, items)


def _first_values(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[str | None, bool]]:
    """Date shape and day order of each column's first value: one row per column."""
    if not columns:
        return {}
    fields = field_map(df)
    ordered = with_row_order(df)
    firsts = [F.min_by(cell(fields[name]), F.when(cell(fields[name]).isNotNull(), F.col(ROW_ID))).alias(f"f{i}") for i, name in enumerate(columns)]
    probes = []
    for i in range(len(columns)):
        probes += [dates.shape_of(text.strip(F.col(f"f{i}"))).alias(f"s{i}"), dates.reads_day_first(F.col(f"f{i}")).alias(f"d{i}")]
    row = ordered.agg(*firsts).select(*probes).first()
    return {name: (row[f"s{i}"], bool(row[f"d{i}"])) for i, name in enumerate(columns)}


def top_values(
    df: DataFrame, columns: Sequence[str] | None = None, limit: int = 5, order_by: str | None = None, ties: str = "first_seen", grouping: str = "exact"
) -> DataFrame:
    """Most frequent values per column; ties in first-seen order, or by ``ties='value'``.

    Grouped by fingerprint, ``value`` is the MD5 of the text.
    """
    names = list(columns) if columns is not None else [f.name for f in fields_of(df, "text", "boolean")]
    counts = vc.value_counts(df, names, order_by, grouping=grouping)
    return vc.top_values(counts, limit, ties).select("column_name", "value", "n", "rank")


def missing_ranking(df: DataFrame) -> DataFrame:
    """Columns with nulls, most nulls first, table order on ties."""
    return column_nulls(df).where("null_count > 0").orderBy(F.desc("null_count"), "column_position")


def semantic_types(df: DataFrame, order_by: str | None = None, probe: str = "all") -> dict[str, str]:
    """Numeric, boolean, datetime or text per column.

    A text column counts as datetime when at least 80 % of its values are dates. With ``probe='first'`` it must have
    1 to 500 values, and only the first 50 of them are looked at.
    """
    types = {field.name: kind(field.dataType) for field in data_fields(df)}
    names = [name for name, family in types.items() if family == "text"]
    if names and probe == "all":
        types.update(_date_columns(df, names))
    elif names:
        fields = field_map(df)
        filled = df.agg(*[F.count(cell(fields[name])).alias(f"n{i}") for i, name in enumerate(names)]).first()
        types.update(_probe_dates(df, [name for i, name in enumerate(names) if 1 <= filled[i] <= DATE_PROBE_LIMIT], order_by))
    return types


def _date_columns(df: DataFrame, names: Sequence[str]) -> dict[str, str]:
    """The text columns that hold dates, judged by all values."""
    if not names:
        return {}
    shares = date_shapes(df, names).groupBy("column_name").agg((F.sum("dates") / F.sum("n")).alias("share"))
    return {row["column_name"]: "datetime" for row in shares.where(F.col("share") >= DATE_SHARE).collect()}


def _probe_dates(df: DataFrame, names: Sequence[str], order_by: str | None) -> dict[str, str]:
    if not names:
        return {}
    fields = field_map(df)
    long = vc.unpivot_cells(with_row_order(df, order_by), [(name, cell(fields[name])) for name in names], [ROW_ID])
    first = Window.partitionBy("column_name").orderBy(ROW_ID)
    probed = long.withColumn("at", F.row_number().over(first)).where(F.col("at") <= DATE_PROBED)
    shares = probed.groupBy("column_name").agg(F.avg(F.when(dates.parse_mixed_text(F.col("value")).isNotNull(), 1.0).otherwise(0.0)).alias("share"))
    return {row["column_name"]: "datetime" for row in shares.where(F.col("share") >= DATE_SHARE).collect()}


def type_breakdown(df: DataFrame, types: Mapping[str, str] | None = None) -> DataFrame:
    """Number of columns per semantic type."""
    types = types or semantic_types(df)
    rows = small_table(df.sparkSession, list(types.items()), "column_name string, semantic_type string")
    return rows.groupBy("semantic_type").agg(row_count().alias("columns"))


def type_classes(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Share of a text column's values that read as number, date or boolean, and the class that follows.

    ``mixed`` means that some but not all values parse as one of the types, ``unknown`` that the
    column has no values.
    """
    fields = field_map(df)
    names = list(columns) if columns is not None else [f.name for f in fields_of(df, "text")]
    items = []
    for name in names:
        value = cell(fields[name])
        filled = value.isNotNull() & ~text.is_blank(value)
        measures = {
            "value_count": count_where(filled),
            "numeric_count": count_where(filled & casts.to_double(value, fields[name].dataType).isNotNull() & ~F.lower(text.strip(value)).isin("true", "false")),
            "date_count": count_where(filled & dates.parse_mixed_text(value).isNotNull()),
            "boolean_count": count_where(F.lower(text.strip(value)).isin("true", "false")),
        }
        items.append(({"column_name": name}, measures))
    n = F.col("value_count")
    best = F.greatest("numeric_count", "date_count", "boolean_count")
    label = (
        F.when(n == 0, "unknown")
        .when(F.col("numeric_count") == n, "numeric")
        .when(F.col("date_count") == n, "date")
        .when(F.col("boolean_count") == n, "boolean")
        .when(best > 0, "mixed")
        .otherwise("text")
    )
    return aggregate_long(df, items).withColumn("type_class", label)


def category_distribution(df: DataFrame, column: str) -> DataFrame:
    """Frequency of every value, nulls included, most frequent first."""
    field = field_map(df)[column]
    return df.groupBy(cell(field).alias("value")).agg(row_count().alias("n")).orderBy(F.desc("n"), "value")


def padding_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Cells with white space at an end, per text column that has any."""
    fields = field_map(df)
    names = list(columns) if columns is not None else [f.name for f in fields_of(df, "text")]
    items = [({"column_name": name}, {"padded": count_where(cell(fields[name]) != text.strip(cell(fields[name])))}) for name in names]
    return aggregate_long(df, items).where("padded > 0")


def duplicate_report(df: DataFrame, subset: Sequence[str] | None = None, method: str = "exact") -> DataFrame:
    """Rows beyond the first copy, their share, and all rows that have a copy."""
    return duplicates.duplicate_counts(df, subset, method).withColumn("duplicate_percentage", ratio_percent(F.col("duplicate_rows"), F.col("total_rows")))


def preview(df: DataFrame, n: int = 5, order_by: str | None = None, tail: bool = False) -> DataFrame:
    """First or last rows in row order."""
    key = F.col(ROW_ID)
    return with_row_order(df, order_by).orderBy(key.desc() if tail else key.asc()).limit(n).drop(ROW_ID)


# -- the whole profile ---------------------------------------------------------------------


@dataclass
class TableProfile:
    """Dataset summary, one record per column, and the columns with missing values, worst first."""

    summary: dict[str, Any]
    columns: dict[str, dict[str, Any]]
    missing_rankings: list[dict[str, Any]] = dataclass_field(default_factory=list)

    def to_dict(self) -> dict[str, Any]:
        return {"summary": self.summary, "columns": self.columns, "missing_rankings": self.missing_rankings}

    def to_json(self, indent: int = 2) -> str:
        return json.dumps(self.to_dict(), indent=indent, default=str, ensure_ascii=False)


def percent(part: int, whole: int) -> float:
    return round(part / whole * 100, 2) if whole else 0.0


def _fused_pass(df: DataFrame) -> dict[str, dict[str, Any]]:
    """Every figure that needs no shuffle, for all columns, from one scan (60 aggregates a pass)."""
    measures: list[tuple[str, str, Column]] = []
    for field in data_fields(df):
        value, family = cell(field), kind(field.dataType)
        wanted: dict[str, Column] = {"rows": row_count(), "nulls": count_where(value.isNull())}
        if family == "numeric":
            number = value.cast("double")
            wanted |= {"min": F.min(number), "max": F.max(number), "mean": F.avg(number), "std": F.stddev_samp(number)}
        elif family in ("text", "boolean"):
            shown = as_text(field)
            length = F.length(shown)
            wanted |= {"min_length": F.min(length), "max_length": F.max(length), "avg_length": F.avg(length)}
        elif family == "datetime":
            wanted |= {"min_date": F.min(value).cast("string"), "max_date": F.max(value).cast("string")}
        if family in ("text", "other"):
            wanted["bytes"] = F.coalesce(F.sum(F.octet_length(as_text(field))), F.lit(0))
        measures += [(field.name, key, measure) for key, measure in wanted.items()]
    found: dict[str, dict[str, Any]] = {}
    for part in chunks(measures, AGGREGATES_PER_PASS):
        row = df.agg(*[measure.alias(f"m{i}") for i, (_, _, measure) in enumerate(part)]).first()
        for i, (name, key, _) in enumerate(part):
            found.setdefault(name, {})[key] = row[i]
    return found


def value_summary(df: DataFrame, names: Sequence[str], top_n: int = 5, order_by: str | None = None, grouping: str = "exact") -> DataFrame:
    """Distinct count (rank 0) and most frequent values (rank 1 ...) of text and boolean columns.

    One query, so that the scans and shuffles of the two halves overlap.
    """
    counts = vc.value_counts(df, names, order_by, grouping=grouping)
    none = F.lit(None)
    per_column = counts.groupBy("column_name").agg(row_count().alias("unique"), F.sum("n").alias("n"))
    totals = per_column.select("column_name", none.cast("string").alias("value"), "n", F.lit(0).alias("rank"), "unique")
    tops = vc.top_values(counts, top_n).select("column_name", "value", "n", "rank", none.cast("bigint").alias("unique"))
    return totals.unionByName(tops)


def profile(
    df: DataFrame,
    top_n: int = 5,
    order_by: str | None = None,
    grouping: str = "exact",
    approximate: bool = False,
    duplicate_rows: int | None = None,
    date_rule: str = "all",
) -> TableProfile:
    """Profile a table. What comes back to the driver is a few rows per column.

    ``approximate`` estimates the distinct counts of numeric and date columns from sketches, which
    spares them a shuffle. ``grouping='fingerprint'`` groups rows and texts by 128-bit digests instead
    of shuffling them. ``duplicate_rows`` hands in a count that is already known. ``date_rule='first'`` judges text dates
    by the first values of small columns and the format of the first one, instead of by all values.
    """
    fields = data_fields(df)
    names = [field.name for field in fields]
    if not fields:
        return TableProfile(_summary(0, 0, 0, 0, 0, {}), {})
    seen = _fused_pass(df)
    rows = seen[names[0]]["rows"]
    nulls = {name: seen[name]["nulls"] for name in names}
    filled = {name: rows - nulls[name] for name in names}
    types = {field.name: kind(field.dataType) for field in fields}
    textual = [name for name in names if types[name] == "text" and filled[name]]
    probed = [name for name in textual if filled[name] <= DATE_PROBE_LIMIT]
    numeric = [name for name in names if types[name] == "numeric" and filled[name]]
    worded = [name for name in names if types[name] in ("text", "boolean")]
    others = [name for name in names if name not in worded]
    dates_found, quartiles, summaries, counted, copies = run_together(
        df.sparkSession,
        lambda: _date_columns(df, textual) if date_rule == "all" else _probe_dates(df, probed, order_by),
        lambda: exact_quantiles(df, numeric, [0.25, 0.5, 0.75], filled),
        lambda: value_summary(df, worded, top_n, order_by, grouping).collect() if rows and worded else [],
        lambda: vc.distinct_counts(df, others, approximate).collect() if rows and others else [],
        lambda: _known_or(duplicate_rows, lambda: duplicates.duplicate_counts(df, method=grouping).first()["duplicate_rows"] if rows else 0),
    )
    types.update(dates_found)
    unique = {row["column_name"]: row["unique_count"] for row in counted}
    frequent: dict[str, dict[str, int]] = {name: {} for name in worded}
    texts = vc.texts_behind(df, [(r["column_name"], r["value"]) for r in summaries if r["rank"]]) if grouping == "fingerprint" else {}
    for row in sorted(summaries, key=lambda row: row["rank"]):
        if row["rank"] == 0:
            unique[row["column_name"]] = row["unique"]
        else:
            frequent[row["column_name"]][texts.get((row["column_name"], row["value"]), row["value"])] = row["n"]
    calendar = {}
    if dates_found:
        spans = datetime_stats(df, list(dates_found), date_rule).select("column_name", *[F.col(c).cast("string").alias(c) for c in ("min_date", "max_date")])
        calendar = _by_column(spans)

    columns: dict[str, dict[str, Any]] = {}
    for field in fields:
        name = field.name
        found, type_ = seen[name], types[name]
        numbers = texts_ = when = None
        if type_ == "numeric" and filled[name]:
            q25, q50, q75 = quartiles[name]
            numbers = {"min": found["min"], "max": found["max"], "mean": _round(found["mean"], 4), "median": _round(q50, 4)}
            numbers |= {"std": _round(found["std"], 4) if filled[name] > 1 else 0.0, "q25": _round(q25, 4), "q75": _round(q75, 4)}
        elif type_ == "datetime" and filled[name]:
            span = calendar.get(name, found)
            when = {key: span[key] for key in ("min_date", "max_date")} if span["min_date"] is not None else None
        elif type_ in ("text", "boolean") and filled[name]:
            texts_ = {"min_length": found["min_length"], "max_length": found["max_length"], "avg_length": _round(found["avg_length"], 2), "top_values": frequent[name]}
        columns[name] = {
            "name": name,
            "dtype": field.dataType.simpleString(),
            "semantic_type": type_,
            "total_count": rows,
            "null_count": nulls[name],
            "null_percentage": percent(nulls[name], rows),
            "unique_count": unique.get(name, 0),
            "unique_percentage": percent(unique.get(name, 0), rows),
            "numeric_stats": numbers,
            "text_stats": texts_,
            "datetime_stats": when,
        }
    ranking = sorted((c for c in columns.values() if c["null_count"]), key=lambda c: -c["null_count"])
    size = sum(seen[f.name].get("bytes", FIXED_BYTES.get(kind(f.dataType), 0) * rows) for f in fields) if rows else 0
    breakdown: dict[str, int] = {}
    for name in names:
        breakdown[types[name]] = breakdown.get(types[name], 0) + 1
    keep = ("null_count", "null_percentage", "semantic_type")
    return TableProfile(
        _summary(rows, len(names), sum(nulls.values()), copies, size, breakdown),
        columns,
        [{"column": c["name"], **{key: c[key] for key in keep}} for c in ranking],
    )


def _known_or(known: int | None, count: Callable[[], int]) -> int:
    return count() if known is None else known


def _round(value: float | None, digits: int) -> float | None:
    return value if value is None or value in (float("inf"), float("-inf")) else round(value, digits)


def _by_column(stats: DataFrame) -> dict[str, dict[str, Any]]:
    return {row["column_name"]: row.asDict() for row in stats.collect()}


def _summary(rows: int, columns: int, missing: int, copies: int, size: int, breakdown: dict[str, int]) -> dict[str, Any]:
    return {
        "total_rows": rows,
        "total_columns": columns,
        "total_cells": rows * columns,
        "total_missing_cells": missing,
        "missing_percentage": percent(missing, rows * columns),
        "duplicate_rows": copies,
        "duplicate_percentage": percent(copies, rows),
        "memory_bytes": size,
        "column_types_breakdown": breakdown,
    }
