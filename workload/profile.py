"""Profile queries (P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from veracol.operators import profile as P
from veracol.functions.frames import small_table

from .inputs import DIRTY, DIRTY_COLUMNS, DIRTY_TEXTS, derive, dirty, table
from .registry import query, union_all

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
NULLS_SQL = union_all(
    [f"SELECT {i} AS column_position, '{c}' AS column_name, count(*) - count({c}) AS null_count, count(*) AS total_count FROM dirty" for i, c in enumerate(DIRTY_COLUMNS)]
)


@query("p01_table_shape", "SELECT count(*) AS total_rows, CAST(11 AS BIGINT) AS total_columns, count(*) * 11 AS total_cells FROM lineitem")
def table_shape(spark, sf_dir):
    return P.table_shape(table(spark, sf_dir, "lineitem"))


@query(
    "p02_missing_cells",
    f"{DIRTY} SELECT CAST(sum(null_count) AS BIGINT) AS missing_cells, CAST(sum(total_count) AS BIGINT) AS total_cells, "
    f"round(CAST(sum(null_count) AS DOUBLE) / CAST(sum(total_count) AS DOUBLE) * 100, 6) AS missing_percentage FROM ({NULLS_SQL})",
)
def missing_cells(spark, sf_dir):
    return P.missing_cells(dirty(spark, sf_dir)).withColumn("missing_percentage", F.round("missing_percentage", 6))


_COPIES = "CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS affected_rows, CAST(sum(n) AS BIGINT) AS total_rows"


@query("p03_duplicate_rows", f"{DIRTY} SELECT {_COPIES} FROM (SELECT count(*) AS n FROM dirty GROUP BY {', '.join(DIRTY_COLUMNS)})")
def duplicate_rows(spark, sf_dir):
    return P.duplicates.duplicate_counts(dirty(spark, sf_dir))


@query("p03_duplicate_rows_fingerprint", f"SELECT {_COPIES} FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang)")
def duplicate_rows_fingerprint(spark, sf_dir):
    return P.duplicates.duplicate_counts(table(spark, sf_dir, "documents").select("text", "lang"), method="fingerprint")


@query("p05_column_nulls", f"{DIRTY} SELECT *, round(CAST(null_count AS DOUBLE) / total_count * 100, 6) AS null_percentage FROM ({NULLS_SQL})")
def column_nulls(spark, sf_dir):
    return P.column_nulls(dirty(spark, sf_dir)).withColumn("null_percentage", F.round("null_percentage", 6))


_ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query(
    "p06_distinct_counts",
    union_all(
        [
            f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS unique_count, round(CAST(count(DISTINCT {c}) AS DOUBLE) / count(*) * 100, 6) AS unique_percentage FROM orders"
            for c in _ORDER_COLUMNS
        ]
    ),
)
def distinct_counts(spark, sf_dir):
    return P.column_distincts(table(spark, sf_dir, "orders")).withColumn("unique_percentage", F.round("unique_percentage", 6))


_SUPPLIER_DATES = """SELECT s_suppkey, s_name, s_acctbal, 'September ' || CAST(1 + s_suppkey % 28 AS VARCHAR(20)) || ', 2021' AS worded,
lpad(CAST(1 + s_suppkey % 12 AS VARCHAR(20)), 2, '0') || '/' || lpad(CAST(1 + s_suppkey % 28 AS VARCHAR(20)), 2, '0') || '/2021' AS slashed, s_acctbal < 0 AS overdrawn FROM {supplier}"""
_SUPPLIER_SQL = f"WITH s AS ({_SUPPLIER_DATES.replace('{supplier}', 'supplier')})"


@query(
    "p07_semantic_types",
    f"{_SUPPLIER_SQL} "
    + union_all(
        [
            "SELECT 's_suppkey' AS column_name, 'numeric' AS semantic_type",
            "SELECT 's_name', 'text'",
            "SELECT 's_acctbal', 'numeric'",
            "SELECT 'worded', CASE WHEN count(worded) BETWEEN 1 AND 500 THEN 'datetime' ELSE 'text' END FROM s",
            "SELECT 'slashed', CASE WHEN count(slashed) BETWEEN 1 AND 500 THEN 'datetime' ELSE 'text' END FROM s",
            "SELECT 'overdrawn', 'boolean'",
        ]
    ),
)
def semantic_types(spark, sf_dir):
    """The rule that looks at the first values of small columns only."""
    types = P.semantic_types(derive(spark, sf_dir, _SUPPLIER_DATES, "supplier"), probe="first")
    return small_table(spark, list(types.items()), "column_name string, semantic_type string")


_READ = "coalesce(try_strptime(joined, '%Y-%m-%d'), try_strptime(joined, '%m/%d/%Y'), try_strptime(joined, '%B %d, %Y'))"


@query(
    "p07_semantic_types_all",
    f"{DIRTY}, x AS ({_SUPPLIER_SQL.removeprefix('WITH s AS (').removesuffix(')')}) "
    + union_all([f"SELECT '{c}' AS column_name, '{t}' AS semantic_type" for c, t in (("s_suppkey", "numeric"), ("s_name", "text"), ("s_acctbal", "numeric"), ("worded", "datetime"), ("slashed", "datetime"), ("overdrawn", "boolean"))])
    + f" UNION ALL SELECT 'joined', CASE WHEN count({_READ}) >= 0.8 * count(joined) THEN 'datetime' ELSE 'text' END FROM dirty",
)
def semantic_types_all(spark, sf_dir):
    """Types by all values, at any size."""
    types = P.semantic_types(derive(spark, sf_dir, _SUPPLIER_DATES, "supplier")) | P.semantic_types(dirty(spark, sf_dir).select("joined"))
    return small_table(spark, list(types.items()), "column_name string, semantic_type string")


def _stats_sql(column: str, source: str, label: str | None = None) -> str:
    q = f"quantile_cont(CAST({column} AS DOUBLE), "
    return (
        f"SELECT '{label or column}' AS column_name, count({column}) AS value_count, CAST(min({column}) AS DOUBLE) AS min, CAST(max({column}) AS DOUBLE) AS max, "
        f"round(avg({column}), 4) AS mean, round({q}0.5), 4) AS median, round(stddev_samp({column}), 4) AS std, round({q}0.25), 4) AS q25, round({q}0.75), 4) AS q75 FROM {source}"
    )


@query("p08_numeric_stats", union_all([_stats_sql(c, "lineitem") for c in LINE_NUMBERS]))
def numeric_stats(spark, sf_dir):
    return P.numeric_stats(table(spark, sf_dir, "lineitem").select(*LINE_NUMBERS))


@query("p08_numeric_stats_searched", _stats_sql("l_extendedprice", "lineitem"))
def numeric_stats_searched(spark, sf_dir):
    """Few buckets, so that ranks take several rounds of narrowing."""
    return P.numeric_stats(table(spark, sf_dir, "lineitem").select("l_extendedprice"), buckets=32)


def _date_sql(column: str, source: str) -> str:
    return f"SELECT '{column}' AS column_name, strftime(min({column}), '%Y-%m-%d %H:%M:%S') AS min_date, strftime(max({column}), '%Y-%m-%d %H:%M:%S') AS max_date FROM {source}"


def _shown_dates(stats):
    return stats.select("column_name", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("min_date", "max_date")])


@query("p09_datetime_stats", _date_sql("o_orderdate", "orders"))
def datetime_stats(spark, sf_dir):
    return _shown_dates(P.datetime_stats(table(spark, sf_dir, "orders"), ["o_orderdate"]))


@query(
    "p09_datetime_stats_text",
    f"{_SUPPLIER_SQL}, t AS (SELECT strptime(worded, '%B %d, %Y') AS worded, strptime(slashed, '%m/%d/%Y') AS slashed FROM s) "
    + union_all([_date_sql("worded", "t"), _date_sql("slashed", "t")]),
)
def datetime_stats_text(spark, sf_dir):
    return _shown_dates(P.datetime_stats(derive(spark, sf_dir, _SUPPLIER_DATES, "supplier"), ["worded", "slashed"]))


@query(
    "p09_date_shapes",
    f"{DIRTY} SELECT CASE WHEN regexp_full_match(joined, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}') THEN 'iso' WHEN regexp_full_match(joined, '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}') THEN 'numeric' WHEN joined LIKE 'September %' THEN 'month_first' END AS shape, "
    f"count(*) AS n, count({_READ}) AS dates, strftime(min({_READ}), '%Y-%m-%d') AS min_date, strftime(max({_READ}), '%Y-%m-%d') AS max_date FROM dirty WHERE joined IS NOT NULL GROUP BY 1",
)
def date_shapes(spark, sf_dir):
    """How the values of a text column are written, how many are dates, and from when to when."""
    shapes = P.date_shapes(dirty(spark, sf_dir), ["joined"]).drop("column_name")
    return shapes.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("min_date", "max_date")})


@query("p09_datetime_stats_mixed", f"{DIRTY}, t AS (SELECT {_READ} AS joined FROM dirty) {_date_sql('joined', 't')}")
def datetime_stats_mixed(spark, sf_dir):
    return _shown_dates(P.datetime_stats(dirty(spark, sf_dir), ["joined"]))


@query(
    "p10_text_stats",
    union_all(
        [f"SELECT '{c}' AS column_name, CAST(min(length({c})) AS INTEGER) AS min_length, CAST(max(length({c})) AS INTEGER) AS max_length, round(avg(length({c})), 2) AS avg_length FROM documents" for c in ("text", "lang", "source")]
    ),
)
def text_stats(spark, sf_dir):
    return P.text_stats(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def _top_sql(column: str, source: str) -> str:
    return (
        f"SELECT '{column}' AS column_name, value, n, rank FROM (SELECT {column} AS value, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, {column}) AS INTEGER) AS rank "
        f"FROM {source} WHERE {column} IS NOT NULL GROUP BY {column}) WHERE rank <= 5"
    )


@query("p11_top_values", f"{DIRTY} " + union_all([_top_sql(c, "dirty") for c in DIRTY_TEXTS]))
def top_values(spark, sf_dir):
    return P.top_values(dirty(spark, sf_dir), DIRTY_TEXTS, ties="value")


@query(
    "p11_top_values_fingerprint",
    "SELECT column_name, md5(value) AS value, n FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, md5({c})) AS pos FROM documents GROUP BY {c}" for c in ("text", "source"))
    + ") WHERE pos <= 5",
)
def top_values_fingerprint(spark, sf_dir):
    """Long texts are grouped by digest, which is also what is shown."""
    documents = table(spark, sf_dir, "documents").select("text", "source")
    return P.top_values(documents, ["text", "source"], ties="value", grouping="fingerprint").select("column_name", "value", "n")


@query("p12_missing_ranking", f"{DIRTY} SELECT column_position, column_name, null_count, total_count FROM ({NULLS_SQL}) WHERE null_count > 0")
def missing_ranking(spark, sf_dir):
    return P.missing_ranking(dirty(spark, sf_dir)).drop("null_percentage")


@query(
    "p13_type_breakdown",
    f"{DIRTY} SELECT semantic_type, count(*) AS columns FROM ("
    + union_all(["SELECT 'numeric' AS semantic_type", "SELECT 'numeric'", *[f"SELECT CASE WHEN count({c}) > 0 THEN 'text' END FROM dirty" for c in DIRTY_TEXTS]])
    + ") GROUP BY semantic_type",
)
def type_breakdown(spark, sf_dir):
    return P.type_breakdown(dirty(spark, sf_dir))


@query(
    "p14_duplicate_report",
    f"SELECT *, round(CAST(duplicate_rows AS DOUBLE) / total_rows * 100, 6) AS duplicate_percentage FROM (SELECT {_COPIES} FROM (SELECT count(*) AS n FROM documents GROUP BY text))",
)
def duplicate_report(spark, sf_dir):
    return P.duplicate_report(table(spark, sf_dir, "documents"), ["text"]).withColumn("duplicate_percentage", F.round("duplicate_percentage", 6))


@query(
    "p14_duplicate_listing",
    "SELECT doc_id, md5(text) AS digest FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)",
)
def duplicate_listing(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return P.duplicates.copies_of_keys(documents, ["text"]).select("doc_id", F.md5("text").alias("digest"))


@query("p15_composite_key_duplicates", f"SELECT {_COPIES} FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_suppkey)")
def composite_key_duplicates(spark, sf_dir):
    return P.duplicates.duplicate_counts(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_suppkey"])


@query("p16_category_distribution", f"{DIRTY} SELECT joined AS value, count(*) AS n FROM dirty GROUP BY joined")
def category_distribution(spark, sf_dir):
    return P.category_distribution(dirty(spark, sf_dir), "joined")


@query(
    "p17_describe",
    "SELECT column_name, value_count, mean, std, min, median, max FROM (" + union_all([_stats_sql("o_orderkey", "orders"), _stats_sql("o_custkey", "orders"), _stats_sql("o_totalprice", "orders")]) + ")",
)
def describe(spark, sf_dir):
    return P.describe_numeric(table(spark, sf_dir, "orders"))


@query("p18_padding_counts", f"{DIRTY} SELECT * FROM (" + union_all([f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} <> trim({c})) AS padded FROM dirty" for c in DIRTY_TEXTS]) + ") WHERE padded > 0")
def padding_counts(spark, sf_dir):
    return P.padding_counts(dirty(spark, sf_dir))


_LOOSE = """SELECT CASE c_custkey % 3 WHEN 0 THEN CAST(c_acctbal AS VARCHAR(20)) WHEN 1 THEN 'n/k' ELSE CAST(c_custkey AS VARCHAR(20)) END AS amount,
CAST(c_nationkey AS VARCHAR(20)) AS nation, CASE WHEN c_acctbal < 0 THEN 'true' ELSE 'FALSE' END AS owes, c_mktsegment AS segment,
CASE c_custkey % 2 WHEN 0 THEN '2021-09-05' ELSE '05/09/2021' END AS day, CAST(NULL AS VARCHAR(20)) AS nothing FROM {customer}"""


@query(
    "p19_type_classes",
    f"WITH t AS ({_LOOSE.replace('{customer}', 'customer')}), c AS ("
    + union_all(
        [
            f"SELECT '{c}' AS column_name, count({c}) AS value_count, count(TRY_CAST({c} AS DOUBLE)) AS numeric_count, "
            f"count(*) FILTER (WHERE regexp_matches({c}, '^(2021-09-05|05/09/2021)$')) AS date_count, count(*) FILTER (WHERE lower({c}) IN ('true', 'false')) AS boolean_count FROM t"
            for c in ("amount", "nation", "owes", "segment", "day", "nothing")
        ]
    )
    + ") SELECT *, CASE WHEN value_count = 0 THEN 'unknown' WHEN numeric_count = value_count THEN 'numeric' WHEN date_count = value_count THEN 'date' "
    "WHEN boolean_count = value_count THEN 'boolean' WHEN greatest(numeric_count, date_count, boolean_count) > 0 THEN 'mixed' ELSE 'text' END AS type_class FROM c",
)
def type_classes(spark, sf_dir):
    return P.type_classes(derive(spark, sf_dir, _LOOSE, "customer"))
