"""Query inputs: the given tables, a dirtied customer table and catalogue tables derived from orders.

The given tables hold no nulls and no repeated rows, so defects are derived from them in portable
SQL. The same text feeds Spark and the comparison engine.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

_DIRTY_BASE = """
SELECT c_custkey AS id,
       CASE c_custkey % 5 WHEN 0 THEN '  ' || c_name WHEN 1 THEN c_name || ' ' ELSE c_name END AS name,
       CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN 'broken_' || CAST(c_custkey AS VARCHAR(20)) WHEN c_custkey % 19 = 0 THEN '   ' ELSE 'user' || CAST(c_custkey AS VARCHAR(20)) || '@example.com' END AS email,
       CASE c_custkey % 3 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN upper(c_mktsegment) ELSE upper(substr(c_mktsegment,1,1)) || lower(substr(c_mktsegment,2)) END AS segment,
       CASE WHEN c_custkey % 17 = 0 THEN CAST(NULL AS DOUBLE) WHEN c_custkey % 101 = 0 THEN c_acctbal * 1000 ELSE c_acctbal END AS balance,
       CASE WHEN c_custkey % 23 = 0 THEN '=' || c_name WHEN c_custkey % 29 = 0 THEN '@' || c_name ELSE 'ok' END AS note,
       CASE c_custkey % 6 WHEN 0 THEN '2021-09-' || lpad(CAST(1 + c_custkey % 28 AS VARCHAR(20)),2,'0') WHEN 1 THEN '09/' || lpad(CAST(1 + c_custkey % 28 AS VARCHAR(20)),2,'0') || '/2021' WHEN 2 THEN 'September ' || CAST(1 + c_custkey % 28 AS VARCHAR(20)) || ', 2021' WHEN 3 THEN '2023-02-29' WHEN 4 THEN 'not_a_date' ELSE NULL END AS joined
FROM {customer}
"""
_DIRTY_ALL = "SELECT * FROM b UNION ALL SELECT * FROM b WHERE id % 50 = 0"

DIRTY_COLUMNS = ["id", "name", "email", "segment", "balance", "note", "joined"]
DIRTY_TEXTS = ["name", "email", "segment", "note", "joined"]

_GOV = {
    "gov_datasets": """
SELECT c_custkey AS id, c_name AS name, CAST(NULL AS VARCHAR(20)) AS description,
  c_name || CASE c_custkey % 4 WHEN 0 THEN '.csv' WHEN 1 THEN '.XLSX' WHEN 2 THEN '.xls' ELSE '.json' END AS original_filename,
  'user_' || CAST(c_nationkey AS VARCHAR(20)) AS user_id, TIMESTAMP '1995-01-01 00:00:00' AS created_at, TIMESTAMP '1995-01-01 00:00:00' AS updated_at FROM {customer}
""",
    "gov_versions": """
SELECT o_orderkey AS id, o_custkey AS dataset_id,
  CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS version_number,
  lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent_version_id,
  'snapshots/' || CAST(o_orderkey AS VARCHAR(20)) AS storage_path, 'parquet' AS file_format,
  CAST(floor(o_totalprice) AS BIGINT) AS row_count, 8 + o_orderkey % 5 AS column_count,
  CAST(floor(o_totalprice * 40) AS BIGINT) AS file_size_bytes, o_orderdate AS created_at FROM {orders}
""",
    "gov_scores": """
SELECT o_orderkey AS id, o_orderkey AS version_id,
  CAST(100 - o_orderkey % 41 AS DOUBLE) AS completeness_score, CAST(100 - o_orderkey % 37 AS DOUBLE) AS validity_score,
  CAST(100 - o_orderkey % 29 AS DOUBLE) AS uniqueness_score, CAST(100 - o_orderkey % 23 AS DOUBLE) AS consistency_score,
  CAST(3 * (100 - o_orderkey % 41) + 3 * (100 - o_orderkey % 37) + 2 * (100 - o_orderkey % 29) + 2 * (100 - o_orderkey % 23) AS DOUBLE) / CAST(10 AS DOUBLE) AS overall_score,
  o_orderdate AS created_at, o_orderkey % 9 <> 0 AS scored FROM {orders}
""",
    "gov_scorecards": """
SELECT id, version_id, overall_score,
  CASE WHEN overall_score >= 90 THEN 'A' WHEN overall_score >= 80 THEN 'B' WHEN overall_score >= 70 THEN 'C' WHEN overall_score >= 60 THEN 'D' ELSE 'F' END AS grade,
  'label' AS grade_label, completeness_score, validity_score, uniqueness_score, consistency_score, overall_score >= 80 AS is_trustworthy, created_at, scored
FROM {gov_scores}
""",
    "gov_reports": """
SELECT id, version_id, overall_score, grade, grade_label, completeness_score, validity_score, uniqueness_score, consistency_score, is_trustworthy, created_at
FROM {gov_scorecards} WHERE scored
""",
    "gov_issues": """
SELECT l_orderkey * 100 + l_linenumber * 10 + l_suppkey % 10 AS id, l_orderkey AS report_id,
  CASE l_linenumber % 4 WHEN 0 THEN 'missing' WHEN 1 THEN 'DUPLICATE' WHEN 2 THEN 'OUTLIER' ELSE 'INVALID_RANGE' END AS category,
  CASE l_returnflag WHEN 'A' THEN 'critical' WHEN 'N' THEN 'WARNING' ELSE 'INFO' END AS severity,
  CASE WHEN l_linenumber % 4 = 1 THEN NULL ELSE 'col_' || CAST(l_partkey % 7 AS VARCHAR(20)) END AS column_name,
  'line ' || CAST(l_linenumber AS VARCHAR(20)) AS description,
  CAST(l_quantity AS BIGINT) AS affected_count, CAST(l_linenumber AS DOUBLE) AS affected_percentage, CAST(NULL AS VARCHAR(20)) AS suggested_action, l_shipdate AS created_at FROM {lineitem}
""",
    "gov_jobs": """
SELECT id, parent_version_id AS source_version_id, id AS target_version_id,
  1 + id % 7 AS total_operations, row_count % 500 AS rows_modified, CAST(id % 31 - 10 AS DOUBLE) / CAST(2 AS DOUBLE) AS quality_score_delta,
  '[{"step_number":1,"operation":"strip_whitespace","target_column":null,"rows_affected":' || CAST(row_count % 500 AS VARCHAR(20)) ||
  '},{"step_number":2,"operation":"' || CASE WHEN id % 2 = 0 THEN 'fill_mean' ELSE 'drop_duplicates' END || '","target_column":"amount","rows_affected":' || CAST(id % 97 AS VARCHAR(20)) || '}]' AS execution_log_json,
  created_at FROM {gov_versions} WHERE parent_version_id IS NOT NULL
""",
}


def _plain(text: str) -> str:
    """Fill the placeholders with table names, leaving literal JSON braces alone."""
    for name in ("customer", "orders", "lineitem", *_GOV):
        text = text.replace("{" + name + "}", name)
    return text.strip()


DIRTY = f"WITH b AS ({_plain(_DIRTY_BASE)}), dirty AS ({_DIRTY_ALL})"
GOV = "WITH " + ", ".join(f"{name} AS ({_plain(text)})" for name, text in _GOV.items())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(spark: SparkSession, text: str, **frames: DataFrame) -> DataFrame:
    """Run SQL over frames; the views have names of their own and are dropped afterwards."""
    views = {}
    for name, frame in frames.items():
        views[name] = f"w_{name}_{uuid.uuid4().hex}"
        frame.createOrReplaceTempView(views[name])
        text = text.replace("{" + name + "}", views[name])
    try:
        return spark.sql(text)
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _sql(spark, _DIRTY_BASE, customer=table(spark, sf_dir, "customer"))
    return base.unionAll(base.where("id % 50 = 0"))


def derive(spark: SparkSession, sf_dir: str, text: str, *tables: str) -> DataFrame:
    """A projection of given tables, written once for both engines with ``{table}`` placeholders."""
    return _sql(spark, text, **{name: table(spark, sf_dir, name) for name in tables})


# Customers with more orders than one task should sort.
LARGE_CUSTOMER = 1_000_000


def _versions(orders: DataFrame, large: int = LARGE_CUSTOMER) -> DataFrame:
    """The orders of a customer as versions of a dataset, numbered by date.

    A window per customer is fine for most. Customers above the limit, found by a count first, are
    numbered day by day.
    """
    sizes = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > large).select("o_custkey")
    if sizes.isEmpty():
        placed = _numbered(orders)
    else:
        hot = F.broadcast(sizes)  # at most rows / limit customers
        placed = _numbered(orders.join(hot, "o_custkey", "left_anti")).unionByName(_numbered_by_day(orders.join(hot, "o_custkey", "left_semi")))
    return placed.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("dataset_id"),
        "version_number",
        "parent_version_id",
        F.concat(F.lit("snapshots/"), F.col("o_orderkey").cast("string")).alias("storage_path"),
        F.lit("parquet").alias("file_format"),
        F.floor("o_totalprice").cast("bigint").alias("row_count"),
        (F.lit(8) + F.col("o_orderkey") % 5).alias("column_count"),
        F.floor(F.col("o_totalprice") * 40).cast("bigint").alias("file_size_bytes"),
        F.col("o_orderdate").alias("created_at"),
    )


_ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")


def _numbered(orders: DataFrame) -> DataFrame:
    in_order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return orders.select(
        *_ORDER_COLUMNS, F.row_number().over(in_order).cast("bigint").alias("version_number"), F.lag("o_orderkey").over(in_order).alias("parent_version_id")
    )


def _numbered_by_day(orders: DataFrame) -> DataFrame:
    """Numbers within a day, plus what the customer's earlier days, one row each, add up to."""
    ordered = orders.select(*_ORDER_COLUMNS, F.to_date("o_orderdate").alias("day"))
    last = F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey"))
    days = ordered.groupBy("o_custkey", "day").agg(F.count(F.lit(1)).alias("n"), last.alias("last"))
    by_day = Window.partitionBy("o_custkey").orderBy("day")
    before = F.coalesce(F.sum("n").over(by_day.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    earlier = days.select("o_custkey", "day", before.alias("before"), F.lag("last").over(by_day).alias("previous"))
    in_day = Window.partitionBy("o_custkey", "day").orderBy("o_orderdate", "o_orderkey")
    placed = ordered.withColumn("place", F.row_number().over(in_day)).withColumn("left", F.lag("o_orderkey").over(in_day))
    return placed.join(earlier, ["o_custkey", "day"]).select(
        *_ORDER_COLUMNS, (F.col("before") + F.col("place")).cast("bigint").alias("version_number"), F.coalesce("left", "previous").alias("parent_version_id")
    )


class GovTables(Mapping):
    """Catalogue tables in the catalogue's own schema, each planned when it is first used."""

    _names = {"datasets": "gov_datasets", "versions": "gov_versions", "reports": "gov_reports", "issues": "gov_issues", "jobs": "gov_jobs", "scorecards": "gov_scorecards"}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._sf_dir = spark, sf_dir
        self._frames: dict[str, DataFrame] = {}

    def _frame(self, name: str) -> DataFrame:
        if name not in self._frames:
            if name == "gov_versions":
                self._frames[name] = _versions(self._frame("orders"))
            elif name not in _GOV:
                self._frames[name] = table(self._spark, self._sf_dir, name)
            else:
                used = [other for other in ("customer", "orders", "lineitem", *_GOV) if "{" + other + "}" in _GOV[name]]
                self._frames[name] = _sql(self._spark, _GOV[name], **{other: self._frame(other) for other in used})
        return self._frames[name]

    def __getitem__(self, name: str) -> DataFrame:
        frame = self._frame(self._names[name])
        return frame.drop("scored") if name == "scorecards" else frame

    def __iter__(self):
        return iter(self._names)

    def __len__(self) -> int:
        return len(self._names)


def gov(spark: SparkSession, sf_dir: str) -> GovTables:
    return GovTables(spark, sf_dir)
