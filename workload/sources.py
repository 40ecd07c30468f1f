"""Source and sink queries (S): written to the shared scratch folder and read back."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from veracol.functions.frames import small_table
from veracol.plans import mart
from veracol.plans.catalog import Catalog
from veracol.session import scratch_path
from veracol.sources import csv_source, sinks
from veracol.sources.landing import screen_files
from veracol.sources.row_order import read_parquet_in_order

from .inputs import DIRTY, DIRTY_COLUMNS, GOV, derive, dirty, gov
from .registry import query, union_all

ALL = ", ".join(DIRTY_COLUMNS)


def _landed_csv(spark, sf_dir) -> str:
    path = scratch_path(spark, "dirty-csv")
    dirty(spark, sf_dir).write.options(**sinks.CSV_OPTIONS).csv(path)
    return path


@query("s01_csv_scan", f"{DIRTY} SELECT {ALL} FROM dirty")
def csv_scan(spark, sf_dir):
    return csv_source.read_csv(spark, _landed_csv(spark, sf_dir), keep_order=False)


_LINED = """SELECT id, CASE id % 7 WHEN 0 THEN 'two' || chr(10) || 'lines of "' || name || '"' WHEN 3 THEN chr(10) || chr(10) ELSE name END AS name,
  CASE WHEN id % 5 = 0 THEN 'a,' || chr(10) || 'b' ELSE note END AS note FROM dirty"""


def _landed_records(spark, sf_dir) -> str:
    """Files whose records span lines, one for each remainder of the id by 3, in the order of the ids."""
    path = scratch_path(spark, "lined-csv")
    dirty(spark, sf_dir).createOrReplaceTempView("dirty_lined")
    rows = spark.sql(_LINED.replace("chr(10)", "char(10)").replace("FROM dirty", "FROM dirty_lined")).distinct()
    rows.withColumn("part", F.col("id") % 3).repartition("part").sortWithinPartitions("part", "id").write.partitionBy("part").options(**sinks.CSV_OPTIONS).csv(path)
    return path


@query("s01_multiline", f"{DIRTY} SELECT DISTINCT id, name, note FROM ({_LINED})")
def csv_multiline(spark, sf_dir):
    """Records with line breaks inside of quotes, put together from the lines of many tasks."""
    return csv_source.read_csv(spark, f"{_landed_records(spark, sf_dir)}/*", keep_order=False)


@query("s01_many_files_order", f"{DIRTY} SELECT id, row_number() OVER (ORDER BY id % 3, id) AS position FROM (SELECT DISTINCT id, name, note FROM ({_LINED}))")
def csv_many_files_order(spark, sf_dir):
    """Rows come in the order of the files' names and of the lines in each."""
    rows = csv_source.read_csv(spark, f"{_landed_records(spark, sf_dir)}/*")
    numbered = Window.orderBy("__rid")  # a report on a small table; row ids themselves are not numbered through
    return rows.select("id", F.row_number().over(numbered).cast("bigint").alias("position"))


@query("s01_malformed_rows", "SELECT count(*) AS rows, count(*) FILTER (WHERE o_orderkey % 97 = 0) AS surplus_rows FROM orders")
def csv_malformed_rows(spark, sf_dir):
    """Rows with more cells than the header are counted; a typed scan refuses them."""
    path = scratch_path(spark, "surplus-csv")
    cells = F.concat_ws(",", F.col("o_orderkey").cast("string"), F.lit("x"), F.when(F.col("o_orderkey") % 97 == 0, "more"))
    spark.read.parquet(f"{sf_dir}/orders.parquet").select(cells.alias("key,word")).write.options(header="true", quote="", escapeQuotes="false", delimiter="\t").csv(path)
    counted = csv_source.malformed_rows(spark, path)
    return counted.agg(F.sum("rows").alias("rows"), F.sum("surplus_rows").alias("surplus_rows"))


@query("s02_version_scan", f"{DIRTY} SELECT {ALL} FROM dirty")
def version_scan(spark, sf_dir):
    catalog = Catalog(spark, scratch_path(spark, "catalog"))
    version = catalog.create_version(catalog.register("dirty", "dirty.csv"), dirty(spark, sf_dir))
    return catalog.load_version(version.id)


@query(
    "s02_ordered_scan",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders",
)
def ordered_scan(spark, sf_dir):
    """Row ids follow the file names and the rows in each file, whatever the scan's splits."""
    path = scratch_path(spark, "ordered")
    spark.read.parquet(f"{sf_dir}/orders.parquet").repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey").write.parquet(path)
    stored = read_parquet_in_order(spark, path)
    per_file = F.shiftright("__rid", 40)
    sizes = stored.groupBy(per_file.alias("file")).agg(F.count(F.lit(1)).alias("n"))  # one row per file
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    smaller = sizes.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.col("__rid").bitwiseAND(F.lit((1 << 40) - 1))
    return stored.withColumn("file", per_file).join(smaller, "file").select("o_orderkey", (inside + F.col("before")).alias("position"))


_TYPED = "SELECT '{c}' AS column_name, CASE WHEN count({c}) = count(*) FILTER (WHERE regexp_full_match({c}, '[+-]?[0-9]+')) THEN 'bigint' WHEN count({c}) = count(TRY_CAST({c} AS DOUBLE)) THEN 'double' WHEN count({c}) = count(*) FILTER (WHERE lower({c}) IN ('true', 'false')) THEN 'boolean' ELSE 'string' END AS type FROM t"
_TEXTED = "SELECT CAST(l_orderkey AS VARCHAR(20)) AS l_orderkey, CAST(l_discount AS VARCHAR(20)) AS l_discount, l_returnflag, CASE WHEN l_quantity > 25 THEN 'True' ELSE 'False' END AS large FROM {lineitem}"


@query("s03_type_inference", f"WITH t AS ({_TEXTED.replace('{lineitem}', 'lineitem')}) " + union_all([_TYPED.replace("{c}", c) for c in ("l_orderkey", "l_discount", "l_returnflag", "large")]))
def type_inference(spark, sf_dir):
    df = derive(spark, sf_dir, _TEXTED, "lineitem")
    return small_table(spark, list(csv_source.infer_types(df).items()), "column_name string, type string")


_FILES = """SELECT doc_id, '/landing/' || source || '/' || CASE doc_id % 11 WHEN 0 THEN '../' ELSE '' END || 'doc_' || CAST(doc_id AS VARCHAR(20)) ||
CASE doc_id % 7 WHEN 0 THEN '.xlsx' WHEN 1 THEN '.xls' WHEN 2 THEN '.exe' ELSE '.CSV' END AS path,
CASE WHEN doc_id % 29 = 0 THEN 0 ELSE n_chars * 10000 END AS length,
CASE WHEN doc_id % 29 = 0 THEN '' WHEN doc_id % 5 = 0 THEN '504B0304' WHEN doc_id % 5 = 1 THEN 'D0CF11E0A1B11AE1' WHEN doc_id % 5 = 2 THEN '4D5A9000' WHEN doc_id % 5 = 3 THEN '7F454C46' ELSE '69642C6E' END AS head_hex FROM {documents}"""
_EXT = "lower(regexp_extract(path, '(\\.[^.]+)$', 1))"
LANDING_SQL = (
    f"SELECT path, regexp_extract(path, '([^/]*)$', 1) AS file_name, 'Doc ' || CAST(doc_id AS VARCHAR) AS dataset_name, length, reason IS NULL AS accepted, reason FROM (SELECT *, CASE WHEN length > 26214400 THEN 'too large' WHEN {_EXT} NOT IN ('.csv', '.xlsx', '.xls') THEN 'unsupported type' "
    f"WHEN length = 0 THEN 'empty' WHEN {_EXT} = '.xlsx' AND head_hex NOT LIKE '504B0304%' THEN 'not an xlsx container' WHEN {_EXT} = '.xls' AND head_hex NOT LIKE 'D0CF11E0A1B11AE1%' THEN 'not an xls container' "
    f"WHEN {_EXT} = '.csv' AND head_hex LIKE '4D5A%' THEN 'windows executable' WHEN {_EXT} = '.csv' AND head_hex LIKE '7F454C46%' THEN 'elf executable' END AS reason FROM ({_FILES.replace('{documents}', 'documents')}))"
)


def landing_files(spark, sf_dir):
    """A listing of landing files, one per document: path, length and leading bytes."""
    return derive(spark, sf_dir, _FILES, "documents").withColumn("head", F.unhex("head_hex"))


@query("s04_landing_screen", LANDING_SQL)
def landing_screen(spark, sf_dir):
    return screen_files(landing_files(spark, sf_dir))


@query("s07_snapshot_sink", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def snapshot_sink(spark, sf_dir):
    path = scratch_path(spark, "snapshot")
    sinks.write_snapshot(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"), path)
    return spark.read.parquet(path)


_SAFE = ", ".join(f"CASE WHEN regexp_matches({c}, '^[=+\\-@\\t\\r]') THEN '''' || {c} ELSE {c} END AS {c}" if c in ("name", "email", "segment", "note", "joined") else c for c in DIRTY_COLUMNS)


@query("s08_safe_csv_sink", f"{DIRTY} SELECT {_SAFE} FROM dirty")
def safe_csv_sink(spark, sf_dir):
    path = scratch_path(spark, "safe-csv")
    sinks.write_safe_csv(dirty(spark, sf_dir), path)
    return csv_source.read_csv(spark, path, keep_order=False)


@query("s08_formula_guard", "SELECT doc_id, md5(CASE WHEN regexp_matches(text, '^[=+\\-@\\t\\r]') THEN '''' || text ELSE text END) AS digest FROM documents")
def formula_guard(spark, sf_dir):
    return sinks.formula_safe(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", F.md5("text").alias("digest"))


_STAR_TABLES = {
    "Dim_Dataset": "gov_datasets",
    "Dim_Version": "gov_versions",
    "Fact_QualityEvaluation": "gov_reports JOIN gov_versions v ON v.id = version_id",
    "Fact_QualityIssues": "gov_issues JOIN gov_reports r ON r.id = report_id",
    "Fact_CleaningJobs": "gov_jobs",
    "Platform_Quality_Analytics_Flat": "gov_reports",
}


@query(
    "s10_star_schema_sink",
    f"{GOV} "
    + union_all([f"SELECT '{name}' AS table_name, count(*) AS rows FROM {source}" for name, source in _STAR_TABLES.items()])
    + " UNION ALL SELECT 'Dim_Severity', 3 UNION ALL SELECT 'Dim_Grade', 5 UNION ALL SELECT 'Dim_Date', CAST(date_diff('day', min(d)::DATE, max(d)::DATE) + 29 AS BIGINT) + CASE WHEN max(d) > max(d)::DATE THEN 1 ELSE 0 END "
    "FROM (SELECT created_at AS d FROM gov_datasets UNION ALL SELECT created_at FROM gov_versions UNION ALL SELECT created_at FROM gov_reports)",
)
def star_schema_sink(spark, sf_dir):
    """All nine tables written as CSV; the rows read back from each."""
    root = scratch_path(spark, "star")
    star = mart.star_schema(gov(spark, sf_dir))
    sinks.write_tables(star, root)
    counted = None
    for name in star:
        rows = spark.read.options(header="true", multiLine="true", escape='"').csv(f"{root}/{name}").agg(F.count(F.lit(1)).alias("rows"))
        row = rows.select(F.lit(name).alias("table_name"), "rows")
        counted = row if counted is None else counted.unionByName(row)
    return counted


@query("s09_json_rows", "SELECT r_regionkey, r_name FROM (SELECT c_custkey AS r_regionkey, c_name AS r_name FROM customer)")
def json_rows(spark, sf_dir):
    """Rows as JSON text, parsed again."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("r_regionkey"), F.col("c_name").alias("r_name"))
    return sinks.to_json_rows(rows).select(F.from_json("json", "r_regionkey bigint, r_name string").alias("row")).select("row.*")
