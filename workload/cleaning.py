"""Cleaning queries (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from veracol.functions.frames import small_table
from veracol.operators import clean as C
from veracol.operators.clean import CleaningRules

from .checks import EMAIL
from .inputs import DIRTY, DIRTY_COLUMNS, derive, dirty, table
from .registry import query

ALL = ", ".join(DIRTY_COLUMNS)


def replaced(**changes: str) -> str:
    """Select list of the dirty table with some columns replaced."""
    return ", ".join(f"{changes[c]} AS {c}" if c in changes else c for c in DIRTY_COLUMNS)


TRIMMED = replaced(**{c: f"trim({c})" for c in ("name", "email", "segment", "note", "joined")})


@query("c02_trim_strings", f"{DIRTY} SELECT {TRIMMED} FROM dirty")
def trim_strings(spark, sf_dir):
    return C.trim_strings(dirty(spark, sf_dir))


@query("c03_lower_case", f"{DIRTY} SELECT {replaced(segment='lower(segment)')} FROM dirty")
def lower_case(spark, sf_dir):
    return C.apply_casing(dirty(spark, sf_dir), {"segment": "lower", "balance": "lower", "note": "unknown"})


@query("c04_upper_case", f"{DIRTY} SELECT {replaced(segment='upper(segment)', email='upper(email)')} FROM dirty")
def upper_case(spark, sf_dir):
    return C.apply_casing(dirty(spark, sf_dir), {"segment": "upper", "email": "upper"})


@query(
    "c05_title_case",
    "SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS p_name, "
    "array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS p_type FROM part",
)
def title_case(spark, sf_dir):
    return C.apply_casing(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"), {"p_name": "title", "p_type": "title"})


@query(
    "c06_category_mapping",
    f"{DIRTY} SELECT {replaced(segment='CASE upper(segment) WHEN ' + repr('AUTOMOBILE') + ' THEN ' + repr('Cars') + ' WHEN ' + repr('MACHINERY') + ' THEN ' + repr('Machines') + ' ELSE upper(segment) END')} FROM dirty",
)
def category_mapping(spark, sf_dir):
    cased = C.apply_casing(dirty(spark, sf_dir), {"segment": "upper"})
    return C.map_categories(cased, {"segment": {"AUTOMOBILE": "Cars", "MACHINERY": "Machines", 7: "Never"}})


@query(
    "c06_category_mapping_large",
    "SELECT o_orderkey, CASE WHEN o_custkey BETWEEN 1 AND 900 THEN 'c' || CAST(o_custkey AS VARCHAR(20)) ELSE 'key ' || CAST(o_custkey AS VARCHAR(20)) END AS owner FROM orders",
)
def category_mapping_large(spark, sf_dir):
    """A mapping too long for an expression is joined."""
    df = derive(spark, sf_dir, "SELECT o_orderkey, 'key ' || CAST(o_custkey AS VARCHAR(20)) AS owner FROM {orders}", "orders")
    return C.map_categories(df, {"owner": {f"key {i}": f"c{i}" for i in range(1, 901)}})


_ISO = "strftime(try_strptime(joined, ['%Y-%m-%d', '%m/%d/%Y', '%B %d, %Y']), '%Y-%m-%d')"


@query("c07_date_normalization", f"{DIRTY} SELECT {replaced(joined=_ISO)} FROM dirty")
def date_normalization(spark, sf_dir):
    return C.normalize_dates(dirty(spark, sf_dir), ["joined", "absent"])


@query("c08_range_clamp", f"{DIRTY} SELECT {replaced(balance='CASE WHEN balance IS NOT NULL THEN greatest(least(balance, 9000), 0) END')} FROM dirty")
def range_clamp(spark, sf_dir):
    return C.enforce_ranges(dirty(spark, sf_dir), {"balance": {"min": 0, "max": 9000}, "name": {"min": 0}})


@query("c09_range_nullify", f"{DIRTY} SELECT {replaced(balance='CASE WHEN balance >= 0 AND balance <= 9000 THEN balance END')} FROM dirty")
def range_nullify(spark, sf_dir):
    return C.enforce_ranges(dirty(spark, sf_dir), {"balance": {"min": 0, "max": 9000, "action": "nullify"}})


@query("c10_drop_duplicate_rows", f"{DIRTY} SELECT DISTINCT {ALL} FROM dirty")
def drop_duplicate_rows(spark, sf_dir):
    return C.duplicates.drop_duplicate_rows(dirty(spark, sf_dir))


def _ranked(direction: str) -> str:
    return (
        "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM "
        f"(SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey {direction}) AS pos FROM orders) WHERE pos = 1"
    )


_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


@query("c11_keep_first_per_key", _ranked("ASC"))
def keep_first_per_key(spark, sf_dir):
    return C.duplicates.drop_duplicate_rows(table(spark, sf_dir, "orders").select(*_ORDERS), ["o_custkey", "o_orderstatus"], order_by="o_orderkey")


@query("c12_drop_missing", f"{DIRTY} SELECT {ALL} FROM dirty WHERE balance IS NOT NULL")
def drop_missing(spark, sf_dir):
    return C.fill_missing(dirty(spark, sf_dir), {"balance": {"strategy": "drop"}})


def _filled(value: str) -> str:
    return f"{DIRTY} SELECT {replaced(balance=f'round(coalesce(balance, {value}), 4)')} FROM dirty"


def _round_balance(df):
    return df.withColumn("balance", F.round("balance", 4))


@query("c13_fill_mean", _filled("(SELECT avg(balance) FROM dirty)"))
def fill_mean(spark, sf_dir):
    return _round_balance(C.fill_missing(dirty(spark, sf_dir), {"balance": {"strategy": "mean"}, "email": {"strategy": "mean"}}))


@query("c14_fill_median", _filled("(SELECT quantile_cont(balance, 0.5) FROM dirty)"))
def fill_median(spark, sf_dir):
    return _round_balance(C.fill_missing(dirty(spark, sf_dir), {"balance": {"strategy": "median"}}))


_GAPS = "SELECT event_id, ts, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS event_type FROM {events}"
_GAPS_SQL = f"WITH gaps AS ({_GAPS.replace('{events}', 'events')})"


def _gaps(spark, sf_dir):
    return derive(spark, sf_dir, _GAPS, "events").drop("ts")


@query("c15_fill_mode", f"{_GAPS_SQL} SELECT event_id, value, coalesce(event_type, (SELECT event_type FROM gaps WHERE event_type IS NOT NULL GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1)) AS event_type FROM gaps")
def fill_mode(spark, sf_dir):
    return C.fill_missing(_gaps(spark, sf_dir), {"event_type": {"strategy": "mode"}})


@query("c16_fill_constant", f"{DIRTY} SELECT {replaced(balance='coalesce(balance, 0)', joined='coalesce(joined, ' + repr('Unknown') + ')')} FROM dirty")
def fill_constant(spark, sf_dir):
    return C.fill_missing(dirty(spark, sf_dir), {"balance": {"value": 0}, "joined": {"strategy": "constant", "value": "Unknown"}, "email": {"strategy": "constant"}})


def _carried(function: str, frame: str) -> str:
    columns = ", ".join(f"{function}({c} IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN {frame}) AS {c}" for c in ("value", "event_type"))
    return f"{_GAPS_SQL} SELECT event_id, {columns} FROM gaps"


@query("c17_forward_fill", _carried("last_value", "UNBOUNDED PRECEDING AND CURRENT ROW"))
def forward_fill(spark, sf_dir):
    return C.fill_missing(_gaps(spark, sf_dir), {"value": {"strategy": "ffill"}, "event_type": {"strategy": "ffill"}}, order_by="event_id")


@query("c18_backward_fill", _carried("first_value", "CURRENT ROW AND UNBOUNDED FOLLOWING"))
def backward_fill(spark, sf_dir):
    return C.fill_missing(_gaps(spark, sf_dir), {"value": {"strategy": "bfill"}, "event_type": {"strategy": "bfill"}}, order_by="event_id")


@query("c19_cast_int", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS l_quantity, l_discount FROM lineitem")
def cast_int(spark, sf_dir):
    """The discount has fractions, so its column stays as it is."""
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return C.cast_columns(df, {"l_quantity": "int", "l_discount": "Int64"})


_MIXED = """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'true' WHEN 1 THEN CAST(c_custkey AS VARCHAR(20)) WHEN 2 THEN '12.5' WHEN 3 THEN 'invalid' ELSE NULL END AS mixed, c_acctbal < 0 AS owes FROM {customer}"""


@query(
    "c20_cast_float",
    f"WITH t AS ({_MIXED.replace('{customer}', 'customer')}) SELECT c_custkey, CASE mixed WHEN 'true' THEN 1.0 ELSE TRY_CAST(mixed AS DOUBLE) END AS mixed, CAST(owes AS DOUBLE) AS owes FROM t",
)
def cast_float(spark, sf_dir):
    return C.cast_columns(derive(spark, sf_dir, _MIXED, "customer"), {"mixed": "float", "owes": "float64"})


@query("c21_cast_string", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_custkey, CASE WHEN o_custkey > 5 THEN 'True' ELSE 'False' END AS flag FROM orders")
def cast_string(spark, sf_dir):
    return C.cast_columns(derive(spark, sf_dir, "SELECT o_orderkey, o_custkey, o_custkey > 5 AS flag FROM {orders}", "orders"), {"o_orderkey": "str", "flag": "string"})


@query("c22_cast_datetime", f"{DIRTY} SELECT id, {_ISO} AS joined FROM dirty")
def cast_datetime(spark, sf_dir):
    cast = C.cast_columns(dirty(spark, sf_dir).select("id", "joined"), {"joined": "datetime"})
    return cast.withColumn("joined", F.date_format("joined", "yyyy-MM-dd"))


_MISSING_CELLS = " + ".join(f"count(*) - count({c})" for c in DIRTY_COLUMNS)
_STATS = (
    "SELECT count(*) AS total_rows, CAST({n} AS BIGINT) AS total_columns, count(*) * {n} AS total_cells, CAST({missing} AS BIGINT) AS missing_cells, "
    "count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {source})) AS duplicate_rows FROM {source}"
)


@query("c23_table_stats", f"{DIRTY} " + _STATS.format(n=7, missing=_MISSING_CELLS, source="dirty"))
def table_stats(spark, sf_dir):
    return C.table_stats(dirty(spark, sf_dir))


AUDITED = CleaningRules(
    casing_rules={"segment": "title"},
    categorical_mappings={"segment": {"Automobile": "Cars"}},
    date_columns=["joined"],
    range_rules={"balance": {"min": 0, "max": 9000, "action": "nullify"}},
    drop_duplicates_subset=["id"],
    missing_strategies={"email": {"strategy": "drop"}, "balance": {"strategy": "median"}, "joined": {"strategy": "constant", "value": "n/a"}},
)
_STAGED = (
    f"{DIRTY}, s1 AS (SELECT {TRIMMED} FROM dirty), s2 AS (SELECT {replaced(segment='upper(segment[1]) || lower(segment[2:])')} FROM s1), "
    f"s3 AS (SELECT {replaced(segment='CASE segment WHEN ' + repr('Automobile') + ' THEN ' + repr('Cars') + ' ELSE segment END', joined=_ISO, balance='CASE WHEN balance >= 0 AND balance <= 9000 THEN balance END')} FROM s2), "
    "s4 AS (SELECT DISTINCT * FROM s3), s5 AS (SELECT * FROM s4 WHERE email IS NOT NULL), "
    f"s6 AS (SELECT {replaced(balance='coalesce(balance, (SELECT quantile_cont(balance, 0.5) FROM s5))', joined='coalesce(joined, ' + repr('n/a') + ')')} FROM s5)"
)


def _cleaned(spark, sf_dir):
    return C.clean(dirty(spark, sf_dir), AUDITED, order_by="id")


@query("c24_cleaned_rows", f"{_STAGED} SELECT {replaced(balance='round(balance, 4)')} FROM s6")
def cleaned_rows(spark, sf_dir):
    return _round_balance(_cleaned(spark, sf_dir).cleaned)


@query(
    "c24_before_after_delta",
    f"{_STAGED}, before AS ({_STATS.format(n=7, missing=_MISSING_CELLS, source='dirty')}), after AS ({_STATS.format(n=7, missing=_MISSING_CELLS, source='s6')}) "
    "SELECT b.total_rows - a.total_rows AS rows_removed, b.missing_cells - a.missing_cells AS missing_cells_resolved, b.duplicate_rows - a.duplicate_rows AS duplicates_removed, CAST(9 AS BIGINT) AS total_operations FROM before b, after a",
)
def before_after_delta(spark, sf_dir):
    result = _cleaned(spark, sf_dir)
    names = ("rows_removed", "missing_cells_resolved", "duplicates_removed", "total_operations")
    return small_table(spark, [tuple(result.delta[n] for n in names)], ", ".join(f"{n} bigint" for n in names))


_PADDED = " + ".join(f"count(*) FILTER (WHERE {c} <> trim({c}))" for c in ("name", "email", "segment", "note", "joined"))


@query(
    "c25_step_log",
    f"{_STAGED} SELECT * FROM (VALUES "
    f"(1, 'strip_whitespace', NULL, (SELECT {_PADDED} FROM dirty)), "
    "(2, 'casing_standardization', 'segment', (SELECT count(*) FROM s1 WHERE segment <> upper(segment[1]) || lower(segment[2:]))), "
    "(3, 'categorical_mapping', 'segment', (SELECT count(*) FROM s2 WHERE segment = 'Automobile')), "
    "(4, 'date_normalization', 'joined', (SELECT count(joined) FROM s2)), "
    "(5, 'range_enforcement', 'balance', (SELECT count(*) FROM s2 WHERE balance < 0 OR balance > 9000)), "
    "(6, 'drop_duplicates', NULL, (SELECT count(*) FROM s3) - (SELECT count(*) FROM s4)), "
    "(7, 'drop_missing', 'email', (SELECT count(*) FROM s4 WHERE email IS NULL)), "
    "(8, 'fill_median', 'balance', (SELECT count(*) FROM s5 WHERE balance IS NULL)), "
    "(9, 'fill_constant', 'joined', (SELECT count(*) FROM s5 WHERE joined IS NULL))) v(step_number, operation, target_column, rows_affected)",
)
def step_log(spark, sf_dir):
    return _cleaned(spark, sf_dir).steps_frame(spark).select("step_number", "operation", "target_column", "rows_affected")


@query(
    "c25_step_log_long_mapping",
    "SELECT * FROM (VALUES (1, 'casing_standardization', 'c_mktsegment', (SELECT count(*) FROM customer WHERE c_mktsegment <> lower(c_mktsegment))), "
    "(2, 'categorical_mapping', 'c_mktsegment', (SELECT count(*) FROM customer WHERE lower(c_mktsegment) = 'building'))) v(step_number, operation, target_column, rows_affected)",
)
def step_log_long_mapping(spark, sf_dir):
    """A mapping long enough to be joined is logged as a short one is, after the casing that it builds on."""
    mapping = {"building": "construction"} | {f"segment {i}": "other" for i in range(C.INLINE_MAP + 1)}
    rules = C.CleaningRules(strip_whitespace=False, casing_rules={"c_mktsegment": "lower"}, categorical_mappings={"c_mktsegment": mapping})
    return C.clean(table(spark, sf_dir, "customer"), rules).steps_frame(spark).select("step_number", "operation", "target_column", "rows_affected")


@query("c26_snake_case_headers", "SELECT c_custkey AS customer_id, c_name AS full_name, c_acctbal AS acct_bal FROM customer")
def snake_case_headers(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias(" Customer ID # "), F.col("c_name").alias("Full--Name"), F.col("c_acctbal").alias("Acct. Bal"))
    return C.normalize_headers(df, "snake")


@query("c27_collapse_whitespace", r"SELECT doc_id, md5(regexp_replace(trim(text, E' \n\t\r'), '\s+', ' ', 'g')) AS digest FROM documents")
def collapse_whitespace(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", "text")
    return C.trim_strings(df, collapse=True).select("doc_id", F.md5("text").alias("digest"))


@query("c28_capitalize", "SELECT p_partkey, upper(p_name[1]) || lower(p_name[2:]) AS p_name FROM part")
def capitalize(spark, sf_dir):
    return C.apply_casing(table(spark, sf_dir, "part").select("p_partkey", "p_name"), {"p_name": "capitalize"})


_FENCED = f"{DIRTY}, q AS (SELECT quantile_cont(balance, 0.25) AS a, quantile_cont(balance, 0.75) AS b FROM dirty), f AS (SELECT a - 1.5 * (b - a) AS low, b + 1.5 * (b - a) AS high FROM q)"


@query("c29_outlier_clip", f"{_FENCED} SELECT {replaced(balance='round(CASE WHEN balance IS NOT NULL THEN greatest(least(balance, high), low) END, 4)')} FROM dirty, f")
def outlier_clip(spark, sf_dir):
    return _round_balance(C.handle_outliers(dirty(spark, sf_dir), {"balance": {"strategy": "clip"}}))


@query("c29_outlier_nullify", f"{_FENCED} SELECT {replaced(balance='CASE WHEN balance BETWEEN low AND high THEN round(balance, 4) END')} FROM dirty, f")
def outlier_nullify(spark, sf_dir):
    return _round_balance(C.handle_outliers(dirty(spark, sf_dir), {"balance": "nullify"}))


@query("c30_keep_last_per_key", _ranked("DESC"))
def keep_last_per_key(spark, sf_dir):
    return C.duplicates.drop_duplicate_rows(table(spark, sf_dir, "orders").select(*_ORDERS), ["o_custkey", "o_orderstatus"], keep="last", order_by="o_orderkey")


@query("c30_drop_all_copies", f"{DIRTY} SELECT {', '.join(f'max({c}) AS {c}' if c != 'id' else 'id' for c in DIRTY_COLUMNS)} FROM dirty GROUP BY id HAVING count(*) = 1")
def drop_all_copies(spark, sf_dir):
    return C.duplicates.drop_duplicate_rows(dirty(spark, sf_dir), ["id"], keep=False)


_SPARSE = """SELECT CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey END AS id, CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE c_name END AS name, CAST(NULL AS VARCHAR(20)) AS nothing FROM {customer}"""


@query("c31_drop_empty", f"WITH t AS ({_SPARSE.replace('{customer}', 'customer')}) SELECT id, name FROM t WHERE id IS NOT NULL OR name IS NOT NULL")
def drop_empty(spark, sf_dir):
    return C.drop_empty_columns(C.drop_empty_rows(derive(spark, sf_dir, _SPARSE, "customer")))


_OK_EMAIL = f"regexp_matches(trim(email), '{EMAIL}')"


@query("c32_invalidate_formats", f"{DIRTY} SELECT {replaced(email=f'CASE WHEN {_OK_EMAIL} THEN email END')} FROM dirty")
def invalidate_formats(spark, sf_dir):
    return C.invalidate_formats(dirty(spark, sf_dir), {"email": "email"})


@query("c32_drop_invalid_formats", f"{DIRTY} SELECT {ALL} FROM dirty WHERE email IS NULL OR {_OK_EMAIL}")
def drop_invalid_formats(spark, sf_dir):
    return C.invalidate_formats(dirty(spark, sf_dir), {"email": "email"}, action="drop")


@query("c33_day_first_dates", f"{DIRTY} SELECT id, strftime(coalesce(try_strptime(joined, '%d/%m/%Y'), try_strptime(joined, ['%Y-%m-%d', '%m/%d/%Y', '%B %d, %Y'])), '%d.%m.%Y') AS joined FROM dirty")
def day_first_dates(spark, sf_dir):
    return C.normalize_dates(dirty(spark, sf_dir).select("id", "joined"), ["joined"], day_first=True, output_format="dd.MM.yyyy")


@query("c34_blank_as_missing", f"{DIRTY} SELECT {replaced(email='coalesce(CASE WHEN trim(email) <> ' + repr('') + ' THEN email END, ' + repr('none') + ')')} FROM dirty")
def blank_as_missing(spark, sf_dir):
    return C.fill_missing(dirty(spark, sf_dir), {"email": {"strategy": "constant", "fill_value": "none"}}, blank_is_missing=True)
