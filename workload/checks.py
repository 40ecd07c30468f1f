"""Quality-check (Q) and score (K) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from veracol.operators import checks as Q, clean as C, score as K
from veracol.operators.checks import CheckRules

from .inputs import DIRTY, DIRTY_COLUMNS, DIRTY_TEXTS, derive, dirty, gov, GOV, table
from .registry import query, union_all

EMAIL = r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$"
SEGMENTS = ["AUTOMOBILE", "Building", "FURNITURE", "machinery", "HOUSEHOLD"]
RULES = CheckRules(
    id_columns=["id"],
    range_rules={"balance": {"min": 0, "max": 9000}},
    format_rules={"email": "email", "joined": "iso_date"},
    category_rules={"segment": SEGMENTS},
)
ROWS = "(SELECT count(*) FROM dirty)"


def _gone(column: str) -> str:
    return f"{column} IS NULL OR trim({column}) = ''" if column in DIRTY_TEXTS else f"{column} IS NULL"


def _count_sql(category: str, column: str, rule: str, predicate: str, source: str = "dirty") -> str:
    return f"SELECT '{category}' AS category, '{column}' AS column_name, '{rule}' AS rule, count(*) FILTER (WHERE {predicate}) AS affected_count, count(*) AS total_rows FROM {source}"


MISSING_SQL = union_all([_count_sql("MISSING", c, "missing", _gone(c)) for c in DIRTY_COLUMNS])
EMAIL_SQL = _count_sql("INVALID_FORMAT", "email", "email", f"email IS NOT NULL AND NOT regexp_matches(trim(email), '{EMAIL}')")
ISO_SQL = _count_sql("INVALID_FORMAT", "joined", "iso_date", "joined IS NOT NULL AND NOT regexp_matches(trim(joined), '^[0-9]{4}-[0-9]{2}-[0-9]{2}$')")
RANGE_SQL = _count_sql("INVALID_RANGE", "balance", "< 0 or > 9000", "balance < 0 OR balance > 9000")
ALLOWED = ", ".join(f"'{s}'" for s in SEGMENTS)
ALLOWED_SQL = _count_sql("INCONSISTENT_CATEGORY", "segment", "allowed", f"segment IS NOT NULL AND trim(segment) NOT IN ({ALLOWED})")


@query("q01_missing_values", f"{DIRTY} {MISSING_SQL}")
def missing_values(spark, sf_dir):
    df = dirty(spark, sf_dir)
    return Q.count_probes(df, Q.missing_probes(df))


@query("q02_exact_duplicates", "SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS affected_rows, CAST(sum(n) AS BIGINT) AS total_rows FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang, source, n_chars)")
def exact_duplicates(spark, sf_dir):
    return Q.duplicates.duplicate_counts(table(spark, sf_dir, "documents").drop("doc_id"))


_KEY_SQL = "SELECT 'DUPLICATE' AS category, '{name}' AS column_name, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS affected_count, CAST(sum(n) AS BIGINT) AS total_rows FROM (SELECT count(*) AS n FROM {source} GROUP BY {keys})"


@query("q03_key_duplicates", f"{DIRTY} " + union_all([_KEY_SQL.format(name=c, source="dirty", keys=c) for c in ("id", "email")]))
def key_duplicates(spark, sf_dir):
    return Q.key_duplicate_counts(dirty(spark, sf_dir), ["id", "email", "absent"])


@query("q04_named_formats", f"{DIRTY} " + union_all([EMAIL_SQL, ISO_SQL, _count_sql("INVALID_FORMAT", "note", "Phone", r"note IS NOT NULL AND NOT regexp_matches(trim(note), '^\+?[0-9\s\-()]{7,20}$')")]))
def named_formats(spark, sf_dir):
    df = dirty(spark, sf_dir)
    return Q.count_probes(df, Q.format_probes(df, {"email": "email", "joined": "iso_date", "note": "Phone"}))


@query("q05_custom_format", _count_sql("INVALID_FORMAT", "p_brand", "Brand#[1-3]", "NOT regexp_matches(trim(p_brand), '^(Brand#[1-3])')", "part"))
def custom_format(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    return Q.count_probes(df, Q.format_probes(df, {"p_brand": "Brand#[1-3]", "p_name": "(unclosed"}))


@query(
    "q06_ranges",
    union_all(
        [
            _count_sql("INVALID_RANGE", "c_acctbal", "< 0", "c_acctbal < 0", "customer"),
            _count_sql("INVALID_RANGE", "c_nationkey", "< 3 or > 20", "c_nationkey < 3 OR c_nationkey > 20", "customer"),
        ]
    ),
)
def ranges(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    return Q.count_probes(df, Q.range_probes(df, {"c_acctbal": {"min": 0}, "c_nationkey": {"min": 3, "max": 20}, "c_name": {"max": 1}}))


def _case_sql(column: str, source: str = "dirty") -> str:
    return (
        f"SELECT '{column}' AS column_name, count(*) AS groups, CAST(sum(rows) AS BIGINT) AS affected_count FROM "
        f"(SELECT lower(trim({column})) AS folded, count(DISTINCT trim({column})) AS spellings, count(*) AS rows FROM {source} WHERE {column} IS NOT NULL GROUP BY 1) WHERE spellings > 1 HAVING count(*) > 0"
    )


CASE_SQL = union_all([_case_sql(c) for c in DIRTY_TEXTS])


@query("q07_case_variants", f"{DIRTY} {CASE_SQL}")
def case_variants(spark, sf_dir):
    return Q.case_variant_counts(dirty(spark, sf_dir))


@query("q07_case_variants_fingerprint", f"{DIRTY} {CASE_SQL}")
def case_variants_fingerprint(spark, sf_dir):
    return Q.case_variant_counts(dirty(spark, sf_dir), grouping="fingerprint")


@query(
    "q07_case_variant_groups",
    f"{DIRTY} SELECT 'segment' AS column_name, folded, spellings, affected_count FROM (SELECT lower(trim(segment)) AS folded, count(DISTINCT trim(segment)) AS spellings, count(*) AS affected_count FROM dirty GROUP BY 1) WHERE spellings > 1",
)
def case_variant_groups(spark, sf_dir):
    return Q.case_variants(dirty(spark, sf_dir), ["segment"]).drop("first_seen")


@query("q08_allowed_categories", f"{DIRTY} {ALLOWED_SQL}")
def allowed_categories(spark, sf_dir):
    df = dirty(spark, sf_dir)
    return Q.count_probes(df, Q.allowed_probes(df, RULES.category_rules))


@query("q08_allowed_by_table", "SELECT count(*) AS affected_count FROM documents WHERE trim(source) NOT IN (SELECT source FROM documents GROUP BY source HAVING count(*) > 100)")
def allowed_by_table(spark, sf_dir):
    """The allowed values come from a table: sources with more than 100 documents."""
    documents = table(spark, sf_dir, "documents")
    listed = documents.groupBy("source").count().where("count > 100").select(F.col("source").alias("value"))
    return Q.unlisted_counts(documents, "source", listed)


@query("q08_long_list_samples", "SELECT trim(c_name) AS value FROM customer WHERE trim(c_name) NOT IN (SELECT c_name FROM customer WHERE c_acctbal > 0) ORDER BY c_custkey LIMIT 5")
def long_list_samples(spark, sf_dir):
    """The first names outside a list that is a table: customers with a positive balance."""
    customers = table(spark, sf_dir, "customer")
    listed = customers.where("c_acctbal > 0").select(F.col("c_name").alias("value"))
    return Q.unlisted_samples(customers, "c_name", listed, order_by="c_custkey")


def _fence_sql(column: str, source: str) -> str:
    return (
        f"SELECT 'OUTLIER' AS category, '{column}' AS column_name, 'iqr' AS rule, count(*) FILTER (WHERE {column} < q1 - 1.5 * (q3 - q1) OR {column} > q3 + 1.5 * (q3 - q1)) AS affected_count, count(*) AS total_rows "
        f"FROM {source}, (SELECT quantile_cont(CAST({column} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({column} AS DOUBLE), 0.75) AS q3 FROM {source})"
    )


@query("q09_iqr_outliers", f"{DIRTY} " + union_all([_fence_sql("id", "dirty"), _fence_sql("balance", "dirty")]))
def iqr_outliers(spark, sf_dir):
    df = dirty(spark, sf_dir)
    return Q.count_probes(df, Q.outlier_probes(df, Q.outlier_fences(df)))


@query("q09_iqr_outliers_orders", _fence_sql("o_totalprice", "orders"))
def iqr_outliers_orders(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_totalprice")
    return Q.count_probes(df, Q.outlier_probes(df, Q.outlier_fences(df, buckets=64)))


@query(
    "q10_z_score_outliers",
    f"{DIRTY} "
    + union_all(
        [
            f"SELECT 'OUTLIER' AS category, '{c}' AS column_name, 'z-score' AS rule, count(*) FILTER (WHERE abs(({c} - m) / s) > 3.0) AS affected_count, count(*) AS total_rows "
            f"FROM dirty, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM dirty)"
            for c in ("id", "balance")
        ]
    ),
)
def z_score_outliers(spark, sf_dir):
    df = dirty(spark, sf_dir)
    return Q.count_probes(df, Q.outlier_probes(df, Q.outlier_fences(df, "zscore")))


def _first_five(category: str, column: str, rule: str, predicate: str) -> str:
    return (
        f"SELECT '{category}' AS category, '{column}' AS column_name, '{rule}' AS rule, string_agg(shown, '|' ORDER BY pos) AS samples FROM "
        f"(SELECT trim({column}) AS shown, row_number() OVER (ORDER BY id) AS pos FROM dirty WHERE {predicate}) WHERE pos <= 5"
    )


@query(
    "q11_sample_values",
    f"{DIRTY} "
    + union_all(
        [
            _first_five("INVALID_FORMAT", "email", "email", f"email IS NOT NULL AND NOT regexp_matches(trim(email), '{EMAIL}')"),
            _first_five("INCONSISTENT_CATEGORY", "segment", "allowed", f"trim(segment) NOT IN ({ALLOWED})"),
        ]
    ),
)
def sample_values(spark, sf_dir):
    df = dirty(spark, sf_dir)
    probes = [*Q.format_probes(df, {"email": "email"}), *Q.allowed_probes(df, RULES.category_rules)]
    found = Q.sample_values(df, probes, 5, order_by="id")
    return found.select("category", "column_name", "rule", F.array_join("sample_values", "|").alias("samples"))


EXACT_SQL = f"SELECT 'DUPLICATE' AS category, CAST(sum(n - 1) AS BIGINT) AS n FROM (SELECT count(*) AS n FROM dirty GROUP BY {', '.join(DIRTY_COLUMNS)})"
ID_SQL = "SELECT 'DUPLICATE' AS category, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS n FROM (SELECT count(*) AS n FROM dirty GROUP BY id)"


def defects_sql(dups: str = EXACT_SQL, ids: str = ID_SQL) -> str:
    """(category, severity, n) of every issue the rules find."""
    parts = [
        f"SELECT category, CASE WHEN 100.0 * affected_count / total_rows >= 20 THEN 'CRITICAL' ELSE 'WARNING' END AS severity, affected_count AS n FROM ({MISSING_SQL})",
        *[f"SELECT category, 'WARNING', affected_count FROM ({sql})" for sql in (EMAIL_SQL, ISO_SQL, RANGE_SQL, ALLOWED_SQL)],
        f"SELECT category, 'WARNING', n FROM ({dups})",
        f"SELECT category, 'CRITICAL', n FROM ({ids})",
        f"SELECT 'INCONSISTENT_CATEGORY', 'INFO', affected_count FROM ({CASE_SQL})",
        f"SELECT category, 'INFO', affected_count FROM ({_fence_sql('id', 'dirty')})",
        f"SELECT category, 'INFO', affected_count FROM ({_fence_sql('balance', 'dirty')})",
    ]
    return union_all(parts)


DEFECTS = f"{DIRTY}, defects AS ({defects_sql()})"


def _report(spark, sf_dir):
    return Q.analyze(dirty(spark, sf_dir), RULES, order_by="id")


@query("q12_issue_rollup_by_category", f"{DEFECTS} SELECT category, CAST(sum(n) AS BIGINT) AS affected_count FROM defects GROUP BY category HAVING sum(n) > 0")
def rollup_by_category(spark, sf_dir):
    return Q.issue_rollup(_report(spark, sf_dir).to_frame(spark), "category")


@query("q12_issue_rollup_by_severity", "SELECT severity, CAST(sum(affected_count) AS BIGINT) AS affected_count FROM (" + GOV + " SELECT upper(severity) AS severity, affected_count FROM gov_issues) GROUP BY severity")
def rollup_by_severity(spark, sf_dir):
    return Q.issue_rollup(gov(spark, sf_dir)["issues"].withColumn("severity", F.upper("severity")), "severity")


@query(
    "q15_invalid_types",
    f"{DIRTY} "
    + union_all(
        [
            _count_sql("INVALID_TYPE", "joined", "datetime", "joined IN ('2023-02-29', 'not_a_date')"),
            _count_sql("INVALID_TYPE", "note", "float", "note IS NOT NULL"),
        ]
    ),
)
def invalid_types(spark, sf_dir):
    df = dirty(spark, sf_dir)
    return Q.count_probes(df, Q.type_probes(df, {"joined": "datetime", "note": "float"}))


@query("q16_postal_codes", "WITH t AS (SELECT CAST(c_custkey AS VARCHAR(20)) AS code FROM customer) " + _count_sql("INVALID_FORMAT", "code", "postal_code", r"NOT regexp_matches(code, '^[A-Za-z0-9][A-Za-z0-9 \-]{2,9}$')", "t"))
def postal_codes(spark, sf_dir):
    df = derive(spark, sf_dir, "SELECT CAST(c_custkey AS VARCHAR(20)) AS code FROM {customer}", "customer")
    return Q.count_probes(df, Q.format_probes(df, {"code": "postal_code"}))


@query("q17_composite_ids", union_all([_KEY_SQL.format(name="l_orderkey,l_linenumber", source="lineitem", keys="l_orderkey, l_linenumber"), _KEY_SQL.format(name="l_orderkey,l_partkey", source="lineitem", keys="l_orderkey, l_partkey")]))
def composite_ids(spark, sf_dir):
    return Q.key_duplicate_counts(table(spark, sf_dir, "lineitem"), [["l_orderkey", "l_linenumber"], ["l_orderkey", "l_partkey"]])


@query("q18_severity_filter", f"{GOV} SELECT report_id, category, severity, affected_count FROM gov_issues WHERE upper(severity) = 'CRITICAL'")
def severity_filter(spark, sf_dir):
    return Q.filter_severity(gov(spark, sf_dir)["issues"], "critical").select("report_id", "category", "severity", "affected_count")


# -- scores --------------------------------------------------------------------------------

CELLS = f"(SELECT count(*) * {len(DIRTY_COLUMNS)} FROM dirty)"
WEIGHTS = {"Completeness": 0.3, "Validity": 0.3, "Uniqueness": 0.2, "Consistency": 0.2}
_CATEGORIES = {
    "Completeness": "'MISSING'",
    "Validity": "'INVALID_FORMAT', 'INVALID_RANGE', 'INVALID_TYPE'",
    "Uniqueness": "'DUPLICATE'",
    "Consistency": "'INCONSISTENT_CATEGORY'",
}


def dimension_sql(name: str, defects: str = "defects", rows: str = ROWS, cells: str = CELLS) -> str:
    total = rows if name == "Uniqueness" else cells
    score = f"greatest(0.0, round((1.0 - CAST(d AS DOUBLE) / t) * 100, 2))" if name != "Completeness" else "round(CAST(greatest(0, t - d) AS DOUBLE) / t * 100, 2)"
    passed = "greatest(0, t - d)" if name in ("Completeness", "Uniqueness") else "t - d"
    return (
        f"SELECT '{name}' AS dimension, {score} AS score, CAST({WEIGHTS[name]} AS DOUBLE) AS weight, round({score} * CAST({WEIGHTS[name]} AS DOUBLE), 2) AS weighted_score, "
        f"CAST({passed} AS BIGINT) AS passed_items, CAST(t AS BIGINT) AS total_evaluated, CAST(d AS BIGINT) AS defects_count "
        f"FROM (SELECT coalesce(sum(n), 0) AS d, {total} AS t FROM {defects} WHERE category IN ({_CATEGORIES[name]}))"
    )


DIMENSIONS_SQL = union_all([dimension_sql(name) for name in WEIGHTS])
GRADE_SQL = "CASE WHEN {s} >= 90 THEN 'A' WHEN {s} >= 80 THEN 'B' WHEN {s} >= 70 THEN 'C' WHEN {s} >= 60 THEN 'D' ELSE 'F' END"
OVERALL_SQL = f"SELECT least(100.0, greatest(0.0, round(sum(weighted_score), 2))) AS s FROM ({DIMENSIONS_SQL})"


def scorecard(spark, sf_dir):
    return K.score(dirty(spark, sf_dir), RULES).to_frame(spark)


def _dimension(name: str):
    def run(spark, sf_dir):
        return scorecard(spark, sf_dir).where(F.col("dimension") == name).drop("grade", "is_trustworthy")

    return run


for _key, _name in (("k02_completeness", "Completeness"), ("k03_validity", "Validity"), ("k04_uniqueness", "Uniqueness"), ("k05_consistency", "Consistency")):
    query(_key, f"{DEFECTS} {dimension_sql(_name)}")(_dimension(_name))


@query("k06_overall_score", f"{DEFECTS} SELECT 'Overall' AS dimension, s AS score FROM ({OVERALL_SQL})")
def overall_score(spark, sf_dir):
    return scorecard(spark, sf_dir).where("dimension = 'Overall'").select("dimension", "score")


@query("k07_grade_and_trust", f"{GOV} SELECT id, overall_score, {GRADE_SQL.format(s='overall_score')} AS grade, overall_score >= 80 AS is_trustworthy FROM gov_scores")
def grade_and_trust(spark, sf_dir):
    scores = gov(spark, sf_dir)["scorecards"].select("id", "overall_score")
    return scores.withColumn("grade", K.grade_column(F.col("overall_score"))).withColumn("is_trustworthy", K.trusted_column(F.col("overall_score")))


@query(
    "k07_scorecard",
    f"{DEFECTS}, dims AS ({DIMENSIONS_SQL}) SELECT dimension, score, weight, weighted_score, passed_items, total_evaluated, defects_count, CAST(NULL AS VARCHAR) AS grade, CAST(NULL AS BOOLEAN) AS is_trustworthy FROM dims "
    f"UNION ALL SELECT 'Overall', s, 1.0, s, NULL, NULL, NULL, {GRADE_SQL.format(s='s')}, s >= 80 FROM ({OVERALL_SQL})",
)
def full_scorecard(spark, sf_dir):
    return scorecard(spark, sf_dir)


def _cleaned(spark, sf_dir):
    """Trim, drop repeated rows, fill the balance with its mean."""
    df = C.duplicates.drop_duplicate_rows(C.trim_strings(dirty(spark, sf_dir)))
    return C.fill_missing(df, {"balance": {"strategy": "mean"}})


_AFTER = (
    f"{DIRTY.replace('dirty AS', 'raw AS')}, trimmed AS (SELECT DISTINCT id, trim(name) AS name, trim(email) AS email, trim(segment) AS segment, balance, trim(note) AS note, trim(joined) AS joined FROM raw), "
    "cleaned AS (SELECT id, name, email, segment, coalesce(balance, (SELECT avg(balance) FROM trimmed)) AS balance, note, joined FROM trimmed)"
)


def _dims(source: str) -> str:
    defects = defects_sql().replace("dirty", source)
    rows, cells = ROWS.replace("dirty", source), CELLS.replace("dirty", source)
    return f"{source}_defects AS ({defects}), {source}_dims AS ({union_all([dimension_sql(n, source + '_defects', rows, cells) for n in WEIGHTS])}), {source}_overall AS (SELECT round(sum(weighted_score), 2) AS s FROM {source}_dims)"


@query(
    "k10_before_after",
    f"{_AFTER}, {_dims('raw')}, {_dims('cleaned')} SELECT lower(b.dimension) AS dimension, b.score AS before_score, a.score AS after_score, round(a.score - b.score, 2) AS delta "
    "FROM raw_dims b JOIN cleaned_dims a USING (dimension) UNION ALL SELECT 'overall', b.s, a.s, round(a.s - b.s, 2) FROM raw_overall b, cleaned_overall a",
)
def before_after(spark, sf_dir):
    return K.compare(dirty(spark, sf_dir), _cleaned(spark, sf_dir), RULES).to_frame(spark)
