"""Checks, issue reports and scores of small tables."""

import pytest

from veracol.operators import checks as Q, score as K
from veracol.operators.checks import CheckRules


def issues_of(report, category):
    return [i for i in report.issues if i.category == category]


def test_missing_counts_blank_text(make):
    df = make(
        "full string, partial string, blank string",
        [("a", "x", "y"), ("b", None, "  "), ("c", "z", "w"), ("d", "q", "v"), ("e", "r", "u")],
    )
    report = Q.analyze(df)
    found = issues_of(report, "MISSING")
    assert [(i.column, i.affected_count, i.severity) for i in found] == [("partial", 1, "CRITICAL"), ("blank", 1, "CRITICAL")]


def test_exact_and_key_duplicates(make):
    df = make("user_id string, city string", [("u1", "A"), ("u2", "B"), ("u1", "A"), ("u3", "C")])
    found = issues_of(Q.analyze(df, CheckRules(id_columns=["user_id", "absent"])), "DUPLICATE")
    assert [(i.column, i.affected_count, i.severity) for i in found] == [(None, 1, "WARNING"), ("user_id", 2, "CRITICAL")]
    assert found[1].sample_values == ["u1", "u1"]


def test_null_keys_collide(make):
    df = make("k string, v bigint", [(None, 1), (None, 2), ("a", 3)])
    assert issues_of(Q.analyze(df, CheckRules(id_columns=["k"])), "DUPLICATE")[0].affected_count == 2


def test_composite_key(make):
    df = make("a bigint, b bigint, c bigint", [(1, 1, 1), (1, 2, 2), (1, 1, 3)])
    found = issues_of(Q.analyze(df, CheckRules(id_columns=[["a", "b"]])), "DUPLICATE")
    assert [(i.column, i.affected_count) for i in found] == [("a,b", 2)]


def test_email_format(make):
    df = make("email string", [("valid@example.com",), ("broken_email",), ("another@test.org",), ("bad@.com",)])
    found = issues_of(Q.analyze(df, CheckRules(format_rules={"email": "EMAIL"})), "INVALID_FORMAT")
    assert found[0].affected_count == 2 and found[0].sample_values == ["broken_email", "bad@.com"]


def test_custom_format_is_anchored_at_the_start_only(make):
    df = make("code string", [("AB12x",), ("xAB12",), ("CD34",)])
    found = issues_of(Q.analyze(df, CheckRules(format_rules={"code": r"(?P<letters>[A-Z]{2})\d+"})), "INVALID_FORMAT")
    assert found[0].sample_values == ["xAB12"]


def test_invalid_regex_is_skipped(make):
    assert issues_of(Q.analyze(make("c string", [("a",)]), CheckRules(format_rules={"c": "(open"})), "INVALID_FORMAT") == []


def test_range(make):
    df = make("age bigint", [(25,), (-5,), (42,), (135,), (30,)])
    found = issues_of(Q.analyze(df, CheckRules(range_rules={"age": {"min": 0, "max": 120}})), "INVALID_RANGE")
    assert found[0].affected_count == 2 and found[0].sample_values == ["-5", "135"]


def test_casing_and_categories(make):
    df = make(
        "gender string, plan string",
        [("Male", "Basic"), ("male", "Pro"), ("Female", "Enterprise"), ("MALE", "Ultra_Invalid"), ("Female", "Basic")],
    )
    found = issues_of(Q.analyze(df, CheckRules(category_rules={"plan": ["Basic", "Pro", "Enterprise"]})), "INCONSISTENT_CATEGORY")
    assert [(i.column, i.affected_count, i.severity) for i in found] == [("gender", 3, "INFO"), ("plan", 1, "WARNING")]
    assert found[0].sample_values == ["{Male, male, MALE}"]


def test_fingerprints_give_the_same_report(make):
    from veracol.operators import profile as P

    rows = [("Male ", "long text " * 50, 1), ("male", "other " * 40, 2), ("MALE", "long text " * 50, 3), ("x", None, 4), ("x", None, 4)]
    df = make("g string, t string, n bigint", rows)
    exact, digests = Q.analyze(df), Q.analyze(df, grouping="fingerprint")
    assert exact.to_dict() == digests.to_dict()
    assert P.profile(df).to_dict() == P.profile(df, grouping="fingerprint").to_dict()


def test_long_category_lists_are_joined(make):
    allowed = [f"v{i}" for i in range(Q.INLINE_SET + 5)]
    df = make("v string", [("v1",), ("v1004",), ("nope",), (None,)])
    found = issues_of(Q.analyze(df, CheckRules(category_rules={"v": allowed})), "INCONSISTENT_CATEGORY")
    assert [(i.column, i.affected_count) for i in found] == [("v", 1)]


def test_long_category_lists_give_samples_in_row_order(make):
    rows = [("v1",), (" zz ",), (None,), ("nope",), ("aa",), ("zz",)]
    for extra in (2, Q.INLINE_SET + 5):
        df = make("v string", rows)
        found = issues_of(Q.analyze(df, CheckRules(category_rules={"v": [f"v{i}" for i in range(extra)]}), sample_limit=3), "INCONSISTENT_CATEGORY")
        assert [(i.affected_count, i.sample_values) for i in found if i.severity == "WARNING"] == [(4, ["zz", "nope", "aa"])]


def test_iqr_and_z_score_outliers(make):
    df = make("val bigint", [(v,) for v in [10, 11, 12] * 4 + [500]])
    found = issues_of(Q.analyze(df), "OUTLIER")
    assert found[0].affected_count == 1 and found[0].sample_values == ["500"]
    assert issues_of(Q.analyze(df, outlier_method="zscore"), "OUTLIER")[0].affected_count == 1


def test_outliers_need_values_and_spread(make):
    assert issues_of(Q.analyze(make("v bigint", [(1,)] * 8 + [(99,)])), "OUTLIER") == []
    assert issues_of(Q.analyze(make("v bigint", [(1,)] * 20 + [(99,)])), "OUTLIER") == []


def test_infinities_do_not_break_outliers(make):
    df = make("id bigint, val double", [(i, v) for i, v in enumerate([10.0, float("inf"), float("-inf"), 1e18, -1e18] * 3)])
    assert Q.analyze(df).total_rows == 15
    assert issues_of(Q.analyze(df, outlier_method="zscore"), "OUTLIER") == []


def test_type_rule(make):
    df = make("n string", [("1",), ("2.5",), ("x",), (" ",), (None,)])
    report = Q.analyze(df, CheckRules(type_rules={"n": "int"}))
    assert issues_of(report, "INVALID_TYPE")[0].sample_values == ["2.5", "x"]


def test_rollups_sum_affected_rows(make):
    df = make("a string, b string", [(None, "x"), (None, None), ("c", "X")])
    report = Q.analyze(df)
    assert report.issues_by_category == {"MISSING": 3, "INCONSISTENT_CATEGORY": 2}
    assert report.total_issues_count == 5
    assert [i.severity for i in report.with_severity("info")] == ["INFO"]


def test_empty_table_has_no_issues(make):
    report = Q.analyze(make("id bigint, score double", []))
    assert report.total_rows == 0 and report.issues == []
    result = K.score_report(report)
    assert (result.overall_score, result.grade, result.grade_label) == (0.0, "F", "Empty dataset")


def test_weights_must_sum_to_one():
    with pytest.raises(ValueError, match="must sum to 1.0"):
        K.ScoreWeights(0.5, 0.5, 0.5, 0.5)


def test_perfect_table(make):
    rules = CheckRules(id_columns=["user_id"], format_rules={"email": "email"}, range_rules={"age": {"min": 18, "max": 65}})
    df = make("user_id bigint, email string, age bigint", [(100 + i, f"u{i}@ex.com", 20 + 5 * i) for i in range(5)])
    result = K.score(df, rules)
    assert (result.overall_score, result.grade, result.is_trustworthy) == (100.0, "A", True)


def test_dirty_table_loses_in_every_dimension(make):
    df = make("id bigint, age double, status string", [(1, 25.0, "Active"), (1, -10.0, "active"), (3, None, "ACTIVE"), (4, 40.0, "Inactive")])
    result = K.score(df, CheckRules(id_columns=["id"], range_rules={"age": {"min": 0, "max": 120}}))
    assert all(d.score < 100 for d in result.dimensions.values())
    assert result.dimensions["uniqueness"].score == 50.0
    assert result.dimensions["consistency"].defects_count == 3


def test_scores_of_a_known_report():
    issues = [Q.Issue("MISSING", "CRITICAL", None, "", 13117, 0.0), Q.Issue("INCONSISTENT_CATEGORY", "INFO", None, "", 15, 0.0), Q.Issue("OUTLIER", "INFO", None, "", 1428, 0.0)]
    result = K.score_report(Q.QualityReport(8807, 14, issues))
    assert result.overall_score == 96.81
    cleaned = K.score_report(Q.QualityReport(8807, 14, [Q.Issue("MISSING", "WARNING", None, "", 8823, 0.0), Q.Issue("INCONSISTENT_CATEGORY", "INFO", None, "", 15, 0.0)]))
    assert K.ScoreComparison(result, cleaned).score_delta == 1.04


def test_comparison(make):
    before = make("id bigint, city string, val double", [(1, "A", 1.0), (2, "B", None), (1, "A", 1.0)])
    after = make("id bigint, city string, val double", [(1, "A", 1.0), (2, "B", 1.0)])
    comparison = K.compare(before, after)
    assert comparison.score_delta > 0
    assert comparison.after.dimensions["completeness"].score == 100.0
    assert comparison.after.dimensions["uniqueness"].score == 100.0
