import contextlib
import io

from veracol.plans.mart import fact_issues


def test_issues_are_not_sorted_for_their_reports(spark):
    """Issues, the largest table, meet their reports by hash: rows that are sorted would spill."""
    reports = spark.createDataFrame([(7, 1), (8, 1), (9, 2)], "id bigint, version_id bigint")
    versions = spark.createDataFrame([(1, 5), (2, 6)], "id bigint, dataset_id bigint")
    issues = spark.createDataFrame(
        [(i, i % 4 + 6, "missing", "critical", None, "d", 1, 1.0, None) for i in range(8)],
        "id bigint, report_id bigint, category string, severity string, column_name string, description string, affected_count bigint, affected_percentage double, created_at timestamp",
    )
    facts = fact_issues(issues, reports, versions)
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        facts.explain()
    assert "ShuffledHashJoin [report_id" in shown.getvalue()
    assert sorted((r.issue_id, r.version_id, r.dataset_id) for r in facts.collect()) == [(1, 1, 5), (2, 1, 5), (3, 2, 6), (5, 1, 5), (6, 1, 5), (7, 2, 6)]
