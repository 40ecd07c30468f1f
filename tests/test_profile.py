"""Profiles of small tables with known figures."""

import math

import pytest
from pyspark.sql import functions as F

from veracol.operators import profile as P
from veracol.operators import quantiles
from veracol.operators.quantiles import exact_quantiles


def test_known_statistics(make):
    people = make(
        "id bigint, name string, age double, score double, is_active boolean",
        [(1, "Ann", 25.0, 80.5, True), (2, "Bob", 30.0, 90.0, False), (3, None, 35.0, 70.0, True), (4, "Dan", None, 60.0, True), (5, "Eve", 40.0, 99.5, False)],
    )
    result = P.profile(people)
    assert result.summary["total_rows"] == 5
    assert result.summary["total_columns"] == 5
    assert result.summary["total_cells"] == 25
    assert result.summary["total_missing_cells"] == 2
    assert result.summary["missing_percentage"] == 8.0
    assert result.summary["duplicate_rows"] == 0
    assert result.summary["column_types_breakdown"] == {"numeric": 3, "text": 1, "boolean": 1}
    age = result.columns["age"]["numeric_stats"]
    assert (age["min"], age["max"], age["mean"], age["median"]) == (25.0, 40.0, 32.5, 32.5)
    assert age["std"] == round(math.sqrt(125 / 3), 4)
    assert result.columns["is_active"]["text_stats"]["top_values"] == {"True": 3, "False": 2}
    assert [r["column"] for r in result.missing_rankings] == ["name", "age"]
    assert '"total_rows": 5' in result.to_json()


def test_exact_duplicates(make):
    df = make("col_a bigint, col_b string", [(1, "x"), (2, "y"), (1, "x"), (3, "z")])
    summary = P.profile(df).summary
    assert summary["duplicate_rows"] == 1
    assert summary["duplicate_percentage"] == 25.0
    row = P.duplicate_report(df).first()
    assert (row["duplicate_rows"], row["affected_rows"]) == (1, 2)
    fingerprinted = P.duplicate_report(df, method="fingerprint").first()
    assert fingerprinted["duplicate_rows"] == 1


def test_fingerprint_tells_null_positions_apart(make):
    df = make("a string, b string", [("x", None), (None, "x"), ("x", None)])
    assert P.duplicate_report(df, method="fingerprint").first()["duplicate_rows"] == 1


def test_empty_and_columnless_tables(spark, make):
    empty = make("id bigint, name string, val double", [])
    result = P.profile(empty)
    assert result.summary["total_rows"] == 0 and result.summary["total_columns"] == 3
    assert result.summary["total_cells"] == 0 and result.summary["missing_percentage"] == 0.0
    assert len(result.columns) == 3
    bare = spark.createDataFrame([], "a int").drop("a")
    assert P.profile(bare).summary["total_cells"] == 0


def test_single_value_has_zero_deviation(make):
    df = make("v double", [(7.0,)])
    stats = P.profile(df).columns["v"]["numeric_stats"]
    assert stats == {"min": 7.0, "max": 7.0, "mean": 7.0, "median": 7.0, "std": 0.0, "q25": 7.0, "q75": 7.0}


def test_text_dates_are_recognised(make):
    rows = [("September 9, 2019",), ("September 10, 2019",), (None,), ("October 1, 2020",), ("not_a_date",), ("May 2, 2021",)]
    column = P.profile(make("added string", rows)).columns["added"]
    assert column["semantic_type"] == "datetime"
    assert column["datetime_stats"] == {"min_date": "2019-09-09 00:00:00", "max_date": "2021-05-02 00:00:00"}


def test_date_range_uses_the_format_of_the_first_value(make):
    rows = [("15/01/2023",), ("14/02/2023",), ("2023-03-01",), ("02/25/2023",), ("01/02/2023",)]
    stats = P.profile(make("d string", rows), date_rule="first").columns["d"]["datetime_stats"]
    assert stats == {"min_date": "2023-01-15 00:00:00", "max_date": "2023-02-14 00:00:00"}


def test_dates_are_judged_by_all_values(make):
    rows = [("15/01/2023",), ("14/02/2023",), ("2023-03-01",), ("02/25/2023",), ("01/02/2021",), ("none",)]
    column = P.profile(make("d string", rows)).columns["d"]
    assert column["semantic_type"] == "datetime" and column["datetime_stats"] == {"min_date": "2021-01-02 00:00:00", "max_date": "2023-03-01 00:00:00"}
    shapes = {r["shape"]: (r["n"], r["dates"]) for r in P.date_shapes(make("d string", rows), ["d"]).collect()}
    assert shapes == {"numeric": (4, 4), "iso": (1, 1), None: (1, 0)}


@pytest.mark.parametrize("n", [50, 500, 501, 2000])
def test_number_of_values_does_not_change_the_type(make, n):
    late = [("x",)] * (n // 10) + [(f"2024-01-{1 + i % 28:02d}",) for i in range(n - n // 10)]
    df = make("d string", late)
    assert P.semantic_types(df) == {"d": "datetime"}
    assert P.semantic_types(df, probe="first") == {"d": "text" if n > 100 else "datetime"}  # the first 50 of 500 are no dates
    assert P.semantic_types(make("d string", [(None,)] * 3)) == {"d": "text"}


def test_top_values_break_ties_by_first_sight(make):
    df = make("v string", [("b",), ("a",), ("b",), ("a",), ("c",), ("e",), ("d",), ("f",)])
    assert list(P.profile(df).columns["v"]["text_stats"]["top_values"]) == ["b", "a", "c", "e", "d"]


def test_nan_is_missing_but_infinity_is_a_value(make):
    df = make("val double", [(10.0,), (float("inf"),), (float("-inf"),), (1e18,), (float("nan"),)])
    column = P.profile(df).columns["val"]
    assert column["null_count"] == 1
    assert column["numeric_stats"]["max"] == float("inf")


def test_type_classes(make):
    df = make("a string, b string, c string, d string", [("1", "x", "2020-01-01", None), ("2.5", "3", "March 4, 2021", None)])
    classes = {row["column_name"]: row["type_class"] for row in P.type_classes(df).collect()}
    assert classes == {"a": "numeric", "b": "mixed", "c": "date", "d": "unknown"}


def test_preview(make):
    df = make("v bigint", [(i,) for i in range(10)])
    assert [r["v"] for r in P.preview(df, 3).collect()] == [0, 1, 2]
    assert [r["v"] for r in P.preview(df, 2, tail=True).collect()] == [9, 8]


def test_footprint_counts_text_bytes(make):
    sizes = {r["column_name"]: r["bytes"] for r in P.footprint(make("v bigint, t string", [(1, "ab"), (2, None)])).collect()}
    assert sizes == {"v": 16, "t": 2}


def _by_sorting(values, p):
    ordered = sorted(values)
    position = (len(ordered) - 1) * p
    low = math.floor(position)
    high = min(low + 1, len(ordered) - 1)
    return ordered[low] if ordered[low] == ordered[high] or position == low else ordered[low] + (ordered[high] - ordered[low]) * (position - low)


PROBABILITIES = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]


@pytest.mark.parametrize("buckets", [2, 50, 4096])
def test_searched_quantiles_match_sorting(make, buckets):
    rows = [(float((i * 7919) % 613),) for i in range(2000)] + [(5.0,)] * 1000 + [(1e9,), (-1e9,)] + [(None,)] * 7
    found = exact_quantiles(make("v double", rows), ["v"], PROBABILITIES, buckets=buckets)["v"]
    assert found == pytest.approx([_by_sorting([v for (v,) in rows if v is not None], p) for p in PROBABILITIES])


def test_searched_quantiles_of_odd_columns(make):
    columns = {
        "wide": [2.0**e * s for e in range(-1000, 1000, 9) for s in (1, -1)],
        "tiny": [5e-324 * i for i in range(100)],
        "huge": [1.7e308, -1.7e308, 0.0, 1.0],
        "infinite": [math.inf] * 3 + [-math.inf] * 2 + [1.0, 2.0],
        "only": [math.inf] * 4,
        "near": [1.0 + 2**-52 * i for i in range(50)],
        "zeros": [0.0] * 500 + [-0.0] * 30 + [1.0, -3.0],
        "negative": [-(2.0**e) for e in range(0, 200)],
        "none": [],
        "nan": [math.nan, 1.0, 2.0],
    }
    height = max(map(len, columns.values()))
    rows = [tuple(v[i] if i < len(v) else None for v in columns.values()) for i in range(height)]
    found = exact_quantiles(make(", ".join(f"{c} double" for c in columns), rows), list(columns), PROBABILITIES, buckets=16)
    for name, column in columns.items():
        column = [v for v in column if not math.isnan(v)]
        want = [_by_sorting(column, p) if column else None for p in PROBABILITIES]
        assert found[name] == [w if w is None or not math.isnan(w) else None for w in want], name


def test_grouped_quantiles_like_one_by_one(make):
    rows = [(g, float((i * 7919) % (40 + 100 * g)) - 30 * g) for g in range(5) for i in range(1, 400 * g)]
    rows += [(7, v) for v in (math.inf, math.inf, 1.0, -math.inf, 2.0)] + [(8, None), (8, math.nan), (9, 5e-324), (9, 1.7e308), (9, -1.7e308), (None, 3.0), (None, 4.0)]
    df = make("g bigint, v double", rows)
    found = {r.g: r for r in quantiles.grouped_quantiles(df, ["g"], PROBABILITIES, buckets=7).collect()}
    assert set(found) == {1, 2, 3, 4, 7, 9}  # a null key joins nothing and is left out, as a group without values is
    for g, row in found.items():
        column = [v for k, v in rows if k == g]
        want = [_by_sorting(column, p) for p in PROBABILITIES]
        assert row.n == len(column) and row.quantiles == [None if math.isnan(w) else w for w in want], g


def test_quantiles_take_the_same_jobs_for_any_number_of_columns(make, spark):
    rows = [tuple(float((i * (7 + c)) % 997) for c in range(40)) for i in range(1500)]
    df = make(", ".join(f"c{c} double" for c in range(40)), rows)
    jobs = {}
    for count in (1, 40):
        spark.sparkContext.setJobGroup(f"quantiles{count}", "")
        exact_quantiles(df, [f"c{c}" for c in range(count)], [0.25, 0.5, 0.75])
        jobs[count] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"quantiles{count}"))
    spark.sparkContext.setJobGroup("", "")
    assert jobs[40] <= jobs[1] + 2
    names = [f"c{c}" for c in range(40)]
    plan = quantiles._grouped(df, [(F.lit(0), F.col(n)) for n in names])._jdf.queryExecution().toString()
    assert "percentile" not in plan and "collect_list" not in plan and plan.count("Exchange hashpartitioning(s") == 1


def test_searched_quantiles_when_one_value_dominates(make):
    rows = [(1.0,)] * 900 + [(float(i),) for i in range(2, 302)]
    df = make("v double", rows)
    assert exact_quantiles(df, ["v"], [0.25, 0.5, 0.75, 0.9], buckets=3)["v"] == pytest.approx(exact_quantiles(df, ["v"], [0.25, 0.5, 0.75, 0.9])["v"])
