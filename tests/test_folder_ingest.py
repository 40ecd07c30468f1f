"""A folder's files ingested together must come out as each would alone."""

import os

import pytest

from veracol.plans import folder_ingest
from veracol.plans.catalog import Catalog
from veracol.plans.folder_ingest import ingest_folder
from veracol.operators.checks import analyze
from veracol.operators.profile import profile
from veracol.operators.score import score_report
from veracol.sources.csv_source import read_csv


def _orders(n, start=0, bad=False):
    lines = ["id,amount,city,when"]
    for i in range(start, start + n):
        amount = "" if i % 7 == 0 else ("n/a" if i % 11 == 0 else ("oops" if bad and i == start + 3 else str(i * 1.5 + (5000 if i % 23 == 0 else 0))))
        lines.append(f"{i},{amount},{['Rom', 'rom ', 'ROM', 'Paris', ''][i % 5]},2024-01-{1 + i % 28:02d}")
    return lines + lines[1:3]


@pytest.fixture
def landing(tmp_path):
    files = {
        "a plain.csv": _orders(60),
        "b+plus.csv": _orders(45, 100),
        "c%20text.csv": _orders(30, 7, bad=True),  # amount is text here
        "sub/other.CSV": ["x;y,flag", "1,true", "2,false", ",", "2,false"],
        "sub/head only.csv": ["id,amount,city,when"],
        "notes.txt": ["id"],
        "fake.csv": ["MZ"],
    }
    for name, lines in files.items():
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("\n".join(lines) + "\n")
    (tmp_path / "in" / "empty.csv").write_text("")
    return tmp_path


def test_each_file_as_if_alone(spark, landing):
    catalog = Catalog(spark, str(landing / "catalog"))
    results, screened = ingest_folder(catalog, str(landing / "in"), "u1")
    names = {os.path.basename(r.path): r for r in results}
    assert set(names) == {"a plain.csv", "b+plus.csv", "c%20text.csv", "other.CSV", "head only.csv"}
    assert {r["file_name"]: r["reason"] for r in screened.where("not accepted").collect()} == {"notes.txt": "unsupported type", "fake.csv": "windows executable", "empty.csv": "empty"}
    for result in results:
        alone = read_csv(spark, result.path.replace("file:", ""))
        report = analyze(alone)
        key = lambda i: (i.category, i.column or "")
        told = [(*key(i), i.severity, i.affected_count, i.affected_percentage, i.description) for i in sorted(result.report.issues, key=key)]
        want = [(*key(i), i.severity, i.affected_count, i.affected_percentage, i.description) for i in sorted(report.issues, key=key)]
        assert told == want, result.path
        assert result.score == score_report(report)
        stored = catalog.load_version(result.version.id)
        assert sorted(map(str, stored.drop("__rid").collect())) == sorted(map(str, alone.drop("__rid").collect()))
        assert result.version.row_count == report.total_rows
        if report.total_rows:
            columns = profile(alone).columns
            for name, told in result.profile.items():
                assert told["unique"] == columns[name]["unique_count"] and told["nulls"] == columns[name]["null_count"]
                if columns[name]["numeric_stats"]:
                    numbers = columns[name]["numeric_stats"]
                    assert {k: round(told[k], 4) for k in ("min", "max", "mean", "median", "q25", "q75")} == {k: numbers[k] for k in ("min", "max", "mean", "median", "q25", "q75")}
                if columns[name]["text_stats"]:
                    assert told["top_values"] == columns[name]["text_stats"]["top_values"]
    listed = {r["original_filename"]: r for r in catalog.listing().collect()}
    assert len(listed) == 5 and listed["a plain.csv"]["latest_quality_score"] == names["a plain.csv"].score.overall_score
    assert listed["a plain.csv"]["user_id"] == "u1"
    for table in ("datasets", "versions", "reports", "issues"):
        files = [f for f in os.listdir(landing / "catalog" / "meta" / table / "gen=0") if f.endswith(".parquet")]
        assert len(files) == 1, table


def test_jobs_do_not_grow_with_the_files(spark, tmp_path):
    jobs = {}
    for count in (2, 9):
        for i in range(count):
            path = tmp_path / f"in{count}" / f"f{i}.csv"
            path.parent.mkdir(exist_ok=True)
            path.write_text("\n".join(_orders(25, 25 * i)) + "\n")
        spark.sparkContext.setJobGroup(f"folder{count}", "")
        ingest_folder(Catalog(spark, str(tmp_path / f"c{count}")), str(tmp_path / f"in{count}"))
        jobs[count] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"folder{count}"))
    spark.sparkContext.setJobGroup("", "")
    assert jobs[9] <= jobs[2] + 6, jobs


def test_report_names_few_of_many_spellings(spark, tmp_path):
    word = "abcdefghijk"
    spelled = {"".join(c.upper() if n >> k & 1 else c for k, c in enumerate(word)) for n in range(2000)}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f.csv").write_text("w\n" + "\n".join(sorted(spelled)) + "\n")
    ((result,), _) = ingest_folder(Catalog(spark, str(tmp_path / "c")), str(tmp_path / "in"))
    (issue,) = [i for i in result.report.issues if i.category == "INCONSISTENT_CATEGORY"]
    assert issue.affected_count == 2000 and issue.sample_values[0].endswith("and 1,995 more}")
    assert issue.sample_values[0].count(",") == folder_ingest.SHOWN


def test_empty_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.txt").write_text("a")
    results, screened = ingest_folder(Catalog(spark, str(tmp_path / "c")), str(tmp_path / "in"))
    assert results == [] and screened.count() == 1
