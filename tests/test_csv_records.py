"""CSV files whose records span lines, read in splits, against Python's own reader."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from veracol.functions.columns import ROW_ID
from veracol.sources import csv_source
from veracol.sources.csv_source import MalformedCsv, csv_records, malformed_rows, read_csv, read_csv_text


@pytest.fixture
def small_splits(spark):
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def _cell(rng):
    return rng.choice(["", "a", "é x", '"quoted"', "two\nlines", "with, comma", 'say ""hi""', "\n", "three\n\n\nlines", "plain", "12", 'end"', "x\r\ny"])


def _written(rows, ending="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=ending).writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_random_files_in_small_splits(spark, tmp_path, small_splits, ending):
    rng = random.Random(3)
    expected = []
    for name in ("b.csv", "a.csv", "c d.csv"):
        rows = [[str(i), _cell(rng), _cell(rng)] for i in range(rng.randint(30, 90))]
        (tmp_path / name).write_bytes(_written([["id", "one", "two"], *rows], ending).encode())
        expected.append((name, rows))
    expected = [row for _, rows in sorted(expected) for row in rows]
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
    df = read_csv_text(spark, str(tmp_path), na_tokens=())
    got = [[r["id"], r["one"] or "", r["two"] or ""] for r in df.orderBy(ROW_ID).collect()]
    assert got == expected
    assert malformed_rows(spark, str(tmp_path)).where("surplus_rows > 0").isEmpty()


def test_states_of_single_lines(spark):
    lines = {'a,"b': (1, 0), "a,b": (0, 1), 'x,5" pipe': (0, 0), '"a""': (1, 0), '"a"': (0, 0), 'a","b': (1, 1), '"': (1, 0), '""': (0, 1), 'q"x,"y': (1, 1), '"a" x,"b': (1, 1), "": (0, 1), 'a"",b': (0, 1)}
    df = spark.createDataFrame([(t,) for t in lines], "value string")
    got = {r[0]: (int(r[1]), int(r[2])) for r in df.select("value", F.col("value").rlike(csv_source.OPENS), F.col("value").rlike(csv_source.STAYS_OPEN)).collect()}
    assert got == lines


def test_stray_quotes_do_not_join_lines(spark, tmp_path):
    (tmp_path / "f.csv").write_text('size,n\n5" pipe,1\n6" pipe,2\n"two\nlines",3\n')
    rows = [(r["size"], r["n"]) for r in read_csv(spark, str(tmp_path)).orderBy(ROW_ID).collect()]
    assert rows == [('5" pipe', 1), ('6" pipe', 2), ("two\nlines", 3)]


def test_surplus_cells_and_open_quotes_are_refused(spark, tmp_path):
    for number, text in enumerate(("a,b\n1,2\n3,4,5\n6\n", 'a,b\n"x\ny",2\n3,4,5\n6\n')):
        path = tmp_path / f"f{number}.csv"
        path.write_text(text)
        with pytest.raises(MalformedCsv, match="1 rows have more cells"):
            read_csv(spark, str(path))
        assert [tuple(r)[1:] for r in malformed_rows(spark, str(path)).collect()] == [(3, 1)]
        rows = [(r["a"], r["b"]) for r in read_csv(spark, str(path), surplus="cut").orderBy(ROW_ID).collect()]
        assert rows == [(1 if not number else "x\ny", 2), (3 if not number else "3", 4), (6 if not number else "6", None)]
    (tmp_path / "open.csv").write_text('a,b\n1,"x\n2,y\n')
    with pytest.raises(MalformedCsv, match="open.csv"):
        csv_records(spark, str(tmp_path / "open.csv"))


def test_order_follows_names_and_places(spark, tmp_path, small_splits):
    for name, start, n in (("b", 1000, 400), ("a", 0, 20), ("c", 5000, 100)):
        (tmp_path / f"{name}.csv").write_text("v\n" + "\n".join(str(start + i) for i in range(n)) + "\n")
    got = [r["v"] for r in read_csv(spark, str(tmp_path)).orderBy(ROW_ID).collect()]
    assert got == [*range(20), *range(1000, 1400), *range(5000, 5100)]


def test_header_names(spark, tmp_path):
    (tmp_path / "f.csv").write_text('path,,line,path,"x\ny"\n1,2,3,4,"a\nb"\n')
    df = read_csv_text(spark, str(tmp_path / "f.csv"))
    assert [c for c in df.columns if c != ROW_ID] == ["path0", "_c1", "line", "path3", "x\ny"]
    assert [tuple(r)[:5] for r in df.collect()] == [("1", "2", "3", "4", "a\nb")]
