"""Rows without an order key, unknown columns, and rules only one regex dialect knows."""

import random

import pytest
from pyspark.sql import functions as F

from veracol.functions.columns import ROW_ID
from veracol.operators.checks import case_variant_report, format_pattern
from veracol.operators.clean import CleaningRules, clean
from veracol.operators.duplicates import drop_duplicate_rows
from veracol.operators.fills import fill_in_order, order_blocks


def test_unknown_key_columns_are_an_error(make):
    df = make("id long, v string", [(1, "a"), (1, "b")])
    for names in (["typo"], ["id", "typo"]):
        with pytest.raises(ValueError, match="typo"):
            drop_duplicate_rows(df, names)


@pytest.mark.parametrize(("keep", "wanted"), [("first", {(1, "b"), (2, "c")}), ("last", {(1, "a"), (2, "c")})])
def test_rows_without_order_key_survive_whole(spark, keep, wanted):
    df = spark.createDataFrame([(1, "a", None), (1, "b", 4), (2, "c", None)], "id long, v string, at long")
    assert {(r.id, r.v) for r in drop_duplicate_rows(df, ["id"], keep, order_by="at").collect()} == wanted


@pytest.mark.parametrize("way", ["ffill", "bfill"])
def test_fills_keep_rows_without_order_key(spark, way):
    df = spark.createDataFrame([("a", 1), (None, 2), ("c", 3), (None, None), ("e", None)], "v string, at long")
    rows = fill_in_order(df, {"v": way}, order_by="at").collect()
    assert len(rows) == 5 and {r.at: r.v for r in rows if r.at is not None} == {1: "a", 2: "a" if way == "ffill" else "c", 3: "c"}
    alone = df.where("at IS NULL")
    assert fill_in_order(alone, {"v": way}, order_by="at").count() == 2


def tied_rows(n=600):
    """A third of the rows has one order key, another third has none; ``seq`` orders rows of one key."""
    random.seed(3)
    places = [5 if i % 3 == 0 else None if i % 3 == 1 else i for i in range(n)]
    return [(None if random.random() < 0.8 else f"v{i}", at, i if i % 7 else -i) for i, at in enumerate(places)]


def one_pass(rows, way, key):
    order = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, key(r)), reverse=way == "bfill")
    out, last = {}, None
    for v, at, seq in order:
        last = v if v is not None else last
        out[at, seq] = last
    return out


@pytest.mark.parametrize("rows_per_block", [5, 40, 100_000])
@pytest.mark.parametrize("way", ["ffill", "bfill"])
def test_fills_with_tied_keys(spark, way, rows_per_block):
    rows = tied_rows()
    df = spark.createDataFrame(rows, "v string, at long, seq long").repartition(5)
    filled = fill_in_order(df, {"v": way}, order_by="at", rows_per_block=rows_per_block, then_by="seq")
    assert filled.columns == df.columns
    assert {(r.at, r.seq): r.v for r in filled.collect()} == one_pass(rows, way, lambda r: r[2])


def test_fills_with_ties_do_not_depend_on_partitions(spark):
    rows = tied_rows()
    results = []
    for parts in (1, 3, 7):
        df = spark.createDataFrame(rows, "v string, at long, seq long").repartition(parts)
        results.append({(r.at, r.seq): r.v for r in fill_in_order(df, {"v": "ffill"}, order_by="at", rows_per_block=20).collect()})
    assert len(results[0]) == len(rows) and results[0] == results[1] == results[2]


def test_one_key_over_many_blocks(spark):
    df = spark.createDataFrame([(i,) for i in range(4000)], "seq long").select(F.lit(9).cast("bigint").alias("__rid_test"), "seq")
    cut = order_blocks(df.withColumnRenamed("__rid_test", ROW_ID), rows_per_block=20, tie="seq")
    blocks = [r["__block"] for r in cut.orderBy("seq").collect()]
    assert blocks == sorted(blocks) and len(set(blocks)) >= 4
    assert max(map(blocks.count, set(blocks))) <= 4 * 500


@pytest.mark.parametrize("grouping", ["exact", "fingerprint"])
def test_casing_report_of_very_many_spellings(spark, grouping):
    """One value in 100 000 spellings: the report shows the first and counts the rest."""
    spell = F.concat(*[F.when(F.expr(f"(id >> {bit}) & 1 = 1"), F.lit(letter.upper())).otherwise(F.lit(letter)) for bit, letter in enumerate("abcdefghijklmnopq")])
    df = spark.range(100_000, numPartitions=4).select(spell.alias("v"), F.col("id").alias(ROW_ID))
    few = spark.createDataFrame([("x", 200_000), ("X", 200_001), ("x", 200_002)], f"v string, {ROW_ID} bigint")
    report = case_variant_report(df.unionByName(few), ["v"], grouping=grouping, most_spellings=3)
    assert report == {"v": (100_003, ["{abcdefghijklmnopq, Abcdefghijklmnopq, aBcdefghijklmnopq, ... 99997 more}", "{x, X}"])}


def test_boolean_as_text(make):
    df = make("flag boolean", [(True,), (False,), (None,)])
    out = clean(df, CleaningRules(type_conversions={"flag": "str"})).cleaned
    assert sorted(str(r.flag) for r in out.collect()) == ["False", "None", "True"]


def test_pattern_the_engine_cannot_compile(spark):
    assert format_pattern(r"(a)?(?(1)b|c)") is None
    assert format_pattern(r"[a-z]+") is not None
