import hashlib

from pyspark.sql import functions as F

from veracol.llm import queries, quote_links, warc_fixity
from veracol.llm.quote_links import link_quotes
from veracol.llm.warc_fixity import audit, lay_out

PAGES = [(i, f"http://h/{i}", f"<p>{i}é</p>" * (i % 5)) for i in range(2500)] + [(None, "u", "h"), (None, None, None), (7, "http://h/7", "again"), (2600, "", "x" * 200_000), (8, "http://h/8", PAGE8 := "<p>8é</p>" * 3)]


SCHEMA = "page_id bigint, url string, html string"


def test_layout(spark):
    pages = spark.createDataFrame([(*p, 1) for p in PAGES] + [(9, "http://h/9", "<p>9é</p>" * 4, 1)] * 3, f"{SCHEMA}, digest int")
    rows = lay_out(pages).collect()
    assert sum(r.copies for r in rows) == len(PAGES) + 3 and [r.copies for r in rows if r.page_id == 9] == [4]
    by_archive = {}
    for r in rows:
        by_archive.setdefault(r.archive, []).append(r)
    assert sum(len(v) for k, v in by_archive.items() if k < 0) == 2
    for group in by_archive.values():
        group.sort(key=lambda r: r.start)
        assert [r.start for r in group] == [0, *(r.stop for r in group[:-1])]
        assert [(r.place, r.digest) for r in group] == sorted((r.place, r.digest) for r in group)
    html = "<p>3é</p>" * 3
    record = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:3>\r\nWARC-Target-URI: http://h/3\r\nContent-Length: {len(html.encode())}\r\n\r\n{html}\r\n\r\n".encode()
    (third,) = [r for r in rows if r.page_id == 3]
    assert third.digest == hashlib.sha256(record).hexdigest() and third.stop - third.start == len(record)


def differences(spark, left, right):
    found = audit(lay_out(spark.createDataFrame(left, SCHEMA)), lay_out(spark.createDataFrame(right, SCHEMA)))
    return sorted(((r.page_id, r.status) for r in found.collect()), key=str)


def test_audit_finds_exactly_the_damage(spark):
    """Replicas laid out by themselves: what a loss moves is not damage."""
    lost, changed = (5, 2600, 0, 1030), (15, 16, 1023, 1024, 2499)
    copy = [(i, u, "bad" if i in changed else h) for i, u, h in PAGES if i not in lost] + [(5000, "u", "new"), (-3, "u", "new")]
    assert differences(spark, PAGES, copy) == sorted([(i, "missing") for i in lost] + [(i, "corrupt") for i in changed] + [(5000, "extra"), (-3, "extra")], key=str)
    assert differences(spark, PAGES, PAGES[::-1]) == []
    assert differences(spark, [], []) == [] and len(differences(spark, PAGES, [])) == len(PAGES)
    assert differences(spark, [], PAGES[:3]) == [(0, "extra"), (1, "extra"), (2, "extra")]


def test_audit_of_nulls_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(warc_fixity, "_BATCH", 3)
    left = [(1, "u", "a"), (1, "u", "b"), (None, "u", "n"), (None, None, None), (2, "u", "x"), (2, "u", "x"), (3, "u", "y"), (-1, "u", "z")] + [(4, "u", "many")] * 10
    assert differences(spark, left, left) == []
    assert differences(spark, left, [r for r in left if r != (1, "u", "b")]) == [(1, "missing")]
    assert differences(spark, left, [(1, "u", "c") if r == (1, "u", "b") else r for r in left]) == [(1, "corrupt")]
    assert differences(spark, left, [*left[:4], *left[5:]]) == [(2, "missing")]
    assert differences(spark, left, [*left, (3, "u", "y"), (3, "u", "w")]) == [(3, "extra"), (3, "extra")]
    assert differences(spark, left, [(None, "u", "m") if r == (None, "u", "n") else r for r in left]) == [(None, "extra"), (None, "missing")]
    assert differences(spark, left, left[:-7]) == [(4, "missing")] * 7
    assert differences(spark, left, [*left[:-7], *[(4, "u", "other")] * 9]) == [(4, "corrupt")] * 7 + [(4, "extra")] * 2


def test_query_on_nulls_and_repeats(spark, tmp_path):
    """The registered query on a table with lost, extra, null and repeated ids, each reported once at its offsets."""
    pages = [(i, "u", f"page {i}") for i in range(1200)] + [(13, "u", "again"), (5, "u", "page 5"), (None, "u", "n"), (None, "u", "n")]
    spark.createDataFrame(pages, SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    rows = queries.QUERIES["op6_warc_fixity"](spark, str(tmp_path)).collect()
    lost = [5, *[i for i in range(1200) if i % 211 == 5]]
    cut_short = [i for i in range(1200) if i % 307 == 7 or i % 97 == 13]
    corrupt = [13, *[i for i in cut_short if i not in lost]]
    extra = [i + queries.ADDED_FROM for i in range(1200) if i % 389 == 3]
    assert sorted((r.page_id, r.status) for r in rows) == sorted([(i, "missing") for i in lost] + [(i, "corrupt") for i in corrupt] + [(i, "extra") for i in extra])
    spans = sorted((r.archive, r.start, r.stop) for r in rows)
    assert all(a[0] < b[0] or a[2] <= b[1] for a, b in zip(spans, spans[1:]))


MESSAGES = [
    (1, 0, "a", "Hello there\nSecond line"),
    (1, 1, "b", "> hello  THERE\nYes"),
    (1, 2, "a", ">> Hello there\n> yes\nMore"),
    (1, 3, "b", "Something else\n\n>"),
    (1, 4, "a", "> Second line\n> Hello there\n> Yes\nboth"),
    (1, 5, "c", None),
    (1, 6, "c", ""),
    (1, 7, "c", "> nobody said this\nreply"),
    (2, 0, "a", "> Hello there\nother conversation"),
    (1, 8, "d", "yes"),
    (1, 9, "d", "> Yes\nto the later one"),
    (1, 9, "d", "> Yes\nto the later one"),
    (None, 0, "a", "> Hello there\nno conversation"),
    (3, None, "a", "> x\nno turn"),
    (4, 0, "a", "long line " * 20000),
    (4, 1, "b", "> " + "long line " * 20000 + "\nok"),
]


def test_links(spark):
    rows = spark.createDataFrame([(*m, "x", 1) for m in MESSAGES], "conv_id bigint, turn bigint, role string, text string, thread string, hash int")
    got = {(r.conv_id, r.turn): r for r in link_quotes(rows).collect()}
    assert link_quotes(rows).count() == len(MESSAGES)
    parent = {k: r.parent_turn for k, r in got.items()}
    assert parent == {(1, 0): None, (1, 1): 0, (1, 2): 1, (1, 3): None, (1, 4): 0, (1, 5): None, (1, 6): None, (1, 7): None, (2, 0): None, (1, 8): None, (1, 9): 8, (None, 0): None, (3, None): None, (4, 0): None, (4, 1): 0}
    assert [(got[1, t].thread, got[1, t].depth, got[1, t].position) for t in (0, 1, 2, 4, 8)] == [(0, 0, 1), (0, 1, 2), (0, 2, 3), (0, 1, 4), (8, 0, 1)]
    assert (got[1, 2].n_quoted, got[1, 2].n_linked, got[1, 2].levels, got[1, 2].text) == (2, 2, 2, "More")
    assert (got[1, 7].n_quoted, got[1, 7].n_linked) == (1, 0)
    assert got[1, 5].text is None and got[1, 6].text == "" and got[1, 3].text == "Something else\n"
    assert link_quotes(rows.where("false")).count() == 0


def test_long_conversations_in_blocks(spark, monkeypatch):
    """A chain of replies and a common line, over many blocks of turns."""
    monkeypatch.setattr(quote_links, "BLOCK", 7)
    rows = [(1, i, "u", f"line {i}\nok") if i % 30 == 0 else (1, i, "u", f"> line {i - 1}\nline {i}\nok") for i in range(200)]
    rows += [(1, 500, "u", "> ok\nlast")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.turn: r for r in link_quotes(df).collect()}
    for i in range(200):
        assert (got[i].thread, got[i].depth, got[i].position) == (i - i % 30, i % 30, i % 30 + 1)
    assert got[500].parent_turn == 199 and got[500].depth == 199 % 30 + 1


def test_native_plan(spark):
    df = spark.createDataFrame(MESSAGES, "conv_id bigint, turn bigint, role string, text string")
    plan = link_quotes(df).select(F.count(F.lit(1)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_audit_heights(spark, monkeypatch):
    monkeypatch.setattr(warc_fixity, "RECORDS", 100_000)
    pages = spark.createDataFrame(PAGES, SCHEMA)
    expected = warc_fixity.lay_out(pages)
    other = expected.withColumn("digest", F.when(F.col("page_id") == 1234, "bad").otherwise(F.col("digest")))
    assert [(r.status, r.found) for r in audit(expected, other, fan=4).collect()] == [("corrupt", "bad")]
