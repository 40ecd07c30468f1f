import hashlib
import random
import re

from pyspark.sql import functions as F

from veracol.llm import disclosure
from veracol.llm.disclosure import digest, find_disclosures, places, sanitise

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in twice) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def base(text):
    spans = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if passes(kind, m[0])]
    return sorted(spans)


def listed(text):
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in base(text))


def test_base_spans_like_plain_patterns(spark):
    rng = random.Random(11)
    bits = ["a@b.c", "x", "é😀", "@", ".", "..", "1.2.3.4", "256", "0007", "4111 1111 1111 1111", "4111-1111-1111-1111", "+49 (30) 123-4567", "+", " ", "-", "_", "12", "%", "(", ")", "a.b-c@d-e.f.g", "\n", "5500005555555559"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(8)
    for r in digest(find_disclosures(docs)).collect():
        want = base(texts[r.doc_id])
        got = ",".join(s for s in r.spans.split(",") if s.split(":")[0] in PLAIN)
        assert got == listed(texts[r.doc_id]), texts[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(got.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _, _ in want) for n in range(4)]


def test_odd_rows_and_long_texts(spark):
    long = [
        "a" * 300_000,  # no quadratic search for an @
        "1" * 200_000,  # nor a deep stack
        "1 " * 100_000,
        "+1" + "(" * 100_000,
        "a@b.co " * 30_000,
        "1.1" * 50_000,
    ]
    rows = [(1, None), (2, ""), (None, "x@y.zz"), (3, "x@y.zz"), (3, "x@y.zz"), *[(10 + i, t) for i, t in enumerate(long)]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for name in ("row", "key", "spans", "term", "start"):
        docs = docs.withColumn(name, F.lit("q"))
    found = digest(find_disclosures(docs)).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    assert by[1].spans == by[2].spans == "" and by[None].spans.startswith("email:0:6")
    for i, text in enumerate(long):
        want = listed(text) if i >= 4 else ""  # plain patterns take quadratic time for the first four, which hold nothing
        assert by[10 + i].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert digest(find_disclosures(docs.where("false"))).count() == 0
    assert {tuple(r) for r in sanitise(docs.where("doc_id < 5 or doc_id is null")).collect()} == {(1, ""), (2, ""), (None, "<EMAIL>"), (3, "<EMAIL>")}


def test_terms_that_disclose_go(spark):
    rows = [(i, f"the report on topic{i % 50} is done and the office is open") for i in range(400)]
    rows += [(1000 + i, f"the report by Zebulon from Quito, mail zeb@corp.example or ask Zebulon, topic{i}") for i in range(3)]
    rows += [(2000 + i, f"the Quito office {i}") for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    clean = {r.doc_id: r.text for r in sanitise(docs).collect()}
    assert "Zebulon" not in clean[1001] and "Quito" not in clean[1001] and "zeb@" not in clean[1001]
    assert "the report" in clean[1001] and "topic1" in clean[1001]
    assert all(clean[i] == t for i, t in rows if not 1000 <= i < 2000)  # documents without values stay
    spans = {r.doc_id: r.spans for r in digest(find_disclosures(docs)).collect()}
    text = rows[401][1]
    at = [m.start() for m in re.finditer("Zebulon", text)]
    assert all(f"remove:{a}:{a + 7}" in spans[1001] for a in at)
    assert f"general:{text.index('Quito')}:{text.index('Quito') + 5}" in spans[1001]


def test_running_places(spark):
    text = " ".join("w" * (1 + i % 7) + "é" for i in range(1000))
    row = spark.createDataFrame([(text,)], "t string").select(places(F.col("t"), r"\S+").alias("p")).first()
    assert [(m.start, m.end, m.value) for m in row.p] == [(m.start(), m.end(), m[0]) for m in re.finditer(r"\S+", text)]


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "x@y.zz")], "doc_id bigint, text string")
    values = disclosure.find_values(docs)
    plan = disclosure.disclosing(docs, values)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
