"""Personal data and the terms that give it away. Information-theoretic sanitisation; DataFrame functions only.

Protected values are found by four patterns (leftmost, not overlapping within a kind, a match that fails its test is dropped):
email, ip (no part over 255), card (14 to 19 digits, Luhn sum) and phone (10 to 15 digits).

The corpus says how strongly a term reveals a value. Terms are runs of three or more letters and digits, without case.
A term occurs with a value in a document if it lies within ``REACH`` code points of it and no further than the next match of the value's
pattern; other values are left out. With N documents, n(v) that
hold the value, n(t) that hold the term, and n(t, v) in which they occur together,

    information of v       I(v)    = log2(N / n(v))
    information t gives    I(t; v) = log2(n(t, v) * N / (n(t) * n(v)))          (pointwise mutual information)

A term that occurs with a value in ``LEAST_TOGETHER`` documents or more discloses it if I(t; v) >= ``GENERAL`` * I(v). In every document in
which the two occur together all of the term's occurrences become spans: ``remove`` if it gives the whole information (it occurs
nowhere without the value), else ``general`` (a word gives way to its class, which is too frequent to disclose). Terms
inside of protected values are part of those already. A document without protected values has no spans.

Every row is a document and comes back as a row, repeated ids and null ids included; statistics count rows. A null text is empty and
has no spans; an empty table gives no rows. Texts are read whole, places count code points, ends are exclusive. Equal starts are
ordered by kind, as listed. Only the two named columns are read, so others, whatever their names, take no part.

Work grows with the text: contexts have bounded length, pairs of term and value are counted from contexts (never all pairs
of a document), and counts are combined before they move. Running places within a text are sums of blocks of 64.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import cut

KINDS = ("email", "ip", "card", "phone", "general", "remove")
REACH = 160
LEAST_TOGETHER = 2
GENERAL = 0.7
TERM = r"[\p{L}\p{N}]{3,}"

# The patterns are written so that no text takes quadratic time or a deep stack: a match cannot begin inside of a
# stretch whose beginning has failed, and repeated groups give nothing back.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BLOCK = 64
_SPANS = "array<struct<start:bigint,kind:int,end:bigint,value:string,context:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("bigint"), lambda a, x: a + x)


def _between(numbers: Column, first: Column, last: Column) -> Column:
    """Sum of the elements at places first to last, read in place."""
    return F.aggregate(F.sequence(first, last), F.lit(0).cast("bigint"), lambda a, k: a + numbers[k])


def _running(steps: Column) -> Column:
    """Running sums of an array that is not empty, by blocks."""
    whole = lambda i: F.floor(i / _BLOCK).cast("int")
    sums = lambda s: F.transform(F.sequence(F.lit(0), whole(F.size(s) - 1)), lambda b: _between(s, b * _BLOCK, F.least(b * _BLOCK + _BLOCK, F.size(s)) - 1))
    before = lambda t: F.transform(t, lambda x, b: _between(t, F.lit(0), b) - x)
    inner = lambda s, b: F.transform(s, lambda x, i: b[whole(i)] + _between(s, whole(i) * _BLOCK, i))
    return _let(steps, lambda s: _let(_let(sums(s), before), lambda b: inner(s, b)))


def places(text: Column, pattern: str) -> Column:
    """All matches of a pattern in a text: array of (start, end, value, left, right).

    ``left`` and ``right`` are up to ``REACH`` code points around a match, up to its neighbours.
    """

    def located(found: Column, gaps: Column) -> Column:
        ends = _running(F.transform(found, lambda m, i: (F.length(gaps[i]) + F.length(m)).cast("bigint")))
        fields = lambda m, i, e: [(e - F.length(m)).alias("start"), e.alias("end"), m.alias("value"), F.right(gaps[i], F.lit(REACH)).alias("left"), F.left(gaps[i + 1], F.lit(REACH)).alias("right")]
        return _let(ends, lambda e: F.transform(found, lambda m, i: F.struct(*fields(m, i, e[i]))))

    parted = lambda found: _let(F.split(text, pattern, -1), lambda gaps: located(found, gaps))
    nothing = F.array().cast("array<struct<start:bigint,end:bigint,value:string,left:string,right:string>>")
    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, nothing).otherwise(parted(found)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a Luhn sum divisible by 10."""
    weighted = lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)
    numbers = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("bigint"))
    return _total(F.transform(numbers, weighted)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = _digits(value)
    return {
        "email": lambda: F.lit(True),
        "ip": lambda: F.forall(F.split(value, r"\."), lambda part: part.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$")),
        "card": lambda: F.length(digits).between(14, 19) & luhn(digits),
        "phone": lambda: F.length(digits).between(10, 15),
    }[kind]()


def _normal(kind: str, value: Column) -> Column:
    """One spelling for one protected value."""
    return {"email": F.lower(value), "ip": value, "card": _digits(value), "phone": _digits(value)}[kind]


def protected(text: Column) -> Column:
    """The protected values of a text: array of (start, kind number, end, value, context), in order."""
    return F.array_sort(F.concat(*[_kind_spans(text, number) for number in range(len(PATTERNS))]))


def _kind_spans(text: Column, number: int) -> Column:
    kind, pattern = list(PATTERNS.items())[number]
    value = lambda m: F.concat(F.lit(f"{kind} "), _normal(kind, m["value"])).alias("value")
    valid = F.filter(places(text, pattern), lambda m: _valid(kind, m["value"]))
    spans = F.transform(valid, lambda m: F.struct(m["start"].alias("start"), F.lit(number).alias("kind"), m["end"].alias("end"), value(m), _context(m).alias("context")))
    sign = {"email": "@", "ip": ".", "phone": "+"}.get(kind)
    return F.when(text.contains(sign), spans).otherwise(F.array().cast(_SPANS)) if sign else spans


def _context(match: Column) -> Column:
    """What lies around a value, words cut by the edges and other values left out."""
    left, right = match["left"], match["right"]
    left = F.when(F.length(left) == REACH, F.regexp_replace(left, r"^[\p{L}\p{N}]+", "")).otherwise(left)
    right = F.when(F.length(right) == REACH, F.regexp_replace(right, r"[\p{L}\p{N}]+$", "")).otherwise(right)
    return F.regexp_replace(F.concat(left, F.lit("\n"), right), "|".join(PATTERNS.values()), "\n")


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def find_values(docs: DataFrame, key: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """Written rows (row, key, spans, text) of all documents; only if ``whole`` with texts without protected values."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), body.alias("text"))
    rows = rows.select("row", "key", "text", protected(F.col("text")).alias("spans"))
    return cut(rows if whole else rows.withColumn("text", F.when(F.size("spans") > 0, F.col("text"))))


def disclosing(docs: DataFrame, values: DataFrame, text: str = "text") -> DataFrame:
    """(row, term, whole): terms that disclose a value of the row's document, whether they give its whole information."""
    n = values.count()
    held = values.where("size(spans) > 0").select("row", F.explode("spans").alias("span")).select("row", "span.value", "span.context")
    near = cut(held.select("row", "value", F.explode(_terms(F.col("context"))).alias("term")).distinct())
    together = near.groupBy("value", "term").agg(F.count(F.lit(1)).alias("both")).where(F.col("both") >= LEAST_TOGETHER)
    holding = held.select("row", "value").distinct().groupBy("value").agg(F.count(F.lit(1)).alias("with_value"))
    using = docs.select(F.explode(_terms(F.col(text).cast("string"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("with_term"))
    pairs = together.join(holding, "value").join(using, "term")
    shared = F.log2(F.col("both") * F.lit(float(n)) / (F.col("with_term") * F.col("with_value")))
    told = pairs.where((F.col("with_value") < n) & (shared >= GENERAL * F.log2(F.lit(float(n)) / F.col("with_value"))))
    told = told.select("value", "term", (F.col("both") == F.col("with_term")).alias("whole"))
    return near.join(told, ["value", "term"]).groupBy("row", "term").agg(F.max("whole").alias("whole"))


def _term_spans(values: DataFrame, terms: DataFrame) -> DataFrame:
    """(row, added): spans of the disclosing terms, those that touch protected values left out."""
    texts = values.join(terms.select("row").distinct(), "row", "left_semi")
    words = texts.select("row", F.explode(places(F.col("text"), TERM)).alias("w")).select("row", F.lower("w.value").alias("term"), "w.start", "w.end")
    words = words.join(terms, ["row", "term"]).select("row", "start", "end", F.when(F.col("whole"), 5).otherwise(4).alias("kind"))
    known = texts.select("row", F.explode("spans").alias("s")).select("row", "s.start", "s.end", "s.kind")
    order = Window.partitionBy("row").orderBy("start")
    value = F.col("kind") < 4
    covered = F.max(F.when(value, F.col("end"))).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    following = F.min(F.when(value, F.col("start"))).over(order.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    rows = words.unionByName(known).select("row", "start", "end", "kind", covered.alias("covered"), following.alias("following"))
    free = rows.where("kind >= 4 AND coalesce(covered, 0) <= start AND coalesce(following, end) >= end")
    span = F.struct("start", "kind", "end", F.lit("").alias("value"), F.lit("").alias("context"))
    return free.groupBy("row").agg(F.collect_list(span).alias("added"))


def find_disclosures(docs: DataFrame, key: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """Written rows (row, key, text, base, spans): protected values, and these with the spans of disclosing terms.

    Spans are arrays of (start, kind number, end, value, context) by start and kind; ``text`` is null without spans, but if ``whole``.
    """
    values = find_values(docs, key, text, whole)
    terms = cut(disclosing(docs, values, text))
    rows = values.join(_term_spans(values, terms), "row", "left")
    everything = F.when(F.col("added").isNull(), F.col("spans")).otherwise(F.array_sort(F.concat("spans", "added")))
    return cut(rows.select("row", "key", "text", F.col("spans").alias("base"), everything.alias("spans")))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Numbers of protected values by kind, the digest of their places, and all spans as text."""
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, number))).cast("bigint").alias(f"n_{kind}") for number, kind in enumerate(PATTERNS)]
    return found.select(F.col("key").alias(key), *counts, F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) of every row: values give way to their kinds, disclosing terms to their classes or to nothing.

    Values that overlap go as one. A null text comes back empty.
    """
    found = find_disclosures(docs, key, text, whole=True)
    spans = found.select("row", F.explode("spans").alias("s")).select("row", "s.start", "s.end", "s.kind")
    order = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("done", F.coalesce(F.max("end").over(order), F.lit(0)).cast("bigint"))
    listed = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "done"))).alias("cuts"))
    part = lambda a, b: F.substring(F.col("text"), a.cast("int") + 1, F.greatest(b - a, F.lit(0)).cast("int"))
    tags = F.array(*[F.lit(f"<{k.upper()}>") for k in PATTERNS])

    def replaced(c: Column) -> Column:
        word = part(c["start"], c["end"])
        generic = F.when(word.rlike("^[0-9]+$"), "<NUMBER>").when(word.rlike(r"^\p{Lu}"), "<NAME>").otherwise("<WORD>")
        tag = F.when(c["kind"] < 4, F.get(tags, c["kind"])).when(c["kind"] == 4, generic).otherwise("")
        return F.when(c["start"] < c["done"], "").otherwise(F.concat(part(c["done"], c["start"]), tag))

    last = F.array_max(F.transform("cuts", lambda c: c["end"]))
    clean = F.concat(F.array_join(F.transform("cuts", replaced), ""), F.substring(F.col("text"), last.cast("int") + 1, F.length("text")))
    return found.join(listed, "row", "left").select(F.col("key").alias(key), F.coalesce(clean, "text").alias(text))
