"""One registered query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import conversation_trie, decontamination, disclosure, periodic_runs, piece_codec, quote_links, secret_scan, simhash_dedup, suffix_dedup, token_files, topk_search, toxicity, warc_fixity
from .shared import cut, table

# Messages as mail would show them: they quote the one or two before, and now and then start anew.
QUOTING = """
WITH b AS (SELECT conv_id, turn, role, text, lag(text, 1) OVER w AS p1, lag(text, 2) OVER w AS p2 FROM {conversations} WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, role, CASE
  WHEN p1 IS NULL OR turn % 6 = 5 THEN text
  WHEN turn % 4 = 3 AND p2 IS NOT NULL THEN '> ' || replace(p2, chr(10), chr(10) || '> ') || chr(10) || text
  WHEN turn % 2 = 0 AND p2 IS NOT NULL THEN '> > ' || replace(p2, chr(10), chr(10) || '> > ') || chr(10) || '> ' || replace(p1, chr(10), chr(10) || '> ') || chr(10) || text
  ELSE '> ' || replace(p1, chr(10), chr(10) || '> ') || chr(10) || text END AS text
FROM b
"""

# A replica with damage: some pages have another first letter, some are cut short, some are lost, and some records are in it alone.
DAMAGED = "CASE WHEN page_id % 97 = 13 THEN '~' || substr(html, 2) WHEN page_id % 307 = 7 THEN substr(html, 1, CAST(floor(length(html) / 2) AS INT)) ELSE html END"
LOST = "page_id % 211 = 5"
ADDED, ADDED_FROM = "page_id % 389 = 3", 1_000_000_000_000

# Unsigned crc32 of a decimal number: its bytes enter the register, eight shifts after each.
CRC32 = """xor(4294967295, list_reduce(flatten(list_prepend([4294967295], list_transform(string_split(CAST({} AS VARCHAR), ''), lambda x: [CAST(ord(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {
    "op9_quote_links": f"""
WITH RECURSIVE m AS ({QUOTING.format(conversations="conversations")}),
l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM m),
h AS (SELECT conv_id, turn, length(regexp_replace(regexp_extract(line, '^[ \t]?(?:>[ \t]?)+', 0), '[^>]', '', 'g')) AS level,
  trim(regexp_replace(lower(regexp_replace(line, '^[ \t]?(?:>[ \t]?)+', '')), '\\s+', ' ', 'g')) AS plain FROM l),
own AS (SELECT DISTINCT conv_id, turn, plain FROM h WHERE level = 0 AND plain <> ''),
q AS (SELECT conv_id, turn, level, plain, count(*) AS n FROM h WHERE level > 0 AND plain <> '' GROUP BY ALL),
o AS (SELECT q.conv_id, q.turn, q.level, q.plain, q.n, max(own.turn) AS origin FROM q LEFT JOIN own ON own.conv_id = q.conv_id AND own.plain = q.plain AND own.turn < q.turn GROUP BY ALL),
f AS (SELECT conv_id, turn, CAST(sum(n) AS BIGINT) AS n_quoted, CAST(coalesce(sum(n) FILTER (origin IS NOT NULL), 0) AS BIGINT) AS n_linked, max(level) AS levels FROM o GROUP BY ALL),
v AS (SELECT conv_id, turn, origin, sum(n) AS n FROM o WHERE level = 1 AND origin IS NOT NULL GROUP BY ALL),
p AS (SELECT conv_id, turn, origin AS parent FROM v QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, origin DESC) = 1),
t AS (SELECT conv_id, turn, parent AS up, 1 AS depth FROM p UNION ALL SELECT t.conv_id, t.turn, p.parent, t.depth + 1 FROM t JOIN p ON p.conv_id = t.conv_id AND p.turn = t.up),
r AS (SELECT conv_id, turn, arg_max(up, depth) AS thread, max(depth) AS depth FROM t GROUP BY ALL)
SELECT m.conv_id, m.turn, m.role, coalesce(r.thread, m.turn) AS thread,
  row_number() OVER (PARTITION BY m.conv_id, coalesce(r.thread, m.turn) ORDER BY m.turn) AS position,
  CAST(coalesce(r.depth, 0) AS BIGINT) AS depth, p.parent AS parent_turn, coalesce(f.n_quoted, 0) AS n_quoted, coalesce(f.n_linked, 0) AS n_linked, CAST(coalesce(f.levels, 0) AS BIGINT) AS levels,
  array_to_string(list_filter(string_split(m.text, chr(10)), lambda x: NOT regexp_matches(x, '^[ \t]?(?:>[ \t]?)+')), chr(10)) AS text
FROM m LEFT JOIN f USING (conv_id, turn) LEFT JOIN p USING (conv_id, turn) LEFT JOIN r USING (conv_id, turn)
""",
    "op6_warc_fixity": f"""
WITH d AS (SELECT page_id, url, html, {DAMAGED} AS copy, {LOST} AS lost, false AS added FROM pages
  UNION ALL SELECT page_id + {ADDED_FROM}, url, html, html, false, true FROM pages WHERE {ADDED}),
s AS (SELECT page_id, page_id // 1024 AS archive, page_id % 1024 AS place, lost, added,
  'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: ' AS head,
  html, copy, chr(13) || chr(10) || chr(13) || chr(10) AS gap FROM d),
w AS (SELECT *, head || strlen(html) || gap || html || gap AS record, head || strlen(copy) || gap || copy || gap AS other FROM s),
x AS (SELECT *, CAST(sum(strlen(record)) OVER o AS BIGINT) AS stop FROM w WINDOW o AS (PARTITION BY archive ORDER BY page_id))
SELECT page_id, archive, place, stop - strlen(record) AS start, stop, CASE WHEN added THEN 'extra' WHEN lost THEN 'missing' ELSE 'corrupt' END AS status,
  CASE WHEN NOT added THEN sha256(record) END AS expected, CASE WHEN NOT lost THEN sha256(other) END AS found
FROM x WHERE added OR lost OR record <> other
""",
    "op3_exact_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS x FROM embeddings),
q AS (SELECT vec_id AS query_id, unnest(x) AS a, generate_subscripts(x, 1) AS i FROM v WHERE vec_id % 50 = 0),
c AS (SELECT vec_id, unnest(x) AS b, generate_subscripts(x, 1) AS i FROM v),
s AS (SELECT query_id, vec_id, CAST(sum(a * b) AS BIGINT) AS score FROM q JOIN c USING (i) WHERE query_id <> vec_id GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
""",
}

ORACLES["op12_prefix_trie"] = f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS z, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, z) - 1 AS r FROM t),
s AS (SELECT c, count(*) AS size FROM o GROUP BY c),
h AS (SELECT c, c - c % 100 AS b, {CRC32.format("c")} % 6 AS h FROM s),
k AS (SELECT h.c, b, h, least(h, coalesce(s.size, 0)) AS k FROM h LEFT JOIN s ON s.c = h.b),
p AS (SELECT k.c, r + 1 AS d, z, length(text) AS points FROM k JOIN o ON o.c = k.b AND r < h
  UNION ALL SELECT k.c, r - h + k + 1, z, length(text) FROM k JOIN o ON o.c = k.c AND r >= h),
q AS (SELECT c, d, points, string_agg(z, '') OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS key FROM p UNION ALL SELECT c, 0, 0, '' FROM k),
n AS (SELECT key, d, min(c) AS m, count(*) AS n, max(points) AS points FROM q GROUP BY key, d),
j AS (SELECT q.c, q.d, n.m, n.n, n.points FROM q JOIN n ON n.key = q.key),
e AS (SELECT m, d, string_agg(c, ',' ORDER BY c) AS ends FROM (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY c ORDER BY d DESC) = 1) GROUP BY ALL),
v AS (SELECT a.m, a.d, a.n, a.points, b.m AS parent FROM j a LEFT JOIN j b ON b.c = a.c AND b.d = a.d - 1 WHERE a.c = a.m),
f AS (SELECT parent AS m, d - 1 AS d, count(*) AS children FROM v WHERE d > 0 GROUP BY ALL),
w AS (SELECT v.*, coalesce(children, 0) AS children FROM v LEFT JOIN f USING (m, d)),
u AS (SELECT j.m, j.d, count(*) FILTER (w.children = 0) AS leaves, sum((w.n - 1) * w.points) AS saved FROM w JOIN j ON j.c = w.m AND j.d <= w.d GROUP BY ALL)
SELECT w.m AS conv_id, w.d AS depth, w.parent AS parent_conv_id, w.n AS n_convs, w.children AS n_children, u.leaves AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM w JOIN u USING (m, d) LEFT JOIN e USING (m, d)
"""

# Personal data: kind, number, pattern and what a match must pass; m is the match, z its digits.
_PERSONAL = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true", "lower(m)"),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR CAST('0' || right(p, 3) AS INT) > 255)) = 0", "m"),
    ("card", r"[0-9](?:[ -]?[0-9])+", "length(z) BETWEEN 14 AND 19 AND list_sum(list_transform(string_split(reverse(z), ''), lambda d, i: CASE WHEN i % 2 = 1 THEN CAST(d AS INT) WHEN d > '4' THEN 2 * CAST(d AS INT) - 9 ELSE 2 * CAST(d AS INT) END)) % 10 = 0", "z"),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", "length(z) BETWEEN 10 AND 15", "z"),
]


def _located(pattern: str, text: str = "text") -> str:
    """Array of (s, e, m, l, r) of all matches: gaps and matches before each are summed, l and r are the ends of the gaps around it."""
    found, gaps = f"regexp_extract_all({text}, '{pattern}')", f"string_split_regex({text}, '{pattern}')"
    upto = lambda n: f"CAST(coalesce(list_sum(list_transform({gaps}[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform({found}[1:{n}], lambda g: length(g))), 0) AS BIGINT)"
    return f"list_transform({found}, lambda m, i: {{'s': {upto('i - 1')}, 'e': {upto('i')}, 'm': m, 'l': right({gaps}[i], {disclosure.REACH}), 'r': left({gaps}[i + 1], {disclosure.REACH})}})"


_BASE = " UNION ALL ".join(
    f"SELECT doc_id, {n} AS k, s, e, l, r, '{kind} ' || {normal} AS v FROM (SELECT doc_id, x.s, x.e, x.m, x.l, x.r, regexp_replace(x.m, '[^0-9]', '', 'g') AS z FROM (SELECT doc_id, unnest({_located(pattern)}) AS x FROM d)) WHERE {test}"
    for n, (kind, pattern, test, normal) in enumerate(_PERSONAL)
)
_LEFT = rf"CASE WHEN length(l) = {disclosure.REACH} THEN regexp_replace(l, '^[\p{{L}}\p{{N}}]+', '') ELSE l END"
_RIGHT = rf"CASE WHEN length(r) = {disclosure.REACH} THEN regexp_replace(r, '[\p{{L}}\p{{N}}]+$', '') ELSE r END"
ORACLES["op13_disclosure"] = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text FROM documents),
b AS MATERIALIZED ({_BASE}),
c AS (SELECT doc_id, v, regexp_replace(l || chr(10) || r, '{"|".join(p for _, p, _, _ in _PERSONAL)}', chr(10), 'g') AS context FROM (SELECT doc_id, v, {_LEFT} AS l, {_RIGHT} AS r FROM b)),
near AS MATERIALIZED (SELECT DISTINCT doc_id, v, unnest(regexp_extract_all(lower(context), '{disclosure.TERM}')) AS t FROM c),
both_ AS (SELECT v, t, count(DISTINCT doc_id) AS both_n FROM near GROUP BY v, t HAVING count(DISTINCT doc_id) >= {disclosure.LEAST_TOGETHER}),
nv AS (SELECT v, count(DISTINCT doc_id) AS nv FROM b GROUP BY v),
nt AS (SELECT t, count(*) AS nt FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '{disclosure.TERM}')) AS t FROM d) GROUP BY t),
told AS (SELECT v, t, both_n = nt AS whole FROM both_ JOIN nv USING (v) JOIN nt USING (t), (SELECT CAST(count(*) AS DOUBLE) AS n FROM d)
  WHERE nv < n AND log2(both_n * n / (nt * nv)) >= {disclosure.GENERAL} * log2(n / nv)),
f AS MATERIALIZED (SELECT doc_id, t, max(whole) AS whole FROM near JOIN told USING (v, t) GROUP BY doc_id, t),
w AS (SELECT doc_id, x.s, x.e, lower(x.m) AS t FROM (SELECT doc_id, unnest({_located(disclosure.TERM)}) AS x FROM d WHERE doc_id IN (SELECT doc_id FROM f))),
g AS (SELECT doc_id, CASE WHEN whole THEN 5 ELSE 4 END AS k, s, e FROM w JOIN f USING (doc_id, t) WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = w.doc_id AND b.s < w.e AND w.s < b.e)),
a AS (SELECT doc_id, k, s, e FROM b UNION ALL SELECT doc_id, k, s, e FROM g),
h AS (SELECT doc_id, string_agg({list(disclosure.KINDS)}[k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans, string_agg({list(disclosure.KINDS)}[k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 4) AS base,
  count(*) FILTER (k = 0) AS n_email, count(*) FILTER (k = 1) AS n_ip, count(*) FILTER (k = 2) AS n_card, count(*) FILTER (k = 3) AS n_phone FROM a GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN h USING (doc_id)
"""


def _query(function):
    QUERIES[function.__name__] = function
    return function


@_query
def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's SimHash fingerprint and the component of fingerprints at 4 or fewer bits."""
    return simhash_dedup.simhash_components(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@_query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score by a model trained on the labels that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.fit(docs, labels))


@_query
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets, found by all rules in one byte pass."""
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


@_query
def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best rows for every vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk_search.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


@_query
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and checksum in token files, written and read back."""
    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


@_query
def op8_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's piece ids by the streaming search, and whether they decode to its text."""
    return piece_codec.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"])


@_query
def op5_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that leaks into a document, with its edits."""
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def damaged_replica(pages: DataFrame) -> DataFrame:
    """Pages as another store might hold them: some changed, some lost, and some that only it has."""
    kept = pages.where(f"({LOST}) IS NOT TRUE").select("page_id", "url", F.expr(DAMAGED).alias("html"))
    return kept.unionByName(pages.where(ADDED).select((F.col("page_id") + ADDED_FROM).alias("page_id"), "url", "html"))


@_query
def op6_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that a damaged replica of all pages' archives has lost, changed or more; each replica is laid out by itself."""
    pages = table(spark, sf_dir, "pages")
    return warc_fixity.audit(warc_fixity.lay_out(pages), warc_fixity.lay_out(damaged_replica(pages)))


@_query
def op9_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of the quoting conversations, in its thread and without quotes."""
    table(spark, sf_dir, "conversations").createOrReplaceTempView("_quoted_conversations")
    return quote_links.link_quotes(spark.sql(QUOTING.format(conversations="_quoted_conversations")))


@_query
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the strings of 400 bytes that repeat anywhere."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@_query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's periodic runs of words, a tenth of the documents having been made periodic."""
    return periodic_runs.digest(periodic_runs.find_runs(periodic_runs.with_planted(table(spark, sf_dir, "documents"))))


@_query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prefix of the rebuilt conversations, with the totals of its subtree."""
    turns = cut(conversation_trie.ranked(table(spark, sf_dir, "conversations")))
    return conversation_trie.prefix_trie(*conversation_trie.rebuilt(turns))


@_query
def op13_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data, and the terms that the corpus shows to give it away."""
    return disclosure.digest(disclosure.find_disclosures(table(spark, sf_dir, "documents")))
