import hashlib
import random
import re

import pytest

from veracol.llm.secret_scan import BASE_RULES, MORE_RULES, Rule, Scanner, code_points, find_secrets, parse, redact, scanner

KINDS = ("assign", "access", "hex")
EXPRESSIONS = [re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")]


def brute(text):
    found = []
    for kind, expression in enumerate(EXPRESSIONS):
        for m in expression.finditer(text or ""):
            if len(m[2] if kind == 0 else m[0]) >= (8, 16, 32)[kind]:
                found.append((m.start(), m.end(), kind))
    return sorted(found, key=lambda x: (x[0], x[2]))


def joined(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


FRAGMENTS = ["password", "passwd", "secret", "Token", "api_key", "APIkey", ":", "=", "==", '"', "'", " ", "  ", "abcdef01", "x" * 7, "x" * 8, "AKIA", "AKIAABCDEFGHIJKL", "AKIA" + "Z" * 11, "0123456789abcdef", "deadbeef" * 4, "é", "\n", "-", "/", "漢"]


def test_random_texts_like_the_expressions():
    rng = random.Random(3)
    texts = ["".join(rng.choice(FRAGMENTS) for _ in range(rng.randint(0, 25))) for _ in range(5000)]
    data = [t.encode() for t in texts]
    got = [[m for m in code_points(d, found) if m[2] < 3] for d, found in zip(data, scanner(BASE_RULES + MORE_RULES).scan(data), strict=True)]
    assert got == [brute(t) for t in texts]


def test_lanes_meet_across_long_matches():
    """A match longer than many lanes, and one document of many lanes."""
    texts = ["a" * 300_000, "token=" + "b" * 200_000 + " x", "é " * 1000 + "AKIA" + "Q" * 90_000]
    data = [t.encode() for t in texts]
    got = [[m for m in code_points(d, found) if m[2] < 3] for d, found in zip(data, scanner(BASE_RULES + MORE_RULES).scan(data), strict=True)]
    assert got == [brute(t) for t in texts]


@pytest.mark.parametrize("pattern", ["a(b|cd)*e", "x{2,4}y?", "[^a-c]+z", "(ab|a)(c|bcd)"])
def test_own_rules(pattern):
    rng = random.Random(pattern)
    texts = ["".join(rng.choice("abcdexyz") for _ in range(rng.randint(0, 30))) for _ in range(500)]
    got = Scanner((Rule("own", pattern, 1),)).scan([t.encode() for t in texts])
    for text, found in zip(texts, got, strict=True):
        # leftmost, then longest
        want, at = [], 0
        while at < len(text):
            ends = [e for e in range(len(text), at, -1) if re.fullmatch(pattern, text[at:e])]
            if ends:
                want.append((at, ends[0], 0))
                at = ends[0]
            else:
                at += 1
        assert found == want


def test_unbalanced():
    with pytest.raises((ValueError, IndexError)):
        parse("a)b")


ROWS = [(1, 'x password = "hunter2hunter2" y'), (2, None), (3, ""), (None, "AKIA" + "A" * 16), (4, "é" * 3 + " token: " + "z" * 9), (4, "é" * 3 + " token: " + "z" * 9), (5, "plain"), (6, "token: secret: abcdefghij"), (7, "ghp_" + "a1B2" * 10)]


def test_rows(spark):
    docs = spark.createDataFrame([(*r, "mine") for r in ROWS], "doc_id bigint, text string, spans string")
    got = sorted([tuple(r) for r in find_secrets(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256").collect()], key=repr)
    want = []
    for i, text in ROWS:
        spans = brute(text)
        want.append((i, *(sum(k == kind for _, _, k in spans) for kind in range(3)), hashlib.sha256(joined(spans).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert find_secrets(docs.where("false")).count() == 0
    assert {r.spans for r in find_secrets(docs).collect()} >= {"", "github:0:44"}


def test_redaction(spark):
    docs = spark.createDataFrame([(*r, "mine") for r in ROWS], "doc_id bigint, text string, spans string")
    out = redact(docs)
    assert out.columns == docs.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[1] == 'x [assign]" y' and texts[2] is None and texts[3] == "" and texts[None] == "[access]" and texts[4] == "ééé [assign]" and texts[5] == "plain"


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id: hashlib.sha256(joined(brute(r.text)).encode()).hexdigest() for r in docs.collect()}
    assert {r.doc_id: r.base_sha256 for r in find_secrets(docs).collect()} == want and len(set(want.values())) > 3
