import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veracol.llm import periodic_runs
from veracol.llm.periodic_runs import find_runs, runs_of_texts, split_rare
from veracol.llm.queries import QUERIES

DIR = "/root/testdata/sf0.001"


def brute(words):
    """Runs by the definition: every lag, every maximal stretch, the smallest period of each."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        start = None
        for i in range(len(words) - q + 1):
            if i < len(words) - q and words[i] == words[i + q]:
                start = i if start is None else start
            elif start is not None:
                length = i - start + q
                if length >= max(6, 4 * q):
                    found.setdefault((start, length), q)  # a greater period of the same stretch is not its smallest
                start = None
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def check(texts):
    for text, (runs, kept) in zip(texts, runs_of_texts([t.encode() for t in texts]), strict=True):
        words = text.split()
        assert runs == brute(words), text[:200]
        assert kept.decode() == collapse(words, runs)


def test_random_texts():
    rng = random.Random(5)
    texts = []
    for _ in range(600):
        words = []
        while len(words) < rng.choice([5, 30, 120]):
            block = [rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(1, 7))]
            words += block * rng.choice([1, 1, 2, 3, 4, 5, 9]) + block[: rng.randint(0, len(block))]
        texts.append(" ".join(words))
    check(texts)


def test_made_texts():
    fibonacci = ["a", "b"]
    while len(fibonacci[-1]) < 300:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    check(["", "a", "a " * 5, "a " * 6, "a b " * 3 + "a", "a b " * 4, ("a a a a a a b " * 5).strip(), " ".join(fibonacci[-1]), "é è " * 9 + "x", ("x y z " * 4 + "w ") * 4, "a " * 3000, ("a " * 100 + "b ") * 9])


def test_rare_words_split_until_stable():
    # c is rare; without it b is rare in both halves, which only the second round sees
    words = np.array([0, 0, 0, 0, 0, 0, 1, 1, 2, 1, 1, 0, 0, 0, 0, 0, 0, 0])
    starts, stops = split_rare(words, np.zeros(len(words), np.int64))
    assert list(zip(starts, stops, strict=True)) == [(0, 6), (11, 18)]


def test_long_text_takes_time_in_proportion():
    words = [f"w{i % 997}" for i in range(200_000)]
    ((runs, kept),) = runs_of_texts([" ".join(words).encode()])
    assert runs == [(0, 200_000, 997)] and len(kept.split()) == 997
    ((runs, _),) = runs_of_texts([("a " * 300_000).encode()])
    assert runs == [(0, 300_000, 1)]


def test_odd_rows(spark):
    odd = [(1, None, 1), (2, "", 2), (None, "a " * 9, 3), (3, " \t\n\x0b\f\r ", 4), (4, "b " * 9, 5), (4, "b " * 9, 5), (5, "x\u00a0y " * 6 + "\u2028", 6)]
    docs = spark.createDataFrame(odd, "doc_id bigint, text string, runs int").withColumn("collapsed", F.lit(1)).withColumn("__bytes", F.lit("z"))
    rows = find_runs(docs).collect()
    assert len(rows) == 7
    got = sorted((r.doc_id or 0, [tuple(x) for x in r.runs], r.collapsed) for r in rows)
    assert got == [(0, [(0, 9, 1)], "a"), (1, [], ""), (2, [], ""), (3, [], ""), (4, [(0, 9, 1)], "b"), (4, [(0, 9, 1)], "b"), (5, [(0, 6, 1)], "x\u00a0y \u2028")]
    assert find_runs(docs.where("false")).count() == 0
    assert periodic_runs.digest(find_runs(periodic_runs.with_planted(docs))).count() == 7


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_like_brute_force(spark, folder):
    rows = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(rows) == len(docs)
    with_runs = 0
    for d in docs:
        words = [w.decode() for w in (d.text or "").encode().split()]
        n, h = len(words), zlib.crc32(str(d.doc_id).encode())
        if len(words) > 3000 and d.doc_id % 7:
            continue  # the plain version is quadratic; some long texts suffice
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute(words)
        got = rows[d.doc_id]
        assert got.n_runs == len(runs)
        if runs:
            with_runs += 1
            s, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2]))
            assert (got.start, got.length, got.period, got.exponent_milli) == (s, length, q, 1000 * length // q)
        else:
            assert (got.start, got.length, got.period, got.exponent_milli) == (None,) * 4
        assert got.runs_sha256 == hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest()
        assert got.collapsed_sha256 == hashlib.sha256(collapse(words, runs).encode()).hexdigest()
    assert with_runs > 5
