import numpy as np
import pytest

from veracol.llm import topk_search
from veracol.llm.topk_search import top_k


def brute(rows, queries, k=5):
    clean = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in {i: v for i, v in clean if queries(i)}.items():
        scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in clean if i != q and len(a) == len(b))[:k]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [8192, 16])
@pytest.mark.parametrize("bins", [4096, 8])
def test_like_brute_force(spark, monkeypatch, block, bins):
    monkeypatch.setattr(topk_search, "CANDIDATE_BLOCK", block)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 4)
    monkeypatch.setattr(topk_search, "BINS", bins)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(150)]
    rows += [(200 + i, [0.5] * 6) for i in range(60)]  # ties beyond k
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, [float("inf")] + [0.0] * 5), (None, [0.1] * 6), (7, [0.9] * 6), (8, rows[8][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<float>, score string").repartition(3)
    as_floats = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = sorted(tuple(r) for r in top_k(df, df.where("vec_id % 10 = 0")).collect())
    assert got == brute(as_floats, lambda i: i % 10 == 0)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [0.5]), (1, [1.0]), (2, [-1.0])], "vec_id bigint, embedding array<float>")
    assert sorted(tuple(r) for r in top_k(df, df.where("vec_id = 0")).collect()) == [(0, 1, 1, 128 * 256), (0, 2, 2, -128 * 256)]
    assert top_k(df.where("false"), df).count() == 0
    assert top_k(df, df.where("false")).count() == 0


def test_large_components(spark):
    """Components of any size take part; a score beyond a long is the long nearest to it."""
    df = spark.createDataFrame([(0, [8e6, 1.0]), (1, [8e6, 2.0]), (2, [8e6, -1.0]), (3, [1e30, 0.0]), (4, [-1e308, 5.0])], "vec_id bigint, embedding array<double>")
    got = sorted(tuple(r) for r in top_k(df, df.where("vec_id = 0")).collect())
    base = (256 * 8_000_000) ** 2
    assert got == [(0, 1, 3, 2**63 - 1), (0, 2, 1, base + 256 * 512), (0, 3, 2, base - 256 * 256), (0, 4, 4, 1 - 2**63)]


@pytest.mark.parametrize("bins", [4096, 8])
def test_wide_scores(spark, monkeypatch, bins):
    """Scores near both ends of a long, and huge components that a zero of the query leaves out."""
    monkeypatch.setattr(topk_search, "BINS", bins)
    rows = [(i, [2.0**26, x]) for i, x in enumerate([2.0**27, -(2.0**27), 2.0**27 - 1 / 256, 3.5, 0.0, -7.25])]
    rows += [(10, [0.0, 2.0**27]), (11, [1e200, 2.0]), (12, [1e200, 2.0 + 1 / 256]), (13, [-(2.0**54), 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    got = sorted(tuple(r) for r in top_k(df, df, k=20).collect())
    end = 2**63 - 1
    whole = {i: [int(np.floor(256 * v)) if abs(v) < 2**53 else int(v) * 256 for v in x] for i, x in rows}
    expected = []
    for q, a in whole.items():
        scores = sorted((-max(-end, min(end, sum(x * y for x, y in zip(a, b, strict=True)))), i) for i, b in whole.items() if i != q)
        expected += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores, 1)]
    assert got == sorted(expected)


def test_mixed_lengths(spark, monkeypatch):
    """Every length is searched, that of few rows and that without components too."""
    monkeypatch.setattr(topk_search, "CANDIDATE_BLOCK", 8)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=(3, 1, 0, 7, 3)[i % 5]).tolist()) for i in range(120)] + [(200, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id bigint, embedding array<double>, n int, x int").repartition(3)
    got = sorted(tuple(r) for r in top_k(df, df.where("vec_id % 4 = 0")).collect())
    assert got == brute(rows, lambda i: i % 4 == 0)
    assert not [r for r in got if r[0] == 200]  # the only one of its length
