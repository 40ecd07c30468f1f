import hashlib
import random

import numpy as np
import pytest

from veracol.llm import suffix_dedup
from veracol.llm.suffix_dedup import remove_repeats, repeated_windows, window_runs


def brute_windows(segments, length):
    seen = {}
    for s, data in enumerate(segments):
        for i in range(len(data) - length + 1):
            seen.setdefault(data[i : i + length], []).append((s, i))
    out = [[] for _ in segments]
    for places in seen.values():
        if len(places) > 1:
            for s, i in places:
                out[s].append(i)
    return [sorted(x) for x in out]


def brute(rows, length):
    data = [(t or "").encode() for _, t in rows]
    out = []
    for (i, _), d, starts in zip(rows, data, brute_windows(data, length), strict=True):
        gone = [False] * len(d)
        for s in starts:
            gone[s : s + length] = [True] * length
        n = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((i, len(d), sum(gone), n, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard_bytes", [100, 1 << 18])
@pytest.mark.parametrize("alphabet", [2, 26])
def test_merged_transforms(shard_bytes, alphabet):
    rng = random.Random(alphabet)
    word = lambda n: bytes(rng.randrange(97, 97 + alphabet) for _ in range(n))
    shared = [word(60), word(25)]
    segments = [word(rng.randrange(20, 60)) + rng.choice(shared) + word(rng.randrange(50)) for _ in range(30)] + [b"ab" * 40, b"a" * 70]
    got = repeated_windows(segments, 20, 4, shard_bytes)
    assert [g.tolist() for g in got] == brute_windows(segments, 20)


def test_strings_that_cannot_repeat_enter_no_transform(monkeypatch):
    rng = random.Random(4)
    word = lambda n: bytes(rng.randrange(256) for _ in range(n))
    entered = []
    real = suffix_dedup.Shard.__init__
    monkeypatch.setattr(suffix_dedup.Shard, "__init__", lambda self, symbols, *rest: (entered.append(len(symbols)), real(self, symbols, *rest))[1])
    # names are shared for 100 bytes; only two segments share strings of 400
    name, passage = word(100), word(450)
    segments = [word(300) + name + word(300) for _ in range(40)]
    assert [g.tolist() for g in repeated_windows(segments)] == [[]] * 40 and sum(entered) == 0
    segments += [word(50) + passage + word(50), word(90) + passage, passage[:399] + word(9)]
    for shard_bytes in (200, 1 << 18):
        entered.clear()
        assert [g.tolist() for g in repeated_windows(segments, shard_bytes=shard_bytes)] == brute_windows(segments, 400)
        assert 0 < sum(entered) <= 3 * 450


@pytest.mark.parametrize("shard_bytes", [60, 1 << 18])
def test_texts_of_few_blocks(shard_bytes):
    rng = random.Random(5)
    blocks = [b"abcd", b"abce", b"aaaa"]
    # every block is frequent, so all that parts these strings is their order; some are cut off or periodic
    segments = [b"".join(rng.choice(blocks) for _ in range(rng.randrange(5, 40)))[rng.randrange(4) :] for _ in range(50)] + [b"a" * 20, b"a" * 21, b"abcd" * 30]
    assert [g.tolist() for g in repeated_windows(segments, 20, 4, shard_bytes)] == brute_windows(segments, 20)


def test_stable_order():
    rng = random.Random(6)
    for keys in ([], [0], [rng.randrange(5) for _ in range(1000)], [rng.randrange(1 << 62) for _ in range(100)] * 2):
        keys = np.array(keys, np.int64)
        assert suffix_dedup.stable_order(keys).tolist() == np.argsort(keys, kind="stable").tolist()


def test_equal_windows_have_equal_names():
    rng = random.Random(1)
    shared = bytes(rng.randrange(256) for _ in range(700))
    names = []
    for _ in range(3):
        data = bytes(rng.randrange(256) for _ in range(rng.randrange(500))) + shared + bytes(rng.randrange(256) for _ in range(300))
        by_start = {}
        for name, start, n, _ in window_runs(data):
            by_start |= dict.fromkeys(range(start, start + n), name)
        assert len(by_start) == len(data) - 399
        at = data.index(shared)
        names.append([by_start[at + i] for i in range(301)])
    assert names[0] == names[1] == names[2]


def corpus(length):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passages = [word(length // 2), word(length), word(length + 7), word(3 * length)]
    rows = [(i, word(rng.randrange(3 * length)) + rng.choice(passages) + word(rng.randrange(3 * length))) for i in range(60)]
    rows += [(100, rows[3][1]), (101, rows[3][1]), (101, rows[3][1]), (102, None), (103, ""), (None, word(length * 2)), (None, passages[3]), (104, "xy" * length), (105, word(5) + "z" * (2 * length)), (106, passages[2] + passages[2])]
    return rows


@pytest.mark.parametrize("hot", [4096, 3])
def test_rows_like_brute_force(spark, hot):
    rows = corpus(40)
    docs = spark.createDataFrame([(*r, b"x") for r in rows], "doc_id bigint, text string, tid binary").repartition(3)
    got = sorted((tuple(r) for r in remove_repeats(docs, length=40, gram=10, block=5, hot=hot).collect()), key=repr)
    assert got == brute(rows, 40)


def test_production_lengths(spark):
    rows = corpus(400)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted((tuple(r) for r in remove_repeats(docs).collect()), key=repr) == brute(rows, 400)
    assert remove_repeats(docs.where("false")).count() == 0
    assert sorted(r.n_removed for r in remove_repeats(docs.where("doc_id > 101 AND doc_id < 104")).collect()) == [0, 0]


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows, 400)
    assert sorted((tuple(r) for r in remove_repeats(docs).collect()), key=repr) == want and sum(r[2] for r in want)
