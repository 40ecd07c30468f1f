import numpy as np
import public_tokenizers

import corpus_pipeline
from veracol.llm.decontamination import normalised
from veracol.llm.piece_codec import Codec
from veracol.llm.toxicity import fit, score

from test_jaccard import brute_kept
from test_secrets import brute as brute_secrets

DIR = "/root/testdata/sf0.01"
KINDS = ("assign", "access", "hex")


def test_like_plain_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    toxic = {r.doc_id for r in score(docs, fit(docs, spark.read.parquet(f"{DIR}/labels.parquet"))).where("predicted = 1").collect()}
    ids = brute_kept([(i, rows[i].text) for i in sorted(set(rows) - toxic)])
    items = [normalised(r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    leaked = {i for i in ids if any(item in normalised(rows[i].text) for item in items)}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, DIR).collect()}
    assert toxic and leaked and set(got) == set(ids) - leaked
    codec = Codec(public_tokenizers.path("piece_bpe_32k.model"))
    for i, row in got.items():
        text, done = "", 0
        for a, b, kind in brute_secrets(rows[i].text):
            if a >= done:  # overlapping secrets go as one
                text += rows[i].text[done:a] + f"[{KINDS[kind]}]"
            done = max(done, b)
        text += rows[i].text[done:]
        assert row.text == text and row.n_chars == len(text) and row.source == rows[i].source
        assert np.array_equal(row.ids, codec.encode(text)) and row.same_text


def test_stages_keep_columns_and_take_odd_rows(spark):
    odd = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", None, None, None), (None, "token: abcdefghijk", "en", "s", 5), (1, None, "en", "s", 0), (4, "w " * 50000, "en", "s", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for docs in (odd, odd.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, DIR)
            if name != "tokens":
                assert out.columns == docs.columns
                docs = out
        rows = out.collect()
        assert out.columns[:5] == odd.columns
    texts = {(r.doc_id, r.text) for r in corpus_pipeline.STAGES[1][1](spark, odd, DIR).collect()}
    assert len(texts) == 3 and rows == []
