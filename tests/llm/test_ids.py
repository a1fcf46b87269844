"""Rows without a doc_id, and rows that share one, are documents of their own."""

from __future__ import annotations

import corpus_pipeline
from millrace.llm import dartminhash, merkle, suffix_array, tokens
from millrace.llm.common import documents

from .conftest import CLASH, prose, rows_of

TEXTS = [(None, prose(50, 60)), (None, prose(51, 60)), (None, prose(52, 60)), (5, prose(53, 60)), (5, None), (5, prose(54, 60) + " password = hunter2hunter2"), (5, prose(53, 60)), (7, prose(50, 60)), (8, prose(55, 60))]
DISTINCT = {(d, t or "") for d, t in TEXTS}


def test_operators_keep_rows(spark):
    df = spark.createDataFrame(rows_of(TEXTS), CLASH)
    ids = sorted(str(d) for d, _ in DISTINCT)
    assert sorted((str(r["given"]), r["text"]) for r in documents(df).collect()) == sorted((str(d), t) for d, t in DISTINCT)
    assert {(r["doc_id"], r["text"]) for r in merkle.fingerprints(df).collect()} == DISTINCT
    for out in (tokens.token_counts(df), suffix_array.dedup_bytes(df)):
        assert sorted(str(r["doc_id"]) for r in out.collect()) == ids
    classed = [(r["doc_id"], r["class_id"]) for r in dartminhash.near_duplicates(df).collect()]
    assert sorted(str(d) for d, _ in classed) == ids and (7, None) in classed and (8, 8) in classed


def test_pipeline_keeps_texts(spark):
    docs = spark.createDataFrame(rows_of(TEXTS), CLASH).select(corpus_pipeline.COLUMNS)
    kept = corpus_pipeline.near_duplicate(spark, docs, "")
    assert {(r["doc_id"], r["text"]) for r in kept.collect()} == DISTINCT - {(7, TEXTS[0][1])}
    clean = corpus_pipeline.secret_scan(spark, kept, "").collect()
    assert len(clean) == len(DISTINCT) - 1 and sum("[SECRET]" in r["text"] for r in clean) == 1
