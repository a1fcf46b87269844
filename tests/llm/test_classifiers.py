"""Held-out accuracy and odd inputs of the two classifiers, and the pipeline."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import quality, toxicity
from millrace.llm.common import written

from .conftest import CLASH, rows_of

SF = "/root/testdata/sf0.01"


def test_quality_held_out(spark):
    out = quality.op1_quality(spark, SF)
    rows = out.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)
    good, bad = [r["score"] for r in rows if r["quality"] == 1], [r["score"] for r in rows if r["quality"] == 0]
    wins = sum(g > b for g in good for b in bad) / (len(good) * len(bad))
    assert wins > 0.9 and sum(r["predicted"] for r in rows if r["quality"] == 1) > 0.9 * len(good)
    assert out.count() == 1000


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    seen = labels.where(F.col("doc_id") % 2 == 0)
    rows = toxicity.toxicity(docs, seen).join(labels.where(F.col("doc_id") % 2 == 1).withColumnRenamed("toxic", "truth"), "doc_id").collect()
    toxic, clean = [r for r in rows if r["truth"] == 1], [r for r in rows if r["truth"] == 0]
    assert sum(r["toxic"] for r in toxic) >= 0.85 * len(toxic)
    assert sum(r["toxic"] for r in clean) <= 0.01 * len(clean)


def test_odd_inputs(spark, odd, nothing, as_documents):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 1), (6, 1, 1), (7, 0, 1), (10, 1, 0), (None, 1, 1), (99, 0, None)], "doc_id long, quality int, toxic int")
    ids = {d for d, _ in as_documents}
    for given in (labels, labels.limit(0)):
        scored = quality.quality(odd, given).collect()
        assert {r["doc_id"] for r in scored} == ids and all(0 <= r["score"] <= 1 for r in scored)
        judged = toxicity.toxicity(odd, given).collect()
        assert {r["doc_id"] for r in judged} == ids and all(0 <= r["p_toxic"] <= 1 for r in judged)
        assert quality.quality(nothing, given).count() == 0 and toxicity.toxicity(nothing, given).count() == 0
    assert toxicity.without_toxic(odd, labels.limit(0)).count() == odd.count()


def test_pipeline_stages(spark):
    """Each stage's decisions take effect on what the one before it kept; clean documents stay."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = docs.where("doc_id = 0").first()["text"]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    planted = [(90_001, text), (90_002, "clean words here " * 3 + item + " and more of them"), (90_003, "my password = hunter2hunter2 ok"), (90_004, "you idiot clown, pathetic worthless scum"), (None, None)]
    more = spark.createDataFrame(rows_of(planted), CLASH).select(docs.columns)
    docs = docs.union(more)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == corpus_pipeline.COLUMNS
    assert 90_004 not in kept["toxicity"] and {90_001, 90_002, 90_003, None} <= set(kept["toxicity"])
    assert 90_001 not in kept["near_duplicates"] and {0, 90_002, 90_003, None} <= set(kept["near_duplicates"])
    assert 90_002 not in kept["decontamination"] and {0, 90_003, None} <= set(kept["decontamination"])
    assert set(kept["secrets"]) == set(kept["decontamination"]) == set(kept["mixing"])
    clean = kept["secrets"][90_003]
    assert clean["text"] == "my [SECRET] ok" and clean["n_chars"] == len(clean["text"])


def test_pipeline_of_nothing(spark, nothing):
    docs = nothing.select(corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
