"""The engine over a store: index and vectors follow the records; expansion; writes; manifests; claims and locks."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from millrace.engine import Engine
from millrace.functions import text
from millrace.operators import applies
from millrace.streaming.ingest import BATCH, RECORDS


def now():
    return F.lit("2024-02-15").cast("timestamp")


def batch(spark, *rows):
    return spark.createDataFrame([(i, "s", ref, "memory", title, body, ["x"], None, None) for i, (ref, title, body) in enumerate(rows)], BATCH).withColumn("created", now())


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    built = Engine(spark, str(tmp_path_factory.mktemp("engine")))
    built.ingest(batch(spark, ("a", "First", "running shoes and socks"), ("b", "Second", "a note about trains"), ("c", "Third", "nothing of the kind")), 1, now())
    return built


def asked(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")


def by_keyword(engine, spark, *queries):
    return {(r["query_id"], r["title"]) for r in engine.search(asked(spark, *queries), now()).where("bm25_rank is not null").collect()}


def test_index_follows_records(spark, engine):
    assert by_keyword(engine, spark, "runs", "notes_about OR sock", "train NOT note") == {(0, "First"), (1, "First"), (1, "Second")}
    engine.ingest(batch(spark, ("b", "Second", "a note about planes"), ("d", "Fourth", "he runs")), 2, now())
    assert by_keyword(engine, spark, "runs", "train", "plane") == {(0, "First"), (0, "Fourth"), (2, "Second")}
    again = engine.index.ledger.read()[1]["segments"]
    engine.refresh(3)
    assert engine.index.ledger.read()[1]["segments"] == again


def test_expansion_asks_once_and_failure_leaves_keywords(spark, engine):
    calls = []

    def answer(misses):
        calls.append(sorted(r["query"] for r in misses.collect()))
        return misses.select("query_hash", F.lit("running shoes and socks").alias("hypothesis"))

    queries = asked(spark, "what does one wear", "what does one wear", "socks", 'say "this" here')
    first = engine.search(queries, now(), expand=answer).collect()
    assert calls == [["what does one wear"]] and {r["degraded"] for r in first} == {None}
    assert {r["title"] for r in first if r["query_id"] == 0 and r["vec_rank"] == 1} == {"First"}
    engine.search(queries, now(), expand=answer)
    assert calls[1] == []

    def broken(rows):
        raise TimeoutError("no model")

    with pytest.warns(UserWarning, match="no model"):
        assert engine.search(asked(spark, "who is it now"), now(), expand=broken).where("degraded is not null").count() == 0
    kept, engine.embed = engine.embed, broken
    try:
        hits = engine.search(asked(spark, "socks"), now()).collect()
    finally:
        engine.embed = kept
    assert [(r["title"], r["vec_rank"], r["degraded"]) for r in hits] == [("First", None, "TimeoutError: no model")]


def test_writes_by_an_api(spark, engine):
    columns = "id string, type string, created string, updated string, source string, title string, scope string, verification string, importance double, tags array<string>, body string, path string"
    row = ("", "odd", None, "bad", None, "Written", None, None, 0.9, None, "zeppelins fly", "memories/w.md")
    engine.write(spark.createDataFrame([row], columns), 5, now())
    (found,) = engine.get(spark.createDataFrame([("memories/w.md",)], "key string")).collect()
    assert (found["type"], found["tags"], found["source"], found["importance"]) == ("memory", ["odd"], "agent", 0.9)
    assert by_keyword(engine, spark, "zeppelin") == {(0, "Written")}
    with pytest.raises(Exception, match="reserved path"):
        engine.write(spark.createDataFrame([(*row[:-1], "_meta/w.md")], columns), 6, now())


def test_manifests_are_applied_whole_or_not(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "m"))
    rows = spark.createDataFrame([("1", "memory", "same", "p/1.md"), ("2", "memory", "Same ", "p/2.md"), ("3", "memory", "other", "p/3.md"), ("4", "memory", "other", "p/4.md")], "id string, type string, body string, path string")
    held = spark.createDataFrame([], RECORDS)
    engine.store.write(0, records=rows.select(*[c if c in rows.columns else F.lit(None).cast(held.schema[c].dataType).alias(c) for c in held.columns]))
    listed = rows.select("id", "type", "path", text.normalized_hash(F.col("body")).alias("hash"))
    manifest = listed.select(F.col("hash").alias("group_key"), F.when(F.col("id") == "4", "drifted").otherwise(F.col("hash")).alias("hash"), "type", F.lit(True).alias("qualifies"), F.when(F.col("id").isin("1", "3"), "winner").otherwise("loser").alias("role"), "id", "path")
    header = {"version": applies.MANIFEST_VERSION, "rules": applies.MANIFEST_RULES}
    with pytest.raises(ValueError, match="version"):
        engine.apply_manifest(manifest, {"version": 7, "rules": applies.MANIFEST_RULES}, now(), 1)
    before = engine.store.snapshot()
    dry = engine.apply_manifest(manifest, header, now(), 1, dry_run=True).first().asDict()
    assert dry == {"groups": 2, "skipped": 1, "planned": 1, "applied": 0, "audit_rows": 0} and engine.store.snapshot() == before
    assert engine.apply_manifest(manifest, header, now(), 1).first()["applied"] == 1
    assert {r["id"]: r["deprecated_by"] for r in engine.records().collect()} == {"1": None, "2": "1", "3": None, "4": None}
    assert [(r["new_id"], r["existing_id"]) for r in engine.store.read("audit", applies.AUDIT).collect()] == [("2", "1")]
    # Played again, the group has drifted: nothing is applied twice.
    assert engine.apply_manifest(manifest, header, now(), 2).first().asDict() == {"groups": 2, "skipped": 2, "planned": 0, "applied": 0, "audit_rows": 0}


def test_claims_and_locks(spark, tmp_path):
    root = str(tmp_path / "q")
    engine = Engine(spark, root)
    engine.enqueue(spark.createDataFrame([(str(i),) for i in range(9)], "id string"), now(), 0)
    with ThreadPoolExecutor(3) as pool:
        got = list(pool.map(lambda w: [r["id"] for r in Engine(spark, root).claim(3, w, now(), 1).collect()], ["w1", "w2", "w3"]))
    assert sorted(i for g in got for i in g) == [str(i) for i in range(9)] and [len(g) for g in got] == [3, 3, 3]
    assert engine.claim(3, "w4", now(), 2).count() == 0
    assert engine.lock("sweep", "a", 1000.0) and not engine.lock("sweep", "b", 2000.0)
    assert engine.lock("other", "b", 2000.0) and engine.lock("sweep", "b", 1000.0 + 3601)
    engine.unlock("sweep", "a")
    assert not engine.lock("sweep", "a", 4700.0)
    engine.unlock("sweep", "b")
    assert engine.lock("sweep", "a", 4701.0)


def test_old_stores_are_upgraded_once_and_lengths_checked(spark, tmp_path):
    from millrace.engine import CHUNKS, STATE
    from millrace.streaming.ingest import HASHES

    engine = Engine(spark, str(tmp_path / "old"))
    held = spark.createDataFrame([], RECORDS)
    rows = spark.createDataFrame([("1", "memory", "a body", "p/1.md"), ("2", "memory", "other", "p/2.md")], "id string, type string, body string, path string")
    chunk = spark.createDataFrame([("1:0", "1", 0, "a body", [0.0] * 4)], CHUNKS)
    engine.store.write(0, records=rows.select(*[c if c in rows.columns else F.lit(None).cast(held.schema[c].dataType).alias(c) for c in held.columns]), chunks=chunk)
    with pytest.raises(ValueError, match="vectors of 4 numbers, not 64"):
        engine.open(1, 64)
    assert engine.open(1, 4) == [1, 2] and engine.open(2, 4) == []
    assert [(r["id"], r["signature"]) for r in engine.store.read("embed_state", STATE).collect()] == [("1", None)]
    assert sorted(r["id"] for r in engine.store.read("hashes", HASHES).collect()) == ["1", "2"]
    assert engine.open(3, 64, rebuild=True) == [] and engine.chunks().count() == 0
    engine.refresh(4)
    assert engine.health().first().asDict() == {"embedded": 2, "pending": 0} and engine.open(5, 64) == []
