"""Files, streams and stores end to end in a temporary folder."""

from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import hygiene, ingest, models, state
from millrace.sources import files, transcripts
from millrace.streaming import ingest as streaming
from millrace.streaming.ingest import BATCH, MAPPING, RECORDS, Store


def now():
    return F.lit("2024-02-15 00:00:00").cast("timestamp")


def test_markdown_tree(spark, tmp_path):
    texts = {
        "notes/a.md": "---\ntitle: \"A b\"\ntags:\n  - x\n  - y\ntype: memory\n---\nBody a",
        "skills/deploy/SKILL.md": "# Deploy it\nsteps",
        "2024-01-05.md": "diary",
        "_meta/skip.md": "no",
        "INCIDENT-2024-01-01.md": "noisy",
        ".hidden/b.md": "secret",
    }
    for name, content in texts.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content)
    rows = files.files(spark, str(tmp_path))
    out = {r["title"]: r for r in files.typed_markdown(files.vault(rows), "notes").collect()}
    assert out["A b"]["tags"] == ["x", "y"] and out["A b"]["body"] == "Body a"
    assert out["Deploy it"]["metadata"]["type"] == "skill" and out["2024-01-05"]["metadata"]["type"] == "daily"
    assert "no" not in {r["body"] for r in out.values()}
    assert "INCIDENT-2024-01-01.md" not in {r["rel"] for r in files.extras(rows).collect()}
    assert ".hidden/b.md" not in {r["rel"] for r in files.user_skills(rows).collect()}
    team = files.workspace(spark, str(tmp_path / "notes"), "ari", {"*.md": ("core",)}, "team").collect()
    assert [r["tags"] for r in team] == [["x", "y", "core", "agent:ari"]]


def test_session_lines(spark, tmp_path):
    folder = tmp_path / "-home-u-app"
    folder.mkdir()
    entries = [
        {"type": "user", "sessionId": "abc", "timestamp": "2024-01-01T00:00:00Z", "message": {"content": "[not a list] hello\nthere"}},
        {"type": "assistant", "timestamp": "2024-01-01T00:01:00Z", "message": {"content": [{"type": "text", "text": "hi"}, {"type": "tool_use", "name": "ls"}, {"type": "tool_result"}]}},
        {"type": "user", "message": {"content": "  "}},
        {"type": "ai-title", "title": " First "},
        {"type": "ai-title", "title": " Last "},
    ]
    (folder / "s.jsonl").write_text("\n".join([json.dumps(e) for e in entries[:2]] + ["not json", "[1]"] + [json.dumps(e) for e in entries[2:]]))
    (folder / "empty.jsonl").write_text("{}")
    (row,) = transcripts.coding_sessions(files.lines(spark, str(tmp_path))).collect()
    assert row["body"] == "**User:** [not a list] hello\nthere\n\n**Assistant:** hi\n[tool_use: ls]\n[tool_result]"
    assert (row["title"], row["tags"], row["metadata"]["session_id"], row["metadata"]["turn_count"]) == ("Last", ["home-u-app"], "abc", "2")
    assert row["metadata"]["updated"] == "2024-01-01T00:01:00Z"


def test_trajectory_snapshot_wins_if_longer(spark, tmp_path):
    shot = [{"role": "user", "content": "q"}, {"role": "user", "content": "q"}, {"role": "assistant", "content": [{"type": "text", "text": " a "}, {"type": "thinking", "text": "x"}]}, {"role": "tool", "content": "t"}, {"role": "user", "content": "r"}]
    entries = [{"type": "prompt.submitted", "ts": "1", "sessionId": "s1", "data": {"prompt": "q"}}, {"type": "model.completed", "ts": "2", "data": {"assistantTexts": ["a", " "], "messagesSnapshot": shot, "agentId": "g"}}]
    (tmp_path / "x.trajectory.jsonl").write_text("\n".join(map(json.dumps, entries)))
    (row,) = transcripts.trajectories(files.lines(spark, str(tmp_path))).collect()
    assert row["body"] == "**User:** q\n\n**Assistant:** a\n\n**User:** r" and row["metadata"]["agent_id"] == "g"


def _batch(rows):
    when = datetime.datetime(2024, 2, 1)
    return [(seq, "src", ref, kind, "t", body, ["x"], when, when) for seq, ref, kind, body in rows]


def test_stream_ingest(spark, tmp_path):
    store = streaming.Store(spark, str(tmp_path / "store"))
    incoming = str(tmp_path / "in")
    run = lambda: streaming.ingest_stream(spark, incoming, store, str(tmp_path / "cp"), now).awaitTermination()
    spark.createDataFrame(_batch([(1, "a", "memory", "one"), (2, "b", "memory", " ONE "), (3, "c", "memory", "HEARTBEAT_OK"), (4, "d", "session", "old"), (5, "d", "session", "new")]), streaming.BATCH).coalesce(1).write.parquet(incoming)
    run()
    first = {r["body"]: r["id"] for r in store.read("records", streaming.RECORDS).collect()}
    assert set(first) == {"one", "new"}
    spark.createDataFrame(_batch([(6, "a", "memory", "one, changed"), (7, "e", "memory", "two by friday: ship it by friday")]), streaming.BATCH).coalesce(1).write.mode("append").parquet(incoming)
    run()
    rows = {r["body"]: r for r in store.read("records", streaming.RECORDS).collect()}
    assert set(rows) == {"one, changed", "new", "two by friday: ship it by friday"}
    assert rows["one, changed"]["id"] == first["one"]
    assert rows["two by friday: ship it by friday"]["valid_to"] == datetime.datetime(2024, 3, 14)
    run()
    assert store.read("records", streaming.RECORDS).count() == 3


def test_exposure_stream(spark, small):
    log = spark.readStream.schema(spark.read.parquet(f"{small}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(small)
    shaped = log.select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("memory_id"), F.col("event_type").alias("kind"))
    query = streaming.exposure_counts(shaped).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("counts").agg(F.sum("count")).first()[0] == spark.read.parquet(f"{small}/events.parquet").count()


def test_queue_lifecycle(spark):
    t = datetime.datetime(2024, 2, 14)
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    empty = spark.createDataFrame([], "id string, enqueued_at timestamp, retries int, last_error string, failed boolean, claimed_at timestamp, claimed_by string")
    queue = state.enqueued(empty, ids, F.lit(t))
    queue = state.claimed(queue, 2, "w", now())
    assert {r["id"] for r in queue.where("claimed_by = 'w'").collect()} == {"a", "b"}
    assert {r["id"] for r in state.claimed(queue, 5, "v", now()).where("claimed_by = 'v'").collect()} == {"c"}
    late = now() + F.expr("INTERVAL 301 SECONDS")
    assert state.claimed(queue, 5, "v", late).where("claimed_by = 'v'").count() == 3
    for _ in range(5):
        queue = state.with_errors(queue, spark.createDataFrame([("a", "boom")], "id string, error string"))
    row = queue.where("id = 'a'").first()
    assert (row["retries"], row["failed"], row["claimed_by"]) == (5, True, None)
    assert state.dequeued(queue, queue.where("id = 'b'")).count() == 2


def test_coerced_and_paths(spark):
    raw = spark.createDataFrame([("x", "weird", None, None, None, "T", None, None, ["a"], "p.md"), ("x", "skill", "2024-01-01", "bad", "s", "T", "u", "v", [], "q.md")], "id string, type string, created string, updated string, source string, title string, scope string, verification string, tags array<string>, path string")
    a, b = ingest.coerced(raw, now()).orderBy("path").collect()
    assert (a["type"], a["tags"], a["source"]) == ("memory", ["a", "weird"], "agent") and a["created"] == datetime.datetime(2024, 2, 15)
    assert (b["type"], b["updated"]) == ("skill", datetime.datetime(2024, 1, 1))


def test_caches_ask_once(spark):
    asked = spark.createDataFrame([("k1",), ("k2",), ("k2",)], "key string")
    cache = spark.createDataFrame([("k1", "old")], "key string, answer string")
    calls = []

    def answer(misses):
        calls.append(misses.count())
        return misses.select("key", F.lit("new").alias("answer"))

    answers, after = models.cached(asked, cache, ["key"], answer)
    assert calls == [1] and after.count() == 2
    assert sorted((r["key"], r["answer"]) for r in answers.collect()) == [("k1", "old"), ("k2", "new"), ("k2", "new")]


def test_embedder_per_task(spark):
    rows = spark.createDataFrame([("1:0", "1", 0, "ab"), ("1:1", "1", 1, "c")], "chunk_id string, id string, chunk_index int, text string")
    out = models.embedded(rows, lambda: lambda texts: [[float(len(t))] for t in texts])
    assert {r["chunk_id"]: r["embedding"] for r in out.collect()} == {"1:0": [2.0], "1:1": [1.0]}


@pytest.mark.parametrize(("dead", "blocked"), [(10, False), (11, True)])
def test_valve(spark, dead, blocked):
    index = spark.range(20).select(F.col("id"), F.col("id").cast("string").alias("path"))
    out = state.prune_missing(index, index.where(F.col("id") >= dead)).collect()
    assert len(out) == dead and {r["blocked"] for r in out} == {blocked}


def test_projects(spark):
    t = datetime.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("1", ["agent:x", "app"], t, t), ("2", ["app"], t, t), ("3", ["core"], t, t), ("4", ["solo"], t, t)], "id string, tags array<string>, created timestamp, updated timestamp")
    assert [(r["tag"], r["sessions"]) for r in hygiene.project_candidates(rows).collect()] == [("app", 2)]
    assert sorted((r["tag"], r["id"]) for r in hygiene.project_members(rows).collect()) == [("app", "1"), ("app", "2")]


def test_engine_round_trip(spark, tmp_path):
    from millrace.engine import Engine

    engine = Engine(spark, str(tmp_path / "engine"))
    rows = [(i, f"r{i}", "memory", f"note number{i} about topic{i % 3} and things") for i in range(9)] + [(9, "dup", "memory", "note number0 about topic0 and  things")]
    engine.ingest(spark.createDataFrame(_batch(rows), streaming.BATCH), 1, now())
    assert engine.verify().first()["records"] == 9 and engine.health().first().asDict() == {"embedded": 9, "pending": 0}
    asked = spark.createDataFrame([(1, "number4 topic1"), (2, "nothing here")], "query_id long, query string")
    hits = engine.search(asked, now()).orderBy("query_id", "final_rank").collect()
    assert hits[0]["query_id"] == 1 and "number4" in hits[0]["snippet"] and hits[0]["bm25_rank"] == 1
    log = engine.exposures(engine.search(asked, now()), asked, "test", now(), 100)
    assert log.agg(F.min("id")).first()[0] == 100 and log.count() == len(hits)
    path = hits[0]["path"]
    found = engine.get(spark.createDataFrame([(path,), (hits[0]["id"],), ("none",)], "key string")).collect()
    assert [r["id"] for r in found] == [hits[0]["id"]] * 2
    engine.ingest(spark.createDataFrame(_batch([(20, "r4", "memory", "now it is otherwise")]), streaming.BATCH), 2, now())
    assert engine.chunks().where("text like '%number4%'").count() == 0 and engine.health().first()["pending"] == 0


def test_ingest_into_a_store_that_has_records(spark):
    """A new title moves no record, a body given up in the batch is free, and a known ref is not given another's record."""
    now = F.lit("2024-02-15").cast("timestamp")

    def batch(*rows):
        whole = [(i, "s", ref, "memory", title, body, [], None, None) for i, (ref, title, body) in enumerate(rows)]
        return spark.createDataFrame(whole, BATCH).withColumn("created", now)

    before = ingest.ingested(batch(("a", "t", "one " * 40), ("c", "t", "three " * 40)), spark.createDataFrame([], RECORDS), spark.createDataFrame([], MAPPING), now)
    ids = {r["ref"]: r["id"] for r in before["source_map"].collect()}
    records = before["records"].withColumn("path", F.concat(F.lit("kept/"), "id"))
    after = ingest.ingested(batch(("a", "new title", "two " * 40), ("b", "t", "one " * 40), ("c", "t", "two " * 40)), records, before["source_map"], now)
    rows = {r["id"]: r for r in after["records"].collect()}
    mapped = {r["ref"]: r["id"] for r in after["source_map"].collect()}
    assert len(rows) == 3 and mapped["a"] == ids["a"] and mapped["c"] == ids["c"] and mapped["b"] not in ids.values()
    assert rows[ids["a"]]["path"] == "kept/" + ids["a"] and rows[ids["a"]]["body"].startswith("two")
    assert rows[mapped["b"]]["body"].startswith("one") and rows[ids["c"]]["body"].startswith("three")


def test_groups_with_a_skill_are_left(spark):
    rows = spark.createDataFrame([(1, "memory", "x", None), (2, "memory", "x", None), (3, "skill", "x", None), (4, "memory", "y", None), (5, "memory", "y", None)], "id long, type string, hash string, deprecated_by long")
    won = spark.createDataFrame([("x", 1, True, 1), ("x", 2, False, 1), ("x", 3, False, 1), ("y", 4, True, 4), ("y", 5, False, 4)], "hash string, id long, is_winner boolean, winner_id long")
    out = {r["id"]: r["deprecated_by"] for r in hygiene.deprecate_losers(rows, won).collect()}
    assert out == {1: None, 2: None, 3: None, 4: None, 5: "4"}


def test_plans_are_capped_by_path(spark):
    rows = spark.createDataFrame([("b", "p/2"), ("a", "p/2"), ("c", "p/1"), ("d", "p/3")], "id string, path string")
    assert [r["id"] for r in hygiene.planned(rows, 2).collect()] == ["c", "a"]
    assert hygiene.planned(rows, None).count() == hygiene.planned(rows, -1).count() == 4 and hygiene.planned(rows, 0).count() == 0


def test_verification_counts(spark):
    columns = "id string, type string, body string, links array<string>, valid_to timestamp, deprecated_by string, deleted_at timestamp"
    rows = [("1", "memory", "x", [], None, None, None), ("2", "memory", " X ", [], None, None, None), ("3", "skill", "y", [], None, None, None), ("4", "memory", "y", [], None, None, None), ("5", "memory", "x", [], None, "1", None)]
    rows += [("6", "distillation", "z", ["memory://sessions/s1.md", "sessions/s1", "memories/m"], None, None, None)]
    status = spark.createDataFrame([("s1", "covered"), ("s2", "candidate"), ("s3", "short")], "id string, status string")
    noise = spark.createDataFrame([("drop",), ("keep",), ("tag_transient",), ("drop",)], "action string")
    paths = spark.createDataFrame([("skills/_review/a.md",), ("skills/_review/done/b.md",), ("skills/a.md",), ("skills/_review/c.txt",)], "rel string")
    broken = spark.createDataFrame([("bad.md",), ("bad.md",)], "ref string")
    whole = hygiene.verification(spark.createDataFrame(rows, columns), status, noise, paths, broken).first().asDict()
    expected = {"records": 6, "deprecated": 1, "expiring": 0, "deleted": 0, "collision_groups": 2, "collision_records": 4, "skill_groups": 1, "to_deprecate": 1}
    assert whole == expected | {"noise_drop": 2, "noise_transient": 1, "covered_sessions": 1, "eligible_sessions": 1, "open_tickets": 1, "parse_skips": 1}
    empty = hygiene.verification(*[t.where("false") for t in (spark.createDataFrame(rows, columns), status, noise, paths, broken)]).first()
    assert set(empty) == {0}


def test_a_batch_played_again_changes_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("1", 0.5)], "id string, importance double")
    store.write(0, "stream", records=rows)
    assert store.seen("stream") == 0 and store.seen("other") == -1
    store.write(7, records=rows)
    assert store.seen("stream") == 0 and store.read("records", "id string, importance double").count() == 1
