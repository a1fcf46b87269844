"""The data source of files: batches, a quiet watch, restarts, liveness, and ingest from it."""

from __future__ import annotations

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from millrace.operators import state
from millrace.sources import datasource
from millrace.streaming.ingest import RECORDS, Store, taken_in


def write(root, name, text, age=100.0):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    os.utime(path, ns=(int((time.time() - age) * 1e9),) * 2)
    return str(path)


@pytest.fixture
def load(spark):
    datasource.VaultFiles.register(spark)
    return lambda root, **options: spark.read.format("vault_files").options(**options).load(str(root))


def test_formats_load(load, tmp_path):
    coding = [{"type": "user", "sessionId": "abc", "timestamp": "2024-01-01T00:00:00Z", "message": {"content": "hello"}}, {"type": "assistant", "message": {"content": [{"type": "text", "text": "hi"}]}}]
    rollout = [{"type": "session_meta", "payload": {"id": "r1", "cwd": "/home/u/app"}}, {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "do it"}]}}]
    trajectory = [{"type": "prompt.submitted", "ts": "1", "sessionId": "s1", "data": {"prompt": "q"}}, {"type": "model.completed", "ts": "2", "data": {"assistantTexts": ["a"]}}]
    for kind, rows in (("coding", coding), ("rollout", rollout), ("trajectory", trajectory)):
        write(tmp_path, f"{kind}/x.jsonl", "\n".join(map(json.dumps, rows)))
    write(tmp_path, "notes/SKILL.md", "# Deploy it\nsteps")
    write(tmp_path, "notes/.hidden/b.md", "secret")
    bodies = {"coding": "**User:** hello\n\n**Assistant:** hi", "rollout": "**User:** do it", "trajectory": "**User:** q\n\n**Assistant:** a"}
    for kind, body in bodies.items():
        (row,) = datasource.parsed(load(tmp_path / kind, glob="*.jsonl"), kind, kind).collect()
        assert row["body"] == body and row["ref"].endswith("x.jsonl")
    (row,) = datasource.parsed(load(tmp_path / "notes"), "markdown", "notes").collect()
    assert (row["title"], row["metadata"]["type"]) == ("Deploy it", "skill")
    assert load(tmp_path / "nothing").count() == 0


def run(spark, root, out, checkpoint, quiet=5):
    rows = spark.readStream.format("vault_files").option("quiet", quiet).load(str(root))
    stream = rows.select("rel", F.decode("content", "UTF-8").alias("text")).writeStream.format("parquet").option("checkpointLocation", str(checkpoint)).start(str(out))
    try:
        stream.processAllAvailable()
    finally:
        stream.stop()
    return sorted(tuple(r) for r in spark.read.schema("rel string, text string").parquet(str(out)).collect()) if out.exists() else []


def test_changed_files_come_once_more_when_they_are_quiet(spark, load, tmp_path):
    root, out, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "cp"
    write(root, "a.md", "one", 300)
    write(root, "b.md", "two", 200)
    write(root, "busy.md", "draft", 0)
    assert run(spark, root, out, checkpoint) == [("a.md", "one"), ("b.md", "two")]
    # Nothing changed: a restart emits nothing.
    assert len(run(spark, root, out, checkpoint)) == 2
    write(root, "a.md", "one, changed", 60)
    for k in range(5):
        write(root, "burst.md", f"version {k}", 50 - k)
    write(root, "busy.md", "final", 40)
    expected = [("a.md", "one"), ("a.md", "one, changed"), ("b.md", "two"), ("burst.md", "version 4"), ("busy.md", "final")]
    assert run(spark, root, out, checkpoint) == expected
    # The last row of each path equals a rescan.
    assert {r["rel"]: bytes(r["content"]).decode() for r in load(root).collect()} == dict(expected)


def test_files_to_records_and_back_when_they_are_deleted(spark, load, tmp_path):
    now = F.lit("2024-02-15").cast("timestamp")
    store, root = Store(spark, str(tmp_path / "store")), tmp_path / "in"
    kept = [write(root, f"n{i}.md", f"note {i}") for i in range(3)]
    take = lambda version: store.change(version, lambda read: taken_in(read, datasource.batch_rows(datasource.parsed(load(root), "markdown", "notes")), now))
    take(0)
    mapping = store.read("source_map", "source string, ref string, id string, hash string")
    assert sorted(r["ref"] for r in mapping.collect()) == kept
    os.remove(kept[1])
    alive = datasource.existing(spark, str(root), mapping)
    assert {r["ref"]: r["exists"] for r in alive.collect()} == {kept[0]: True, kept[1]: False, kept[2]: True}
    verdicts = state.source_sweep(alive, store.read("records", RECORDS), spark.createDataFrame([(str(root),)], "root string"))
    assert sorted(r["verdict"] for r in verdicts.collect()) == ["live", "live", "tombstone"]


def test_heads_of_prompts(spark, tmp_path):
    from hashlib import sha256

    from millrace.sources.heads import prompt_heads

    long = "x" * 3000
    write(tmp_path, "CLAUDE.md", "root")
    write(tmp_path, "a/b/c/d/USER.md", long)
    write(tmp_path, "a/b/c/d/e/SOUL.md", "too deep")
    write(tmp_path, "a/node_modules/CLAUDE.md", "skipped")
    write(tmp_path, "a/.claude/projects/MEMORY.md", "skipped, too")
    write(tmp_path, "a/projects/MEMORY.md", "kept")
    write(tmp_path, "a/SOUL.md", "")
    write(tmp_path, "a/other.md", "no prompt")
    found = {r["head"] for r in prompt_heads(spark, [str(tmp_path), str(tmp_path / "a"), "/no/such/root"], 4).collect()}
    assert found == {sha256(t[:1024].encode()).hexdigest() for t in ("root", long, "kept", "too deep")}
    assert len(prompt_heads(spark, [str(tmp_path)]).collect()) == 3
