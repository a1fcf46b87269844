"""Ingest into a store that has records: one row of each id and path, shared refs, displaced records, counts of bodies."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from millrace.operators import ingest
from millrace.streaming.ingest import BATCH, DETAILS, HASHES, MAPPING, RECORDS, Store, taken_in
from millrace.streaming.ledger import Conflict


def now():
    return F.lit("2024-02-15").cast("timestamp")


def batch(spark, *rows, start=0):
    """rows: (ref, type, title, body) with, if need be, more columns by name."""
    whole = [(start + i, "s", r[0], r[1], r[2], r[3], [], None, None, *[(r[4] if len(r) > 4 else {}).get(c) for c in ("scope", "session_id", "daily_date", "daily_scope")]) for i, r in enumerate(rows)]
    return spark.createDataFrame(whole, f"{BATCH}, {DETAILS}").withColumn("created", F.lit("2024-01-01").cast("timestamp"))


class Tables:
    def __init__(self, spark):
        self.spark = spark
        self.held = {"records": spark.createDataFrame([], RECORDS), "source_map": spark.createDataFrame([], MAPPING), "hashes": spark.createDataFrame([], HASHES)}

    def take(self, rows):
        out = ingest.ingested(rows, self.held["records"], self.held["source_map"], now(), hashes=self.held["hashes"])
        self.held = {k: out[k].checkpoint() for k in self.held}
        self.displaced = [r["id"] for r in out["displaced"].collect()]
        records = self.held["records"].collect()
        assert len({r["id"] for r in records}) == len({r["path"] for r in records}) == len(records)
        self.mapped = {r["ref"]: r["id"] for r in self.held["source_map"].collect()}
        assert len(self.mapped) == self.held["source_map"].count() and set(self.mapped.values()) <= {r["id"] for r in records}
        self.seen = {r["id"]: r["seen_count"] for r in self.held["hashes"].collect()}
        assert set(self.seen) == {r["id"] for r in records}
        return {r["id"]: r for r in records}


def test_refs_of_one_record_change_at_once(spark):
    t = Tables(spark)
    (x,) = t.take(batch(spark, ("a", "memory", "t", "one"), ("b", "memory", "t", " ONE ")))
    assert t.mapped == {"a": x, "b": x} and t.seen == {x: 2}
    rows = t.take(batch(spark, ("a", "memory", "t", "two"), ("b", "memory", "t", "three"), ("c", "memory", "t", "one")))
    assert rows[x]["body"] == "three" and t.mapped["a"] == t.mapped["b"] == x and t.mapped["c"] != x and rows[t.mapped["c"]]["body"] == "one"
    rows = t.take(batch(spark, ("a", "memory", "t", "four"), ("b", "memory", "t", "four")))
    assert rows[x]["body"] == "four" and len(rows) == 2 and t.seen[x] == 1


def test_known_refs_do_not_take_others_bodies(spark):
    t = Tables(spark)
    t.take(batch(spark, ("a", "memory", "t", "one"), ("b", "memory", "t", "two")))
    ids = dict(t.mapped)
    # Both bring what the other had: nothing changes, and it is counted.
    rows = t.take(batch(spark, ("a", "memory", "t", "two"), ("b", "memory", "t", "one")))
    assert t.mapped == ids and rows[ids["a"]]["body"] == "one" and t.seen == {ids["a"]: 2, ids["b"]: 2}
    # a wins the new body; c, a session, is no source of it.
    rows = t.take(batch(spark, ("a", "memory", "t", "new"), ("b", "memory", "t", "new"), ("c", "session", "t", "new")))
    assert rows[ids["a"]]["body"] == "new" and rows[ids["b"]]["body"] == "two" and set(t.mapped) == {"a", "b"} and t.seen[ids["a"]] == 3


def test_paths(spark):
    t = Tables(spark)
    rows = t.take(batch(spark, ("x/2024-01-05.md", "daily", "d", "diary"), ("y", "daily", "d", "more", {"daily_date": "2024-01-06", "daily_scope": "rem"}), ("z", "session", "s", "talk", {"session_id": "abc"}), ("k1", "skill", "Deploy it", "v1"), ("k2", "skill", "Deploy it", "v2"), ("m", "memory", "t", "plain")))
    assert {r["path"] for r in rows.values()} == {"daily/2024-01-05.md", "daily/rem/2024-01-06.md", "sessions/abc.md", "skills/deploy-it.md", f"memories/s/{t.mapped['m']}.md"}
    assert rows[t.mapped["k2"]]["body"] == "v2" and "k1" not in t.mapped and len(t.displaced) == 1
    first = t.mapped["k2"]
    rows = t.take(batch(spark, ("k3", "skill", "deploy IT", "v3")))
    assert first not in rows and t.displaced == [first] and "k2" not in t.mapped


def test_upserts_leave_one_row_of_each_key_and_slot(spark):
    old = spark.createDataFrame([("1", "a", "x"), ("2", "b", "y"), ("3", "c", "z")], "id string, path string, body string")
    new = spark.createDataFrame([("4", "b", "p", 1), ("4", "d", "q", 2), ("5", "d", "r", 3), ("1", "c", "s", 0)], "id string, path string, body string, n int")
    assert sorted(map(tuple, ingest.upserted(old, new, order=["n"]).collect())) == [("1", "c", "s"), ("2", "b", "y"), ("5", "d", "r")]


def test_writers_of_a_store_take_turns(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    read = lambda s=store: s.read("n", "n long").collect()[0]["n"]
    store.write(0, n=spark.range(1).selectExpr("id AS n"))
    stale = store.snapshot()
    store.write(1, n=spark.range(1).selectExpr("id + 1 AS n"))
    with pytest.raises(Conflict):
        store.write(2, snapshot=stale, n=spark.range(1).selectExpr("id + 7 AS n"))
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda k: Store(spark, str(tmp_path / "s")).change(k, lambda get: {"n": get("n", "n long").selectExpr("n + 1 AS n")}), range(3)))
    assert read() == 4
    assert store.change(5, lambda get: {"n": get("n", "n long")}, "stream") and not store.change(5, lambda get: {"n": get("n", "n long")}, "stream")
    assert not store.change(6, lambda get: None)


def test_displaced_records_lose_their_children(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    chunks = "chunk_id string, memory_id string"
    store.change(0, lambda read: taken_in(read, batch(spark, ("k1", "skill", "Do", "v1")), now()))
    (old,) = [r["id"] for r in store.read("records", RECORDS).collect()]
    store.write(1, chunks=spark.createDataFrame([("c", old), ("d", "other")], chunks))
    store.change(2, lambda read: taken_in(read, batch(spark, ("k2", "skill", "Do", "v2")), now(), children={"chunks": chunks}))
    assert [r["chunk_id"] for r in store.read("chunks", chunks).collect()] == ["d"]
