"""Phrases, operators and the stored index, against SQLite's FTS5 and against rebuilding."""

from __future__ import annotations

import math
import sqlite3
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

from millrace.functions.stem import stem, stemmed
from millrace.operators import lexical
from millrace.operators.textindex import TextIndex
from millrace.plans import bindings
from millrace.streaming.ledger import Conflict, Ledger

SCHEMA = "id string, title string, body string, tags array<string>"
BODIES = ["foo bar", "bar foo", "alpha beta", "alpha", "beta gamma alpha", "foo x bar running", "AND or not", "near alpha x", "foo bar foo bar runs", "", "gamma, gamma; GAMMA"]
QUERIES = [
    "foo_bar", "alpha AND beta", "alpha OR foo", "alpha NOT beta", "AND alpha", "alpha AND", "NOT", "alpha beta NOT gamma", "alpha NOT beta OR foo", "NOT beta", "_ alpha", "_", "alpha AND _", "alpha NOT _",
    "_ OR alpha", "NEAR alpha", "alpha alpha", "alpha OR OR foo", "x OR alpha AND beta NOT gamma", "or", "_ NOT alpha", "foo_ _bar", "runs", "what's-new? foo", "", " ?! ", "alpha OR", "bar_foo OR gamma_gamma", "and", "runner_up", "foo AND bar AND x", "tags_foo",
]


def corpus(spark, bodies=BODIES, start=0):
    return spark.createDataFrame([(f"d{start + i:03}", f"title {i % 3}", b, ["tags", "x" * (i % 2)]) for i, b in enumerate(bodies)], SCHEMA)


def fts5(rows, query):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(id UNINDEXED, title, body, tags, tokenize='porter unicode61')")
    db.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", [(r["id"], r["title"], r["body"], " ".join(r["tags"])) for r in rows])
    import re

    clean = re.sub(r"[^\w\s]", " ", query).strip()
    try:
        return dict(db.execute("SELECT id, bm25(t) FROM t WHERE t MATCH ?", (clean,)).fetchall()) if clean else {}
    except sqlite3.OperationalError as error:
        assert "syntax error" in str(error)
        return {}


def compare(hits, rows):
    found = {}
    for r in hits.collect():
        found.setdefault(r["query_id"], {})[r["id"]] = r["score"]
    for k, query in enumerate(QUERIES):
        expected = fts5(rows, query)
        assert set(found.get(k, {})) == set(expected), query
        assert all(math.isclose(found[k][i], s, rel_tol=1e-9, abs_tol=1e-12) for i, s in expected.items()), query


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, query string").cache()


def test_operators_equal_fts5(spark, asked):
    rows = corpus(spark)
    compare(lexical.search(rows, asked, 1000, stem=stemmed), rows.collect())


def test_index_follows_changes(spark, asked, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i"), buckets=8)
    assert index.hits(asked).count() == 0
    index.upsert(corpus(spark, ["gone words here"] * len(BODIES)))
    index.upsert(corpus(spark, BODIES[:6]))
    index.upsert(corpus(spark, BODIES[6:], 6))
    index.upsert(corpus(spark, ["more alpha", "foo bar baz"], 50))
    index.delete(spark.createDataFrame([("d050",), ("d003",), ("unknown",)], "id string"))
    now = corpus(spark).where("id <> 'd003'").unionByName(corpus(spark, ["more alpha", "foo bar baz"], 50).where("id = 'd051'"))
    # Titles go by the place in a batch; those of the second one start anew.
    now = now.selectExpr("id", "CASE WHEN id >= 'd006' AND id < 'd050' THEN concat('title ', (cast(substr(id, 2) as int) - 6) % 3) ELSE title END AS title", "body", "CASE WHEN id >= 'd006' AND id < 'd050' THEN array('tags', repeat('x', (cast(substr(id, 2) as int) - 6) % 2)) ELSE tags END AS tags")
    rows = now.collect()
    compare(index.hits(asked), rows)
    for step in (lambda: index.merge(), lambda: index.merge(everything=True), lambda: index.vacuum()):
        step()
        compare(index.hits(asked), rows)
    assert len(index._state()[1]["segments"]) == 1
    rebuilt = lexical.postings(now, stem=stemmed)
    df = {r["term"]: r["df"] for r in lexical.document_frequencies(rebuilt).collect()}
    assert {r["term"]: r["df"] for r in index.frequencies().collect()} == df
    index.upsert(corpus(spark, ["alpha"], 70))
    assert {r["term"]: r["df"] for r in index.frequencies().collect()}["alpha"] == df["alpha"] + 1


def test_many_small_changes_are_merged(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i"), buckets=2)
    for i in range(11):
        index.upsert(corpus(spark, [f"word{i} alpha"], i % 4))
    assert len(index._state()[1]["segments"]) <= 9
    assert index.statistics().first()["n"] == 4
    one = spark.createDataFrame([(1, "alpha"), (2, "word3"), (3, "word10")], "query_id long, query string")
    assert sorted((r["query_id"], r["id"]) for r in index.hits(one).collect()) == [(1, "d000"), (1, "d001"), (1, "d002"), (1, "d003"), (3, "d002")]


def test_searches_read_the_buckets_of_their_terms(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i"), buckets=16)
    index.upsert(corpus(spark))
    terms = spark.createDataFrame([("alpha",)], "term string")
    plan = index.postings(terms)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket#" in plan.split("PartitionFilters")[-1] and "EqualTo(term,alpha)" in plan


def test_writers_at_once_lose_nothing(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i"), buckets=2)
    index.upsert(corpus(spark, ["base"], 0))
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda i: TextIndex(spark, str(tmp_path / "i"), buckets=2).upsert(corpus(spark, [f"word{i}", "shared"], 10 * i)), range(1, 4)))
    assert index.statistics().first()["n"] == 7
    found = index.hits(spark.createDataFrame([(1, "shared"), (2, "base"), (3, "word2")], "query_id long, query string"))
    assert sorted((r["query_id"], r["id"]) for r in found.collect()) == [(1, "d011"), (1, "d021"), (1, "d031"), (2, "d000"), (3, "d020")]


def test_ledger_entries_are_made_once(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"))
    assert ledger.read() == (0, {})
    ledger.put(1, {"a": 1})
    with pytest.raises(Conflict):
        ledger.put(1, {"a": 2})
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda _: Ledger(spark, str(tmp_path / "l")).update(lambda v: {"a": v["a"] + 1}), range(24)))
    assert ledger.read() == (25, {"a": 25})


def test_stems_in_sql_equal_the_stemmer(spark, small):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW d AS SELECT * FROM '{small}/documents.parquet'")
    rows = con.sql(f"WITH {bindings.stems_sql('SELECT DISTINCT unnest(' + bindings.words_sql('text') + ') AS term FROM d')} SELECT * FROM stems").fetchall()
    assert len(rows) > 1000 and all(s == stem(t) for t, s in rows)


def test_words_hash_as_in_spark(spark):
    import pyarrow as pa

    from millrace.operators import blocks

    words = ["", "a", "éa", "word", "worded1", "12345678", "größe12345678", *["x" * n + "yz" * (n % 3) for n in range(70)]]
    expected = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").selectExpr("xxhash64(w)").collect()]
    assert blocks.xxhash64(pa.array(["before", *words])[1:]).tolist() == expected


def test_an_index_is_made_without_shuffles_of_postings(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from millrace.operators import blocks

    monkeypatch.setattr(blocks, "SPLIT", 3)
    monkeypatch.setattr(lexical, "postings", None)  # nor grouped by them
    rows = corpus(spark, BODIES * 4)
    index = TextIndex(spark, str(tmp_path / "i"), buckets=4)
    index.upsert(rows)
    monkeypatch.undo()
    key = lambda r: (r["id"], r["term"], r["tf"], r["dl"], sorted(r["positions"]))
    assert sorted(map(key, index.postings().collect())) == sorted(map(key, lexical.postings(rows, stem=stemmed).collect()))
    held = {r["id"]: (r["dl"], sorted(r["terms"])) for r in index._read("records", [1]).collect()}
    own = rows.select("id", lexical.words().alias("words")).select("id", lexical.length().alias("dl"))
    assert {i: d for i, (d, _) in held.items()} == {r["id"]: r["dl"] for r in own.collect()}
    terms = lexical.postings(rows, stem=stemmed).groupBy("id").agg(F.sort_array(F.collect_list("term")).alias("t")).collect()
    assert all(held[r["id"]][1] == sorted(r["t"]) for r in terms)


@pytest.mark.parametrize("types", [(), ("a",)])
def test_a_search_of_single_terms_equals_its_hits(spark, tmp_path, types):
    index = TextIndex(spark, str(tmp_path / "i"), buckets=4)
    index.upsert(corpus(spark, ["gone alpha"] * 20))
    index.upsert(corpus(spark, BODIES * 3))
    index.delete(spark.createDataFrame([("d003",)], "id string"))
    rows = corpus(spark, BODIES * 3).where("id <> 'd003'").selectExpr("*", "if(id > 'd010', 'a', 'b') AS type")
    asked = spark.createDataFrame([(1, "alpha"), (2, "foo AND bar"), (3, "running OR gamma NOT beta"), (4, "nowhere"), (5, "")], "query_id long, query string")
    got = sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in index.search(asked, rows, 4, types).collect())
    assert got == sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in lexical.best(index.hits(asked), rows, 4, types).collect())
    assert len(got) == 12


def test_removed_records_are_found_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "FEW", 2)
    index = TextIndex(spark, str(tmp_path / "i"), buckets=8)
    index.upsert(corpus(spark, ["one two"] * 12))
    index.upsert(corpus(spark, ["two three"] * 9, 2))
    index.delete(spark.createDataFrame([("d000",), ("d005",), ("unknown",)], "id string"))
    df = {r["term"]: r["df"] for r in index.frequencies().collect()}
    assert (index.statistics().first()["n"], df["on"], df["two"], df["three"]) == (10, 2, 10, 8)
