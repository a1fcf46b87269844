"""Search semantics against SQLite's FTS5, a greedy loop, and hand-made cases."""

from __future__ import annotations

import math
import sqlite3

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.functions import stem, text, vectors
from millrace.model import SearchOptions, clamp_limit, clamp_rerank
from millrace.operators import evaluate, fusion, lexical
from millrace.plans import bindings

STEMS = "caresses ponies feed agreed matting meeting relational conditional hopefulness formalize electriciti adjustable replacement adoption effective controll sky happy hopping falling generalizations".split()


def test_stemmer_equals_fts5():
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61')")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, row)")
    for word in STEMS:
        db.execute("DELETE FROM t")
        db.execute("INSERT INTO t VALUES (?)", (word,))
        assert [r[0] for r in db.execute("SELECT term FROM v")] == [stem.stem(word)]


def test_bm25_equals_fts5(spark, small):
    rows = bindings.records(spark, small)
    asked = spark.createDataFrame([(1, "the of"), (2, "and that the"), (3, "café nosuchword"), (4, " ?! ")], "query_id long, query string")
    hits = {(r["query_id"], r["id"]): r["score"] for r in lexical.search(rows, asked, 1000).collect()}
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(id UNINDEXED, title, body, tags, tokenize='unicode61')")
    db.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", [(r["id"], r["title"], r["body"], " ".join(r["tags"])) for r in rows.collect()])
    expected = {(q, i): s for q, words in ((1, "the of"), (2, "and that the")) for i, s in db.execute("SELECT id, bm25(t) FROM t WHERE t MATCH ?", (words,))}
    assert set(hits) == set(expected)
    assert all(math.isclose(hits[k], expected[k], rel_tol=1e-9, abs_tol=1e-12) for k in hits)


def test_mmr_is_greedy(spark):
    rng = np.random.default_rng(5)
    vs = rng.normal(size=(30, 6))
    asked = rng.normal(size=6)
    rows = [(1, i, i + 1, vs[i].tolist() if i % 7 else None, asked.tolist()) for i in range(30)]
    df = spark.createDataFrame(rows, "query_id long, id long, final_rank int, embedding array<double>, query_embedding array<double>")
    got = [r["id"] for r in fusion.mmr(df, 0.5, 8).orderBy("mmr_rank").collect()]
    cos = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    left, picked = [i for i in range(30) if i % 7], []
    while len(picked) < 8:
        best = max(left, key=lambda i: 0.5 * cos(asked, vs[i]) - 0.5 * max([cos(vs[i], vs[j]) for j in picked], default=0.0))
        picked.append(best)
        left.remove(best)
    assert got == picked
    assert len(fusion.mmr(df, 0.5, 40).collect()) == 30


def test_rrf_ties_keep_keyword_hits_first(spark):
    keyword = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id long, id string, rank int")
    near = spark.createDataFrame([(1, "c", 10, 1), (1, "d", 11, 2), (1, "c", 12, 3)], "query_id long, id string, chunk_id long, rank int")
    out = fusion.rrf(keyword, near).orderBy("position").collect()
    assert [(r["id"], r["bm25_rank"], r["vec_rank"]) for r in out] == [("a", 1, None), ("c", None, 1), ("b", 2, None), ("d", None, 2)]
    assert out[0]["score"] == pytest.approx(1 / 61)


def test_visibility_border(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    rows = spark.sql("SELECT 1 AS id, TIMESTAMP '2024-01-01 00:00:00' AS valid_to, CAST(NULL AS STRING) AS deprecated_by, CAST(NULL AS TIMESTAMP) AS deleted_at UNION ALL SELECT 2, NULL, NULL, NULL UNION ALL SELECT 3, NULL, 'x', NULL")
    assert [r["id"] for r in rows.where(fusion.visible(now)).collect()] == [2]
    assert {r["id"] for r in rows.where(fusion.visible(now, True, True)).collect()} == {1, 2, 3}


def test_options():
    assert SearchOptions(limit=5, mmr_lambda=0.7, rerank_top_n=30).materialised == 30
    assert SearchOptions(limit=5).materialised == 5 and SearchOptions(limit=5).candidates == 25
    assert (clamp_limit(0), clamp_limit(500), clamp_rerank(0), clamp_rerank(99)) == (1, 100, 1, 50)


def test_cosine_guards(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == pytest.approx([0.0, 0.0, 0.0, 1.0])


def test_metrics(spark):
    ranks = spark.createDataFrame([(1, "factual", 1), (2, "factual", None), (3, "historical", 5)], "query_id long, class string, first_rank int")
    out = {r["class"]: r for r in evaluate.metrics(ranks).collect()}
    assert out["all"]["mrr"] == pytest.approx((1 + 0 + 0.2) / 3) and out["factual"]["recall_3"] == 0.5 and out["all"]["found"] == 2


def _chunked(body: str, most: int) -> list[str]:
    """The rule of the chunk function in plain Python."""
    if not body.strip():
        return []
    if len(body) <= most:
        return [body.strip()]
    out, held = [], ""
    for p in filter(None, (p.strip() for p in body.split("\n\n"))):
        if len(p) > most:
            out += [held] if held else []
            out += [p[i : i + most] for i in range(0, len(p), most)]
            held = ""
        elif held and len(held) + 2 + len(p) <= most:
            held += "\n\n" + p
        else:
            out += [held] if held else []
            held = p
    return out + ([held] if held else [])


def test_chunks(spark):
    bodies = ["", "  \n ", " short ", "a\n\nb\n\n\n\nccc\n\n" + "d" * 25 + "\n\ne", "x" * 20, "x" * 21, "aaaa aaaa\n\nbbbb bbb\n\ncc\n\n" + "é" * 11]
    df = spark.createDataFrame(pd.DataFrame({"body": bodies}))
    got = [r[0] for r in df.select(text.chunks(F.col("body"), 10)).collect()]
    assert got == [_chunked(b, 10) for b in bodies]


def test_uuid5(spark):
    import uuid

    space = "a3c1f0de-1b2c-4d3e-9f80-0a1b2c3d4e5f"
    names = ["a", "memories/1.md", "ü/é"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(text.uuid5(space, F.col("n"))).collect()]
    assert got == [str(uuid.uuid5(uuid.UUID(space), n)) for n in names]


def test_vectors_of_other_lengths_are_left_out_or_an_error(spark):
    from millrace.operators import vector

    chunks = spark.createDataFrame([(1, 1, [0.0, 1.0]), (2, 2, [0.0, 1.0, 0.0, 1.0]), (3, 3, [1.0, 1.0, 1.0]), (4, 4, None), (5, 5, [0.0, 0.0, 3.0])], "chunk_id long, id long, embedding array<double>")
    asked = spark.createDataFrame([(1, [0.0, 0.0, 0.0]), (2, [0.0, 1.0]), (3, [])], "query_id long, embedding array<double>")
    out = vector.knn(chunks, asked, 10).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["chunk_id"], round(r["distance"], 6)) for r in out] == [(1, 3, 1.732051), (1, 5, 3.0), (2, 1, 0.0)]
    with pytest.raises(Exception, match="another length"):
        vector.knn(chunks, asked, 10, strict=True).collect()
    assert vector.knn(chunks, asked.where("query_id > 9"), 3).count() == 0


def test_a_task_keeps_what_the_final_k_need(spark):
    from millrace.operators import vector

    rng = np.random.default_rng(2)
    rows = [(i, i, rng.integers(0, 4, 3).astype(float).tolist()) for i in range(3000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        asked = spark.createDataFrame([(q, rng.integers(0, 4, 3).astype(float).tolist()) for q in range(5)], "query_id long, embedding array<double>")
        got = {(r["query_id"], r["rank"]): r["chunk_id"] for r in vector.knn(spark.createDataFrame(rows, "chunk_id long, id long, embedding array<double>").coalesce(2), asked, 7).collect()}
        for q in asked.collect():
            best = sorted(rows, key=lambda r: (round(math.dist(r[2], q["embedding"]), 6), r[0]))[:7]
            assert [got[q["query_id"], n + 1] for n in range(7)] == [r[0] for r in best]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def shuffled(df) -> int:
    """Rows that the query's shuffles wrote, by its metrics."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        for kind in ("executedPlan", "plan"):
            if "QueryStage" in node.nodeName() or node.nodeName().startswith("AdaptiveSparkPlan"):
                try:
                    todo.append(getattr(node, kind)())
                    break
                except Exception:  # noqa: BLE001  stages and adaptive plans name their plan differently
                    continue
        if node.nodeName() == "Exchange":
            total += node.metrics().apply("shuffleRecordsWritten").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


ODD = ["", None, "!?", "one two", "two one two", "one one two", "Zwei É one", "one " * 50 + "two", "foo bar foo", "bar foo bar foo bar"]


def odd_records(spark, n: int = 400):
    rows = [(i, "one" if i % 7 == 0 else None, ODD[i % len(ODD)], ["a", "two"] if i % 3 else None, "memory" if i % 2 else "skill") for i in range(n)]
    return spark.createDataFrame(rows, "id long, title string, body string, tags array<string>, type string").repartition(6)


SPOKEN = ["one", "one two", "two AND one", "one NOT two", "one OR foo", "foo_bar", "foo_bar NOT bar_foo_bar", "one one two OR zwei", "AND one", "", "nowhere", "one_two e AND two NOT foo", "bar_foo_bar_foo OR one_two", "missing_word OR one"]


@pytest.mark.parametrize("types", [(), ("memory",)])
def test_a_scan_finds_what_joined_postings_find_and_shuffles_little(spark, monkeypatch, types):
    from millrace.operators import scan

    rows = odd_records(spark)
    asked = spark.createDataFrame(list(enumerate(SPOKEN)), "query_id long, query string")
    out = lexical.search(rows, asked, 7, types)
    got = {(r["query_id"], r["rank"]): (r["id"], round(r["score"], 9)) for r in out.collect()}
    # Each of 6 tasks sends 7 hits of a query at most; there are thousands of hits.
    assert shuffled(out) <= 6 * 7 * len(SPOKEN)
    monkeypatch.setattr(scan, "CELLS", 100)
    assert {(r["query_id"], r["rank"]): (r["id"], round(r["score"], 9)) for r in lexical.search(rows, asked, 7, types).collect()} == got
    monkeypatch.setattr(scan, "STATED", 0)
    joined = {(r["query_id"], r["rank"]): (r["id"], round(r["score"], 9)) for r in lexical.search(rows, asked, 7, types).collect()}
    assert got == joined and len({q for q, _ in got}) >= 9
    assert lexical.search(rows, asked.limit(0), 7).count() == 0 and lexical.search(rows.limit(0), asked, 7).count() == 0


def test_scores_are_rounded_as_spark_does(spark):
    from millrace.operators import scan

    values = [0.0000000005, -0.0000000015, 0.1234567895, -2.5000000005, 7.25, -1e-9, 3.0000000004999]
    expected = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(F.round("v", 9)).collect()]
    assert [round(u / 1e9, 9) for u in scan.units(np.array(values))] == expected


def test_only_records_that_hits_name_are_joined(spark, monkeypatch):
    rows = odd_records(spark)
    hits = spark.createDataFrame([(1, 5), (2, 5), (2, 11)], "query_id long, id long")
    found = lexical.named(rows, hits)
    assert shuffled(found.select("id")) <= rows.count()  # rows come repartitioned
    assert sorted(r["id"] for r in found.collect()) == [5, 11]
    monkeypatch.setattr(lexical, "FEW", 1)
    assert sorted(r["id"] for r in lexical.named(rows, hits).collect()) == [5, 11]
