"""DartMinHash near-duplicates and containment search against all pairs."""

from __future__ import annotations

import random
from collections import Counter

import duckdb
import numpy as np

from millrace.llm import containment, dartminhash

from .conftest import CLASH, prose, rows_of


def weighted(text):
    w = text.split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def components(docs):
    sets = {d: weighted(t) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = list(sets)
    order = {d: i for i, d in enumerate(ids)}
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = sum((sets[a] & sets[b]).values())
            whole = sum(sets[a].values()) + sum(sets[b].values()) - both
            if whole and both / whole >= 0.8:
                x, y = sorted((find(a), find(b)), key=order.get)
                parent[y] = x
    return {d: find(d) for d in ids}


def test_odd(odd, as_documents):
    assert {r["doc_id"]: r["class_id"] for r in dartminhash.near_duplicates(odd).collect()} == components(as_documents)


def test_chains_and_groups(spark):
    """Near copies of a base, near copies of those, and unrelated texts that share half."""
    rng = random.Random(3)
    docs = []
    for g in range(6):
        words = prose(g, 200).split()
        for c in range(12):
            copy = list(words)
            for _ in range(rng.choice([0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(10**6)}"
            docs.append((g * 100 + c, " ".join(copy)))
            words = copy if c % 3 == 2 else words
        docs.append((g * 100 + 50, " ".join(words[:100]) + " " + prose(900 + g, 100)))
    df = spark.createDataFrame(rows_of(docs), CLASH)
    assert {r["doc_id"]: r["class_id"] for r in dartminhash.near_duplicates(df).collect()} == components(sorted(docs))


def test_pairs_of_a_family(spark, monkeypatch):
    """Pairs of near copies in a family of similar texts: most buckets hold nearly all, and few pairs meet a leader."""
    monkeypatch.setattr(dartminhash, "BLOCK", 50)
    rng = random.Random(8)

    def edited(words, places):
        out = list(words)
        for i in places:
            out[i] = f"w{rng.randrange(10**9)}"
        return out

    template, docs = prose(70, 1000).split(), []
    for pair in range(60):
        base = edited(template, rng.sample(range(1000), 6))
        docs += [(2 * pair + c, " ".join(edited(base, rng.sample(range(1000), 9)))) for c in range(2)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    expected = components(docs)
    assert len(set(expected.values())) > 30
    assert {r["doc_id"]: r["class_id"] for r in dartminhash.near_duplicates(df).collect()} == expected


def test_against_sql(spark):
    """Every document of a given table, against all pairs in SQL; once more with sets of two documents taken for hot ones."""
    docs = "/root/testdata/sf0.01"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{docs}/documents.parquet'")
    expected = {r[0]: r[1] for r in duckdb.sql(dartminhash.OP4_SQL).fetchall()}
    assert {r["doc_id"]: r["class_id"] for r in dartminhash.op4_dartminhash(spark, docs).collect()} == expected
    assert sum(d != c for d, c in expected.items()) > 50


def test_sets_of_many_documents(spark):
    copies = [(i, f"all the same words as {i % 2}" if i % 5 else f"none but {i}") for i in range(6000)]
    out = {r["doc_id"]: r["class_id"] for r in dartminhash.near_duplicates(spark.createDataFrame(copies, "doc_id long, text string")).collect()}
    assert out == {i: (i if i % 5 == 0 else 2 - i % 2) for i in range(6000)}


def test_empty(nothing, spark):
    assert dartminhash.near_duplicates(nothing).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert containment.contained(nothing, items).count() == 0


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    element = rng.integers(1, 2**63, 300, dtype=np.uint64)
    a, b = rng.integers(1, 6, 300), rng.integers(1, 6, 300)
    k = 4000
    same = (dartminhash.signature(element, a, k) == dartminhash.signature(element, b, k)).mean()
    assert abs(same - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def test_contained(spark, odd, odd_texts, as_documents):
    long_text = dict(as_documents)[10].split()
    items = [(1, " ".join(long_text[5000:5060])), (2, " ".join(long_text[20_000:20_012])), (3, prose(77, 40)), (4, None), (5, ""), (6, "one two"), (7, " ".join(long_text[100:120]) + " " + prose(78, 100)), (8, prose(1, 120)), (8, prose(79, 12))]
    out = {(r["doc_id"], r["item_id"]): r["containment"] for r in containment.contained(odd, spark.createDataFrame(items, "item_id long, text string"), block=3).collect()}
    expected = {}
    for doc_id, text in as_documents:
        for item_id, item in items:
            w, d = (item or "").split(), text.split()
            n = min(5, len(w))
            if n:
                need = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
                have = {tuple(d[i : i + n]) for i in range(len(d) - n + 1)}
                share = len(need & have) / len(need)
                if share >= 0.8:
                    expected[doc_id, item_id] = max(share, expected.get((doc_id, item_id), 0))
    assert out == expected and (10, 1) in out and (10, 2) in out
    kept = {r["doc_id"] for r in containment.without_contaminated(odd, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert kept == {d for d, _ in odd_texts} - {d for d, _ in expected}
