"""Both substring dedups against a set of all windows seen so far."""

from __future__ import annotations

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import suffix_array, suffix_automata
from millrace.llm.anchors import anchors
from millrace.llm.repeats import word_hashes

from .conftest import prose, rows_of, CLASH

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def gone(sequences, length):
    seen, out = set(), {}
    for doc_id, s in sequences:
        mask = bytearray(len(s))
        for i in range(len(s) - length + 1):
            window = bytes(s[i : i + length]) if isinstance(s, bytes) else tuple(s[i : i + length])
            if window in seen:
                mask[i : i + length] = b"\1" * length
            seen.add(window)
        out[doc_id] = mask
    return out


def expected_bytes(docs):
    rows = [(d, t.encode()) for d, t in docs]
    mask = gone(rows, 100)
    return {d: (len(s), sum(mask[d]), len(re.findall(b"\1+", bytes(mask[d]))), hashlib.sha256(bytes(x for x, g in zip(s, mask[d]) if not g)).hexdigest()) for d, s in rows}


def expected_words(docs):
    rows = [(d, WORD.findall(t)) for d, t in docs]
    mask = gone(rows, 20)
    return {d: (len(s), sum(mask[d]), hashlib.sha256(" ".join(w for w, g in zip(s, mask[d]) if not g).encode()).hexdigest()) for d, s in rows}


@pytest.mark.parametrize("hot", [1, 50_000])
def test_bytes_odd(odd, as_documents, hot):
    out = {r[0]: tuple(r[1:]) for r in suffix_array.dedup_bytes(odd, hot=hot).collect()}
    assert out == expected_bytes(as_documents)


@pytest.mark.parametrize("hot", [1, 50_000])
def test_words_odd(odd, as_documents, hot):
    out = {r[0]: tuple(r[1:]) for r in suffix_automata.dedup_words(odd, hot=hot).collect()}
    assert out == expected_words(as_documents)


def test_mixed_passages(spark):
    """Passages cut at many places and put between fresh prose, so that windows match only in part."""
    rng = random.Random(4)
    passages = [prose(100 + i, 60) for i in range(4)]
    docs = []
    for i in range(60):
        p = rng.choice(passages)
        at, end = sorted(rng.sample(range(len(p)), 2))
        docs.append((i * 7 % 60, prose(i, 30) + " " + p[at:end] + " " + prose(1000 + i, 15)))
    df = spark.createDataFrame(rows_of(docs), CLASH)
    docs.sort()
    assert {r[0]: tuple(r[1:]) for r in suffix_array.dedup_bytes(df).collect()} == expected_bytes(docs)
    assert {r[0]: tuple(r[1:]) for r in suffix_automata.dedup_words(df).collect()} == expected_words(docs)


def test_words_are_told_apart(spark):
    """Words whose polynomial hashes modulo 2^64 agree whatever the base, and words that differ in their last parts only."""
    morse = ["a" if bin(i).count("1") % 2 else "b" for i in range(1024)]
    one, other = "".join(morse), "".join("b" if c == "a" else "a" for c in morse)
    head = " ".join(f"w{i}" for i in range(19))
    docs = [(1, f"{head} {one}"), (2, f"{head} {other}"), (3, f"{head} {one[:900]}x"), (4, f"{head} {one[:900]}y"), (5, f"{head}\t{one}\n")]
    out = {r[0]: r["n_removed"] for r in suffix_automata.dedup_words(spark.createDataFrame(rows_of(docs), CLASH)).collect()}
    assert out == {1: 0, 2: 0, 3: 0, 4: 0, 5: 20}
    many = np.frombuffer(" ".join(["x" * k for k in range(1, 3000)] + ["x" * 2999 + "y"]).encode(), dtype=np.uint8)
    assert len(set(word_hashes(many).tolist())) == 3000


@pytest.mark.parametrize("sql, query", [(suffix_array.OP3_SQL, suffix_array.op3_suffix_array_dedup), (suffix_automata.OP10_SQL, suffix_automata.op10_suffix_automata_dedup)])
def test_against_sql(spark, sql, query):
    """Every document of a given table, against all windows in SQL."""
    docs = "/root/testdata/sf0.01"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{docs}/documents.parquet'")
    expected = duckdb.sql(sql)
    out = query(spark, docs)
    assert out.columns == expected.columns
    assert {r[0]: tuple(r) for r in out.collect()} == {r[0]: r for r in expected.fetchall()}


def test_against_a_reference(spark):
    """Broadcast automata of a reference table: all its windows, whatever the shards."""
    texts = [prose(i, 70) for i in range(8)]
    docs = [(i, prose(500 + i, 10) + " " + texts[i][20 * i : 20 * i + 250] + " \n" + texts[-1]) for i in range(6)] + [(7, None), (8, "")]
    reference = spark.createDataFrame([(t,) for t in [*texts, None, "", texts[0]]], "text string")
    known = {tuple(w[i : i + 20]) for t in texts for w in [t.split()] for i in range(len(w) - 19)}
    expected = {(d, i) for d, t in docs for w in [(t or "").split()] for i in range(len(w) - 19) if tuple(w[i : i + 20]) in known}
    for shard in (50, 10_000):
        runs = suffix_automata.against(spark.createDataFrame(rows_of(docs), CLASH), reference, shard=shard).collect()
        assert {(r["doc_id"], i) for r in runs for i in range(r["first"], r["last"] + 1)} == expected and expected
    assert suffix_automata.against(spark.createDataFrame(rows_of(docs), CLASH), reference.limit(0)).count() == 0


def test_empty_tables(nothing):
    assert suffix_array.dedup_bytes(nothing).count() == 0
    assert suffix_automata.dedup_words(nothing).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=120), st.integers(0, 40))
def test_anchors_partition_windows_by_content(symbols, shift):
    """Every window has one anchor, at the same relative place wherever the window stands."""
    length, gram = 12, 4
    s = np.array(symbols, dtype=np.uint8)
    moved = np.concatenate((np.arange(shift, dtype=np.uint8), s))
    owner = {}
    for sequence in (s, moved):
        _, first, last, at = anchors(sequence, length, gram)
        covered = [i for a, b in zip(first, last) for i in range(a, b + 1)]
        assert covered == list(range(max(0, len(sequence) - length + 1)))
        for a, b, p in zip(first, last, at):
            for i in range(a, b + 1):
                assert owner.setdefault(sequence[i : i + length].tobytes(), p - i) == p - i


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=12), max_size=5), st.lists(st.integers(0, 2), max_size=15))
def test_automaton_matching_statistics(sequences, text):
    automaton = suffix_automata.Automaton()
    for s in sequences:
        automaton.add(s)
    known = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for end, n in enumerate(automaton.matches(text), 1):
        assert n == max([0, *(k for k in range(1, end + 1) if tuple(text[end - k : end]) in known)])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.binary(min_size=10, max_size=10)), min_size=1, max_size=40))
def test_multikey_ties(rows):
    rows.sort(key=lambda x: x[0])
    group = np.array([g for g, _ in rows])
    data = np.array([list(x) for _, x in rows], dtype=np.uint8)
    seen, expected = set(), []
    for i, row in enumerate(rows):
        if row in seen:
            expected.append(i)
        seen.add(row)
    assert sorted(suffix_array.ties(group, data).tolist()) == expected
