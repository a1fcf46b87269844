"""Secrets, fingerprints, mixing and token counts."""

from __future__ import annotations

import hashlib
import random
import re
import string
from itertools import groupby

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.llm import merkle, mixing, secrets, tokens
from millrace.llm.common import documents

from .conftest import CLASH, rows_of

RULES = (
    ("assign", re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)
RANDOM = "q7Rk2LpZ0vXw9TbN4sYd8HfJ1mCg"
SECRETS = [
    (1, "ö token token: token: abcdefgh, Secret='" + "a1" * 15 + "' x"),
    (2, "password=short pass PASSWD = longenough api_key:" + "AKIA" + "Z9" * 10),
    (3, "AKIAAKIA0000 AKIA" + "Q" * 16 + " " + "0f" * 12 + "g" + "f" * 23),
    (4, None),
    (5, ""),
    (6, f"plain prose and a key {RANDOM} in it, thenonouninganderedlesstation too"),
    (7, "token=" + "x" * 100_000),
    (7, "token=" + "x" * 100_000),
    (None, "secret: hunter22"),
]


def test_secrets(spark):
    df = spark.createDataFrame(rows_of(SECRETS), CLASH)
    ratios = secrets.train(documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))
    found = secrets.find_secrets(documents(df), ratios).select("doc_id", secrets.listed(F.col("base")).alias("base"), secrets.listed(F.col("spans")).alias("spans"), secrets.redacted(F.col("text"), F.col("spans")).alias("clean")).collect()
    got = {r["doc_id"]: r for r in found}
    for doc_id, text in dict(SECRETS).items():
        spans = sorted((m.start(), i, m.end(), kind) for i, (kind, rule, group, least) in enumerate(RULES) for m in rule.finditer(text or "") if len(m.group(group)) >= least)
        row = got[-(2**63) if doc_id is None else doc_id]
        assert row["base"] == ",".join(f"{k}:{a}:{e}" for a, _, e, k in spans)
    at = SECRETS[5][1].index(RANDOM)
    assert got[6]["spans"] == f"markov:{at}:{at + len(RANDOM)}"
    assert got[6]["clean"] == SECRETS[5][1].replace(RANDOM, "[SECRET]")
    assert "hunter22" not in got[-(2**63)]["clean"] and got[7]["clean"] == "[SECRET]"


def test_runs_around_fixed_matches(spark):
    """A longer secret with a hex match inside goes as a whole."""
    run = RANDOM + "0f3a" * 6 + RANDOM
    df = spark.createDataFrame([(1, f"a key {run} here")], "doc_id long, text string")
    ratios = secrets.train(documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))
    row = secrets.find_secrets(documents(df), ratios).select(secrets.listed(F.col("spans")).alias("spans"), secrets.redacted(F.col("text"), F.col("spans")).alias("clean")).first()
    assert row["spans"].startswith("markov:6:") and "hex:" in row["spans"] and row["clean"] == "a key [SECRET] here"


def test_markov_recall_and_precision(spark):
    """Planted random strings outside the fixed patterns are found; identifiers made of the corpus's words, numbers and rules of signs are not."""
    docs = documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    ratios = secrets.train(docs)
    rng = random.Random(5)
    words = [w for (t,) in docs.select("text").limit(200).collect() for w in t.split() if w.isascii() and w.isalpha() and len(w) > 3]
    alphabets = {"base62": string.ascii_letters + string.digits, "base64": string.ascii_letters + string.digits + "+/", "lower36": string.ascii_lowercase + string.digits, "upper36": string.ascii_uppercase + string.digits}
    planted = [(name, n, "".join(rng.choice(a) for _ in range(n))) for name, a in alphabets.items() for n in (12, 16, 19, 24) for _ in range(100)]
    ordinary = [sign.join(rng.sample(words, 3)) for sign in ("_", "-", "/") for _ in range(300)] + [f"{rng.randrange(10**16):016d}" for _ in range(100)] + ["2024-01-15T10-30-00", "-" * 40, "=" * 40, "_" * 12]
    rows = [(i, f"see {t} here") for i, t in enumerate([t for *_, t in planted] + ordinary)]
    found = {r[0] for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"), ratios).where("size(spans) > 0").select("doc_id").collect()}
    for name in alphabets:
        mine = [i for i, (k, n, _) in enumerate(planted) if k == name and n >= 16]
        assert len(found & set(mine)) >= 0.97 * len(mine)
    assert len(found & set(range(len(planted)))) >= 0.95 * len(planted)
    assert len([i for i in found if i >= len(planted)]) <= 0.01 * len(ordinary)
    whole = secrets.find_secrets(docs, ratios).select(F.sum(F.size("spans") - F.size("base"))).first()[0]
    assert whole == 0  # the given table has no such string


def test_secret_columns(spark):
    """What the query returns of the fixed patterns, for every document of a given table."""
    out = {r["doc_id"]: r for r in secrets.op2_secrets(spark, "/root/testdata/sf0.01").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    assert len(out) == len(rows)
    for doc_id, text in rows:
        spans = sorted((m.start(), i, m.end(), kind) for i, (kind, rule, group, least) in enumerate(RULES) for m in rule.finditer(text or "") if len(m.group(group)) >= least)
        row = out[doc_id]
        assert [row["n_assign"], row["n_access"], row["n_hex"]] == [sum(s[1] == i for s in spans) for i in range(3)]
        assert row["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{e}" for a, _, e, k in spans).encode()).hexdigest()


def test_many_spans(spark):
    """Texts of thousands of matches of all kinds, redacted as a loop over the spans would."""
    docs = documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    ratios, rng = secrets.train(docs), random.Random(6)
    parts = ["ö", "plain ", "token=", "secret: ", "AKIA" + "Q9" * 10, " ", "\n", "𝄞", RANDOM, "password='hunter22'"]
    texts = ["".join(rng.choice([*parts, f"{rng.getrandbits(128):032x}"]) for _ in range(rng.randrange(500))) for _ in range(60)]
    texts += [" ".join(f"{rng.getrandbits(128):032x}" for _ in range(5000)), "token=" + "x" * 1_000_000, "𝄞" * 4096 + " " + RANDOM + " " + "é" * 4096]
    rows = secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ratios).select("doc_id", "spans", secrets.redacted(F.col("text"), F.col("spans")).alias("clean")).collect()
    for r in rows:
        text, at, out = texts[r["doc_id"]], 0, ""
        for s in r["spans"]:
            if s["start"] >= at:
                out += text[at : s["start"]] + "[SECRET]"
            at = max(at, s["end"])
        assert r["clean"] == out + text[at:]
    assert max(len(r["spans"]) for r in rows) == 5000


def test_secrets_of_nothing(nothing):
    assert secrets.find_secrets(documents(nothing)).count() == 0


def test_fingerprints(odd, as_documents, nothing):
    out = {r["doc_id"]: r for r in merkle.fingerprints(odd).collect()}
    ring = as_documents[::-1]
    assert set(out) == {d for d, _ in ring}
    for (doc_id, text), (_, after) in zip(ring, ring[1:] + ring[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert out[doc_id]["edited_text"] == edited
    prints = {}
    for doc_id, text in ring:
        assert prints.setdefault(text, out[doc_id]["fingerprint"]) == out[doc_id]["fingerprint"]
    assert len(set(prints.values())) == len(prints)
    assert out[10]["near_edited"] > 0.4 > out[10]["near_next"]
    assert merkle.fingerprints(nothing).count() == 0


def test_many_runs_of_ids(spark, monkeypatch):
    """Ids in many windows, unevenly spread: every document meets its next once."""
    monkeypatch.setattr(merkle, "RUN", 3)
    ids = [*range(40), *range(10_000, 10_011), -7]
    df = spark.createDataFrame([(i, f"text {i}.\nmore {i}") for i in ids], "doc_id long, text string")
    ring = sorted(ids, reverse=True)
    got = {r["doc_id"]: r["next_text"] for r in merkle.with_next(df).collect()}
    assert got == {a: f"text {b}.\nmore {b}" for a, b in zip(ring, ring[1:] + ring[:1])}


def test_fingerprints_against_sql(spark):
    docs = "/root/testdata/sf0.01"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{docs}/documents.parquet'")
    expected = duckdb.sql(merkle.OP6_SQL)
    out = merkle.op6_merkle_fingerprints(spark, docs)
    assert out.columns == expected.columns
    rows = {r[0]: tuple(r) for r in out.collect()}
    assert rows == {r[0]: r for r in expected.fetchall()}
    assert max(len(r[3]) for r in rows.values()) <= 64 + 4 + merkle.MOST * merkle.DIGITS


def test_tree_locates_edits(spark):
    """The leaves named are the edited ones, and fingerprints stay small and alike for long texts, also without punctuation."""
    rng = random.Random(9)
    cases = []
    for n in (3, 40, 900, 30_000):
        for stop in (". ", " ", ""):
            words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            at = rng.randrange(n)
            cases.append((stop.join(words), stop.join([*words[:at], "other", *words[at + 1 :]])))
    cases += [("", ""), ("", "a"), ("same", "same"), ("line\n" * 5000, "line\n" * 5001)]
    a, b = F.col("a"), F.col("b")
    cut = spark.createDataFrame(cases, "a string, b string").select("a", "b", merkle.leaves(a).alias("la"), merkle.leaves(b).alias("lb"), merkle.edit_range(merkle.labels(a), merkle.labels(b)).alias("edit"), merkle.fingerprint(merkle.labels(a)).alias("fa"), merkle.fingerprint(merkle.labels(b)).alias("fb"))
    for r in cut.select("*", merkle.likeness(F.col("fa"), F.col("fb")).alias("near")).collect():
        assert "".join(r["la"]) == r["a"] and all(len(x) <= merkle.PIECE for x in r["la"])
        front = next((i for i, (x, y) in enumerate(zip(r["la"], r["lb"])) if x != y), min(len(r["la"]), len(r["lb"])))
        assert r["edit"]["first"] == front
        after = len(r["la"]) - r["edit"]["end"]
        assert after == 0 or r["la"][r["edit"]["end"] :] == r["lb"][-after:]
        assert len(r["fa"]) <= 64 + 4 + merkle.MOST * merkle.DIGITS
        assert (r["near"] == 1) == (r["a"] == r["b"]) or len(set(r["la"])) == 1
        if len(set(r["la"])) > 100:
            assert r["near"] > 0.8
            assert r["edit"]["end"] - r["edit"]["first"] < 0.1 * len(r["la"])


def test_mix_limits(spark, odd, nothing):
    sources = ["a"] * 9 + [None, "b", "big", "", None]
    texts = [(i, "w " * (3 * i)) for i in range(11)] + [(11, "w " * 5000), (12, ""), (13, None)]
    df = spark.createDataFrame(rows_of(texts, sources), CLASH)
    rows = mixing.mix(df).collect()
    assert len(rows) == len(texts)
    total = sum(r["size"] for r in rows)
    for source, group in groupby(sorted(rows, key=lambda r: (r["source"] is None, r["source"] or "")), key=lambda r: r["source"]):
        group = list(group)
        taken, size = sum(r["taken"] for r in group), sum(r["size"] for r in group)
        assert abs(taken - group[0]["target"]) <= 0.5 + 1e-6 and group[0]["target"] <= 3 * size + 1e-6
        assert all(r["taken"] <= 3 * r["size"] and len(r["positions"]) == -(-r["taken"] // r["size"] if r["size"] else 0) for r in group)
    assert abs(sum({r["source"]: r["target"] for r in rows}.values()) - total) < 1e-6 * total
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(nothing).count() == 0
    positions = [r["position"] for r in mixing.schedule(mixing.mix(df)).collect()]
    assert positions == sorted(positions) and all(0 <= p <= total for p in positions)


def test_mix_against_sql(spark, small):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    expected = {r[0]: r[1:] for r in duckdb.sql(mixing.OP7_SQL).fetchall()}
    out = mixing.op7_mixing(spark, small)
    names = duckdb.sql(mixing.OP7_SQL).columns
    assert {r["doc_id"]: tuple(r[c] for c in names[1:]) for r in out.collect()} == expected


def test_tokens(odd, as_documents, nothing):
    encoder = tokens.Encoder(f"{tokens.tokenizer_dir()}/{tokens.VOCABULARY}")
    out = {r["doc_id"]: r for r in tokens.token_counts(odd).collect()}
    for doc_id, text in as_documents:
        row = out[doc_id]
        ids = encoder.encoding.encode_ordinary(text)
        assert encoder.encoding.decode(ids) == text
        assert row["n_tokens"] == len(ids) == sum(row["section_tokens"])
        assert row["n_sections"] == len(row["section_tokens"])
    assert tokens.token_counts(nothing).count() == 0


def test_very_long_runs(spark, monkeypatch):
    """Texts that are one long run of blanks, letters or line breaks; and the cuts give the tokens of the whole."""
    encoder = tokens.Encoder(f"{tokens.tokenizer_dir()}/{tokens.VOCABULARY}")
    runs = [(i, c * 5_000_000) for i, c in enumerate((" ", "a", "\n", "\u3000"))] + [(9, "x" + " " * 3_000_000 + "y")]
    out = {r["doc_id"]: r for r in tokens.token_counts(spark.createDataFrame(runs, "doc_id long, text string")).collect()}
    assert len(out) == 5 and all(r["n_tokens"] == sum(r["section_tokens"]) > 10_000 for r in out.values())
    rng = random.Random(2)
    monkeypatch.setattr(tokens, "PIECE", 200)
    monkeypatch.setattr(tokens, "RUN", 3)
    monkeypatch.setattr(tokens, "LONG_RUN", re.compile(rf"[{tokens.BLANK}]{{3,}}"))
    for _ in range(300):
        text = "".join(rng.choice([" ", "  ", "\n", "a", "bc", "12", "!?", "\u3000", "é", "\x1c", "'s", " \n "]) for _ in range(rng.randrange(1500)))
        assert encoder.ids(text).tolist() == encoder.encoding.encode_ordinary(text)


@pytest.mark.parametrize("text", ["One. Two is här!\nThree? four", "é. ü.\n\nß! x", "no end", "a.\n"])
def test_attribution_rule(text):
    """Each token goes to the section with most of its characters, the earlier one of two."""
    import numpy as np

    encoder = tokens.Encoder(f"{tokens.tokenizer_dir()}/{tokens.VOCABULARY}")
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    starts = tokens.sections(data)
    first, end = encoder.spans(text, data)
    counts, crossing = tokens.attribute(first, end, starts)
    borders = [*starts.tolist(), len(text)]
    expected, crossed = [0] * len(starts), 0
    for a, b in zip(first.tolist(), end.tolist()):
        held = [len(set(range(a, b)) & set(range(borders[k], borders[k + 1]))) for k in range(len(starts))]
        expected[held.index(max(held))] += 1
        crossed += sum(h > 0 for h in held) > 1
    assert counts.tolist() == expected and crossing == crossed
    assert hashlib.sha256(text.encode()).hexdigest() == hashlib.sha256(data.tobytes()).hexdigest()
