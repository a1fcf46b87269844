from __future__ import annotations

import random

import pytest

WORDS = [f"{a}{b}" for a in ("th", "er", "on", "sta", "ou", "re") for b in ("ing", "ed", "le", "nt", "es", "ö", "a")]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + ("." if rng.random() < 0.1 else "") for _ in range(n))


#: What most tests put in besides doc_id and text: columns whose names the operators use inside.
CLASH = "doc_id long, text string, lang string, source string, n_chars long, size long, rank int, key long, bucket string, label int, rep long, hash string, place long, run int, leaves string"


def rows_of(texts, sources=None):
    out = []
    for i, (doc_id, text) in enumerate(texts):
        source = sources[i] if sources else f"s{i % 3}"
        out.append((doc_id, text, "en", source, len(text or ""), 1, 2, 3, "b", 4, 5, "h", 6, 7, "l"))
    return out


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty and blank texts, ties, repeated rows, a null id, and one very long text."""
    a, b = prose(1, 120), prose(2, 300)
    return [
        (1, a),
        (2, None),
        (3, ""),
        (4, " \n\t "),
        (5, a),
        (5, a),
        (6, b + "\n" + b),
        (7, prose(3, 20) + " " + b),
        (None, b[:400]),
        (8, "one two"),
        (9, "é" * 150 + " " + "é" * 150),
        (10, prose(4, 40_000)),
        (11, prose(5, 50) + " " + a[30:]),
        (12, "one two"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_texts):
    return spark.createDataFrame(rows_of(odd_texts), CLASH).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], CLASH)


@pytest.fixture(scope="session")
def as_documents(odd_texts):
    """What the operators take odd_texts for: one text per id, no nulls, the null id first."""
    seen = {}
    for doc_id, text in odd_texts:
        seen[doc_id] = min(seen.get(doc_id, text or ""), text or "")
    return sorted(seen.items(), key=lambda x: (x[0] is not None, x[0] or 0))
