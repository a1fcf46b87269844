"""Bounded labelled samples for the classifiers, and byte features they share."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .anchors import Rolling
from .repeats import word_hashes


def crc_fold(doc_id: Column | str = "doc_id", folds: int = 4) -> Column:
    """crc32 of the id written as text, modulo `folds`; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")), F.lit(folds))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, where: Column) -> tuple[list[tuple[int, str, int]], dict[int, int]]:
    """([(doc_id, text, label)] of at most `per_class` documents of each of the labels 0 and 1, counts of all labelled rows).

    The documents with the lowest hashes of their ids are taken, so the sample is
    the same in every run and blind to everything but the id. Rows without an id
    or a label, and ids with both labels, are left out.
    """
    clean = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & where)
    clean = clean.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").select("doc_id", "label")
    counts = {r["label"]: r["count"] for r in clean.groupBy("label").count().collect()}
    parts = [clean.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for v in (0, 1)]
    ids = reduce(DataFrame.union, parts)
    # 2 * per_class rows at most
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "text", "label").collect()
    return sorted((r["doc_id"], r["text"], r["label"]) for r in rows), counts


def grams(text: np.ndarray, sizes: tuple[int, ...]) -> np.ndarray:
    """Hashes of a text's words and of its substrings of some sizes, repeats included."""
    parts = [word_hashes(text)]
    if len(text) >= min(sizes):
        rolling = Rolling(text)
        parts += [rolling.grams(k) for k in sizes if len(text) >= k]
    return np.concatenate(parts)


def letter_runs(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of letters; bytes beyond ASCII count as letters."""
    letter = (text >= 0x80) | ((text >= 0x61) & (text <= 0x7A)) | ((text >= 0x41) & (text <= 0x5A))
    step = np.diff(np.concatenate(([False], letter, [False])).astype(np.int8))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def utf8(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), dtype=np.uint8)


def lowered(text: np.ndarray) -> np.ndarray:
    """ASCII letters in lower case."""
    return np.where((text >= 0x41) & (text <= 0x5A), text | 0x20, text).astype(np.uint8)
