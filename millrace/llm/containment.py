"""Benchmark decontamination: short test items found inside long documents.

Containment of an item in a document is the share of the item's shingles that
the document has. MinHash values estimate Jaccard similarity, which a long
document makes tiny, so both sides are partitioned by size: a document of a
size class is hashed by one permutation into bins in proportion to the class's
upper size over the *load* of the item's size class, and an item into the same
bins. The lowest hash of a bin is its MinHash value; an item is a candidate if
any of its bins agrees with the document's. The load is set so that an item at
the threshold misses with a chance below 1 in 10,000; items of fewer than eight
shingles get a bin for every hash, which misses nothing. Candidates are verified
by exact containment.

Items are met in blocks of bounded size: each block's index goes to all tasks,
and one pass over the documents answers it, with no shuffle of texts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import Rolling
from .common import documents, given_ids, table
from .repeats import texts_of, word_hashes

SHINGLE = 5
CONTAINMENT = 0.8
#: Items of one block, about; a block's index is broadcast.
BLOCK = 20_000
#: (least shingles of an item, shingles per bin of a document); below the first, every hash is a bin.
LOADS = ((8, 0.5), (16, 1.0), (32, 2.0))


def _shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of `size` words."""
    return np.unique(Rolling(words).grams(size)) if len(words) >= size else np.zeros(0, np.uint64)


def bin_minima(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Least hash of each bin; a bin is the hashes' first `bits` bits, so sorted hashes are sorted by bin."""
    if bits >= 64 or not len(hashes):
        return hashes
    at = hashes >> np.uint64(64 - bits)
    return hashes[np.concatenate(([True], at[1:] != at[:-1]))]


def bin_bits(size: int, load: float) -> int:
    """Bits of the bins for documents of the size class of `size`: its upper size over the load."""
    return max(1, int(np.ceil(np.log2((1 << int(size).bit_length()) / load))))


class Items:
    """Index of one block: shingle sets by item and, per size class and bins, items by MinHash value."""

    def __init__(self, rows: list[tuple[int, str]], shingle: int):
        self.sets: list[np.ndarray] = []
        self.ids: list[int] = []
        self.classes: dict[tuple[int, float], list[int]] = defaultdict(list)
        self.made: dict[tuple[int, float, int], tuple[np.ndarray, np.ndarray]] = {}
        for item_id, text in rows:
            words = word_hashes(np.frombuffer(text.encode(), dtype=np.uint8))
            size = min(shingle, len(words))
            if not size:
                continue
            held = _shingles(words, size)
            load = max((l for n, l in LOADS if len(held) >= n), default=0.0)
            self.classes[size, load].append(len(self.sets))
            self.sets.append(held)
            self.ids.append(item_id)

    def index(self, size: int, load: float, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(values, items), sorted by value."""
        if (size, load, bits) not in self.made:
            parts = [(bin_minima(self.sets[i], bits), i) for i in self.classes[size, load]]
            values = np.concatenate([v for v, _ in parts])
            owner = np.concatenate([np.full(len(v), i) for v, i in parts])
            order = np.argsort(values, kind="stable")
            self.made[size, load, bits] = values[order], owner[order]
        return self.made[size, load, bits]

    def search(self, words: np.ndarray, least: float) -> dict[int, float]:
        """Containment of each item that the document contains to the threshold."""
        found: dict[int, float] = {}
        sets: dict[int, np.ndarray] = {}
        for size, load in self.classes:
            if size not in sets:
                sets[size] = _shingles(words, size)
            whole = sets[size]
            if not len(whole):
                continue
            bits = bin_bits(len(whole), load) if load else 64
            values, owner = self.index(size, load, bits)
            own = bin_minima(whole, bits)
            at = np.searchsorted(own, values)
            hit = own[np.minimum(at, len(own) - 1)] == values if len(values) < len(own) else np.isin(values, own)
            for i in np.unique(owner[hit]).tolist():
                item = self.sets[i]
                share = int(np.isin(item, whole, assume_unique=True).sum()) / len(item)
                if share >= least:
                    found[self.ids[i]] = max(share, found.get(self.ids[i], 0.0))
        return found


def _blocks(spark: SparkSession, items: DataFrame, block: int) -> Iterator[Broadcast]:
    """Broadcasts of [(item_id, text)], about `block` items each; one at least."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = max(1, -(-rows.count() // block))
    for b in range(blocks):
        held = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        yield spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in held])


def contained(df: DataFrame, items: DataFrame, least: float = CONTAINMENT, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, containment) of every item contained in a document to at least `least`.

    Null and empty texts of either side have no shingle and match nothing. An
    item of fewer words than a shingle is one shingle of its own length. Of rows
    that repeat an item_id, the best match counts; a null item_id stays null.
    Repeated documents and null ids: see `common`. Either table may be empty.
    """
    rows = documents(df)
    docs = rows.select("doc_id", "text")
    parts = []
    for shared in _blocks(docs.sparkSession, items, block):

        def search(batches, shared=shared):
            index = Items(shared.value, shingle)
            for batch in batches:
                hits = [(d, i, c) for d, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True) for i, c in index.search(word_hashes(text), least).items()]
                yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in hits], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["doc_id", "item_id", "containment"])

        parts.append(docs.mapInArrow(search, "doc_id long, item_id long, containment double"))
    return given_ids(reduce(DataFrame.union, parts), rows)


def without_contaminated(df: DataFrame, items: DataFrame, least: float = CONTAINMENT, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """The rows of df, with all their columns, that contain no item; judged row by row, without a shuffle."""
    at = df.columns.index("text")
    for shared in _blocks(df.sparkSession, items, block):

        def keep(batches, shared=shared):
            index = Items(shared.value, shingle)
            for batch in batches:
                yield batch.filter(pa.array([not index.search(word_hashes(t), least) for t in texts_of(batch.column(at))], pa.bool_()))

        df = df.mapInArrow(keep, df.schema)
    return df


def op5_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM d, unnest(range(1, len(w) - 3)) AS t(i)),
b AS (SELECT item_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM b, unnest(range(1, len(w) - 3)) AS t(i)),
n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id)
SELECT doc_id, bs.item_id, count(*)::DOUBLE / any_value(n.n) AS containment
FROM bs JOIN ds USING (s) JOIN n ON n.item_id = bs.item_id
GROUP BY doc_id, bs.item_id HAVING count(*)::DOUBLE / any_value(n.n) >= 0.8
"""
