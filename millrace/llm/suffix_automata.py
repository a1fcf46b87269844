"""Substring dedup of words by suffix automata and matching statistics.

`against` is the plain form: a bounded reference table is cut into shards, each
shard's automaton is broadcast, and documents stream through it for their
matching statistics, the longest match that ends at each word. Removed are the
maximal spans of matches of `length` words or more.

A corpus against itself would be as many shards as the corpus is long, each met
by every document: work that grows with its square (figures in the README). So
`dedup_words` lets the reference shards hold only what can match at all:
passages that share a gram of words with another, dealt to shards by that gram
(`repeats.found`), and only those passages stream through their shard, in
document order, so that what is in the automaton is earlier. A window lies in
passages of one gram only, so grams may share an automaton.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, given_ids, table, written
from .repeats import FOUND, covered, first_of, found, texts_of, with_runs, word_spans, words_of

LENGTH = 20
GRAM = 6
#: Passages of one gram that an automaton may hold; grams with more go by single windows.
HOT = 2_000
#: Words after which a shard ends, at the next gram, and words of a broadcast shard.
SHARD = 20_000


class Automaton:
    """Suffix automaton of several sequences: every path from state 0 is a substring of one."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _split(self, p: int, q: int, c: int) -> int:
        """A copy of q for the paths that end with p's and c."""
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def add(self, sequence: list[int]) -> None:
        last = 0
        for c in sequence:
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
                continue
            new = len(self.next)
            self.next.append({})
            self.link.append(0)
            self.length.append(self.length[last] + 1)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
            last = new

    def matches(self, sequence: list[int]) -> list[int]:
        """Length of the longest substring of the automaton that ends at each symbol."""
        out, state, n = [], 0, 0
        for c in sequence:
            while state and c not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                n += 1
            out.append(n)
        return out


class Shard:
    """An automaton over words as bytes, so that no two words are taken for one."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.automaton = Automaton()
        self.words = 0

    def add(self, words: list[bytes]) -> None:
        number = self.number
        self.automaton.add([number.setdefault(w, len(number)) for w in words])
        self.words += len(words)

    def windows(self, words: list[bytes], length: int) -> list[tuple[int, int]]:
        """Runs (first, last) of the windows of `length` words that the shard holds."""
        runs: list[tuple[int, int]] = []
        number = self.number
        for i, n in enumerate(self.automaton.matches([number.get(w, -1) for w in words])):
            if n >= length:
                at = i - length + 1
                if runs and runs[-1][1] == at - 1:
                    runs[-1] = runs[-1][0], at
                else:
                    runs.append((at, at))
        return runs


def _found_batch(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["doc_id", "first", "last"])


def automaton_shards(length: int, shard: int = SHARD):
    def compare(contexts: DataFrame) -> DataFrame:
        def rows(batches):
            key_now, held = None, Shard()
            for batch in batches:
                out = []
                place = batch.column(2).to_numpy()
                for key, doc_id, start, passage in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), first_of(place).tolist(), texts_of(batch.column(3)), strict=True):
                    words = passage.tobytes().split(b" ")
                    if key != key_now:
                        key_now = key
                        if held.words >= shard:
                            held = Shard()
                    else:
                        out += [(doc_id, start + a, start + b) for a, b in held.windows(words, length)]
                    held.add(words)
                yield _found_batch(out)

        return contexts.repartition("key").sortWithinPartitions("key", "doc_id", "place").mapInArrow(rows, FOUND)

    return compare


def against(docs: DataFrame, reference: DataFrame, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """(doc_id, first, last): runs of word windows of `docs` that a text of `reference` holds.

    reference has a text, and is meant to be small: one pass over docs for every
    `shard` words of it. A shard's texts come to the driver, its automaton is
    broadcast; a text longer than a shard is cut where pieces overlap by length - 1
    words, so no window is lost. Ids and odd rows: as `common.documents` has it.
    """
    rows = documents(docs)
    pieces: DataFrame = reference.select("text").mapInArrow(_pieces(length, shard), "piece binary, words long")
    part = F.floor((F.sum("words").over(Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, 0)) - 1) / shard).alias("shard")
    dealt = written(pieces.distinct().select("piece", part), "shards")
    parts = []
    for row in dealt.select("shard").distinct().orderBy("shard").toLocalIterator():
        held = Shard()
        for piece in dealt.where(F.col("shard") == row["shard"]).collect():  # `shard` words and one piece at most
            held.add(bytes(piece["piece"]).split(b" "))
        shared = rows.sparkSession.sparkContext.broadcast(held)

        def stream(batches, shared=shared):
            for batch in batches:
                out = []
                for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                    whole = words_of(text)
                    n = len(whole.symbols)
                    words = whole.cuts(np.arange(n), np.arange(1, n + 1))
                    out += [(doc_id, a, b) for a, b in shared.value.windows(words, length)]
                yield _found_batch(out)

        parts.append(rows.select("doc_id", "text").mapInArrow(stream, FOUND))
    none = rows.select("doc_id", F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("last")).where(F.lit(False))
    return given_ids(reduce(DataFrame.union, parts, none), rows)


def _pieces(length: int, shard: int):
    def rows(batches):
        for batch in batches:
            out = []
            for text in texts_of(batch.column(0).cast(pa.string()).fill_null("")):
                whole = words_of(text)
                n = len(whole.symbols)
                first = np.arange(0, max(n - length + 1, 0), shard)
                out += [(p, int(b - a)) for p, a, b in zip(whole.cuts(first, np.minimum(first + shard + length - 1, n)), first, np.minimum(first + shard + length - 1, n), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.binary()), pa.array([w for _, w in out], pa.int64())], ["piece", "words"])

    return rows


def repeated_words(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, first, last): runs of word windows of `docs` that start earlier elsewhere."""
    return found(docs, words_of, length, gram, hot, automaton_shards(length))


def dedup_words(df: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """One row per document: (doc_id, n_words, n_removed, kept_sha256).

    Every word covered by a window of `length` words that starts earlier is
    removed. Null, empty and blank texts have no words; texts of fewer words
    than `length` keep all. Repeated rows and null ids: see `common`. An empty
    table gives an empty result.
    """

    def judge(text, first, last):
        starts, ends = word_spans(text)
        gone = covered(len(starts), first, last, length)
        data, digest = text.tobytes(), hashlib.sha256()
        kept = np.flatnonzero(~gone)
        digest.update(b" ".join([data[a:b] for a, b in zip(starts[kept].tolist(), ends[kept].tolist(), strict=True)]))
        return len(starts), int(gone.sum()), digest.hexdigest()

    docs = documents(df)
    out = with_runs(docs, repeated_words(docs, length, gram, hot), judge, "n_words long, n_removed long, kept_sha256 string")
    return given_ids(out, docs)


def op10_suffix_automata_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_words(table(spark, sf_dir, "documents"))


#: Windows by their texts (words hold no blank), each with its first place; words that a later place of one covers.
OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM d, unnest(range(1, len(w) - 18)) AS t(i)),
again AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM again, range(0, 20) AS t(k)),
kept AS (SELECT doc_id, string_agg(w[i], ' ' ORDER BY i) AS text FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
