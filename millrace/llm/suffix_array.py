"""Suffix-array dedup of byte strings.

The suffixes compared are those that start windows of `length` bytes; only
their first `length` bytes matter. `repeats.found` deals them out by sampled
splitters over what the suffixes at their anchors begin with (the first LEAD
bytes, then a hash of the gram), sorts each range and compares neighbours, across
partition borders too. What shares a gram but not its surroundings is dealt out
by the gram's bytes and sorted here, bucket by bucket, by multikey quicksort:
three-way partitions on eight bytes at a time, all segments of a bucket at once.
Windows that stay together to their end are equal, and all but the earliest are
repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, given_ids, table
from .repeats import FOUND, Sequence, bytes_of, count_of, covered, first_of, found, shift_of, texts_of, with_runs

LENGTH = 100
GRAM = 32
#: Candidates of one key that one task may hold; keys with more go by single windows.
HOT = 60_000
#: Candidates that are sorted together at least, if there are so many.
BUCKET = 20_000


#: Bytes of a suffix that lead its key.
LEAD = 3


def leading(whole: Sequence, at: np.ndarray) -> tuple[np.ndarray, int]:
    """The first LEAD bytes of the suffixes at some places, as a number in their order, and its bits."""
    head = np.zeros(len(at), dtype=np.uint64)
    for k in range(LEAD):
        head = head << np.uint64(8) | whole.data[at + k].astype(np.uint64)
    return head ^ np.uint64(1 << 8 * LEAD - 1), 8 * LEAD  # so that signed keys are in that order


def ties(group: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Indices of rows that equal an earlier row of their group, by multikey quicksort on 8-byte words.

    A segment holds rows of one group with the same words up to its depth. Each
    round parts every segment in three by its middle row's next word; the rows
    with that very word go one word deeper. Rows left alone are settled.
    """
    words = -(-rows.shape[1] // 8)
    padded = np.zeros((len(rows), words * 8), dtype=np.uint8)
    padded[:, : rows.shape[1]] = rows
    padded = padded.view(">u8").astype(np.uint64)
    order = np.arange(len(rows))
    new = np.concatenate(([True], group[1:] != group[:-1]))
    depth, equal = np.zeros(len(rows), dtype=np.int64), []
    while len(order):
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(order)))
        together = np.repeat(size > 1, size)
        order, depth, size = order[together], depth[together], size[size > 1]
        if not len(order):
            break
        start = np.cumsum(size) - size
        word = padded[order, depth]
        pivot = np.repeat(word[start + size // 2], size)
        part = (word > pivot).astype(np.int64) + (word >= pivot)  # 0 less, 1 equal, 2 greater
        segment = np.repeat(np.arange(len(size)), size) * 3 + part
        by = np.argsort(segment, kind="stable")  # equal rows stay in order
        order, segment = order[by], segment[by]
        depth = depth[by] + (part[by] == 1)
        new = np.concatenate(([True], segment[1:] != segment[:-1]))
        through = depth == words
        if through.any():
            equal.append(order[through & ~new])
            order, depth, segment = order[~through], depth[~through], segment[~through]
            new = np.concatenate(([True], segment[1:] != segment[:-1])) if len(order) else new[:0]
    return np.concatenate(equal) if equal else order


def _bucket(length: int, key: np.ndarray, doc_id: np.ndarray, place: np.ndarray, held: list[np.ndarray]) -> pa.RecordBatch:
    """Runs of repeats among contexts that come in order of key, document and place (a key's in one piece)."""
    first, count, shift = first_of(place), count_of(place), shift_of(place)
    group = np.cumsum(np.concatenate(([True], key[1:] != key[:-1])))
    data = np.concatenate(held)
    base = np.cumsum([0, *map(len, held)])[:-1]
    at = np.cumsum(np.concatenate(([0], count)))  # of each context's windows in `hit`
    hit = np.zeros(at[-1], dtype=bool)
    reach = np.arange(length)
    for offset in range(int((shift - count + 1).min()), int(shift.max()) + 1):
        start = shift - offset  # the window that starts `offset` before the anchor
        there = np.flatnonzero((start >= 0) & (start < count))
        if len(there) < 2:
            continue
        rows = data[(base[there] + start[there])[:, None] + reach]
        again = there[ties(group[there], rows)]
        hit[at[again] + start[again]] = True
    owner = np.repeat(np.arange(len(key)), count)
    step = np.flatnonzero(hit)
    if not len(step):
        return pa.RecordBatch.from_pydict({"doc_id": [], "first": [], "last": []}, pa.schema([(c, pa.int64()) for c in ("doc_id", "first", "last")]))
    new = np.concatenate(([True], (np.diff(step) > 1) | (owner[step[1:]] != owner[step[:-1]])))
    begin = step[new]
    end = np.append(step[np.flatnonzero(new)[1:] - 1], step[-1])
    who = owner[begin]
    return pa.RecordBatch.from_arrays([pa.array(doc_id[who]), pa.array(first[who] + begin - at[who]), pa.array(first[who] + end - at[who])], ["doc_id", "first", "last"])


def sort_buckets(length: int, bucket: int = BUCKET):
    def compare(contexts: DataFrame) -> DataFrame:
        def rows(batches):
            keys, docs, places, held = [], [], [], []
            for batch in batches:
                key = batch.column(0).to_numpy()
                if len(held) >= bucket and len(key):
                    # all of the last key must be seen before its bucket is sorted
                    more = np.flatnonzero(key != keys[-1][-1])
                    cut = more[0] if len(more) else len(key)
                    for part, whole in ((batch.slice(0, cut), True), (batch.slice(cut), False)):
                        if len(part):
                            keys.append(part.column(0).to_numpy())
                            docs.append(part.column(1).to_numpy())
                            places.append(part.column(2).to_numpy())
                            held += [t.copy() for t in texts_of(part.column(3))]
                        if whole and len(more):
                            yield _bucket(length, np.concatenate(keys), np.concatenate(docs), np.concatenate(places), held)
                            keys, docs, places, held = [], [], [], []
                    continue
                if len(key):
                    keys.append(key)
                    docs.append(batch.column(1).to_numpy())
                    places.append(batch.column(2).to_numpy())
                    held += [t.copy() for t in texts_of(batch.column(3))]
            if held:
                yield _bucket(length, np.concatenate(keys), np.concatenate(docs), np.concatenate(places), held)

        # Keys lead with the suffixes' first bytes, so sampled splitters deal the buckets out in the suffixes' order.
        return contexts.repartitionByRange("key").sortWithinPartitions("key", "doc_id", "place").mapInArrow(rows, FOUND)

    return compare


def repeated_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, first, last): runs of byte windows of `docs` that start earlier elsewhere."""
    return found(docs, bytes_of, length, gram, hot, sort_buckets(length), leading)


def dedup_bytes(df: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """One row per document: (doc_id, n_bytes, n_removed, n_spans, kept_sha256).

    Every byte covered by a `length`-byte string that starts earlier is removed.
    Null and empty texts have no bytes; texts shorter than `length` keep all.
    Repeated rows and null ids: see `common`. An empty table gives an empty result.
    """

    def judge(text, first, last):
        gone = covered(len(text), first, last, length)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        return len(text), int(gone.sum()), spans, hashlib.sha256(text[~gone].tobytes()).hexdigest()

    docs = documents(df)
    out = with_runs(docs, repeated_bytes(docs, length, gram, hot), judge, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return given_ids(out, docs)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_bytes(table(spark, sf_dir, "documents"))


#: Bytes as two hex digits each, windows by their digests, each with its first place; texts go in blocks to keep substr short.
OP3_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, k, substr(h, 2000 * k + 1, 2198) AS h FROM d, unnest(range(0, (len(h) + 1999) // 2000)) AS t(k)),
win AS (SELECT doc_id, 1000 * k + j AS i, md5(substr(h, 2 * j + 1, 200)) AS m FROM b, unnest(range(0, least(1000, len(h) // 2 - 99))) AS t(j)),
again AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY m ORDER BY doc_id, i) > 1),
fresh AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM again),
span AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM fresh),
gone AS (SELECT doc_id, s, min(i) AS a, max(i) + 100 AS e FROM span GROUP BY doc_id, s),
gaps AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS e FROM gone
  UNION ALL SELECT doc_id, max(e), 1000000000 FROM gone GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (e - a)), '' ORDER BY a) AS h FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, sum(e - a) AS removed, count(*) AS spans FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(d.h) // 2 AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
