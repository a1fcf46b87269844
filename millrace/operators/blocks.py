"""Postings and records of a stored index, made where the records lie and shuffled as compressed blocks.

A record's tokens are all in its row, so its postings need no grouping. A batch's
rows of a bucket travel as one block of Arrow with zstd; they are rows again, and
sorted, where they are written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Records of a split of a bucket, about.
SPLIT = 200_000
SEED = 42
_P = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def xxhash64(words: pa.StringArray) -> np.ndarray:
    """What Spark's xxhash64 gives for each word, as signed numbers; words of one length together."""
    p1, p2, p3, p4, p5 = _P
    words = words.cast(pa.large_string())
    _, offsets, data = words.buffers()
    starts = np.frombuffer(offsets, dtype=np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, dtype=np.int64)
    text = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    lengths, out = np.diff(starts), np.zeros(len(words), dtype=np.uint64)
    seed = np.uint64(SEED)
    with np.errstate(over="ignore"):
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            raw = text[starts[at][:, None] + np.arange(n)]
            number = lambda i, kind: np.ascontiguousarray(raw[:, i : i + np.dtype(kind).itemsize]).view(kind)[:, 0].astype(np.uint64)  # noqa: B023, E731  used at once
            mixed = lambda w: _rotated(w * p2, 31) * p1
            i, h = 0, np.full(len(at), seed + p5, dtype=np.uint64)
            if n >= 32:
                lanes = [np.full(len(at), x, dtype=np.uint64) for x in (seed + p1 + p2, seed + p2, seed, seed - p1)]
                while i + 32 <= n:
                    lanes = [_rotated(v + number(i + 8 * k, "<u8") * p2, 31) * p1 for k, v in enumerate(lanes)]
                    i += 32
                h = _rotated(lanes[0], 1) + _rotated(lanes[1], 7) + _rotated(lanes[2], 12) + _rotated(lanes[3], 18)
                for v in lanes:
                    h = (h ^ mixed(v)) * p1 + p4
            h = h + np.uint64(n)
            while i + 8 <= n:
                h = _rotated(h ^ mixed(number(i, "<u8")), 27) * p1 + p4
                i += 8
            if i + 4 <= n:
                h = _rotated(h ^ number(i, "<u4") * p1, 23) * p2 + p3
                i += 4
            while i < n:
                h = _rotated(h ^ number(i, "<u1") * p5, 11) * p1
                i += 1
            h = (h ^ (h >> np.uint64(33))) * p2
            h = (h ^ (h >> np.uint64(29))) * p3
            out[at] = h ^ (h >> np.uint64(32))
    return out.view(np.int64)


def _posted(words: pa.ListArray, word: Callable[[str], str] | None) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, and of each posting, by record and term: its record, term, tf; all their positions; words of each record)."""
    lengths = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    held = words.flatten().dictionary_encode()
    terms, codes = held.dictionary, pc.fill_null(held.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    if word is not None:
        stems = pa.array([word(w) for w in terms.to_pylist()], pa.string()).dictionary_encode()
        codes = np.append(stems.indices.to_numpy(zero_copy_only=False).astype(np.int64), -1)[codes]
        terms = stems.dictionary
    at = np.flatnonzero(codes >= 0)
    record = np.repeat(np.arange(len(words)), lengths)[at]
    key = record * max(1, len(terms)) + codes[at]
    order = np.argsort(key, kind="stable")
    key, place = key[order], (at - (np.cumsum(lengths) - lengths)[record])[order]
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    return terms, key[starts] // max(1, len(terms)), key[starts] % max(1, len(terms)), np.diff(np.append(starts, len(key))), place, lengths - 2


def _block(names: list[str], columns: list[pa.Array]) -> bytes:
    batch, sink = pa.RecordBatch.from_arrays(columns, names), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _slices(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values of the chosen runs one after another, where each begins, with the end)."""
    ends = np.cumsum(counts)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)
    return values[at], np.append(0, ends)


def _packer(name: str, word: Callable[[str], str] | None, buckets: int, splits: int):
    """Records (id, words, bucket of the id) to blocks of rows of the table."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        for batch in batches:
            ids = batch.column(0)
            terms, record, term, tf, place, dl = _posted(batch.column(1), word)
            found = []
            if name == "postings":
                bucket = (xxhash64(terms) % buckets)[term]
                starts = np.cumsum(tf) - tf
                # By bucket, then term and record, which packs well.
                order = np.lexsort((record, term, bucket))
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(cuts)):
                    at = order[cuts[b] : cuts[b + 1]]
                    places, offsets = _slices(place, starts[at], tf[at])
                    positions = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(places, pa.int32()))
                    found.append((b, _block(["term", "id", "tf", "dl", "positions"], [terms.take(pa.array(term[at])), ids.take(pa.array(record[at])), pa.array(tf[at]), pa.array(dl[record[at]], pa.int32()), positions])))
            else:
                bucket = batch.column(2).to_numpy(zero_copy_only=False)
                cuts = np.searchsorted(record, np.arange(len(batch) + 1))
                for b in np.unique(bucket):
                    at = np.flatnonzero(bucket == b)
                    own, offsets = _slices(term, cuts[at], cuts[at + 1] - cuts[at])
                    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), terms.take(pa.array(own)))
                    found.append((b, _block(["id", "dl", "terms"], [ids.take(pa.array(at)), pa.array(dl[at], pa.int32()), lists])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int32()), pa.array([number % splits] * len(found), pa.int32()), pa.array([x for _, x in found], pa.binary())], ["bucket", "split", "block"])
            number += 1

    return pack


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for bucket, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            with pa.ipc.open_stream(block.as_buffer()) as rows:
                for out in rows:
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.full(len(out), bucket, dtype=np.int32))], [*out.schema.names, "bucket"])


def dealt(name: str, records: DataFrame, words: F.Column, bucket: F.Column, schema: str, word: Callable[[str], str] | None, buckets: int) -> DataFrame:
    """Rows of a table (postings or records) with their bucket, a bucket in several partitions if there are many records."""
    spark = records.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    splits = max(1, -(-records.select(F.lit(1)).count() // SPLIT))
    packed = records.select("id", words.alias("words"), bucket.alias("bucket")).mapInArrow(_packer(name, word, buckets, splits), "bucket int, split int, block binary")
    return packed.repartition("bucket", "split").select("bucket", "block").mapInArrow(_unpack, f"{schema}, bucket int")
