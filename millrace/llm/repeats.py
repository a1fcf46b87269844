"""Windows of a document that start earlier elsewhere: what both substring dedups share.

A document is a sequence of symbols (its UTF-8 bytes, or its words). Asked is
every window of `length` symbols that also starts earlier: in a document with a
smaller id, or in the same document before. The work goes in three steps.

1. `anchored`: one row per anchor (see `anchors`), range-partitioned by sampled
   splitters over (key, context, document, place) and sorted, so that even the
   key of a passage in a third of all documents is split between tasks.
   `settled` reads neighbours: a row whose context equals that of the row
   before repeats it whole; a row that shares no key with a neighbour has no
   window in common with anything; what is left are candidates, anchors that
   share a gram with another but not all their windows. First and last contexts
   of a partition count as candidates, so no border hides a repeat.
2. The candidates' symbols are fetched and compared within their key, by the
   method of the operator. Keys with more than `hot` candidates are not put
   into one task: their windows are sorted by range one by one (`sorted_out`).
3. The repeats found go back to their documents.

Keys only bring rows together. Equality is judged on the symbols themselves (2)
or on 128 bits of BLAKE2b of their bytes (1 and `sorted_out`), never on a
rolling hash. Memory: a task holds about ten arrays of eight bytes a symbol of
the text it is at, so the longest text must be a small share of a task's memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import idset
from .anchors import Rolling, anchors, mix
from .common import written

ANCHOR = "key long, context long, more long, doc_id long, place long"
SETTLED = "key long, doc_id long, place long, repeat boolean"
FOUND = "doc_id long, first long, last long"



@dataclass
class Sequence:
    """Symbols of one text: their hashes (or the symbols, if they are bytes), and where each starts in `data`."""

    symbols: np.ndarray
    data: np.ndarray
    #: Start of each symbol and, one gap after it, of what would follow the last; None: every byte is a symbol.
    starts: np.ndarray | None = None

    def cuts(self, first: np.ndarray, end: np.ndarray) -> list[bytes]:
        """The symbols of each span [first, end) as bytes; equal bytes, equal symbols."""
        data = self.data.tobytes()
        if self.starts is not None:
            first, end = self.starts[first], self.starts[end] - 1
        return [data[a:b] for a, b in zip(first.tolist(), end.tolist(), strict=True)]

    def digests(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """128 bits of each span, as two columns of 64."""
        return np.frombuffer(b"".join([blake2b(s, digest_size=16).digest() for s in self.cuts(first, end)]), dtype=np.int64).reshape(-1, 2)


Symbols = Callable[[np.ndarray], Sequence]
#: A key's highest bits, if they are to follow the symbols' order: of places in a sequence, with how many bits.
Lead = Callable[[Sequence, np.ndarray], tuple[np.ndarray, int]]


def texts_of(column: pa.Array) -> Iterator[np.ndarray]:
    """UTF-8 bytes of each string (or bytes of each binary) of an Arrow column, without copying."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    all_bytes = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    for i in range(len(column)):
        yield all_bytes[ends[i] : ends[i + 1]]


def word_spans(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of anything but ASCII white space) in UTF-8 bytes."""
    blank = (text == 0x20) | ((text >= 0x09) & (text <= 0x0D))
    step = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
    return np.flatnonzero(step == -1), np.flatnonzero(step == 1)


#: Keeps the first 0 to 8 bytes of a little-endian word.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_SIZE = np.uint64(0xC2B2AE3D27D4EB4F)
#: Words of more bytes are hashed by BLAKE2b, one by one.
_LONG = 1024


def word_hashes(text: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, chained over its eight-byte parts."""
    starts, ends = word_spans(text)
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    padded = np.zeros(len(text) + 8, dtype=np.uint8)
    padded[: len(text)] = text
    parts = np.ndarray(len(text) + 1, dtype="<u8", buffer=padded, strides=(1,))
    value = mix((parts[starts] & _KEEP[np.minimum(size, 8)]) + size.astype(np.uint64) * _SIZE)
    step, more = 8, np.flatnonzero((size > 8) & (size <= _LONG))
    while len(more):
        part = parts[starts[more] + step] & _KEEP[np.minimum(size[more] - step, 8)]
        value[more] = mix(value[more] * _SIZE + mix(part + np.uint64(step)))
        step += 8
        more = more[size[more] > step]
    for i in np.flatnonzero(size > _LONG).tolist():
        value[i] = int.from_bytes(blake2b(text[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return value


def words_of(text: np.ndarray) -> Sequence:
    """The words of a text, joined by single blanks."""
    blank = (text == 0x20) | ((text >= 0x09) & (text <= 0x0D))
    after = np.concatenate(([True], blank[:-1]))  # the start of the text, too, follows a blank
    keep = ~(blank & after)
    data = np.where(blank, 0x20, text).astype(np.uint8)[keep]
    starts = np.flatnonzero((~blank & after)[keep])
    ended = len(data) if not len(data) or data[-1] == 0x20 else len(data) + 1
    return Sequence(word_hashes(text), data, np.append(starts, ended))


def bytes_of(text: np.ndarray) -> Sequence:
    return Sequence(text, text)


# A place is first window << 16 | windows - 1 << 8 | anchor - first window.
def first_of(place: np.ndarray) -> np.ndarray:
    return place >> 16


def count_of(place: np.ndarray) -> np.ndarray:
    return ((place >> 8) & 0xFF) + 1


def shift_of(place: np.ndarray) -> np.ndarray:
    return place & 0xFF


def anchored(docs: DataFrame, symbols: Symbols, length: int, gram: int, lead: Lead | None = None) -> DataFrame:
    if not 0 < gram <= length < gram + 128:
        raise ValueError("length - gram must be 0 to 127")
    names = ["key", "context", "more", "doc_id", "place"]

    def rows(batches):
        for batch in batches:
            parts, held = [], 0
            for doc_id, text in zip(batch.column(0).to_numpy(), texts_of(batch.column(1)), strict=True):
                whole = symbols(text)
                key, first, last, at = anchors(whole.symbols, length, gram)
                if not len(key):
                    continue
                if lead is not None:
                    head, bits = lead(whole, at)
                    key = head << np.uint64(64 - bits) | key >> np.uint64(bits)
                context = whole.digests(first, last + length)
                parts.append((key.view(np.int64), context[:, 0], context[:, 1], np.full(len(key), doc_id), first << 16 | (last - first) << 8 | (at - first)))
                held += len(key)
                if held > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names)
                    parts, held = [], 0
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names)

    return docs.select("doc_id", "text").mapInArrow(rows, ANCHOR)


def _settle(batches):
    """Decide sorted anchors by their neighbours; see the module's text."""
    last = waiting = None
    for batch in batches:
        key, context, more, doc_id, place = (batch.column(i).to_numpy() for i in range(5))
        if not len(key):
            continue
        before = last if last is not None else (key[0], context[0], more[0])
        same_key = key == np.concatenate(([before[0]], key[:-1]))
        same = same_key & (context == np.concatenate(([before[1]], context[:-1]))) & (more == np.concatenate(([before[2]], more[:-1])))
        if last is None:
            same_key[0] = same[0] = False
        repeats = np.flatnonzero(same)
        heads = np.flatnonzero(~same)
        if len(heads):
            near = same_key[heads]  # to the head before, which has another context
            if last is None:
                near[0] = True
            h_key, h_doc, h_place = key[heads], doc_id[heads], place[heads]
            if waiting is not None:
                h_key, h_doc, h_place = (np.concatenate(([w], x)) for w, x in zip(waiting, (h_key, h_doc, h_place), strict=False))
                near = np.concatenate(([waiting[3]], near))
            chosen = np.flatnonzero(near[:-1] | (h_key[1:] == h_key[:-1]))
            waiting = (h_key[-1], h_doc[-1], h_place[-1], near[-1])
        else:
            chosen, h_key, h_doc, h_place = np.zeros(0, np.int64), key[:0], doc_id[:0], place[:0]
        last = key[-1], context[-1], more[-1]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate((key[repeats], h_key[chosen]))),
                pa.array(np.concatenate((doc_id[repeats], h_doc[chosen]))),
                pa.array(np.concatenate((place[repeats], h_place[chosen]))),
                pa.array(np.arange(len(repeats) + len(chosen)) < len(repeats)),
            ],
            ["key", "doc_id", "place", "repeat"],
        )
    if waiting is not None:
        yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in waiting[:3]] + [pa.array([False])], ["key", "doc_id", "place", "repeat"])


def settled(rows: DataFrame) -> DataFrame:
    order = ["key", "context", "more", "doc_id", "place"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_settle, SETTLED)


def packed(docs: DataFrame, bits: np.ndarray | None = None) -> DataFrame:
    """(doc_id, packed): texts compressed, for a shuffle of whole texts; of the documents that a bitmap perhaps holds."""

    def rows(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            if bits is not None:
                batch = batch.filter(pa.array(idset.perhaps(bits, batch.column(2).to_numpy())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack.compress(t) for t in texts_of(batch.column(1))], pa.binary())], ["doc_id", "packed"])

    return docs.select("doc_id", "text", idset.slot().alias("slot")).mapInArrow(rows, "doc_id long, packed binary")


def unpacked(column: pa.Array) -> Iterator[np.ndarray]:
    unpack = zstandard.ZstdDecompressor()
    for blob in column:
        yield np.frombuffer(unpack.decompress(blob.as_py()), dtype=np.uint8)


def _held(candidates: DataFrame, blobs: DataFrame) -> DataFrame:
    """(doc_id, packed, key, place): each text with its own candidates."""
    by_doc = candidates.groupBy("doc_id").agg(F.collect_list(F.struct("key", "place")).alias("at"))
    return blobs.join(by_doc, "doc_id").select("doc_id", "packed", F.col("at.key").alias("key"), F.col("at.place").alias("place"))


def contexts(candidates: DataFrame, blobs: DataFrame, symbols: Symbols, length: int) -> DataFrame:
    """(key, doc_id, place, symbols): the symbols that a candidate's windows cover, as `Sequence.cuts` gives them."""

    def rows(batches):
        for batch in batches:
            for doc_id, text, keys, places in zip(batch.column(0).to_pylist(), unpacked(batch.column(1)), batch.column(2), batch.column(3), strict=True):
                key, place = keys.values.to_numpy(), places.values.to_numpy()
                first, count = first_of(place), count_of(place)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(np.full(len(key), doc_id)), pa.array(place), pa.array(symbols(text).cuts(first, first + count - 1 + length), pa.binary())],
                    ["key", "doc_id", "place", "symbols"],
                )

    return _held(candidates, blobs).mapInArrow(rows, "key long, doc_id long, place long, symbols binary")


def sorted_out(candidates: DataFrame, blobs: DataFrame, symbols: Symbols, length: int) -> DataFrame:
    """FOUND rows for candidates whose key is hot: windows sorted by range, compared with the one before.

    A window (its 128-bit digest) and its place are the sort key, so windows that
    thousands of documents share are split between tasks too; the first of a
    partition is compared with the last of the partition before.
    """

    def windows(batches):
        for batch in batches:
            for doc_id, text, places in zip(batch.column(0).to_pylist(), unpacked(batch.column(1)), batch.column(3), strict=True):
                place = places.values.to_numpy()
                starts = np.concatenate([np.arange(a, a + n) for a, n in zip(first_of(place), count_of(place), strict=True)])
                digests = symbols(text).digests(starts, starts + length)
                yield pa.RecordBatch.from_arrays([pa.array([d.tobytes() for d in digests], pa.binary()), pa.array(np.full(len(starts), doc_id)), pa.array(starts)], ["window", "doc_id", "start"])

    def compare(batches):
        from pyspark import TaskContext

        part, before, first = TaskContext.get().partitionId(), None, True
        for batch in batches:
            window, doc_id, start = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            if not window:
                continue
            same = [w == b for w, b in zip(window, [before, *window[:-1]], strict=True)]
            keep = [i for i, s in enumerate(same) if s or first and i == 0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(keep), pa.int32()), pa.array([bool(same[i]) for i in keep]), pa.array([window[i] if not same[i] else None for i in keep], pa.binary()), pa.array([doc_id[i] for i in keep], pa.int64()), pa.array([start[i] for i in keep], pa.int64())],
                ["part", "same", "window", "doc_id", "start"],
            )
            before, first = window[-1], False
        if not first:  # the last window of the partition, without a document
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([False]), pa.array([before], pa.binary()), pa.array([None], pa.int64()), pa.array([None], pa.int64())], ["part", "same", "window", "doc_id", "start"])

    order = ["window", "doc_id", "start"]
    each = _held(candidates, blobs).mapInArrow(windows, "window binary, doc_id long, start long")
    marked = written(each.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(compare, "part int, same boolean, window binary, doc_id long, start long"), "hot-windows")
    from pyspark.sql import Window

    borders = marked.where("not same")  # two rows per partition
    previous = F.lag(F.when(F.col("doc_id").isNull(), F.col("window"))).over(Window.orderBy("part", F.col("doc_id").asc_nulls_last()))
    across = borders.withColumn("previous", previous).where("doc_id is not null and window = previous")
    return marked.where("same").select("doc_id", "start").union(across.select("doc_id", "start")).select("doc_id", F.col("start").alias("first"), F.col("start").alias("last"))


def found(docs: DataFrame, symbols: Symbols, length: int, gram: int, hot: int, compare: Callable[[DataFrame], DataFrame], lead: Lead | None = None) -> DataFrame:
    """(doc_id, first, last): runs of windows that start earlier elsewhere.

    `compare` gets the contexts of keys with up to `hot` candidates each and
    returns FOUND rows.
    """
    rows = written(settled(anchored(docs, symbols, length, gram, lead)), "settled")
    place = F.col("place")
    first = F.shiftright(place, 16)
    whole = rows.where("repeat").select("doc_id", first.alias("first"), (first + F.shiftright(place, 8).bitwiseAND(F.lit(0xFF))).alias("last"))
    candidates = rows.where("not repeat").select("key", "doc_id", "place")
    crowded = candidates.groupBy("key").count().where(F.col("count") > hot).select("key", F.lit(True).alias("hot"))
    apart = written(candidates.join(crowded, "key", "left"), "candidates")
    few, many = (apart.where(c).select("key", "doc_id", "place") for c in ("hot is null", "hot"))
    near = compare(contexts(few, packed(docs, idset.bitmap(few)), symbols, length))
    return whole.union(near).union(sorted_out(many, packed(docs, idset.bitmap(many)), symbols, length))


def with_runs(docs: DataFrame, runs: DataFrame, judge: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple], schema: str) -> DataFrame:
    """Give each document's text and runs to judge(text, first, last); one row (doc_id, *result) per document.

    Only texts of documents with runs are shuffled; the others are judged where they are read.
    """

    names = [c.split()[0] for c in f"doc_id long, {schema}".split(", ")]
    none = np.zeros(0, np.int64)
    runs = written(runs, "runs")
    bits = idset.bitmap(runs)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out, strict=True)), strict=True)) if out else {n: [] for n in names})

    def joined(batches):
        for batch in batches:
            out = []
            for doc_id, text, first, last in zip(batch.column(0).to_pylist(), unpacked(batch.column(1)), batch.column(2), batch.column(3), strict=True):
                a, b = (x.values.to_numpy() if x.is_valid else none for x in (first, last))
                out.append((doc_id, *judge(text, a, b)))
            yield batch_of(out)

    def untouched(batches):
        for batch in batches:
            batch = batch.filter(pa.array(~idset.perhaps(bits, batch.column(2).to_numpy())))
            yield batch_of([(doc_id, *judge(text, none, none)) for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True)])

    by_doc = runs.groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    some = packed(docs, bits).join(by_doc, "doc_id", "left").select("doc_id", "packed", F.col("runs.first").alias("first"), F.col("runs.last").alias("last"))
    rest = docs.select("doc_id", "text", idset.slot().alias("slot"))
    whole = f"doc_id long, {schema}"
    return some.mapInArrow(joined, whole).union(rest.mapInArrow(untouched, whole))


def covered(n: int, first: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    """Which of n symbols lie in a window of the runs."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, last + length, -1)
    return np.cumsum(step)[:n] > 0
