"""Exact nearest neighbours of a stated query set, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexical import top

#: Queries whose vectors are broadcast at a time.
BLOCK = 1000


def _nearest(held, k: int):
    """A task's k nearest chunks of each query; the final k are among them.

    held: broadcast (query ids, their vectors, all of one length). Distances to all
    queries come from one matrix product; those near the k-th are computed anew
    from the differences, so that rounding decides nothing. What a task has found
    so far bounds what it keeps of the next batch.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, wanted = held.value
        best: pa.RecordBatch | None = None
        far = np.full(len(ids), np.inf)
        for batch in batches:
            fit = pc.equal(pc.list_value_length(batch.column(2)), wanted.shape[1])
            batch = batch.filter(pc.fill_null(fit, False))
            if not len(batch) or not len(ids):
                continue
            vectors = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1)
            squares = (vectors**2).sum(axis=1)
            rough = np.sqrt(np.maximum(squares + (wanted**2).sum(axis=1)[:, None] - 2 * wanted @ vectors.T, 0))
            last = min(k, len(batch)) - 1
            edges = np.partition(rough, last, axis=1)[:, last] if len(batch) >= k else np.full(len(ids), np.inf)
            edges = np.minimum(edges, far)
            q, at = np.nonzero(rough <= edges[:, None] + 1e-4)  # ties are settled later, by id
            if not len(q):
                continue
            exact = np.sqrt(((vectors[at] - wanted[q]) ** 2).sum(axis=1))
            at = pa.array(at)
            fresh = pa.RecordBatch.from_arrays([pa.array(q), batch.column(0).take(at), batch.column(1).take(at), pa.array(exact)], ["q", "chunk_id", "id", "distance"])
            best = fresh if best is None else pa.concat_batches([best, fresh])
            if len(best) > 4 * k * len(ids):
                best, far = _kept(best, k, far)
        if best is not None:
            best, _ = _kept(best, k, far)
            yield pa.RecordBatch.from_arrays([pa.array(ids[best.column(0).to_numpy()]), *best.columns[1:]], ["query_id", "chunk_id", "id", "distance"])

    return search


def _kept(found: pa.RecordBatch, k: int, far: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray]:
    """(rows up to each query's k-th distance, with ties; these distances)."""
    q, distance = found.column(0).to_numpy(), found.column(3).to_numpy()
    order = np.lexsort((distance, q))
    start = np.searchsorted(q[order], np.arange(len(far)))
    end = np.searchsorted(q[order], np.arange(len(far)), side="right")
    full = end - start >= k
    far = far.copy()
    far[full] = distance[order][start[full] + k - 1]
    return found.filter(pa.array(distance <= far[q] + 1e-4)), far


def knn(chunks: DataFrame, queries: DataFrame, k: int, block: int = BLOCK, strict: bool = False) -> DataFrame:
    """(query_id, chunk_id, id, distance, rank): L2 top k chunks of each query.

    chunks has chunk_id, id and embedding; queries has query_id (long) and
    embedding. Queries are a stated set, met by all chunks block by block; a
    block's vectors are broadcast. A query meets the chunks whose vectors are as
    long as its own; with `strict`, chunks of another length than the queries' are an error.
    """
    rows = queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding").where("embedding is not null")
    held = chunks.select("chunk_id", "id", "embedding").where("embedding is not null")
    schema = f"query_id long, chunk_id {held.schema['chunk_id'].dataType.simpleString()}, id {held.schema['id'].dataType.simpleString()}, distance double"
    sizes = {r["n"]: r["c"] for r in rows.groupBy(F.size("embedding").alias("n")).agg(F.count(F.lit(1)).alias("c")).collect()}
    if strict and sizes:
        held = held.where(F.when(F.size("embedding").isin(list(sizes)), True).otherwise(F.raise_error(F.concat(F.lit("a chunk's vector has "), F.size("embedding").cast("string"), F.lit(" numbers, the queries have another length"))).cast("boolean")))
    found = None
    for size, count in sorted(sizes.items()):
        blocks = max(1, -(-count // block))
        for b in range(blocks):
            some = rows.where((F.size("embedding") == size) & (F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).collect()
            vectors = np.array([r["embedding"] for r in some], dtype=np.float64).reshape(len(some), size)
            sent = chunks.sparkSession.sparkContext.broadcast((np.array([r["query_id"] for r in some], dtype=np.int64), vectors))
            near = held.mapInArrow(_nearest(sent, k), schema)
            found = near if found is None else found.union(near)
    if found is None:
        found = chunks.sparkSession.createDataFrame([], schema)
    return top(found, k, F.round("distance", 6).asc(), F.col("chunk_id").asc())


def knn_typed(chunks: DataFrame, records: DataFrame, queries: DataFrame, k: int, types: tuple[str, ...], compat: bool = False) -> DataFrame:
    """kNN among records of some types.

    By default chunks are filtered first, so k chunks come back if there are so
    many. compat fetches 5k chunks of any type, filters and cuts to k.
    """
    allowed = records.where(F.col("type").isin(*types)).select("id")
    if not compat:
        return knn(chunks.join(allowed, "id", "left_semi"), queries, k)
    wide = knn(chunks, queries, 5 * k).drop("rank").join(allowed, "id", "left_semi")
    return top(wide, k, F.round("distance", 6).asc(), F.col("chunk_id").asc())


def first_chunks(chunks: DataFrame) -> DataFrame:
    """The vector that stands for a record: that of its first chunk."""
    return chunks.where("chunk_index = 0").select("id", "embedding")
