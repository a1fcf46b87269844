"""Model protocols with offline stand-ins: embedding, expansion and summaries, behind caches."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..session import cut
from . import state


class Embedder(Protocol):
    """Turns texts into vectors; made once per task."""

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


def hashed_vectors(chunks: DataFrame, dimensions: int = 64) -> DataFrame:
    """(chunk_id, embedding) of chunks (chunk_id, text): a deterministic stand-in for an embedding.

    Tokens are counted in hashed, signed buckets; vectors are of unit length, or
    all zero for chunks without tokens.
    """
    # Nine digits of a hash: eight for the bucket, the last bit for the sign. A chunk without tokens adds nothing to bucket 0.
    each = chunks.select("chunk_id", F.explode_outer(text.tokens(F.col("text"))).alias("token"))
    each = each.select("chunk_id", F.conv(F.substring(F.md5("token"), 1, 9), 16, 10).cast("long").alias("h"))
    bucket = F.coalesce(F.pmod(F.shiftright("h", 4), F.lit(dimensions)), F.lit(0)).cast("int")
    value = F.when(F.col("h").isNull(), 0.0).when(F.col("h") % 2 == 0, 1.0).otherwise(-1.0)
    sums = each.groupBy("chunk_id", bucket.alias("bucket")).agg(F.sum(value).alias("value"))
    held = sums.groupBy("chunk_id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "value"))).alias("held"), F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    value = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.coalesce(F.try_element_at("held", i), F.lit(0.0)) / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0))
    return held.select("chunk_id", value.alias("embedding"))


def embedded(chunks: DataFrame, make: Callable[[], Embedder]) -> DataFrame:
    """chunks (chunk_id, id, chunk_index, text) with embeddings of a model that each task makes once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for batch in batches:
            yield batch.assign(embedding=model(batch["text"].tolist()))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.schema.fields)
    return chunks.mapInPandas(run, f"{kinds}, embedding array<double>")


def cached(requests: DataFrame, cache: DataFrame, keys: list[str], answer: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(answers, cache after): a model is asked only for distinct misses."""
    hits, misses = state.answered(requests, cache, keys)
    fresh = answer(misses.dropDuplicates(keys)).select(*cache.columns)
    return hits.unionByName(misses.join(fresh, keys).select(*hits.columns)), cache.unionByName(fresh)


def chunk_rows(records: DataFrame, most: int = 2048) -> DataFrame:
    """(chunk_id, id, chunk_index, text) of records."""
    each = records.select("id", F.posexplode(text.chunks(F.col("body"), most)).alias("chunk_index", "text"))
    return each.select(F.concat_ws(":", F.col("id").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"), "id", "chunk_index", "text")


def expanded(queries: DataFrame, cache: DataFrame, judge: str, answer: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(queries with `passage`, cache after): hypothetical answers to look for instead of the questions.

    queries: query_id, query; cache: query_hash, judge, hypothesis. `answer` turns
    distinct misses (query_hash, query) into (query_hash, hypothesis) and is asked
    once for each. Look-ups are not expanded (`text.expands`), and where the model
    fails or says nothing, the passage is the query; empty answers are not cached.
    """
    rows = queries.select("query_id", "query", text.raw_hash(F.trim("query")).alias("query_hash"), text.expands(F.col("query")).alias("expands"))
    known = cache.where(F.col("judge") == judge).select("query_hash", "hypothesis")
    misses = rows.where("expands").join(known, "query_hash", "left_anti").groupBy("query_hash").agg(F.min("query").alias("query"))
    try:
        fresh = cut(answer(cut(misses)).select("query_hash", "hypothesis").where("coalesce(hypothesis, '') <> ''").dropDuplicates(["query_hash"]))
    except Exception as error:  # noqa: BLE001  whatever a model raises, the search goes on
        warnings.warn(f"no expansion: {error}", stacklevel=2)
        fresh = known.limit(0)
    answers = known.unionByName(fresh)
    out = rows.join(answers, "query_hash", "left").select("query_id", "query", F.when(F.col("expands"), F.coalesce("hypothesis", "query")).otherwise(F.col("query")).alias("passage"))
    return out, cache.unionByName(fresh.withColumn("judge", F.lit(judge)).select(*cache.columns))


def vectors_or_none(rows: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, str | None]:
    """(query_id, embedding) of rows (query_id, passage), and why there is none if the model fails: search by keywords is left."""
    try:
        return cut(embed(rows.select(F.col("query_id").alias("chunk_id"), F.col("passage").alias("text"))).select(F.col("chunk_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))), None
    except Exception as error:  # noqa: BLE001
        return rows.select("query_id", F.lit(None).cast("array<double>").alias("embedding")), f"{type(error).__name__}: {str(error).splitlines()[0][:200]}"
