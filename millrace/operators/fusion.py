"""Hybrid search: fusing ranked lists, visibility, re-scoring, reranking and diversification."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..model import NEUTRAL_IMPORTANCE, TYPE_BIAS, SearchOptions
from ..session import cut
from . import lexical, vector


def rrf(keyword: DataFrame, nearest: DataFrame, k: int = 60, keyword_weight: float = 1.0, vector_weight: float = 1.0) -> DataFrame:
    """(query_id, id, score, bm25_rank, vec_rank, position): reciprocal rank fusion.

    keyword has query_id, id, rank; nearest has query_id, id, chunk_id, rank, whose
    chunks are first reduced to each record's best and ranked anew. Ties keep the
    keyword list's order, then the vector list's.
    """
    best = nearest.groupBy("query_id", "id").agg(F.min("rank").alias("chunk_rank"))
    dense = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_rank")))
    none = F.lit(None).cast("int")
    both = keyword.select("query_id", "id", F.col("rank").alias("b"), none.alias("v")).unionByName(dense.select("query_id", "id", none.alias("b"), F.col("rank").alias("v")))
    fused = both.groupBy("query_id", "id").agg(F.max("b").alias("bm25_rank"), F.max("v").alias("vec_rank"))
    part = lambda rank, weight: F.coalesce(F.lit(weight) / (F.lit(k) + F.col(rank)), F.lit(0.0))
    fused = fused.withColumn("score", part("bm25_rank", keyword_weight) + part("vec_rank", vector_weight))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("bm25_rank").asc_nulls_last(), F.col("vec_rank").asc_nulls_last())
    return fused.withColumn("position", F.row_number().over(order))


def visible(now: Column, expired: bool = False, deprecated: bool = False, deleted: bool = False) -> Column:
    """Lifecycle predicate over records; each flag lets one kind of hidden record through."""
    keep = F.lit(True)
    if not expired:
        keep = keep & (F.col("valid_to").isNull() | (F.col("valid_to") > now))
    if not deprecated:
        keep = keep & F.col("deprecated_by").isNull()
    if not deleted:
        keep = keep & F.col("deleted_at").isNull()
    return keep


def bias_of(type_: Column, bias: Mapping[str, float] = TYPE_BIAS) -> Column:
    out = F.lit(1.0)
    for name, factor in bias.items():
        out = F.when(type_ == name, F.lit(factor)).otherwise(out)
    return out


def rescored(fused: DataFrame, records: DataFrame, now: Column, options: SearchOptions = SearchOptions()) -> DataFrame:
    """Fused hits that are visible, in final order: query_id, id, score, bm25_rank, vec_rank, position, final_rank.

    Only the first over_fetch * materialised visible hits are scored again. With
    no importance weight and no bias the fused order stands.
    """
    kept = ["id", "type", "importance", "valid_to", "deprecated_by", "deleted_at"]
    fused = cut(fused)
    shown = fused.join(lexical.named(records.select(*kept), fused), "id").where(visible(now, options.include_expired, options.include_deprecated, options.include_deleted))
    if options.types:
        shown = shown.where(F.col("type").isin(*options.types))
    pool = F.row_number().over(Window.partitionBy("query_id").orderBy("position"))
    shown = shown.withColumn("pool", pool).where(F.col("pool") <= options.over_fetch * options.materialised)
    factor = (1.0 + options.importance_weight * F.coalesce("importance", F.lit(NEUTRAL_IMPORTANCE))) * bias_of(F.col("type"), options.type_bias)
    shown = shown.withColumn("score", F.col("score") * factor)
    final = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "position"))
    out = shown.withColumn("final_rank", final).where(F.col("final_rank") <= options.materialised)
    return out.select("query_id", "id", "score", "bm25_rank", "vec_rank", "position", "final_rank")


def reranked(hits: DataFrame, scores: DataFrame, top_n: int) -> DataFrame:
    """The first top_n hits by a model's score (query_id, id, rerank), then by rank before; the rest stay behind."""
    if top_n <= 0:
        return hits
    joined = hits.join(scores, ["query_id", "id"], "left")
    head = F.col("final_rank") <= top_n
    judged = F.when(head, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("rerank", F.lit(0.0)))))
    order = Window.partitionBy("query_id").orderBy(head.desc(), judged.desc_nulls_last(), F.col("final_rank"))
    return joined.withColumn("rank", F.row_number().over(order)).drop("final_rank").withColumnRenamed("rank", "final_rank")


def lexical_scores(hits: DataFrame, queries: DataFrame, records: DataFrame, head: int = 4000) -> DataFrame:
    """(query_id, id, rerank): share of a query's distinct tokens that a record's title or head has; a model-free judge."""
    words = queries.select("query_id", F.array_distinct(text.tokens(text.sanitized(F.col("query")))).alias("asked"))
    shown = lexical.named(records.select("id", "title", "body"), hits).select("id", F.array_distinct(text.tokens(F.concat_ws(" ", "title", F.substring("body", 1, head)))).alias("has"))
    share = F.size(F.array_intersect("asked", "has")) / F.greatest(F.size("asked"), F.lit(1))
    return hits.select("query_id", "id").join(words, "query_id").join(shown, "id").select("query_id", "id", share.alias("rerank"))


def mmr(candidates: DataFrame, lambda_: float = 0.7, k: int = 10) -> DataFrame:
    """(query_id, id, mmr_rank): maximal marginal relevance, greedy per query.

    candidates has query_id, id, final_rank, embedding and query_embedding; at
    most a search's pool per query. The first of equal candidates wins;
    candidates without a usable vector follow in their order. Greedy choice is
    sequential, so a query's candidates meet in one group; queries are parallel.
    """
    weight = min(1.0, max(0.0, lambda_))

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        rows = rows.sort_values("final_rank")
        asked = np.array(rows["query_embedding"].iloc[0], dtype=float)
        usable = [v is not None and len(v) == len(asked) and bool(np.any(v)) for v in rows["embedding"]]
        with_vector, without = rows[usable], rows[[not u for u in usable]]
        chosen: list[int] = []
        if len(with_vector):
            units = np.array([np.array(v, dtype=float) / np.linalg.norm(v) for v in with_vector["embedding"]])
            relevance = units @ (asked / (np.linalg.norm(asked) or 1.0))
            closest = np.zeros(len(units))
            open_ = np.ones(len(units), dtype=bool)
            for step in range(min(k, len(units))):
                value = weight * relevance - (1 - weight) * (closest if step else 0.0)
                best = int(np.argmax(np.where(open_, value.round(9), -np.inf)))
                chosen.append(best)
                open_[best] = False
                likeness = units @ units[best]
                closest = likeness if not step else np.maximum(closest, likeness)
        ids = [*with_vector["id"].iloc[chosen], *without["id"]][: max(0, k)]
        return pd.DataFrame({"query_id": rows["query_id"].iloc[0], "id": ids, "mmr_rank": range(1, len(ids) + 1)})

    kind = candidates.schema["id"].dataType.simpleString()
    return candidates.groupBy("query_id").applyInPandas(pick, f"query_id long, id {kind}, mmr_rank int")


def search(records: DataFrame, chunks: DataFrame, queries: DataFrame, now: Column, options: SearchOptions = SearchOptions(), keyword: DataFrame | None = None) -> DataFrame:
    """Hybrid search of many queries at once.

    queries has query_id (long), query and embedding (null: keywords only, and
    then no diversification). keyword: hits of a stored index (query_id, id, score,
    rank), else the records are indexed anew. Reranking comes before diversification.
    """
    if keyword is None:
        keyword = lexical.search(records, queries, options.candidates, options.types)
    near = vector.knn_typed(chunks, records, queries, options.candidates, options.types) if options.types else vector.knn(chunks, queries, options.candidates)
    hits = cut(rescored(rrf(keyword, near, options.rrf_k, options.bm25_weight, options.vector_weight), records, now, options))
    if options.rerank_top_n > 0:
        hits = reranked(hits, lexical_scores(hits, queries, records), options.rerank_top_n)
    if options.mmr_lambda is not None:
        pool = hits.join(lexical.named(vector.first_chunks(chunks), hits), "id", "left").join(queries.select("query_id", F.col("embedding").alias("query_embedding")), "query_id")
        picked = mmr(pool.where("query_embedding is not null"), options.mmr_lambda, options.limit)
        plain = pool.where("query_embedding is null").select("query_id", "id", F.col("final_rank").cast("int").alias("mmr_rank"))
        ranks = picked.unionByName(plain)
        hits = hits.drop("final_rank").join(ranks.withColumnRenamed("mmr_rank", "final_rank"), ["query_id", "id"])
    return hits.where(F.col("final_rank") <= options.limit)
