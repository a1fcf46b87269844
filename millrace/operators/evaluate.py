"""Retrieval quality: first relevant rank per query, reciprocal rank and recall, by class and in all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.
CLASSES = ("conceptual", "factual", "historical", "procedural")


def first_ranks(hits: DataFrame, relevant: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, class, first_rank): least rank of a relevant hit; null if none was found."""
    found = hits.join(relevant.select("query_id", "id").distinct(), ["query_id", "id"]).groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    return queries.select("query_id", "class").join(found, "query_id", "left")


def metrics(ranks: DataFrame) -> DataFrame:
    """(class, queries, mrr, recall_3, recall_10, found); the row of all classes has class 'all'."""
    rank = F.col("first_rank")
    measured = ranks.rollup("class").agg(
        F.count(F.lit(1)).alias("queries"),
        F.avg(F.coalesce(1.0 / rank, F.lit(0.0))).alias("mrr"),
        F.avg(F.coalesce((rank <= 3).cast("double"), F.lit(0.0))).alias("recall_3"),
        F.avg(F.coalesce((rank <= 10).cast("double"), F.lit(0.0))).alias("recall_10"),
        F.count(rank).alias("found"),
        F.grouping("class").alias("_all"),
    )
    return measured.withColumn("class", F.when(F.col("_all") == 1, "all").otherwise(F.col("class"))).drop("_all")


def valid_queries(rows: DataFrame) -> DataFrame:
    """Eval queries with a known class, a text, an expectation and a positive top_k; others are left out."""
    expected = F.size(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in ("title_contains", "body_contains", "path_contains")]))
    return rows.where(F.col("class").isin(*CLASSES) & (F.trim("query") != "") & (expected > 0) & (F.col("top_k") >= 1))
