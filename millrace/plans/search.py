"""Registered queries of retrieval: keyword, vector and hybrid search, and its evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..model import SearchOptions
from ..operators import evaluate, fusion, lexical, vector
from ..session import cut
from . import bindings as b

K = 10
WIDE = 50
SOME = ("memory", "skill")


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return lexical.search(b.records(spark, d), b.queries(spark, d), K).withColumn("score", F.round("score", 8))


def bm25_typed(spark: SparkSession, d: str) -> DataFrame:
    return lexical.search(b.records(spark, d), b.queries(spark, d), K, SOME).withColumn("score", F.round("score", 8))


def bm25_stemmed(spark: SparkSession, d: str) -> DataFrame:
    """Through a stored index: built from old bodies of some records, then brought up to date."""
    rows, index = b.records(spark, d), b.stored_index(spark, d)
    return index.search(b.queries(spark, d), rows, K).withColumn("score", F.round("score", 8))


def keyword_operators(spark: SparkSession, d: str) -> DataFrame:
    """Phrases, AND, OR, NOT and a syntax error, from each item's first two words and its two search terms."""
    first = text.tokens(F.col("text"))
    items = b.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat_ws("_", first[0], first[1]).alias("p"), first[0].alias("w"))
    rows = b.queries(spark, d).select("query_id", F.split_part("query", F.lit(" "), F.lit(1)).alias("a"), F.split_part("query", F.lit(" "), F.lit(2)).alias("b")).where("b <> ''").join(items, "query_id")
    spoken = F.array(*[F.format_string(shape, "a", "b", "p", "w") for shape in ("%3$s", "%1$s AND %2$s", "%1$s OR %2$s", "%1$s NOT %2$s", "%1$s %2$s OR %3$s AND %1$s NOT %2$s", "AND %1$s")])
    asked = rows.select("query_id", F.posexplode(spoken).alias("k", "query")).select((F.col("query_id") * 10 + F.col("k")).alias("query_id"), "query")
    return lexical.search(b.records(spark, d), asked, K).withColumn("score", F.round("score", 8))


def term_stats(spark: SparkSession, d: str) -> DataFrame:
    posted = lexical.postings(b.records(spark, d))
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def knn_l2_topk(spark: SparkSession, d: str) -> DataFrame:
    return vector.knn(b.chunks(spark, d), b.queries(spark, d), K).withColumn("distance", F.round("distance", 6))


def knn_typed_compat(spark: SparkSession, d: str) -> DataFrame:
    return vector.knn_typed(b.chunks(spark, d), b.records(spark, d), b.queries(spark, d), K, SOME, compat=True).withColumn("distance", F.round("distance", 6))


def knn_typed(spark: SparkSession, d: str) -> DataFrame:
    return vector.knn_typed(b.chunks(spark, d), b.records(spark, d), b.queries(spark, d), K, SOME).withColumn("distance", F.round("distance", 6))


def _fused(spark: SparkSession, d: str, *weights: float) -> DataFrame:
    asked = b.queries(spark, d)
    return fusion.rrf(lexical.search(b.records(spark, d), asked, WIDE), vector.knn(b.chunks(spark, d, many=True), asked, WIDE), 60, *weights)


def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).withColumn("score", F.round("score", 10))


def rrf_weighted(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d, 2.0, 0.5).withColumn("score", F.round("score", 10))


ALL = SearchOptions(include_expired=True, include_deprecated=True, include_deleted=True)


def hybrid_rescored(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rescored(_fused(spark, d), b.records(spark, d), b.now(), ALL).withColumn("score", F.round("score", 10))


def hybrid_visible(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rescored(_fused(spark, d), b.records(spark, d), b.now()).withColumn("score", F.round("score", 10))


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    options = SearchOptions(mmr_lambda=0.7, rerank_top_n=20)
    return fusion.search(b.records(spark, d), b.chunks(spark, d, many=True), b.queries(spark, d), b.now(), options).withColumn("score", F.round("score", 10))


def rerank_lexical(spark: SparkSession, d: str) -> DataFrame:
    rows, asked = b.records(spark, d), b.queries(spark, d)
    hits = cut(fusion.rescored(_fused(spark, d), rows, b.now()))
    out = fusion.reranked(hits, fusion.lexical_scores(hits, asked, rows), 5)
    return out.select("query_id", "id", F.round("rerank", 8).alias("rerank"), "final_rank")


def mmr_topk(spark: SparkSession, d: str) -> DataFrame:
    asked, chunks = b.queries(spark, d), b.chunks(spark, d, many=True)
    hits = cut(fusion.rescored(_fused(spark, d), b.records(spark, d), b.now(), SearchOptions(mmr_lambda=0.7)))
    pool = hits.join(lexical.named(vector.first_chunks(chunks), hits), "id", "left").join(asked.select("query_id", F.col("embedding").alias("query_embedding")), "query_id")
    return fusion.mmr(pool.where("query_embedding is not null"))


def search_snippets(spark: SparkSession, d: str) -> DataFrame:
    hits = cut(fusion.rescored(_fused(spark, d), b.records(spark, d), b.now()))
    rows = lexical.named(b.records(spark, d).select("id", "title", "body", "type", "path"), hits).select("id", "title", "type", "path", text.snippet(F.col("body")).alias("snippet"))
    return hits.join(rows, "id").select("query_id", "id", "title", "type", "path", "snippet", "bm25_rank", "vec_rank", "final_rank")


def hyde_gate(spark: SparkSession, d: str) -> DataFrame:
    """Over every line of the conversations and the benchmark, some turned into look-ups."""
    said = b.table(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("key"), F.when(F.col("turn") % 4 == 1, F.concat(F.lit('find "'), F.substring("text", 1, 10), F.lit('" in all of it'))).when(F.col("turn") % 4 == 2, F.concat(F.lit("this AND "), "text")).when(F.col("turn") % 4 == 3, F.substring_index("text", " ", 2)).otherwise(F.col("text")).alias("query"))
    items = b.table(spark, d, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("key"), F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("/docs/"), F.col("item_id").cast("string"), F.lit("/a-b.md"))).otherwise(F.col("text")).alias("query"))
    return said.union(items).select("key", text.expands(F.col("query")).alias("expands"))


def fts_sanitize(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "conversations").select("conv_id", "turn", text.sanitized(F.concat(F.lit("what's-new? "), F.col("text"))).alias("clean"))


def eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    items = b.table(spark, d, "benchmark")
    asked = b.queries(spark, d)
    hits = cut(lexical.search(b.records(spark, d), asked, K))
    needles = items.select(F.col("item_id").alias("query_id"), F.array(F.substring("text", 1, 60)).alias("needles"))
    bodies = hits.join(lexical.named(b.records(spark, d).select("id", "title", "body", "path"), hits), "id").join(needles, "query_id")
    relevant = bodies.where(text.matches_expectation(F.col("needles"), F.col("title"), F.col("body"), F.col("path"))).select("query_id", "id")
    classed = items.select(F.col("item_id").alias("query_id"), F.element_at(F.array(*[F.lit(c) for c in evaluate.CLASSES]), (F.col("item_id") % 4 + 1).cast("int")).alias("class"))
    out = evaluate.metrics(evaluate.first_ranks(hits, relevant, classed))
    return out.select("class", "queries", *[F.round(c, 8).alias(c) for c in ("mrr", "recall_3", "recall_10")], "found")


def related_by_tag(spark: SparkSession, d: str) -> DataFrame:
    """How often terms of queries occur by tag, from the postings: an exploded view of tags."""
    tagged = b.records(spark, d).select("id", F.explode("tags").alias("tag"))
    posted = lexical.postings(b.records(spark, d), terms=lexical.asked_terms(lexical.plan(b.queries(spark, d))))
    per = posted.join(tagged, "id").groupBy("tag", "term").agg(F.count(F.lit(1)).alias("records"))
    return per.withColumn("place", F.row_number().over(Window.partitionBy("tag").orderBy(F.col("records").desc(), "term"))).where("place <= 5")


QUERIES = {f.__name__: f for f in (bm25_topk, bm25_typed, bm25_stemmed, keyword_operators, term_stats, knn_l2_topk, knn_typed, knn_typed_compat, rrf_fuse, rrf_weighted, hybrid_rescored, hybrid_visible, hybrid_search, rerank_lexical, mmr_topk, search_snippets, hyde_gate, fts_sanitize, eval_metrics, related_by_tag)}

_BASE = f"WITH {b.RECORDS_SQL}, {b.QUERIES_SQL}"
_RECURSIVE = _BASE.replace("WITH", "WITH RECURSIVE", 1)


def _bm(where: str, k: int) -> str:
    return f"""bmk AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), id) AS rank FROM bm {where} QUALIFY rank <= {k})"""


def _rrf(kw: float, vw: float) -> str:
    return f"""{b.bm25_sql()}, {_bm("", WIDE)}, {b.knn_sql(WIDE, True)},
bestc AS (SELECT query_id, id, min(rank) AS cr FROM nn GROUP BY query_id, id),
dense AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY cr) AS v FROM bestc),
fused0 AS (SELECT query_id, id, bmk.rank AS bm25_rank, v AS vec_rank,
   coalesce({kw}::DOUBLE / (60 + bmk.rank), 0) + coalesce({vw}::DOUBLE / (60 + v), 0) AS score FROM bmk FULL JOIN dense USING (query_id, id)),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, bm25_rank ASC NULLS LAST, vec_rank ASC NULLS LAST) AS position FROM fused0)"""


def _rescored(condition: str, pool: int = 50, most: int = 10) -> str:
    bias = "CASE type WHEN 'distillation' THEN 1.10::DOUBLE WHEN 'memory' THEN 1.05::DOUBLE WHEN 'skill' THEN 1.05::DOUBLE WHEN 'project' THEN 1.05::DOUBLE WHEN 'decision' THEN 1.05::DOUBLE WHEN 'session' THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END"
    return f"""shown AS (SELECT f.*, r.type, r.importance, row_number() OVER (PARTITION BY query_id ORDER BY position) AS pool
   FROM fused f JOIN records r USING (id) WHERE {condition} QUALIFY pool <= {pool}),
scored AS (SELECT query_id, id, score * ((1.0::DOUBLE + 0.2::DOUBLE * coalesce(importance, 0.5::DOUBLE)) * {bias}) AS score, bm25_rank, vec_rank, position FROM shown),
final AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, position) AS final_rank FROM scored QUALIFY final_rank <= {most})"""


def _mmr(candidates: str) -> str:
    """CTEs ending in `mmr` (query_id, id, mmr_rank): greedy choice of ten among candidates (query_id, id, final_rank), a step a round."""
    return f"""qv AS (SELECT query_id, embedding::DOUBLE[] AS qe FROM queries JOIN embeddings ON vec_id = query_id),
cv AS (SELECT c.query_id, c.id, c.final_rank, qe, e.embedding::DOUBLE[] AS v FROM ({candidates}) c JOIN qv USING (query_id) LEFT JOIN embeddings e ON e.vec_id = c.id * 4),
wv AS (SELECT query_id, id, final_rank, v, list_cosine_similarity(qe, v) AS rel FROM cv WHERE v IS NOT NULL),
sims AS (SELECT a.query_id, a.id AS i, b.id AS j, list_cosine_similarity(a.v, b.v) AS s FROM wv a JOIN wv b USING (query_id)),
pick AS (SELECT DISTINCT query_id, 0 AS step, []::BIGINT[] AS chosen FROM cv
  UNION ALL
  SELECT query_id, step + 1, list_append(chosen, id) FROM (
    SELECT query_id, step, chosen, id, row_number() OVER (PARTITION BY query_id ORDER BY round(0.7::DOUBLE * rel - 0.3::DOUBLE * coalesce(near, 0), 9) DESC, final_rank) AS n
    FROM (SELECT k.query_id, k.step, k.chosen, w.id, w.final_rank, w.rel, max(s.s) AS near FROM pick k JOIN wv w ON w.query_id = k.query_id AND NOT list_contains(k.chosen, w.id)
      LEFT JOIN sims s ON s.query_id = k.query_id AND s.i = w.id AND list_contains(k.chosen, s.j) WHERE k.step < 10 GROUP BY k.query_id, k.step, k.chosen, w.id, w.final_rank, w.rel)) WHERE n = 1),
ended AS (SELECT query_id, arg_max(chosen, step) AS chosen, max(step) AS n FROM pick GROUP BY query_id),
mmr AS (SELECT query_id, unnest(chosen) AS id, generate_subscripts(chosen, 1) AS mmr_rank FROM ended
  UNION ALL SELECT query_id, id, n + row_number() OVER (PARTITION BY query_id ORDER BY final_rank) AS mmr_rank FROM cv JOIN ended USING (query_id) WHERE v IS NULL QUALIFY mmr_rank <= 10)"""


_VISIBLE = f"(valid_to IS NULL OR valid_to > TIMESTAMP '{b.NOW_TEXT}') AND deprecated_by IS NULL AND deleted_at IS NULL"
_TYPED = "WHERE id IN (SELECT id FROM records WHERE type IN ('memory', 'skill'))"
_HITS = "SELECT query_id, id, round(score, 10) AS score, bm25_rank::INT AS bm25_rank, vec_rank::INT AS vec_rank, position"

ORACLE = {
    "bm25_topk": f"{_BASE}, {b.bm25_sql()}, {_bm('', K)} SELECT query_id, id, round(score, 8) AS score, rank FROM bmk",
    "bm25_typed": f"{_BASE}, {b.bm25_sql()}, {_bm(_TYPED, K)} SELECT query_id, id, round(score, 8) AS score, rank FROM bmk",
    "bm25_stemmed": f"{_BASE}, {b.STEMMED_SQL}, {b.bm25_sql('sqt', 'stf', 'sdf')}, {_bm('', K)} SELECT query_id, id, round(score, 8) AS score, rank FROM bmk",
    "keyword_operators": f"""{_BASE}, said AS (SELECT query_id, split_part(query, ' ', 1) AS a, split_part(query, ' ', 2) AS b, {b.words_sql("text")}[1] AS w1, {b.words_sql("text")}[2] AS w2 FROM queries JOIN benchmark ON item_id = query_id WHERE contains(query, ' ')),
asked AS (
  SELECT query_id * 10 AS query_id, 0 AS part, 0 AS every, 0 AS other, 1 AS needs, 1 AS phrases, w1 || ' ' || w2 AS phrase FROM said
  UNION ALL SELECT query_id * 10 + 1, 0, e, 0, 2, 1, CASE e WHEN 0 THEN a ELSE b END FROM said, range(2) r(e)
  UNION ALL SELECT query_id * 10 + 2, e, 0, 0, 1, 1, CASE e WHEN 0 THEN a ELSE b END FROM said, range(2) r(e)
  UNION ALL SELECT query_id * 10 + 3, 0, 0, e, 1, 1, CASE e WHEN 0 THEN a ELSE b END FROM said, range(2) r(e)
  UNION ALL SELECT query_id * 10 + 4, 0, 0, 0, 1, 2, CASE e WHEN 0 THEN a ELSE b END FROM said, range(2) r(e)
  UNION ALL SELECT query_id * 10 + 4, 1, 0, 0, 2, 1, w1 || ' ' || w2 FROM said
  UNION ALL SELECT query_id * 10 + 4, 1, 1, e, 2, 1, CASE e WHEN 0 THEN a ELSE b END FROM said, range(2) r(e)),
parts AS (SELECT id, {b.words_sql("c")} AS ws FROM (SELECT id, unnest([title, body, lang || ' ' || source]) AS c FROM records)),
pairs AS (SELECT id, unnest(list_zip(ws[1:-2], ws[2:])) AS z FROM parts WHERE len(ws) > 1),
occ AS (SELECT term AS phrase, id, tf FROM tf WHERE term IN (SELECT phrase FROM asked)
  UNION ALL SELECT z[1] || ' ' || z[2] AS phrase, id, count(*) FROM pairs WHERE z[1] || ' ' || z[2] IN (SELECT phrase FROM asked) GROUP BY ALL),
odf AS (SELECT phrase, count(*) AS df FROM occ GROUP BY phrase),
met AS (SELECT query_id, part, every, other, o.id, any_value(needs) AS needs, sum(-(CASE WHEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) <= 0 THEN 1e-6::DOUBLE ELSE ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) END)
    * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)))) AS s
  FROM asked JOIN occ o USING (phrase) JOIN odf USING (phrase) JOIN dl ON dl.id = o.id, st GROUP BY query_id, part, every, other, o.id HAVING count(*) = any_value(phrases)),
whole AS (SELECT query_id, part, id, sum(s) FILTER (other = 0) AS s FROM met GROUP BY query_id, part, id HAVING count(*) FILTER (other = 0) = any_value(needs) AND count(*) FILTER (other > 0) = 0),
hit AS (SELECT query_id, id, sum(s) AS score FROM whole GROUP BY query_id, id)
SELECT query_id, id, round(score, 8) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), id) AS rank FROM hit QUALIFY rank <= {K}""",
    "term_stats": f"{_BASE} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY term",
    "knn_l2_topk": f"{_BASE}, {b.knn_sql(K, False)} SELECT query_id, chunk_id, id, round(distance, 6) AS distance, rank FROM nn",
    "knn_typed_compat": f"{_BASE}, {b.knn_sql(5 * K, False)} SELECT query_id, chunk_id, id, round(distance, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 6), chunk_id) AS rank FROM nn {_TYPED} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 6), chunk_id) <= {K}",
    "knn_typed": f"{_BASE}, {b.knn_sql(1_000_000_000, False)} SELECT query_id, chunk_id, id, round(distance, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 6), chunk_id) AS rank FROM nn {_TYPED} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 6), chunk_id) <= {K}",
    "rrf_fuse": f"{_BASE}, {_rrf(1, 1)} {_HITS} FROM fused",
    "rrf_weighted": f"{_BASE}, {_rrf(2, 0.5)} {_HITS} FROM fused",
    "hybrid_rescored": f"{_BASE}, {_rrf(1, 1)}, {_rescored('true')} {_HITS}, final_rank FROM final",
    "hybrid_visible": f"{_BASE}, {_rrf(1, 1)}, {_rescored(_VISIBLE)} {_HITS}, final_rank FROM final",
    "rerank_lexical": f"""{_BASE}, {_rrf(1, 1)}, {_rescored(_VISIBLE)},
judged AS (SELECT query_id, f.id, final_rank, len(list_intersect(list_distinct({b.words_sql("q.query")}), {b.words_sql("concat_ws(' ', r.title, substr(r.body, 1, 4000))")}))::DOUBLE
   / greatest(len(list_distinct({b.words_sql("q.query")})), 1) AS rerank FROM final f JOIN queries q USING (query_id) JOIN records r ON r.id = f.id)
SELECT query_id, id, round(rerank, 8) AS rerank, row_number() OVER (PARTITION BY query_id ORDER BY final_rank <= 5 DESC, CASE WHEN final_rank <= 5 THEN rerank END DESC NULLS LAST, final_rank) AS final_rank FROM judged""",
    "mmr_topk": f"""{_RECURSIVE}, {_rrf(1, 1)}, {_rescored(_VISIBLE, 250, 50)}, {_mmr("SELECT query_id, id, final_rank FROM final")}
SELECT query_id, id, mmr_rank::INT AS mmr_rank FROM mmr""",
    "hybrid_search": f"""{_RECURSIVE}, {_rrf(1, 1)}, {_rescored(_VISIBLE, 250, 50)},
judged AS (SELECT f.*, len(list_intersect(list_distinct({b.words_sql("q.query")}), {b.words_sql("concat_ws(' ', r.title, substr(r.body, 1, 4000))")}))::DOUBLE
   / greatest(len(list_distinct({b.words_sql("q.query")})), 1) AS rerank FROM final f JOIN queries q USING (query_id) JOIN records r ON r.id = f.id),
ordered AS (SELECT * EXCLUDE (final_rank), row_number() OVER (PARTITION BY query_id ORDER BY final_rank <= 20 DESC, CASE WHEN final_rank <= 20 THEN rerank END DESC NULLS LAST, final_rank) AS final_rank FROM judged),
{_mmr("SELECT query_id, id, final_rank FROM ordered")}
SELECT query_id, id, round(score, 10) AS score, bm25_rank::INT AS bm25_rank, vec_rank::INT AS vec_rank, position, rerank, mmr_rank::INT AS final_rank FROM mmr JOIN ordered USING (query_id, id)""",
    "search_snippets": f"""{_BASE}, {_rrf(1, 1)}, {_rescored(_VISIBLE)},
flat AS (SELECT id, title, type, path, trim(regexp_replace(body, '\\s+', ' ', 'g')) AS f FROM records)
SELECT query_id, id, title, flat.type, path, CASE WHEN length(f) > 240 THEN rtrim(substr(f, 1, 240)) || '…' ELSE f END AS snippet, bm25_rank::INT AS bm25_rank, vec_rank::INT AS vec_rank, final_rank FROM final JOIN flat USING (id)""",
    "hyde_gate": r"""WITH q AS (SELECT conv_id::VARCHAR || ':' || turn::VARCHAR AS key, CASE WHEN turn % 4 = 1 THEN 'find "' || substr(text, 1, 10) || '" in all of it' WHEN turn % 4 = 2 THEN 'this AND ' || text
   WHEN turn % 4 = 3 THEN array_to_string(string_split(text, ' ')[1:2], ' ') ELSE text END AS query FROM conversations
 UNION ALL SELECT 'b' || item_id::VARCHAR, CASE WHEN item_id % 3 = 0 THEN '/docs/' || item_id::VARCHAR || '/a-b.md' ELSE text END FROM benchmark),
t AS (SELECT key, trim(query, E' \n\t\r') AS q FROM q)
SELECT key, q <> '' AND NOT regexp_matches(q, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$') AND NOT regexp_matches(q, '^[0-9a-fA-F]{32,}$')
  AND NOT regexp_matches(q, '^[/~][\w./~\-]+$|^[\w\-]+/[\w./\-]+$') AND NOT regexp_matches(q, '"[^"]+"') AND NOT regexp_matches(q, '\b(AND|OR|NOT)\b') AND NOT regexp_matches(q, '(^|\s)[+-]\w')
  AND len(regexp_split_to_array(q, '\s+')) >= 3 AS expands FROM t""",
    "fts_sanitize": r"""SELECT conv_id, turn, trim(regexp_replace('what''s-new? ' || text, '[^\p{L}\p{N}_\s]', ' ', 'g')) AS clean FROM conversations""",
    "eval_metrics": f"""{_BASE}, {b.bm25_sql()}, {_bm('', K)},
fr AS (SELECT query_id, min(rank) AS r FROM bmk JOIN records USING (id) JOIN benchmark bb ON bb.item_id = query_id
  WHERE contains(lower(body), lower(substr(bb.text, 1, 60))) OR contains(lower(title), lower(substr(bb.text, 1, 60))) OR contains(path, lower(substr(bb.text, 1, 60))) GROUP BY query_id),
c AS (SELECT ['conceptual','factual','historical','procedural'][(item_id % 4 + 1)::INT] AS class, r FROM benchmark LEFT JOIN fr ON query_id = item_id)
SELECT coalesce(class, 'all') AS class, count(*) AS queries, round(avg(coalesce(1.0::DOUBLE / r, 0)), 8) AS mrr, round(avg(CASE WHEN r <= 3 THEN 1.0::DOUBLE ELSE 0 END), 8) AS recall_3,
  round(avg(CASE WHEN r <= 10 THEN 1.0::DOUBLE ELSE 0 END), 8) AS recall_10, count(r) AS found FROM c GROUP BY ROLLUP (class)""",
    "related_by_tag": f"""{_BASE}, tagged AS (SELECT id, unnest(tags) AS tag FROM records)
SELECT tag, term, count(*) AS records, row_number() OVER (PARTITION BY tag ORDER BY count(*) DESC, term) AS place
FROM tf JOIN tagged USING (id) WHERE term IN (SELECT term FROM qt) GROUP BY tag, term QUALIFY place <= 5""",
}
