"""Registered queries of the sources: transcripts and Markdown, in lines that Spark makes of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import models
from ..sources import files, transcripts
from . import bindings as b


def _lines(turns: DataFrame, value, folder: str) -> DataFrame:
    path = F.concat(F.lit(folder), (F.col("conv_id") % 12).cast("string"), F.lit("/c"), F.col("conv_id").cast("string"), F.lit(".jsonl"))
    return turns.select(path.alias("path"), F.substring_index(path, "/", -1).alias("rel"), b.now().alias("modified"), F.col("turn").cast("int").alias("line_no"), value.alias("value"))


def _when() -> F.Column:
    return F.date_format(b.now() + F.make_dt_interval(secs=F.col("turn").cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _out(rows: DataFrame) -> DataFrame:
    return rows.select("ref", "title", "body", F.array_join("tags", ",").alias("tags"), F.col("metadata.session_id").alias("session_id"), F.col("metadata.created").alias("created"), F.col("metadata.updated").alias("updated"), F.col("metadata.turn_count").alias("turn_count"))


def coding_sessions(spark: SparkSession, d: str) -> DataFrame:
    turns = b.table(spark, d, "conversations")
    blocks = F.array(F.struct(F.lit("text").alias("type"), F.col("text"), F.lit(None).cast("string").alias("name")), F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("grep").alias("name")))
    said = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(F.col("role").alias("type"), F.struct("role", F.col("text").alias("content")).alias("message"), _when().alias("timestamp"), F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("sessionId"))))
    said = said.otherwise(F.to_json(F.struct(F.col("role").alias("type"), F.struct("role", blocks.alias("content")).alias("message"), _when().alias("timestamp"))))
    return _out(transcripts.coding_sessions(_lines(turns, said, "/p/-home-")))


def rollouts(spark: SparkSession, d: str) -> DataFrame:
    turns = b.table(spark, d, "conversations")
    content = F.array(F.struct(F.lit("input_text").alias("type"), F.col("text")))
    item = F.to_json(F.struct(F.lit("response_item").alias("type"), _when().alias("timestamp"), F.struct(F.lit("message").alias("type"), F.when(F.col("role") == "system", "developer").otherwise(F.col("role")).alias("role"), content.alias("content")).alias("payload")))
    meta = F.to_json(F.struct(F.lit("session_meta").alias("type"), _when().alias("timestamp"), F.struct(F.concat(F.lit("r"), F.col("conv_id").cast("string")).alias("id"), F.concat(F.lit("/home/u x/"), (F.col("conv_id") % 5).cast("string")).alias("cwd")).alias("payload")))
    rows = _lines(turns, item, "/r/")
    heads = _lines(turns.where("turn = 0").withColumn("turn", F.lit(-1)), meta, "/r/")
    return _out(transcripts.rollouts(rows.union(heads)))


def trajectories(spark: SparkSession, d: str) -> DataFrame:
    turns = b.table(spark, d, "conversations")
    prompt = F.to_json(F.struct(F.lit("prompt.submitted").alias("type"), _when().alias("ts"), F.concat(F.lit("t"), F.col("conv_id").cast("string")).alias("sessionId"), F.struct(F.col("text").alias("prompt")).alias("data")))
    reply = F.to_json(F.struct(F.lit("model.completed").alias("type"), _when().alias("ts"), F.struct(F.array("text").alias("assistantTexts")).alias("data")))
    value = F.when(F.col("role") == "assistant", reply).when(F.col("role") == "user", prompt).otherwise(F.lit("not json"))
    return _out(transcripts.trajectories(_lines(turns, value, "/t/")))


def markdown_records(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as Markdown with a header, and read back."""
    i = F.col("id")
    rel = F.when(i % 5 == 0, F.concat(F.lit("skills/s"), i.cast("string"), F.lit("/SKILL.md"))).when(i % 5 == 1, F.concat(F.lit("2024-01-"), F.lpad((i % 28 + 1).cast("string"), 2, "0"), F.lit(".md"))).when(i % 5 == 2, F.concat(F.lit("_meta/"), i.cast("string"), F.lit(".md"))).otherwise(F.concat(F.lit("n/"), i.cast("string"), F.lit(".md")))
    head = F.when(i % 2 == 0, F.concat(F.lit("---\ntitle: 'T "), i.cast("string"), F.lit("'\ntags: [a, "), "lang", F.lit("]\ncreated: 2024-01-01\n---\n"))).otherwise("")
    rows = b.records(spark, d).select(F.concat(F.lit("/v/"), rel).alias("path"), rel.alias("rel"), b.now().alias("modified"), F.encode(F.concat(head, "body"), "UTF-8").alias("content"))
    out = files.typed_markdown(files.vault(rows), "notes")
    return out.select("ref", "title", F.md5("body").alias("digest"), F.array_join("tags", ",").alias("tags"), F.col("metadata.type").alias("type"), F.col("metadata.created").alias("created"))


def hashed_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk of the documents with the offline embedder's vector."""
    return models.hashed_vectors(models.chunk_rows(b.records(spark, d)), 16)


def conversation_projects(spark: SparkSession, d: str) -> DataFrame:
    """Sessions read from lines, counted by the project tag of their folder."""
    return coding_sessions(spark, d).groupBy("tags").agg(F.count(F.lit(1)).alias("sessions"), F.sum(F.col("turn_count").cast("long")).alias("turns"))


QUERIES = {f.__name__: f for f in (coding_sessions, rollouts, trajectories, markdown_records, hashed_vectors, conversation_projects)}

_STAMP = f"strftime(TIMESTAMP '{b.NOW_TEXT}' + to_seconds({{}}::INT), '%Y-%m-%dT%H:%M:%SZ')"
_ROLE = "'**' || upper(substr(role, 1, 1)) || substr(role, 2) || ':** '"
_TITLE = "trim(substr(split_part(arg_min(text, turn) FILTER (role = 'user'), chr(10), 1), 1, 80))"
_CODING = f"""coding AS (SELECT '/p/-home-' || (conv_id % 12)::VARCHAR || '/c' || conv_id::VARCHAR || '.jsonl' AS ref,
  string_agg({_ROLE} || text || CASE WHEN turn % 2 = 1 THEN chr(10) || '[tool_use: grep]' ELSE '' END, chr(10) || chr(10) ORDER BY turn) FILTER (role IN ('user','assistant')) AS body,
  coalesce({_TITLE}, 'session ' || substr('s' || conv_id::VARCHAR, 1, 8)) AS title, 'home-' || (conv_id % 12)::VARCHAR AS tags, 's' || conv_id::VARCHAR AS session_id,
  {_STAMP.format("min(turn)")} AS created, {_STAMP.format("max(turn)")} AS updated, count(*) FILTER (role IN ('user','assistant'))::VARCHAR AS turn_count
  FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role IN ('user','assistant')) > 0)"""

ORACLE = {
    "hashed_vectors": f"""WITH {b.RECORDS_SQL}, {b.chunked_sql('records')},
rows AS (SELECT id, (k - 1)::INT AS n, cs[k] AS chunk FROM (SELECT id, cs, unnest(range(1, len(cs) + 1)) AS k FROM cut)),
tok AS (SELECT id, n, md5(t) AS h FROM (SELECT id, n, unnest({b.words_sql('chunk')}) AS t FROM rows)),
sums AS (SELECT id, n, ('0x' || substr(h, 1, 8))::BIGINT % 16 AS bucket, sum(CASE WHEN ('0x' || substr(h, 9, 1))::BIGINT % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS v FROM tok GROUP BY 1, 2, 3),
norms AS (SELECT id, n, sqrt(sum(v * v)) AS norm, map_from_entries(list({{'k': bucket, 'v': v}})) AS held FROM sums GROUP BY 1, 2)
SELECT id::VARCHAR || ':' || n::VARCHAR AS chunk_id, list_transform(range(16), lambda i: coalesce(held[i], 0.0::DOUBLE) / CASE WHEN coalesce(norm, 0) > 0 THEN norm ELSE 1.0::DOUBLE END) AS embedding FROM rows LEFT JOIN norms USING (id, n)""",
    "coding_sessions": f"WITH {_CODING} SELECT * FROM coding",
    "conversation_projects": f"WITH {_CODING} SELECT tags, count(*) AS sessions, sum(turn_count::BIGINT)::BIGINT AS turns FROM coding GROUP BY tags",
    "rollouts": f"""SELECT '/r/' || (conv_id % 12)::VARCHAR || '/c' || conv_id::VARCHAR || '.jsonl' AS ref, string_agg({_ROLE} || text, chr(10) || chr(10) ORDER BY turn) FILTER (role IN ('user','assistant')) AS body,
  coalesce({_TITLE}, 'codex session ' || substr('r' || conv_id::VARCHAR, 1, 8)) AS title, 'home-u-x-' || (conv_id % 5)::VARCHAR AS tags, 'r' || conv_id::VARCHAR AS session_id,
  {_STAMP.format("-1")} AS created, {_STAMP.format("max(turn)")} AS updated, count(*) FILTER (role IN ('user','assistant'))::VARCHAR AS turn_count
FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role IN ('user','assistant')) > 0""",
    "trajectories": f"""SELECT '/t/' || (conv_id % 12)::VARCHAR || '/c' || conv_id::VARCHAR || '.jsonl' AS ref, string_agg({_ROLE} || text, chr(10) || chr(10) ORDER BY turn) AS body,
  coalesce({_TITLE}, 'session ' || CASE WHEN bool_or(role = 'user') THEN substr('t' || conv_id::VARCHAR, 1, 8) ELSE substr('c' || conv_id::VARCHAR, 1, 8) END) AS title, '' AS tags,
  CASE WHEN bool_or(role = 'user') THEN 't' || conv_id::VARCHAR ELSE 'c' || conv_id::VARCHAR END AS session_id, {_STAMP.format("min(turn)")} AS created, {_STAMP.format("max(turn)")} AS updated, count(*)::VARCHAR AS turn_count
FROM conversations WHERE role IN ('user','assistant') GROUP BY conv_id""",
    "markdown_records": f"""WITH {b.RECORDS_SQL} SELECT '/v/' || CASE WHEN id % 5 = 0 THEN 'skills/s' || id::VARCHAR || '/SKILL.md' WHEN id % 5 = 1 THEN '2024-01-' || lpad((id % 28 + 1)::VARCHAR, 2, '0') || '.md' ELSE 'n/' || id::VARCHAR || '.md' END AS ref,
  CASE WHEN id % 2 = 0 THEN 'T ' || id::VARCHAR WHEN id % 5 = 0 THEN 's' || id::VARCHAR WHEN id % 5 = 1 THEN '2024-01-' || lpad((id % 28 + 1)::VARCHAR, 2, '0') ELSE id::VARCHAR END AS title, md5(body) AS digest,
  CASE WHEN id % 2 = 0 THEN 'a,' || lang ELSE '' END AS tags, CASE WHEN id % 5 = 0 THEN 'skill' WHEN id % 5 = 1 THEN 'daily' ELSE 'memory' END AS type,
  CASE WHEN id % 2 = 0 THEN '2024-01-01' ELSE '2024-02-15T00:00:00Z' END AS created FROM records WHERE id % 5 <> 2""",
}
