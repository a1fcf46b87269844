"""Registered queries of state transitions: queue, embedding state, deletions, upserts, stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import applies, ingest, relocate, state
from . import bindings as b


def _state(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """records' hashes, and the embedding state of most of them, some stale."""
    i = F.col("id")
    rows = b.records(spark, d).select("id", text.raw_hash(F.col("body")).alias("body_hash"))
    known = rows.where(i % 5 != 0).select("id", F.when(i % 7 == 0, F.lit("old")).when(i % 11 == 0, F.lit(None)).otherwise(F.col("body_hash")).alias("body_hash"), F.when(i % 13 == 0, F.lit("v1")).when(i % 3 == 0, F.lit(None)).otherwise(F.lit("v2")).alias("signature"))
    return rows, known


def needs_reembed(spark: SparkSession, d: str) -> DataFrame:
    return state.needs_embedding(*_state(spark, d), "v2")


def missing_state(spark: SparkSession, d: str) -> DataFrame:
    return state.missing_state(b.chunks(spark, d, many=True), _state(spark, d)[1])


def _queue(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    q = b.table(spark, d, "events").select(
        i.alias("id"),
        F.col("ts").cast("timestamp").alias("enqueued_at"),
        (F.col("user_id") % 6).cast("int").alias("retries"),
        F.when(i % 10 == 0, F.lit("boom")).alias("last_error"),
        (i % 10 == 0).alias("failed"),
        F.when(i % 4 == 0, b.now() - F.make_dt_interval(secs=(i % 600).cast("int"))).alias("claimed_at"),
        F.when(i % 4 == 0, F.lit("w0")).alias("claimed_by"),
    )
    return q


def queue_stats(spark: SparkSession, d: str) -> DataFrame:
    return state.queue_stats(_queue(spark, d))


def queue_claim(spark: SparkSession, d: str) -> DataFrame:
    return state.claimed(_queue(spark, d), 25, "w1", b.now()).select("id", "claimed_at", "claimed_by")


def queue_errors(spark: SparkSession, d: str) -> DataFrame:
    queue = _queue(spark, d)
    out = state.with_errors(queue, queue.where("id % 3 = 0").select("id", F.lit("timeout").alias("error")))
    return out.select("id", "retries", "failed", "last_error", "claimed_by")


def queue_requeue(spark: SparkSession, d: str) -> DataFrame:
    queue = _queue(spark, d)
    return state.enqueued(queue, queue.where("id % 9 = 0").select("id"), b.now()).select("id", "enqueued_at", "retries", "failed")


def prune_missing(spark: SparkSession, d: str) -> DataFrame:
    rows = b.records(spark, d)
    return state.prune_missing(rows, rows.where("id % 3 != 0"))


def owning_root(spark: SparkSession, d: str) -> DataFrame:
    roots = b.records(spark, d).select(F.substring_index("ref", "/", 2).alias("root")).where("root != '/root4'").distinct()
    deep = b.records(spark, d).select(F.when(F.col("id") % 2 == 0, F.concat(F.substring_index("ref", "/", 2), F.lit("/sub/"), F.col("id").cast("string"))).otherwise(F.col("ref")).alias("ref"))
    return state.owning_root(deep, roots.union(spark.createDataFrame([("/root1/sub",)], "root string")))


def source_sweep(spark: SparkSession, d: str) -> DataFrame:
    rows = b.records(spark, d)
    mapping = rows.select("source", "ref", "id", (F.col("id") % 13 != 0).alias("exists"))
    second = rows.where("id % 26 = 0").select("source", F.concat(F.col("ref"), F.lit(".bak")).alias("ref"), "id", F.lit(True).alias("exists"))
    roots = rows.select(F.substring_index("ref", "/", 2).alias("root")).where("root != '/root3'").distinct()
    return state.source_sweep(mapping.union(second), rows, roots)


def sweep_apply(spark: SparkSession, d: str) -> DataFrame:
    """A second sweep: some files are back, some are gone, and refs of records that are gone are left over."""
    rows = b.records(spark, d)
    i = F.col("id")
    mapping = rows.select("source", "ref", "id", (i % 13 != 0).alias("exists"))
    second = rows.where("id % 26 = 0").select("source", F.concat(F.col("ref"), F.lit(".bak")).alias("ref"), "id", F.lit(True).alias("exists"))
    orphans = rows.where("id % 50 = 0").select("source", F.concat(F.col("ref"), F.lit(".old")).alias("ref"), (i + 8_000_000_000).alias("id"), F.lit(True).alias("exists"))
    roots = rows.select(F.substring_index("ref", "/", 2).alias("root")).where("root != '/root3'").distinct()
    out = applies.sweep_applied(mapping.union(second).union(orphans), rows, roots, b.now())
    refs = out["mapping"].groupBy("id").agg(F.count(F.lit(1)).alias("refs"))
    return out["records"].select("id", "deleted_at").join(refs, "id", "left").select("id", "deleted_at", F.coalesce("refs", F.lit(0)).alias("refs"))


def skip_unchanged(spark: SparkSession, d: str) -> DataFrame:
    rows = b.records(spark, d).select("source", "ref", text.normalized_hash(F.col("body")).alias("hash"), "id")
    known = rows.where("id % 4 != 0").withColumn("hash", F.when(F.col("id") % 6 == 1, F.lit("stale")).otherwise(F.col("hash")))
    return state.changed(rows, known).select("id", "ref")


def merge_upsert(spark: SparkSession, d: str) -> DataFrame:
    """New rows take others' paths, each other's too, and some ids come twice."""
    i = F.col("id")
    rows = b.records(spark, d).select("id", "title", "path")
    path = lambda n: F.concat(F.lit("memories/"), n.cast("string"), F.lit(".md"))
    new = rows.where("id % 10 = 3").select("id", F.lit("new").alias("title"), F.when(i % 20 == 3, path(i + 1)).when(i % 40 == 13, path(i - 9)).otherwise(F.col("path")).alias("path"), F.lit(1).alias("turn"))
    again = rows.where("id % 30 = 3").select("id", F.lit("newer").alias("title"), "path", F.lit(2).alias("turn"))
    return ingest.upserted(rows, new.union(again), order=["turn"])


def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Model requests answered from a cache, and how many must still be made, by conversation role."""
    asked = b.table(spark, d, "conversations").select("role", text.raw_hash(F.col("text")).alias("content_hash"), F.lit("m1").alias("model"))
    cache = asked.where("role = 'user'").select("content_hash", "model").distinct()
    hits, misses = state.answered(asked, cache, ["content_hash", "model"])
    count = lambda df, name: df.groupBy("role").agg(F.count(F.lit(1)).alias(name))
    return count(hits, "hits").join(count(misses, "misses"), "role", "full").select("role", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("misses", F.lit(0)).alias("misses"))


def stages_due(spark: SparkSession, d: str) -> DataFrame:
    """Each user's last event as a stage's last run, every tenth locked."""
    runs = b.table(spark, d, "events").groupBy("user_id").agg(F.max("ts").cast("timestamp").alias("last_run"))
    u = F.col("user_id")
    stages = runs.select(u.alias("name"), (F.lit(86400) * (u % 30)).alias("interval_seconds"), F.when(u % 9 != 0, F.col("last_run")).alias("last_run"), F.when(u % 10 == 0, b.now() - F.make_dt_interval(secs=(u * 60 % 7200).cast("int"))).alias("locked_at"))
    return state.due(stages, b.now()).select("name", "due")


def ingest_batch(spark: SparkSession, d: str) -> DataFrame:
    """The documents as one batch of source records: the noisy ones dropped, equal bodies kept once, of records with one path the last."""
    rows = b.noisy(spark, d).select(F.col("id").alias("arrival_seq"), "source", "ref", "type", "title", "body", "tags", "created", "updated")
    columns = "id string, type string, title string, body string, tags array<string>, source string, created timestamp, updated timestamp, importance double, valid_from timestamp, valid_to timestamp, deprecated_by string, deleted_at timestamp, path string"
    out = ingest.ingested(rows, spark.createDataFrame([], columns), spark.createDataFrame([], "source string, ref string, id string, hash string"), b.now())
    named = F.when(F.col("type").isin("skill", "daily"), F.col("path")).otherwise("").alias("place")
    return out["records"].select(named, "type", F.md5("body").alias("digest"), "title", F.round("importance", 8).alias("importance"), "valid_to", "source")


def daily_relocation(spark: SparkSession, d: str) -> DataFrame:
    """Chains of moves: some wait for the next to leave, some for a record that stays, some evict a stale copy."""
    i = F.col("id")
    rows = b.records(spark, d).select("id", "path", F.when(i % 6 == 5, F.concat(F.lit("r"), (i - 1).cast("string"))).otherwise(F.concat(F.lit("r"), i.cast("string"))).alias("ref"), (i % 6 != 5).alias("owns"))
    after = F.concat(F.lit("memories/"), (i + 1).cast("string"), F.lit(".md"))
    target = F.when(i % 6 == 0, after).when(i % 6 == 1, F.concat(F.lit("daily/"), i.cast("string"), F.lit(".md"))).when((i % 6 == 2) | (i % 6 == 4), after)
    return relocate.relocated(rows, rows.select("id", target.alias("target")).where("target is not null"))


def daily_targets(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    day = F.date_format("created", "yyyy-MM-dd")
    ref = F.when(i % 4 == 0, F.concat(F.lit("/w/memory/"), day, F.lit(".md"))).when(i % 4 == 1, F.concat(F.lit("/w/memory/rem/x/"), day, F.lit(".md"))).when(i % 4 == 2, F.concat(F.lit("/w/other/"), day, F.lit(".md"))).otherwise(F.col("ref"))
    return b.records(spark, d).select("id", relocate.daily_target(ref, F.when(i % 3 == 0, F.lit("ari"))).alias("target"))


QUERIES = {f.__name__: f for f in (daily_relocation, daily_targets, needs_reembed, missing_state, queue_stats, queue_claim, queue_errors, queue_requeue, prune_missing, owning_root, source_sweep, sweep_apply, skip_unchanged, merge_upsert, cache_lookup, stages_due, ingest_batch)}

_R = f"WITH {b.RECORDS_SQL}"
_NOW = f"TIMESTAMP '{b.NOW_TEXT}'"
_HASH = b.HASH_SQL.format("body")
_QUEUE = f"""WITH queue AS (SELECT event_id AS id, ts AS enqueued_at, (user_id % 6)::INT AS retries, CASE WHEN event_id % 10 = 0 THEN 'boom' END AS last_error, event_id % 10 = 0 AS failed,
  CASE WHEN event_id % 4 = 0 THEN {_NOW} - to_seconds((event_id % 600)::INT) END AS claimed_at, CASE WHEN event_id % 4 = 0 THEN 'w0' END AS claimed_by FROM events)"""
_SEED = "least(1.0::DOUBLE, greatest(0.1::DOUBLE, CASE type WHEN 'skill' THEN 0.7::DOUBLE WHEN 'decision' THEN 0.6::DOUBLE WHEN 'distillation' THEN 0.7::DOUBLE WHEN 'daily' THEN 0.4::DOUBLE WHEN 'session' THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END"

ORACLE = {
    "daily_relocation": f"""{_R}, last AS (SELECT max(id) AS m FROM records)
SELECT id, CASE id % 6 WHEN 0 THEN 'memories/' || (id + 1)::VARCHAR || '.md' WHEN 1 THEN 'daily/' || id::VARCHAR || '.md' WHEN 2 THEN CASE WHEN id = m THEN 'memories/' || (id + 1)::VARCHAR || '.md' ELSE path END
  WHEN 4 THEN 'memories/' || (id + 1)::VARCHAR || '.md' WHEN 5 THEN '_meta/superseded-daily/' || path ELSE path END AS path,
  CASE id % 6 WHEN 3 THEN 'unchanged' WHEN 5 THEN 'parked' WHEN 2 THEN CASE WHEN id = m THEN 'moved' ELSE 'blocked' END ELSE 'moved' END AS status FROM records, last""",
    "daily_targets": f"""{_R} SELECT id, CASE WHEN id % 4 <> 3 THEN 'daily' || CASE WHEN id % 3 = 0 THEN '/ari' ELSE '' END || CASE WHEN id % 4 = 1 THEN '/rem/x' ELSE '' END || '/' || strftime(created, '%Y-%m-%d') || '.md' END AS target FROM records""",
    "needs_reembed": f"""{_R}, r AS (SELECT id, sha256(body) AS h FROM records), s AS (SELECT id, CASE WHEN id % 7 = 0 THEN 'old' WHEN id % 11 = 0 THEN NULL ELSE h END AS sh, CASE WHEN id % 13 = 0 THEN 'v1' WHEN id % 3 = 0 THEN NULL ELSE 'v2' END AS sg FROM r WHERE id % 5 <> 0)
SELECT r.id, sh IS NULL OR sh <> h OR coalesce(sg <> 'v2', false) AS needed FROM r LEFT JOIN s USING (id)""",
    "missing_state": f"{_R} SELECT DISTINCT vec_id // 4 AS id FROM embeddings WHERE vec_id // 4 NOT IN (SELECT id FROM records WHERE id % 5 <> 0)",
    "queue_stats": f"{_QUEUE} SELECT count(*) FILTER (NOT failed) AS pending, count(*) FILTER (failed) AS failed, count(*) AS total FROM queue",
    "queue_claim": f"""{_QUEUE}, t AS (SELECT id FROM queue WHERE NOT failed AND (claimed_at IS NULL OR claimed_at < {_NOW} - to_seconds(300)) ORDER BY enqueued_at, retries, id LIMIT 25)
SELECT id, CASE WHEN id IN (SELECT id FROM t) THEN {_NOW} ELSE claimed_at END AS claimed_at, CASE WHEN id IN (SELECT id FROM t) THEN 'w1' ELSE claimed_by END AS claimed_by FROM queue""",
    "queue_errors": f"{_QUEUE} SELECT id, retries + (id % 3 = 0)::INT AS retries, CASE WHEN id % 3 = 0 THEN retries + 1 >= 5 ELSE failed END AS failed, CASE WHEN id % 3 = 0 THEN 'timeout' ELSE last_error END AS last_error, CASE WHEN id % 3 = 0 THEN NULL ELSE claimed_by END AS claimed_by FROM queue",
    "queue_requeue": f"{_QUEUE} SELECT id, CASE WHEN id % 9 = 0 THEN {_NOW} ELSE enqueued_at END AS enqueued_at, CASE WHEN id % 9 = 0 THEN 0 ELSE retries END AS retries, id % 9 <> 0 AND failed AS failed FROM queue",
    "prune_missing": f"{_R}, g AS (SELECT id, path FROM records WHERE id % 3 = 0) SELECT id, path, (SELECT count(*) FROM g) > greatest(10, floor((SELECT count(*) FROM records) * 0.5::DOUBLE)) AS blocked FROM g",
    "owning_root": f"""{_R}, deep AS (SELECT CASE WHEN id % 2 = 0 THEN '/' || split_part(ref, '/', 2) || '/sub/' || id::VARCHAR ELSE ref END AS ref FROM records),
roots AS (SELECT DISTINCT '/' || split_part(ref, '/', 2) AS root FROM records WHERE ref NOT LIKE '/root4/%' UNION SELECT '/root1/sub')
SELECT ref, arg_max(root, length(root)) AS root FROM deep LEFT JOIN roots ON ref = root OR starts_with(ref, root || '/') GROUP BY ref""",
    "source_sweep": f"""{_R}, m AS (SELECT source, ref, id, id % 13 <> 0 AS ex FROM records UNION ALL SELECT source, ref || '.bak', id, true FROM records WHERE id % 26 = 0),
a AS (SELECT m.*, CASE WHEN m.ref NOT LIKE '/root3/%' THEN split_part(m.ref, '/', 2) END AS root FROM m JOIN records r USING (id) WHERE r.type IN ('memory','skill','daily')),
per AS (SELECT root, count(*) AS total, count(*) FILTER (NOT ex AND root IS NOT NULL) AS dead FROM a GROUP BY root),
v AS (SELECT a.id, ex, NOT ex AND (a.root IS NULL OR dead > greatest(10, floor(total * 0.5::DOUBLE))) AS unverified FROM a JOIN per ON a.root IS NOT DISTINCT FROM per.root)
SELECT id, CASE WHEN bool_or(ex) THEN 'live' WHEN bool_or(unverified) THEN 'unverified' ELSE 'tombstone' END AS verdict FROM v GROUP BY id""",
    "sweep_apply": f"""{_R}, m AS (SELECT source, ref, id, id % 13 <> 0 AS ex FROM records UNION ALL SELECT source, ref || '.bak', id, true FROM records WHERE id % 26 = 0),
a AS (SELECT m.*, r.type IN ('memory','skill','daily') AS authored, CASE WHEN m.ref NOT LIKE '/root3/%' THEN split_part(m.ref, '/', 2) END AS root FROM m JOIN records r USING (id)),
per AS (SELECT root, count(*) AS total, count(*) FILTER (NOT ex AND root IS NOT NULL) AS dead FROM a WHERE authored GROUP BY root),
v AS (SELECT a.*, CASE WHEN NOT authored THEN 'other' WHEN ex THEN 'live' WHEN a.root IS NULL OR dead > greatest(10, floor(total * 0.5::DOUBLE)) THEN 'unverified' ELSE 'dead' END AS state FROM a LEFT JOIN per ON a.root IS NOT DISTINCT FROM per.root),
w AS (SELECT id, bool_or(state = 'live') AS live, bool_and(state = 'dead') AS gone, count(*) FILTER (state <> 'dead') AS refs FROM v GROUP BY id)
SELECT r.id, CASE WHEN gone THEN coalesce(deleted_at, {_NOW}) WHEN live THEN NULL ELSE deleted_at END AS deleted_at, refs FROM records r JOIN w USING (id)""",
    "skip_unchanged": f"{_R} SELECT id, ref FROM records WHERE id % 4 = 0 OR id % 6 = 1",
    "merge_upsert": f"""{_R}, new AS (SELECT id, 'new' AS title, CASE WHEN id % 20 = 3 THEN 'memories/' || (id + 1)::VARCHAR || '.md' WHEN id % 40 = 13 THEN 'memories/' || (id - 9)::VARCHAR || '.md' ELSE path END AS path, 1 AS turn FROM records WHERE id % 10 = 3
  UNION ALL SELECT id, 'newer', path, 2 FROM records WHERE id % 30 = 3),
one AS (SELECT * FROM new QUALIFY row_number() OVER (PARTITION BY id ORDER BY turn DESC) = 1),
taken AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY path ORDER BY turn DESC, id DESC) = 1)
SELECT id, title, path FROM records WHERE id NOT IN (SELECT id FROM taken) AND path NOT IN (SELECT path FROM taken) UNION ALL SELECT id, title, path FROM taken""",
    "cache_lookup": """WITH c AS (SELECT DISTINCT text FROM conversations WHERE role = 'user')
SELECT role, count(*) FILTER (text IN (SELECT text FROM c)) AS hits, count(*) FILTER (text NOT IN (SELECT text FROM c)) AS misses FROM conversations GROUP BY role""",
    "stages_due": f"""WITH s AS (SELECT user_id AS name, 86400 * (user_id % 30) AS every, CASE WHEN user_id % 9 <> 0 THEN max(ts) END AS last_run, CASE WHEN user_id % 10 = 0 THEN {_NOW} - to_seconds((user_id * 60 % 7200)::INT) END AS locked_at FROM events GROUP BY user_id)
SELECT name, (last_run IS NULL OR floor(epoch({_NOW})) - floor(epoch(last_run)) >= every) AND (locked_at IS NULL OR epoch({_NOW}) - epoch(locked_at) > 3600) AS due FROM s""",
    "ingest_batch": f"""{_R}, {b.NOISY_SQL}, kept AS (SELECT *, {_HASH} AS hash FROM noisy WHERE id % 97 <> 0 AND id % 89 <> 0 AND id % 83 <> 0),
owned AS (SELECT *, CASE type WHEN 'skill' THEN 'skills/' || substr(replace(lower(title), ' ', '-'), 1, 64) WHEN 'daily' THEN 'daily/' || strftime(created, '%Y-%m-%d') ELSE 'other/' || id::VARCHAR END || '.md' AS place
  FROM kept QUALIFY row_number() OVER (PARTITION BY hash ORDER BY id) = 1),
first AS (SELECT * FROM owned QUALIFY row_number() OVER (PARTITION BY place ORDER BY id DESC) = 1)
SELECT CASE WHEN starts_with(place, 'other/') THEN '' ELSE place END AS place, type, md5(body) AS digest, title, round({_SEED} + 0.3::DOUBLE * ((1.0::DOUBLE - 0.5::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, (epoch_us({_NOW}) - epoch_us(created))::DOUBLE / 86400000000.0::DOUBLE / 90.0::DOUBLE))) - 0.5::DOUBLE) - CASE WHEN length(body) < 100 THEN 0.1::DOUBLE ELSE 0 END)), 8) AS importance,
  CASE WHEN id % 73 = 0 OR id % 79 = 0 THEN {_NOW} + to_days(28) END AS valid_to, source FROM first""",
}
