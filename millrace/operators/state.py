"""State transitions as joins: queue, embedding state, deletions, roots, caches and stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import AUTHORED_TYPES

# Fixed values.
LEASE_SECONDS, MAX_RETRIES, VALVE_LEAST, VALVE_SHARE = 300, 5, 10, 0.5
STALE_LOCK_SECONDS, MAX_ATTEMPTS, COOLDOWN_HOURS = 3600, 3, 24


def needs_embedding(records: DataFrame, state: DataFrame, signature: str | None = None) -> DataFrame:
    """(id, needed): no state, no hash, another hash or another signature. records: id, body_hash; state: id, body_hash, signature."""
    kept = state.select("id", F.col("body_hash").alias("_hash"), F.col("signature").alias("_signature"))
    rows = records.select("id", "body_hash").join(kept, "id", "left")
    other = F.lit(False) if signature is None else F.coalesce(F.col("_signature") != signature, F.lit(False))
    return rows.select("id", (F.col("_hash").isNull() | (F.col("_hash") != F.col("body_hash")) | other).alias("needed"))


def missing_state(chunks: DataFrame, state: DataFrame) -> DataFrame:
    """Records that have vectors but no embedding state."""
    return chunks.select("id").distinct().join(state.select("id"), "id", "left_anti")


def enqueued(queue: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """The queue with ids added anew; a known id starts over."""
    text = F.lit(None).cast("string")
    fresh = ids.select("id", now.alias("enqueued_at"), F.lit(0).alias("retries"), text.alias("last_error"), F.lit(False).alias("failed"), F.lit(None).cast("timestamp").alias("claimed_at"), text.alias("claimed_by"))
    return queue.join(ids.select("id"), "id", "left_anti").select(*fresh.columns).unionByName(fresh)


def queue_stats(queue: DataFrame) -> DataFrame:
    return queue.agg(F.count_if(~F.col("failed")).alias("pending"), F.count_if("failed").alias("failed"), F.count(F.lit(1)).alias("total"))


def _claimable(now: Column, lease: int) -> Column:
    return ~F.col("failed") & (F.col("claimed_at").isNull() | (F.col("claimed_at") < now - F.make_dt_interval(secs=F.lit(lease))))


def claimed(queue: DataFrame, limit: int, claimant: str, now: Column, lease: int = LEASE_SECONDS) -> DataFrame:
    """The queue after one claim: the oldest `limit` free rows, or rows whose lease ran out, belong to the claimant."""
    taken = queue.where(_claimable(now, lease)).orderBy("enqueued_at", "retries", "id").limit(limit).select("id", F.lit(True).alias("_taken"))
    rows = queue.join(taken, "id", "left")
    return rows.withColumn("claimed_at", F.when(F.col("_taken"), now).otherwise(F.col("claimed_at"))).withColumn("claimed_by", F.when(F.col("_taken"), F.lit(claimant)).otherwise(F.col("claimed_by"))).drop("_taken")


def dequeued(queue: DataFrame, done: DataFrame) -> DataFrame:
    """The queue without rows done under the same enqueued_at; what was enqueued again meanwhile stays."""
    return queue.join(done.select("id", "enqueued_at"), ["id", "enqueued_at"], "left_anti")


def with_errors(queue: DataFrame, errors: DataFrame, most: int = MAX_RETRIES) -> DataFrame:
    """The queue after failures (id, error): one more retry, failed at `most`, the claim released."""
    rows = queue.join(errors.select("id", F.substring("error", 1, 500).alias("_error")), "id", "left")
    hit = F.col("_error").isNotNull()
    return (
        rows.withColumn("retries", F.col("retries") + hit.cast("int"))
        .withColumn("failed", F.when(hit, F.col("retries") >= most).otherwise(F.col("failed")))
        .withColumn("last_error", F.coalesce("_error", "last_error"))
        .withColumn("claimed_at", F.when(~hit, F.col("claimed_at")))
        .withColumn("claimed_by", F.when(~hit, F.col("claimed_by")))
        .drop("_error")
    )


def released_failures(queue: DataFrame) -> DataFrame:
    return queue.withColumn("retries", F.when(F.col("failed"), F.lit(0)).otherwise(F.col("retries"))).withColumn("failed", F.lit(False))


def backoff_seconds(failures: Column, idle: float = 1.0, most: float = 60.0) -> Column:
    return F.least(F.lit(most), F.lit(idle) * F.pow(F.lit(2.0), failures - 1))


def _valve(dead: Column, total: Column, share: float = VALVE_SHARE) -> Column:
    return dead > F.greatest(F.lit(VALVE_LEAST), F.floor(total * F.lit(share)))


def prune_missing(index: DataFrame, present: DataFrame, share: float | None = VALVE_SHARE) -> DataFrame:
    """(id, path, blocked): index rows whose file is gone; blocked if so many are that a mount may be missing."""
    gone = index.select("id", "path").join(present.select("path"), "path", "left_anti")
    if share is None:
        return gone.select("id", "path", F.lit(False).alias("blocked"))
    counts = index.agg(F.count(F.lit(1)).alias("_total")).crossJoin(gone.agg(F.count(F.lit(1)).alias("_gone")))
    return gone.crossJoin(F.broadcast(counts)).select("id", "path", _valve(F.col("_gone"), F.col("_total"), share).alias("blocked"))


def owning_root(refs: DataFrame, roots: DataFrame) -> DataFrame:
    """refs with the longest configured root that contains them, or null. Roots are few; refs are cut at each level instead of compared with all."""
    levels = F.transform(F.sequence(F.lit(1), F.size(F.split("ref", "/"))), lambda i: F.array_join(F.slice(F.split(F.col("ref"), "/"), 1, i), "/"))
    each = refs.select("ref").distinct().select("ref", F.explode(levels).alias("root"))
    owned = each.join(roots.select("root").distinct(), "root").groupBy("ref").agg(F.max_by("root", F.length("root")).alias("root"))
    return refs.join(owned, "ref", "left")


def ref_states(mapping: DataFrame, records: DataFrame, roots: DataFrame, share: float | None = VALVE_SHARE) -> DataFrame:
    """(source, ref, id, state) of authored records' refs: live, dead, or unverified: without a root, or of one that lost more than the valve allows."""
    rows = owning_root(mapping, roots).join(records.where(F.col("type").isin(*AUTHORED_TYPES)).select("id"), "id", "left_semi")
    rows = rows.withColumn("dead", ~F.col("exists") & F.col("root").isNotNull())
    per = rows.groupBy("root").agg(F.count(F.lit(1)).alias("_total"), F.count_if("dead").alias("_dead"))
    blocked = F.lit(False) if share is None else _valve(F.col("_dead"), F.col("_total"), share)
    rows = rows.join(per.select("root", blocked.alias("_blocked")), rows.root.eqNullSafe(per.root), "left").drop(per.root)
    state = F.when(F.col("exists"), "live").when(F.col("dead") & ~F.coalesce("_blocked", F.lit(False)), "dead").otherwise("unverified")
    return rows.select("source", "ref", "id", state.alias("state"))


def verdicts(states: DataFrame) -> DataFrame:
    """(id, verdict): a tombstone if all refs are dead; with a live ref the record is restored."""
    verdict = F.when(F.max(F.col("state") == "live"), "live").when(F.max(F.col("state") == "unverified"), "unverified").otherwise("tombstone")
    return states.groupBy("id").agg(verdict.alias("verdict"))


def source_sweep(mapping: DataFrame, records: DataFrame, roots: DataFrame, share: float | None = VALVE_SHARE) -> DataFrame:
    """(id, verdict): what missing source files mean for authored records. mapping: source, ref, id, exists."""
    return verdicts(ref_states(mapping, records, roots, share))


def orphans(mapping: DataFrame, records: DataFrame) -> DataFrame:
    """Mapping rows whose record is gone."""
    return mapping.join(records.select("id"), "id", "left_anti")


def changed(batch: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows of a rescan (source, ref, hash) that are new or whose hash is not the one stored for the ref."""
    return batch.join(mapping.select("source", "ref", "hash"), ["source", "ref", "hash"], "left_anti")


def answered(requests: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of requests in a model cache; only misses go to the model."""
    return requests.join(cache, keys), requests.join(cache.select(*keys), keys, "left_anti")


def due(stages: DataFrame, now: Column) -> DataFrame:
    """stages (name, interval_seconds, last_run, locked_at) with due: the interval passed and no fresh lock."""
    elapsed = F.col("last_run").isNull() | (F.unix_seconds(now) - F.unix_seconds("last_run") >= F.col("interval_seconds"))
    free = F.col("locked_at").isNull() | (F.unix_seconds(now) - F.unix_seconds("locked_at") > STALE_LOCK_SECONDS)
    return stages.withColumn("due", elapsed & free)


def excluded_sessions(failures: DataFrame, now: Column) -> DataFrame:
    """(id): sessions that failed often enough and are not cooled down yet. failures: id, failures, last_failed."""
    fresh = F.col("last_failed") > now - F.make_dt_interval(hours=F.lit(COOLDOWN_HOURS))
    return failures.where((F.col("failures") >= MAX_ATTEMPTS) & F.coalesce(fresh, F.lit(False))).select("id")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    window = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return rows.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")
