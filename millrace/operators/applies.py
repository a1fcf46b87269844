"""What plans do when they are applied: tables after them, audit rows, tickets and counters.

Each function is a pure step from tables to tables; `Store.change` writes all of
them at once, made again from the newest state if another writer was first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hygiene, state

AUDIT = "ts timestamp, new_id string, existing_id string, verdict string, rationale string, judge string, applied boolean"
#: Headers of manifests that can be applied. Fixed values.
MANIFEST_VERSION, MANIFEST_RULES = 1, "phase1-v1"


def audit_rows(losers: DataFrame, now: Column, rationale: str, judge: str) -> DataFrame:
    """Change log of losers (id, winner_id)."""
    return losers.select(now.alias("ts"), F.col("id").cast("string").alias("new_id"), F.col("winner_id").cast("string").alias("existing_id"), F.lit("DUPLICATE").alias("verdict"), F.lit(rationale).alias("rationale"), F.lit(judge).alias("judge"), F.lit(True).alias("applied"))


def header_errors(version: object, rules: object) -> list[str]:
    """What is wrong with a manifest's header; nothing may be applied then."""
    return [f"{name} is {given!r}, not {wanted!r}" for name, given, wanted in (("version", version, MANIFEST_VERSION), ("rules", rules, MANIFEST_RULES)) if given != wanted]


def manifest_status(manifest: DataFrame, records: DataFrame) -> DataFrame:
    """manifest with `errors` of each row and `safe` for its group.

    manifest: group_key, hash, type, qualifies, role (winner or loser), id, path.
    A group is safe if it has one winner and none of its rows has an error: both
    roles need the same id at their path and the same body, losers the same type
    and no deprecation. Errors are counted, not collected, so a group may be of any size.
    """
    now = hygiene.hashed(records).select("path", F.col("id").cast("string").alias("_id"), F.col("hash").alias("_hash"), F.col("type").alias("_type"), "deprecated_by")
    rows = manifest.join(now, "path", "left")
    loser = F.col("role") != "winner"
    rules = [
        F.when(~F.coalesce("qualifies", F.lit(False)), "not marked safe"),
        F.when(F.col("type").isin(*hygiene.BLOCKED_TYPES), "blocked type"),
        F.when(F.coalesce("hash", F.lit("")) == "", "no hash"),
        F.when(F.col("id").isNull() | F.col("path").isNull(), "no id or path"),
        F.when(F.col("_id").isNull(), "missing"),
        F.when(F.col("_id") != F.col("id").cast("string"), "other id"),
        F.when(F.col("_hash") != F.col("hash"), "body changed"),
        F.when(loser & F.col("deprecated_by").isNotNull(), "deprecated"),
        F.when(loser & (F.col("_type") != F.col("type")), "type changed"),
    ]
    rows = rows.withColumn("errors", F.array_compact(F.array(*rules))).select(*manifest.columns, "errors")
    groups = rows.groupBy("group_key").agg(((F.sum(F.size("errors")) == 0) & (F.count_if(~loser) == 1)).alias("safe"))
    return rows.join(groups, "group_key")


def manifest_applied(manifest: DataFrame, records: DataFrame, now: Column, dry_run: bool = False) -> dict[str, DataFrame]:
    """records, audit (new rows), status and a one-row report; a dry run changes nothing but counts what it would."""
    status = manifest_status(manifest, records)
    won = status.where("safe and role = 'winner'").select("group_key", F.col("id").alias("winner_id"))
    planned = status.where("safe and role <> 'winner'").select("group_key", "id").join(won, "group_key").select("id", "winner_id")
    losers = planned.limit(0) if dry_run else planned
    out = records.join(losers, "id", "left")
    out = out.withColumn("deprecated_by", F.coalesce(F.col("winner_id").cast("string"), F.col("deprecated_by").cast("string"))).select(*records.columns)
    groups = status.groupBy("group_key", "safe").agg(F.count_if(F.col("role") != "winner").alias("losers"))
    counts = groups.agg(F.count(F.lit(1)).alias("groups"), F.count_if(~F.col("safe")).alias("skipped"), F.coalesce(F.sum(F.when(F.col("safe"), F.col("losers"))), F.lit(0)).alias("planned"))
    applied = F.lit(0).cast("long") if dry_run else F.col("planned")
    return {"records": out, "audit": audit_rows(losers, now, "manifest of groups with one type, source, ref and body", "phase1-apply"), "status": status, "report": counts.select("*", applied.alias("applied"), applied.alias("audit_rows"))}


def collisions_applied(records: DataFrame, won: DataFrame, now: Column) -> dict[str, DataFrame]:
    """records with losers of equal bodies deprecated, audit (new rows), and tickets for groups with a skill, which are left to review.

    won: id, is_winner, winner_id as `hygiene.winners` returns them.
    """
    skilled = won.join(records.where("type = 'skill'").select("id"), "id", "left_semi").select("winner_id").distinct()
    losers = won.where("not is_winner").join(skilled, "winner_id", "left_anti").join(records.where("deprecated_by is null").select("id"), "id", "left_semi").select("id", "winner_id")
    sizes = won.join(skilled, "winner_id", "left_semi").groupBy("winner_id").agg(F.count(F.lit(1)).alias("size"))
    name = F.col("winner_id").cast("string")
    tickets = sizes.select(F.concat(F.lit("skills/_review/dedup-"), name, F.lit(".md")).alias("path"), name.alias("winner_id"), "size", F.concat(F.lit("# Equal skills\n\nKeep: "), name, F.lit("\n\nRecords with this body: "), F.col("size").cast("string"), F.lit("\n")).alias("body"))
    return {"records": hygiene.deprecate_losers(records, won), "audit": audit_rows(losers, now, "equal bodies found afterwards", "layer1-retro"), "tickets": tickets}


def sweep_applied(mapping: DataFrame, records: DataFrame, roots: DataFrame, now: Column, share: float | None = state.VALVE_SHARE) -> dict[str, DataFrame]:
    """records and mapping after a sweep for deleted source files, and a one-row report.

    Records whose refs are all dead get a deletion mark, unless they have one;
    those with a live ref lose it. Dead refs go in either case, unverified ones
    stay, and refs of records that are gone go first. mapping: source, ref, id, exists.
    """
    known = mapping.join(records.select("id"), "id", "left_semi")
    states = state.ref_states(known, records, roots, share)
    found = state.verdicts(states)
    rows = records.join(found, "id", "left")
    mark = F.when((F.col("verdict") == "tombstone") & F.col("deleted_at").isNull(), now).when(F.col("verdict") == "live", F.lit(None).cast("timestamp")).otherwise(F.col("deleted_at"))
    kept = known.join(states.where("state = 'dead'").select("source", "ref", "id"), ["source", "ref", "id"], "left_anti").select(*mapping.columns)
    marks = rows.agg(F.count_if((F.col("verdict") == "tombstone") & F.col("deleted_at").isNull()).alias("tombstoned"), F.count_if((F.col("verdict") == "live") & F.col("deleted_at").isNotNull()).alias("restored"))
    dropped = states.agg(F.count_if(F.col("state") == "dead").alias("dead_refs"), F.count_if(F.col("state") == "unverified").alias("unverified_refs"))
    orphaned = state.orphans(mapping, records).agg(F.count(F.lit(1)).alias("orphans"))
    return {"records": rows.withColumn("deleted_at", mark).select(*records.columns), "mapping": kept, "report": marks.crossJoin(dropped).crossJoin(orphaned)}
