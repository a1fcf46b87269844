"""Ingest as set operations: noise, seeds, coercion, paths, exact dedup and upsert."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..model import AUTHORED_TYPES, ID_NAMESPACE, SEED_WEIGHTS, SKILL_REQUIRED, TRANSIENT_DAYS, TYPES
from ..session import cut

# Patterns of noise, in the order in which they are tried.
HEARTBEAT = (r"(?m)^\s*HEARTBEAT_OK\s*$", r"(?im)^\s*\[heartbeat\]")
CRON = (r"(?i)__openclaw_[a-z_]*dream__", r"(?im)^Running cron job:")
AUTOMATION = r"(?i)(?:^|[/\\.])(?:heartbeat|monitoring|pm2[/\\]+logs|cron[/\\]+logs|automation)(?:/|\\)"
TRANSIENT = (
    r"(?i)\b(?:deploy(?:ing)?|ship(?:ping)?|fix(?:ing)?|merge|merging|release|releasing|land(?:ing)?|push(?:ing)?)\b[^.\n]{0,40}\bby\b\s+"
    r"(?:tomorrow|today|tonight|mon(?:day)?|tues?(?:day)?|wed(?:nesday)?|thur?s?(?:day)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?"
    r"|eo[dw]|end\s+of\s+(?:day|week|sprint)|next\s+(?:week|sprint))"
)
DUMP_SHARE, DUMP_LINES, DUMP_CHARS, HEAD_BYTES = 0.8, 6, 200, 1024


def is_heartbeat(body: Column) -> Column:
    return body.rlike(HEARTBEAT[0]) | body.rlike(HEARTBEAT[1])


def is_cron_output(body: Column) -> Column:
    return body.rlike(CRON[0]) | body.rlike(CRON[1])


def is_tool_dump(body: Column) -> Column:
    """At least 200 characters and 6 lines, four fifths of which begin as JSON does."""
    lines = F.filter(F.split(body, r"\R"), lambda line: F.trim(line) != "")
    shaped = F.size(F.filter(lines, lambda line: line.rlike(r'^\s*[{}\[\]"]')))
    return (F.char_length(body) >= DUMP_CHARS) & (F.size(lines) >= DUMP_LINES) & (shaped / F.greatest(F.size(lines), F.lit(1)) >= DUMP_SHARE)


def is_transient_task(body: Column) -> Column:
    return body.rlike(TRANSIENT)


def is_automation_log(ref: Column) -> Column:
    return ref.rlike(AUTOMATION)


def head_hash(body: Column) -> Column:
    """Hash of the first bytes, by which copies of system prompts are known."""
    return F.sha2(F.substring(F.encode(body, "UTF-8"), 1, HEAD_BYTES), 256)


def noise_decisions(records: DataFrame, known_heads: DataFrame | None = None) -> DataFrame:
    """records with action (keep, drop, tag_transient), kind and ttl_days; the first match wins.

    records has body and ref; known_heads has one column, head.
    """
    rows = records.withColumn("_head", head_hash(F.col("body")))
    if known_heads is None:
        rows = rows.withColumn("_echo", F.lit(False))
    else:
        echoes = known_heads.select(F.col("head").alias("_head")).distinct().withColumn("_echo", F.lit(True))
        rows = rows.join(echoes, "_head", "left").withColumn("_echo", F.coalesce("_echo", F.lit(False)))
    body, ref = F.col("body"), F.col("ref")
    kind = (
        F.when(is_heartbeat(body), "heartbeat")
        .when(is_cron_output(body), "cron_output")
        .when(is_tool_dump(body), "tool_dump")
        .when(F.col("_echo"), "boot_echo")
        .when(is_automation_log(ref), "automation_log")
        .when(is_transient_task(body), "transient_task")
    )
    rows = rows.withColumn("kind", kind).drop("_head", "_echo")
    transient = F.col("kind").isin("automation_log", "transient_task")
    action = F.when(F.col("kind").isNull(), "keep").when(transient, "tag_transient").otherwise("drop")
    return rows.withColumn("action", action).withColumn("ttl_days", F.when(transient, F.lit(TRANSIENT_DAYS)))


def _by_type(type_: Column, weights: Mapping[str, float], other: float) -> Column:
    out = F.lit(other)
    for name, weight in weights.items():
        out = F.when(type_ == name, F.lit(weight)).otherwise(out)
    return out


def importance_seed(type_: Column, length: Column, created: Column, now: Column) -> Column:
    """Weight of the type, raised by up to 0.15 for records of the last 90 days, less 0.1 for short bodies."""
    age = (F.unix_micros(now) - F.unix_micros(created)) / 86_400_000_000.0
    recency = 1.0 - 0.5 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), age / 90.0))
    seed = _by_type(type_, SEED_WEIGHTS, 0.5) + 0.3 * (recency - 0.5) - F.when(length < 100, F.lit(0.1)).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.1), seed))


def coerced(rows: DataFrame, now: Column) -> DataFrame:
    """Raw headers (id, type, created, updated, source, title, scope, verification as strings, tags, path) made valid.

    An unknown type becomes memory and stays as a tag; bad dates become now, or
    created; a bad id becomes the UUID of the path; a missing source becomes
    agent; a skill without its required fields becomes a memory.
    """
    given = F.col("type")
    known = F.coalesce(given.isin(*TYPES), F.lit(False))
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    label = ~known & (F.coalesce(given, F.lit("")) != "") & ~F.array_contains(tags, F.coalesce(given, F.lit("")))
    created = F.coalesce(F.try_to_timestamp("created"), now)
    uuid = F.lower(F.col("id")).rlike("^[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}$")
    complete = F.lit(True)
    for name in SKILL_REQUIRED:
        complete = complete & (F.coalesce(F.col(name), F.lit("")) != "")
    return (
        rows.withColumn("tags", F.when(label, F.array_append(tags, given)).otherwise(tags))
        .withColumn("type", F.when(~known, "memory").when((given == "skill") & ~complete, "memory").otherwise(given))
        .withColumn("_created", created)
        .withColumn("updated", F.coalesce(F.try_to_timestamp("updated"), F.col("_created")))
        .withColumn("created", F.col("_created"))
        .drop("_created")
        .withColumn("id", F.when(F.coalesce(uuid, F.lit(False)), F.col("id")).otherwise(text.uuid5(ID_NAMESPACE, F.col("path"))))
        .withColumn("source", F.when(F.coalesce("source", F.lit("")) == "", "agent").otherwise(F.col("source")))
    )


def problems(rows: DataFrame) -> DataFrame:
    """rows with an array of the rules that a header breaks; empty means valid."""
    importance = F.col("importance")
    rules = [
        F.when(~F.coalesce(F.col("type").isin(*TYPES), F.lit(False)), "type"),
        F.when(importance.isNotNull() & ~importance.between(0.0, 1.0), "importance"),
        *[F.when((F.col("type") == "skill") & (F.coalesce(F.col(c), F.lit("")) == ""), c) for c in SKILL_REQUIRED],
    ]
    return rows.withColumn("problems", F.array_compact(F.array(*rules)))


def agent_of(tags: Column) -> Column:
    named = F.filter(F.transform(F.filter(tags, lambda t: t.startswith("agent:")), lambda t: F.trim(F.substring(t, 7, 10_000))), lambda t: t != "")
    return F.try_element_at(named, F.lit(1))


def vault_path(type_: Column, id_: Column, title: Column, source: Column, tags: Column, created: Column, session_id: Column, daily_date: Column, daily_scope: Column) -> Column:
    """Where a record lives, by type, agent, slug, session, date and scope."""
    agent = agent_of(tags)
    slug = F.substring(F.replace(F.lower(F.coalesce(F.nullif(title, F.lit("")), id_)), F.lit(" "), F.lit("-")), 1, 64)
    day = F.when(daily_date.rlike(r"^\d{4}-\d{2}-\d{2}$"), daily_date).otherwise(F.date_format(created, "yyyy-MM-dd"))
    parts = F.filter(F.split(daily_scope, "/"), lambda s: s != "")
    bad = F.exists(parts, lambda s: s.isin(".", "..") | s.startswith("_") | F.contains(s, F.lit("\\")) | F.contains(s, F.lit(":")))
    scope = F.when((F.size(parts) > 0) & ~bad, F.array_join(parts, "/"))
    path = (
        F.when(type_ == "skill", F.concat_ws("/", F.lit("skills"), agent, slug))
        .when(type_ == "session", F.concat_ws("/", F.lit("sessions"), F.coalesce(F.nullif(session_id, F.lit("")), id_)))
        .when(type_ == "daily", F.concat_ws("/", F.lit("daily"), agent, scope, day))
        .otherwise(F.concat_ws("/", F.lit("memories"), source, agent, id_))
    )
    return F.concat(path, F.lit(".md"))


def is_reserved(path: Column) -> Column:
    return path.rlike("(^|/)_")


def first_bodies(rows: DataFrame, arrival: str = "arrival_seq", known: DataFrame | None = None) -> DataFrame:
    """(hash, id, seen_count): the first record to bring a normalized body owns it; later ones are counted.

    Bodies in `known` (one column, hash) have owners already and bring none.
    """
    hashed = rows.select("id", arrival, text.normalized_hash(F.col("body")).alias("hash"))
    if known is not None:
        hashed = hashed.join(known.select("hash"), "hash", "left_anti")
    return hashed.groupBy("hash").agg(F.min_by("id", F.struct(arrival, "id")).alias("id"), F.count(F.lit(1)).alias("seen_count"))


def last_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    window = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return rows.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")


def upserted(old: DataFrame, new: DataFrame, key: str = "id", slot: str | None = "path", order: list[str] | None = None) -> DataFrame:
    """old with new rows in place of those of equal key, or of equal slot; no MERGE is needed.

    Of new rows of one key the last by `order` (columns of new; the key breaks ties)
    is taken, and then of one slot, as if they had come in turn; so keys and slots are unique.
    """
    order = [*(order or []), key]
    # Of a key all columns break ties, so the choice is the same in every run.
    new = last_of(new, [key], [*order, *sorted(c for c in new.columns if c not in order)])
    if slot:
        new = last_of(new, [slot], order)
    kept = old.join(new.select(key), key, "left_anti")
    if slot:
        kept = kept.join(new.select(slot), slot, "left_anti")
    return kept.select(*old.columns).unionByName(new.select(*old.columns))


def cascaded(tables: Mapping[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Child tables (each with the column id, or memory_id) without the rows of records that are gone."""
    out = {}
    for name, rows in tables.items():
        key = "memory_id" if "memory_id" in rows.columns else "id"
        out[name] = rows.join(gone.select(F.col("id").alias(key)), key, "left_anti")
    return out


def removed(rows: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(keys.select(key), key, "left_anti")


def with_header(rows: DataFrame, existing: DataFrame, now: Column) -> DataFrame:
    """New source records (id, type, body, created, importance, ttl_days) with what survives of existing ones.

    Importance is the record's own, else the existing, else the seed; a time to
    live gives a new valid_to, else the existing stays; deprecation stays, a
    deletion mark does not.
    """
    before = existing.select("id", *[F.col(c).alias(f"_{c}") for c in ("importance", "valid_to", "deprecated_by", "valid_from")])
    out = rows.join(before, "id", "left")
    seed = importance_seed(F.col("type"), F.char_length("body"), F.col("created"), now)
    out = out.withColumn("importance", F.coalesce("importance", "_importance", seed))
    out = out.withColumn("valid_to", F.coalesce(F.when(F.col("ttl_days").isNotNull(), now + F.make_dt_interval(F.col("ttl_days"))), F.col("_valid_to")))
    out = out.withColumn("deprecated_by", F.col("_deprecated_by")).withColumn("valid_from", F.col("_valid_from"))
    return out.withColumn("deleted_at", F.lit(None).cast("timestamp")).drop("_importance", "_valid_to", "_deprecated_by", "_valid_from")


def body_hashes(records: DataFrame) -> DataFrame:
    """(hash, id, seen_count): who owns which normalized body, for a store that kept no such table."""
    hashed = records.select("id", text.normalized_hash(F.col("body")).alias("hash"))
    return hashed.groupBy("hash").agg(F.min("id").alias("id"), F.lit(1).cast("long").alias("seen_count"))


def _details(batch: DataFrame) -> DataFrame:
    """batch with session_id, daily_date, daily_scope and scope, from its columns or its metadata; a daily's date also from its file's name."""
    for name in ("session_id", "daily_date", "daily_scope", "scope"):
        found = [F.col(name)] if name in batch.columns else []
        found += [F.col("metadata")[name]] if "metadata" in batch.columns else []
        batch = batch.withColumn(name, F.coalesce(*found, F.lit(None).cast("string")))
    named = F.nullif(F.regexp_extract("ref", r"(?:^|/)(\d{4}-\d{2}-\d{2})(?:\.[^./]*)?$", 1), F.lit(""))
    return batch.withColumn("daily_date", F.coalesce("daily_date", named))


def ingested(batch: DataFrame, records: DataFrame, source_map: DataFrame, now: Column, known_heads: DataFrame | None = None, hashes: DataFrame | None = None) -> dict[str, DataFrame]:
    """One batch of source records through the whole chain, as set operations.

    batch: arrival_seq, source, ref, type, title, body, tags, created, updated, and
    where known metadata or session_id, daily_date, daily_scope, scope.
    records: the current table; source_map: source, ref, id, hash; hashes: hash, id,
    seen_count. Returns all three after it, the ids that lost their path to another
    record (`displaced`; their child rows must go), and the decisions made.

    The last row of each (source, ref) counts. Noise is dropped. A known ref rewrites
    its record, which keeps its path; if several refs of one record change, the last
    to arrive is its body. A body belongs to one record: one that a record had before
    the batch is that record's, unless the record gives it up in the batch; a new
    one is that of the first to arrive. A known ref that brings another record's body
    changes nothing; a new one is mapped to that record if it is authored. Of records
    with one path the last to arrive stays.
    """
    rows = last_of(_details(batch), ["source", "ref"], ["arrival_seq"])
    rows = noise_decisions(rows, known_heads).withColumn("hash", text.normalized_hash(F.col("body")))
    kept = rows.where("action != 'drop'").join(source_map.select("source", "ref", F.col("id").alias("_id")), ["source", "ref"], "left")
    kept = kept.withColumn("id", F.coalesce("_id", text.uuid5(ID_NAMESPACE, F.concat_ws(":", "source", "ref")))).withColumn("known", F.col("_id").isNotNull())
    kept = cut(kept)  # noise, hashes and ids are found once
    hashes = body_hashes(records) if hashes is None else hashes
    held = hashes.select("hash", F.col("id").alias("_holder"))

    # What each record is to become: the last of its refs.
    slim = kept.select("source", "ref", "id", "hash", "arrival_seq", "known", "type")
    latest = cut(last_of(slim, ["id"], ["arrival_seq", "source", "ref"]).join(held, "hash", "left"))
    # A body that nobody had: the first to bring it.
    claims = latest.where("_holder is null").groupBy("hash").agg(F.min_by("id", F.struct("arrival_seq", "id")).alias("_owner"))
    latest = cut(latest.join(claims, "hash", "left"))
    moved = latest.where("_owner = id").select("id")
    # A body that a record had before and gives up: the first new ref to bring it.
    left_ = held.join(moved.withColumnRenamed("id", "_holder"), "_holder", "left_semi").select("hash", F.lit(True).alias("_free"))
    latest = cut(latest.join(left_, "hash", "left"))
    heirs = latest.where("_free and not known and _holder != id").groupBy("hash").agg(F.min_by("id", F.struct("arrival_seq", "id")).alias("_heir"))
    # A record that rewrites itself with the body it has gives up nothing.
    owner = F.coalesce("_owner", F.when(F.col("_free") & (F.col("_holder") != F.col("id")), F.coalesce("_heir", "_holder")), "_holder")
    owners = cut(latest.join(heirs, "hash", "left").select("source", "ref", "id", "hash", owner.alias("_owner")))
    own = kept.join(owners.where("_owner = id").select("source", "ref"), ["source", "ref"], "left_semi")

    fresh = with_header(own.withColumn("importance", F.lit(None).cast("double")), records, now)
    fresh = fresh.join(records.select("id", F.col("path").alias("_path")), "id", "left")
    placed = vault_path(F.col("type"), F.col("id"), F.col("title"), F.col("source"), F.col("tags"), F.col("created"), F.col("session_id"), F.col("daily_date"), F.col("daily_scope"))
    fresh = fresh.withColumn("path", F.coalesce("_path", placed))
    after = upserted(records, fresh.select(*records.columns, "arrival_seq"), order=["arrival_seq"])
    there = cut(after.select("id"))
    displaced = records.select("id").unionByName(fresh.select("id")).distinct().join(there, "id", "left_anti")

    # Whose body each ref brought. A known ref stays with its record; a new, authored one goes to the owner of its body.
    by_hash = owners.groupBy("hash").agg(F.first("_owner").alias("_owner"))
    taken = slim.join(by_hash, "hash", "left").join(held, "hash", "left").withColumn("_owner", F.coalesce("_owner", "_holder", "id"))
    target = F.when(F.col("known"), F.col("id")).otherwise(F.col("_owner"))
    rewritten = own.select("id", "hash", F.lit(1).cast("long").alias("seen_count"))
    mapped = taken.join(rewritten.select("id", F.lit(True).alias("_changed")), "id", "left").where("known and _changed or not known and _owner = id" + "".join(f" or not known and type = '{t}'" for t in AUTHORED_TYPES))
    mapped = mapped.select("source", "ref", target.alias("id"), "hash")
    mapping = source_map.join(mapped, ["source", "ref"], "left_anti").select(*mapped.columns).unionByName(mapped).join(there, "id", "left_semi").select(*mapped.columns)

    # Bodies with their owners, and how often each came: once with its owner, and with each ref that brought it for another record.
    stale = hashes.join(rewritten.select("id"), "id", "left_anti").join(rewritten.select("hash"), "hash", "left_anti")
    same = rewritten.join(hashes.select("hash", "id", F.col("seen_count").alias("_before")), ["hash", "id"], "left").select("hash", "id", F.coalesce("_before", "seen_count").alias("seen_count"))
    again = taken.where("_owner <> id").groupBy("hash").agg(F.count(F.lit(1)).alias("_again"))
    counted = stale.select("hash", "id", "seen_count").unionByName(same).join(there, "id", "left_semi").join(again, "hash", "left")
    counted = counted.select("hash", "id", (F.col("seen_count") + F.coalesce("_again", F.lit(0))).alias("seen_count"))
    return {"records": after, "source_map": mapping, "hashes": counted, "displaced": displaced, "decisions": rows.select("source", "ref", "action", "kind")}
