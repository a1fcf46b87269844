"""Hygiene analytics: duplicates, usage, clusters, projects, sessions and reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..model import NEUTRAL_IMPORTANCE
from ..session import cut

# Fixed values.
LOW_RISK_TYPES = ("memory", "session", "daily", "person", "decision")
DERIVED_TYPES = ("project", "distillation")
BLOCKED_TYPES = ("skill", "project", "distillation")
GET_BUMP, SEARCH_BUMP, RECENT_DAYS, MOST_PER_RUN = 0.05, 0.01, 30, 0.1
NOT_PROJECTS = ("instructions", "core", "shared")
NOT_PROJECT_PREFIXES = ("agent:", "topic:", "distillation:", "project:")
MIN_TURNS, MIN_WORDS, SESSION_DAYS, MIN_CLUSTER, MIN_SESSIONS = 10, 100, 30, 5, 2
MOST_PER_CYCLE = 50


# Duplicates


def hashed(records: DataFrame) -> DataFrame:
    return records.withColumn("hash", text.normalized_hash(F.col("body")))


def collision_groups(records: DataFrame) -> DataFrame:
    """(hash, size): normalized bodies that two or more undeprecated records share."""
    return hashed(records.where("deprecated_by is null")).groupBy("hash").agg(F.count(F.lit(1)).alias("size")).where("size > 1")


def retrieval_counts(log: DataFrame) -> DataFrame:
    return log.groupBy(F.col("memory_id").alias("id")).agg(F.count(F.lit(1)).alias("retrievals"))


def winners(records: DataFrame, log: DataFrame, key: str = "hash") -> DataFrame:
    """(key, id, is_winner, winner_id, coin_flip, size) of the members of each group of two or more.

    records has `key`. Importance decides, then retrievals, then the newer
    update, then the least id; a coin flip is a group where only the id decided.
    Aggregates by group, so a huge group is no window.
    """
    rows = records.join(retrieval_counts(log), "id", "left")
    signal = F.struct(
        (-F.coalesce("importance", F.lit(NEUTRAL_IMPORTANCE))).alias("a"),
        (-F.coalesce("retrievals", F.lit(0))).alias("b"),
        (-F.coalesce(F.unix_micros("updated"), F.lit(0))).alias("c"),
    )
    rows = rows.withColumn("_signal", signal)
    groups = rows.groupBy(key).agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("_signal", "id"))["id"].alias("winner_id"), (F.min("_signal") == F.max("_signal")).alias("coin_flip")).where("size > 1")
    return rows.join(groups, key).select(key, "id", (F.col("id") == F.col("winner_id")).alias("is_winner"), "winner_id", "coin_flip", "size")


def audit(records: DataFrame) -> DataFrame:
    """(class, group_key, size): the eight classes of duplicate candidates, which may overlap.

    records has id, type, title, ref, body, deprecated_by. Class A: one low-risk
    type with equal bodies, D: with equal titles, too; B: equal ref and body; C:
    equal ref, other bodies; E: equal title, other bodies, not only dailies; F:
    several types; G: with a skill; H: derived types.
    """
    rows = hashed(records.where("deprecated_by is null")).withColumn("norm_title", text.normalized_title(F.col("title")))
    size = F.count(F.lit(1)).alias("size")
    bodies = rows.groupBy("hash").agg(size, F.collect_set("type").alias("types"), F.min("norm_title").alias("low"), F.max("norm_title").alias("high"), F.count("norm_title").alias("titled")).where("size > 1")
    only = F.element_at("types", 1)
    routed = F.when(F.array_contains("types", "skill"), "G").when(F.size("types") > 1, "F").when(only.isin(*DERIVED_TYPES), "H").when(only.isin(*LOW_RISK_TYPES), "A").otherwise("F")
    bodies = bodies.withColumn("class", routed)
    confirmed = bodies.where("class = 'A' and low = high and titled = size").withColumn("class", F.lit("D"))
    by_ref_body = rows.where("coalesce(ref, '') != ''").groupBy("ref", "hash").agg(size).where("size > 1").select(F.lit("B").alias("class"), F.concat_ws("|", "ref", "hash").alias("group_key"), "size")

    def differing(key: str, label: str, extra: Column) -> DataFrame:
        groups = rows.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(size, F.min("hash").alias("low"), F.max("hash").alias("high"), F.min("type").alias("t0"), F.max("type").alias("t1"))
        return groups.where((F.col("size") > 1) & (F.col("low") != F.col("high")) & extra).select(F.lit(label).alias("class"), F.col(key).alias("group_key"), "size")

    parts = [bodies.select("class", F.col("hash").alias("group_key"), "size"), confirmed.select("class", F.col("hash").alias("group_key"), "size"), by_ref_body, differing("ref", "C", F.lit(True)), differing("norm_title", "E", (F.col("t0") != "daily") | (F.col("t1") != "daily"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def audit_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("class").agg(F.count(F.lit(1)).alias("groups"), F.sum("size").alias("records"))


def phase1(records: DataFrame, log: DataFrame) -> DataFrame:
    """(hash, winner_id, size, reasons): groups of equal ref and body with the rules they fail; none means safe to merge."""
    rows = hashed(records).where("coalesce(ref, '') != ''").withColumn("group_key", F.concat_ws("|", "ref", "hash"))
    won = winners(rows, log, "group_key").groupBy("group_key").agg(F.first("winner_id").alias("winner_id"), F.first("coin_flip").alias("coin_flip"))
    groups = rows.groupBy("group_key").agg(
        F.count(F.lit(1)).alias("size"),
        F.collect_set("type").alias("types"),
        F.count_distinct("source").alias("sources"),
        F.count("source").alias("sourced"),
        F.max(F.col("deprecated_by").isNotNull()).alias("deprecated"),
    )
    only = F.element_at("types", 1)
    rules = [
        F.when(F.size("types") > 1, "mixed types").when(only.isin(*BLOCKED_TYPES), "blocked type"),
        F.when((F.col("sources") != 1) | (F.col("sourced") != F.col("size")), "mixed or missing source"),
        F.when(F.col("deprecated"), "contains a deprecated record"),
        F.when(F.col("coin_flip"), "coin flip"),
    ]
    return groups.where("size > 1").join(won, "group_key").select("group_key", "winner_id", "size", F.array_compact(F.array(*rules)).alias("reasons"))


def drifted(manifest: DataFrame, records: DataFrame) -> DataFrame:
    """manifest (id, hash, type) with what no longer matches the current records; none means safe to apply."""
    now = hashed(records).select("id", F.col("hash").alias("_hash"), F.col("type").alias("_type"), "deprecated_by")
    rows = manifest.join(now, "id", "left")
    rules = [
        F.when(F.col("_hash").isNull(), "missing"),
        F.when(F.col("_hash") != F.col("hash"), "body changed"),
        F.when(F.col("_type") != F.col("type"), "type changed"),
        F.when(F.col("deprecated_by").isNotNull(), "deprecated"),
    ]
    return rows.select("id", F.array_compact(F.array(*rules)).alias("mismatches"))


def deprecate_losers(records: DataFrame, won: DataFrame) -> DataFrame:
    """records with losers of undisputed groups pointing to their winner; groups that any skill is in are left to review."""
    skilled = won.join(records.where("type = 'skill'").select("id"), "id", "left_semi").select("winner_id").distinct()
    losers = won.where("not is_winner").join(skilled, "winner_id", "left_anti").select("id", "winner_id")
    out = records.join(losers, "id", "left")
    apply = F.col("winner_id").isNotNull() & F.col("deprecated_by").isNull()
    return out.withColumn("deprecated_by", F.when(apply, F.col("winner_id").cast("string")).otherwise(F.col("deprecated_by").cast("string"))).drop("winner_id")


def noise_plan(records: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """The decisions on records that are neither deprecated nor expired: only these are searched for noise afterwards."""
    active = records.where(F.col("deprecated_by").isNull() & (F.col("valid_to").isNull() | (F.col("valid_to") > now)))
    return decisions.join(active.select("id"), "id", "left_semi")


def expire_noise(records: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """records with valid_to set for noise: now for what would be dropped, after its time to live for the transient."""
    ends = noise_plan(records, decisions, now).where("action != 'keep'").select("id", (now + F.make_dt_interval(F.coalesce("ttl_days", F.lit(0)))).alias("_end"))
    out = records.join(ends, "id", "left")
    return out.withColumn("valid_to", F.coalesce("_end", "valid_to")).drop("_end")


# Usage


def bumps(log: DataFrame, records: DataFrame, now: Column, cursor: int = -1) -> DataFrame:
    """(id, gets, searches, old_importance, new_importance): what exposures after the cursor add, at most 0.1."""
    age = (F.unix_micros(now) - F.unix_micros(F.col("ts").cast("timestamp"))) / 86_400_000_000.0
    fresh = F.when(age <= RECENT_DAYS, 1.0).otherwise(0.5)
    weight = F.when(F.col("kind") == "get", F.lit(GET_BUMP)).when((F.col("kind") == "search") & (F.col("rank") >= 1), F.lit(SEARCH_BUMP) / F.col("rank")).otherwise(0.0) * fresh
    summed = log.where(F.col("id") > cursor).groupBy("memory_id").agg(F.sum(weight).alias("raw"), F.count_if(F.col("kind") == "get").alias("gets"), F.count_if((F.col("kind") == "search") & (F.col("rank") >= 1)).alias("searches")).where("raw > 0")
    eligible = records.where(F.col("deprecated_by").isNull() & (F.col("valid_to").isNull() | (F.col("valid_to") > now)))
    old = F.coalesce("importance", F.lit(NEUTRAL_IMPORTANCE))
    joined = summed.join(eligible, summed.memory_id == eligible.id).withColumn("old_importance", old)
    new = F.least(F.lit(1.0), F.col("old_importance") + F.least(F.lit(MOST_PER_RUN), F.col("raw")))
    return joined.withColumn("new_importance", new).where("new_importance > old_importance").select("id", "gets", "searches", "old_importance", "new_importance")


def pruned_log(log: DataFrame, most: int, keep_share: float = 0.9) -> DataFrame:
    """The newest int(most * keep_share) rows once there are more than `most`; the least id kept comes from a top-k, not a window."""
    target = int(most * keep_share)
    if log.count() <= most:
        return log
    least = log.select("id").orderBy(F.col("id").desc()).limit(target).agg(F.min("id").alias("least"))
    return log.join(F.broadcast(least), F.col("id") >= F.col("least"), "left_semi")


def type_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("type").agg(F.count(F.lit(1)).alias("total"), F.count("deprecated_by").alias("deprecated"), F.count("valid_to").alias("expired"))


# Clusters


def topic_clusters(records: DataFrame, prefix: str = "topic:", least: int = MIN_CLUSTER) -> DataFrame:
    """(cluster_id, id): members of topics with enough records that are not distillations."""
    each = records.where("type != 'distillation'").select("id", F.explode(F.array_distinct(F.filter("tags", lambda t: t.startswith(prefix)))).alias("cluster_id"))
    return _large(each, least)


def week_clusters(records: DataFrame, least: int = MIN_CLUSTER) -> DataFrame:
    """(cluster_id, id): daily records by agent and ISO week."""
    agent = F.coalesce(F.try_element_at(F.transform(F.filter("tags", lambda t: t.startswith("agent:")), lambda t: F.substring(t, 7, 10_000)), F.lit(1)), F.lit("(no-agent)"))
    each = records.where("type = 'daily'").select("id", F.concat_ws("/", agent, text.iso_week(F.col("created"))).alias("cluster_id"))
    return _large(each, least)


def _large(members: DataFrame, least: int) -> DataFrame:
    large = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least).select("cluster_id")
    return members.join(large, "cluster_id", "left_semi").select("cluster_id", "id")


def covered_ids(records: DataFrame) -> DataFrame:
    """(id): last path components of the links of distillations."""
    link = F.regexp_replace(F.substring_index(F.col("link"), "/", -1), r"\.md$", "")
    return records.where("type = 'distillation'").select(F.explode("links").alias("link")).select(link.alias("id")).where("id != ''").distinct()


def open_clusters(clusters: DataFrame, covered: DataFrame) -> DataFrame:
    """(cluster_id, size): clusters with a member that no distillation covers."""
    marked = clusters.join(covered.withColumn("_covered", F.lit(1)), "id", "left")
    return marked.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"), F.count("_covered").alias("done")).where("done < size").select("cluster_id", "size")


# Sessions and projects


def transcripts(turns: DataFrame) -> DataFrame:
    """(conv_id, body, n_turns): turns of users and assistants as one text. turns: conv_id, turn, role, text."""
    said = turns.where(F.col("role").isin("user", "assistant") & (F.trim("text") != ""))
    line = F.concat(F.lit("**"), F.initcap("role"), F.lit(":** "), F.col("text"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"])
    return said.groupBy("conv_id").agg(F.array_join(ordered, "\n\n").alias("body"), F.count(F.lit(1)).cast("int").alias("n_turns"))


def session_status(sessions: DataFrame, covered: DataFrame, failed: DataFrame, now: Column, days: int | None = SESSION_DAYS, min_turns: int = MIN_TURNS, min_words: int = MIN_WORDS) -> DataFrame:
    """sessions (id, body, updated) with the first reason that keeps them from being distilled, or candidate."""
    rows = sessions.join(covered.select("id", F.lit(1).alias("_done")), "id", "left").join(failed.select("id", F.lit(1).alias("_failed")), "id", "left")
    old = F.lit(False) if days is None else F.col("updated") < now - F.make_dt_interval(F.lit(days))
    short = (text.turn_count(F.col("body")) < min_turns) | (text.word_count(F.col("body")) < min_words)
    status = F.when(old, "old").when(F.col("_done").isNotNull(), "covered").when(F.col("_failed").isNotNull(), "failed").when(short, "short").otherwise("candidate")
    return rows.withColumn("status", status).drop("_done", "_failed")


def linked_sessions(records: DataFrame) -> DataFrame:
    """(id): sessions that a distillation links to."""
    inner = F.regexp_extract(F.trim("link"), r"^(?:memory://)?sessions/(.+?)(?:\.md)?$", 1)
    return records.where("type = 'distillation'").select(F.explode("links").alias("link")).select(inner.alias("id")).where("id != ''").distinct()


def planned(candidates: DataFrame, most: int | None = MOST_PER_CYCLE) -> DataFrame:
    """The first candidates by path that one cycle takes; the rest wait for the next. No cap if it is none or negative."""
    return candidates if most is None or most < 0 else candidates.orderBy("path", "id").limit(most)


def verification(records: DataFrame, status: DataFrame, decisions: DataFrame, paths: DataFrame, skipped: DataFrame) -> DataFrame:
    """One row of totals, each part a one-row aggregate.

    records has links; status is what `session_status` found, decisions what
    `noise_decisions` did; paths (rel) are all files below the root, whether
    records or not, skipped (ref) those that could not be read as records.
    """
    n = F.count(F.lit(1))
    whole = records.agg(n.alias("records"), F.count("deprecated_by").alias("deprecated"), F.count("valid_to").alias("expiring"), F.count("deleted_at").alias("deleted"))
    skilled = F.coalesce(F.max(F.col("type") == "skill"), F.lit(False)).alias("skilled")
    groups = hashed(records.where("deprecated_by is null")).groupBy("hash").agg(n.alias("size"), skilled).where("size > 1")
    losers = F.when(~F.col("skilled"), F.col("size") - 1)
    parts = [
        groups.agg(n.alias("collision_groups"), F.coalesce(F.sum("size"), F.lit(0)).alias("collision_records"), F.count_if("skilled").alias("skill_groups"), F.coalesce(F.sum(losers), F.lit(0)).alias("to_deprecate")),
        decisions.agg(F.count_if(F.col("action") == "drop").alias("noise_drop"), F.count_if(F.col("action") == "tag_transient").alias("noise_transient")),
        linked_sessions(records).agg(n.alias("covered_sessions")),
        status.agg(F.count_if(F.col("status") == "candidate").alias("eligible_sessions")),
        paths.agg(F.count_if(F.col("rel").rlike(r"^skills/_review/[^/]+\.md$")).alias("open_tickets")),
        skipped.select("ref").distinct().agg(n.alias("parse_skips")),
    ]
    for part in parts:
        whole = whole.crossJoin(part)
    return whole


def project_tag(tags: Column) -> Column:
    """A session's first tag that is neither a literal nor a prefix of another kind."""

    def named(t: Column) -> Column:
        bad = t.isin(*NOT_PROJECTS)
        for prefix in NOT_PROJECT_PREFIXES:
            bad = bad | t.startswith(prefix)
        return ~bad

    return F.try_element_at(F.filter(tags, named), F.lit(1))


def _tagged(sessions: DataFrame) -> DataFrame:
    return sessions.withColumn("tag", project_tag(F.col("tags"))).where("tag is not null")


def project_candidates(sessions: DataFrame, least: int = MIN_SESSIONS) -> DataFrame:
    """(tag, sessions, created, updated): projects with enough sessions."""
    return _tagged(sessions).groupBy("tag").agg(F.count(F.lit(1)).alias("sessions"), F.min("created").alias("created"), F.max("updated").alias("updated")).where(F.col("sessions") >= least)


def project_members(sessions: DataFrame, least: int = MIN_SESSIONS) -> DataFrame:
    """(tag, id, updated): the sessions of such projects, one row each, so that a large project is no one value; in order by update and id."""
    return _tagged(sessions).join(project_candidates(sessions, least).select("tag"), "tag", "left_semi").select("tag", "id", "updated")


def latest_distillations(records: DataFrame) -> DataFrame:
    """(session_id, id): the distillation of each session; the last path wins."""
    inner = F.regexp_extract(F.trim("link"), r"^(?:memory://)?sessions/(.+?)(?:\.md)?$", 1)
    links = records.where("type = 'distillation'").select("id", "path", F.explode("links").alias("link")).withColumn("session_id", inner).where("session_id != ''")
    return links.groupBy("session_id").agg(F.max_by("id", F.struct("path", "id")).alias("id"))


#: Characters of a project's prompt, and sections that can be needed to fill it: each is longer than 24.
PROJECT_CHARS, PROJECT_SECTIONS = 12_000, 500


def project_prompts(sessions: DataFrame, distillations: DataFrame, least: int = MIN_SESSIONS, most: int = PROJECT_CHARS) -> DataFrame:
    """(tag, prompt, sessions, created, updated) of projects with enough sessions.

    sessions: id, title, body, tags, created, updated; distillations: session_id, id,
    title, body, updated. Sections stand in the order of the sessions' updates, the
    distillation of a session in its place. Only the sections that can be in the
    prompt are put together, whatever the size of the project.
    """
    found = distillations.select(F.col("session_id").alias("id"), F.col("title").alias("_title"), F.col("body").alias("_body"), F.col("updated").alias("_updated"))
    rows = _tagged(sessions).join(found, "id", "left")
    told = F.col("_body").isNotNull()
    part = lambda a, b: F.when(told, F.col(a)).otherwise(F.col(b))
    section = F.concat(F.lit("### ["), F.when(told, "distillation").otherwise("session"), F.lit("] "), F.date_format(part("_updated", "updated"), "yyyy-MM-dd"), F.lit(" — "), F.coalesce(part("_title", "title"), F.lit("(untitled)")), F.lit("\n\n"), F.coalesce(part("_body", "body"), F.lit("")))
    rows = rows.select("tag", "id", "created", "updated", told.alias("told"), section.alias("section"))
    whole = rows.groupBy("tag").agg(F.count(F.lit(1)).alias("sessions"), F.count_if("told").alias("told"), F.sum(F.char_length("section") + 2).alias("chars"), F.min("created").alias("created"), F.max("updated").alias("updated")).where(F.col("sessions") >= least)
    place = F.row_number().over(Window.partitionBy("tag").orderBy("updated", "id"))
    first = rows.withColumn("place", place).where(F.col("place") <= PROJECT_SECTIONS).groupBy("tag").agg(F.sort_array(F.collect_list(F.struct("place", F.substring("section", 1, most).alias("section"), F.char_length("section").alias("n")))).alias("s"))
    text_ = F.array_join(F.transform("s", lambda x: x["section"]), "\n\n")
    # A section that was cut is longer than all there is room for, so the head is right either way.
    rest = F.col("chars") - 2 - most
    sources = F.when(rest <= 0, text_).otherwise(F.concat(F.substring(text_, 1, most), F.lit("\n\n[… "), F.format_number(rest, 0), F.lit(" more characters]")))
    raw = F.col("sessions") - F.col("told")
    kind = F.concat_ws(", ", F.when(F.col("told") > 0, F.concat(F.col("told").cast("string"), F.lit(" distilled"))), F.when(raw > 0, F.concat(raw.cast("string"), F.lit(" as they were"))))
    prompt = F.concat(F.lit("Write a current record of the project below from its sessions, oldest first.\n\nProject: "), F.col("tag"), F.lit("\nSessions: "), kind, F.lit("\n\n"), sources)
    return whole.join(first, "tag").select("tag", prompt.alias("prompt"), "sessions", "created", "updated")


def project_links(sessions: DataFrame, distillations: DataFrame, tags: DataFrame) -> DataFrame:
    """(tag, target): each project's sessions, and their distillations once; rows, so that a large project is no one value."""
    members = _tagged(sessions).join(tags.select("tag"), "tag", "left_semi").select("tag", "id")
    told = members.join(distillations.select(F.col("session_id").alias("id"), F.col("id").alias("_d")), "id").select("tag", F.concat(F.lit("memory://memories/distillations/"), F.col("_d").cast("string")).alias("target")).distinct()
    return members.select("tag", F.concat(F.lit("memory://sessions/"), F.col("id").cast("string")).alias("target")).unionByName(told)


def project_records(sessions: DataFrame, distillations: DataFrame, existing: DataFrame, cache: DataFrame, model: str, answer: Callable[[DataFrame], DataFrame], now: Column, force: bool = False, least: int = MIN_SESSIONS) -> dict[str, DataFrame]:
    """Upkeep of the records of projects: records (id, tag, title, body, path, manual, created, updated, status), links, cache.

    existing: id, tag, title, body, created, manual; cache: content_hash, model,
    output. The hash of a project's prompt, which is all its inputs, is the key of
    the cache, so a project that did not change asks no model; `answer` turns
    (content_hash, prompt) into (content_hash, output). A manual record keeps its
    body and asks nothing, unless forced; its links and update are renewed.
    status: written, updated, links_only, or skipped where the model said nothing.
    """
    known = existing.select("tag", F.col("id").alias("_id"), F.col("body").alias("_body"), F.col("created").alias("_created"), F.coalesce("manual", F.lit(False)).alias("_manual"))
    rows = project_prompts(sessions, distillations, least).withColumn("content_hash", text.raw_hash(F.col("prompt"))).join(known, "tag", "left")
    manual = F.coalesce("_manual", F.lit(False)) & F.lit(not force)
    rows = cut(rows.withColumn("manual", manual))
    held = cache.where(F.col("model") == model).select("content_hash", "output")
    misses = rows.where("not manual").select("content_hash", "prompt").join(held, "content_hash", "left_anti")
    fresh = cut(answer(misses).select("content_hash", "output").where("coalesce(output, '') <> ''"))
    out = rows.join(held.unionByName(fresh), "content_hash", "left")
    body = F.when(F.col("manual"), F.col("_body")).otherwise(F.col("output"))
    status = F.when(F.col("manual"), "links_only").when(F.coalesce("output", F.lit("")) == "", "skipped").when(F.col("_id").isNotNull(), "updated").otherwise("written")
    made = F.concat(F.lit("p-"), F.substring(F.sha2(F.concat(F.lit("project:"), F.col("tag")), 256), 1, 32))
    records = out.select(F.coalesce(F.col("_id").cast("string"), made).alias("id"), "tag", F.coalesce(text.leading_title(body), F.col("tag")).alias("title"), body.alias("body"), F.concat(F.lit("memories/projects/"), F.col("tag"), F.lit(".md")).alias("path"), "manual", F.coalesce("_created", "created").alias("created"), now.alias("updated"), status.alias("status"))
    kept = records.where("status <> 'skipped'").select("tag")
    return {"records": records, "links": project_links(sessions, distillations, kept), "cache": cache.unionByName(fresh.withColumn("model", F.lit(model)).select(*cache.columns))}


def session_prompt(title: Column, body: Column, most: int = 32_000) -> Column:
    return F.concat(F.lit("Summarise the work session below: goal, decisions, results, and where it ended.\n\nTitle: "), F.coalesce(title, F.lit("(untitled)")), F.lit("\n\n"), text.truncated_middle(body, most))


def extractive_summary(body: Column, sentences: int = 3) -> Column:
    """A stand-in for a summarizing model: the first sentences."""
    return F.array_join(F.slice(F.split(text.collapsed(body), r"(?<=[.!?]) "), 1, sentences), " ")


def distillations(candidates: DataFrame, now: Column, summary: Column | None = None) -> DataFrame:
    """Derived records of sessions (id, title, body, tags), linked to their source; ids follow from the session."""
    ref = F.concat(F.lit("session-distillation:"), F.col("id"))
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    body = extractive_summary(F.col("body")) if summary is None else summary
    return candidates.select(
        F.concat(F.lit("d-"), F.substring(F.sha2(ref, 256), 1, 32)).alias("id"),
        F.lit("distillation").alias("type"),
        F.coalesce(text.leading_title(body), F.concat(F.lit("Session: "), F.coalesce("title", "id"))).alias("title"),
        body.alias("body"),
        F.when(F.array_contains(tags, "distillation:session"), tags).otherwise(F.array_append(tags, F.lit("distillation:session"))).alias("tags"),
        F.array(F.concat(F.lit("memory://sessions/"), F.col("id"))).alias("links"),
        F.lit(0.8).alias("importance"),
        F.struct(F.lit("hygiene").alias("source"), ref.alias("ref"), now.alias("ingested_at")).alias("provenance"),
        now.alias("created"),
        now.alias("updated"),
    )
