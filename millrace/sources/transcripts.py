"""Session transcripts in three JSON line formats, parsed with variants and array functions.

Each function takes lines (path, rel, modified, line_no, value) and gives one
source record per file with any turn. Lines that are not JSON objects are
skipped. A file's turns meet in one group, which a file's size bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

# Openings of generated messages.
PERMISSIONS, ENVIRONMENT = "<permissions instructions>", "<environment_context>"


def _get(path: str, type_: str = "string") -> Column:
    return F.try_variant_get("v", path, type_)


def _is_list(path: str) -> Column:
    return F.coalesce(F.schema_of_variant(_get(path, "variant")).startswith("ARRAY"), F.lit(False))


def _is_string(path: str) -> Column:
    return F.coalesce(F.schema_of_variant(_get(path, "variant")) == "STRING", F.lit(False))


def _string(path: str) -> Column:
    return F.when(_is_string(path), _get(path))


def _blocks(path: str) -> Column:
    return F.when(_is_list(path), F.from_json(F.to_json(_get(path, "variant")), "array<struct<type:string,text:string,name:string>>"))


def _turn(role: Column, said: Column) -> Column:
    """**Role:** text, or null if nothing is said."""
    return F.when(F.trim(said, F.lit(" \n\t\r")) != "", F.concat(F.lit("**"), F.initcap(role), F.lit(":** "), said))


def _objects(lines: DataFrame) -> DataFrame:
    rows = lines.withColumn("v", F.try_parse_json(F.trim("value")))
    return rows.where(F.schema_of_variant("v").startswith("OBJECT"))


def _first_line(turn: Column) -> Column:
    return F.trim(F.substring(F.substring_index(F.regexp_replace(turn, r"^\*\*User:\*\* ", ""), "\n", 1), 1, 80))


def _records(rows: DataFrame, source: str, tag: Column, title_prefix: str = "session ", **more: Column) -> DataFrame:
    """rows has path, rel, modified, turns, first_ts, last_ts, session_id, title."""
    stem = F.regexp_replace(F.substring_index("rel", "/", -1), r"(\.trajectory)?\.jsonl$", "")
    session = F.coalesce(F.nullif(F.col("session_id"), F.lit("")), stem)
    said = F.try_element_at(F.filter("turns", lambda t: t.startswith("**User:**")), F.lit(1))
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.nullif(_first_line(said), F.lit("")), F.concat(F.lit(title_prefix), F.substring(session, 1, 8)))
    modified = F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    pairs = {"type": F.lit("session"), "session_id": session, "created": F.coalesce("first_ts", modified), "updated": F.coalesce("last_ts", modified), "turn_count": F.size("turns").cast("string"), **more}
    entries = [x for k, v in pairs.items() for x in (F.lit(k), v)]
    meta = F.map_filter(F.create_map(*entries), lambda _, v: v.isNotNull())
    tags = F.filter(F.array(tag), lambda t: F.coalesce(t, F.lit("")) != "")
    body = F.array_join("turns", "\n\n")
    return rows.where(F.size("turns") > 0).select(F.lit(source).alias("source"), F.col("path").alias("ref"), title.alias("title"), body.alias("body"), tags.alias("tags"), meta.alias("metadata"))


def _first(value: Column) -> Column:
    return F.min_by(value, F.when(value.isNotNull(), F.col("line_no")))


def _last(value: Column) -> Column:
    return F.max_by(value, F.when(value.isNotNull(), F.col("line_no")))


def _in_order(turn: str = "turn") -> Column:
    kept = F.collect_list(F.when(F.col(turn).isNotNull(), F.struct("line_no", turn)))
    return F.transform(F.sort_array(kept), lambda x: x[turn])


def _grouped(rows: DataFrame, **aggs: Column) -> DataFrame:
    return rows.groupBy("path", "rel", "modified").agg(*[c.alias(n) for n, c in aggs.items()])


def coding_sessions(lines: DataFrame, source: str = "coding") -> DataFrame:
    """Lines of {type, message{content}, timestamp, sessionId, title}: user and assistant turns, tool calls named."""
    rows = _objects(lines)
    kind = _string("$.type")
    block = F.transform(
        _blocks("$.message.content"),
        lambda x: F.when((x["type"] == "text") & (x["text"] != ""), x["text"]).when(x["type"] == "tool_use", F.concat(F.lit("[tool_use: "), F.coalesce(x["name"], F.lit("tool")), F.lit("]"))).when(x["type"] == "tool_result", F.lit("[tool_result]")),
    )
    said = F.coalesce(_string("$.message.content"), F.array_join(F.array_compact(block), "\n"))
    named = F.trim(F.coalesce(_string("$.title"), _string("$.text")))
    rows = rows.select("path", "rel", "modified", "line_no", F.when(kind.isin("user", "assistant"), _turn(kind, said)).alias("turn"), _string("$.timestamp").alias("ts"), _string("$.sessionId").alias("sid"), F.when((kind == "ai-title") & (named != ""), named).alias("named"))
    files = _grouped(rows, turns=_in_order(), first_ts=_first(F.col("ts")), last_ts=_last(F.col("ts")), session_id=_first(F.col("sid")), title=_last(F.col("named")))
    folder = F.try_element_at(F.split("path", "/"), F.lit(-2))
    return _records(files, source, F.when(folder.startswith("-"), F.ltrim(folder, F.lit("-"))), project=folder)


def rollouts(lines: DataFrame, source: str = "rollout") -> DataFrame:
    """Lines of {type: session_meta or response_item, payload, timestamp}: messages but generated ones, and calls."""
    rows = _objects(lines)
    kind, part, role = _string("$.type"), _string("$.payload.type"), F.coalesce(_string("$.payload.role"), F.lit(""))
    block = F.transform(_blocks("$.payload.content"), lambda x: F.when(x["type"].isin("input_text", "output_text", "text") & (x["text"] != ""), x["text"]))
    said = F.coalesce(_string("$.payload.content"), F.array_join(F.array_compact(block), "\n"))
    opening = F.ltrim(said, F.lit(" \n\t\r"))
    real = (role != "developer") & ~opening.startswith(PERMISSIONS) & ~((role == "user") & opening.startswith(ENVIRONMENT))
    turn = F.when(kind == "response_item", F.when((part == "message") & real, _turn(role, said)).when(part == "function_call", F.concat(F.lit("[function_call: "), F.coalesce(_string("$.payload.name"), F.lit("tool")), F.lit("]"))).when(part == "function_call_output", F.lit("[function_call_output]")))
    meta = {n: F.when(kind == "session_meta", _string(f"$.payload.{n}")) for n in ("id", "cwd", "cli_version", "model_provider")}
    rows = rows.select("path", "rel", "modified", "line_no", turn.alias("turn"), _string("$.timestamp").alias("ts"), *[c.alias(n) for n, c in meta.items()])
    last = {n: _last(F.col(n)) for n in ("cwd", "cli_version", "model_provider")}
    files = _grouped(rows, turns=_in_order(), first_ts=_first(F.col("ts")), last_ts=_last(F.col("ts")), session_id=_last(F.col("id")), title=F.first(F.lit(None).cast("string")), **last)
    return _records(files, source, text.cwd_slug(F.col("cwd")), "codex session ", **{n: F.col(n) for n in last})


def trajectories(lines: DataFrame, source: str = "trajectory") -> DataFrame:
    """Lines of {type, data, ts, sessionId}: prompts and replies, unless the longest snapshot of messages has more turns."""
    rows = _objects(lines)
    kind = _string("$.type")
    texts = F.from_json(F.to_json(F.when(_is_list("$.data.assistantTexts"), _get("$.data.assistantTexts", "variant"))), "array<string>")
    joined = F.array_join(F.filter(texts, lambda t: F.trim(t) != ""), "\n\n")
    turn = F.when(kind == "prompt.submitted", _turn(F.lit("user"), _string("$.data.prompt"))).when(kind == "model.completed", _turn(F.lit("assistant"), joined))
    shot = F.when((kind == "model.completed") & _is_list("$.data.messagesSnapshot"), F.from_json(F.to_json(_get("$.data.messagesSnapshot", "variant")), "array<struct<role:string,content:string>>"))
    rows = rows.select("path", "rel", "modified", "line_no", turn.alias("turn"), shot.alias("shot"), _string("$.ts").alias("ts"), F.coalesce(_string("$.sessionId"), _string("$.traceId")).alias("sid"), _string("$.workspaceDir").alias("dir"), _string("$.data.agentId").alias("agent"))
    longest = F.max_by("shot", F.when(F.col("shot").isNotNull(), F.struct(F.size("shot").alias("n"), -F.col("line_no"))))
    files = _grouped(rows, plain=_in_order(), shot=longest, first_ts=_first(F.col("ts")), last_ts=_last(F.col("ts")), session_id=_first(F.col("sid")), title=F.first(F.lit(None).cast("string")), dir=_first(F.col("dir")), agent=_first(F.col("agent")))

    def said(content: Column) -> Column:
        blocks = F.from_json(content, "array<struct<type:string,text:string>>")
        kept = F.filter(F.transform(F.filter(blocks, lambda x: x["type"] == "text"), lambda x: F.trim(x["text"])), lambda t: F.coalesce(t, F.lit("")) != "")
        return F.when(content.startswith("[{"), F.array_join(kept, "\n\n")).otherwise(F.trim(content))

    shown = F.array_compact(F.transform(F.filter("shot", lambda m: m["role"].isin("user", "assistant")), lambda m: _turn(m["role"], said(m["content"]))))
    files = files.withColumn("shown", shown)
    runs = F.filter("shown", lambda t, i: (i == 0) | (t != F.get(F.col("shown"), i - 1)))
    files = files.withColumn("shown", runs).withColumn("turns", F.when(F.size("shown") > F.size("plain"), F.col("shown")).otherwise(F.col("plain")))
    return _records(files, source, F.lit(None).cast("string"), workspace_dir=F.col("dir"), agent_id=F.col("agent"))
