"""Moving daily records to the paths that their source files call for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

PARKED = "_meta/superseded-daily/"


def daily_target(ref: Column, agent: Column, folders: Sequence[str] = ("memory", "memories")) -> Column:
    """daily/agent/scope/date.md of a source file named by a date; null for others.

    The scope is what lies between the last folder of one of the names and the file.
    """
    stem = F.regexp_extract(ref, r"([^/]*?)(?:\.[^./]*)?$", 1)
    parent = F.regexp_replace(ref, r"/?[^/]*$", "")
    scope = F.lit(None).cast("string")
    for name in reversed(folders):
        inside = F.concat(F.lit("/"), parent, F.lit("/"))
        mark = f"/{name}/"
        scope = F.when(F.contains(inside, F.lit(mark)), F.rtrim(F.substring_index(inside, mark, -1), F.lit("/"))).otherwise(scope)
    path = F.concat(F.concat_ws("/", F.lit("daily"), F.nullif(agent, F.lit("")), F.nullif(scope, F.lit("")), stem), F.lit(".md"))
    return F.when(stem.rlike(r"^\d{4}-\d{2}-\d{2}$"), path)


def relocated(records: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, path, status): where records end up.

    records: id, path, ref, owns (whether the record still owns its ref);
    targets: id, target. Rounds go on until one moves nothing: a record moves
    once its target is free, the least id first if several want it; a record in
    the way that lost its ref to the mover is parked. Status is unchanged,
    moved, parked, or blocked for records whose target stays taken.
    """
    rows = records.join(targets, "id", "left").withColumn("status", F.lit("unchanged"))
    open_ = F.col("target").isNotNull() & (F.col("target") != F.col("path")) & (F.col("status") == "unchanged")
    rows = cut(rows)
    while True:
        waiting = rows.where(open_).select(F.col("id").alias("mover"), "target", F.col("ref").alias("mover_ref"))
        held = rows.select(F.col("path").alias("target"), F.col("id").alias("holder"), F.col("ref").alias("holder_ref"), (~F.col("owns") & (F.col("status") == "unchanged")).alias("loose"))
        met = waiting.join(held, "target", "left")
        may = met.where(F.col("holder").isNull() | (F.col("loose") & (F.col("holder_ref") == F.col("mover_ref")) & (F.col("holder") != F.col("mover"))))
        chosen = may.groupBy("target").agg(F.min(F.struct("mover", "holder")).alias("m")).select("target", "m.mover", "m.holder")
        moves = cut(chosen)
        if not moves.limit(1).count():
            return rows.select("id", "path", F.when(open_, "blocked").otherwise(F.col("status")).alias("status"))
        parked = moves.where("holder is not null").select(F.col("holder").alias("id"), F.lit(True).alias("_park"))
        moved = moves.select(F.col("mover").alias("id"), F.col("target").alias("_to"))
        rows = rows.join(parked, "id", "left").join(moved, "id", "left")
        path = F.when(F.col("_park"), F.concat(F.lit(PARKED), "path")).otherwise(F.coalesce("_to", "path"))
        status = F.when(F.col("_park"), "parked").when(F.col("_to").isNotNull(), "moved").otherwise(F.col("status"))
        rows = cut(rows.withColumn("status", status).withColumn("path", path).drop("_park", "_to"))
