"""Incremental ingest and usage with Structured Streaming.

A file source tells of a path once, but files change. So a stream here is a
stream of source rows (appended as files), and each micro-batch goes through the
same set operations as a batch, collapsing to the last row of each ref first.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import hygiene, ingest
from .ledger import Conflict, Ledger

BATCH = "arrival_seq long, source string, ref string, type string, title string, body string, tags array<string>, created timestamp, updated timestamp"
#: What a batch may tell besides.
DETAILS = "scope string, session_id string, daily_date string, daily_scope string"
RECORDS = "id string, type string, title string, body string, tags array<string>, source string, created timestamp, updated timestamp, importance double, valid_from timestamp, valid_to timestamp, deprecated_by string, deleted_at timestamp, path string, scope string"
MAPPING = "source string, ref string, id string, hash string"
HASHES = "hash string, id string, seen_count long"


class Store:
    """Versioned Parquet tables: a version is written whole, then the ledger's next entry names it.

    Writers may be many. A write that was made from an older state than the newest
    one raises Conflict; `change` makes it again from the newest.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.ledger = Ledger(spark, f"{self.root}/current")

    def snapshot(self) -> tuple[int, dict[str, str]]:
        """(number of the last write, path of each table)."""
        return self.ledger.read()

    def read(self, name: str, schema: str, snapshot: tuple[int, dict[str, str]] | None = None) -> DataFrame:
        path = (snapshot or self.snapshot())[1].get(name)
        return self.spark.read.schema(schema).parquet(path) if path else self.spark.createDataFrame([], schema)

    def seen(self, stream: str) -> int:
        """The last batch of a stream that a write has taken in; -1 if none."""
        return int(self.snapshot()[1].get(f"#{stream}", -1))

    def write(self, version: int, stream: str | None = None, snapshot: tuple[int, dict[str, str]] | None = None, **tables: DataFrame) -> None:
        """All given tables become visible at once, with the number of the stream's batch they come from.

        snapshot is the state they were made from: the newest one, unless given.
        Folders are never reused, so readers of the last write go on.
        """
        number, paths = snapshot or self.snapshot()
        if stream is not None:
            paths = paths | {f"#{stream}": str(version)}
        fresh = {n: f"{self.root}/{n}/v{version}-{number + 1}-{uuid.uuid4().hex[:8]}" for n in tables}
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(fresh[name])
        self.ledger.put(number + 1, paths | fresh)

    def change(self, version: int, compute: Callable[[Callable[[str, str], DataFrame]], Mapping[str, DataFrame] | None], stream: str | None = None, tries: int = 10) -> bool:
        """Write compute(read), made again from the newest state whenever another writer was first; whether anything was written.

        compute may give up with None. A batch of `stream` that a write has taken in changes nothing.
        """
        for _ in range(tries):
            state = self.snapshot()
            if stream is not None and version <= int(state[1].get(f"#{stream}", -1)):
                return False
            tables = compute(lambda name, schema: self.read(name, schema, state))  # noqa: B023  used at once
            if tables is None:
                return False
            try:
                self.write(version, stream, state, **tables)
                return True
            except Conflict:
                continue
        raise Conflict(f"{self.root}: another writer was first {tries} times")


def taken_in(read: Callable[[str, str], DataFrame], batch: DataFrame, now: Column, known_heads: DataFrame | None = None, children: Mapping[str, str] | None = None) -> dict[str, DataFrame]:
    """The tables of a store after a batch; children (name: schema) lose the rows of displaced records."""
    records, mapping = read("records", RECORDS), read("source_map", MAPPING)
    kept = read("hashes", HASHES)
    out = ingest.ingested(batch, records, mapping, now, known_heads, kept if kept.limit(1).count() else None)
    after = {"records": out["records"].select(*records.columns), "source_map": out["source_map"], "hashes": out["hashes"]}
    return after | ingest.cascaded({name: read(name, schema) for name, schema in (children or {}).items()}, out["displaced"])


def ingest_stream(spark: SparkSession, incoming: str, store: Store, checkpoint: str, now: Callable[[], Column], known_heads: DataFrame | None = None, children: Mapping[str, str] | None = None) -> StreamingQuery:
    """Ingest all rows waiting under `incoming`, then stop; run again for more."""

    def apply(batch: DataFrame, epoch: int) -> None:
        # A batch that was written before a failure, and is played again, changes nothing.
        store.change(epoch, lambda read: taken_in(read, batch, now(), known_heads, children), checkpoint)

    stream = spark.readStream.schema(f"{BATCH}, {DETAILS}").option("maxFilesPerTrigger", 100).parquet(incoming)
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def exposure_counts(log: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Exposures per record and window of an (event-time) log stream; rows later than `late` are left out."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", window), "memory_id", "kind").count()


def bump_stream(log: DataFrame, store: Store, checkpoint: str, now: Callable[[], Column]) -> StreamingQuery:
    """Importance bumps from an exposure log stream; the checkpoint is the cursor, and a batch that the store has taken in is not counted again."""

    def raised(read: Callable[[str, str], DataFrame], batch: DataFrame) -> dict[str, DataFrame]:
        records = read("records", RECORDS)
        bumped = hygiene.bumps(batch, records, now()).select("id", "new_importance")
        out = records.join(bumped, "id", "left").withColumn("importance", F.coalesce("new_importance", "importance"))
        return {"records": out.select(*records.columns)}

    def apply(batch: DataFrame, epoch: int) -> None:
        store.change(epoch, lambda read: raised(read, batch), checkpoint)

    return log.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
