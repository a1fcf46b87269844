"""One object over a store of records and chunks: search, point reads, skills, writes, applies, claims, reports."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text
from .model import SearchOptions, clamp_limit, clamp_rerank
from .operators import applies, fusion, hygiene, ingest, models, state
from .operators.textindex import TextIndex
from .session import cut
from .streaming.ingest import HASHES, RECORDS, Store, taken_in
from .streaming.ledger import Ledger

CHUNKS = "chunk_id string, id string, chunk_index int, text string, embedding array<double>"
STATE = "id string, body_hash string, signature string"
LAYOUT = "number int, value int"
INDEXED = "id string, hash string"
HYDE = "query_hash string, judge string, hypothesis string"
QUEUE = "id string, enqueued_at timestamp, retries int, last_error string, failed boolean, claimed_at timestamp, claimed_by string"
#: Tables whose rows go with their record.
CHILDREN = {"chunks": CHUNKS, "embed_state": STATE}
LOG = "id long, ts timestamp, kind string, query string, client string, memory_id string, rank int, score double"


def _with_states(engine: Engine, read: Callable[[str, str], DataFrame]) -> dict[str, DataFrame]:
    """1: vectors that are older than their state table get a row in it, good for any embedder."""
    known = read("embed_state", STATE)
    bodies = read("records", RECORDS).select("id", text.raw_hash(F.col("body")).alias("body_hash"))
    missing = state.missing_state(read("chunks", CHUNKS), known).join(bodies, "id").withColumn("signature", F.lit(None).cast("string"))
    return {"embed_state": known.unionByName(missing)}


def _with_hashes(engine: Engine, read: Callable[[str, str], DataFrame]) -> dict[str, DataFrame]:
    """2: the owners of bodies, for stores that kept none."""
    known = read("hashes", HASHES)
    missing = ingest.body_hashes(read("records", RECORDS)).join(known.select("hash"), "hash", "left_anti")
    return {"hashes": known.unionByName(missing)}


UPGRADES: dict[int, Callable[[Engine, Callable[[str, str], DataFrame]], dict[str, DataFrame]]] = {1: _with_states, 2: _with_hashes}


class Engine:
    """Reads and writes the tables of a `Store`. `embed` turns (chunk_id, text) into (chunk_id, embedding)."""

    def __init__(self, spark: SparkSession, root: str, embed: Callable[[DataFrame], DataFrame] = models.hashed_vectors, signature: str = "hashed-64"):
        self.spark, self.store, self.embed, self.signature = spark, Store(spark, root), embed, signature
        self.locks = Ledger(spark, f"{root.rstrip('/')}/locks")
        self.index = TextIndex(spark, f"{root.rstrip('/')}/index")

    def records(self) -> DataFrame:
        return self.store.read("records", RECORDS)

    def chunks(self) -> DataFrame:
        return self.store.read("chunks", CHUNKS)

    def ingest(self, batch: DataFrame, version: int, now: Column, known_heads: DataFrame | None = None) -> None:
        """Source rows (`streaming.ingest.BATCH`) into records, then vectors for what changed."""
        self.store.change(version, lambda read: taken_in(read, batch, now, known_heads, CHILDREN))
        self.refresh(version)

    def open(self, version: int, dimensions: int, rebuild: bool = False) -> list[int]:
        """Bring the store up to the newest layout and check its vectors' length; the upgrades that were done.

        The store's tables know which upgrades they have seen, so each is done once.
        Vectors of another length are an error or, with `rebuild`, dropped with their
        state, so that the next refresh makes them anew.
        """
        done: list[int] = []

        def upgraded(read: Callable[[str, str], DataFrame]) -> dict[str, DataFrame] | None:
            known = {r["number"]: r["value"] for r in read("layout", LAYOUT).collect()}
            before = max(known, default=0) if known else 0
            tables: dict[str, DataFrame] = {}
            done[:] = [n for n in sorted(UPGRADES) if n > before]
            for number in done:
                tables |= UPGRADES[number](self, lambda name, schema: tables.get(name, read(name, schema)))
            held = read("chunks", CHUNKS).where("embedding is not null").select(F.size("embedding").alias("n")).where(F.col("n") != dimensions).limit(1).collect()
            if held and not rebuild:
                raise ValueError(f"the store holds vectors of {held[0]['n']} numbers, not {dimensions}; open it with rebuild")
            if held:
                tables |= {"chunks": read("chunks", CHUNKS).limit(0), "embed_state": read("embed_state", STATE).limit(0)}
            if not tables and not done:
                return None
            return tables | {"layout": self.spark.createDataFrame([(n, dimensions) for n in sorted({*known, *done})], LAYOUT)}

        self.store.change(version, upgraded)
        return done

    def refresh(self, version: int) -> None:
        """Bring chunks, vectors and the keyword index up to the records: what is new, changed or gone."""
        known = self.store.read("embed_state", STATE)
        hashes = self.records().select("id", text.raw_hash(F.col("body")).alias("body_hash"))
        stale = state.needs_embedding(hashes, known, self.signature).where("needed").select("id")
        rows = models.chunk_rows(self.records().join(stale, "id", "left_semi"))
        fresh = rows.join(self.embed(rows.select("chunk_id", "text")), "chunk_id")
        kept = self.chunks().join(stale, "id", "left_anti").join(hashes.select("id"), "id", "left_semi")
        columns = [c.split()[0] for c in CHUNKS.split(", ")]
        after = hashes.withColumn("signature", F.lit(self.signature))
        # Indexed is what a search finds: title, body and tags. The index goes first, so a failure between repeats it.
        indexed = self.store.read("indexed", INDEXED)
        said = self.records().select("id", text.raw_hash(F.concat_ws("\n", "title", "body", F.array_join("tags", " "))).alias("hash"))
        changed = cut(said.join(indexed, ["id", "hash"], "left_anti").select("id"))
        gone = cut(indexed.join(said, "id", "left_anti").select("id"))
        if changed.limit(1).count():
            self.index.upsert(self.records().join(changed, "id", "left_semi").select("id", "title", "body", "tags"))
        if gone.limit(1).count():
            self.index.delete(gone)
        self.store.write(version, chunks=kept.select(*columns).unionByName(fresh.select(*columns)), embed_state=after, indexed=said)

    def search(self, queries: DataFrame, now: Column, options: SearchOptions = SearchOptions(), expand: Callable[[DataFrame], DataFrame] | None = None, judge: str = "model") -> DataFrame:
        """queries (query_id long, query) to hits with the records' titles, snippets and paths.

        expand: a model that turns questions into passages that could answer them
        (see `models.expanded`), kept in the store's cache; vectors are then those
        of the passages. If vectors cannot be had, hits are those by keyword, and
        `degraded` says why.
        """
        options = replace(options, limit=clamp_limit(options.limit), rerank_top_n=clamp_rerank(options.rerank_top_n) if options.rerank_top_n > 0 else 0)
        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "query")
        passages = asked.withColumn("passage", F.col("query"))
        if expand is not None:
            cache = self.store.read("hyde_cache", HYDE)
            passages, after = models.expanded(asked, cache, judge, expand)
            passages = cut(passages)
            self.store.change(0, lambda read: {"hyde_cache": after.unionByName(read("hyde_cache", HYDE)).dropDuplicates(["query_hash", "judge"])})
        vectors, failed = models.vectors_or_none(passages, self.embed)
        keyword = self.index.search(asked, self.records(), options.candidates, options.types)
        hits = fusion.search(self.records(), self.chunks(), asked.join(vectors, "query_id", "left"), now, options, keyword)
        shown = self.records().select("id", "title", "type", "path", text.snippet(F.col("body")).alias("snippet"))
        return hits.join(shown, "id").select("query_id", "final_rank", "id", "title", "type", "path", "snippet", "score", "bm25_rank", "vec_rank", F.lit(failed).cast("string").alias("degraded"))

    def exposures(self, hits: DataFrame, queries: DataFrame, client: str, now: Column, first_id: int) -> DataFrame:
        """Log rows of the hits of searches, to be appended."""
        rows = hits.join(queries.select("query_id", "query"), "query_id")
        per = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
        before = Window.orderBy("query_id").rowsBetween(Window.unboundedPreceding, -1)  # one row per query
        rows = rows.join(per.select("query_id", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), "query_id")
        number = F.lit(first_id) + F.col("_before") + F.row_number().over(Window.partitionBy("query_id").orderBy("final_rank")) - 1
        return rows.select(number.cast("long").alias("id"), now.alias("ts"), F.lit("search").alias("kind"), "query", F.lit(client).alias("client"), F.col("id").alias("memory_id"), F.col("final_rank").cast("int").alias("rank"), "score")

    def get(self, keys: DataFrame) -> DataFrame:
        """Records by path, else by id; keys has one column, key."""
        rows = self.records()
        by_path = keys.join(rows.withColumnRenamed("path", "key"), "key").withColumn("path", F.col("key"))
        left = keys.join(by_path.select("key"), "key", "left_anti")
        by_id = left.join(rows.withColumn("key", F.col("id")), "key")
        return by_path.unionByName(by_id)

    def skills(self, scope: str | None = None, include_deleted: bool = False) -> DataFrame:
        rows = self.records().where("type = 'skill'")
        rows = rows if include_deleted else rows.where("deleted_at is null")
        return rows if scope is None else rows.where(F.col("scope") == scope)

    def skill(self, name: str) -> DataFrame:
        return self.skills().where(F.col("title") == name).orderBy("path").limit(1)

    def write(self, record: DataFrame, version: int, now: Column) -> None:
        """Upsert records by an API: raw headers (id, type, title, ... as strings), body and path, coerced first.

        Paths into reserved folders are an error. A record keeps what it has of
        lifecycle and importance, unless the header gives it.
        """
        rows = record.withColumn("path", F.when(ingest.is_reserved(F.col("path")), F.raise_error(F.concat(F.lit("reserved path: "), F.col("path"))).cast("string")).otherwise(F.col("path")))
        rows = cut(ingest.coerced(rows, now))

        def written(read: Callable[[str, str], DataFrame]) -> dict[str, DataFrame]:
            records, kept = read("records", RECORDS), read("hashes", HASHES)
            new = ingest.with_header(rows.withColumn("ttl_days", F.lit(None).cast("int")), records, now)
            new = new.select(*[F.col(c) if c in new.columns else F.lit(None).cast(records.schema[c].dataType).alias(c) for c in records.columns])
            after = ingest.upserted(records, new)
            gone = records.select("id").join(after.select("id"), "id", "left_anti")
            owned = new.groupBy(text.normalized_hash(F.col("body")).alias("hash")).agg(F.min("id").alias("id"), F.lit(1).cast("long").alias("seen_count"))
            hashes = kept.join(new.select("id"), "id", "left_anti").join(gone, "id", "left_anti").join(owned.select("hash"), "hash", "left_anti").select(*kept.columns).unionByName(owned)
            return {"records": after, "hashes": hashes} | ingest.cascaded({name: read(name, schema) for name, schema in CHILDREN.items()}, gone)

        self.store.change(version, written)
        self.refresh(version)

    def apply_manifest(self, manifest: DataFrame, header: dict, now: Column, version: int, dry_run: bool = False) -> DataFrame:
        """The report of a manifest (see `applies.manifest_status`); records and change log are written at once, or not at all."""
        if errors := applies.header_errors(header.get("version"), header.get("rules")):
            raise ValueError("; ".join(errors))
        reports: list[DataFrame] = []

        def changed(read: Callable[[str, str], DataFrame]) -> dict[str, DataFrame] | None:
            out = applies.manifest_applied(manifest, read("records", RECORDS), now, dry_run)
            reports.append(cut(out["report"]))
            return None if dry_run else {"records": out["records"], "audit": read("audit", applies.AUDIT).unionByName(out["audit"])}

        self.store.change(version, changed)
        return reports[-1]

    def claim(self, limit: int, claimant: str, now: Column, version: int) -> DataFrame:
        """Queue rows that now belong to the claimant, and to no one else: claims are compared and swapped."""
        self.store.change(version, lambda read: {"queue": state.claimed(read("queue", QUEUE), limit, claimant, now)})
        return self.store.read("queue", QUEUE).where(F.col("claimed_by") == claimant)

    def enqueue(self, ids: DataFrame, now: Column, version: int) -> None:
        self.store.change(version, lambda read: {"queue": state.enqueued(read("queue", QUEUE), ids, now)})

    def retry(self, version: int) -> None:
        """Give failed queue rows another chance."""
        self.store.change(version, lambda read: {"queue": state.released_failures(read("queue", QUEUE))})

    def lock(self, stage: str, owner: str, now: float) -> bool:
        """Take a stage's lock, if it is free or was taken more than `state.STALE_LOCK_SECONDS` ago."""

        def taken(locks: dict) -> dict | None:
            held = locks.get(stage)
            if held and now - held["at"] <= state.STALE_LOCK_SECONDS:
                return None
            return locks | {stage: {"owner": owner, "at": now}}

        return self.locks.update(taken).get(stage) == {"owner": owner, "at": now}

    def unlock(self, stage: str, owner: str) -> None:
        self.locks.update(lambda locks: {k: v for k, v in locks.items() if k != stage} if locks.get(stage, {}).get("owner") == owner else None)

    def verify(self) -> DataFrame:
        """One row: records, deprecated, deleted, groups of equal bodies."""
        rows = self.records()
        groups = hygiene.collision_groups(rows).agg(F.count(F.lit(1)).alias("collision_groups"))
        return rows.agg(F.count(F.lit(1)).alias("records"), F.count("deprecated_by").alias("deprecated"), F.count("deleted_at").alias("deleted")).crossJoin(groups)

    def health(self) -> DataFrame:
        """One row: records with and without current vectors."""
        hashes = self.records().select("id", text.raw_hash(F.col("body")).alias("body_hash"))
        needed = state.needs_embedding(hashes, self.store.read("embed_state", STATE), self.signature)
        return needed.agg(F.count_if(~F.col("needed")).alias("embedded"), F.count_if("needed").alias("pending"))
