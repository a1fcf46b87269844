"""A stored inverted index: posting segments by term, brought up to date by small segments and merged now and then.

Four tables lie under one folder, each partitioned by segment and by a bucket:

  postings   term, id, tf, dl, positions   by bucket of the term, sorted by term and id
  terms      term, df                      by bucket of the term; changes of df, so a sum over segments is the df
  records    id, dl, terms                 by bucket of the id: what a record's removal takes back
  removed    id                            by bucket of the id: postings of segments committed before are void

A change writes one segment of each and then moves the ledger's entry, which lists the
segments that count and the totals (records, tokens). Segments that no entry lists,
left by a writer that failed or lost a race, are never read. A search reads the
buckets of its queries' terms, and within their files the row groups of the terms.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stem import stemmed
from ..session import cut
from ..streaming.ledger import Conflict, Ledger
from . import blocks, lexical, scan

TABLES = {
    "postings": "term string, id {id}, tf long, dl int, positions array<int>",
    "terms": "term string, df long",
    "records": "id {id}, dl int, terms array<string>",
    "removed": "id {id}",
}
#: Terms up to which a search names them to the scan; beyond, it names their buckets only.
NAMED = 2000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Small segments before a merge, and their share of all records from which everything is merged.
SEGMENTS, SHARE = 8, 0.25


def bucket_of(column: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


class TextIndex:
    """An index of records (id, title, body, tags); `id_type` is that of their ids."""

    def __init__(self, spark: SparkSession, root: str, stem: lexical.Stem = stemmed, id_type: str = "string", buckets: int = 64):
        self.spark, self.root, self.stem, self.id_type, self.buckets = spark, root.rstrip("/"), stem, id_type, buckets
        self.ledger = Ledger(spark, f"{self.root}/ledger")

    def _state(self) -> tuple[int, dict]:
        number, value = self.ledger.read()
        return number, value or {"segments": [], "next": 1, "records": 0, "tokens": 0, "sizes": {}}

    def _read(self, name: str, segments: Sequence[int], buckets: Sequence[int] | None = None) -> DataFrame:
        schema = TABLES[name].format(id=self.id_type)
        if not segments:
            return self.spark.createDataFrame([], f"{schema}, segment int, bucket int")
        rows = self.spark.read.schema(f"{schema}, segment int, bucket int").parquet(f"{self.root}/{name}").where(F.col("segment").isin(list(segments)))
        return rows if buckets is None else rows.where(F.col("bucket").isin(list(buckets)))

    def _write(self, name: str, segment: int, rows: DataFrame, key: str, *order: str) -> None:
        """Split by range, so that a term in a third of all records is no file or task of its own."""
        rows = rows.withColumn("bucket", bucket_of(F.col(key), self.buckets))
        self._put(name, segment, rows.repartitionByRange("bucket", *order), *order)

    def _put(self, name: str, segment: int, rows: DataFrame, *order: str) -> None:
        # Runs of terms, ids and places pack to half in the newer encodings.
        out = rows.sortWithinPartitions("bucket", *order).write.option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0")
        # The shuffle of a write goes with it, else it would stay on disk until the driver collects its garbage.
        conf = self.spark.conf
        before = conf.get(CLEANUP, None)
        conf.set(CLEANUP, "true")
        try:
            out.partitionBy("bucket").mode("overwrite").parquet(f"{self.root}/{name}/segment={segment}")
        finally:
            conf.set(CLEANUP, before) if before is not None else conf.unset(CLEANUP)

    def _index(self, segment: int, records: DataFrame) -> None:
        """Postings and records of a segment, made where the records lie if the stemmer works in Python."""
        if self.stem is None or hasattr(self.stem, "word"):
            for name, order in (("postings", ("term", "id")), ("records", ("id",))):
                rows = blocks.dealt(name, records, lexical.words(), bucket_of(F.col("id"), self.buckets), TABLES[name].format(id=self.id_type), self.stem and self.stem.word, self.buckets)
                self._put(name, segment, rows, *order)
            return
        posted = lexical.postings(records, stem=self.stem)
        self._write("postings", segment, posted.select("term", "id", "tf", "dl", "positions"), "term", "term", "id")
        # Records without any token are records, too.
        fresh = records.select("id", lexical.words().alias("words")).select("id", lexical.length().alias("dl"))
        held = fresh.join(self._read("postings", [segment]).groupBy("id").agg(F.collect_list("term").alias("terms")), "id", "left")
        self._write("records", segment, held.select("id", "dl", F.coalesce("terms", F.array().cast("array<string>")).alias("terms")), "id", "id")

    def _live(self, name: str, segments: Sequence[int], buckets: Sequence[int] | None = None, part: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """Rows of a table that no later segment has made void; part: what of them is wanted, before they are joined (with id and segment)."""
        rows = self._read(name, segments, buckets)
        rows = part(rows) if part else rows
        if len(segments) < 2:
            return rows
        # Segments count in the order of the ledger, which is that of commits; numbers only name them.
        order = F.create_map(*[F.lit(x) for k, s in enumerate(segments) for x in (s, k)])
        gone = self._read("removed", segments[1:], buckets if name == "records" else None).groupBy("id").agg(F.max(order[F.col("segment")]).alias("_last")).withColumnRenamed("id", "_id")
        return rows.join(gone, (F.col("id") == F.col("_id")) & (order[F.col("segment")] < F.col("_last")), "left_anti")

    def _segment_number(self) -> int:
        """A number that no other writer takes: drawn from the ledger, whether or not the segment comes to count."""
        return self.ledger.update(lambda v: (v or self._state()[1]) | {"next": (v or {"next": 1})["next"] + 1})["next"] - 1

    def _commit(self, change: Callable[[dict], dict]) -> None:
        self.ledger.update(change)

    def upsert(self, records: DataFrame) -> None:
        """Index records, in place of those with their ids."""
        self._change(records, records.select("id"))

    def delete(self, ids: DataFrame) -> None:
        self._change(None, ids.select("id"))

    def _change(self, records: DataFrame | None, ids: DataFrame) -> None:
        """One segment. If another writer commits meanwhile, what is taken back is looked up anew."""
        segment = self._segment_number()
        if records is None:
            for name, key in (("postings", "term"), ("records", "id")):
                self._write(name, segment, self.spark.createDataFrame([], TABLES[name].format(id=self.id_type)), key, key)
        else:
            self._index(segment, records)
        posted = self._read("postings", [segment])
        self._write("removed", segment, ids.distinct(), "id", "id")
        added = self._read("records", [segment]).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens")).collect()[0]
        touched = {r["bucket"]: r["count"] for r in self._read("removed", [segment]).groupBy("bucket").count().collect()}
        while True:
            number, state = self._state()
            before = self._held(state["segments"], segment, touched)
            lost = before.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens")).collect()[0]
            plus = posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
            minus = before.select(F.explode("terms").alias("term")).groupBy("term").agg((-F.count(F.lit(1))).alias("df"))
            self._write("terms", segment, plus.unionByName(minus).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0"), "term", "term")
            after = state | {"segments": [*state["segments"], segment], "records": state["records"] + added["n"] - lost["n"], "tokens": state["tokens"] + added["tokens"] - lost["tokens"], "sizes": state["sizes"] | {str(segment): added["n"]}}
            try:
                self.ledger.put(number + 1, after)
                break
            except Conflict:
                continue
        if len(after["segments"]) > SEGMENTS:
            self.merge()

    def _held(self, segments: Sequence[int], segment: int, touched: dict[int, int]) -> DataFrame:
        """Live records that a segment removes. Its ids go to the records, bucket by bucket, `lexical.FEW` or one bucket at a time, so that these are not shuffled."""
        parts: list[list[int]] = []
        room = 0
        for bucket, count in sorted(touched.items()):
            if not parts or count > room:
                parts, room = [*parts, []], lexical.FEW
            parts[-1].append(bucket)
            room -= count
        out = self._live("records", segments, [])
        for buckets in parts:
            ids = F.broadcast(self._read("removed", [segment], buckets).select("id"))
            out = out.unionByName(self._live("records", segments, buckets, lambda rows: rows.join(ids, "id", "left_semi").select(*rows.columns)))  # noqa: B023  used at once
        return out

    def merge(self, everything: bool = False) -> None:
        """Write the small segments, or all if these have grown, as one. Searches under way go on with the old ones."""
        _, state = self._state()
        first, *small = state["segments"] or [None]
        whole = everything or sum(state["sizes"][str(s)] for s in small) > SHARE * max(1, state["sizes"].get(str(first), 0))
        chosen = state["segments"] if whole else small
        if len(chosen) < 2:
            return
        segment = self._segment_number()
        self._write("postings", segment, self._live("postings", chosen).select("term", "id", "tf", "dl", "positions"), "term", "term", "id")
        self._write("records", segment, self._live("records", chosen).select("id", "dl", "terms"), "id", "id")
        self._write("terms", segment, self._read("terms", chosen).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0"), "term", "term")
        removed = self._read("removed", chosen).select("id").distinct()
        self._write("removed", segment, removed.limit(0) if whole else removed, "id", "id")
        size = self._read("records", [segment]).count()

        def replaced(value: dict) -> dict | None:
            if not set(chosen) <= set(value["segments"]):
                return None  # another merge was first
            at = value["segments"].index(chosen[0])
            rest = [s for s in value["segments"] if s not in chosen]
            sizes = {k: v for k, v in value["sizes"].items() if int(k) not in chosen}
            return value | {"segments": [*rest[:at], segment, *rest[at:]], "sizes": sizes | {str(segment): size}}

        self._commit(replaced)

    def vacuum(self) -> None:
        """Delete segments that count no more. Only while no search and no change is under way."""
        keep = set(self._state()[1]["segments"])
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        for name in TABLES:
            folder = hadoop.Path(f"{self.root}/{name}")
            fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for s in fs.listStatus(folder) if fs.exists(folder) else []:
                if s.getPath().getName().startswith("segment=") and int(s.getPath().getName()[8:]) not in keep:
                    fs.delete(s.getPath(), True)

    def statistics(self) -> DataFrame:
        """One row: n, avgdl."""
        _, state = self._state()
        n = state["records"]
        return self.spark.createDataFrame([(n, state["tokens"] / n if n else 0.0)], "n long, avgdl double")

    def frequencies(self) -> DataFrame:
        """(term, df) of the whole index."""
        return self._read("terms", self._state()[1]["segments"]).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """(id, term, tf, dl, positions) as they count now; with `terms`, of these only, reading only their part of the index."""
        segments = self._state()[1]["segments"]
        if terms is None:
            return self._live("postings", segments).select("id", "term", "tf", "dl", "positions")
        return self._of(terms, "id", "term", "tf", "dl", "positions")

    def _of(self, terms: DataFrame, *columns: str) -> DataFrame:
        segments = self._state()[1]["segments"]
        wanted = terms.select("term").distinct()
        first = wanted.select("term", bucket_of(F.col("term"), self.buckets).alias("b")).limit(NAMED + 1).collect()
        named, buckets = [r["term"] for r in first], sorted({r["b"] for r in first})
        if len(named) > NAMED:
            buckets = [r["b"] for r in wanted.select(bucket_of(F.col("term"), self.buckets).alias("b")).distinct().collect()]  # as many as there are buckets at most
        part = lambda rows: (rows.where(F.col("term").isin(named)) if len(named) <= NAMED else rows.join(wanted, "term", "left_semi")).select(*columns, "segment")
        return self._live("postings", segments, buckets, part).select(*columns)

    def hits(self, queries: DataFrame) -> DataFrame:
        """(query_id, id, score) of queries (query_id, query)."""
        asked = cut(lexical.plan(queries, self.stem))
        several = asked.where(F.size("terms") > 1).limit(1).count() > 0
        found = lexical.occurrences(self.postings(lexical.asked_terms(asked)), asked, several)
        return lexical.bm25(found, self.statistics(), asked)

    def search(self, queries: DataFrame, records: DataFrame, k: int, types: tuple[str, ...] = ()) -> DataFrame:
        """(query_id, id, score, rank); records give the types."""
        asked = cut(lexical.plan(queries, self.stem))
        held = scan.stated(asked)
        if held is None or held.steps or not len(held.queries):
            return lexical.best(self.hits(queries), records, k, types)
        # Single terms of stated queries: a record's postings meet in a row, and each task sends its best.
        terms = [held.terms[int(p)].as_py() for p in range(len(held.phrases))]
        place = self.spark.createDataFrame([(t, i) for i, t in enumerate(terms)], "term string, phrase long")
        df = np.zeros(len(terms), dtype=np.int64)
        for r in self.frequencies().join(F.broadcast(place), "term").collect():
            df[r["phrase"]] = r["df"]
        posted = self._of(place.select("term"), "id", "term", "tf", "dl").join(F.broadcast(place), "term").select("id", "dl", (F.shiftleft("phrase", 32) + F.col("tf")).alias("both"))
        rows = posted.groupBy("id").agg(F.first("dl").alias("dl"), F.collect_list("both").alias("both"))
        packed = rows.select("id", "dl", F.transform("both", lambda x: F.shiftright(x, 32).cast("int")).alias("phrases"), F.transform("both", lambda x: x.bitwiseAND(F.lit(2**32 - 1)).cast("int")).alias("counts"))
        if types:
            packed = packed.join(records.where(F.col("type").isin(*types)).select("id"), "id", "left_semi")
        state = self._state()[1]
        return lexical.best(scan.hits(packed, held, df, state["records"], state["tokens"] / max(1, state["records"]), k), records, k)


def scratch_root(folder: str, name: str) -> str:
    return f"{folder}/{name}-{uuid.uuid4().hex}"
