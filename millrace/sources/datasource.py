"""Folders of files as a Python data source, in batches and as a stream that waits until files are quiet.

    VaultFiles.register(spark)
    spark.read.format("vault_files").option("glob", "*.jsonl").load(root)        # a rescan
    spark.readStream.format("vault_files").option("quiet", 30).load(root)        # a watch

Rows have the columns of `files.files`, so its parsers and those of `transcripts`
take either. A stream's offset is a time: a batch holds every file whose last
change lies between two offsets, whole. A file is not taken in before its last
change is `quiet` seconds old, so a burst of writes gives one row; a file that
changes again is emitted again; and as the offset is in the checkpoint, a restart
loses nothing. A file that is moved in with a time older than the offset is left
to the next rescan. Folders are listed on the driver, files are read by tasks;
paths go by Arrow's file systems (local, HDFS, object stores).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from fnmatch import fnmatch

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from . import files, transcripts

SCHEMA = "path string, rel string, modified timestamp, length long, content binary"
#: Files of a task, and seconds that a watched file must be quiet.
TASK_FILES, QUIET = 64, 30.0


@dataclass
class Some(InputPartition):
    """Files of one task: (path, rel, nanoseconds of the last change, size)."""

    found: list[tuple[str, str, int, int]]


class Folder:
    """What both readers share: listing, and reading some files."""

    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/")
        self.globs = [g.strip() for g in options.get("glob", "*.md").split(",")]
        self.hidden = options.get("hidden", "false").lower() == "true"
        self.content = options.get("content", "true").lower() == "true"

    def listed(self) -> list[tuple[str, str, int, int]]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(self.root if ":" in self.root else f"file://{self.root}")
        out = []
        for info in system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)):
            rel = info.path[len(base) :].lstrip("/")
            if info.type == fs.FileType.File and any(fnmatch(rel.rsplit("/", 1)[-1], g) for g in self.globs) and (self.hidden or not any(p.startswith(".") for p in rel.split("/"))):
                out.append((info.path, rel, info.mtime_ns or 0, info.size))
        return sorted(out)

    def parted(self, found: list[tuple[str, str, int, int]]) -> list[Some]:
        return [Some(found[i : i + TASK_FILES]) for i in range(0, len(found), TASK_FILES)]

    def rows(self, part: Some) -> Iterator[tuple]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.root if ":" in self.root else f"file://{self.root}")
        for path, rel, changed, size in part.found:
            content = None
            if self.content:
                try:
                    with system.open_input_stream(path) as stream:
                        content = stream.read()
                except FileNotFoundError:
                    continue  # gone since it was listed
            yield path, rel, datetime.fromtimestamp(changed / 1e9, UTC), size, content


class Rescan(Folder, DataSourceReader):
    def partitions(self) -> list[Some]:
        return self.parted(self.listed()) or [Some([])]

    def read(self, partition: Some) -> Iterator[tuple]:
        return self.rows(partition)


class Watch(Folder, DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.quiet = float(options.get("quiet", QUIET))
        self.until = 0

    def initialOffset(self) -> dict:
        return {"until": 0}

    def latestOffset(self) -> dict:
        """The last change among files that are quiet, or the one before if nothing changed or the newest file was deleted."""
        border = int((datetime.now(UTC).timestamp() - self.quiet) * 1e9)
        self.until = max([self.until, *[changed for _, _, changed, _ in self.listed() if changed <= border]])
        return {"until": self.until}

    def partitions(self, start: dict, end: dict) -> list[Some]:
        return self.parted([f for f in self.listed() if start["until"] < f[2] <= end["until"]]) or [Some([])]

    def read(self, partition: Some) -> Iterator[tuple]:
        return self.rows(partition)

    def commit(self, end: dict) -> None:
        json.dumps(end)  # offsets lie in the checkpoint; nothing else is kept


class VaultFiles(DataSource):
    """Options: path, glob (comma-separated), hidden, content (false: names and times only), quiet (streams)."""

    @classmethod
    def name(cls) -> str:
        return "vault_files"

    @classmethod
    def register(cls, spark: SparkSession) -> None:
        spark.dataSource.register(cls)

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Rescan:
        return Rescan(self.options)

    def streamReader(self, schema: StructType) -> Watch:
        return Watch(self.options)


def parsed(rows: DataFrame, kind: str, source: str) -> DataFrame:
    """Source records of files: markdown, coding, rollout or trajectory."""
    if kind == "markdown":
        return files.typed_markdown(files.vault(rows), source)
    readers = {"coding": transcripts.coding_sessions, "rollout": transcripts.rollouts, "trajectory": transcripts.trajectories}
    return readers[kind](files.lines_of(rows), source)


def existing(spark: SparkSession, root: str, mapping: DataFrame, globs: str = "*.md,*.jsonl") -> DataFrame:
    """mapping (source, ref, ...) with `exists`: whether the ref's file is under the root, from one listing."""
    VaultFiles.register(spark)
    there = spark.read.format("vault_files").option("glob", globs).option("content", "false").option("hidden", "true").load(root)
    return mapping.join(there.select(F.col("path").alias("ref"), F.lit(True).alias("_there")).distinct(), "ref", "left").withColumn("exists", F.coalesce("_there", F.lit(False))).drop("_there")


def batch_rows(records: DataFrame, first: Column | int = 0) -> DataFrame:
    """Source records in the shape of a batch for ingest, in the order of their last change, then of their refs."""
    meta = lambda k: F.col("metadata")[k]
    stamp = lambda k: F.try_to_timestamp(meta(k))
    order = F.unix_micros(F.coalesce(stamp("updated"), stamp("created"), F.timestamp_seconds(F.lit(0))))
    return records.select((order + first).alias("arrival_seq"), "source", "ref", meta("type").alias("type"), "title", "body", "tags", stamp("created").alias("created"), stamp("updated").alias("updated"), meta("scope").alias("scope"), meta("session_id").alias("session_id"), meta("daily_date").alias("daily_date"), meta("daily_scope").alias("daily_scope"))
