"""Hashes of the heads of system prompts under some roots: what boot echoes are known by."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import HEAD_BYTES
from ..session import cut

# Names of system prompts, folders that hold none, and how deep they lie.
PROMPTS = ("CLAUDE.md", "MEMORY.md", "SOUL.md", "USER.md", "HARD-RULES.md")
SKIPPED = (
    ".git", "node_modules", "__pycache__", ".venv", "venv", "site-packages", ".mypy_cache", ".pytest_cache", ".ruff_cache",
    "sessions", "heartbeat", "monitoring", "session-cache",
)
SKIPPED_BELOW = {"projects": ".claude"}
DEPTH = 4

FOUND = "root string, path string, head binary"


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folders (root, path) to their folders that may hold prompts (head null) and the heads of their prompts."""
    from pyarrow import fs

    for batch in batches:
        out = []
        for root, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            system, _ = fs.FileSystem.from_uri(root if ":" in root else f"file://{root}")
            for info in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
                name, parent = info.base_name, path.rstrip("/").rsplit("/", 1)[-1]
                if info.type == fs.FileType.Directory and name not in SKIPPED and SKIPPED_BELOW.get(name) != parent:
                    out.append((root, info.path, None))
                elif info.type == fs.FileType.File and name in PROMPTS:
                    try:
                        with system.open_input_stream(info.path) as stream:
                            out.append((root, info.path, stream.read(HEAD_BYTES)))
                    except OSError:
                        continue  # unreadable: detection does what it can
        columns = list(zip(*out, strict=True)) if out else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.binary())], ["root", "path", "head"])


def prompt_heads(spark: SparkSession, roots: list[str], depth: int = DEPTH) -> DataFrame:
    """(head): distinct hashes of the first bytes of the prompts under the roots, down to `depth` folders below.

    The folders of a level are the frontier, a DataFrame; tasks list them and give
    the next one. Folders that are skipped are never listed. Empty heads don't count.
    """
    at = [(r.rstrip("/"), r.rstrip("/").split("://")[-1]) for r in roots]
    frontier = spark.createDataFrame(at, "root string, path string")
    heads = None
    for level in range(depth + 1):
        found = cut(frontier.repartition("path").mapInArrow(_listed, FOUND))
        some = found.where("length(head) > 0").select(F.sha2("head", 256).alias("head"))
        heads = some if heads is None else heads.unionByName(some)
        frontier = found.where("head is null").select("root", "path")
        if level == depth or not frontier.limit(1).count():
            break
    return heads.distinct()
