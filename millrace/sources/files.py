"""File sources: Markdown trees, line files and images, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

# Fixed values.
SIZE_CAP = 50_000
DEDICATED = ("MEMORY.md", "CLAUDE.md", "HARD-RULES.md")
NOISY_NAMES = (
    r"^.*_FULL_\d{4}-\d{2}-\d{2}\.md$",
    r"^.*_REFERENCE_\d{4}-\d{2}-\d{2}\.md$",
    r"^.*-status-report-\d{4}-\d{2}-\d{2}\.md$",
    r"^INCIDENT-\d{4}-\d{2}-\d{2}\.md$",
    r"^RECOVERY-.+\.md$",
)


def relative(root: str) -> Column:
    plain = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    base = F.regexp_replace(F.lit(root.rstrip("/") + "/"), r"^[a-z]+:/+", "/")
    return F.replace(plain, base, F.lit(""))


def files(spark: SparkSession, root: str, glob: str = "*.md") -> DataFrame:
    """(path, rel, modified, length, content) of all files under a root."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return rows.select("path", relative(root).alias("rel"), F.col("modificationTime").alias("modified"), "length", "content")


def lines(spark: SparkSession, root: str, glob: str = "*.jsonl") -> DataFrame:
    return lines_of(files(spark, root, glob))


def lines_of(rows: DataFrame) -> DataFrame:
    """(path, rel, modified, line_no, value): the files' lines in order, which `spark.read.text` does not tell."""
    rows = rows.withColumn("value", F.decode("content", "UTF-8"))
    return rows.select("path", "rel", "modified", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "value"))


def vault(rows: DataFrame, types: tuple[str, ...] = ()) -> DataFrame:
    """Parsed Markdown records outside folders whose names begin with an underscore, by path."""
    kept = rows.where(~F.col("rel").rlike("(^|/)_[^/]*/"))
    out = frontmatter(kept.withColumn("body", F.decode("content", "UTF-8")))
    return out.where(F.col("header.type").isin(*types)) if types else out


def frontmatter(rows: DataFrame) -> DataFrame:
    """rows with `header` (string fields and lists of a YAML header, or an empty map) and the body below it.

    Only flat headers are read natively: `key: value`, quoted or not, and lists
    as `[a, b]` or as dashed lines, which come back comma-joined.
    """
    whole = r"(?s)^---\n(.*?)\n---\n?(.*)$"
    has = F.col("body").rlike(whole)
    head = F.when(has, F.regexp_extract("body", whole, 1)).otherwise("")
    flat = F.regexp_replace(head, r"\n\s*-\s+", ", - ")
    fields = F.filter(F.split(flat, "\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*:"))

    def value(x: Column) -> Column:
        raw = F.trim(F.regexp_replace(x, r"^[^:]*:", ""))
        listed = F.regexp_replace(F.regexp_replace(raw, r"^,?\s*-\s+|^\[|\]$", ""), r"\s*,\s*(-\s+)?", ",")
        return F.regexp_replace(listed, r"""^["']|["']$""", "")

    entries = F.transform(fields, lambda x: F.struct(F.regexp_extract(x, r"^([^:]*):", 1), value(x)))
    return rows.withColumn("header", F.map_from_entries(entries)).withColumn("body", F.when(has, F.regexp_extract("body", whole, 2)).otherwise(F.col("body")))


def typed_markdown(rows: DataFrame, source: str) -> DataFrame:
    """Source records of Markdown files (path, rel, modified, header, body): the file's name gives its type."""
    name = F.substring_index("rel", "/", -1)
    stem = F.regexp_replace(name, r"\.md$", "")
    type_ = F.when(name == "SKILL.md", "skill").when(name.rlike(r"^\d{4}-\d{2}-\d{2}\.md$"), "daily").otherwise("memory")
    folder = F.element_at(F.split("rel", "/"), -2)
    title = F.coalesce(F.col("header.title"), text.h1_title(F.col("body")), F.when((name == "SKILL.md") & (F.size(F.split("rel", "/")) > 1), folder).otherwise(stem))
    modified = F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    tags = F.coalesce(F.filter(F.split(F.col("header.tags"), ","), lambda t: t != ""), F.array().cast("array<string>"))
    return rows.select(
        F.lit(source).alias("source"),
        F.col("path").alias("ref"),
        title.alias("title"),
        "body",
        tags.alias("tags"),
        F.create_map(F.lit("type"), type_, F.lit("created"), F.coalesce(F.col("header.created"), modified), F.lit("updated"), F.coalesce(F.col("header.updated"), modified)).alias("metadata"),
    )


def user_skills(rows: DataFrame) -> DataFrame:
    """Files with no hidden part in their path."""
    return rows.where(~F.col("rel").rlike(r"(^|/)\."))


def workspace(spark: SparkSession, root: str, tag: str, layout: dict[str, tuple[str, ...]], source: str) -> DataFrame:
    """Records of a workspace: each glob of the layout with its role tags, and the agent's tag on all."""
    parts = []
    for glob, roles in layout.items():
        found = typed_markdown(frontmatter(files(spark, root, glob).withColumn("body", F.decode("content", "UTF-8"))), source)
        extra = F.array(*[F.lit(t) for t in (*roles, f"agent:{tag}")])
        parts.append(found.withColumn("tags", F.array_distinct(F.concat("tags", extra))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def extras(rows: DataFrame) -> DataFrame:
    """Files a workspace may index besides its layout: no dedicated or noisy name, not too large."""
    name = F.substring_index("rel", "/", -1)
    noisy = F.lit(False)
    for pattern in NOISY_NAMES:
        noisy = noisy | name.rlike(pattern)
    return rows.where(~name.isin(*DEDICATED) & ~noisy & (F.col("length") <= SIZE_CAP))


def recent(rows: DataFrame, days: int, now: Column) -> DataFrame:
    return rows.where(F.col("modified") >= now - F.make_dt_interval(F.lit(days)))


def tagged(rows: DataFrame, tag: str) -> DataFrame:
    """rows with a tag that is added once, however often."""
    return rows.withColumn("tags", F.array_union("tags", F.array(F.lit(tag))))


def write_vault(records: DataFrame, path: str) -> None:
    """Records as Parquet by type; Spark's commit makes the write all or nothing."""
    records.write.mode("overwrite").partitionBy("type").parquet(path)


def markdown(records: DataFrame) -> DataFrame:
    """(path, content): records as Markdown with a header of their set fields."""
    fields = ("id", "type", "created", "updated", "source", "title", "importance", "scope")
    parts = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in fields if c in records.columns]
    tags = F.when(F.size("tags") > 0, F.concat(F.lit("tags: ["), F.array_join("tags", ", "), F.lit("]")))
    head = F.array_join(F.array_compact(F.array(*parts, tags)), "\n")
    return records.select("path", F.concat(F.lit("---\n"), head, F.lit("\n---\n"), F.col("body")).alias("content"))
