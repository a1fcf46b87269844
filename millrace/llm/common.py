"""What the operators of this subpackage share: input columns, scratch tables, query sets.

Defined results that hold for every operator here: only the named columns are
read, so extra columns with any name do no harm; a null text is an empty text;
rows equal in doc_id and text are one document, and rows that share a doc_id, or
have none, but differ in text are documents of their own, each with a row in the
result under the id it came with. In id order a null doc_id is first, and texts
of one doc_id follow one another in text order.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id while documents are compared; turned back by `outer_id`.
NO_ID = -(2**63)
#: Words of all contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def outer_id(name: str = "doc_id") -> Column:
    return F.when(F.col(name) != F.lit(NO_ID), F.col(name))


def documents(df: DataFrame, *more: str) -> DataFrame:
    """(doc_id, text, *more) with one row per doc_id and text, no null in the first two and no doc_id twice.

    Where ids repeat with different texts, doc_id is an inner key in (id, text)
    order, written so that it stays the same, and a column `given` has the ids;
    `given_ids` puts them back.
    """
    rows = df.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *[F.col(c) for c in more],
    )
    repeated = rows.groupBy("doc_id").count().where("count > 1").limit(1).count()
    if not repeated:
        return rows
    if more:
        rows = rows.groupBy("doc_id", "text").agg(F.min(F.struct(*more)).alias("least")).select("doc_id", "text", "least.*")
    else:
        rows = rows.distinct()
    if not rows.groupBy("doc_id").count().where("count > 1").limit(1).count():
        return rows
    order = ["doc_id", "text"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("key", F.monotonically_increasing_id())
    return written(placed.select(F.col("key").alias("doc_id"), "text", *more, outer_id().alias("given")), "documents")


def given_ids(out: DataFrame, docs: DataFrame, *columns: str) -> DataFrame:
    """out with the ids that the documents came with in its columns (doc_id unless named)."""
    names = out.columns
    for c in columns or ("doc_id",):
        if "given" in docs.columns:
            ids = docs.select(F.col("doc_id").alias(c), F.col("given").alias("_given"))
            out = out.join(ids, c, "left").withColumn(c, F.col("_given")).select(names)
        else:
            out = out.withColumn(c, outer_id(c))
    return out


def for_labels(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to learn from: labels know the ids that documents came with; of an id's texts the least is learnt."""
    if "given" not in docs.columns:
        return docs
    return docs.where(F.col("given").isNotNull()).groupBy(F.col("given").alias("doc_id")).agg(F.min("text").alias("text"))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only where none is named and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
    own = tempfile.mkdtemp(prefix="millrace-scratch-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back.

    The files stay until the folder's owner clears it; they are scratch.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tokenizer_dir() -> str:
    return os.environ.get("MILLRACE_TOKENIZERS", "/opt/tokenizers")


Query = Callable[[SparkSession, str], DataFrame]
