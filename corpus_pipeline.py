"""The corpus pipeline: each stage reads what the one before it wrote.

toxicity: documents that the classifier chain rejects go.
near-duplicates: of each class of near-duplicates the lowest id stays; rows go only if their text has a kept copy.
decontamination: documents that contain a benchmark item go.
secrets: secrets in the texts are replaced by a mark.
mixing: how much of each document the mix takes, and when in training.

In all stages: a null text is an empty one (and stays null in the table unless it
was rewritten), texts of any length are judged whole, columns besides those of
documents are not read, and an empty table gives an empty one. Rows without an id,
or of one id with different texts, are documents of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import documents, outer_id, table, written
from millrace.llm.containment import without_contaminated
from millrace.llm.dartminhash import near_classes
from millrace.llm.mixing import mix
from millrace.llm.secrets import find_secrets, redacted
from millrace.llm.toxicity import without_toxic

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Classifiers, MinHash and Markov models can't be written in SQL; see the tests.
ORACLE_SQL = None

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row is kept or not by its own text: repeated rows share a fate, rows without an id stay if their text is clean; empty texts are clean."""
    return without_toxic(docs.select(COLUMNS), table(spark, sf_dir, "labels"))


def outer_ids(rows: DataFrame) -> DataFrame:
    """What `documents` returned, with the ids it came with."""
    return rows.withColumn("doc_id", F.col("given") if "given" in rows.columns else outer_id())


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows equal in id and text become one, whatever their lang and source: the least of these by (lang, source, n_chars).

    Of a class the row with the least id stays, one without an id before all, ties by
    text. Texts of fewer than five words are near copies of texts of the same words only.
    """
    rows = documents(docs, "lang", "source", "n_chars")
    first = near_classes(rows).where("doc_id = class_id").select("doc_id")
    return outer_ids(rows.join(first, "doc_id", "left_semi")).select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row is kept or not by its own text; repeated rows share a fate. Items without a word contaminate nothing."""
    return without_contaminated(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """No row goes, but rows equal in id and text become one. Overlapping secrets get one mark; n_chars is the new length where there was any."""
    rows = documents(docs, "lang", "source", "n_chars")
    found = find_secrets(rows).withColumn("clean", redacted(F.col("text"), F.col("spans")))
    length = F.when(F.size("spans") > 0, F.char_length("clean").cast("long")).otherwise(F.col("n_chars"))
    return outer_ids(found).select("doc_id", F.col("clean").alias("text"), "lang", "source", length.alias("n_chars"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per row, repeated ones too; a null source is a source of its own; documents without a word are never taken."""
    return mix(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicate),
    ("decontamination", decontamination),
    ("secrets", secret_scan),
    ("mixing", mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
