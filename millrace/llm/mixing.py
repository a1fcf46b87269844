"""Mixing sources to target weights by a time-varying curriculum.

Every source has a weight schedule over training time t in [0, 1],
w(t) = W * (1 + slope * (2t - 1)). Its integral from 0 to t gives the share of
the source's target that has been asked for by then, t + slope * (t*t - t).
Documents of a source stand in a fixed pseudo-random order; the words before a
document (plus whole earlier passes) over the source's target is the demand at
which it is due, and inverting the integral gives its training position.
Sorting all documents by position by range interleaves the sources as scheduled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, table, written

WEIGHTS = (1, 2, 3)
CAP = 3
#: Slope of each source's schedule, repeating by rank: early, level, late.
SLOPES = (-0.5, 0.0, 0.5)
#: Documents of one source that are summed up in one window.
RUN = 500


def _repeating(values: Sequence[float], rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(rank - 1, F.lit(len(values))) + 1).cast("int"))


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, rank, n_docs, source_size, target): weighted shares of all words, capped.

    Water filling in closed form: with the sources in the order of cap over
    weight, each prefix of capped sources leaves one level for the rest; the level
    rises while capped sources are set aside and falls afterwards, so the highest
    is the level of the mix.
    One row per source; only these rows meet in one window.
    """
    per = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("rank", F.row_number().over(by_name))
    per = per.withColumn("weight", _repeating([float(w) for w in weights], F.col("rank")))
    per = per.withColumn("most", F.col("source_size").cast("double") * cap)
    order = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("rank").asc())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    per = per.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    target = F.least("most", F.max("level").over(whole) * F.col("weight"))
    return per.select("source", "rank", "n_docs", "source_size", target.alias("target"))


def mix(documents: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = CAP, slopes: Sequence[float] = SLOPES, seed: str = "mix") -> DataFrame:
    """One row per input row: (doc_id, source, size, source_size, target, taken, positions).

    taken counts the words the mix takes from the document, repeats included: whole
    passes over the source, then a last pass that stops, inside a document if
    need be, where the target (rounded) is reached; at most `cap` times its size.
    positions are the training positions, in words of the whole mix, at which
    the document's passes start; empty if nothing of it is taken. Null or empty
    texts have size 0 and are never taken; a null source is a source of its own,
    last in order; rows that repeat a doc_id stay rows of their own, in the
    order of their sizes; an empty table gives an empty result.
    """
    sized = documents.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    # Rows without an id, or of one id, are told apart by their sizes, so they are not one run.
    key = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"))
    sized = written(sized.withColumn("order_key", F.md5(key)), "sizes")
    targets = written(source_targets(sized, weights, cap), "targets")

    rows = sized.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("d.*", "t.rank", "t.n_docs", "t.source_size", "t.target")
    # The order within a source is cut into runs, so that no source is summed up in one task.
    runs = F.ceil(F.col("n_docs") / F.lit(RUN))
    rows = rows.withColumn("run", F.floor(F.conv(F.substring("order_key", 1, 8), 16, 10).cast("double") * runs / F.lit(2.0**32)))
    run_sums = rows.groupBy("rank", "run").agg(F.sum("size").alias("run_size"))
    earlier = Window.partitionBy("rank").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    run_sums = run_sums.select("rank", "run", F.coalesce(F.sum("run_size").over(earlier), F.lit(0)).alias("run_start"))
    within = Window.partitionBy("rank", "run").orderBy("order_key", F.col("doc_id"), "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0))).join(run_sums, ["rank", "run"])

    start, size, whole = F.col("run_start") + F.col("inner"), F.col("size"), F.col("source_size")
    asked = F.floor(F.col("target") + 0.5)
    passes = F.when(whole > 0, F.floor(asked / whole)).otherwise(F.lit(0)).cast("long")
    rest = asked - passes * whole
    rows = rows.withColumn("start", start).withColumn("taken", (passes * size + F.greatest(F.lit(0), F.least(size, rest - start))).cast("long"))
    slope = _repeating([float(s) for s in slopes], F.col("rank"))
    total = F.lit(1.0) * F.col("all_words")

    def position(k: Column) -> Column:
        demand = (F.col("start") + k * whole) / F.col("target")
        b = 1.0 - slope
        return total * F.when(slope == 0.0, demand).otherwise(F.abs((F.sqrt(b * b + 4.0 * slope * demand) - b) / (2.0 * slope)))

    times = F.when(F.col("taken") > 0, F.ceil(F.col("taken") / size)).otherwise(F.lit(0)).cast("int")
    all_words = targets.agg(F.sum("source_size").alias("all_words"))
    rows = rows.crossJoin(F.broadcast(all_words))  # one row
    positions = F.when(times > 0, F.transform(F.sequence(F.lit(0), times - 1), position)).otherwise(F.array().cast("array<double>"))
    return rows.select("doc_id", "source", size, whole.alias("source_size"), "target", "taken", positions.alias("positions"))


def schedule(mixed: DataFrame) -> DataFrame:
    """One row per pass over a document, range-sorted by training position."""
    passes = mixed.select("*", F.explode("positions").alias("position"))
    return passes.repartitionByRange(F.col("position"), F.col("doc_id")).sortWithinPartitions("position", "doc_id")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    first = F.try_element_at("positions", F.lit(1)).alias("first_position")
    out = mixed.select("doc_id", "size", "source_size", "target", "taken", first)
    return out.repartitionByRange(F.col("first_position").asc_nulls_last(), F.col("doc_id")).sortWithinPartitions(F.col("first_position").asc_nulls_last(), "doc_id")


OP7_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::VARCHAR) AS order_key
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS rank
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, ((rank - 1) % 3 + 1)::DOUBLE AS weight, source_size * 3.0::DOUBLE AS most FROM per),
leveled AS (
  SELECT *, (sum(source_size) OVER ()
     - coalesce(sum(most) OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
     / sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targets AS (
  SELECT *, sum(source_size) OVER () AS all_words,
     least(most, max(level) OVER () * weight) AS target,
     [-0.5, 0.0, 0.5][((rank - 1) % 3 + 1)::INT]::DOUBLE AS slope
  FROM leveled),
placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.slope, t.all_words,
     coalesce(sum(d.size) OVER (PARTITION BY t.rank ORDER BY d.order_key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
     floor(t.target + 0.5)::BIGINT AS asked
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
taken AS (
  SELECT *, CASE WHEN source_size > 0 THEN asked // source_size ELSE 0 END AS passes FROM placed),
counted AS (
  SELECT *, (passes * size + greatest(0, least(size, asked - passes * source_size - start)))::BIGINT AS taken FROM taken)
SELECT doc_id, size, source_size, target, taken,
  CASE WHEN taken > 0 THEN all_words::DOUBLE * CASE WHEN slope = 0 THEN start / target
    ELSE abs((sqrt((1.0::DOUBLE - slope) * (1.0::DOUBLE - slope) + 4.0::DOUBLE * slope * (start / target)) - (1.0::DOUBLE - slope)) / (2.0::DOUBLE * slope)) END END AS first_position
FROM counted
"""
