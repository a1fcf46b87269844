"""Secret scans in Spark SQL functions only: fixed patterns, and Markov models of characters.

Two Markov models of characters, one of random strings and one of ordinary
identifiers, are trained from labelled samples. A character depends on the one
before and on the kind (upper, lower, digit, other, none) of the one before that,
backed off to the one before. Labelled random are the values that the fixed
patterns find and encoded digests of ids (see `samples`); labelled ordinary are the
other runs of the same characters, alone and joined as identifiers are. A run of
RUN or more such characters is a secret, too, if its log-likelihood ratio
between the two models is high enough.

Spark finds all matches of a pattern but not their places; cutting the text at
the same matches gives the pieces between, and running sums of lengths the places.
Spans are gathered in linear time; redaction looks at each gap once for every 32
blocks of 4,096 characters and again in its own. A text with matches is held a few times
over by its task, so the longest text must be a small share of a task's memory.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, outer_id, table

# The patterns of the kinds, the group and least length that count, in order.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Kinds of the character before last: upper, lower, digit, other, none.
KINDS_BEFORE = "uldo^"
RUN = 12
RUN_PATTERN = rf"[A-Za-z0-9+/_=-]{{{RUN},}}"
#: Least log-likelihood ratio of a run, in all and per transition, and least number of different characters.
LEAST, LEAST_EACH, LEAST_DISTINCT = 20.0, 1.4, 6
#: Weight of the first-order model where the second order has few counts.
BACK_OFF = 8.0
#: Documents that training reads at most.
SAMPLE = 2000
#: Characters of a block of a text that is redacted.
BLOCK = 4096

SPAN = "struct<start:int,kind_no:int,end:int,kind:string>"
SPANS = f"array<{SPAN}>"


def once(value: Column, use) -> Column:
    """use(value) with value computed once, even where use has it within a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def scanned(values: Column, how) -> Column:
    """Running how(a, b) of an array, in log2(size) passes."""

    def all_passes(values: Column) -> Column:
        passes = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)) + 0.0)).cast("int"))

        def one(acc: Column, k: Column) -> Column:
            width = F.pow(F.lit(2.0), k).cast("int")
            return F.transform(acc, lambda x, i: how(x, F.coalesce(F.get(acc, i - width), F.lit(0))))

        return F.aggregate(passes, values, one)

    return once(values, all_passes)


def _spans(text: Column, number: int, kind: str, pattern: str, keep) -> Column:
    """Spans of the matches of a pattern that keep(match, group 2 or match) accepts; most texts have none."""
    regex = F.lit(pattern)

    def span(x: Column) -> Column:
        start = x["end"] - F.char_length(x["match"])
        kept = F.struct(start.alias("start"), F.lit(number).alias("kind_no"), x["end"].alias("end"), F.lit(kind).alias("kind"))
        return F.when(keep(x["match"], x["group"]), kept)

    def placed(matches: Column) -> Column:
        group = F.regexp_extract_all(text, regex, F.lit(2)) if kind == "assign" else matches
        between = F.slice(F.split(text, pattern, -1), 1, F.size(matches))
        ends = scanned(F.zip_with(between, matches, lambda x, y: F.char_length(x) + F.char_length(y)), lambda x, y: x + y)
        parts = F.arrays_zip(ends.alias("end"), matches.alias("match"), group.alias("group"))
        return F.filter(F.transform(parts, span), lambda s: s.isNotNull())

    found = once(F.regexp_extract_all(text, regex, F.lit(0)), placed)
    return F.when(F.regexp_like(text, regex), found).otherwise(F.array().cast(SPANS))


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, by start and kind; leftmost and non-overlapping per kind."""
    each = [_spans(text, i, kind, pattern, lambda match, group, least=least: F.char_length(group) >= least) for i, (kind, pattern, _, least) in enumerate(KINDS)]
    return F.array_sort(F.concat(*each))


def samples(docs: DataFrame, size: int = SAMPLE) -> DataFrame:
    """(label, token): labelled samples, 1 random and 0 ordinary, of the `size` documents with the lowest hashes of their ids.

    Random: values of the fixed patterns, and a digest of the id in hexadecimal
    of both cases, base64, and base64 without its signs, also in one case.
    Ordinary: runs of token characters that no fixed pattern covers, and pairs of
    neighbouring words joined by a sign or by a capital.
    """
    ids = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)  # bounded
    taken = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    digest = F.sha2(F.col("doc_id").cast("string"), 256)
    signed = F.base64(F.unhex(digest))
    plain = F.regexp_replace(signed, "[+/=]", "")
    encoded = F.array(F.substring(digest, 1, 40), F.upper(F.substring(digest, 41, 24)), signed, plain, F.upper(F.substring(plain, 1, 24)), F.lower(F.substring(plain, 20, 24)))
    values = F.concat(*[F.regexp_extract_all("text", F.lit(pattern), F.lit(group)) for _, pattern, group, _ in KINDS])
    random = taken.select(F.lit(1).alias("label"), F.explode(F.concat(encoded, values)).alias("token")).where(F.char_length("token") >= 6)
    bare = F.col("text")
    for _, pattern, _, _ in KINDS:
        bare = F.regexp_replace(bare, pattern, " ")
    runs = F.regexp_extract_all(bare, F.lit(r"[A-Za-z0-9+/_=-]{2,}"), F.lit(0))
    words = F.regexp_extract_all(bare, F.lit(r"[A-Za-z]{3,}"), F.lit(0))
    ways = (lambda a, b: F.concat(a, F.lit("_"), b), lambda a, b: F.concat(a, F.lit("-"), b), lambda a, b: F.concat(F.lower(a), F.initcap(b)), lambda a, b: F.upper(F.concat(a, F.lit("_"), b)))

    def neighbours(all_words: Column) -> Column:
        pairs = F.transform(all_words, lambda w, i: F.struct(w.alias("a"), F.get(all_words, i + 1).alias("b"), (i % 64).alias("way")))
        some = F.filter(pairs, lambda p: p["b"].isNotNull() & (p["way"] < len(ways)))
        return F.transform(some, lambda p: F.element_at(F.array(*[way(p["a"], p["b"]) for way in ways]), p["way"] + 1))

    joined = once(words, neighbours)
    return random.union(taken.select(F.lit(0).alias("label"), F.explode(F.concat(runs, joined)).alias("token")))


def train(docs: DataFrame, size: int = SAMPLE) -> list[float]:
    """Log-likelihood ratios of all transitions, random over ordinary, by kind before last, character before, character.

    What comes back to the driver is one count per label, kind and pair of
    characters, at most 2 * len(KINDS_BEFORE) * len(ALPHABET) ** 2 numbers.
    """
    n = len(ALPHABET)
    kinds = F.concat(F.lit("^"), F.translate("token", ALPHABET, "".join("uldo"[(i >= 26) + (i >= 52) + (i >= 62)] for i in range(n))))
    letters = F.arrays_zip(F.split("token", "").alias("letter"), F.split(kinds, "").alias("before"))

    def steps(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.char_length("token") - 2), lambda i: F.concat(F.get(x, i)["before"], F.get(x, i)["letter"], F.get(x, i + 1)["letter"]))

    tokens = samples(docs, size).where(F.char_length("token") >= 2).groupBy("label", "token").count()
    counts = tokens.select("label", "count", F.explode(once(letters, steps)).alias("step")).groupBy("label", "step").agg(F.sum("count").alias("count")).collect()
    seen = [[[[0] * n for _ in range(n)] for _ in KINDS_BEFORE] for _ in range(2)]
    first = [[[0.5] * n for _ in range(n)] for _ in range(2)]
    for row in counts:
        k, a, b = KINDS_BEFORE.find(row["step"][0]), *(ALPHABET.find(c) for c in row["step"][1:])
        if k >= 0 and a >= 0 and b >= 0:
            seen[row["label"]][k][a][b] += row["count"]
            first[row["label"]][a][b] += row["count"]
    ratio = []
    for k in range(len(KINDS_BEFORE)):
        for a in range(n):
            deep = [sum(seen[label][k][a]) for label in (0, 1)]
            flat = [sum(first[label][a]) for label in (0, 1)]
            for b in range(n):
                p = [(seen[label][k][a][b] + BACK_OFF * first[label][a][b] / flat[label]) / (deep[label] + BACK_OFF) for label in (0, 1)]
                ratio.append(round(math.log(p[1] / p[0]), 4))
    return ratio


def ratio_of(token: Column, ratios: list[float]) -> Column:
    """Log-likelihood ratio of a token's characters, random over ordinary."""
    table_ = F.from_json(F.lit(json.dumps(ratios)), "array<double>")  # a constant of as many numbers as `train` gives
    n = len(ALPHABET)
    codes = F.transform(F.split(token, ""), lambda c: F.position(c, F.lit(ALPHABET)) - 1)

    def total(code: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            a, b, c = F.get(code, i), F.get(code, i + 1), F.get(code, i - 1)
            kind = F.when(c.isNull(), 4).when(c < 26, 0).when(c < 52, 1).when(c < 62, 2).otherwise(3)
            return acc + F.when((a >= 0) & (b >= 0), F.get(table_, (kind * n + a) * n + b)).otherwise(0.0)

        return F.aggregate(F.sequence(F.lit(0), F.char_length(token) - 2), F.lit(0.0), step)

    return once(codes, total)


def markov_spans(text: Column, ratios: list[float], least: float = LEAST, least_each: float = LEAST_EACH) -> Column:
    def keep(match: Column, _: Column) -> Column:
        ratio = ratio_of(match, ratios)
        varied = F.size(F.array_distinct(F.split(match, ""))) > LEAST_DISTINCT  # the split gives an empty end, too
        return varied & once(ratio, lambda r: (r >= least) & (r >= least_each * (F.char_length(match) - 1)))

    return _spans(text, len(KINDS), "markov", RUN_PATTERN, keep)


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, ratios: list[float] | None = None, size: int = SAMPLE) -> DataFrame:
    """docs with `base` and `spans`: spans of the fixed patterns, and those with what the models add.

    The models are trained on docs themselves unless ratios of `train` are given. docs has doc_id and text without nulls, as `common.documents` returns.
    Runs that lie within a base span are not added again; longer ones are, and overlap it. Places are code points.
    """
    ratios = train(docs, size) if ratios is None else ratios
    rows = docs.withColumn("base", base_spans(F.col("text")))
    own = F.lit(len(KINDS))

    def merged(both: Column) -> Column:
        reach = scanned(F.transform(both, lambda s: F.when(s["kind_no"] < own, s["end"]).otherwise(0)), lambda x, y: F.greatest(x, y))
        parts = F.filter(F.arrays_zip(both.alias("span"), reach.alias("reach")), lambda p: (p["span"]["kind_no"] < own) | (p["span"]["end"] > p["reach"]))
        return F.transform(parts, lambda p: p["span"])

    # of one start, fixed ones come first
    return rows.withColumn("spans", once(F.array_sort(F.concat("base", markov_spans(F.col("text"), ratios))), merged))


#: Blocks of a row, in redaction.
ROW = 32


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with its spans (sorted by start, perhaps overlapping) replaced by a mark each run.

    What stays are the gaps between runs; each block of the text gives its parts of them.
    """
    reach = scanned(F.transform(spans, lambda s: s["end"]), lambda x, y: F.greatest(x, y))
    gaps = F.transform(F.arrays_zip(spans.alias("span"), F.concat(F.array(F.lit(0)), reach).alias("at")), lambda p: F.struct(p["at"].alias("a"), F.coalesce(p["span"]["start"], F.char_length(text)).alias("e"), p["span"].isNotNull().alias("marked")))
    gaps = F.filter(gaps, lambda g: g["e"] >= g["a"])
    blocks = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def part(block: Column, low: Column, g: Column) -> Column:
        a, e = F.greatest(g["a"], low), F.least(g["e"], low + BLOCK)
        kept = F.when(e > a, F.substring(block, a - low + 1, e - a)).otherwise("")
        return F.concat(kept, F.when(g["marked"] & ends(g, low, BLOCK), F.lit(mark)).otherwise(""))

    def ends(g: Column, low: Column, size: int) -> Column:
        return (g["e"] <= low + size) & ((g["e"] > low) | (low == 0))

    def meeting(all_gaps: Column, low: Column, size: int) -> Column:
        return F.filter(all_gaps, lambda g: ((g["a"] < low + size) & (g["e"] > low)) | ends(g, low, size))

    def block_of(all_gaps: Column) -> Column:
        """Gaps are dealt to rows of blocks first and to blocks then, so no block looks at all of them."""

        def one(block: Column, low: Column, gaps_: Column) -> Column:
            return F.array_join(F.transform(meeting(gaps_, low, BLOCK), lambda g: part(block, low, g)), "")

        rows = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(blocks) - 1) / ROW).cast("int")),
            lambda r: F.struct((r * ROW * BLOCK).alias("low"), F.slice(blocks, r * ROW + 1, F.lit(ROW)).alias("blocks"), meeting(all_gaps, r * ROW * BLOCK, ROW * BLOCK).alias("gaps")),
        )
        return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r["blocks"], lambda block, i: one(block, r["low"] + i * BLOCK, r["gaps"])), "")), "")

    return F.when(F.size(spans) > 0, once(gaps, block_of)).otherwise(text)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document. Null and empty texts have no spans; repeated rows and null ids: see `common`."""
    docs = documents(table(spark, sf_dir, "documents"))
    found = find_secrets(docs)

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        (F.col("given") if "given" in docs.columns else outer_id()).alias("doc_id"),
        *[count(kind) for kind, *_ in KINDS],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
