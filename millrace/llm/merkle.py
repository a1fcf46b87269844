"""Document fingerprints: a Merkle tree over paragraphs and sections, in Spark SQL functions only.

A leaf is a piece of a paragraph: it ends with a line break, or with punctuation
and a blank; where there is none for PIECE characters, at a blank after certain
characters, or after certain other ones, or else there. A section is a run of leaves that ends after a label
whose last digit is 0, 4, 8 or c (or after 16 labels without one), so that inserting or deleting a piece moves no
border but its own; sections form sections of sections in the same way, level
by level. A label is the start of the SHA-256 of the piece, or of the labels
below. The fingerprint is the SHA-256 of the lowest level's labels (the root: equal
roots mean equal texts), and the labels of the lowest level that has at most
MOST of them: some 2,300 characters at most, however long the text.

Where fingerprints differ, `likeness` compares their labels at a common level,
and `edit_range` descends from the sections that differ to their leaves, which
locates an edit to a piece.

Memory: the labels of a text's leaves are held, about as large as the text, and a
few copies of both.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, given_ids, table, written

#: Most characters of a leaf.
PIECE = 400
# Frequent characters after which a leaf ends where there is neither punctuation nor a blank for long.
ENDS = "07kqzKQZ的了是一のはをい다는이가"
LEAF = (
    rf"(?s).{{0,{PIECE - 2}}}?(?:[!-/:-@\[-`{{-~]\x20|\n)"
    rf"|.{{64,{PIECE - 2}}}?[aeiou0-4]\x20"
    rf"|.{{64,{PIECE - 1}}}?[{ENDS}]"
    rf"|.{{1,{PIECE}}}"
)
#: A run of at most 16 labels up to one that ends a section, or 16, or the rest.
SECTION = r"(?:[0-9a-f]{15}[1235679abdef] ){0,15}[0-9a-f]{15}[048c] |(?:[0-9a-f]{16} ){1,16}"
#: Hex digits of a label, and most labels in a fingerprint.
DIGITS, MOST = 16, 128
#: More levels than any text needs: each has about a quarter of the labels of the one below.
LEVELS = 20
#: Documents that one window holds, up to RUNS windows; with more documents windows grow, and Spark spills them.
RUN, RUNS = 500, 65_536


def once(value: Column, use) -> Column:
    """use(value) with value computed once, even where use has it within a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def label(piece: Column) -> Column:
    return F.substring(F.sha2(piece, 256), 1, DIGITS)


def leaves(text: Column) -> Column:
    """The pieces of a text, in order; they concatenate to it."""
    return F.regexp_extract_all(text, F.lit(LEAF), F.lit(0))


def labels(text: Column) -> Column:
    """Labels of the leaves, in order. An empty text has none."""
    return F.transform(leaves(text), label)


def sections(below: Column) -> Column:
    """The runs of labels that form the sections of a level, each label with a blank after it."""
    return F.regexp_extract_all(F.concat(F.array_join(below, " "), F.when(F.size(below) > 0, F.lit(" ")).otherwise("")), F.lit(SECTION), F.lit(0))


def above(below: Column) -> Column:
    """Labels of the next level."""
    return F.transform(sections(below), label)


def fingerprint(leaf_labels: Column) -> Column:
    """root:level:labels of the lowest level with at most MOST labels; of a text's leaf labels."""

    def shortened(lowest: Column) -> Column:
        start = F.struct(F.lit(0).alias("level"), lowest.alias("labels"))

        def up(acc: Column, _: Column) -> Column:
            return F.when(F.size(acc["labels"]) <= MOST, acc).otherwise(F.struct((acc["level"] + 1).alias("level"), above(acc["labels"]).alias("labels")))

        def shown(acc: Column) -> Column:
            # LEVELS are enough but for once in 4^LEVELS texts of one piece repeated; then the root stands alone
            few = F.when(F.size(acc["labels"]) <= MOST, F.array_join(acc["labels"], "")).otherwise("")
            return F.concat(acc["level"].cast("string"), F.lit(":"), few)

        return F.concat(F.sha2(F.array_join(lowest, ""), 256), F.lit(":"), F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), start, up, shown))

    return once(leaf_labels, shortened)


def root(print_: Column) -> Column:
    return F.substring_index(print_, ":", 1)


def level_of(print_: Column) -> Column:
    return F.split_part(print_, F.lit(":"), F.lit(2)).cast("int")


def labels_of(print_: Column) -> Column:
    return F.regexp_extract_all(F.split_part(print_, F.lit(":"), F.lit(3)), F.lit(rf"[0-9a-f]{{{DIGITS}}}"), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of the labels of two fingerprints at the higher of their levels, 0 to 1; 1 for equal roots."""

    def lifted(print_: Column, other: Column) -> Column:
        steps = F.greatest(level_of(other) - level_of(print_), F.lit(0))
        return F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), labels_of(print_), lambda acc, i: F.when(i <= steps, above(acc)).otherwise(acc))

    def dice(both: Column) -> Column:
        shared = F.size(F.array_intersect(both["a"], both["b"])).cast("double")
        return 2.0 * shared / F.greatest(F.size(F.array_distinct(both["a"])) + F.size(F.array_distinct(both["b"])), F.lit(1))

    return F.when(root(a) == root(b), 1.0).otherwise(once(F.struct(lifted(a, b).alias("a"), lifted(b, a).alias("b")), dice))


def common_prefix(a: Column, b: Column) -> Column:
    """How many labels two arrays have in common at their start."""
    first = F.array_position(F.zip_with(a, b, lambda x, y: F.equal_null(x, y)), F.lit(False))
    return F.when(first == 0, F.size(a)).otherwise(first - 1).cast("int")


def edit_range(a: Column, b: Column) -> Column:
    """(first, end): the leaves of a, as a range, outside of which it is as b; of two arrays of leaf labels.

    Sections are compared first, from both ends; leaves only within the first
    and the last section that differ.
    """

    def agreeing(a_: Column, b_: Column) -> Column:
        def by_sections(s: Column) -> Column:
            same = common_prefix(s["a"], s["b"])
            before = F.aggregate(F.slice(s["a"], 1, same), F.lit(0), lambda acc, x: acc + F.floor(F.char_length(x) / (DIGITS + 1)).cast("int"))
            # within the first section that differs (or what is left)
            inner = common_prefix(F.split(F.coalesce(F.get(s["a"], same), F.lit("")), " "), F.split(F.coalesce(F.get(s["b"], same), F.lit("")), " "))
            return before + F.when(same < F.size(s["a"]), inner).otherwise(0)

        return once(F.struct(sections(a_).alias("a"), sections(b_).alias("b")), by_sections)

    def both_ends(x: Column) -> Column:
        front = F.least(agreeing(x["a"], x["b"]), F.size(x["a"]), F.size(x["b"]))
        back = common_prefix(F.reverse(x["a"]), F.reverse(x["b"]))
        back = F.least(back, F.size(x["a"]) - front, F.size(x["b"]) - front)
        return F.struct(front.alias("first"), (F.size(x["a"]) - back).alias("end"))

    return once(F.struct(a.alias("a"), b.alias("b")), both_ends)


def _run_of(doc_id: Column, splitters: list[int]) -> Column:
    """Number of splitters at or above doc_id: 0 for the highest ids. Two steps of a wide search."""
    if not splitters:
        return F.lit(0)
    width = max(1, int(len(splitters) ** 0.5))
    blocks = [splitters[i : i + width] for i in range(0, len(splitters), width)]  # ascending
    nested = F.from_json(F.lit(json.dumps(blocks)), "array<array<bigint>>")  # constants of at most RUNS numbers
    # blocks wholly below doc_id
    below = F.size(F.filter(F.from_json(F.lit(json.dumps([b[-1] for b in blocks])), "array<bigint>"), lambda x: x < doc_id))
    inside = F.coalesce(F.size(F.filter(F.try_element_at(nested, below + 1), lambda x: x < doc_id)), F.lit(0))
    return F.lit(len(splitters)) - (below * width + F.greatest(inside, F.lit(0)))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text, leaves, next_leaves): each document beside the next in descending doc_id.

    Ids are cut into runs at their quantiles; a run meets in one window, and the
    head of each run is sent to the run before it as well, so the texts are
    shuffled once. The last document's next is the first.
    """
    spark = docs.sparkSession
    ids = written(docs.select("doc_id"), "ids")
    n = ids.count()
    if not n:
        return docs.select("doc_id", "text", F.col("text").alias("next_text"), labels(F.col("text")).alias("leaves"), labels(F.col("text")).alias("next_leaves"))
    wanted = min(RUNS, -(-n // RUN))
    splitters: list[int] = []
    if wanted > 1:
        shares = [i / wanted for i in range(1, wanted)]
        splitters = sorted(set(ids.agg(F.percentile_approx("doc_id", shares, 10 * wanted)).first()[0]))
    run = _run_of(F.col("doc_id"), splitters)
    # At most RUNS rows: the head of each run and the run before it, around the ring.
    heads = ids.groupBy(run.alias("run")).agg(F.max("doc_id").alias("doc_id")).orderBy("run").collect()
    ring = [(h["doc_id"], heads[i - 1]["run"]) for i, h in enumerate(heads)]
    sent = spark.createDataFrame(ring, "doc_id long, before int")
    rows = docs.withColumn("run", run).join(F.broadcast(sent), "doc_id", "left")
    dealt = F.array_compact(F.array(F.struct(F.col("run").alias("run"), F.lit(False).alias("guest")), F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("run"), F.lit(True).alias("guest")))))
    rows = rows.select("doc_id", "text", F.explode(dealt).alias("to")).select("doc_id", "text", "to.run", "to.guest")
    rows = rows.repartition("run").withColumn("leaves", labels(F.col("text")))
    order = Window.partitionBy("run").orderBy("guest", F.col("doc_id").desc())
    rows = rows.withColumn("next", F.lead(F.struct("text", "leaves")).over(order)).where(~F.col("guest"))
    return rows.select("doc_id", "text", "leaves", F.col("next.text").alias("next_text"), F.col("next.leaves").alias("next_leaves"))


def edited(text: Column, next_text: Column) -> Column:
    """The last floor(n/2) code points replaced by the first as many (or all) of the next text."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(next_text, F.lit(1), half))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: (doc_id, text, edited_text, fingerprint, edited_fingerprint, likenesses, edit).

    edit is the range of leaves (first, end) in which the edit lies, and n_leaves
    how many there are. A null text is an empty text, whose tree has no leaf; equal
    texts, also of repeated rows, have equal fingerprints; a lone document is its
    own next; an empty table gives an empty result; very long texts: see above.
    """
    docs = documents(docs)
    rows = with_next(docs).withColumn("edited_text", edited(F.col("text"), F.col("next_text")))
    rows = rows.withColumn("edited_leaves", labels(F.col("edited_text")))
    prints = rows.select(
        "doc_id",
        "text",
        "edited_text",
        fingerprint(F.col("leaves")).alias("fingerprint"),
        fingerprint(F.col("edited_leaves")).alias("edited_fingerprint"),
        fingerprint(F.col("next_leaves")).alias("next_fingerprint"),
        F.size("leaves").alias("n_leaves"),
        edit_range(F.col("leaves"), F.col("edited_leaves")).alias("edit"),
    )
    out = prints.select(
        "doc_id",
        "text",
        "edited_text",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        "n_leaves",
        "edit",
    )
    return given_ids(out, docs)


def op6_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited_text", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
        F.col("n_leaves").cast("long").alias("n_leaves"),
        F.col("edit.first").cast("long").alias("edit_first"),
        F.col("edit.end").cast("long").alias("edit_end"),
    )


_SECTION_SQL = SECTION.replace("'", "''")
_LEAF_SQL = LEAF.replace("'", "''")
_OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
r AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS nxt FROM d),
e AS (SELECT doc_id, text, substr(text, 1, (length(text) - length(text) // 2)::BIGINT) || substr(nxt, 1, (length(text) // 2)::BIGINT) AS etext FROM r),
t AS (SELECT doc_id, 0 AS w, text FROM e UNION ALL SELECT doc_id, 1, etext FROM e),
s0 AS (SELECT doc_id, w, length(text) AS n_chars, sha256(text) AS h, list_transform(regexp_extract_all(text, '{leaf}'), lambda x: substr(sha256(x), 1, 16)) AS l0 FROM t),
{levels}
p AS (SELECT doc_id, w, n_chars, h, l0, sha256(array_to_string(l0, '')) AS root, n, l, sha256(array_to_string(l0, '')) || ':' || n || ':' || array_to_string(l, '') AS print FROM {last}),
z AS (SELECT a.doc_id, a.n_chars, b.h AS edited_sha256, a.print AS fingerprint, b.print AS edited_fingerprint, a.l0 AS la, b.l0 AS lb,
  {near_ab} AS near_edited, {near_ac} AS near_next
  FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.w = 0 AND b.w = 1
  JOIN (SELECT doc_id, coalesce(lead(doc_id) OVER (ORDER BY doc_id DESC), max(doc_id) OVER ()) AS nid FROM d) x ON x.doc_id = a.doc_id
  JOIN p c ON c.doc_id = x.nid AND c.w = 0),
f AS (SELECT *, coalesce(list_position(list_transform(range(1, least(len(la), len(lb)) + 1), lambda i: la[i] = lb[i]), false) - 1, least(len(la), len(lb))) AS front,
  coalesce(list_position(list_transform(range(0, least(len(la), len(lb))), lambda i: la[len(la) - i] = lb[len(lb) - i]), false) - 1, least(len(la), len(lb))) AS back FROM z)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, len(la) AS n_leaves, front::BIGINT AS edit_first,
  (len(la) - least(back, len(la) - front, len(lb) - front))::BIGINT AS edit_end FROM f
"""


def _op6_sql(levels: int = 8) -> str:
    def up(labels_: str) -> str:
        joined = f"CASE WHEN len({labels_}) > 0 THEN array_to_string({labels_}, ' ') || ' ' ELSE '' END"
        return f"list_transform(regexp_extract_all({joined}, '{_SECTION_SQL}'), lambda x: substr(sha256(x), 1, 16))"

    steps = ["l1 AS (SELECT doc_id, w, n_chars, h, l0, 0 AS n, l0 AS l FROM s0)"]
    for i in range(1, levels):
        steps.append(f"l{i + 1} AS (SELECT doc_id, w, n_chars, h, l0, CASE WHEN len(l) > {MOST} THEN n + 1 ELSE n END AS n, CASE WHEN len(l) > {MOST} THEN {up('l')} ELSE l END AS l FROM l{i})")

    def near(x: str, y: str) -> str:
        def lifted(u: str, v: str) -> str:
            one = up(f"{u}.l")
            two = up(one)
            return f"CASE WHEN {v}.n - {u}.n >= 2 THEN {two} WHEN {v}.n - {u}.n = 1 THEN {one} ELSE {u}.l END"

        a, b = lifted(x, y), lifted(y, x)
        return f"CASE WHEN {x}.root = {y}.root THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(list_distinct({a}), list_distinct({b}))) / greatest(len(list_distinct({a})) + len(list_distinct({b})), 1) END"

    return _OP6_SQL.format(leaf=_LEAF_SQL, levels=", ".join(steps) + ",", last=f"l{levels}", near_ab=near("a", "b"), near_ac=near("a", "c"))


OP6_SQL = _op6_sql()
