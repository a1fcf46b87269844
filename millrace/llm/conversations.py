"""Repair of conversations whose turns lost their structure, by a suffix-shared automaton.

A turn is a symbol: the class of its role's initial (u, a, s, any other) and its
first fault (none, blank, duplicate, truncated). A conversation is a word of such
symbols, its signature, and conversations of one signature have one repair. The
distinct signatures are range-sorted by their reversals, so neighbours share their
longest ends, and a task walks them with one stack: a node of the automaton stands
for an end of signatures and is pushed once however many conversations end so
(again only where a partition's border cuts a path). A node holds, for each state
of the grammar `(s?(ua)+)?`, the cost to go and the first letter of the cheapest
audit; as a letter leaves each state to one state only, a tie is settled by that
letter, and following the letters reads the audit. Nodes that agree in symbol and
in the relative costs below them are minimised to one entry of a register.

Edits: Keep costs 0, Rerole (to user or assistant) 2, Delete 3, Insert (an empty
user or assistant turn) 2; a truncated turn that stays adds 1; blank and duplicate
turns must go. Of the cheapest audits the least by ASCII is taken.

Defined results: null roles and texts are one blank; a null conv_id is a
conversation of its own; null turns come first, and turns of one number follow in
the order of role and text; equal rows are copies, of which all but the first are
duplicates; a role whose initial is none of s, u, a (an empty one too) can't be
kept; extra columns are not read; an empty table gives an empty result. Texts of
any length are judged whole. A conversation's rows are sorted and judged in pieces
by range, and only its audit and signature, a letter a turn, are ever one value.
Hashing its repaired text is sequential: one task streams it, a batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

ROLES = ("user", "assistant", "system")
FAULTS = ("none", "blank", "duplicate", "truncated")
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
#: A symbol is LETTERS[4 * class of the role + fault].
LETTERS = "ABCDEFGHIJKLMNOP"
REROLE, DELETE, INSERT, LEFT_TRUNCATED = 2, 3, 2, 1
#: States of the grammar: nothing yet, after s, after u, after a; where the next turn of user or assistant leads.
NEXT = (2, 2, 3, 2)
KEEP = {(2, 0): 1, (0, 0): 2, (0, 1): 2, (0, 3): 2, (1, 2): 3}
#: Cost to go and first letter at the end of every conversation.
END = ((0, 4, 2, 0), ("", "I", "I", ""))
LEGAL = {(2, 0), (0, 1), (1, 0)}

TURN = "conv_id long, place long, turn long, edit string, role string, text string"
REPAIR = "signature string, cost long, audit string, blank long, duplicate long, truncated long, illegal long"


@cache
def _node(symbol: int, below: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[str, ...]]:
    """(costs to go, first letters) by state, before `symbol`, over the costs below it. The register of the automaton."""
    kind, fault = divmod(symbol, 4)
    best = []
    for state in range(4):
        ways = [(DELETE + below[state], "D")]
        if fault not in (BLANK, DUPLICATE):
            extra = LEFT_TRUNCATED * (fault == TRUNCATED)
            ways.append((REROLE + extra + below[NEXT[state]], "R"))
            if (kind, state) in KEEP:
                ways.append((extra + below[KEEP[kind, state]], "K"))
        best.append(min(ways))
    after_u = min(best[2], (INSERT + best[3][0], "I"))
    after_a = min(best[3], (INSERT + best[2][0], "I"))
    most = [min(best[0], (INSERT + after_u[0], "I")), min(best[1], (INSERT + after_u[0], "I")), after_u, after_a]
    return tuple(c for c, _ in most), tuple(a for _, a in most)


class Suffixes:
    """The path of nodes of one signature, last symbol first; the next signature keeps the end they share."""

    def __init__(self) -> None:
        self.reversed = ""
        #: Of each node: costs less the least of them, that least cost with all below, first letters.
        self.nodes: list[tuple[tuple[int, ...], int, tuple[str, ...]]] = [(END[0], 0, END[1])]

    def to(self, reversed_: str) -> None:
        shared = 0
        for a, b in zip(self.reversed, reversed_, strict=False):
            if a != b:
                break
            shared += 1
        del self.nodes[shared + 1 :]
        for letter in reversed_[shared:]:
            below, least, _ = self.nodes[-1]
            costs, first = _node(LETTERS.index(letter), below)
            lowest = min(costs)
            self.nodes.append((tuple(c - lowest for c in costs), least + lowest, first))
        self.reversed = reversed_

    def repair(self) -> tuple[int, str]:
        """Cost and audit from the node on top."""
        costs, least, _ = self.nodes[-1]
        state, out = 0, []
        for k in range(len(self.nodes) - 1, -1, -1):
            while (letter := self.nodes[k][2][state]) == "I":
                out.append("I")
                state = NEXT[state]
            out.append(letter)
            if letter == "R":
                state = NEXT[state]
            elif letter == "K":
                state = KEEP[LETTERS.index(self.reversed[k - 1]) // 4, state]
        return least + costs[0], "".join(out)


def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    path = Suffixes()
    for batch in batches:
        out = []
        for reversed_ in batch.column(0).to_pylist():
            path.to(reversed_)
            cost, audit = path.repair()
            symbols = [LETTERS.index(x) for x in reversed(reversed_)]
            faults = [s % 4 for s in symbols]
            illegal = sum((a // 4, b // 4) not in LEGAL for a, b in zip(symbols, symbols[1:], strict=False))
            out.append((reversed_[::-1], cost, audit, faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), illegal))
        names = [c.split()[0] for c in REPAIR.split(", ")]
        kinds = [pa.string() if c.endswith("string") else pa.int64() for c in REPAIR.split(", ")]
        columns = zip(*out, strict=True) if out else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, pos, turn, role, text, copies, audit), each conversation led by one with its audit, to rows of TURN.

    A leading row comes out with the edit null. Only the letters left and the state are kept from row to row.
    """
    conv, audit, at, state, place = None, "", 0, 0, 0
    for batch in batches:
        out: list[tuple] = []

        def put(edit: str, turn: int | None, role: str, text: str) -> None:
            nonlocal place
            out.append((conv, place, turn, edit, role, text))  # noqa: B023  used at once
            place += 1

        def inserts() -> None:
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                state, at = NEXT[state], at + 1
                put("I", None, ROLES[state - 2], "")

        for conv_id, turn, role, text, copies, given in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "audit")), strict=True):
            if given is not None:
                inserts()
                conv, audit, at, state, place = conv_id, given, 0, 0, 0
                out.append((conv, None, None, None, None, None))
                continue
            for _ in range(copies):
                inserts()
                letter, at = audit[at], at + 1
                if letter == "R":
                    state = NEXT[state]
                elif letter == "K":
                    state = KEEP["uas".index(role[0]), state]
                put(letter, turn, ROLES[state - 2] if letter == "R" else role, text)
        if len(batch):
            # What is inserted at the very end waits for no row: nothing but inserts is left of the audit.
            if at < len(audit) and set(audit[at:]) == {"I"}:
                inserts()
        names = [c.split()[0] for c in TURN.split(", ")]
        kinds = [pa.string() if c.endswith("string") else pa.int64() for c in TURN.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * len(names), kinds, strict=True)], names)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, repaired_sha256) of rows of TURN in order."""
    conv, digest, lines, open_ = None, sha256(), 0, False
    for batch in batches:
        done = []
        for conv_id, edit, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "edit", "role", "text")), strict=True):
            if edit is None:
                if open_:
                    done.append((conv, digest.hexdigest()))
                conv, digest, lines, open_ = conv_id, sha256(), 0, True
            elif edit != "D":
                digest.update(f"{chr(10) * (lines > 0)}{role}:{text}".encode())
                lines += 1
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.int64()), pa.array([d for _, d in done], pa.string())], ["conv_id", "repaired_sha256"])
    if open_:
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([digest.hexdigest()], pa.string())], ["conv_id", "repaired_sha256"])


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) with damage by crc32 of `conv_id:turn`; copies: how often a row is there, 0 if it is dropped."""
    shown = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fate = F.pmod(F.crc32(F.concat_ws(":", shown("conv_id"), shown("turn"))), F.lit(20))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), shown("role").alias("role"), shown("text").alias("text"), fate.alias("fate"))
    text = F.when(F.col("fate") == 1, F.lit("")).when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("fate") == 0, F.lit(0)).when(F.col("fate") == 3, F.lit(2)).otherwise(F.lit(1))
    return rows.select("conv_id", "turn", F.when(F.col("fate") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), copies.cast("long").alias("copies"))


def _joined(part: str, order: str) -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, part))), lambda x: x[part]), "")


class Repair:
    """The repair of a table of turns (conv_id, turn, role, text and, if rows stand for several or none, copies).

    conversations: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, signature.
    turns: the edits in order (place), with Insert's new turns; those of edit D are gone from the repaired conversation.
    """

    def __init__(self, rows: DataFrame):
        text_or_blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name)
        copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
        key = ["conv_id", "turn", "role", "text"]
        rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text_or_blank("role"), text_or_blank("text"), copies.cast("long").alias("copies"))
        # Copies are counted before anything moves, so a row that is there a million times is one.
        rows = rows.groupBy(key).agg(F.sum("copies").alias("copies"))
        rows = written(rows.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("pos", F.monotonically_increasing_id()), "turns")
        self.rows = rows.where("copies > 0")
        self.conversations = self._judged(rows)

    def _judged(self, rows: DataFrame) -> DataFrame:
        blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
        end = F.right(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\f\r")), F.lit(1))
        initial = F.substring("role", 1, 1)
        marks = rows.select("conv_id", "pos", "copies", "turn", "role", F.when(initial == "u", 0).when(initial == "a", 1).when(initial == "s", 2).otherwise(3).alias("kind"), blank.alias("blank"), end.isin(".", "!", "?").alias("ended"), F.sha2("text", 256).alias("digest"))
        first = marks.where("copies > 0").groupBy("conv_id", "role", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
        marks = marks.join(first, "pos", "left")
        fault = F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE).when(~F.col("ended"), TRUNCATED).otherwise(0)
        letter = lambda f: F.substring(F.lit(LETTERS), (F.col("kind") * 4 + f + 1).cast("int"), F.lit(1))
        again = F.repeat(letter(F.when(F.col("blank"), BLANK).otherwise(DUPLICATE)), (F.col("copies") - 1).cast("int"))
        marks = marks.select("conv_id", "pos", F.shiftright("pos", 33).alias("part"), F.when(F.col("copies") > 0, F.concat(letter(fault), again)).otherwise("").alias("letters"), F.when(F.col("copies") > 0, F.col("turn")).alias("turn"))
        # Letters meet twice: within a sorted partition first, then one string for each of these.
        pieces = marks.groupBy("conv_id", "part").agg(_joined("letters", "pos").alias("letters"))
        signatures = pieces.groupBy("conv_id").agg(_joined("letters", "part").alias("signature"))
        wide = lambda c: c.cast("decimal(20,0)")
        gaps = marks.groupBy("conv_id").agg(F.coalesce((wide(F.max("turn")) - wide(F.min("turn")) + 1 - F.count_distinct("turn")).try_cast("long"), F.lit(0)).alias("gaps"))
        signatures = signatures.withColumnRenamed("conv_id", "c").join(gaps, F.col("c").eqNullSafe(F.col("conv_id"))).select("conv_id", "signature", "gaps")
        distinct = signatures.select(F.reverse("signature").alias("reversed")).distinct()
        repairs = distinct.repartitionByRange("reversed").sortWithinPartitions("reversed").mapInArrow(_repairs, REPAIR)
        return written(signatures.join(repairs, "signature"), "repairs")

    def _stream(self) -> DataFrame:
        nothing = lambda kind: F.lit(None).cast(kind)
        heads = self.conversations.select("conv_id", F.lit(-1).cast("long").alias("pos"), nothing("long").alias("turn"), nothing("string").alias("role"), nothing("string").alias("text"), F.lit(0).cast("long").alias("copies"), "audit")
        body = self.rows.select("conv_id", "pos", "turn", "role", "text", "copies", nothing("string").alias("audit"))
        return heads.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(_edited, TURN)

    @property
    def turns(self) -> DataFrame:
        return self._stream().where("edit is not null")

    @property
    def digests(self) -> DataFrame:
        """(conv_id, repaired_sha256) of each conversation's repaired `role:text` lines."""
        return self._stream().mapInArrow(_digests, "conv_id long, repaired_sha256 string")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    repair = Repair(damaged(table(spark, sf_dir, "conversations")))
    digests = repair.digests.withColumnRenamed("conv_id", "c")
    out = repair.conversations.join(digests, F.col("c").eqNullSafe(F.col("conv_id")))
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _add(value: str, cost: int | str, letter: str) -> str:
    return f"lpad((substr({value}, 1, 9)::INT + {cost})::VARCHAR, 9, '0') || '{letter}' || substr({value}, 10)"


def _ways(state: int) -> str:
    kept = " ".join(f"WHEN kind = {kind} THEN {_add(f'v{to}', 'extra', 'K')}" for (kind, s), to in KEEP.items() if s == state)
    stay = f"least({_add(f'v{NEXT[state]}', '2 + extra', 'R')}, CASE {kept} ELSE '~' END)"
    return f"least({_add(f'v{state}', 3, 'D')}, CASE WHEN gone THEN '~' ELSE {stay} END) AS b{state}"


# A value is the cost in nine digits and the audit behind it, so that the least string is the cheapest, then ASCII-least.
OP11_SQL = f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
fates AS (
  SELECT k, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(k) + 1),
      lambda i: [ascii(substr(k, i::INT, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, o: CASE WHEN o >= 0 THEN xor(c, o) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END), 4294967295::BIGINT) % 20 AS fate
  FROM (SELECT DISTINCT k FROM keyed)),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM keyed JOIN fates USING (k), range(2) c(copy) WHERE fate <> 0 AND (copy = 0 OR fate = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
judged AS (
  SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS cut, CASE substr(role, 1, 1) WHEN 'u' THEN 0 WHEN 'a' THEN 1 WHEN 's' THEN 2 ELSE 3 END AS kind,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) AS pair FROM placed),
rows AS (SELECT *, blank OR again AS gone, CASE WHEN cut THEN 1 ELSE 0 END AS extra FROM judged),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
    count(*) FILTER (cut AND NOT gone) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id),
walk AS (
  SELECT conv_id, n AS i, '000000000' AS v0, '000000004II' AS v1, '000000002I' AS v2, '000000000' AS v3 FROM counts
  UNION ALL
  SELECT conv_id, i - 1, least(b0, {_add('u2', 2, 'I')}), least(b1, {_add('u2', 2, 'I')}), u2, least(b3, {_add('b2', 2, 'I')})
  FROM (SELECT *, least(b2, {_add('b3', 2, 'I')}) AS u2 FROM (
    SELECT w.conv_id, w.i, {', '.join(_ways(s) for s in range(4))} FROM walk w JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i))),
best AS (SELECT conv_id, substr(v0, 1, 9)::BIGINT AS cost, substr(v0, 10) AS audit FROM walk WHERE i = 0),
made AS (
  SELECT conv_id, audit, 0 AS i, 0 AS state, [] ::VARCHAR[] AS lines FROM best
  UNION ALL
  SELECT conv_id, substr(audit, 2), CASE WHEN letter = 'I' THEN i ELSE i + 1 END, after,
    CASE letter WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text) ELSE list_append(lines, CASE after WHEN 2 THEN 'user:' ELSE 'assistant:' END || CASE letter WHEN 'I' THEN '' ELSE text END) END
  FROM (SELECT m.*, substr(m.audit, 1, 1) AS letter, r.role, r.text,
      CASE WHEN substr(m.audit, 1, 1) = 'D' THEN state WHEN substr(m.audit, 1, 1) = 'K' AND r.kind = 2 THEN 1 WHEN state = 2 THEN 3 ELSE 2 END AS after
    FROM made m LEFT JOIN rows r ON r.conv_id IS NOT DISTINCT FROM m.conv_id AND r.i = m.i + 1 WHERE m.audit <> ''))
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate, coalesce(c.truncated, 0)::BIGINT AS truncated,
  coalesce(c.illegal, 0)::BIGINT AS illegal, coalesce(b.cost, 0)::BIGINT AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(array_to_string(m.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN made m ON m.conv_id IS NOT DISTINCT FROM o.conv_id AND m.audit = ''
"""
