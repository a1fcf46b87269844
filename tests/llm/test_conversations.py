from __future__ import annotations

import heapq
import random
import re
from hashlib import sha256

import duckdb
import pytest

from millrace.llm import conversations as conv
from tests.test_catalogue import bag

SCHEMA = "conv_id long, turn long, role string, text string, audit string, pos long, part int, copies_of int, signature string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, "y") for r in rows], SCHEMA)


def cheapest(rows):
    """Least (cost, audit) and the lines of a conversation, by searching edits one by one, cheapest first."""
    seen, turns = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\f\r")
        turns.append((role, text, not bare or (role, text) in seen, bare[-1:] not in (".", "!", "?")))
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, initials, lines = heapq.heappop(heap)
        if i == len(turns) and re.fullmatch("(s?(ua)+)?", initials):
            return cost, audit, lines
        # What may follow depends on the first and last initial and how many of u and a there are, odd or even.
        key = (i, initials[:1] == "s", initials[-1:])
        if key in done:
            continue
        done.add(key)
        ok = lambda s: re.fullmatch("s?(ua)*u?", s)
        for new in ("user", "assistant"):
            if ok(initials + new[0]):
                heapq.heappush(heap, (cost + 2, audit + "I", i, initials + new[0], (*lines, f"{new}:")))
        if i < len(turns):
            role, text, gone, cut = turns[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, initials, lines))
            if not gone:
                for letter, new in (("K", role), ("R", "user"), ("R", "assistant")):
                    if new and ok(initials + new[0]):
                        heapq.heappush(heap, (cost + 2 * (letter == "R") + cut, audit + letter, i + 1, initials + new[0], (*lines, f"{new}:{text}")))
    raise AssertionError


def test_repairs_equal_a_search_over_all_edits(spark):
    rng = random.Random(5)
    rows = []
    for c in range(60):
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "tool", "user"]), rng.choice(["Yes.", "No", " ", "A b!", "Why?", "x"])))
    repair = conv.Repair(frame(spark, rows).repartition(5))
    found = {r["conv_id"]: r for r in repair.conversations.collect()}
    digests = {r["conv_id"]: r["repaired_sha256"] for r in repair.digests.collect()}
    turns = sorted(repair.turns.collect(), key=lambda r: (r["conv_id"], r["place"]))
    for c in range(60):
        cost, audit, lines = cheapest([(role, text) for i, _, role, text in rows if i == c])
        assert (found[c]["cost"], found[c]["audit"]) == (cost, audit)
        assert digests[c] == sha256("\n".join(lines).encode()).hexdigest()
        assert "".join(r["edit"] for r in turns if r["conv_id"] == c) == audit


def test_shared_ends_are_one_path():
    path = conv.Suffixes()
    for word in sorted(["AEAE", "AEAEAE", "EAE", "IAE", "IAEAE"], key=lambda w: w[::-1]):
        path.to(word[::-1])
        fresh = conv.Suffixes()
        fresh.to(word[::-1])
        assert path.repair() == fresh.repair()
    # What the register holds does not grow with the length of signatures.
    before = conv._node.cache_info().currsize
    path.to("AEIMD" * 4000)
    assert conv._node.cache_info().currsize - before < 200
    cost, audit = path.repair()
    assert len(audit) >= 20_000 and cost > 0


ODD = [
    (1, 0, "user", "Hello."), (1, 0, "user", "Hello."), (1, None, None, None), (1, 3, "assistant", "Cut"),
    (None, 0, "user", "No id."), (None, 1, "assistant", "Yes."), (2, None, "", "no role."), (2, None, "system", "Rules."),
    (3, 7, "user", "word " * 40_000 + "end."), (3, 9, "assistant", "é" * 5_000), (4, 2**60, "user", "Far."), (4, -(2**60), "assistant", "Farther."),
    *[(5, t, "user", "Same.") for t in range(30)], *[(6, 1, "user", "Tie.")] * 40, *[(7 + i % 5, i, "uasx"[i % 4], f"T{i % 3}!") for i in range(60)],
]


@pytest.mark.parametrize("rows", [ODD, []])
def test_query_on_odd_input_equals_sql(spark, tmp_path, rows):
    frame(spark, rows).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    out = conv.op11_conversation_repair(spark, str(tmp_path))
    columns = sorted(out.columns)
    expected = con.sql(f"SELECT {', '.join(columns)} FROM ({conv.OP11_SQL}) q").fetchall()
    got = out.select(*columns).collect()
    assert len(got) == len({r[0] for r in rows})
    assert bag(got) == bag(expected)
