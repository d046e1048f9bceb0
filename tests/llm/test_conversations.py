"""Conversation repair against a plain walk over all states, in blocks and over odd rows."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest

from driftledger.llm import conversations as C
from driftledger.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
LEGAL = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ROLE = {"u": "user", "a": "assistant"}
KIND = "conv_id long, turn long, role string, text string"


def hurt(rows):
    for conv, turn, role, text in rows:
        deal = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if deal == 1 else re.sub("[.!?]", "", text) if deal == 2 else text
        yield from [(conv, turn, "user" if deal == 4 else role, text)] * (0 if deal == 0 else 2 if deal == 3 else 1)


def walked(rows):
    """{conversation: (gaps, blank, duplicate, truncated, illegal, cost, audit, hash)} by the least (cost, audit) of each state."""
    convs, out = {}, {}
    for conv, *row in rows:
        convs.setdefault(conv, []).append(row)
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in own:
            solid = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None)
            seen.add((role, text))
        best = {0: (0, "", ())}

        def inserted(best):
            for _ in range(4):
                for q, (cost, audit, lines) in list(best.items()):
                    for ch in LEGAL[q].keys() - {"s"}:
                        way = (cost + 3, audit + "I", (*lines, ROLE[ch] + ":"))
                        if LEGAL[q][ch] not in best or way[:2] < best[LEGAL[q][ch]][:2]:
                            best[LEGAL[q][ch]] = way
            return best

        for (_, role, text), fault in zip(own, faults, strict=True):
            after = {}
            for q, (cost, audit, lines) in inserted(best).items():
                ways = [(q, (cost + 4, audit + "D", lines))]
                if fault not in ("blank", "duplicate"):
                    more = 3 * (fault == "truncated")
                    ways += [(LEGAL[q][role[:1]], (cost + more, audit + "K", (*lines, f"{role}:{text}")))] if role[:1] in LEGAL[q] else []
                    ways += [(LEGAL[q][ch], (cost + 3 + more, audit + "R", (*lines, f"{ROLE[ch]}:{text}"))) for ch in LEGAL[q].keys() - {"s"}]
                for to, way in ways:
                    if to not in after or way[:2] < after[to][:2]:
                        after[to] = way
            best = after
        cost, audit, lines = min((w for q, w in inserted(best).items() if q in (0, 3)), key=lambda w: w[:2])
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def made(seed, convs, turns):
    rnd = random.Random(seed)
    texts = ["Yes.", "No!", "well", " \n", "", None, "A long answer? ", "x.\u0085", "Yes.", "b" * 3000 + ".", "ends\t"]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", None, "", "u"]
    return [(rnd.choice([c, c, None]) if not c else c, rnd.choice([t, t, t + 3, None]), rnd.choice(roles), rnd.choice(texts)) for c in range(convs) for t in range(rnd.randint(1, turns))]


def test_odd_conversations(spark):
    rows = list({r: None for r in made(3, 60, 14)}) + [(901, 0, "user", "twice."), (901, 0, "user", "twice.")]
    table = spark.createDataFrame(rows, KIND).selectExpr("*", "'x' as conv", "1 as kind", "2 as place", "3 as edit").repartition(5)
    got = {r[0]: tuple(r)[1:] for r in C.digests(C.repair(table, table.select("conv_id"))).collect()}
    assert got == walked([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows])
    hurt_rows = list(hurt(rows))
    assert sorted(tuple(r) for r in C.damaged(table).na.fill(-1).collect()) == sorted(tuple(-1 if v is None else v for v in r) for r in hurt_rows)


def test_repaired_turns_are_legal(spark):
    plan = C.repair(spark.createDataFrame(made(4, 30, 9), KIND))
    convs = {}
    for r in sorted(C.repaired(plan).collect(), key=lambda r: (str(r.conv_id), r.place)):
        if r.place:
            convs[r.conv_id] = convs.get(r.conv_id, "") + r.role[:1]
    assert convs and all(re.fullmatch("(s?(ua)+)?", s) for s in convs.values())
    heads = {r.conv_id: r.counts for r in plan.where("place = 0").collect()}
    edits = {r.conv_id: r.n for r in plan.where("place > 0").groupBy("conv_id").agg({"*": "count"}).toDF("conv_id", "n").collect()}
    assert set(edits) == set(heads)


def test_conversations_without_rows_and_empty_tables(spark):
    none = spark.createDataFrame([], KIND)
    assert C.digests(C.repair(none)).count() == 0
    got = C.digests(C.repair(none, spark.createDataFrame([(5,), (5,), (None,)], "conv_id long"))).collect()
    assert sorted((str(r.conv_id), r.cost, r.gaps, r.audit, r.repaired_sha256) for r in got) == [(k, 0, 0, "", hashlib.sha256(b"").hexdigest()) for k in ("5", "None")]


@pytest.mark.parametrize("block", [1, 2, 5])
def test_blocks_give_the_same_edits(monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    rnd = random.Random(block)
    for _ in range(150):
        rows = [(7, t, rnd.choice(["system", "user", "assistant", "tool"]), rnd.choice(["a.", "b", "", "c!"])) for t in range(rnd.randint(0, 17))]
        conv, seen = C._Conversation("7"), {}
        for _, t, role, text in rows:
            seen.setdefault((role, text), t)
        for _, t, role, text in rows:
            conv.add(t, role, text.encode(), not text, bool(text) and text[-1] not in ".!?", seen[role, text] == t)
        conv.finish()
        want = walked(rows).get(7, (0, 0, 0, 0, 0, 0, "", ""))
        assert (conv.counts["cost"], "".join(conv.edits)) == want[5:7]


def test_a_very_long_conversation(spark):
    """A third of all rows are one conversation of 20,000 turns."""
    rows = [(1, t, ["user", "assistant"][t % 2 ^ (t % 97 == 0)], f"{t % 5000}" + "." * (t % 89 > 0)) for t in range(20_000)] + [(k, 0, "user", "q.") for k in range(2, 40_002)]
    got = C.digests(C.repair(spark.createDataFrame(rows, KIND))).where("conv_id = 1").first()
    assert tuple(got)[1:] == walked([r for r in rows if r[0] == 1])[1]


def test_query_against_sql_and_walk(spark):
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op11_conversation_repair"](spark, DATA).collect()}
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{DATA}/conversations.parquet'")
    assert got == {r[0]: r[1:] for r in con.execute(ORACLE_SQL["op11_conversation_repair"]).fetchall()}
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got == walked(hurt(rows))
