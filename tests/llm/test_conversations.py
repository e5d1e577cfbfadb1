"""Conversation repair against a plain walk over a four-state automaton that carries the repaired rows."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tablemill.llm import conversations
from tablemill.sources.tables import read_table

NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
WHITE = " \t\n\x0b\x0c\r"


def brute(rows):
    """{conv_id: (gaps, blank, duplicate, truncated, illegal, cost, audit, hash)} of (conv_id, turn, role, text)."""
    groups = {}
    for conv, turn, role, text in rows:
        group = groups.setdefault(conv, [])
        name = lambda v: " " if v is None else v
        kind = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        group += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {conv: repaired(group) for conv, group in groups.items()}


def repaired(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, counts = set(), [0, 0, 0]
    best = {0: (0, "", [])}

    def inserted(best):
        changed = True
        while changed:
            changed = False
            for state, (cost, audit, out) in list(best.items()):
                for r in ("user", "assistant"):
                    to = NEXT.get((state, r[0]))
                    if to is not None and (to not in best or (cost + 3, audit + "I") < best[to][:2]):
                        best[to], changed = (cost + 3, audit + "I", out + [(r, "")]), True
        return best

    for _, role, text in rows:
        bare = text.strip(WHITE)
        fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            counts[fault] += 1
        after = {}

        def offer(state, cost, audit, out):
            if state is not None and (state not in after or (cost, audit) < after[state][:2]):
                after[state] = (cost, audit, out)

        for state, (cost, audit, out) in inserted(best).items():
            offer(state, cost + 4, audit + "D", out)
            if fault in (0, 1):
                continue
            extra = 3 if fault == 2 else 0
            offer(NEXT.get((state, role[:1])), cost + extra, audit + "K", out + [(role, text)])
            for r in ("user", "assistant"):
                offer(NEXT.get((state, r[0])), cost + extra + 3, audit + "R", out + [(r, text)])
        best = after
    cost, audit, out = min((v for s, v in inserted(best).items() if s in (0, 3)), key=lambda v: v[:2])
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def result(df):
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in rows}


def made_up(seed, n=60):
    r = random.Random(seed)
    texts = ["yes.", "no", "why?", "a longer one\nof two lines.", "", " \n", "ok!  ", "É.", "w" * 500]
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(r.randint(1, 9)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "User"])
            rows.append((conv, r.choice([turn, turn, turn * 2, None, 3]), role, r.choice([*texts, None])))
    return rows + rows[:10] + [(700, 1, "user", "again.")] * 9 + [(701, k, ("user", "assistant")[k % 2], f"t{k % 97}.") for k in range(3000)]


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("limit", [1, 3, 1024])
def test_equals_plain_walk(spark, limit):
    rows = made_up(limit)
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("own").alias(c) for c in ("key", "audit", "cost", "part", "lines", "same")])
    got, want = result(conversations.repair_conversations(df, limit)), brute(rows)
    assert got == want


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    table = read_table(spark, folder, "conversations")
    want = brute([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
    assert result(conversations.repair_conversations(table)) == want and any(v[5] for v in want.values())


def test_no_rows(spark):
    assert conversations.repair_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:1".encode()) % 20 == 0)
    got = result(conversations.repair_conversations(spark.createDataFrame([(gone, 1, "user", "x.")], SCHEMA)))
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", conversations.NOTHING)}
