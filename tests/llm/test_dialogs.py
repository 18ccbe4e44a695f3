"""Conversation repair against a search over all edits, with chunks small enough that fix-up passes run."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from corpusloom.llm import dialogs

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def plain(rows):
    """What the contract says, one conversation after another; the edits by a shortest-path search that orders equal
    costs by the audit."""
    text = lambda x: " " if x is None else str(x)
    found = {}
    for conv, turn, role, words in rows:
        own = found.setdefault(conv, [])
        fault = zlib.crc32(f"{text(conv)}:{text(turn)}".encode()) % 20
        role, words = text(role), text(words)
        if fault == 0:
            continue
        words = "" if fault == 1 else re.sub("[.!?]", "", words) if fault == 2 else words
        own += [(turn, "user" if fault == 4 else role, words)] * (1 + (fault == 3))
    return {conv: _repair(own) for conv, own in found.items()}


def _repair(rows):
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    seen, kinds = set(), []
    for _, role, words in rows:
        bare = words.strip(WHITE)
        kinds.append("blank" if not bare else "duplicate" if (role, words) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, words))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    todo, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, at, last, out = heapq.heappop(todo)
        if (at, last) in done:
            continue
        done.add((at, last))
        if at == len(rows) and last in ("", "a"):
            break
        then = "a" if last == "u" else "u"
        whole = {"u": "user", "a": "assistant"}[then]
        heapq.heappush(todo, (cost + 5, audit + "I", at, then, (*out, (whole, ""))))
        if at < len(rows):
            _, role, words = rows[at]
            heapq.heappush(todo, (cost + 2, audit + "D", at + 1, last, out))
            if kinds[at] in ("", "truncated"):
                more = 5 * (kinds[at] == "truncated")
                if role[:1] == then or (not last and role[:1] == "s"):
                    heapq.heappush(todo, (cost + more, audit + "K", at + 1, role[:1], (*out, (role, words))))
                heapq.heappush(todo, (cost + more + 1, audit + "R", at + 1, then, (*out, (whole, words))))
    sha = hashlib.sha256("\n".join(f"{r}:{w}" for r, w in out).encode()).hexdigest()
    return gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repaired(df, *args):
    rows = dialogs.repaired_conversations(df, *args).select("conv_id", *COLUMNS).collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r)[1:] for r in rows}


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert repaired(df) == plain(df.select("conv_id", "turn", "role", "text").collect())


@pytest.mark.parametrize("size, stretch", [(2, 1 << 14), (7, 16)])
def test_random_conversations(spark, size, stretch):
    """Long and short ones, of any roles, with nulls, ties, repeated rows and texts; a conversation holds a third of all."""
    rng = random.Random(size)
    texts = ["A.", "B!", "no stop", "", " \n", None, "C?\t", "A.", "D."]
    rows = [(rng.choice([1, *range(2, 40), None]) if rng.random() < 0.7 else 1, rng.choice([None, *range(60)]), rng.choice(["system", "user", "assistant", "User", "tool", "", None, "s"]), rng.choice(texts)) for _ in range(600)]
    rows += rows[:50]
    assert repaired(spark.createDataFrame(rows, SCHEMA).repartition(3), size, stretch) == plain(rows)


def test_rank_that_never_converges(spark):
    """Rows of one role keep two vectors apart for ever: stretches that double settle them all the same."""
    rows = [(1, t, "user", f"{t}.") for t in range(301)] + [(2, t, "assistant", "") for t in range(200)] + [(2, 200, "user", "x."), (2, 201, "assistant", "y.")]
    assert repaired(spark.createDataFrame(rows, SCHEMA), 8, 64) == plain(rows)


def test_speculation_is_mended():
    """Chunks from a speculative vector end as the whole sequence does, from where vectors differ by a constant."""
    rng = random.Random(3)
    symbols = "".join(rng.choice("suaxSUAX-") for _ in range(400))
    whole, left = dialogs.backward(symbols, dialogs.LAST)
    first, _ = dialogs.backward(symbols[:200], dialogs.LAST)
    cut = tuple(whole[4 * 199 : 4 * 200])
    assert dialogs.backward(symbols[:200], cut, first) == (whole[:800], left)
    assert first[:400] == whole[:400]  # the rank had converged long before


def test_edges(spark):
    assert repaired(spark.createDataFrame([], SCHEMA)) == {}
    dropped = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    kept = next(t for t in range(1000) if zlib.crc32(f"6:{t}".encode()) % 20 > 4)
    rows = [(5, dropped, "user", "A."), (6, kept, "user", "w " * 300_000 + "end."), (6, kept, "assistant", "B."), (None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = repaired(df.selectExpr("*", "role AS digest", "turn AS no", "text AS symbols", "1 AS n"))
    assert got == plain(rows)
    assert got[5] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repaired(df.selectExpr("CAST(conv_id AS STRING) AS conv_id", "turn", "role", "text"))["6"] == got[6]
