"""Conversation repair against a plain search over all edits."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from spellwise.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string"
END = re.compile(r"[.!?][\x20\x09-\x0D]*\Z")


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        if not re.search(r"[^\x20\x09-\x0D]", text):
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if END.search(text) else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, bad):
    """Dijkstra over (rows done, roles so far) with (cost, audit) as the key: no automaton, no matrices."""
    n = len(rows)

    def grows(roles):  # can become s?(ua)+
        return re.fullmatch(r"s?(ua)*u?", roles) is not None

    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, text = heapq.heappop(heap)
        if i == n and re.fullmatch(r"(s?(ua)+)?", roles):
            return cost, audit, "\n".join(text)
        key = (i, re.sub(r"(ua)+", "ua", roles))
        if key in done:
            continue
        done.add(key)
        for new in ("user", "assistant"):
            if grows(roles + new[0]):
                heapq.heappush(heap, (cost + 5, audit + "I", i, roles + new[0], (*text, new + ":")))
        if i < n:
            _, role, t = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, roles, text))
            if bad[i] not in ("blank", "duplicate"):
                extra = 5 if bad[i] == "truncated" else 0
                if role and grows(roles + role[0]):
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, roles + role[0], (*text, f"{role}:{t}")))
                for new in ("user", "assistant"):
                    if grows(roles + new[0]):
                        heapq.heappush(heap, (cost + 1 + extra, audit + "R", i + 1, roles + new[0], (*text, f"{new}:{t}")))
    raise AssertionError


def sorted_rows(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))


def report(rows):
    rows = sorted_rows(rows)
    bad = faults(rows)
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit, text = cheapest(rows, bad)
    return gaps, *[bad.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def damage(rows):
    space = lambda v: " " if v is None else str(v)
    out = []
    for conv, turn, role, text in rows:
        lot = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        if lot:
            text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
            out += [(conv, turn, "user" if lot == 4 else role, text)] * (2 if lot == 3 else 1)
    return out


def odd_conversations():
    rng = random.Random(11)
    texts = ["Hi.", "Well?", "no end", "", " \t", "Yes! \n", "Da…", "Ok.\u0085", "x" * 50_000 + "."]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "ursula", None, "", "System"]
    rows = []
    for conv in range(120):
        n = rng.randrange(0, 9)
        rows += [(conv, rng.choice([t, t + 1, None, t * 2]), rng.choice(roles), rng.choice([*texts, None])) for t in range(n)]
        rows += [(conv + 1000, t, ["user", "assistant"][t % 2], f"T{t}.") for t in range(n)]  # nothing to mend
    rows += rows[:40]  # repeated rows
    rows += [(None, i, "user", "Again.") for i in range(5)] + [(None, None, None, None)]
    return rows


def table(spark, rows):
    extra = "conv string, kind int, part int, digest string, cost long, symbol int, fault string"
    return spark.createDataFrame([(*r, "x", 1, 2, "d", 3, 4, "f") for r in rows], f"{SCHEMA}, {extra}").repartition(4)


@pytest.mark.parametrize("piece", [C.PIECE, 1])
def test_equals_a_plain_search(spark, monkeypatch, piece):
    rows = odd_conversations()
    df = table(spark, rows)
    by = {}
    for conv, *rest in damage(rows):
        by.setdefault(conv, []).append(tuple(rest))
    want = {conv: report(by.get(conv, [])) for conv in {r[0] for r in rows}}
    monkeypatch.setattr(C, "PIECE", piece)  # pieces of one run: the same results
    got = {r[0]: tuple(r[1:]) for r in C.repair(C.damaged(df), df).collect()}
    assert got.keys() == want.keys()
    for conv in want:
        assert got[conv] == want[conv], conv


def test_rows_come_back_repaired(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "So?"), (1, 2, "assistant", "Well."), (2, 0, "assistant", " ")]
    df = table(spark, rows)
    got = sorted(tuple(r) for r in C.repaired_rows(df).collect())
    # a delete (2) beats rerole and delete (3) and inserts (5); of the two deletes DKK comes first
    assert got == [(1, 0, "user", "So?"), (1, 1, "assistant", "Well.")]
    one = C.repair(df).where("conv_id = 1").first()
    assert (one["cost"], one["audit"]) == (2, "DKK")


def test_a_long_run_is_a_product_of_powers(spark):
    for symbol in range(9):
        for n in (1, 2, 3, 7, 12):
            step = C.symbol_move(symbol)
            plain = step
            for _ in range(n - 1):
                plain = plain * step
            fast = C.run_move(symbol, n)
            assert (fast.cost, fast.rank) == (plain.cost, plain.rank)
            for e, x in itertools.product(range(4), repeat=2):
                if fast.cost[e][x] < C.FAR:
                    assert fast.unroll(e, x) == plain.unroll(e, x)
    assert C.run_move(8, 10**15).cost[0][0] == 2 * 10**15
    # a conversation of very many equal rows
    df = spark.range(50_000).select(F.lit(7).alias("conv_id"), F.lit(1).alias("turn"), F.lit("user").alias("role"), F.lit("Same.").alias("text"))
    row = C.repair(df).first()
    assert row["duplicate"] == 49_999 and row["illegal"] == 49_999 and len(row["audit"]) == 50_000 and row["cost"] == 100_000


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.repair(empty).count() == 0 and C.repair(C.damaged(empty), empty).count() == 0 and C.repaired_rows(empty).count() == 0
    ids = spark.createDataFrame([(5,), (None,)], "conv_id long")
    nothing = hashlib.sha256(b"").hexdigest()
    assert {tuple(r) for r in C.repair(empty, ids).collect()} == {(i, 0, 0, 0, 0, 0, 0, "", nothing) for i in (5, None)}
