"""Cheapest repair of conversations to `s?(ua)+`, or to nothing, by run-length dynamic programming.

Each row of a conversation becomes a symbol: its role's class and its fault. Equal consecutive symbols collapse to a run. A
symbol's transition holds, for each pair of states of the target's automaton, the least cost and the place of its cheapest
edits among those of the same entry in ASCII order; transitions multiply (min-plus, ties by that place), so a run of any
length is a product of cached binary powers of its symbol's transition, and pieces of a conversation multiply likewise. Every
product remembers the state in its middle; unrolling these choices gives the audit.

A transition counts inserts before the row they precede, so all of its edit strings end in a row's own edit: two of them
with the same entry and other exits differ before either ends, and comparing first parts first is the ASCII order of the
whole.

Only short rows (keys, digest, flags) are put in order for this, by ranges, so a conversation of very many rows is dealt to
many tasks; each sends pieces of at most PIECE runs. Whole texts move once, by conversation and in order, and are streamed
past the audit: a conversation's text is never held, only the rows of one batch and the audit itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: States: nothing yet, system kept, after user, after assistant. Ends are allowed in the first and the last.
STATES = range(4)
USER, ASSISTANT = "user", "assistant"
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
#: Symbols: role class (s, u, a, other) + 4 if truncated; GONE for rows that must go.
GONE = 8
#: Runs of one piece at most.
PIECE = 4096
FAR = 1 << 62

ROLE = {"s": 0, "u": 1, "a": 2}
LEGAL = {(0, 1), (1, 2), (2, 1)}


def turn_to(state: int) -> tuple[int, str]:
    """The state after an inserted or reroled row, and its role."""
    return (3, ASSISTANT) if state == 2 else (2, USER)


class Move:
    """A transition: `cost[e][x]`, `rank[e][x]` (place of its edits among the exits of e), and how to unroll it."""

    __slots__ = ("cost", "rank", "left", "right", "middle", "edits")

    def __init__(self, cost, rank, left=None, right=None, middle=None, edits=None):
        self.cost, self.rank, self.left, self.right, self.middle, self.edits = cost, rank, left, right, middle, edits

    def __mul__(self, other: Move) -> Move:
        cost, rank, middle = [], [], []
        for e in STATES:
            row, mid, keys = [FAR] * 4, [0] * 4, []
            c, r = self.cost[e], self.rank[e]
            for x in STATES:
                best = min(((c[m] + other.cost[m][x], r[m], m) for m in STATES if c[m] < FAR and other.cost[m][x] < FAR), default=None)
                if best:
                    row[x], mid[x] = best[0], best[2]
                    keys.append((best[1], other.rank[best[2]][x], x))
            place = [0] * 4
            for i, (_, _, x) in enumerate(sorted(keys)):
                place[x] = i
            cost.append(row)
            rank.append(place)
            middle.append(mid)
        return Move(cost, rank, self, other, middle)

    def unroll(self, entry: int, leave: int) -> str:
        """The edits of the cheapest way from `entry` to `leave`, the least of them in ASCII order."""
        out, todo = [], [(self, entry, leave)]
        while todo:
            move, e, x = todo.pop()
            if move.edits is not None:
                out.append(move.edits[e][x])
            else:
                m = move.middle[e][x]
                todo += [(move.right, m, x), (move.left, e, m)]
        return "".join(out)


@lru_cache(maxsize=None)
def symbol_move(symbol: int) -> Move:
    """One row: some inserts, then its own edit."""
    edits = [[""] * 4 for _ in STATES]
    cost = [[FAR] * 4 for _ in STATES]
    for entry in STATES:
        state = entry
        for inserts in range(4):
            ways = [("D", DELETE, state)]
            if symbol != GONE:
                role, extra = symbol % 4, TRUNCATED * (symbol // 4)
                ways.append(("R", REROLE + extra, turn_to(state)[0]))
                if (role == 0 and state == 0) or (role == 1 and state != 2) or (role == 2 and state == 2):
                    ways.append(("K", extra, role + 1))
            for letter, price, leave in ways:
                new = (price + INSERT * inserts, "I" * inserts + letter)
                if new < (cost[entry][leave], edits[entry][leave]):
                    cost[entry][leave], edits[entry][leave] = new
            state = turn_to(state)[0]
    rank = []
    for e in STATES:
        order = sorted((edits[e][x], x) for x in STATES if cost[e][x] < FAR)
        place = [0] * 4
        for i, (_, x) in enumerate(order):
            place[x] = i
        rank.append(place)
    return Move(cost, rank, edits=edits)


@lru_cache(maxsize=None)
def power(symbol: int, k: int) -> Move:
    """The transition of 2 ** k rows of one symbol."""
    return symbol_move(symbol) if not k else power(symbol, k - 1) * power(symbol, k - 1)


def run_move(symbol: int, n: int) -> Move:
    move = None
    for k in range(n.bit_length()):
        if n >> k & 1:
            move = power(symbol, k) if move is None else move * power(symbol, k)
    return move


def runs_move(runs: tuple[tuple[int, int], ...]) -> Move:
    """The transition of consecutive runs (symbol, length); short conversations of one shape share it."""
    if len(runs) > 1:
        half = len(runs) // 2
        return (_short if len(runs) <= 16 else _product)(runs[:half], runs[half:])
    return run_move(*runs[0])


def _product(left, right) -> Move:
    return runs_move(left) * runs_move(right)


@lru_cache(maxsize=4096)
def _short(left, right) -> Move:
    return _product(left, right)


def closing(state: int) -> str:
    """Inserts at the end that make the roles complete."""
    return {0: "", 1: "II", 2: "I", 3: ""}[state]


def cheapest(pieces: list[tuple[list, list]]) -> tuple[int, list[tuple[int, int]], str]:
    """(cost, (entry, exit) of each piece, closing inserts) for the (cost, rank) of consecutive pieces."""
    ahead = [INSERT * len(closing(x)) for x in STATES]
    choices = []
    for cost, rank in reversed(pieces):
        now, choice = [FAR] * 4, [0] * 4
        for e in STATES:
            best = min(((cost[e][x] + ahead[x], rank[e][x], x) for x in STATES if cost[e][x] < FAR), default=None)
            if best:
                now[e], choice[e] = best[0], best[2]
        choices.append(choice)
        ahead = now
    state, way = 0, []
    for choice in reversed(choices):
        way.append((state, choice[state]))
        state = choice[state]
    return ahead[0], way, closing(state)


def replay(audit: Iterator[str], rows: Iterator[tuple[str, str, int]]) -> Iterator[tuple[str, str]]:
    """The repaired (role, text) rows: `audit` carried out on (role, text, copies) rows in their order."""
    state = 0
    for role, text, copies in rows:
        for _ in range(copies):
            letter = next(audit)
            while letter == "I":
                state, new = turn_to(state)
                yield new, ""
                letter = next(audit)
            if letter == "R":
                state, new = turn_to(state)
                yield new, text
            elif letter == "K":
                state = ROLE[role[0]] + 1
                yield role, text
    for letter in audit:  # closing inserts
        state, new = turn_to(state)
        yield new, ""


# ------------------------------------------------------------------------------------------------ rows


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): `rows` with the faults that CRC-32 of `conv_id:turn` modulo 20 deals out: 0 drops
    the row, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes its role user. Null counts as one
    space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(lot == 1, "").when(lot == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    return rows.where(lot != 0).select(
        "conv_id", "turn", F.when(lot == 4, USER).otherwise(space("role")).alias("role"), text.alias("text"),
        F.when(lot == 3, 2).otherwise(1).alias("copies"),
    )


def plain_rows(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text, copies, digest: nulls of role and text as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    copies = F.col("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    out = rows.select(F.col("conv_id").alias("conv"), "turn", space("role").alias("role"), space("text").alias("text"), copies.alias("copies"))
    return out.withColumn("digest", F.unhex(F.md5("text")))


def symbols(plain: DataFrame) -> DataFrame:
    """One row per distinct (conv, turn, role, text): `symbol` of its first copy, `copies`, `fault` of the first copy.

    Equal rows are counted before they are shuffled. A text seen earlier in its conversation is known by the earliest turn of
    its (role, digest), an aggregate too; the join back is left to adaptive skew splitting.
    """
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    ended = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    slim = plain.select("conv", "turn", "role", "digest", "copies", F.when(blank, 1).when(~ended, 3).otherwise(0).alias("fault"))
    slim = slim.groupBy("conv", "turn", "role", "digest", "fault").agg(F.sum("copies").alias("copies"))
    first = slim.groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(
        F.max(F.col("turn").isNull()).alias("unturned"), F.min("turn").alias("least")
    )
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    is_first = F.when(F.col("turn").isNull(), True).otherwise(~F.col("unturned") & (F.col("turn") == F.col("least")))
    fault = F.when(F.col("fault") == 1, 1).when(~is_first, 2).otherwise(F.col("fault"))
    return slim.join(first, same).select("conv", "turn", "role", "digest", "copies", fault.cast("int").alias("fault"))


_PIECE = (
    "part int, seq int, symbols array<int>, lengths array<long>, cost array<long>, rank array<int>, n long, blank long, duplicate long, "
    "truncated long, illegal long, first int, last int, turns long, first_turn {turn}, last_turn {turn}"
)
_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 1024) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema=schema)


def _cut(schema: pa.Schema):
    """Rows in order to pieces of a conversation."""

    def pieces(batches):
        part = TaskContext.get().partitionId()
        for conv, rows in groupby(_rows(batches), key=lambda r: r[0]):
            seq, runs, facts = 0, [], None
            for _, turn, role, copies, fault in rows:
                code = ROLE.get(role[:1], 3)
                if facts is None:
                    facts = [0, 0, 0, 0, 0, code, code, 0, None, None]
                elif (facts[6], code) not in LEGAL:
                    facts[4] += 1
                if (code, code) not in LEGAL:
                    facts[4] += copies - 1
                facts[0] += copies
                facts[1] += copies if fault == 1 else 0
                facts[2] += copies if fault == 2 else 0 if fault == 1 else copies - 1
                facts[3] += fault == 3
                facts[6] = code
                if turn is not None and turn != facts[9]:
                    facts[7] += 1
                    facts[8] = turn if facts[8] is None else facts[8]
                    facts[9] = turn
                gone = copies if fault in (1, 2) else copies - 1
                for symbol, n in ((code + 4 * (fault == 3), copies - gone), (GONE, gone)):
                    if n and runs and runs[-1][0] == symbol:
                        runs[-1] = (symbol, runs[-1][1] + n)
                    elif n:
                        runs.append((symbol, n))
                if len(runs) >= PIECE:
                    yield _piece(conv, part, seq, runs, facts)
                    seq, runs, facts = seq + 1, [], None
            if runs:
                yield _piece(conv, part, seq, runs, facts)

    return lambda batches: _batches(pieces(batches), schema)


def _piece(conv, part, seq, runs, facts):
    move = runs_move(tuple(runs))
    flat = lambda m: [v for row in m for v in row]
    return (conv, part, seq, [s for s, _ in runs], [n for _, n in runs], flat(move.cost), flat(move.rank), *facts)


def _solve(schema: pa.Schema):
    """Pieces in order to one report per conversation."""

    def square(flat):
        return [flat[4 * i : 4 * i + 4] for i in STATES]

    def reports(batches):
        for conv, group in groupby(_rows(batches), key=lambda r: r[0]):
            moves, runs, total, last = [], [], [0] * 5, None
            low = high = seen = None
            distinct = 0
            for _, _, _, symbol, length, cost, rank, _, blank, dup, cut, illegal, first, end, turns, turn0, turn1 in group:
                moves.append((square(cost), square(rank)))
                runs.append((symbol, length))
                total = [a + b for a, b in zip(total, (0, blank, dup, cut, illegal))]
                total[4] += last is not None and (last, first) not in LEGAL
                last = end
                if turns:
                    distinct += turns - (turn0 == seen)
                    low, high, seen = turn0 if low is None else low, turn1, turn1
            price, way, ending = cheapest(moves)
            audit = [runs_move(tuple(zip(*r))).unroll(e, x) for r, (e, x) in zip(runs, way)]
            gaps = 0 if low is None else high - low + 1 - distinct
            yield (conv, gaps, *total[1:], price, "".join(audit) + ending)

    return lambda batches: _batches(reports(batches), schema)


def reports(rows: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) per conversation with a row."""
    types = {f.name: f.dataType.simpleString() for f in rows.select("conv_id", "turn").schema.fields}
    conv = f"conv {types['conv_id']}"
    ordered = symbols(plain_rows(rows)).repartitionByRange("conv", "turn", "role", "digest").sortWithinPartitions("conv", "turn", "role", "digest")
    piece = f"{conv}, {_PIECE.format(turn=types['turn'])}"
    pieces = ordered.select("conv", "turn", "role", "copies", "fault").mapInArrow(_cut(_arrow(piece)), piece)
    report = f"{conv}, {_REPORT}"
    return pieces.repartition("conv").sortWithinPartitions("conv", "part", "seq").mapInArrow(_solve(_arrow(report)), report)


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def _streamed(rows: DataFrame, conversations: DataFrame | None, finish, ddl: str) -> DataFrame:
    """`finish(conv, report, repaired rows)` gives the result rows of each conversation; texts are streamed past it."""
    plain = plain_rows(rows)
    report = reports(rows)
    facts = [c for c in report.columns if c != "conv"]
    key = ["conv", "kind", "turn", "role", "digest", "text", "copies"]
    known = report.select("conv", F.lit(0).alias("kind"), F.struct(*facts).alias("report"))
    if conversations is not None:
        ids = conversations.select(F.col("conv_id").alias("conv")).distinct()
        known = known.unionByName(ids.select("conv", F.lit(1).alias("kind")), allowMissingColumns=True)
    texts = plain.select("conv", F.lit(2).alias("kind"), "turn", "role", "digest", "text", "copies")
    both = texts.unionByName(known, allowMissingColumns=True).select(*key, "report")
    both = both.repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "digest").drop("digest", "turn")
    schema = _arrow(ddl)

    def run(batches):
        def results():
            for conv, group in groupby(_rows(batches), key=lambda r: r[0]):
                head = next(group)
                found = head[5] if head[1] == 0 else dict.fromkeys(facts, 0) | {"audit": ""}
                texts = ((role, text, copies) for _, kind, role, text, copies, _ in group if kind == 2)
                yield from finish(conv, found, replay(iter(found["audit"]), texts))

        return _batches(results(), schema, 256)

    return both.mapInArrow(run, ddl)


def repair(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    `rows` has conv_id, turn (a whole number), role, text and optionally `copies` (how often the row stands there). Rows are in the order of turn
    (nulls first), role and the text's MD5. A null role or text counts as one space, a null conv_id is a conversation of its
    own, repeated rows are duplicates, very long texts are read whole, other columns are not read. `conversations` names the
    conv_ids to report even without a row: zeros, an empty audit and the digest of nothing. A role that is empty or does not
    begin with s, u or a can't be kept.
    """
    conv = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}"

    def finish(conv_id, report, repaired):
        digest, first = hashlib.sha256(), True
        for role, text in repaired:
            digest.update((f"{role}:{text}" if first else f"\n{role}:{text}").encode())
            first = False
        yield (conv_id, *report.values(), digest.hexdigest())

    return _streamed(rows, conversations, finish, f"{conv}, {_REPORT}, repaired_sha256 string")


def repaired_rows(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), role, text; conversations that are deleted whole have none."""
    conv = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}"

    def finish(conv_id, report, repaired):
        for place, (role, text) in enumerate(repaired):
            yield conv_id, place, role, text

    return _streamed(rows, None, finish, f"{conv}, place long, role string, text string")
