"""Conversation structure repair: the cheapest edits that give a conversation the roles `(s?(ua)+)?`.

A row is kept (0), given the role user or assistant (3) or deleted (4); an empty text of the user or assistant may be
inserted anywhere (3). The first fault of a row counts: blank, duplicate (its role and text were there before) or
truncated (its last character but for white space is none of `.!?`). Blank and duplicate rows have to be deleted; a
truncated row that stays costs 3 more. Of the cheapest edits those with the least initials (K, R, D, I) in ASCII order
are taken. The search is Dijkstra's on a lattice of nodes (rows taken, state of the grammar) that exists only as far as
it is reached, by (cost, initials); it ends at the first accepting end node that is popped.

Rows stand in the order of turn (nulls first), role and text, which running sums over range partitions number. Blocks of
`BLOCK` rows are searched apart, so that no conversation has to lie in one task: a conversation of several blocks is
searched from each state at which a block may begin to each at which it may end, the costs and the order of the initials
are joined over trees of `FAN` blocks, and the states that the best way passes come back down to the blocks. That is
exact: an insertion before a block's first row belongs to that block, so that initials which lead to one place are never
a beginning of each other, and comparing what came before decides unless it is equal.

Null roles and texts are one space; so a row with a null text is blank. A null conversation is one of its own. Repeated
rows are duplicates. A table without rows gives none. Further columns, of any name, are not read. A long text is moved
whole, but is no part of the search. The digest of a repaired conversation reads its text once, in order, in one task,
which holds one row at a time.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, running_total

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLOCK, FAN = 512, 256
#: States: at the beginning, after the system, after the user, after the assistant. What each lets follow.
STATES = range(4)
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
#: A row as one character: its role's initial as it is, in capitals if truncated, a digit if it has to be deleted.
PLAIN, CUT, GONE = "suax", "SUAX", "0123"
LEGAL = {"su", "ua", "au"}
BLANK_CLASS = r"[^\x20\x09-\x0D]"
EMPTY = hashlib.sha256(b"").hexdigest()


@lru_cache(1 << 16)
def cheapest(rows: str, start: int, last: bool, goal: int = -1) -> dict[int, tuple[int, str]]:
    """Of the ways from a state over rows, the best to each state at the end, or to the goal alone.

    After the last row of a conversation (`last`) something may be inserted; then -2 as goal is any accepting state."""
    n, out, done = len(rows), {}, set()
    heap = [(0, "", 0, start)]
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n:
            out[state] = cost, audit
            if state == goal or goal == -2 and state in ENDS:
                return {state: (cost, audit)}
        if i < n:
            code = rows[i]
            heapq.heappush(heap, (cost + DELETE, audit + "D", i + 1, state))
            if code not in GONE:
                more = cost + (TRUNCATED if code in CUT else 0)
                to = NEXT[state].get(code.lower())
                if to is not None:
                    heapq.heappush(heap, (more + KEEP, audit + "K", i + 1, to))
                for role, to in NEXT[state].items():
                    if role in ROLES:
                        heapq.heappush(heap, (more + REROLE, audit + "R", i + 1, to))
        if i < n or last:
            for role, to in NEXT[state].items():
                if role in ROLES:
                    heapq.heappush(heap, (cost + INSERT, audit + "I", i, to))
    return out


FAR = 1 << 60


def summary(rows: str, first: bool, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Costs from each state to each over a block, and of the ways from one state the order of their initials."""
    cost, rank = np.full((4, 4), FAR, dtype=np.int64), np.zeros((4, 4), dtype=np.int64)
    for start in STATES if not first else (0,):
        found = cheapest(rows, start, last)
        order = sorted(found, key=lambda to: found[to][1])
        for to, (c, _) in found.items():
            cost[start, to], rank[start, to] = c, order.index(to)
    return cost, rank


def joined(blocks: list[tuple[np.ndarray, np.ndarray]], start: int) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """Over blocks in order, from a state: the cost and the rank of each last state, and before each block the state that it comes from."""
    cost, rank, back = np.full(4, FAR, dtype=np.int64), np.zeros(4, dtype=np.int64), []
    cost[start] = 0
    for c, r in blocks:
        ways = {}
        for to in STATES:
            own = [(int(cost[s] + c[s, to]), int(rank[s]), s) for s in STATES if cost[s] < FAR and c[s, to] < FAR]
            if own:
                ways[to] = min(own)
        order = sorted(ways, key=lambda to: (ways[to][1], r[ways[to][2], to]))
        cost, rank = np.full(4, FAR, dtype=np.int64), np.zeros(4, dtype=np.int64)
        for to, (whole, _, _) in ways.items():
            cost[to], rank[to] = whole, order.index(to)
        back.append([ways[to][2] if to in ways else -1 for to in STATES])
    return cost, rank, back


def _packed(cost: np.ndarray, rank: np.ndarray) -> list[int]:
    return [*cost.ravel().tolist(), *rank.ravel().tolist()]


def _unpacked(x) -> tuple[np.ndarray, np.ndarray]:
    both = np.asarray(x, dtype=np.int64).reshape(2, 4, 4)
    return both[0], both[1]


def initial(role: str = "role") -> Column:
    return F.when(F.substring(role, 1, 1).isin("s", "u", "a"), F.substring(role, 1, 1)).otherwise("x")


def _code(initial: str, fault: str) -> Column:
    at = F.instr(F.lit(PLAIN), F.col(initial))
    pick = lambda letters: F.substring(F.lit(letters), at, F.lit(1))
    return F.when(F.col(fault).isin("blank", "duplicate"), pick(GONE)).when(F.col(fault) == "truncated", pick(CUT)).otherwise(pick(PLAIN))


def numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows' texts by number (id, role, text), and their places (id, conv_id, turn, place, initial, fault)."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("id"))
    held = checkpointed(rows.withColumn("same", F.sha2(F.concat("role", F.lit("\0"), "text"), 256)))
    own = F.when(~F.col("text").rlike(BLANK_CLASS), "blank").when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated").alias("own")
    narrow = held.select("id", "conv_id", "turn", "role", "same", own, F.lit(1).cast("long").alias("one"))
    placed = running_total(narrow.withColumn("initial", initial()), ["turn", "role", "same", "id"], "one", "place", ["conv_id"])
    placed = checkpointed(placed.select("id", "conv_id", "turn", "initial", "own", "same", "place"))
    # The first of each role and text, by number: no key of a join is held by more than one row.
    firsts = placed.groupBy("conv_id", "same").agg(F.min_by("id", "place").alias("first")).select("first")
    fault = F.when(F.col("own") == "blank", "blank").when(F.col("first").isNull(), "duplicate").otherwise(F.col("own")).alias("fault")
    marked = placed.join(firsts, F.col("id") == F.col("first"), "left")
    return held.select("id", "role", "text"), marked.select("id", "conv_id", "turn", "place", "initial", fault)


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows by blocks: conv_id, block, codes, ids, the initial of the row before, numbers of faults."""
    block = F.floor(F.col("place") / size)
    own = F.struct(block.alias("block"), F.lit(True).alias("own"))
    after = F.struct((block + 1).alias("block"), F.lit(False).alias("own"))
    dealt = rows.select("*", _code("initial", "fault").alias("code"), F.explode(F.when((F.col("place") + 1) % size == 0, F.array(own, after)).otherwise(F.array(own))).alias("to"))
    mine = F.when(F.col("to.own"), F.struct("place", "code", "id"))
    counts = [F.count_if(F.col("to.own") & (F.col("fault") == f)).alias(f) for f in ("blank", "duplicate", "truncated")]
    found = dealt.groupBy("conv_id", F.col("to.block").alias("block")).agg(F.array_sort(F.collect_list(mine)).alias("rows"), F.max(F.when(~F.col("to.own"), F.col("initial"))).alias("before"), *counts)
    return found.select("conv_id", "block", F.array_join("rows.code", "").alias("codes"), F.col("rows.id").alias("ids"), "before", "blank", "duplicate", "truncated")


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b[["conv_id", "node"]].assign(ways=[_packed(*summary(c, k == 0, k == m)) for c, k, m in zip(b["codes"], b["node"], b["last"])])


def _up(group: pd.DataFrame) -> list[int]:
    blocks = [_unpacked(x) for x in group.sort_values("node")["ways"]]
    ways = [joined(blocks, s)[:2] for s in STATES]
    return _packed(np.stack([w[0] for w in ways]), np.stack([w[1] for w in ways]))


def _spans(blocks: DataFrame, fan: int) -> DataFrame:
    """conv_id, block, start and goal of the blocks of conversations with several: the states between which the best way lies."""
    kind = blocks.schema["conv_id"].dataType.simpleString()
    ways = f"conv_id {kind}, node long, ways array<long>"
    levels = [checkpointed(blocks.where("last > 0").select("conv_id", F.col("block").alias("node"), "codes", "last").mapInPandas(_summed, ways))]
    while levels[-1].agg(F.max("node").alias("m")).first()["m"]:
        up = lambda g: g.iloc[:1][["conv_id"]].assign(node=g["node"].iloc[0] // fan, ways=[_up(g)])
        levels.append(checkpointed(levels[-1].groupBy("conv_id", F.floor(F.col("node") / fan).alias("parent")).applyInPandas(up, ways)))

    def ended(x: pd.Series) -> pd.Series:
        both = [_unpacked(w) for w in x]
        return pd.Series([min((c[0, t], r[0, t], t) for t in ENDS)[2] for c, r in both])

    goal = F.pandas_udf(ended, "int")
    spans = levels[-1].select("conv_id", "node", F.lit(0).alias("start"), goal("ways").cast("int").alias("goal"))

    def down(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("node")
        _, _, back = joined([_unpacked(x) for x in g["ways"]], int(g["start"].iloc[0]))
        states = [int(g["goal"].iloc[0])]
        for b in reversed(back):
            states.append(b[states[-1]])
        states.reverse()
        return g[["conv_id", "node"]].assign(start=states[:-1], goal=states[1:])

    for level in reversed(levels[:-1]):
        above = spans.select(F.col("conv_id").alias("c"), F.col("node").alias("parent"), "start", "goal")
        below = level.withColumn("up", F.floor(F.col("node") / fan)).join(above, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("up") == F.col("parent")))
        spans = below.select("conv_id", "up", "node", "ways", "start", "goal").groupBy("conv_id", "up").applyInPandas(down, f"conv_id {kind}, node long, start int, goal int")
    return spans


EDIT = "place long, n int, edit string, role string, id long"


def _edited(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {k: [] for k in ("cost", "audit", "illegal", "edits")}
            columns = [b.column(c).to_pylist() for c in ("codes", "ids", "before", "block", "last", "start", "goal")]
            for codes, ids, before, block, last, start, goal in zip(*columns):
                (end, (cost, audit)), = cheapest(codes, start or 0, block == last, -2 if goal is None else goal).items()
                del end
                row, state, edits = 0, start or 0, []
                for n, edit in enumerate(audit):
                    role = None
                    if edit in "IR":
                        initial, = NEXT[state].keys() & ROLES.keys()
                        role = ROLES[initial]
                    elif edit == "K":
                        initial = codes[row].lower()
                    if edit != "D":
                        state = NEXT[state][initial]
                    edits.append({"place": block * size + row, "n": n, "edit": edit, "role": role, "id": None if edit == "I" else ids[row]})
                    row += edit != "I"
                roles = (before or "") + codes.lower().translate(str.maketrans(GONE, PLAIN))
                out["cost"].append(cost)
                out["audit"].append(audit)
                out["illegal"].append(sum(x + y not in LEGAL for x, y in pairwise(roles)))
                out["edits"].append(edits)
            kinds = {"cost": pa.int64(), "audit": pa.string(), "illegal": pa.int64(), "edits": pa.list_(pa.struct([("place", pa.int64()), ("n", pa.int32()), ("edit", pa.string()), ("role", pa.string()), ("id", pa.int64())]))}
            made = [pa.array(out[k], kinds[k]) for k in kinds]
            kept = [b.column(c) for c in ("conv_id", "block", "blank", "duplicate", "truncated")]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=["conv_id", "block", "blank", "duplicate", "truncated", *kinds])

    return run


def repair(turns: DataFrame, block: int = BLOCK, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """Of conversations (conv_id, turn, role, text) their edits and their reports.

    edits: conv_id, place, n (order among a block's edits), edit, role and text; deleted rows have the role and text they had.
    reports: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.
    """
    texts, rows = numbered(turns)
    rows = checkpointed(rows)
    blocks = checkpointed(_blocks(rows, block))
    last = blocks.groupBy(F.col("conv_id").alias("c")).agg(F.max("block").alias("last"))
    blocks = blocks.join(last, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    spans = _spans(blocks, fan).select(F.col("conv_id").alias("c"), F.col("node").alias("b"), "start", "goal")
    spanned = blocks.join(spans, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")), "left").drop("c", "b")
    kind = rows.schema["conv_id"].dataType.simpleString()
    solved = checkpointed(spanned.mapInArrow(_edited(block), f"conv_id {kind}, block long, blank long, duplicate long, truncated long, cost long, audit string, illegal long, edits array<struct<{EDIT.replace(' ', ':').replace(',:', ',')}>>"))
    every = solved.select("conv_id", F.explode("edits").alias("e")).select("conv_id", "e.place", "e.n", "e.edit", F.col("e.role").alias("to"), F.col("e.id").alias("edited"))
    stay = every.where("edited is not null").join(texts, F.col("edited") == F.col("id")).select("conv_id", "place", "n", "edit", F.coalesce("to", "role").alias("role"), "text")
    edits = stay.union(every.where("edited is null").select("conv_id", "place", "n", "edit", F.col("to").alias("role"), F.lit("").alias("text")))
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    audit = F.array_join(F.array_sort(F.collect_list(F.struct("block", "audit"))).getField("audit"), "").alias("audit")
    reports = solved.groupBy("conv_id").agg(*sums, audit)
    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    gaps = rows.groupBy(F.col("conv_id").alias("c")).agg(F.coalesce(span, F.lit(0)).cast("long").alias("gaps"))
    reports = reports.join(gaps, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return edits, reports


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, state, kind = [], None, None  # the conversation that is being read, and what its digest is so far

    def ended() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(now, kind), pa.array([state.hexdigest()])], names=["conv_id", "repaired_sha256"])

    for b in batches:
        kind = b.schema.field("conv_id").type
        for conv, role, text in zip(b.column("conv_id").to_pylist(), b.column("role"), b.column("text")):
            if now != [conv]:
                if now:
                    yield ended()
                now, state = [conv], hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(role.as_buffer())
            state.update(b":")
            state.update(text.as_buffer())
    if now:
        yield ended()


def digests(edits: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of conversations that have rows after their repair."""
    rows = edits.where("edit <> 'D'").repartition("conv_id").sortWithinPartitions("conv_id", "place", "n")
    kind = edits.schema["conv_id"].dataType.simpleString()
    return rows.select("conv_id", "role", "text").mapInArrow(_hashed, f"conv_id {kind}, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with faults that the checksum of a row's key decides on: rows dropped, emptied, without stops, repeated or given to the user."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fault = F.crc32(key) % 20
    rows = turns.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(role).alias("role"), F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), fault.alias("fault"))
    times = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where("fault <> 0").select("conv_id", "turn", "role", "text", F.explode(times)).select("conv_id", "turn", "role", "text")
