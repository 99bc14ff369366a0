"""Repair of conversations against a search over all edits."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from plumbline.llm import queries, repair

GRAMMAR = re.compile(r"(s?(ua)+)?")


def brute(rows):
    """(cost, initials, repaired) of the best edits of (role, text, fault) rows, by dynamic programming over whole words of edits."""
    best = {(0, ""): (0, "", ())}  # by rows taken and role initials so far
    for i in range(len(rows) + 1):
        for _ in range(2 * len(rows) + 4):  # insertions until nothing changes
            more = {}
            for (at, said), (cost, audit, out) in list(best.items()):
                if at == i and len(said) < 2 * len(rows) + 3:
                    for role in ("user", "assistant"):
                        more.setdefault((i, said + role[0]), []).append((cost + 3, audit + "I", (*out, (role, ""))))
            changed = False
            for key, ways in more.items():
                if GRAMMAR.fullmatch(key[1] + "a") or GRAMMAR.fullmatch(key[1]) or GRAMMAR.fullmatch(key[1] + "ua"):
                    way = min(ways + ([best[key]] if key in best else []))
                    changed |= best.get(key) != way
                    best[key] = way
            if not changed:
                break
        if i == len(rows):
            break
        role, text, fault = rows[i]
        for (at, said), (cost, audit, out) in list(best.items()):
            if at != i:
                continue
            ways = [(4, "D", said, out)]
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault == "truncated" else 0
                ways.append((extra, "K", said + (role[:1] or "x"), (*out, (role, text))))
                ways += [(3 + extra, "R", said + r[0], (*out, (r, text))) for r in ("user", "assistant")]
            for c, e, s, o in ways:
                if GRAMMAR.fullmatch(s + "a") or GRAMMAR.fullmatch(s) or GRAMMAR.fullmatch(s + "ua"):
                    way = (cost + c, audit + e, o)
                    best[i + 1, s] = min(best.get((i + 1, s), way), way)
    return min(w for (at, said), w in best.items() if at == len(rows) and GRAMMAR.fullmatch(said))


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not last else "duplicate" if (role, text) in seen else None if last[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def expected(table, harm):
    """The contract's row for each conversation, in plain Python."""
    out = []
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in sorted((r for r in table if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or " ", r[3] or " ")):
            role, text = (" " if x is None else x for x in (role, text))
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if harm else 9
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            rows += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{r[1]}\0{r[2]}".encode()).hexdigest()))
        found = faults([r[1:] for r in rows])
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, audit, left = brute([(r[1], r[2], f) for r, f in zip(rows, found)])
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
        out.append((conv, gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit, digest))
    return sorted(out, key=repr)


def made(seed, conversations, most):
    r = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for turn in range(r.randint(1, most)):
            rows.append((conv, r.choice([turn, turn, turn, turn + 3]), r.choice(["user", "assistant", "user", "assistant", "system", "tool"]), r.choice(["Yes.", "No!", f"What {turn}?", "cut off", "", " \n", f"so {turn}. ", "it ends.\n "])))
    return rows


ODD = [(None, 0, "user", "a."), (None, None, None, None), (7, None, "user", None), (8, 2, None, "Hm."), (9, 5, "system", "Only."), (10, 1, "user", "é 漢字 🙂!"), (10, 1, "user", "é 漢字 🙂!"), (10, 2, "", "x."), (11, 0, "user", "w " * 500_000 + "."), (11, 1, "assistant", "w " * 500_000)]
KIND = "conv_id long, turn long, role string, text string"


def rows_of(spark, table, **sizes):
    edits, reports = repair.repair(spark.createDataFrame(table, KIND), **sizes)
    digest = {r[0]: r[1] for r in repair.digests(edits).collect()}
    return sorted(((*r, digest.get(r[0], repair.EMPTY)) for r in reports.collect()), key=repr)


def test_search_equals_all_edits():
    r = random.Random(3)
    for n in itertools.chain(range(7), [6] * 300):
        rows = [(r.choice(["user", "assistant", "system", "x"]), "t", r.choice([None, None, "truncated", "blank"])) for _ in range(n)]
        codes = "".join({None: repair.PLAIN, "truncated": repair.CUT}.get(f, repair.GONE)["suax".index(role[0])] for role, _, f in rows)
        (found,) = repair.cheapest(codes, 0, True, -2).values()
        assert found == brute(rows)[:2]


def test_joined_blocks_equal_one_search():
    r = random.Random(4)
    for _ in range(200):
        codes = "".join(r.choice("suauauaxSUA13") for _ in range(r.randint(4, 30)))
        size = r.randint(1, 5)
        blocks = [codes[i : i + size] for i in range(0, len(codes), size)]
        ways = [repair.summary(b, i == 0, i == len(blocks) - 1) for i, b in enumerate(blocks)]
        cost, rank, back = repair.joined(ways, 0)
        states = [min((cost[t], rank[t], t) for t in repair.ENDS)[2]]
        for b in reversed(back):
            states.append(b[states[-1]])
        states.reverse()
        audit = "".join(repair.cheapest(b, s, i == len(blocks) - 1, g)[g][1] for i, (b, s, g) in enumerate(zip(blocks, states, states[1:])))
        (whole,) = repair.cheapest(codes, 0, True, -2).values()
        assert audit == whole[1] and cost[states[-1]] == whole[0]


@pytest.mark.parametrize(("block", "fan"), [(512, 256), (2, 2)])
def test_repair_equals_plain_python(spark, block, fan):
    table = made(1, 40, 9) + ODD[:8]
    assert rows_of(spark, table, block=block, fan=fan) == expected(table, False)


def test_odd_rows_and_long_texts(spark):
    assert rows_of(spark, ODD) == expected(ODD, False)
    assert rows_of(spark, []) == []


def test_long_conversation_is_repaired_over_blocks(spark):
    table = [(1, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(5000) if t % 100 != 7]
    (row,) = rows_of(spark, table, block=64, fan=4)
    assert row[1] == 50 and row[6] == 150 and row[7].count("I") == 50 and len(row[7]) == 5000


def test_query(spark, tmp_path):
    table = made(2, 60, 8) + [(99, 0, "user", "Dropped."), *ODD[:8]]
    spark.createDataFrame(table, KIND).write.parquet(f"{tmp_path}/conversations.parquet")
    found = queries.op13_structure_repair(spark, str(tmp_path))
    order = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted((tuple(r) for r in found.select(*order).collect()), key=repr) == expected(table, True)


def test_query_when_all_rows_go(spark, tmp_path):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "Hm.")], KIND).write.parquet(f"{tmp_path}/conversations.parquet")
    (row,) = queries.op13_structure_repair(spark, str(tmp_path)).collect()
    assert (row["conv_id"], row["cost"], row["audit"], row["gaps"], row["repaired_sha256"]) == (gone, 0, "", 0, repair.EMPTY)
