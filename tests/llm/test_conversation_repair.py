"""Op 12: auctions against trying all edits, the whole operator against plain Python, segments of any size, and SQL."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from millrace.llm import conversation_repair as repair
from millrace.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """(cost, audit, lines) of the cheapest edits of (role, text, fault), by forward steps over states."""
    known = {"": (0, "", ())}  # role initials so far, as far as they matter -> best

    def better(table, state, value):
        if state not in table or value[:2] < table[state][:2]:
            table[state] = value

    def inserted(table):
        out = dict(table)
        for _ in range(2):
            for state, (cost, audit, lines) in list(out.items()):
                role = "assistant" if state == "u" else "user"
                better(out, role[0], (cost + 2, audit + "I", (*lines, f"{role}:")))
        return out

    for role, text, fault in rows:
        after = {}
        for state, (cost, audit, lines) in inserted(known).items():
            better(after, state, (cost + 3, audit + "D", lines))
            if fault not in ("blank", "duplicate"):
                more = cost + (fault == "truncated")
                new = "assistant" if state == "u" else "user"
                better(after, new[0], (more + 2, audit + "R", (*lines, f"{new}:{text}")))
                first = role[:1]
                if first == "s" and state == "" or first == "u" and state != "u" or first == "a" and state == "u":
                    better(after, first, (more, audit + "K", (*lines, f"{role}:{text}")))
        known = after
    known = inserted(known)
    return min(known[s] for s in ("", "a") if s in known)


def plain(rows):
    """conv_id -> what the query gives, in plain Python; rows are (conv_id, turn, role, text) after damage."""
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append((r[1], " " if r[2] is None else r[2], " " if r[3] is None else r[3]))
    out = {}
    for conv_id, found in by.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, faulty = set(), []
        for _, role, text in found:
            last = text.strip(" \t\n\v\f\r")[-1:]
            faulty.append((role, text, "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else ""))
            seen.add((role, text))
        turns = [t for t, _, _ in found if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        counts = [sum(f == x for _, _, f in faulty) for x in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(faulty))
        cost, audit, lines = cheapest(faulty)
        out[conv_id] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def damaged(rows):
    for conv_id, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        chance = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv_id, turn)).encode()) % 20
        if chance:
            text = "" if chance == 1 else re.sub("[.!?]", "", text) if chance == 2 else text
            yield from [(conv_id, turn, "user" if chance == 4 else role, text)] * (2 if chance == 3 else 1)


def random_cells(rng, n):
    return [rng.choice([0, 1, 2, 2, 3, 3]) + rng.choice([0, 0, 0, 4, 8]) for _ in range(n)]


def distances(arcs, goal):
    """Least costs to the goal by relaxing all arcs."""
    far = [repair.NEVER] * len(arcs)
    far[goal] = 0
    for _ in arcs:
        for i, out in enumerate(arcs):
            far[i] = min([far[i], *(c + far[j] for _, j, c in out)])
    return far


def test_auction_prices_are_optimal_and_tight_paths_least():
    rng = random.Random(4)
    for _ in range(150):
        cells = random_cells(rng, rng.randint(1, 6))
        arcs = repair.lattice(cells, [rng.randint(0, 9) for _ in range(4)])
        goal, prices = len(arcs) - 1, [0] * len(arcs)
        far = distances(arcs, goal)
        for origin in range(4):
            assert repair.auction(arcs, origin, prices) == far[origin]
            assert all(prices[i] <= c + prices[j] for i, out in enumerate(arcs) for _, j, c in out)
            paths, found = [(origin, "")], []
            while paths:  # all shortest paths
                i, labels = paths.pop()
                found += [labels] if i == goal else []
                paths += [(j, labels + label) for label, j, c in arcs[i] if far[i] == c + far[j]]
            assert repair.trace(arcs, origin, prices)[0] == min(found)


def test_segment_costs_multiply():
    rng = random.Random(5)
    for _ in range(60):
        a, b = random_cells(rng, rng.randint(1, 5)), random_cells(rng, rng.randint(1, 5))
        assert repair.times(repair.costs(a), repair.costs(b)) == repair.costs(a + b)


def test_audits_equal_forward_steps():
    rng = random.Random(6)
    for _ in range(400):
        rows = [(rng.choice(["system", "user", "assistant", "tool", ""]), rng.choice("xyz"), rng.choice(["", "", "", "blank", "duplicate", "truncated"])) for _ in range(rng.randint(1, 9))]
        cells = [{"s": 1, "u": 2, "a": 3}.get(r[:1], 0) + {"": 0, "blank": 4, "duplicate": 4, "truncated": 8}[f] for r, _, f in rows]
        arcs = repair.lattice(cells, repair.END)
        prices = [0] * len(arcs)
        cost = repair.auction(arcs, 0, prices)
        audit, state = repair.trace(arcs, 0, prices)
        assert (cost, audit + repair.TAIL[state]) == cheapest(rows)[:2]


def odd_rows():
    rng = random.Random(7)
    rows = [(1, None, None, None), (1, None, "user", "No end"), (None, 3, "assistant", "Hm."), (None, 9, "user", "Hm."), (2, 0, "", "."), (3, 0, "user", "x " * 40_000), (4, 5, "system", "Be kind.")]
    rows += [(5, 1, "user", "Same.")] * 7 + [(6, t, "user", "Hi.") for t in (3, 3, 1)] + [(7, 1, "system", "A.\t\n"), (7, 2, "system", "B!")]
    rows += [(8, t, rng.choice(["user", "assistant", "assistant", "system", "other"]), rng.choice(["Yes.", "no", "", "Why? ", f"Text {t}.", f"Text {t}"])) for t in range(150)]
    return rows


@pytest.mark.parametrize(("segment", "fan"), [(64, 1024), (3, 2)])
def test_repair_equals_plain_python(spark, segment, fan):
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as n", "2 as segment", "3 as row", "4 as res", "5 as key", "6 as at_id", "7 as `a.b`")
    repaired = repair.repair_conversations(df, segment, fan)
    got = {r.conv_id: tuple(r)[1:] for r in repair.summarize(repaired).collect()}
    assert got == plain(rows)
    edits = sorted(repaired.where("conv_id = 5").collect(), key=lambda r: r.segment)
    assert [e.edit for r in edits for e in r.edits] == list("KDDDDDDI")


def test_op12_equals_plain_python_and_sql(spark, sf, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    every, some = {r[0] for r in rows}, plain(damaged(rows))
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    got = [tuple(r) for r in queries.op12_conversation_repair(spark, sf).collect()]
    assert {r[0]: r[1:] for r in got} == {c: some.get(c, none) for c in every} and len(got) == len(every)
    odd = odd_rows() + [(100 + c, t, "user", "Gone.") for c in range(40) for t in range(1)]
    spark.createDataFrame(odd, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(tuple, queries.op12_conversation_repair(spark, str(tmp_path)).collect()), key=str)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert got == sorted(con.sql(queries.OP12_SQL).fetchall(), key=str)
    assert any(r[1:] == none for r in got)


def test_op12_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op12_conversation_repair(spark, str(tmp_path))
    assert got.collect() == [] and got.columns == ["conv_id", *repair.SUMMARY, "audit", "repaired_sha256"]
