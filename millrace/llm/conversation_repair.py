"""Conversation structure repair: the cheapest edits that make a conversation alternate, by the auction algorithm.

The rows of a conversation and four states (nothing yet, after system, after user, after assistant) span a lattice whose
arcs are edits with integer costs. Its shortest path is found by an auction: every node has a price, which never exceeds
the cost of an arc plus the price where it leads; a path grows from the origin along arcs that meet this bound, and
where none does, the last node's price rises to the least bound and the path loses that node. When the path reaches
the goal the prices are an optimal dual solution: the shortest paths are just the paths of tight arcs, and the
one whose labels are least is traced among them.

No conversation is brought into one task whole. Rows are sorted and numbered over the table, and a segment is SEGMENT
consecutive numbers of one conversation. A segment is a map from the state before to the state after it: auctions give
its 4 x 4 costs, products of these give every segment the costs from its end on (the prices of its last nodes), with
which it is traced from each state before it, and composing the traces gives the state that each really starts in.
Products and compositions go through blocks of FAN segments, blocks of blocks and so on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.llm._common import annotate, materialize, release
from millrace.operators.relational import number_rows

SEGMENT, FAN = 64, 1024
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: States: nothing yet, after system, after user, after assistant; the state after the next inserted or reroled row.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = ("", "", "user", "assistant")
LEGAL = frozenset(["su", "ua", "au"])
#: What it costs to end in each state, and the edits for that.
END = [0, 2 * INSERT, INSERT, 0]
TAIL = ["", "II", "I", ""]
FAULTS = ["", "blank", "duplicate", "truncated"]
NEVER = 1 << 40
BLANKS = " \t\n\x0b\x0c\r"

Arcs = list[list[tuple[str, int, int]]]


def lattice(cells: list[int], ends: list[int]) -> Arcs:
    """Arcs (label, to, cost) by node, least label first; node 4 i + s is state s before row i, the last one the goal.

    A cell is the state that keeping the row leads to (0: none), + 4 if it must go, + 8 if it is truncated.
    """
    out: Arcs = []
    for i, cell in enumerate(cells):
        leads, cut = cell & 3, TRUNCATED * (cell >> 3)
        for state, to in enumerate(NEXT):
            arcs = [("D", 4 * i + 4 + state, DELETE), ("I", 4 * i + to, INSERT)]
            if not cell & 4:
                if leads == to or leads == SYSTEM and state == START:
                    arcs.append(("K", 4 * i + 4 + leads, cut))
                arcs.append(("R", 4 * i + 4 + to, REROLE + cut))
            out.append(arcs)
    goal = len(out) + 4
    return out + [[("", goal, e)] if e < NEVER else [] for e in ends] + [[]]


def auction(arcs: Arcs, origin: int, prices: list[int]) -> int:
    """The least cost from the origin to the goal, which must be reachable; prices end up optimal for it.

    prices must not exceed cost + price at any arc's end: all 0, or what an earlier auction left.
    """
    goal, path = len(arcs) - 1, [origin]
    while path[-1] != goal:
        i = path[-1]
        least, to = NEVER, -1
        for _, j, cost in arcs[i]:
            if cost + prices[j] < least:
                least, to = cost + prices[j], j
        if prices[i] < least:  # contract
            prices[i] = least
            if len(path) > 1:
                path.pop()
        else:
            path.append(to)
    return prices[origin]


def trace(arcs: Arcs, origin: int, prices: list[int]) -> tuple[str, int]:
    """(labels, last state) of the path of tight arcs with the least labels."""
    goal, nodes, labels, dead = len(arcs) - 1, [origin], [], set()
    while nodes[-1] != goal:
        i = nodes[-1]
        step = next(((label, j) for label, j, cost in arcs[i] if j not in dead and prices[i] == cost + prices[j]), None)
        if step is None:
            dead.add(i)
            nodes.pop()
            labels.pop()
        else:
            labels.append(step[0])
            nodes.append(step[1])
    return "".join(labels), nodes[-2] % 4


def costs(cells: list[int]) -> list[int]:
    """Least cost from each state before the cells (rows of the 4 x 4 matrix) to each after them."""
    out = [NEVER] * 16
    keeps_system = any(c & 7 == SYSTEM for c in cells)
    for after in range(4):
        arcs = lattice(cells, [0 if s == after else NEVER for s in range(4)])
        prices = [0] * len(arcs)
        for before in range(4):
            reachable = after >= USER or before == after or (after == SYSTEM and before == START and keeps_system)
            if reachable:
                out[4 * before + after] = auction(arcs, before, prices)
    return out


def times(a: list[int], b: list[int]) -> list[int]:
    """The product of two cost matrices: least sums."""
    return [min(NEVER, *(a[4 * i + k] + b[4 * k + j] for k in range(4))) for i in range(4) for j in range(4)]


def scan(chain: DataFrame, combine: Callable, act: Callable, start: list[int], backwards: bool, fan: int) -> DataFrame:
    """(conv_id, i, state): the state in which each part of a chain (conv_id, i, v) is met, from one end to the other.

    act(v, state) is the state behind a part and combine(v, w) the part that acts like v and then w in ascending order
    of i. A task sees up to `fan` parts of a chain; longer chains are combined in blocks and scanned block by block.
    """
    kind, longs = chain.schema["conv_id"].dataType, T.ArrayType(T.LongType())
    row = lambda name: T.StructType([T.StructField("conv_id", kind), T.StructField("i", T.LongType()), T.StructField(name, longs)])
    chain = chain.withColumn("block", F.floor(F.col("i") / fan))
    longest = chain.agg(F.max("i").alias("i")).first().i
    given = chain.withColumn("from", F.array(*[F.lit(s) for s in start]).cast(longs))
    if longest is not None and longest >= fan:

        def whole(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("i")
            total = None
            for v in rows["v"]:
                total = list(v) if total is None else combine(total, list(v))
            return pd.DataFrame({"conv_id": rows["conv_id"].iloc[:1], "i": rows["block"].iloc[:1], "v": [total]})

        blocks = materialize(chain.groupBy("conv_id", "block").applyInPandas(whole, row("v")))
        known = scan(blocks, combine, act, start, backwards, fan).select(F.col("conv_id").alias("at_id"), F.col("i").alias("at"), F.col("state").alias("from"))
        given = chain.join(known, F.col("conv_id").eqNullSafe(F.col("at_id")) & (F.col("block") == F.col("at"))).drop("at_id", "at")

    def go(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i", ascending=not backwards)
        state, met = list(rows["from"].iloc[0]), []
        for v in rows["v"]:
            met.append(state)
            state = act(list(v), state)
        return pd.DataFrame({"conv_id": rows["conv_id"], "i": rows["i"], "state": met})

    return given.groupBy("conv_id", "block").applyInPandas(go, row("state"))


def _to_end(v: list[int], end: list[int]) -> list[int]:
    return [min(NEVER, *(v[4 * i + k] + end[k] for k in range(4))) for i in range(4)]


def _faults(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows in order, numbered over the table as `n`; narrow rows conv_id, n, initial, fault), fault an index of FAULTS."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    plain = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"))
    # equal rows are told apart by where they were read, so that no range of the sort holds too many
    keyed = plain.withColumns({"key": F.sha2("text", 256), "tie": F.monotonically_increasing_id()})
    ordered = number_rows(keyed.orderBy("conv_id", "turn", "role", "key", "tie"), "n")
    trimmed = F.rtrim("text", F.lit(BLANKS))
    own = F.when(trimmed == "", 1).when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    narrow = ordered.select("conv_id", "n", "role", "key", own.alias("own"))
    first = narrow.groupBy("conv_id", "role", "key").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    # a written table: both sides of the join are then plain exchanges, whose hot partitions Spark splits
    first = materialize(first.select(F.col("conv_id").alias("at_id"), F.col("role").alias("at_role"), F.col("key").alias("at_key"), "first")).hint("merge")
    same = F.col("conv_id").eqNullSafe(F.col("at_id")) & (F.col("role") == F.col("at_role")) & (F.col("key") == F.col("at_key"))
    fault = F.when((F.col("own") != 1) & (F.col("n") > F.col("first")), 2).otherwise(F.col("own"))
    return ordered, narrow.join(first, same, "left").select("conv_id", "n", F.left("role", F.lit(1)).alias("initial"), fault.alias("fault"))


def _cells(rows: Column) -> Column:
    leads = lambda r: F.when(r["initial"] == "s", SYSTEM).when(r["initial"] == "u", USER).when(r["initial"] == "a", ASSISTANT).otherwise(0)
    return F.transform(rows, lambda r: leads(r) + F.when(r["fault"].isin(1, 2), 4).when(r["fault"] == 3, 8).otherwise(0))


EDIT = [("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]


def apply_edits(rows: list[dict], audit: str, state: int) -> list[dict]:
    """One dict (edit, turn, role, text) for each edit."""
    out, at = [], iter(rows)
    for label in audit:
        row = {"turn": None, "role": "", "text": ""} if label == "I" else next(at)
        leads = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(row["role"][:1]) if label == "K" else NEXT[state]
        role = row["role"] if label in "KD" else ROLES[leads]
        state = state if label == "D" else leads
        out.append({"edit": label, "turn": row["turn"], "role": role, "text": row["text"]})
    return out


def repair_conversations(rows: DataFrame, segment: int = SEGMENT, fan: int = FAN) -> DataFrame:
    """(conv_id, segment, edits, faults, initials) of rows (conv_id, turn, role, text), one row per segment, written.

    edits: array of (edit, turn, role, text) in order: K kept, R with a new role, I inserted, D deleted. faults: an index
    of FAULTS for each row. initials: the first letters of the rows' roles, that of the row before the segment first.

    A conversation's rows go by turn, nulls first, those of one turn by role and SHA-256 of the text; repeated rows are
    rows. A null role or text is one space, a null conv_id is a conversation like any other, an empty table gives no
    rows. Texts count as equal if their SHA-256 is.
    """
    ordered, faulty = _faults(rows)
    place = F.floor(F.col("n") / segment)
    # the last row of a segment is also shown to the next one, for the pair of roles that they form
    shown = faulty.withColumn("segment", F.explode(F.when((F.col("n") + 1) % segment == 0, F.array(place, place + 1)).otherwise(F.array(place))))
    own = place == F.col("segment")
    rows_of = F.sort_array(F.collect_list(F.when(own, F.struct("n", "initial", "fault"))))
    parts = shown.groupBy("conv_id", "segment").agg(rows_of.alias("rows"), F.min(F.when(~own, F.col("initial"))).alias("before"))
    parts = materialize(parts.where(F.size("rows") > 0).withColumn("cells", _cells(F.col("rows"))))
    bounds = materialize(parts.groupBy("conv_id").agg(F.min("segment").alias("first"), F.max("segment").alias("last")).where("first < last"))
    bounds = bounds.withColumnRenamed("conv_id", "at_id")
    narrow = parts.select("conv_id", "segment", "cells").join(bounds.hint("merge"), F.col("conv_id").eqNullSafe(F.col("at_id"))).drop("at_id")
    lists = lambda made: pa.array(made, pa.list_(pa.int64()))
    longs = T.ArrayType(T.LongType())
    matrices = annotate(narrow, ["cells"], [("v", longs)], lambda cells: [lists([costs(c) for c in cells.to_pylist()])], ["conv_id", "segment", "first"])
    matrices = materialize(matrices.select("row.conv_id", (F.col("row.segment") - F.col("row.first")).alias("i"), "row.segment", "res.v"))
    ends = scan(matrices.select("conv_id", "i", "v"), times, _to_end, END, True, fan)
    numbered = lambda found, name: found.join(bounds.hint("merge"), F.col("conv_id").eqNullSafe(F.col("at_id"))).select("at_id", (F.col("first") + F.col("i")).alias("at"), F.col("state").alias(name), (F.col("first") + F.col("i") == F.col("last")).alias("closes"))
    here = F.col("conv_id").eqNullSafe(F.col("at_id")) & (F.col("segment") == F.col("at"))
    ends = materialize(numbered(ends, "end"))
    priced = parts.join(ends.hint("merge"), here, "left").drop("at_id", "at")

    def solve(cells: pa.Array, end: pa.Array) -> list[pa.Array]:
        audits, afters = [], []
        for c, e in zip(cells.to_pylist(), end.to_pylist()):
            arcs = lattice(c, e or END)
            prices, found = [0] * len(arcs), []
            for before in range(4 if e else 1):
                auction(arcs, before, prices)
                found.append(trace(arcs, before, prices))
            audits.append([a for a, _ in found])
            afters.append([s for _, s in found])
        return [pa.array(audits, pa.list_(pa.string())), lists(afters)]

    kept = ["conv_id", "segment", "rows", "before", "closes"]
    traced = annotate(priced, ["cells", "end"], [("audits", T.ArrayType(T.StringType())), ("v", longs)], solve, kept)
    traced = materialize(traced.select("row.*", "res.*"))
    many = traced.where(F.col("closes").isNotNull()).select("conv_id", "segment", "v").join(bounds.hint("merge"), F.col("conv_id").eqNullSafe(F.col("at_id")))
    many = materialize(many.select("conv_id", (F.col("segment") - F.col("first")).alias("i"), "v"))
    states = scan(many, lambda v, w: [w[s] for s in v], lambda v, state: [v[state[0]]], [START], False, fan)
    states = materialize(numbered(states, "state").drop("closes"))
    placed = traced.join(states.hint("merge"), here, "left").drop("at_id", "at")

    # texts meet the plans of their segments in one aggregation
    plan = F.struct("audits", "v", "closes", "state", F.transform("rows", lambda r: r["fault"].cast("long")).alias("faults"), F.transform("rows", lambda r: r["initial"]).alias("initials"), "before")
    plans = placed.select("conv_id", "segment", plan.alias("plan"))
    row = F.struct("n", F.col("turn").cast("long").alias("turn"), "role", "text")
    texts = ordered.select("conv_id", place.alias("segment"), row.alias("row"))
    every = texts.unionByName(plans, allowMissingColumns=True).groupBy("conv_id", "segment")
    every = every.agg(F.sort_array(F.collect_list("row")).alias("rows"), F.first("plan", ignorenulls=True).alias("plan"))

    def edit(rows: pa.Array, plans: pa.Array) -> list[pa.Array]:
        edits, faults, initials = [], [], []
        for r, p in zip(rows.to_pylist(), plans.to_pylist()):
            s = p["state"][0] if p["state"] else START
            edits.append(apply_edits(r, p["audits"][s] + ("" if p["closes"] is False else TAIL[p["v"][s]]), s))
            faults.append(p["faults"])
            initials.append(([] if p["before"] is None else [p["before"]]) + p["initials"])
        return [pa.array(edits, pa.list_(pa.struct(EDIT))), lists(faults), pa.array(initials, pa.list_(pa.string()))]

    struct = T.StructType([T.StructField(n, T.LongType() if n == "turn" else T.StringType()) for n, _ in EDIT])
    fields = [("edits", T.ArrayType(struct)), ("faults", longs), ("initials", T.ArrayType(T.StringType()))]
    made = annotate(every, ["rows", "plan"], fields, edit, ["conv_id", "segment"])
    out = materialize(made.select("row.*", "res.*"))
    release(parts, matrices, ends, traced, many, states)
    return out


SUMMARY = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def summarize(repaired: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation.

    Segments are sorted by conversation and pass through one by one; a conversation's digest is a chain over its text, so
    its segments meet in one task, which holds its audit but never its texts.
    """
    kind = repaired.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind), *[T.StructField(c, T.LongType()) for c in SUMMARY], T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                for r in batch.slice(start, 256).to_pylist():
                    if now is None or now.conv_id != r["conv_id"]:
                        out += [] if now is None else [now.row()]
                        now = Running(r["conv_id"])
                    now.add(r)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.row()], schema=arrow)

    arrow = to_arrow_schema(schema)
    return repaired.repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(run, schema)


class Running:
    """What is known of a conversation after some of its segments."""

    def __init__(self, conv_id):
        self.conv_id, self.n, self.audit, self.digest, self.lines = conv_id, dict.fromkeys(SUMMARY, 0), [], hashlib.sha256(), 0
        self.turns, self.distinct = None, 0

    def add(self, r: dict) -> None:
        for fault in r["faults"]:
            if fault:
                self.n[FAULTS[fault]] += 1
        self.n["illegal"] += sum(a + b not in LEGAL for a, b in zip(r["initials"], r["initials"][1:]))
        faults = iter(r["faults"])
        for e in r["edits"]:
            label = e["edit"]
            truncated = label != "I" and next(faults) == 3
            self.n["cost"] += {"K": 0, "R": REROLE, "I": INSERT, "D": DELETE}[label] + TRUNCATED * (truncated and label != "D")
            if label != "I" and e["turn"] is not None:
                lo, hi = self.turns or (e["turn"], None)
                self.distinct += e["turn"] != hi
                self.turns = lo, e["turn"]
            if label != "D":
                self.digest.update((("\n" if self.lines else "") + f"{e['role']}:{e['text']}").encode())
                self.lines += 1
        self.audit.append("".join(e["edit"] for e in r["edits"]))

    def row(self) -> dict:
        if self.turns:
            self.n["gaps"] = min(self.turns[1] - self.turns[0] + 1 - self.distinct, (1 << 63) - 1)
        return {"conv_id": self.conv_id, **self.n, "audit": "".join(self.audit), "repaired_sha256": self.digest.hexdigest()}


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with rows dropped, emptied, cut, repeated and given to the user, by a checksum of (conv_id, turn)."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    chance = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.when(chance == 1, "").when(chance == 2, F.regexp_replace(part("text"), "[.!?]", "")).otherwise(part("text"))
    role = F.when(chance == 4, "user").otherwise(part("role"))
    copies = F.explode(F.when(chance == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return conversations.where(chance != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """The summary of each conversation after damage; one whose rows are all dropped has zeros, no edits and an empty digest."""
    repaired = repair_conversations(damage(conversations))
    found = summarize(repaired).withColumnRenamed("conv_id", "at_id")
    every = conversations.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("at_id")), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in SUMMARY]
    return every.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
