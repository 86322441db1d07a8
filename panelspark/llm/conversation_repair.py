"""Conversation structure repair by lightest derivations.

A conversation is mended by edits, from left to right: keep, re-role or delete a row, insert an empty turn.
Repairs are deductions of a weighted hypergraph. An item [i, q] says that the first i rows are dealt with and the
roles written so far have brought the pattern to state q; the rules are

    [i, q], row i  |-  [i + 1, q']     keep, re-role or delete the row
    [i, q]         |-  [i, q']         insert a turn
    [n, q]         |-  goal            where q may end a conversation

A weight is (cost, audit), audit being the edits' initials in order. Every rule adds to the cost, or keeps it
and makes the audit longer, so its value is never below that of its antecedent; and it keeps the order of
weights of one item: two audits of equal cost for one item cannot be a prefix of each other, as the rest would be
inserts, which cost. The rules are thus monotone superior functions, and Knuth's agenda finalises each item with its
lightest derivation when it is popped; the goal's is the cheapest repair, the ASCII-least of equals.

Conversations of at most LONG rows are streamed, sorted, through the tasks. A longer one never meets in one
task: its rows lie in order in blocks of LONG rows over many tasks, each block is solved from every state
to every state, and the blocks are rows of the same deduction: [b, q], block b  |-  [b + 1, q']. Only its audit and
the running SHA-256 of its repaired text, both results of a single value, pass one task, as a stream.
"""
from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Hashable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from panelspark.session import cut_lineage

LONG = 4096                     # rows of a block, a power of two; longer conversations are repaired by blocks
BROADCAST_ROWS = 1_000_000      # ids of long conversations that are sent to every executor
_OUT_ROWS, _OUT_CHARS = 1000, 1 << 24     # results of one Arrow batch, whichever comes first

# What an edit costs. An undeleted truncated row costs one more.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

# Roles' initials match (s?(ua)+)?: states are 0 nothing yet, 1 after the system turn, 2 question open, 3 answered.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FINAL = (0, 3)
LEGAL = ("su", "ua", "au")
SPACE = " \t\n\x0b\x0c\r"

_TURNS = "turns array<struct<role:string,text:string>>"
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
_VERDICT = "conv_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", cost long, audit string"

Weight = tuple[int, str]
Row = tuple[str, str]           # role's initial and fault: "" sound, "t" truncated, "d" to be deleted


def lightest(axioms: Iterable[tuple[Hashable, Weight]], deduce: Callable[[Hashable, Weight], Iterable[tuple[Hashable, Weight]]],
             goal: Hashable = None) -> dict[Hashable, tuple[Weight, Hashable]]:
    """Knuth's agenda: item -> (lightest weight, antecedent), until the goal is final or no item is left.

    deduce gives the items that follow from a final one. Items must be comparable.
    """
    agenda = [(weight, item, item) for item, weight in axioms]
    heapq.heapify(agenda)
    final: dict[Hashable, tuple[Weight, Hashable]] = {}
    while agenda:
        weight, item, source = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = (weight, source)
        if item == goal:
            break
        for head, value in deduce(item, weight):
            if head not in final:
                heapq.heappush(agenda, (value, head, item))
    return final


def _rules(rows: list[Row]) -> Callable:
    n = len(rows)

    def deduce(item, weight):
        (i, q), (cost, audit) = item, weight
        if i > n:
            return
        for role in "ua":
            if (q, role) in NEXT:
                yield (i, NEXT[q, role]), (cost + INSERT, audit + "I")
        if i == n:
            if q in FINAL:
                yield (n + 1, 0), weight
            return
        initial, fault = rows[i]
        yield (i + 1, q), (cost + DELETE, audit + "D")
        if fault != "d":
            more = cost + (TRUNCATED if fault == "t" else 0)
            if (q, initial) in NEXT:
                yield (i + 1, NEXT[q, initial]), (more, audit + "K")
            for role in "ua":
                if (q, role) in NEXT:
                    yield (i + 1, NEXT[q, role]), (more + REROLE, audit + "R")
    return deduce


def cheapest(rows: list[Row]) -> Weight:
    """(cost, audit) of the cheapest repair of a conversation."""
    goal = (len(rows) + 1, 0)
    return lightest([((0, 0), (0, ""))], _rules(rows), goal)[goal][0]


def ways(rows: list[Row], start: int) -> list[tuple[int, int, str]]:
    """(state, cost, audit): the cheapest way over a block's rows from a state to every state."""
    final = lightest([((0, start), (0, ""))], _rules(rows))
    return [(q, *weight) for (i, q), (weight, _) in final.items() if i == len(rows)]


def written(rows: list[tuple[str, str]], audit: str, state: int = 0) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns that the edits of an audit leave, from a state on."""
    at = 0
    for edit in audit:
        due = "assistant" if state == 2 else "user"
        if edit == "I":
            yield due, ""
            state = NEXT[state, due[0]]
            continue
        if edit != "D":
            role = due if edit == "R" else rows[at][0]
            yield role, rows[at][1]
            state = NEXT[state, role[0]]
        at += 1


def fault_of(text: str) -> str:
    """b: blank, t: truncated, else empty."""
    end = text.rstrip(SPACE)
    return "b" if not end else "" if end[-1] in ".!?" else "t"


def _examine(turns: list, texts: list[tuple[str, str]]) -> tuple[list[int], list[Row]]:
    """The counts of a whole conversation and its rows as the agenda sees them."""
    known = [t for t in turns if t is not None]
    seen: set[tuple[str, str]] = set()
    rows, counts = [], {"b": 0, "d": 0, "t": 0, "": 0}
    for row in texts:
        fault = fault_of(row[1])
        if fault != "b" and row in seen:
            fault = "d"
        seen.add(row)
        counts[fault] += 1
        rows.append((row[0][:1], "d" if fault in ("b", "d") else fault))
    illegal = sum(a[0] + b[0] not in LEGAL for a, b in zip(rows, rows[1:]))
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return [gaps, counts["b"], counts["d"], counts["t"], illegal], rows


def _repair_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv_id, turn, role, text) to a row per conversation."""
    types = [pa.int64()] * 7 + [pa.string(), pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))]
    names = ["conv_id", *_COUNTS, "cost", "audit", "turns"]
    out: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
        out.clear()
        return made

    def solve(conv, turns, texts) -> None:
        counts, rows = _examine(turns, texts)
        cost, audit = cheapest(rows)
        out.append((conv, *counts, cost, audit, [{"role": r, "text": t} for r, t in written(texts, audit)]))

    conv, turns, texts, open_ = None, [], [], False
    for rows in batches:
        for c, turn, role, text in zip(*(column.to_pylist() for column in rows.columns)):
            if open_ and c != conv:
                solve(conv, turns, texts)
                size += sum(len(t) for _, t in texts)
                turns, texts = [], []
                if len(out) == _OUT_ROWS or size > _OUT_CHARS:
                    yield batch()
                    size = 0
            conv, open_ = c, True
            if role is not None:          # else the row only stands for its conversation
                turns.append(turn)
                texts.append((role, text))
    if open_:
        solve(conv, turns, texts)
    if out:
        yield batch()


def _given(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: null roles and texts read as one space unless both are null."""
    some = F.col("role").isNotNull() | F.col("text").isNotNull()
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(some, F.coalesce("role", F.lit(" "))).alias("role"),
                       F.when(some, F.coalesce("text", F.lit(" "))).alias("text"))


# ---- conversations of more rows than a task should hold ----

_BLOCK = ("conv_id long, block long, first long, last long, turns long, role_in string, role_out string, illegal long, "
          "blank long, duplicate long, truncated long, ways array<struct<start:int,state:int,cost:long,audit:string>>")


def _solve_block(part: pa.Table) -> pa.Table:
    """A block's counts and its cheapest ways from every state to every state."""
    part = part.sort_by("at")
    turns, rows = part["turn"].to_pylist(), list(zip(part["initial"].to_pylist(), part["fault"].to_pylist()))
    known = [t for t in turns if t is not None]
    seen = [(i, "d" if f in ("b", "d") else f) for i, f in rows]
    out = {"conv_id": part["conv_id"][0].as_py(), "block": part["block"][0].as_py(), "first": known[0] if known else None,
           "last": known[-1] if known else None, "turns": len(set(known)), "role_in": rows[0][0], "role_out": rows[-1][0],
           "illegal": sum(a[0] + b[0] not in LEGAL for a, b in zip(rows, rows[1:])),
           **{name: sum(f == name[0] for _, f in rows) for name in ("blank", "duplicate", "truncated")},
           "ways": [{"start": q, "state": r, "cost": c, "audit": a} for q in range(4) for r, c, a in ways(seen, q)]}
    way = pa.struct([("start", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
    text = ("role_in", "role_out")
    return pa.Table.from_pydict({k: pa.array([v], pa.list_(way) if k == "ways" else pa.string() if k in text else pa.int64())
                                 for k, v in out.items()})


def _chain_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by (conv_id, block) to rows per conversation (block null) and per block (its entry and exit state)."""
    names = ["conv_id", "block", "entry", "exit", *_COUNTS, "cost", "audit"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 6, pa.string()]

    def finish(state) -> pa.RecordBatch:
        conv, low, high, distinct, _, _, totals, final, back = state
        cost, audit = min(final[q] for q in FINAL if q in final)
        q = min((final[q], q) for q in FINAL if q in final)[1]
        gaps = 0 if low is None else high - low + 1 - distinct
        rows = [(conv, None, None, None, gaps, *totals, cost, audit)]
        for block, sources in reversed(back):
            rows.append((conv, block, sources[q], q, *[None] * 7))
            q = sources[q]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    state = None
    for batch in batches:
        for row in batch.to_pylist():
            if state is not None and row["conv_id"] != state[0]:
                yield finish(state)
                state = None
            if state is None:
                state = (row["conv_id"], None, None, 0, None, None, [0, 0, 0, 0], {0: (0, "")}, [])
            conv, low, high, distinct, last, role, totals, final, back = state
            edges: dict[int, list] = {}
            for way in row["ways"]:
                edges.setdefault(way["start"], []).append((way["state"], way["cost"], way["audit"]))

            def deduce(item, weight):
                if item[0] == 0:
                    for r, cost, audit in edges.get(item[1], []):
                        yield (1, r), (weight[0] + cost, weight[1] + audit)

            done = lightest([((0, q), w) for q, w in final.items()], deduce)
            back.append((row["block"], {q: source[1] for (i, q), (_, source) in done.items() if i}))
            totals = [a + row[k] for a, k in zip(totals, ("blank", "duplicate", "truncated", "illegal"))]
            totals[3] += role is not None and role + row["role_in"] not in LEGAL
            if row["turns"]:
                distinct += row["turns"] - (last is not None and last == row["first"])
                low, high, last = row["first"] if low is None else low, row["last"], row["last"]
            state = (conv, low, high, distinct, last, row["role_out"], totals,
                     {q: w for (i, q), (w, _) in done.items() if i}, back)
    if state is not None:
        yield finish(state)


def _write_block(part: pa.Table) -> pa.Table:
    """The turns that a block's edits leave."""
    part = part.sort_by("at")
    texts = list(zip(part["role"].to_pylist(), part["text"].to_pylist()))
    conv, block = part["conv_id"][0].as_py(), part["block"][0].as_py()
    # A block leaves at most a turn per row and an insert before each and at its end.
    turns = written(texts, part["piece"][0].as_py(), part["entry"][0].as_py())
    made = [(conv, block * 4 * LONG + k, *turn) for k, turn in enumerate(turns)]
    columns = list(zip(*made)) or [[], [], [], []]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["conv_id", "position", "role", "text"])


def _hash_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running digest of sorted turns (conv_id, position, role, text)."""
    def result(conv, digest):
        return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([digest.hexdigest()])], names=["conv_id", "repaired_sha256"])

    conv, digest = None, None
    for batch in batches:
        for c, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text"))):
            if digest is not None and c != conv:
                yield result(conv, digest)
                digest = None
            digest, new = (hashlib.sha256(), True) if digest is None else (digest, False)
            digest.update(("" if new else "\n").encode() + f"{role}:{text}".encode())
            conv = c
    if digest is not None:
        yield result(conv, digest)


def _repair_long(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verdicts with repaired_sha256, and turns (conv_id, position, role, text), of conversations of any length."""
    order = ["conv_id", "turn", "role"]
    placed = rows.where("role is not null").repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")
    # Written, as the ranges are cut anew on every run: "at" is the order of all rows.
    placed = cut_lineage(placed.withColumn("at", F.monotonically_increasing_id()).withColumn("block", F.expr(f"at div {LONG}")))
    digest = F.sha2("text", 256)
    first = placed.groupBy("conv_id", "role", digest.alias("d")).agg(F.min("at").alias("at")).select("at", F.lit(True).alias("new"))
    solid = F.regexp_replace("text", r"[\x20\x09-\x0D]+$", "")
    fault = F.when(solid == "", "b").when(F.col("new").isNull(), "d").when(F.substring(solid, -1, 1).isin(".", "!", "?"), "").otherwise("t")
    blocks = placed.join(first.hint("merge"), "at", "left").select(
        "conv_id", "block", "at", "turn", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))
    solved = cut_lineage(blocks.groupBy("conv_id", "block").applyInArrow(_solve_block, _BLOCK))
    chained = cut_lineage(solved.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(
        _chain_blocks, "conv_id long, block long, entry int, exit int, " + ", ".join(f"{c} long" for c in _COUNTS) + ", cost long, audit string"))
    pieces = solved.select("conv_id", "block", F.explode("ways").alias("w")).select(
        F.col("conv_id").alias("c"), F.col("block").alias("b"), F.col("w.start").alias("s"), F.col("w.state").alias("r"), F.col("w.audit").alias("piece"))
    chosen = chained.where("block is not null").join(
        pieces, (F.col("c").eqNullSafe(F.col("conv_id"))) & F.expr("b = block and s = entry and r = exit")).select(
            F.col("c"), F.col("b"), "entry", "piece")
    turns = placed.join(chosen, F.col("c").eqNullSafe(F.col("conv_id")) & F.expr("b = block")).select(
        "conv_id", "block", "at", "role", "text", "entry", "piece").groupBy("conv_id", "block").applyInArrow(
            _write_block, "conv_id long, position long, role string, text string")
    turns = cut_lineage(turns)
    hashed = turns.repartition("conv_id").sortWithinPartitions("conv_id", "position").mapInArrow(
        _hash_turns, "conv_id long, repaired_sha256 string").withColumnRenamed("conv_id", "c")
    verdict = chained.where("block is null").join(hashed, F.col("c").eqNullSafe(F.col("conv_id")), "left").select(
        "conv_id", *_COUNTS, "cost", "audit", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
    return verdict, turns


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repairs conversations (conv_id, turn, role, text), rows in order of turn, nulls first, then role, then text.

    The first result has a row per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256 of its turns as role:text lines. The second holds the repaired turns: conv_id, position (rising
    with the turns, not always by one), role, text.

    Defined results: a null conv_id is a conversation like any other; a null role or text is one space; a row
    with neither is no turn but keeps its conversation in the result, which without turns has zeros, an empty
    audit and the hash of an empty text; equal rows are duplicates after the first; an empty role cannot be kept; an
    empty table gives empty tables. Other columns are not read.
    """
    rows = _given(rows)
    long_ids = cut_lineage(rows.groupBy(F.col("conv_id").alias("long_id")).agg(
        F.count("role").alias("n")).where(f"n > {LONG}").select("long_id", F.lit(True).alias("is_long")))
    count = long_ids.count()
    short = rows
    if count:
        same = rows["conv_id"].eqNullSafe(F.col("long_id"))
        ids = F.broadcast(long_ids) if count <= BROADCAST_ROWS else long_ids
        short = rows.join(ids, same, "left_anti")
    short = short.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(
        _repair_short, f"{_VERDICT}, {_TURNS}")
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    verdicts = short.select("conv_id", *_COUNTS, "cost", "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    turns = short.select("conv_id", F.posexplode("turns").alias("position", "t")).select(
        "conv_id", F.col("position").cast("long").alias("position"), "t.role", "t.text")
    if count:
        more, long_turns = _repair_long(rows.join(ids, same, "left_semi"))
        verdicts = verdicts.union(more)
        turns = turns.union(long_turns)
    return verdicts, turns


def damage(rows: DataFrame) -> DataFrame:
    """Conversations with planted faults, by crc32 of conv_id:turn modulo 20.

    0 drops a row (role, text and turn become null: what is left only stands for the conversation), 1 empties its text,
    2 removes its full stops, exclamation and question marks, 3 repeats it, 4 makes its role user. Nulls are one space.
    """
    def spaced(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    there = F.col("kind") != 0
    return rows.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind")).select(
        "conv_id", F.when(there, F.col("turn")).alias("turn"),
        F.when(there, F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))).alias("role"), F.when(there, text).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")
