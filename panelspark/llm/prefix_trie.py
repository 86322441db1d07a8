"""The prefix trie of conversations, from sorted neighbours.

A conversation is the sequence of its turns' digests. Sequences are sorted; neighbours are joined by edges whose depth is
their longest common prefix (LCP). Edges are taken in descending depth and their ends united (union-find): a
component is a range of sequences with a common prefix, and every merge of components makes a branching node
at the edge's depth. Nodes between two merges have one child each.

Sequences lie sorted over many tasks, in blocks. A block closes all nodes but those on the paths of its first and last
sequence, which other blocks may share. Its forest is contracted to these two paths: at every
depth they carry what was closed below (members, smallest id, children, leaves, savings). The paths of all
blocks, still sorted, are the sequences of the next round, which merges them across the boundaries of blocks the same
way; a round leaves two rows of BLOCK at most, and when BLOCK or fewer are left everything is closed.

Texts are only read to be hashed and counted where they lie. Equal conversations are one sequence before the sort. The
digest of a node's ids is a running SHA-256 over its sorted members: of one node it passes one task, as a stream.
A conversation's turns are held as 16 bytes each in one row.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelspark.session import cut_lineage

BLOCK = 10_000                  # sequences of which one task builds a forest at once; far above the two it leaves
BROADCAST_ROWS = 500_000        # boundary nodes, of about 40 bytes, that are sent to every executor
WIDTH = 16                      # bytes of a turn's digest
EMPTY = hashlib.sha256(b"").hexdigest()

_CARRIED = ("ns", "lows", "kids", "leaves", "saved")
_PATH = "seq binary, lens array<long>, " + ", ".join(f"{c} array<long>" for c in _CARRIED) + ", ends array<string>"
_NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
         "ends_sha256 string, key binary, parent_key binary")
_OUT = f"{_NODE}, part int, at long, {_PATH}"
_NODE_NAMES = [c.split()[0] for c in _NODE.split(", ")]


def common_prefix(a: bytes, b: bytes) -> int:
    """Number of leading turns that two sequences share, by bisection over slices."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * WIDTH:mid * WIDTH] == b[low * WIDTH:mid * WIDTH]:
            low = mid
        else:
            high = mid - 1
    return low


def _keys(seq: bytes) -> list[bytes]:
    """A digest of every prefix of a sequence, the empty one first."""
    keys = [b"\0" * WIDTH]
    for d in range(0, len(seq), WIDTH):
        keys.append(hashlib.blake2b(keys[-1] + seq[d:d + WIDTH], digest_size=WIDTH).digest())
    return keys


class _Component:
    """Sequences with a common prefix, and the node at its end (depth) as far as it is known."""

    __slots__ = ("row", "depth", "n", "low", "kids", "leaves", "saved", "ends", "waiting", "below", "side")

    def __init__(self, row: int, depth: int, below: list | None, side: str | None):
        self.row, self.depth, self.below, self.side = row, depth, below, side
        self.clear()

    def clear(self) -> None:
        self.n, self.low, self.kids, self.leaves, self.saved, self.ends, self.waiting = 0, None, 0, 0, 0, None, []

    def add(self, n: int, low: int | None, kids: int, leaves: int, saved: int, ends: str | None) -> None:
        self.n, self.kids, self.leaves, self.saved = self.n + n, self.kids + kids, self.leaves + leaves, self.saved + saved
        self.low = low if self.low is None else self.low if low is None else min(self.low, low)
        self.ends = ends if self.ends is None else self.ends

    def carried(self) -> tuple:
        return self.n, self.low, self.kids, self.leaves, self.saved, self.ends


class Forest:
    """The forest of one block of sorted, distinct sequences.

    rows: (seq, lens, carried), carried being None or a (n, low, kids, leaves, saved, ends) per depth from 0. nodes gets a
    list per closed node, in the order of _NODE. paths gets the contracted rows, none if whole.
    """

    def __init__(self, rows: list[tuple[bytes, list[int], list[tuple]]], whole: bool, keyed: bool):
        self.rows, self.whole, self.keyed = rows, whole, keyed
        self.nodes: list[list] = []
        last = len(rows) - 1
        sides = [None if whole else "first" if i == 0 else "last" if i == last else None for i in range(len(rows))]
        self.kept: dict[str, list] = {s: [None] * (len(rows[i][0]) // WIDTH + 1) for i, s in enumerate(sides) if s}
        self.chains = {s: _keys(rows[i][0]) for i, s in enumerate(sides) if s}
        parts = []
        for i, (seq, _, carried) in enumerate(rows):
            depth = len(seq) // WIDTH
            part = _Component(i, depth, carried[:-1] if any(x is not None for x in carried[:-1]) else None, sides[i])
            if carried[-1] is not None:
                part.add(*carried[-1])
            parts.append(part)
        self._row_keys: dict[int, list[bytes]] = {}
        edges = sorted((-common_prefix(rows[i][0], rows[i + 1][0]), i) for i in range(last))
        root = list(range(len(rows)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for depth, i in edges:
            a, b = find(i), find(i + 1)
            self._raise(parts[a], -depth)
            self._raise(parts[b], -depth)
            self._unite(parts[a], parts[b])
            root[b] = a
            parts[b] = None
        top = parts[find(0)]
        self._raise(top, 0)
        self._close(top)

    def _unite(self, a: _Component, b: _Component) -> None:
        """b's node is a's node: both stand at the depth of the edge between them."""
        a.add(*b.carried())
        a.waiting += b.waiting
        if b.below is not None:
            a.below = b.below if a.below is None else [self._sum(x, y) for x, y in zip(a.below, b.below)]
        if a.side is None:
            a.side, a.row = b.side, b.row if b.side else a.row

    @staticmethod
    def _sum(x: tuple | None, y: tuple | None) -> tuple | None:
        if x is None or y is None:
            return x if y is None else y
        both = _Component(0, 0, None, None)
        both.add(*x)
        both.add(*y)
        return both.carried()

    def _close(self, part: _Component) -> int | None:
        """Writes the node of a component, or keeps it for later rounds where it lies on an outer path."""
        d = part.depth
        if part.side:
            self.kept[part.side][d] = part.carried()
            for node in part.waiting:
                self.nodes[node][9] = self.chains[part.side][d]
            return None
        seq, lens, _ = self.rows[part.row]
        if part.kids == 0:
            part.leaves = 1
        if d:
            part.saved += (part.n - 1) * lens[d - 1]
        for node in part.waiting:
            self.nodes[node][2] = part.low
        key = None
        if self.keyed:
            if part.row not in self._row_keys:
                self._row_keys[part.row] = _keys(seq)
            key = self._row_keys[part.row][d]
        self.nodes.append([part.low, d, None, part.n, part.kids, part.leaves, part.saved, part.ends, key, None])
        return len(self.nodes) - 1

    def _raise(self, part: _Component, depth: int) -> None:
        """Closes the component's nodes down to a depth, at which it stands then."""
        while part.depth > depth:
            node = self._close(part)
            n, low, leaves, saved = part.n, part.low, part.leaves, part.saved
            part.clear()
            part.depth -= 1
            if node is not None:
                part.add(n, low, 1, leaves, saved, None)
                part.waiting = [node]
            if part.below is not None:
                carried = part.below.pop()
                if carried is not None:
                    part.add(*carried)

    def paths(self) -> Iterator[tuple[bytes, list[int], list[tuple | None]]]:
        for side, row in (("first", 0), ("last", len(self.rows) - 1)):
            if side in self.kept:
                yield self.rows[row][0], self.rows[row][1], self.kept[side]


def _forests(whole: bool, first_round: bool, block: int):
    """Sorted rows of one range of sequences to closed nodes and contracted paths, block by block."""
    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for row in batch.to_pylist():
                if first_round:
                    n = len(row["seq"]) // WIDTH
                    carried = [None] * n + [(row["n"], row["low"], 0, 0, 0, row["sha"])]
                else:
                    carried = [t if t[0] is not None else None for t in zip(*(row[c] for c in _CARRIED), row["ends"])]
                yield row["part"], (row["seq"], row["lens"], carried)

    longs, long = pa.list_(pa.int64()), pa.int64()
    types = [long] * 7 + [pa.string(), pa.binary(), pa.binary(), pa.int32(), long, pa.binary(), longs, *[longs] * 5, pa.list_(pa.string())]
    names = [*_NODE_NAMES, "part", "at", "seq", "lens", *_CARRIED, "ends"]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def build(rows: list, part: int, at: int) -> Iterator[pa.RecordBatch]:
        forest = Forest(rows, whole, not first_round)
        blank = (None,) * (len(names) - len(_NODE_NAMES))
        for i in range(0, len(forest.nodes), 10_000):
            yield batch([(*node, *blank) for node in forest.nodes[i:i + 10_000]])
        paths = []
        for k, (seq, lens, kept) in enumerate(forest.paths()):
            columns = list(zip(*[t if t is not None else (None,) * 6 for t in kept]))
            paths.append(((None,) * len(_NODE_NAMES)) + (part, at + k, seq, lens, *map(list, columns)))
        if paths:
            yield batch(paths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part, at = [], None, 0
        for part, row in rows_of(batches):
            held.append(row)
            if len(held) == block and not whole:
                yield from build(held, part, at)
                held, at = [], at + 2
        if held:
            yield from build(held, part, at)
    return run


def _members(rebuilt: DataFrame) -> DataFrame:
    """(seq, lens, n, low, sha) of every distinct sequence, from (conv_id, seq, lens)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["seq", "lens", "n", "low", "sha"]
        types = [pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string()]
        seq, lens, n, low, digest, out = None, None, 0, None, None, []
        for batch in batches:
            ids, seqs, all_lens = (batch.column(c) for c in ("conv_id", "seq", "lens"))
            for i, (conv, s) in enumerate(zip(ids.to_pylist(), seqs.to_pylist())):
                if s != seq:
                    if seq is not None:
                        out.append((seq, lens, n, low, digest.hexdigest()))
                    seq, lens, n, low, digest = s, all_lens[i].as_py(), 0, conv, hashlib.sha256()
                digest.update(("," if n else "").encode() + str(conv).encode())
                n += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                out = []
        if seq is not None:
            out.append((seq, lens, n, low, digest.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    # The whole sequence is the key: a fingerprint of it is all that is compared for most.
    keyed = rebuilt.withColumn("class", F.xxhash64("seq"))
    return keyed.repartition("class").sortWithinPartitions("class", "seq", "conv_id").mapInArrow(
        run, "seq binary, lens array<long>, n long, low long, sha string")


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """The nodes of the trie of sequences (conv_id, seq, lens): seq has WIDTH bytes per turn, lens the turns' lengths.

    Per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256. An empty table has no nodes, otherwise the root is one.
    """
    classes = _members(sequences).repartitionByRange("seq").sortWithinPartitions("seq").withColumn("part", F.spark_partition_id())
    built, left, first_round = [], None, True
    while True:
        if first_round:
            rows = classes
        elif left > BLOCK:
            rows = paths.repartitionByRange(-(-left // BLOCK), "part", "at").sortWithinPartitions("part", "at").drop("at").withColumn(
                "part", F.spark_partition_id())
        else:
            rows = paths.coalesce(1).sortWithinPartitions("part", "at").drop("at")
        whole = not first_round and left <= BLOCK
        made = cut_lineage(rows.mapInArrow(_forests(whole, first_round, BLOCK), _OUT))
        built.append(made.where("depth is not null").select(*_NODE_NAMES))
        if whole:
            break
        paths = made.where("seq is not null").select("part", "at", *[c.split()[0] for c in _PATH.split(", ")])
        left, first_round = paths.count(), False
        if left == 0:
            break
    nodes = built[0]
    for more in built[1:]:
        nodes = nodes.union(more)
    # Parents that were open when their children closed; the root, parent of any number of them, needs no join.
    open_ = nodes.where("key is not null").select(F.col("key").alias("k"), F.col("conv_id").alias("p"), F.col("depth").alias("d"))
    top = open_.where("d = 0").first()
    known = nodes.where("parent_key is null or depth = 1")
    parent = F.when(F.col("depth") == 1, F.lit(top.p if top else None).cast("long")).otherwise(F.col("parent_conv_id"))
    waiting = nodes.where("parent_key is not null and depth > 1")
    few = open_.count() <= BROADCAST_ROWS
    joined = waiting.join(F.broadcast(open_) if few else open_, F.col("k") == F.col("parent_key"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return known.withColumn("parent_conv_id", parent).select(*columns).union(
        joined.withColumn("parent_conv_id", F.col("p")).select(*columns)).withColumn(
            "ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))


def sequences(rows: DataFrame) -> DataFrame:
    """conv_id and turns, an array of (digest, chars) in order of turn (null first), then of role and the text's digest.

    A null role or text is empty. Rows without a conv_id belong to no conversation and are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH)
    each = rows.where("conv_id is not null").select("conv_id", F.struct(
        F.col("turn").cast("long").alias("turn"), role.alias("role"), digest.alias("digest"), F.length(text).cast("long").alias("chars")).alias("t"))
    # Nulls of a field come first.
    ordered = each.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    return ordered.select("conv_id", F.transform("turns", lambda t: F.struct(
        t["digest"].alias("digest"), t["chars"].alias("chars"))).alias("turns"))


def rebuild(rows: DataFrame, family: int = 100, most: int = 6) -> DataFrame:
    """(conv_id, seq, lens): conversations that begin like the first one of their family.

    h = crc32(conv_id) % most turns come from conversation c - c % family (all it has if fewer, none if it is absent), then c's
    own turns follow after its first h.
    """
    own = cut_lineage(sequences(rows))
    first = own.where(f"conv_id % {family} = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    each = own.withColumn("base", F.expr(f"conv_id - conv_id % {family}")).withColumn(
        "h", (F.crc32(F.col("conv_id").cast("string")) % most).cast("int"))
    joined = each.join(first, "base", "left")
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    tail = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    turns = joined.select("conv_id", F.concat(head, tail).alias("t"))
    return turns.select("conv_id", F.unhex(F.array_join(F.transform("t", lambda t: t["digest"]), "")).alias("seq"),
                        F.transform("t", lambda t: t["chars"]).alias("lens"))


def conversation_trie(rows: DataFrame) -> DataFrame:
    """prefix_trie of the rebuilt conversations of a table (conv_id, turn, role, text).

    Defined results: a null role or text is empty; rows of one turn are ordered by role, then by the text's
    digest; equal rows are turns of their own; rows without a conv_id are left out; conversations without turns are
    members of the root; an empty table gives an empty table. Other columns are not read.
    """
    return prefix_trie(rebuild(rows))
