"""Conversation prefix trie (operator 13): double-array tries over shards of prefixes.

1. *Paths.* A turn becomes 20 bytes: the MD5 of its role and text, and its text's length. The
   turns of a conversation in order are its path; a prefix of the conversation is a prefix of it.
2. *Shards.* Paths are dealt by range and sorted, so each shard is a stretch of the trie, however
   many conversations share a beginning or are copies; ids break ties, so copies spread as well.
3. *Double arrays.* Per shard the turns get dense ids in order of their first appearance, level by
   level, and the nodes are packed: the child of node s by turn t lies at ``BASE[s] + t`` and
   ``CHECK`` there names s. All paths then walk the arrays and leave counts at the nodes they pass.
4. *Shared nodes.* Only nodes on a shard's first and last path can lie in another shard too. Their
   counts are added per prefix. A node that goes on over an edge between shards was counted on both
   sides; the two paths at the edge say which nodes these are, and a correction for each joins the
   sum. Children of shared nodes then learn their parent's smallest member.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabletidy.llm.common import reachable, staged

UNIT = 20
#: Turns and conversations of a shard (one longer conversation is a shard of its own).
SHARD = 1 << 18
NODE, CHILD, SHARED, ENDS, EDGE = range(5)
NO_ENDS = hashlib.sha256(b"").hexdigest()
ROWS = pa.schema(
    [
        ("kind", pa.int8()), ("key", pa.binary()), ("parent_key", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()),
        ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
        ("saved_tokens", pa.int64()), ("ends", pa.string()), ("part", pa.int32()), ("first", pa.binary()), ("last", pa.binary()),
    ]
)
ROWS_SQL = (
    "kind tinyint, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long,"
    " n_leaves long, saved_tokens long, ends string, part int, first binary, last binary"
)
OUT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


# --- paths ---------------------------------------------------------------------------------


def turn_key(role: Column, text: Column) -> Column:
    """MD5 of a turn's role and text as hexadecimal digits."""
    return F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))


def paths(conversations: DataFrame, group: Column | None = None) -> DataFrame:
    """(conv_id, path) of every conversation, dealt by ``group`` (a function of conv_id).

    Turns stand in the order of ``turn``, null first, equal ones in the order of their MD5; null
    roles and texts are empty; repeated rows are turns of their own; rows without conv_id
    are no conversation's. One conversation's turns (36 bytes each) are one row.
    """
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where(conversations["conv_id"].isNotNull()).select(
        conversations["conv_id"].cast("long").alias("conv_id"),
        F.struct(conversations["turn"].alias("turn"), F.concat(turn_key(role, text), F.lpad(F.hex(F.octet_length(text)), 8, "0")).alias("unit")).alias("t"),
    )
    own = turns.withColumn("_group", F.col("conv_id") if group is None else group).repartition("_group").groupBy("_group", "conv_id")
    return own.agg(F.unhex(F.array_join(F.sort_array(F.collect_list("t")).getField("unit"), "")).alias("path"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, path) of the rebuilt conversations: c begins with the first h turns of conversation
    c - c % 5 (none if there is no such one), h = crc32 of its decimal id, % 9, and goes on with
    its own turns after its first h. Both are dealt by c - c % 5 from the start: one shuffle."""
    c, head = F.col("conv_id"), F.crc32(F.col("conv_id").cast("string")) % 9 * UNIT
    own = paths(conversations, c - c % 5)
    base = F.max(F.when(c == F.col("_group"), F.substring(F.col("path"), F.lit(1), F.lit(8 * UNIT)))).over(Window.partitionBy("_group"))
    parts = own.withColumns({"_base": base, "_head": head.cast("int")})
    begin = F.coalesce(F.expr("substring(_base, 1, _head)"), F.lit(b""))
    return parts.select("conv_id", F.concat(begin, F.expr("substring(path, _head + 1)")).alias("path"))


# --- double arrays -------------------------------------------------------------------------


class DoubleArray:
    """The trie of sorted sequences: ``codes`` of all of them in a row, ``starts`` and ``lengths`` of each."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        self.n_codes = int(codes.max(initial=0))
        self.base = np.zeros(2 * self.n_codes + 64, np.int64)
        self.check = np.full(len(self.base), -1, np.int64)
        self.check[0] = -2  # the root
        self.low = 1  # no slot below is free
        self.levels = [np.zeros(1, np.int64)]
        state = np.zeros(len(lengths), np.int64)
        active = np.flatnonzero(lengths > 0)
        while len(active):
            here, code = state[active], codes[starts[active] + len(self.levels) - 1]
            new = np.ones(len(active), bool)
            new[1:] = (here[1:] != here[:-1]) | (code[1:] != code[:-1])
            slots = self._place(here[new], code[new])
            self.levels.append(slots)
            state[active] = slots[np.cumsum(new) - 1]
            active = active[lengths[active] > len(self.levels) - 1]

    def _grow(self, need: int) -> None:
        if need >= len(self.check):
            more = max(need + 1, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def _free(self, most: int, start: int) -> np.ndarray:
        """The first ``most`` free slots from ``start`` on."""
        width = 2 * most + 64
        while True:
            self._grow(start + width)
            found = np.flatnonzero(self.check[start : start + width] == -1)
            if len(found) >= most:
                return found[:most] + start
            width *= 2

    def _place(self, parents: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Slots for the children (parent, code), which stand together by parent."""
        slots = np.empty(len(codes), np.int64)
        bounds = np.flatnonzero(np.r_[True, parents[1:] != parents[:-1], True])
        sizes = np.diff(bounds)
        for g in np.flatnonzero(sizes > 1):
            a, b = bounds[g], bounds[g + 1]
            base = self._base_of(codes[a:b])
            slots[a:b] = base + codes[a:b]
            self.base[parents[a]] = base
            self.check[slots[a:b]] = parents[a]
        single = bounds[:-1][sizes == 1]
        if len(single):  # any free slot will do
            free = self._free(len(single), self.low)
            slots[single] = free
            self.base[parents[single]] = free - codes[single]
            self.check[free] = parents[single]
            self.low = int(free[-1]) + 1
        return slots

    def _base_of(self, codes: np.ndarray) -> int:
        """The first base that puts all ``codes`` on free slots."""
        ahead = codes - codes.min()
        self.low = int(self._free(1, self.low)[0])
        start, many = self.low, 4
        while True:
            free = self._free(many, start)
            self._grow(int(free[-1] + ahead.max()))
            fits = np.ones(len(free), bool)
            for at in range(0, len(ahead), 4096):
                left = np.flatnonzero(fits)
                if not len(left):
                    break
                fits[left] = (self.check[free[left, None] + ahead[None, at : at + 4096]] == -1).all(axis=1)
            if fits.any():
                return int(free[fits.argmax()] - codes.min())
            start, many = int(free[-1]) + 1, min(2 * many, 256)

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """From each state by its turn: the child, or -1 if there is none."""
        to = self.base[state] + code
        good = (to > 0) & (to < len(self.check))
        return np.where(good & (self.check[np.where(good, to, 0)] == state), to, -1)


def dense(units: np.ndarray, rows: np.ndarray, depths: np.ndarray) -> np.ndarray:
    """Ids from 1 for equal units, in the order of their first appearance by depth, then row."""
    _, first, inverse = np.unique(units, return_index=True, return_inverse=True)
    del first
    order = np.lexsort((rows, depths))
    seen = np.full(inverse.max(initial=-1) + 1, len(units))
    np.minimum.at(seen, inverse[order], np.arange(len(units)))
    ids = np.empty(len(seen), np.int64)
    ids[np.argsort(seen)] = np.arange(1, len(seen) + 1)
    return ids[inverse]


def prefix_keys(path: bytes) -> list[bytes]:
    """The MD5 of every prefix of ``path`` by whole turns, the empty one first."""
    running = hashlib.md5()
    keys = [running.digest()]
    for at in range(0, len(path), UNIT):
        running.update(path[at : at + UNIT])
        keys.append(running.copy().digest())
    return keys


def _batches(columns: dict[str, list | np.ndarray], n: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``ROWS`` in batches; columns that are not named are null."""
    arrays = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in ROWS]
    whole = pa.RecordBatch.from_arrays(arrays, schema=ROWS)
    for at in range(0, n, 1 << 15):
        yield whole.slice(at, 1 << 15)


def edge(last: bytes, first: bytes) -> Iterator[pa.RecordBatch]:
    """What the nodes on both paths, neighbours over an edge between shards, were counted too often."""
    shared, most = 0, min(len(last), len(first))
    while shared < most and last[shared : shared + UNIT] == first[shared : shared + UNIT]:
        shared += UNIT
    turns = shared // UNIT
    sizes = [0, *(struct.unpack(">I", last[at + 16 : at + 20])[0] for at in range(0, shared, UNIT))]
    saved = np.cumsum(sizes[::-1])[::-1]
    n, keys = turns + 1, prefix_keys(last[:shared])
    yield from _batches(
        {
            "kind": np.full(n, SHARED), "key": keys, "parent_key": [None, *keys[:-1]], "depth": np.arange(n), "n_convs": np.zeros(n, int),
            "n_children": np.where(np.arange(n) < turns, -1, 0), "n_leaves": np.full(n, -(len(last) == shared)), "saved_tokens": saved,
        },
        n,
    )


def shard(ids: np.ndarray, found: list[bytes]) -> Iterator[pa.RecordBatch]:
    """The nodes of the trie of ``found``, sorted paths with ascending ids among equal ones."""
    lengths = np.array([len(p) // UNIT for p in found], np.int64)
    starts = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"".join(found), np.uint8).reshape(-1, UNIT)
    rows = np.repeat(np.arange(len(found)), lengths)
    depths = np.arange(len(data)) - starts[rows]
    codes = dense(np.ascontiguousarray(data[:, :16]).view("S16").ravel(), rows, depths)
    sizes = np.ascontiguousarray(data[:, 16:]).view(">u4").ravel().astype(np.int64)
    trie = DoubleArray(codes, starts, lengths)

    n = len(trie.check)
    convs, least, size, depth = (np.zeros(n, np.int64) for _ in range(4))
    least[:] = np.iinfo(np.int64).max
    convs[0], least[0] = len(ids), ids.min()
    state, ends = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
    spine = {0: (0, 0)}  # slot -> (which path, depth)
    active = np.flatnonzero(lengths > 0)
    for d in range(1, len(trie.levels)):  # all paths walk from the root
        at = starts[active] + d - 1
        to = trie.step(state[active], codes[at])
        if (to < 0).any():
            raise AssertionError("a path has left the trie")
        np.add.at(convs, to, 1)
        np.minimum.at(least, to, ids[active])
        size[to], depth[to] = sizes[at], d
        state[active] = ends[active] = to
        for which in (0, len(found) - 1):
            if lengths[which] >= d:
                spine.setdefault(int(state[which]), (which, d))
        active = active[lengths[active] > d]

    parent = trie.check
    children, leaves, saved = (np.zeros(n, np.int64) for _ in range(3))
    for slots in trie.levels[:0:-1]:
        np.add.at(children, parent[slots], 1)
        leaves[slots] += children[slots] == 0
        saved[slots] += (convs[slots] - 1) * size[slots]
        np.add.at(leaves, parent[slots], leaves[slots])
        np.add.at(saved, parent[slots], saved[slots])
    leaves[0] += children[0] == 0

    runs = np.flatnonzero(np.r_[True, ends[1:] != ends[:-1], True])
    listed = {int(ends[a]): (int(ids[a]), ",".join(map(str, ids[a:b].tolist()))) for a, b in zip(runs[:-1], runs[1:])}
    keys = {which: prefix_keys(found[which]) for which in {0, len(found) - 1}}
    key_of = {slot: keys[which][d] for slot, (which, d) in spine.items()}
    slots = np.concatenate(trie.levels)
    counts = lambda at: {"depth": depth[at], "n_convs": convs[at], "n_children": children[at], "n_leaves": leaves[at], "saved_tokens": saved[at], "conv_id": least[at]}

    on = np.array(list(spine), np.int64)
    yield from _batches({"kind": np.full(len(on), SHARED), "key": [key_of[s] for s in on], "parent_key": [key_of[int(parent[s])] if s else None for s in on], **counts(on)}, len(on))
    pieces = [(key_of[s], *listed[s]) for s in spine if s in listed]
    if pieces:
        key, first, text = zip(*pieces)
        yield from _batches({"kind": np.full(len(key), ENDS), "key": list(key), "conv_id": list(first), "ends": list(text)}, len(key))
    off = slots[~np.isin(slots, on)]
    if len(off):
        below = np.isin(parent[off], on)
        hashed = [hashlib.sha256(listed[s][1].encode()).hexdigest() if s in listed else NO_ENDS for s in off.tolist()]
        yield from _batches(
            {
                "kind": np.where(below, CHILD, NODE), "parent_key": [key_of[p] if b else None for p, b in zip(parent[off].tolist(), below)],
                "parent_conv_id": pa.array(least[parent[off]], mask=below), "ends": hashed, **counts(off),
            },
            len(off),
        )


def _shards(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        found: list[bytes] = []
        held, first, last = 0, None, None
        for batch in batches:
            for conv, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and held + len(path) // UNIT >= most:
                    yield from shard(np.array(ids, np.int64), found)
                    yield from edge(found[-1], path)
                    ids, found, held = [], [], 0
                first = path if first is None else first
                ids.append(conv)
                found.append(path)
                held, last = held + len(path) // UNIT + 1, path
        if found:
            yield from shard(np.array(ids, np.int64), found)
            yield from _batches({"kind": [EDGE], "part": [TaskContext.get().partitionId()], "first": [first], "last": [last]}, 1)

    return run


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for last, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield from edge(last, first)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ids) in order -> (key, SHA-256 of all its ids); one piece at a time."""
    now, running = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([running.hexdigest()])], names=["key", "ends_sha256"])

    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1)):
            if key.as_py() != now:
                if now is not None:
                    yield row()
                now, running = key.as_py(), hashlib.sha256()
            else:
                running.update(b",")
            running.update(text.as_py().encode())
    if now is not None:
        yield row()


# --- the operator --------------------------------------------------------------------------


def prefix_trie(found: DataFrame, most: int = SHARD) -> DataFrame:
    """Per node of the trie of ``found`` (conv_id, path): conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    A node is a distinct sequence of first turns; conv_id is its smallest member. ``saved_tokens``
    sums, over the subtree, (members - 1) times the bytes of the node's last text; ``ends_sha256``
    is the SHA-256 of the ids, ascending and comma-joined, of the members that end there. A path
    without turns is a member of the root alone. Paths of any length; equal paths (copies) meet
    in one node; each id is taken as one conversation. No conversation, no nodes. Turns are compared
    by 128 bits of MD5.

    A task holds one shard of at most ``most`` turns. A list of ids is hashed in order, as
    SHA-256 asks, but from pieces of a shard's size; nothing else gathers a node's members.
    """
    reachable(found.sparkSession)
    dealt = staged(found.select("conv_id", "path"), "trie-paths").repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    rows = staged(dealt.mapInArrow(_shards(most), ROWS_SQL), "trie-nodes")

    ends_of = rows.where(F.col("kind") == EDGE)
    top = ends_of.agg(F.max("part"), F.count("*")).first()
    if top[1] and top[0] + 1 != top[1]:
        raise RuntimeError("a range without rows lies between others")
    side = F.explode(F.array(F.struct(F.col("part").alias("at"), F.col("last").alias("last"), F.lit(None).cast("binary").alias("first")), F.struct((F.col("part") - 1).alias("at"), F.lit(None).cast("binary").alias("last"), F.col("first").alias("first"))))
    pairs = ends_of.select(side.alias("s")).select("s.*").groupBy("at").agg(F.max("last").alias("last"), F.max("first").alias("first"))
    over = pairs.where(F.col("last").isNotNull() & F.col("first").isNotNull()).select("last", "first").mapInArrow(_edges, ROWS_SQL)

    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = rows.where(F.col("kind") == SHARED).unionByName(over).groupBy("key").agg(F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *sums)
    pieces = rows.where(F.col("kind") == ENDS).select("key", "ends", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id")
    hashed = pieces.select("key", "ends").mapInArrow(_hashed, "key binary, ends_sha256 string")
    shared = staged(merged.join(hashed, "key", "left").withColumn("ends", F.coalesce("ends_sha256", F.lit(NO_ENDS))).drop("ends_sha256"), "trie-shared")

    parents = shared.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent"))
    columns = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends", "parent_key"]
    waiting = rows.where(F.col("kind") == CHILD).select(columns).unionByName(shared.select(columns))
    known = waiting.join(parents, "parent_key", "left").withColumnRenamed("_parent", "parent_conv_id")
    whole = rows.where(F.col("kind") == NODE).select(*columns, "parent_conv_id").unionByName(known.select(*columns, "parent_conv_id"))
    return whole.withColumnRenamed("ends", "ends_sha256").select(*OUT)
