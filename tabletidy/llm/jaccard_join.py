"""N-gram Jaccard join (operator 1): inverted lists that skip blocks and derived answers.

Documents link when the Jaccard similarity of their shingle sets is 0.8 or more; the result
is the class (connected component) of every document.

1. *Sets.* Texts become sets of 64-bit shingle hashes; equal sets are one node from here on.
   The same pass counts shingles of all documents in a sketch of fixed size, which gives the
   global order: rare shingles first. (Any order is right; this one keeps lists short.)
2. *Lists.* A set enters the lists of its first ``n - ceil(0.8 n) + 1`` shingles with its size
   and position. Two linked sets meet in the list of their first common shingle, where
   ``min(n1 - pos1, n2 - pos2)`` is at least the needed overlap. Lists of one set go.
3. *Derived answers.* A set that is linked to a similar set inherits that set's class, so no
   pair inside a class needs an answer. Rounds test, per list entry, its nearest predecessor
   of another class that passes the size and position bounds, link, and merge classes; a
   group of near copies shrinks to one class without its pairs ever being listed.
4. *Exact round.* All pairs of different classes that are left in any list and pass the bounds
   are tested. Lists are walked in blocks of entries in order of size; a block whose sizes,
   positions or single common class rule out every pair is skipped whole. No link is lost.

Before a pair is tested, parity bitmaps of both sets bound their difference from below (each
shingle flips one bit, so bits that differ are at most shingles that differ); a pair over the
allowed difference goes (in the exact round already where it would form). What is left is tested on whole texts: the text of one side travels
to the group of the other, both become sets again and are intersected. A list of more than
``HOT`` sets, as counted, is dealt over salts in the rounds and over pairs of its blocks in the
exact round; a hub's pairs are salted too. Classes are merged by contraction in Spark.

Links are counted per document within classes, in pairs of blocks of sets. A set's answers follow
from those of one set of its block wherever their difference leaves no doubt; only the others
are intersected.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabletidy.llm.common import free_name, map_rows, reachable, slices, staged
from tabletidy.llm.shingles import mix, shingle_sets

WIDTH = 5
COUNTERS = 1 << 22
SEGMENT = 1 << 14
HOT = 2000  # entries of a list's block; a group holds two blocks at most
ROUNDS: int | None = None  # near rounds at most; None: as many as pay
REACH = 8  # predecessors that an entry tries in a round
HUB = 500  # pairs that one group tests against a set
BLOCK = 256
FILTER_BITS = 1 << 27
SIGNATURE = 256  # bits of a folded bitmap
CLASS_SETS, CLASS_TOKENS = 512, 1_000_000  # sets, and shingles, of a class that one block holds


def needed(n1, n2):
    """The least overlap of linked sets: 100 * i >= 80 * (n1 + n2 - i)."""
    return -((-4 * (n1 + n2)) // 9)


def prefix_length(n):
    return n - (4 * n + 4) // 5 + 1


def set_id(tokens: np.ndarray) -> int:
    """64 bits that name a set (equal sets agree; different ones differ but for 2^-64)."""
    if not len(tokens):
        return 0
    with np.errstate(over="ignore"):
        total = mix(tokens).sum(dtype=np.uint64) + np.uint64(len(tokens))
    return int(mix(np.array([total]))[0].view(np.int64))


def _picked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    reachable(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.xxhash64(f"`{text_col}`").alias("mark"))


def parity(tokens: np.ndarray) -> bytes:
    """A bitmap in which each token flips one bit; as many bits as tokens, or up to twice as many."""
    bits = max(64, 1 << (len(tokens) - 1).bit_length()) if len(tokens) else 64
    at = (mix(tokens ^ np.uint64(0x5BD1E995)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def bits_apart(one: bytes, other: bytes) -> int:
    """Bits that differ; the larger bitmap is folded to the size of the smaller."""
    a, b = np.frombuffer(one, np.uint8), np.frombuffer(other, np.uint8)
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count((a ^ b).view(np.uint64)).sum())


def sets_and_counts(picked: DataFrame) -> DataFrame:
    """Rows (doc_id, mark, n, sid, bits) of all documents, and per task the sketch in segments (segment, counts)."""
    at = picked.columns.index("text")
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), ("sid", pa.int64()), ("bits", pa.binary()), ("segment", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(COUNTERS, np.int32)
        for part in slices(batches, at):
            sets = shingle_sets(part.column(at), WIDTH)
            if any(map(len, sets)):
                sketch += np.bincount((mix(np.concatenate(sets)) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS).astype(np.int32)
            none = pa.nulls(len(sets))
            own = [pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) for s in sets], pa.int64()), pa.array([parity(s) for s in sets], pa.binary())]
            yield pa.record_batch([part.column(0), part.column(2), *own, none.cast(pa.int32()), none.cast(pa.binary())], schema=schema)
        full = [(k, part) for k, part in enumerate(sketch.reshape(-1, SEGMENT)) if part.any()]
        if full:
            none = pa.nulls(len(full)).cast(pa.int64())
            packed = [zlib.compress(p.astype("<i4").tobytes(), 1) for _, p in full]
            yield pa.record_batch([none, none, none, none, pa.nulls(len(full), pa.binary()), pa.array([k for k, _ in full], pa.int32()), pa.array(packed, pa.binary())], schema=schema)

    return picked.mapInArrow(run, "doc_id long, mark long, n long, sid long, bits binary, segment int, counts binary")


def ranks(sketches: DataFrame) -> np.ndarray:
    """The order of shingles: per counter the half octave of its count over all tasks, a byte each
    (``COUNTERS`` bytes whatever the input; half octaves, so that chance collisions order little)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(packed), "<i4").astype(np.int64)
                sums[k] = sums[k] + part if k in sums else part
        if sums:
            halves = [np.floor(2 * np.log2(np.maximum(v, 1))).astype(np.uint8).tobytes() for v in sums.values()]
            yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array(halves, pa.binary())], ["segment", "counts"])

    schema = "segment int, counts binary"
    rows = sketches.select("segment", "counts").repartition(64, "segment").mapInArrow(run, schema).collect()
    out = np.zeros((COUNTERS // SEGMENT, SEGMENT), np.uint8)
    for r in rows:
        out[r["segment"]] = np.frombuffer(r["counts"], np.uint8)
    return out.reshape(-1)


def postings(picked: DataFrame, order: np.ndarray) -> DataFrame:
    """Rows (token, salts, sid, n, pos): each distinct set of a task in its prefix lists."""
    shared = picked.sparkSession.sparkContext.broadcast(order.tobytes())
    at = picked.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.frombuffer(shared.value, np.uint8)
        seen: set[int] = set()
        for part in slices(batches, at):
            new = []
            for s in shingle_sets(part.column(at), WIDTH):
                if len(s) and (sid := set_id(s)) not in seen:
                    seen.add(sid)
                    new.append((sid, s))
            if not new:
                continue
            sizes = np.array([len(s) for _, s in new])
            tokens = np.concatenate([s for _, s in new])
            owner = np.repeat(np.arange(len(new)), sizes)
            rank = order[(mix(tokens) & np.uint64(COUNTERS - 1)).astype(np.int64)]
            by = np.argsort(owner << 8 | rank, kind="stable")  # by rank, then by token: sets are sorted
            pos = np.arange(len(by)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            first = pos < prefix_length(sizes)[owner]
            by, pos = by[first], pos[first]
            who = owner[by]
            salts = np.maximum(1, 2.0 ** (rank[by] / 2) // HOT)
            yield pa.record_batch(
                [pa.array(tokens[by].view(np.int64)), pa.array(salts, pa.int32()), pa.array(np.array([i for i, _ in new], np.int64)[who]), pa.array(sizes[who], pa.int32()), pa.array(pos, pa.int32())],
                ["token", "salts", "sid", "n", "pos"],
            )

    return picked.mapInArrow(run, "token long, salts int, sid long, n int, pos int")


def _salt(*by: Column) -> Column:
    return F.pmod(F.xxhash64(*by), F.col("salts").cast("long")).cast("int")


def _numbers(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    out = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names if n != "sign"}
    if "sign" in batch.schema.names:  # bitmaps as rows of 64-bit words, and how many each has
        signs = batch.column("sign").to_pylist()
        out["sign"] = np.frombuffer(b"".join(x.ljust(SIGNATURE // 8, b"\0") for x in signs), np.uint64).reshape(-1, SIGNATURE // 64)
        out["words"] = np.array([len(x) // 8 for x in signs])
    return out


def counted_lists(posts: DataFrame) -> DataFrame:
    """The lists of two sets or more, their salts taken from their counted lengths.

    The sketch only deals the postings: a counter is never below a list's length, but chance
    collisions may put it far above. So what it calls long is counted (one number per list and
    task moves), and what is not goes on as one list. Lists over ``HOT`` are at most one in
    ``HOT`` of the entries; Spark broadcasts them where they are few and else splits the join.
    """
    dealt = staged(lists_of_several(posts), "dealt-lists")
    maybe = dealt.where("salts > 1").drop("salts")
    salts = F.ceil(F.col("k") / HOT).cast("int")
    long_ = staged(maybe.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > HOT).select("token", salts.alias("salts")), "long-lists")
    again = maybe.join(long_, "token", "left").select("token", F.coalesce("salts", F.lit(1)).alias("salts"), "sid", "n", "pos")
    return staged(dealt.where("salts = 1").unionByName(lists_of_several(again)), "lists")


def lists_of_several(posts: DataFrame) -> DataFrame:
    """Postings of lists with two sets or more, repeats gone (a list of several salts is kept whole)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row: its list may go on
        known = False  # is an equal list entry before ``held``?

        def kept(rows: pa.RecordBatch, before: bool, more: bool):
            x = _numbers(rows)
            same = (x["token"][1:] == x["token"][:-1]) & (x["salt"][1:] == x["salt"][:-1])
            twin = same & (x["sid"][1:] == x["sid"][:-1])
            keep = np.r_[True, ~twin]
            # neighbours of another set in the same list, on either side
            left = np.r_[before, np.zeros(len(same), bool)]
            for i in np.flatnonzero(same):
                left[i + 1] = left[i] if twin[i] else True
            right = np.r_[same & ~twin, False]
            for i in np.flatnonzero(twin)[::-1]:
                right[i] = right[i + 1]
            good = keep & (left | right | (x["salts"] > 1))
            end = len(good) - (1 if more else 0)
            return rows.slice(0, end).filter(pa.array(good[:end])), bool(left[-1]), bool(keep[-1])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            out, known, _ = kept(rows, known, True)
            held = rows.slice(rows.num_rows - 1)
            if out.num_rows:
                yield out
        if held is not None:
            out, _, _ = kept(held, known, False)
            if out.num_rows:
                yield out

    salted = posts.withColumn("salt", _salt(F.col("sid"))).repartition("token", "salt").sortWithinPartitions("token", "salt", "n", "sid")
    return salted.mapInArrow(run, "token long, salts int, sid long, n int, pos int, salt int").drop("salt")


def may_link(n1, p1, n2, p2):
    """Size and position bounds of two entries of a list."""
    return (5 * np.minimum(n1, n2) >= 4 * np.maximum(n1, n2)) & (np.minimum(n1 - p1, n2 - p2) >= needed(n1, n2))


PAIR = "a long, b long"


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return pa.record_batch([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])


def near_pairs(entries: DataFrame, turn: int) -> DataFrame:
    """For each list entry the nearest of ``REACH`` predecessors of another class that may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            x = _numbers(rows)
            open_ = np.ones(rows.num_rows, bool)
            if held is not None:
                open_[: held.num_rows] = False  # they had their turn
            a, b = [], []
            for d in range(1, min(REACH, rows.num_rows - 1) + 1):
                i = np.flatnonzero(open_[d:]) + d
                j = i - d
                good = (x["token"][i] == x["token"][j]) & (x["salt"][i] == x["salt"][j]) & (x["label"][i] != x["label"][j])
                good &= may_link(x["n"][i], x["pos"][i], x["n"][j], x["pos"][j])
                i, j = i[good], j[good]
                open_[i] = False
                a.append(x["sid"][i])
                b.append(x["sid"][j])
            held = rows.slice(max(0, rows.num_rows - REACH))
            if a and len(np.concatenate(a)):
                yield _pairs(np.concatenate(a), np.concatenate(b))

    # by size first; later in one of eight orders by list, so that a set meets several others
    order = F.col("n") if turn == 0 else F.xxhash64("sid", F.lit(turn), F.pmod("token", F.lit(8)))
    dealt = entries.withColumn("salt", _salt(F.col("sid"), F.lit(turn))).withColumn("by", order.cast("long"))
    return dealt.repartition("token", "salt").sortWithinPartitions("token", "salt", "by", "sid").mapInArrow(run, PAIR).distinct()


def _list_pairs(x: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a list of different classes that pass the bounds, block by block."""
    by = np.lexsort((x["label"], x["n"]))
    x = {k: v[by] for k, v in x.items()}
    n, pos, label, side = x["n"], x["pos"], x["label"], x["side"]
    starts = np.arange(0, len(n), BLOCK)
    least_pos = np.minimum.reduceat(pos, starts)
    low, high = np.minimum.reduceat(label, starts), np.maximum.reduceat(label, starts)
    for s, i in enumerate(starts):
        i2 = min(i + BLOCK, len(n))
        for t in range(s, len(starts)):
            j, j2 = starts[t], min(starts[t] + BLOCK, len(n))
            if 5 * n[i2 - 1] < 4 * n[j]:
                break  # this block and all after it are too large
            if low[s] == high[s] == low[t] == high[t]:
                continue  # one class: its answers are known
            if min(n[i2 - 1] - least_pos[s], n[j2 - 1] - least_pos[t]) < needed(n[i], n[j]):
                continue  # even the foremost positions leave too little to share
            ok = (label[i:i2, None] != label[None, j:j2]) & may_link(n[i:i2, None], pos[i:i2, None], n[None, j:j2], pos[None, j:j2])
            if side[0]:
                ok &= side[i:i2, None] != side[None, j:j2]  # the pairs of one block are another group's
            if s == t:
                ok = np.triu(ok, 1)
            a, b = np.nonzero(ok)
            a, b = i + a, j + b
            good = may_match(x, a, b)
            if good.any():
                yield x["sid"][a[good]], x["sid"][b[good]]


def folded(bits: bytes) -> bytes:
    """A parity bitmap folded to ``SIGNATURE`` bits (smaller ones repeat nothing: zeros follow)."""
    a = np.frombuffer(bits, np.uint8)
    while len(a) > SIGNATURE // 8:
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return a.tobytes()


def signed(entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """The entries of lists of several classes, each with its set's folded bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([folded(x) for x in batch.column(1).to_pylist()], pa.binary())], ["sid", "sign"])

    open_ = entries.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("token")
    left = staged(entries.join(open_, "token"), "open-lists")
    signs = nodes.join(left.select("sid").distinct(), "sid", "left_semi").select("sid", "bits").mapInArrow(run, "sid long, sign binary")
    return staged(left.join(signs, "sid"), "signed-lists")


def may_match(x: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of pairs of entries those whose folded bitmaps allow a link: bits that differ, once both
    have the size of the smaller, are at most shingles that differ."""
    most = x["n"][a] + x["n"][b] - 2 * needed(x["n"][a], x["n"][b])
    out = np.ones(len(a), bool)
    size = np.minimum(x["words"][a], x["words"][b])
    for words in np.unique(size):
        at = np.flatnonzero(size == words)
        both = []
        for i in (a[at], b[at]):
            sign, full = x["sign"][i].copy(), x["words"][i]
            for w in (4, 2):
                if w > words:
                    fold = full >= w
                    sign[fold, : w // 2] ^= sign[fold, w // 2 : w]
            both.append(sign[:, :words])
        out[at] = np.bitwise_count(both[0] ^ both[1]).sum(axis=1) <= most[at]
    return out


def in_groups(entries: DataFrame) -> DataFrame:
    """The entries with the group (token, salt) in which they meet others, and their side there.

    A hot list is cut into blocks of some ``HOT`` entries, those of its largest class (whose
    answers are known among themselves) and the others apart. Each block of others meets each
    block of the class, each other block of others and itself, in a group of its own; so no
    group holds more than two blocks, whatever the list's classes are. Side 0 meets all of its
    group, sides 1 and 2 only each other.
    """
    hot = entries.where("salts > 1")
    sizes = hot.groupBy("token", "label").agg(F.count(F.lit(1)).alias("k"))
    most = sizes.groupBy("token").agg(F.max(F.struct("k", "label")).alias("most"), F.sum("k").alias("all"))
    blocks = lambda k: F.ceil(k / HOT).cast("long")
    shape = most.select("token", F.col("most.label").alias("own"), blocks(F.col("most.k")).alias("inner"), blocks(F.col("all") - F.col("most.k")).alias("outer"))
    inner, outer, block = F.col("inner"), F.col("outer"), F.col("block")
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    group = lambda salt, side: F.struct(salt.alias("salt"), side.cast("int").alias("side"))
    of_class = F.transform(upto(outer), lambda i: group(i * inner + block, F.lit(1)))
    to_class = F.transform(upto(inner), lambda j: group(block * inner + j, F.lit(2)))
    to_others = F.transform(upto(outer), lambda i: group(inner * outer + F.least(i, block) * outer + F.greatest(i, block), F.when(i == block, 0).when(i > block, 1).otherwise(2)))
    inside = F.col("label") == F.col("own")
    placed = hot.join(shape.where("outer > 0"), "token").withColumn("block", F.pmod(F.xxhash64("sid"), F.when(inside, inner).otherwise(outer)))
    dealt = placed.withColumn("group", F.explode(F.when(inside, of_class).otherwise(F.concat(to_class, to_others))))
    cold = entries.where("salts = 1").withColumn("salt", F.lit(0).cast("long")).withColumn("side", F.lit(0))
    return cold.unionByName(dealt.select(*entries.columns, "group.salt", "group.side"))


def all_pairs(entries: DataFrame) -> DataFrame:
    """Every pair of different classes that meets in a list and passes the bounds, those of the
    folded bitmaps too."""
    rows = in_groups(entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None

        def found(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            x = _numbers(part)
            cuts = np.flatnonzero((x["token"][1:] != x["token"][:-1]) | (x["salt"][1:] != x["salt"][:-1])) + 1
            edges = [0, *cuts.tolist(), part.num_rows]
            a: list[np.ndarray] = []
            b: list[np.ndarray] = []
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if j - i > 1:
                    for p, q in _list_pairs({k: v[i:j] for k, v in x.items()}):
                        a.append(p)
                        b.append(q)
                        if sum(map(len, a)) > 500_000:
                            yield _pairs(np.concatenate(a), np.concatenate(b))
                            a, b = [], []
            if a:
                yield _pairs(np.concatenate(a), np.concatenate(b))

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            x = _numbers(part)
            last = np.flatnonzero((x["token"] != x["token"][-1]) | (x["salt"] != x["salt"][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            yield from found(part.slice(0, cut)) if cut else ()
            held = part.slice(cut)
        if held is not None:
            yield from found(held)

    return rows.repartition("token", "salt").sortWithinPartitions("token", "salt").mapInArrow(run, PAIR).distinct()


def mixed_key(*columns: np.ndarray) -> np.ndarray:
    """One 64-bit key of several columns of 64-bit numbers."""
    x = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        x = mix(x + c.astype(np.int64, copy=False).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return x


def whole_numbers(column: pa.Array) -> np.ndarray:
    """A long column, nulls as the least number."""
    return pa.compute.fill_null(column, -(1 << 63)).to_numpy(zero_copy_only=False)


def key_filter(keys: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of ``bits`` bits (two per key) over rows of long columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(filter_positions(mixed_key(*map(whole_numbers, batch.columns)), bits))
            segments, starts = np.unique(at // SEGMENT, return_index=True)
            parts = np.split((at % SEGMENT).astype("<u2"), starts[1:])
            if len(at):
                yield pa.record_batch([pa.array(segments, pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["segment", "at"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(k, np.zeros(SEGMENT, bool))[np.frombuffer(at, "<u2")] = True
        if held:
            yield pa.record_batch([pa.array(list(held), pa.int32()), pa.array([np.packbits(v).tobytes() for v in held.values()], pa.binary())], ["segment", "at"])

    schema = "segment int, at binary"
    rows = keys.mapInArrow(run, schema).repartition(min(64, bits // SEGMENT), "segment").mapInArrow(merged, schema).collect()
    out = np.zeros((bits // SEGMENT, SEGMENT // 8), np.uint8)
    for r in rows:
        out[r["segment"]] = np.frombuffer(r["at"], np.uint8)
    return out.reshape(-1)


def filter_positions(keys: np.ndarray, bits: int) -> np.ndarray:
    both = np.concatenate([keys & np.uint64(bits - 1), (keys >> np.uint64(32)) & np.uint64(bits - 1)])
    return both.astype(np.int64)


def in_filter(bitmap: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    p = filter_positions(keys, bits).reshape(2, -1)
    return ((bitmap[p >> 3] >> (7 - (p & 7))) & 1).all(axis=0)


def filter_bits(n: int) -> int:
    """16 bits a key, up to ``FILTER_BITS``."""
    return min(FILTER_BITS, max(SEGMENT, 1 << (16 * max(n, 1) - 1).bit_length()))


def texts_of(picked: DataFrame, sids: DataFrame) -> DataFrame:
    """(sid, text) of one document per set of ``sids`` (sid, doc_id, mark).

    A Bloom filter of bounded size over document and text hash says which documents are asked
    for: only their texts become sets and move. What it lets through beside them meets no pair later.
    """
    wanted = staged(sids.select("sid", "doc_id", "mark"), "wanted")
    n = wanted.count()
    if not n:
        return picked.sparkSession.createDataFrame([], "sid long, text string")
    bits = filter_bits(n)
    shared = picked.sparkSession.sparkContext.broadcast(key_filter(wanted.select("mark", "doc_id"), bits).tobytes())

    def asked(part: pa.RecordBatch) -> pa.RecordBatch:
        keep = in_filter(np.frombuffer(shared.value, np.uint8), mixed_key(whole_numbers(part.column(2)), whole_numbers(part.column(0))), bits)
        part = part.filter(pa.array(keep))
        ids = np.array([set_id(s) for s in shingle_sets(part.column(1), WIDTH)], np.int64)
        return pa.record_batch([pa.array(ids), part.column(1)], ["sid", "text"])

    return staged(map_rows(picked, "text", "sid long, text string", asked).dropDuplicates(["sid"]), "texts")


def screened(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose parity bitmaps allow a link (a proven bound: no linked pair goes)."""
    own = nodes.select("sid", "n", "bits")
    met = pairs.join(own.withColumnsRenamed({"sid": "a", "n": "n1", "bits": "b1"}), "a").join(own.withColumnsRenamed({"sid": "b", "n": "n2", "bits": "b2"}), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in ("n1", "n2")}
            most = (x["n1"] + x["n2"] - 2 * needed(x["n1"], x["n2"])).tolist()
            keep = [bits_apart(p, q) <= d for p, q, d in zip(batch.column("b1").to_pylist(), batch.column("b2").to_pylist(), most, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return met.mapInArrow(run, PAIR)


def links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets share 0.8 or more.

    ``a``'s text goes once to each group of its pairs (of ``HUB`` at most, by a salt) and the
    text of ``b`` to its group; the group streams by with one set of ``a`` in memory.
    """
    hubs = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / HUB).cast("int").alias("salts"))
    salted = pairs.join(hubs, "a").withColumn("salt", _salt(F.col("b")))
    right = salted.join(texts.withColumnRenamed("sid", "b"), "b").select("a", "salt", "b", "text")
    left = hubs.select(F.col("a"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).join(texts.withColumnRenamed("sid", "a"), "a")
    rows = right.unionByName(left.select("a", "salt", F.lit(None).cast("long").alias("b"), "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tokens = None, None
        for part in slices(batches, 3):
            sets = shingle_sets(part.column(3), WIDTH)
            good: list[tuple[int, int]] = []
            for a, salt, b, s in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), sets, strict=True):
                if b is None:
                    own, tokens = (a, salt), s
                elif own == (a, salt):
                    at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                    shared = int((tokens[at] == s).sum())
                    if 100 * shared >= 80 * (len(tokens) + len(s) - shared):
                        good.append((a, b))
            if good:
                yield pa.record_batch([pa.array([a for a, _ in good], pa.int64()), pa.array([b for _, b in good], pa.int64())], ["a", "b"])

    return rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()).mapInArrow(run, PAIR)


def merge_classes(edges: DataFrame) -> DataFrame:
    """Connected components by contraction: (v, label) of every vertex, label the least vertex.

    Each turn every vertex goes four steps, from least neighbour to least neighbour; the edges
    between what they reach are the next turn's graph. Written each turn; log n turns.
    """
    edges = staged(edges.select("a", "b").where("a <> b").distinct(), "edges")
    steps: list[DataFrame] = []
    while n := edges.count():
        files = 1 + n // 200_000  # the graph shrinks each turn, and so do its tables
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = staged(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("up")).withColumnRenamed("a", "v").coalesce(files), "up")
        top = up.select(F.col("v").alias("up"), F.col("up").alias("top"))
        two = up.join(top, "up").select("v", F.col("top").alias("mid"))
        step = staged(two.join(two.select(F.col("v").alias("mid"), F.col("mid").alias("label")), "mid").select("v", "label").coalesce(files), "step")
        steps.append(step)
        a = step.select(F.col("v").alias("a"), F.col("label").alias("x"))
        b = step.select(F.col("v").alias("b"), F.col("label").alias("y"))
        edges = staged(edges.join(a, "a").join(b, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct().coalesce(files), "edges")
    if not steps:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("label"))
    labels = steps[0]
    for step in steps[1:]:
        moved = step.select(F.col("v").alias("label"), F.col("label").alias("next"))
        labels = labels.join(moved, "label", "left").select("v", F.coalesce("next", "label").alias("label"))
    return staged(labels, "labels") if len(steps) > 1 else labels


def overlaps(sets: list[np.ndarray], k: int) -> np.ndarray:
    """Intersection sizes of the first ``k`` sets with all of ``sets``; shingles of one set only go."""
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    count = np.bincount(token)
    keep = count[token] > 1
    owner, token = owner[keep], (np.cumsum(count > 1) - 1)[token[keep]]
    by = np.argsort(token, kind="stable")
    owner, token = owner[by], token[by]
    out = np.zeros((k, len(sets)))
    for first in range(0, int(token[-1]) + 1 if len(token) else 0, 2048):
        a, b = np.searchsorted(token, [first, first + 2048])
        has = np.zeros((len(sets), 2048), np.float32)
        has[owner[a:b], token[a:b] - first] = 1
        out += has[:k] @ has.T
    return out.astype(np.int64)


def partners(sets: list[np.ndarray], copies: np.ndarray, k: int, same: bool) -> np.ndarray:
    """Per set the documents it links to: the first ``k`` sets meet the others (``same``: each other).

    All sets are compared with one of them first. With d shingles that differ from it, two
    sets s and t differ in between ``|d_s - d_t|`` and ``d_s + d_t`` shingles, and they link if
    9 times what differs is at most ``n_s + n_t``: most answers follow from these bounds; only sets with
    an answer left open are intersected.
    """
    n = np.array([len(x) for x in sets])
    rest = slice(0, k) if same else slice(k, len(sets))
    apart = n + n[0] - 2 * np.array([np.isin(x, sets[0], assume_unique=True).sum() for x in sets])
    total = n[:k, None] + n[None, rest]
    linked = 9 * (apart[:k, None] + apart[None, rest]) <= total
    unsure = ~linked & (9 * np.abs(apart[:k, None] - apart[None, rest]) <= total)
    rows, columns = np.flatnonzero(unsure.any(axis=1)), np.flatnonzero(unsure.any(axis=0))
    if len(rows):
        others = columns + rest.start
        both = overlaps([sets[i] for i in rows] + [sets[i] for i in others], len(rows))[:, len(rows) :]
        at = np.ix_(rows, columns)
        linked[at] = 9 * both >= 4 * total[at]
    if same:
        np.fill_diagonal(linked, False)
    out = np.zeros(len(sets), np.int64)
    out[:k] = linked @ copies[rest]
    if not same:
        out[rest] = copies[:k] @ linked
    return out


def link_counts(picked: DataFrame, nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """(sid, links): the documents of other sets that a set of a class links to.

    A link's two sets share a class. A class is dealt into blocks of sets (by a hash; of
    ``CLASS_SETS`` sets or ``CLASS_TOKENS`` shingles or so), and two blocks meet in one group, which
    returns a count per set, never its pairs.
    """
    members = staged(classes.withColumnRenamed("v", "sid").join(nodes.select("sid", "doc_id", "mark", "n", "copies"), "sid"), "members")
    texts = texts_of(picked, members)
    sizes = members.groupBy("label").agg(F.greatest(F.ceil(F.count(F.lit(1)) / CLASS_SETS), F.ceil(F.sum("n") / CLASS_TOKENS)).cast("long").alias("blocks"))
    dealt = members.join(sizes, "label").withColumn("own", F.pmod(F.xxhash64("sid"), F.col("blocks")))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = met.select("label", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).alias("second"), "sid", "copies")
    held = rows.join(texts, "sid").select("label", "low", "high", "second", "sid", "copies", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sids, copies, sets, firsts = None, [], [], [], 0

        def counted() -> pa.RecordBatch:
            k = len(sets) if now[1] == now[2] else firsts
            links = partners(sets, np.array(copies, np.int64), k, now[1] == now[2]) if k and (k < len(sets) or now[1] == now[2]) else np.zeros(len(sets), np.int64)
            some = np.flatnonzero(links)
            return pa.record_batch([pa.array(np.array(sids, np.int64)[some]), pa.array(links[some])], ["sid", "links"])

        for part in slices(batches, 6):
            found = shingle_sets(part.column(6), WIDTH)
            keys = zip(*(part.column(c).to_pylist() for c in range(3)))
            for key, second, sid, copy, tokens in zip(keys, part.column(3).to_pylist(), part.column(4).to_pylist(), part.column(5).to_pylist(), found, strict=True):
                if key != now:
                    if now is not None:
                        yield counted()
                    now, sids, copies, sets, firsts = key, [], [], [], 0
                firsts += not second
                sids.append(sid)
                copies.append(copy)
                sets.append(tokens)
        if now is not None:
            yield counted()

    dealt_out = held.repartition("label", "low", "high").sortWithinPartitions("label", "low", "high", "second")
    return dealt_out.mapInArrow(run, "sid long, links long").groupBy("sid").agg(F.sum("links").alias("links"))


def classes_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_links: bool = False) -> DataFrame:
    """One row per input row: doc_id, mark (64-bit hash of the text), n, label, component_id.

    ``label`` names the class; it is null for rows without shingles. With ``count_links`` also
    n_links, the number of other rows that the row links to.
    """
    picked = _picked(docs, id_col, text_col)
    first = staged(sets_and_counts(picked), "sets")
    sets = first.where("segment is null").select("doc_id", "mark", "n", "sid")
    own = first.where("segment is null and n > 0").groupBy("sid").agg(F.min(F.struct("doc_id", "mark")).alias("own"), F.max("n").alias("n"), F.max("bits").alias("bits"), F.count(F.lit(1)).alias("copies"))
    nodes = staged(own.select("sid", "own.doc_id", "own.mark", "n", "bits", "copies"), "nodes")
    lists = counted_lists(postings(picked, ranks(first.where("segment is not null"))))
    rows = lists.count()
    classes = texts = None
    turn, last, stalled = 0, False, False
    while not last:
        if classes is None:
            entries = lists.withColumn("label", F.col("sid"))
        else:
            named = classes.withColumnRenamed("v", "sid")
            entries = staged(lists.join(named, "sid", "left").withColumn("label", F.coalesce("label", "sid")), "entries")
            # pairs of different classes in lists: an upper bound of what the exact round lists
            per = entries.groupBy("token", "label").agg(F.count(F.lit(1)).cast("double").alias("k"))
            open_ = per.groupBy("token").agg(((F.sum("k") ** 2 - F.sum(F.col("k") ** 2)) / 2).alias("pairs"))
            last = stalled or (ROUNDS is not None and turn >= ROUNDS) or (open_.agg(F.sum("pairs")).first()[0] or 0) <= 4 * rows
        pairs = staged(screened(all_pairs(signed(entries, nodes)) if last else near_pairs(entries, turn), nodes), "pairs")
        sids = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
        more = texts_of(picked, (sids if texts is None else sids.join(texts, "sid", "left_anti")).join(nodes, "sid").select("sid", "doc_id", "mark"))
        texts = more if texts is None else texts.unionByName(more)
        found = links(pairs, texts)
        if classes is None:
            classes = merge_classes(found)
        else:
            found = (
                found.join(classes.withColumnsRenamed({"v": "a", "label": "la"}), "a", "left")
                .join(classes.withColumnsRenamed({"v": "b", "label": "lb"}), "b", "left")
                .select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
            )
            new = merge_classes(found)
            stalled = new.count() <= rows // 1000  # near rounds no longer pay (classes are finite: this comes)
            moved = new.select(F.col("v").alias("label"), F.col("label").alias("next"))
            kept = classes.join(moved, "label", "left").select("v", F.coalesce("next", "label").alias("label"))
            classes = staged(kept.unionByName(new.join(classes, "v", "left_anti")), "classes")
        turn += 1
    linked = sets.where("n > 0").join(classes.withColumnRenamed("v", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    least = staged(linked.groupBy("label").agg(F.min("doc_id").alias("component_id")), "least")
    some = linked.join(least, "label")
    none = sets.where("n = 0").select("doc_id", "mark", "n", F.lit(None).cast("long").alias("label"), F.col("doc_id").alias("component_id"))
    columns = ["doc_id", "mark", "n", "label", "component_id"]
    if not count_links:
        return some.select(columns).unionByName(none)
    linked_to = link_counts(picked, nodes, classes)
    counts = staged(nodes.join(linked_to, "sid", "left").select("sid", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "links")
    return some.join(counts, "sid").select(*columns, "n_links").unionByName(none.withColumn("n_links", F.lit(0).cast("long")))


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the smallest id of its class), n_links.

    ``n_links`` counts the other rows that the row itself links to, those of equal texts too.

    Null and empty texts and texts without words have no shingles and are linked with nothing
    (their own id is their class). Equal sets link, so rows that repeat a text do. A null id
    takes part like any other; its class id is null only if no member has an id.
    """
    return classes_of(docs, id_col, text_col, count_links=True).select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "n_links")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents table with one row of each class: the one with the smallest id.

    Rows without words stay, all of them. Ties: of rows that repeat the smallest id the one
    with the least hash of its text stays; of rows that repeat the text too, one. A null id
    comes after all others.
    """
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("mark").alias("mark"))
    firsts = classes_of(docs).where("label is not null").groupBy("label").agg(F.min(first).alias("x")).select(F.col("x.id").alias("_keep"), F.col("x.mark").alias("_mark"))
    wordless = ~F.coalesce(F.col("text"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    its = free_name(docs, "_its")
    marked = docs.where(~wordless).withColumn(its, F.xxhash64("text"))
    one = marked.join(firsts, marked["doc_id"].eqNullSafe(firsts["_keep"]) & (marked[its] == firsts["_mark"]), "left_semi")
    return one.dropDuplicates(["doc_id", its]).drop(its).unionByName(docs.where(wordless))
