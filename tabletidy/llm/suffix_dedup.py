"""Suffix-array dedup (operator 3): every byte of a 100-byte string that starts earlier goes.

The corpus is cut into shards whose suffix arrays together find every repeat:

1. *Segments.* Each 100-byte window has an anchor, its byte gram of the least hash (the
   leftmost of equals). Equal windows have equal anchors. The consecutive windows of one
   anchor form a segment, about one per 39 bytes.
2. *Equal segments.* Segments shuffle as hashes by anchor. Of equal ones the earliest
   remains, all windows of the others are repeats; a task combines its own equal segments
   first, so thousands of copies reach a shard as a few rows. Anchors with one segment go.
3. *Shards.* Only the bytes of segments that share an anchor but differ are sent. A shard
   concatenates some MB of them, builds the suffix array by induced sorting and the permuted
   common prefixes; windows with a common prefix of 100 bytes are equal, and all but the
   earliest are repeats. An anchor with more than ``ANCHOR_SEGMENTS`` segments is never
   gathered: its windows are compared by 128-bit hashes in a grouped join.
4. *Removal.* The spans of a document meet its text, are merged and cut out.

A document is an id with a text: rows that repeat both are one document. Earlier means a
smaller id (null last; rows with equal ids and different texts in order of the text's hash).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletidy.llm.common import reachable, slices, staged
from tabletidy.llm.jaccard_join import filter_bits, in_filter, key_filter, mixed_key
from tabletidy.llm.shingles import mix, text_bytes
from tabletidy.llm.suffix_array import common_prefixes, suffix_array

WIDTH = 100
GRAM = 24
PIECE = 1 << 23  # windows of a text that are looked at together
SLICE = 1_000_000  # bytes of text that a task looks at together (eight arrays of 64 bits a byte)
FLUSH = 400_000  # segments of a task that are combined at a time
SHARD_BYTES = 2_000_000
ANCHOR_SEGMENTS = 10_000
LAST = (1 << 63) - 1  # stands for a null id in the order of documents

_U = np.uint64
_BASE = 0xD1342543DE82EF95
_BACK = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(3).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


def _running(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def segments(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Segments of the texts that lie one after another in ``data``.

    row, start (in the text), len (bytes; the windows start at the first len - 99), anchor, seg.
    """
    parts = []
    for a in range(0, max(len(data) - WIDTH + 1, 0), PIECE):
        part = _segments(data[a : a + PIECE + WIDTH - 1], np.clip(offsets - a, 0, PIECE + WIDTH - 1), offsets, a)
        parts.append(part)
    names = ("row", "start", "len", "anchor", "seg")
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.uint64 if k in ("anchor", "seg") else np.int64) for k in names}


def _segments(data: np.ndarray, cuts: np.ndarray, offsets: np.ndarray, base: int) -> dict[str, np.ndarray]:
    n = len(data)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * _running(_BASE, n), out=sums[1:])
    back = _running(_BACK, n)
    grams = mix((sums[GRAM:] - sums[: n - GRAM + 1]) * back[: n - GRAM + 1])
    # the least gram of each window: 40 bits of hash, then the place
    least = (grams & ~_U((1 << 24) - 1)) | np.arange(len(grams), dtype=np.uint64)
    span, want = 1, WIDTH - GRAM + 1
    while 2 * span <= want:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < want:
        least = np.minimum(least[: len(least) - (want - span)], least[want - span :])
    place = (least & _U((1 << 24) - 1)).astype(np.int64)
    inside = np.zeros(n + 1, np.int64)
    starts, stops = cuts[:-1], cuts[1:] - WIDTH + 1
    # windows that reach over the end of this piece belong to the next one
    full = stops > starts
    np.add.at(inside, starts[full], 1)
    np.add.at(inside, stops[full], -1)
    valid = np.cumsum(inside)[: len(place)] > 0
    first = valid & np.r_[True, (place[1:] != place[:-1]) | ~valid[:-1]]
    last = valid & np.r_[(place[1:] != place[:-1]) | ~valid[1:], True]
    s, e = np.flatnonzero(first), np.flatnonzero(last)
    row = np.searchsorted(offsets, s + base, "right") - 1
    stop = e + WIDTH
    hashed = mix((sums[stop] - sums[s]) * back[s] + (stop - s).astype(np.uint64))
    return {"row": row, "start": s + base - offsets[row], "len": stop - s, "anchor": grams[place[s]], "seg": hashed}


def _merged(start: np.ndarray, stop: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching spans of a key merged (sorted by key and start)."""
    if not len(start):
        return start, stop, key
    far = np.empty(len(stop), np.int64)
    first = np.r_[True, key[1:] != key[:-1]]
    edges = np.r_[np.flatnonzero(first), len(key)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        far[a:b] = np.maximum.accumulate(stop[a:b])
    new = first | np.r_[True, start[1:] > far[:-1]]
    at = np.flatnonzero(new)
    return start[at], far[np.r_[at[1:] - 1, len(far) - 1]], key[at]


ROWS = pa.schema([("anchor", pa.int64()), ("seg", pa.int64()), ("d", pa.int64()), ("t", pa.int64()), ("start", pa.int64()), ("len", pa.int64()), ("again", pa.bool_())])
ROWS_SQL = "anchor long, seg long, d long, t long, start long, len long, again boolean"


def _rows(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(columns[f.name], f.type) for f in ROWS], schema=ROWS)


def anchored(keyed: DataFrame) -> DataFrame:
    """Segments of (d, t, text); of a task's equal segments the earliest, and the rest as spans ``again``."""
    at = keyed.columns.index("text")

    def combined(parts: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        x = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        by = np.lexsort((x["start"], x["t"], x["d"], x["seg"], x["anchor"]))
        x = {k: v[by] for k, v in x.items()}
        new = np.r_[True, (x["anchor"][1:] != x["anchor"][:-1]) | (x["seg"][1:] != x["seg"][:-1])]
        lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        twin = (x["d"] == x["d"][lead]) & (x["t"] == x["t"][lead]) & (x["start"] == x["start"][lead])
        yield _rows(**{k: v[new] for k, v in x.items() if k in ROWS.names}, again=np.zeros(int(new.sum()), bool))
        again = ~new & ~twin
        if again.any():
            r = {k: v[again] for k, v in x.items()}
            by = np.lexsort((r["start"], r["t"], r["d"]))
            r = {k: v[by] for k, v in r.items()}
            key = np.cumsum(np.r_[True, (r["d"][1:] != r["d"][:-1]) | (r["t"][1:] != r["t"][:-1])])
            start, stop, key2 = _merged(r["start"], r["start"] + r["len"], key)
            where = np.searchsorted(key, key2)
            d, t = r["d"][where], r["t"][where]
            spread = mix((d ^ t ^ start).view(np.uint64)).view(np.int64)
            yield _rows(anchor=spread, seg=spread, d=d, t=t, start=start, len=stop - start, again=np.ones(len(start), bool))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for part in slices(batches, at, SLICE):
            x = segments(*text_bytes(part.column(at)))
            row = x.pop("row")
            if not len(row):
                continue
            x["d"] = part.column(0).to_numpy(zero_copy_only=False)[row]
            x["t"] = part.column(1).to_numpy(zero_copy_only=False)[row]
            x["anchor"], x["seg"] = x["anchor"].view(np.int64), x["seg"].view(np.int64)
            parts.append(x)
            held += len(row)
            if held >= FLUSH:
                yield from combined(parts)
                parts, held = [], 0
        if parts:
            yield from combined(parts)

    return keyed.mapInArrow(run, ROWS_SQL)


def equal_segments(rows: DataFrame) -> DataFrame:
    """Spans that are repeats (``again``), and the earliest of each segment whose anchor has several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead: dict[str, int] | None = None  # the first row of the segment that is open
        alone = True  # is it the only segment of its anchor so far? (then it is not given out yet)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ROWS.names}
            if x["again"].any():
                yield batch.filter(batch.column("again"))
                x = {k: v[~x["again"]] for k, v in x.items()}
                if not len(x["seg"]):
                    continue
            if lead is not None:
                x = {k: np.r_[np.array([lead[k]], v.dtype), v] for k, v in x.items()}
            new = np.r_[True, (x["anchor"][1:] != x["anchor"][:-1]) | (x["seg"][1:] != x["seg"][:-1])]
            at = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            twin = (x["d"] == x["d"][at]) & (x["t"] == x["t"][at]) & (x["start"] == x["start"][at])
            rep = ~new & ~twin
            if rep.any():
                yield _rows(**{k: v[rep] for k, v in x.items() if k != "again"}, again=np.ones(int(rep.sum()), bool))
            f = {k: v[new] for k, v in x.items()}
            same = f["anchor"][1:] == f["anchor"][:-1]
            several = np.r_[False, same] | np.r_[same, False]
            out = several.copy()
            if lead is not None and not alone:
                out[0], several[0] = False, True  # given out already
            if out.any():
                yield _rows(**{k: v[out] for k, v in f.items()})
            alone = not several[-1]
            last = int(np.flatnonzero(new)[-1])
            lead = {k: v[last] for k, v in x.items()}

    order = ["anchor", "seg", "d", "t", "start"]
    return rows.repartition("anchor").sortWithinPartitions(*order).mapInArrow(run, ROWS_SQL)


SPAN = "d long, t long, start long, len long"


def _spans(d, t, start, length) -> pa.RecordBatch:
    return pa.record_batch([pa.array(v, pa.int64()) for v in (d, t, start, length)], ["d", "t", "start", "len"])


def contents(keyed: DataFrame, firsts: DataFrame) -> DataFrame:
    """(anchor, d, t, start, bytes) of the segments in ``firsts``.

    A second look at the texts: a Bloom filter of bounded size over the segments' keys says
    which bytes move. What it lets through beside them is a true segment too, and harmless.
    """
    bits = filter_bits(firsts.count())
    shared = keyed.sparkSession.sparkContext.broadcast(key_filter(firsts.select("anchor", "d", "t", "start"), bits).tobytes())
    at = keyed.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(shared.value, np.uint8)
        for part in slices(batches, at, SLICE):
            data, offsets = text_bytes(part.column(at))
            x = segments(data, offsets)
            row = x["row"]
            if not len(row):
                continue
            d = part.column(0).to_numpy(zero_copy_only=False)[row]
            t = part.column(1).to_numpy(zero_copy_only=False)[row]
            take = np.flatnonzero(in_filter(bitmap, mixed_key(x["anchor"].view(np.int64), d, t, x["start"]), bits))
            if len(take):
                a = offsets[row[take]] + x["start"][take]
                raw = data.tobytes()
                found = [raw[i:j] for i, j in zip(a.tolist(), (a + x["len"][take]).tolist(), strict=True)]
                yield pa.record_batch([pa.array(x["anchor"][take].view(np.int64)), pa.array(d[take]), pa.array(t[take]), pa.array(x["start"][take]), pa.array(found, pa.binary())], ["anchor", "d", "t", "start", "bytes"])

    return keyed.mapInArrow(run, "anchor long, d long, t long, start long, bytes binary")


def shard_repeats(parts: list[tuple]) -> pa.RecordBatch | None:
    """The repeats among segments (d, t, start, bytes), by their suffix array."""
    parts.sort(key=lambda p: p[:3])  # then the earliest window is the least place in the text
    parts = [p for k, p in enumerate(parts) if not k or p[:3] != parts[k - 1][:3]]  # rows that repeat a document
    lengths = np.array([len(p[3]) for p in parts])
    data = np.frombuffer(b"\0".join(p[3] for p in parts) + b"\0", np.uint8)
    starts = np.r_[0, np.cumsum(lengths + 1)[:-1]]
    letters = np.zeros(256, np.int64)
    letters[np.unique(data)] = 1
    ends = starts + lengths  # the separators; a text may hold byte 0, so they get a letter of their own
    code = np.cumsum(letters)
    text = code[data]
    text[ends] = 0
    order = suffix_array(text, int(code[-1]) + 1, depth=WIDTH)
    shared = common_prefixes(text.astype(np.uint8) if code[-1] < 256 else data, order, WIDTH)
    left = np.repeat(starts + lengths, lengths + 1) - np.arange(len(data))
    window = (left >= WIDTH)[order]
    equal = shared[order] >= WIDTH
    group = np.cumsum(~equal)
    at, which = order[window], group[window]
    if not len(at):
        return None
    edges = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
    first = np.repeat(np.minimum.reduceat(at, edges), np.diff(np.r_[edges, len(at)]))
    again = np.sort(at[at != first])
    if not len(again):
        return None
    owner = np.searchsorted(starts, again, "right") - 1
    a, b, _ = _merged(again, again + WIDTH, owner)
    owner = np.searchsorted(starts, a, "right") - 1
    inside = a - starts[owner]
    d, t, s = (np.array([p[k] for p in parts], np.int64)[owner] for k in range(3))
    return _spans(d, t, s + inside, b - a)


def shards(pieces: DataFrame, most: int) -> DataFrame:
    """Repeats found by the suffix arrays of shards of about ``most`` bytes; no anchor is split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        held, anchor = 0, None
        for batch in batches:
            for a, d, t, s, raw in zip(*(batch.column(n).to_pylist() for n in ("anchor", "d", "t", "start", "bytes")), strict=True):
                if a != anchor and held >= most:
                    if (out := shard_repeats(parts)) is not None:
                        yield out
                    parts, held = [], 0
                anchor = a
                parts.append((d, t, s, raw))
                held += len(raw)
        if parts and (out := shard_repeats(parts)) is not None:
            yield out

    return pieces.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, SPAN)


def window_repeats(pieces: DataFrame) -> DataFrame:
    """Repeats of anchors with very many segments: windows meet by 128-bit hashes, no group is gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, t, s, raw in zip(*(batch.column(n).to_pylist() for n in ("d", "t", "start", "bytes")), strict=True):
                data = np.frombuffer(raw, np.uint8)
                n = len(data) - WIDTH + 1
                views = np.lib.stride_tricks.sliding_window_view(data, WIDTH)
                hashes = []
                for seed in (1, 2):
                    powers = mix(np.arange(WIDTH, dtype=np.uint64) + _U(seed * 1000)) | _U(1)
                    hashes.append(mix((_BYTE[views] * powers).sum(axis=1, dtype=np.uint64)).view(np.int64))
                where = [np.full(n, d, np.int64), np.full(n, t, np.int64), s + np.arange(n)]
                yield pa.record_batch([pa.array(v) for v in (*hashes, *where)], ["w1", "w2", "d", "t", "start"])

    windows = staged(pieces.mapInArrow(run, "w1 long, w2 long, d long, t long, start long").distinct(), "windows")
    first = staged(windows.groupBy("w1", "w2").agg(F.min(F.struct("d", "t", "start")).alias("first")), "first-windows")
    met = windows.join(first, ["w1", "w2"])
    return met.where(F.struct("d", "t", "start") != F.col("first")).select("d", "t", "start", F.lit(WIDTH).cast("long").alias("len"))


def repeats(keyed: DataFrame) -> DataFrame:
    """Spans (d, t, start, len) that cover exactly the bytes to remove."""
    rows = staged(equal_segments(anchored(keyed)), "segments")
    firsts = rows.where("not again")
    pieces = staged(contents(keyed, firsts), "pieces")
    many = staged(firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > ANCHOR_SEGMENTS).select("anchor"), "many")
    few = shards(pieces.join(many, "anchor", "left_anti"), SHARD_BYTES)
    spans = rows.where("again").select("d", "t", "start", "len").unionByName(few)
    return spans.unionByName(window_repeats(pieces.join(many, "anchor", "left_semi"))) if not many.isEmpty() else spans


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, spans (removed, start and stop in bytes), kept (bytes).

    Null counts as empty; texts under 100 bytes lose nothing. A cut may fall inside a letter,
    so ``kept`` is binary.
    """
    reachable(docs.sparkSession)
    id_ = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    keyed = docs.select(id_.alias("d"), F.xxhash64(text).alias("t"), text.alias("text"))
    spans = repeats(keyed.where(F.octet_length("text") >= WIDTH)).groupBy("d", "t").agg(F.collect_list(F.struct("start", "len")).alias("spans"))
    whole = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), id_.alias("d"), F.xxhash64(text).alias("t"), text.alias("text"))
    met = whole.join(spans, ["d", "t"], "left").select("id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            n_bytes, cut, kept = [], [], []
            for raw, found in zip(part.column(1).cast(pa.binary()).to_pylist(), part.column(2), strict=True):
                n_bytes.append(len(raw))
                if found.as_py() is None:
                    cut.append([])
                    kept.append(raw)
                    continue
                values = found.values
                start = values.field("start").to_numpy(zero_copy_only=False)
                stop = start + values.field("len").to_numpy(zero_copy_only=False)
                by = np.argsort(start, kind="stable")
                a, b, _ = _merged(start[by], stop[by], np.zeros(len(by), np.int64))
                cut.append([{"start": i, "stop": j} for i, j in zip(a.tolist(), b.tolist(), strict=True)])
                kept.append(b"".join(raw[i:j] for i, j in zip([0, *b.tolist()], [*a.tolist(), len(raw)], strict=True)))
            spans_t = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.record_batch([part.column(0), pa.array(n_bytes, pa.int64()), pa.array(cut, spans_t), pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"])

    out = met.mapInArrow(run, "id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")
    return out.withColumnRenamed("id", id_col)
