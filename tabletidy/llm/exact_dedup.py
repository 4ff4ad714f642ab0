"""Exact dedup (operator 7): two Bloom passes, then only possibly repeated rows shuffle.

Pass 1 turns every row into a narrow fingerprint row (id, SHA-256 of the normalised
text) and sets the fingerprint's positions in a saturating two-level Bloom filter:
level one says "seen", level two "seen again". The filter is cut into segments, each
task sends the positions it set, and a segment's levels are merged by one streaming
task of bounded memory. Pass 2 asks level two: a fingerprint with a position that was
set only once is surely unique, and its row goes straight through. The rest, all
repeats and a few false positives, shuffle by their SHA-256.

The filter has 16 bits a row up to ``MAX_FILTER_BITS`` (32 MB, the proven bound of what
is broadcast). Beyond that more unique rows shuffle, and the result stays the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletidy.llm.common import SPACE_RUN, staged

MAX_FILTER_BITS = 1 << 28
SEGMENT_BITS = 1 << 16


def normalised(text) -> F.Column:
    """Each run of white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def _positions(shas: pa.Array, bits: int) -> np.ndarray:
    """Two filter positions for each fingerprint: shape (rows, 2)."""
    raw = np.frombuffer(b"".join(shas.to_pylist()), dtype="<u8").reshape(-1, 4)[:, :2]
    return (raw & np.uint64(bits - 1)).astype(np.int64)


def seen_again(prints: DataFrame, bits: int, column: str = "_sha") -> list[tuple[int, bytes]]:
    """Level two of the filter over all rows: (segment, bitmap) of the segments that have a bit."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            positions = np.sort(_positions(batch.column(0), bits), axis=1)
            positions[positions[:, 0] == positions[:, 1], 1] = -1  # one position twice is one bit
            flat = np.sort(positions[positions >= 0])
            segments, starts = np.unique(flat // SEGMENT_BITS, return_index=True)
            parts = np.split((flat % SEGMENT_BITS).astype("<u4"), starts[1:])
            yield pa.record_batch([pa.array(segments, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], ["segment", "bits"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels: dict[int, np.ndarray] = {}  # at most this task's share of the filter
        for batch in batches:
            for segment, sent_bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                level = levels.setdefault(segment, np.zeros(SEGMENT_BITS, np.uint8))
                at, n = np.unique(np.frombuffer(sent_bits, "<u4"), return_counts=True)
                level[at] = np.minimum(level[at] + np.minimum(n, 2), 2)
        found = [(s, np.packbits(v >= 2).tobytes()) for s, v in levels.items() if (v >= 2).any()]
        if found:
            yield pa.record_batch([pa.array([s for s, _ in found], pa.int64()), pa.array([b for _, b in found], pa.binary())], ["segment", "bits"])

    schema = "segment long, bits binary"
    parts = min(64, max(1, bits // SEGMENT_BITS))
    rows = prints.select(column).mapInArrow(sent, schema).repartition(parts, "segment").mapInArrow(merged, schema)
    return [(r["segment"], bytes(r["bits"])) for r in rows.collect()]  # bounded: bits / 8 bytes


def possibly_repeated(prints: DataFrame, column: str = "_sha", max_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """``prints`` with ``_maybe``: false only where the fingerprint is surely unique."""
    rows = prints.count()
    bits = min(max_bits, max(SEGMENT_BITS, 1 << (16 * max(rows, 1) - 1).bit_length()))
    bitmap = np.zeros(bits // 8, np.uint8)
    for segment, found in seen_again(prints, bits, column):
        start = segment * SEGMENT_BITS // 8
        bitmap[start : start + len(found)] = np.frombuffer(found, np.uint8)
    shared = prints.sparkSession.sparkContext.broadcast(bitmap.tobytes())
    at = prints.columns.index(column)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            if batch.num_rows:
                p = _positions(batch.column(at), bits)
                maybe = ((level[p >> 3] >> (7 - (p & 7))) & 1).all(axis=1)
                yield pa.record_batch([*batch.columns, pa.array(maybe)], [*batch.schema.names, "_maybe"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prints.schema.fields)
    return prints.mapInArrow(asked, f"{fields}, _maybe boolean")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ``[\\x20\\x09-\\x0D]`` becomes one
    space; null counts as empty. Of equal texts the row with the smallest id stays. Ties:
    of rows that repeat the id as well, exactly one stays; a null id sorts last, and its
    ``keep_id`` is null only if the whole group has null ids.
    """
    prints = staged(
        docs.select(
            F.col(id_col).cast("long").alias("_id"),
            F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("_sha"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "fingerprints",
    )
    asked = possibly_repeated(prints, max_bits=max_bits)
    first = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row"))
    # written, so that the join deals both sides itself and may split the rows of a hot group
    groups = staged(asked.where("_maybe").groupBy("_sha").agg(F.min(first).alias("_first"), F.count(F.lit(1)).alias("_n")), "groups")
    shuffled = asked.where("_maybe").join(groups, "_sha").select("_id", F.col("_first.id").alias("keep_id"), F.col("_n").alias("group_size"), (F.col("_row") == F.col("_first.row")).alias("kept"), "_sha")
    straight = asked.where("not _maybe").select("_id", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "_sha")
    return straight.unionByName(shuffled).select(F.col("_id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("_sha")).alias("text_sha256"))
