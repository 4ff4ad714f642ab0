"""Quoted CSV read in blocks (S1): a file of any size by many tasks, newlines inside quotes included.

Spark's text source splits a file into blocks of whole lines. Whether a block begins inside a
quoted cell depends on everything before it, so the read takes two passes:

1. *States.* Per block, what becomes of either state at its start (outside or inside quotes): where it
   ends, and whether a cell that is open at the start closes. A state is followed over lines with
   quotes only. The driver gets one small row per block (which Spark's own list of splits
   has too) and the distinct headers; an exclusive prefix over each file's blocks gives the state
   in which every block really begins.
2. *Records.* Each task joins the lines of its records, from true record starts on. A record that goes
   on over the end of its block comes as fragments, which a group per record puts together.

Cells are then parsed by ``from_csv`` on whole records, and the table is written once as Parquet:
the passes of a profile or a cleaning read columns, not CSV text.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabletidy.session import reachable

#: One row per block reaches the driver, and 33 bytes per block every task.
MAX_BLOCKS = 4_000_000

# Where a reader stands: at a field's start, in a plain field, in quotes, behind a quote inside quotes.
START, PLAIN, QUOTED, ENDING = range(4)
#: What a quote makes of it: only the first character of a field opens quotes.
AT_QUOTE = (QUOTED, PLAIN, ENDING, QUOTED)


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line (without its newline) that begins inside or outside of quotes ends inside."""
    state = QUOTED if inside else START
    for k, piece in enumerate(line.split('"')):
        if k:
            state = AT_QUOTE[state]
        if piece and state != QUOTED:
            state = START if piece[-1] in ",\r" else PLAIN
    return state == QUOTED


def at_returns(record: str) -> list[str]:
    """A record, cut at the carriage returns outside of quotes (which end records too)."""
    record = record.removesuffix("\r")
    if "\r" not in record:
        return [record]
    parts, now, state = [], [], START
    for k, piece in enumerate(record.split('"')):
        if k:
            state = AT_QUOTE[state]
            now.append('"')
        if piece and state != QUOTED:
            *whole, rest = piece.split("\r")
            for x in whole:
                parts.append("".join([*now, x]))
                now = []
            piece, state = rest, START if piece[-1] in ",\r" else PLAIN
        now.append(piece)
    return [*parts, "".join(now)]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Array]]:
    """Stretches of lines of one block: (file, start, lines)."""
    for batch in batches:
        file, start = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero(np.r_[True, (file[1:] != file[:-1]) | (start[1:] != start[:-1]), True]) if len(file) else []
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield int(file[a]), int(start[a]), batch.column(2).slice(a, b - a)


BLOCK = "file long, start long, from_outside boolean, from_inside boolean, closes boolean, header string"


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines -> a row per block."""

    class Block:
        def __init__(self, file: int, start: int) -> None:
            self.key = (file, start)
            self.outside, self.inside, self.closes = False, True, False  # where the two hypotheses stand
            self.header: str | None = None
            self.first: list[str] | None = [] if start == 0 else None  # lines of the first record

        def row(self) -> pa.RecordBatch:
            if self.first:
                self.header = at_returns("\n".join(self.first))[0]
            values = [*self.key, self.outside, self.inside, self.closes, self.header]
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["file", "start", "from_outside", "from_inside", "closes", "header"])

    now: Block | None = None
    for file, start, lines in _runs(batches):
        if now is None or now.key != (file, start):
            if now:
                yield now.row()
            now = Block(file, start)
        if now.first is not None:
            state = bool(now.first) and now.outside
            for i in range(len(lines)):
                line = lines[i].as_py()
                if not now.first and not line.removesuffix("\r"):
                    continue
                now.first.append(line)
                state = ends_inside(line, state)
                if not state:
                    now.header, now.first = at_returns("\n".join(now.first))[0], None
                    break
        for at in np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False)).tolist():
            line, same = lines[at].as_py(), now.outside == now.inside
            now.outside = ends_inside(line, now.outside)
            now.inside = now.outside if same else ends_inside(line, now.inside)
            now.closes = now.closes or not now.inside
    if now:
        yield now.row()


class Blocks:
    """Per block, in order of file and start: whether it begins inside, the block whose record is
    open there, and the header of its file."""

    def __init__(self, rows: list) -> None:
        rows = sorted(rows, key=lambda r: (r["file"], r["start"]))
        self.file = np.array([r["file"] for r in rows], np.int64)
        self.start = np.array([r["start"] for r in rows], np.int64)
        if len(rows) != len({(r["file"], r["start"]) for r in rows}):
            raise ValueError("two files share one hash of their paths")
        n = len(rows)
        self.inside, self.chain, self.header = np.zeros(n, bool), np.full(n, -1, np.int64), np.full(n, -1, np.int32)
        headers: dict[str, int] = {}
        self.crossing = False
        inside, chain, header, file = False, -1, -1, None
        for i, r in enumerate(rows):
            if r["file"] != file:
                inside, chain, header, file = False, -1, -1, r["file"]
                if r["header"] is not None:
                    header = headers.setdefault(r["header"], len(headers))
            self.inside[i], self.chain[i], self.header[i] = inside, chain if inside else -1, header
            after = r["from_inside"] if inside else r["from_outside"]
            if after and (not inside or r["closes"]):
                chain = i  # a record that opens here is open at the end
            inside = after
            self.crossing |= after
        self.headers = list(headers)

    def find(self, file: int, start: int) -> int:
        low, high = np.searchsorted(self.file, file, "left"), np.searchsorted(self.file, file, "right")
        return int(low + np.searchsorted(self.start[low:high], start))


RECORD = "header int, chain long, place long, named boolean, text string"


def _records(sent) -> object:
    """Lines -> records: whole ones (no chain) and fragments (by the block in which theirs begins)."""

    def rows(header: int, texts: pa.Array | list[str], chain: int | None = None, place: int | None = None, named: bool = False) -> pa.RecordBatch:
        n = len(texts)
        return pa.RecordBatch.from_arrays(
            [pa.array([header] * n, pa.int32()), pa.array([chain] * n, pa.int64()), pa.array([place] * n, pa.int64()), pa.array([named] * n), pa.array(texts, pa.string()) if isinstance(texts, list) else texts],
            names=["header", "chain", "place", "named", "text"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: Blocks = sent.value
        key, at, inside, held, chain, named, header = None, -1, False, [], None, False, -1

        def rest() -> Iterator[pa.RecordBatch]:
            if held:  # open at the end of the block
                yield rows(header, ["\n".join(held)], chain, at, named)

        for file, start, lines in _runs(batches):
            if key != (file, start):
                yield from rest()
                key, at = (file, start), blocks.find(file, start)
                inside, held, header = bool(blocks.inside[at]), [], int(blocks.header[at])
                chain = int(blocks.chain[at]) if inside else at
                named = start == 0 and not inside  # the next record is the header
                begun = inside
            whole: list[pa.Array] = []
            done = 0  # lines before this one are dealt with
            events = np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False)).tolist()
            for i in events:
                if inside:
                    line = lines[i].as_py()
                    if ends_inside(line, True):
                        continue
                    held.extend(lines.slice(done, i + 1 - done).to_pylist())
                    text = "\n".join(held)
                    if begun:  # it began in an earlier block
                        yield rows(header, [text], chain, at)
                    else:
                        whole.append(pa.array(at_returns(text), pa.string()))
                    inside, begun, held, chain, done = False, False, [], at, i + 1
                elif ends_inside(lines[i].as_py(), False):
                    whole.append(plain(lines.slice(done, i - done)))
                    inside, done = True, i
            if inside:
                held.extend(lines.slice(done).to_pylist())
            else:
                whole.append(plain(lines.slice(done)))
            texts = pa.concat_arrays([w.cast(pa.string()) for w in whole]) if whole else pa.array([], pa.string())
            texts = texts.filter(pc.not_equal(texts, ""))
            if named and len(texts):
                texts, named = texts.slice(1), False
            if len(texts):
                yield rows(header, texts)
        yield from rest()

    def plain(lines: pa.Array) -> pa.Array:
        """Lines that are records, without the carriage return of their end."""
        if not pc.any(pc.match_substring(lines, "\r")).as_py():
            return lines
        return pa.array([x for line in lines.to_pylist() for x in at_returns(line)], pa.string())

    return run


def _lines(spark: SparkSession, path: str, glob: str) -> DataFrame:
    read = spark.read.option("lineSep", "\n").option("pathGlobFilter", glob).text(path)
    return read.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def read_blocks(spark: SparkSession, path: str, glob: str) -> tuple[list[list[str]], DataFrame, bool]:
    """The distinct headers (their cells) of the CSV files under ``path``; their records as (header,
    chain, place, named, text); whether records cross blocks, which ``joined`` then puts together."""
    reachable(spark)
    lines = _lines(spark, path, glob)
    found = lines.mapInArrow(_states, BLOCK).collect()
    if len(found) > MAX_BLOCKS:
        raise ValueError(f"{path} has more than {MAX_BLOCKS} blocks: raise spark.sql.files.maxPartitionBytes")
    blocks = Blocks(found)
    headers = [next(csv.reader(io.StringIO(h.lstrip("\ufeff"), newline="")), []) for h in blocks.headers]
    return headers, lines.mapInArrow(_records(spark.sparkContext.broadcast(blocks)), RECORD), blocks.crossing


def joined(held: DataFrame) -> DataFrame:
    """The fragments of ``held`` as (header, whole): whole records, put together in the order of their blocks."""
    parts = held.where(F.col("chain").isNotNull()).groupBy("chain").agg(F.max("header").alias("header"), F.max("named").alias("named"), F.sort_array(F.collect_list(F.struct("place", "fragment"))).alias("parts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(h, x) for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x in at_returns(text)]
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.int32()), pa.array([x for _, x in found], pa.string())], names=["header", "whole"])

    return parts.where(~F.col("named")).select("header", F.array_join(F.col("parts.fragment"), "\n").alias("whole")).mapInArrow(cut, "header int, whole string")
