"""Quoted CSV in blocks: any block edge gives what a reader of the whole file gives."""

import csv
import glob
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from tabletidy.sources import csv_blocks
from tabletidy.sources.files import read_csv, read_csv_text
from tabletidy.sources.staging import release, scratch_root


def _put(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(text)
    return path


@pytest.fixture()
def small_blocks(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")

    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield use
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


CELLS = ["", "a", "7", 'say "hi"', "x,y", "two\nlines", "\n", "\n\n\n", '"', '""', '"\n"', "a,\nb,\"c\",\n", "é" * 30, "long " * 40, 'q"\n' * 30]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("block", [150, 997, 1 << 20])
def test_any_block_edge(spark, scratch, small_blocks, block, end):
    """A file with newlines, doubled quotes and separators in quotes, cut at every few bytes."""
    small_blocks(block)
    r = random.Random(block)
    rows = [[str(i), r.choice(CELLS), r.choice(CELLS)] for i in range(60)]
    text = io.StringIO()
    csv.writer(text, lineterminator=end).writerows([["k", "a\nname", "b"], *rows])
    path = _put(scratch, "in.csv", text.getvalue())
    got = read_csv_text(spark, path, na_tokens=())
    assert got.columns == ["k", "a\nname", "b"]
    lines = csv_blocks._lines(spark, path, "*.csv")
    assert lines.select("start").distinct().count() > (10 if block < 500 else 0)
    assert sorted((tuple(x or "" for x in row) for row in got.collect()), key=lambda x: int(x[0])) == [tuple(x) for x in rows]


def test_many_tasks_read_one_file(spark, scratch, small_blocks):
    """The parse runs on many blocks of one file, and equals the one-block read."""
    r = random.Random(5)
    text = io.StringIO()
    csv.writer(text).writerows([["k", "v"], *[[i, r.choice(CELLS)] for i in range(3000)]])
    path = _put(scratch, "in.csv", text.getvalue())
    whole = sorted(map(tuple, read_csv(spark, path).collect()), key=repr)
    small_blocks(8192)
    headers, records, crossing = csv_blocks.read_blocks(spark, path, "*.csv")
    assert headers == [["k", "v"]] and crossing
    assert records.select(F.spark_partition_id().alias("p")).distinct().count() > 10
    assert sorted(map(tuple, read_csv(spark, path).collect()), key=repr) == whole


def test_stray_and_open_quotes(spark, scratch, small_blocks):
    """A quote inside a plain cell is text; one that never closes takes the rest of its file only."""
    _put(scratch, "a.csv", 'k,v\n1,5" pipe\n2,"x"y\n3,a"b"\n4,"ok, yes"\n')
    _put(scratch, "b.csv", 'k,v\n5,"open, and\n6,more\n7,x\nend')
    for block in (16, 1 << 20):
        small_blocks(block)
        got = {x[0]: x[1] for x in read_csv_text(spark, scratch, na_tokens=()).collect()}
        assert got["1"] == '5" pipe' and got["3"] == 'a"b"' and got["4"] == "ok, yes" and "2" in got
        assert set(got) == {"1", "2", "3", "4", "5"} and "6,more" in got["5"] and "end" in got["5"]


def test_line_ends_headers_and_blank_lines(spark, scratch, small_blocks):
    _put(scratch, "mac.csv", 'k,v\r1,"a\rb"\r2,c\r')
    _put(scratch, "order.csv", '﻿\r\nv,k\r\n\r\n"d\r\ne",3\r\n\r\n')
    _put(scratch, "only.csv", "k,v")
    _put(scratch, "empty.csv", "")
    _put(scratch, "not.txt", "zzz\n1\n")
    _put(scratch, "UPPER.CSV", "k,v\n4,f")
    for block in (8, 1 << 20):
        small_blocks(block)
        got = {x["k"]: x["v"] for x in read_csv_text(spark, scratch).collect()}
        assert got == {"1": "a\rb", "2": "c", "3": "d\r\ne", "4": "f"}


def test_states():
    """The state after a line, against a reader that walks every character."""
    def walk(line, inside):
        state = "Q" if inside else "S"
        for ch in line:
            if state == "Q":
                state = "E" if ch == '"' else "Q"
            elif state == "E" and ch == '"' or state == "S" and ch == '"':
                state = "Q"
            else:
                state = "S" if ch in ",\r" else "U"
        return state == "Q"

    r = random.Random(1)
    for _ in range(20000):
        line = "".join(r.choice('",a\r') for _ in range(r.randrange(9)))
        for inside in (False, True):
            assert csv_blocks.ends_inside(line, inside) == walk(line, inside)


def test_release(spark, scratch):
    path = _put(scratch, "in.csv", "k\n1\n")
    assert read_csv(spark, path).count() == 1
    root = scratch_root(spark).removeprefix("file:")
    assert glob.glob(f"{root}/*")
    release(spark)
    assert not os.path.exists(root)
