"""Commits over several history tables (S7): versioned manifests, published by an atomic rename.

A writer puts its rows under a partition of their own (``commit=<id>``) in each table, then
publishes a manifest ``_commits/<version>.json`` that names all commits that count, the new one too.
A manifest is written aside and renamed to the next version, which fails if another writer has
taken it: the writer then adds its commit to that one's list and tries the version after. Readers take
the newest manifest and prune all other partitions, so they see whole commits over all tables,
and what a killed writer left is never seen. ``compact`` replaces many small commits by one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMMIT = "commit"


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, root: str) -> tuple[int, list[str]]:
    """The newest version and its commits; (0, []) before the first."""
    folder, fs = _hadoop(spark, f"{root}/_commits")
    if not fs.exists(folder):
        return 0, []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    versions = sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())
    if not versions:
        return 0, []
    stream = fs.open(_hadoop(spark, f"{root}/_commits/{versions[-1]:020d}.json")[0])
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return versions[-1], json.loads(text)["commits"]


def _publish(spark: SparkSession, root: str, version: int, commits: list[str]) -> bool:
    """Makes ``commits`` the manifest of ``version``; False if another writer has that version."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    aside, fs = _hadoop(spark, f"{root}/_commits/.{uuid.uuid4().hex}.tmp")
    out = fs.create(aside, False)
    try:
        out.write(json.dumps({"commits": commits}).encode())
    finally:
        out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    to = _hadoop(spark, f"{root}/_commits/{version:020d}.json")[0]
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(aside), fs.makeQualified(to), options)
        return True
    except Py4JJavaError as exc:
        fs.delete(aside, False)
        if "FileAlreadyExists" in str(exc.java_exception.getClass().getName()):
            return False
        raise


def change(spark: SparkSession, root: str, step: Callable[[list[str]], list[str]]) -> int:
    """Publishes ``step`` of the newest commits, as often as other writers come first."""
    while True:
        version, commits = manifest(spark, root)
        if _publish(spark, root, version + 1, step(commits)):
            return version + 1


def _write(tables: dict[str, tuple[DataFrame, list[str]]], root: str) -> str:
    commit = uuid.uuid4().hex
    for name, (rows, partitions) in tables.items():
        rows.write.partitionBy(*partitions).parquet(f"{root}/{name}/{COMMIT}={commit}")  # a folder of its own: writers share nothing
    return commit


def append(spark: SparkSession, tables: dict[str, tuple[DataFrame, list[str]]], root: str) -> int:
    """Rows of several tables (rows, partition columns) as one commit; its version."""
    commit = _write(tables, root)
    return change(spark, root, lambda commits: [*commits, commit])


def read(spark: SparkSession, root: str, name: str, schema, commits: list[str] | None = None) -> DataFrame:
    """The rows of a table that the newest manifest (or ``commits``) counts; none yet is an empty table."""
    commits = manifest(spark, root)[1] if commits is None else commits
    if not commits:
        return spark.createDataFrame([], schema)
    whole = spark.read.schema(T.StructType([*schema.fields, T.StructField(COMMIT, T.StringType())])).parquet(f"{root}/{name}")
    return whole.where(F.col(COMMIT).isin(commits)).drop(COMMIT)


def compact(spark: SparkSession, root: str, tables: dict[str, tuple[object, list[str]]], least: int = 20) -> bool:
    """Rewrites the counted commits as one, when there are ``least`` or more; (schema, partition
    columns) per table. Commits that others add meanwhile stay; files of old ones stay for readers that
    began before. Returns whether it rewrote."""
    old = manifest(spark, root)[1]
    if len(old) < least:
        return False
    rows = {name: (read(spark, root, name, schema, old).repartition(*partitions), partitions) for name, (schema, partitions) in tables.items()}
    commit = _write(rows, root)

    def swap(commits: list[str]) -> list[str]:
        if not set(old) <= set(commits):  # another one has compacted them
            return commits
        return [commit, *[c for c in commits if c not in set(old)]]

    change(spark, root, swap)
    return True
