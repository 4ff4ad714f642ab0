"""Helpers shared by the training-data operators.

Conventions of every operator in this package:

* it selects the columns it needs first, so extra columns (also ones whose names
  clash with a result column) never disturb it;
* a null text counts as the empty text unless its docstring says otherwise;
* rows that repeat a ``doc_id`` are rows of their own, and each comes back;
* an empty table gives an empty result of the same schema;
* intermediate results that are read more than once are written to the shared
  folder of ``spark.checkpoint.dir`` and read again, so a lost executor costs the
  rest of its stage only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

from tabletidy.session import reachable
from tabletidy.sources.staging import scratch_path

#: The white space that separates words in every contract.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in this application's folder below the one that driver and executors share
    (``tabletidy.sources.staging.release`` gives the whole folder back)."""
    reachable(spark)
    return scratch_path(spark, f"llm-{label}")


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read again: lineage is cut there."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer if ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most`` bytes of text, so that a task's memory follows
    the longest text and not the batch (one longer text is a slice of its own)."""
    for batch in batches:
        lengths = [x or 0 for x in pa.compute.binary_length(batch.column(column)).to_pylist()]
        start = total = 0
        for i, n in enumerate(lengths):
            if i > start and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(lengths):
            yield batch.slice(start)


def map_rows(df: DataFrame, text: str, schema: str, rows: Callable[[pa.RecordBatch], pa.RecordBatch], done: Callable[[], None] | None = None) -> DataFrame:
    """``mapInArrow`` over bounded slices of ``df``; ``rows`` turns one slice into result rows, and
    ``done`` gives back what it held at the end of a task."""
    reachable(df.sparkSession)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, at):
            out = rows(part)
            if out.num_rows:
                yield out
        if done:
            done()

    return df.mapInArrow(run, schema)
