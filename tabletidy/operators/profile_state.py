"""Mergeable profile state (A4, A7, A8): a profile of a growing table without rescanning it.

A part of a table (a day's files, an upload) leaves one row per column: counts, a HyperLogLog sketch
of the distinct values, and the first values by the table's order. Rows of several parts merge
into those of all parts together, in any grouping, so the state of an appended table is the
merge of the old state and the new part's. States are plain tables: keep them as Parquet.

Counts, types, issues and samples of a merged state are exact. ``unique_count`` is an estimate with
a relative standard error of ``UNIQUE_ERROR``, whether the parts were merged or the whole table was
sketched at once (the two estimates may differ within it).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabletidy.functions.predicates import PLACEHOLDERS, Placeholders, dtype_label
from tabletidy.operators.profile import PROFILE_COLUMNS, _fields, _with_verdicts, first_found, stats_frame

#: log2 of the sketch's registers, and the relative standard error that follows (1.04 / sqrt(registers)).
REGISTERS = 12
UNIQUE_ERROR = 1.04 / 2 ** (REGISTERS / 2)

KEYS = ("column", "ordinal", "kind", "label_nulls", "label_plain")
COUNTS = ("rows", "missing_count", "null_count", "numeric_ok")


def profile_state(df: DataFrame, part: int = 0, top_values: int = 3, placeholders: Placeholders = PLACEHOLDERS, order_by: str | None = None) -> DataFrame:
    """The state of one part: a row per column, from one pass over the part plus its samples'.

    ``part`` numbers the parts in the table's order; with ``order_by`` the samples of all parts
    go by that key instead. No cells are shuffled: a task sends one row. A column that
    the merge finds under another type is another column.
    """
    spark = df.sparkSession
    fields = _fields(df, None)
    stats = stats_frame(df, placeholders, registers=REGISTERS)
    key = T.LongType() if order_by is None else df.schema[order_by].dataType
    sample = T.StructType([T.StructField("part", T.LongType()), T.StructField("none", T.BooleanType()), T.StructField("key", key), T.StructField("value", T.StringType())])
    rows = []
    for i, values in first_found(df, top_values, placeholders, order_by).items():
        if order_by is None:  # in scan order a place within the part is enough
            rows.append((i, [(part, False, j, v) for j, (_, v) in enumerate(values)]))
        else:
            rows.append((i, [(0, k["none"], k["key"], v) for k, v in values]))
    samples = spark.createDataFrame(rows, T.StructType([T.StructField("ordinal", T.IntegerType()), T.StructField("samples", T.ArrayType(sample))]))
    labels = spark.createDataFrame([(i, dtype_label(f.dataType, True), dtype_label(f.dataType, False)) for i, f in fields], "ordinal int, label_nulls string, label_plain string")
    # one row per column on all sides: bounded by the table's width
    joined = stats.join(F.broadcast(samples), "ordinal").join(F.broadcast(labels), "ordinal")
    return joined.select(*KEYS, *COUNTS, "sketch", "samples")


def merge_states(states: DataFrame, top_values: int = 3) -> DataFrame:
    """States of any parts (their union) as the state of all of them together: a row per column.

    What moves is a sketch and a few values per column and part; the first values are found
    among those by distinct value, so no list of all parts is ever held.
    """
    one = states.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in COUNTS], F.hll_union_agg("sketch").alias("sketch"))
    values = states.select("column", "ordinal", "kind", F.explode("samples").alias("s"))
    least = values.groupBy("column", "ordinal", "kind", F.col("s.value").alias("value")).agg(F.min(F.struct("s.part", "s.none", "s.key")).alias("k"))
    w = Window.partitionBy("column", "ordinal", "kind").orderBy("k", "value")
    first = least.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= top_values)
    again = first.groupBy("column", "ordinal", "kind").agg(F.sort_array(F.collect_list(F.struct("k.part", "k.none", "k.key", "value"))).alias("samples"))
    empty = F.array().cast(states.schema["samples"].dataType)
    return one.join(again, ["column", "ordinal", "kind"], "left").select(*KEYS, *COUNTS, "sketch", F.coalesce("samples", empty).alias("samples"))


def profile_from_state(state: DataFrame, sort: str = "total_issues") -> DataFrame:
    """A8 of the table that a merged state stands for (the fields of ``profile``)."""
    base = state.select(
        "column",
        "ordinal",
        "kind",
        *COUNTS,
        F.when(F.col("null_count") > 0, F.col("label_nulls")).otherwise(F.col("label_plain")).alias("dtype"),
        F.hll_sketch_estimate("sketch").alias("unique_count"),
        F.col("samples.value").alias("sample_values"),
    )
    return _with_verdicts(base).select(*PROFILE_COLUMNS).orderBy(F.col(sort).desc(), F.col("ordinal"))
