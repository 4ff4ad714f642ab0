"""Dirty inputs derived from the driver tables, in Spark and as DuckDB SQL text.

The driver's tables are clean, so the registered queries run on deterministic
rewrites of them: every row is kept; only cell values are replaced by
placeholders or nulls at fixed key residues. The Spark builders and the SQL texts
state the same rules so both engines see identical inputs (FIXTURES.md §3).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: the three dtype labels cycled through by the synthetic profiles.
DTYPE_CYCLE = ("int64", "float64", "object")
# --- fixed values: number of columns each synthetic run profiles.
SYNTH_COLUMNS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dirty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    money = F.col("value").cast("decimal(18,2)").cast("string")
    return e.select(
        eid.alias("event_id"),
        F.when(eid % 11 != 0, F.col("user_id")).alias("user_id"),
        F.when(eid % 13 == 0, F.lit(" N/A ")).otherwise(F.col("event_type")).alias("event_type"),
        F.when(eid % 7 == 0, F.lit("?")).when(eid % 29 == 1, F.lit("abc")).otherwise(money).alias("value_txt"),
        F.when(eid % 5 != 0, (eid % 100).cast("string")).otherwise(F.lit("x")).alias("code_txt"),
        F.when(eid % 17 != 0, F.col("ts")).alias("ts"),
        F.lit("--").alias("blank"),
    )


DIRTY_EVENTS_SQL = """
SELECT event_id,
       CASE WHEN event_id % 11 <> 0 THEN user_id END AS user_id,
       CASE WHEN event_id % 13 = 0 THEN ' N/A ' ELSE event_type END AS event_type,
       CASE WHEN event_id % 7 = 0 THEN '?'
            WHEN event_id % 29 = 1 THEN 'abc'
            ELSE CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) END AS value_txt,
       CASE WHEN event_id % 5 <> 0 THEN CAST(event_id % 100 AS VARCHAR) ELSE 'x' END AS code_txt,
       CASE WHEN event_id % 17 <> 0 THEN ts END AS ts,
       '--' AS blank
FROM events
"""


def dirty_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dirty_events(spark, sf_dir).select("event_type", "user_id")


DIRTY_DUPS_SQL = f"SELECT event_type, user_id FROM ({DIRTY_EVENTS_SQL}) de"


def runs_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One synthetic run per order (user = customer key), flat columns."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    original = k % 1000 + 1
    dups = F.least(k % 7, original)
    numeric = k % (SYNTH_COLUMNS + 1)
    return o.select(
        k.cast("string").alias("run_id"),
        F.col("o_orderdate").alias("ingested_at"),
        F.col("o_custkey").cast("string").alias("user_email"),
        F.concat(F.lit("file_"), k.cast("string"), F.lit(".csv")).alias("uploaded_filename"),
        original.alias("original_rows"),
        (original - dups).alias("cleaned_rows"),
        dups.alias("dropped_duplicates"),
        (k % 50).alias("missing_before"),
        (k % 3).alias("missing_after"),
        F.lit(SYNTH_COLUMNS).alias("columns"),
        numeric.cast("int").alias("numeric_cols"),
        (F.lit(SYNTH_COLUMNS) - numeric).cast("int").alias("categorical_cols"),
    )


RUNS_FLAT_SQL = f"""
SELECT CAST(o_orderkey AS VARCHAR) AS run_id,
       o_orderdate AS ingested_at,
       CAST(o_custkey AS VARCHAR) AS user_email,
       'file_' || CAST(o_orderkey AS VARCHAR) || '.csv' AS uploaded_filename,
       o_orderkey % 1000 + 1 AS original_rows,
       o_orderkey % 1000 + 1 - least(o_orderkey % 7, o_orderkey % 1000 + 1) AS cleaned_rows,
       least(o_orderkey % 7, o_orderkey % 1000 + 1) AS dropped_duplicates,
       o_orderkey % 50 AS missing_before,
       o_orderkey % 3 AS missing_after,
       {SYNTH_COLUMNS} AS columns,
       CAST(o_orderkey % {SYNTH_COLUMNS + 1} AS INTEGER) AS numeric_cols,
       CAST({SYNTH_COLUMNS} - o_orderkey % {SYNTH_COLUMNS + 1} AS INTEGER) AS categorical_cols
FROM orders
"""


SUMMARY_FIELDS = (
    "original_rows",
    "cleaned_rows",
    "dropped_duplicates",
    "missing_before",
    "missing_after",
    "columns",
    "numeric_cols",
    "categorical_cols",
)


def runs_synth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The synthetic runs in the ``runs`` table layout (summary as a struct)."""
    flat = runs_flat(spark, sf_dir)
    return flat.select(
        "run_id",
        "ingested_at",
        "user_email",
        "uploaded_filename",
        F.struct(
            *[F.col(c) for c in SUMMARY_FIELDS],
            F.col("missing_before").alias("missing_before_total"),
            F.col("missing_after").alias("missing_after_total"),
        ).alias("summary"),
    )


def profiles_synth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-form before/after profiles, five columns per synthetic run.

    ``(run_id, column, stage)`` is unique; some keys exist in one stage only.
    The (column, stage) pairs come from one ``explode``, not a join or a union,
    so ``orders`` is scanned once.
    """
    runs = runs_flat(spark, sf_dir).select(
        F.col("run_id").cast("long").alias("key"), "run_id", "original_rows", "cleaned_rows"
    )
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(st).alias("stage")) for k in range(SYNTH_COLUMNS) for st in ("before", "after")])
    per = runs.select("*", F.inline(pairs))
    key, k = F.col("key"), F.col("k")
    before = F.col("stage") == "before"
    exists = F.when(before, (key + k) % 13 != 0).otherwise((key * 3 + k) % 17 != 0)
    rows = F.when(before, F.col("original_rows")).otherwise(F.col("cleaned_rows"))
    missing = F.when(before, (key * 7 + k * 11) % F.col("original_rows")).otherwise(
        F.least((key + k) % 3, F.col("cleaned_rows"))
    )
    dtype = F.element_at(F.array(*[F.lit(d) for d in DTYPE_CYCLE]), (k % 3 + 1).cast("int"))
    both = per.where(exists).select(
        "run_id",
        F.concat(F.lit("c"), k.cast("string")).alias("column"),
        "stage",
        k.cast("int").alias("ordinal"),
        rows.alias("rows"),
        missing.alias("missing_count"),
        dtype.alias("dtype"),
    )
    return both.select(
        "run_id",
        "column",
        "stage",
        "ordinal",
        F.col("missing_count").cast("long").alias("missing_count"),
        F.lit(0).cast("long").alias("type_issues"),
        F.col("missing_count").cast("long").alias("total_issues"),
        F.coalesce(
            F.bround(F.try_divide(F.col("missing_count").cast("double"), F.col("rows").cast("double")) * 100.0, 2),
            F.lit(0.0),
        ).alias("missing_pct"),
        "dtype",
        (F.col("rows") - F.col("missing_count")).cast("long").alias("unique_count"),
    )


PROFILES_SYNTH_SQL = f"""
WITH r AS (
  SELECT o_orderkey AS key, CAST(o_orderkey AS VARCHAR) AS run_id,
         o_orderkey % 1000 + 1 AS original_rows,
         o_orderkey % 1000 + 1 - least(o_orderkey % 7, o_orderkey % 1000 + 1) AS cleaned_rows
  FROM orders
), pc AS (
  SELECT r.*, k FROM r, range(0, {SYNTH_COLUMNS}) t(k)
), st AS (
  SELECT run_id, 'c' || CAST(k AS VARCHAR) AS "column", 'before' AS stage, CAST(k AS INTEGER) AS ordinal,
         original_rows AS rows, (key * 7 + k * 11) % original_rows AS missing_count, k
  FROM pc WHERE (key + k) % 13 <> 0
  UNION ALL
  SELECT run_id, 'c' || CAST(k AS VARCHAR), 'after', CAST(k AS INTEGER),
         cleaned_rows, least((key + k) % 3, cleaned_rows), k
  FROM pc WHERE (key * 3 + k) % 17 <> 0
)
SELECT run_id, "column", stage, ordinal,
       CAST(missing_count AS BIGINT) AS missing_count,
       CAST(0 AS BIGINT) AS type_issues,
       CAST(missing_count AS BIGINT) AS total_issues,
       coalesce(round_even(CAST(missing_count AS DOUBLE) / NULLIF(CAST(rows AS DOUBLE), 0) * 100.0, 2), 0.0) AS missing_pct,
       CASE k % 3 WHEN 0 THEN '{DTYPE_CYCLE[0]}' WHEN 1 THEN '{DTYPE_CYCLE[1]}' ELSE '{DTYPE_CYCLE[2]}' END AS dtype,
       CAST(rows - missing_count AS BIGINT) AS unique_count
FROM st
"""


# The dirty events after a CSV round trip (S4 then S1): the CSV reader types an
# integer column with nulls as double and leaves timestamps as text.
EVENTS_CSV_SQL = f"""
SELECT event_id, CAST(user_id AS DOUBLE) AS user_id, event_type, value_txt, code_txt,
       strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, blank
FROM ({DIRTY_EVENTS_SQL}) de
"""
