"""The ``runs`` and ``profiles`` tables (S7): run history as appended parquet.

``runs`` holds one row per cleaning run (summary as a struct) and is partitioned
by ingest date, so history queries filtered on time prune files. ``profiles``
holds the before/after column profiles in long form, one row per
``(run_id, column, stage)``, partitioned by stage and ingest date; report joins
(J1-J5) group or join it on ``(run_id, column)``.
"""

from __future__ import annotations

import datetime as _dt
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabletidy.sources import commits
from tabletidy.sources.files import SUMMARY_SCHEMA, summary_row

log = logging.getLogger("tabletidy")

RUNS_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("ingested_at", T.TimestampType()),
        T.StructField("user_email", T.StringType()),
        T.StructField("uploaded_filename", T.StringType()),
        T.StructField("raw_file", T.StringType()),
        T.StructField("cleaned_file", T.StringType()),
        T.StructField("report_file", T.StringType()),
        T.StructField("json_summary", T.StringType()),
        T.StructField("summary", SUMMARY_SCHEMA),
    ]
)

PROFILES_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("column", T.StringType()),
        T.StructField("stage", T.StringType()),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("missing_count", T.LongType()),
        T.StructField("type_issues", T.LongType()),
        T.StructField("total_issues", T.LongType()),
        T.StructField("missing_pct", T.DoubleType()),
        T.StructField("dtype", T.StringType()),
        T.StructField("unique_count", T.LongType()),
        T.StructField("sample_values", T.ArrayType(T.StringType())),
    ]
)


def run_record(
    spark: SparkSession,
    run_id: str,
    summary: dict,
    user_email: str | None = None,
    uploaded_filename: str | None = None,
    raw_file: str | None = None,
    cleaned_file: str | None = None,
    report_file: str | None = None,
    json_summary: str | None = None,
    ingested_at: _dt.datetime | None = None,
) -> DataFrame:
    """One run as a one-row DataFrame in the ``runs`` layout."""
    at = ingested_at or _dt.datetime.now(_dt.timezone.utc)
    if at.tzinfo is None:  # naive times are UTC, whatever the driver's zone
        at = at.replace(tzinfo=_dt.timezone.utc)
    row = (run_id, at, user_email, uploaded_filename, raw_file, cleaned_file, report_file, json_summary, summary_row(summary))
    return spark.createDataFrame([row], RUNS_SCHEMA)


def profile_records(spark: SparkSession, run_id: str, summary: dict) -> DataFrame:
    """The run's two profile lists in long form (one row per column and stage)."""
    rows = []
    for stage, key in (("before", "missing_summary_before"), ("after", "missing_summary_after")):
        for e in summary.get(key) or []:
            rows.append(
                (
                    run_id,
                    e["column"],
                    stage,
                    e.get("ordinal"),
                    e.get("missing_count"),
                    e.get("type_issues"),
                    e.get("total_issues"),
                    e.get("missing_pct"),
                    e.get("dtype"),
                    e.get("unique_count"),
                    list(e.get("sample_values") or []),
                )
            )
    return spark.createDataFrame(rows, PROFILES_SCHEMA)


FAILURES_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("failed_at", T.TimestampType()),
        T.StructField("path", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


def append_run(runs: DataFrame, profiles: DataFrame, root: str) -> bool:
    """Append runs and their profiles to ``<root>/runs`` and ``<root>/profiles`` as one commit.

    Readers see both or neither (``commits``), whatever stops the writer; several may write at once.
    As in the reference a failure to record history is logged and does not fail
    the run; returns whether the commit succeeded.
    """
    try:
        append_runs(runs, profiles, root)
        return True
    except Exception as exc:  # noqa: BLE001 - history is best effort, as in the reference
        log.warning("could not record run history: %s", exc)
        return False


def append_runs(runs: DataFrame, profiles: DataFrame, root: str) -> None:
    """S7 for the runs of one micro-batch: one commit; a failure is raised, so the batch is tried again."""
    day = F.to_date("ingested_at")
    at = runs.select("run_id", day.alias("ingest_date"))  # a row per run of the batch
    tables = {
        "profiles": (profiles.join(F.broadcast(at), "run_id"), _PARTITIONS["profiles"]),
        "runs": (runs.withColumn("ingest_date", day), _PARTITIONS["runs"]),
    }
    commits.append(runs.sparkSession, tables, root)


def compact_history(spark: SparkSession, root: str, least: int = 20) -> bool:
    """The small files of many runs rewritten, once ``least`` commits have gathered."""
    return commits.compact(spark, root, {"runs": (_runs_schema(), _PARTITIONS["runs"]), "profiles": (_profiles_schema(), _PARTITIONS["profiles"])}, least)


def append_failures(spark: SparkSession, rows: list[tuple[str, str, str]], root: str) -> None:
    """Uploads that could not be cleaned: (run_id, path, error) appended to ``<root>/failures``."""
    now = _dt.datetime.now(_dt.timezone.utc)
    spark.createDataFrame([(r, now, p, e) for r, p, e in rows], FAILURES_SCHEMA).write.mode("append").parquet(f"{root}/failures")


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def read_failures(spark: SparkSession, root: str) -> DataFrame:
    """Failed uploads; none yet is an empty table."""
    if not _exists(spark, f"{root}/failures"):
        return spark.createDataFrame([], FAILURES_SCHEMA)
    return spark.read.schema(FAILURES_SCHEMA).parquet(f"{root}/failures")


def recorded(spark: SparkSession, root: str, run_ids: list[str]) -> set[str]:
    """Which of the runs are in ``runs`` or ``failures`` already."""
    found = {r[0] for r in read_runs(spark, root).where(F.col("run_id").isin(run_ids)).select("run_id").collect()}
    return found | {r[0] for r in read_failures(spark, root).where(F.col("run_id").isin(run_ids)).select("run_id").collect()}


_PARTITIONS = {"runs": ["ingest_date"], "profiles": ["stage", "ingest_date"]}


def _runs_schema() -> T.StructType:
    return T.StructType(RUNS_SCHEMA.fields + [T.StructField("ingest_date", T.DateType())])


def _profiles_schema() -> T.StructType:
    return T.StructType(PROFILES_SCHEMA.fields + [T.StructField("ingest_date", T.DateType())])


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """The runs of all commits; none yet is an empty table."""
    return commits.read(spark, root, "runs", _runs_schema())


def read_profiles(spark: SparkSession, root: str) -> DataFrame:
    """The profiles of the runs that ``read_runs`` shows."""
    return commits.read(spark, root, "profiles", _profiles_schema())
