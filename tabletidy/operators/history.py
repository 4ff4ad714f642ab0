"""Run-history queries over the ``runs`` table.

The table holds one row per cleaning run with its summary as a struct; it is
appended to by the batch and streaming jobs (``sources.runs``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: defaults the history listing shows for absent fields, and the UI sort choices.
DEFAULT_FILENAME, DEFAULT_RUN_ID = "Unknown", "N/A"
SORT_RECENT, SORT_OLDEST, SORT_LARGEST = "Most Recent", "Oldest First", "Largest File"


def _s(field: str) -> Column:
    return F.col(f"summary.{field}")


def _improvement(mb: Column, ma: Column) -> Column:
    """M5: (before − after) / before × 100, 0 when nothing was missing."""
    return F.when(mb > 0, (mb - ma) / mb * 100.0).otherwise(F.lit(0.0))


def kpis(runs: DataFrame) -> DataFrame:
    """H1 + H2: run count, totals, and the mean improvement of improving runs."""
    mb = F.coalesce(_s("missing_before"), F.lit(0))
    ma = F.coalesce(_s("missing_after"), F.lit(0))
    improving = (mb > 0) & (ma <= mb)
    return runs.agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum(F.coalesce(_s("cleaned_rows"), F.lit(0))).cast("long").alias("total_cleaned_rows"),
        F.sum(F.coalesce(_s("dropped_duplicates"), F.lit(0))).cast("long").alias("total_duplicates"),
        F.sum(mb - ma).cast("long").alias("total_issues_fixed"),
        F.avg(F.when(improving, (mb - ma) / mb * 100.0)).alias("avg_improvement"),
    )


def listing(runs: DataFrame, *more: str) -> DataFrame:
    """H3: one display row per run; absent fields get the reference's defaults."""
    mb = F.coalesce(_s("missing_before"), F.lit(0))
    ma = F.coalesce(_s("missing_after"), F.lit(0))
    return runs.select(
        "run_id",
        "ingested_at",
        F.coalesce(F.col("uploaded_filename"), F.lit(DEFAULT_FILENAME)).alias("file_name"),
        F.substring(F.coalesce(F.col("run_id"), F.lit(DEFAULT_RUN_ID)), 1, 12).alias("short_id"),
        F.coalesce(_s("original_rows"), F.lit(0)).cast("long").alias("original_rows"),
        F.coalesce(_s("cleaned_rows"), F.lit(0)).cast("long").alias("cleaned_rows"),
        F.coalesce(_s("dropped_duplicates"), F.lit(0)).cast("long").alias("duplicates"),
        F.coalesce(_s("columns"), F.lit(0)).cast("long").alias("columns"),
        _improvement(mb, ma).alias("quality_improvement"),
        *more,
    )


def run_detail(runs: DataFrame, run_id: str) -> DataFrame:
    """H3 detail: one run by key, with its listing fields and whole summary."""
    return listing(runs.where(F.col("run_id") == F.lit(run_id)), "summary")


def user_runs(runs: DataFrame, user_email: str | Column) -> DataFrame:
    """H4: the runs of one user (a filter; Catalyst pushes it to the scan)."""
    u = user_email if isinstance(user_email, Column) else F.lit(user_email)
    return runs.where(F.col("user_email") == u)


def latest_runs(runs: DataFrame, user_email: str | Column, limit: int = 50) -> DataFrame:
    """Newest runs of a user first, at most ``limit`` (a top-k: TakeOrderedAndProject)."""
    return user_runs(runs, user_email).orderBy(F.col("ingested_at").desc(), F.col("run_id").desc()).limit(limit)


def runs_per_user(runs: DataFrame) -> DataFrame:
    """H5: how many runs each user made (map-side partial counts)."""
    return runs.groupBy("user_email").agg(F.count(F.lit(1)).alias("processing_count"))


def ordered_history(runs: DataFrame, sort_by: str = SORT_RECENT, limit: int | None = 20) -> DataFrame:
    """The history in one of the UI orders, optionally the first ``limit`` runs."""
    if sort_by == SORT_RECENT:
        order = [F.col("ingested_at").desc(), F.col("run_id").desc()]
    elif sort_by == SORT_OLDEST:
        order = [F.col("ingested_at").asc(), F.col("run_id").asc()]
    elif sort_by == SORT_LARGEST:
        order = [_s("original_rows").desc(), F.col("run_id").asc()]
    else:
        raise ValueError(f"unknown order {sort_by!r}")
    out = runs.orderBy(*order)
    return out.limit(limit) if limit is not None else out
