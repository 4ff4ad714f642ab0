"""Batch jobs over files.

``clean_path`` reads a CSV, cleans it and writes the cleaned CSV, returning the
run summary with the table metrics. ``ingest`` is the whole upload job: check
the name, archive the raw file, clean, write the report table and the JSON
summary, and append the run to the history tables. Every step is a Spark job;
the driver only holds the summary (a few numbers and one profile entry per
column).
"""

from __future__ import annotations

import os
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tabletidy.operators.report import report_table
from tabletidy.plans.cleaning import CleanResult, clean, table_metrics
from tabletidy.sources.files import artifact_stem, is_csv_name, landing_copy, read_csv, write_csv, write_summary_json
from tabletidy.sources.tables import append_run, profile_records, run_record


def clean_path(
    spark: SparkSession, src: str, dst: str, drop_duplicates: bool = True, top_values: int = 3
) -> tuple[dict[str, Any], CleanResult]:
    """CSV in → cleaned CSV out; returns (summary with table metrics, result)."""
    raw = read_csv(spark, src)
    res = clean(raw, drop_duplicates=drop_duplicates, top_values=top_values)
    try:
        write_csv(res.cleaned, dst)
    finally:
        res.release()
    summary = dict(res.summary)
    summary.update(table_metrics(res.stats, res.cleaned.schema))
    return summary, res


@dataclass
class IngestResult:
    run_id: str
    raw_file: str
    cleaned_file: str
    report_file: str
    json_summary: str
    summary: dict[str, Any]
    recorded: bool
    runs: DataFrame | None = None  # the history rows, when the caller is to append them
    profiles: DataFrame | None = None


def ingest(
    spark: SparkSession,
    src: str,
    root: str,
    user_email: str | None = None,
    drop_duplicates: bool = True,
    run_id: str | None = None,
    record: bool = True,
) -> IngestResult:
    """I8: one uploaded CSV through the whole job, artifacts under ``root``.

    Layout: ``raw/<stem>_<id>.csv`` (S8), ``cleaned/<stem>_<id>_cleaned`` (S4),
    ``reports/<stem>_<id>_report`` (R9 as CSV), ``reports/<stem>_<id>_summary.json``
    (S5), and the ``runs`` / ``profiles`` history tables (S7). With ``record=False`` the
    history rows come back for the caller to append (one append for many uploads).
    """
    name = os.path.basename(src.rstrip("/"))
    if not is_csv_name(name):
        raise ValueError(f"only CSV files are accepted: {name!r}")
    root = root.rstrip("/")
    rid, raw_file = landing_copy(spark, src, f"{root}/raw", run_id)
    stem = artifact_stem(name, rid)
    cleaned_file = f"{root}/cleaned/{stem}_cleaned"
    report_file = f"{root}/reports/{stem}_report"
    json_file = f"{root}/reports/{stem}_summary.json"
    summary, _ = clean_path(spark, src, cleaned_file, drop_duplicates)
    profiles = profile_records(spark, rid, summary)
    runs = run_record(spark, rid, summary, user_email, name, raw_file, cleaned_file, report_file, json_file)
    write_csv(report_table(profiles, runs, generated_at=True).orderBy("column"), report_file)
    write_summary_json(spark, summary, json_file)
    recorded = append_run(runs, profiles, root) if record else False
    return IngestResult(rid, raw_file, cleaned_file, report_file, json_file, summary, recorded, runs, profiles)
