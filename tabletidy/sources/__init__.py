"""Sources and sinks: CSV scan/sink, JSON summaries, landing copy, run-history tables."""

from tabletidy.sources.files import (
    CSV_GLOB,
    CSV_NA_TOKENS,
    SUMMARY_SCHEMA,
    dedupe_names,
    infer_csv_types,
    is_csv_name,
    landing_copy,
    read_csv,
    read_csv_text,
    read_summaries,
    summary_frame,
    write_csv,
    write_summary_json,
)
from tabletidy.sources.tables import (
    PROFILES_SCHEMA,
    RUNS_SCHEMA,
    append_run,
    profile_records,
    read_failures,
    read_profiles,
    read_runs,
    run_record,
)

__all__ = [
    "CSV_GLOB",
    "CSV_NA_TOKENS",
    "PROFILES_SCHEMA",
    "RUNS_SCHEMA",
    "SUMMARY_SCHEMA",
    "append_run",
    "dedupe_names",
    "infer_csv_types",
    "is_csv_name",
    "landing_copy",
    "profile_records",
    "read_csv",
    "read_csv_text",
    "read_failures",
    "read_profiles",
    "read_runs",
    "read_summaries",
    "run_record",
    "summary_frame",
    "write_csv",
    "write_summary_json",
]
