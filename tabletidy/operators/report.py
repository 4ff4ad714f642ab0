"""Before/after comparisons, report tables and quality metrics (J*, R*, M*, P11-P13).

Inputs are the long ``profiles`` table (``run_id, column, stage, ...``; one row
per run, column and stage) and the ``runs`` table (``summary`` struct), so every
report covers all runs at once; one run is the special case of a filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["run_id", "column"]

# --- fixed values: report labels and thresholds shown by the dashboard.
SEVERITY_HIGH, SEVERITY_MEDIUM, SEVERITY_LOW = "HIGH", "MEDIUM", "LOW"
STATUS_FIXED, STATUS_PARTIAL = "Fixed", "Partial"
BAND_EXCELLENT, BAND_GOOD, BAND_WARNING = "Excellent", "Good", "Needs attention"
ISSUE_DUPLICATES, ISSUE_MISSING = "Duplicate Rows", "Missing Values"
STATUS_REMOVED, STATUS_FILLED = "REMOVED", "FILLED"
STAGE_ORIGINAL, STAGE_DEDUPED, STAGE_FINAL = "Original Data", "After Duplicate Removal", "Final Cleaned"


def _s(field: str) -> Column:
    return F.col(f"summary.{field}")


# ---------------------------------------------------------------- predicates
def duplicate_severity(dups: Column, original_rows: Column) -> Column:
    """P11 (duplicates): HIGH above 5 % of the rows, else MEDIUM."""
    return F.when(dups > original_rows * 0.05, SEVERITY_HIGH).otherwise(SEVERITY_MEDIUM)


def missing_severity(missing_pct: Column) -> Column:
    """P11 (missing): HIGH above 20 %, MEDIUM above 5 %, else LOW."""
    return F.when(missing_pct > 20, SEVERITY_HIGH).when(missing_pct > 5, SEVERITY_MEDIUM).otherwise(SEVERITY_LOW)


def fix_status(count_after: Column) -> Column:
    """Fixed when nothing is missing after cleaning, else Partial."""
    return F.when(count_after == 0, STATUS_FIXED).otherwise(STATUS_PARTIAL)


def quality_band(quality_after: Column) -> Column:
    """Excellent ≥ 95, Good ≥ 85, else a warning."""
    return F.when(quality_after >= 95, BAND_EXCELLENT).when(quality_after >= 85, BAND_GOOD).otherwise(BAND_WARNING)


# ---------------------------------------------------------------- joins
def stage_pairs(profiles: DataFrame) -> DataFrame:
    """Both stages of each ``(run_id, column)`` side by side (the J1-J3 full outer join).

    Both sides live in one table, so the outer join is a conditional aggregate:
    one shuffle on the key instead of two shuffles and two sorts. Absent stages
    come back null; callers apply the reference's 0 defaults.
    """
    b = F.col("stage") == "before"
    a = F.col("stage") == "after"
    return profiles.groupBy(*KEYS).agg(
        F.max(F.when(b, F.col("missing_count"))).alias("count_before"),
        F.max(F.when(b, F.col("missing_pct"))).alias("pct_before"),
        F.max(F.when(b, F.col("dtype"))).alias("dtype_before"),
        F.max(F.when(b, F.col("unique_count"))).alias("unique_before"),
        F.max(F.when(a, F.col("missing_count"))).alias("count_after"),
        F.max(F.when(a, F.col("missing_pct"))).alias("pct_after"),
        F.max(F.when(a, F.col("dtype"))).alias("dtype_after"),
        F.max(F.when(b, F.col("ordinal"))).alias("ordinal_before"),
        F.max(F.when(a, F.col("ordinal"))).alias("ordinal_after"),
    )


def _z(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0)).cast("long")


def _zd(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0)).cast("double")


def missing_comparison(pairs: DataFrame) -> DataFrame:
    """Counts and shares before/after, absent → 0, ``fixed`` = before − after."""
    return pairs.select(
        *KEYS,
        _z("count_before").alias("missing_before"),
        _zd("pct_before").alias("pct_before"),
        _z("count_after").alias("missing_after"),
        _zd("pct_after").alias("pct_after"),
        (_z("count_before") - _z("count_after")).alias("fixed"),
    )


def status_comparison(pairs: DataFrame) -> DataFrame:
    """J1 plus type, distinct count and the fix status."""
    return pairs.select(
        *KEYS,
        F.col("dtype_before").alias("dtype"),
        _z("count_before").alias("missing_before"),
        _zd("pct_before").alias("pct_before"),
        _z("unique_before").alias("unique_count"),
        _z("count_after").alias("missing_after"),
        _zd("pct_after").alias("pct_after"),
        (_z("count_before") - _z("count_after")).alias("fixed"),
        fix_status(_z("count_after")).alias("status"),
    )


def pct_comparison(pairs: DataFrame) -> DataFrame:
    """Shares before/after with ``improvement = round(before − after, 2)``."""
    return pairs.select(
        *KEYS,
        F.col("dtype_before").alias("dtype"),
        _z("unique_before").alias("unique_count"),
        _zd("pct_before").alias("pct_before"),
        _zd("pct_after").alias("pct_after"),
        F.bround(_zd("pct_before") - _zd("pct_after"), 2).alias("improvement"),
    )


def after_lookup(profiles: DataFrame) -> DataFrame:
    """Every before row with its after count looked up, absent → 0 (one scan, one shuffle)."""
    pairs = stage_pairs(profiles).where(F.col("ordinal_before").isNotNull() | F.col("count_before").isNotNull())
    return pairs.select(
        *KEYS,
        F.col("count_before").alias("missing_before"),
        "pct_before",
        _z("count_after").alias("missing_after"),
        _zd("pct_after").alias("pct_after"),
    )


def report_rows(profiles: DataFrame) -> DataFrame:
    """The union of both key sets with each side looked up.

    Missing sides stay null (the reference prints an empty cell). The rows' order inside
    a run is L5: ``rank_within_run(rows, F.col("column"))``.
    """
    return stage_pairs(profiles).select(*KEYS, "pct_before", "pct_after", "dtype_after")


# ---------------------------------------------------------------- orderings
def rank_within_run(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Position of each column inside its run for an ordering.

    The window is partitioned by run, so each partition holds one run's columns.
    """
    return df.withColumn(name, F.row_number().over(Window.partitionBy("run_id").orderBy(*order)))


# ---------------------------------------------------------------- reshapes
def melt_pct(pct_cmp: DataFrame) -> DataFrame:
    """before/after shares in long form ``(run_id, column, variable, value)``."""
    return pct_cmp.select(*KEYS, "pct_before", "pct_after").unpivot(
        KEYS, ["pct_before", "pct_after"], "variable", "value"
    )


def counts_per_stage(missing_cmp: DataFrame) -> DataFrame:
    """R2: two rows per column: ``(run_id, column, stage, count)``."""
    return missing_cmp.select(
        *KEYS, F.col("missing_before").alias("Before"), F.col("missing_after").alias("After")
    ).unpivot(KEYS, ["Before", "After"], "stage", "count")


def rows_per_stage(runs: DataFrame) -> DataFrame:
    """Row counts through the stages of each run."""
    return runs.select(
        "run_id",
        F.inline(
            F.array(
                F.struct(F.lit(STAGE_ORIGINAL).alias("stage"), _s("original_rows").cast("long").alias("rows")),
                F.struct(
                    F.lit(STAGE_DEDUPED).alias("stage"),
                    (_s("original_rows") - _s("dropped_duplicates")).cast("long").alias("rows"),
                ),
                F.struct(F.lit(STAGE_FINAL).alias("stage"), _s("cleaned_rows").cast("long").alias("rows")),
            )
        ),
    )


def fixed_vs_remaining(runs: DataFrame) -> DataFrame:
    """Issues fixed vs remaining per run (runs with issues), with their share."""
    mb, ma = _s("missing_before"), _s("missing_after")
    return (
        runs.where(mb > 0)
        .select(
            "run_id",
            F.inline(
                F.array(
                    F.struct(F.lit("Fixed").alias("label"), (mb - ma).cast("long").alias("value")),
                    F.struct(F.lit("Remaining").alias("label"), ma.cast("long").alias("value")),
                )
            ),
            mb.alias("_total"),
        )
        .select("run_id", "label", "value", (F.col("value") / F.col("_total") * 100.0).alias("share"))
    )


def column_types(runs: DataFrame) -> DataFrame:
    """Numeric vs categorical column counts per run."""
    return runs.select(
        "run_id",
        F.inline(
            F.array(
                F.struct(F.lit("Numeric").alias("kind"), _s("numeric_cols").cast("long").alias("count")),
                F.struct(F.lit("Categorical").alias("kind"), _s("categorical_cols").cast("long").alias("count")),
            )
        ),
    )


def completeness(pct_cmp: DataFrame) -> DataFrame:
    """R7 + M9: completeness (100 − missing %) before and after, quality score per column."""
    return pct_cmp.select(
        *KEYS,
        (100.0 - F.col("pct_before")).alias("completeness_before"),
        (100.0 - F.col("pct_after")).alias("completeness_after"),
        (100.0 - F.col("pct_after")).alias("quality_score"),
    )


def issue_list(runs: DataFrame) -> DataFrame:
    """Per run the non-zero issues with count, share, severity (P11) and status."""
    issues = F.array(
        F.struct(
            F.lit(ISSUE_DUPLICATES).alias("issue"),
            F.col("dropped_duplicates").cast("long").alias("count"),
            F.col("duplicate_pct").alias("percentage"),
            duplicate_severity(F.col("dropped_duplicates"), F.col("original_rows")).alias("severity"),
            F.lit(STATUS_REMOVED).alias("status"),
        ),
        F.struct(
            F.lit(ISSUE_MISSING).alias("issue"),
            F.col("missing_before").cast("long").alias("count"),
            F.col("missing_before_pct").alias("percentage"),
            missing_severity(F.col("missing_before_pct")).alias("severity"),
            F.lit(STATUS_FILLED).alias("status"),
        ),
    )
    return run_metrics(runs).select("run_id", F.inline(issues)).where(F.col("count") > 0)


def report_table(profiles: DataFrame, runs: DataFrame, generated_at: bool = False) -> DataFrame:
    """The before/after report rows of every run with its header figures.

    The header (rows, duplicates, and with ``generated_at`` the UTC time the
    report was made) is one row per run; it joins on ``run_id``.
    """
    head = runs.select(
        "run_id",
        _s("original_rows").alias("original_rows"),
        _s("cleaned_rows").alias("cleaned_rows"),
        _s("dropped_duplicates").alias("dropped_duplicates"),
        *([F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).alias("generated_at")] if generated_at else []),
    )
    # dealt by run once: the pairs group inside it and the header joins without another shuffle
    return report_rows(profiles.repartition("run_id")).join(head, "run_id", "left")


def profile_report(profile: DataFrame, max_chars: int = 200) -> DataFrame:
    """One report row per profiled column; examples joined, long text shortened."""
    ex = F.array_join(F.col("sample_values").cast("array<string>"), ", ")
    short = F.when(F.length(ex) > max_chars, F.concat(F.substring(ex, 1, max_chars - 3), F.lit("..."))).otherwise(ex)
    return profile.select(
        "column",
        "missing_pct",
        "missing_count",
        "dtype",
        "unique_count",
        short.alias("examples"),
    )


# ---------------------------------------------------------------- metrics
def run_metrics(runs: DataFrame) -> DataFrame:
    """M1-M8, M10 per run from its summary."""
    orig, cleaned = _s("original_rows"), _s("cleaned_rows")
    dups, cols = _s("dropped_duplicates"), _s("columns")
    mb, ma = _s("missing_before"), _s("missing_after")
    mb_pct = F.when(orig > 0, mb / (orig * cols) * 100.0).otherwise(F.lit(0.0))
    ma_pct = F.when(cleaned > 0, ma / (cleaned * cols) * 100.0).otherwise(F.lit(0.0))
    q_before, q_after = 100.0 - mb_pct, 100.0 - ma_pct
    return runs.select(
        "run_id",
        orig.alias("original_rows"),
        cleaned.alias("cleaned_rows"),
        dups.alias("dropped_duplicates"),
        mb.alias("missing_before"),
        ma.alias("missing_after"),
        mb_pct.alias("missing_before_pct"),
        ma_pct.alias("missing_after_pct"),
        q_before.alias("quality_before"),
        q_after.alias("quality_after"),
        (q_after - q_before).alias("improvement_points"),
        F.when(q_before > 0, (q_after - q_before) / q_before * 100.0).otherwise(F.lit(0.0)).alias("improvement_relative"),
        F.when(mb > 0, mb - ma).otherwise(F.lit(0)).cast("long").alias("cells_fixed"),
        F.when(mb > 0, (mb - ma) / mb * 100.0).otherwise(F.lit(0.0)).alias("quality_improvement_pct"),
        F.try_divide(cleaned.cast("double"), orig.cast("double")).alias("_ret"),
        F.when(orig > 0, dups / orig * 100.0).otherwise(F.lit(0.0)).alias("duplicate_pct"),
        (dups + (mb - ma)).cast("long").alias("issues_resolved"),
        (orig - cleaned).cast("long").alias("rows_removed"),
        quality_band(q_after).alias("quality_band"),
    ).withColumn("rows_retained_pct", F.col("_ret") * 100.0).drop("_ret")
