"""Report tables, before/after joins and quality metrics (J*, R*, M*, P11-P13)."""

import pytest
from pyspark.sql import functions as F

from tabletidy.operators import report as R
from tabletidy.plans.cleaning import clean
from tabletidy.sources.tables import profile_records, run_record


def test_f4_report_row(spark):
    prof = spark.createDataFrame(
        [("id", 0.0, 0, "int64", 3, [1, 2, 3])],
        "column string, missing_pct double, missing_count bigint, dtype string, unique_count bigint, sample_values array<bigint>",
    )
    rows = R.profile_report(prof).collect()
    assert [tuple(r) for r in rows] == [("id", 0.0, 0, "int64", 3, "1, 2, 3")]


def test_f7_profile_report_and_truncation(spark):
    prof = spark.createDataFrame(
        [("id", 0.0, 0, "float64", 5, ["1.0", "2.0", "3.0"]), ("name", 20.0, 1, "object", 4, ["Alice", "Bob"]), ("long", 0.0, 0, "object", 3, ["x" * 150, "y" * 150])],
        "column string, missing_pct double, missing_count bigint, dtype string, unique_count bigint, sample_values array<string>",
    )
    got = {r["column"]: r["examples"] for r in R.profile_report(prof).collect()}
    assert got["name"] == "Alice, Bob"
    assert len(got["long"]) == 200 and got["long"].endswith("...") and got["long"].startswith("x" * 150)


@pytest.fixture()
def demo_run(spark):
    """F8: 5 rows in, 5 out, no duplicates; column a goes 20 % -> 0 %."""
    rows = [(1.0, "p"), (None, "q"), (3.0, "r"), (4.0, "s"), (5.0, "t")]
    res = clean(spark.createDataFrame(rows, "a double, b string"))
    profiles = profile_records(spark, "r1", res.summary)
    runs = run_record(spark, "r1", res.summary, "u@x", "demo.csv")
    return res, profiles, runs


def test_f8_summary_before_after(spark, demo_run):
    res, profiles, runs = demo_run
    s = res.summary
    assert (s["original_rows"], s["cleaned_rows"], s["dropped_duplicates"]) == (5, 5, 0)
    rep = {r["column"]: r for r in R.report_table(profiles, runs).collect()}
    assert rep["a"]["pct_before"] == 20.0 and rep["a"]["pct_after"] == 0.0
    assert rep["a"]["original_rows"] == 5 and rep["a"]["dropped_duplicates"] == 0
    stamped = R.report_table(profiles, runs, generated_at=True).collect()
    assert all(r["generated_at"] is not None for r in stamped)


def _profiles(spark):
    # r1: a in both stages, b only before, c only after; r2: a both, fully fixed
    rows = [
        ("r1", "a", "before", 0, 4, 0, 4, 40.0, "float64", 6),
        ("r1", "a", "after", 0, 1, 0, 1, 10.0, "float64", 7),
        ("r1", "b", "before", 1, 2, 0, 2, 20.0, "object", 3),
        ("r1", "c", "after", 2, 3, 0, 3, 30.0, "object", 2),
        ("r2", "a", "before", 0, 5, 0, 5, 50.0, "int64", 5),
        ("r2", "a", "after", 0, 0, 0, 0, 0.0, "int64", 5),
    ]
    return spark.createDataFrame(
        rows,
        "run_id string, column string, stage string, ordinal int, missing_count bigint, type_issues bigint, "
        "total_issues bigint, missing_pct double, dtype string, unique_count bigint",
    )


def test_j1_j2_j3_full_outer(spark):
    pairs = R.stage_pairs(_profiles(spark))
    j1 = {(r["run_id"], r["column"]): tuple(r)[2:] for r in R.missing_comparison(pairs).collect()}
    assert j1 == {
        ("r1", "a"): (4, 40.0, 1, 10.0, 3),
        ("r1", "b"): (2, 20.0, 0, 0.0, 2),
        ("r1", "c"): (0, 0.0, 3, 30.0, -3),
        ("r2", "a"): (5, 50.0, 0, 0.0, 5),
    }
    j2 = {(r["run_id"], r["column"]): r["status"] for r in R.status_comparison(pairs).collect()}
    assert j2 == {("r1", "a"): "Partial", ("r1", "b"): "Fixed", ("r1", "c"): "Partial", ("r2", "a"): "Fixed"}
    j3 = {(r["run_id"], r["column"]): r["improvement"] for r in R.pct_comparison(pairs).collect()}
    assert j3 == {("r1", "a"): 30.0, ("r1", "b"): 20.0, ("r1", "c"): -30.0, ("r2", "a"): 50.0}


def test_j4_j5(spark):
    p = _profiles(spark)
    j4 = {(r["run_id"], r["column"]): r["missing_after"] for r in R.after_lookup(p).collect()}
    assert j4 == {("r1", "a"): 1, ("r1", "b"): 0, ("r2", "a"): 0}
    j5 = {(r["run_id"], r["column"]): (r["pct_before"], r["pct_after"]) for r in R.report_rows(p).collect()}
    assert j5[("r1", "c")] == (None, 30.0) and j5[("r1", "b")] == (20.0, None) and len(j5) == 4


def test_reshapes(spark):
    pairs = R.stage_pairs(_profiles(spark))
    melt = R.melt_pct(R.pct_comparison(pairs))
    assert melt.count() == 8 and set(r["variable"] for r in melt.collect()) == {"pct_before", "pct_after"}
    cps = R.counts_per_stage(R.missing_comparison(pairs)).where("run_id = 'r1' AND column = 'a'")
    assert sorted((r["stage"], r["count"]) for r in cps.collect()) == [("After", 1), ("Before", 4)]
    comp = {(r["run_id"], r["column"]): r["quality_score"] for r in R.completeness(R.pct_comparison(pairs)).collect()}
    assert comp[("r1", "a")] == 90.0
    ranked = R.rank_within_run(R.completeness(R.pct_comparison(pairs)), F.col("quality_score").asc(), F.col("column"))
    assert [r["column"] for r in ranked.where("run_id = 'r1'").orderBy("rank").collect()] == ["c", "a", "b"]


def _runs(spark):
    from tabletidy.sources.files import SUMMARY_SCHEMA
    from tabletidy.sources.tables import RUNS_SCHEMA

    def summ(o, c, d, mb, ma, cols=4, num=2):
        return {"original_rows": o, "cleaned_rows": c, "dropped_duplicates": d, "missing_before": mb, "missing_after": ma,
                "columns": cols, "numeric_cols": num, "categorical_cols": cols - num}

    import datetime as dt

    from tabletidy.sources.files import summary_row

    data = [
        ("r1", dt.datetime(2024, 1, 1), "u1", "a.csv", summ(100, 90, 10, 40, 0)),
        ("r2", dt.datetime(2024, 1, 2), "u1", "b.csv", summ(100, 99, 1, 0, 0)),
        ("r3", dt.datetime(2024, 1, 3), "u2", None, summ(0, 0, 0, 0, 0)),
        ("r4", dt.datetime(2024, 1, 4), "u2", "d.csv", summ(50, 50, 0, 10, 12)),
    ]
    assert SUMMARY_SCHEMA
    rows = [(rid, at, u, f, None, None, None, None, summary_row(s)) for rid, at, u, f, s in data]
    return spark.createDataFrame(rows, RUNS_SCHEMA)


def test_metrics_and_issue_list(spark):
    runs = _runs(spark)
    m = {r["run_id"]: r for r in R.run_metrics(runs).collect()}
    assert m["r1"]["missing_before_pct"] == 10.0 and m["r1"]["quality_after"] == 100.0
    assert m["r1"]["cells_fixed"] == 40 and m["r1"]["quality_improvement_pct"] == 100.0
    assert m["r1"]["issues_resolved"] == 50 and m["r1"]["rows_removed"] == 10 and m["r1"]["rows_retained_pct"] == 90.0
    assert m["r3"]["rows_retained_pct"] is None and m["r3"]["missing_before_pct"] == 0.0  # zero guards
    assert m["r1"]["quality_band"] == "Excellent"
    issues = {(r["run_id"], r["issue"]): (r["count"], r["severity"]) for r in R.issue_list(runs).collect()}
    assert issues == {
        ("r1", "Duplicate Rows"): (10, "HIGH"),
        ("r1", "Missing Values"): (40, "MEDIUM"),
        ("r2", "Duplicate Rows"): (1, "MEDIUM"),
        ("r4", "Missing Values"): (10, "LOW"),
    }
    fr = {(r["run_id"], r["label"]): r["value"] for r in R.fixed_vs_remaining(runs).collect()}
    assert fr == {("r1", "Fixed"): 40, ("r1", "Remaining"): 0, ("r4", "Fixed"): -2, ("r4", "Remaining"): 12}
    stages = {(r["run_id"], r["stage"]): r["rows"] for r in R.rows_per_stage(runs).collect()}
    assert stages[("r1", "After Duplicate Removal")] == 90
    kinds = {(r["run_id"], r["kind"]): r["count"] for r in R.column_types(runs).collect()}
    assert kinds[("r1", "Numeric")] == 2 and kinds[("r1", "Categorical")] == 2


def test_history(spark):
    from tabletidy.operators import history as H

    runs = _runs(spark)
    k = H.kpis(runs).first()
    assert (k["runs"], k["total_cleaned_rows"], k["total_duplicates"], k["total_issues_fixed"]) == (4, 239, 11, 38)
    assert k["avg_improvement"] == 100.0  # only r1 qualifies (before > 0 and after <= before)
    lst = {r["run_id"]: r for r in H.listing(runs).collect()}
    assert lst["r3"]["file_name"] == "Unknown" and lst["r1"]["short_id"] == "r1"
    assert [r["run_id"] for r in H.latest_runs(runs, "u1").collect()] == ["r2", "r1"]
    assert {r["user_email"]: r["processing_count"] for r in H.runs_per_user(runs).collect()} == {"u1": 2, "u2": 2}
    assert [r["run_id"] for r in H.ordered_history(runs, H.SORT_OLDEST, 2).collect()] == ["r1", "r2"]
    assert [r["run_id"] for r in H.ordered_history(runs, H.SORT_LARGEST, None).collect()] == ["r1", "r2", "r4", "r3"]
    assert H.user_runs(runs, "u2").count() == 2
    d = H.run_detail(runs, "r4").collect()
    assert len(d) == 1 and d[0]["summary"]["missing_after"] == 12 and d[0]["quality_improvement"] == -20.0
