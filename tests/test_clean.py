"""Cleaning (P2, P5, D1, I1-I6, A9, A12-A16) on the reference cases and the edge rules."""

import datetime as dt
import math
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabletidy.operators.impute import column_modes, exact_medians
from tabletidy.plans.cleaning import CleaningPlan, clean, fit, transform


def _rows(df, order=None):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_f3_clean_fill(spark):
    rows = [(1, "Alice", 25.0), (2, "UNKNOWN", None), (3, "ERROR", 30.0), (4, "Diana", 35.0)]
    res = clean(spark.createDataFrame(rows, "id bigint, name string, age double"))
    s = res.summary
    assert s["missing_before_total"] == 3 and s["missing_after_total"] == 0
    assert s["missing_before"] == 3 and s["missing_after"] == 0 and s["columns"] == 3
    out = _rows(res.cleaned, ["id"])
    assert out == [(1, "Alice", 25.0), (2, "Alice", 30.0), (3, "Alice", 30.0), (4, "Diana", 35.0)]
    res.release()


def test_f5_clean_demo(spark):
    t1, t2 = dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 2)
    rows = [(1.0, "x", None), (2.0, None, t1), (None, "y", None), (2.0, "x", t2), (1.0, "x", None)]
    res = clean(spark.createDataFrame(rows, "a double, b string, c timestamp"))
    assert res.summary["dropped_duplicates"] == 1 and res.summary["cleaned_rows"] == 4
    by_b = sorted(_rows(res.cleaned), key=lambda r: (r[0], r[1], r[2]))
    # a: median of 1, 2, 2 -> 2.0; b: mode x; c: earliest 2020-01-01
    assert by_b == sorted([(1.0, "x", t1), (2.0, "x", t1), (2.0, "y", t1), (2.0, "x", t2)])


def test_g2_g3_all_null_columns(spark):
    df = spark.createDataFrame([(None, None), (None, "N/A"), (None, None)], "n double, s string")
    res = clean(df, drop_duplicates=False)
    assert _rows(res.cleaned) == [(0.0, "Unknown")] * 3
    # Q1: 'Unknown' is itself a placeholder, so missing_after is not 0 ...
    assert res.summary["missing_after"] == 3
    # ... while the after profile is forced to 0
    assert all(r["missing_count"] == 0 for r in res.profile_after)
    honest = clean(df, drop_duplicates=False, honest_after=True)
    assert {r["column"]: r["missing_count"] for r in honest.profile_after} == {"n": 0, "s": 3}


def test_g4_median_g5_mode(spark):
    df = spark.createDataFrame([(1.0, "A"), (2.0, "B"), (None, None), (4.0, "A"), (5.0, "B"), (6.0, "B")], "s double, t string")
    plan = fit(df)
    fills = {c.name: c.fill_value for c in plan.columns}
    assert fills == {"s": 4.0, "t": "B"}
    df4 = spark.createDataFrame([(1.0,), (2.0,), (None,), (4.0,), (5.0,)], "s double")
    assert fit(df4).columns[0].fill_value == 3.0


def test_g6_duplicates(spark):
    res = clean(spark.createDataFrame([(1, 4), (2, 5), (1, 4)], "a bigint, b bigint"))
    assert res.summary["cleaned_rows"] == 2 and res.summary["dropped_duplicates"] == 1
    assert sorted(_rows(res.cleaned)) == [(1, 4), (2, 5)]


def test_g7_g8_numeric_text(spark):
    res = clean(spark.createDataFrame([("1",), ("2",), ("3",)], "mixed string"))
    assert _rows(res.cleaned, ["mixed"]) == [(1.0,), (2.0,), (3.0,)]
    res2 = clean(spark.createDataFrame([("1",), ("2",), ("NA",)], "partial string"))
    assert _rows(res2.cleaned, ["partial"]) == [(1.0,), (1.5,), (2.0,)]


def test_g11_datetime(spark):
    rows = [(dt.datetime(2020, 1, 1),), (dt.datetime(2020, 12, 31),), (None,)]
    res = clean(spark.createDataFrame(rows, "s timestamp"))
    assert sorted(r[0] for r in _rows(res.cleaned)) == [dt.datetime(2020, 1, 1)] * 2 + [dt.datetime(2020, 12, 31)]


def test_g12_constant_rows_dedup(spark):
    """The stated 100k x 50 shape, scaled to 2k rows: every row equal -> one row survives."""
    df = spark.range(2000).select(*[F.lit(7).cast("bigint").alias(f"c{i}") for i in range(50)])
    res = clean(df)
    assert res.summary["cleaned_rows"] == 1 and res.summary["dropped_duplicates"] == 1999
    kept = clean(df, drop_duplicates=False)
    assert kept.summary["cleaned_rows"] == 2000


def test_type_issue_value_becomes_median(spark):
    rows = [(str(v),) for v in [1, 2, 3, 4, 5, 6, 7, 8, 9]] + [("abc",)]
    res = clean(spark.createDataFrame(rows, "n string"))
    assert res.summary["missing_before"] == 1  # one type issue, no missing cell
    vals = sorted(r[0] for r in _rows(res.cleaned))
    assert vals == sorted([1.0, 2, 3, 4, 5, 6, 7, 8, 9, 5.0])


def test_bool_with_nulls_becomes_double(spark):
    res = clean(spark.createDataFrame([(True,), (False,), (None,), (True,)], "b boolean"), drop_duplicates=False)
    assert sorted(r[0] for r in _rows(res.cleaned)) == [0.0, 1.0, 1.0, 1.0]


def test_nan_is_missing_and_skipped(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,)], "f double")
    res = clean(df, drop_duplicates=False)
    assert res.summary["missing_before"] == 2
    assert sorted(r[0] for r in _rows(res.cleaned)) == [1.0, 2.0, 2.0, 3.0]


def test_placeholder_spellings_merge_in_dedup(spark):
    rows = [("x", "N/A"), ("x", "unknown"), ("x", None), ("1", "a"), ("1.0", "a")]
    res = clean(spark.createDataFrame(rows, "k string, v string"))
    assert res.summary["dropped_duplicates"] == 2  # the three missing spellings merge; "1" vs "1.0" do not


def test_plan_json_roundtrip_and_transform_new_data(spark):
    df = spark.createDataFrame([(1.0, "a", dt.datetime(2021, 5, 1)), (None, None, None), (3.0, "a", None)], "x double, s string, t timestamp")
    plan = fit(df)
    again = CleaningPlan.from_json(plan.to_json())
    assert again == plan
    new = spark.createDataFrame([(None, "N/A", None)], "x double, s string, t timestamp")
    assert _rows(transform(new, again)) == [(2.0, "a", dt.datetime(2021, 5, 1))]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_exact_median_bracket_narrowing(spark, seed):
    """Forced narrowing rounds (tiny bracket) still give numpy's exact median."""
    rng = np.random.default_rng(seed)
    n = 20001 + seed
    heavy = rng.integers(0, 50, size=n).astype(float)  # few distinct values, heavy ties
    wide = rng.normal(size=n)
    wide[rng.random(n) < 0.05] = np.nan
    pdf = [(float(a), None if math.isnan(b) else float(b)) for a, b in zip(heavy, wide)]
    df = spark.createDataFrame(pdf, "heavy double, wide double").repartition(8)
    got = exact_medians(df, ["heavy", "wide"], accuracy=1000)
    assert got["heavy"] == float(np.median(heavy))
    assert got["wide"] == pytest.approx(float(np.nanmedian(wide)), abs=0, rel=0)


def test_mode_ties_to_smallest(spark):
    vals = ["b", "a", "b", "a", "c", None]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    assert column_modes(df, ["s"]) == {"s": "a"}


def test_random_frames_against_pandas_rules(spark):
    """Differential check: the same dirty frames cleaned by a plain-Python statement of the rules."""
    from rules_oracle import clean_frame

    rng = random.Random(5)
    words = ["a", "b", "c", "N/A", "", " error ", "1", "2.5", "x"]
    for _ in range(4):
        n = rng.randint(5, 40)
        rows = []
        for i in range(n):
            rows.append(
                (
                    rng.choice([None, float(rng.randint(0, 5)), float("nan")]),
                    rng.choice(words + [None]),
                    rng.choice(["1", "2", "3", "4", "x", None, "NA"]),
                    rng.choice([None, 1, 2, 3]),
                )
            )
        df = spark.createDataFrame(rows, "f double, s string, n string, i bigint")
        res = clean(df, honest_after=True)
        expect_rows, expect_summary = clean_frame(rows, ["f", "s", "n", "i"])
        got = sorted(tuple(r) for r in res.cleaned.collect())
        assert got == sorted(expect_rows)
        for k in ("original_rows", "cleaned_rows", "dropped_duplicates", "missing_before", "missing_after"):
            assert res.summary[k] == expect_summary[k], k
        res.release()


@pytest.mark.parametrize("heavy_at", [5.0, 9.5])
def test_exact_median_with_a_third_of_rows_on_one_value(spark, heavy_at):
    """A value holding a third of the column at (or away from) the median cannot stall the search."""
    rng = np.random.default_rng(3)
    vals = np.concatenate([np.full(9000, heavy_at), rng.uniform(0, 10, size=18001)])
    df = spark.createDataFrame([(float(v),) for v in vals], "x double").repartition(8)
    got = exact_medians(df, ["x"], accuracy=500)
    assert got["x"] == float(np.median(vals))


def test_e9_per_column_placeholder_override(spark):
    """'error' can be a real category: a per-column set keeps it, other columns keep the default."""
    from tabletidy.functions import PLACEHOLDERS
    from tabletidy.operators.profile import profile

    rows = [("click", "error"), ("error", "ok"), ("error", "ok"), ("view", None)]
    df = spark.createDataFrame(rows, "event_type string, note string")
    keep_error = {"event_type": [p for p in PLACEHOLDERS if p != "error"]}
    prof = {r["column"]: r["missing_count"] for r in profile(df, placeholders=keep_error).collect()}
    assert prof == {"event_type": 0, "note": 2}
    res = clean(df, drop_duplicates=False, placeholders=keep_error)
    assert sorted(r["event_type"] for r in res.cleaned.collect()) == ["click", "error", "error", "view"]
    assert sorted(r["note"] for r in res.cleaned.collect()) == ["ok"] * 4
    again = CleaningPlan.from_json(res.plan.to_json())
    assert again.placeholders == {"event_type": keep_error["event_type"]}
    # the default treats 'error' as missing everywhere
    assert {r["column"]: r["missing_count"] for r in profile(df).collect()}["event_type"] == 2


def test_e7_narrow_integers_opt_in(spark):
    df = spark.createDataFrame([("1",), ("2",), (" 3 ",)], "n string")
    assert dict(clean(df).cleaned.dtypes)["n"] == "double"  # default: always double
    res = clean(df, narrow_integers=True)
    assert dict(res.cleaned.dtypes)["n"] == "bigint" and sorted(r[0] for r in res.cleaned.collect()) == [1, 2, 3]
    assert {r["column"]: r["dtype"] for r in res.profile_after} == {"n": "int64"}
    for vals in (["1", "2", "NA"], ["1", "2.0", "3"], ["1", "1e5", "3"]):
        d = spark.createDataFrame([(v,) for v in vals], "n string")
        assert dict(clean(d, narrow_integers=True).cleaned.dtypes)["n"] == "double", vals
    plan = fit(df, narrow_integers=True)
    assert CleaningPlan.from_json(plan.to_json()).columns[0].narrow is True


def test_clean_with_sketched_distinct_counts(spark):
    """approx_unique changes only the profiles' distinct counts."""
    from tabletidy.fixtures import dirty_events

    de = dirty_events(spark, "/root/testdata/sf0.001")
    exact = clean(de, order_by="event_id")
    approx = clean(de, order_by="event_id", approx_unique=0.01)
    assert sorted(tuple(r) for r in exact.cleaned.collect()) == sorted(tuple(r) for r in approx.cleaned.collect())
    for k in ("original_rows", "cleaned_rows", "dropped_duplicates", "missing_before", "missing_after", "columns"):
        assert exact.summary[k] == approx.summary[k], k
    for side in ("profile_before", "profile_after"):
        e = {r["column"]: r for r in getattr(exact, side)}
        a = {r["column"]: r for r in getattr(approx, side)}
        for c in e:
            for key in ("missing_count", "type_issues", "total_issues", "missing_pct", "dtype", "sample_values"):
                assert e[c][key] == a[c][key], (side, c, key)
            assert abs(e[c]["unique_count"] - a[c]["unique_count"]) <= max(2, 0.05 * e[c]["unique_count"])
    exact.release()
    approx.release()


def test_timestamp_fill_keeps_the_column_type(spark):
    """A wall-clock (NTZ) column stays NTZ after the earliest-value fill."""
    rows = [(dt.datetime(2020, 1, 1, 5),), (None,), (dt.datetime(2020, 6, 1),)]
    df = spark.createDataFrame(rows, "t timestamp_ntz")
    res = clean(df, drop_duplicates=False)
    assert dict(res.cleaned.dtypes)["t"] == "timestamp_ntz"
    assert sorted(r[0] for r in res.cleaned.collect()) == [dt.datetime(2020, 1, 1, 5)] * 2 + [dt.datetime(2020, 6, 1)]


def _after_by_both(spark, df, **kw):
    """The after profile as ``clean`` derives it, and as a whole profile of the cleaned table gives it."""
    from tabletidy.operators.profile import ORD, PROFILE_COLUMNS, profile_rows
    from tabletidy.plans import cleaning as C

    placeholders = kw.get("placeholders", C.PLACEHOLDERS)
    res = clean(df, honest_after=True, **kw)
    whole = C.apply_fills(C._prepared(df, res.plan, kw.get("order_by"), keep_order=True), res.plan)
    assert ORD in whole.columns
    rows = profile_rows(whole, 3, placeholders)
    res.release()
    return res.profile_after, [{k: r[k] for k in PROFILE_COLUMNS} for r in rows]


@pytest.mark.parametrize("seed", range(3))
def test_after_profile_by_algebra(spark, seed):
    """Distinct counts of the cleaned table follow from the before profile and the plan."""
    rng = random.Random(seed)
    pick = lambda *xs: rng.choice(xs)
    rows = [
        (
            i,
            pick("1", "1.0", " 2", "2.50", "2.5", "x", "NA", "7", "8", "9", "1e1", "10"),  # texts that become equal numbers
            pick("red", "blue", "N/A", "", "12", None),
            pick(None, 1, 2, 4),
            pick(None, 2**53, 2**53 + 1, 5),  # become equal as doubles
            pick(None, float("nan"), 0.0, -0.0, 1.5),
            pick(None, True, False),
            pick(None, Decimal("1.10"), Decimal("2.00")),
            pick(None, dt.date(2020, 1, 1), dt.date(2021, 1, 1)),
            None,
            pick("NA", "n/a"),
            pick(None, float("nan")),
        )
        for i in (rng.randrange(30) for _ in range(40))
    ]
    schema = "k int, numeric string, colour string, small int, big long, f double, b boolean, d decimal(9,2), day date, none int, blank string, gaps float"
    df = spark.createDataFrame(rows, schema)
    for kw in ({"order_by": "k"}, {"order_by": "k", "drop_duplicates": False}, {"order_by": "k", "placeholders": {"blank": ["na", "n/a"], "colour": ["n/a"]}}):
        derived, whole = _after_by_both(spark, df, **kw)
        assert derived == whole, kw


def test_after_profile_by_algebra_no_rows(spark):
    df = spark.createDataFrame([], "a string, b int, c double")
    derived, whole = _after_by_both(spark, df)
    assert derived == whole and [r["unique_count"] for r in derived] == [0, 0, 0]


def test_after_profile_groups_only_cells_that_may_merge(spark, monkeypatch):
    """Columns without gaps, texts, dates and filled doubles are not grouped a second time."""
    from tabletidy.plans import cleaning as C

    grouped = []
    real = C.frequency_table
    monkeypatch.setattr(C, "frequency_table", lambda df, exclude, columns, *a, **kw: grouped.append(columns) or real(df, exclude, columns, *a, **kw))
    clean(spark.createDataFrame([("a", 1, 1.0), ("b", 2, None), ("b", 2, 3.0)], "t string, n long, f double")).release()
    assert grouped == []
    clean(spark.createDataFrame([("1", 1), ("2", None), ("NA", 3)], "t string, n long")).release()
    assert grouped == [["t", "n"]]
