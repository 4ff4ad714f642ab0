"""Mergeable profile states, proven modes, and the passes that samples take."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from tabletidy.operators import impute, profile_state
from tabletidy.operators.profile import PREFIX_ROWS, first_values_scan, profile
from tabletidy.sources.staging import staged

SF = "/root/testdata/sf0.001"


def _rows(df):
    return {r["column"]: r.asDict(recursive=True) for r in df.collect()}


@pytest.mark.parametrize("order", [None, "event_id"])
def test_state_of_an_appended_table(spark, order):
    """Old state and new part, in any grouping, give the profile of the whole table."""
    from tabletidy.fixtures import dirty_events

    de = staged(dirty_events(spark, SF).coalesce(1), "events").coalesce(1)
    parts = [de.where(f"event_id % 3 = {k}") for k in range(3)]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2]) if order is None else de
    states = [staged(profile_state.profile_state(p, i, order_by=order), "state") for i, p in enumerate(parts)]
    old = profile_state.merge_states(states[0].unionByName(states[1]))
    left = _rows(profile_state.profile_from_state(profile_state.merge_states(old.unionByName(states[2]))))
    other = profile_state.merge_states(states[1].unionByName(states[2]))
    right = _rows(profile_state.profile_from_state(profile_state.merge_states(states[0].unionByName(other))))
    exact = _rows(profile(whole, order_by=order))
    assert list(left) == list(exact)
    for c, e in exact.items():
        for key in ("missing_count", "type_issues", "total_issues", "missing_pct", "dtype", "sample_values", "ordinal"):
            assert left[c][key] == right[c][key] == e[key], (c, key)
        for got in (left, right):
            assert abs(got[c]["unique_count"] - e["unique_count"]) <= 4 * profile_state.UNIQUE_ERROR * e["unique_count"] + 1


def test_state_edges(spark):
    """Empty parts, columns without values, float zeros and NaN, one of few values."""
    schema = "a double, b string, c int, d date, e boolean"
    rows = [(0.0, "x", 1, None, True), (-0.0, "N/A", 1, None, None), (float("nan"), None, None, None, False)]
    one, none = spark.createDataFrame(rows, schema).coalesce(1), spark.createDataFrame([], schema)
    states = [profile_state.profile_state(df, i) for i, df in enumerate((none, one, none))]
    got = _rows(profile_state.profile_from_state(profile_state.merge_states(states[0].unionByName(states[1]).unionByName(states[2]))))
    assert got == _rows(profile(one))
    empty = _rows(profile_state.profile_from_state(profile_state.merge_states(states[0].unionByName(states[2]))))
    assert empty == _rows(profile(none))


def test_state_shuffles_no_cells(spark):
    """One wide aggregate: its only exchange carries a row per task."""
    df = spark.range(1000).select("id", F.col("id").cast("string").alias("s"))
    plan = profile_state.profile_state(df)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Python" not in plan


def _mode(values):
    counts = {}
    for v in values:
        if v is not None:
            counts[v] = counts.get(v, 0) + 1
    return min(counts, key=lambda v: (-counts[v], v)) if counts else None


def test_modes_proven_and_counted(spark, monkeypatch):
    """Skewed and tied columns are proven by two passes; nearly unique ones fall to the frequency table."""
    r = random.Random(2)
    n = 6000
    columns = {
        "skewed": [f"v{int(r.paretovariate(0.7)) % 500}" for _ in range(n)],
        "tied": [f"t{i % 40:02d}" for i in range(n)],
        "unique": [uuid.UUID(int=r.getrandbits(128)).hex for _ in range(n)],
        "nearly": [f"u{i}" if i else "u77" for i in range(n)],
        "null": [None] * n,
        "some": ["a" if i % 9 == 0 else None for i in range(n)],
        "`odd`": ["x", "y"] * (n // 2),
    }
    names = list(columns)
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"`{c.replace('`', '``')}` string" for c in names)).repartition(5)
    df = df.toDF(*[c.replace("`", "") for c in names])
    names = df.columns
    want = dict(zip(names, map(_mode, columns.values())))
    proven = impute.proven_modes(df, names)
    assert {"skewed", "tied", "null", "some", "odd"} <= set(proven)
    assert all(proven[c] == want[c] for c in proven)
    assert impute.column_modes(df, names) == want
    # a sketch far smaller than the columns: fewer proofs, the same modes
    monkeypatch.setattr(impute, "TRACKED", 50)
    monkeypatch.setattr(impute, "SKETCH_ERROR", 3.5 / 50)
    monkeypatch.setattr(impute, "CANDIDATES", 20)
    assert "tied" not in impute.proven_modes(df, names)
    assert impute.column_modes(df, names) == want


def test_median_of_an_input_that_changes(spark):
    """A probe without values raises in place of searching for ever."""
    df = spark.range(100).select(F.when(F.rand(1) < 2, None).otherwise(F.col("id")).cast("double").alias("v"))
    with pytest.raises(RuntimeError, match="changed between two passes"):
        impute.exact_medians(df, ["v"], counts={"v": 100})


def test_samples_beyond_the_first_rows(spark):
    """Values that show up late, never, or tied at the edge of the first rows."""
    n = 3 * PREFIX_ROWS
    rows = [(i // 5, "same", None if i < n - 3 else f"late{i}", f"k{i % 2}", "z" if i != 2 * PREFIX_ROWS else "a", f"t{n - i}") for i in range(n)]
    df = spark.createDataFrame(rows, "k int, const string, late string, two string, rare string, many string").coalesce(1)
    want = [["same"], [f"late{n - 3}", f"late{n - 2}", f"late{n - 1}"], ["k0", "k1"], ["z", "a"]]
    scan = {r["ordinal"]: r["sample_values"] for r in first_values_scan(df).collect()}
    assert [scan[i] for i in range(1, 5)] == want and scan[5] == [f"t{n}", f"t{n - 1}", f"t{n - 2}"]
    exact = {r["ordinal"]: r["sample_values"] for r in profile(df, order_by="k").collect()}
    assert {r["ordinal"]: r["sample_values"] for r in first_values_scan(df.repartition(4), order_by="k").collect()} == exact
