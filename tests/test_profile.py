"""Profiling (A1-A10, A17, A18, P4, L1-L3) on the reference's own cases (FIXTURES §1-2)."""

import datetime as dt

from pyspark.sql import functions as F

from tabletidy.operators.profile import (
    head_preview,
    profile,
    raw_column_info,
    raw_null_pct,
    raw_preview_profile,
    stats_frame,
)


def _by_col(prof_df):
    return {r["column"]: r.asDict(recursive=True) for r in prof_df.collect()}


def test_f1_profile_basic(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (3.0, "x")], "a double, b string")
    p = _by_col(profile(df))
    assert p["a"]["missing_count"] == 1 and p["a"]["unique_count"] == 2
    assert p["b"]["missing_count"] == 2 and p["b"]["unique_count"] == 1
    assert p["a"]["dtype"] == "float64" and p["b"]["dtype"] == "object"


def test_f2_placeholders(spark):
    rows = [(1, "Alice", "Active"), (2, "UNKNOWN", "N/A"), (3, "ERROR", "Inactive"), (4, "Diana", "na")]
    p = _by_col(profile(spark.createDataFrame(rows, "id bigint, name string, status string")))
    assert p["name"]["missing_count"] == 2
    assert p["status"]["missing_count"] == 2
    assert p["id"]["missing_count"] == 0 and p["id"]["dtype"] == "int64"


def test_f6_twenty_percent_each(spark):
    rows = [(1.0, "a", 20.0, "x"), (None, "b", 21.0, "y"), (3.0, None, 22.0, "z"), (4.0, "d", None, "w"), (5.0, "e", 24.0, None)]
    p = _by_col(profile(spark.createDataFrame(rows, "id double, name string, age double, city string")))
    assert {c: r["missing_pct"] for c, r in p.items()} == {"id": 20.0, "name": 20.0, "age": 20.0, "city": 20.0}


def test_g9_percentages(spark):
    rows = [(1.0, None), (None, None), (3.0, 1.0), (None, None), (5.0, 2.0)]
    p = _by_col(profile(spark.createDataFrame(rows, "a double, b double")))
    assert p["a"]["missing_pct"] == 40.0 and p["b"]["missing_pct"] == 60.0


def test_g10_small_summary(spark):
    rows = [(1.0, "a"), (None, "b"), (3.0, None), (4.0, "d")]
    p = profile(spark.createDataFrame(rows, "id double, name string"))
    assert p.agg(F.sum("missing_count")).first()[0] == 2


def test_samples_first_distinct_in_order(spark):
    rows = [(i, v) for i, v in enumerate(["b", "N/A", "a", "b", "c", "a", "d"])]
    p = _by_col(profile(spark.createDataFrame(rows, "k bigint, s string"), order_by="k"))
    assert p["s"]["sample_values"] == ["b", "a", "c"]
    assert p["s"]["unique_count"] == 4
    p5 = _by_col(profile(spark.createDataFrame(rows, "k bigint, s string"), top_values=5, order_by="k"))
    assert p5["s"]["sample_values"] == ["b", "a", "c", "d"]


def test_type_issues_and_sort(spark):
    # 9 numbers + 1 word: 90 % numeric > 80 % -> numeric, one type issue
    rows = [(i, str(i) if i < 9 else "abc", "N/A" if i < 3 else "z") for i in range(10)]
    df = spark.createDataFrame(rows, "k bigint, n string, t string")
    prof = profile(df, order_by="k").collect()
    p = {r["column"]: r for r in prof}
    assert p["n"]["type_issues"] == 1 and p["n"]["total_issues"] == 1
    assert p["t"]["type_issues"] == 0 and p["t"]["total_issues"] == 3
    assert [r["column"] for r in prof] == ["t", "n", "k"]  # L1: total_issues desc, ordinal pins ties
    by_pct = [r["column"] for r in profile(df, order_by="k", sort="missing_pct").collect()]
    assert by_pct == ["t", "k", "n"]


def test_p4_strict_threshold(spark):
    # exactly 80 % numeric is NOT numeric (strict >)
    rows = [(str(i) if i < 8 else "x",) for i in range(10)]
    st = {r["column"]: r for r in stats_frame(spark.createDataFrame(rows, "s string")).collect()}
    assert st["s"]["is_numeric"] is False and st["s"]["type_issues"] == 0


def test_dtype_labels(spark):
    rows = [(1, True, dt.datetime(2020, 1, 1), None, 1), (2, None, None, None, None)]
    df = spark.createDataFrame(rows, "i bigint, b boolean, t timestamp, e string, j int")
    p = _by_col(profile(df))
    assert p["i"]["dtype"] == "int64" and p["b"]["dtype"] == "object"
    assert p["t"]["dtype"] == "datetime64[ns]" and p["e"]["dtype"] == "object" and p["j"]["dtype"] == "float64"


def test_e8_empty_tables(spark):
    empty_rows = spark.createDataFrame([], "a double, b string")
    p = _by_col(profile(empty_rows))
    assert p["a"]["missing_pct"] == 0.0 and p["b"]["unique_count"] == 0
    no_cols = spark.range(3).select()
    assert profile(no_cols).count() == 0


def test_raw_preview_and_info(spark):
    rows = [(1.0, "N/A"), (None, "x"), (3.0, None), (float("nan"), "x")]
    df = spark.createDataFrame(rows, "a double, s string")
    prev = {r["column"]: r for r in raw_preview_profile(df).collect()}
    assert prev["a"]["null_count"] == 2 and prev["a"]["null_pct"] == 50.0
    assert prev["s"]["null_count"] == 1 and prev["s"]["null_pct"] == 25.0  # placeholders are not raw nulls
    info = {r["column"]: r for r in raw_column_info(df).collect()}
    assert info["s"]["unique_count"] == 2  # 'N/A' counts as a value here
    tot = raw_null_pct(df).first()
    assert (tot["rows"], tot["columns"], tot["null_cells"], tot["missing_pct"]) == (4, 2, 3, 37.5)


def test_head_preview(spark):
    df = spark.range(100).select((99 - F.col("id")).alias("k"))
    got = [r["k"] for r in head_preview(df, 10, order_by="k").collect()]
    assert got == list(range(10))


def test_wide_table_stats(spark):
    from tabletidy.operators import profile as P

    rows = [(1, None, "N/A", 2.0, "x", None, 7), (2, 5, "b", None, "y", "z", 7)]
    df = spark.createDataFrame(rows, "a bigint, b bigint, c string, d double, e string, f string, g bigint")
    st = {r["column"]: (r["ordinal"], r["missing_count"], r["dtype"]) for r in P.stats_frame(df).collect()}
    assert st == {
        "a": (0, 0, "int64"), "b": (1, 1, "float64"), "c": (2, 1, "object"), "d": (3, 1, "float64"),
        "e": (4, 0, "object"), "f": (5, 1, "object"), "g": (6, 0, "int64"),
    }
    wide = spark.range(20).select(*[(F.col("id") % (i + 1)).alias(f"c{i}") for i in range(450)])  # one pass, one shape
    assert P.stats_frame(wide).where("missing_count = 0 and is_numeric").count() == 450


def test_profile_is_one_scan_and_one_shuffle_of_cells(spark):
    """No Python, one file scan; the samples reuse the counts' exchange."""
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for order in (None, "event_id"):
        prof = profile(df, order_by=order)
        prof.collect()
        plan = prof._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "MapInPandas" not in plan and "Python" not in plan
        assert plan.count("FileScan") == 1 and "ReusedExchange" in plan, plan


def test_order_keys_keep_their_type(spark):
    """Fractional, text, date and null keys order samples and previews as they are."""
    rows = [(0.9, "d", dt.date(2020, 1, 4), "w"), (0.1, "a", dt.date(2020, 1, 1), "x"), (None, None, None, "n"), (0.5, "c", dt.date(2020, 1, 3), "y"), (0.2, "b", dt.date(2020, 1, 2), "z")]
    df = spark.createDataFrame(rows, "f double, s string, d date, v string").repartition(3)
    for key in "fsd":
        assert _by_col(profile(df, order_by=key))["v"]["sample_values"] == ["x", "z", "y"]
        assert [r["v"] for r in head_preview(df, 10, order_by=key).collect()] == ["x", "z", "y", "w", "n"]


def test_distinct_by_value_not_text(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (1.5,)], "f double")
    assert _by_col(profile(df))["f"]["unique_count"] == 2
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        t = spark.createDataFrame([(1604206800,), (1604210400,)], "s bigint").select(F.timestamp_seconds("s").alias("t"))
        assert _by_col(profile(t))["t"]["unique_count"] == 2  # one wall-clock hour, two instants
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_approx_profile_matches_exact_except_distinct_counts(spark):
    from tabletidy.fixtures import dirty_events
    from tabletidy.operators.profile import first_values_scan, profile_approx

    de = dirty_events(spark, "/root/testdata/sf0.001").repartition(4)
    for order in (None, "event_id"):
        exact = {r["column"]: r.asDict(recursive=True) for r in profile(de, order_by=order).collect()}
        approx = {r["column"]: r.asDict(recursive=True) for r in profile_approx(de, order_by=order, rsd=0.01).collect()}
        assert exact.keys() == approx.keys()
        for c in exact:
            e, a = exact[c], approx[c]
            for key in ("missing_count", "type_issues", "total_issues", "missing_pct", "dtype", "sample_values"):
                assert e[key] == a[key], (order, c, key)
            assert abs(e["unique_count"] - a["unique_count"]) <= max(2, 0.05 * e["unique_count"])
    # scan order with an explicit key (no early stop) agrees with the shuffled samples
    plain = spark.createDataFrame([(i, f"v{(i * 7) % 13}") for i in range(200)], "k bigint, s string").repartition(5)
    a = {r["ordinal"]: r["sample_values"] for r in first_values_scan(plain, 4, order_by="k").collect()}
    assert a[1] == ["v0", "v7", "v1", "v8"]


def test_scan_samples_with_a_carried_order_key(spark):
    """An order key carried through a shuffle is not in row order: no early stop may be taken."""
    from tabletidy.operators.profile import ORD, first_values_scan

    rows = [(i, f"v{i % 9}") for i in range(300)]
    df = spark.createDataFrame(rows, "k bigint, s string").withColumn(ORD, F.col("k")).repartition(3, "s")
    got = {r["ordinal"]: r["sample_values"] for r in first_values_scan(df, 3).collect()}
    assert got[1] == ["v0", "v1", "v2"]


def test_scan_order_samples_agree_with_frequency_table(spark):
    """In scan order the bounded early-stopping scan gives the frequency table's first values."""
    from tabletidy.fixtures import dirty_events
    from tabletidy.operators.profile import ORD, frequency_table, profile_frame, with_order

    de = with_order(dirty_events(spark, "/root/testdata/sf0.001").repartition(5), None).drop(ORD)
    keyed = with_order(de, None)  # the same scan positions, attached once and carried
    scan = {r["column"]: r["sample_values"] for r in profile_frame(de).collect()}
    table = {r["column"]: r["sample_values"] for r in profile_frame(keyed, freq=frequency_table(keyed, "none")).collect()}
    assert scan == table and any(len(v) == 3 for v in scan.values())


def test_scan_samples_break_position_ties_by_value(spark):
    """With a repeating order key, values tied at the k-th position are chosen by text."""
    from tabletidy.operators.profile import first_values_scan

    rows = [(1, "z"), (1, "y"), (2, "d"), (2, "c"), (2, "b"), (3, "a")]
    df = spark.createDataFrame(rows, "k bigint, s string").coalesce(1)
    got = {r["ordinal"]: r["sample_values"] for r in first_values_scan(df, 3, order_by="k").collect()}
    assert got[1] == ["y", "z", "b"]
    from tabletidy.operators.profile import profile

    assert {r["column"]: r["sample_values"] for r in profile(df, order_by="k").collect()}["s"] == ["y", "z", "b"]


def test_keyed_profile_hashes_its_cells(spark):
    """An order key must not make Spark sort the cells; rows without a key come last and are all counted."""
    from tabletidy.operators.profile import frequency_table

    rows = [(None, "late"), (None, "b"), (2, "b"), (1, "c"), (1, "a"), (5, "none")]
    df = spark.createDataFrame(rows, "k bigint, s string")
    for kind in ("bigint", "double", "timestamp_ntz"):
        key = F.timestamp_seconds("k").cast(kind) if kind == "timestamp_ntz" else F.col("k").cast(kind)
        keyed = df.withColumn("k", key)
        plan = frequency_table(keyed, "none", order_by="k")._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan
        s = {r["column"]: r for r in profile(keyed, 4, order_by="k").collect()}["s"]
        assert s["sample_values"] == ["a", "c", "b", "late"] and s["unique_count"] == 4 and s["missing_count"] == 1
    unkeyed = spark.createDataFrame([(None, x) for x in "ba"], "k bigint, s string")
    s = {r["column"]: r for r in profile(unkeyed, order_by="k").collect()}
    assert s["s"]["sample_values"] == ["a", "b"] and s["k"]["missing_count"] == 2
