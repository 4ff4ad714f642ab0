"""P1-P3, P5 and the edge rules E1-E3 (whitespace, numeric grammar)."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabletidy.functions import (
    PLACEHOLDERS,
    coerce_numeric,
    is_missing,
    is_placeholder,
    numeric_text_ok,
    pct,
    replace_placeholders,
    strip_ws,
)


def _one_col(spark, values, dtype="string"):
    return spark.createDataFrame([(v,) for v in values], f"s {dtype}")


def test_placeholders_case_and_space_insensitive(spark):
    vals = ["UNKNOWN", " n/a ", "Na", "NaN", "none", "NULL", "Error", "missing", "undefined", "unavailable",
            "", "-", "--", "?", "N.A.", "#N/A", "\tnull ", "Alice", "0", None]
    df = _one_col(spark, vals)
    got = [r[0] for r in df.select(is_missing(F.col("s"), T.StringType())).collect()]
    assert got == [True] * 17 + [False, False, True]
    assert len(PLACEHOLDERS) == 16


def test_missing_by_type(spark):
    df = spark.createDataFrame([(1.0, 1, "x"), (float("nan"), None, None), (None, 2, "N/A")], "f double, i bigint, s string")
    rows = df.select(
        is_missing(F.col("f"), T.DoubleType()).alias("f"),
        is_missing(F.col("i"), T.LongType()).alias("i"),
        is_missing(F.col("s"), T.StringType()).alias("s"),
    ).collect()
    assert [tuple(r) for r in rows] == [(False, False, False), (True, True, True), (True, False, True)]


def test_strip_unicode_whitespace(spark):
    vals = [" x　", "\x1cy\x1f", " z ", "\n\tw\r"]
    got = [r[0] for r in _one_col(spark, vals).select(strip_ws(F.col("s"))).collect()]
    assert got == ["x", "y", "z", "w"] == [v.strip() for v in vals]


def test_replace_placeholders(spark):
    got = [r[0] for r in _one_col(spark, ["a", "N/A", None, " -- "]).select(replace_placeholders(F.col("s"))).collect()]
    assert got == ["a", None, None, None]


# FIXTURES §3 numeric_text edge table: (text, detected by P3, coerced by P5)
EDGE = [
    ("1_000", True, None),
    (" 12 ", True, 12.0),
    ("1e5", True, 100000.0),
    ("inf", True, float("inf")),
    ("1.", True, 1.0),
    (".5", True, 0.5),
    ("+5", True, 5.0),
    ("0x10", False, None),
    ("1,000", False, None),
    ("1d", False, None),
    ("1f", False, None),
    ("5L", False, None),
    ("True", False, None),
]


def test_numeric_edge_table(spark):
    df = _one_col(spark, [t for t, _, _ in EDGE])
    rows = df.select(numeric_text_ok(F.col("s")), coerce_numeric(F.col("s"))).collect()
    for (text, detected, coerced), r in zip(EDGE, rows):
        assert r[0] == detected, text
        assert r[1] == coerced, text


def _py_float_ok(s: str) -> bool:
    try:
        float(s)
        return True
    except ValueError:
        return False


def test_numeric_detection_agrees_with_python_float(spark):
    """P3 against Python's float() on random ASCII strings of the numeric alphabet."""
    rng = random.Random(7)
    alphabet = "0123456789._eE+- infatyINF"
    samples = {"".join(rng.choice(alphabet) for _ in range(rng.randint(1, 7))) for _ in range(4000)}
    samples |= {"nan", "-Infinity", "+inf", "1e+5", "1_0.0_1", "1__0", "_1", "1_", "1e1_0", "+.5e-3", "."}
    samples = sorted(samples)
    got = [r[0] for r in _one_col(spark, samples).select(numeric_text_ok(F.col("s"))).collect()]
    bad = [s for s, g in zip(samples, got) if g != _py_float_ok(s)]
    assert not bad, bad[:20]


def test_coercion_is_detection_without_underscores(spark):
    rng = random.Random(11)
    alphabet = "0123456789.eE+-"
    samples = sorted({"".join(rng.choice(alphabet) for _ in range(rng.randint(1, 6))) for _ in range(2000)})
    rows = _one_col(spark, samples).select(coerce_numeric(F.col("s"))).collect()
    for s, r in zip(samples, rows):
        expect = float(s) if _py_float_ok(s) else None
        assert r[0] == expect, s


@pytest.mark.parametrize("part,whole,expect", [(1, 8, 12.5), (1, 3, 33.33), (2, 3, 66.67), (0, 0, 0.0), (1, 800, 0.12)])
def test_pct_rounding(spark, part, whole, expect):
    row = spark.range(1).select(pct(F.lit(part), F.lit(whole)).alias("p")).first()
    assert row["p"] == expect == (round(part / whole * 100, 2) if whole else 0.0)


def test_strip_takes_bare_cells_as_they_are(spark):
    """Only cells with a character to strip at an end are trimmed; all come out as str.strip() gives them."""
    long = "a🙂\n" * 60_000
    cells = ["", " ", "a", " a", "a ", "a\n", "\na", "a b", "a\nb", "a\r", "é", "é ", "　a　", "a ", "\x1fa", "🙂", " 🙂 ", "~", "!x~", "\x7f", "a\x00", long, long + "z", " N/A ", "N/A", " nan "]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)] + [(-1, None)], "i int, c string")
    got = {r["i"]: (r["s"], r["p"]) for r in df.select("i", strip_ws(F.col("c")).alias("s"), is_placeholder(F.col("c")).alias("p")).collect()}
    assert got == {-1: (None, False)} | {i: (c.strip(), c.strip().lower() in PLACEHOLDERS) for i, c in enumerate(cells)}
    plan = df.select(strip_ws(F.col("c")))._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan.upper()
