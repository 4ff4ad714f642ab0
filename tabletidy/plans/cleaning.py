"""Fit/transform cleaning.

``fit`` runs the aggregate jobs and returns a ``CleaningPlan`` (detected types
and fill values, JSON-serialisable); ``transform`` is a lazy ``select`` that
applies a plan to any table with the same columns, in batch or on a stream.
``clean`` is both plus the before/after profiles and the run summary.

Job shape (see SURVEY §3.2): fit-1 is one wide aggregate over the input; the
placeholder rewrite and the exact-duplicate removal are lazy and persisted once;
fit-2 (medians, minimums, modes) touches only columns that hold nulls after
dedup; the transform is one projection with the fill values as literals. The after
profile's distinct counts follow from the before profile and the plan (``derived_after``).
"""

from __future__ import annotations

import datetime as _dt
import json
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabletidy.functions.predicates import (
    NUMERIC_KINDS,
    PLACEHOLDERS,
    UNKNOWN_FILL,
    Placeholders,
    INTEGER_TEXT_RE,
    coerce_numeric,
    is_missing,
    kind_of,
    null_nan,
    placeholder_sets,
    placeholders_json,
    replace_placeholders,
    strip_ws,
    typed_literal,
)
from tabletidy.operators.impute import column_minimums, column_modes, exact_medians
from tabletidy.operators.profile import (
    ORD,
    PROFILE_COLUMNS,
    first_found,
    frequency_table,
    profile,
    profile_rows,
    spread,
    stats_frame,
    with_order,
)


_EPOCH = _dt.datetime(1970, 1, 1, tzinfo=_dt.timezone.utc)


@dataclass
class ColumnPlan:
    name: str
    ordinal: int
    kind: str  # input kind: string, float, integral, decimal, bool, datetime, other
    numeric: bool  # P4 verdict on the input
    coerce: bool  # string column parsed to double (P5)
    fill_rule: str | None = None  # median | zero | earliest | mode | unknown | None
    fill_value: Any = None
    narrow: bool = False  # E7 opt-in: coerced text that is all integers, no gaps -> bigint

    @property
    def out_kind(self) -> str:
        if self.coerce and self.narrow:
            return "integral"
        if self.coerce or self.kind == "decimal":
            return "float"
        if self.kind in ("integral", "bool") and self.fill_rule in ("median", "zero"):
            return "float"
        return self.kind


@dataclass
class CleaningPlan:
    columns: list[ColumnPlan]
    drop_duplicates: bool = True
    # one list for every text column, or {column: list, "*": default}
    placeholders: list[str] | dict[str, list[str]] = field(default_factory=lambda: list(PLACEHOLDERS))

    def to_json(self) -> str:
        def enc(v):
            if isinstance(v, _dt.datetime) and v.tzinfo is not None:
                return {"__micros__": round((v - _EPOCH) / _dt.timedelta(microseconds=1))}
            if isinstance(v, (_dt.datetime, _dt.date)):
                return {"__ts__": v.isoformat(), "date": not isinstance(v, _dt.datetime)}
            return v

        d = asdict(self)
        for c in d["columns"]:
            c["fill_value"] = enc(c["fill_value"])
        return json.dumps(d)

    @staticmethod
    def from_json(text: str) -> CleaningPlan:
        d = json.loads(text)
        cols = []
        for c in d["columns"]:
            v = c["fill_value"]
            if isinstance(v, dict) and "__micros__" in v:
                v = _EPOCH + _dt.timedelta(microseconds=v["__micros__"])
            elif isinstance(v, dict) and "__ts__" in v:
                v = (_dt.date if v.get("date") else _dt.datetime).fromisoformat(v["__ts__"])
            c["fill_value"] = v
            cols.append(ColumnPlan(**c))
        return CleaningPlan(cols, d["drop_duplicates"], d["placeholders"])

    @property
    def numeric_columns(self) -> list[str]:
        return [c.name for c in self.columns if c.coerce]


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def _as_null(f: T.StructField, ph: list[str]) -> Column:
    k = kind_of(f.dataType)
    if k == "string":
        return replace_placeholders(_col(f.name), ph).alias(f.name)
    if k == "float":  # E6: NaN and null are one missing value, so they must merge in D1
        return null_nan(_col(f.name), f.dataType).alias(f.name)
    return _col(f.name)


def replace_all_placeholders(df: DataFrame, placeholders: Placeholders = PLACEHOLDERS) -> DataFrame:
    """P2 over every column in one projection: placeholder text and NaN become null."""
    ph = placeholder_sets(placeholders)
    return df.select(*[_as_null(f, list(ph(f.name))) for f in df.schema.fields])


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """Exact duplicate rows over all columns (null equals null, NaN equals NaN).

    One hash aggregate; map-side partials absorb large groups of copies before
    the shuffle. When the order key is present the survivor keeps the smallest
    one, i.e. the first occurrence, as the reference keeps it.
    """
    if ORD not in df.columns:
        return df.dropDuplicates()
    keys = [_col(c) for c in df.columns if c != ORD]
    return df.groupBy(*keys).agg(F.min(ORD).alias(ORD))


def _prepared(df: DataFrame, plan: CleaningPlan, order_by: str | None = None, keep_order: bool = False) -> DataFrame:
    """P2 then (optionally) D1: the table the fill values are fitted on."""
    src = with_order(df, order_by) if keep_order else df
    out = replace_all_placeholders(src, plan.placeholders)
    return drop_exact_duplicates(out) if plan.drop_duplicates else out


def _value_expr(cp: ColumnPlan) -> Column:
    """Column after P5 and type widening, before the fill."""
    c = _col(cp.name)
    if cp.coerce and cp.narrow:
        return strip_ws(c).try_cast("long")  # every value is integer text (checked in fit)
    if cp.coerce:
        return coerce_numeric(c)
    if cp.out_kind == "float" and cp.kind != "float":
        return c.cast("double")
    if cp.kind == "float":
        return F.nanvl(c.cast("double"), F.lit(None).cast("double")) if cp.fill_rule else c
    return c


def _filled(cp: ColumnPlan, dt: T.DataType | None = None) -> Column:
    v = _value_expr(cp)
    if cp.fill_rule in ("median", "zero"):
        v = F.coalesce(v, F.lit(float(cp.fill_value)))
    elif cp.fill_rule == "earliest" and cp.fill_value is not None:
        fill = typed_literal(cp.fill_value, dt) if dt is not None else F.lit(cp.fill_value)
        v = F.coalesce(v, fill)  # keeps the column's own timestamp/date type
    elif cp.fill_rule in ("mode", "unknown"):
        v = F.coalesce(v, F.lit(str(cp.fill_value)))
    return v.alias(cp.name)


def _keep_ord(df: DataFrame) -> list[Column]:
    return [F.col(ORD)] if ORD in df.columns else []


def coerce_columns(prepared: DataFrame, plan: CleaningPlan) -> DataFrame:
    """P5 only (no fills): the table fit-2 measures."""
    return prepared.select(*[_value_expr(cp).alias(cp.name) for cp in plan.columns])


def fit_types(df: DataFrame, placeholders: Placeholders = PLACEHOLDERS, drop_duplicates: bool = True):
    """fit-1: one aggregate → per-column kinds and the P4 verdict. Returns (plan, stats rows)."""
    stats = stats_frame(df, placeholders).collect()  # one row per column
    return plan_from_stats(stats, placeholders, drop_duplicates), stats


def plan_from_stats(stats: list, placeholders: Placeholders = PLACEHOLDERS, drop_duplicates: bool = True) -> CleaningPlan:
    """The type half of a plan from per-column rows (kind, is_numeric)."""
    cols = []
    for r in sorted(stats, key=lambda r: r["ordinal"]):
        cols.append(
            ColumnPlan(
                name=r["column"],
                ordinal=r["ordinal"],
                kind=r["kind"],
                numeric=bool(r["is_numeric"]),
                coerce=bool(r["is_numeric"]) and r["kind"] == "string",
            )
        )
    return CleaningPlan(cols, drop_duplicates, placeholders_json(placeholders))


def _mark_narrow(prepared: DataFrame, plan: CleaningPlan) -> None:
    """E7 opt-in: a coerced column whose every cell is integer text (no gaps) stays integral.

    pandas yields int64 for such a column; one aggregate over the prepared table decides.
    """
    cands = [cp for cp in plan.columns if cp.coerce]
    if not cands:
        return
    aggs = [F.count(F.lit(1)).alias("rows")]
    for cp in cands:
        t = strip_ws(_col(cp.name))
        aggs.append(F.count_if(t.rlike(INTEGER_TEXT_RE) & t.try_cast("long").isNotNull()).alias(f"i{cp.ordinal}"))
    row = prepared.agg(*aggs).first()
    for cp in cands:
        cp.narrow = int(row[f"i{cp.ordinal}"]) == int(row["rows"]) > 0


def fit_fills(prepared: DataFrame, plan: CleaningPlan, narrow_integers: bool = False) -> tuple[CleaningPlan, int]:
    """fit-2 on the prepared (P2 + D1) table: fill values for columns holding nulls.

    Returns the completed plan and the prepared row count (A16's ``cleaned_rows``).
    """
    if narrow_integers:
        _mark_narrow(prepared, plan)
    coerced = coerce_columns(prepared, plan)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for cp in plan.columns:
        c = _col(cp.name)
        null = (c.isNull() | F.isnan(c)) if cp.out_kind == "float" else c.isNull()
        aggs.append(F.count_if(null).alias(f"z{cp.ordinal}"))
    row = coerced.agg(*aggs).first()
    rows = int(row["rows"])
    nulls = {cp.name: int(row[f"z{cp.ordinal}"]) for cp in plan.columns}
    needs = [cp for cp in plan.columns if nulls[cp.name] > 0]
    num = [cp for cp in needs if cp.out_kind == "float" or cp.kind in ("integral", "bool")]
    dts = [cp for cp in needs if cp.kind == "datetime"]
    txt = [cp for cp in needs if cp.kind == "string" and not cp.coerce]
    counts = {cp.name: rows - nulls[cp.name] for cp in num}
    medians = exact_medians(coerced, [cp.name for cp in num], counts)
    mins = column_minimums(coerced, [cp.name for cp in dts])
    modes = column_modes(coerced, [cp.name for cp in txt])
    for cp in num:
        m = medians[cp.name]
        cp.fill_rule, cp.fill_value = ("median", m) if m is not None else ("zero", 0.0)
    for cp in dts:
        cp.fill_rule, cp.fill_value = "earliest", mins[cp.name]
    for cp in txt:
        m = modes[cp.name]
        cp.fill_rule, cp.fill_value = ("mode", m) if m is not None else ("unknown", UNKNOWN_FILL)
    return plan, rows


def fit(
    df: DataFrame, drop_duplicates: bool = True, placeholders: Placeholders = PLACEHOLDERS, narrow_integers: bool = False
) -> CleaningPlan:
    """Estimator step: detect types on the input, fit fills on the deduplicated table."""
    plan, _ = fit_types(df, placeholders, drop_duplicates)
    prepared = _prepared(df, plan).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        plan, _ = fit_fills(prepared, plan, narrow_integers)
    finally:
        prepared.unpersist()
    return plan


def fit_transform(
    df: DataFrame, drop_duplicates: bool = True, placeholders: Placeholders = PLACEHOLDERS, narrow_integers: bool = False
) -> tuple[DataFrame, CleaningPlan, DataFrame]:
    """``fit`` and ``transform`` of one table: the prepared table of the fit is the transform's.

    Returns (cleaned, plan, prepared); ``prepared`` is persisted, so the scan and the dedup
    shuffle run once. Release it with ``unpersist()`` when ``cleaned`` has been written.
    """
    plan, _ = fit_types(df, placeholders, drop_duplicates)
    prepared = _prepared(df, plan).persist(StorageLevel.MEMORY_AND_DISK)
    plan, _ = fit_fills(prepared, plan, narrow_integers)
    return apply_fills(prepared, plan), plan, prepared


def transform(df: DataFrame, plan: CleaningPlan, dedup: bool | None = None) -> DataFrame:
    """Model step: P2 → D1 → P5 → fills, as one lazy plan (no aggregate, one shuffle for D1).

    Works on a streaming DataFrame too (a frozen clean of arriving rows) with
    ``dedup=False``: exact-duplicate removal over an unbounded stream would keep
    every distinct row as state, so it is refused there; deduplicate with a
    watermark (``dropDuplicatesWithinWatermark``) upstream instead.
    """
    p = plan if dedup is None else CleaningPlan(plan.columns, dedup, plan.placeholders)
    if df.isStreaming and p.drop_duplicates:
        raise ValueError("dedup on a stream keeps every row as state: pass dedup=False")
    return apply_fills(_prepared(df, p), plan)


def transform_ordered(df: DataFrame, plan: CleaningPlan, order_by: str | None = None) -> DataFrame:
    """``transform`` that keeps the first-occurrence key (for samples of the after profile)."""
    return apply_fills(_prepared(df, plan, order_by, keep_order=True), plan)


def after_profile(df: DataFrame, plan: CleaningPlan, top_values: int = 3, order_by: str | None = None, honest: bool = False) -> DataFrame:
    """I6 as a lazy DataFrame: the profile of the cleaned table, issue columns zeroed."""
    prof = profile(transform_ordered(df, plan, order_by), top_values, plan.placeholders)
    return prof if honest else _zero_after(prof)


def apply_fills(prepared: DataFrame, plan: CleaningPlan) -> DataFrame:
    types = {f.name: f.dataType for f in prepared.schema.fields}
    return prepared.select(*[_filled(cp, types.get(cp.name)) for cp in plan.columns], *_keep_ord(prepared))


def _zero_after(after: DataFrame) -> DataFrame:
    """The after profile keeps its measured order, then reports no issues."""
    return after.select(
        "column",
        "ordinal",
        F.lit(0).cast("long").alias("missing_count"),
        F.lit(0).cast("long").alias("type_issues"),
        F.lit(0).cast("long").alias("total_issues"),
        F.lit(0.0).alias("missing_pct"),
        "dtype",
        "unique_count",
        "sample_values",
    )


def after_uniques(before: list, prepared: DataFrame, cleaned: DataFrame, plan: CleaningPlan, placeholders: Placeholders = PLACEHOLDERS) -> dict[int, int]:
    """A4 of the cleaned table from the before profile's counts (I6 by algebra).

    Placeholder rewriting and deduplication leave a column's set of values as it was, and a mode
    or an earliest instant is one of them, so the count stays. A median is new unless a cell holds
    it already: one flag per column, all in one pass without a shuffle. Zero and "Unknown" fill
    columns that had no value. Only where different cells may become equal (numbers written as text,
    decimals and filled 64-bit integers as doubles) are that column's cells grouped again.
    """
    ph = placeholder_sets(placeholders)
    types = {f.name: f.dataType for f in prepared.schema.fields}
    uniques = {r["ordinal"]: int(r["unique_count"]) for r in before}
    merging = [cp for cp in plan.columns if cp.coerce or cp.kind == "decimal" or (cp.fill_rule and isinstance(types[cp.name], T.LongType))]
    if merging:
        freq = frequency_table(cleaned, "missing", [cp.name for cp in merging], placeholders, with_first=False)
        found = {r["ordinal"]: int(r["n"]) for r in freq.groupBy("ordinal").agg(F.count(F.lit(1)).alias("n")).collect()}
        uniques.update({cp.ordinal: found.get(cp.ordinal, 0) for cp in merging})
    new = {}
    for cp in plan.columns:
        if cp in merging:
            continue
        if cp.fill_rule == "median":
            new[cp.ordinal] = ~F.coalesce(F.bool_or(_value_expr(cp) == F.lit(float(cp.fill_value))), F.lit(False))
        elif cp.fill_rule == "unknown":
            new[cp.ordinal] = F.bool_or(~is_missing(F.lit(str(cp.fill_value)), T.StringType(), ph(cp.name)))
        elif cp.fill_rule == "zero":
            new[cp.ordinal] = F.lit(True)
    if new:
        row = prepared.agg(F.count(F.lit(1)).alias("n"), *[v.alias(f"v{i}") for i, v in new.items()]).first()
        for i in new:
            uniques[i] += bool(row[f"v{i}"])
    return uniques


def derived_after(before: list, prepared: DataFrame, cleaned: DataFrame, plan: CleaningPlan, top_values: int = 3, placeholders: Placeholders = PLACEHOLDERS) -> list[dict[str, Any]]:
    """I6, eager: ``profile_rows(cleaned)`` without a frequency table of the cleaned cells.

    ``before`` holds the exact profile rows of the input, ``cleaned`` is ``prepared`` with its fills and
    its order key. Counts come from the pass without a shuffle, samples from ``first_found``,
    distinct counts from ``after_uniques``.
    """
    uniques = after_uniques(before, prepared, cleaned, plan, placeholders)
    samples = first_found(cleaned, top_values, placeholders)
    rows = [r.asDict() for r in stats_frame(cleaned, placeholders).collect()]  # one per column
    for r in rows:
        r.update(unique_count=uniques[r["ordinal"]], sample_values=[v for _, v in samples[r["ordinal"]]])
    return sorted(rows, key=lambda r: (-r["total_issues"], r["ordinal"]))


@dataclass
class CleanResult:
    cleaned: DataFrame
    summary: dict[str, Any]
    plan: CleaningPlan
    profile_before: list[dict[str, Any]]
    profile_after: list[dict[str, Any]]
    stats: list = field(default_factory=list)  # fit-1 rows, one per input column
    cached: list[DataFrame] = field(default_factory=list)  # persisted intermediates under ``cleaned``

    def release(self) -> None:
        """Drop the persisted intermediates once the cleaned table has been written."""
        for df in self.cached:
            df.unpersist()
        self.cached = []


def clean(
    df: DataFrame,
    drop_duplicates: bool = True,
    placeholders: Placeholders = PLACEHOLDERS,
    top_values: int = 3,
    order_by: str | None = None,
    honest_after: bool = False,
    persist: bool = True,
    narrow_integers: bool = False,
    approx_unique: float | None = None,
    spread_input: bool = False,
) -> CleanResult:
    """Clean a table and summarise it.

    The cleaned table stays lazy over the persisted prepared table; use
    ``result.cleaned`` in a write, then call ``result.release()``.
    Profiles hold one entry per column, so they are small driver-side lists.
    ``approx_unique`` (a relative standard deviation, e.g. 0.05) sketches the
    profiles' distinct counts, so no cells are shuffled for them; every other
    field, the plan and the cleaned rows stay exact. ``spread_input`` first deals a table
    of a few large partitions over all task slots (a persisted copy).
    """
    if not isinstance(df, DataFrame):  # S2: the in-memory source is a DataFrame
        raise TypeError("df must be a Spark DataFrame")
    ph = placeholders
    src = spread(df, order_by) if spread_input else df
    cached = [src] if spread_input else []

    # before profile + fit-1 from one frequency table (one scan, one shuffle)
    stats = profile_rows(src, top_values, ph, order_by, approx_rsd=approx_unique)
    plan = plan_from_stats(stats, ph, drop_duplicates)
    prepared = _prepared(src, plan, order_by, keep_order=True)
    if persist:
        prepared = prepared.persist(StorageLevel.MEMORY_AND_DISK)
        cached.append(prepared)
    plan, cleaned_rows = fit_fills(prepared, plan, narrow_integers)
    ordered = apply_fills(prepared, plan)
    cleaned = ordered.drop(ORD)
    if approx_unique is None:
        after = derived_after(stats, prepared, ordered, plan, top_values, ph)
    else:
        after = profile_rows(ordered, top_values, ph, approx_rsd=approx_unique)
    missing_after = int(sum(r["missing_count"] for r in after))
    after_rows = [{k: r[k] for k in PROFILE_COLUMNS} for r in after]
    if not honest_after:
        for r in after_rows:
            r.update(missing_count=0, type_issues=0, total_issues=0, missing_pct=0.0)
    before_rows = [{k: r[k] for k in PROFILE_COLUMNS} for r in stats]
    original_rows = int(stats[0]["rows"]) if stats else int(df.count())
    missing_before = int(sum(r["total_issues"] for r in stats))
    summary = {
        "original_rows": original_rows,
        "cleaned_rows": cleaned_rows,
        "dropped_duplicates": original_rows - cleaned_rows,
        "missing_before_total": missing_before,
        "missing_after_total": missing_after,
        "missing_before": missing_before,
        "missing_after": missing_after,
        "columns": len(plan.columns),
        "missing_summary_before": before_rows,
        "missing_summary_after": after_rows,
    }
    return CleanResult(cleaned, summary, plan, before_rows, after_rows, stats, cached)


def table_metrics(stats: list, cleaned_schema: T.StructType) -> dict[str, Any]:
    """I7's extra keys: rows, columns, raw-null share (A10), numeric/categorical counts."""
    rows = int(stats[0]["rows"]) if stats else 0
    ncols = len(stats)
    nulls = sum(int(r["null_count"]) for r in stats)
    cells = rows * ncols
    pct = round(nulls / cells * 100, 2) if cells else 0.0
    numeric = sum(1 for f in cleaned_schema.fields if kind_of(f.dataType) in NUMERIC_KINDS)
    return {
        "rows": rows,
        "columns": ncols,
        "missing_pct": float(pct),
        "numeric_cols": numeric,
        "categorical_cols": len(cleaned_schema.fields) - numeric,
    }
