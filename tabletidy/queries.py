"""Registered queries: one Spark callable per SURVEY §2 operator, plus DuckDB SQL.

Each Spark query takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
driver tables (or the dirty fixtures Spark derives from them). The SQL texts state
the same computation independently for the correctness oracle; column names match.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabletidy import fixtures as fx
from tabletidy.functions.predicates import (
    COERCIBLE_TEXT_RE,
    NUMERIC_TEXT_RE,
    PLACEHOLDERS,
    UNKNOWN_FILL,
    coerce_numeric,
    is_missing,
    replace_placeholders,
)
from tabletidy.operators import history as H
from tabletidy.operators import report as R
from tabletidy.operators.impute import column_modes, exact_medians
from tabletidy.operators.profile import (
    PROFILE_COLUMNS,
    PROFILE_SCHEMA,
    first_values_scan,
    frequency_table,
    head_preview,
    mode_frame,
    profile,
    raw_column_info,
    raw_null_pct,
    raw_preview_profile,
    stats_frame,
    value_stats,
)
from tabletidy.operators.profile_state import UNIQUE_ERROR, merge_states, profile_from_state, profile_state
from tabletidy.plans.cleaning import (
    after_profile,
    clean,
    drop_exact_duplicates,
    fit,
    replace_all_placeholders,
    table_metrics,
    transform,
)
from tabletidy.plans.pipeline import clean_path, ingest
from tabletidy.session import checkpoint_dir
from tabletidy.sources.files import landing_copy, read_csv, read_summaries, write_csv, write_summary_json
from tabletidy.sources.staging import staged
from tabletidy.sources.tables import profile_records, read_runs, run_record
from tabletidy.streaming.landing import watch_landing

Query = Callable[[SparkSession, str], DataFrame]

# Dirty-events columns and kinds (see fixtures.dirty_events); the order key is event_id.
DE_COLS = [
    ("event_id", "integral"),
    ("user_id", "integral"),
    ("event_type", "string"),
    ("value_txt", "string"),
    ("code_txt", "string"),
    ("ts", "datetime"),
    ("blank", "string"),
]
DD_COLS = [("event_type", "string"), ("user_id", "integral")]
# P4 verdicts the fixture rules guarantee at every scale (value_txt > 0.8, code_txt = 0.8).
DE_COERCED = {"value_txt"}
# Integral columns the fixture rules never null (no fill, type kept).
DE_NULL_FREE = frozenset({"event_id"})

# ---------------------------------------------------------------- SQL fragments
_PH = ", ".join("'" + p.replace("'", "''") + "'" for p in PLACEHOLDERS)


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def _miss(c: str, kind: str) -> str:
    if kind == "string":
        return f"({c} IS NULL OR lower({_strip(c)}) IN ({_PH}))"
    if kind == "float":
        return f"({c} IS NULL OR isnan({c}))"
    return f"({c} IS NULL)"


def _numok(c: str, kind: str) -> str:
    if kind == "string":
        return f"coalesce(regexp_matches({_strip(c)}, '{NUMERIC_TEXT_RE}'), false)"
    if kind in ("integral", "float", "decimal", "bool"):
        return f"({c} IS NOT NULL)"
    return "false"


def _coerce(c: str) -> str:
    return f"CASE WHEN regexp_matches({_strip(c)}, '{COERCIBLE_TEXT_RE}') THEN TRY_CAST({_strip(c)} AS DOUBLE) END"


def _dtype(kind: str, nulls: str) -> str:
    if kind == "integral":
        return f"CASE WHEN {nulls} > 0 THEN 'float64' ELSE 'int64' END"
    if kind == "bool":
        return f"CASE WHEN {nulls} > 0 THEN 'object' ELSE 'bool' END"
    if kind in ("float", "decimal"):
        return "'float64'"
    if kind == "datetime":
        return "'datetime64[ns]'"
    return "'object'"


def _pct(part: str, whole: str) -> str:
    return f"coalesce(round_even(CAST({part} AS DOUBLE) / NULLIF(CAST({whole} AS DOUBLE), 0) * 100.0, 2), 0.0)"


def _stats_sql(src: str, cols) -> str:
    """Per-column counts over relation ``src``: the stats_frame columns."""
    parts = []
    for i, (c, k) in enumerate(cols):
        parts.append(
            f"SELECT '{c}' AS \"column\", {i} AS ordinal, '{k}' AS kind, count(*) AS \"rows\", "
            f"count_if({_miss(c, k)}) AS missing_count, count_if({c} IS NULL) AS null_count, "
            f"count_if(NOT {_miss(c, k)} AND {_numok(c, k)}) AS numeric_ok, "
            f"{_dtype(k, f'count_if({c} IS NULL)')} AS dtype FROM {src}"
        )
    union = "\nUNION ALL\n".join(parts)
    return f"""
SELECT *, missing_count + type_issues AS total_issues,
       {_pct('missing_count', '"rows"')} AS missing_pct
FROM (
  SELECT *, CASE WHEN kind = 'string' AND is_numeric THEN "rows" - missing_count - numeric_ok ELSE 0 END AS type_issues
  FROM (
    SELECT *, coalesce(CAST(numeric_ok AS DOUBLE) / NULLIF(CAST("rows" - missing_count AS DOUBLE), 0) > 0.8, false) AS is_numeric
    FROM ({union}) u
  ) a
) b
"""


def _freq_sql(src: str, cols, ord_col: str, exclude: str = "missing") -> str:
    parts = []
    for i, (c, k) in enumerate(cols):
        drop = _miss(c, k) if exclude == "missing" else f"({c} IS NULL)"
        parts.append(f"SELECT {i} AS ordinal, CAST({c} AS VARCHAR) AS value, {ord_col} AS ord FROM {src} WHERE NOT {drop}")
    union = "\nUNION ALL\n".join(parts)
    return f"SELECT ordinal, value, count(*) AS n, min(ord) AS first_ord FROM ({union}) u GROUP BY ordinal, value"


def _samples_sql(freq: str, k: int = 3) -> str:
    return f"""SELECT ordinal, value, rk FROM (
  SELECT ordinal, value, row_number() OVER (PARTITION BY ordinal ORDER BY first_ord, value) AS rk FROM {freq}
) s WHERE rk <= {k}"""


def _profile_sql(src: str, cols, ord_col: str, zero: bool = False) -> str:
    """A8 as SQL: stats + distinct counts + joined first-3 samples."""
    z = zero
    return f"""
WITH st AS ({_stats_sql(src, cols)}),
fq AS ({_freq_sql(src, cols, ord_col)}),
un AS (SELECT ordinal, count(*) AS unique_count FROM fq GROUP BY ordinal),
sm AS (SELECT ordinal, string_agg(value, ', ' ORDER BY rk) AS samples FROM ({_samples_sql('fq')}) x GROUP BY ordinal)
SELECT st."column", CAST(st.ordinal AS INTEGER) AS ordinal,
       {'CAST(0 AS BIGINT)' if z else 'CAST(st.missing_count AS BIGINT)'} AS missing_count,
       {'CAST(0 AS BIGINT)' if z else 'CAST(st.type_issues AS BIGINT)'} AS type_issues,
       {'CAST(0 AS BIGINT)' if z else 'CAST(st.total_issues AS BIGINT)'} AS total_issues,
       {'CAST(0.0 AS DOUBLE)' if z else 'st.missing_pct'} AS missing_pct,
       st.dtype, CAST(coalesce(un.unique_count, 0) AS BIGINT) AS unique_count,
       coalesce(sm.samples, '') AS samples
FROM st LEFT JOIN un ON st.ordinal = un.ordinal LEFT JOIN sm ON st.ordinal = sm.ordinal
"""


def _p2_select(cols) -> str:
    return ", ".join(f"CASE WHEN {_miss(c, k)} THEN NULL ELSE {c} END AS {c}" if k == "string" else c for c, k in cols)


def _clean_sql(
    src: str, cols, coerced: set[str], null_free: frozenset[str] = frozenset(), dedup: bool = True, apply_all: bool = False
) -> str:
    """I5 as SQL: P2 → D1 → P5 → fills (median / earliest / mode / 'Unknown').

    ``null_free`` names the integral columns the fixture never nulls: they need no
    fill and keep their integer type (SQL types are static, so this is pinned).
    """
    p2 = f"SELECT {_p2_select(cols)} FROM {src}"
    d = f"SELECT DISTINCT * FROM ({p2}) p" if dedup else p2
    coerce_sel = ", ".join(f"{_coerce(c)} AS {c}" if c in coerced else c for c, _ in cols)
    fills = []
    med_parts, mode_ctes = [], []
    for c, k in cols:
        if c in coerced or k in ("integral", "float", "decimal", "bool"):
            med_parts.append(f"median(CAST({c} AS DOUBLE)) AS med_{c}, count_if({c} IS NULL) AS nul_{c}")
        elif k == "datetime":
            med_parts.append(f"min({c}) AS min_{c}")
        elif k == "string":
            mode_ctes.append(
                f"mo_{c} AS (SELECT max(v) AS v FROM (SELECT {c} AS v, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rn "
                f"FROM c WHERE {c} IS NOT NULL GROUP BY {c}) z WHERE rn = 1)"
            )
    for c, k in cols:
        if c in coerced or k in ("integral", "float", "decimal", "bool"):
            fills.append(
                f"c.{c}" if c in null_free else f"coalesce(CAST(c.{c} AS DOUBLE), f.med_{c}, 0.0) AS {c}"
            )
        elif k == "datetime":
            fills.append(f"coalesce(c.{c}, f.min_{c}) AS {c}")
        elif k == "string":
            fills.append(f"coalesce(c.{c}, (SELECT v FROM mo_{c}), '{UNKNOWN_FILL}') AS {c}")
        else:
            fills.append(f"c.{c}")
    ctes = [f"c AS (SELECT {coerce_sel} FROM ({d}) dd)", f"f AS (SELECT {', '.join(med_parts) or '1 AS one'} FROM c)"] + mode_ctes
    if apply_all:  # fills fitted on the deduplicated table, applied to every row (a frozen plan)
        ctes.append(f"a AS (SELECT {coerce_sel} FROM ({p2}) pp)")
        return f"WITH {', '.join(ctes)} SELECT {', '.join(fills)} FROM a AS c, f"
    return f"WITH {', '.join(ctes)} SELECT {', '.join(fills)} FROM c, f"


def _de(inner: str) -> str:
    return f"WITH de AS ({fx.DIRTY_EVENTS_SQL}) {inner}"


def _dd(inner: str) -> str:
    return f"WITH dd AS ({fx.DIRTY_DUPS_SQL}) {inner}"


def _runs(inner: str) -> str:
    if inner.lstrip().startswith("WITH "):  # merge the caller's CTEs into one WITH list
        inner = ", " + inner.lstrip()[len("WITH "):]
    return f"WITH runs AS ({fx.RUNS_FLAT_SQL}) {inner}"


def _profs(inner: str) -> str:
    return f"WITH profiles AS ({fx.PROFILES_SYNTH_SQL}) {inner}"


_PAIRS_SQL = """
SELECT run_id, "column",
  max(CASE WHEN stage = 'before' THEN missing_count END) AS count_before,
  max(CASE WHEN stage = 'before' THEN missing_pct END) AS pct_before,
  max(CASE WHEN stage = 'before' THEN dtype END) AS dtype_before,
  max(CASE WHEN stage = 'before' THEN unique_count END) AS unique_before,
  max(CASE WHEN stage = 'after' THEN missing_count END) AS count_after,
  max(CASE WHEN stage = 'after' THEN missing_pct END) AS pct_after,
  max(CASE WHEN stage = 'after' THEN dtype END) AS dtype_after
FROM profiles GROUP BY run_id, "column"
"""

_METRICS_SQL = """
SELECT run_id, original_rows, cleaned_rows, dropped_duplicates, missing_before, missing_after,
  CASE WHEN original_rows > 0 THEN missing_before / (original_rows * columns) * 100.0 ELSE 0.0 END AS mb_pct,
  CASE WHEN cleaned_rows > 0 THEN missing_after / (cleaned_rows * columns) * 100.0 ELSE 0.0 END AS ma_pct
FROM runs
"""


# ---------------------------------------------------------------- Spark queries
def _de_df(spark, sf):
    return fx.dirty_events(spark, sf)


def q_p1_missing_flags(spark, sf):
    de = _de_df(spark, sf)
    types = dict((f.name, f.dataType) for f in de.schema.fields)
    return de.select("event_id", *[is_missing(F.col(c), types[c]).alias(f"m_{c}") for c, _ in DE_COLS if c != "event_id"])


def q_p2_replace(spark, sf):
    return replace_all_placeholders(_de_df(spark, sf))


def _stats(spark, sf):
    return stats_frame(_de_df(spark, sf))


def q_p3_p4_numeric_detect(spark, sf):
    return _stats(spark, sf).select("column", "numeric_ok", (F.col("rows") - F.col("missing_count")).alias("non_missing"), "is_numeric")


def q_p5_coerce(spark, sf):
    de = _de_df(spark, sf)
    return de.select("event_id", coerce_numeric(replace_placeholders(F.col("value_txt"))).alias("value_num"))


def q_a2_a6_profile(spark, sf):
    return _stats(spark, sf).select("column", "ordinal", "missing_count", "type_issues", "total_issues", "missing_pct", "dtype")


def q_a4_unique(spark, sf):
    freq = frequency_table(_de_df(spark, sf), "missing", order_by="event_id")
    names = F.array(*[F.lit(c) for c, _ in DE_COLS])
    return value_stats(freq).select(F.element_at(names, F.col("ordinal") + 1).alias("column"), "unique_count")


def q_a7_samples(spark, sf):
    freq = frequency_table(_de_df(spark, sf), "missing", order_by="event_id")
    names = F.array(*[F.lit(c) for c, _ in DE_COLS])
    vs = value_stats(freq, 3)
    return vs.select(
        F.element_at(names, F.col("ordinal") + 1).alias("column"),
        F.posexplode("sample_values").alias("pos", "sample_value"),
    ).select("column", (F.col("pos") + 1).alias("sample_rank"), "sample_value")


def q_a7_samples_scan(spark, sf):
    """A7 without a shuffle of cells: per-partition first values, then a bounded merge."""
    names = F.array(*[F.lit(c) for c, _ in DE_COLS])
    fv = first_values_scan(_de_df(spark, sf), 3, order_by="event_id")
    return fv.select(
        F.element_at(names, F.col("ordinal") + 1).alias("column"),
        F.posexplode("sample_values").alias("pos", "sample_value"),
    ).select("column", (F.col("pos") + 1).alias("sample_rank"), "sample_value")


def _with_samples_text(prof: DataFrame) -> DataFrame:
    return prof.withColumn("samples", F.array_join("sample_values", ", ")).drop("sample_values")


def q_a8_full_profile(spark, sf):
    return _with_samples_text(profile(_de_df(spark, sf), order_by="event_id"))


ORDERS_COLS = [
    ("o_orderkey", "integral"),
    ("o_custkey", "integral"),
    ("o_orderstatus", "string"),
    ("o_totalprice", "float"),
    ("o_orderdate", "datetime"),
    ("o_orderpriority", "string"),
]
LINEITEM_COLS = [
    ("l_orderkey", "integral"),
    ("l_partkey", "integral"),
    ("l_suppkey", "integral"),
    ("l_linenumber", "integral"),
    ("l_quantity", "float"),
    ("l_extendedprice", "float"),
    ("l_discount", "float"),
    ("l_tax", "float"),
    ("l_returnflag", "string"),
    ("l_linestatus", "string"),
    ("l_shipdate", "datetime"),
]


def q_a8_profile_orders(spark, sf):
    """A8 on a whole driver table (first appearance by order key)."""
    return _with_samples_text(profile(fx.table(spark, sf, "orders"), order_by="o_orderkey"))


def q_a8_profile_lineitem(spark, sf):
    """A8 on lineitem; the order key repeats, ties in first appearance go to the smaller text."""
    return _with_samples_text(profile(fx.table(spark, sf, "lineitem"), order_by="l_orderkey"))


def q_a9_issue_total(spark, sf):
    return _stats(spark, sf).agg(F.sum("total_issues").cast("long").alias("missing_before"))


def q_a10_raw_null_pct(spark, sf):
    return raw_null_pct(_de_df(spark, sf))


def q_a12_median(spark, sf):
    """Exact medians of every numeric lineitem column and the dirty numeric text.

    A small bracket limit forces the distributed narrowing rounds even at sf0.01.
    """
    li = fx.table(spark, sf, "lineitem")
    de = _de_df(spark, sf).select("user_id", coerce_numeric(replace_placeholders(F.col("value_txt"))).alias("value_txt"))
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
    got = exact_medians(li, cols)
    got.update(exact_medians(de, ["user_id", "value_txt"]))
    return spark.createDataFrame([(k, v) for k, v in got.items()], "column string, median double")


def q_a13_min_ts(spark, sf):
    de = _de_df(spark, sf)
    li = fx.table(spark, sf, "lineitem")
    a = de.agg(F.min("ts").alias("earliest")).select(F.lit("ts").alias("column"), "earliest")
    b = li.agg(F.min("l_shipdate").alias("earliest")).select(F.lit("l_shipdate").alias("column"), "earliest")
    return a.unionByName(b)


def _modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, mode)`` as a lazy frame: frequency table + min_by, names by ordinal."""
    sub = df.select(*columns)
    names = F.array(*[F.lit(c) for c in columns])
    return mode_frame(frequency_table(sub, "null", order_by=None)).select(
        F.element_at(names, F.col("ordinal") + 1).alias("column"), "mode"
    )


def q_a14_mode(spark, sf):
    """Most frequent value of each text column (after P2), ties to the smallest."""
    p2 = replace_all_placeholders(_de_df(spark, sf))
    li = fx.table(spark, sf, "lineitem")
    text = ["event_type", "value_txt", "code_txt", "blank"]
    # an all-missing column has no frequency rows: its mode is null
    present = _modes(p2, text)
    allcols = spark.createDataFrame([(c,) for c in text], "column string")
    return allcols.join(present, "column", "left").unionByName(_modes(li, ["l_returnflag", "l_linestatus"]))


def q_a14_mode_proven(spark, sf):
    """A14 by frequent-items sketch, exact counts of its candidates and a bound on the rest: skewed,
    tied and nearly unique text columns (the last are counted in a frequency table)."""
    li = fx.table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_partkey").cast("string").alias("l_partkey"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line"))
    got = column_modes(li, li.columns)
    return spark.createDataFrame(list(got.items()), "column string, mode string")


def q_a8_state_merge(spark, sf):
    """A8 of an appended table: the states of its first events and of the new ones, merged; the
    sketched distinct count stands within four standard errors of the exact one."""
    de = _de_df(spark, sf)
    parts = [de.where("event_id % 10 < 7"), de.where("event_id % 10 >= 7")]
    states = [staged(profile_state(p, i, order_by="event_id"), "profile-state") for i, p in enumerate(parts)]
    merged = profile_from_state(merge_states(states[0].unionByName(states[1])))
    exact = profile(de, order_by="event_id").select("column", F.col("unique_count").alias("exact"))
    near = F.abs(F.col("unique_count") - F.col("exact")) <= 4 * UNIQUE_ERROR * F.col("exact") + 1
    return _with_samples_text(merged.join(exact, "column").withColumn("unique_count", F.when(near, F.col("exact")).otherwise(F.col("unique_count"))).drop("exact"))


def q_a16_dropped(spark, sf):
    dd = fx.dirty_dups(spark, sf)
    d1 = drop_exact_duplicates(replace_all_placeholders(dd))
    # both counts in one aggregate over tagged rows (no join of the two results)
    tagged = dd.select(F.lit(1).alias("o"), F.lit(0).alias("c")).unionByName(d1.select(F.lit(0).alias("o"), F.lit(1).alias("c")))
    counts = tagged.agg(F.sum("o").cast("long").alias("original_rows"), F.sum("c").cast("long").alias("cleaned_rows"))
    return counts.select(
        "original_rows", "cleaned_rows", (F.col("original_rows") - F.col("cleaned_rows")).alias("dropped_duplicates")
    )


def q_a17_preview(spark, sf):
    return raw_preview_profile(_de_df(spark, sf))


def q_a18_column_info(spark, sf):
    return raw_column_info(_de_df(spark, sf))


def q_d1_dedup(spark, sf):
    return drop_exact_duplicates(replace_all_placeholders(fx.dirty_dups(spark, sf)))


def q_i1_fill_numeric(spark, sf):
    de = _de_df(spark, sf)
    plan = fit(de)
    return transform(de, plan).select("event_id", "user_id", "value_txt")


def q_i2_fill_ts(spark, sf):
    de = _de_df(spark, sf)
    return transform(de, fit(de)).select("event_id", "ts")


def q_i3_fill_mode(spark, sf):
    de = _de_df(spark, sf)
    plan = fit(de)
    return transform(de, plan).select("event_id", "event_type", "code_txt", "blank")


def q_i5_clean(spark, sf):
    de = _de_df(spark, sf)
    return transform(de, fit(de))


def q_i5_clean_sketched(spark, sf):
    """I5 with sketched distinct counts in its profiles: the cleaned rows are exactly I5's."""
    res = clean(_de_df(spark, sf), order_by="event_id", approx_unique=0.05)
    return res.cleaned


def q_i5_clean_dups(spark, sf):
    dd = fx.dirty_dups(spark, sf)
    return transform(dd, fit(dd))


def _summary_df(spark, res) -> DataFrame:
    s = res.summary
    keys = ["original_rows", "cleaned_rows", "dropped_duplicates", "missing_before", "missing_after", "columns"]
    return spark.createDataFrame([tuple(int(s[k]) for k in keys)], ", ".join(f"{k} bigint" for k in keys))


def _summary_of(spark, df: DataFrame, **kw) -> DataFrame:
    res = clean(df, **kw)
    try:
        return _summary_df(spark, res)
    finally:
        res.release()  # the summary is already on the driver


def q_i5_summary(spark, sf):
    return _summary_of(spark, _de_df(spark, sf), order_by="event_id")


def q_i5_summary_dups(spark, sf):
    return _summary_of(spark, fx.dirty_dups(spark, sf))


def q_i6_after_profile(spark, sf):
    de = _de_df(spark, sf)
    return _with_samples_text(after_profile(de, fit(de), order_by="event_id"))


def q_i6_after_algebra(spark, sf):
    res = clean(_de_df(spark, sf), order_by="event_id")
    res.release()
    return _with_samples_text(spark.createDataFrame([tuple(r[c] for c in PROFILE_COLUMNS) for r in res.profile_after], PROFILE_SCHEMA))


def _pairs(spark, sf):
    return R.stage_pairs(fx.profiles_synth(spark, sf))


def q_j1_missing_compare(spark, sf):
    return R.missing_comparison(_pairs(spark, sf))


def q_j2_status_compare(spark, sf):
    return R.status_comparison(_pairs(spark, sf))


def q_j3_pct_compare(spark, sf):
    return R.pct_comparison(_pairs(spark, sf))


def q_j4_after_lookup(spark, sf):
    return R.after_lookup(fx.profiles_synth(spark, sf))


def q_j5_report_union(spark, sf):
    return R.report_rows(fx.profiles_synth(spark, sf))


def q_l5_report_order(spark, sf):
    """The report rows of every run by column name, as a rank."""
    return R.rank_within_run(R.report_rows(fx.profiles_synth(spark, sf)), F.col("column"))


def _real_history(spark, sf):
    """Runs and profiles that cleaning the dirty tables makes (the engine's own figures)."""
    runs, profiles = [], []
    for name, df, key in (("events", _de_df(spark, sf), "event_id"), ("pairs", fx.dirty_dups(spark, sf), None)):
        res = clean(df, order_by=key)
        summary = {**res.summary, **table_metrics(res.stats, res.cleaned.schema)}
        res.release()
        runs.append(run_record(spark, name, summary, user_email="real", uploaded_filename=f"{name}.csv"))
        profiles.append(profile_records(spark, name, summary))
    return runs[0].unionByName(runs[1]), profiles[0].unionByName(profiles[1])


def q_j1_real_profiles(spark, sf):
    """J1 over profiles that the engine measured."""
    return R.missing_comparison(R.stage_pairs(_real_history(spark, sf)[1]))


def q_r9_real_report(spark, sf):
    """R9 over runs that the engine recorded."""
    runs, profiles = _real_history(spark, sf)
    return R.report_table(profiles, runs)


def q_m_real_metrics(spark, sf):
    """M1-M10 over runs that the engine recorded."""
    return R.run_metrics(_real_history(spark, sf)[0])


def q_l7_runs_from_files(spark, sf):
    """Several summary files, one of them broken: the first two in name order."""
    folder = f"{_scratch(spark)}/reports"
    events = fx.table(spark, sf, "events")
    for k in range(3):
        part = events.where(F.col("event_id") % 3 == k)
        rows = part.count()
        write_summary_json(spark, {"original_rows": rows, "cleaned_rows": rows - k}, f"{folder}/{k}_summary.json")
    spark.range(1).select(F.lit("{not json").alias("value")).coalesce(1).write.text(f"{folder}/0_broken_summary.json")
    return read_summaries(spark, folder, limit=2).select(F.col("summary.original_rows").alias("original_rows"), F.col("summary.cleaned_rows").alias("cleaned_rows"))


def q_h3_run_detail(spark, sf):
    """H3 detail: the least run id by key, with its listing fields."""
    runs = fx.runs_synth(spark, sf)
    least = runs.agg(F.min("run_id")).first()[0]
    return H.run_detail(runs, least).select("run_id", "file_name", "original_rows", "cleaned_rows", F.col("summary.missing_before").alias("missing_before"))


def q_a7_samples_by_ts(spark, sf):
    """A7 with a timestamp and with a fractional order key: first values in those orders."""
    e = fx.table(spark, sf, "events").select("event_id", "event_type", "user_id", "ts", "value")
    out = []
    for key in ("ts", "value"):
        prof = profile(e, order_by=key)
        out.append(prof.select(F.lit(key).alias("by"), "column", F.array_join("sample_values", "|").alias("samples")).where(F.col("column").isin("event_type", "user_id")))
    return out[0].unionByName(out[1])


def q_l3_head_by_value(spark, sf):
    """L3 by a fractional key: the ten rows of least value."""
    e = fx.table(spark, sf, "events").select("event_id", "value")
    return head_preview(e, 10, order_by="value").select("value")


def q_a8_profile_documents(spark, sf):
    """A8 on whole documents (long free texts), without the sample texts."""
    return profile(fx.table(spark, sf, "documents"), order_by="doc_id").drop("sample_values")


def q_l1_sort_issues(spark, sf):
    p = fx.profiles_synth(spark, sf).where(F.col("stage") == "before")
    return R.rank_within_run(p, F.col("total_issues").desc(), F.col("ordinal")).select("run_id", "column", "rank")


def q_l2_sort_pct(spark, sf):
    p = fx.profiles_synth(spark, sf).where(F.col("stage") == "before")
    return R.rank_within_run(p, F.col("missing_pct").desc(), F.col("ordinal")).select("run_id", "column", "rank")


def q_l3_head_preview(spark, sf):
    return head_preview(fx.table(spark, sf, "events"), 10, order_by="event_id")


def q_l4_sort_quality(spark, sf):
    c = R.completeness(R.pct_comparison(_pairs(spark, sf)))
    return R.rank_within_run(c, F.col("quality_score").asc(), F.col("column")).select("run_id", "column", "quality_score", "rank")


def _busiest_user(runs: DataFrame) -> str:
    """The user with the most runs (ties to the smallest id)."""
    return H.runs_per_user(runs).orderBy(F.col("processing_count").desc(), F.col("user_email")).first()["user_email"]


def q_l6_latest_runs(spark, sf):
    runs = fx.runs_synth(spark, sf)
    return H.latest_runs(runs, _busiest_user(runs)).select("run_id", "user_email", "ingested_at")


def q_l9_history_order(spark, sf):
    runs = fx.runs_synth(spark, sf)
    parts = []
    for mode in (H.SORT_RECENT, H.SORT_OLDEST, H.SORT_LARGEST):
        o = H.ordered_history(runs, mode, 20).select("run_id")
        parts.append(o.withColumn("order_mode", F.lit(mode)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def q_r1_melt_pct(spark, sf):
    return R.melt_pct(R.pct_comparison(_pairs(spark, sf)))


def q_r2_counts_per_stage(spark, sf):
    return R.counts_per_stage(R.missing_comparison(_pairs(spark, sf)))


def q_r3_rows_per_stage(spark, sf):
    return R.rows_per_stage(fx.runs_synth(spark, sf))


def q_r5_fixed_remaining(spark, sf):
    return R.fixed_vs_remaining(fx.runs_synth(spark, sf))


def q_r6_column_types(spark, sf):
    return R.column_types(fx.runs_synth(spark, sf))


def q_r7_completeness(spark, sf):
    return R.completeness(R.pct_comparison(_pairs(spark, sf)))


def q_r8_issue_list(spark, sf):
    return R.issue_list(fx.runs_synth(spark, sf))


def q_r9_report_table(spark, sf):
    return R.report_table(fx.profiles_synth(spark, sf), fx.runs_synth(spark, sf))


def q_r10_profile_report(spark, sf):
    return R.profile_report(profile(_de_df(spark, sf), order_by="event_id", sort="missing_pct"))


def q_m_metrics(spark, sf):
    return R.run_metrics(fx.runs_synth(spark, sf))


def q_h1_kpis(spark, sf):
    return H.kpis(fx.runs_synth(spark, sf)).drop("avg_improvement")


def q_h2_avg(spark, sf):
    return H.kpis(fx.runs_synth(spark, sf)).select("avg_improvement")


def q_h3_listing(spark, sf):
    return H.listing(fx.runs_synth(spark, sf)).drop("ingested_at")


def q_h4_user(spark, sf):
    runs = fx.runs_synth(spark, sf)
    return H.user_runs(runs, _busiest_user(runs)).select("run_id", "user_email", F.col("summary.original_rows").alias("original_rows"))


def q_h5_per_user(spark, sf):
    return H.runs_per_user(fx.runs_synth(spark, sf))


# ---------------------------------------------------------------- file pipeline (S1, S4-S8, I7, I8, ST1)
def _scratch(spark) -> str:
    """A fresh folder under the shared checkpoint folder (``spark.checkpoint.dir``)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tabletidy-queries/{uuid.uuid4().hex}"


def _events_csv(spark, sf, parts: int | None = None) -> str:
    """The dirty events written as CSV (S4); ``parts`` files when given."""
    path = f"{_scratch(spark)}/events.csv"  # a directory of CSV part files
    de = _de_df(spark, sf)
    write_csv(de.repartition(parts) if parts else de, path)
    return path


def q_s1_s4_csv_roundtrip(spark, sf):
    """S4 then S1: the dirty events through a CSV file and back, typed like a CSV reader."""
    return read_csv(spark, _events_csv(spark, sf))


def q_s1_csv_documents(spark, sf):
    """S4 then S1 on free text with quotes, newlines and commas: whole texts come back unchanged."""
    docs = fx.table(spark, sf, "documents").select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("part"), "text")
    talk = fx.table(spark, sf, "conversations").select(F.lit("c").alias("kind"), F.col("conv_id").alias("id"), F.col("turn").cast("long").alias("part"), "text")
    quoted = F.concat(F.lit('He said ""hi"", "'), F.col("text"), F.lit('"\n, end'))
    path = f"{_scratch(spark)}/texts.csv"
    write_csv(docs.unionByName(talk).withColumn("text", quoted), path)
    back = read_csv(spark, path)
    return back.select("kind", "id", "part", "text")


def q_s1_csv_bool_blank(spark, sf):
    """A boolean CSV column with blanks becomes 1.0/0.0 with the median filled in."""
    e = fx.table(spark, sf, "events")
    flag = F.when(F.col("event_id") % 7 != 0, F.when(F.col("event_id") % 3 == 0, "False").otherwise("True"))
    path = f"{_scratch(spark)}/flags.csv"
    write_csv(e.select("event_id", flag.alias("flag")), path)
    src = read_csv(spark, path)
    return transform(src, fit(src))


def q_s10_file_filter(spark, sf):
    """Of a landing folder's files only the ``.csv`` ones are read, in any letter case."""
    e = fx.table(spark, sf, "events").select("event_id", "event_type")
    folder = f"{_scratch(spark)}/landing"
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(jvm.org.apache.hadoop.fs.Path(folder))
    for k, name in enumerate(("a.csv", "b.CSV", "c.txt", "d.csv.bak", "csv")):
        write_csv(e.where(F.col("event_id") % 5 == k).coalesce(1), f"{folder}-{k}")
        part = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{folder}-{k}/part-*"))[0].getPath()
        fs.rename(part, jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"))
    return read_csv(spark, folder)


def q_s8_raw_copy(spark, sf):
    """The archived upload, read again, is the upload."""
    src = _events_csv(spark, sf)
    _, copy = landing_copy(spark, src, f"{src}_raw")
    return read_csv(spark, copy)


def q_i7_clean_file(spark, sf):
    """Clean the CSV of the dirty events; the cleaned CSV it wrote, read back."""
    src = _events_csv(spark, sf)
    _, res = clean_path(spark, src, f"{src}_cleaned.csv")
    back = read_csv(spark, f"{src}_cleaned.csv", infer_types=False)
    types = {f.name: f.dataType for f in res.cleaned.schema.fields}
    return back.select(*[F.col(f"`{c}`").cast(types[c]).alias(c) for c in back.columns])


def q_s5_s6_summary_json(spark, sf):
    """S5 then S6: the run summary of I7 written as JSON and read back with the file scan."""
    src = _events_csv(spark, sf)
    summary, _ = clean_path(spark, src, f"{src}_cleaned")
    folder = f"{src}_reports"
    write_summary_json(spark, summary, f"{folder}/events_summary.json")
    got = read_summaries(spark, folder)
    return got.select(*[F.col(f"summary.{k}").alias(k) for k in ("original_rows", "cleaned_rows", "dropped_duplicates", "missing_before", "missing_after", "rows", "missing_pct", "numeric_cols", "categorical_cols")])


def _runs_flat(runs: DataFrame) -> DataFrame:
    keys = ("original_rows", "cleaned_rows", "dropped_duplicates", "missing_before", "missing_after", "columns")
    return runs.select("uploaded_filename", *[F.col(f"summary.{k}").alias(k) for k in keys])


def q_i8_ingest(spark, sf):
    """I8 (+S7, S8, S10): the whole upload job on the events CSV; the recorded run."""
    src = _events_csv(spark, sf)
    root = f"{src}_root"
    ingest(spark, src, root, user_email="driver")  # the whole CSV directory is one upload
    return _runs_flat(read_runs(spark, root))


def q_st1_frozen_stream_clean(spark, sf):
    """A plan fitted on the dirty events cleans the same rows arriving as parquet files (stream, no dedup)."""
    de = _de_df(spark, sf)
    plan = fit(de)
    base = _scratch(spark)
    de.repartition(3).write.parquet(f"{base}/arrivals")
    stream = spark.readStream.schema(de.schema).parquet(f"{base}/arrivals")
    query = (
        transform(stream, plan, dedup=False)
        .writeStream.format("parquet")
        .option("checkpointLocation", f"{base}/_stream")
        .trigger(availableNow=True)
        .start(f"{base}/cleaned")
    )
    query.awaitTermination()
    return spark.read.parquet(f"{base}/cleaned")


def q_st1_landing(spark, sf):
    """ST1: the events land as three CSV files, twice handed out; the stream cleans each once."""
    landing = f"{_scratch(spark)}/landing"
    de = _de_df(spark, sf)
    files = [(de.where(F.col("event_id") % 3 == k).coalesce(1), f"{landing}/{k}.csv") for k in range(3)]
    with ThreadPoolExecutor(len(files)) as pool:  # one task writes a file: all three at a time
        list(pool.map(lambda f: write_csv(*f), files))
    root = f"{landing}_root"
    for turn in ("a", "b"):  # another checkpoint: every file comes again
        watch_landing(spark, landing, root, checkpoint=f"{root}/_stream-{turn}").awaitTermination()
    return _runs_flat(read_runs(spark, root)).drop("uploaded_filename")


QUERIES: dict[str, Query] = {
    "p1_missing_flags": q_p1_missing_flags,
    "p2_replace": q_p2_replace,
    "p3_p4_numeric_detect": q_p3_p4_numeric_detect,
    "p5_coerce": q_p5_coerce,
    "a2_a6_profile": q_a2_a6_profile,
    "a4_unique": q_a4_unique,
    "a7_samples": q_a7_samples,
    "a7_samples_scan": q_a7_samples_scan,
    "a8_full_profile": q_a8_full_profile,
    "a8_profile_orders": q_a8_profile_orders,
    "a8_profile_lineitem": q_a8_profile_lineitem,
    "a9_issue_total": q_a9_issue_total,
    "a10_raw_null_pct": q_a10_raw_null_pct,
    "a12_median": q_a12_median,
    "a13_min_ts": q_a13_min_ts,
    "a14_mode": q_a14_mode,
    "a14_mode_proven": q_a14_mode_proven,
    "a8_state_merge": q_a8_state_merge,
    "s10_file_filter": q_s10_file_filter,
    "a16_dropped": q_a16_dropped,
    "a17_preview": q_a17_preview,
    "a18_column_info": q_a18_column_info,
    "d1_dedup": q_d1_dedup,
    "i1_fill_numeric": q_i1_fill_numeric,
    "i2_fill_ts": q_i2_fill_ts,
    "i3_fill_mode": q_i3_fill_mode,
    "i5_clean": q_i5_clean,
    "i5_clean_sketched": q_i5_clean_sketched,
    "i5_clean_dups": q_i5_clean_dups,
    "i5_summary": q_i5_summary,
    "i5_summary_dups": q_i5_summary_dups,
    "i6_after_profile": q_i6_after_profile,
    "i6_after_algebra": q_i6_after_algebra,
    "j1_missing_compare": q_j1_missing_compare,
    "j2_status_compare": q_j2_status_compare,
    "j3_pct_compare": q_j3_pct_compare,
    "j4_after_lookup": q_j4_after_lookup,
    "j5_report_union": q_j5_report_union,
    "j1_real_profiles": q_j1_real_profiles,
    "r9_real_report": q_r9_real_report,
    "m_real_metrics": q_m_real_metrics,
    "l5_report_order": q_l5_report_order,
    "l7_runs_from_files": q_l7_runs_from_files,
    "h3_run_detail": q_h3_run_detail,
    "a7_samples_by_ts": q_a7_samples_by_ts,
    "l3_head_by_value": q_l3_head_by_value,
    "a8_profile_documents": q_a8_profile_documents,
    "l1_sort_issues": q_l1_sort_issues,
    "l2_sort_pct": q_l2_sort_pct,
    "l3_head_preview": q_l3_head_preview,
    "l4_sort_quality": q_l4_sort_quality,
    "l6_latest_runs": q_l6_latest_runs,
    "l9_history_order": q_l9_history_order,
    "r1_melt_pct": q_r1_melt_pct,
    "r2_counts_per_stage": q_r2_counts_per_stage,
    "r3_rows_per_stage": q_r3_rows_per_stage,
    "r5_fixed_remaining": q_r5_fixed_remaining,
    "r6_column_types": q_r6_column_types,
    "r7_completeness": q_r7_completeness,
    "r8_issue_list": q_r8_issue_list,
    "r9_report_table": q_r9_report_table,
    "r10_profile_report": q_r10_profile_report,
    "m_metrics": q_m_metrics,
    "h1_kpis": q_h1_kpis,
    "h2_avg": q_h2_avg,
    "h3_listing": q_h3_listing,
    "h4_user": q_h4_user,
    "h5_per_user": q_h5_per_user,
    "s1_s4_csv_roundtrip": q_s1_s4_csv_roundtrip,
    "s1_csv_documents": q_s1_csv_documents,
    "s1_csv_bool_blank": q_s1_csv_bool_blank,
    "s8_raw_copy": q_s8_raw_copy,
    "i7_clean_file": q_i7_clean_file,
    "s5_s6_summary_json": q_s5_s6_summary_json,
    "i8_ingest": q_i8_ingest,
    "st1_landing": q_st1_landing,
    "st1_frozen_stream_clean": q_st1_frozen_stream_clean,
}


# ---------------------------------------------------------------- oracle SQL
def _oracle() -> dict[str, str]:
    de_stats = _stats_sql("de", DE_COLS)
    names_case = "CASE ordinal " + " ".join(f"WHEN {i} THEN '{c}'" for i, (c, _) in enumerate(DE_COLS)) + " END"
    o: dict[str, str] = {}
    o["p1_missing_flags"] = _de(
        "SELECT event_id, " + ", ".join(f"{_miss(c, k)} AS m_{c}" for c, k in DE_COLS if c != "event_id") + " FROM de"
    )
    o["p2_replace"] = _de(f"SELECT {_p2_select(DE_COLS)} FROM de")
    o["p3_p4_numeric_detect"] = _de(
        f'SELECT "column", numeric_ok, "rows" - missing_count AS non_missing, is_numeric FROM ({de_stats}) s'
    )
    p2_value = f"CASE WHEN {_miss('value_txt', 'string')} THEN NULL ELSE value_txt END"
    o["p5_coerce"] = _de(f"SELECT event_id, {_coerce(p2_value)} AS value_num FROM de")
    o["a2_a6_profile"] = _de(
        f'SELECT "column", CAST(ordinal AS INTEGER) AS ordinal, missing_count, type_issues, total_issues, missing_pct, dtype FROM ({de_stats}) s'
    )
    o["a4_unique"] = _de(
        f'SELECT {names_case} AS "column", count(*) AS unique_count FROM ({_freq_sql("de", DE_COLS, "event_id")}) f GROUP BY ordinal'
    )
    o["a7_samples"] = _de(
        f'SELECT {names_case} AS "column", CAST(rk AS INTEGER) AS sample_rank, value AS sample_value '
        f'FROM ({_samples_sql("(" + _freq_sql("de", DE_COLS, "event_id") + ") f")}) s'
    )
    o["a7_samples_scan"] = o["a7_samples"]
    o["a8_full_profile"] = _de(f"SELECT * FROM ({_profile_sql('de', DE_COLS, 'event_id')}) p")
    o["a8_profile_orders"] = _profile_sql("orders", ORDERS_COLS, "o_orderkey")
    o["a8_profile_lineitem"] = _profile_sql("lineitem", LINEITEM_COLS, "l_orderkey")
    o["a9_issue_total"] = _de(f"SELECT CAST(sum(total_issues) AS BIGINT) AS missing_before FROM ({de_stats}) s")
    nulls = " + ".join(f"count_if({c} IS NULL)" for c, _ in DE_COLS)
    o["a10_raw_null_pct"] = _de(
        f'SELECT count(*) AS "rows", {len(DE_COLS)} AS columns, CAST({nulls} AS BIGINT) AS null_cells, '
        f"{_pct(nulls, f'count(*) * {len(DE_COLS)}')} AS missing_pct FROM de"
    )
    li_cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
    li_med = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", median(CAST({c} AS DOUBLE)) AS median FROM lineitem" for c in li_cols)
    o["a12_median"] = _de(
        f"{li_med} UNION ALL SELECT 'user_id', median(CAST(user_id AS DOUBLE)) FROM de "
        f"UNION ALL SELECT 'value_txt', median({_coerce(p2_value)}) FROM de"
    )
    o["a13_min_ts"] = _de(
        "SELECT 'ts' AS \"column\", min(ts) AS earliest FROM de UNION ALL SELECT 'l_shipdate', min(l_shipdate) FROM lineitem"
    )
    mode_src = [(c, f"(SELECT CASE WHEN {_miss(c, 'string')} THEN NULL ELSE {c} END AS v FROM de)") for c in ("event_type", "value_txt", "code_txt", "blank")]
    mode_src += [(c, f"(SELECT {c} AS v FROM lineitem)") for c in ("l_returnflag", "l_linestatus")]
    mode_parts = [
        f"SELECT '{c}' AS \"column\", (SELECT v FROM (SELECT v, row_number() OVER (ORDER BY count(*) DESC, v) AS rn FROM {src} s "
        f"WHERE v IS NOT NULL GROUP BY v) z WHERE rn = 1) AS mode"
        for c, src in mode_src
    ]
    o["a14_mode"] = _de(" UNION ALL ".join(mode_parts))
    proven = [("l_returnflag", "l_returnflag"), ("l_linestatus", "l_linestatus"), ("l_partkey", "CAST(l_partkey AS VARCHAR)"), ("line", "l_orderkey || '-' || l_linenumber")]
    o["a14_mode_proven"] = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", (SELECT v FROM (SELECT {x} AS v, row_number() OVER (ORDER BY count(*) DESC, {x}) AS rn FROM lineitem "
        f"WHERE {x} IS NOT NULL GROUP BY {x}) z WHERE rn = 1) AS mode"
        for c, x in proven
    )
    o["a8_state_merge"] = o["a8_full_profile"]
    o["s10_file_filter"] = "SELECT event_id, event_type FROM events WHERE event_id % 5 < 2"
    dd_p2 = f"SELECT {_p2_select(DD_COLS)} FROM dd"
    o["a16_dropped"] = _dd(
        f"SELECT (SELECT count(*) FROM dd) AS original_rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM ({dd_p2}) p) q) AS cleaned_rows, "
        f"(SELECT count(*) FROM dd) - (SELECT count(*) FROM (SELECT DISTINCT * FROM ({dd_p2}) p) q) AS dropped_duplicates"
    )
    o["a17_preview"] = _de(
        f'SELECT "column", CAST(ordinal AS INTEGER) AS ordinal, dtype, null_count, {_pct("null_count", chr(34) + "rows" + chr(34))} AS null_pct FROM ({de_stats}) s'
    )
    o["a18_column_info"] = _de(
        f"""SELECT s."column", CAST(s.ordinal AS INTEGER) AS ordinal, s.dtype, s.null_count, CAST(coalesce(u.n, 0) AS BIGINT) AS unique_count
FROM ({de_stats}) s LEFT JOIN (SELECT ordinal, count(*) AS n FROM ({_freq_sql('de', DE_COLS, 'event_id', 'null')}) f GROUP BY ordinal) u ON s.ordinal = u.ordinal"""
    )
    o["d1_dedup"] = _dd(f"SELECT DISTINCT * FROM ({dd_p2}) p")
    clean_de = _clean_sql("de", DE_COLS, DE_COERCED, DE_NULL_FREE)
    o["i1_fill_numeric"] = _de(f"SELECT event_id, user_id, value_txt FROM ({clean_de}) x")
    o["i2_fill_ts"] = _de("SELECT event_id, coalesce(ts, (SELECT min(ts) FROM de)) AS ts FROM de")
    o["i3_fill_mode"] = _de(f"SELECT event_id, event_type, code_txt, blank FROM ({clean_de}) x")
    o["i5_clean"] = _de(f"SELECT * FROM ({clean_de}) x")
    o["i5_clean_sketched"] = o["i5_clean"]
    o["i5_clean_dups"] = _dd(f"SELECT * FROM ({_clean_sql('dd', DD_COLS, set())}) x")

    def summary_sql(src, cols, coerced, null_free=frozenset()):
        st = _stats_sql(src, cols)
        cleaned = _clean_sql(src, cols, coerced, null_free)

        def after_kind(c, k):
            if c in null_free:
                return k
            return "float" if (c in coerced or k in ("integral", "bool", "decimal")) else k

        after_miss = " + ".join(f"count_if({_miss(c, after_kind(c, k))})" for c, k in cols)
        return f"""SELECT CAST((SELECT count(*) FROM {src}) AS BIGINT) AS original_rows,
  CAST((SELECT count(*) FROM ({cleaned}) c1) AS BIGINT) AS cleaned_rows,
  CAST((SELECT count(*) FROM {src}) - (SELECT count(*) FROM ({cleaned}) c2) AS BIGINT) AS dropped_duplicates,
  CAST((SELECT sum(total_issues) FROM ({st}) s) AS BIGINT) AS missing_before,
  CAST((SELECT {after_miss} FROM ({cleaned}) c3) AS BIGINT) AS missing_after,
  CAST({len(cols)} AS BIGINT) AS columns"""

    o["i5_summary"] = _de(summary_sql("de", DE_COLS, DE_COERCED, DE_NULL_FREE))
    o["i5_summary_dups"] = _dd(summary_sql("dd", DD_COLS, set()))
    after_cols = [(c, "float" if (c in DE_COERCED or (k == "integral" and c not in DE_NULL_FREE)) else k) for c, k in DE_COLS]
    o["i6_after_profile"] = _de(
        f"SELECT * FROM ({_profile_sql('cl', after_cols, 'event_id', zero=True).replace('WITH st AS', f'WITH cl AS ({clean_de}), st AS', 1)}) p"
    )
    o["i6_after_algebra"] = o["i6_after_profile"]
    pairs = f"({_PAIRS_SQL}) pr"
    o["j1_missing_compare"] = _profs(
        f"""SELECT run_id, "column", CAST(coalesce(count_before, 0) AS BIGINT) AS missing_before, coalesce(pct_before, 0.0) AS pct_before,
  CAST(coalesce(count_after, 0) AS BIGINT) AS missing_after, coalesce(pct_after, 0.0) AS pct_after,
  CAST(coalesce(count_before, 0) - coalesce(count_after, 0) AS BIGINT) AS fixed FROM {pairs}"""
    )
    o["j2_status_compare"] = _profs(
        f"""SELECT run_id, "column", dtype_before AS dtype, CAST(coalesce(count_before, 0) AS BIGINT) AS missing_before,
  coalesce(pct_before, 0.0) AS pct_before, CAST(coalesce(unique_before, 0) AS BIGINT) AS unique_count,
  CAST(coalesce(count_after, 0) AS BIGINT) AS missing_after, coalesce(pct_after, 0.0) AS pct_after,
  CAST(coalesce(count_before, 0) - coalesce(count_after, 0) AS BIGINT) AS fixed,
  CASE WHEN coalesce(count_after, 0) = 0 THEN '{R.STATUS_FIXED}' ELSE '{R.STATUS_PARTIAL}' END AS status FROM {pairs}"""
    )
    o["j3_pct_compare"] = _profs(
        f"""SELECT run_id, "column", dtype_before AS dtype, CAST(coalesce(unique_before, 0) AS BIGINT) AS unique_count,
  coalesce(pct_before, 0.0) AS pct_before, coalesce(pct_after, 0.0) AS pct_after,
  round_even(coalesce(pct_before, 0.0) - coalesce(pct_after, 0.0), 2) AS improvement FROM {pairs}"""
    )
    stages = f"""WITH profiles AS MATERIALIZED ({fx.PROFILES_SYNTH_SQL}),
b AS MATERIALIZED (SELECT * FROM profiles WHERE stage = 'before'), a AS MATERIALIZED (SELECT * FROM profiles WHERE stage = 'after')"""
    ranked = """SELECT j.*, CAST(row_number() OVER (PARTITION BY run_id ORDER BY "column") AS INTEGER) AS rank"""
    o["j4_after_lookup"] = f"""{stages} SELECT run_id, "column", missing_before, pct_before, missing_after, pct_after FROM ({ranked} FROM (
  SELECT b.run_id, b."column", b.missing_count AS missing_before, b.missing_pct AS pct_before,
    CAST(coalesce(a.missing_count, 0) AS BIGINT) AS missing_after, coalesce(a.missing_pct, 0.0) AS pct_after
  FROM b LEFT JOIN a ON b.run_id = a.run_id AND b."column" = a."column") j) WHERE rank >= 1"""
    both = """(SELECT coalesce(b.run_id, a.run_id) AS run_id, coalesce(b."column", a."column") AS "column",
    b.missing_pct AS pct_before, a.missing_pct AS pct_after, a.dtype AS dtype_after
  FROM b FULL OUTER JOIN a ON b.run_id = a.run_id AND b."column" = a."column") j"""
    o["l5_report_order"] = f"{stages} {ranked} FROM {both}"
    o["j5_report_union"] = f'{stages} SELECT run_id, "column", pct_before, pct_after, dtype_after FROM ({ranked} FROM {both}) WHERE rank >= 1'
    o["l7_runs_from_files"] = """SELECT count(*) AS original_rows, count(*) - event_id % 3 AS cleaned_rows FROM events
WHERE event_id % 3 < 2 GROUP BY event_id % 3"""
    o["h3_run_detail"] = _runs(
        """SELECT run_id, uploaded_filename AS file_name, CAST(original_rows AS BIGINT) AS original_rows,
  CAST(cleaned_rows AS BIGINT) AS cleaned_rows, missing_before FROM runs WHERE run_id = (SELECT min(run_id) FROM runs)"""
    )

    def first_three(col: str, key: str) -> str:
        return f"""(SELECT string_agg(v, '|' ORDER BY f, v) FROM (SELECT CAST({col} AS VARCHAR) AS v, min({key}) AS f FROM events
    WHERE NOT {_miss(f'CAST({col} AS VARCHAR)', 'string')} GROUP BY 1 ORDER BY f, v LIMIT 3) x)"""

    o["a7_samples_by_ts"] = " UNION ALL ".join(
        f"SELECT '{key}' AS \"by\", '{col}' AS \"column\", {first_three(col, key)} AS samples" for key in ("ts", "value") for col in ("event_type", "user_id")
    )
    o["l3_head_by_value"] = "SELECT value FROM events ORDER BY value LIMIT 10"
    doc_cols = [("doc_id", "integral"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "integral")]
    o["a8_profile_documents"] = f"""SELECT s."column", CAST(s.ordinal AS INTEGER) AS ordinal, s.missing_count, s.type_issues, s.total_issues, s.missing_pct, s.dtype,
  CAST(coalesce(u.n, 0) AS BIGINT) AS unique_count
FROM ({_stats_sql('documents', doc_cols)}) s LEFT JOIN (SELECT ordinal, count(*) AS n FROM ({_freq_sql('documents', doc_cols, 'doc_id')}) f GROUP BY ordinal) u ON s.ordinal = u.ordinal"""
    o["l1_sort_issues"] = _profs(
        """SELECT run_id, "column", CAST(row_number() OVER (PARTITION BY run_id ORDER BY total_issues DESC, ordinal) AS INTEGER) AS rank
FROM profiles WHERE stage = 'before'"""
    )
    o["l2_sort_pct"] = _profs(
        """SELECT run_id, "column", CAST(row_number() OVER (PARTITION BY run_id ORDER BY missing_pct DESC, ordinal) AS INTEGER) AS rank
FROM profiles WHERE stage = 'before'"""
    )
    o["l3_head_preview"] = "SELECT * FROM events ORDER BY event_id LIMIT 10"
    o["l4_sort_quality"] = _profs(
        f"""SELECT run_id, "column", 100.0 - coalesce(pct_after, 0.0) AS quality_score,
  CAST(row_number() OVER (PARTITION BY run_id ORDER BY 100.0 - coalesce(pct_after, 0.0), "column") AS INTEGER) AS rank FROM {pairs}"""
    )
    busiest = "(SELECT user_email FROM runs GROUP BY user_email ORDER BY count(*) DESC, user_email LIMIT 1)"
    o["l6_latest_runs"] = _runs(
        f"SELECT run_id, user_email, ingested_at FROM runs WHERE user_email = {busiest} ORDER BY ingested_at DESC, run_id DESC LIMIT 50"
    )
    o["l9_history_order"] = _runs(
        f"""SELECT * FROM (SELECT run_id, '{H.SORT_RECENT}' AS order_mode FROM runs ORDER BY ingested_at DESC, run_id DESC LIMIT 20)
UNION ALL SELECT * FROM (SELECT run_id, '{H.SORT_OLDEST}' FROM runs ORDER BY ingested_at ASC, run_id ASC LIMIT 20)
UNION ALL SELECT * FROM (SELECT run_id, '{H.SORT_LARGEST}' FROM runs ORDER BY original_rows DESC, run_id ASC LIMIT 20)"""
    )
    o["r1_melt_pct"] = _profs(
        f"""SELECT run_id, "column", 'pct_before' AS variable, coalesce(pct_before, 0.0) AS value FROM {pairs}
UNION ALL SELECT run_id, "column", 'pct_after', coalesce(pct_after, 0.0) FROM {pairs}"""
    )
    o["r2_counts_per_stage"] = _profs(
        f"""SELECT run_id, "column", 'Before' AS stage, CAST(coalesce(count_before, 0) AS BIGINT) AS count FROM {pairs}
UNION ALL SELECT run_id, "column", 'After', CAST(coalesce(count_after, 0) AS BIGINT) FROM {pairs}"""
    )
    o["r3_rows_per_stage"] = _runs(
        f"""SELECT run_id, '{R.STAGE_ORIGINAL}' AS stage, CAST(original_rows AS BIGINT) AS "rows" FROM runs
UNION ALL SELECT run_id, '{R.STAGE_DEDUPED}', CAST(original_rows - dropped_duplicates AS BIGINT) FROM runs
UNION ALL SELECT run_id, '{R.STAGE_FINAL}', CAST(cleaned_rows AS BIGINT) FROM runs"""
    )
    o["r5_fixed_remaining"] = _runs(
        """SELECT run_id, 'Fixed' AS label, CAST(missing_before - missing_after AS BIGINT) AS value,
  (missing_before - missing_after) / missing_before * 100.0 AS share FROM runs WHERE missing_before > 0
UNION ALL SELECT run_id, 'Remaining', CAST(missing_after AS BIGINT), missing_after / missing_before * 100.0 FROM runs WHERE missing_before > 0"""
    )
    o["r6_column_types"] = _runs(
        """SELECT run_id, 'Numeric' AS kind, CAST(numeric_cols AS BIGINT) AS count FROM runs
UNION ALL SELECT run_id, 'Categorical', CAST(categorical_cols AS BIGINT) FROM runs"""
    )
    o["r7_completeness"] = _profs(
        f"""SELECT run_id, "column", 100.0 - coalesce(pct_before, 0.0) AS completeness_before,
  100.0 - coalesce(pct_after, 0.0) AS completeness_after, 100.0 - coalesce(pct_after, 0.0) AS quality_score FROM {pairs}"""
    )
    o["r8_issue_list"] = _runs(
        f"""WITH m AS ({_METRICS_SQL})
SELECT run_id, '{R.ISSUE_DUPLICATES}' AS issue, CAST(dropped_duplicates AS BIGINT) AS count,
  CASE WHEN original_rows > 0 THEN dropped_duplicates / original_rows * 100.0 ELSE 0.0 END AS percentage,
  CASE WHEN dropped_duplicates > original_rows * 0.05 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, '{R.STATUS_REMOVED}' AS status
FROM m WHERE dropped_duplicates > 0
UNION ALL
SELECT run_id, '{R.ISSUE_MISSING}', CAST(missing_before AS BIGINT), mb_pct,
  CASE WHEN mb_pct > 20 THEN 'HIGH' WHEN mb_pct > 5 THEN 'MEDIUM' ELSE 'LOW' END, '{R.STATUS_FILLED}'
FROM m WHERE missing_before > 0"""
    )
    o["r9_report_table"] = f"""{stages}, runs AS MATERIALIZED ({fx.RUNS_FLAT_SQL})
SELECT q.run_id, q."column", pct_before, pct_after, dtype_after, r.original_rows, r.cleaned_rows, r.dropped_duplicates
FROM ({ranked} FROM {both}) q LEFT JOIN runs r ON q.run_id = r.run_id WHERE rank >= 1"""
    o["r10_profile_report"] = _de(
        f"""SELECT "column", missing_pct, missing_count, dtype, unique_count,
  CASE WHEN length(samples) > 200 THEN substring(samples, 1, 197) || '...' ELSE samples END AS examples
FROM ({_profile_sql('de', DE_COLS, 'event_id')}) p"""
    )
    o["m_metrics"] = _runs(
        f"""WITH m AS ({_METRICS_SQL})
SELECT run_id, original_rows, cleaned_rows, dropped_duplicates, missing_before, missing_after,
  mb_pct AS missing_before_pct, ma_pct AS missing_after_pct, 100.0 - mb_pct AS quality_before, 100.0 - ma_pct AS quality_after,
  (100.0 - ma_pct) - (100.0 - mb_pct) AS improvement_points,
  CASE WHEN 100.0 - mb_pct > 0 THEN ((100.0 - ma_pct) - (100.0 - mb_pct)) / (100.0 - mb_pct) * 100.0 ELSE 0.0 END AS improvement_relative,
  CAST(CASE WHEN missing_before > 0 THEN missing_before - missing_after ELSE 0 END AS BIGINT) AS cells_fixed,
  CASE WHEN missing_before > 0 THEN (missing_before - missing_after) / missing_before * 100.0 ELSE 0.0 END AS quality_improvement_pct,
  CASE WHEN original_rows > 0 THEN dropped_duplicates / original_rows * 100.0 ELSE 0.0 END AS duplicate_pct,
  CAST(dropped_duplicates + (missing_before - missing_after) AS BIGINT) AS issues_resolved,
  CAST(original_rows - cleaned_rows AS BIGINT) AS rows_removed,
  CASE WHEN 100.0 - ma_pct >= 95 THEN '{R.BAND_EXCELLENT}' WHEN 100.0 - ma_pct >= 85 THEN '{R.BAND_GOOD}' ELSE '{R.BAND_WARNING}' END AS quality_band,
  CAST(cleaned_rows AS DOUBLE) / NULLIF(CAST(original_rows AS DOUBLE), 0) * 100.0 AS rows_retained_pct
FROM m"""
    )
    o["h1_kpis"] = _runs(
        """SELECT count(*) AS runs, CAST(sum(cleaned_rows) AS BIGINT) AS total_cleaned_rows,
  CAST(sum(dropped_duplicates) AS BIGINT) AS total_duplicates, CAST(sum(missing_before - missing_after) AS BIGINT) AS total_issues_fixed FROM runs"""
    )
    o["h2_avg"] = _runs(
        """SELECT avg(CASE WHEN missing_before > 0 AND missing_after <= missing_before
  THEN (missing_before - missing_after) / missing_before * 100.0 END) AS avg_improvement FROM runs"""
    )
    o["h3_listing"] = _runs(
        """SELECT run_id, coalesce(uploaded_filename, 'Unknown') AS file_name, substring(coalesce(run_id, 'N/A'), 1, 12) AS short_id,
  CAST(original_rows AS BIGINT) AS original_rows, CAST(cleaned_rows AS BIGINT) AS cleaned_rows,
  CAST(dropped_duplicates AS BIGINT) AS duplicates, CAST(columns AS BIGINT) AS columns,
  CASE WHEN missing_before > 0 THEN (missing_before - missing_after) / missing_before * 100.0 ELSE 0.0 END AS quality_improvement FROM runs"""
    )
    o["h4_user"] = _runs(f"SELECT run_id, user_email, original_rows FROM runs WHERE user_email = {busiest}")
    o["h5_per_user"] = _runs("SELECT user_email, count(*) AS processing_count FROM runs GROUP BY user_email")
    o["s1_s4_csv_roundtrip"] = fx.EVENTS_CSV_SQL
    o["s8_raw_copy"] = fx.EVENTS_CSV_SQL
    # the engine's own runs: the dirty events and the dirty pairs, measured over the raw tables
    dirty = f"WITH de AS ({fx.DIRTY_EVENTS_SQL}), dd AS ({fx.DIRTY_DUPS_SQL})"
    clean_dd = _clean_sql("dd", DD_COLS, set())
    dd_after = [(c, "float" if k == "integral" else k) for c, k in DD_COLS]
    o["j1_real_profiles"] = f"{dirty} " + " UNION ALL ".join(
        f"""SELECT '{run}' AS run_id, "column", CAST(missing_count AS BIGINT) AS missing_before, missing_pct AS pct_before,
  CAST(0 AS BIGINT) AS missing_after, CAST(0 AS DOUBLE) AS pct_after, CAST(missing_count AS BIGINT) AS fixed FROM ({_stats_sql(src, cols)}) s{src}"""
        for run, src, cols in (("events", "de", DE_COLS), ("pairs", "dd", DD_COLS))
    )
    real = [("events", "de", DE_COLS, DE_COERCED, DE_NULL_FREE, clean_de, after_cols), ("pairs", "dd", DD_COLS, set(), frozenset(), clean_dd, dd_after)]
    o["r9_real_report"] = f"{dirty}, cde AS ({clean_de}), cdd AS ({clean_dd}) " + " UNION ALL ".join(
        f"""SELECT '{run}' AS run_id, b."column", b.missing_pct AS pct_before, CAST(0 AS DOUBLE) AS pct_after, a.dtype AS dtype_after,
  m.original_rows, m.cleaned_rows, m.dropped_duplicates
FROM ({_stats_sql(src, cols)}) b JOIN ({_stats_sql('c' + src, after)}) a ON a."column" = b."column" CROSS JOIN ({summary_sql(src, cols, coerced, null_free)}) m"""
        for run, src, cols, coerced, null_free, _, after in real
    )
    runs_real = " UNION ALL ".join(
        f"SELECT '{run}' AS run_id, m.* FROM ({summary_sql(src, cols, coerced, null_free)}) m" for run, src, cols, coerced, null_free, _, _ in real
    )
    metrics = o["m_metrics"]
    o["m_real_metrics"] = f"{dirty}, runs AS ({runs_real}), {metrics[metrics.index('m AS ('):]}"
    o["s1_csv_documents"] = """SELECT 'd' AS kind, doc_id AS id, CAST(0 AS BIGINT) AS part,
  'He said ""hi"", "' || text || '"' || chr(10) || ', end' AS text FROM documents
UNION ALL SELECT 'c', conv_id, CAST(turn AS BIGINT), 'He said ""hi"", "' || text || '"' || chr(10) || ', end' FROM conversations"""
    flag = "CASE WHEN event_id % 7 <> 0 THEN CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE 1.0 END END"
    o["s1_csv_bool_blank"] = (
        f"WITH e AS (SELECT event_id, CAST({flag} AS DOUBLE) AS flag FROM events) "
        "SELECT DISTINCT event_id, coalesce(flag, (SELECT median(flag) FROM e)) AS flag FROM e"
    )
    rt_cols = [(c, {"user_id": "float", "ts": "string"}.get(c, k)) for c, k in DE_COLS]
    o["i7_clean_file"] = f"WITH rt AS ({fx.EVENTS_CSV_SQL}) SELECT * FROM ({_clean_sql('rt', rt_cols, DE_COERCED, DE_NULL_FREE)}) x"
    o["st1_frozen_stream_clean"] = _de(f"SELECT * FROM ({_clean_sql('de', DE_COLS, DE_COERCED, DE_NULL_FREE, apply_all=True)}) x")
    rt_nulls = " + ".join(f"count_if({c} IS NULL)" for c, _ in rt_cols)
    # cleaned schema: event_id (bigint), user_id and value_txt (double) are numeric, the rest text
    n_numeric = 3
    rt_summary = summary_sql("rt", rt_cols, DE_COERCED, DE_NULL_FREE)
    o["s5_s6_summary_json"] = f"""WITH rt AS ({fx.EVENTS_CSV_SQL})
SELECT s.original_rows, s.cleaned_rows, s.dropped_duplicates, s.missing_before, s.missing_after,
  CAST((SELECT count(*) FROM rt) AS BIGINT) AS "rows",
  (SELECT {_pct(rt_nulls, f'count(*) * {len(rt_cols)}')} FROM rt) AS missing_pct,
  CAST({n_numeric} AS INTEGER) AS numeric_cols, CAST({len(rt_cols) - n_numeric} AS INTEGER) AS categorical_cols
FROM ({rt_summary}) s"""
    per_file = []
    for k in range(3):
        one = rt_summary.replace("FROM rt", f"FROM rt{k}")
        per_file.append(f"""SELECT s.original_rows, s.cleaned_rows, s.dropped_duplicates, s.missing_before, s.missing_after,
  CAST(s.columns AS INTEGER) AS columns FROM ({one}) s""")
    parts = ", ".join(f"rt{k} AS (SELECT * FROM ({fx.EVENTS_CSV_SQL}) x WHERE event_id % 3 = {k})" for k in range(3))
    o["st1_landing"] = f"WITH {parts} " + " UNION ALL ".join(per_file)
    o["i8_ingest"] = f"""WITH rt AS ({fx.EVENTS_CSV_SQL})
SELECT 'events.csv' AS uploaded_filename, s.original_rows, s.cleaned_rows, s.dropped_duplicates,
  s.missing_before, s.missing_after, CAST(s.columns AS INTEGER) AS columns
FROM ({rt_summary}) s"""
    return o


ORACLE_SQL: dict[str, str] = _oracle()
