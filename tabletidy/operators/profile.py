"""Column profiling.

A full profile is one scan and one shuffle of cells, whatever the table's width:
every cell is unpivoted to ``(ordinal, typed slots)`` and aggregated into a frequency
table ``(ordinal, value) → n, first_ord`` (map-side partial aggregation, so a
value that fills a third of a column costs one row per task in the shuffle).
The cell predicates (missing, raw null, numeric text) are then evaluated once
per *distinct* value instead of once per cell; the per-column counts, distinct
counts, modes and first-k samples all derive from that one table, whose shuffle
both consumers read.

``stats_frame`` is the shuffle-free variant (one wide aggregate, one tiny row
per task) for callers that need only the counts: the fit step, the raw preview.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabletidy.functions.predicates import (
    NUMERIC_KINDS,
    PLACEHOLDERS,
    Placeholders,
    dtype_label,
    is_missing,
    is_placeholder,
    kind_of,
    numeric_text_ok,
    parses_as_number,
    pct,
    placeholder_sets,
)

ORD = "__tt_ord"

PROFILE_SCHEMA = T.StructType(
    [
        T.StructField("column", T.StringType(), False),
        T.StructField("ordinal", T.IntegerType(), False),
        T.StructField("missing_count", T.LongType(), False),
        T.StructField("type_issues", T.LongType(), False),
        T.StructField("total_issues", T.LongType(), False),
        T.StructField("missing_pct", T.DoubleType(), False),
        T.StructField("dtype", T.StringType(), False),
        T.StructField("unique_count", T.LongType(), False),
        T.StructField("sample_values", T.ArrayType(T.StringType()), True),
    ]
)


def is_null_like(c: Column, dt: T.DataType) -> Column:
    """A raw null as a pandas reader sees it: null, or NaN in a float column."""
    return (c.isNull() | F.isnan(c)) if kind_of(dt) == "float" else c.isNull()


def with_order(df: DataFrame, order_by: str | None) -> DataFrame:
    """Attach the order-of-appearance key used by samples and previews.

    An explicit column keeps its own type (numbers, texts, dates, timestamps), nulls
    last. Without one the key is the scan position (``monotonically_increasing_id``),
    which follows the offsets inside a file; the order of several files is Spark's.
    """
    if ORD in df.columns:
        return df
    if order_by is not None:
        c = F.col(f"`{order_by}`")
        return df.withColumn(ORD, F.struct(c.isNull().alias("none"), c.alias("key")))
    return df.withColumn(ORD, F.monotonically_increasing_id())


def _order_key(df: DataFrame) -> Column:
    """The order key as a plain column (null last): the minimum of a struct is no fixed-width
    buffer, so Spark would sort all cells to aggregate it instead of hashing them."""
    return F.col(f"{ORD}.key") if isinstance(df.schema[ORD].dataType, T.StructType) else F.col(ORD)


def spread(df: DataFrame, order_by: str | None = None) -> DataFrame:
    """The input dealt over all task slots and persisted, for callers that ask for it.

    For a table of a few large partitions that is scanned more than once (one
    unsplittable file): it gets its order key first, so first-appearance semantics
    survive. Never done by itself; release it with ``unpersist()``.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return with_order(df, order_by).repartition(slots).persist(StorageLevel.MEMORY_AND_DISK)


def _fields(df: DataFrame, columns: Sequence[str] | None) -> list[tuple[int, T.StructField]]:
    fields = [f for f in df.schema.fields if f.name != ORD]
    if columns is not None:
        wanted = set(columns)
        return [(i, f) for i, f in enumerate(fields) if f.name in wanted]
    return list(enumerate(fields))


def stats_frame(
    df: DataFrame, placeholders: Placeholders = PLACEHOLDERS, approx_rsd: float | None = None, registers: int | None = None
) -> DataFrame:
    """Per-column counts from one aggregate pass.

    Columns: column, ordinal, kind, rows, missing_count, null_count, numeric_ok,
    dtype, is_numeric, type_issues, total_issues, missing_pct. One pass for a table of
    any width. With ``approx_rsd`` each column also gets ``unique_count`` from a
    HyperLogLog sketch (``approx_count_distinct``) of its non-missing values; with
    ``registers`` (log2 of their number) the mergeable ``sketch`` itself.
    """
    fields = _fields(df, None)
    ph = placeholder_sets(placeholders)
    # Evaluate each cell predicate once in a projection, then count the flags.
    flags: list[Column] = []
    aggs: list[Column] = [F.count(F.lit(1)).alias("rows")]
    for i, f in fields:
        c = F.col(f"`{f.name}`")
        flags.append(is_missing(c, f.dataType, ph(f.name)).alias(f"m{i}"))
        flags.append(is_null_like(c, f.dataType).alias(f"n{i}"))
        aggs += [F.count_if(F.col(f"m{i}")).alias(f"m{i}"), F.count_if(F.col(f"n{i}")).alias(f"n{i}")]
        if kind_of(f.dataType) == "string":
            flags.append(parses_as_number(c, f.dataType).alias(f"p{i}"))
            aggs.append(F.count_if(~F.col(f"m{i}") & F.col(f"p{i}")).alias(f"k{i}"))
        if approx_rsd is not None:
            flags.append(F.when(~is_missing(c, f.dataType, ph(f.name)), c).alias(f"v{i}"))  # typed: no text cast
            aggs.append(F.approx_count_distinct(F.col(f"v{i}"), approx_rsd).alias(f"u{i}"))
        if registers is not None:
            slot, v = _slots(c, f.dataType)
            flags.append(F.when(~is_missing(c, f.dataType, ph(f.name)), F.xxhash64(v) if slot == "d" else v).alias(f"h{i}"))
            aggs.append(F.hll_sketch_agg(F.col(f"h{i}"), registers).alias(f"h{i}"))
    one = df.select(*flags).agg(*aggs)
    rows = F.col("rows")
    entries = []
    for i, f in fields:
        k = kind_of(f.dataType)
        m, n = F.col(f"m{i}"), F.col(f"n{i}")
        if k == "string":
            ok = F.col(f"k{i}")
        elif k in NUMERIC_KINDS:
            ok = rows - m
        else:
            ok = F.lit(0).cast("long")
        label = F.when(n > 0, dtype_label(f.dataType, True)).otherwise(dtype_label(f.dataType, False))
        entries.append(
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(i).alias("ordinal"),
                F.lit(k).alias("kind"),
                rows.alias("rows"),
                m.alias("missing_count"),
                n.alias("null_count"),
                ok.cast("long").alias("numeric_ok"),
                label.alias("dtype"),
                *([F.col(f"u{i}").cast("long").alias("unique_count")] if approx_rsd is not None else []),
                *([F.col(f"h{i}").alias("sketch")] if registers is not None else []),
            )
        )
    if not entries:
        return one.sparkSession.createDataFrame(
            [],
            "column string, ordinal int, kind string, rows bigint, missing_count bigint, "
            "null_count bigint, numeric_ok bigint, dtype string, is_numeric boolean, type_issues bigint, "
            "total_issues bigint, missing_pct double",
        )
    return _with_verdicts(one.select(F.inline(F.array(*entries))))


def _text(c: Column, dt: T.DataType) -> Column:
    """A cell as text; the two zeros of a float column are one value."""
    return (c + F.lit(0.0).cast(dt)).cast("string") if kind_of(dt) == "float" else c.cast("string")


def _slots(c: Column, dt: T.DataType) -> tuple[str, Column]:
    """The slot of a cell and its value there: equal values are equal in it, as they are as texts.

    ``l`` takes integers, booleans, dates and instants (two of one wall-clock hour stay two), ``d``
    floating point (one zero, one NaN), ``s`` the text of all else.
    """
    if kind_of(dt) in ("integral", "bool"):
        return "l", c.cast("long")
    if isinstance(dt, T.DateType):
        return "l", F.unix_date(c).cast("long")
    if isinstance(dt, T.TimestampType):
        return "l", F.unix_micros(c)
    if kind_of(dt) == "float":
        return "d", c.cast("double") + F.lit(0.0)
    return "s", c.cast("string")


_SLOT_TYPES = {"l": "bigint", "d": "double", "s": "string"}


def _slot_text(fields: list[tuple[int, T.StructField]]) -> Column:
    """The text of a slotted cell, as a cast of the column itself gives it."""
    groups: dict[str, tuple[Column, list[int]]] = {}
    for i, f in fields:
        slot, _ = _slots(F.lit(None), f.dataType)
        if slot == "s":
            groups.setdefault("s", (F.col("s"), []))[1].append(i)
        elif kind_of(f.dataType) == "bool":
            groups.setdefault("bool", (F.col("l").cast("boolean").cast("string"), []))[1].append(i)
        elif isinstance(f.dataType, T.DateType):
            groups.setdefault("date", (F.date_from_unix_date(F.col("l").cast("int")).cast("string"), []))[1].append(i)
        elif isinstance(f.dataType, T.TimestampType):
            groups.setdefault("ts", (F.timestamp_micros("l").cast("string"), []))[1].append(i)
        elif isinstance(f.dataType, T.FloatType):
            groups.setdefault("float", (F.col("d").cast("float").cast("string"), []))[1].append(i)
        else:
            groups.setdefault(slot, (F.col(slot).cast("string"), []))[1].append(i)
    (first, _), *rest = groups.values()
    text = first
    for value, ordinals in rest:
        text = F.when(F.col("ordinal").isin(ordinals), value).otherwise(text)
    return text


def _cell_counts(df: DataFrame, exclude: str, columns: Sequence[str] | None, placeholders: Placeholders, order_by: str | None, with_first: bool) -> DataFrame | None:
    """``(ordinal, l?, d?, s?, n, first_ord?)``: the frequency table in typed slots (those in use)."""
    ph = placeholder_sets(placeholders)
    src = (df if ORD in df.columns else with_order(df, order_by)) if with_first else df
    fields = _fields(df, columns)
    if not fields:
        return None
    used = sorted({_slots(F.lit(None), f.dataType)[0] for _, f in fields})
    cells = []
    for i, f in fields:
        c = F.col(f"`{f.name}`")
        slot, v = _slots(c, f.dataType)
        if exclude == "missing":
            v = F.when(~is_missing(c, f.dataType, ph(f.name)), v)
        elif exclude == "null":
            v = F.when(~is_null_like(c, f.dataType), v)
        cells.append(F.struct(F.lit(i).alias("ordinal"), *[(v if u == slot else F.lit(None).cast(_SLOT_TYPES[u])).alias(u) for u in used]))
    keep = [F.col(ORD)] if with_first else []
    long_form = src.select(*keep, F.inline(F.array(*cells)))
    if exclude != "none":
        there = F.col(used[0]).isNotNull()
        for u in used[1:]:
            there = there | F.col(u).isNotNull()
        long_form = long_form.where(there)
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.min(_order_key(src)).alias("first_ord")] if with_first else [])
    return long_form.groupBy("ordinal", *used).agg(*aggs)


def frequency_table(
    df: DataFrame,
    exclude: str = "missing",
    columns: Sequence[str] | None = None,
    placeholders: Placeholders = PLACEHOLDERS,
    order_by: str | None = None,
    with_first: bool = True,
) -> DataFrame:
    """``(ordinal, value, n, first_ord)``: how often each text value occurs per column.

    Cells are grouped in typed slots (numbers and instants as numbers); the text is made once
    per distinct value, after the shuffle.

    ``with_first=False`` leaves out ``first_ord`` (no order key is attached or
    carried through the shuffle) when only counts are needed.

    ``exclude="missing"`` leaves out P1-missing cells (profile semantics);
    ``exclude="null"`` only raw nulls/NaN (the raw column info, A18);
    ``exclude="none"`` keeps every cell, a null cell as a null ``value``.
    """
    counts = _cell_counts(df, exclude, columns, placeholders, order_by, with_first)
    if counts is None:
        schema = "ordinal int, value string, n bigint" + (", first_ord bigint" if with_first else "")
        return df.sparkSession.createDataFrame([], schema)
    return counts.select("ordinal", _slot_text(_fields(df, columns)).alias("value"), "n", *(["first_ord"] if with_first else []))


def first_values(freq: DataFrame, top_values: int = 3) -> DataFrame:
    """``(ordinal, sample_values)``: the first ``top_values`` distinct texts by first appearance.

    The ``row_number() <= k`` filter becomes a window group limit that also runs
    before the shuffle, so each task sends at most k rows per column.
    """
    w = Window.partitionBy("ordinal").orderBy(F.col("first_ord").asc_nulls_last(), "value")
    return (
        freq.withColumn("rk", F.row_number().over(w))
        .where(F.col("rk") <= top_values)
        .groupBy("ordinal")
        .agg(F.sort_array(F.collect_list(F.struct("rk", "value"))).alias("s"))
        .select("ordinal", F.col("s.value").alias("sample_values"))
    )


def value_stats(freq: DataFrame, top_values: int = 3) -> DataFrame:
    """``(ordinal, unique_count, sample_values)`` from a frequency table."""
    uniques = freq.groupBy("ordinal").agg(F.count(F.lit(1)).alias("unique_count"))
    return uniques.join(first_values(freq, top_values), "ordinal", "left")


def mode_frame(freq: DataFrame) -> DataFrame:
    """``(ordinal, mode)``: most frequent value, ties to the smallest.

    ``min_by`` over ``(-n, value)`` is a plain aggregate with map-side partials,
    so no single buffer ever holds a column's distinct values.
    """
    return freq.groupBy("ordinal").agg(
        F.min_by("value", F.struct((-F.col("n")).alias("nn"), F.col("value"))).alias("mode")
    )


def _field_table(df: DataFrame) -> DataFrame:
    """One row per column: ordinal, name, kind and its two possible dtype labels."""
    rows = [
        (i, f.name, kind_of(f.dataType), dtype_label(f.dataType, True), dtype_label(f.dataType, False))
        for i, f in _fields(df, None)
    ]
    return df.sparkSession.createDataFrame(
        rows, "ordinal int, column string, kind string, label_nulls string, label_plain string"
    )


def _value_flags(df: DataFrame, placeholders: Placeholders) -> dict[str, Column]:
    """P1 / raw-null / P3 flags of a frequency-table row, from its column's kind."""
    fields = _fields(df, None)
    ph = placeholder_sets(placeholders)

    def ords(pred) -> list[int]:
        return [i for i, f in fields if pred(kind_of(f.dataType))]

    o, v = F.col("ordinal"), F.col("value")
    is_str = o.isin(ords(lambda k: k == "string"))
    is_flt = o.isin(ords(lambda k: k == "float"))
    is_num = o.isin(ords(lambda k: k in NUMERIC_KINDS))
    null_like = v.isNull() | (is_flt & (v == F.lit("NaN")))
    # text columns grouped by their placeholder set (one set unless overridden)
    by_set: dict[tuple[str, ...], list[int]] = {}
    for i, f in fields:
        if kind_of(f.dataType) == "string":
            by_set.setdefault(ph(f.name), []).append(i)
    hit = F.lit(False)
    for texts, ordinals in by_set.items():
        hit = hit | (o.isin(ordinals) & is_placeholder(v, texts))
    missing = null_like | hit
    num_ok = ~missing & (F.when(is_str, numeric_text_ok(v)).otherwise(is_num))
    return {"null_like": null_like, "missing": missing, "num_ok": num_ok}


def profile_frame(
    df: DataFrame,
    top_values: int = 3,
    placeholders: Placeholders = PLACEHOLDERS,
    order_by: str | None = None,
    freq: DataFrame | None = None,
    samples: DataFrame | None = None,
) -> DataFrame:
    """Everything about every column from one frequency table.

    Columns: the ``PROFILE_SCHEMA`` fields plus ``kind``, ``rows``, ``null_count``,
    ``numeric_ok`` and ``is_numeric`` (the fit step's inputs). Counts and samples read
    the same shuffle of cells: both sit on one filter over the table that needs all its
    columns, so their plans agree up to the exchange and it is computed once. With
    ``samples`` (``first_values_scan``) no order key takes part in the shuffle.
    """
    ph = placeholders
    fields = _field_table(df)
    if freq is None:
        freq = frequency_table(df, "none", None, ph, order_by, with_first=samples is None)
    if samples is None:
        freq = freq.where((F.col("n") > 0) | F.col("first_ord").isNotNull())  # true for every row
    flags = _value_flags(df, ph)
    n = F.col("n")
    counts = freq.groupBy("ordinal").agg(
        F.sum(n).alias("rows"),
        F.sum(F.when(flags["missing"], n).otherwise(0)).alias("missing_count"),
        F.sum(F.when(flags["null_like"], n).otherwise(0)).alias("null_count"),
        F.sum(F.when(flags["num_ok"], n).otherwise(0)).alias("numeric_ok"),
        F.count_if(~flags["missing"]).alias("unique_count"),
    )
    # the condition needs n, so it stays above the shared exchange
    if samples is None:
        samples = first_values(freq.where(F.when(n > 0, ~flags["missing"])), top_values)
    zero = F.lit(0).cast("long")
    # one row per column on all sides: bounded by the table's width
    joined = fields.join(F.broadcast(counts), "ordinal", "left").join(F.broadcast(samples), "ordinal", "left")
    rows = F.coalesce("rows", zero)  # every cell, null or not, is in the table
    base = joined.select(
        "column",
        F.col("ordinal").cast("int").alias("ordinal"),
        "kind",
        F.coalesce("missing_count", zero).cast("long").alias("missing_count"),
        F.coalesce("null_count", zero).cast("long").alias("null_count"),
        F.coalesce("numeric_ok", zero).cast("long").alias("numeric_ok"),
        rows.cast("long").alias("rows"),
        F.when(F.coalesce("null_count", zero) > 0, F.col("label_nulls")).otherwise(F.col("label_plain")).alias("dtype"),
        F.coalesce("unique_count", zero).cast("long").alias("unique_count"),
        F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"),
    )
    return _with_verdicts(base)


def _with_verdicts(per_col: DataFrame) -> DataFrame:
    """P4, A5, A6, A3 from per-column counts (rows, missing_count, numeric_ok, kind)."""
    nonmissing = F.col("rows") - F.col("missing_count")
    # Strictly more than 80 % of the non-missing values parse as numbers.
    is_numeric = F.coalesce(
        F.try_divide(F.col("numeric_ok").cast("double"), nonmissing.cast("double")) > 0.8, F.lit(False)
    )
    type_issues = F.when((F.col("kind") == "string") & is_numeric, nonmissing - F.col("numeric_ok")).otherwise(
        F.lit(0).cast("long")
    )
    return (
        per_col.withColumn("is_numeric", is_numeric)
        .withColumn("type_issues", type_issues.cast("long"))
        .withColumn("total_issues", F.col("missing_count") + F.col("type_issues"))
        .withColumn("missing_pct", pct(F.col("missing_count"), F.col("rows")))
    )


PROFILE_COLUMNS = [f.name for f in PROFILE_SCHEMA.fields]


def profile_rows(
    df: DataFrame,
    top_values: int = 3,
    placeholders: Placeholders = PLACEHOLDERS,
    order_by: str | None = None,
    sort: str = "total_issues",
    approx_rsd: float | None = None,
) -> list:
    """Eager A8 (``profile_frame`` rows, sorted): one row per column.

    Samples come from a scan, so cells shuffle without order keys; with ``approx_rsd`` no
    cells are shuffled (``profile_approx_frame``).
    """
    if approx_rsd is not None:  # counts from the shuffle-free pass, distinct counts sketched
        rows = profile_approx_frame(df, top_values, placeholders, order_by, approx_rsd).collect()
    else:
        samples = first_values_scan(df, top_values, placeholders, order_by)
        rows = profile_frame(df, top_values, placeholders, order_by, samples=samples).collect()
    return sorted(rows, key=lambda r: (-r[sort], r["ordinal"]))


def profile(
    df: DataFrame,
    top_values: int = 3,
    placeholders: Placeholders = PLACEHOLDERS,
    order_by: str | None = None,
    sort: str = "total_issues",
) -> DataFrame:
    """One row per column with the fields of ``PROFILE_SCHEMA``.

    ``sort="total_issues"`` (engine order, L1) or ``"missing_pct"`` (library
    order, L2); both descending with the column ordinal pinning ties.
    """
    full = profile_frame(df, top_values, placeholders, order_by)
    return full.select(*PROFILE_COLUMNS).orderBy(F.col(sort).desc(), F.col("ordinal"))


#: Rows of the table's beginning that the search for samples looks at before it asks for more.
PREFIX_ROWS = 256


def first_found(
    df: DataFrame, top_values: int = 3, placeholders: Placeholders = PLACEHOLDERS, order_by: str | None = None
) -> dict[int, list[tuple]]:
    """Per column the first ``top_values`` distinct values in the table's order, as (key, text).

    Most columns show that many within the table's first rows, which a top-k (in scan order: the
    first partitions alone) brings to the driver. The others are asked for in one pass whether
    they hold any further value, a flag per column; only a column that does takes part in further
    passes, each of which finds its next value by least key. Values tied at a key go by text.
    """
    ph = placeholder_sets(placeholders)
    fields = _fields(df, None)
    if not fields:
        return {}
    scan = order_by is None and ORD not in df.columns
    src = with_order(df, order_by)
    # values in their own type where equal values are equal texts; ties of a given key go by text
    typed = {i: scan and kind_of(f.dataType) in ("string", "integral", "bool") for i, f in fields}
    values = {
        i: F.when(~is_missing(F.col(f"`{f.name}`"), f.dataType, ph(f.name)), F.col(f"`{f.name}`") if typed[i] else _text(F.col(f"`{f.name}`"), f.dataType))
        for i, f in fields
    }
    ordered = src if scan else src.orderBy(ORD)
    head = ordered.select(F.col(ORD).alias("o"), *[v.alias(f"v{i}") for i, v in values.items()]).limit(PREFIX_ROWS).collect()
    whole = len(head) < PREFIX_ROWS
    if not whole and not scan:  # rows tied with the last one may be missing
        head = [r for r in head if r["o"] != head[-1]["o"]]
    words = {True: "true", False: "false"}
    text = lambda v: words[v] if isinstance(v, bool) else str(v)
    found: dict[int, list[tuple]] = {}
    for i, _ in fields:
        best: dict = {}
        for r in head:
            if (v := r[f"v{i}"]) is not None and v not in best:
                best[v] = r["o"]
        # rows come by key: a value's first key is its least; equal keys go by text
        place = {}
        for r in head:
            place.setdefault(r["o"], len(place))
        order = sorted(best, key=lambda v: (place[best[v]], text(v)))
        found[i] = [(best[v], v) for v in order[:top_values]]
    open_ = set() if whole else {i for i in found if len(found[i]) < top_values}

    def new(i: int) -> Column:
        v = values[i]
        return v.isNotNull() & ~v.isin([x for _, x in found[i]]) if found[i] else v.isNotNull()

    if open_:
        more = src.agg(*[F.bool_or(new(i)).alias(f"f{i}") for i in sorted(open_)]).first()
        open_ = {i for i in open_ if more[f"f{i}"]}
    while open_:
        firsts = [F.min(F.when(new(i), F.struct(F.col(ORD).alias("o"), values[i].alias("v")))).alias(f"f{i}") for i in sorted(open_)]
        row = src.agg(*firsts).first()
        for i in sorted(open_):
            if row[f"f{i}"] is not None:
                found[i].append((row[f"f{i}"]["o"], row[f"f{i}"]["v"]))
            if row[f"f{i}"] is None or len(found[i]) == top_values:
                open_.discard(i)
    return {i: [(k, text(v)) for k, v in vs] for i, vs in found.items()}


def first_values_scan(
    df: DataFrame,
    top_values: int = 3,
    placeholders: Placeholders = PLACEHOLDERS,
    order_by: str | None = None,
) -> DataFrame:
    """``(ordinal, sample_values)`` as ``first_values`` gives, without shuffling cells (``first_found``).

    The result (a few values per column) is held by the driver.
    """
    rows = [(i, [v for _, v in vs]) for i, vs in first_found(df, top_values, placeholders, order_by).items()]
    return df.sparkSession.createDataFrame(rows, "ordinal int, sample_values array<string>")


def profile_approx(
    df: DataFrame,
    top_values: int = 3,
    placeholders: Placeholders = PLACEHOLDERS,
    order_by: str | None = None,
    sort: str = "total_issues",
    rsd: float = 0.05,
) -> DataFrame:
    """A8 with an approximate ``unique_count`` (opt-in, SURVEY A4): no shuffle of cells.

    Counts come from the shuffle-free pass (plus a HyperLogLog sketch per column
    with relative standard deviation ``rsd``); samples are exact and come from
    ``first_values_scan`` (a few more passes over the columns). Every other field equals ``profile``'s.
    """
    full = profile_approx_frame(df, top_values, placeholders, order_by, rsd)
    return full.select(*PROFILE_COLUMNS).orderBy(F.col(sort).desc(), F.col("ordinal"))


def profile_approx_frame(
    df: DataFrame,
    top_values: int = 3,
    placeholders: Placeholders = PLACEHOLDERS,
    order_by: str | None = None,
    rsd: float = 0.05,
) -> DataFrame:
    """``profile_frame``'s columns with ``unique_count`` from a sketch (no shuffle of cells)."""
    stats = stats_frame(df, placeholders, approx_rsd=rsd)
    samples = first_values_scan(df, top_values, placeholders, order_by)
    # one row per column on both sides: bounded by the table's width
    return stats.join(F.broadcast(samples), "ordinal", "left").select(
        *[c for c in stats.columns if c != "ordinal"],
        F.col("ordinal").cast("int").alias("ordinal"),
        F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"),
    )


def raw_preview_profile(df: DataFrame) -> DataFrame:
    """Per column the raw null count and share (no placeholders) and its type."""
    return stats_frame(df).select(
        "column",
        "ordinal",
        "dtype",
        F.col("null_count").alias("null_count"),
        pct(F.col("null_count"), F.col("rows")).alias("null_pct"),
    )


def raw_column_info(df: DataFrame) -> DataFrame:
    """Per column type, raw nulls, and distinct non-null values (placeholders count)."""
    freq = frequency_table(df, "none", with_first=False)
    null_like = _value_flags(df, PLACEHOLDERS)["null_like"]
    zero = F.lit(0).cast("long")
    counts = freq.groupBy("ordinal").agg(
        F.sum(F.when(null_like, F.col("n")).otherwise(0)).alias("nulls"), F.count_if(~null_like).alias("uniques")
    )
    joined = _field_table(df).join(F.broadcast(counts), "ordinal", "left")
    nulls = F.coalesce("nulls", zero)
    return joined.select(
        "column",
        F.col("ordinal").cast("int").alias("ordinal"),
        F.when(nulls > 0, F.col("label_nulls")).otherwise(F.col("label_plain")).alias("dtype"),
        nulls.cast("long").alias("null_count"),
        F.coalesce("uniques", zero).cast("long").alias("unique_count"),
    )


def raw_null_pct(df: DataFrame) -> DataFrame:
    """A1 + A10: rows, columns and raw null cells as a share of all cells."""
    fields = _fields(df, None)
    ncols = len(fields)
    nulls = [F.count_if(is_null_like(F.col(f"`{f.name}`"), f.dataType)) for _, f in fields]
    total_nulls = sum(nulls[1:], nulls[0]) if nulls else F.lit(0).cast("long")
    one = df.agg(F.count(F.lit(1)).alias("rows"), total_nulls.cast("long").alias("null_cells"))
    return one.select(
        "rows",
        F.lit(ncols).alias("columns"),
        "null_cells",
        pct(F.col("null_cells"), F.col("rows") * ncols).alias("missing_pct"),
    )


def head_preview(df: DataFrame, n: int = 10, order_by: str | None = None) -> DataFrame:
    """L3: the first n rows in order of appearance (a top-k, not a row cap)."""
    src = with_order(df, order_by)
    return src.orderBy(ORD).limit(n).drop(ORD)
