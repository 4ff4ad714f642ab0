"""Fill values (A12-A14, I1-I3) computed without single-buffer aggregates.

* Exact median: Spark's ``median``/``percentile`` keep every distinct value of a
  group in one buffer; for a whole-column median that is one task holding the
  column. Instead the rank bracket around the middle is narrowed with
  ``percentile_approx`` (bounded sketch) and verified with exact counts; the last
  small bracket is resolved from a (value, count) table and a running sum.
  All columns are handled in the same passes.
* Earliest timestamp: a plain ``min`` (map-side partials).
* Mode: frequent-items sketch, exact counts of its candidates and a bound on all other values; where
  that proves nothing, frequency table + ``min_by`` (see ``profile.mode_frame``).
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabletidy.operators.profile import _fields, frequency_table, mode_frame


def _value(name: str):
    c = F.col(f"`{name}`").cast("double")
    return F.nanvl(c, F.lit(None).cast("double"))


def exact_medians(
    df: DataFrame,
    columns: Sequence[str],
    counts: dict[str, int] | None = None,
    accuracy: int = 10_000,
) -> dict[str, float | None]:
    """Exact median of each column (nulls and NaN skipped; even count → mean of the middle two).

    Each middle rank r is a *target*. A round asks ``percentile_approx`` for two
    values a ≤ b around r inside the target's current bracket, then counts
    exactly how many values are < a, ≤ a, < b and ≤ b. If r falls on the copies
    of a or of b the answer is found; if it falls strictly between them the
    bracket becomes the open interval (a, b), which excludes both, so a value
    holding a third of the column cannot stall the search. If the sketch missed the
    rank, the probe widens until it spans the bracket. Every round so finds the value,
    loses two distinct values or widens, and rounds go on until all targets are found:
    brackets shrink by about ``accuracy`` a round, and a bracket of fewer rows than that
    is exact in the sketch. Every pass is an aggregate over the whole table with a few
    numbers per column as its result; nothing is sorted or gathered.
    """
    columns = list(columns)
    if not columns:
        return {}
    if counts is None:
        row = df.agg(*[F.count(_value(c)).alias(f"c{i}") for i, c in enumerate(columns)]).first()
        counts = {c: int(row[f"c{i}"]) for i, c in enumerate(columns)}
    out: dict[str, float | None] = {c: None for c in columns}
    # one target per middle rank: column, rank, bracket (lo, lo_open, hi, hi_open), rows below/inside
    targets: list[dict[str, Any]] = []
    for c in columns:
        n = counts[c]
        if n > 0:
            for r in sorted({(n - 1) // 2, n // 2}):
                targets.append({"col": c, "r": r, "lo": None, "lo_open": False, "hi": None, "hi_open": False,
                                "below": 0, "inside": n, "margin": 2.0, "value": None})

    def in_bracket(t: dict[str, Any]):
        v = _value(t["col"])
        cond = v.isNotNull()
        if t["lo"] is not None:
            cond = cond & ((v > F.lit(t["lo"])) if t["lo_open"] else (v >= F.lit(t["lo"])))
        if t["hi"] is not None:
            cond = cond & ((v < F.lit(t["hi"])) if t["hi_open"] else (v <= F.lit(t["hi"])))
        return cond

    eps = 1.0 / accuracy
    while todo := [t for t in targets if t["value"] is None]:
        probes = []
        for i, t in enumerate(todo):
            q = (t["r"] - t["below"]) / t["inside"]
            qs = [max(0.0, q - t["margin"] * eps), min(1.0, q + t["margin"] * eps)]
            probes.append(F.percentile_approx(F.when(in_bracket(t), _value(t["col"])), qs, accuracy).alias(f"p{i}"))
        approx = df.agg(*probes).first()
        checks = []
        for i, t in enumerate(todo):
            if approx[f"p{i}"] is None or None in approx[f"p{i}"]:
                raise RuntimeError(f"the values of {t['col']} changed between two passes: persist or write the input first")
            a, b = approx[f"p{i}"]
            v = _value(t["col"])
            checks += [
                F.count_if(v < F.lit(a)).alias(f"la{i}"),
                F.count_if(v <= F.lit(a)).alias(f"ea{i}"),
                F.count_if(v < F.lit(b)).alias(f"lb{i}"),
                F.count_if(v <= F.lit(b)).alias(f"eb{i}"),
            ]
        exact = df.agg(*checks).first()
        for i, t in enumerate(todo):
            a, b = approx[f"p{i}"]
            la, ea, lb, eb = (int(exact[f"{k}{i}"]) for k in ("la", "ea", "lb", "eb"))
            r = t["r"]
            if la <= r < ea:
                t["value"] = float(a)
            elif lb <= r < eb:
                t["value"] = float(b)
            elif ea <= r < lb:
                t.update(lo=a, lo_open=True, hi=b, hi_open=True, below=ea, inside=lb - ea)
            else:
                t["margin"] *= 4.0  # the sketch missed the rank: widen the probe and retry

    for c in columns:
        vals = [t["value"] for t in targets if t["col"] == c]
        if vals:
            out[c] = sum(vals) / len(vals)
    return out


def column_minimums(df: DataFrame, columns: Sequence[str]) -> dict[str, Any]:
    """Earliest non-null value per column, one aggregate.

    A ``TIMESTAMP`` (an instant) comes as an aware UTC datetime, whatever the zone of the
    driver or the session; wall-clock timestamps and dates come as they are.
    """
    columns = list(columns)
    if not columns:
        return {}
    types = {f.name: f.dataType for f in df.schema.fields}
    instant = {c: isinstance(types[c], T.TimestampType) for c in columns}
    least = {c: F.min(F.col(f"`{c}`")) for c in columns}
    row = df.agg(*[(F.unix_micros(least[c]) if instant[c] else least[c]).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    epoch = _dt.datetime(1970, 1, 1, tzinfo=_dt.timezone.utc)
    out: dict[str, Any] = {}
    for i, c in enumerate(columns):
        v = row[f"m{i}"]
        out[c] = epoch + _dt.timedelta(microseconds=v) if instant[c] and v is not None else v
    return out


#: Values that a frequent-items sketch tracks per column and task, and the share of a column's rows
#: by which it may miss a value's count (3.5 over the tracked values, as the sketch states).
TRACKED = 10_000
SKETCH_ERROR = 3.5 / TRACKED
CANDIDATES = 1_000


def proven_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """The modes of the text columns where two passes without a shuffle of cells can prove them.

    The first pass keeps a frequent-items sketch of bounded size per column. A value that isn't
    among its answers occurs at most ``bound`` times: twice the sketch's error, or the
    estimate of the last answer where the answers were cut. The second pass counts the candidates
    exactly. If the best of them beats the bound, no other value can win or tie; ties
    among the candidates go to the smallest. Columns without such a proof (nearly unique
    ones) are left out.
    """
    columns = list(columns)
    if not columns:
        return {}
    named = [f"approx_top_k(`{c.replace('`', '``')}`, {CANDIDATES}, {TRACKED})" for c in columns]
    tops = [F.expr(f"filter({x}, x -> x.item IS NOT NULL)").alias(f"t{i}") for i, x in enumerate(named)]
    row = df.agg(*tops, *[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(columns)], F.count(F.lit(1)).alias("rows")).first()
    out: dict[str, str | None] = {}
    cells, bounds = [], {}
    for i, c in enumerate(columns):
        n, found = int(row[f"n{i}"]), row[f"t{i}"] or []
        if n == 0:
            out[c] = None
            continue
        error = SKETCH_ERROR * row["rows"]  # nulls are items of the sketch too
        bounds[i] = max(2 * error, found[-1]["count"] if len(found) >= CANDIDATES - 1 else 0)
        least = found[0]["count"] - error if found else 0
        items = [x["item"] for x in found if x["count"] >= least]
        if items:
            cells.append(F.struct(F.lit(i).alias("i"), F.when(F.col(f"`{c}`").isin(items), F.col(f"`{c}`")).alias("v")))
    if cells:
        counted = df.select(F.inline(F.array(*cells))).where(F.col("v").isNotNull()).groupBy("i", "v").count().collect()  # candidates only
        for i in bounds:
            mine = [(-r["count"], r["v"]) for r in counted if r["i"] == i]
            if mine and -min(mine)[0] > bounds[i]:
                out[columns[i]] = min(mine)[1]
    return out


def column_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """Most frequent non-null text per column, ties to the smallest.

    Text columns go through ``proven_modes``; what is left unproven is counted in a frequency table
    (the only cells that shuffle).
    """
    columns = list(columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    out = proven_modes(df, [c for c in columns if isinstance(types[c], T.StringType)]) if columns else {}
    rest = [c for c in columns if c not in out]
    if rest:
        freq = frequency_table(df, "null", rest, with_first=False)
        ordinals = {i: f.name for i, f in _fields(df, None)}
        got = {ordinals[r["ordinal"]]: r["mode"] for r in mode_frame(freq).collect()}
        out.update({c: got.get(c) for c in rest})
    return {c: out[c] for c in columns}
