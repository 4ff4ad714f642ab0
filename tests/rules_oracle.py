"""A plain-Python statement of the cleaning rules, for differential tests.

Independent of the Spark code: rows in, cleaned rows and summary counts out.
Column kinds are taken from the first non-null Python value (float, int, str).
"""

from __future__ import annotations

import math
import statistics

from tabletidy.functions.predicates import PLACEHOLDERS, UNKNOWN_FILL


def _missing(v) -> bool:
    if v is None:
        return True
    if isinstance(v, float) and math.isnan(v):
        return True
    return isinstance(v, str) and v.strip().lower() in PLACEHOLDERS


def _floatable(v) -> bool:
    try:
        float(v)
        return True
    except (TypeError, ValueError):
        return False


def _strict_number(v: str):
    t = v.strip()
    if "_" in t:
        return None
    try:
        return float(t)
    except ValueError:
        return None


def _kind(values) -> str:
    for v in values:
        if v is not None and not (isinstance(v, float) and math.isnan(v)):
            return "str" if isinstance(v, str) else ("float" if isinstance(v, float) else "int")
    return "float"


def clean_frame(rows: list[tuple], names: list[str]):
    cols = list(zip(*rows)) if rows else [() for _ in names]
    kinds = [_kind(c) for c in cols]
    numeric = []
    missing_before = 0
    for c, k in zip(cols, kinds):
        present = [v for v in c if not _missing(v)]
        ok = sum(1 for v in present if _floatable(v))
        is_num = bool(present) and ok / len(present) > 0.8
        numeric.append(is_num)
        missing_before += sum(1 for v in c if _missing(v))
        if is_num and k == "str":
            missing_before += len(present) - ok

    def norm(v):
        return None if _missing(v) else v

    seen, kept = set(), []
    for r in rows:
        key = tuple(norm(v) for v in r)
        if key not in seen:
            seen.add(key)
            kept.append(key)
    cols2 = list(zip(*kept)) if kept else [() for _ in names]
    out_cols = []
    for c, k, is_num in zip(cols2, kinds, numeric):
        if k == "str" and is_num:
            c = tuple(None if v is None else _strict_number(v) for v in c)
            k = "float"
        present = [v for v in c if v is not None]
        if k in ("float", "int"):
            if k == "int" and len(present) == len(c):
                out_cols.append(c)
                continue
            fill = float(statistics.median(present)) if present else 0.0
            out_cols.append(tuple(float(v) if v is not None else fill for v in c))
        else:
            if present:
                counts: dict = {}
                for v in present:
                    counts[v] = counts.get(v, 0) + 1
                fill = min(counts, key=lambda v: (-counts[v], v))
            else:
                fill = UNKNOWN_FILL
            out_cols.append(tuple(v if v is not None else fill for v in c))
    out_rows = list(zip(*out_cols)) if kept else []
    missing_after = sum(1 for r in out_rows for v in r if _missing(v))
    summary = {
        "original_rows": len(rows),
        "cleaned_rows": len(kept),
        "dropped_duplicates": len(rows) - len(kept),
        "missing_before": missing_before,
        "missing_after": missing_after,
    }
    return out_rows, summary
