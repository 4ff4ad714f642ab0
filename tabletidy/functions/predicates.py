"""Cell-level predicates and scalar rewrites.

Everything here returns a native ``Column`` expression, so it stays inside
whole-stage codegen; profiling and cleaning run no Python on the executors.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: the placeholder texts that count as a missing cell, matched
# --- after lower-casing and stripping surrounding whitespace.
PLACEHOLDERS: tuple[str, ...] = (
    "unknown",
    "n/a",
    "na",
    "nan",
    "none",
    "null",
    "error",
    "missing",
    "undefined",
    "unavailable",
    "",
    "-",
    "--",
    "?",
    "n.a.",
    "#n/a",
)

# --- fixed values: the text an all-missing string column is filled with.
UNKNOWN_FILL = "Unknown"

# --- fixed values: the characters Python's str.strip() removes (Unicode White_Space and the
# --- ASCII separators 1C-1F that Java's \s lacks); trimming a set is far cheaper than a regex.
STRIP_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Text that neither begins nor ends with a character to strip (most cells): visible ASCII at both ends.
BARE_TEXT_RE = r"(?s)\A[!-~](?:.*[!-~])?\z"

# Text that Python's float() accepts (ASCII digits only): decimal with optional
# exponent and single underscores between digits, or signed inf/infinity/nan.
NUMERIC_TEXT_RE = (
    r"^(?:[+-]?((\d(_?\d)*)(\.(\d(_?\d)*)?)?|\.\d(_?\d)*)([eE][+-]?\d(_?\d)*)?"
    r"|(?i:[+-]?(inf|infinity|nan)))$"
)
# Integer text (what a pandas parse keeps as int64).
INTEGER_TEXT_RE = r"^[+-]?\d+$"
# What a pandas-style coercion parses: the same grammar without underscores.
COERCIBLE_TEXT_RE = (
    r"^(?:[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?"
    r"|(?i:[+-]?(inf|infinity|nan)))$"
)

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType)
DATETIME = (T.TimestampType, T.TimestampNTZType, T.DateType)


def kind_of(dt: T.DataType) -> str:
    """Coarse column kind that decides the cleaning rules for a column."""
    if isinstance(dt, T.StringType):
        return "string"
    if isinstance(dt, FRACTIONAL):
        return "float"
    if isinstance(dt, INTEGRAL):
        return "integral"
    if isinstance(dt, T.DecimalType):
        return "decimal"
    if isinstance(dt, T.BooleanType):
        return "bool"
    if isinstance(dt, DATETIME):
        return "datetime"
    return "other"


NUMERIC_KINDS = frozenset({"float", "integral", "decimal", "bool"})


Placeholders = Iterable[str] | Mapping[str, Iterable[str]]


def placeholder_sets(placeholders: Placeholders = PLACEHOLDERS) -> Callable[[str], tuple[str, ...]]:
    """Column name → its placeholder texts.

    One iterable applies to every text column; a mapping overrides columns by
    name, with ``"*"`` (else the fixed list) for the rest. Example: keep the real
    category ``error`` of one column with ``{"event_type": [p for p in
    PLACEHOLDERS if p != "error"]}``.
    """
    if isinstance(placeholders, Mapping):
        default = tuple(placeholders.get("*", PLACEHOLDERS))
        per = {k: tuple(v) for k, v in placeholders.items() if k != "*"}
        return lambda name: per.get(name, default)
    fixed = tuple(placeholders)
    return lambda name: fixed


def placeholders_json(placeholders: Placeholders) -> list[str] | dict[str, list[str]]:
    """The placeholder setting in a JSON-serialisable form (for a CleaningPlan)."""
    if isinstance(placeholders, Mapping):
        return {k: list(v) for k, v in placeholders.items()}
    return list(placeholders)


def strip_ws(c: Column) -> Column:
    """str.strip(): remove leading/trailing Unicode whitespace (E3); a cell without any is taken as it is."""
    return F.when(c.rlike(BARE_TEXT_RE), c).otherwise(F.trim(c, F.lit(STRIP_CHARS)))


def is_placeholder(c: Column, placeholders: Iterable[str] = PLACEHOLDERS) -> Column:
    """True when a string cell is one of the placeholder texts (null-safe: null → false).

    Lower-casing never shortens a text, so a stripped cell longer than the
    longest placeholder cannot match: the guard skips lower-casing long texts.
    """
    ph = [p.lower() for p in placeholders]  # a caller's list may be in upper case
    if not ph:
        return F.lit(False)
    longest = max(len(p) for p in ph)
    hit = lambda t: F.when(F.length(t) <= longest, F.lower(t).isin(ph))
    return F.coalesce(F.when(c.rlike(BARE_TEXT_RE), hit(c)).otherwise(hit(F.trim(c, F.lit(STRIP_CHARS)))), F.lit(False))


def is_missing(c: Column, dt: T.DataType, placeholders: Iterable[str] = PLACEHOLDERS) -> Column:
    """Null, NaN (float columns) or placeholder text (string columns)."""
    k = kind_of(dt)
    if k == "string":
        return c.isNull() | is_placeholder(c, placeholders)
    if k == "float":
        return c.isNull() | F.isnan(c)
    return c.isNull()


def numeric_text_ok(c: Column) -> Column:
    """P3 on text: would Python's float() accept this cell? (null → false)."""
    return F.coalesce(strip_ws(c).rlike(NUMERIC_TEXT_RE), F.lit(False))


def parses_as_number(c: Column, dt: T.DataType) -> Column:
    """P3 for any column type: numbers and booleans always parse, datetimes never."""
    k = kind_of(dt)
    if k == "string":
        return numeric_text_ok(c)
    if k in NUMERIC_KINDS:
        return c.isNotNull()
    return F.lit(False)


def coerce_numeric(c: Column) -> Column:
    """P5: text → double; anything a strict numeric parse rejects becomes null."""
    s = strip_ws(c)
    return F.when(s.rlike(COERCIBLE_TEXT_RE), s.try_cast("double"))


def replace_placeholders(c: Column, placeholders: Iterable[str] = PLACEHOLDERS) -> Column:
    """Placeholder text → null; other values unchanged."""
    return F.when(~is_placeholder(c, placeholders), c)


def null_nan(c: Column, dt: T.DataType) -> Column:
    """NaN → null on float columns so aggregates skip it like pandas does."""
    return F.nanvl(c, F.lit(None).cast(dt)) if kind_of(dt) == "float" else c


def pct(part: Column, whole: Column, digits: int = 2) -> Column:
    """A3: round(part / whole * 100, 2) with banker's rounding; 0.0 when whole is 0."""
    return F.coalesce(
        F.bround(F.try_divide(part.cast("double"), whole.cast("double")) * 100.0, digits),
        F.lit(0.0),
    )


def typed_literal(value, dt: T.DataType) -> Column:
    """A driver-side value (e.g. a collected minimum) as a literal of the column's own type.

    A wall-clock ``TIMESTAMP_NTZ`` value goes through its text, so no time zone
    (session or Python process) can shift it; other types keep their type by cast.
    """
    if isinstance(dt, T.TimestampNTZType) and hasattr(value, "isoformat"):
        return F.lit(value.isoformat(sep=" ")).cast(dt)
    if getattr(value, "tzinfo", None) is not None:  # an instant: by its microseconds
        epoch = _dt.datetime(1970, 1, 1, tzinfo=_dt.timezone.utc)
        return F.timestamp_micros(F.lit(round((value - epoch) / _dt.timedelta(microseconds=1)))).cast(dt)
    return F.lit(value).cast(dt)


def dtype_label(dt: T.DataType, has_nulls: bool) -> str:
    """The dtype name the profile reports, as a pandas frame of the same data would show it.

    Integral and boolean columns holding nulls are float64 / object there, so the
    label depends on whether the column has nulls.
    """
    k = kind_of(dt)
    if k == "integral":
        return "float64" if has_nulls else "int64"
    if k in ("float", "decimal"):
        return "float64"
    if k == "bool":
        return "object" if has_nulls else "bool"
    if k == "datetime":
        return "datetime64[ns]"
    return "object"
