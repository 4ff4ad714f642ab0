"""File sources and sinks.

* ``read_csv`` (S1): header row, every column read as text (no sampling-based
  ``inferSchema``), the reader's NA tokens nulled, then one aggregate that types
  each column the way a pandas CSV reader would (int64 / float64 / bool / text).
* ``write_csv`` (S4): a directory of part files with a header in each.
* ``write_summary_json`` / ``read_summaries`` (S5 / S6): run summaries as JSON.
* ``landing_copy`` (S8): the raw upload archived byte for byte.
* ``CSV_GLOB`` (S10): only ``*.csv`` names, any letter case.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabletidy.functions.predicates import COERCIBLE_TEXT_RE, INTEGER_TEXT_RE, strip_ws
from tabletidy.sources.csv_blocks import joined, read_blocks
from tabletidy.sources.staging import staged

# --- fixed values: the texts a pandas CSV reader turns into NaN by default.
CSV_NA_TOKENS: tuple[str, ...] = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)
# --- fixed values: texts a pandas CSV reader reads as booleans.
CSV_TRUE = ("True", "TRUE", "true")
CSV_FALSE = ("False", "FALSE", "false")
# A landing file is a CSV when its name ends in .csv, any case.
CSV_GLOB = "*.[cC][sS][vV]"



def is_csv_name(path: str) -> bool:
    return path.lower().endswith(".csv")


def dedupe_names(names: list[str]) -> list[str]:
    """pandas-style names: empty → ``Unnamed: i``; repeats → ``a``, ``a.1``, ``a.2``."""
    out: list[str] = []
    seen: dict[str, int] = {}
    for i, n in enumerate(names):
        base = n if n != "" else f"Unnamed: {i}"
        name = base
        while name in seen:
            seen[base] += 1
            name = f"{base}.{seen[base]}"
        seen.setdefault(name, 0)
        out.append(name)
    return out


_CORRUPT = "__tt_corrupt"


def _more_cells(k: int) -> Column:
    """Whether the record of ``_CORRUPT`` (of another number of cells than ``k``) has more.

    A last cell that is added to a record of fewer cells lands in a column; beyond the last
    column it does not. Two texts for that cell tell it from the record's own cells.
    """
    fields = ", ".join(f"c{i} string" for i in range(k))
    options = {"quote": '"', "escape": '"', "maxCharsPerColumn": "-1", "multiLine": "true"}
    with_cell = lambda x: F.from_csv(F.concat(F.col(_CORRUPT), F.lit(f",{x}")), fields, options)
    return F.to_json(with_cell("1")) == F.to_json(with_cell("2"))


def _cells(records: DataFrame, k: int) -> DataFrame:
    """``records`` with the ``k`` cells c0, c1, ... of its whole records in place of ``whole`` (null: nulls).

    A record with fewer cells than the header ends in nulls. One with more fails the read, also
    if the cells past the header are empty; a quote that never closes takes the rest of the file
    into its cell: nothing is cut or dropped. The parser hands over the text of records with
    another number of cells only.
    """
    fields = ", ".join([f"c{i} string" for i in range(k)] + [f"{_CORRUPT} string"])
    options = {"quote": '"', "escape": '"', "maxCharsPerColumn": "-1", "multiLine": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    raw = records.withColumn("r", F.from_csv("whole", fields, options)).select(*[c for c in records.columns if c != "whole"], "r.*")
    whole = F.when(F.col(_CORRUPT).isNull() | ~_more_cells(k), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("CSV record with more cells than the header: "), F.coalesce("c0", F.lit(""))))
    )
    return raw.where(whole).drop(_CORRUPT)


def read_csv_text(spark: SparkSession, path: str, na_tokens: tuple[str, ...] = CSV_NA_TOKENS) -> DataFrame:
    """S1 without typing: all columns as text, NA tokens → null, pandas-style names.

    Files of any size are read in blocks by many tasks, quoted newlines included (``csv_blocks``).
    The files of a directory are read by header: another column order is matched by name, other
    column names fail. The cells are written once to this application's scratch folder
    (``staging``), so what follows reads columns.
    """
    headers, records, crossing = read_blocks(spark, path, CSV_GLOB)
    if not headers:
        raise ValueError(f"no columns to read in {path}: the CSV is empty")
    names = [dedupe_names(h) for h in headers]
    columns = names[0]
    for other in names[1:]:
        if set(other) != set(columns):
            raise ValueError(f"CSV files of {path} differ in their columns: {columns} and {other}")

    def by_name(cells: DataFrame) -> DataFrame:
        """Cells by the position of their name in the file's own header, NA tokens as nulls."""
        out = []
        for j, c in enumerate(columns):
            cell = F.col(f"c{j}")
            for h, other in enumerate(names[1:], 1):
                if other != columns:
                    cell = F.when(F.col("header") == h, F.col(f"c{other.index(c)}")).otherwise(cell)
            out.append(F.when(~cell.isin(list(na_tokens)), cell).alias(f"c{j}"))
        return cells.select(*out)

    # one pass over the text: whole records as cells, fragments of records over blocks as they are
    whole = F.col("chain").isNull()
    parts = records.select("header", "chain", "place", "named", F.when(~whole, F.col("text")).alias("fragment"), F.when(whole, F.col("text")).alias("whole"))
    held = staged(_cells(parts, len(columns)), "csv-cells")
    table = by_name(held.where(F.col("chain").isNull()))
    if crossing:
        table = table.unionByName(by_name(staged(_cells(joined(held), len(columns)), "csv-crossing")))
    return table.toDF(*columns)


#: Rows at the beginning that may show at once which types a text column does not have.
HEAD_ROWS = 256


def infer_csv_types(df: DataFrame) -> DataFrame:
    """Type text columns as a pandas CSV reader does, from one aggregate pass.

    A column is int64 when every non-null value is an integer and none is null,
    float64 when every non-null value is a number (or all are null), bool when
    every non-null value is a true/false word (with nulls a nullable boolean,
    which cleaning turns into 1.0/0.0 with a median), else it stays text. A type that one of the
    first rows rules out is settled; the pass over all rows tests the others.
    """
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not cols:
        return df
    tests: dict[str, Column] = {}
    for i, c in enumerate(cols):
        s = strip_ws(F.col(f"`{c}`"))
        tests[f"i{i}"] = s.rlike(INTEGER_TEXT_RE) & s.try_cast("long").isNotNull()
        tests[f"f{i}"] = s.rlike(COERCIBLE_TEXT_RE)
        tests[f"b{i}"] = F.col(f"`{c}`").isin(list(CSV_TRUE + CSV_FALSE))
    head = df.select(*[t.alias(k) for k, t in tests.items()]).limit(HEAD_ROWS).collect()
    possible = [k for k in tests if all(r[k] is not False for r in head)]  # a null cell rules out integers only
    aggs = [F.count(F.lit(1)).alias("rows"), *[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(cols)]]
    row = df.agg(*aggs, *[F.count_if(tests[k]).alias(k) for k in possible]).first().asDict()
    rows = int(row["rows"])
    casts: dict[str, Column] = {}
    for i, c in enumerate(cols):
        n, ints, floats, bools = (int(row.get(f"{p}{i}", 0)) for p in "nifb")
        s = strip_ws(F.col(f"`{c}`"))
        if n == 0 and rows > 0:
            casts[c] = F.lit(None).cast("double")
        elif n > 0 and ints == n and n == rows:
            casts[c] = s.try_cast("long")
        elif n > 0 and floats == n:
            casts[c] = F.when(s.rlike(COERCIBLE_TEXT_RE), s.try_cast("double"))
        elif n > 0 and bools == n:
            casts[c] = F.col(f"`{c}`").isin(list(CSV_TRUE))
    return df.select(*[casts[c].alias(c) if c in casts else F.col(f"`{c}`") for c in df.columns])


def read_csv(spark: SparkSession, path: str, infer_types: bool = True) -> DataFrame:
    """A CSV file or directory as a typed DataFrame (absent path → Spark's PATH_NOT_FOUND)."""
    text = read_csv_text(spark, path)
    return infer_csv_types(text) if infer_types else text


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header in every part file, nulls as empty cells, quotes doubled inside quoted
    cells (as standard readers expect), timestamps as ``yyyy-MM-dd HH:mm:ss.ffffff``."""
    (
        df.write.mode(mode)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)  # Spark trims on write by default; keep values exact
        .option("ignoreTrailingWhiteSpace", False)
        .option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
        .csv(path)
    )


def artifact_stem(src: str, run_id: str) -> str:
    """``<stem>_<run_id>``, the stem cut where names of 255 bytes would not hold it (the id tells files apart)."""
    stem = os.path.splitext(os.path.basename(src.rstrip("/")))[0]
    room = 255 - len(f"_{run_id}_summary.json") - len("..crc")
    return f"{stem.encode()[:room].decode(errors='ignore')}_{run_id}"


def landing_copy(spark: SparkSession, src: str, bronze_root: str, run_id: str | None = None) -> tuple[str, str]:
    """Archive an upload byte for byte as ``<stem>_<run_id>.csv``, which ``read_csv`` opens.

    A file-system copy of the file (or directory of part files), through whatever Hadoop
    file systems hold source and archive; ``run_id`` is eight hex characters when not given.
    Returns (run_id, path).
    """
    rid = run_id or uuid.uuid4().hex[:8]
    dst = f"{bronze_root.rstrip('/')}/{artifact_stem(src, rid)}.csv"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    a, b = jvm.org.apache.hadoop.fs.Path(src), jvm.org.apache.hadoop.fs.Path(dst)
    to = b.getFileSystem(conf)
    to.mkdirs(b.getParent())
    if to.exists(b):  # a repeated run: the copy is made anew
        to.delete(b, True)
    jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, to, b, False, conf)
    return rid, dst


# ---------------------------------------------------------------- summaries
_PROFILE_ENTRY = T.StructType(
    [
        T.StructField("column", T.StringType()),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("missing_count", T.LongType()),
        T.StructField("type_issues", T.LongType()),
        T.StructField("total_issues", T.LongType()),
        T.StructField("missing_pct", T.DoubleType()),
        T.StructField("dtype", T.StringType()),
        T.StructField("unique_count", T.LongType()),
        T.StructField("sample_values", T.ArrayType(T.StringType())),
    ]
)

SUMMARY_SCHEMA = T.StructType(
    [
        T.StructField("original_rows", T.LongType()),
        T.StructField("cleaned_rows", T.LongType()),
        T.StructField("dropped_duplicates", T.LongType()),
        T.StructField("missing_before_total", T.LongType()),
        T.StructField("missing_after_total", T.LongType()),
        T.StructField("missing_before", T.LongType()),
        T.StructField("missing_after", T.LongType()),
        T.StructField("columns", T.IntegerType()),
        T.StructField("rows", T.LongType()),
        T.StructField("missing_pct", T.DoubleType()),
        T.StructField("numeric_cols", T.IntegerType()),
        T.StructField("categorical_cols", T.IntegerType()),
        T.StructField("missing_summary_before", T.ArrayType(_PROFILE_ENTRY)),
        T.StructField("missing_summary_after", T.ArrayType(_PROFILE_ENTRY)),
    ]
)


def _entry(d: dict) -> tuple:
    return tuple(
        list(d.get(f.name) or []) if f.name == "sample_values" else d.get(f.name) for f in _PROFILE_ENTRY.fields
    )


def summary_row(summary: dict) -> tuple:
    """A summary dict as a tuple in ``SUMMARY_SCHEMA`` order (absent keys → null)."""
    out = []
    for f in SUMMARY_SCHEMA.fields:
        v = summary.get(f.name)
        if f.name.startswith("missing_summary_"):
            v = [_entry(e) for e in (v or [])]
        out.append(v)
    return tuple(out)


def summary_frame(spark: SparkSession, summary: dict) -> DataFrame:
    """One run's summary (one row; its lists hold one entry per column) as a DataFrame."""
    return spark.createDataFrame([summary_row(summary)], SUMMARY_SCHEMA)


def write_summary_json(spark: SparkSession, summary: dict, path: str) -> str:
    """The whole summary as UTF-8 JSON (one small row)."""
    summary_frame(spark, summary).coalesce(1).write.mode("overwrite").json(path)
    return path


def read_summaries(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """S6 + L7: every ``*_summary.json`` under ``folder`` (file or directory of parts).

    Unreadable files are skipped, the source file is kept as ``json_file``, and the
    runs come in file-name order, the first ``limit`` when given.
    """
    schema = T.StructType(SUMMARY_SCHEMA.fields + [T.StructField("_corrupt_record", T.StringType())])
    df = (
        spark.read.schema(schema)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .option("ignoreCorruptFiles", True)
        .json(f"{folder.rstrip('/')}/*_summary.json")
    )
    out = (
        df.where(F.col("_corrupt_record").isNull())
        .select(F.col("_metadata.file_path").alias("json_file"), F.struct(*[F.col(f.name) for f in SUMMARY_SCHEMA.fields]).alias("summary"))
        .orderBy("json_file")
    )
    return out.limit(limit) if limit is not None else out
