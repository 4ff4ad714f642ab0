"""Line dedup (operator 10, native): explode, hash, count documents, drop, reassemble by position."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabletidy.llm.common import SPACES, free_name, staged

MIN_CHARS = 40
MIN_DOCS = 5


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case, all else unchanged (``lower`` does the same for ASCII, faster)."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(SPACES)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _met(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> tuple[DataFrame, Column, Column, Column]:
    """``docs`` with its drop lists, and the columns: lines, dropped lines, text of the rest."""
    ident = F.struct(F.col("_id").alias("id"))
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_text"), F.posexplode(_lines(F.col(text_col))).alias("_pos", "_line"))
    keys = rows.where(F.length("_line") >= min_chars).withColumn("_key", line_key(F.col("_line"))).where(F.length("_key") >= min_chars)
    held = staged(keys.select("_id", "_text", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit("line"), "_key").alias("_h2")), "line-keys")
    counted = held.groupBy("_h1", "_h2").agg(F.count_distinct(ident).alias("_docs"), F.max(ident).alias("_stays"))
    # written, so that the join deals both sides itself and may split the lines of a hot key
    frequent = staged(counted.where(F.col("_docs") >= min_docs), "frequent-lines")
    gone = held.join(frequent, ["_h1", "_h2"]).where(~ident.eqNullSafe(F.col("_stays")))
    drops = gone.groupBy("_id", "_text").agg(F.collect_set("_pos").alias("_gone")).withColumnsRenamed({"_id": "_drop_id", "_text": "_drop_text"})
    joined = docs.join(drops, docs[id_col].eqNullSafe(drops["_drop_id"]) & (F.xxhash64(docs[text_col]) == drops["_drop_text"]), "left")
    # the lines are a column of their own, read several times below: each text is split once
    own = free_name(joined, "_own_lines")
    joined, lines, dropped = joined.withColumn(own, _lines(docs[text_col])), F.col(own), drops["_gone"]
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped)
    kept = F.when(dropped.isNull(), F.coalesce(docs[text_col], F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    return joined, F.size(lines).cast("long"), F.coalesce(F.size(dropped), F.lit(0)).cast("long"), kept


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with each frequent line kept in one document only; adds _n_lines, _n_dropped, _kept.

    Keys of at least ``min_chars`` code points in at least ``min_docs`` documents lose all
    their lines except in the largest id that holds them; ``_kept`` is the text of the lines
    that stay. A null or empty text is one empty line. Rows that repeat an id are the same
    document for the counts, and each loses its own lines. Null ids together count as one
    document with the smallest id. Every input row comes back with its own columns. A text of any
    length is split twice, whatever the number of lines it loses.

    Keys are held as two 64-bit hashes. Only hashes with positions, never lines, are
    counted and joined; a hot key meets its documents in a sort-merge join that can be split,
    after a count that combines per task. The text shuffles once, to meet its own drop list.
    """
    joined, n_lines, n_dropped, kept = _met(docs, id_col, text_col, min_chars, min_docs)
    return joined.select(*[docs[c] for c in docs.columns], n_lines.alias("_n_lines"), n_dropped.alias("_n_dropped"), kept.alias("_kept"))


def drop_lines(docs: DataFrame) -> DataFrame:
    """The documents table with the frequent lines gone (same columns; ``n_chars`` follows the
    new text, and a null text stays null)."""
    joined, _, _, kept = _met(docs, "doc_id", "text", MIN_CHARS, MIN_DOCS)
    text = F.when(docs["text"].isNotNull(), kept)
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return joined.select(*[(new[c] if c in new else docs[c]).alias(c) for c in docs.columns])
