"""The registered queries of the training-data operators and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabletidy.llm.bpe import bpe
from tabletidy.llm.common import table
from tabletidy.llm.exact_dedup import exact_dedup
from tabletidy.llm.html_extract import extract_html
from tabletidy.llm.jaccard_join import jaccard_classes
from tabletidy.llm.license_scan import license_scan
from tabletidy.llm.line_dedup import line_dedup
from tabletidy.llm.mixing import mixture
from tabletidy.llm.prefix_trie import prefix_trie, rebuilt
from tabletidy.llm.quality_rules import quality
from tabletidy.llm.secret_scan import secret_scan
from tabletidy.llm.suffix_dedup import suffix_dedup
from tabletidy.llm.warc import op8_warc
from tabletidy.llm.whitening import whiten


def vocabulary() -> str:
    """The public word-level BPE file (a parameter of the operator)."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(table(spark, sf_dir, "documents"))
    counts = [F.col(f"_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return out.select(F.col("_id").alias("doc_id"), *counts, "base_failed", "kept")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda x, s: x + s["stop"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixture(table(spark, sf_dir, "documents"))
    return out.select(F.col("_id").alias("doc_id"), F.get_json_object("_src", "$.s").alias("source"), "n_tokens", "epoch", "block", "place")


def token_digests(encoded: DataFrame) -> DataFrame:
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(bpe(table(spark, sf_dir, "documents"), vocabulary()))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("places")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("_kept", 256).alias("kept_sha256"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whiten(table(spark, sf_dir, "embeddings"), components=4)
    return out.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def op12_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_html(table(spark, sf_dir, "pages"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_quality_rules": op2_quality_rules,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_secret_scan": op4_secret_scan,
    "op5_mixing": op5_mixing,
    "op6_bpe": op6_bpe,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_warc": op8_warc,
    "op9_license_scan": op9_license_scan,
    "op10_line_dedup": op10_line_dedup,
    "op11_whitening": op11_whitening,
    "op12_html_extract": op12_html_extract,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op1_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        s AS (SELECT doc_id, unnest(CASE WHEN len(ws) >= 5
                  THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))
                  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
        e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        r(d, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.y, r.c FROM r JOIN e ON r.d = e.x),
        m AS (SELECT d, min(c) AS c FROM r GROUP BY d)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, w.doc_id) AS component_id, coalesce(k.n, 0) AS n_links
        FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.d = w.doc_id
        LEFT JOIN (SELECT x, count(*) AS n FROM e GROUP BY x) k ON k.x = w.doc_id
    """,
    "op7_exact_dedup": r"""
        WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM n WINDOW w AS (PARTITION BY text_sha256)
    """,
    "op10_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
        keyed AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
        frequent AS (SELECT k, max(doc_id) AS stays FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
        marked AS (SELECT keyed.*, stays IS NOT NULL AND stays <> doc_id AS gone FROM keyed LEFT JOIN frequent USING (k))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
    "op13_prefix_trie": r"""
        WITH RECURSIVE own AS (
            SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id
                ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
            FROM conversations WHERE conv_id IS NOT NULL),
        conv AS (
            SELECT c, c - c % 5 AS b, n, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ord(s)::UBIGINT)),
                lambda a, s: list_reduce(list_prepend(xor(a, s), list_value(0, 0, 0, 0, 0, 0, 0, 0)::UBIGINT[]),
                    lambda v, z: xor(v >> 1, 3988292384::UBIGINT * (v & 1)))), 4294967295::UBIGINT)::BIGINT % 9 AS h
            FROM (SELECT c, count(*) AS n FROM own GROUP BY c)),
        turns AS (
            SELECT conv.c, own.i AS d, r, x FROM conv JOIN own ON own.c = conv.b AND own.i <= conv.h
            UNION ALL
            SELECT conv.c, least(conv.h, coalesce(base.n, 0)) + own.i - conv.h, r, x
            FROM conv JOIN own ON own.c = conv.c AND own.i > conv.h LEFT JOIN conv base ON base.c = conv.b),
        walk(c, d, id) AS (
            SELECT c, 0::BIGINT, min(c) OVER () FROM conv
            UNION ALL
            SELECT walk.c, walk.d + 1, min(walk.c) OVER (PARTITION BY walk.id, r, x) FROM walk JOIN turns ON turns.c = walk.c AND turns.d = walk.d + 1),
        ended AS (SELECT id, d, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids
                  FROM walk WHERE NOT EXISTS (SELECT 1 FROM turns WHERE turns.c = walk.c AND turns.d = walk.d + 1) GROUP BY id, d),
        node AS (SELECT w.id, w.d, count(*) AS n, any_value(up.id) AS parent, any_value(strlen(turns.x)) AS bytes
                 FROM walk w LEFT JOIN walk up ON up.c = w.id AND up.d = w.d - 1 LEFT JOIN turns ON turns.c = w.id AND turns.d = w.d GROUP BY w.id, w.d),
        child AS (SELECT parent, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
        below AS (SELECT up.id, up.d, count(*) FILTER (child.n IS NULL) AS n_leaves, sum((node.n - 1) * coalesce(node.bytes, 0)) AS saved
                  FROM node JOIN walk up ON up.c = node.id AND up.d <= node.d LEFT JOIN child ON child.parent = node.id AND child.d = node.d GROUP BY up.id, up.d)
        SELECT node.id AS conv_id, node.d AS depth, node.parent AS parent_conv_id, node.n AS n_convs, coalesce(child.n, 0) AS n_children,
               n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ended.ids, '')) AS ends_sha256
        FROM node JOIN below ON below.id = node.id AND below.d = node.d
        LEFT JOIN child ON child.parent = node.id AND child.d = node.d LEFT JOIN ended ON ended.id = node.id AND ended.d = node.d
    """,
}
