"""Secret scans (operator 4, native): an incremental ledger of content-addressed blobs.

Every version of every path is addressed by its SHA-256. The ledger says which (blob, rule
version) pairs have been scanned; a run scans only unseen pairs, each blob once however many
paths and versions hold it, appends the findings and then the ledger rows, and joins findings
back to all paths. A run that dies between the two appends scans those blobs again; findings
are read as a set, so nothing counts twice.

Positions come from the pieces between matches: ``split`` and ``regexp_extract_all`` walk the
same matches, so a match starts where the lengths (code points) of all pieces and matches
before it end. Those lengths are summed by a window over the rows of one blob and rule.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabletidy.llm.common import shared_path, staged


@dataclass(frozen=True)
class Rule:
    """A pattern in the syntax of java.util.regex; of its group ``group`` at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base rules, in the order that spans at one place are listed.
BASE = (
    Rule("assign", r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),  # runs of under 20 characters fail anyway
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: What this scan adds.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
FINDING = "blob binary, rule string, kind string, rank int, start long, stop long"
SEEN = "blob binary, rule string"


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows appended so far; a ledger that has none yet is empty."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def _matches(text: Column, rule: Rule, rank: int) -> Column:
    """What one rule finds in a text, or null if it is seen already or finds nothing."""
    pattern = F.lit(rule.pattern)
    found = F.struct(
        F.lit(rule.key).alias("rule"),
        F.lit(rule.kind).alias("kind"),
        F.lit(rank).alias("rank"),
        F.lit(rule.least).alias("least"),
        F.arrays_zip(
            F.split(text, rule.pattern, -1).alias("piece"),
            F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"),
            F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("value"),
        ).alias("at"),
    )
    return F.when(F.array_contains("todo", rule.key) & text.rlike(rule.pattern), found)


def findings_of(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``blobs`` (blob, text, todo): a row per finding of the rules in ``todo``."""
    text = F.coalesce("text", F.lit(""))
    tried = F.array_compact(F.array(*[_matches(text, r, i) for i, r in enumerate(rules)]))
    hits = blobs.select("blob", F.explode(tried).alias("hit")).select("blob", "hit.rule", "hit.kind", "hit.rank", "hit.least", F.posexplode("hit.at").alias("k", "at"))
    sized = hits.where("at.found is not null").select("blob", "rule", "kind", "rank", "least", "k", F.length("at.piece").alias("piece"), F.length("at.found").alias("found"), F.length("at.value").alias("value"))
    so_far = Window.partitionBy("blob", "rule").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("piece") + F.col("found")).over(so_far)
    placed = sized.distinct().withColumn("stop", stop).withColumn("start", F.col("stop") - F.col("found"))
    return placed.where("value >= least").select("blob", "rule", "kind", "rank", "start", "stop")


def scan(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = BASE + MORE, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bring the ledger up to date with ``docs``; the paths and blobs of ``docs``: path, blob.

    Each row is a version of its path. Null text is the empty blob. Read the findings with
    :func:`findings`, and join them with :func:`by_path`.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    versions = staged(docs.select(F.col(path_col).alias("path"), F.unhex(F.sha2(text, 256)).alias("blob")), "versions")
    seen = _table(spark, f"{ledger}/seen", SEEN).distinct().groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    every = F.array(*[F.lit(r.key) for r in rules])
    blobs = versions.groupBy("blob").agg(F.min("path").alias("at")).join(seen, "blob", "left")
    todo = F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))
    unseen = staged(blobs.select("blob", "at", todo.alias("todo")).where(F.size("todo") > 0), "unseen")
    held = docs.select(F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    one_each = held.join(unseen, held["path"].eqNullSafe(unseen["at"]) & (F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)) == unseen["blob"]))
    findings_of(one_each.select("blob", "text", "todo"), rules).write.mode("append").parquet(f"{ledger}/findings")
    unseen.select("blob", F.explode("todo").alias("rule")).write.mode("append").parquet(f"{ledger}/seen")
    return versions


def findings(spark: SparkSession, ledger: str, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """All findings of the current rule versions: blob, rule, kind, rank, start, stop."""
    return _table(spark, f"{ledger}/findings", FINDING).where(F.col("rule").isin([r.key for r in rules])).distinct()


def by_path(versions: DataFrame, found: DataFrame) -> DataFrame:
    """One row per version: counts of the base kinds, and the spans of its blob in order."""
    spans = F.array_sort(F.collect_list(F.struct("start", "rank", F.concat_ws(":", "kind", "start", "stop").alias("span"), "kind")))
    blobs = staged(found.groupBy("blob").agg(spans.alias("spans")), "blob-spans")
    met = versions.join(blobs, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(blobs.schema["spans"].dataType)))
    base = [r.kind for r in BASE]
    of = lambda kind: F.filter("spans", lambda x: x["kind"] == kind)
    line = lambda a: F.array_join(F.transform(a, lambda x: x["span"]), ",")
    return met.select(
        "path",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(line(F.filter("spans", lambda x: x["kind"].isin(base))), 256).alias("base_sha256"),
        line(F.col("spans")).alias("spans"),
    )


def secret_scan(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """The whole run over ``documents``: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    One row per input row; rows without findings have zeros, the hash of the empty text and
    empty spans. Without a ``ledger`` path a fresh ledger is kept in the shared folder.
    """
    ledger = ledger or shared_path(docs.sparkSession, "ledger")
    versions = scan(docs, ledger)
    return by_path(versions, findings(docs.sparkSession, ledger)).withColumnRenamed("path", "doc_id")
