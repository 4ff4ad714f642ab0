"""Quality rules (operator 2, native): base rules, then robust multivariate outliers.

Per language and source the minimum covariance determinant (MCD) of a transformed vector
of text statistics is estimated by concentration steps: distances under the current centre
and scatter, the least distant share ``SHARE`` of the group, its mean and covariance, and
again, until a group's determinant stands still. Three deterministic starts (medians with
absolute deviations, plain moments, and moments of the rows drawn in towards the medians) run
side by side and the least determinant wins. A document that passes the base rules is
rejected when its squared Mahalanobis distance is over the cutoff.

All of it is grouped sums over a narrow table of statistics, written once. The sums are of
integers (statistics in units of 1/10000), so they don't depend on the order of rows.
The quantiles come from counts per bin, of a bounded number, never from sorted groups.
A small table of estimates (a row per group) meets the rows by a join Spark may split.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabletidy.llm.common import SPACE_RUN, staged

WINDOW = 8
SHARE = 0.75  # of a group's rows that an estimate must be drawn from
STILL = 1e-4  # a log determinant that falls by less has come to its end
LEAST_ROWS = 40  # smaller groups are judged by the estimate of a pool
UNIT = 10_000
#: Added to each standard deviation (squared) in the steps, only to keep a scatter regular.
FLOORS = {"length": 0.01, "symbols": 0.01, "repeats": 0.01, "dup_lines": 0.01}
#: A document is judged by its group's own deviations, or by these where they are smaller: about
#: the word length's chance variation in 30 words, one symbol in 30 words, one passage of 16
#: words twice in 280, one line twice.
LEAST = {"length": 0.08, "symbols": 0.3, "repeats": 0.058, "dup_lines": 0.6}
NAMES = list(FLOORS)
D = len(NAMES)
TAIL = 1e-3  # share of a normal group beyond the cutoff


def _chi2_cdf(x: float, dof: int) -> float:
    """For an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dof // 2))


def _chi2_quantile(p: float, dof: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_cdf(mid, dof) < p else (low, mid)
    return low


CUTOFF = _chi2_quantile(1 - TAIL, D)
#: Makes the scatter of the nearest share consistent for a normal group.
CONSISTENCY = SHARE / _chi2_cdf(_chi2_quantile(SHARE, D), D + 2)


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with _n_words, _word_chars, _n_symbols, _n_dup_lines, _n_repeat_words.

    Windows are compared by 64-bit hashes, made by doubling: of 1, 2, 4 and 8 words. Each
    array is a column of its own, so that no lambda evaluates it again.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = [F.col(f"`{c}`") for c in docs.columns]
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    df = docs.select(*kept, F.array_remove(F.split(text, SPACE_RUN, -1), "").alias("_w"), lines.alias("_lines"), F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("_n_symbols"))
    df = df.select(
        *kept,
        F.size("_w").cast("long").alias("_n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("_word_chars"),
        "_n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("_n_dup_lines"),
        F.transform("_w", lambda x: F.xxhash64(x)).alias("_h"),
    )
    done = [*kept, "_n_words", "_word_chars", "_n_symbols", "_n_dup_lines"]
    step = 1
    while step < WINDOW:
        n = F.size("_h") - step
        pairs = F.zip_with(F.slice("_h", F.lit(1), n), F.slice("_h", F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))
        df = df.select(*done, F.when(n > 0, pairs).otherwise(F.array().cast("array<bigint>")).alias("_h"))
        step *= 2
    # positions of windows that are there twice: neighbours among the sorted hashes
    twice = F.size(F.array_distinct("_h")) < F.size("_h")
    none = F.array().cast("array<struct<h:bigint,p:int>>")
    df = df.select(*done, F.when(twice, F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))).otherwise(none).alias("_s"))
    n = F.greatest(F.size("_s") - 1, F.lit(0))
    same = F.zip_with(F.slice("_s", F.lit(2), n), F.slice("_s", F.lit(1), n), lambda b, a: a["h"] == b["h"])
    df = df.select(*done, "_s", F.when(F.size("_s") > 0, same).otherwise(F.array().cast("array<boolean>")).alias("_same"))
    no = F.array(F.lit(False))
    either = F.zip_with(F.concat(no, "_same"), F.concat("_same", no), lambda a, b: a | b)
    at = F.array_compact(F.zip_with("_s", F.when(F.size("_s") > 0, either).otherwise(F.array().cast("array<boolean>")), lambda x, m: F.when(m, x["p"])))
    df = df.select(*done, F.sort_array(at).alias("_at"))
    n = F.greatest(F.size("_at") - 1, F.lit(0))
    steps = F.zip_with(F.slice("_at", F.lit(2), n), F.slice("_at", F.lit(1), n), lambda b, a: F.least(b - a, F.lit(WINDOW)).cast("long"))
    covered = F.aggregate(steps, F.lit(WINDOW).cast("long"), lambda x, y: x + y)
    return df.select(*done, F.when(F.size("_at") > 0, covered).otherwise(F.lit(0).cast("long")).alias("_n_repeat_words"))


def base_failed() -> Column:
    return (F.col("_n_words") < 20) | (100 * F.col("_n_repeat_words") > 30 * F.col("_n_words"))


def _vector() -> dict[str, Column]:
    """The transformed statistics of a text with words, in units of 1/UNIT."""
    words = F.col("_n_words").cast("double")
    raw = {
        "length": F.log(F.col("_word_chars") / words),
        "symbols": F.log1p(10 * F.col("_n_symbols") / words),
        "repeats": F.col("_n_repeat_words") / words,
        "dup_lines": F.log1p(F.col("_n_dup_lines").cast("double")),
    }
    return {k: F.round(v * UNIT).cast("long") for k, v in raw.items()}


def _factor(moments: DataFrame, extra: float, least: dict[str, float] | None = None) -> DataFrame:
    """Means and the Cholesky factor of scatter (times ``extra``) plus squared floors, and log det.

    With ``least``, a variance below its square is raised to it.
    """
    out = moments
    for i in NAMES:
        out = out.withColumn(f"m_{i}", F.col(f"s_{i}") / F.col("n"))
    for a, i in enumerate(NAMES):
        for j in NAMES[: a + 1]:
            cov = (F.col(f"s_{i}_{j}") / F.col("n") - F.col(f"m_{i}") * F.col(f"m_{j}")) * extra
            if i == j:
                cov = F.greatest(cov, F.lit(0.0)) + (FLOORS[i] * UNIT) ** 2
                cov = F.greatest(cov, F.lit((least[i] * UNIT) ** 2)) if least else cov
            below = [F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in NAMES[: NAMES.index(j)]]
            rest = cov - sum(below, F.lit(0.0))
            out = out.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1.0))) if i == j else rest / F.col(f"l_{j}_{j}"))
    det = sum((F.log(F.col(f"l_{i}_{i}")) for i in NAMES), F.lit(0.0))
    return out.select("_g", "_start", "n_all", *[f"m_{i}" for i in NAMES], *[f"l_{i}_{j}" for a, i in enumerate(NAMES) for j in NAMES[: a + 1]], det.alias("log_det"))


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution."""
    z: list[Column] = []
    for a, i in enumerate(NAMES):
        rest = F.col(f"_{i}") - F.col(f"m_{i}") - sum((F.col(f"l_{i}_{k}") * z[b] for b, k in enumerate(NAMES[:a])), F.lit(0.0))
        z.append(rest / F.col(f"l_{i}_{i}"))
    return sum((x * x for x in z), F.lit(0.0))


def _moments(rows: DataFrame) -> DataFrame:
    exact = lambda c: F.sum(c.cast("decimal(20,0)")).cast("double")
    sums = [exact(F.col(f"_{i}")).alias(f"s_{i}") for i in NAMES]
    sums += [exact(F.col(f"_{i}") * F.col(f"_{j}")).alias(f"s_{i}_{j}") for a, i in enumerate(NAMES) for j in NAMES[: a + 1]]
    return rows.groupBy("_g", "_start", "n_all").agg(F.count(F.lit(1)).cast("double").alias("n"), *sums)


def _median(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """The lower median of integer ``value`` per ``by``, from counts per value."""
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy(*by).orderBy(value)
    ranked = counts.withColumn("upto", F.sum("n").over(run)).withColumn("all", F.sum("n").over(Window.partitionBy(*by)))
    return ranked.where("2 * upto >= all").groupBy(*by).agg(F.min(value).alias(name))


def _robust_starts(rows: DataFrame) -> DataFrame:
    """Coordinate medians and deviations, rounded to hundredths: at most some hundred bins a group.

    The second start has the moments of rows whose every statistic is drawn in by tanh, so that
    none is farther from its median than the deviation; it sees correlations as the first does not.
    """
    long = rows.select("_g", "n_all", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.round(F.col(f"_{i}") / 100.0).cast("long").alias("v")) for i in NAMES])).alias("x")).select("_g", "n_all", "x.i", "x.v")
    middle = staged(_median(long, ["_g", "n_all", "i"], "v", "mid"), "medians")
    away = long.join(middle, ["_g", "n_all", "i"]).withColumn("away", F.abs(F.col("v") - F.col("mid")))
    spread = _median(away, ["_g", "n_all", "i", "mid"], "away", "mad")
    per = [F.max(F.when(F.col("i") == i, F.col("mid") * 100.0)).alias(f"m_{i}") for i in NAMES] + [F.max(F.when(F.col("i") == i, F.col("mad") * 148.26)).alias(f"d_{i}") for i in NAMES]
    wide = staged(spread.groupBy("_g", "n_all").agg(*per), "deviations")
    factor = [(F.sqrt(F.col(f"d_{i}") ** 2 + (FLOORS[i] * UNIT) ** 2) if i == j else F.lit(0.0)).alias(f"l_{i}_{j}") for a, i in enumerate(NAMES) for j in NAMES[: a + 1]]
    medians = wide.select("_g", F.lit("medians").alias("_start"), "n_all", *[f"m_{i}" for i in NAMES], *factor, F.lit(0.0).alias("log_det"))
    reach = {i: F.greatest(F.col(f"d_{i}"), F.lit(FLOORS[i] * UNIT)) for i in NAMES}
    drawn = [F.round(F.col(f"m_{i}") + reach[i] * F.tanh((F.col(f"_{i}") - F.col(f"m_{i}")) / reach[i])).cast("long").alias(f"_{i}") for i in NAMES]
    near = rows.join(wide.drop("n_all"), "_g").select("_g", F.lit("drawn in").alias("_start"), "n_all", *drawn)
    return medians.unionByName(_factor(_moments(near), 1.0))


def estimates(rows: DataFrame) -> DataFrame:
    """``rows`` (_g, n_all and the vector): one MCD estimate per group.

    A group's start goes on while its log determinant falls by more than ``STILL``; floors bound
    it from below, so every one comes to an end. Only what goes on meets the rows again.
    """
    plain = _factor(_moments(rows.withColumn("_start", F.lit("moments"))), 1.0)
    now = staged(_robust_starts(rows).unionByName(plain), "mcd").withColumn("log_det", F.lit(float("inf")))
    all_sums, all_dets = [], []
    while True:
        met = rows.join(now.drop("n_all", "log_det"), "_g").withColumn("_bin", F.floor(F.log(_distance() + 1e-6) * 64))
        counts = met.groupBy("_g", "_start", "n_all", "_bin").agg(F.count(F.lit(1)).alias("n"))
        run = Window.partitionBy("_g", "_start").orderBy("_bin")
        upto = counts.withColumn("upto", F.sum("n").over(run)).where(F.col("upto") >= F.ceil(F.col("n_all") * SHARE))
        edge = staged(upto.groupBy("_g", "_start").agg(F.min("_bin").alias("_edge")), "mcd-edge")
        near = met.join(edge, ["_g", "_start"]).where("_bin <= _edge")
        sums = staged(_moments(near), "mcd-sums")
        before = now.select("_g", "_start", F.col("log_det").alias("_before"))
        found = staged(_factor(sums, CONSISTENCY).join(before, ["_g", "_start"]), "mcd")
        step = F.lit(len(all_sums)).alias("_step")
        all_sums.append(sums.select("*", step))
        all_dets.append(found.select("_g", "log_det", "_start", step))
        now = found.where(F.col("log_det") < F.col("_before") - STILL).drop("_before")
        if now.isEmpty():
            break
    every = lambda tables: functools.reduce(DataFrame.unionByName, tables)
    best = every(all_dets).groupBy("_g").agg(F.min(F.struct("log_det", "_start", "_step")).alias("best")).select("_g", "best._start", "best._step")
    return staged(_factor(every(all_sums).join(best, ["_g", "_start", "_step"]), CONSISTENCY, LEAST).drop("n_all", "_start", "log_det"), "mcd-best")


def _groups(rows: DataFrame) -> DataFrame:
    """Per language and source (_own): the estimate that judges it (_g) and those drawn from it (_in: _g, n_all)."""
    sizes = staged(rows.groupBy("_own", "_of").agg(F.count(F.lit(1)).alias("n")), "group-sizes")
    few = F.col("n") < LEAST_ROWS
    langs = staged(sizes.groupBy("_of").agg(F.sum("n").alias("n_lang"), F.sum(F.when(few, F.col("n")).otherwise(0)).alias("n_few")), "language-sizes")
    rare = F.col("n_lang") < LEAST_ROWS
    n_rare = langs.agg(F.sum(F.when(rare, F.col("n_lang")))).first()[0] or 0
    name = lambda kind, c: F.concat(F.lit(f"{kind} "), c)
    own, together, whole = name("own", F.col("_own")), name("few", F.col("_of")), name("lang", F.col("_of"))
    judge = F.when(~few, own).when(F.col("n_few") >= LEAST_ROWS, together).when(~rare, whole).otherwise(F.lit("rare" if n_rare >= LEAST_ROWS else "all"))
    drawn = F.array_compact(F.array(F.when(~few, own), F.when(few, together), whole, F.when(rare, F.lit("rare")), F.lit("all")))
    named = staged(sizes.join(langs, "_of").select("_own", "n", judge.alias("_g"), drawn.alias("_all")), "group-names")
    used = named.select("_g").distinct()
    pools = staged(named.select("_own", "n", F.explode("_all").alias("_g")).join(used, "_g", "left_semi"), "pools")
    members = pools.join(pools.groupBy("_g").agg(F.sum("n").alias("n_all")), "_g").groupBy("_own").agg(F.collect_list(F.struct("_g", "n_all")).alias("_in"))
    return named.join(members, "_own", "left").select("_own", "_g", "_in")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: _id, _text (64-bit hash), the counts, base_failed, distance2, kept.

    Null text has no words and fails. Null languages and sources are groups of their own.
    Every base-passing row gets a distance, from the first of these estimates that is drawn from
    ``LEAST_ROWS`` base-passing rows: of its language and source, of its language's sources under
    that number, of its language, of all languages under that number, or else of all documents.
    """
    has = set(docs.columns)
    pick = lambda c: F.col(f"`{c}`") if c in has else F.lit(None).cast("string")
    picked = docs.select(pick(id_col).alias("_id"), F.xxhash64(pick(text_col)).alias("_text"), pick("lang").alias("_lang"), pick("source").alias("_source"), pick(text_col).cast("string").alias("_body"))
    stats = statistics(picked, "_body").drop("_body").withColumn("base_failed", base_failed())
    table = staged(stats.select("*", *[F.when(~F.col("base_failed"), v).alias(f"_{k}") for k, v in _vector().items()]), "statistics")
    passed = table.where("not base_failed")
    group, lang = F.to_json(F.struct(F.col("_lang").alias("l"), F.col("_source").alias("s"))), F.to_json(F.struct(F.col("_lang").alias("l")))
    groups = staged(_groups(passed.select(group.alias("_own"), lang.alias("_of"))), "groups")
    # an estimate is drawn from all rows of its pool, also from those that another one judges
    rows = passed.withColumn("_own", group).join(groups, "_own").select(F.explode("_in").alias("_in"), *[f"_{i}" for i in NAMES]).select("_in.*", *[f"_{i}" for i in NAMES])
    found = estimates(rows)
    known = groups.drop("_in").join(found, "_g").drop("_g")
    judged = table.withColumn("_own", F.when(~F.col("base_failed"), group)).join(known, "_own", "left").withColumn("distance2", _distance())
    kept = ~F.col("base_failed") & (F.col("distance2") <= CUTOFF)
    return judged.select("_id", "_text", "_n_words", "_word_chars", "_n_symbols", "_n_dup_lines", "_n_repeat_words", "base_failed", "distance2", kept.alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents table without the documents that the rules reject (all columns unchanged).

    A verdict belongs to an id and its text, so rows that repeat an id are judged each.
    """
    good = quality(docs).where("kept").select("_id", "_text").distinct()
    return docs.join(good, docs["doc_id"].eqNullSafe(good["_id"]) & (F.xxhash64(docs["text"]) == good["_text"]), "left_semi")
