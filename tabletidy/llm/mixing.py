"""Mixing sources to target weights (operator 5): temperature, bisection, block permutations.

A source's weight is its token share to the power ``alpha``, normalised: 1 keeps the shares,
0 makes sources equal. ``alpha`` is found by bisection, either as the value whose weights
have a target entropy, or as the least value under which no source repeats more than
``max_repeats`` times. Each Spark job evaluates the 63 inner points of six halvings over the
table of sources; only those numbers reach the driver, so the table may be of any size.

A source's budget is its weight times the mixture's tokens. It is realised as whole passes
over the source and one partial pass: documents lie in blocks of about ``block_tokens`` by
hash, each pass takes the blocks in a permutation of its own, and the partial pass stops in
the block where the budget ends, at the last document that fits. ``place`` (0 to 1) orders
the mixture so that all sources advance together.

With ``budget=None`` the mixture is the smallest in which every source has a whole pass: no
document is lost, small sources repeat. A number of tokens may also cut large sources.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabletidy.llm.common import SPACE_RUN, staged

MAX_REPEATS = 2.0
#: A pass's blocks are ordered within 2^RANGE_BITS ranges of their hash.
RANGE_BITS = 12
BLOCK_TOKENS = 1 << 16
HALVINGS = 6
JOBS = 5


def count_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN, -1), "")).cast("long")


def _moments(sources: DataFrame, alphas: list[float]) -> dict[float, tuple[float, float]]:
    """For each alpha: the sum of p^alpha, and the sum of p^alpha * ln p."""
    power = F.pow("p", F.col("alpha"))
    rows = sources.select("p", F.explode(F.array(*map(F.lit, alphas))).alias("alpha")).groupBy("alpha").agg(F.sum(power).alias("z"), F.sum(power * F.log("p")).alias("l")).collect()
    return {r["alpha"]: (r["z"], r["l"]) for r in rows}


def find_alpha(sources: DataFrame, target_entropy: float | None, max_repeats: float | None, budget: float | None) -> float:
    """The exponent for ``sources`` (p: share of tokens, over 0), between 0 and 1, to 9 digits.

    Entropy falls and the most repeats fall as alpha grows, so each has one crossing. A target
    beyond what 0 or 1 gives ends at that end.
    """
    ends = sources.agg(F.min("p").alias("low"), F.max("p").alias("high"), F.sum("tokens").alias("all")).first()
    if ends["low"] is None:
        return 1.0

    def above(alpha: float, z: float, logs: float) -> bool:
        """Is the crossing at a larger alpha?"""
        if target_entropy is not None:
            return math.log(z) - alpha * logs / z > target_entropy
        if budget is None:
            repeats = (ends["high"] / ends["low"]) ** (1 - alpha)
        else:
            repeats = budget / ends["all"] * ends["low"] ** (alpha - 1) / z
        return repeats > max_repeats

    low, high = 0.0, 1.0
    at = _moments(sources, [0.0, 1.0])
    if not above(0.0, *at[0.0]):
        return 0.0
    if above(1.0, *at[1.0]):
        return 1.0
    for _ in range(JOBS):
        n = 1 << HALVINGS
        points = [low + (high - low) * k / n for k in range(1, n)]
        at = _moments(sources, points)
        inside = [low, *points, high]
        a, b = 0, n
        while b - a > 1:
            mid = (a + b) // 2
            a, b = (mid, b) if above(inside[mid], *at[inside[mid]]) else (a, mid)
        low, high = inside[a], inside[b]
    return round(high, 9)


def weigh(sources: DataFrame, target_entropy: float | None = None, max_repeats: float | None = MAX_REPEATS, budget: int | None = None) -> DataFrame:
    """``sources`` (src, tokens) with weight, budget, passes (whole ones) and rest (tokens).

    A source without tokens has weight 0 and one pass.
    """
    some = sources.where("tokens > 0")
    total = some.agg(F.sum("tokens")).first()[0] or 0
    shares = staged(some.withColumn("p", F.col("tokens") / F.lit(float(total or 1))), "shares")
    alpha = find_alpha(shares, target_entropy, max_repeats, budget)
    power = F.pow("p", F.lit(alpha))
    norm = shares.agg(F.sum(power).alias("z"), F.max(F.col("p") / power).alias("least")).first()
    z, least = norm["z"] or 1.0, norm["least"] or 0.0
    whole = float(budget) if budget is not None else total * z * least  # the least weight per token gets one pass
    # rounded to 6 digits, so that a source that is to have one pass has no sliver more or less
    passes = F.round(whole * power / z / F.col("tokens"), 6)
    weighed = shares.select("src", "tokens", (power / z).alias("weight"), (passes * F.col("tokens")).cast("long").alias("budget"))
    none = sources.where("tokens = 0").select("src", "tokens", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("budget"))
    whole_passes = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(1).cast("long"))
    out = weighed.unionByName(none).withColumn("passes", whole_passes)
    return staged(out.withColumn("rest", F.greatest(F.col("budget") - F.col("passes") * F.col("tokens"), F.lit(0))), "weights")


def _hash(*parts: Column) -> Column:
    return F.xxhash64(*parts)


def mixture(docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = MAX_REPEATS, budget: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 0) -> DataFrame:
    """The mixture's rows: _id, _mark (hash of the text), _src, n_tokens, epoch, block, place.

    One row per distinct (id, text, source) of ``docs`` and pass that takes it. Tokens are
    words. Null is a source like any other; null and empty texts have no tokens and go with
    their block. Rows that repeat id, text and source are taken together.
    """
    source = F.to_json(F.struct(F.col("source").alias("s")))
    named = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_mark"), source.alias("_src"), count_words(F.col("text")).alias("n"))
    rows = staged(named.groupBy("_id", "_mark", "_src").agg(F.sum("n").alias("n_tokens")), "mix-rows")
    weights = weigh(rows.groupBy(F.col("_src").alias("src")).agg(F.sum("n_tokens").alias("tokens")), target_entropy, max_repeats, budget)
    blocks = F.greatest(F.ceil(F.col("tokens") / block_tokens), F.lit(1)).cast("long")
    own = _hash(F.lit(seed), F.coalesce("_id", F.lit(-1)), F.col("_mark"))
    placed = rows.join(weights, rows["_src"] == weights["src"]).drop("src").withColumn("block", F.pmod(own, blocks))
    placed = staged(placed.select("_id", "_mark", "_src", "n_tokens", "block", "tokens", "budget", "passes", "rest"), "mix-blocks")
    # the blocks of each pass in its order, and how far the partial pass goes
    sizes = placed.groupBy("_src", "block", "tokens", "budget", "passes", "rest").agg(F.sum("n_tokens").alias("size"))
    last = F.when(F.col("rest") > 0, F.col("passes")).otherwise(F.col("passes") - 1)
    each = sizes.withColumn("last", last).where("last >= 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    # running sums in two levels, so that no task holds a source: over ranges of the hash, then within each
    turned = each.withColumn("_h", _hash(F.lit(seed), F.col("epoch"), F.col("block")))
    ranged = staged(turned.withColumn("_range", F.shiftright("_h", 64 - RANGE_BITS)), "mix-ranges")
    parts = ranged.groupBy("_src", "epoch", "_range").agg(F.sum("size").alias("_part"))
    before = Window.partitionBy("_src", "epoch").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_src", "epoch", "_range", F.coalesce(F.sum("_part").over(before), F.lit(0)).alias("_before"))
    order = Window.partitionBy("_src", "epoch", "_range").orderBy("_h", "block").rowsBetween(Window.unboundedPreceding, 0)
    runs = ranged.join(offsets, ["_src", "epoch", "_range"]).withColumn("upto", F.col("_before") + F.sum("size").over(order))
    room = F.when(F.col("epoch") < F.col("passes"), F.col("size")).otherwise(F.col("rest") - (F.col("upto") - F.col("size")))
    start = F.col("epoch") * F.col("tokens") + F.col("upto") - F.col("size")
    plan = runs.withColumn("room", room).where((F.col("room") > 0) | (F.col("epoch") < F.col("passes")))
    plan = staged(plan.select(F.col("_src").alias("_s"), F.col("block").alias("_b"), "epoch", "room", "size", start.alias("start"), F.greatest("budget", F.lit(1)).alias("whole")), "mix-plan")
    met = placed.join(plan, (placed["_src"] == plan["_s"]) & (placed["block"] == plan["_b"])).withColumn("turn", _hash(F.lit(seed), F.col("epoch"), F.coalesce("_id", F.lit(-1)), F.col("_mark")))
    inside = Window.partitionBy("_src", "block", "epoch").orderBy("turn", "_id", "_mark").rowsBetween(Window.unboundedPreceding, 0)
    fits = met.withColumn("upto", F.sum("n_tokens").over(inside)).where((F.col("upto") <= F.col("room")) | (F.col("room") >= F.col("size")))
    place = (F.col("start") + F.col("upto") - F.col("n_tokens")) / F.col("whole")
    return fits.select("_id", "_mark", "_src", "n_tokens", "epoch", "block", place.alias("place"))


def mix_sources(docs: DataFrame, **how) -> DataFrame:
    """The documents table as the mixture holds it: a row per pass (same columns, all unchanged)."""
    taken = mixture(docs, **how).select("_id", "_mark", "_src")
    same = docs["doc_id"].eqNullSafe(taken["_id"]) & (F.xxhash64(docs["text"]) == taken["_mark"]) & (F.to_json(F.struct(docs["source"].alias("s"))) == taken["_src"])
    return docs.join(taken, same).select(*[docs[c] for c in docs.columns])
