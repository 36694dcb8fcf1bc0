"""Mixing sources to target weights: temperature, then budgeted block permutations.

Weights are the sources' token shares to the power alpha, normalised.  Alpha is the largest
exponent of [0, 1] at which the mixture's entropy reaches the target (an entropy target), or the
least at which no source repeats more often than the limit (a repetition limit), whichever is
larger; each is found by bisection.  The default target lies ``TOWARDS`` of the way from the
entropy of the shares themselves to that of equal weights, so it moves weight to small sources
wherever shares differ.  Each source then gets budget * weight tokens: whole blocks (a block is
one permutation of all the source's documents), and of the last block as long a prefix as fits.

Defined results.  A null source counts as the source ''.  Texts that are null or without a
word have no tokens: they belong to every whole block and to the prefix up to their place.
Repeated rows are separate documents with equal places.  Ties of the order key go by doc_id, a null
doc_id first.  An empty table, and one without a word, gives an empty result.  Extra columns are
passed through, whatever their names; ones named mix_tokens, mix_block or mix_order are replaced.

What is sent to every task is one row a source: its whole blocks, and the place up to which its
last block goes.  Beyond ``SMALL`` sources it is joined by a shuffle instead."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, plain

TOWARDS, MAX_REPEATS, SEED, BUCKET_BITS = 0.5, 4.0, 7, 12
PARTS, ROUNDS, DIGITS, SMALL = 64, 7, 9, 100_000
ADDED = ("mix_tokens", "mix_block", "mix_order")


def n_words(text: Column) -> Column:
    """Words of a text: runs of characters other than the six ASCII blanks."""
    runs = F.size(F.split(F.trim(F.translate(F.coalesce(text.cast("string"), F.lit("")), "\t\n\x0b\x0c\r", "     ")), " +"))
    return F.when(F.regexp_like(F.coalesce(text.cast("string"), F.lit("")), F.lit("[^ \\x09-\\x0D]")), runs).otherwise(0).cast("long")


def _bisect(shares: DataFrame, fits: Column) -> float:
    """Least alpha in [0, 1] at which ``fits`` holds; it must hold at 1 and go on to hold.

    A round evaluates 63 inner points of the bracket in one job over the table of
    sources, which is six halvings at once; nothing by source comes to the driver."""
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        points = [low + (high - low) * i / PARTS for i in range(PARTS)]
        grid = shares.select(F.explode(F.array(*map(F.lit, points))).alias("alpha"), "p", "rate")
        power = F.pow("p", F.col("alpha"))
        z = grid.groupBy("alpha").agg(F.sum(power).alias("z"), F.sum(power * F.log("p")).alias("zl"), F.max(F.pow("p", F.col("alpha") - 1) * F.col("rate")).alias("top"))
        ok = {r[0] for r in z.where(fits).select("alpha").collect()}  # at most 64 numbers
        first = min(ok, default=high)
        if first <= low:
            return round(low, DIGITS)
        low, high = first - (high - low) / PARTS, first
        low = max(0.0, low)
    return round(high, DIGITS)


def solve(tokens: DataFrame, budget: int, total: int, entropy: float | None, repeats: float | None) -> float:
    """The exponent for a table (source, tokens)."""
    shares = tokens.where("tokens > 0").select((F.col("tokens") / F.lit(total)).alias("p"), F.lit(budget / total).alias("rate"))
    alpha = 0.0
    if entropy is not None:
        alpha = _bisect(shares, F.log("z") - F.col("alpha") * F.col("zl") / F.col("z") <= F.lit(entropy))
    if repeats is not None:
        alpha = max(alpha, _bisect(shares, F.col("top") / F.col("z") <= F.lit(max(repeats, budget / total))))
    return alpha


def temperature_mix(docs: DataFrame, budget: int | None = None, entropy: float | None = None, repeats: float | None = MAX_REPEATS, seed: int = SEED, towards: float | None = TOWARDS) -> DataFrame:
    """The mixture: a row for each copy, with the columns of ``docs`` and mix_tokens,
    mix_block (which pass over the source) and mix_order (the place within the block).

    budget: tokens in all; by default those of ``docs``.  entropy: in nats; by default
    ``towards`` of the way from that of the shares to that of equal weights."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    at = {c: F.col(f"c{docs.columns.index(c)}") for c in ("doc_id", "source", "text")}
    out = [(f"c{i}", c) for i, c in enumerate(docs.columns) if c not in ADDED]
    place = F.xxhash64(F.lit(seed), at["doc_id"])
    rows = plain(docs).select(
        *(c for c, _ in out), F.coalesce(at["source"].cast("string"), F.lit("")).alias("s"), n_words(at["text"]).alias("t"),
        F.shiftrightunsigned(place, 64 - BUCKET_BITS).cast("int").alias("k"), place.alias("o"), at["doc_id"].alias("i"),
    )
    names = [c for _, c in out] + list(ADDED)
    sums = scratch.write(rows.groupBy("s", "k").agg(F.sum("t").alias("t")), "sums")
    by_source = scratch.write(sums.groupBy("s").agg(F.sum("t").alias("tokens")), "sources")
    total, n = by_source.agg(F.sum("tokens"), F.count_if(F.col("tokens") > 0)).first()
    if not total:
        return rows.limit(0).select(*(c for c, _ in out), "t", F.lit(0).alias("b"), "o").toDF(*names)
    budget = total if budget is None else budget
    if entropy is None and towards is not None and n > 1:
        own = _entropy_of(by_source, total)
        entropy = own + towards * (math.log(n) - own)
    alpha = solve(by_source, budget, total, entropy, repeats)
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(total), F.lit(alpha))).otherwise(0.0)
    z = by_source.agg(F.sum(power)).first()[0]
    goal = F.floor(F.lit(float(budget)) * F.round(power / F.lit(z), DIGITS + 3)).cast("long")
    goals = by_source.select("s", F.when(F.col("tokens") > 0, F.floor(goal / F.col("tokens"))).otherwise(0).cast("int").alias("blocks"), F.when(F.col("tokens") > 0, goal % F.col("tokens")).otherwise(0).alias("left"))
    before = F.sum("t").over(Window.partitionBy("s").orderBy("k").rowsBetween(Window.unboundedPreceding, -1))  # of 4096 sums a source at most
    plan = sums.select("s", "k", "t", F.coalesce(before, F.lit(0)).alias("base")).join(goals, "s")
    # bucket by bucket the prefix takes all, nothing, or (in one bucket a source, the edge) some
    edge = plan.groupBy("s").agg(
        F.first("blocks").alias("blocks"), F.first("left").alias("left"), F.max(F.when(F.expr("left >= base + t"), F.col("k"))).alias("whole"),
        F.max(F.when(F.expr("left > base and left < base + t"), F.col("k"))).alias("edge"), F.max(F.when(F.expr("left > base and left < base + t"), F.col("base"))).alias("base"),
    )
    edge = scratch.write(edge, "edge")
    cuts = edge.where("edge is not null").select("s", F.col("edge").alias("k"), "base", "left")
    inner = rows.select("s", "k", "o", "i", "t").join(_sent(cuts), ["s", "k"])
    run = F.sum("t").over(Window.partitionBy("s", "k").orderBy("o", "i"))
    last = inner.select("s", "o", "i", (F.col("base") + run).alias("upto"), "left").where("upto <= left").groupBy("s").agg(F.max(F.struct("o", "i")).alias("last"))
    steps = scratch.write(edge.join(last, "s", "left").select("s", "blocks", "left", "whole", "edge", "last"), "steps")
    held = rows.join(_sent(steps), "s")
    # the places of one bucket share their first bits, so o orders them
    within = (F.col("left") > 0) & F.when(F.col("k") == F.col("edge"), F.coalesce(F.struct("o", "i") <= F.col("last"), F.lit(False))).otherwise(F.coalesce(F.col("k") <= F.col("whole"), F.lit(False)))
    taken = held.withColumn("copies", F.col("blocks") + within.cast("int")).where("copies > 0").withColumn("b", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    order = F.when(F.col("b") == F.col("blocks"), F.col("o")).otherwise(F.xxhash64(F.lit(seed), F.col("i"), F.col("b")))
    return taken.select(*(c for c, _ in out), "t", "b", order).toDF(*names)


def _entropy_of(by_source: DataFrame, total: int) -> float:
    p = F.col("tokens") / F.lit(total)
    return by_source.where("tokens > 0").agg(-F.sum(p * F.log(p))).first()[0]


def _sent(table: DataFrame) -> DataFrame:
    """A table of narrow rows, sent to every executor if it has at most ``SMALL`` of them."""
    return F.broadcast(table) if table.count() <= SMALL else table
