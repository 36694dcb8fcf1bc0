"""Links between items that meet in a bucket, without listing the pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components

ROUNDS = 2


def link_buckets(
    scratch: Scratch, keys: DataFrame, verify: Callable[[DataFrame], DataFrame], near: str, name: str, marks: DataFrame | None = None, alike: str = "true",
    rounds: int = ROUNDS, known: DataFrame | None = None, early: bool = False, rank: str = "0", late: DataFrame | None = None, once: str = "true",
) -> DataFrame:
    """(node, root) of the graph whose edges are the verified pairs that share a key.

    keys: key, id and what ``near`` needs.  near: a cheap SQL condition that every pair to be
    verified meets, over those columns with the endings _a and _b; alike: a further one over the
    columns of marks (id, ..), which is asked of all pairs (early) or of those listed in the end.
    late (id, ..) and once: columns and a condition that take a pair in one of the buckets it shares.
    verify: (a, b) -> the pairs that hold.

    With early, every item is first compared with the highest centre of all its buckets, one pair an
    item, which leaves few labels.  Then, in each of ``rounds`` rounds every item of a bucket is compared with one of them, its centre
    (n - 1 pairs for n items), and the centre, which has met all others, leaves the bucket.  A
    bucket whose items are all in one component is done.  The centre is the item of the highest
    ``rank``, or drawn by hash, so that a large group of alike items falls into one component within
    a few rounds.  What is left is compared pair by pair, but for pairs in one component.  No pair
    that ``near`` and ``alike`` let through and that could join two components is left out, so the
    components are those of all such pairs that share a key, and of the links ``known`` (a, b)."""
    if early:
        keys = keys.join(marks, "id")
    order = lambda i: F.expr(f"{rank} * 4294967296L + pmod(xxhash64(id, {i}), 4294967296L)")
    # numbers alone are aggregated, in hash tables without a sort; buckets of one item go
    firsts = keys.groupBy("key").agg(F.max_by("id", order(-1)).alias("cid"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")).where("lo < hi").drop("lo", "hi")
    rest = scratch.write(keys.join(firsts.hint("shuffle_hash"), "key").dropDuplicates(["key", "id"]), f"{name}-rest")
    ends = lambda df, x: df.select("key", *(F.col(c).alias(f"{c}_{x}") for c in df.columns if c not in {"key", "cid", "n"}))
    links = [] if known is None else [known]
    roots, apart, old = None if known is None else components(scratch, known, f"{name}-known"), "true", f"{name}-rest"
    if roots is not None:
        told = rest.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("root", "id")).drop("root")
        rest, apart = scratch.write(told, f"{name}-told"), "label_a <> label_b"
        scratch.drop(old)
        old = f"{name}-told"
        if early:
            centres = rest.where("id = cid").select("key", F.col("label").alias("cl"), order(-1).alias("r"))
            best = rest.where("id <> cid").join(centres, "key").where("label <> cl").groupBy("id").agg(F.max_by("cid", "r").alias("cid"))
            pairs = scratch.write(best.select(F.least("id", "cid").alias("a"), F.greatest("id", "cid").alias("b")).distinct(), f"{name}-best")
            links.append(scratch.write(verify(pairs), f"{name}-best-links"))
            roots = components(scratch, reduce(DataFrame.union, links), f"{name}-near")
            told = rest.drop("label").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("root", "id")).drop("root")
            mixed = told.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
            rest = scratch.write(told.join(mixed, "key"), f"{name}-some")
            scratch.drop(old)
            old = f"{name}-some"
            if rest.isEmpty():
                return roots
    for i in range(rounds):
        others = rest.where("id <> cid")
        stars = ends(others, "b").join(ends(rest.where("id = cid"), "a"), "key").where(f"{apart} and {near} and {alike if early else 'true'}")
        pairs = scratch.write(stars.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct(), f"{name}-pairs")
        links.append(scratch.write(verify(pairs), f"{name}-links-{i}"))
        roots = components(scratch, reduce(DataFrame.union, links), f"{name}-{i}")
        scratch.drop(f"{name}-pairs")
        told = others.where("n > 2").drop("cid", "label").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("root", "id")).drop("root", "n")
        mixed = told.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max_by("id", order(i)).alias("cid"), F.count("*").alias("n"))
        rest = scratch.write(told.join(mixed.where("lo <> hi").drop("lo", "hi"), "key"), f"{name}-rest-{i}")
        scratch.drop(old)
        old, apart = f"{name}-rest-{i}", "label_a <> label_b"
        if rest.isEmpty():
            return roots
    left = rest.drop("n", "cid")
    more = late if early else marks
    if more is not None:
        left = scratch.write(left.join(more, "id"), f"{name}-left")
    cross = ends(left, "a").join(ends(left, "b"), "key").where(f"id_a < id_b and label_a <> label_b and {near} and {alike} and {once}")
    cross = scratch.write(cross.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct(), f"{name}-cross")
    scratch.drop(old, f"{name}-left")
    found = scratch.write(verify(cross), f"{name}-found")
    return roots if found.isEmpty() else components(scratch, reduce(DataFrame.union, [*links, found]), f"{name}-all")
