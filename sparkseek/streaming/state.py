"""Typing with flushes, cached answers that expire and back-off as plans over tables; ``timers`` has the
streams of the same rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch_table

WAIT_MS, EXTENSIONS = 500, 20
NEGATIVE_SECONDS, BACK_OFF_SECONDS = 300, 300


def typed_bursts(keys: DataFrame, wait_ms: int = WAIT_MS, extensions: int = EXTENSIONS) -> DataFrame:
    """(session_id, query, due, n_keys, flushed) of a table of keys (session_id, at, seq, query, flush,
    held_until).

    A query runs once nothing was typed for ``wait_ms``; the latest wins.  A key that is still held
    puts the run off, by ``extensions`` waits at most.  A flush runs it at once; without a wait every
    key does."""
    order = Window.partitionBy("session_id").orderBy("at", "seq")
    wait = F.make_dt_interval(secs=F.lit(wait_ms / 1000))
    gap = (F.col("at") >= F.lag("at").over(order) + wait) | F.lag("flush").over(order)
    fresh = F.when(F.coalesce(gap, F.lit(True)), 1).otherwise(0) if wait_ms > 0 else F.lit(1)
    rows = keys.withColumn("burst", F.sum(fresh).over(order))
    last = rows.groupBy("session_id", "burst").agg(F.max_by(F.struct("query", "at", "flush", "held_until"), F.struct("at", "seq")).alias("k"), F.count("*").alias("n_keys"))
    most = F.col("k.at") + F.make_dt_interval(secs=F.lit(wait_ms / 1000 * (extensions + 1)))
    due = F.when(F.col("k.flush"), F.col("k.at")).otherwise(F.greatest(F.col("k.at") + wait, F.least(F.coalesce("k.held_until", "k.at"), most)))
    return last.select("session_id", F.col("k.query").alias("query"), due.alias("due"), "n_keys", F.col("k.flush").alias("flushed"))


def live_entries(cache: DataFrame, as_of: Column, negative: int = NEGATIVE_SECONDS) -> DataFrame:
    """The entries of a cache (uri, at, body) that still hold: answers always, failures (no body) for
    ``negative`` seconds; of each address the last."""
    last = cache.groupBy(F.sha2("uri", 256).alias("key")).agg(F.max_by(F.struct("uri", "at", "body"), "at").alias("e")).select("key", "e.*")
    age = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))
    return last.where(F.col("body").isNotNull() | (age < negative * 1_000_000))


def back_off(answers: DataFrame, most: int = BACK_OFF_SECONDS) -> DataFrame:
    """(host, failures, seconds): how long a host is left alone after its last failures in a row; 1, 2, 4,
    .. seconds, ``most`` at most.  answers: (host, at, ok)."""
    good = answers.where("ok").groupBy("host").agg(F.max("at").alias("since"))
    bad = answers.where("not ok").join(good, "host", "left").where(F.col("since").isNull() | (F.col("at") > F.col("since")))
    return bad.groupBy("host").agg(F.count("*").alias("failures")).select("host", "failures", F.least(F.pow(F.lit(2.0), F.least(F.col("failures") - 1, F.lit(30))), F.lit(float(most))).cast("long").alias("seconds"))


def paced(requests: DataFrame, gap_ms: int) -> DataFrame:
    """(host, id, at, due): when each request (host, id, at) is sent: in order, not before it is made and ``gap_ms``
    after the one before it of its host.

    The i-th of a host is due at the largest of at_j + (i - j) gaps over all j up to i, so this is a running maximum of
    at_j - j gaps.  It is taken in ranges of (host, at, id) first, whose counts and maxima then run over
    the ranges: a host of any number of requests is spread over the tasks."""
    ms = F.unix_millis(F.col("at").cast("timestamp"))
    ranged = scratch_table(requests.select("host", "id", "at", ms.alias("ms")).repartitionByRange("host", "ms", "id").withColumn("part", F.spark_partition_id()), "ranged")
    inside = Window.partitionBy("part", "host").orderBy("ms", "id")
    rows = ranged.withColumn("i", F.row_number().over(inside) - 1).withColumn("lead", F.max(F.col("ms") - F.col("i") * gap_ms).over(inside))
    parts = ranged.withColumn("i", F.row_number().over(inside) - 1).groupBy("host", "part").agg(F.count("*").alias("n"), F.max(F.col("ms") - F.col("i") * gap_ms).alias("most"))
    before = Window.partitionBy("host").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    parts = parts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    parts = parts.withColumn("reached", F.max(F.col("most") - F.col("base") * gap_ms).over(before)).select("host", "part", "base", "reached")
    due = F.greatest(F.col("lead") - F.col("base") * gap_ms, "reached") + (F.col("base") + F.col("i")) * gap_ms
    return rows.join(parts, ["host", "part"]).select("host", "id", "at", F.timestamp_millis(due).alias("due"))
