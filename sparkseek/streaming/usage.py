"""Streams: launch counts, debounced queries, settled refreshes."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def launch_counts(launches: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Count and last time of each entity's launches (entity_id, at), in update mode.  The
    watermark bounds what late launches may still count."""
    rows = launches.withWatermark("at", late) if launches.isStreaming else launches
    return rows.groupBy("entity_id").agg(F.count("*").alias("launch_count"), F.max("at").alias("last_launched_at"))


def debounced(keys: DataFrame, wait: str = "500 milliseconds", late: str = "1 minute") -> DataFrame:
    """(session_id, query, at): a query runs once nothing was typed for ``wait``; the latest
    wins.  keys: (session_id, at, query)."""
    rows = keys.withWatermark("at", late) if keys.isStreaming else keys
    burst = rows.groupBy("session_id", F.session_window("at", wait)).agg(F.max_by("query", F.struct("at", "query")).alias("query"), F.max("at").alias("at"), F.count("*").alias("n_keys"))
    return burst.select("session_id", "query", "at", "n_keys")


def settled_changes(files: DataFrame, wait: str = "45 seconds", late: str = "5 minutes") -> DataFrame:
    """(begin, end, n): bursts of shortcut changes (path, at) that have come to rest."""
    own = F.regexp_like(F.lower("path"), F.lit(r"\.(lnk|url)$")) | ~F.regexp_like("path", F.lit(r"\.[^\\/.]+$"))
    rows = files.where(own)
    rows = rows.withWatermark("at", late) if rows.isStreaming else rows
    return rows.groupBy(F.session_window("at", wait).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n")


@dataclass(frozen=True)
class RefreshState:
    """What the scheduler knows at a tick."""

    now: datetime
    started: datetime
    last_end: datetime | None = None
    last_change: datetime | None = None
    enabled: bool = True
    running: bool = False
    busy: bool = False
    count: int = 1
    interval_minutes: int = 60


SETTLE, STARTUP = timedelta(seconds=45), timedelta(minutes=2)


def refresh_due(s: RefreshState) -> bool:
    """Whether a tick starts a refresh: not while one runs, nor when disabled, empty or busy;
    a change that has settled does; else the interval since the last end decides."""
    if s.running or not s.enabled or s.count == 0 or s.busy:
        return False
    if s.last_change is not None and s.now - s.last_change >= SETTLE and (s.last_end is None or s.last_change > s.last_end):
        return True
    interval = timedelta(minutes=max(15, min(1440, s.interval_minutes)))
    return s.now - s.last_end >= interval if s.last_end is not None else s.now - s.started >= STARTUP


def publish_each(store, build):
    """foreachBatch function: builds tables of a micro-batch and publishes them as the next
    snapshot; a batch that is delivered again is published once."""

    def run(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            store.publish(batch=number, **build(batch))

    return run
