"""Streams with state, and the pieces that decide when something runs."""

from __future__ import annotations

from datetime import datetime, timedelta

from sparkseek.streaming import state

T0 = datetime(2024, 1, 1, 9)
KEYS = "session_id string, at timestamp, seq int, query string, flush boolean, held_until timestamp"


def at(ms):
    return T0 + timedelta(milliseconds=ms)


def test_bursts(spark):
    rows = [("a", 0, "t"), ("a", 300, "ta"), ("a", 700, "tas"), ("a", 1500, "task"), ("b", 0, "x")]
    keys = [(s, at(ms), i, q, False, None) for i, (s, ms, q) in enumerate(rows)]
    keys += [("c", at(0), 10, "go", False, None), ("c", at(100), 11, "gone", True, None), ("c", at(200), 12, "h", False, None), ("d", at(0), 13, "held", False, at(1200)), ("e", at(0), 14, "held", False, at(60_000))]
    got = {(r["session_id"], r["query"]): (int((r["due"] - T0).total_seconds() * 1000), r["n_keys"], r["flushed"]) for r in state.typed_bursts(spark.createDataFrame(keys, KEYS)).collect()}
    assert got == {("a", "tas"): (1200, 3, False), ("a", "task"): (2000, 1, False), ("b", "x"): (500, 1, False), ("c", "gone"): (100, 2, True), ("c", "h"): (700, 1, False), ("d", "held"): (1200, 1, False), ("e", "held"): (10_500, 1, False)}
    assert state.typed_bursts(spark.createDataFrame(keys, KEYS), 0).count() == len(keys)
