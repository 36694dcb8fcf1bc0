"""Rules with timers: over tables, and as streams of any batches."""

from __future__ import annotations

import random
import time
from datetime import datetime, timedelta

import pandas as pd
import pytest

from sparkseek.streaming import timers

T0 = datetime(2024, 1, 1, 9)
SCHEMA = "box string, at timestamp, seq long, kind string, text string, value long"


def table(spark, events):
    """events: (key, milliseconds, kind, text, value)."""
    return spark.createDataFrame([(k, T0 + timedelta(milliseconds=ms), i, kind, text, value) for i, (k, ms, kind, text, value) in enumerate(events)], SCHEMA)


def told(df):
    return sorted(((r[0], int((r[1] - T0).total_seconds() * 1000), *r[2:]) for r in df.collect()), key=str)


def key(box, ms, text, held=0):
    return (box, ms, "key", text, held)


def test_typing(spark):
    """The debouncer's cases, one box each."""
    events = [key("once", 0, "a")]
    events += [key("again", i * 100, f"q{i}") for i in range(5)]
    events += [key("held", 0, "h", 1), ("held", 1_730, "up", None, None)]
    events += [key("never up", 0, "n", 1)]
    events += [key("cancelled", 0, "c"), ("cancelled", 200, "cancel", None, None)]
    events += [key("cancelled, again", 0, "c"), ("cancelled, again", 200, "cancel", None, None), key("cancelled, again", 300, "d")]
    events += [key("flushed", 0, "f"), ("flushed", 100, "flush", None, None), ("flushed", 150, "flush", None, None)]
    events += [key("two", 0, "x"), key("two", 500, "y")]  # what is due comes before what is typed at that time
    events += [key("held, then typed", 0, "a", 1), key("held, then typed", 700, "b")]
    rule = timers.Typing()
    assert told(timers.over_table(rule, table(spark, events), "box", T0 + timedelta(minutes=1))) == sorted(
        [
            ("once", 500, "a", 1, 0), ("again", 900, "q4", 5, 0), ("held", 2_000, "h", 1, 3), ("never up", 10_500, "n", 1, 20), ("cancelled, again", 800, "d", 1, 0),
            ("flushed", 100, "f", 1, 0), ("two", 500, "x", 1, 0), ("two", 1_000, "y", 1, 0), ("held, then typed", 1_200, "b", 2, 0),
        ], key=str,
    )
    assert told(timers.over_table(timers.Typing(0), table(spark, [key("off", 0, "a"), key("off", 1, "b")]), "box")) == [("off", 0, "a", 1, 0), ("off", 1, "b", 1, 0)]
    assert timers.over_table(rule, table(spark, events).where("false"), "box").count() == 0


M = 60_000


def refreshes(spark, events, minutes):
    got = told(timers.over_table(timers.RefreshClock(), table(spark, events), "box", T0 + timedelta(minutes=minutes)))
    out = {}
    for box, ms, reason in got:
        out.setdefault(box, []).append((ms / M, reason))
    return {b: sorted(x) for b, x in out.items()}


def test_refresh_clock(spark):
    """The scheduler's cases, one index each; times in minutes."""
    cases = {
        "starts after the delay": ([], [(2, "scheduled")]),
        "waits for the interval": ([(3, "ended", None)], [(2, "scheduled"), (63, "scheduled")]),
        "interval of at least a quarter": ([(0, "interval", 1), (2, "ended", None)], [(2, "scheduled"), (17, "scheduled")]),
        "not while in use": ([(1, "busy", 1), (30.5, "busy", 0)], [(31, "scheduled")]),
        "never when empty": ([(0, "count", 0)], []),
        "not when switched off": ([(0, "enabled", 0)], []),
        "switched on again": ([(0, "enabled", 0), (40.5, "enabled", 1)], [(41, "scheduled")]),
        "a change, settled": ([(2.5, "ended", None), (10.5, "change", None)], [(2, "scheduled"), (12, "changed")]),
        "a burst begins the wait anew": ([(2.5, "ended", None), *((10 + i * 0.5, "change", None) for i in range(9))], [(2, "scheduled"), (15, "changed")]),
        "a change counts once": ([(2.5, "ended", None), (10.5, "change", None), (12.5, "ended", None)], [(2, "scheduled"), (12, "changed"), (73, "scheduled")]),
        "a rebuild begins the interval anew": ([(1, "rebuild", 1), (9.5, "change", None), (20.5, "rebuild", 0)], []),
        "a long refresh leaves the whole gap": ([(6, "ended", None)], [(2, "scheduled"), (66, "scheduled")]),
        "a failed one ends, too": ([(2.1, "ended", None), (63.1, "ended", None)], [(2, "scheduled"), (63, "scheduled")]),
        "nothing while one runs": ([(5, "change", None)], [(2, "scheduled")]),
        "nothing after the end": ([(1.5, "stop", None), (1.6, "change", None)], []),
    }
    events = [e for box, (said, _) in cases.items() for e in [(box, 0, "start", None, None), *((box, int(m * M), kind, None, v) for m, kind, v in said)]]
    assert refreshes(spark, events, 75) == {b: want for b, (_, want) in cases.items() if want}
    assert refreshes(spark, [("a", 0, "start", None, None), ("a", int(2.5 * M), "ended", None, None)], 62.5 + 600)["a"] == [(2, "scheduled"), (63, "scheduled")]


def test_shared_runs(spark):
    events = [("x", 0, "ask", "a", None), ("x", 5, "ask", "b", None), ("x", 10, "ended", "done", None), ("x", 11, "ended", "odd", None), ("x", 20, "ask", "c", None), ("x", 30, "ended", "failed", None), ("y", 0, "ask", "d", None)]
    got = told(timers.over_table(timers.SharedRuns(), table(spark, events), "box"))
    base = int((T0 - datetime(1970, 1, 1)).total_seconds() * 1000)
    assert [(b, ms, who, began - base, out) for b, ms, who, began, out in got] == [("x", 10, "a", 0, "done"), ("x", 10, "b", 0, "done"), ("x", 30, "c", 20, "failed")]


def test_answers_expire(spark):
    s = 1000
    events = [("u", 0, "ask", None, None), ("u", 1 * s, "failure", None, None), ("u", 2 * s, "ask", None, None), ("u", 301 * s, "ask", None, None), ("u", 302 * s, "failure", None, None), ("u", 303 * s, "failure", None, None), ("u", 604 * s, "ask", None, None)]
    events += [("v", 0, "answer", "body", None), ("v", 10_000 * s, "ask", None, None), ("w", 0, "answer", "short", 5 * s), ("w", 4 * s, "ask", None, None), ("w", 5 * s, "ask", None, None)]
    got = {(b, ms // s): rest for b, ms, *rest in told(timers.over_table(timers.Answers(), table(spark, events), "box"))}
    assert got == {("u", 0): ["fetch", None, 0], ("u", 2): ["cache", None, 0], ("u", 301): ["fetch", None, 0], ("u", 604): ["fetch", None, 0], ("v", 10_000): ["cache", "body", 0], ("w", 4): ["cache", "short", 0], ("w", 5): ["fetch", None, 0]}


def random_events(seed):
    rng = random.Random(seed)
    events, at = [], 0
    for _ in range(120):
        at += rng.choice([50, 100, 300, 700, 2_000])
        box = rng.choice("abc")
        kind = rng.choice(["key", "key", "key", "up", "cancel", "flush"])
        events.append((box, at, kind, f"q{len(events)}" if kind == "key" else None, rng.randint(0, 1)))
    return events


def clock_events(seed):
    rng = random.Random(seed)
    events = [(b, 0, "start", None, None) for b in "abc"]
    at = 0
    for _ in range(80):
        at += rng.choice([10_000, 40_000, 3 * M, 11 * M])
        kind, value = rng.choice([("change", None), ("change", None), ("ended", None), ("ended", None), ("busy", 0), ("busy", 1), ("rebuild", 0), ("enabled", 1), ("interval", 15)])
        events.append((rng.choice("abc"), at, kind, None, value))
    return events


@pytest.mark.parametrize("rule, events, key_of_end", [(timers.Typing(), random_events(1), "end"), (timers.RefreshClock(), clock_events(2), "end")])
def test_a_stream_equals_the_table(spark, tmp_path, rule, events, key_of_end):
    """In three files, out of order within the allowed lateness; a last event of another key moves the clock on."""
    last = max(e[1] for e in events)
    late = 5_000
    df = table(spark, events)
    rows = df.collect()
    rng = random.Random(3)
    cut = [T0 + timedelta(milliseconds=last * j / 3) for j in (1, 2)]
    parts = [[], [], []]
    for r in rows:
        shift = timedelta(milliseconds=rng.choice([0, 0, late - 1_000]))  # some come a file later
        parts[sum(r["at"] + shift > c for c in cut)].append(tuple(r))
    parts.append([(key_of_end, T0 + timedelta(milliseconds=last + 100 * M), 10_000, "none", None, None)])
    parts.append([(key_of_end, T0 + timedelta(milliseconds=last + 100 * M + 1), 10_001, "none", None, None)])
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/{i}")
    (tmp_path / "in").mkdir()
    files = [next(p for p in (tmp_path / str(i)).iterdir() if p.suffix == ".parquet") for i in range(len(parts))]
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    name = f"out_{type(rule).__name__}"
    run = timers.as_stream(rule, stream, "box", f"{late} milliseconds").writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/state").start()
    try:
        for i, f in enumerate(files):
            f.rename(tmp_path / "in" / f"{i}.parquet")
            run.processAllAvailable()
            time.sleep(0.5)
        run.processAllAvailable()
        got = told(spark.table(name))
    finally:
        run.stop()
    until = T0 + timedelta(milliseconds=last + 100 * M - late)
    assert got == told(timers.over_table(rule, df, "box", until)) and len(got) > 5


def test_rows_of_a_table_come_in_few_frames():
    """A frame for each row was nine tenths of the time of a table of events."""
    events = pd.DataFrame({"box": [i // 2 for i in range(6000)], "ms": [i * 1000 for i in range(6000)], "seq": range(6000), "kind": "key", "text": [str(i) for i in range(6000)], "value": [None, 1] * 3000})
    frames = list(timers.streamed(timers.Typing(), "box", 10**8)(iter([events[:2500], events[2500:]])))
    assert len(frames) == 1 and list(frames[0]["query"]) == [str(i) for i in range(6000)]
    assert list(frames[0]["held"]) == [0, 20] * 3000 and list(frames[0]["n_keys"]) == [1] * 6000
