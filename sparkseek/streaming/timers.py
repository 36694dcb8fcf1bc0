"""Streams with timers and state of their own (transformWithState): typing, the refresh clock, shared runs and
cached answers.

Each rule is a fold of one key's events in the order of their times.  As a stream, events wait in the state until
the watermark has passed them, so those that come out of order within the allowed lateness are folded in
order, and timers fire at the times of the events' own clock: a stream's rows are those of the same fold over a table
(:func:`over_table`), whatever its batches were.  Later events are dropped by the watermark.  The
state needs the RocksDB provider (:func:`use_rocksdb`)."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

WAIT_MS, EXTENSIONS = 500, 20
SETTLE_MS, STARTUP_MS, TICK_MS = 45_000, 120_000, 60_000
NEGATIVE_MS, MOST_BACK_OFF_MS = 300_000, 300_000
FOREVER = 1 << 60
#: Rows that are handed on together.
ROWS = 10_000


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Typing:
    """One box that is typed in.  ``key`` (query; value: held down or not) schedules a run in place of the one that
    waits, ``up`` says that the key came up, ``cancel`` drops what waits, ``flush`` runs it at once.

    A run is due when nothing was typed for the wait.  While the key is still down it is put off by another
    wait, ``EXTENSIONS`` times at most.  Without a wait a key runs at once."""

    INPUT = "kind string, text string, value long"
    OUTPUT = "query string, n_keys long, held long"
    STATE = "query string, n long, due long, held long, down boolean"
    EMPTY = (None, 0, FOREVER, 0, False)

    def __init__(self, wait_ms: int = WAIT_MS, extensions: int = EXTENSIONS):
        self.wait, self.extensions = wait_ms, extensions

    def next(self, state: tuple) -> int:
        return state[2]

    def wake(self, state: tuple, now: int) -> tuple[tuple, list]:
        query, n, due, held, down = state
        if down and held < self.extensions:
            return (query, n, due + self.wait, held + 1, down), []
        return (None, 0, FOREVER, 0, down), [(now, query, n, held)]

    def event(self, state: tuple, at: int, kind: str, text: str | None, value: int | None) -> tuple[tuple, list]:
        query, n, due, held, down = state
        if kind == "key":
            if self.wait <= 0:
                return self.EMPTY, [(at, text, 1, 0)]
            return (text, n + 1, at + self.wait, 0, bool(value)), []
        if kind == "up":
            return (query, n, due, held, False), []
        if kind == "cancel":
            return (None, 0, FOREVER, 0, down), []
        if kind == "flush" and n:
            return (None, 0, FOREVER, 0, down), [(at, query, n, held)]
        return state, []


class RefreshClock:
    """One index that is kept current.  Every minute it is decided whether a refresh starts: not while one runs, nor
    when switched off, empty or in use; a change that has settled starts one, else the interval since the last end, at
    first a delay after the start.

    Events: ``start``; ``change``; ``count``, ``enabled``, ``busy`` (value); ``interval`` (minutes); ``ended``, that of
    a refresh of its own; ``rebuild`` (value: begun or ended by someone else); ``stop``."""

    INPUT = "kind string, text string, value long"
    OUTPUT = "reason string"
    STATE = "tick long, due long, change long, running boolean, rebuilding boolean, enabled boolean, busy boolean, count long, minutes long"
    EMPTY = (FOREVER, FOREVER, None, False, False, True, False, 1, 60)

    def next(self, state: tuple) -> int:
        return state[0]

    @staticmethod
    def _interval(minutes: int) -> int:
        return max(15, min(24 * 60, minutes)) * 60_000

    def wake(self, state: tuple, now: int) -> tuple[tuple, list]:
        tick, due, change, running, rebuilding, enabled, busy, count, minutes = state
        tick += TICK_MS
        if rebuilding:  # serves the same purpose: the interval begins anew
            return (tick, now + self._interval(minutes), None, running, rebuilding, enabled, busy, count, minutes), []
        if running or not enabled or not count or busy:
            return (tick, *state[1:]), []
        settled = change is not None and now - change >= SETTLE_MS
        if settled or now >= due:
            return (tick, due, None, True, rebuilding, enabled, busy, count, minutes), [(now, "changed" if settled else "scheduled")]
        return (tick, *state[1:]), []

    def event(self, state: tuple, at: int, kind: str, text: str | None, value: int | None) -> tuple[tuple, list]:
        tick, due, change, running, rebuilding, enabled, busy, count, minutes = state
        if kind == "start" and tick == FOREVER:
            tick, due = at + TICK_MS, at + STARTUP_MS
        elif kind == "stop":
            tick = FOREVER
        elif kind == "change":
            change = at
        elif kind == "ended":
            running, due = False, at + self._interval(minutes)
        elif kind == "rebuild":
            rebuilding = bool(value)
        elif kind == "enabled":
            enabled = bool(value)
        elif kind == "busy":
            busy = bool(value)
        elif kind == "count":
            count = value
        elif kind == "interval":
            minutes = value
        return (tick, due, change, running, rebuilding, enabled, busy, count, minutes), []


class SharedRuns:
    """One run at a time: who asks (``ask``, text: who) while one is in flight shares it.  ``ended`` (text: the
    outcome) ends the run in flight.  A row for each one who asked: when the run began, and its outcome."""

    INPUT = "kind string, text string, value long"
    OUTPUT = "who string, began long, outcome string"
    STATE = "began long, waiting array<string>"
    EMPTY = (None, [])

    def next(self, state: tuple) -> int:
        return FOREVER

    def wake(self, state: tuple, now: int) -> tuple[tuple, list]:
        return state, []

    def event(self, state: tuple, at: int, kind: str, text: str | None, value: int | None) -> tuple[tuple, list]:
        began, waiting = state
        if kind == "ask":
            return (at if began is None else began, [*waiting, text]), []
        if kind == "ended" and began is not None:
            return self.EMPTY, [(at, who, began, text) for who in waiting]
        return state, []


class Answers:
    """The cache of one address.  ``ask`` is answered from it while the entry lives, else fetched (a row: from
    where); ``answer`` (text) stores one for good or, with a value, for so many milliseconds; ``failure``
    stores that there is none for ``NEGATIVE_MS``.  After failures in a row it is left alone for 1, 2, 4, .. seconds, to
    which an ``ask`` is told to wait."""

    INPUT = "kind string, text string, value long"
    OUTPUT = "source string, body string, wait long"
    STATE = "body string, known boolean, until long, failures long, free long"
    EMPTY = (None, False, FOREVER, 0, 0)

    def next(self, state: tuple) -> int:
        return state[2] if state[1] else FOREVER

    def wake(self, state: tuple, now: int) -> tuple[tuple, list]:
        return (None, False, FOREVER, *state[3:]), []  # the entry has expired, the failures count on

    def event(self, state: tuple, at: int, kind: str, text: str | None, value: int | None) -> tuple[tuple, list]:
        body, known, until, failures, free = state
        if kind == "answer":
            return (text, True, FOREVER if value is None else at + value, 0, 0), []
        if kind == "failure":
            failures += 1
            return (None, True, at + NEGATIVE_MS, failures, at + min(MOST_BACK_OFF_MS, 1000 << min(failures - 1, 30))), []
        if kind == "ask":
            return state, [(at, "cache" if known else "fetch", body, 0 if known else max(0, free - at))]
        return state, []


RULES = {c.__name__: c for c in (Typing, RefreshClock, SharedRuns, Answers)}


def advance(rule, state: tuple, until: int) -> tuple[tuple, list]:
    """Fires all that is due up to and at a time."""
    out = []
    while (due := rule.next(state)) <= until:
        state, more = rule.wake(state, due)
        out += more
    return state, out


def _ms(at: datetime) -> int:
    at = at if at.tzinfo else at.replace(tzinfo=UTC)
    return int(at.timestamp() * 1000)


def _output(rule, key: str, kind: str) -> str:
    return f"`{key}` {kind}, at timestamp, {rule.OUTPUT}"


def _frame(rule, key, out: list, name: str) -> pd.DataFrame:
    return _rows(rule, [(key, *x) for x in out], name)


def _rows(rule, out: list, name: str) -> pd.DataFrame:
    columns = [name, "at", *(c.split()[0] for c in rule.OUTPUT.split(", "))]
    rows = pd.DataFrame(out, columns=columns)
    rows["at"] = pd.to_datetime(rows["at"], unit="ms")
    return rows


class Folded(StatefulProcessor):
    """The fold of a rule with timers: ``waiting`` events and the rule's state."""

    def __init__(self, rule, name: str):
        self.rule, self.name = rule, name

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, seq long, kind string, text string, value long")
        self.state = handle.getValueState("state", self.rule.STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        for batch in rows:
            new = [(int(r.ms), int(r.seq), r.kind, None if pd.isna(r.text) else r.text, None if pd.isna(r.value) else int(r.value)) for r in batch.itertuples()]
            self.waiting.appendList(new)
            for at in {x[0] for x in new}:
                self.handle.registerTimer(max(at, now + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = sorted((tuple(x) for x in self.waiting.get()), key=lambda x: (x[0], x[1]))
        ready = [x for x in held if x[0] <= now]
        if ready:
            rest = held[len(ready) :]
            self.waiting.clear()
            if rest:
                self.waiting.appendList(rest)
        before = self.state.get() if self.state.exists() else None
        state = self.rule.EMPTY if before is None else tuple(before)
        state, out = fold(self.rule, state, ready, now)
        self.state.update(state)
        if self.rule.next(state) < FOREVER:
            self.handle.registerTimer(self.rule.next(state))
        if out:
            yield _frame(self.rule, key[0], out, self.name)

    def close(self) -> None:
        pass


def fold(rule, state: tuple, events: list[tuple], until: int) -> tuple[tuple, list]:
    """Events (at, seq, kind, text, value) in order, and what is due up to ``until``.  What is due at the time of an
    event comes before it."""
    out = []
    for at, _, kind, text, value in events:
        state, more = advance(rule, state, at)
        out += more
        state, more = rule.event(state, at, kind, text, value)
        out += more
    state, more = advance(rule, state, until)
    return state, out + more


def _told(events: DataFrame, key: str) -> DataFrame:
    return events.select(F.col(key), "at", F.unix_millis("at").alias("ms"), F.col("seq").cast("long").alias("seq"), "kind", "text", F.col("value").cast("long").alias("value"))


def as_stream(rule, events: DataFrame, key: str, late: str = "1 minute") -> DataFrame:
    """The rows of a rule over a stream of events (key, at, seq, kind, text, value)."""
    use_rocksdb(events.sparkSession)
    rows = _told(events, key).withWatermark("at", late)
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=Folded(rule, key), outputStructType=_output(rule, key, dict(events.dtypes)[key]), outputMode="Append", timeMode="EventTime")


def _plain(column: pd.Series) -> list:
    """Plain values, whole numbers as such, None for what is absent."""
    gone = column.isna()
    return [None if g else int(x) if isinstance(x, float) else x for x, g in zip(column.tolist(), gone, strict=True)] if gone.any() else column.tolist()


def streamed(rule, key: str, end: int):
    """The rows of a rule over batches of events in order by key and time, fired up to ``end``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, out = None, None, []
        for batch in batches:
            for name, *event in zip(*(_plain(batch[c]) for c in batch), strict=True):
                if state is None or name != now:
                    if state is not None:
                        out += [(now, *x) for x in advance(rule, state, end)[1]]
                    now, state = name, rule.EMPTY
                state, more = fold(rule, state, [event], event[0] - 1)
                out += [(now, *x) for x in more]
                if len(out) >= ROWS:  # one frame for many rows: a frame costs more than the fold
                    yield _rows(rule, out, key)
                    out = []
        if state is not None:
            yield _rows(rule, [*out, *((now, *x) for x in advance(rule, state, end)[1])], key)

    return run


def over_table(rule, events: DataFrame, key: str, until: datetime | None = None) -> DataFrame:
    """The same over a table; what is due by ``until`` (by default the last event of any key) has fired.

    A key's events stream by in order: only its state is held."""
    end = _ms(until) if until is not None else events.agg(F.max(F.unix_millis("at"))).first()[0] or 0
    kind = dict(events.dtypes)[key]

    rows = _told(events, key).repartition(key).sortWithinPartitions(key, "ms", "seq").select(key, "ms", "seq", "kind", "text", "value")
    return rows.mapInPandas(streamed(rule, key, end), _output(rule, key, kind))
