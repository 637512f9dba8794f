"""The life of sessions as one stream: counters in state, deadlines as timers.

This is the running form of :mod:`..operators.schedule`: the same counters and rules, kept per
session by ``transformWithState`` instead of a table that each notification writes anew.  Events
go in (conversations that arrived, answers of extractions and of runs over scenes), firings come
out, and :func:`acting` runs what fired and writes the answers that the stream reads again.

Clocks.  By ``ProcessingTime`` rows count when they come and deadlines are of the wall clock: for
running.  By ``EventTime`` rows wait until the watermark has passed them and are then taken in the
order of their times, so that firings do not depend on how rows were batched: for replays.  Rows
behind that watermark are dropped by Spark, as its progress tells.

Each row counts once.  A session's arrival is known by its time, so of several at one instant
(a producer adds those up) the first counts, and one not after the last is a replay.  An answer is
known by the number of its run; others are passed over.  A run without an answer after ``wait`` is
a failed one.  A session that was idle for ``STALE_WINDOWS`` windows with nothing buffered or running loses its state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as tx
from ..operators.schedule import RETRIES, RETRY_MS, STALE_WINDOWS, STATES, Times

#: ``kind`` is arrived (conversations, messages), facts (run, ok, taken) or scenes (run, ok, skipped, cursor).
EVENTS = "session_key string, kind string, at timestamp, conversations long, messages long, run long, ok boolean, taken long, skipped boolean, cursor string"
#: ``action`` is facts or scenes, to be answered with ``run``, or persona, which is not.
FIRINGS = "session_key string, action string, run long, at long, conversations long, buffered long, cursor string"
WAIT_MS = 600_000

_STATE = (
    "conversation_count long, buffered long, last_active long, warmup_threshold long, l2_pending_l1_count long, l1_due long, l1_retries long, l2_due long, "
    "l2_source string, l2_last_run long, l2_cursor string, seen long, runs long, l1_run long, l1_answer long, l2_run long, l2_answer long, timer long"
)
_EVENT = "at long, kind string, conversations long, messages long, run long, ok boolean, taken long, skipped boolean, cursor string"
_FIRED = [c.split(" ")[0] for c in FIRINGS.split(", ")]


def _known(x):
    """A cell of pandas as Python has it, null as None."""
    return None if pd.isna(x) else x.item() if hasattr(x, "item") else x


@dataclass
class _Session:
    """One session's counters, deadlines and runs; a field for each column of the state."""

    conversation_count: int = 0
    buffered: int = 0
    last_active: int = 0
    warmup_threshold: int = 0
    l2_pending_l1_count: int = 0
    l1_due: int | None = None
    l1_retries: int = 0
    l2_due: int | None = None
    l2_source: str | None = None
    l2_last_run: int | None = None
    l2_cursor: str | None = None
    seen: int | None = None
    runs: int = 0
    l1_run: int | None = None
    l1_answer: int | None = None
    l2_run: int | None = None
    l2_answer: int | None = None
    timer: int | None = None

    def due(self, times: Times) -> tuple[int, str] | None:
        """The next deadline and what it is; extractions come before scenes, the end of the state last."""
        found = []
        if self.l1_run is not None:
            found.append((self.l1_answer, 0, "no facts"))
        elif self.l1_due is not None and (self.conversation_count or self.buffered):
            found.append((self.l1_due, 1, "facts"))
        if self.l2_run is not None:
            found.append((self.l2_answer, 2, "no scenes"))
        elif self.l2_due is not None:
            found.append((self.l2_due, 3, "scenes"))
        if self.l1_run is None and self.l2_run is None and not self.buffered:
            found.append((self.last_active + STALE_WINDOWS * times.active, 4, "stale"))
        return (min(found)[0], min(found)[2]) if found else None

    def arrived(self, conversations: int, messages: int, now: int, times: Times) -> None:
        self.conversation_count += conversations
        self.buffered += messages
        self.last_active, self.l1_retries = now, 0
        wanted = min(self.warmup_threshold, times.every) if times.warmup and self.warmup_threshold > 0 else times.every
        self.l1_due = now if self.conversation_count >= wanted else now + times.idle

    def advance(self, now: int, times: Times) -> int:
        return max(now + times.delay, 0 if self.l2_last_run is None else self.l2_last_run + times.least)

    def facts_done(self, ok: bool, taken: int | None, now: int, times: Times) -> None:
        self.l1_run = self.l1_answer = None
        if not ok:
            self.l1_retries += 1
            self.l1_due = now + RETRY_MS if self.l1_retries <= RETRIES else None
            return
        self.l2_pending_l1_count, self.conversation_count = self.conversation_count, 0
        self.buffered = 0 if taken is None else max(0, self.buffered - taken)
        self.l1_due, self.l1_retries = None, 0
        if times.warmup and self.warmup_threshold > 0:
            self.warmup_threshold = 0 if self.warmup_threshold * 2 >= times.every else self.warmup_threshold * 2
        at = self.advance(now, times)
        if self.l2_due is None or at < self.l2_due:
            self.l2_due, self.l2_source = at, "delay"

    def scenes_done(self, ok: bool, skipped: bool, cursor: str | None, now: int, times: Times) -> bool:
        """Whether the run counts; the longest interval begins anew in any case."""
        self.l2_run = self.l2_answer = None
        self.l2_due, self.l2_source = now + times.most, "max"
        if not ok or (skipped and self.l2_last_run is None):
            return False
        self.l2_pending_l1_count, self.l2_last_run = 0, now
        self.l2_cursor = cursor or self.l2_cursor or pd.Timestamp(now, unit="ms").isoformat(timespec="milliseconds") + "Z"
        return True


class _Sessions(StatefulProcessor):
    """Events of a session in the order of their times, between them what gets due."""

    def __init__(self, times: Times, by_event: bool, wait: int):
        self.times, self.by_event, self.wait = times, by_event, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", _STATE)
        self.waiting = handle.getListState("waiting", _EVENT)

    def _now(self, timer_values) -> int:
        return timer_values.getCurrentWatermarkInMs() if self.by_event else timer_values.getCurrentProcessingTimeInMs()

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """A saved state at the start: pending work becomes a delayed run over scenes; buffers,
        deadlines and runs were of the old process."""
        row = {c: _known(v) for c, v in initialState.iloc[0].items() if c != "session_key"}
        now = self._now(timerValues)
        s = _Session(last_active=row["last_active"] or now, warmup_threshold=row["warmup_threshold"] or 0, l2_last_run=row["l2_last_run"], l2_cursor=row["l2_cursor"])
        s.l2_pending_l1_count = max(row["l2_pending_l1_count"] or 0, row["conversation_count"] or 0)
        if s.l2_pending_l1_count:
            s.l2_due, s.l2_source = s.advance(now, self.times), "delay"
        self._keep(s, [])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [tuple(_known(v) for v in r) for part in rows for r in part[[c.split(" ")[0] for c in _EVENT.split(", ")]].itertuples(index=False)]
        yield from self._run(key, new, self._now(timerValues))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._run(key, [], self._now(timerValues), expiredTimerInfo.getExpiryTimeInMs())

    def _run(self, key, new: list[tuple], now: int, expired: int | None = None) -> Iterator[pd.DataFrame]:
        s = _Session(*self.state.get()) if self.state.exists() else None
        if s is not None and s.timer == expired:
            s.timer = None  # Spark takes an expired timer away by itself
        held = list(self.waiting.get()) if self.by_event and self.waiting.exists() else []
        events = sorted([tuple(e) for e in held] + new, key=lambda e: (e[0], e[1] != "arrived", e[1], e[4] or 0))
        out, k = [], 0
        while True:
            at = None if k == len(events) else events[k][0] if self.by_event else now
            due = None if s is None else s.due(self.times)
            if at is not None and at <= now and (due is None or at <= due[0]):
                s = self._take(s, events[k], at, key[0], out)
                k += 1
            elif due is not None and due[0] <= now:
                s = self._fire(s, *due, key[0], out)
            else:
                break
        self._keep(s, events[k:])
        if out:
            yield pd.DataFrame(out, columns=_FIRED)

    def _take(self, s: _Session | None, event: tuple, at: int, key: str, out: list) -> _Session | None:
        mark, kind, conversations, messages, run, ok, taken, skipped, cursor = event
        if kind == "arrived":
            if s is None:
                s = _Session(warmup_threshold=1 if self.times.warmup else 0)
            if s.seen is None or mark > s.seen:
                s.seen = mark
                s.arrived(conversations or 0, messages or 0, at, self.times)
        elif s is not None and run is not None and kind == "facts" and run == s.l1_run:
            s.facts_done(bool(ok), taken, at, self.times)
        elif s is not None and run is not None and kind == "scenes" and run == s.l2_run:
            if s.scenes_done(bool(ok), bool(skipped), cursor, at, self.times):
                out.append((key, "persona", run, at, s.conversation_count, s.buffered, s.l2_cursor))
        return s

    def _fire(self, s: _Session, at: int, what: str, key: str, out: list) -> _Session | None:
        if what == "stale":
            return None
        if what == "no facts":
            s.facts_done(False, None, at, self.times)
        elif what == "no scenes":
            s.scenes_done(False, False, None, at, self.times)
        elif what == "facts":
            s.runs += 1
            s.l1_due, s.l1_run, s.l1_answer = None, s.runs, at + self.wait
            out.append((key, what, s.runs, at, s.conversation_count, s.buffered, None))
        else:
            cold = s.l2_source == "max" and at - s.last_active >= self.times.active
            s.l2_due = s.l2_source = None
            if not cold:
                s.runs += 1
                s.l2_run, s.l2_answer = s.runs, at + self.wait
                out.append((key, what, s.runs, at, s.conversation_count, s.buffered, s.l2_cursor))
        return s

    def _keep(self, s: _Session | None, events: list[tuple]) -> None:
        """The state, what waits, and one timer for whichever is next."""
        if self.by_event:
            self.waiting.put(events) if events else self.waiting.clear()
        due = None if s is None else s.due(self.times)
        ends = ([] if due is None else [due[0]]) + ([events[0][0]] if events else [])
        timer = min(ends) if ends else None
        for old in list(self.handle.listTimers()):
            if old != timer:
                self.handle.deleteTimer(old)
        if timer is not None:
            self.handle.registerTimer(timer)
        if s is None:
            self.state.clear()
        else:
            s.timer = timer
            self.state.update(astuple(s))

    def close(self) -> None:
        pass


def firings(events: DataFrame, times: Times = Times(), clock: str = "ProcessingTime", late: str = "10 minutes", saved: DataFrame | None = None, skip: tuple[str, ...] = (), wait: int = WAIT_MS) -> DataFrame:
    """What gets due in a stream of events (:data:`EVENTS`), with columns :data:`FIRINGS`.

    ``late`` is how far behind the newest a row may be by ``EventTime``.  ``saved`` is a table of
    states (of :mod:`..operators.schedule`, a row for each session) to start from.  Sessions that
    :func:`skip_session` takes out, by ``skip`` too, and rows without a session or a time never get a state."""
    rows = events.where(F.col("session_key").isNotNull() & F.col("at").isNotNull() & F.col("kind").isNotNull() & ~tx.skip_session(F.col("session_key"), skip))
    by_event = clock == "EventTime"
    if by_event:
        rows = rows.withColumn("seen", F.col("at")).withWatermark("seen", late)
    rows = rows.withColumn("at", F.unix_millis("at"))
    start = None if saved is None else saved.select(*(c.split(" ")[0] for c in STATES.split(", "))).groupBy("session_key")
    return rows.groupBy("session_key").transformWithStateInPandas(_Sessions(times, by_event, wait), FIRINGS, "Append", clock, start)


def arrivals(messages: DataFrame) -> DataFrame:
    """Events of captured messages (session_key, role, timestamp in milliseconds): those of one
    instant are one, with a conversation for each user message in it.  Of a batch, as in ``foreachBatch``."""
    own = messages.groupBy("session_key", "timestamp").agg(F.count_if(F.col("role") == "user").alias("conversations"), F.count(F.lit(1)).alias("messages"))
    known = {"session_key": F.col("session_key"), "kind": F.lit("arrived"), "at": F.timestamp_millis("timestamp"), "conversations": F.col("conversations"), "messages": F.col("messages")}
    return own.select(*(known.get(n, F.lit(None)).cast(t).alias(n) for n, t in (c.split(" ") for c in EVENTS.split(", "))))


def acting(extract: Callable[[DataFrame], DataFrame], scenes: Callable[[DataFrame], DataFrame], persona: Callable[[], None], path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: runs what fired and writes the answers under ``path``, which the stream
    of events reads as ``{path}/batch=*``.

    ``extract`` takes firings and returns (session_key, ok, taken), ``scenes`` (session_key, ok, skipped, cursor).
    A session that they do not return, or for which they raise, has failed.  All requests for the persona of a
    batch are one run.  A batch that is run again replaces its answers, and the stream takes either once."""
    values = {"ok": "boolean", "taken": "long", "skipped": "boolean", "cursor": "string"}

    def answers(fired: DataFrame, kind: str, call) -> DataFrame:
        own = fired.where(F.col("action") == kind).drop("cursor") if kind == "facts" else fired.where(F.col("action") == kind)
        asked = own.select("session_key", F.col("action").alias("kind"), "run")
        try:
            got = call(own)
            got = got.select("session_key", *(c for c in values if c in got.columns)).dropDuplicates(["session_key"]).persist()
            got.count()
        except Exception:  # whatever it raises is a failed try of all
            got = asked.select("session_key").limit(0)
        both = asked.join(got, "session_key", "left").withColumn("ok", F.coalesce("ok", F.lit(False)) if "ok" in got.columns else F.lit(False)).withColumn("at", F.current_timestamp())
        return both.select(*(F.col(n).cast(t).alias(n) if n in both.columns else F.lit(None).cast(t).alias(n) for n, t in (c.split(" ") for c in EVENTS.split(", "))))

    def act(batch: DataFrame, batch_id: int) -> None:
        fired = batch.persist()
        try:
            if fired.isEmpty():
                return
            both = [answers(fired, kind, call) for kind, call in (("facts", extract), ("scenes", scenes)) if not fired.where(F.col("action") == kind).isEmpty()]
            for k, rows in enumerate(both):
                rows.write.mode("append" if k else "overwrite").parquet(f"{path}/batch={batch_id}")
            if not fired.where(F.col("action") == "persona").isEmpty():
                persona()
        finally:
            fired.unpersist()

    return act
