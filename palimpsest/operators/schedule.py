"""The life of sessions between extractions, as tables of states and the changes of them.

A state row has the counters of a session and its deadlines in milliseconds: ``l1_due`` (the next
extraction of facts) and ``l2_due`` (the next run over scenes, with ``l2_source``: ``delay`` after
an extraction, or ``max`` when the longest interval is over).  Each function takes states and what
happened, and returns all states after it; a run over many sessions is a join, not a loop.

A session is run by one batch at a time, so what arrives while it runs waits in ``buffered`` for
the next one, and requests for a persona that come together are one run.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .triggers import ACTIVE_S, DELAY_S, EVERY, IDLE_S, MAX_INTERVAL_S, MIN_INTERVAL_S

STATES = (
    "session_key string, conversation_count long, buffered long, last_active long, warmup_threshold long, l2_pending_l1_count long, "
    "l1_due long, l1_retries int, l2_due long, l2_source string, l2_last_run long, l2_cursor string"
)
RETRIES, RETRY_MS = 5, 30_000
STALE_WINDOWS = 3


@dataclass(frozen=True)
class Times:
    """Settings, in conversations and milliseconds."""

    every: int = EVERY
    warmup: bool = True
    idle: int = IDLE_S * 1000
    delay: int = DELAY_S * 1000
    least: int = MIN_INTERVAL_S * 1000
    most: int = MAX_INTERVAL_S * 1000
    active: int = ACTIVE_S * 1000


_NAMES = [c.strip().split(" ")[0] for c in STATES.split(",")]


def _with(states: DataFrame, **columns) -> DataFrame:
    kinds = dict(x.strip().split(" ") for x in STATES.split(","))
    return states.withColumns({c: (v if isinstance(v, Column) else F.lit(v)).cast(kinds[c]) for c, v in columns.items()}).select(*_NAMES)


def _split(states: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The states of some sessions, and the others."""
    own = keys.select("session_key").distinct()
    return states.join(own, "session_key", "left_semi"), states.join(own, "session_key", "left_anti")


def notified(states: DataFrame, arrived: DataFrame, now: int, times: Times = Times()) -> DataFrame:
    """After conversations (session_key, conversations, messages) arrived: counted and buffered,
    with an extraction due at once where enough came, else after the idle time.

    New sessions begin with a warm-up of one conversation.  An arrival ends a row of retries."""
    new = arrived.groupBy("session_key").agg(F.sum("conversations").alias("_c"), F.sum("messages").alias("_m"))
    both = states.join(new, "session_key", "full_outer")
    came = F.col("_c").isNotNull()
    zero = lambda c: F.coalesce(c, F.lit(0))
    threshold = F.when(F.col("last_active").isNull(), 1 if times.warmup else 0).otherwise(zero("warmup_threshold"))
    count = zero("conversation_count") + zero("_c")
    wanted = F.when(F.lit(times.warmup) & (threshold > 0), F.least(threshold, F.lit(times.every))).otherwise(times.every)
    due = F.when(~came, F.col("l1_due")).when(count >= wanted, F.lit(now)).otherwise(F.lit(now + times.idle))
    return _with(
        both, l1_due=due, conversation_count=count, buffered=zero("buffered") + zero("_m"), warmup_threshold=threshold, last_active=F.when(came, F.lit(now)).otherwise(F.col("last_active")),
        l1_retries=F.when(came, 0).otherwise(zero("l1_retries")), l2_pending_l1_count=zero("l2_pending_l1_count"),
    )


def due_extractions(states: DataFrame, now: int) -> DataFrame:
    """Sessions whose facts are to be extracted now."""
    return states.where((F.col("l1_due") <= now) & ((F.col("conversation_count") > 0) | (F.col("buffered") > 0))).select("session_key")


def flushed(states: DataFrame, now: int, sessions: DataFrame | None = None) -> DataFrame:
    """With an extraction due at once in sessions that end (all, when the process does) and hold work."""
    own, rest = (states, states.limit(0)) if sessions is None else _split(states, sessions)
    work = (F.col("conversation_count") > 0) | (F.col("buffered") > 0)
    return _with(own, l1_due=F.when(work, F.lit(now))).unionByName(rest)


def _advanced(now: int, times: Times) -> Column:
    """When a run over scenes is due after an extraction, if nothing earlier is."""
    return F.greatest(F.lit(now + times.delay), F.coalesce(F.col("l2_last_run") + times.least, F.lit(0)))


def extracted(states: DataFrame, done: DataFrame, now: int, times: Times = Times(), closing: bool = False) -> DataFrame:
    """After extractions (session_key, ok, taken): counters move on and a run over scenes gets due,
    or, of failed ones, the buffer stays and up to ``RETRIES`` new tries follow.

    While the process is closing no new deadline is set, but for retries."""
    result = done.groupBy("session_key").agg(F.min("ok").alias("_ok"), F.sum("taken").alias("_taken"))
    rows = states.join(result, "session_key", "left")
    good, bad = F.coalesce(F.col("_ok"), F.lit(False)), F.coalesce(~F.col("_ok"), F.lit(False))
    tries = F.col("l1_retries") + 1
    desired = _advanced(now, times)
    earlier = good & F.lit(not closing) & (F.col("l2_due").isNull() | (desired < F.col("l2_due")))
    step = F.col("warmup_threshold") * 2
    return _with(
        rows,
        l2_pending_l1_count=F.when(good, F.col("conversation_count")).otherwise(F.col("l2_pending_l1_count")), conversation_count=F.when(good, 0).otherwise(F.col("conversation_count")),
        buffered=F.when(good, F.greatest(F.lit(0), F.col("buffered") - F.coalesce("_taken", F.col("buffered")))).otherwise(F.col("buffered")),
        warmup_threshold=F.when(good & F.lit(times.warmup) & (F.col("warmup_threshold") > 0), F.when(step >= times.every, 0).otherwise(step)).otherwise(F.col("warmup_threshold")),
        l1_due=F.when(good, F.lit(None)).when(bad, F.when(tries <= RETRIES, F.lit(now + RETRY_MS))).otherwise(F.col("l1_due")), l1_retries=F.when(good, 0).when(bad, tries).otherwise(F.col("l1_retries")),
        l2_due=F.when(earlier, desired).otherwise(F.col("l2_due")), l2_source=F.when(earlier, "delay").otherwise(F.col("l2_source")),
    )


def due_scenes(states: DataFrame, now: int, times: Times = Times(), closing: bool = False) -> tuple[DataFrame, DataFrame]:
    """(sessions to run over scenes now with their cursor, states without those deadlines).

    A deadline of the longest interval is dropped where the session is cold.  A closing process
    runs all that have a deadline."""
    over = F.col("l2_due").isNotNull() if closing else F.coalesce(F.col("l2_due") <= now, F.lit(False))
    cold = F.lit(False) if closing else (F.col("l2_source") == "max") & (now - F.col("last_active") >= times.active)
    run = states.where(over & ~cold).select("session_key", F.col("l2_cursor").alias("cursor"))
    return run, _with(states, l2_due=F.when(~over, F.col("l2_due")), l2_source=F.when(~over, F.col("l2_source")))


def scenes_done(states: DataFrame, done: DataFrame, now: int, now_iso: str, times: Times = Times()) -> tuple[DataFrame, DataFrame]:
    """(states after runs over scenes (session_key, ok, skipped, cursor), sessions that count as run).

    The longest interval begins anew for all of them; a failed run, or a first one that found
    nothing to do, changes nothing else.  A cursor that a run does not tell stays, or is the time."""
    result = done.groupBy("session_key").agg(F.struct(F.min("ok").alias("ok"), F.max("skipped").alias("skipped"), F.max("cursor").alias("cursor")).alias("_r"))
    rows = states.join(result, "session_key", "left").withColumn("_ran", F.col("_r").isNotNull())
    counts = F.col("_ran") & F.coalesce(F.col("_r.ok"), F.lit(False)) & ~(F.coalesce(F.col("_r.skipped"), F.lit(False)) & F.col("l2_last_run").isNull())
    rows = rows.withColumn("_counts", counts)
    cursor = F.coalesce("_r.cursor", F.when(F.coalesce("l2_cursor", F.lit("")) != "", F.col("l2_cursor")), F.lit(now_iso))
    after = _with(
        rows, l2_due=F.when(F.col("_ran"), F.lit(now + times.most)).otherwise(F.col("l2_due")), l2_source=F.when(F.col("_ran"), "max").otherwise(F.col("l2_source")),
        l2_pending_l1_count=F.when(F.col("_counts"), 0).otherwise(F.col("l2_pending_l1_count")), l2_last_run=F.when(F.col("_counts"), F.lit(now)).otherwise(F.col("l2_last_run")),
        l2_cursor=F.when(F.col("_counts"), cursor).otherwise(F.col("l2_cursor")),
    )
    return after, rows.where("_counts").select("session_key")


def restored(states: DataFrame, now: int, times: Times = Times()) -> DataFrame:
    """Saved states at a start: work that was pending becomes a delayed run over scenes; buffers and
    deadlines were of the old process."""
    pending = (F.col("conversation_count") != 0) | (F.col("l2_pending_l1_count") != 0)
    fresh = _with(states, l1_due=None, l1_retries=0, l2_due=None, l2_source=None, buffered=0)
    return _with(
        fresh, l2_pending_l1_count=F.when(pending, F.greatest("l2_pending_l1_count", "conversation_count")).otherwise(F.col("l2_pending_l1_count")), l2_due=F.when(pending, _advanced(now, times)),
        l2_source=F.when(pending, "delay"), conversation_count=0,
    )


def without_stale(states: DataFrame, now: int, times: Times = Times()) -> DataFrame:
    """States but for those of sessions idle for three windows with nothing buffered."""
    return states.where((now - F.col("last_active") < STALE_WINDOWS * times.active) | (F.col("buffered") > 0))


def next_deadline(states: DataFrame) -> int | None:
    return states.agg(F.min(F.least("l1_due", "l2_due"))).first()[0]


class Coalesced:
    """Runs an action at once; requests while it runs are one more run."""

    def __init__(self, action: Callable[[], None]):
        self.action, self.running, self.again, self.closed = action, False, False, False

    def request(self) -> None:
        if self.closed:
            return
        if self.running:
            self.again = True
            return
        while True:
            self.running, self.again = True, False
            try:
                self.action()
            except Exception:  # a failed run is not repeated by itself
                pass
            self.running = False
            if not self.again or self.closed:
                return


class Scheduler:
    """States in a store, and the runs that are due, made by given functions.

    ``load`` and ``save`` read and write the table of states (a saved table replaces the last);
    ``extract`` takes the due sessions and returns (session_key, ok, taken); ``scenes`` takes them
    with their cursors and returns (session_key, ok, skipped, cursor); ``persona`` is a single run.
    A session that ``extract`` does not return, or for which it raises, is a failed try.  Sessions that
    :func:`skip_session` takes out, by ``skip`` too, never get a state.
    """

    def __init__(self, load: Callable[[], DataFrame], save: Callable[[DataFrame], None], extract: Callable[[DataFrame], DataFrame], scenes: Callable[[DataFrame], DataFrame], persona: Callable[[], None], clock: Callable[[], int], times: Times = Times(), gc_every: int = 50, skip: tuple[str, ...] = ()):
        self.load, self.save, self.extract, self.scenes, self.clock, self.times = load, save, extract, scenes, clock, times
        self.persona, self.closed, self.below, self.gc_every, self.skip = Coalesced(persona), False, 0, gc_every, skip

    def _wanted(self, rows: DataFrame) -> DataFrame:
        return rows.where(~tx.skip_session(F.col("session_key"), self.skip))

    def start(self) -> None:
        self.save(restored(self._wanted(self.load()), self.clock(), self.times))

    def notify(self, arrived: DataFrame) -> None:
        """Take note of new conversations; what that makes due waits for :meth:`run_due`."""
        if self.closed:
            return
        now, arrived = self.clock(), self._wanted(arrived)
        self.save(notified(self.load(), arrived, now, self.times))
        waits = self.load().where(F.col("l1_due") > now).select("session_key")
        self.below += arrived.join(waits, "session_key", "left_semi").count()  # those that reach their threshold do not count
        if self.below >= self.gc_every:
            self.below = 0
            self.save(without_stale(self.load(), now, self.times))

    def run_due(self) -> None:
        """Everything that is due, and what that makes due: extractions before scenes."""
        while not self.closed and (self._extract() or self._scenes()):
            pass

    def _extract(self, closing: bool = False, sessions: DataFrame | None = None) -> bool:
        now = self.clock()
        due = due_extractions(self.load(), now)
        if sessions is not None:
            due = due.join(sessions.select("session_key").distinct(), "session_key", "left_semi")
        if due.isEmpty():
            return False
        failed = due.select("session_key", F.lit(False).alias("ok"), F.lit(0).cast("long").alias("taken"))
        try:
            done = self.extract(due).select("session_key", "ok", F.col("taken").cast("long").alias("taken")).persist()
            done.count()
        except Exception:  # whatever the extraction raises is a failed try of all
            done = failed
        else:
            done = done.unionByName(failed.join(done, "session_key", "left_anti"))
        self.save(extracted(self.load(), done, now, self.times, closing))
        return True

    def _scenes(self, closing: bool = False) -> bool:
        now = self.clock()
        states = self.load()
        run, rest = due_scenes(states, now, self.times, closing)
        dropped = states.where(F.col("l2_due") <= now).isEmpty()
        if run.isEmpty():
            if not dropped:
                self.save(rest)
            return False
        iso = run.sparkSession.range(1).select(F.date_format(F.timestamp_millis(F.lit(now)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).first()[0]
        after, counted = scenes_done(rest, self.scenes(run), now, iso, self.times)
        again = not counted.isEmpty()
        self.save(after)
        if again and not closing:
            self.persona.request()
        return True

    def flush(self, sessions: DataFrame) -> None:
        """The end of some sessions: their extraction now, and no other's."""
        if not self.closed:
            sessions = self._wanted(sessions)
            self.save(flushed(self.load(), self.clock(), sessions))
            self._extract(sessions=sessions)

    def shutdown(self) -> None:
        """The end of the process: extractions of all that hold work, then the scheduled runs over
        scenes, and no persona."""
        if self.closed:
            return
        self.closed = self.persona.closed = True
        self.save(flushed(self.load(), self.clock()))
        self._extract(closing=True)
        self._scenes(closing=True)
