"""When a session's work is due: batch replays of count, idle and interval triggers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVERY = 5
IDLE_S, DELAY_S, MIN_INTERVAL_S, MAX_INTERVAL_S, ACTIVE_S = 600, 10, 900, 3600, 24 * 3600


def warmup_positions(every: int = EVERY) -> list[int]:
    """Counts since the start at which the doubling warm-up fires, up to the steady step."""
    out, at, step = [], 0, 1
    while step < every:
        at += step
        out.append(at)
        step *= 2
    return out


def count_trigger(events: DataFrame, session: str, order: str, every: int = EVERY) -> DataFrame:
    """With ``n`` and ``fires``: after 1, 2, 4, … conversations, then after every ``every``."""
    early = warmup_positions(every)
    last = early[-1] if early else 0
    n = F.row_number().over(Window.partitionBy(session).orderBy(order))
    fires = F.col("n").isin(early) if early else F.lit(False)
    return events.withColumn("n", n).withColumn("fires", fires | ((F.col("n") > last) & ((F.col("n") - last) % every == 0)))


def idle_sessions(events: DataFrame, session: str, ts: str, idle_s: int = IDLE_S) -> DataFrame:
    """(session, start, end, n): runs of events with no gap of ``idle_s`` seconds or more."""
    w = Window.partitionBy(session).orderBy(ts)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = at - F.lag(at).over(w) >= idle_s * 1_000_000
    runs = events.withColumn("_run", F.sum(F.when(gap, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(session, "_run").agg(F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count(F.lit(1)).alias("n")).drop("_run")


def advance_timer(current: Column, now: Column, last: Column, delay: int = DELAY_S, least: int = MIN_INTERVAL_S) -> Column:
    """A downstream deadline, in seconds: it only moves earlier, and keeps the interval's floor."""
    due = F.greatest(now + delay, F.coalesce(last + least, now + delay))
    return F.least(F.coalesce(current, due), due)


def due_after_max(states: DataFrame, now: Column, most: int = MAX_INTERVAL_S, active: int = ACTIVE_S) -> DataFrame:
    """Sessions whose longest interval is over and that were active within the window."""
    return states.where((now - F.col("last_run") >= most) & (now - F.col("last_active") < active))


def stale(states: DataFrame, now: Column, active: int = ACTIVE_S) -> DataFrame:
    """Sessions to forget: idle for three windows, with nothing queued or buffered."""
    return states.where((now - F.col("last_active") >= 3 * active) & (F.col("queued") == 0) & (F.col("buffered") == 0))


def persona_due(cp: DataFrame, every: int = 50) -> DataFrame:
    """With ``reason``: the first of five conditions of a checkpoint that asks for a persona, or null."""
    reason = (
        F.when(F.col("request_persona_update"), "requested")
        .when((F.col("scenes_processed") > 0) & (F.col("last_persona_at") == 0) & F.col("has_scenes"), "cold start")
        .when((F.col("last_persona_at") > 0) & F.col("has_scenes") & ~F.col("has_body"), "body lost")
        .when((F.col("scenes_processed") == 1) & (F.col("memories_since_last_persona") > 0), "first scene")
        .when(F.col("memories_since_last_persona") >= every, "threshold")
    )
    return cp.withColumn("reason", reason)


def diagram_due(entries: DataFrame, now: Column, last_run: Column, least: int = 4, timeout_s: int = 300) -> DataFrame:
    """(session, due): enough entries without a node, or new ones for longer than the timeout."""
    open_ = F.col("node_id").isNull()
    got = entries.groupBy("session_key").agg(F.count_if(open_).alias("n"), F.min(F.when(open_, F.col("ts"))).alias("oldest"), F.max(F.when(open_, F.col("ts"))).alias("newest"))
    waited = (now - F.coalesce(last_run, F.col("oldest")) >= timeout_s) & (F.col("n") > 0) & (last_run.isNull() | (F.col("newest") > last_run))
    return got.withColumn("due", (F.col("n") >= least) | waited)


def scene_advice(n: Column, most: int = 15) -> Column:
    return F.when(n >= most, "merge now").when(n == most - 1, "last free").when(n >= most - 3, "nearly full")
