"""State tables against a plain scheduler of single sessions."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import schedule as S

T = S.Times(every=4, idle=100, delay=10, least=50, most=300, active=500)


class Plain:
    """One session's counters and deadlines, changed step by step."""

    def __init__(self, now):
        self.count = self.buffer = self.pending = self.tries = 0
        self.warm, self.active, self.l1, self.l2, self.source, self.last, self.cursor = 1, now, None, None, None, None, None

    def notify(self, n, m, now):
        self.count, self.buffer, self.active, self.tries = self.count + n, self.buffer + m, now, 0
        limit = min(self.warm, T.every) if self.warm > 0 else T.every
        self.l1 = now if self.count >= limit else now + T.idle

    def after_l1(self, ok, now):
        if ok:
            self.pending, self.count, self.buffer, self.tries, self.l1 = self.count, 0, 0, 0, None
            if self.warm:
                self.warm = 0 if self.warm * 2 >= T.every else self.warm * 2
            at = max(now + T.delay, (self.last + T.least) if self.last is not None else 0)
            if self.l2 is None or at < self.l2:
                self.l2, self.source = at, "delay"
        else:
            self.tries += 1
            self.l1 = now + S.RETRY_MS if self.tries <= S.RETRIES else None

    def after_l2(self, ok, skipped, cursor, now, iso):
        first = self.last is None
        self.l2, self.source = now + T.most, "max"
        if not ok or (first and skipped):
            return False
        self.pending, self.last = 0, now
        self.cursor = cursor if cursor is not None else self.cursor or iso
        return True

    def row(self, key):
        return (key, self.count, self.buffer, self.active, self.warm, self.pending, self.l1, self.tries, self.l2, self.source, self.last, self.cursor)


def test_states_follow_the_plain_scheduler(spark):
    rng = random.Random(2)
    plain, states, now = {}, spark.createDataFrame([], S.STATES), 1000
    local = lambda df: spark.createDataFrame(df.collect(), S.STATES)
    for _ in range(12):
        now += rng.choice([5, 20, 120, 400, 31_000])
        came = [(k, rng.randrange(1, 3), rng.randrange(1, 4)) for k in rng.sample("abcdef", rng.randrange(0, 5))]
        for k, n, m in came:
            plain.setdefault(k, Plain(now)).notify(n, m, now)
        states = local(S.notified(states, spark.createDataFrame(came, "session_key string, conversations long, messages long"), now, T))
        due = {r[0] for r in S.due_extractions(states, now).collect()}
        assert due == {k for k, p in plain.items() if p.l1 is not None and p.l1 <= now and (p.count or p.buffer)}
        done = [(k, rng.random() < 0.6, plain[k].buffer) for k in due]
        for k, ok, _ in done:
            plain[k].after_l1(ok, now)
        states = local(S.extracted(states, spark.createDataFrame(done, "session_key string, ok boolean, taken long"), now, T))
        run, rest = S.due_scenes(states, now, T)
        over = {k for k, p in plain.items() if p.l2 is not None and p.l2 <= now}
        want = {k for k in over if not (plain[k].source == "max" and now - plain[k].active >= T.active)}
        assert {(r.session_key, r.cursor) for r in run.collect()} == {(k, plain[k].cursor) for k in want}
        for k in over:
            plain[k].l2 = plain[k].source = None
        done = [(k, rng.random() < 0.8, rng.random() < 0.3, rng.choice([None, f"c{now}"])) for k in want]
        counted = {k for k, ok, skipped, cursor in done if plain[k].after_l2(ok, skipped, cursor, now, f"t{now}")}
        after, ran = S.scenes_done(local(rest), spark.createDataFrame(done, "session_key string, ok boolean, skipped boolean, cursor string"), now, f"t{now}", T)
        assert {r[0] for r in ran.collect()} == counted
        states = local(after)
        assert sorted(map(tuple, states.collect())) == sorted(p.row(k) for k, p in plain.items())
        ends = [x for p in plain.values() for x in (p.l1, p.l2) if x is not None]
        assert S.next_deadline(states) == (min(ends) if ends else None)


def test_restart_and_stale_sessions(spark):
    rows = [("a", 3, 2, 10, 0, 1, 99, 2, None, None, None, None), ("b", 0, 0, 10, 2, 5, None, 0, 77, "max", 980, "c"), ("c", 0, 0, 900, 1, 0, None, 0, None, None, None, None)]
    got = {r.session_key: r for r in S.restored(spark.createDataFrame(rows, S.STATES), 1000, T).collect()}
    assert (got["a"].l2_pending_l1_count, got["a"].conversation_count, got["a"].l2_due, got["a"].l1_due) == (3, 0, 1010, None)
    assert (got["b"].l2_due, got["b"].l2_source, got["b"].l2_pending_l1_count) == (1030, "delay", 5)
    assert got["c"].l2_due is None
    kept = S.without_stale(spark.createDataFrame(rows, S.STATES), 1510, T)
    assert {r.session_key for r in kept.collect()} == {"a", "c"}


def test_runs_flush_and_shutdown(spark):
    held, log, now = [spark.createDataFrame([], S.STATES)], [], [1000]
    fail = [True]

    def extract(due):
        keys = sorted(r[0] for r in due.collect())
        log.append(("l1", keys))
        return spark.createDataFrame([(k, not fail[0], 1) for k in keys], "session_key string, ok boolean, taken long")

    def scenes(due):
        keys = sorted(r[0] for r in due.collect())
        log.append(("l2", keys))
        return spark.createDataFrame([(k, True, False, None) for k in keys], "session_key string, ok boolean, skipped boolean, cursor string")

    save = lambda df: held.__setitem__(0, spark.createDataFrame(df.collect(), S.STATES))
    s = S.Scheduler(lambda: held[0], save, extract, scenes, lambda: log.append(("l3", [])), lambda: now[0], T)
    came = lambda *keys: spark.createDataFrame([(k, 1, 1) for k in keys], "session_key string, conversations long, messages long")
    s.notify(came("a", "b"))
    s.run_due()
    assert log == [("l1", ["a", "b"])] and {r.l1_due for r in held[0].collect()} == {1000 + S.RETRY_MS}
    fail[0] = False
    now[0] += S.RETRY_MS
    s.run_due()
    now[0] += T.delay
    s.run_due()
    assert log[1:] == [("l1", ["a", "b"]), ("l2", ["a", "b"]), ("l3", [])]
    s.notify(came("a", "c"))
    s.flush(came("a"))
    s.shutdown()
    s.notify(came("z"))
    s.run_due()
    assert log[4:6] == [("l1", ["a"]), ("l1", ["c"])] and log[6][0] == "l2"
    assert ("l3", []) not in log[4:] and "z" not in {r.session_key for r in held[0].collect()}


def test_absent_and_raising_extractions_are_failed_tries(spark):
    held, log, now = [spark.createDataFrame([], S.STATES)], [], [1000]

    def save(df):
        held[0] = spark.createDataFrame(df.collect(), S.STATES)

    def extract(due):
        keys = sorted(r[0] for r in due.collect())
        log.append(keys)
        if "bad" in keys and len(log) > 1:
            raise OSError("no service")
        return due.where("session_key <> 'bad'").selectExpr("session_key", "true as ok", "1 as taken")

    came = lambda *keys: spark.createDataFrame([(k, 1, 1) for k in keys], "session_key string, conversations long, messages long")
    s = S.Scheduler(lambda: held[0], save, extract, lambda run: run.selectExpr("session_key", "true as ok", "false as skipped", "cursor"), lambda: None, lambda: now[0], T, gc_every=3, skip=("noise-*",))
    s.notify(came("good", "bad", "temp:x", "noise-1"))
    assert {r.session_key for r in held[0].collect()} == {"good", "bad"}
    s.run_due()  # ends, though nothing comes back for one session
    states = {r.session_key: r for r in held[0].collect()}
    assert log == [["bad", "good"]] and (states["bad"].l1_retries, states["bad"].l1_due) == (1, 1000 + S.RETRY_MS) and states["good"].l1_due is None
    for k in range(S.RETRIES + 2):
        now[0] += S.RETRY_MS
        s.run_due()
    assert log[1:] == [["bad"]] * S.RETRIES and {r.session_key: r.l1_due for r in held[0].collect()}["bad"] is None
    s.notify(came("new"))  # at its threshold: does not count towards the clean-up
    assert s.below == 0
    s.notify(came("good"))
    assert s.below == 1
    s.flush(came("good"))
    assert log[-1] == ["good"]


def test_requests_while_running_are_one_more_run():
    runs = []

    def action():
        runs.append(1)
        if len(runs) < 2:
            c.request()
            c.request()

    c = S.Coalesced(action)
    c.request()
    assert len(runs) == 2
    c = S.Coalesced(lambda: (_ for _ in ()).throw(ValueError()))
    c.request()
    assert not c.running


@pytest.mark.parametrize("n", [0, 3])
def test_empty_tables(spark, n):
    states = spark.createDataFrame([], S.STATES)
    none = spark.createDataFrame([], "session_key string, conversations long, messages long")
    assert S.notified(states, none, n, T).count() == 0 and S.next_deadline(states) is None
    assert S.flushed(states, n).where(F.lit(True)).count() == 0
