"""The stream of sessions against a plain loop over events and deadlines, and the closed loop."""

import random
import time

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import schedule as S
from palimpsest.streaming import sessions

T = S.Times(every=4, idle=100_000, delay=10_000, least=50_000, most=300_000, active=500_000)
WAIT = 40_000


@pytest.fixture
def rocks(spark):
    pytest.importorskip("google.protobuf", reason="stateful Python streams need protobuf")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def plain(rows, end):
    """Firings of one session until ``end``, a millisecond-stepped list of what happens next."""
    rows = sorted({r[1]: r for r in reversed(rows)}.values(), key=lambda r: r[1])
    st, out, run = None, [], 0
    while True:
        todo = [(rows[0][1], -1, "row")] if rows else []
        if st:
            if st["flying1"] is not None:
                todo.append((st["flying1"], 0, "lost1"))
            elif st["l1"] is not None:
                todo.append((st["l1"], 1, "facts"))
            if st["flying2"] is not None:
                todo.append((st["flying2"], 2, "lost2"))
            elif st["l2"] is not None:
                todo.append((st["l2"], 3, "scenes"))
            if st["flying1"] is None and st["flying2"] is None and not st["buf"]:
                todo.append((st["active"] + 3 * T.active, 4, "stale"))
        if not todo or min(todo)[0] > end:
            return out
        at, _, what = min(todo)
        if what == "row":
            _, _, n, m = rows.pop(0)
            st = st or {"n": 0, "buf": 0, "warm": 1, "tries": 0, "l1": None, "l2": None, "src": None, "last": None, "flying1": None, "flying2": None}
            st["n"] += n
            st["buf"] += m
            st["active"], st["tries"] = at, 0
            st["l1"] = at if st["n"] >= (min(st["warm"], T.every) or T.every) else at + T.idle
        elif what == "facts":
            run += 1
            st["l1"], st["flying1"] = None, at + WAIT
            out.append((what, run, at, st["n"], st["buf"]))
        elif what == "lost1":
            st["flying1"], st["tries"] = None, st["tries"] + 1
            st["l1"] = at + S.RETRY_MS if st["tries"] <= S.RETRIES else None
        elif what == "stale":
            st, run = None, 0
        else:
            raise AssertionError(what)  # no extraction succeeds here, so no scenes are due


def event(spark, rows):
    df = spark.createDataFrame(rows, "session_key string, ms long, conversations long, messages long")
    return df.select("session_key", F.lit("arrived").alias("kind"), F.timestamp_millis("ms").alias("at"), "conversations", "messages", *(F.lit(None).cast(t).alias(c) for c, t in [("run", "long"), ("ok", "boolean"), ("taken", "long"), ("skipped", "boolean"), ("cursor", "string")]))


def run(spark, tmp, files, name, **more):
    """Firings of events in files, one file a batch."""
    for k, rows in enumerate(files):
        (rows if hasattr(rows, "columns") else event(spark, rows)).coalesce(1).write.mode("append").parquet(f"file://{tmp}/{name}/f{k:03d}")
    stream = spark.readStream.schema(sessions.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp}/{name}/f*")
    out = sessions.firings(stream, T, "EventTime", "200 seconds", wait=WAIT, **more)
    q = out.writeStream.format("memory").queryName(name).option("checkpointLocation", f"file://{tmp}/{name}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_firings_of_late_and_replayed_rows_are_those_of_a_plain_loop(rocks, tmp_path):
    rng, now, rows = random.Random(5), 1_000_000, []
    for _ in range(60):
        now += rng.choice([1_000, 7_000, 30_000, 90_000])
        rows += [(k, now, rng.randrange(1, 3), rng.randrange(0, 3)) for k in rng.sample("abc", rng.randrange(1, 3))]
    rows += [("temp:x", now, 1, 1), (None, now, 1, 1)]
    late = sorted(rows, key=lambda r: r[1] + rng.randrange(60_000))  # out of order by less than the watermark waits
    third = len(late) // 3
    parts = [late[:third], late[third : 2 * third], late[third : 2 * third], late[2 * third :], late[2 * third :]]  # two come twice
    end = [("z", now + 9_000_000, 1, 1)], [("z", now + 9_000_001, 1, 1)]
    got = run(rocks, tmp_path, [*parts, *end], "replayed")
    assert {r.session_key for r in got} <= {"a", "b", "c", "z"}
    for k in "abc":
        mine = sorted([(r.action, r.run, r.at, r.conversations, r.buffered) for r in got if r.session_key == k], key=lambda r: r[2])
        want = plain([r for r in rows if r[0] == k], now + 8_000_000)
        assert len(want) > 5 and mine == want


def test_answers_scenes_and_saved_states(rocks, tmp_path):
    t = 1_000_000
    answer = lambda key, ms, kind, n, ok=True, skipped=False, cursor=None: event(rocks, [(key, ms, None, None)]).withColumns({"kind": F.lit(kind), "run": F.lit(n).cast("long"), "ok": F.lit(ok), "taken": F.lit(1).cast("long"), "skipped": F.lit(skipped), "cursor": F.lit(cursor).cast("string")})
    first = event(rocks, [("a", t, 1, 1)])
    facts = answer("a", t + 5_000, "facts", 1).unionByName(answer("a", t + 5_000, "facts", 9))  # one of a run that never was
    scenes = answer("a", t + 20_000, "scenes", 2, cursor="c1").unionByName(answer("a", t + 21_000, "scenes", 2, cursor="again"))
    end = [("z", t + 400_000, 1, 1)], [("z", t + 700_000, 1, 1)]
    saved = rocks.createDataFrame([("old", 2, 5, 900_000, 0, 1, 3, 2, None, None, None, None), ("idle", 0, 0, 900_000, 0, 0, None, 0, None, None, None, "c0")], S.STATES)
    got = run(rocks, tmp_path, [first, facts, scenes, *end], "answered", saved=saved)
    mine = sorted((r.at, r.action, r.run, r.cursor) for r in got if r.session_key == "a")
    assert mine == [(t, "facts", 1, None), (t + 15_000, "scenes", 2, None), (t + 20_000, "persona", 2, "c1"), (t + 320_000, "scenes", 3, "c1")]
    assert [(r.action, r.run) for r in got if r.session_key == "old"][:1] == [("scenes", 1)]  # what was pending is a run over scenes
    assert not [r for r in got if r.session_key == "idle"]


def test_what_fires_is_run_and_answered_by_the_clock(rocks, tmp_path):
    path, log = f"file://{tmp_path}/answers", []
    event(rocks, [("good", 1, 1, 1), ("lost", 1, 1, 1)]).coalesce(1).write.parquet(f"{path}/batch=in")
    stream = rocks.readStream.schema(sessions.EVENTS).parquet(f"{path}/batch=*")
    note = lambda kind, df: log.extend((kind, r.session_key) for r in df.collect())

    def extract(due):
        note("facts", due)
        return due.where("session_key = 'good'").selectExpr("session_key", "true as ok", "1L as taken")

    def scenes(due):
        note("scenes", due)
        return due.selectExpr("session_key", "true as ok", "false as skipped", "'c' as cursor")

    act = sessions.acting(extract, scenes, lambda: log.append(("persona", None)), path)
    times = S.Times(every=4, idle=100, delay=10, least=50, most=10**8, active=10**8)
    q = sessions.firings(stream, times).writeStream.foreachBatch(act).option("checkpointLocation", f"file://{tmp_path}/state").trigger(processingTime="1 second").start()
    until = time.time() + 90
    while ("persona", None) not in log and time.time() < until and q.isActive:
        time.sleep(0.5)
    q.stop()
    assert sorted(x for x in log if x[0] == "facts")[:2] == [("facts", "good"), ("facts", "lost")]
    assert log.count(("facts", "good")) == 1 and [x for x in log if x[0] == "scenes"] == [("scenes", "good")] and log.count(("persona", None)) == 1
    kept = rocks.read.schema(sessions.EVENTS).parquet(f"{path}/batch=*").where("kind = 'facts'")
    assert {(r.session_key, r.ok) for r in kept.collect()} >= {("good", True), ("lost", False)}
