"""Captures that are killed, run again or come second, and searches by the maintained index."""

import pytest

from palimpsest import schemas
from palimpsest.operators import search
from palimpsest.plans.memory import Memory
from palimpsest.sources.versions import Conflict, Versions


def rows(spark, *ids, at=0):
    return spark.createDataFrame([(str(k), f"s{k % 2}", f"s{k % 2}", "user", f"message number w{k} of all", "t", at + k) for k in ids], schemas.L0)


def state(m):
    return sorted(map(tuple, m.l0.collect())), sorted(map(tuple, m.cursors().collect()))


def test_a_batch_that_is_killed_or_run_again_counts_once(spark, tmp_path, monkeypatch):
    once, killed = (Memory(spark, f"file://{tmp_path}/{x}") for x in "ab")
    batches = [rows(spark, 1, 2), rows(spark, 3, 4), rows(spark, 5)]
    for k, b in enumerate(batches):
        once.sink("in")(b, k)
    write, commit = killed.sink("in"), Versions.commit

    def dies(self, after, new):
        raise OSError("killed between data and version")

    for k, b in enumerate(batches):
        monkeypatch.setattr(Versions, "commit", dies)
        with pytest.raises(OSError):
            write(b, k)
        monkeypatch.setattr(Versions, "commit", commit)
        before = state(killed)
        write(b, k)
        assert state(killed) != before
        write(b, k)
        write(rows(spark, 90 + k, at=1000), k)  # other rows by the number of a batch that was taken
    assert state(killed) == state(once) and len(state(once)[0]) == 5


def test_a_second_writer_tries_again_and_loses_nothing(spark, tmp_path, monkeypatch):
    a, b = (Memory(spark, f"file://{tmp_path}/m") for _ in range(2))
    a.capture(rows(spark, 1, 2))
    commit, calls, others = Versions.commit, [], [3, 5]

    def slow(self, after, new):
        if not calls:
            calls.append(after)
            b.capture(rows(spark, others.pop(0)))  # comes between what the first read and what it writes
        return commit(self, after, new)

    monkeypatch.setattr(Versions, "commit", slow)
    assert a.capture(rows(spark, 4)) == 1
    assert [r[0] for r in state(a)[0]] == ["1", "2", "3", "4"] and dict(state(b)[1]) == {"s0": 4, "s1": 3}
    calls.clear()
    with pytest.raises(Conflict):
        a.forget("l0", rows(spark, 1).select("record_id"))  # of an older version: refused
    monkeypatch.setattr(Versions, "commit", commit)
    a.forget("l0", rows(spark, 1).select("record_id"))
    assert [r[0] for r in state(a)[0]] == ["2", "3", "4", "5"]


def test_searches_by_the_index_follow_the_layer(spark, tmp_path):
    m = Memory(spark, f"file://{tmp_path}/m")
    m.capture(rows(spark, *range(1, 6)))
    asked = "w3 w7 message"

    def same():
        got = [(r.record_id, round(r.score, 9)) for r in m.search_conversations(asked, 3).collect()]
        assert got == [(r.record_id, round(r.score, 9)) for r in search.search_conversations(m.l0, asked, 3).collect()] and got
        return m._indexed("l0")._state()

    m.index("l0")
    first = same()
    m.capture(rows(spark, 7, 8))
    second = same()
    assert second["n"] == 7 and len(second["segments"]) == len(first["segments"]) + 1  # only the new part was read
    m.forget("l0", rows(spark, 3).select("record_id"))
    third = same()
    assert third["n"] == 6 and third["segments"] == second["segments"]  # nothing but the dead was written
    assert same() == third
