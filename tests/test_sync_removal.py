"""Profiles of three sides in all combinations, and files that go in two phases."""

from itertools import product

import pytest

from palimpsest.operators import store
from palimpsest.sources import removal
from palimpsest.sources.versions import Versions

SIDES = "id string, content_md5 string, version long"


def test_all_combinations_of_three_sides(spark):
    cases = {"".join(x or "-" for x in c): c for c in product((None, "A", "B", "C"), repeat=3)}  # absent or one of three texts
    table = lambda k, v: spark.createDataFrame([(name, c[k], v) for name, c in cases.items() if c[k]], SIDES)
    plan = store.reconcile(table(0, 3), table(1, 0), table(2, 5))
    got = {r.id: r.action for r in plan.collect()}

    def expected(base, own, other):
        if own == other:
            return "none"
        if own == base:
            return "pull" if other else "remove"
        if other == base:
            return "push" if own else "delete"
        return "conflict"

    assert got == {name: expected(*c) for name, c in cases.items() if any(c)}
    after = {r.id: (r.content_md5, r.version) for r in store.after_sync(plan).collect()}
    for name, (base, own, other) in cases.items():
        what = got.get(name)
        want = {"none": other and (other, 5), "pull": (other, 5), "push": (own, 6 if other else 4 if base else 1), "conflict": base and (base, 3)}.get(what)
        assert after.get(name) == want, name
    none = store.after_sync(plan, plan.where("false"))  # nothing was done: only what both sides share moves on
    held = {r.id: r.content_md5 for r in none.collect()}
    assert all(held.get(name) == (c[2] if got.get(name) == "none" else c[0]) for name, c in cases.items())
    empty = spark.createDataFrame([], SIDES)
    assert store.reconcile(empty, empty, empty).count() == 0
    assert store.reconcile(spark.createDataFrame([(None, "A", 1)], SIDES), empty, empty).count() == 0


def test_a_run_that_ends_in_the_middle_is_finished_by_the_next(spark, tmp_path, monkeypatch):
    files = [tmp_path / f"f {k}.jsonl" for k in range(8)]
    for f in files:
        f.write_text("x")
    uri = lambda f: f.as_uri()
    waste = spark.createDataFrame([(uri(f), "entries") for f in files[:5]] + [(uri(files[0]), "entries"), (None, "entries")], "path string, kind string")
    work = f"file://{tmp_path}/work"
    commit, calls = Versions.commit, []

    def dies(self, after, state):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("killed after the files went")
        return commit(self, after, state)

    monkeypatch.setattr(Versions, "commit", dies)
    with pytest.raises(OSError):
        removal.remove(waste, work, 2)
    monkeypatch.setattr(Versions, "commit", commit)
    assert [f.exists() for f in files] == [False] * 5 + [True] * 3
    files[4].write_text("named again")
    later = spark.createDataFrame([(uri(f), "entries") for f in files[:4]] + [(uri(files[5]), "reference"), (f"file://{tmp_path}/none", "reference"), ("nowhere://x/y", "diagram")], "path string, kind string")
    got = {r.path: r.outcome.split(":")[0] for r in removal.remove(later, work, 2).collect()}
    assert got[uri(files[4])] == "kept" and files[4].exists()
    assert [got[uri(f)] for f in files[:4]] == ["absent"] * 4 and got[uri(files[5])] == "removed"
    assert got[f"file://{tmp_path}/none"] == "absent" and got["nowhere://x/y"] == "failed" and len(got) == 8
    report = removal.remove(waste.where("false"), work, 2)
    assert report.count() == 0 and files[6].exists()
    last = spark.createDataFrame([(uri(files[6]), "entries")], "path string, kind string")
    assert {tuple(r) for r in removal.counts(removal.remove(last, work)).collect()} == {("entries", 1, 0, 0)}


def test_when_a_pass_is_due():
    assert removal.next_run(1000, None, 2) is None
    assert removal.next_run(1000, None, 3) == 301_000 and removal.next_run(1000, 5000, 3) == 5000 + 86_400_000
