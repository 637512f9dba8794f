"""Decisions on new facts: one set against a loop in order, and extraction that applies them."""

import json
import random

import pytest

from palimpsest import schemas
from palimpsest.operators import extract, resolve, search
from palimpsest.plans.memory import Config, Memory

FACTS = "record_id string, content string, type string, priority double, scene_name string, session_key string, session_id string, timestamps array<string>, created_time string, updated_time string, metadata_json string, pos long"
DECISIONS = "record_id string, pos long, action string, target_ids array<string>, merged_content string, merged_type string, merged_priority double, merged_timestamps array<string>"
NAMES = [c.split()[0] for c in schemas.L1.split(", ")]


def fact(i, content, pos, times=(), created="new", session="s2"):
    return (i, content, "episodic", 50.0, "w", session, session, list(times), created, created, "{}", pos)


def known(i, content):
    return (i, content, "persona", 1.0, "w", "s1", "s1", "t", "t", "t", "old", "old", "{}")


def in_order(l1, facts, decisions):
    """The loop: a dictionary of rows, one decision after another."""
    rows = {r[0]: dict(zip(NAMES, r, strict=True)) for r in l1}
    last = {d[0]: d for d in sorted(decisions, key=lambda d: d[1])}
    for f in sorted(facts, key=lambda f: f[-1]):
        names = [c.split()[0] for c in FACTS.split(", ")]
        row, d = dict(zip(names, f, strict=True)), last.get(f[0])
        action = d[2] if d else "store"
        if action == "skip":
            continue
        if action in ("update", "merge"):
            for name, value in zip(("content", "type", "priority", "timestamps"), d[4:], strict=True):
                row[name] = row[name] if value is None else value
            for t in d[3] or ():
                rows.pop(t, None)
        times = row.pop("timestamps") or []
        row |= {"timestamp_str": times[0] if times else "", "timestamp_start": min(times, default=""), "timestamp_end": max(times, default="")}
        del row["pos"]
        if held := rows.get(row["record_id"]):
            row |= {c: held[c] for c in ("session_key", "session_id", "created_time")}
        rows[row["record_id"]] = row
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_equals_a_loop_in_order(spark, seed):
    rng = random.Random(seed)
    ids = [f"k{n}" for n in range(12)] + [f"n{n}" for n in range(12)]
    l1 = [known(i, f"old {i}") for i in ids[:12]]
    facts = [fact(rng.choice(ids[6:]), f"new {p}", p, rng.choices("xyz", k=rng.randrange(4)), created=f"c{p}", session=f"s{p}") for p in range(25)]
    pick = lambda: rng.sample([*ids, "missing", "", None], rng.randrange(4))
    decisions = [(f[0], f[-1], rng.choice(["store", "skip", "update", "merge"]), pick(), rng.choice([None, f"merged {f[-1]}"]), rng.choice([None, "persona"]), rng.choice([None, 3.0]), rng.choice([None, [], ["b", "a"]])) for f in facts if rng.random() < 0.8]
    want = in_order(l1, facts, decisions)
    got = resolve.resolve(spark.createDataFrame(l1, schemas.L1), spark.createDataFrame(facts, FACTS), spark.createDataFrame(decisions, DECISIONS))
    assert {r.record_id: r.asDict() for r in got.l1.collect()} == want and got.l1.count() == len(want)
    last = {d[0]: d[2] for d in decisions}
    assert got.stored.first().stored == sum(last.get(f[0], "store") != "skip" for f in facts)
    before = {r[0] for r in l1}
    removed = {r[0] for r in got.removed.collect()}
    assert before - set(want) <= removed and not removed & set(want)
    written = {r[0] for r in got.written.collect()}
    assert {i for i, r in want.items() if r["created_time"] != "old" or r["updated_time"] != "old"} == written


def test_odd_batches(spark):
    l1 = spark.createDataFrame([known("a", "x")], schemas.L1)
    none = spark.createDataFrame([], DECISIONS)
    assert resolve.resolve(l1, spark.createDataFrame([], FACTS), none).l1.collect() == l1.collect()
    bare = spark.createDataFrame([fact(None, "one", 1), fact(None, "one", 2)], FACTS)
    assert sorted(r.content for r in resolve.resolve(l1, bare, none).l1.collect()) == ["one", "one", "x"]
    hot = spark.createDataFrame([fact(f"n{k}", f"c{k}", k) for k in range(200)], FACTS)
    same = spark.createDataFrame([(f"n{k}", k, "merge", ["a"], None, None, None, None) for k in range(200)], DECISIONS)
    got = resolve.resolve(l1, hot, same)
    assert got.l1.count() == 200 and [r[0] for r in got.removed.collect()] == ["a"]


def test_decisions_with_trails(spark):
    answer = '[{"record_id": "r", "action": "merge", "target_ids": ["a"], "merged_timestamps": ["2", "1"]}]'
    d = extract.parse_decisions(spark.createDataFrame([(answer,)], "answer string")).first()
    assert (d.action, d.target_ids, d.merged_timestamps, d.merged_content) == ("merge", ["a"], ["2", "1"], None)


def test_neighbours_are_reduced_in_the_task(spark):
    rng = random.Random(5)
    rows = [(f"v{k}", [rng.choice([0.0, 1.0, rng.random()]) for _ in range(3)]) for k in range(9_000)]
    v = spark.createDataFrame(rows, "record_id string, embedding array<double>").repartition(2)
    new = v.where("record_id in ('v1', 'v2', 'v3', 'v4')")
    got = {(r.new_id, r.candidate_id) for r in search.neighbours(new, v, 4).collect()}
    held = dict(rows)
    norm = lambda x: sum(y * y for y in x) ** 0.5
    for i in ("v1", "v2", "v3", "v4"):
        if not norm(held[i]):
            continue
        cos = sorted((round(1 - sum(a * b for a, b in zip(held[i], x, strict=True)) / norm(held[i]) / norm(x), 12), j) for j, x in rows if j not in ("v1", "v2", "v3", "v4") and norm(x))
        found = [j for a, j in got if a == i]
        assert len(found) == 4 and {round(next(d for d, k in cos if k == j), 9) for j in found} == {round(d, 9) for d, _ in cos[:4]}


def test_extraction_applies_decisions(spark, tmp_path):
    class Lengths:  # here, so that workers get it by value
        dimensions = 2

        def __call__(self, texts):
            if any("refused" in t for t in texts):
                raise ValueError("refused")
            return [[float(len(t)), 1.0] for t in texts]

    m = Memory(spark, f"file://{tmp_path}/m", Lengths())
    row = lambda i, k, text, at: (i, k, k, "user", text, "t", at)
    talk = lambda rows: spark.createDataFrame(rows, schemas.L0)
    told = lambda p: json.dumps([{"scene_name": "w", "memories": [{"content": x} for x in p.split("\n")]}])
    prompt = lambda texts: "\n".join(texts)
    m.capture(talk([row("1", "k", "likes the red fox", 1), row("2", "k", "lives in a blue house", 2), row("3", "j", "a text that is refused", 1)]))
    assert m.extract(prompt, told, "2024-01-01T00:00:00.000Z") == 3
    ids = {r.content: r.record_id for r in m.l1.collect()}
    assert {r.timestamp_start for r in m.l1.collect()} == {"2024-01-01T00:00:00.000Z"}
    assert m.vectors("l1").count() == 2 and [r.t for r in m.backlog("l1").collect()] == ["a text that is refused"]
    m.capture(talk([row("4", "k", "likes the grey fox", 10), row("5", "k", "has two dogs now", 11), row("6", "i", "something else again", 12)]))

    def judge(new, old):
        fox = next((x["record_id"] for x in old if "red fox" in x["content"]), None)
        return json.dumps([{"record_id": x["record_id"], "action": "update" if "fox" in x["content"] else "skip", "target_ids": [fox], "merged_content": "liked the red fox, likes the grey one"} for x in new if "else" not in x["content"]])

    assert m.extract(prompt, told, "2024-02-01T00:00:00.000Z", judge) == 2
    assert sorted(r.content for r in m.l1.collect()) == ["a text that is refused", "liked the red fox, likes the grey one", "lives in a blue house", "something else again"]
    assert ids["likes the red fox"] not in {r.record_id for r in m.vectors("l1").collect()} and m.vectors("l1").count() == 3
    assert m.totals()["total_memories_extracted"] == 5

    def fails(*_):
        raise OSError("no service")

    m.capture(talk([row("7", "k", "yet another sentence", 20)]))
    assert m.extract(prompt, fails, "x") == 0  # the session is asked again
    assert m.extract(prompt, told, "2024-03-01T00:00:00.000Z", fails) == 1  # and a judge that raises stores
    assert m.extract(prompt, told, "x") == 0 and m.l1.count() == 5


def test_backlog_asks_only_for_the_rest(spark, tmp_path):
    class Picky:
        dimensions = 1

        def __init__(self, bad):
            self.bad = bad

        def __call__(self, texts):
            if any(b in t for t in texts for b in self.bad):
                raise ValueError("no")
            return [[float(len(t)) + 1] for t in texts]

    m = Memory(spark, f"file://{tmp_path}/m", Picky(["odd"]), Config())
    m.add_facts(spark.createDataFrame([known(f"f{k}", "odd one" if k % 5 == 0 else f"fact {k}") for k in range(20)], schemas.L1))
    m.reindex("l1")
    assert m.vectors("l1").count() == 16
    assert m.embed_backlog("l1") == 0
    m.embed = Picky(["fact"])  # whoever asks for another than the rest fails
    assert m.embed_backlog("l1") == 4 and m.vectors("l1").count() == 20 and m.backlog("l1").isEmpty()
