"""The maintained index against a scan of all texts, and versions written by two."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.operators import fulltext, search
from palimpsest.sources.versions import Conflict, Versions


def test_after_random_changes_scores_are_those_of_a_scan(spark, tmp_path):
    rng, held = random.Random(3), {}
    index = fulltext.Index(spark, f"file://{tmp_path}/i", buckets=4)
    words = [f"w{k}" for k in range(12)]
    schema = "record_id string, content string"
    asked = "w3 w5 w11 nowhere"
    assert index.search(asked, 5).count() == 0
    for step in range(12):
        new = {str(rng.randrange(40)): rng.choice([None, "", *(" ".join(rng.choices(words, k=rng.randrange(1, 15))) for _ in range(6))]) for _ in range(rng.randrange(1, 8))}
        index.upsert(spark.createDataFrame([*new.items(), (None, "w3")], schema), "record_id", "content")
        held |= new
        if step % 3 == 2:
            out = rng.sample(sorted(held), 3) + ["unknown"]
            index.delete(spark.createDataFrame([(x,) for x in out], "record_id string"), "record_id")
            held = {k: v for k, v in held.items() if k not in out}
        state = index._state()
        assert state["n"] == len(held)
        if step % 4 == 3:
            docs = spark.createDataFrame(list(held.items()), schema)
            want = [(r.record_id, round(r.score, 9)) for r in search.keyword_search(docs, asked, 20).collect()]
            assert (want or step < 11) and [(r.id, round(r.score, 9)) for r in index.search(asked, 20).collect()] == want
    assert len(state["segments"]) < 12  # merges happened
    index.vacuum()
    assert [(r.id, round(r.score, 9)) for r in index.search(asked, 20).collect()] == want
    index.delete(docs.select("record_id"), "record_id")
    assert index._state()["n"] == 0 and index._state()["words"] == 0 and index.search(asked, 5).count() == 0
    index.upsert(docs.limit(0), "record_id", "content")
    index.delete(docs.limit(0), "record_id")


def test_terms_are_counted_row_by_row_and_in_no_table_of_a_task(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    texts = [None, "", " . ", "a", "A a b", "b 中文字中文 b a", *(" ".join(rng.choices("abcdefgé", k=rng.randrange(1, 400))) for _ in range(20))]
    docs = spark.createDataFrame(list(enumerate(texts)), "k long, x string")
    rows = docs.select(tx.terms(F.col("x")).alias("t")).select("t", tx.counts(F.col("t")).alias("c")).collect()
    assert len(rows) == len(texts) and [dict(r.c or []) for r in rows] == [dict(Counter(r.t or [])) for r in rows]
    assert all(len(dict(r.c)) == len(r.c) for r in rows if r.c)
    plans, write = [], fulltext.Index._write
    monkeypatch.setattr(fulltext.Index, "_write", lambda self, postings, name: plans.append(postings._jdf.queryExecution().executedPlan().toString()) or write(self, postings, name))
    index = fulltext.Index(spark, f"file://{tmp_path}/i", buckets=4)
    index.upsert(docs, "k", "x")
    assert plans and "Generate" in plans[0] and "keys=[term" not in plans[0]
    name = next(iter(index._state()["segments"]))
    got = {(r.id, r.term): (r.tf, r.dl) for r in index._read("postings", [name], fulltext.POSTINGS).collect()}
    assert got == {(str(k), t): (n, len(r.t)) for k, r in enumerate(rows) for t, n in Counter(r.t or []).items()}


def test_a_query_reads_the_buckets_of_its_terms_alone(spark, tmp_path):
    index = fulltext.Index(spark, f"file://{tmp_path}/i", buckets=16)
    index.upsert(spark.range(200).selectExpr("cast(id as string) as i", "concat('w', id, ' common') as t"), "i", "t")
    plan = index._read("postings", list(index._state()["segments"]), fulltext.POSTINGS).where("bucket = 3 and term = 'w7'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(term), EqualTo(term,w7)]" in plan
    assert [r.id for r in index.search("w7", 5).collect()] == ["7"]


def test_of_two_writers_one_is_refused(spark, tmp_path):
    a, b = (Versions(spark, f"file://{tmp_path}/v") for _ in range(2))
    assert a.read() == (0, {})
    assert a.commit(0, {"n": 1}) == 1
    with pytest.raises(Conflict):
        b.commit(0, {"n": 2})
    calls = []

    def step(state):
        if not calls:
            a.commit(1, {"n": 10})  # comes first
        calls.append(dict(state))
        return {"n": state["n"] + 1}

    assert b.change(step) == {"n": 11} and calls == [{"n": 1}, {"n": 10}]
    assert a.read() == (3, {"n": 11}) and a.change(lambda s: None) == {"n": 11}
    for k in range(3, 40):
        a.commit(k, {"n": k})
    assert len(a._numbers()) == 20 and b.read() == (40, {"n": 39})
    assert not [p for p in (tmp_path / "v").iterdir() if not p.name.endswith((".json", ".crc"))]
