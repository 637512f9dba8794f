import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import extract, joins, query, search, store, transcript, triggers
from palimpsest.plans import memory
from palimpsest.plans.memory import ANSWERS, Config, Memory, render
from palimpsest.sources import files, logs
from palimpsest.streaming import capture

L1_COLUMNS = "record_id string, content string, type string, priority double, scene_name string, session_key string, session_id string, timestamp_str string, timestamp_start string, timestamp_end string, created_time string, updated_time string, metadata_json string"


def fact(i, content, kind="episodic", scene="s", at="2024-01-01T00:00:00.000Z"):
    return (i, content, kind, 50.0, scene, "k", "k", "", "", "", at, at, "{}")


def test_filter_expressions(spark):
    df = spark.createDataFrame([(1, "a", 2.5), (2, "b", 3.5)], "user_id int, kind string, value double")
    assert [r.user_id for r in query.where(df, "userId>=1, value<3").collect()] == [1]
    assert [r.user_id for r in query.where(df, "kind!=a").collect()] == [2]
    for bad in ("nope=1", "userId~1"):
        with pytest.raises(ValueError):
            query.where(df, bad)


def test_fusion_counts_repeats_and_breaks_ties_by_first_place(spark):
    a = spark.createDataFrame([("x", 0), ("y", 1), ("x", 2)], "record_id string, pos int")
    b = spark.createDataFrame([("z", 0), ("y", 1)], "record_id string, pos int")
    got = search.fuse([a, b]).collect()
    assert [r.record_id for r in got] == ["x", "y", "z"]
    assert got[0].rrf == pytest.approx(1 / 61 + 1 / 63)
    tie = search.fuse([a.where("pos = 0"), b.where("pos = 0")]).collect()
    assert [r.record_id for r in tie] == ["x", "z"]


def test_search_filters_after_the_cut(spark):
    rows = [fact(str(k), f"red fox {'red ' * k}", "persona" if k % 2 else "episodic", f"Scene{k}") for k in range(6)]
    l1 = spark.createDataFrame(rows, L1_COLUMNS)
    got = search.search_memories(l1, "red", 1).collect()
    assert len(got) == 1 and got[0].strategy == "fts"
    assert len(search.search_memories(l1, "red", 2, kind="persona").collect()) <= 2
    assert search.search_memories(l1, "red", 5, scene="SCENE3").count() <= 1
    assert search.search_memories(l1, "!!", 5).count() == 0
    vectors = spark.createDataFrame([("0", [1.0, 0.0]), ("1", [0.0, 0.0]), ("9", [1.0, 0.0])], "record_id string, embedding array<float>")
    assert [r.record_id for r in search.search_memories(l1, "", 5, vectors, [1.0, 0.0]).collect()] == ["0"]


def test_threshold_falls_back_for_short_lists(spark):
    few = spark.createDataFrame([(0.1,), (0.2,)], "score double")
    assert search.threshold_with_fallback(few, 0.3, 10).count() == 2
    assert search.threshold_with_fallback(few, 0.3, 3).count() == 0
    assert search.threshold_with_fallback(few, 0.15, 10).count() == 1


def test_index_equals_scan(spark, tmp_path):
    rows = [(str(k), " ".join(f"w{(k * j) % 7}" for j in range(1, k + 2))) for k in range(30)]
    df = spark.createDataFrame(rows, "record_id string, content string")
    search.build_index(df, str(tmp_path / "i"), "record_id", "content", 4)
    a = [(r.id, round(r.score, 9)) for r in search.search_index(spark, str(tmp_path / "i"), "w3 w5", 8).collect()]
    b = [(r.record_id, round(r.score, 9)) for r in search.keyword_search(df, "w3 w5", 8).collect()]
    assert a == b


def test_upserts_keep_identity_and_take_the_last(spark):
    old = spark.createDataFrame([fact("1", "old"), fact("2", "two")], L1_COLUMNS)
    new = spark.createDataFrame([(*fact("1", "a", at="x")[:5], "other", *fact("1", "a", at="x")[6:], 1), (*fact("1", "b", at="y"), 2), (*fact("3", "c"), 3)], L1_COLUMNS + ", seq int")
    got = {r.record_id: r for r in store.upsert_l1(old, new, "seq").collect()}
    assert set(got) == {"1", "2", "3"} and got["1"].content == "b" and got["1"].updated_time == "y"
    assert got["1"].session_key == "k" and got["1"].created_time == "2024-01-01T00:00:00.000Z"


def test_retention_guards(spark):
    guard = store.Retention(5)
    few, half = spark.range(5).select(F.col("id").alias("t")), spark.range(100).select(F.col("id").alias("t"))
    assert store.retain(few, "t", F.lit(3), guard).count() == 5
    assert store.retain(half, "t", F.lit(50), guard).count() == 50
    assert store.retain(half, "t", F.lit(81), guard).count() == 100
    assert store.retain(half, "t", F.lit(80), guard).count() == 20


def test_asof_takes_the_last_boundary(spark):
    e = spark.createDataFrame([("a", 0), ("a", 3), ("a", 5), ("b", 9)], "s string, idx int")
    b = spark.createDataFrame([("a", 3, "x"), ("a", 4, "y")], "s string, start_index int, result string")
    assert {(r.s, r.idx, r.result) for r in joins.asof(e, b, "s").collect()} == {("a", 0, None), ("a", 3, "x"), ("a", 5, "y"), ("b", 9, None)}


def test_decisions_and_ids(spark):
    m = spark.createDataFrame([("1",), ("2",)], "record_id string")
    d = spark.createDataFrame([("1", "skip", 0), ("1", "merge", 1)], "record_id string, action string, pos int")
    assert {tuple(r) for r in joins.decide(m, d).collect()} == {("1", "merge"), ("2", "store")}
    e = spark.createDataFrame([("call_1", "x"), ("call2", "y")], "tool_call_id string, summary string")
    t = spark.createDataFrame([("call1",), ("call_2",), ("none",)], "tool_id string")
    assert {tuple(r) for r in joins.by_tool_id(t, e, ("summary",)).collect()} == {("call1", "x"), ("call_2", "y"), ("none", None)}
    assert joins.confirmed(e, spark.createDataFrame([("call_2",)], "tool_call_id string")).collect()[0].summary == "y"


MESSAGES = "session_id string, pos int, role string, content string, tokens long, injected boolean, tool_id string"


def messages(spark, tokens, roles, ids=None):
    ids = ids or [None] * len(tokens)
    return spark.createDataFrame([("s", k, r, f"c{k}", t, False, i) for k, (t, r, i) in enumerate(zip(tokens, roles, ids, strict=True))], MESSAGES)


def test_prefix_and_emergency(spark):
    m = messages(spark, [10] * 8, ["user", "assistant"] * 4)
    gone = lambda need: sorted(r.pos for r in transcript.delete_prefix(m, F.lit(need)).where("deleted").collect())
    assert gone(0) == [] and gone(25) == [0, 1, 2] and gone(1000) == [0, 1, 2, 3, 4, 5]
    assert transcript.emergency(m, 60).agg(F.sum("tokens")).first()[0] <= 36
    assert transcript.emergency(m, 10_000).count() == 8


def test_budget_cuts_once(spark):
    rows = spark.createDataFrame([("s", k, "x" * n) for k, n in enumerate([30, 30, 100, 5])], "session_id string, rank int, line string")
    got = [r.line for r in transcript.budget_lines(rows, 120).orderBy("rank").collect()]
    assert [len(x) for x in got] == [30, 30, 58] and got[2].endswith(transcript.LINE_SUFFIX)
    assert [len(r.line) for r in transcript.budget_lines(rows, 70).orderBy("rank").collect()] == [30, 30]


def test_cascade_and_tail(spark):
    e = spark.createDataFrame([("s", x) for x in [7] * 4 + [6] * 3 + [5] * 4 + [2]], "session_id string, score int")
    assert [tuple(r) for r in transcript.cascade(e).collect()] == [("s", 5, 11)]
    m = messages(spark, [5, 50, 5, 20, 9], ["user", "assistant", "tool", "assistant", "tool"], [None, "a", "a", "b", "b"])
    assert sorted(r.pos for r in transcript.tail_delete(m, 40).collect()) == [0, 3, 4]
    assert transcript.insertion_point(m).first()["at"] == 1


def test_reapply_and_compress(spark):
    m = messages(spark, [5, 6, 7], ["tool"] * 3, ["a_1", "b", "c"])
    e = spark.createDataFrame([("a1", "short", "true"), ("b", "gone", "deleted")], "tool_call_id string, summary string, offloaded string")
    assert sorted((r.pos, r.content, r.replaced) for r in transcript.reapply(m, e).collect()) == [(0, "short", True), (2, "c2", False)]
    full = messages(spark, [100] * 10, ["user", "assistant"] * 5)
    assert transcript.level(full, 1000).first()["level"] == "emergency"
    assert transcript.compress(full, 1000).agg(F.sum("tokens")).first()[0] == 800  # down to 85 %, which is no emergency
    assert transcript.compress(full, 10_000).count() == 10


def plain_compress(rows, entries, window):
    """(pos, content) kept of one session, by the steps one after another; no session here meets an emergency."""
    rows = [dict(zip(("pos", "role", "content", "tokens", "tool_id"), r, strict=True)) for r in rows]
    total = lambda: sum(r["tokens"] for r in rows) + -(-len(rows) // 2)
    limit = int(window * 0.85)
    if total() >= limit and len(rows) > 2:
        need, acc, count = total() - limit, 0, 0
        for r in rows[:-2]:
            acc, count = acc + r["tokens"], count + 1
            if acc >= need:
                break
        users = [k for k, r in enumerate(rows) if r["role"] == "user"]
        del rows[: min(count, users[-1]) if users else count]
    if total() >= int(window * 0.5):
        able = [(r, *entries[r["tool_id"].replace("_", "")]) for r in rows[: int(len(rows) * 0.7)] if r["role"] == "tool" and r["tool_id"].replace("_", "") in entries]
        n, done = 0, set()
        for least in range(7, 0, -1):
            for r, summary, score in able:
                if r["pos"] not in done and (5 if score is None else score) >= least:
                    n += len(summary) <= len(r["content"])
                    done.add(r["pos"])
                    r["content"], r["tokens"] = summary, -(-len(summary) // 4)
            if n >= 10:
                break
    assert total() < int(window * 0.95)
    return [(r["pos"], r["content"]) for r in rows]


def test_compress_with_entries_is_the_plain_loop(spark):
    rng = random.Random(4)
    for size, window in ((10, 1000), (40, 4000), (60, 3000)):
        rows = [(k, rng.choice(["tool", "tool", "assistant"]) if k else "user", "x" * (n := rng.choice([40, 200, 400])), -(-n // 4), f"c_{k}") for k in range(size)]
        entries = {f"c{k}": ("s" * rng.choice([20, 60, 300]), rng.choice([None, 1.0, 3.0, 6.5, 7.0, 9.0, 0.5])) for k in range(0, size, rng.choice([1, 2]))}
        if size == 10:  # all of equal size, nothing to summarise
            rows, entries = [(k, "user" if k % 2 == 0 else "assistant", "x" * 400, 100, f"c_{k}") for k in range(10)], {}
        m = spark.createDataFrame([("s", p, r, c, t, False, i) for p, r, c, t, i in rows], MESSAGES)
        e = spark.createDataFrame([(k, *v) for k, v in entries.items()], "tool_call_id string, summary string, score double")
        got = [(r.pos, r.content) for r in transcript.compress(m, window, e).orderBy("pos").collect()]
        assert got == plain_compress(rows, entries, window)


def test_triggers(spark):
    e = spark.createDataFrame([("s", k) for k in range(1, 20)], "s string, k int")
    assert [r.n for r in triggers.count_trigger(e, "s", "k").where("fires").orderBy("n").collect()] == [1, 3, 7, 12, 17]
    t = spark.createDataFrame([(5, 100, None), (None, 100, 50), (2000, 100, 50)], "c int, n int, l int").select(triggers.advance_timer(F.col("c"), F.col("n"), F.col("l")))
    assert [r[0] for r in t.collect()] == [5, 950, 950]


def test_parse_answers(spark):
    answer = 'ok ```json\n[{"scene_name": "work", "memories": [{"content": "x", "type": "episode"}, {"content": "y", "type": "odd"}, {"content": "z", "priority": 70.5, "source_message_ids": ["1"]},]}]\n```'
    got = extract.parse_memories(spark.createDataFrame([("s", answer), ("t", "nothing")], "session_key string, answer string")).collect()
    assert [(r.content, r.type, r.priority, r.scene_name) for r in got] == [("x", "episodic", 50.0, "work"), ("z", "episodic", 70.5, "work")]
    d = extract.parse_decisions(spark.createDataFrame([('[{"record_id": "1", "action": "merge", "merged_type": "preference"}, {"record_id": "2", "action": "odd"}]',)], "answer string")).collect()
    assert [(r.record_id, r.action, r.merged_type) for r in d] == [("1", "merge", "persona")]


def test_logs_and_scenes(spark, tmp_path):
    l0 = spark.createDataFrame([("1", "k", "s", "user", "hi", "t", 0), ("2", "k", "s", "user", "yo", "t", 86_400_000)], "record_id string, session_key string, session_id string, role string, message_text string, recorded_at string, timestamp long")
    logs.append_messages(l0, str(tmp_path))
    assert [r.message_text for r in logs.read_messages(spark, str(tmp_path), "k").collect()] == ["hi", "yo"]
    blocks = tmp_path / "scene_blocks"
    blocks.mkdir()
    (blocks / "a.md").write_text("-----META-START-----\ncreated: c\nupdated: u\nsummary: about\nheat: 120\n-----META-END-----\n\nbody\n")
    (blocks / "b.md").write_text("[DELETED]")
    (blocks / "c.md").write_text("only body")
    got = files.scenes(spark, str(tmp_path)).orderBy("filename").collect()
    assert [(r.filename, r.summary, r.heat, r.body.strip()) for r in got] == [("a.md", "about", 120, "body"), ("c.md", "", 0, "only body")]
    assert files.navigation(files.scenes(spark, str(tmp_path))).orderBy("rank").first().line == "- a.md 🔥🔥 about"
    entries = tmp_path / "o.jsonl"
    entries.write_text('{"tool_call_id": "a", "score": 3}\nnot json\n{"tool_call_id": ""}\n{"tool_call_id": "b"}\n')
    assert [(r.idx, r.tool_call_id) for r in logs.read_entries(spark, str(entries)).orderBy("idx").collect()] == [(0, "a"), (3, "b")]


def test_seed(spark, tmp_path):
    p = tmp_path / "seed.json"
    p.write_text('[{"conversations": [[{"role": "user", "content": "a"}, {"role": "odd", "content": "b"}]]}, {"sessionKey": "k", "conversations": [[{"role": "assistant", "content": "c"}]]}]')
    got = files.fill_times(files.read_seed(spark, str(p)), 1000).orderBy("session", "place").collect()
    assert [(r.session_key, r.content, r.timestamp, r.error is None) for r in got] == [("seed", "a", 1000, True), ("seed", "b", 1100, False), ("k", "c", 1200, True)]
    assert files.round_keys(files.read_seed(spark, str(p))).count() == 2


def test_facade(spark, tmp_path):
    class Lengths:  # here, so that workers get it by value
        dimensions = 2

        def __call__(self, texts):
            return [[float(len(t)), 1.0] for t in texts]

    m = Memory(spark, f"file://{tmp_path}/m", Lengths(), Config(retention_days=2))
    rows = spark.createDataFrame([("1", "k", "s", "user", "the red fox runs", "t", 10), ("2", "k", "s", "system", "no", "t", 11), ("3", "k", "s", "assistant", "a blue dog sleeps", "t", 12)], "record_id string, session_key string, session_id string, role string, message_text string, recorded_at string, timestamp long")
    assert m.capture(rows) == 2 and m.capture(rows) == 0
    m.reindex("l0")
    assert m.search_conversations("fox").first().record_id == "1"
    n = m.extract(lambda texts: "\n".join(texts), lambda p: '[{"scene_name": "w", "memories": [{"content": "likes the red fox"}]}]', "2024-01-01T00:00:00.000Z")
    assert n == 1 and m.extract(lambda t: "", lambda p: "[]", "x") == 0
    assert m.totals()["total_memories_extracted"] == 1 and m.runner().first().last_scene_name == "w"
    more = spark.createDataFrame([("9", "k", "s", "user", "something else to say", "t", 20)], m.l0.schema)
    assert m.capture(more) == 1 and len(m._parts("l0")) == 2
    m.extract(lambda texts: "|".join(texts), lambda p: f"[] {p}", "x")
    assert [r.answer for r in m.table("answers", ANSWERS).collect()] == ["[] something else to say"] and m.totals()["total_memories_extracted"] == 1
    m.forget("l0", spark.createDataFrame([("9",)], "record_id string"))
    assert m.recall("red fox")["lines"] == ["- [episodic|w] likes the red fox (活动时间: 2024-01-01)"]
    assert {r.layer: r.n for r in m.status().collect()} == {"l0": 2, "l1": 1}
    m.update(m.l1.first().record_id, "likes the blue fox", "2024-02-01T00:00:00.000Z")
    assert m.l1.first().content == "likes the blue fox" and m.vectors("l1").count() == 1
    with pytest.raises(KeyError):
        m.update("none", "x", "t")
    assert m.bootstrap({"type": "parquet"}) == [] and m.bootstrap({"type": "other"}) == ["store type changed: parquet → other"]
    assert {r.removed for r in m.retain(10**12).collect()} == {0}
    assert m.next_retention(0) == 3 * 3_600_000
    assert m.l0.count() == 2 and '"total": 2' in render(m.status())
    m.forget("l0", spark.createDataFrame([("1",)], "record_id string"))
    assert m.l0.count() == 1 and m.vectors("l0").count() == 1


def test_streams_drop_replays(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "session_key string, record_id string, role string, message_text string, timestamp long"
    source = tmp_path / "in"

    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))

    def run(name, f):
        stream = spark.readStream.schema(schema).parquet(str(source))
        q = f(stream).writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    try:
        pytest.importorskip("google.protobuf", reason="stateful Python streams need protobuf")
        feed([("k", "1", "user", "a", 1), ("k", "2", "user", "b", 2), ("j", "3", "user", "c", 9)])
        run("out", capture.captured)
        run("fired", lambda s: capture.fired(s, 2))
        feed([("k", "2", "user", "b", 2), ("k", "4", "user", "d", 3), ("j", "5", "user", "e", 5)])
        run("out", capture.captured)
        run("fired", lambda s: capture.fired(s, 2))
        assert sorted(r.record_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1", "2", "3", "4"]
        assert sorted((r.session_key, r.n) for r in spark.read.parquet(str(tmp_path / "fired")).collect()) == [("j", 1), ("k", 1), ("k", 3)]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_batch_cursors(spark):
    rows = spark.createDataFrame([("k", 1), ("k", 5), ("j", 2)], "session_key string, timestamp long")
    cursors = spark.createDataFrame([("k", 1)], "session_key string, last_captured_timestamp long")
    left = capture.after_cursors(rows, cursors)
    assert {tuple(r) for r in left.collect()} == {("k", 5), ("j", 2)}
    assert {tuple(r) for r in capture.advance(cursors, left).collect()} == {("k", 5), ("j", 2)}


def test_config():
    c = Config.parse({"recall": {"maxResults": 7, "scoreThreshold": 1, "strategy": "${S}"}, "zone": "UTC"}, {"S": "keyword"})
    assert (c.max_results, c.score_threshold, c.strategy) == (7, 1.0, "keyword")
    for bad in ({"odd": 1}, {"maxResults": "7"}, {"strategy": "x"}, {"retentionDays": 2}):
        with pytest.raises(ValueError):
            Config.parse(bad)


def test_embedding_requests():
    asked = []

    def embed(texts):
        asked.append(texts)
        if len(asked) == 1:
            raise OSError("busy")
        return [[float(len(t))] for t in texts]

    assert memory.embed_all(embed, ["a", None, "abc𝄞", "xy"], batch=3, units=4) == [[1.0], [0.0], [3.0], [2.0]]
    assert [len(x) for x in asked] == [3, 3, 1]
    with pytest.raises(ValueError):
        memory.embed_all(lambda texts: [], ["a"])
    with pytest.raises(OSError):
        memory.embed_all(lambda texts: (_ for _ in ()).throw(OSError()), ["a"])


def test_many_parts_are_written_anew(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(memory, "PARTS", 2)
    m = Memory(spark, f"file://{tmp_path}/m")
    schema = "record_id string, session_key string, session_id string, role string, message_text string, recorded_at string, timestamp long"
    for k in range(4):
        assert m.capture(spark.createDataFrame([(str(k), "k", "s", "user", f"message {k}", "t", k + 1)], schema)) == 1
    assert m.l0.count() == 4 and len(m._parts("l0")) == 2
    again = spark.createDataFrame([("3", "k", "s", "user", "other words", "t", 9)], schema)
    assert m.capture(again) == 1 and m.l0.count() == 4 and m.l0.where("record_id = '3'").first().message_text == "other words"
