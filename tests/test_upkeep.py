import pytest
from pyspark.sql import functions as F

from palimpsest import schemas
from palimpsest.operators import upkeep
from palimpsest.sources import logs

DAY = 86_400_000


def test_shards_by_day(spark):
    files = spark.createDataFrame([("p", n) for n in ("2024-01-01.jsonl", "2024-01-02.json", "2024-02-30.jsonl", "notes.jsonl", "x.txt")], "path string, name string")
    got = upkeep.expired_shards(files, "2024-01-02")
    assert {r.name: r.verdict for r in got.collect()} == {"2024-01-01.jsonl": "delete", "2024-01-02.json": "keep", "2024-02-30.jsonl": "odd", "notes.jsonl": "odd"}
    assert tuple(upkeep.cleanup_counts(got, 5, 6).first()) == (4, 1, 2, 5, 6)


def test_offload_waste(spark):
    old, new = 0, 100 * DAY
    rows = [("a", f"/a/mmds/{k:02}.mmd", f"{k:02}.mmd", old + k) for k in range(18)] + [("b", f"/b/mmds/{k}.mmd", f"{k}.mmd", old) for k in range(10)]
    rows += [("a", "/a/offload-1.jsonl", "offload-1.jsonl", old), ("a", "/a/offload-2.jsonl", "offload-2.jsonl", new), ("a", "/a/refs/x.md", "x.md", old), ("a", "/a/refs/y.md", "y.md", old), ("b", "/b/refs/x.md", "x.md", old), ("b", "/b/refs/z.md", "z.md", new), ("a", "/a/state.json", "state.json", old)]
    files = spark.createDataFrame(rows, "agent string, path string, name string, modified long")
    refs, active = spark.createDataFrame([("a", "x.md")], "agent string, name string"), spark.createDataFrame([("a", "01.mmd")], "agent string, name string")
    got = {r.path for r in upkeep.offload_waste(files, refs, active, new, 7).collect()}
    assert got == {"/a/mmds/00.mmd", "/a/mmds/02.mmd", "/a/mmds/03.mmd", "/a/offload-1.jsonl", "/a/refs/y.md", "/b/refs/x.md"}
    assert upkeep.offload_waste(files, refs, active, new, 2).count() == 0


def test_registry(spark):
    none = spark.createDataFrame([], upkeep.REGISTRY)
    one = upkeep.register_sessions(none, spark.createDataFrame([("k", "1"), ("j", "2")], "session_key string, session_id string"), F.lit("2024-01-01T00:00:00Z"))
    two = upkeep.register_sessions(one, spark.createDataFrame([("k", "3")], "session_key string, session_id string"), F.lit("1970-01-01T00:00:01Z"))
    assert {(r.session_key, r.offload_file) for r in two.collect()} == {("k", "offload-3.jsonl"), ("j", "offload-2.jsonl")}
    odd = two.unionByName(spark.createDataFrame([("x", "9", None, "sometime"), ("y", "8", "gone.jsonl", "2024-01-01T00:00:00Z")], upkeep.REGISTRY))
    files = spark.createDataFrame([("offload-2.jsonl",), ("offload-3.jsonl",)], "name string")
    assert {r.session_key for r in upkeep.live_registry(odd, files, 5000).collect()} == {"j", "x"}


def test_entry_logs_are_replaced(spark, tmp_path):
    path = str(tmp_path / "e")
    entries = spark.createDataFrame([(None, "a_1"), (None, "b"), (None, "")], "offloaded string, tool_call_id string")
    logs.append_entries(entries.select("tool_call_id", "offloaded"), path)
    logs.mark_entries(spark, path, spark.createDataFrame([("a1", "true")], "tool_call_id string, offloaded string"))
    assert {(r.tool_call_id, r.offloaded) for r in spark.read.schema(schemas.OFFLOAD_ENTRY).json(path).collect()} == {("a_1", "true"), ("b", None)}
    call = spark.range(1).select(logs.degraded_summary(F.lit("run"), F.lit("p" * 201), F.lit("r" * 300)).alias("d")).first().d
    assert call.tool_call == "run(" + "p" * 197 + "...)" and call.summary == "[L1 degraded] run: " + "r" * 300


def test_settings():
    meta = upkeep.EmbeddingMeta("p", "m", 3)
    assert upkeep.read_embedding_meta(upkeep.write_embedding_meta(meta)) == meta
    assert upkeep.read_embedding_meta({"provider": "p", "model": "m", "dimensions": "3"}) == meta and upkeep.read_embedding_meta({"model": "m"}) is None
    for bad in ({"embedding_provider_info": "{"}, {"embedding_provider_info": '{"odd": 1}'}, {"provider": "p", "model": "m", "dimensions": "x"}):
        with pytest.raises(ValueError):
            upkeep.read_embedding_meta(bad)
    assert upkeep.binding_changes({"type": "a", "path": "x"}, {"type": "a", "path": "y"}) == ["path changed: x → y"]
    assert upkeep.binding_changes({"type": "a", "path": "x"}, {"type": "b"}) == ["store type changed: a → b"]
    assert upkeep.merge_settings({"a": {"b": 1, "c": 2}, "d": 1}, {"a": {"b": 3}, "d": 1.5, "e": "x"}) == {"a": {"b": 3, "c": 2}, "d": 1.5, "e": "x"}
    with pytest.raises(ValueError):
        upkeep.merge_settings({"a": 1}, {"a": "x"})
