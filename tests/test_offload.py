from pyspark.sql import functions as F

from palimpsest.plans import offload
from palimpsest.sources import export

PAIRS = "session_id string, timestamp string, tool_call_id string, tool_name string, params string, result string"
MESSAGES = "session_id string, pos int, role string, content string, tokens long, injected boolean, tool_id string"


def pairs(spark, n):
    return spark.createDataFrame([("s", f"t{k:02d}", f"c{k:02d}", "run", "{}", f"out {k}") for k in range(n)], PAIRS)


def none(spark):
    return spark.createDataFrame([], "tool_call_id string")


def test_flush_waits_and_chunks(spark):
    assert offload.ready(pairs(spark, 3), none(spark)).count() == 0
    assert offload.ready(pairs(spark, 3), none(spark), force=True).count() == 3
    got = offload.ready(pairs(spark, 23), none(spark)).groupBy("chunk").count().orderBy("chunk").collect()
    assert [tuple(r) for r in got] == [(0, 5), (1, 5), (2, 5), (3, 5)]
    done = spark.createDataFrame([(f"c{k:02d}",) for k in range(20)], "tool_call_id string")
    assert offload.ready(pairs(spark, 23), done).count() == 0


def test_answers_must_match_the_question(spark):
    def call(asked):
        if any(a["tool_call_id"] == "c07" for a in asked):
            return [{"tool_call_id": "c05", "summary": "half"}]
        return [{"tool_call_id": a["tool_call_id"], "summary": "did " + a["result"], "score": 7} for a in asked]

    got = {r.tool_call_id: (r.summary, r.score) for r in offload.summarise(offload.ready(pairs(spark, 10), none(spark)), call).collect()}
    assert got["c03"] == ("did out 3", 7.0) and got["c07"] == (offload.DEGRADED + "run: out 7", 0.0) and len(got) == 10


def test_boundaries_and_candidates(spark):
    judged = spark.createDataFrame([("s", 0, 1, "short", None), ("s", 0, 2, "long", "a.mmd"), ("s", 5, 3, None, None)], "session_id string, start_index int, seq int, result string, target string")
    e = spark.createDataFrame([("s", 1, None, 0), ("s", 2, "wait", 0), ("s", 3, "wait", 90), ("s", 6, None, 0), ("s", 4, "n1", 0)], "session_id string, idx int, node_id string, ts int")
    assert sorted(r.idx for r in offload.diagram_candidates(e, judged, 130).collect()) == [1, 2]


def test_injection_and_compression(spark):
    m = spark.createDataFrame([("s", k, "user" if k % 2 == 0 else "assistant", "word " * 20, 25, False, None) for k in range(6)], MESSAGES)
    block = spark.createDataFrame([("s", "context")], "session_id string, content string")
    got = offload.inject(m, block).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(7)) and [r.injected for r in got].index(True) == 5
    again = offload.inject(offload.inject(m, block), block)
    assert again.where("injected").count() == 1 and again.count() == 7
    entries = spark.createDataFrame([], "tool_call_id string, summary string, offloaded string")
    assert offload.before_prompt(m, entries, block, 100_000).count() == 7
    small = offload.before_prompt(m, entries, block, 100)
    assert small.where("injected").count() == 1 and small.count() < 7
    assert offload.after_tool(m, entries, block, 100).count() < 7


def test_export_and_references(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.5])], "id int, vector array<double>")
    export.export({"a": df}, str(tmp_path / "x"))
    assert spark.read.json(str(tmp_path / "x/a")).columns == ["id"]
    assert spark.read.json(str(tmp_path / "x/meta")).first().documents == 1
    got = export.write_references(pairs(spark, 2), str(tmp_path / "r"))
    assert got.where("tool_call_id = 'c01'").first().result_ref == "refs/t01-run-c01.md"
    assert spark.read.text(str(tmp_path / "r")).where(F.col("value") == "out 1").count() == 1


def test_compression_tells_what_it_did(spark):
    """Statuses that a compression leaves make the next one take the same decisions first."""
    rows = []
    for s, n in (("full", 40), ("half", 20), ("empty", 4)):
        for k in range(n):
            role = ("user", "assistant", "tool", "tool")[k % 4]
            rows.append((s, k, role, f"{s} {k} " + "word " * 20, 25, False, f"{s}_{k}" if role == "tool" else None))
    m = spark.createDataFrame(rows, MESSAGES)
    entries = spark.createDataFrame([(r[6], f"sum {r[6]}", 8.0, None) for r in rows if r[6] and r[1] % 4 == 2], "tool_call_id string, summary string, score double, offloaded string")
    got = offload.compress(m, entries, 800)
    report = {r.session_id: r for r in got.report.collect()}
    assert {s: r.mode for s, r in report.items()} == {"full": "aggressive", "half": "mild", "empty": "none"}
    before = {r[:2]: r for r in rows}
    after = {(r.session_id, r.pos): r for r in got.messages.collect()}
    change = {(r.session_id, r.pos): r.change for r in got.changes.collect()}
    assert {k for k, c in change.items() if c == "deleted"} == set(before) - set(after)
    assert {k for k, c in change.items() if c == "replaced"} == {k for k, r in after.items() if r.content != before[k][3]} and "cut" not in change.values()
    for s, r in report.items():
        own = [x for k, x in after.items() if k[0] == s]
        assert r.deleted == sum(c == "deleted" and k[0] == s for k, c in change.items()) and r.replaced == sum(c == "replaced" and k[0] == s for k, c in change.items())
        n = sum(x[0] == s for x in rows)
        assert (r.tokens_before, r.tokens_after) == (25 * n + -(-n // 2), sum(x.tokens for x in own) + -(-len(own) // 2)) and r.tokens_saved == r.tokens_before - r.tokens_after
        assert (r.fast_replaced, r.fast_deleted) == (0, 0)
    marks = {r.tool_call_id: r.offloaded for r in got.entries.collect()}
    for k, c in change.items():
        if before[k][6] in marks:
            assert marks[before[k][6]] == {"deleted": "deleted", "replaced": "true"}[c]
    again = offload.compress(m, spark.createDataFrame(got.entries.collect(), got.entries.schema), 800)
    second = {r.session_id: r for r in again.report.collect()}
    assert second["half"].fast_replaced == report["half"].replaced and second["half"].replaced == 0
    assert second["full"].fast_deleted == sum(v == "deleted" and k.startswith("full") for k, v in marks.items())
    assert {r.tool_call_id: r.offloaded for r in again.entries.collect() if marks[r.tool_call_id]} == {k: v for k, v in marks.items() if v}
