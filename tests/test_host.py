import json

import pytest
from pyspark.sql import functions as F

from palimpsest.__main__ import main
from palimpsest.plans import host, prompts
from palimpsest.plans.memory import Config, Memory, render, report


def part(**given):
    names = [x.strip().split(":")[0] for x in host.PART.removeprefix("struct<").removesuffix(">").split(",")]
    return tuple(given.get(n) for n in names)


def rows(spark):
    tool = lambda k, **more: part(id=f"p{k}", type="tool", call_id=f"c{k}", tool="run", **more)
    return spark.createDataFrame(
        [
            ("s", 0, "m0", "user", [part(type="text", text="do it")]),
            ("s", 1, "m1", "assistant", [part(type="text", text="sure"), tool(1, status="completed", output="one"), tool(2, status="error", error="bad"), tool(3, status="running")]),
            ("s", 2, "m2", "user", [part(type="text", text="more"), part(type="file")]),
            ("s", 3, "m3", "assistant", [tool(4, status="completed", output="four")]),
        ],
        host.HOST,
    )


def test_canonical_rows(spark):
    got = host.canonical(rows(spark)).orderBy("pos").collect()
    assert [(r.id, r.role, r.content, r.tool_id, r.tool_calls) for r in got] == [
        ("m0", "user", "do it", None, []), ("m1", "assistant", "sure", None, ["c1", "c2", "c3"]), ("m1:p1", "tool", "one", "c1", []), ("m1:p2", "tool", "bad", "c2", []),
        ("m2", "user", "more", None, []), ("m3", "assistant", "", None, ["c4"]), ("m3:p4", "tool", "four", "c4", []),
    ]


def test_rewrites_go_back(spark):
    same = host.merged(rows(spark), host.canonical(rows(spark))).orderBy("pos").collect()
    assert [r.id for r in same] == ["m0", "m1", "m2", "m3"] and [p.call_id for p in same[1].parts if p.type == "tool"] == ["c1", "c2"]
    c = host.canonical(rows(spark)).where("id not in ('m0', 'm1:p2')")
    c = c.withColumn("content", F.when(F.col("tool_id") == "c1", "short").when(F.col("id") == "m1", "sure\nran c2").otherwise(F.col("content")))
    extra = spark.createDataFrame([("s", 500, None, "user", "context", 1, True, None, [])], host.CANONICAL)
    got = host.merged(rows(spark), c.unionByName(extra)).orderBy("pos").collect()
    assert [r.id for r in got] == ["m1", "m2", "m3"]
    assert [(p.type, p.text, p.output, p.kind) for p in got[0].parts] == [("text", "sure", None, None), ("tool", None, "short", None), ("text", "ran c2", None, "tool-summary")]
    assert [p.text for p in got[1].parts] == ["more", None, "context"] and got[1].parts[2].synthetic
    created = rows(spark).withColumn("created", F.lit(5))
    assert host.latest_user(created).first().id == "m2"


def test_messages_and_lines_are_dealt_out_once(spark):
    import __spark_entry__

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = {n: __spark_entry__.queries()[n](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString() for n in ("join09_merged", "scl_j11_canonical")}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # the host's messages (twice in the plan, one shuffle when it runs) and the lines that are gone
    assert {n: p.count("Exchange") for n, p in plans.items()} == {"join09_merged": 3, "scl_j11_canonical": 1}


def test_injected_rows_go_to_the_user_before_or_the_last_one(spark):
    ids = {0: "a", 2: "b", 4: "c"}
    host_rows = [(s, p, f"{s}{p}", "user" if p in ids and s != "n" else "assistant", [part(type="text", text="t")]) for s in ("s", "r", "n") for p in range(2 if s == "r" else 0, 5)]
    given = spark.createDataFrame([*host_rows, ("e", 0, "e0", "assistant", None)], host.HOST)
    rows_ = host.canonical(given)
    assert [(r.id, r.content, r.tool_calls) for r in rows_.where("session_id = 'e'").collect()] == [("e0", None, None)]
    at = [(s, p, f"{s}@{p}") for s in ("s", "r", "n") for p in (-1, 0, 1, 1999, 2000, 3500, 4000, 9000)]
    extra = spark.createDataFrame([*((s, p, None, "user", c, 1, True, None, []) for s, p, c in at), ("s", 1, None, "user", "", 1, True, None, [])], host.CANONICAL)
    got = host.merged(given, rows_.unionByName(extra)).collect()
    want: dict = {}
    for s, p, c in at:
        users = sorted(r[1] for r in host_rows if r[0] == s and r[3] == "user")
        if users:
            want.setdefault((s, max((u for u in users if u * 1000 <= p), default=users[-1])), []).append(c)
    assert {(r.session_id, r.pos // 1000): [x.text for x in r.parts if x.kind == "active"] for r in got if r.role == "user"} == want | {("s", k): want.get(("s", k), []) for k in ids}
    assert len(got) == len(host_rows) + 1 and not any(x.kind for r in got if r.role != "user" for x in r.parts or [])


def test_prompts_hold_their_rows():
    assert prompts.as_text(None) == "" and prompts.as_text({"a": "ü"}) == '{"a":"ü"}' and prompts.as_text("x") == "x"
    assert '"content": "hi"' in prompts.extraction([{"id": "1", "content": "hi"}], scene="work") and "work" in prompts.extraction([], scene="work")
    assert "(none)" in prompts.comparison([{"record_id": "1", "content": "a"}], {}) and "xx..." in prompts.summaries([{"tool_call_id": "a", "tool_name": "t", "result": "x" * 9}], most=2)
    assert "2: b" in prompts.diagram([], "a\nb") and "taskCompleted" in prompts.judgement("r")
    assert "body" in prompts.persona("", [{"filename": "a.md", "body": "body"}]) and "a.md" in prompts.scenes([], [{"filename": "a.md"}])


def test_seed_recall_and_pages(spark, tmp_path, capsys):
    m = Memory(spark, f"file://{tmp_path}/m", config=Config(retention_days=3))
    p = tmp_path / "seed.json"
    p.write_text(json.dumps({"sessions": [{"sessionKey": "k", "conversations": [[{"role": "user", "content": "the red fox"}, {"role": "assistant", "content": "is quick"}]]}]}))
    assert m.seed(str(p), 1000) == {"sessions": 1, "rounds": 1, "messages": 2, "recorded": 2}
    assert m.seed(str(p), 1000) == {"sessions": 1, "rounds": 0, "messages": 2, "recorded": 0}
    p.write_text('[{"conversations": [[{"role": "user", "content": "a"}, {"role": "odd", "content": "b"}]]}]')
    with pytest.raises(ValueError, match="session 1, round 1, place 2"):
        m.seed(str(p), 0)
    assert m.recall_within("fox", 60, "persona")["strategy"] == "hybrid" and m.recall_within("fox", 60) is None and m.recall_within("fox", 0, "persona") is None
    assert report(m.search_conversations("fox"), "messages").startswith("Found 1 matching messages:\n1. [user] the red fox (score:") and report(m.search_memories("fox")) == "No matching memories found."
    assert render(m.l0.select("role").orderBy("role"), "table").split() == ["role", "assistant", "user"]
    main(["--path", f"file://{tmp_path}/m", "rows", "l0", "--where", "role=user", "--since", "1970-01-01"])
    page = json.loads(capsys.readouterr().out)
    assert page["total"] == 1 and page["data"][0]["message_text"] == "the red fox" and page["level"] == "l0"
