import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import messages as ms
from palimpsest.functions import text as tx
from palimpsest.operators import answers


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "k int, answer string")


def test_summaries(spark):
    got = answers.summaries(asked(spark, 'Sure:\n```json\n[{"tool_call_id": "a", "summary": "did", "score": 7.5, "offloaded": true,}, {"tool_call_id": ""}, {"tool_call_id": 5}, {"tool_call_id": "b", "score": "9"}]\n```', "no", '{"tool_call_id": "x"}', None)).orderBy("k", "pos").collect()
    assert [(r.k, r.tool_call_id, r.summary, r.score, r.offloaded) for r in got] == [(0, "a", "did", 7.5, "true"), (0, "b", "", 5.0, None)]


def test_judgements(spark):
    got = answers.judgements(asked(spark, '{"taskCompleted": true, "newTaskLabel": "x", "isLongTask": null}', '{"taskCompleted": null}', "[]", "text", '{"isLongTask": "yes", "continuationMmdFile": 3}')).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(0, True, False, False, None, "x"), (4, False, False, False, None, None)]


def test_diagrams(spark):
    one = json.dumps({"file_action": "replace", "replace_blocks": [{"start_line": "2", "end_line": 3, "content": "```mermaid\nB\n```"}, {"start_line": 1}, {"start_line": -1, "end_line": 1}], "node_mapping": {"a": "n1", "b": 2}})
    got = answers.diagrams(asked(spark, one, '{"mmd_content": "plain"}', "```mermaid\nflowchart TD\n```", "nothing", '{"mmd_content": 5}')).orderBy("k").collect()
    assert [(r.k, r.replace, r.content) for r in got] == [(0, True, None), (1, False, "plain"), (2, False, "flowchart TD"), (4, False, None)]
    assert [tuple(b) for b in got[0].blocks] == [(2, 3, "B")] and got[0].nodes == {"a": "n1"}


@pytest.mark.parametrize(
    ("source", "blocks", "want"),
    [
        ("a\nb\nc\n", [(2, 2, "x\ny")], "a\nx\ny\nc"),
        ("a\nb\nc", [(1, 1, "1"), (3, 3, "3")], "1\nb\n3"),
        ("a\nb", [(2, 1, "new")], "a\nnew\nb"),
        ("a\nb", [(1, 2, "")], ""),
        ("a\nb", [(0, 1, "x")], None),
        ("a\nb", [(1, 3, "x")], None),
        ("a\nb", [(3, 2, "end")], "a\nb\nend"),
        ("", [(1, 0, "only")], "only"),
        ("a", [], "a"),
    ],
)
def test_splicing(spark, source, blocks, want):
    df = spark.createDataFrame([(source, blocks)], "s string, b array<struct<start_line: bigint, end_line: bigint, content: string>>")
    assert df.select(tx.splice_lines(F.col("s"), F.col("b"))).first()[0] == want


def test_diagram_text(spark):
    text = lambda s, f: spark.createDataFrame([(s,)], "s string").select(f(F.col("s"))).first()[0]
    assert text("x ```mermaid\n a \n``` y", tx.mermaid) == "a" and text("graph TD ", tx.mermaid) == "graph TD" and text("else", tx.mermaid) is None
    assert text('%%{x}%%\nA["one"]\nA --> B\n  %% note', tx.diagram_outline) == '%%{x}%%\nA["one"]\n  %% note'


MESSAGES = [
    {"role": "user", "content": "hi"},
    {"role": "user", "content": "[1, 2]"},
    {"message": {"role": "assistant", "content": [{"type": "text", "text": "a"}, {"type": "tool_use", "id": "t_1", "input": {"x": 1}}, {"type": "text", "text": "b"}]}},
    {"role": "assistant", "content": [{"type": "toolCall", "id": "t2", "arguments": {}}]},
    {"role": "tool", "toolCallId": "t1", "content": "raw", "details": {"a": 1}},
    {"type": "toolResult", "message": {"role": "toolResult", "tool_call_id": "t2", "content": [{"type": "text", "text": "raw"}]}},
    {"role": "assistant", "content": []},
    {"role": "user"},
]


def test_message_accessors(spark):
    df = spark.createDataFrame([(k, json.dumps(m)) for k, m in enumerate(MESSAGES)] + [(9, "no json")], "k int, m string")
    m = F.col("m")
    got = {r.k: r for r in df.select("k", ms.role(m).alias("role"), ms.text_content(m).alias("text"), ms.call_ids(m).alias("calls"), ms.only_calls(m).alias("only"), ms.result_id(m).alias("tool"), ms.is_result(m).alias("result")).collect()}
    assert [got[k].role for k in range(8)] == ["user", "user", "assistant", "assistant", "tool", "toolResult", "assistant", "user"]
    assert [got[k].text for k in range(8)] == ["hi", "[1, 2]", "a\nb", None, "raw", "raw", None, None]
    assert [got[k].calls for k in (2, 3, 4)] == [["t_1"], ["t2"], []]
    assert [got[k].only for k in range(8)] == [False, False, False, True, False, False, False, False]
    assert [got[k].tool for k in (4, 5, 2)] == ["t1", "t2", None] and [k for k in range(8) if got[k].result] == [4, 5]


def test_message_rewrites(spark):
    df = spark.createDataFrame([(k, json.dumps(m)) for k, m in enumerate(MESSAGES)], "k int, m string")
    out = {r.k: json.loads(r.x) for r in df.select("k", ms.replace_result(F.col("m"), F.lit("note"), F.lit("t_2")).alias("x")).collect()}
    assert out[4] == MESSAGES[4] and out[5]["message"]["content"] == [{"type": "text", "text": "note"}] and out[5]["_offloaded"] is True
    e = F.array(F.struct(F.lit("t1").alias("tool_call_id"), F.lit("c" * 400).alias("tool_call"), F.lit(None).cast("string").alias("node_id")))
    out = {r.k: json.loads(r.x) for r in df.select("k", ms.replace_calls(F.col("m"), e).alias("x")).collect()}
    call = out[2]["message"]["content"][1]["input"]
    assert call == {"_offloaded": True, "node_id": "N/A", "tool_call": "c" * 299 + "…"} and out[3] == MESSAGES[3]
    assert ms.tracked.func(pd.Series(['{"a": {"details": 1, "b": [{"_offloaded": true}]}}', "x", None])).tolist() == ['{"a":{"b":[{}]}}', "x", None]


def test_recursive_redaction(spark):
    deep = {"a": "password=abc ok"}
    for _ in range(12):
        deep = {"in": deep}
    value = {"apiKey": {"x": 1}, "list": list(range(150)), "text": "Bearer abcdefghijkl", "n": 1, "deep": deep}
    got = json.loads(spark.createDataFrame([(json.dumps(value),)], "v string").select(ms.redact_values(F.col("v"))).first()[0])
    assert got["apiKey"] == "[REDACTED]" and len(got["list"]) == 100 and got["text"] == "Bearer [REDACTED]" and got["n"] == 1
    assert "[TRUNCATED_DEPTH]" in json.dumps(got["deep"])
    same = "x <memory-context a>secret</memory-context> sk-abcdefghijklmnop y"
    assert ms.redact_text(same, 100) == spark.createDataFrame([(same,)], "v string").select(tx.redact(F.col("v"), 100)).first()[0]


def test_truth_of_values(spark):
    values = ["true", "false", "null", "0", "0.0", "1", '""', '"x"', "[]", "{}", "[0]", None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(ms.truthy(F.col("v"))).collect()]
    assert got == [True, False, False, False, False, True, False, True, False, False, True, False]


def test_host_parts(spark):
    parts = [("text", "a", None, None), ("text", "hidden", True, None), ("text", "made", None, True), ("file", "f", None, None), ("text", " ", None, None), ("text", "password=abcd", None, None)]
    df = spark.createDataFrame([(parts,)], "p array<struct<type: string, text: string, ignored: boolean, synthetic: boolean>>")
    assert df.select(ms.host_text(F.col("p"))).first()[0] == "a\npassword=[REDACTED]"
    ids = spark.range(1).select(ms.synthetic_id(F.lit("m"), F.lit("k"), F.lit("t")), ms.synthetic_id(F.lit("m"), F.lit("k"), F.lit("t")), ms.internal_assistant(F.lit("title"), F.lit(None), F.lit(None)), ms.internal_assistant(F.lit("x"), F.lit("build"), F.lit(False))).first()
    assert ids[0] == ids[1] and tuple(ids)[2:] == (True, False)


def test_cuts_and_widths(spark):
    text = lambda s, f: spark.createDataFrame([(s,)], "s string").select(f(F.col("s"))).first()[0]
    assert [text("a𝄞b", lambda c, n=n: tx.cut_utf16(c, n)) for n in (1, 2, 3, 4)] == ["a", "a", "a𝄞", "a𝄞b"]
    assert text("abcdef", lambda c: tx.truncate_utf16(c, 3)) == "abc..." and text("abc", lambda c: tx.truncate_utf16(c, 3)) == "abc"
    assert text("abcdef", lambda c: tx.truncate_chars(c, 5, "..")) == "abc.." and text("x" * 301, tx.compact_call) == "x" * 299 + "…" and text("x" * 300, tx.compact_call) == "x" * 300
    assert tx.fit_width("日本語", 8) == "日本語  " and tx.fit_width("日本語", 5) == "日本…" and tx.fit_width("a\nb", 3) == "a↵b"
    keys = spark.createDataFrame([("agent:me:s:1",), ("agent:me:x-swebench-w12/z",), ("agent::s",), ("user:a:b",), ("agent:a",)], "k string").select(tx.parse_session_key(F.col("k")).alias("p")).collect()
    assert [r.p and tuple(r.p) for r in keys] == [("me", "s_1"), ("me-w12", "x-swebench-w12_z"), None, None, None]


def test_clock_times():
    ms_ = lambda s: tx.parse_when(s, 0)
    assert tx.next_run_ms("03:00", ms_("2024-03-30T12:00:00+01:00"), "Europe/Berlin") == ms_("2024-03-31T03:00:00+02:00")
    assert tx.next_run_ms("02:30", ms_("2024-03-31T00:00:00+01:00"), "Europe/Berlin") == ms_("2024-03-31T03:00:00+02:00")  # left out
    assert tx.next_run_ms("02:30", ms_("2024-10-27T00:00:00+02:00"), "Europe/Berlin") == ms_("2024-10-27T02:30:00+02:00")  # the earlier one
    assert tx.next_run_ms("10:00", ms_("2024-10-27T10:00:00+01:00"), "Europe/Berlin") == ms_("2024-10-28T10:00:00+01:00")
    assert [tx.clean_time(x) for x in ("4:05", " 23:59 ", "24:00", "7", "1:2", "003:00")] == ["04:05", "23:59", "03:00", "03:00", "03:00", "03:00"]
    assert tx.parse_when("2d", 10**9) == 10**9 - 172_800_000 and tx.parse_when("90m", 10**9) == 10**9 - 5_400_000
    assert "Asia/Kolkata (UTC+05:30)" in tx.zone_sentence("Asia/Kolkata", 0)


def test_tokenizer(spark):
    t = tx.Tokenizer("/opt/tokenizers/byte_bpe_50k.tiktoken")
    if not __import__("os").path.exists(t.path):
        pytest.skip("no vocabulary files here")
    assert t.count("") == 0 and t.count("hello world") == 2 and t.count("<|endoftext|>abc") == 4
    got = [r[0] for r in spark.createDataFrame([("hello world",), (None,), ("",)], "s string").select(t.column(F.col("s"))).collect()]
    assert got == [2, None, 0]
