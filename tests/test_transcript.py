"""Transcript compression against plain loops over the messages of one session."""

import math
import random

from pyspark.sql import functions as F

from palimpsest.operators import transcript

SCHEMA = "session_id string, pos int, role string, content string, tokens long, injected boolean, tool_id string, tool_calls array<string>"


def conversation(seed):
    """Rows of a session with calls, results, lone results and injected messages."""
    rng = random.Random(seed)
    out, open_calls = [], []
    for k in range(rng.randrange(1, 30)):
        kind = rng.choice(["user", "assistant", "call", "result", "system", "injected"] if seed % 3 else ["assistant", "call", "result"])
        tool, calls = None, None
        if kind == "call":
            calls = [f"c{k}_{j}" for j in range(rng.randrange(1, 3))]
            open_calls += calls
        if kind == "result":
            tool = rng.choice(open_calls) if open_calls and rng.random() < 0.8 else f"lone{k}"
        role = {"call": "assistant", "result": rng.choice(["tool", "toolResult"]), "injected": "user"}.get(kind, kind)
        out.append((f"s{seed}", k, role, f"m{k}", rng.choice([5, 40, 200, 200, 900]), kind == "injected", tool, calls))
    return out


def is_user(m):
    return m["role"] == "user"


def drop_groups(msgs, goal, left):
    removed = 0
    while left - removed > goal and len(msgs) > 2:
        users = [i for i, m in enumerate(msgs) if is_user(m)]
        guard = users[-1] if users else None
        taken, groups = [], []
        for i in range(1, len(msgs)):
            if i != guard and i not in taken and msgs[i]["role"] == "assistant" and msgs[i]["tool_calls"]:
                mine = [i]
                taken.append(i)
                for j in range(i + 1, len(msgs)):
                    if j != guard and j not in taken and msgs[j]["role"] in ("tool", "toolResult") and msgs[j]["tool_id"] in msgs[i]["tool_calls"]:
                        mine.append(j)
                        taken.append(j)
                groups.append(mine)
        for i in range(1, len(msgs) - 1):
            if i != guard and i not in taken and msgs[i]["role"] in ("tool", "toolResult", "assistant"):
                groups.append([i])
        groups.sort(key=lambda g: -sum(msgs[i]["tokens"] for i in g))
        if not groups or len(msgs) - len(groups[0]) < 2:
            break
        removed += sum(msgs[i]["tokens"] for i in groups[0])
        msgs[:] = [m for i, m in enumerate(msgs) if i not in groups[0]]
    return removed


def cut(msgs):
    users = [i for i, m in enumerate(msgs) if is_user(m)]
    rest = [(m["tokens"], i) for i, m in enumerate(msgs) if not users or i != users[-1]]
    if not rest or max(rest)[0] < 600:
        return 0
    before, i = max(rest)
    m = msgs[i]
    m["content"] = f"[Tool output truncated for context management. Original ~{before} tokens, role={m['role']}" + (f", id={m['tool_id']}]" if m["tool_id"] else "]")
    m["tokens"] = math.ceil(len(m["content"]) / 4)
    return before - m["tokens"]


def plain_emergency(rows, goal, system):
    every = [dict(zip(("session_id", "pos", "role", "content", "tokens", "injected", "tool_id", "tool_calls"), r, strict=True)) for r in rows]
    left = system + sum(m["tokens"] for m in every) + (len(every) + 1) // 2
    msgs = [m for m in every if not m["injected"]]
    while len(msgs) > 2 and left > goal:
        n = min(max(math.ceil(len(msgs) * min((left - goal) / left, 0.5)), 1), len(msgs) - 2)
        users = [i for i, m in enumerate(msgs) if is_user(m)]
        n = min(n, users[-1]) if users else n
        if n:
            left = max(0, left - sum(m["tokens"] for m in msgs[:n]))
            msgs = msgs[n:]
            continue
        size = len(msgs)
        left = max(0, left - drop_groups(msgs, goal, left))
        if len(msgs) == size:
            saved = cut(msgs)
            if not saved:
                break
            left = max(0, left - saved)
    return sorted((m["session_id"], m["pos"], m["content"], m["tokens"]) for m in [*msgs, *(m for m in every if m["injected"])])


def kept(df):
    return sorted((r.session_id, r.pos, r.content, r.tokens) for r in df.collect())


def test_emergency_is_the_plain_loop(spark):
    sessions = [conversation(k) for k in range(60)]
    df = spark.createDataFrame([r for s in sessions for r in s], SCHEMA)
    for window, system in ((1000, 0), (400, 50), (3000, 0), (100, 500)):
        goal = math.floor(window * 0.6)
        want = sorted(x for s in sessions for x in plain_emergency(s, goal, system))
        assert kept(transcript.emergency(df, window, system=system)) == want


def test_tail_deletion_is_the_plain_loop(spark):
    sessions = [conversation(k) for k in range(60)]
    df = spark.createDataFrame([r for s in sessions for r in s], SCHEMA)
    for need in (1, 200, 1000):
        want = []
        for s in sessions:
            every = [dict(zip(("session_id", "pos", "role", "content", "tokens", "injected", "tool_id", "tool_calls"), r, strict=True)) for r in s]
            msgs = [m for m in every if not m["injected"]]
            drop_groups(msgs, 0, need)
            want += [(m["session_id"], m["pos"], m["content"], m["tokens"]) for m in [*msgs, *(m for m in every if m["injected"])]]
        assert kept(transcript.tail_delete(df, need)) == sorted(want)


def plain_place(rows):
    n = len(rows)
    if n <= 2:
        return 0
    users = [i for i, r in enumerate(rows) if r[2] == "user" and not r[5]]
    if users and users[-1] >= n // 2:
        at = users[-1] + 1
    else:
        at = n
        while at > 0 and rows[at - 1][2] in ("tool", "toolResult", "assistant"):
            at -= 1
        at = min(max(at, n - 30), n - 1)
    while 0 < at < n and rows[at][2] in ("tool", "toolResult"):
        at -= 1
    return at


def test_insertion_point_is_the_plain_loop(spark):
    sessions = [conversation(k) for k in range(80)] + [[("long", k, "assistant" if k % 2 else "tool", "", 1, False, None, None) for k in range(70)]]
    df = spark.createDataFrame([r for s in sessions for r in s], SCHEMA)
    assert {r.session_id: r["at"] for r in transcript.insertion_point(df).collect()} == {s[0][0]: plain_place(s) for s in sessions}


def test_largest_message_spares_the_last_user_message(spark):
    rows = [("s", 0, "tool", "a", 700, False, "t1", None), ("s", 1, "assistant", "b", 700, False, None, None), ("s", 2, "user", "c", 9000, False, None, None), ("s", 3, "user", "d", 8000, True, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in transcript.largest_message(df).collect()] == [("s", 1, 700)]
    got = {r.pos: (r.content, r.tokens) for r in transcript.truncate_largest(df).collect()}
    assert got[1] == ("[Tool output truncated for context management. Original ~700 tokens, role=assistant]", 21) and got[0] == ("a", 700)
    assert transcript.truncate_largest(df.where("pos = 0")).first().content == "[Tool output truncated for context management. Original ~700 tokens, role=tool, id=t1]"
    assert transcript.largest_message(df, 701).count() == 0


def test_offloaded_results_name_node_and_reference(spark):
    m = spark.createDataFrame([("s", 0, "tool", "raw", 3, False, "a_1", None)], SCHEMA)
    e = spark.createDataFrame([("a1", "short", "n-1", "refs/x.md", "true")], "tool_call_id string, summary string, node_id string, result_ref string, offloaded string")
    want = "[Offloaded Tool Result | node: n-1]\nSummary: short\nresult_ref: refs/x.md (read this file for full tool call and raw result)"
    assert transcript.reapply(m, e).first().content == want


def test_logs_are_truncated_from_the_largest(spark):
    rng = random.Random(1)
    rows = [(f"f{k}", rng.choice([0, 1, 7, 100, 130, 5000])) for k in range(300)]
    df = spark.createDataFrame(rows, "name string, size long")
    for most in (0, 10, 1000, 100_000, 10**9):
        total, want = sum(n for _, n in rows), []
        for name, n in sorted(rows, key=lambda r: (-r[1], r[0])):
            if total <= most:
                break
            want.append(name)
            total -= n
        assert sorted(r.name for r in transcript.truncate_logs(df, most).collect()) == sorted(want)
    assert transcript.truncate_logs(df.limit(0), 5).count() == 0
    assert transcript.truncate_logs(df.where(F.col("size") == 0), -1).count() > 0


def test_history_is_the_plain_loop(spark):
    rng = random.Random(5)
    rows = [(f"s{k % 9}", k, rng.randrange(5, 200), rng.randrange(1, 60)) for k in range(120)]
    want = []
    for s in {r[0] for r in rows}:
        left = 300
        for _, seq, full, compact in sorted((r for r in rows if r[0] == s), key=lambda r: -r[1]):
            for form, n in (("full", full), ("compact", compact)):
                if n <= left:
                    want.append((s, seq, form))
                    left -= n
                    break
    got = transcript.build_history(spark.createDataFrame(rows, "session_id string, seq int, full_tokens long, compact_tokens long"), 300)
    assert sorted((r.session_id, r.seq, r.form) for r in got.collect()) == sorted(want)
