"""Injected messages put back one by one, against a plain loop over lists."""

import random

from palimpsest.operators import transcript

SCHEMA = "session_id string, pos int, role string, content string, tokens long, injected boolean, context string"


def plain(rows):
    """The order of positions that inserting each injected row into a list gives."""
    held = [r for r in rows if not r[5]]

    def point():
        size = len(held)
        if size <= 2:
            return 0
        users = [i for i, r in enumerate(held) if not r[5] and r[2] == "user"]
        if users and users[-1] >= size // 2:
            return users[-1] + 1
        start, i = size, size - 1
        while i >= 0 and (held[i][5] or held[i][2] in ("tool", "toolResult", "assistant")):
            start = start if held[i][5] else i
            i -= 1
        return min(max(start, size - 30), size - 1)

    for r in [r for r in rows if r[5]]:
        active = [i for i, x in enumerate(held) if x[6] == "active"]
        held.insert(active[0] if r[6] == "history" and active else point(), r)
    return [r[1] for r in held]


def test_several_injected_messages_of_a_session(spark):
    rng, rows = random.Random(4), []
    for s in range(150):
        n = rng.choice([0, 1, 2, 3, 5, 9, 40, 70])
        roles = rng.choice([["user", "assistant", "tool", "system"], ["assistant", "toolResult"], ["user", "system"], ["user", *["assistant"] * 30]])
        own = [(rng.choice(roles), False, None) for _ in range(n)] + [("user", True, rng.choice(["active", "history", "history"])) for _ in range(rng.randrange(4))]
        rng.shuffle(own)
        rows += [(str(s), 3 * k, role, f"{s}-{k}", 1, injected, context) for k, (role, injected, context) in enumerate(own)]
    got = {}
    for r in transcript.reinserted(spark.createDataFrame(rows, SCHEMA)).orderBy("session_id", "pos").collect():
        assert r.pos == len(got.setdefault(r.session_id, []))
        got[r.session_id].append(3 * int(r.content.split("-")[1]))
    sessions = {r[0] for r in rows}
    assert got == {s: plain([r for r in rows if r[0] == s]) for s in sessions}
    assert transcript.reinserted(spark.createDataFrame([], SCHEMA)).count() == 0
