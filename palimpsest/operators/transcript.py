"""Transcripts: budgets, head deletion, cascades, insertion points and compression.

A transcript is rows (session_id, pos, role, tokens, …).  What depends on positions and
running sums is windows over a session; the loops that delete group by group run per
session in ``applyInPandas``, where a session is one agent's context and so bounded.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

#: Shares of the context window: where mild, aggressive and emergency compression begin,
#: and what an emergency aims at.
MILD, AGGRESSIVE, EMERGENCY, TARGET = 0.5, 0.85, 0.95, 0.6
MIN_LINE, LINE_SUFFIX = 40, "…（已截断）"
LEAST_TRUNCATED = 600
RESULTS = ("tool", "toolResult")
# What stands for a truncated message, and for a tool result that was offloaded.
TRUNCATED = ("[Tool output truncated for context management. Original ~", " tokens, role=")
OFFLOADED = "[Offloaded Tool Result | node: %s]\nSummary: %s\nresult_ref: %s (read this file for full tool call and raw result)"
CASCADE_STOP = 10
#: The share of a session's messages, from the head, that the mild step looks at, and the score of entries without one.
MILD_SCAN, MILD_SCORE = 0.7, 5.0


def _session(*order: str):
    return Window.partitionBy("session_id").orderBy(*order)


def cut_lines(lines: DataFrame, most: int, line: str = "line") -> DataFrame:
    """Lines of at most ``most`` characters; a longer one ends with a mark if that fits."""
    room = most - len(LINE_SUFFIX)
    head = F.concat(F.regexp_replace(F.substring(line, 1, room), "\\s+$", ""), F.lit(LINE_SUFFIX)) if room > 0 else F.substring(line, 1, most)
    return lines.withColumn(line, F.when(F.length(line) <= most, F.col(line)).otherwise(head))


def budget_lines(lines: DataFrame, total: int, group: str = "session_id", order: str = "rank", line: str = "line") -> DataFrame:
    """Lines while they fit ``total`` UTF-16 units with a separator between; the first that does
    not is cut if at least ``MIN_LINE`` units remain, and ends the list."""
    w = Window.partitionBy(group).orderBy(order)
    length = tx.utf16_length(F.col(line))
    used = F.coalesce(F.sum(length + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = lines.withColumn("_left", total - used).withColumn("_over", length > F.col("_left"))
    before = F.coalesce(F.max("_over").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    rows = rows.withColumn("_after", before).where(~F.col("_after") & (F.col("_left") > 0) & (~F.col("_over") | (F.col("_left") >= MIN_LINE)))
    head = F.regexp_replace(F.substring(F.col(line), F.lit(1), F.col("_left") - len(LINE_SUFFIX)), "\\s+$", "")
    cut = F.when(F.length(line) <= F.col("_left"), F.col(line)).otherwise(F.concat(head, F.lit(LINE_SUFFIX)))
    return rows.withColumn(line, F.when(F.col("_over"), cut).otherwise(F.col(line))).drop("_left", "_over", "_after")


def _injected() -> Column:
    return F.coalesce(F.col("injected"), F.lit(False))


def _own_user() -> Column:
    return (F.col("role") == "user") & ~_injected()


def last_user(messages: DataFrame) -> DataFrame:
    """With ``last_user``: the position of the session's last user message that was not injected."""
    return messages.withColumn("last_user", F.max(F.when(_own_user(), F.col("pos"))).over(Window.partitionBy("session_id")))


def delete_prefix(messages: DataFrame, need: Column) -> DataFrame:
    """With ``deleted``: the shortest head whose tokens reach ``need``, short of the last two
    messages and of the last user message.  A session that needs nothing loses nothing; one just
    at its limit needs 1 (see :func:`compress`) and so loses a message."""
    w = _session("pos")
    rows = messages.withColumn("_n", F.row_number().over(w)).withColumn("_sum", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_need", need)
    whole = Window.partitionBy("session_id")
    rows = rows.withColumns({"_size": F.count(F.lit(1)).over(whole), "_user": F.max(F.when(_own_user(), F.col("_n"))).over(whole), "_first": F.min(F.when(F.col("_sum") >= F.col("_need"), F.col("_n"))).over(whole)})
    most = F.least(F.col("_size") - 2, F.coalesce(F.col("_user") - 1, F.col("_size")))
    count = F.when(F.col("_need") <= 0, 0).otherwise(F.greatest(F.lit(0), F.least(F.coalesce("_first", "_size"), most)))
    return rows.withColumn("deleted", F.col("_n") <= count).drop("_n", "_sum", "_need", "_size", "_user", "_first")


def cascade(entries: DataFrame, start: int = 7, stop_at: int = CASCADE_STOP) -> DataFrame:
    """(session_id, threshold, replaced): the highest score threshold, from ``start`` down to 1,
    at which at least ``stop_at`` entries qualify, else 1."""
    marks = entries.groupBy("session_id").agg(*(F.count_if(F.col("score") >= t).alias(f"n{t}") for t in range(start, 0, -1)))
    threshold = F.lit(1)
    for t in range(2, start + 1):
        threshold = F.when(F.col(f"n{t}") >= stop_at, t).otherwise(threshold)
    count = F.coalesce(*(F.when(F.col("threshold") == t, F.col(f"n{t}")) for t in range(1, start + 1)))
    return marks.withColumn("threshold", threshold).withColumn("replaced", count).select("session_id", "threshold", "replaced")


def insertion_point(messages: DataFrame) -> DataFrame:
    """(session_id, at): where an active context goes, as a place among the messages.

    A session of at most two messages: at the start.  Else after the last user message, if that
    is in the second half (from ``size // 2`` on); else at the start of the trailing run of tool
    and assistant messages, but within the last 30 and not behind the last message.  From a tool
    result the place moves back to the next message that is none, or to the start.
    """
    whole = Window.partitionBy("session_id")
    rows = messages.withColumns({"n": F.row_number().over(_session("pos")) - 1, "size": F.count(F.lit(1)).over(whole)})
    ends = rows.groupBy("session_id").agg(F.max("size").alias("size"), F.max(F.when(_own_user(), F.col("n"))).alias("user"), F.max(F.when(~F.col("role").isin(*RESULTS, "assistant"), F.col("n"))).alias("other"), F.array_sort(F.collect_list(F.when(~F.col("role").isin(*RESULTS), F.col("n")))).alias("calm"))
    run = F.least(F.greatest(F.coalesce(F.col("other") + 1, F.lit(0)), F.col("size") - 30), F.col("size") - 1)
    start = F.when(F.col("user") >= F.floor(F.col("size") / 2), F.col("user") + 1).otherwise(run)
    back = F.coalesce(F.array_max(F.filter("calm", lambda n: n <= F.col("start"))), F.lit(0))
    at = F.when(F.col("size") <= 2, 0).when(F.col("start") >= F.col("size"), F.col("start")).otherwise(back)
    return ends.withColumn("start", start).select("session_id", at.cast("long").alias("at"))


def reinserted(messages: DataFrame) -> DataFrame:
    """Messages of a shortened transcript with the injected ones taken out and put where they belong
    in it, in new positions from 0.

    ``context`` tells of an injected message whether it is ``history`` or active.  They go in one after
    another, in the order that they had, each into what those before it left.  History goes before the first active
    one.  All else goes to the start of a session of at most two messages; or behind the last user message, if that is in
    the second half; or to the start of the trailing run of tool and assistant messages, which injected ones do
    not end, but within the last 30 and not behind the last message."""
    kind = F.when(_injected(), F.when(F.col("context") == "history", "h").otherwise("a")).when(F.col("role") == "user", "u").when(F.col("role").isin(*RESULTS, "assistant"), "t").otherwise("o")
    item = F.struct(F.col("pos").alias("p"), kind.alias("k"))
    lists = messages.groupBy("session_id").agg(F.array_sort(F.collect_list(item)).alias("all"))
    own, moved = F.filter("all", lambda x: ~x["k"].isin("h", "a")), F.filter("all", lambda x: x["k"].isin("h", "a"))

    def place(held: Column, new: Column) -> Column:
        size = F.size(held)
        where = lambda test: F.filter(F.transform(held, lambda x, i: F.when(test(x["k"], i), i)), lambda i: i.isNotNull())
        user, breaker = F.array_max(where(lambda k, i: k == "u")), F.coalesce(F.array_max(where(lambda k, i: k.isin("u", "o"))), F.lit(-1))
        run = F.coalesce(F.array_min(where(lambda k, i: (k == "t") & (i > breaker))), size)
        at = F.when(size <= 2, 0).when(user >= F.floor(size / 2), user + 1).otherwise(F.least(F.greatest(run, size - 30), size - 1))
        return F.when(new["k"] == "h", F.coalesce(F.array_min(where(lambda k, i: k == "a")), at)).otherwise(at)

    order = F.aggregate(moved, own, lambda held, new: F.when(F.size(held) == 0, F.array(new)).otherwise(F.array_insert(held, (place(held, new) + 1).cast("int"), new)))
    placed = lists.select("session_id", F.posexplode(order).alias("_at", "_x")).select("session_id", F.col("_x.p").alias("pos"), "_at")
    rows = messages.join(placed, ["session_id", "pos"])
    return rows.withColumn("pos", F.col("_at").cast(messages.schema["pos"].dataType)).select(*messages.columns)


def transcript_tokens(messages: DataFrame, system: int = 0) -> DataFrame:
    """(session_id, tokens): messages, half a token for each, and the system prompt."""
    return messages.groupBy("session_id").agg((F.sum("tokens") + F.ceil(F.count(F.lit(1)) * 0.5) + system).cast("long").alias("tokens"))


def largest_message(messages: DataFrame, least: int = LEAST_TRUNCATED) -> DataFrame:
    """(session_id, pos, tokens): the largest message of each session, if it has at least ``least``
    tokens; the later one of ties.  The last user message and injected ones do not count."""
    rows = last_user(messages).where(~_injected() & ~F.col("pos").eqNullSafe(F.col("last_user")))
    top = rows.groupBy("session_id").agg(F.max(F.struct("tokens", "pos")).alias("m"))
    return top.select("session_id", F.col("m.pos").alias("pos"), F.col("m.tokens").alias("tokens")).where(F.col("tokens") >= least)


def truncated_text(tokens: Column, role: Column, tool: Column | None = None) -> Column:
    """What stands for a message that was truncated."""
    id_ = F.lit("") if tool is None else F.coalesce(F.concat(F.lit(", id="), tool), F.lit(""))
    return F.concat(F.lit(TRUNCATED[0]), tokens.cast("string"), F.lit(TRUNCATED[1]), F.coalesce(role, F.lit("undefined")), id_, F.lit("]"))


def truncate_largest(messages: DataFrame, least: int = LEAST_TRUNCATED) -> DataFrame:
    """Messages with the content and tokens of each session's largest one replaced by a note."""
    top = largest_message(messages, least).select("session_id", F.col("pos").alias("_at"))
    rows = messages.join(top, "session_id", "left").withColumn("_hit", F.coalesce(F.col("pos") == F.col("_at"), F.lit(False)))
    note = truncated_text(F.col("tokens"), F.col("role"), F.col("tool_id") if "tool_id" in messages.columns else None)
    rows = rows.withColumn("content", F.when(F.col("_hit"), note).otherwise(F.col("content")))
    return rows.withColumn("tokens", F.when(F.col("_hit"), tx.tokens(F.col("content"))).otherwise(F.col("tokens")).cast(messages.schema["tokens"].dataType)).select(*messages.columns)


def truncate_logs(files: DataFrame, most: int) -> DataFrame:
    """Files (name, size) to truncate, the largest first, until the total is within ``most``.

    Sizes are summed by their power of two first; only the files of the one power in which the
    total comes within ``most`` are put in order.
    """
    power = F.when(F.col("size") > 0, F.floor(F.log2("size"))).otherwise(-1).cast("int")
    rows = files.withColumn("_power", power)
    sums = {r[0]: r[1] for r in rows.groupBy("_power").agg(F.sum("size")).collect()}  # 64 powers at most
    left, cut = sum(sums.values()), None
    for p in sorted(sums, reverse=True):
        if left <= most:
            break
        cut = p
        left -= sums[p]
    if cut is None:
        return files.limit(0)
    w = Window.partitionBy("_power").orderBy(F.desc("size"), "name").rowsBetween(Window.unboundedPreceding, -1)
    last = rows.where(F.col("_power") == cut).withColumn("_before", F.coalesce(F.sum("size").over(w), F.lit(0)))
    last = last.where(F.col("_before") < left + sums[cut] - most)
    return rows.where(F.col("_power") > cut).select(*files.columns).unionByName(last.select(*files.columns))


@dataclass
class _Message:
    """A message in the sequential steps; ``at`` is its row."""

    at: int
    role: str
    tokens: int
    tool: str | None
    calls: frozenset[str]
    note: str | None = None


def _listed(rows: pd.DataFrame) -> list[_Message]:
    """The messages of a session in order, those that were injected left out.

    An assistant's calls are its ``tool_calls``, or else its ``tool_id``.
    """
    out = []
    for at, r in zip(rows.index, rows.to_dict("records"), strict=True):
        if r.get("injected") is True:
            continue
        tool = r.get("tool_id")
        tool = tool if isinstance(tool, str) else None
        calls = r.get("tool_calls")
        calls = frozenset([] if tool is None else [tool]) if calls is None else frozenset(calls)
        result = r["role"] in RESULTS
        out.append(_Message(at, r["role"], int(r["tokens"]), tool if result or "tool_calls" in r else None, calls if r["role"] == "assistant" else frozenset()))
    return out


def _last_of(messages: list[_Message]) -> int | None:
    return max((k for k, m in enumerate(messages) if m.role == "user"), default=None)


def _costliest(messages: list[_Message]) -> list[int]:
    """The places of the group to delete next: a call with its later results, or a lone result or
    assistant message.  The first message, the last user message and (alone) the last one stay."""
    last, claimed, groups = _last_of(messages), set(), []
    for k, m in enumerate(messages):
        if k == 0 or k == last or k in claimed or not m.calls:
            continue
        own = [k] + [j for j in range(k + 1, len(messages)) if j not in claimed and j != last and messages[j].role in RESULTS and messages[j].tool in m.calls]
        claimed.update(own)
        groups.append(own)
    groups += [[k] for k, m in enumerate(messages) if 0 < k < len(messages) - 1 and k not in claimed and k != last and m.role in (*RESULTS, "assistant")]
    return max(groups, key=lambda g: sum(messages[k].tokens for k in g), default=[])


def _delete_tail(messages: list[_Message], need: int) -> int:
    """Delete groups, the costliest first, until ``need`` tokens are saved; the tokens saved."""
    saved = 0
    while saved < need and len(messages) > 2:
        group = _costliest(messages)
        if not group or len(messages) - len(group) < 2:
            break
        saved += sum(messages[k].tokens for k in group)
        for k in reversed(group):
            del messages[k]
    return saved


def _cut_largest(messages: list[_Message]) -> int:
    """Put a note in place of the largest message; the tokens saved."""
    last = _last_of(messages)
    places = [k for k in range(len(messages)) if k != last]
    if not places:
        return 0
    m = messages[max(places, key=lambda k: (messages[k].tokens, k))]
    if m.tokens < LEAST_TRUNCATED:
        return 0
    m.note = f"{TRUNCATED[0]}{m.tokens}{TRUNCATED[1]}{m.role or 'undefined'}{'' if m.tool is None else f', id={m.tool}'}]"
    before, m.tokens = m.tokens, tx.estimate(m.note)
    return max(0, before - m.tokens)


def _per_session(messages: DataFrame, run) -> DataFrame:
    """``run`` on the message list of each session and the tokens of its injected rows; rows as it leaves them."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos", kind="stable").reset_index(drop=True)
        listed = _listed(rows)
        own = {m.at for m in listed}
        run(listed, len(rows), int(rows["tokens"].sum()))
        for m in listed:
            if m.note is not None:
                rows.loc[m.at, "tokens"] = m.tokens
                if "content" in rows:
                    rows.loc[m.at, "content"] = m.note
        stay = {m.at for m in listed}
        return rows[[k in stay or k not in own for k in rows.index]]

    return messages.groupBy("session_id").applyInPandas(one, messages.schema)


def emergency(messages: DataFrame, window: int, target: float = TARGET, system: int = 0) -> DataFrame:
    """Rows kept of each session until its tokens (with half a token for each message, and the
    system prompt) are within the target.

    Each round deletes a share of the head, as large as the excess and at most half, rounded up,
    but neither the last two messages nor the last user message or what follows it.  Where no
    head may go, groups of the tail are deleted (:func:`tail_delete`); where none may, the largest
    message is cut.  Injected messages count, stay, and keep their place among the rest.
    """
    goal = math.floor(window * target)

    def run(listed: list[_Message], n: int, tokens: int) -> None:
        left = system + tokens + math.ceil(n * 0.5)
        while len(listed) > 2 and left > goal:
            count = min(max(1, math.ceil(len(listed) * min((left - goal) / left, 0.5))), len(listed) - 2)
            if (last := _last_of(listed)) is not None:
                count = min(count, last)
            if count:
                left = max(0, left - sum(m.tokens for m in listed[:count]))
                del listed[:count]
                continue
            before = len(listed)
            left = max(0, left - _delete_tail(listed, left - goal))
            if len(listed) == before:
                saved = _cut_largest(listed)
                if not saved:
                    return
                left = max(0, left - saved)

    return _per_session(messages, run)


def tail_delete(messages: DataFrame, need: int) -> DataFrame:
    """Rows kept after deleting tool groups (calls with their later results) and lone tool and
    assistant messages, the costliest first, until ``need`` tokens are saved or two messages
    would not be left.  The first message and the last user message stay; groups are made anew
    after each deletion."""
    return _per_session(messages, lambda listed, n, tokens: _delete_tail(listed, need))


def build_history(diagrams: DataFrame, most: int) -> DataFrame:
    """Diagrams (session_id, seq, full_tokens, compact_tokens) newest first within ``most``
    tokens, with ``form``: full, or compact where only that fits; those that do not fit are out."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        left, out = most, []
        for r in rows.sort_values("seq", ascending=False).itertuples(index=False):
            for form in ("full", "compact"):
                n = getattr(r, f"{form}_tokens")
                if n <= left:
                    out.append((*r, form))
                    left -= n
                    break
        return pd.DataFrame(out, columns=[*rows.columns, "form"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in diagrams.schema.fields) + ", form string"
    return diagrams.groupBy("session_id").applyInPandas(one, schema)


def _summary(entries: DataFrame) -> Column:
    """The text for an entry's result: its summary, with node and reference where entries have them."""
    if "result_ref" not in entries.columns:
        return F.col("summary")
    node = F.coalesce("node_id", F.lit("N/A")) if "node_id" in entries.columns else F.lit("N/A")
    return F.when(F.col("summary").isNotNull(), F.format_string(OFFLOADED, node, F.col("summary"), F.coalesce("result_ref", F.lit(""))))


def reapply(messages: DataFrame, entries: DataFrame) -> DataFrame:
    """Stored decisions on messages with a tool_id: ``deleted`` ones go, replaced ones get the
    entry's summary as content and ``replaced``."""
    from .joins import by_tool_id

    own = entries.select("tool_call_id", _summary(entries).alias("summary"), "offloaded")
    out = by_tool_id(messages, own, ("summary", "offloaded"))
    out = out.where(~F.coalesce(F.col("offloaded") == "deleted", F.lit(False)))
    hit = F.coalesce(F.col("offloaded") == "true", F.lit(False)) & F.col("summary").isNotNull()
    return out.withColumn("content", F.when(hit, F.col("summary")).otherwise(F.col("content"))).withColumn("replaced", hit).drop("summary", "offloaded")


def level(messages: DataFrame, window: int, system: int = 0) -> DataFrame:
    """(session_id, tokens, level): which compression a session's fill of the window asks for."""
    t = transcript_tokens(messages, system)
    share = lambda x: math.floor(window * x)
    return t.withColumn("level", F.when(F.col("tokens") >= share(EMERGENCY), "emergency").when(F.col("tokens") >= share(AGGRESSIVE), "aggressive").when(F.col("tokens") >= share(MILD), "mild").otherwise("none"))


def mild(messages: DataFrame, entries: DataFrame, window: int, system: int = 0) -> DataFrame:
    """Messages, with content and tokens of tool results in the head replaced by their entries'
    summaries where the session is mildly full, down to the score threshold of :func:`cascade`."""
    from .joins import by_tool_id

    if "tool_id" not in messages.columns:
        return messages
    score = F.col("score").cast("double") if "score" in entries.columns else F.lit(None).cast("double")
    rows = by_tool_id(messages, entries.select("tool_call_id", _summary(entries).alias("_summary"), F.coalesce(score, F.lit(MILD_SCORE)).alias("_score")), ("_summary", "_score"))
    rows = rows.withColumns({"_n": F.row_number().over(_session("pos")), "_size": F.count(F.lit(1)).over(Window.partitionBy("session_id"))})
    full = level(messages, window, system).where("level <> 'none'").select("session_id", F.lit(True).alias("_full"))
    tool = F.col("role").isin(*RESULTS) & (F.col("_n") <= F.floor(F.col("_size") * MILD_SCAN)) & F.col("_summary").isNotNull()
    rows = rows.join(full, "session_id", "left").withColumn("_fits", F.coalesce(F.col("_full") & tool & ~F.col("content").eqNullSafe(F.col("_summary")), F.lit(False)))
    # longer summaries replace, but do not count
    counted = rows.where(F.col("_fits") & (tx.utf16_length(F.col("_summary")) <= F.coalesce(tx.utf16_length(F.col("content")), F.lit(0))))
    until = cascade(counted.select("session_id", F.col("_score").alias("score"))).select("session_id", F.col("threshold").alias("_until"))
    rows = rows.join(until, "session_id", "left")
    hit = F.col("_fits") & (F.col("_score") >= F.coalesce("_until", F.lit(1)))
    own = {"content": F.when(hit, F.col("_summary")).otherwise(F.col("content")), "tokens": F.when(hit, tx.tokens(F.col("_summary"))).otherwise(F.col("tokens")).cast(messages.schema["tokens"].dataType)}
    return rows.withColumns(own).select(*messages.columns)


def compress(messages: DataFrame, window: int, entries: DataFrame | None = None, system: int = 0) -> DataFrame:
    """Transcripts after head deletion where a session is aggressively full, down to the aggressive
    share, summaries for tool results where it is still mildly full (with ``entries``), and
    emergency deletion where that leaves it above the emergency share.  Injected messages count
    and are not deleted."""
    return compressed(messages, window, entries, system)[0]


def compressed(messages: DataFrame, window: int, entries: DataFrame | None = None, system: int = 0) -> tuple[DataFrame, DataFrame]:
    """(messages of :func:`compress`, modes): modes has session_id and mode, the last of none, mild,
    aggressive and emergency that was applied (a session that was cut to the aggressive share stays so)."""
    full = level(messages, window, system)
    need = F.when(F.col("_level").isin("aggressive", "emergency"), F.greatest(F.col("_tokens") - math.floor(window * AGGRESSIVE), F.lit(1))).otherwise(0)
    rows = messages.join(full.select("session_id", F.col("tokens").alias("_tokens"), F.col("level").alias("_level")), "session_id")
    kept = delete_prefix(rows.where(~_injected()), need).where(~F.col("deleted")).select(*messages.columns)
    kept = kept.unionByName(messages.where(_injected()))
    if entries is not None:
        kept = mild(kept, entries, window, system)
    over = level(kept, window, system).where("level = 'emergency'").select("session_id")
    out = kept.join(over, "session_id", "left_anti").unionByName(emergency(kept.join(over, "session_id", "left_semi").select(*messages.columns), window, system=system))
    first = F.when(F.col("level") == "emergency", "aggressive").otherwise(F.col("level"))
    modes = full.join(over.withColumn("_over", F.lit(True)), "session_id", "left").select("session_id", F.when(F.col("_over"), "emergency").otherwise(first).alias("mode"))
    return out, modes


def changes(before: DataFrame, after: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """(session_id, pos, tool_id, change) of the messages that a compression changed: ``deleted``,
    ``replaced`` by the summary of their entry, or ``cut``.

    Messages are told by session and position, and their texts compared by a hash, so the contents are not
    shuffled.  Injected messages are never changed; without a column tool_id the ids are null."""
    tool = F.col("tool_id") if "tool_id" in before.columns else F.lit(None).cast("string")
    was = before.where(~_injected()).select("session_id", "pos", tool.alias("tool_id"), F.xxhash64("content").alias("_was"))
    now = after.where(~_injected()).select(F.col("session_id").alias("_s"), F.col("pos").alias("_p"), F.xxhash64("content").alias("_now"))
    both = was.join(now, F.col("session_id").eqNullSafe(F.col("_s")) & (F.col("pos") == F.col("_p")), "left").where(F.col("_now").isNull() | (F.col("_was") != F.col("_now")))
    if entries is None:
        both = both.withColumn("_summary", F.lit(None).cast("long"))
    else:
        from .joins import by_tool_id

        both = by_tool_id(both, entries.select("tool_call_id", F.xxhash64(_summary(entries)).alias("_summary")), ("_summary",))
    kind = F.when(F.col("_now").isNull(), "deleted").when(F.col("_summary") == F.col("_now"), "replaced").otherwise("cut")
    return both.select("session_id", "pos", "tool_id", kind.alias("change"))


def statuses(changed: DataFrame) -> DataFrame:
    """(tool_call_id, offloaded) that changes leave on entries: ``true`` for replaced ones, ``deleted`` for deleted."""
    own = changed.where("tool_id is not null and change in ('replaced', 'deleted')")
    return own.groupBy(F.col("tool_id").alias("tool_call_id")).agg(F.when(F.max(F.col("change") == "deleted"), "deleted").otherwise("true").alias("offloaded"))


def report(before: DataFrame, after: DataFrame, changed: DataFrame, modes: DataFrame, system: int = 0) -> DataFrame:
    """What a compression did to each session: mode, replaced, deleted, tokens_before, tokens_after, tokens_saved."""
    totals = lambda rows, name: transcript_tokens(rows, system).select("session_id", F.col("tokens").alias(name))
    count = lambda kind: F.count_if(F.col("change") == kind).alias(kind)
    own = changed.groupBy("session_id").agg(count("replaced"), count("deleted"))
    out = totals(before, "tokens_before").join(modes, "session_id").join(totals(after, "tokens_after"), "session_id", "left").join(own, "session_id", "left")
    left = F.coalesce("tokens_after", F.lit(system).cast("long"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("session_id", "mode", zero("replaced"), zero("deleted"), "tokens_before", left.alias("tokens_after"), F.greatest(F.lit(0), F.col("tokens_before") - left).cast("long").alias("tokens_saved"))
