"""Offloading tool results of transcripts: summaries in chunks, task boundaries, diagrams and injection."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import joins, transcript

FLUSH_AT, PER_FLUSH, PER_CALL, ATTEMPTS = 4, 20, 5, 3
CONTEXT_SHARE = 0.2
# What a row says whose result could not be summarised.
DEGRADED = "[L1 degraded] "
PARAMS, RESULT = 200, 300


def ready(pairs: DataFrame, processed: DataFrame, force: bool = False) -> DataFrame:
    """Admitted tool pairs with their ``chunk``: of each session with enough of them (any, when
    forced) the first ``PER_FLUSH`` in order of arrival."""
    rows = joins.admit(pairs, processed)
    w = Window.partitionBy("session_id")
    n = F.row_number().over(w.orderBy("timestamp", "tool_call_id"))
    rows = rows.withColumns({"n": n, "_size": F.count(F.lit(1)).over(w)})
    rows = rows.where((F.col("n") <= PER_FLUSH) & (F.lit(force) | (F.col("_size") >= FLUSH_AT)))
    return rows.withColumn("chunk", F.floor((F.col("n") - 1) / PER_CALL).cast("int")).drop("n", "_size")


def summarise(chunks: DataFrame, call: Callable[[list[dict]], list[dict]], attempts: int = ATTEMPTS) -> DataFrame:
    """Offload entries of chunks from an injected model call, made where the chunk is.

    An answer counts if it has each asked id once; after ``attempts`` answers that do not,
    the chunk's rows are degraded: the call and the head of its result, with a score of 0.
    """
    cut = lambda x, most: x if len(x) <= most else x[: most - 3] + "..."

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["timestamp", "tool_call_id"], kind="stable")
        asked = rows[["tool_call_id", "tool_name", "params", "result"]].to_dict("records")
        ids, got = sorted(r["tool_call_id"] for r in asked), None
        for _ in range(attempts):
            try:
                answer = call(asked)
            except Exception:  # whatever a service raises is a failed attempt
                continue
            if sorted(a.get("tool_call_id", "") for a in answer) == ids:
                got = {a["tool_call_id"]: a for a in answer}
                break
        text = lambda r: f"{DEGRADED}{r.tool_name}: {cut(r.result or '', RESULT)}"
        call_ = lambda r: (got[r.tool_call_id].get("tool_call") if got else None) or f"{r.tool_name}({cut(r.params or '', PARAMS)})"
        out = [(r.session_id, r.timestamp, r.tool_call_id, call_(r), got[r.tool_call_id].get("summary", "") if got else text(r), float(got[r.tool_call_id].get("score", 5)) if got else 0.0) for r in rows.itertuples(index=False)]
        return pd.DataFrame(out, columns=["session_id", "timestamp", "tool_call_id", "tool_call", "summary", "score"])

    return chunks.groupBy("session_id", "chunk").applyInPandas(one, "session_id string, timestamp string, tool_call_id string, tool_call string, summary string, score double")


def boundaries(judged: DataFrame) -> DataFrame:
    """The last judgement of each place; one without a result is ``short``."""
    last = judged.groupBy("session_id", "start_index").agg(F.max_by(F.struct("result", "target"), "seq").alias("j"))
    return last.select("session_id", "start_index", F.coalesce("j.result", F.lit("short")).alias("result"), "j.target")


def diagram_candidates(entries: DataFrame, judged: DataFrame, now_s, retry_s: int = 120) -> DataFrame:
    """Entries for a task's diagram: without a node, or waiting for longer than the retry time,
    whose boundary is a long task with a target."""
    open_ = F.col("node_id").isNull() | ((F.col("node_id") == "wait") & (F.lit(now_s) - F.col("ts") >= retry_s))
    found = joins.asof(entries.where(open_), boundaries(judged), "session_id")
    return found.where((F.col("result") == "long") & F.col("target").isNotNull())


def inject(messages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Messages with each session's context block (session_id, content) at its place, in new positions."""
    own = messages.where(~F.coalesce(F.col("injected"), F.lit(False)))
    at = transcript.insertion_point(own).join(blocks.select("session_id", F.col("content").alias("_block")), "session_id")
    n = F.row_number().over(Window.partitionBy("session_id").orderBy("pos")) - 1
    rows = own.withColumn("_at", F.struct((n * 2 + 1).alias("a")))
    block = at.select("session_id", F.lit("user").alias("role"), F.col("_block").alias("content"), tx.tokens(F.col("_block")).alias("tokens"), F.lit(True).alias("injected"), F.struct((F.col("at") * 2).cast("int").alias("a")).alias("_at"))
    both = rows.unionByName(block, allowMissingColumns=True)
    return both.withColumn("pos", (F.row_number().over(Window.partitionBy("session_id").orderBy("_at")) - 1).cast(messages.schema["pos"].dataType)).drop("_at").select(*messages.columns)


def task_goal(diagram: Column) -> Column:
    """The goal in a diagram's first line, which is ``%%{…}%%``; empty without one."""
    head = F.regexp_extract(F.get(tx.lines_of(diagram), F.lit(0)), r"^%%(\{.*\})%%$", 1)
    return F.coalesce(F.get_json_object(head, "$.taskGoal"), F.lit(""))


def active_block(goal: Column, diagram: Column, file: Column | None = None) -> Column:
    """The text of an active task's block; null without a diagram."""
    name = F.lit("") if file is None else F.concat(F.lit("\nFile: "), file)
    return F.when(diagram.isNotNull(), F.concat(F.lit("Current task: "), F.coalesce(goal, F.lit("")), name, F.lit("\n```mermaid\n"), diagram, F.lit("\n```")))


def within_share(blocks: DataFrame, window: int, share: float = CONTEXT_SHARE) -> DataFrame:
    """Blocks (session_id, content) that take at most their share of the context window."""
    return blocks.where(tx.tokens(F.col("content")) <= int(window * share))


@dataclass
class Compression:
    """Messages after a compression, what it changed (:func:`transcript.changes`), the entries with the
    statuses that follow, and a report for each session (:func:`transcript.report`, with fast_replaced and
    fast_deleted: how many stored decisions were applied before)."""

    messages: DataFrame
    changes: DataFrame
    entries: DataFrame
    report: DataFrame


def compress(messages: DataFrame, entries: DataFrame, window: int, system: int = 0) -> Compression:
    """Stored decisions applied, then compression, and what both did.

    Entries whose statuses are stored make the next call take the same decisions before it
    looks at sizes: what was replaced stays replaced, and deleted tool messages do not come back.
    With a column ``context`` injected messages go to their places in what is left
    (:func:`transcript.reinserted`); without, they keep theirs."""
    fast = transcript.reapply(messages, entries)
    tokens = F.when(F.col("replaced"), tx.tokens(F.col("content"))).otherwise(F.col("tokens"))
    start = fast.withColumn("tokens", tokens.cast(messages.schema["tokens"].dataType)).select(*messages.columns)
    after, modes = transcript.compressed(start, window, entries, system)
    changed = transcript.changes(start, after, entries)
    again = fast.groupBy("session_id").agg(F.count_if("replaced").alias("fast_replaced"), F.count(F.lit(1)).alias("_left"))
    lost = messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("_had")).join(again, "session_id", "left")
    lost = lost.select("session_id", F.coalesce("fast_replaced", F.lit(0)).alias("fast_replaced"), (F.col("_had") - F.coalesce("_left", F.lit(0))).alias("fast_deleted"))
    report = transcript.report(start, after, changed, modes, system).join(lost, "session_id")
    if "context" in after.columns:
        after = transcript.reinserted(after)
    return Compression(after, changed, joins.mark_status(entries, transcript.statuses(changed)), report)


def before_prompt(messages: DataFrame, entries: DataFrame, blocks: DataFrame, window: int) -> DataFrame:
    """Stored decisions, then compression, then injection."""
    kept = transcript.reapply(messages, entries).drop("replaced").withColumn("tokens", tx.tokens(F.col("content"))).select(*messages.columns)
    return inject(transcript.compress(kept, window, entries), within_share(blocks, window))


def after_tool(messages: DataFrame, entries: DataFrame, blocks: DataFrame, window: int) -> DataFrame:
    """Stored decisions, then injection, then compression."""
    kept = transcript.reapply(messages, entries).drop("replaced").withColumn("tokens", tx.tokens(F.col("content"))).select(*messages.columns)
    return transcript.compress(inject(kept, within_share(blocks, window)), window, entries)
