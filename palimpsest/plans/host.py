"""Host transcripts: messages with parts, as the rows that compression works on, and back.

A host message is (session_id, pos, id, role, parts); a part has ``PART``'s fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import messages as ms
from ..functions import text as tx

PART = "struct<id: string, type: string, text: string, call_id: string, tool: string, status: string, input: string, output: string, error: string, ignored: boolean, synthetic: boolean, kind: string>"
HOST = f"session_id string, pos long, id string, role string, parts array<{PART}>"
CANONICAL = "session_id string, pos long, id string, role string, content string, tokens long, injected boolean, tool_id string, tool_calls array<string>"
_STEP = 1000


def _texts(parts: Column) -> Column:
    own = F.filter(parts, lambda p: p["type"].isin("text", "reasoning") & p["text"].isNotNull())
    return F.array_join(F.transform(own, lambda p: p["text"]), "\n")


def _tools(parts: Column) -> Column:
    return F.filter(parts, lambda p: (p["type"] == "tool") & (F.coalesce(p["call_id"], F.lit("")) != ""))


def canonical(host: DataFrame) -> DataFrame:
    """Rows of ``CANONICAL``: each message with its text and the ids of its tool calls, and after an
    assistant's message a ``tool`` row for each of its finished calls."""
    calls = F.when(F.col("role") == "assistant", F.transform(_tools(F.col("parts")), lambda p: p["call_id"])).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    row = lambda pos, id, role, content, tool_id, tool_calls: F.struct(pos.alias("pos"), id.alias("id"), role.alias("role"), content.alias("content"), tool_id.alias("tool_id"), tool_calls.alias("tool_calls"))
    own = row(F.col("pos") * _STEP, F.col("id"), F.col("role"), _texts(F.col("parts")), F.lit(None).cast("string"), calls)

    def result(p: Column, n: Column) -> Column:
        output = F.coalesce(F.when(p["status"] == "error", p["error"]).otherwise(p["output"]), F.lit(""))
        return row(F.col("pos") * _STEP + 1 + n, F.concat_ws(":", "id", F.coalesce(p["id"], p["call_id"])), F.lit("tool"), output, p["call_id"], none)

    done = F.when(F.col("role") == "assistant", F.filter(_tools(F.col("parts")), lambda p: p["status"].isin("completed", "error")))
    results = F.coalesce(F.transform(done, result), F.array().cast("array<struct<pos: bigint, id: string, role: string, content: string, tool_id: string, tool_calls: array<string>>>"))
    both = host.select("session_id", F.inline(F.concat(F.array(own), results))).withColumns({"tokens": tx.tokens(F.col("content")), "injected": F.lit(False)})
    return both.select(*(c.strip().split(" ")[0] for c in CANONICAL.split(", ")))


def _part(message: Column, kind: Column, text: Column) -> Column:
    null = F.lit(None).cast("string")
    given = {"id": ms.synthetic_id(message, kind, text), "type": F.lit("text"), "text": text, "synthetic": F.lit(True), "kind": kind, "ignored": F.lit(False)}
    names = [x.strip().split(":")[0] for x in PART.removeprefix("struct<").removesuffix(">").split(",")]
    return F.struct(*(given.get(n, null).alias(n) for n in names)).cast(PART)


def merged(host: DataFrame, rewritten: DataFrame) -> DataFrame:
    """Host messages after compression: those that are left, in the new order.

    A tool part stays if its call and its result are both left, with the result's text.  Text that
    compression added to a message becomes a synthetic part, and an injected row becomes one of
    the user message before it, or of the last one if there is none before."""
    # what is left of a session is one row, so that each side is dealt out once, by session
    row = F.struct("id", "pos", "content", "tool_calls", "injected", F.when(F.col("role").isin(*ms.RESULTS), F.col("tool_id")).alias("result"))
    left = rewritten.groupBy("session_id").agg(F.collect_list(row).alias("_left"))
    results = F.transform(F.filter("_left", lambda r: r["result"].isNotNull()), lambda r: F.struct(r["result"].alias("tool_id"), r["content"].alias("content")))
    injected = F.transform(F.filter("_left", lambda r: r["injected"] & (r["content"] != "")), lambda r: F.struct(r["pos"].alias("p"), r["content"].alias("c")))
    left = left.select("session_id", "_left", F.map_from_entries(F.array_distinct(results)).alias("_results"), F.array_sort(injected).alias("_injected"))
    rows = host.join(left, "session_id").select("session_id", "id", "role", "parts", "_results", "_injected", F.explode(F.filter("_left", lambda r: r["id"] == F.col("id"))).alias("_own"))
    rows = rows.select("*", F.col("_own.pos").alias("_at"), F.col("_own.content").alias("_text"), F.col("_own.tool_calls").alias("_calls"))
    known = F.col("_results")
    calls = F.coalesce("_calls", F.array().cast("array<string>"))
    assistant = F.col("role") == "assistant"

    def stays(p: Column) -> Column:
        return ~assistant | (p["type"] != "tool") | p["call_id"].isNull() | (F.array_contains(calls, p["call_id"]) & F.map_contains_key(known, p["call_id"]))

    def filled(p: Column) -> Column:
        text = F.element_at(known, F.coalesce(p["call_id"], F.lit("")))
        own = (p["type"] == "tool") & text.isNotNull()
        return p.withField("output", F.when(own & p["output"].isNotNull(), text).otherwise(p["output"])).withField("error", F.when(own & p["output"].isNull() & p["error"].isNotNull(), text).otherwise(p["error"]))

    parts = F.transform(F.filter("parts", stays), filled)
    old = _texts(F.col("parts"))
    more = F.when((old != "") & F.col("_text").startswith(old), tx.strip(F.substring(F.col("_text"), F.length(old) + 1, F.length("_text")))).otherwise(F.col("_text"))
    more = F.when(assistant & (F.col("_text") != old), more)
    summary = F.when(F.coalesce(more, F.lit("")) != "", F.array(_part(F.col("id"), F.lit("tool-summary"), more))).otherwise(F.array().cast(f"array<{PART}>"))
    return _with_injected(rows.select("session_id", F.col("_at").alias("pos"), "id", "role", F.concat(parts, summary).alias("parts"), "_injected"))


def _with_injected(host: DataFrame) -> DataFrame:
    """Each of a session's ``_injected`` (p, c) as a part of the last user message up to its place, or of the session's last."""
    session = Window.partitionBy("session_id")
    user = F.when(F.col("role") == "user", F.col("pos"))
    following = F.last(user, ignorenulls=True).over(session.orderBy(F.desc("pos"), F.desc("id")).rowsBetween(Window.unboundedPreceding, -1))
    rows = host.withColumns({"_next": following, "_first": F.min(user).over(session)})

    def here(x: Column) -> Column:
        early = F.coalesce(x["p"] < F.col("_first"), F.lit(True))
        return F.when(F.col("_next").isNull(), early | (x["p"] >= F.col("pos"))).otherwise((x["p"] >= F.col("pos")) & (x["p"] < F.col("_next")))

    more = F.when(F.col("role") == "user", F.filter("_injected", here))
    extra = F.transform(F.coalesce(more, F.array().cast("array<struct<p: bigint, c: string>>")), lambda x: _part(F.col("id"), F.lit("active"), x["c"]))
    return rows.select("session_id", "pos", "id", "role", F.concat("parts", extra).alias("parts"))


def latest_user(host: DataFrame, created: str = "created") -> DataFrame:
    """(session_id, id): the newest user message of each session, the largest id of equal times."""
    return host.where("role = 'user'").groupBy("session_id").agg(F.max(F.struct(F.coalesce(created, F.lit(0)).alias("at"), "id")).getField("id").alias("id"))
