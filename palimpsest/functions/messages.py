"""Accessors and rewrites of messages as JSON text, whose content is a string or a list of blocks.

Reads are Column expressions.  Rewrites keep every other field of any depth, which columns of a
fixed type cannot, and are Arrow-batched functions over the parsed JSON.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx

_BLOCKS = "array<struct<type: string, text: string, id: string>>"
CALLS = ("tool_use", "toolCall")
RESULTS = ("tool", "toolResult")
# Keys that are no part of a message for a token count, and keys whose values are secret.
BOOKKEEPING = ("_offloaded", "_mmdContextMessage", "_mmdInjection", "_contextOffloadProcessed", "details")
SECRET_KEYS = "(?i)(?:key|token|secret|password|passwd|authorization|cookie)"
DEPTH, ITEMS = 8, 100


# ---- reads


def view(raw: Column) -> Column:
    """The message, or the one that it wraps as ``message``."""
    return F.coalesce(F.get_json_object(raw, "$.message"), raw)


def role(raw: Column) -> Column:
    """The role of the message, of the wrapped one, or its type."""
    return F.coalesce(F.get_json_object(raw, "$.role"), F.get_json_object(raw, "$.message.role"), F.get_json_object(raw, "$.type"))


def result_id(raw: Column) -> Column:
    """The tool id of a result, in either spelling; null without one."""
    v = view(raw)
    return F.coalesce(F.get_json_object(v, "$.toolCallId"), F.get_json_object(v, "$.tool_call_id"))


def is_result(raw: Column) -> Column:
    return F.coalesce(F.get_json_object(view(raw), "$.role").isin(*RESULTS), F.lit(False))


def _content(raw: Column) -> Column:
    return F.get_json_object(view(raw), "$.content")


def _is_list(raw: Column) -> Column:
    """Whether the content is a list; a string that looks like one is not."""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(view(raw))).rlike(r"content: ARRAY<"), F.lit(False))


def blocks(raw: Column) -> Column:
    """Type, text and id of the blocks of a list; null for other content."""
    return F.when(_is_list(raw), F.from_json(_content(raw), _BLOCKS))


def text_content(raw: Column) -> Column:
    """The content, or its text blocks by lines; null if it has none."""
    texts = F.transform(F.filter(blocks(raw), lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"])
    return F.when(_is_list(raw), F.when(F.size(texts) > 0, F.array_join(texts, "\n"))).otherwise(_content(raw))


def call_ids(raw: Column) -> Column:
    """The ids of tool calls among the blocks."""
    found = F.filter(blocks(raw), lambda b: b["type"].isin(*CALLS) & b["id"].isNotNull())
    return F.coalesce(F.transform(found, lambda b: b["id"]), F.array().cast("array<string>"))


def only_calls(raw: Column) -> Column:
    """Whether an assistant's content is tool calls alone."""
    b = blocks(raw)
    return F.coalesce((F.get_json_object(view(raw), "$.role") == "assistant") & (F.size(b) > 0) & F.forall(b, lambda x: F.coalesce(x["type"].isin(*CALLS), F.lit(False))), F.lit(False))


def truthy(value: Column) -> Column:
    """Whether a JSON value counts as true: not null, false, 0, an empty string, list or object."""
    t = F.trim(value)
    number = F.when(t.rlike(r"^-?[0-9]"), t.try_cast("double"))
    return F.coalesce(~t.isin("null", "false", '""') & ~t.rlike(r"^(\[\s*\]|\{\s*\})$") & ~F.coalesce(number == 0, F.lit(False)) & (t != ""), F.lit(False))


# ---- rewrites


def _rewrite(f):
    """A function of one parsed message as a Column function; text that is no JSON stays."""

    def one(raw: str | None, *rest):
        try:
            return None if raw is None else json.dumps(f(json.loads(raw), *rest), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return raw

    return one


def _without_bookkeeping(x):
    if isinstance(x, dict):
        return {k: _without_bookkeeping(v) for k, v in x.items() if k not in BOOKKEEPING}
    return [_without_bookkeeping(v) for v in x] if isinstance(x, list) else x


@F.pandas_udf(T.StringType())
def tracked(raw: pd.Series) -> pd.Series:
    """Compact JSON without bookkeeping keys at any depth: what tokens are counted of."""
    return raw.map(_rewrite(_without_bookkeeping))


def redact_text(text: str, most: int, tag: str = "memory-context") -> str:
    """:func:`palimpsest.functions.text.redact` of one text, outside of columns."""
    text = re.sub(f"(?is)<{tag}\\b[^>]*>.*?</{tag}>", "", text)
    text = re.sub(f"(?i)</?{tag}\\b[^>]*>", "[REDACTED_MEMORY_TAG]", text)
    for pattern, by in tx.REDACTIONS:
        text = re.sub(pattern, by.replace("$1", r"\g<1>"), text)
    return text.strip()[:most]


def _redacted(x, most: int, depth: int = 0):
    if depth > DEPTH:
        return "[TRUNCATED_DEPTH]"
    if isinstance(x, str):
        return redact_text(x, most)
    if isinstance(x, list):
        return [_redacted(v, most, depth + 1) for v in x[:ITEMS]]
    if not isinstance(x, dict):
        return x
    return {k: "[REDACTED]" if re.search(SECRET_KEYS, k) else _redacted(v, most, depth + 1) for k, v in list(x.items())[:ITEMS]}


def redact_values(raw: Column, most: int = 40_000) -> Column:
    """JSON whose texts are redacted and whose values under secret keys are gone; lists and objects
    keep their first ``ITEMS``, and nothing is deeper than ``DEPTH``."""

    @F.pandas_udf(T.StringType())
    def run(x: pd.Series) -> pd.Series:
        return x.map(_rewrite(lambda v: _redacted(v, most)))

    return run(raw)


def _result(x: dict, note: str | None, tool: str | None):
    own = x["message"] if isinstance(x.get("message"), dict) else x
    held = own.get("toolCallId", own.get("tool_call_id"))
    if note is None or own.get("role") not in RESULTS or not isinstance(held, str) or held.replace("_", "") != (tool or "").replace("_", ""):
        return x
    own["content"] = [{"type": "text", "text": note}] if isinstance(own.get("content"), list) else note
    x["_offloaded"] = True
    return x


@F.pandas_udf(T.StringType())
def replace_result(raw: pd.Series, note: pd.Series, tool: pd.Series) -> pd.Series:
    """A tool result with ``note`` as its content, if it is of ``tool``; marked as offloaded."""
    one = _rewrite(_result)
    return pd.Series([one(*r) for r in zip(raw, note, tool, strict=True)], dtype=object)


def _calls(x: dict, entries):
    own = x["message"] if isinstance(x.get("message"), dict) else x
    if own.get("role") != "assistant" or not isinstance(own.get("content"), list):
        return x
    known = {}
    for e in entries if entries is not None else ():
        known[e["tool_call_id"]] = e
        known.setdefault(e["tool_call_id"].replace("_", ""), e)
    for b in own["content"]:
        if isinstance(b, dict) and b.get("type") in CALLS and isinstance(b.get("id"), str):
            if e := known.get(b["id"]) or known.get(b["id"].replace("_", "")):
                call = e["tool_call"] or ""
                b["arguments" if "arguments" in b else "input"] = {"_offloaded": True, "node_id": e["node_id"] or "N/A", "tool_call": call if len(call) <= 300 else call[:299] + "…"}
    return x


def replace_calls(raw: Column, entries: Column) -> Column:
    """An assistant's tool calls with the compact call of their entry as input.

    ``entries`` is an array of (tool_call_id, tool_call, node_id)."""

    @F.pandas_udf(T.StringType())
    def run(x: pd.Series, e: pd.Series) -> pd.Series:
        one = _rewrite(_calls)
        return pd.Series([one(*r) for r in zip(x, e, strict=True)], dtype=object)

    return run(raw, entries)


# ---- host messages


def host_text(parts: Column, most: int = 40_000) -> Column:
    """Text of host parts (type, text, ignored, synthetic): text only, redacted."""
    own = F.filter(parts, lambda p: (p["type"] == "text") & ~F.coalesce(p["ignored"], F.lit(False)) & ~F.coalesce(p["synthetic"], F.lit(False)) & (tx.strip(F.coalesce(p["text"], F.lit(""))) != ""))
    return tx.redact(F.array_join(F.transform(own, lambda p: p["text"]), "\n"), most)


def synthetic_id(message: Column, kind: Column, text: Column) -> Column:
    """The same id for the same text of the same kind in a message."""
    return F.concat(F.lit("memory_offload_"), F.substring(F.sha2(F.concat_ws("\x00", message, kind, text).cast("binary"), 256), 1, 20))


def internal_assistant(agent: Column, mode: Column, summary: Column) -> Column:
    return F.coalesce(agent.isin("compaction", "title"), F.lit(False)) | F.coalesce(mode == "compaction", F.lit(False)) | F.coalesce(summary, F.lit(False))


def recall_parts(body: Column, most: int = 40_000) -> Column:
    """(prepend, append) of a recall's answer, redacted: what goes before a turn, and to the system's text.

    An answer that counts its memories has the latter as ``context``, unless it names both; an older
    one has the former there."""
    field = lambda *names: F.coalesce(*(F.get_json_object(body, f"$.{n}") for n in names))
    counts, old = F.get_json_object(body, "$.memory_count").isNotNull(), F.get_json_object(body, "$.context")
    prepend = F.coalesce(field("prepend_context", "prependContext"), F.when(~counts, old), F.lit(""))
    append = F.coalesce(field("append_system_context", "appendSystemContext"), F.when(counts, old), F.lit(""))
    return F.struct(tx.redact(prepend, most).alias("prepend"), tx.redact(append, most).alias("append"))
