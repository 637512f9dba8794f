"""What models answer about offloaded tool results: summaries, judgements of tasks, and diagrams.

Answers are text with JSON in it somewhere; each function keeps the key columns of its table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

SCORE = 5.0


def _json(answers: DataFrame, text_col: str) -> tuple[list[str], DataFrame]:
    """The key columns, and the answers with ``_v``: the JSON of the text as a variant, or null."""
    keys = [c for c in answers.columns if c != text_col]
    found = answers.select("*", F.explode(F.array(tx.extract_json(F.col(text_col)))).alias("_j"))  # made once for all that is read of it
    return keys, found.select("*", F.explode(F.array(F.try_parse_json("_j"))).alias("_v")).drop("_j")


def _as(v: Column, path: str, kinds: tuple[str, ...], target: str) -> Column:
    """A field of a variant, if it is of one of some kinds."""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when(kind.rlike("^(" + "|".join(kinds) + ")"), F.try_variant_get(v, path, target))


def _text(v: Column, path: str) -> Column:
    return _as(v, path, ("STRING",), "string")


def _elements(v: Column, path: str) -> Column:
    """The elements of a list of a variant; none for anything else."""
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def summaries(answers: DataFrame, text_col: str = "answer") -> DataFrame:
    """(keys, pos, timestamp, tool_call, summary, tool_call_id, score, offloaded): the entries of a
    list that have an id; a score that is no number is ``SCORE``, missing texts are empty."""
    keys, rows = _json(answers, text_col)
    is_list = F.schema_of_variant("_v").startswith("ARRAY")
    rows = rows.where(is_list).select(*keys, F.posexplode(_elements(F.col("_v"), "$")).alias("pos", "e"))
    e = F.col("e")
    text = lambda c: F.coalesce(_text(e, f"$.{c}"), F.lit("")).alias(c)
    out = rows.select(
        *keys, "pos", text("timestamp"), text("tool_call"), text("summary"), text("tool_call_id"),
        F.coalesce(_as(e, "$.score", ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "double"), F.lit(SCORE)).alias("score"), F.to_json(F.try_variant_get(e, "$.offloaded", "variant")).alias("offloaded"),
    )
    return out.where("tool_call_id <> ''")


def judgements(answers: DataFrame, text_col: str = "answer") -> DataFrame:
    """(keys, task_completed, is_continuation, is_long_task, continuation_file, new_label); answers
    without any of the three flags are left out."""
    keys, rows = _json(answers, text_col)
    v = F.col("_v")
    there = lambda c: F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{c}", "variant")) != "VOID", F.lit(False))
    flag = lambda c: F.coalesce(_as(v, f"$.{c}", ("BOOLEAN",), "boolean"), F.lit(False))
    rows = rows.where(there("taskCompleted") | there("isContinuation") | there("isLongTask"))
    return rows.select(*keys, flag("taskCompleted").alias("task_completed"), flag("isContinuation").alias("is_continuation"), flag("isLongTask").alias("is_long_task"), _text(v, "$.continuationMmdFile").alias("continuation_file"), _text(v, "$.newTaskLabel").alias("new_label"))


def diagrams(answers: DataFrame, text_col: str = "answer") -> DataFrame:
    """(keys, replace, content, blocks, nodes): a whole diagram, or with ``replace`` the ranges of
    lines to splice in, and the nodes of tool calls.  Line numbers may be text; blocks without
    them are left out, and so are answers with neither JSON nor a diagram."""
    keys, rows = _json(answers, text_col)
    v, raw = F.col("_v"), F.col(text_col)
    rows = rows.where(v.isNotNull() | tx.mermaid(raw).isNotNull())
    replace = F.coalesce(_text(v, "$.file_action") == "replace", F.lit(False))
    own = _text(v, "$.mmd_content")
    content = F.when(~replace, F.coalesce(tx.mermaid(own), own, tx.mermaid(raw)))
    number = lambda b, c: F.coalesce(_as(b, f"$.{c}", ("BIGINT",), "bigint"), F.when(_text(b, f"$.{c}").rlike("^[+]?[0-9]+$"), _text(b, f"$.{c}").try_cast("bigint")))
    block = lambda b: F.struct(number(b, "start_line").alias("start_line"), number(b, "end_line").alias("end_line"), F.coalesce(tx.mermaid(_text(b, "$.content")), _text(b, "$.content"), F.lit("")).alias("content"))
    blocks = F.filter(F.transform(_elements(v, "$.replace_blocks"), block), lambda b: (b["start_line"] >= 0) & (b["end_line"] >= 0))
    held = F.coalesce(F.try_variant_get(v, "$.node_mapping", "map<string, variant>"), F.create_map().cast("map<string, variant>"))
    nodes = F.transform_values(F.map_filter(held, lambda k, x: F.schema_of_variant(x) == "STRING"), lambda k, x: x.cast("string"))
    return rows.select(*keys, replace.alias("replace"), content.alias("content"), blocks.alias("blocks"), nodes.alias("nodes"))
