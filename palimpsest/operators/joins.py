"""Joins of the layers: as-of, decisions, tool ids, pairing, and set tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def asof(entries: DataFrame, boundaries: DataFrame, on: str, at: str = "idx", start: str = "start_index") -> DataFrame:
    """Each entry with the last boundary of its group that starts at or before it.

    Both sides go through one sort by position: the last boundary seen is carried along, so
    no range of pairs is made.
    """
    columns = [c for c in boundaries.columns if c not in (on, start)]
    held = F.struct(F.col(start).alias(start), *(F.col(c) for c in columns))
    b = boundaries.select(on, F.col(start).cast("long").alias("_p"), F.lit(0).alias("_k"), held.alias("_b"), F.lit(None).cast(entries.select(F.struct("*")).schema[0].dataType).alias("_e"))
    e = entries.select(on, F.col(at).cast("long").alias("_p"), F.lit(1).alias("_k"), F.lit(None).cast(boundaries.select(held).schema[0].dataType).alias("_b"), F.struct("*").alias("_e"))
    so_far = Window.partitionBy(on).orderBy("_p", "_k").rowsBetween(Window.unboundedPreceding, 0)
    found = b.unionByName(e).withColumn("_last", F.last("_b", ignorenulls=True).over(so_far)).where(F.col("_k") == 1)
    return found.select("_e.*", *(F.col("_last").getField(c).alias(c) for c in (start, *columns)))


def decide(memories: DataFrame, decisions: DataFrame) -> DataFrame:
    """Memories with their decision; the last of an id wins, and without one it is ``store``."""
    last = decisions.groupBy("record_id").agg(F.max_by("action", "pos").alias("action"))
    return memories.join(last, "record_id", "left").withColumn("action", F.coalesce("action", F.lit("store")))


def by_tool_id(messages: DataFrame, entries: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Messages with columns of the entry of their tool id, or else of the id without ``_``."""
    once = lambda key: entries.select(key.alias("_key"), F.struct(*columns).alias("_e")).groupBy("_key").agg(F.min("_e").alias("_e"))
    exact = once(F.col("tool_call_id")).withColumnsRenamed({"_key": "_x", "_e": "_ex"})
    loose = once(tx.tool_id(F.col("tool_call_id"))).withColumnsRenamed({"_key": "_y", "_e": "_ey"})
    out = messages.join(exact, F.col("tool_id") == F.col("_x"), "left").join(loose, tx.tool_id(F.col("tool_id")) == F.col("_y"), "left")
    found = F.coalesce("_ex", "_ey")
    return out.select(*messages.columns, *(found.getField(c).alias(c) for c in columns))


def orphans(files: DataFrame, references: DataFrame, name: str = "name") -> DataFrame:
    """Files that nothing refers to."""
    return files.join(references.select(name), name, "left_anti")


def confirmed(entries: DataFrame, ids: DataFrame, key: str = "tool_call_id") -> DataFrame:
    """Entries whose id, raw or without ``_``, is in a set of ids (both forms of them)."""
    both = ids.select(F.explode(F.array_distinct(F.array(F.col(key), tx.tool_id(F.col(key))))).alias("_id")).distinct()
    own = entries.withColumn("_raw", F.col(key)).withColumn("_bare", tx.tool_id(F.col(key)))
    one = own.join(both, F.col("_raw") == F.col("_id"), "left_semi")
    other = own.join(both, F.col("_raw") == F.col("_id"), "left_anti").join(both, F.col("_bare") == F.col("_id"), "left_semi")
    return one.unionByName(other).drop("_raw", "_bare")


def mark_status(entries: DataFrame, updates: DataFrame) -> DataFrame:
    """Entries with ``offloaded`` from updates (tool_call_id, offloaded), by id or bare id."""
    bare = updates.select(tx.tool_id(F.col("tool_call_id")).alias("_k"), F.col("offloaded").alias("_new")).groupBy("_k").agg(F.max("_new").alias("_new"))
    out = entries.join(bare, tx.tool_id(F.col("tool_call_id")) == F.col("_k"), "left")
    return out.withColumn("offloaded", F.coalesce("_new", "offloaded")).drop("_k", "_new")


def map_nodes(entries: DataFrame, mapping: DataFrame, selected: DataFrame) -> DataFrame:
    """Entries with the node of a mapping (tool_call_id, node); selected ones without become ``wait``."""
    m = mapping.groupBy("tool_call_id").agg(F.max("node").alias("_node"))
    s = selected.select("tool_call_id").distinct().withColumn("_selected", F.lit(True))
    out = entries.join(m, "tool_call_id", "left").join(s, "tool_call_id", "left")
    return out.withColumn("node_id", F.coalesce("_node", F.when(F.col("_selected"), "wait"), "node_id")).drop("_node", "_selected")


def pairs(messages: DataFrame) -> DataFrame:
    """Tool results with the call before them: session, id, call_pos, result_pos.

    ``messages`` has session_id, pos, kind (``call`` or ``result``) and tool_id.
    """
    w = Window.partitionBy("session_id", "tool_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    before = F.max(F.when(F.col("kind") == "call", F.col("pos"))).over(w)
    found = messages.withColumn("call_pos", before).where((F.col("kind") == "result") & F.col("call_pos").isNotNull())
    return found.select("session_id", "tool_id", "call_pos", F.col("pos").alias("result_pos"))


def same_ids(left: DataFrame, right: DataFrame, group: str, key: str) -> DataFrame:
    """(group, ok): whether both sides have the same ids, each once."""
    a = left.select(group, F.col(key).alias("k"), F.lit(1).alias("l"), F.lit(0).alias("r"))
    b = right.select(group, F.col(key).alias("k"), F.lit(0).alias("l"), F.lit(1).alias("r"))
    each = a.unionByName(b).groupBy(group, "k").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    return each.groupBy(group).agg(F.min((F.col("l") == 1) & (F.col("r") == 1)).alias("ok"))


def parents(messages: DataFrame) -> DataFrame:
    """Completed assistant messages with their user message, the newest first."""
    a = messages.where((F.col("role") == "assistant") & F.col("completed").isNotNull()).select("session_id", F.col("id").alias("assistant_id"), "parent_id", "completed")
    u = messages.where(F.col("role") == "user").select(F.col("id").alias("user_id"), F.col("session_id").alias("_s"))
    found = a.join(u, (F.col("parent_id") == F.col("user_id")) & (F.col("session_id") == F.col("_s"))).drop("_s")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("completed"), "assistant_id")))


def diagrams_of(history: DataFrame, deleted: DataFrame) -> DataFrame:
    """History diagrams that share the prefix of a deleted entry's node."""
    prefix = deleted.where("node_id is not null").select(F.split("node_id", "-")[0].alias("prefix")).distinct()
    return history.join(prefix, "prefix", "left_semi")


def admit(pairs: DataFrame, processed: DataFrame) -> DataFrame:
    """Tool pairs to summarise: with an id, not about the heartbeat, not waiting for approval,
    not processed yet.  ``pairs`` has tool_call_id, params and result as JSON."""
    waiting = F.coalesce(F.get_json_object("result", "$.details.status") == "approval-pending", F.lit(False))
    rows = pairs.where((F.coalesce(F.col("tool_call_id"), F.lit("")) != "") & ~F.coalesce(F.col("params").contains("HEARTBEAT.md"), F.lit(False)) & ~waiting)
    return rows.join(processed.select("tool_call_id"), "tool_call_id", "left_anti")
