"""From messages to facts: what is extracted, how answers are parsed, and what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schemas import MEMORY_TYPES, TYPE_ALIASES

WINDOW_ROWS, NEW_ROWS, BACKGROUND_ROWS, PER_SESSION = 50, 10, 5, 20


def newest_rows(l0: DataFrame, n: int = WINDOW_ROWS) -> DataFrame:
    """The newest ``n`` messages of each session, with ``back`` (1: the newest)."""
    back = F.row_number().over(Window.partitionBy("session_key").orderBy(F.desc("timestamp"), F.desc("record_id")))
    return l0.withColumn("back", back).where(F.col("back") <= n)


def drop_first(l0: DataFrame, n: int) -> DataFrame:
    """Without the first ``n`` raw messages of each session that has as many."""
    w = Window.partitionBy("session_key")
    place = F.row_number().over(w.orderBy("timestamp", "record_id"))
    rows = l0.withColumns({"_n": place, "_size": F.count(F.lit(1)).over(w)})
    return rows.where((F.lit(n) <= 0) | (F.col("_size") < n) | (F.col("_n") > n)).drop("_n", "_size")


def split_window(l0: DataFrame, new: int = NEW_ROWS, background: int = BACKGROUND_ROWS) -> DataFrame:
    """Messages that pass the gate, of each session the newest as ``new`` and those before as ``background``."""
    ok = newest_rows(l0).where(tx.should_extract_l1(F.col("message_text")))
    back = F.row_number().over(Window.partitionBy("session_key").orderBy("back"))
    return ok.withColumn("back", back).where(F.col("back") <= new + background).withColumn("part", F.when(F.col("back") <= new, "new").otherwise("background"))


def enough(l0: DataFrame) -> DataFrame:
    """(session_key, bytes, ok): whether a session's new messages suffice for an extraction."""
    size = F.sum(F.octet_length(tx.strip(F.col("message_text"))))
    return split_window(l0).where("part = 'new'").groupBy("session_key").agg(size.alias("bytes")).withColumn("ok", tx.enough_text(F.col("bytes")))


def valid_type(kind):
    """A memory type, by its name or an alias; null for others."""
    for alias, name in TYPE_ALIASES.items():
        kind = F.when(kind == alias, name).otherwise(kind)
    return F.when(kind.isin(*MEMORY_TYPES), kind)


def parse_memories(answers: DataFrame, text_col: str = "answer") -> DataFrame:
    """Facts in a model's answers: from the first [ to the last ], scenes with their memories;
    missing fields get defaults and unknown types are dropped."""
    body = tx.repair_json(F.regexp_extract(text_col, "(?s)(\\[.*\\])", 1))
    memory = "struct<content: string, type: string, priority: double, source_message_ids: array<string>, metadata: map<string, string>>"
    scenes = F.from_json(body, f"array<struct<scene_name: string, memories: array<{memory}>>>")
    keys = [c for c in answers.columns if c != text_col]
    rows = answers.select(*keys, F.posexplode(scenes).alias("scene_pos", "s")).select(*keys, "scene_pos", F.col("s.scene_name").alias("scene_name"), F.posexplode("s.memories").alias("pos", "m"))
    out = rows.select(
        *keys, "scene_pos", "pos", F.coalesce("scene_name", F.lit("未知情境")).alias("scene_name"), F.col("m.content").alias("content"), valid_type(F.coalesce("m.type", F.lit("episodic"))).alias("type"),
        F.coalesce("m.priority", F.lit(50.0)).alias("priority"), F.coalesce("m.source_message_ids", F.array().cast("array<string>")).alias("source_message_ids"), F.coalesce(F.to_json("m.metadata"), F.lit("{}")).alias("metadata_json"),
    )
    return out.where(F.col("type").isNotNull() & F.col("content").isNotNull() & (tx.strip(F.col("content")) != ""))


def parse_decisions(answers: DataFrame, text_col: str = "answer") -> DataFrame:
    """(record_id, pos, action, target_ids, merged_content, merged_type, merged_priority, merged_timestamps)."""
    kind = "array<struct<record_id: string, action: string, target_ids: array<string>, merged_content: string, merged_type: string, merged_priority: double, merged_timestamps: array<string>>>"
    keys = [c for c in answers.columns if c != text_col]
    rows = answers.select(*keys, F.posexplode(F.from_json(tx.repair_json(F.regexp_extract(text_col, "(?s)(\\[.*\\])", 1)), kind)).alias("pos", "d"))
    return rows.where(F.col("d.action").isin("store", "skip", "update", "merge")).select(*keys, "d.record_id", "pos", "d.action", F.coalesce("d.target_ids", F.array().cast("array<string>")).alias("target_ids"), "d.merged_content", valid_type(F.col("d.merged_type")).alias("merged_type"), "d.merged_priority", "d.merged_timestamps")


def limit_per_session(memories: DataFrame, n: int = PER_SESSION, order: str = "pos") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("session_key").orderBy(order))
    return memories.withColumn("_n", rank).where(F.col("_n") <= n).drop("_n")


def by_session(l0: DataFrame) -> DataFrame:
    """Sessions in order of their first message, with their messages in order."""
    rows = l0.groupBy("session_id").agg(F.min("timestamp").alias("first"), F.array_sort(F.collect_list(F.struct("timestamp", "record_id", "role", "message_text"))).alias("messages"))
    return rows.orderBy("first", "session_id")
