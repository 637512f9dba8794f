"""Append-only JSON-lines logs of messages, facts and offload entries, in daily shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as tx


def _jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed rows with ``shard_date`` from the file's name; lines that do not parse are left out."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"(\d{4}-\d{2}-\d{2})[^/]*(/[^/]*)?$", 1)  # of the file, or of its folder
    lines = spark.read.text(path).select("value", F.try_to_date(F.nullif(name, F.lit(""))).alias("shard_date"))
    rows = lines.select(F.from_json("value", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"), "shard_date")
    return rows.where("r is not null and r._bad is null").select("r.*", "shard_date").drop("_bad")


def read_messages(spark: SparkSession, base_dir: str, session_key: str | None = None) -> DataFrame:
    """Raw messages of all shards, or of one session, as L0 rows in order of time."""
    rows = _jsonl(spark, f"{base_dir}/conversations/", schemas.L0_JSON)
    rows = rows.select(F.col("id").alias("record_id"), F.col("sessionKey").alias("session_key"), F.col("sessionId").alias("session_id"), "role", F.col("content").alias("message_text"), F.col("recordedAt").alias("recorded_at"), "timestamp")
    return rows if session_key is None else rows.where(F.col("session_key") == session_key).orderBy("timestamp", "record_id")


def append_messages(l0: DataFrame, base_dir: str, zone: str = "UTC") -> None:
    """Append L0 rows to the shards of their local days."""
    day = F.date_format(F.from_utc_timestamp(F.timestamp_millis("timestamp"), zone), "yyyy-MM-dd")
    rows = l0.select(F.col("session_key").alias("sessionKey"), F.col("session_id").alias("sessionId"), F.col("recorded_at").alias("recordedAt"), F.col("record_id").alias("id"), "role", F.col("message_text").alias("content"), "timestamp", day.alias("shard"))
    rows.write.mode("append").partitionBy("shard").json(f"{base_dir}/conversations")


def read_facts(spark: SparkSession, base_dir: str, session_key: str | None = None) -> DataFrame:
    """Facts of all shards, or of one session, as L1 rows in order of creation."""
    rows = _jsonl(spark, f"{base_dir}/records/", schemas.L1_JSON)
    trail = F.col("timestamps")
    rows = rows.select(
        F.col("id").alias("record_id"), "content", "type", "priority", "scene_name", F.col("sessionKey").alias("session_key"), F.col("sessionId").alias("session_id"), F.coalesce(F.get(trail, F.lit(0)), F.lit("")).alias("timestamp_str"),
        F.coalesce(F.array_min(trail), F.lit("")).alias("timestamp_start"), F.coalesce(F.array_max(trail), F.lit("")).alias("timestamp_end"), F.col("createdAt").alias("created_time"), F.col("updatedAt").alias("updated_time"), F.coalesce("metadata", F.lit("{}")).alias("metadata_json"),
    )
    return rows if session_key is None else rows.where(F.col("session_key") == session_key).orderBy("created_time", "record_id")


def append_facts(l1: DataFrame, base_dir: str) -> None:
    trail = F.array_distinct(F.filter(F.array("timestamp_str", "timestamp_start", "timestamp_end"), lambda x: x.isNotNull() & (x != "")))
    rows = l1.select(F.col("record_id").alias("id"), "content", "type", "priority", "scene_name", F.array().cast("array<string>").alias("source_message_ids"), F.col("metadata_json").alias("metadata"), trail.alias("timestamps"), F.col("created_time").alias("createdAt"), F.col("updated_time").alias("updatedAt"), F.col("session_key").alias("sessionKey"), F.col("session_id").alias("sessionId"), F.substring("created_time", 1, 10).alias("shard"))
    rows.write.mode("append").partitionBy("shard").json(f"{base_dir}/records")


def read_values(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): lines that are JSON, as variants."""
    return spark.read.text(path).select(F.col("value").alias("line"), tx.json_value(F.col("value")).alias("value")).where("value is not null")


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Offload entries with an id, with ``idx``, their order in each file."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("idx", "line"))
    rows = lines.select("file", "idx", F.from_json("line", schemas.OFFLOAD_ENTRY).alias("e")).where("e is not null").select("file", "idx", "e.*")
    return rows.where((F.col("tool_call_id") != ""))


def append_entries(entries: DataFrame, path: str) -> None:
    entries.where(F.coalesce(F.col("tool_call_id"), F.lit("")) != "").write.mode("append").json(path)


def rewrite_entries(entries: DataFrame, path: str) -> None:
    """Replace an entry log by a whole one; it is written beside the old and then takes its place."""
    spark = entries.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    staged = f"{path.rstrip('/')}.staged"
    entries.where(F.coalesce(F.col("tool_call_id"), F.lit("")) != "").write.mode("overwrite").json(staged)
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(hadoop(path), True)
    if not fs.rename(hadoop(staged), hadoop(path)):
        raise OSError(f"{staged} could not take the place of {path}")


def mark_entries(spark: SparkSession, path: str, updates: DataFrame) -> None:
    """Keep decisions (tool_call_id, offloaded) in an entry log; it is only rewritten if one changes."""
    from ..operators.joins import mark_status

    old = spark.read.schema(schemas.OFFLOAD_ENTRY).json(path)
    new = mark_status(old, updates)
    if not new.exceptAll(old).isEmpty():
        rewrite_entries(new, path)


def degraded_summary(tool: Column, params: Column, result: Column) -> Column:
    """(tool_call, summary) for a tool pair that could not be summarised: a short call and its result's head."""
    call = F.concat(tool, F.lit("("), tx.truncate_chars(F.coalesce(params, F.lit("")), 200, "..."), F.lit(")"))
    summary = F.concat(F.lit("[L1 degraded] "), tool, F.lit(": "), tx.truncate_chars(F.coalesce(result, F.lit("")), 300, "..."))
    return F.struct(call.alias("tool_call"), summary.alias("summary"))
