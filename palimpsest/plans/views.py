"""The layers as views over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def l0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as raw messages; times count from the conversation's number."""
    c = read(spark, sf_dir, "conversations")
    ts = F.col("conv_id") * 1_000_000 + F.col("turn") * 1000
    key = F.col("conv_id").cast("string")
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("record_id"), key.alias("session_key"), key.alias("session_id"), "role", F.col("text").alias("message_text"), tx.millis_to_iso(ts).alias("recorded_at"), ts.alias("timestamp"))


def l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as facts, of three types in turn, with a priority from their label."""
    d, q = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").select("doc_id", "quality")
    kind = F.get(F.array(F.lit("persona"), F.lit("episodic"), F.lit("instruction")), F.pmod("doc_id", F.lit(3)).cast("int"))
    at = lambda add: tx.millis_to_iso(F.col("doc_id") * 60_000 + add)
    return d.join(q, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("record_id"), F.col("text").alias("content"), kind.alias("type"), (50.0 + 10.0 * F.coalesce("quality", F.lit(0))).alias("priority"), F.col("source").alias("scene_name"),
        F.col("lang").alias("session_key"), F.concat_ws("-", "lang", F.pmod("doc_id", F.lit(10))).alias("session_id"), at(0).alias("timestamp_str"), at(0).alias("timestamp_start"), at(3_600_000).alias("timestamp_end"),
        at(0).alias("created_time"), at(1000).alias("updated_time"), F.lit("{}").alias("metadata_json"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("record_id"), "embedding")


def transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as messages of a transcript, with estimated tokens."""
    c = read(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("pos"), "role", F.col("text").alias("content"), tx.tokens(F.col("text")).alias("tokens"), F.lit(False).alias("injected"))


_ISO = "strftime(make_timestamp(({}) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ')"
L0_SQL = f"""l0 AS (SELECT conv_id || '-' || turn AS record_id, cast(conv_id AS varchar) AS session_key, cast(conv_id AS varchar) AS session_id, role, text AS message_text,
    {_ISO.format('conv_id * 1000000 + turn * 1000')} AS recorded_at, conv_id * 1000000 + turn * 1000 AS timestamp FROM conversations)"""
L1_SQL = f"""l1 AS (SELECT cast(d.doc_id AS varchar) AS record_id, text AS content, ['persona', 'episodic', 'instruction'][doc_id % 3 + 1] AS type, 50.0::double + 10.0::double * coalesce(quality, 0) AS priority, source AS scene_name,
    lang AS session_key, lang || '-' || doc_id % 10 AS session_id, {_ISO.format('doc_id * 60000')} AS timestamp_str, {_ISO.format('doc_id * 60000')} AS timestamp_start, {_ISO.format('doc_id * 60000 + 3600000')} AS timestamp_end,
    {_ISO.format('doc_id * 60000')} AS created_time, {_ISO.format('doc_id * 60000 + 1000')} AS updated_time, '{{}}' AS metadata_json FROM documents d LEFT JOIN labels USING (doc_id))"""
#: White space as the text functions trim it, for character classes of RE2.
BLANK_SQL = r"\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
TRANSCRIPT_SQL = r"""t AS (SELECT cast(conv_id AS varchar) AS session_id, turn AS pos, role, text AS content,
    cast(ceil(len(regexp_extract_all(text, '[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]')) / 1.7::double + (length(text) - len(regexp_extract_all(text, '[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]'))) / 4.0::double) AS bigint) AS tokens FROM conversations)"""


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^[{BLANK_SQL}]+|[{BLANK_SQL}]+$', '', 'g')"
