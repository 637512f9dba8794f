"""The generic query surface: filters, field expressions, time ranges, sorting, pages, counts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx

_OPS = (">=", "<=", "!=", ">", "<", "=")


def l1_filter(l1: DataFrame, session_key: str | None = None, session_id: str | None = None, updated_after: str | None = None) -> DataFrame:
    """Facts by optional equality and a strict lower bound of updated_time, newest first."""
    for column, value in (("session_key", session_key), ("session_id", session_id)):
        if value is not None:
            l1 = l1.where(F.col(column) == value)
    if updated_after is not None:
        l1 = l1.where(F.col("updated_time") > updated_after)
    return l1.orderBy(F.desc("updated_time"), "record_id")


def newest(l0: DataFrame, session_key: str, limit: int) -> DataFrame:
    """A session's newest messages."""
    return l0.where(F.col("session_key") == session_key).orderBy(F.desc("recorded_at"), F.desc("record_id")).limit(limit)


def after_cursor(l0: DataFrame, session_key: str, cursor_ms: int | None, limit: int) -> DataFrame:
    """A session's newest messages strictly after a cursor; all of them without one."""
    rows = l0 if cursor_ms is None else l0.where(F.col("timestamp") > cursor_ms)
    return newest(rows, session_key, limit)


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", name).lower()


def parse_filter(expression: str) -> list[tuple[str, str, str]]:
    """``a>=1, b=x`` as (column, operator, value) triples."""
    out = []
    for part in filter(None, (p.strip() for p in expression.split(","))):
        found = re.fullmatch(r"(\w+)\s*(>=|<=|!=|>|<|=)\s*(.*)", part)
        if not found:
            raise ValueError(f"not a filter: {part!r}; operators are {' '.join(_OPS)}")
        out.append((snake(found[1]), found[2], found[3]))
    return out


def where(df: DataFrame, expression: str) -> DataFrame:
    """Rows that meet all parts of a filter expression; unknown columns are refused."""
    for column, op, value in parse_filter(expression):
        if column not in df.columns:
            raise ValueError(f"unknown column {column!r}; there are {', '.join(df.columns)}")
        typed: Column = F.lit(value)
        if isinstance(df.schema[column].dataType, T.NumericType):
            typed = F.lit(float(value)) if "." in value else F.lit(int(value))
        c = F.col(column)
        df = df.where({">=": c >= typed, "<=": c <= typed, "!=": c != typed, ">": c > typed, "<": c < typed, "=": c == typed}[op])
    return df


def time_range(df: DataFrame, column: str, since=None, until=None) -> DataFrame:
    """Rows from ``since`` to ``until``, both included."""
    if since is not None:
        df = df.where(F.col(column) >= since)
    return df if until is None else df.where(F.col(column) <= until)


def page(df: DataFrame, sort: str, limit: int, offset: int = 0, descending: bool = True, tie: str = "record_id") -> DataFrame:
    """A page in order of ``sort``, ties by ``tie``."""
    return df.orderBy(F.desc(sort) if descending else F.asc(sort), tie).offset(offset).limit(limit)


def counts(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def status(l0: DataFrame, l1: DataFrame) -> DataFrame:
    """Rows of both layers and active sessions, in one row each."""
    a = l0.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("session_key").alias("sessions")).selectExpr("'l0' as layer", "n", "sessions")
    b = l1.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("session_key").alias("sessions")).selectExpr("'l1' as layer", "n", "sessions")
    return a.unionByName(b)


def overview(l0: DataFrame, l1: DataFrame, scenes: DataFrame | None = None) -> DataFrame:
    """(layer, key, n): messages by role, facts by type, scenes and their heat."""
    out = l0.groupBy("role").agg(F.count(F.lit(1)).alias("n")).selectExpr("'l0' as layer", "role as key", "n")
    out = out.unionByName(l1.groupBy("type").agg(F.count(F.lit(1)).alias("n")).selectExpr("'l1' as layer", "type as key", "n"))
    if scenes is not None:
        out = out.unionByName(scenes.agg(F.count(F.lit(1)).alias("n")).selectExpr("'l2' as layer", "'scenes' as key", "n"))
        out = out.unionByName(scenes.agg(F.coalesce(F.sum("heat"), F.lit(0)).alias("n")).selectExpr("'l2' as layer", "'heat' as key", "n"))
    return out


def api_l0(l0: DataFrame) -> DataFrame:
    return l0.select(F.col("record_id").alias("recordId"), F.col("session_key").alias("sessionKey"), F.col("session_id").alias("sessionId"), "role", F.col("message_text").alias("content"), F.col("recorded_at").alias("recordedAt"), "timestamp")


def api_l1(l1: DataFrame) -> DataFrame:
    """Camel case, with the distinct non-empty times as a trail."""
    trail = F.array_distinct(F.filter(F.array("timestamp_str", "timestamp_start", "timestamp_end"), lambda x: x.isNotNull() & (x != "")))
    return l1.select(F.col("record_id").alias("recordId"), "content", "type", "priority", F.col("scene_name").alias("sceneName"), F.col("session_key").alias("sessionKey"), F.col("session_id").alias("sessionId"), trail.alias("timestamps"), F.col("created_time").alias("createdTime"), F.col("updated_time").alias("updatedTime"), F.col("metadata_json").alias("metadata"))


def memory_records(hits: DataFrame) -> DataFrame:
    """Facts of vector hits as records: metadata that is no JSON is empty, and the trail has the one
    time that a hit carries."""
    metadata = F.when(tx.json_value(F.col("metadata_json")).isNotNull(), F.col("metadata_json")).otherwise("{}")
    return hits.select("record_id", "content", "type", "priority", "scene_name", metadata.alias("metadata"), F.array("timestamp_str").alias("timestamps"), "session_key", "session_id")
