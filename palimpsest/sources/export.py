"""Exports of tables with their schemas, and references of raw tool results."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def export(tables: dict[str, DataFrame], path: str, vectors: bool = False, vector_cols: tuple[str, ...] = ("vector", "embedding")) -> None:
    """Each table as JSON lines in a folder of its name, their schemas in ``schemas`` and their
    rows in ``meta``; vectors are left out unless asked for."""
    spark, rows = next(iter(tables.values())).sparkSession, []
    for name, df in tables.items():
        out = df if vectors else df.drop(*vector_cols)
        out.write.mode("overwrite").json(f"{path}/{name}")
        rows.append((name, json.dumps(json.loads(df.schema.json())), spark.read.schema(out.schema).json(f"{path}/{name}").count()))
    meta = spark.createDataFrame(rows, "collection string, schema string, documents long")
    meta.select("collection", "schema").coalesce(1).write.mode("overwrite").json(f"{path}/schemas")
    meta.select("collection", "documents").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def reference(timestamp: Column, tool: Column, call_id: Column) -> Column:
    """The relative path of a raw tool result: refs/<time>-<tool>-<id>.md, safe as a file name."""
    return F.concat(F.lit("refs/"), tx.safe_component(F.concat_ws("-", F.regexp_replace(timestamp, "[:.]", "-"), tool, call_id)), F.lit(".md"))


def write_references(pairs: DataFrame, path: str) -> DataFrame:
    """Raw results as text below ``path`` by their reference; entries with ``result_ref``."""
    rows = pairs.withColumn("result_ref", reference(F.col("timestamp"), F.col("tool_name"), F.col("tool_call_id")))
    rows.select("result_ref", "result").write.mode("append").partitionBy("result_ref").text(path)
    return rows.drop("result")
