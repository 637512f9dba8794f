"""Keeping a memory folder in order: what is due for deletion, registries, and the store's settings.

Which files, rows and sessions go is decided on tables; removing files is left to the caller.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

DIAGRAMS_KEPT, LEAST_DAYS = 15, 3
REGISTRY = "session_key string, session_id string, offload_file string, updated_at string"


def expired_shards(files: DataFrame, cutoff_day: str) -> DataFrame:
    """(path, name, verdict) of shard files: ``delete`` before the day, ``keep``, or ``odd`` for a name
    that is no date; files that are no shards are left out."""
    base = F.regexp_extract("name", r"^(.*)\.jsonl?$", 1)
    day = F.when(base.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(base))
    verdict = F.when(day.isNull(), "odd").when(day < F.lit(cutoff_day).cast("date"), "delete").otherwise("keep")
    return files.where(F.col("name").rlike(r"\.jsonl?$")).select("path", "name", verdict.alias("verdict"))


def cleanup_counts(shards: DataFrame, removed_l0: int = 0, removed_l1: int = 0) -> DataFrame:
    """One row: files scanned, changed and odd, and the rows removed of each layer."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    out = shards.agg(F.count(F.lit(1)).alias("scanned_files"), n("delete").alias("changed_files"), n("odd").alias("skipped_files"))
    return out.withColumns({"removed_l0": F.lit(removed_l0), "removed_l1": F.lit(removed_l1)})


def offload_waste(files: DataFrame, references: DataFrame, active: DataFrame, now_ms: int, days: int) -> DataFrame:
    """Files of agents (agent, path, name, modified) that may go, with ``kind``; none below three days.

    Entry logs older than ``days`` go; references that no entry (agent, name) names, if as old; and
    of each agent's diagrams the oldest, if as old and not active (agent, name), as far as
    ``DIAGRAMS_KEPT`` are left."""
    if days < LEAST_DAYS:
        return files.limit(0).withColumn("kind", F.lit(""))
    old = F.col("modified") < now_ms - days * 86_400_000
    kind = F.when(F.col("name").rlike(r"^offload-.*\.jsonl$"), "entries").when(F.col("path").rlike(r"/refs/[^/]*\.md$"), "reference").when(F.col("path").rlike(r"/mmds/[^/]*\.mmd$"), "diagram")
    rows = files.withColumns({"kind": kind, "old": old}).where("kind is not null")
    entries = rows.where("kind = 'entries' and old")
    unused = rows.where("kind = 'reference' and old").join(references.select("agent", "name"), ["agent", "name"], "left_anti")
    diagrams = rows.where("kind = 'diagram'").withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("agent")))
    can_go = diagrams.where("old").join(active.select("agent", "name"), ["agent", "name"], "left_anti")
    place = F.row_number().over(Window.partitionBy("agent").orderBy("modified", "name"))
    extra = can_go.withColumn("n", place).where(F.col("n") <= F.col("size") - DIAGRAMS_KEPT)
    columns = [*files.columns, "kind"]
    return entries.select(*columns).unionByName(unused.select(*columns)).unionByName(extra.select(*columns))


def register_sessions(registry: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """The registry with sessions (session_key, session_id); a known key takes the new id and file."""
    rows = new.groupBy("session_key").agg(F.max("session_id").alias("session_id"))
    rows = rows.select("session_key", "session_id", F.concat(F.lit("offload-"), "session_id", F.lit(".jsonl")).alias("offload_file"), now.cast("string").alias("updated_at"))
    return registry.join(rows.select("session_key"), "session_key", "left_anti").select(*rows.columns).unionByName(rows)


def live_registry(registry: DataFrame, files: DataFrame, cutoff_ms: int) -> DataFrame:
    """Registry rows whose file (name) is there, or that name none, and that are not older than the
    cutoff; a time that cannot be read keeps its row."""
    there = registry.join(files.select(F.col("name").alias("offload_file")), "offload_file", "left_semi").unionByName(registry.where("offload_file is null"))
    at = tx.parse_time_ms(F.col("updated_at"))
    return there.where(F.coalesce(at >= cutoff_ms, F.lit(True))).select(*registry.columns)


def update_content(l1: DataFrame, record_id: str, content: str, now: str) -> DataFrame:
    """The row of a fact with new content and time; ``KeyError`` without one of that id."""
    row = l1.where(F.col("record_id") == record_id).limit(1)
    if row.isEmpty():
        raise KeyError(f"no fact {record_id}")
    return row.withColumns({"content": F.lit(content), "updated_time": F.lit(now)})


# ---- settings of a store, as JSON


@dataclass(frozen=True)
class EmbeddingMeta:
    provider: str
    model: str
    dimensions: int


def write_embedding_meta(meta: EmbeddingMeta) -> dict[str, str]:
    return {"embedding_provider_info": json.dumps(asdict(meta))}


def read_embedding_meta(values: dict[str, str]) -> EmbeddingMeta | None:
    """From the one JSON value, or from the three of older stores; ``ValueError`` if it is malformed."""
    try:
        if "embedding_provider_info" in values:
            return EmbeddingMeta(**json.loads(values["embedding_provider_info"]))
        if {"provider", "model", "dimensions"} <= set(values):
            return EmbeddingMeta(values["provider"], values["model"], int(values["dimensions"]))
    except TypeError as e:
        raise ValueError(f"malformed embedding settings: {e}") from e
    return None


def binding_changes(old: dict, new: dict) -> list[str]:
    """How a store's place differs from the one that its manifest names."""
    if old.get("type") != new.get("type"):
        return [f"store type changed: {old.get('type')} → {new.get('type')}"]
    return [f"{name} changed: {old.get(name)} → {new.get(name)}" for name in sorted(set(old) | set(new)) if old.get(name) != new.get(name)]


def merge_settings(base: dict, over: dict) -> dict:
    """``over`` on ``base``, level by level; a value of another type than the base's is refused."""
    out = dict(base)
    for key, value in over.items():
        held = out.get(key)
        if isinstance(held, dict) and isinstance(value, dict):
            out[key] = merge_settings(held, value)
        elif held is None or value is None or type(held) is type(value) or {type(held), type(value)} == {int, float}:
            out[key] = value
        else:
            raise ValueError(f"{key!r} must be of type {type(held).__name__}")
    return out
