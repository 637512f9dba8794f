"""What a model decided on new facts, applied to the layer of facts as one set.

Decisions are taken in order (``pos``, anything sortable): ``store`` writes the fact, ``skip`` does not,
``update`` and ``merge`` remove their targets and write the fact with the merged fields that the
decision gives.  Several facts may name one target, a target may be missing, and it may be
another fact of the batch.  What a loop over the decisions would leave follows from a few
numbers for each id, so nothing runs in order:

* the last removal of the id: what was written before it is gone, and so is a row that was there
  before all decisions, however early the removal.  A fact that names itself is written after;
* the writes from there on: the last gives the content, and the first the columns that an
  upsert keeps, unless a row that was never removed has them.

A hot target (a fact that a third of a batch names) is a partial maximum, not a group.

Defined results: a fact without a decision is stored; of several decisions on a fact the last
counts; null or empty targets are none; a merged content, type, priority or trail that is null
leaves the fact's own; facts without an id are stored as they are, each on its own; an empty batch
changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

MERGED = ("content", "type", "priority", "timestamps")


@dataclass
class Resolution:
    """``l1`` after the decisions; ``written`` and ``removed`` tell the ids whose rows changed
    (a written one is not removed); ``stored`` tells how many decisions wrote."""

    l1: DataFrame
    written: DataFrame
    removed: DataFrame
    stored: DataFrame


def decided(facts: DataFrame, decisions: DataFrame, key: str = "record_id") -> DataFrame:
    """Facts with action and targets; merged fields in place of their own."""
    merged = [F.col(f"merged_{c}") for c in MERGED]
    last = decisions.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct("action", "target_ids", *merged), "pos").alias("_d"))
    rows = facts.join(last, F.col(key) == F.col("_key"), "left")
    action = F.coalesce("_d.action", F.lit("store"))
    change = action.isin("update", "merge")
    own = {c: F.coalesce(F.when(change, F.col(f"_d.merged_{c}")), F.col(c)) for c in MERGED}
    targets = F.when(change, F.filter("_d.target_ids", lambda x: x.isNotNull() & (x != "")))
    return rows.withColumns({**own, "action": action, "targets": F.coalesce(targets, F.array().cast("array<string>"))}).drop("_key", "_d")


def trail(timestamps) -> dict:
    """The columns of a time trail: its first entry, its least and its largest."""
    at = lambda c: F.coalesce(c, F.lit(""))
    return {"timestamp_str": at(F.get(timestamps, 0)), "timestamp_start": at(F.array_min(timestamps)), "timestamp_end": at(F.array_max(timestamps))}


def resolve(l1: DataFrame, facts: DataFrame, decisions: DataFrame) -> Resolution:
    """``facts`` are rows of L1 without the columns of a trail, but with ``timestamps`` and ``pos``."""
    rows = decided(facts, decisions)
    removals = rows.select("pos", F.explode("targets").alias("_id")).groupBy("_id").agg(F.max("pos").alias("_removed"))
    writes = rows.where("action <> 'skip'").withColumns(trail(F.col("timestamps")))
    left = writes.join(removals, F.col("record_id") == F.col("_id"), "left").where(F.col("_removed").isNull() | (F.col("pos") >= F.col("_removed")))
    columns, fixed = l1.columns, [c for c in l1.columns if c in store.L1_FIXED]
    named, bare = left.where("record_id is not null").select("pos", *columns), left.where("record_id is null").select(*columns)
    last = named.groupBy("record_id").agg(F.max_by(F.struct(*(c for c in columns if c not in ("record_id", *fixed))), "pos").alias("_l"), F.min_by(F.struct(*fixed), "pos").alias("_f"))
    new = last.select("record_id", "_l.*", "_f.*").select(*columns)
    kept = l1.join(removals, F.col("record_id") == F.col("_id"), "left_anti")
    gone = removals.select(F.col("_id").alias("record_id")).join(new.select("record_id"), "record_id", "left_anti")
    count = rows.agg(F.count_if(F.col("action") != "skip").alias("stored"), F.count(F.lit(1)).alias("extracted"))
    return Resolution(store.upsert_l1(kept, new).unionByName(bare), new.select("record_id"), gone, count)
