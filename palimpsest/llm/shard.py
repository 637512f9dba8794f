"""Sharding with a permutation-filled lookup table.

Every shard prefers the slots of a prime-sized table in an order of its own (an offset
and a step from its name's hash).  Shards take turns; at its turn a shard claims its most
preferred free slot, until the table is full.  Shares differ by at most one slot, and a
changed list of shards moves few slots.  A row's key is hashed to a slot, and the table,
of a fixed size (a row per slot), is broadcast: placement is a constant-time look-up,
without a shuffle.

Defined results: null keys hash like any value (all to one slot) unless more key columns
tell them apart; equal keys share a shard; rows and columns stay as they are, and the
two result columns win over columns of the same names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import apart

#: Slots of the table: a prime, over 100 for each of the default shards.
SLOTS = 8191
SHARDS = 64


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard (its place in ``shards``) of each slot."""
    if slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"the number of slots must be a prime, not {slots}")
    if not 0 < len(shards) <= slots or len(set(shards)) < len(shards):
        raise ValueError("shards must be distinct names, at least one and no more than slots")
    at = [_number(f"offset {s}") % slots for s in shards]
    step = [_number(f"step {s}") % (slots - 1) + 1 for s in shards]
    table, free = [-1] * slots, slots
    while free:
        for k in range(len(shards)):
            if not free:
                break
            while table[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % slots
            table[at[k]] = k
            free -= 1
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """A key's slot, from the first 60 bits of the MD5 of its text; null counts as ''."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def assign_shards(docs: DataFrame, key_col: str = "doc_id", shards: list[str] | int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``docs`` with ``slot`` and ``shard`` (the place of its shard in the list)."""
    names = [f"shard-{k:05d}" for k in range(shards)] if isinstance(shards, int) else list(shards)
    table = docs.sparkSession.createDataFrame(list(enumerate(fill(names, slots))), "slot int, shard int")
    result = ("slot", "shard")

    def run(d: DataFrame, own) -> DataFrame:
        kept = [c for c in d.columns if not (key_col in result and c == own(key_col))]
        placed = d.withColumn("slot", slot_of(F.col(f"`{own(key_col)}`"), slots)).join(F.broadcast(table), "slot")
        return placed.select(*(f"`{c}`" for c in kept), *result)

    return apart(docs, result, (key_col,), run)


def write_shards(docs: DataFrame, path: str, key_col: str = "doc_id", shards: list[str] | int = SHARDS, slots: int = SLOTS, files: int = 1) -> None:
    """Write a folder per shard, each in ``files`` files (more for larger corpora)."""
    out = assign_shards(docs, key_col, shards, slots)
    n = shards if isinstance(shards, int) else len(shards)
    out.repartition(n * files, "shard", F.pmod("slot", F.lit(files))).write.partitionBy("shard").parquet(path)
