"""Upserts, deletes, retention and profile differences on tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as vec

#: Columns that a later row of the same id does not change.
L1_FIXED = ("session_key", "session_id", "created_time")
L0_FIXED = ("session_key", "session_id", "role")


def last_per_id(rows: DataFrame, seq: str, id_col: str = "record_id") -> DataFrame:
    """The row of each id that comes last by ``seq``; others are dropped before the shuffle."""
    order = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc(seq)))
    return rows.withColumn("_n", order).where(F.col("_n") == 1).drop("_n")


def upsert(old: DataFrame, new: DataFrame, fixed: tuple[str, ...], seq: str | None = None, id_col: str = "record_id") -> DataFrame:
    """``old`` with the rows of ``new``: a known id takes all columns but ``fixed`` ones.

    With ``seq`` the last of several new rows of an id wins.
    """
    columns = old.columns
    if seq is not None:
        new = last_per_id(new, seq, id_col)
    o = old.select(*(F.col(c).alias(f"o_{c}") for c in columns), F.lit(True).alias("o"))
    n = new.select(*(F.col(c).alias(f"n_{c}") for c in columns), F.lit(True).alias("n"))
    both = o.join(n, F.col(f"o_{id_col}") == F.col(f"n_{id_col}"), "full_outer")
    pick = lambda c: F.when(F.col("n").isNull() | (F.col("o").isNotNull() & F.lit(c in fixed)), F.col(f"o_{c}")).otherwise(F.col(f"n_{c}"))
    return both.select(*(pick(c).alias(c) for c in columns))


def upsert_l0(old: DataFrame, new: DataFrame, seq: str | None = None) -> DataFrame:
    return upsert(old, new, L0_FIXED, seq)


def upsert_l1(old: DataFrame, new: DataFrame, seq: str | None = None) -> DataFrame:
    return upsert(old, new, L1_FIXED, seq)


def delete(df: DataFrame, ids: DataFrame, id_col: str = "record_id") -> DataFrame:
    return df.join(ids.select(id_col), id_col, "left_anti")


def attach_embeddings(vectors: DataFrame, new: DataFrame, rows: DataFrame, time_col: str = "recorded_at") -> DataFrame:
    """Vectors with new ones (record_id, embedding): those of unknown ids and zeros are ignored."""
    ready = new.where(F.col("embedding").isNotNull() & vec.nonzero(F.col("embedding"))).join(rows.select("record_id", F.col(time_col).alias("updated_time")), "record_id")
    ready = ready.select("record_id", "embedding", "updated_time").dropDuplicates(["record_id"])
    return vectors.join(ready.select("record_id"), "record_id", "left_anti").unionByName(ready)


def insert_if_absent(known: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """The new rows whose key is not known yet, one for each key."""
    return new.dropDuplicates([key]).join(known.select(key), key, "left_anti")


@dataclass(frozen=True)
class Retention:
    """Guards of a retention pass: a table this small is left alone, and so is one that would
    lose more than eight tenths."""

    min_rows: int
    most_tenths: int = 8


L0_RETENTION, L1_RETENTION = Retention(50), Retention(20)


def retention_guard(df: DataFrame, time_col: str, cutoff, guard: Retention) -> DataFrame:
    """One row: total, expired, and allowed."""
    out = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(time_col) < cutoff).alias("expired"))
    fit = (F.col("total") > guard.min_rows) & (F.col("expired") > 0) & ~(F.col("expired") * 10 > F.col("total") * guard.most_tenths)
    return out.withColumn("allowed", fit)


def retain(df: DataFrame, time_col: str, cutoff, guard: Retention) -> DataFrame:
    """``df`` without its expired rows, or as it is if the guard refuses."""
    allowed = retention_guard(df, time_col, cutoff, guard).first()["allowed"]
    return df.where(~F.coalesce(F.col(time_col) < cutoff, F.lit(False))) if allowed else df


def changed(local: DataFrame, baseline: DataFrame, key: str = "id", digest: str = "content_md5") -> DataFrame:
    """Local rows that are new or whose digest differs from the baseline's."""
    old = baseline.select(F.col(key).alias("_k"), F.col(digest).alias("_d"))
    return local.join(old, F.col(key) == F.col("_k"), "left").where(~F.col(digest).eqNullSafe(F.col("_d"))).drop("_k", "_d")


def missing(baseline: DataFrame, local: DataFrame, key: str = "id") -> DataFrame:
    """Baseline rows that are no longer local."""
    return baseline.join(local.select(key), key, "left_anti")


def merge_states(old: DataFrame, new: DataFrame, key: str = "session_key") -> DataFrame:
    """Whole rows of ``new`` replace those of the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def changed_since(scenes: DataFrame, last, time_col: str = "updated") -> DataFrame:
    """Scenes updated after a time; those without a readable time count as changed."""
    return scenes.where(F.coalesce(F.try_to_timestamp(time_col) > F.try_to_timestamp(last), F.lit(True)))


def keep_newest(files: DataFrame, n: int, group: str, name: str = "filename") -> DataFrame:
    """The ``n`` last names of each group."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(name)))
    return files.withColumn("_n", rank).where(F.col("_n") <= n).drop("_n")


def profile_rows(files: DataFrame, scope: str) -> DataFrame:
    """(id, type, filename, content, content_md5) of profile files (type, filename, content)."""
    identity = F.sha2(F.concat_ws("\x00", F.lit(scope), "type", "filename").cast("binary"), 256)
    return files.select(identity.alias("id"), "type", "filename", "content", F.md5(F.col("content").cast("binary")).alias("content_md5"))


def verified(profiles: DataFrame) -> DataFrame:
    """Pulled profiles whose content has the digest that came with it."""
    return profiles.where(F.md5(F.col("content").cast("binary")) == F.col("content_md5"))


ACTIONS = ("none", "push", "delete", "pull", "remove", "conflict")


def reconcile(baseline: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """What a sync does with each profile of three tables (id, content_md5, version; local needs no version):
    (id, action, base_md5, local_md5, remote_md5, base_version, remote_version).

    Where local and remote are equal, or both gone, nothing is to do.  A side that is as the baseline
    takes the other's change: ``push`` or ``delete`` at the store, ``pull`` or ``remove`` here.  Where both
    changed, each in its own way, it is a ``conflict``, and neither is touched.  Ids are distinct in each table;
    rows without an id are not taken, and a null digest is one that equals no text's."""
    side = lambda df, name, *more: df.where(F.col("id").isNotNull()).select("id", F.coalesce("content_md5", F.lit("")).alias(f"{name}_md5"), *(F.col(c).cast("long").alias(f"{name}_{c}") for c in more))
    rows = side(baseline, "base", "version").join(side(local, "local"), "id", "full_outer").join(side(remote, "remote", "version"), "id", "full_outer")
    base, own, other = F.col("base_md5"), F.col("local_md5"), F.col("remote_md5")
    action = (
        F.when(own.eqNullSafe(other), "none")
        .when(other.eqNullSafe(base), F.when(own.isNull(), "delete").otherwise("push"))
        .when(own.eqNullSafe(base), F.when(other.isNull(), "remove").otherwise("pull"))
        .otherwise("conflict")
    )
    return rows.select("id", action.alias("action"), "base_md5", "local_md5", "remote_md5", "base_version", "remote_version")


def after_sync(plan: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """The next baseline (id, content_md5, version) when the actions of ``plan`` are done, or those of the ids in ``done``.

    A push makes the version after the one that the store had.  What is in conflict or was not done keeps
    its old baseline, so that the next sync decides on it again."""
    made = F.lit(True) if done is None else F.col("_done").isNotNull()
    rows = plan if done is None else plan.join(done.select("id", F.lit(True).alias("_done")).distinct(), "id", "left")
    held = (F.col("action") == "conflict") | (F.col("action").isin("push", "delete", "pull", "remove") & ~made)
    digest = F.when(held, F.col("base_md5")).when(F.col("action").isin("push", "delete"), F.col("local_md5")).otherwise(F.col("remote_md5"))
    pushed = F.greatest(F.coalesce("remote_version", F.lit(0)), F.coalesce("base_version", F.lit(0))) + 1
    version = F.when(held, F.col("base_version")).when(F.col("action") == "push", pushed).otherwise(F.col("remote_version"))
    return rows.select("id", digest.alias("content_md5"), version.alias("version")).where(F.col("content_md5").isNotNull())
