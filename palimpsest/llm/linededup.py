"""Cross-site boilerplate lines, by the number of distinct sites a line is on.

Each line hash has a HyperLogLog sketch of its sites; sketches merge by aggregation, on
the map side first, so a line on a third of all pages is a sketch for each task.  Lines
whose estimate is within ``SIGMAS`` relative errors of the threshold (one site at least)
get an exact distinct count; the rest is decided by the estimate.  Boilerplate lines are
then removed wherever they are.

Only DataFrame operations run.  Up to ``LITERAL_LINES`` boilerplate lines are a set in the
plan, so that texts are filtered where they are read; of more, the positions of removed lines
are joined back to the texts, by id and text hash.

Defined results: lines are split at \\n and compared without surrounding blanks; blank
lines are never boilerplate.  A row without a site adds none, but loses boilerplate
lines like any other.  A null text stays null; repeated rows are treated alike; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import apart
from .scratch import table

#: Distinct sites that make a line boilerplate.
MIN_SITES = 5
#: Binary logarithm of a sketch's registers, and relative errors that count as near.
LOG_REGISTERS, SIGMAS = 10, 4.0
#: Boilerplate lines that may be in the plan, and hashes of lines that may be broadcast; more are joined.
LITERAL_LINES, BROADCAST_LINES = 20_000, 500_000


def split_lines(text: Column) -> Column:
    return F.split(text, "\n")


def line_hash(line: Column) -> Column:
    """The hash of a line without surrounding blanks; null for a blank one."""
    bare = F.btrim(line, F.lit(" \t\r\x0b\x0c"))
    return F.when(bare != "", F.xxhash64(bare))


def boilerplate(docs: DataFrame, site_col: str = "source", text_col: str = "text", min_sites: int = MIN_SITES) -> DataFrame:
    """(line): hashes of the lines on at least ``min_sites`` distinct sites, as a table."""
    lines = docs.select(F.col(f"`{site_col}`").cast("string").alias("site"), F.explode(split_lines(F.col(f"`{text_col}`"))).alias("l")).select("site", line_hash(F.col("l")).alias("line")).where("line is not null and site is not null")
    spread = lines.groupBy("line").agg(F.hll_sketch_agg("site", LOG_REGISTERS).alias("sketch")).select("line", F.hll_sketch_estimate("sketch").alias("sites"))
    margin = max(1.0, SIGMAS * 1.04 / 2 ** (LOG_REGISTERS / 2) * min_sites)
    spread = table(spread.where(F.col("sites") >= min_sites - margin), "spread")
    sure = spread.where(F.col("sites") > min_sites + margin).select("line")
    near = spread.where(F.col("sites") <= min_sites + margin).select("line")
    near = F.broadcast(near) if near.count() <= BROADCAST_LINES else near
    exact = lines.join(near, "line", "left_semi").groupBy("line").agg(F.count_distinct("site").alias("sites")).where(F.col("sites") >= min_sites).select("line")
    return table(sure.union(exact), "boilerplate")


def remove_boilerplate(docs: DataFrame, site_col: str = "source", text_col: str = "text", id_col: str = "doc_id", min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with boilerplate lines cut from ``text_col``, and n_lines and n_removed
    (which win over columns of those names)."""
    return apart(docs, ("n_lines", "n_removed"), (site_col, text_col, id_col), lambda d, own: _cleaned(d, own(site_col), own(text_col), own(id_col), min_sites))


def _cleaned(docs: DataFrame, site_col: str, text_col: str, id_col: str, min_sites: int) -> DataFrame:
    found = boilerplate(docs, site_col, text_col, min_sites)
    n = found.count()
    text, own = F.col(f"`{text_col}`"), [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    if n <= LITERAL_LINES:
        known = [r[0] for r in found.collect()]
        lines = split_lines(text)
        stays = lambda x: F.coalesce(~line_hash(x).isin(known), F.lit(True))
        rows = docs.select(*(f"`{c}`" for c in own), F.struct(lines.alias("all"), (F.filter(lines, stays) if known else lines).alias("kept")).alias("_dedup"))
        size = lambda c: F.when(text.isNull(), 0).otherwise(F.size(f"_dedup.{c}"))
        clean = F.when(size("all") == size("kept"), text).otherwise(F.array_join("_dedup.kept", "\n"))
        return rows.select(*(clean.alias(c) if c == text_col else F.col(f"`{c}`") for c in own), size("all").alias("n_lines"), (size("all") - size("kept")).alias("n_removed"))
    found = F.broadcast(found) if n <= BROADCAST_LINES else found
    key = [F.col(f"`{id_col}`").alias("_id"), F.xxhash64(text).alias("_hash")]
    at = docs.select(*key, F.posexplode(split_lines(text)).alias("_at", "l")).select("_id", "_hash", "_at", line_hash(F.col("l")).alias("line")).where("line is not null")
    cut = at.join(found, "line", "left_semi").groupBy("_id", "_hash").agg(F.collect_set("_at").alias("_cut"))
    cut = cut.withColumnsRenamed({"_id": "_of", "_hash": "_is"})
    joined = docs.select(*(f"`{c}`" for c in own), F.xxhash64(text).alias("_hash")).join(cut, F.col(f"`{id_col}`").eqNullSafe(F.col("_of")) & (F.col("_hash") == F.col("_is")), "left")
    lines = split_lines(text)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_cut"))
    clean = F.when(F.col("_cut").isNull(), text).otherwise(F.array_join(F.transform(kept, lambda k: F.get(F.col("_lines"), k)), "\n"))
    joined = joined.withColumn("_lines", lines).withColumn("_clean", clean)
    columns = [F.col("_clean").alias(c) if c == text_col else F.col(f"`{c}`") for c in own]
    return joined.select(*columns, F.when(text.isNull(), 0).otherwise(F.size("_lines")).alias("n_lines"), F.when(F.col("_cut").isNull(), 0).otherwise(F.size("_cut")).alias("n_removed"))
