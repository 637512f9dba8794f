"""Removing files in two phases: first a table of what goes, then tasks that remove and report.

A run that ends in the middle leaves its table, and the next run goes on with what that has not
reported.  Nothing that is named again meanwhile is removed: a file goes only while the caller's
decision still holds it.  Registries and logs that name files are to be written first, so that
no row ever names a file that is gone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .versions import Versions

FIRST_MS, EVERY_MS, LEAST_DAYS = 5 * 60_000, 24 * 3_600_000, 3
PLAN = "path string, kind string"
REPORT = "path string, kind string, outcome string"


def next_run(start_ms: int, last_ms: int | None, days: int) -> int | None:
    """When the next pass is due: five minutes after the start, then a day after the last; never
    where files are kept for less than three days."""
    if days < LEAST_DAYS:
        return None
    return start_ms + FIRST_MS if last_ms is None else last_ms + EVERY_MS


def _remove(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """An outcome for each path: removed, absent (it was gone), or failed and why."""
    from pyarrow import fs

    for part in parts:
        out = []
        for path in part["path"]:
            try:
                at, name = fs.FileSystem.from_uri(path)
                at.delete_file(name)
                out.append("removed")
            except FileNotFoundError:
                out.append("absent")
            except Exception as e:  # one file's error is a row, the others go on
                out.append(f"failed: {e}"[:500])
        yield part.assign(outcome=out)


def remove(waste: DataFrame, work: str, tasks: int = 64) -> DataFrame:
    """Remove the files of ``waste`` (path as a URI, kind), with the plan and reports below ``work``; what was
    done with each: (path, kind, outcome), once for each path.

    An unfinished plan is finished together with the new one, as far as ``waste`` still holds its
    files; those that it does not are left, with the outcome ``kept``."""
    spark: SparkSession = waste.sparkSession
    versions = Versions(spark, f"{work}/versions")
    number, state = versions.read()
    asked = waste.where(F.col("path").isNotNull()).groupBy("path").agg(F.min("kind").alias("kind"))
    if state.get("plan") is None:
        state = {"plan": number + 1, "reports": []}
        asked.write.mode("overwrite").parquet(f"{work}/plan-{number + 1}")
        number = versions.commit(number, state)
    plan = spark.read.schema(PLAN).parquet(f"{work}/plan-{state['plan']}")
    rows = plan.unionByName(asked.join(plan, "path", "left_anti"))
    held = rows.join(asked.select("path", F.lit(True).alias("_held")), "path", "left")
    name = f"report-{state['plan']}-{number}"
    own = held.where("_held").select("path", "kind").repartition(tasks, "path").mapInPandas(_remove, REPORT)
    out = own.unionByName(held.where("_held is null").select("path", "kind", F.lit("kept").alias("outcome")))
    out.write.mode("overwrite").parquet(f"{work}/{name}")
    versions.commit(number, {"plan": None, "last": name})
    return spark.read.schema(REPORT).parquet(f"{work}/{name}")


def counts(report: DataFrame) -> DataFrame:
    """(kind, removed, kept, failed) of a report; files that were gone already count as removed, by a
    task that ran twice or by the run before."""
    n = lambda test: F.count_if(test)
    o = F.col("outcome")
    return report.groupBy("kind").agg(n(o.isin("removed", "absent")).alias("removed"), n(o == "kept").alias("kept"), n(o.startswith("failed")).alias("failed"))
