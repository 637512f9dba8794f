"""Intermediate tables in the folder that all executors share.

A written table cuts the lineage, survives the loss of executors and can be reread by
column.  The folder is ``spark.checkpoint.dir``; only where that is unset in a local session
(tests, a notebook) a temporary folder of this machine takes its place.  Tables go when what
replaces them is written (:func:`drop`, :func:`drop_since`), the rest when the driver ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
_paths: dict[int, tuple[weakref.ref, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, without a trailing slash."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/palimpsest/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path


#: Rows of a few numbers that a file of :func:`table` may hold.
FILE_ROWS = 1_000_000


def table(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return it reread.

    A table of few numbers whose ``rows`` are known to be no more than that goes to as many files as
    there are cores, or one for each ``FILE_ROWS`` if that is more, not to one for each partition."""
    spark = df.sparkSession
    path = new_path(spark, name)
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = (weakref.ref(out), path)
    return out


def drop(*tables: DataFrame) -> None:
    """Remove tables that :func:`table` made and that nothing reads any more."""
    for df in tables:
        ref, path = _paths.pop(id(df), (None, None))
        if ref is not None and ref() is df:
            _remove(df.sparkSession, path)


def mark() -> int:
    """How many tables were made; for :func:`drop_since`."""
    return len(_made)


def drop_since(at: int, keep: DataFrame | None = None) -> None:
    """Remove the tables made since ``at``, but for ``keep``."""
    held = _paths.get(id(keep), (None, None))[1]
    for spark, path in _made[at:]:
        if path != held:
            _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def _clean() -> None:
    for spark, path in _made:
        try:
            _remove(spark, path)
        except Exception:  # the session may have ended before the interpreter does
            return
