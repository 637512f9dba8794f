"""Capture and triggers as streams with state per session.

Late rows are judged by each session's own high-water mark (``timestamp > cursor``), not by
a watermark of the whole stream, so one fast session never drops another's messages.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as tx
from ..operators.triggers import EVERY, warmup_positions

CAPTURED = "session_key string, record_id string, role string, message_text string, timestamp long"
FIRED = "session_key string, n long, at long"


class _Cursor(StatefulProcessor):
    """Rows after the session's cursor, in order; each advances it, and a replay adds none."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cursor = handle.getValueState("cursor", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at = self.cursor.get()[0] if self.cursor.exists() else None
        got = pd.concat(list(rows)).sort_values(["timestamp", "record_id"], kind="stable")
        if at is not None:
            got = got[got["timestamp"] > at]
        if len(got):
            self.cursor.update((int(got["timestamp"].max()),))
            yield got[["session_key", "record_id", "role", "message_text", "timestamp"]]

    def close(self) -> None:
        pass


class _Counter(StatefulProcessor):
    """A row whenever a session's count of conversations fires: 1, 2, 4, … apart, then steadily."""

    def __init__(self, every: int):
        self.every, self.early = every, warmup_positions(every)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.count.get()[0] if self.count.exists() else 0
        last, fired = self.early[-1] if self.early else 0, []
        for part in rows:
            for at in part["timestamp"].sort_values():
                n += 1
                if n in self.early or (n > last and (n - last) % self.every == 0):
                    fired.append((key[0], n, int(at)))
        self.count.update((n,))
        if fired:
            yield pd.DataFrame(fired, columns=["session_key", "n", "at"])

    def close(self) -> None:
        pass


def prepare(l0: DataFrame, patterns: tuple[str, ...] = ()) -> DataFrame:
    """What is captured of raw messages: user and assistant turns of sessions that are not
    skipped, sanitised, without images, past the gate."""
    clean = tx.sanitize(tx.strip_base64_images(F.col("message_text")))
    rows = l0.where(F.col("role").isin("user", "assistant") & ~tx.skip_session(F.col("session_key"), patterns)).withColumn("message_text", clean)
    return rows.where(tx.should_capture(F.col("message_text")))


def captured(stream: DataFrame) -> DataFrame:
    """New messages of a stream of L0 rows, each once."""
    return stream.select("session_key", "record_id", "role", "message_text", "timestamp").groupBy("session_key").transformWithStateInPandas(_Cursor(), CAPTURED, "Append", "None")


def fired(stream: DataFrame, every: int = EVERY) -> DataFrame:
    """Count triggers of a stream with session_key and timestamp."""
    return stream.select("session_key", "timestamp").groupBy("session_key").transformWithStateInPandas(_Counter(every), FIRED, "Append", "None")


def after_cursors(l0: DataFrame, cursors: DataFrame) -> DataFrame:
    """The batch form: rows after their session's last_captured_timestamp, all where it is 0 or missing."""
    at = cursors.select("session_key", F.col("last_captured_timestamp").alias("_at"))
    rows = l0.join(at, "session_key", "left")
    return rows.where(F.col("_at").isNull() | (F.col("_at") == 0) | (F.col("timestamp") > F.col("_at"))).drop("_at")


def advance(cursors: DataFrame, taken: DataFrame) -> DataFrame:
    """Cursors after rows were taken."""
    new = taken.groupBy("session_key").agg(F.max("timestamp").alias("last_captured_timestamp"))
    both = cursors.select("session_key", "last_captured_timestamp").unionByName(new)
    return both.groupBy("session_key").agg(F.max("last_captured_timestamp").alias("last_captured_timestamp"))
