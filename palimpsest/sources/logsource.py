"""Daily logs of messages as a data source, for batches and streams.

Each shard's day is in its path, so bounds of day or time decide which files are opened, and a
session which lines are parsed.  Files are read in ranges of bytes; a line is of the range that it
begins in.  A stream remembers how far each file was read, up to the last whole line, so a line
that is still being written waits for its end.

The filters are options and not taken from the query: Spark 4.1 keeps what was pushed with the
loaded table, so that two branches of a query with different filters would both get the last one's rows.

    read(spark, "file:///data/memory", session="k", since=5)
    register(spark)
    spark.readStream.format("daily_logs").load("file:///data/memory")
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

RANGE = 64 << 20
BLOCK = 1 << 16
ROWS = "record_id string, session_key string, session_id string, role string, message_text string, recorded_at string, timestamp long, shard_date date"
_KEYS = ("id", "sessionKey", "sessionId", "role", "content", "recordedAt")
_DAY = re.compile(r"(\d{4}-\d{2}-\d{2})[^/]*(/[^/]*)?$")


def _day(path: str) -> date | None:
    found = _DAY.search(path)
    try:
        return date.fromisoformat(found[1]) if found else None
    except ValueError:
        return None


def _utc_day(ms: int) -> date:
    """The day of a time; one beyond the calendar is of its first or last."""
    days = ms // 86_400_000 + date(1970, 1, 1).toordinal()
    return date.fromordinal(min(max(days, date.min.toordinal()), date.max.toordinal()))


def _files(uri: str) -> dict[str, int]:
    """Sizes of the log files below a folder; names that begin with ``_`` or ``.`` are no logs."""
    from pyarrow import fs

    at, root = fs.FileSystem.from_uri(uri)
    found = at.get_file_info(fs.FileSelector(f"{root}/conversations", recursive=True, allow_not_found=True))
    return {f.path: f.size for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and f.base_name[0] not in "_."}


@dataclass
class _Range(InputPartition):
    path: str
    start: int
    end: int


def _ranges(path: str, start: int, end: int, size: int) -> list[_Range]:
    return [_Range(path, lo, min(lo + size, end)) for lo in range(start, end, size)]


def _text(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _row(line: bytes, day: date | None) -> tuple | None:
    """A message, or None of a line that is none."""
    try:
        got = json.loads(line)
    except ValueError:
        return None
    if not isinstance(got, dict):
        return None
    at = got.get("timestamp")
    if at is not None and (not isinstance(at, int) or isinstance(at, bool) or not -(1 << 63) <= at < 1 << 63):
        return None
    return (*(_text(got.get(k)) for k in _KEYS), at, day)


def _lines(at, part: _Range) -> Iterator[bytes]:
    """Lines that begin in a range; the last may end behind it."""
    with at.open_input_file(part.path) as f:
        place, rest = part.start, b""
        if part.start:  # what is before the first line's begin is of the range before
            f.seek(part.start - 1)
            while block := f.read(BLOCK):
                cut = block.find(b"\n")
                if cut >= 0:
                    rest, place = block[cut + 1 :], f.tell() - len(block) + cut + 1
                    break
            else:
                return
        while place < part.end:
            cut = rest.find(b"\n")
            if cut < 0:
                parts = [rest]
                while (block := f.read(BLOCK)) and b"\n" not in block:
                    parts.append(block)
                rest = b"".join([*parts, block])
                cut = rest.find(b"\n")
                if cut < 0:
                    if rest:
                        yield rest
                    return
            line, rest = rest[:cut], rest[cut + 1 :]
            place += cut + 1
            yield line


class _Reading:
    """What batches and streams share: the folder, and rows of a range that pass the filters."""

    def __init__(self, options: dict):
        self.uri, self.size = options["path"], int(options.get("rangebytes", RANGE))
        number = lambda name: int(options[name]) if name in options else None
        self.session, self.since, self.until = options.get("session"), number("since"), number("until")
        self.first, self.last = (date.fromisoformat(options[n]) if n in options else None for n in ("firstday", "lastday"))

    def read(self, partition: _Range) -> Iterator[tuple]:
        from pyarrow import fs

        at, _ = fs.FileSystem.from_uri(self.uri)
        day = _day(partition.path)
        # a key of plain letters stands in the line as it is
        plain = self.session.encode() if self.session and self.session.isascii() and self.session.replace("-", "").isalnum() else None
        for line in _lines(at, partition):
            if not line.strip() or (plain and plain not in line and b"\\" not in line):
                continue
            row = _row(line, day)
            if row is None or (self.session is not None and row[1] != self.session):
                continue
            at_ms = row[6]
            if at_ms is None and (self.since, self.until) != (None, None):
                continue
            if (self.since is None or at_ms >= self.since) and (self.until is None or at_ms <= self.until):
                yield row


class _Batch(_Reading, DataSourceReader):
    def _wanted(self, day: date | None) -> bool:
        """Whether a shard can hold wanted rows; its day is a local one, so times have a day's room."""
        if day is None:
            return self.first is None and self.last is None
        if (self.first and day < self.first) or (self.last and day > self.last):
            return False
        bounds = [(self.since, 1), (self.until, -1)]
        return all(v is None or (day - _utc_day(v)).days * sign >= -1 for v, sign in bounds)

    def partitions(self) -> list[InputPartition]:
        return [p for path, size in _files(self.uri).items() if self._wanted(_day(path)) for p in _ranges(path, 0, size, self.size)] or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        return super().read(partition) if partition.path else iter(())


class _Stream(_Reading, DataSourceStreamReader):
    """Offsets are the bytes read of each file; an entry for each file that the folder holds."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        at, _ = fs.FileSystem.from_uri(self.uri)
        out = {}
        for path, size in _files(self.uri).items():
            with at.open_input_file(path) as f:
                end = size
                while end > 0:  # back to the last line's end
                    lo = max(0, end - BLOCK)
                    f.seek(lo)
                    cut = f.read(end - lo).rfind(b"\n")
                    if cut >= 0:
                        end = lo + cut + 1
                        break
                    end = lo
            out[path] = end
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [p for path, stop in sorted(end.items()) for p in _ranges(path, start.get(path, 0), stop, self.size)]

    def commit(self, end: dict) -> None:
        pass


class DailyLogs(DataSource):
    """Messages below ``path``/conversations, a shard a day; lines that are no messages are left out.

    Options: ``session`` (its key), ``since`` and ``until`` (milliseconds, both included; rows without a
    time are then out), ``firstDay`` and ``lastDay`` (of shards, which those without a day in their path are not),
    and ``rangeBytes``, how much of a file a task reads.  A stream opens every file, whatever the bounds."""

    @classmethod
    def name(cls) -> str:
        return "daily_logs"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> _Batch:
        return _Batch(self.options)

    def streamReader(self, schema) -> _Stream:
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DailyLogs)


def read(spark: SparkSession, path: str, session: str | None = None, since: int | None = None, until: int | None = None, first_day: date | None = None, last_day: date | None = None) -> DataFrame:
    """Messages of the logs below ``path`` (a URI), by the options of :class:`DailyLogs`."""
    register(spark)
    chosen = {"session": session, "since": since, "until": until, "firstDay": first_day, "lastDay": last_day}
    return spark.read.format("daily_logs").options(**{k: str(v) for k, v in chosen.items() if v is not None}).load(path)
