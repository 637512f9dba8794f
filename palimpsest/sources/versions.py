"""Versions of a small state, such as what files tables consist of.

Each version is a file that is written aside and renamed to its number, which fails where the
number is taken: of two writers that began at one version, one is refused and can try again on
what the other left.  A reader sees the newest whole version.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

KEPT = 20
TRIES = 10


class Conflict(RuntimeError):
    """The version was written by another."""


class Versions:
    """States below ``path``, the last ``KEPT`` of them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def _numbers(self) -> list[int]:
        if not self._fs.exists(self._at("")):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(self._at("")))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def read(self) -> tuple[int, dict]:
        """The newest number and state; 0 and an empty one before the first."""
        numbers = self._numbers()
        if not numbers:
            return 0, {}
        stream = self._fs.open(self._at(f"{numbers[-1]:012d}.json"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return numbers[-1], json.loads(text)

    def commit(self, after: int, state: dict) -> int:
        """Write the version after ``after``; :class:`Conflict` if there is one."""
        aside, place = self._at(f".{uuid4().hex}"), self._at(f"{after + 1:012d}.json")
        out = self._fs.create(aside, False)
        try:
            out.write(bytearray(json.dumps(state).encode()))
        finally:
            out.close()
        context = self._hadoop.FileContext.getFileContext(self._fs.makeQualified(place).toUri(), self.spark._jsc.hadoopConfiguration())
        rename = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0)
        try:
            context.rename(aside, place, rename)
        except Py4JJavaError as e:
            self._fs.delete(aside, False)
            if "AlreadyExists" in str(e.java_exception):
                raise Conflict(f"{self.path}: version {after + 1} is taken") from e
            raise
        for old in self._numbers()[:-KEPT]:
            self._fs.delete(self._at(f"{old:012d}.json"), False)
        return after + 1

    def change(self, step: Callable[[dict], dict | None]) -> dict:
        """The state after ``step``, which is asked again if another writer came first; nothing is
        written where it returns None."""
        for _ in range(TRIES):
            number, state = self.read()
            new = step(dict(state))
            if new is None:
                return state
            try:
                self.commit(number, new)
                return new
            except Conflict:
                continue
        raise Conflict(f"{self.path}: {TRIES} tries")
