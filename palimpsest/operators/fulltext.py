"""A full-text index that is kept up: postings in segments, which changes add and merges replace.

A segment holds the postings (term, id, tf, dl) of one batch by hash of the term, and its documents
(id, dl).  A document that comes again or goes leaves its old postings where they are; the pair
(segment, id) is noted as dead.  Documents and words of the living are counted as they change, so
a query reads the postings of its own terms and the dead, and no text.  ``FAN`` segments of one
size class become one, without their dead, so there are a few for each factor of ``FAN`` in size.
"""

from __future__ import annotations

import math
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.versions import Versions
from .search import K1, B, score_l1

POSTINGS = "term string, id string, tf long, dl long, bucket int"
DOCS = "id string, dl long, hash long"
DEAD = "segment string, id string"
FAN = 8
BUCKETS = 64


def _name() -> str:
    return f"s{uuid4().hex}"


class Index:
    """The index below ``path``; one version of it is a list of segments, of tables of the dead, and two counts.

    ``of`` in a version names what was indexed.  An id has one document, the last.  Rows without an id are not taken, nulls are empty texts.  A
    change that another writer came before is made again on what that one left."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.versions = Versions(spark, f"{self.path}/versions")

    def _state(self, state: dict | None = None) -> dict:
        return {"segments": {}, "dead": [], "n": 0, "words": 0, "of": None, "buckets": self.buckets, **(self.versions.read()[1] if state is None else state)}

    def _read(self, kind: str, names: list[str], schema: str) -> DataFrame:
        schema = schema if kind == "dead" else f"{schema}, segment string"
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(*(self._folder(kind, x) for x in names))

    def _folder(self, kind: str, name: str) -> str:
        return f"{self.path}/{kind}/{'version' if kind in ('dead', 'gone') else 'segment'}={name}"

    def _live(self, kind: str, schema: str, state: dict, names: list[str] | None = None) -> DataFrame:
        rows = self._read(kind, list(state["segments"]) if names is None else names, schema)
        return rows.join(self._read("dead", state["dead"], DEAD), ["segment", "id"], "left_anti") if state["dead"] else rows

    def exists(self) -> bool:
        return self.versions.read()[0] > 0

    def upsert(self, docs: DataFrame, id_col: str, text_col: str, of: list[str] | None = None) -> None:
        """Take documents, in the place of those of the same ids.  Of repeated ids in ``docs`` the greatest text counts.
        ``of`` names what the index then reflects."""
        own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
        texts = own.groupBy("id").agg(F.max("_text").alias("_text"))
        words = texts.select("id", F.xxhash64("_text").alias("hash"), tx.terms(F.col("_text")).alias("t")).withColumn("dl", F.size("t").cast("long"))
        name = _name()
        words.select("id", "dl", "hash").write.parquet(self._folder("docs", name))
        postings = words.select("id", "dl", F.inline(tx.counts(F.col("t"))))
        self._write(postings.select("term", "id", "tf", "dl"), name)
        new = self._read("docs", [name], DOCS)
        n, total = new.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        if n or of is not None:
            self._commit(new.select("id"), {name: n} if n else {}, n, total, of)

    def delete(self, ids: DataFrame, id_col: str, of: list[str] | None = None) -> None:
        """Documents go; ids without one change nothing."""
        self._commit(ids.select(F.col(id_col).cast("string").alias("id")).distinct(), {}, 0, 0, of)

    def refresh(self, docs: DataFrame, id_col: str, text_col: str, of: list[str] | None = None) -> None:
        """Make the index one of ``docs``, whose ids are distinct: what is new or has another text is taken, what is no
        more goes, and nothing else is written."""
        held = self._live("docs", DOCS, self._state())
        own = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("hash", F.xxhash64("_text"))
        self.upsert(own.join(held, ["id", "hash"], "left_anti"), "id", "_text")
        self.delete(self._live("docs", DOCS, self._state()).join(own, "id", "left_anti"), "id", of)

    def _write(self, postings: DataFrame, name: str) -> None:
        rows = postings.withColumn("bucket", F.pmod(F.crc32("term"), F.lit(self._state()["buckets"])).cast("int"))
        # a bucket of a frequent term is split among tasks
        rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(self._folder("postings", name))

    def _commit(self, ids: DataFrame, segments: dict[str, int], n: int, words: int, of: list[str] | None = None) -> None:
        def step(held: dict) -> dict | None:
            state = self._state(held)
            name = _name()
            old = self._live("docs", DOCS, state).join(ids, "id", "left_semi")
            old.drop("hash").write.parquet(self._folder("gone", name))
            gone = self.spark.read.schema(f"{DEAD}, dl long").parquet(self._folder("gone", name))
            lost, lost_words = gone.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
            if lost:
                gone.select("segment", "id").coalesce(8).write.parquet(self._folder("dead", name))
            elif not segments and of is None:
                return None
            dead = [*state["dead"], *([name] if lost else [])]
            named = {} if of is None else {"of": of}
            return {**state, **named, "segments": {**state["segments"], **segments}, "dead": dead, "n": state["n"] + n - lost, "words": state["words"] + words - lost_words}

        self.versions.change(step)
        self.compact()

    def compact(self) -> bool:
        """Merge a size class that is full, and the tables of the dead if they are many; whether there was one."""
        state = self._state()
        classes: dict[int, list[str]] = {}
        for name, n in state["segments"].items():
            classes.setdefault(int(math.log(n, FAN)), []).append(name)
        full = next((names for _, names in sorted(classes.items()) if len(names) >= FAN), [])
        if not full and len(state["dead"]) < 2 * FAN:
            return False
        name, merged = _name(), {}
        if full:
            self._live("docs", DOCS, state, full).select("id", "dl", "hash").write.parquet(self._folder("docs", name))
            self._write(self._live("postings", POSTINGS, state, full).select("term", "id", "tf", "dl"), name)
            n = self._read("docs", [name], DOCS).count()
            merged = {name: n} if n else {}
        left = self._read("dead", state["dead"], DEAD).where(~F.col("segment").isin(full)) if state["dead"] else None
        if left is not None:
            left.coalesce(8).write.parquet(self._folder("dead", name))
        segments = {k: v for k, v in state["segments"].items() if k not in full} | merged

        def step(held: dict) -> dict | None:
            if self._state(held) != state:  # a change came in between; the next one merges
                return None
            return {**state, "segments": segments, "dead": [name] if left is not None else []}

        return self.versions.change(step)["segments"] == segments and bool(full)

    def vacuum(self) -> int:
        """Remove folders that the newest version does not name; how many.  For when no reader of an older one is at work."""
        state, fs = self._state(), self.versions._fs
        kept, n = {"postings": set(state["segments"]), "docs": set(state["segments"]), "dead": set(state["dead"]), "gone": set()}, 0
        for kind, names in kept.items():
            at = self.versions._hadoop.Path(f"{self.path}/{kind}")
            for status in fs.listStatus(at) if fs.exists(at) else []:
                if status.getPath().getName().split("=")[-1] not in names:
                    n += bool(fs.delete(status.getPath(), True))
        return n

    def ranks(self, query: str, state: dict | None = None) -> DataFrame:
        """(id, rank) of every document with a term of the query; the numbers are of all living documents."""
        state, asked = state or self._state(), tx.query_terms(query)
        if not asked or not state["n"]:
            return self.spark.createDataFrame([], "id string, rank double")
        n, mean = state["n"], state["words"] / state["n"] or 1.0
        places = self.spark.createDataFrame([(t, k) for k, t in enumerate(asked)], "term string, place int")
        buckets = [r[0] for r in places.select(F.pmod(F.crc32("term"), F.lit(state["buckets"])).cast("int")).distinct().collect()]
        rows = self._read("postings", list(state["segments"]), POSTINGS).where(F.col("bucket").isin(buckets) & F.col("term").isin(asked))
        if state["dead"]:
            rows = rows.join(self._read("dead", state["dead"], DEAD), ["segment", "id"], "left_anti")
        counts = {r[0]: r[1] for r in rows.groupBy("term").agg(F.count(F.lit(1))).collect()}  # a row for each term of the query
        idf = {t: math.log((n - c + 0.5) / (c + 0.5)) for t, c in counts.items()}
        weight: Column = F.lit(0.0)
        for t, w in idf.items():
            weight = F.when(F.col("term") == t, F.lit(w if w > 0 else 1e-6)).otherwise(weight)
        part = weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(mean)))
        own = rows.join(F.broadcast(places), "term").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", part.alias("part")))).alias("parts"))
        return own.select("id", (-F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["part"])).alias("rank"))

    def search(self, query: str, k: int, score=score_l1) -> DataFrame:
        """(id, rank, score) of the best ``k``, ties by id."""
        return self.ranks(query).orderBy("rank", "id").limit(k).withColumn("score", score(F.col("rank")))
