"""The facade: a folder of layers with capture, search, recall, retention and status."""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable, Mapping
from contextlib import contextmanager
from dataclasses import dataclass, field, fields
from typing import Protocol

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as tx
from ..functions import vectors as vec
from ..operators import extract, fulltext, query, resolve, search, store, transcript, upkeep
from ..sources import files
from ..sources.versions import TRIES, Conflict, Versions
from ..streaming import capture


class Embedder(Protocol):
    """Turns texts into vectors of one length."""

    dimensions: int

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class Model(Protocol):
    """Answers a prompt."""

    def __call__(self, prompt: str) -> str: ...


class Judge(Protocol):
    """Compares new facts with known ones (each with record_id, content and type); a JSON list of decisions."""

    def __call__(self, new: list[dict], known: list[dict]) -> str: ...


@dataclass(frozen=True)
class Config:
    max_results: int = 5
    score_threshold: float = 0.3
    strategy: str = "hybrid"
    max_chars: int = 0
    max_chars_per_memory: int = 0
    skip_sessions: tuple[str, ...] = ()
    retention_days: int = 0
    zone: str = "UTC"
    memories_per_session: int = extract.PER_SESSION
    conflict_recall_top_k: int = 5
    clean_time: str = "03:00"
    context_window: int = 200_000

    @classmethod
    def parse(cls, raw: dict, env: Mapping[str, str] = os.environ) -> Config:
        """From a tree of camel or snake case keys, one level of sections allowed; ``${NAME}`` in
        texts is taken from the environment.  Unknown keys and wrong types are refused."""
        flat: dict = {}
        for key, value in raw.items():
            flat |= value if isinstance(value, dict) else {key: value}
        kinds, out = {f.name: type(f.default) for f in fields(cls)}, {}
        for key, value in flat.items():
            name = query.snake(key)
            if name not in kinds:
                raise ValueError(f"unknown setting {key!r}")
            if isinstance(value, str):
                value = re.sub(r"\$\{(\w+)\}", lambda m: env.get(m[1], ""), value)
            if kinds[name] is tuple:
                value = tuple(value)
            elif kinds[name] is float and isinstance(value, int) and not isinstance(value, bool):
                value = float(value)
            if not isinstance(value, kinds[name]) or isinstance(value, bool):
                raise ValueError(f"{key!r} must be of type {kinds[name].__name__}")
            out[name] = value
        made = cls(**out)
        if made.strategy not in ("hybrid", "embedding", "keyword"):
            raise ValueError(f"no strategy {made.strategy!r}")
        if 0 < made.retention_days < 3:
            raise ValueError("retention is off (0) or at least 3 days")
        return made


#: UTF-16 units of a text that are embedded, texts of a request, and requests for a batch that fails.
EMBED_UNITS, EMBED_BATCH, EMBED_TRIES = 8_000, 256, 3
#: The line over recalled facts (a fixed value), and what a turn is told of the searches.
RECALL_NOTE = "以下是当前对话召回的相关记忆，不代表当前任务进程，仅作为参考："
TOOLS_GUIDE = "<memory-tools-guide>\nsearch_memories looks facts up (preferences, events, rules); search_conversations looks up what was said, word for word.\n</memory-tools-guide>"
#: Parts of a table from which an append writes it anew.
PARTS = 32
RUNNER = "session_key string, last_l1_cursor long, last_scene_name string"
TOTALS = "name string, n long"
ANSWERS = "session_key string, cursor long, answer string"


def embed_all(embed: Embedder, texts: list[str | None], batch: int = EMBED_BATCH, units: int = EMBED_UNITS, tries: int = EMBED_TRIES) -> list[list[float]]:
    """Vectors of texts in their order, in requests of at most ``batch``; texts are cut at ``units``
    UTF-16 units, and a request that fails is made again."""

    def cut(text: str | None) -> str:
        raw = (text or "").encode("utf-16-le", "surrogatepass")[: 2 * units]
        if len(raw) >= 2 and 0xD8 <= raw[-1] <= 0xDB:  # the first half of a pair
            raw = raw[:-2]
        return raw.decode("utf-16-le", "replace")

    out: list[list[float]] = []
    for k in range(0, len(texts), batch):
        part = [cut(t) for t in texts[k : k + batch]]
        for attempt in range(tries):
            try:
                got = list(embed(part))
                break
            except Exception:
                if attempt + 1 == tries:
                    raise
        if len(got) != len(part):
            raise ValueError(f"{len(got)} vectors for {len(part)} texts")
        out += got
    return out


def _asking(call: Callable[[dict], str], keep: list[str]):
    """Rows -> ``keep`` and the answer of ``call`` on each row, null where it raised."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            answers = []
            for row in b.to_pylist():
                try:
                    answers.append(call(row))
                except Exception:  # whatever a service raises is a failed try
                    answers.append(None)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(answers, pa.string())], names=[*keep, "answer"])

    return run


def _embedding(embed: Embedder, batch: int = EMBED_BATCH):
    """(record_id, text, updated_time) -> vectors; a batch that fails is tried text by text, and what fails then is left out."""
    import pyarrow as pa

    def each(texts):
        try:
            return embed_all(embed, texts, batch)
        except Exception:  # one text may be what the service refuses
            out = []
            for t in texts:
                try:
                    out += embed_all(embed, [t])
                except Exception:
                    out.append(None)
            return out

    def run(batches):
        for b in batches:
            got = each(b.column(1).to_pylist())
            ok = pa.array([x is not None for x in got], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.float32())), b.column(2)], names=["record_id", "embedding", "updated_time"]).filter(ok)

    return run


@dataclass
class Memory:
    """Layers as Parquet below ``path``.

    A table is a list of parts.  One small version names those of all tables, so a reader sees a whole
    state, and tables that change together do so at once: new rows are a new part, a change writes the
    table anew.  A writer that another came before is refused (:class:`~..sources.versions.Conflict`);
    :meth:`capture` tries again.  What a change leaves goes with the table's next one."""

    spark: SparkSession
    path: str
    embed: Embedder | None = None
    config: Config = field(default_factory=Config)
    _open: dict | None = field(default=None, init=False, repr=False)

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    @contextmanager
    def _together(self):
        """Changes of tables in the body are one version, written at its end."""
        if self._open is not None:
            yield self._open
            return
        versions = Versions(self.spark, f"{self.path}/.metadata/versions")
        number, held = versions.read()
        self._open = {"tables": dict(held.get("tables", {})), "batches": dict(held.get("batches", {}))}
        try:
            yield self._open
            new = self._open
        finally:
            self._open = None
        if new == {"tables": held.get("tables", {}), "batches": held.get("batches", {})}:
            return
        left, gone = dict(held.get("left", {})), []
        for name, parts in held.get("tables", {}).items():
            dropped = [x for x in parts if x not in new["tables"][name]]
            if dropped:  # a reader of the last version may still be at work, none of the one before
                gone += [f"{self.path}/{name}/{x}" for x in left.get(name, [])]
                left[name] = dropped
        versions.commit(number, {**new, "left": left})
        for path in gone:
            fs, p = self._fs(path)
            fs.delete(p, True)

    def _read_text(self, path: str) -> str | None:
        fs, p = self._fs(path)
        return "\n".join(r[0] for r in self.spark.read.text(path).collect()) if fs.exists(p) else None

    def _write_text(self, path: str, text: str) -> None:
        fs, p = self._fs(path)
        out = fs.create(p, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _parts(self, name: str) -> list[str]:
        state = self._open if self._open is not None else Versions(self.spark, f"{self.path}/.metadata/versions").read()[1]
        if name in state.get("tables", {}):
            return state["tables"][name]
        held = self._read_text(f"{self.path}/{name}/CURRENT")  # of before there were versions
        got = [] if held is None else json.loads(held)
        return got if isinstance(got, list) else [f"v{got}"]

    def _write(self, df: DataFrame, name: str, parts: list[str]) -> str:
        part = f"v{1 + max((int(x[1:].split('-')[0]) for x in parts), default=0)}-{uuid.uuid4().hex[:12]}"
        df.write.parquet(f"{self.path}/{name}/{part}")
        return part

    def table(self, name: str, schema: str) -> DataFrame:
        return self._table(name, self._parts(name), schema)

    def _table(self, name: str, parts: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{name}/{x}" for x in parts)) if parts else self.spark.createDataFrame([], schema)

    def _replace(self, name: str, df: DataFrame) -> None:
        with self._together() as state:
            state["tables"][name] = [self._write(df, name, self._parts(name))]

    def _append(self, name: str, df: DataFrame, schema: str) -> None:
        """Rows whose ids are new; the table is written anew when it has many parts."""
        with self._together() as state:
            old = self._parts(name)
            if len(old) >= PARTS:
                self._replace(name, self.table(name, schema).unionByName(df))
            else:
                state["tables"][name] = [*old, self._write(df, name, old)]

    def bootstrap(self, binding: dict | None = None) -> list[str]:
        """Empty tables where there are none, and the manifest; how ``binding`` differs from it."""
        for name, schema in (("l0", schemas.L0), ("l1", schemas.L1), ("l0_vec", schemas.VECTORS), ("l1_vec", schemas.VECTORS)):
            if not self._parts(name):
                self._replace(name, self.spark.createDataFrame([], schema))
        held = self._read_text(f"{self.path}/.metadata/manifest.json")
        if held is None:
            self._write_text(f"{self.path}/.metadata/manifest.json", json.dumps(binding or {}) + "\n")
            return []
        return upkeep.binding_changes(json.loads(held), binding or {})

    def drop_vectors(self, layer: str) -> None:
        self._replace(f"{layer}_vec", self.spark.createDataFrame([], schemas.VECTORS))

    @property
    def l0(self) -> DataFrame:
        return self.table("l0", schemas.L0)

    @property
    def l1(self) -> DataFrame:
        return self.table("l1", schemas.L1)

    def vectors(self, layer: str) -> DataFrame:
        return self.table(f"{layer}_vec", schemas.VECTORS)

    def cursors(self) -> DataFrame:
        return self.table("cursors", "session_key string, last_captured_timestamp long")

    def capture(self, messages: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Take the new messages of L0 rows; the number taken.  Rows and cursors change as one, and a
        ``batch`` (the name of a stream and the number in it) that was taken is not taken again."""
        for _ in range(TRIES):
            try:
                with self._together() as state:
                    if batch is not None and state["batches"].get(batch[0], -1) >= batch[1]:
                        return 0
                    n = self._capture(messages)
                    if n and batch is not None:
                        state["batches"][batch[0]] = batch[1]
                return n
            except Conflict:
                continue
        raise Conflict(f"{self.path}: {TRIES} tries")

    def sink(self, stream: str) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: batches of L0 rows, each taken once however often it is run."""

        def write(rows: DataFrame, batch_id: int) -> None:
            self.capture(rows, (stream, batch_id))

        return write

    def _capture(self, messages: DataFrame) -> int:
        rows = capture.after_cursors(capture.prepare(messages, self.config.skip_sessions), self.cursors()).select(*self.l0.columns)
        rows = store.last_per_id(rows, "timestamp").persist()
        try:
            n = rows.count()
            if not n:
                return 0
            known = rows.select("record_id").join(self.l0.select("record_id"), "record_id", "left_semi")
            if known.isEmpty():
                self._append("l0", rows, schemas.L0)
            else:
                self._replace("l0", store.upsert_l0(self.l0, rows))
            self._replace("cursors", capture.advance(self.cursors(), rows))
            return n
        finally:
            rows.unpersist()

    def add_facts(self, facts: DataFrame, seq: str | None = None) -> None:
        self._replace("l1", store.upsert_l1(self.l1, facts, seq))

    def update(self, record_id: str, content: str, now: str) -> None:
        """New content of a fact, and its vector; ``KeyError`` without one of that id."""
        row = upkeep.update_content(self.l1, record_id, content, now)
        self._replace("l1", store.upsert_l1(self.l1, row))
        if self.embed:
            new = self.spark.createDataFrame([(record_id, [float(x) for x in embed_all(self.embed, [content])[0]])], "record_id string, embedding array<float>")
            self._replace("l1_vec", store.attach_embeddings(self.vectors("l1"), new, self.l1, "updated_time"))

    def forget(self, layer: str, ids: DataFrame) -> None:
        with self._together():
            for name, schema in ((layer, schemas.L0 if layer == "l0" else schemas.L1), (f"{layer}_vec", schemas.VECTORS)):
                self._replace(name, store.delete(self.table(name, schema), ids))

    def _texts(self, layer: str) -> DataFrame:
        rows, text, time = (self.l0, "message_text", "recorded_at") if layer == "l0" else (self.l1, "content", "updated_time")
        return rows.select("record_id", F.col(text).alias("t"), F.col(time).alias("updated_time"))

    def reindex(self, layer: str, batch: int = EMBED_BATCH) -> None:
        """Vectors of every row of a layer, from the embedder, in batches in the tasks; rows that it
        refuses have none and stay in the backlog."""
        self._replace(f"{layer}_vec", self._texts(layer).mapInArrow(_embedding(self.embed, batch), schemas.VECTORS).where(vec.nonzero(F.col("embedding"))))

    def backlog(self, layer: str) -> DataFrame:
        """(record_id, t, updated_time) of the rows without a vector, or with one of an older text."""
        held = self.vectors(layer).select(F.col("record_id").alias("_of"), F.col("updated_time").alias("_at"))
        return self._texts(layer).join(held, (F.col("record_id") == F.col("_of")) & (F.col("updated_time") <= F.col("_at")), "left_anti")

    def embed_backlog(self, layer: str) -> int:
        """Vectors for the backlog only; how many of it got one."""
        new = self.backlog(layer).mapInArrow(_embedding(self.embed), schemas.VECTORS).where(vec.nonzero(F.col("embedding"))).persist()
        try:
            n = new.count()
            if n:
                self._replace(f"{layer}_vec", store.delete(self.vectors(layer), new).unionByName(new))
            return n
        finally:
            new.unpersist()

    def _asked(self, text: str) -> list[float] | None:
        return list(embed_all(self.embed, [text])[0]) if self.embed else None

    def index(self, layer: str) -> fulltext.Index:
        """The full-text index of a layer, brought up to date: of parts that came since, only those are
        read; of a table that was written anew, what differs is taken.  Searches use it once it exists."""
        index, parts = fulltext.Index(self.spark, f"{self.path}/{layer}_terms"), self._parts(layer)
        schema, text = (schemas.L0, "message_text") if layer == "l0" else (schemas.L1, "content")
        of = index._state()["of"]
        if of is not None and parts[: len(of)] == of:
            if len(parts) > len(of):
                index.upsert(self._table(layer, parts[len(of) :], schema), "record_id", text, parts)
        else:
            index.refresh(self._table(layer, parts, schema), "record_id", text, parts)
        return index

    def _indexed(self, layer: str) -> fulltext.Index | None:
        return self.index(layer) if fulltext.Index(self.spark, f"{self.path}/{layer}_terms").exists() else None

    def search_memories(self, text: str, limit: int = 5, kind: str | None = None, scene: str | None = None) -> DataFrame:
        return search.search_memories(self.l1, text, limit, self.vectors("l1"), self._asked(text), kind, scene, self._indexed("l1"))

    def search_conversations(self, text: str, limit: int = 5, session_key: str | None = None) -> DataFrame:
        return search.search_conversations(self.l0, text, limit, self.vectors("l0"), self._asked(text), session_key, self._indexed("l0"))

    def recall(self, text: str, persona: str | None = None, scenes: DataFrame | None = None) -> dict:
        """What a turn gets.

        ``lines`` of facts within both budgets, ``memories`` (type and content of each), ``persona``
        without its navigation, the blocks ``prepend`` (facts) and ``append`` (persona, navigation over
        ``scenes`` and a guide to the tools), None where there is nothing to put in them, and the
        configured ``strategy``, or "skipped" for a text of under two UTF-16 units.  A search that fails
        gives no lines, and the rest all the same."""
        clean = tx_clean(text)
        skipped = len(clean.encode("utf-16-le", "surrogatepass")) < 4
        try:
            found = [] if skipped else self._recalled(clean)
        except Exception:  # persona and scenes do not depend on the search
            found = []
        lines = [r.line for r in found]
        body = re.sub(r"(?s)\n*<scene-navigation>.*$", "", persona or "").strip() or None
        nav = [r.line for r in files.navigation(scenes).orderBy("rank").collect()] if scenes is not None else []
        prepend = f"<relevant-memories>\n{RECALL_NOTE}\n\n{'\n'.join(lines)}\n</relevant-memories>" if lines else None
        stable = [f"<user-persona>\n{body}\n</user-persona>"] if body else []
        stable += [f"<scene-navigation>\n{'\n'.join(nav)}\n</scene-navigation>"] if nav else []
        if stable or prepend:
            stable.append(TOOLS_GUIDE)
        memories = [{"type": r.type, "content": r.content, "score": 0.0} for r in found]
        return {"lines": lines, "memories": memories, "persona": body, "prepend": prepend, "append": "\n\n".join(stable) or None, "strategy": "skipped" if skipped else self.config.strategy}

    def _recalled(self, clean: str) -> list:
        """The facts' lines in order, with what each still shows of its type and content."""
        c = self.config
        asked = self._asked(clean) if c.strategy != "keyword" else None
        found = search.recall(self.l1, clean, c.max_results, c.score_threshold, c.strategy, self.vectors("l1"), asked, None if c.strategy == "embedding" else self._indexed("l1"))
        meta = lambda key: F.get_json_object("metadata_json", f"$.{key}")
        line = tx.memory_line(F.col("type"), F.col("scene_name"), F.col("content"), meta("activity_start_time"), meta("activity_end_time"), F.col("timestamp_str"))
        rows = search.positions(found, F.col("_o")).select(F.lit(1).alias("session_id"), F.col("pos").alias("rank"), line.alias("line"))
        if c.max_chars_per_memory:
            rows = transcript.cut_lines(rows, c.max_chars_per_memory)
        if c.max_chars:
            rows = transcript.budget_lines(rows, c.max_chars)
        part = lambda k: F.regexp_extract("line", r"(?s)^- \[([^|\]]*)[^\]]*\] (.*?)(?: \(活动时间:.*)?$", k)
        kind = F.when(part(1) == "", "unknown").otherwise(part(1))
        return rows.withColumns({"type": kind, "content": F.when(part(1) == "", F.col("line")).otherwise(tx.strip(part(2)))}).orderBy("rank").collect()

    def recall_within(self, text: str, seconds: float, persona: str | None = None, scenes: DataFrame | None = None) -> dict | None:
        """:meth:`recall`; None where that takes longer (its jobs are cancelled then) or both blocks are empty."""
        group, sc = f"recall-{uuid.uuid4().hex}", self.spark.sparkContext
        out: list = []

        def run() -> None:
            sc.setJobGroup(group, "recall", interruptOnCancel=True)
            try:
                out.append(self.recall(text, persona, scenes))
            except Exception as e:  # what a cancelled job raises is of no interest
                out.append(e)

        worker = InheritableThread(target=run, daemon=True)
        worker.start()
        worker.join(seconds)
        if worker.is_alive():
            sc.cancelJobGroup(group)
            return None
        if isinstance(out[0], Exception):
            raise out[0]
        return out[0] if out[0]["prepend"] or out[0]["append"] else None

    def seed(self, path: str, start_ms: int, barrier: Callable[[], None] | None = None) -> dict[str, int]:
        """Replay the rounds of a seed file that were not replayed before; how much there was.

        ``ValueError`` tells the first place that is wrong, before anything is written.  The keys
        of rounds are kept after their messages, so what a failure leaves undone is done next time."""
        rows = files.fill_times(files.read_seed(self.spark, path), start_ms)
        wrong = rows.where("error is not null").orderBy("session", "round", "place").first()
        if wrong is not None:
            place = ", ".join(f"{n} {getattr(wrong, n) + 1}" for n in ("session", "round", "place") if getattr(wrong, n) is not None)
            raise ValueError(f"{place}: {wrong.error}" if place else wrong.error)
        keys = files.round_keys(rows)
        new = store.insert_if_absent(self.table("seed_keys", "key string"), keys)
        own = F.sha2(F.concat_ws("\x1f", "key", F.col("place").cast("string")), 256)
        messages = rows.join(new, ["session_key", "round"]).select(F.concat(F.lit("seed_"), F.substring(own, 1, 24)).alias("record_id"), "session_key", F.coalesce("session_id", "session_key").alias("session_id"), "role", F.col("content").alias("message_text"), tx.millis_to_iso(F.col("timestamp")).alias("recorded_at"), "timestamp")
        taken = self.capture(messages)
        rounds = new.count()
        self._replace("seed_keys", self.table("seed_keys", "key string").unionByName(new.select("key")).distinct())
        if barrier is not None:
            barrier()
        total = rows.agg(F.count_distinct("session"), F.count(F.lit(1))).first()
        return {"sessions": total[0], "rounds": rounds, "messages": total[1], "recorded": taken}

    def retain(self, now_ms: int) -> DataFrame:
        """Drop expired rows of both layers, as far as the guards allow; how many of each."""
        before = {"l0": self.l0.count(), "l1": self.l1.count()}
        if self.config.retention_days:
            cutoff = tx.retention_cutoff(F.lit(now_ms), self.config.zone, self.config.retention_days)
            for name, column, at, guard in (("l0", "timestamp", cutoff, store.L0_RETENTION), ("l1", "updated_time", tx.millis_to_iso(cutoff), store.L1_RETENTION)):
                rows = getattr(self, name)
                if store.retention_guard(rows, column, at, guard).first()["allowed"]:
                    self._replace(name, store.retain(rows, column, at, guard))
        return self.spark.createDataFrame([(name, n - getattr(self, name).count()) for name, n in before.items()], "layer string, removed long")

    def next_retention(self, now_ms: int) -> int:
        """When the next retention is due, by the clocks of the zone."""
        return tx.next_run_ms(tx.clean_time(self.config.clean_time), now_ms, self.config.zone)

    def status(self) -> DataFrame:
        return query.status(self.l0, self.l1)

    def runner(self) -> DataFrame:
        return self.table("runner", RUNNER)

    def totals(self) -> dict[str, int]:
        return {r.name: r.n for r in self.table("totals", TOTALS).collect()}

    def extract(self, prompt: Callable[[list[str]], str], model: Model, created: str, judge: Judge | None = None) -> int:
        """Ask the model for facts of each session's messages since its last extraction, and store
        them; how many were written.

        Only sessions with enough new text are asked, each by a task (a model is a service outside the
        cluster), and the answers are a table before anything is made of them.  A session whose answer
        came is not asked again for the same messages; one whose call raised is.  With a
        ``judge`` and an embedder, each session's new facts go to it with the known ones
        nearest to them, and its decisions are applied (:mod:`resolve`); a judge that raises stores all."""
        cursors = self.runner().select("session_key", F.col("last_l1_cursor").alias("_at"))
        new = self.l0.join(cursors, "session_key", "left").where(F.col("_at").isNull() | (F.col("timestamp") > F.col("_at"))).drop("_at")
        ready = extract.enough(new).where("ok").select("session_key")
        rows = extract.split_window(new).where("part = 'new'").join(ready, "session_key").groupBy("session_key").agg(F.array_sort(F.collect_list(F.struct("timestamp", "message_text"))).alias("m"))
        rows = rows.select("session_key", F.element_at("m", -1)["timestamp"].alias("cursor"), F.col("m.message_text").alias("texts"))
        call = lambda r: model(prompt(list(r["texts"])))
        self._replace("answers", rows.mapInArrow(_asking(call, ["session_key", "cursor"]), ANSWERS))
        asked = self.table("answers", ANSWERS).where("answer is not null")
        if asked.isEmpty():
            return 0
        parsed = extract.parse_memories(asked.select("session_key", "answer"))
        parsed = extract.limit_per_session(parsed.withColumn("o", F.struct("scene_pos", "pos")), self.config.memories_per_session, "o")
        identity = F.concat(F.lit("m_"), F.substring(F.sha2(F.concat_ws("\x1f", "session_key", "content", "type"), 256), 1, 24))
        facts = parsed.select(identity.alias("record_id"), "content", "type", "priority", "scene_name", "session_key", F.col("session_key").alias("session_id"), F.array(F.lit(created)).alias("timestamps"), F.lit(created).alias("created_time"), F.lit(created).alias("updated_time"), "metadata_json", F.struct("session_key", "scene_pos", "pos").alias("pos"))
        self._replace("facts", facts)
        facts = self.table("facts", facts.schema)
        done = resolve.resolve(self.l1, facts, self._decisions(facts, judge))
        written, removed, n = done.written.persist(), done.removed.persist(), done.stored.first().stored
        try:
            if written.count() + removed.count():
                self._replace("l1", done.l1)
                self._refresh(written, removed)
        finally:
            written.unpersist()
            removed.unpersist()
        self._finished(asked, parsed, n)
        return n

    def _decisions(self, facts: DataFrame, judge: Judge | None) -> DataFrame:
        """What the judge says of each session's facts; none without candidates."""
        none = self.spark.createDataFrame([], "session_key string, answer string")
        known = self.vectors("l1")
        if judge is None or self.embed is None or known.isEmpty():
            return extract.parse_decisions(none)
        new = facts.select("record_id", F.col("content").alias("t"), F.lit("").alias("updated_time")).dropDuplicates(["record_id"]).mapInArrow(_embedding(self.embed), schemas.VECTORS)
        near = search.neighbours(new, known, self.config.conflict_recall_top_k).join(self.l1.select(F.col("record_id").alias("candidate_id"), F.col("content").alias("known_content"), F.col("type").alias("known_type")), "candidate_id")
        of = near.join(facts.select(F.col("record_id").alias("new_id"), "session_key"), "new_id").select("session_key", F.struct(F.col("candidate_id").alias("record_id"), F.col("known_content").alias("content"), F.col("known_type").alias("type")).alias("k"))
        found = of.groupBy("session_key").agg(F.array_sort(F.collect_set("k")).alias("known"))
        each = facts.groupBy("session_key").agg(F.array_sort(F.collect_list(F.struct("pos", "record_id", "content", "type"))).alias("new")).join(found, "session_key")
        call = lambda r: judge([{k: v for k, v in x.items() if k != "pos"} for x in r["new"]], list(r["known"]))
        self._replace("judged", each.mapInArrow(_asking(call, ["session_key"]), "session_key string, answer string"))
        answers = self.table("judged", "session_key string, answer string").where("answer is not null")
        return extract.parse_decisions(answers)

    def _refresh(self, written: DataFrame, removed: DataFrame) -> None:
        """Vectors of written facts, and none of removed ones; a fact that cannot be embedded has none."""
        if self.embed is None:
            return
        rows = self.l1.join(written, "record_id", "left_semi").select("record_id", F.col("content").alias("t"), "updated_time")
        kept = store.delete(store.delete(self.vectors("l1"), removed), written)
        self._replace("l1_vec", kept.unionByName(rows.mapInArrow(_embedding(self.embed), schemas.VECTORS).where(vec.nonzero(F.col("embedding")))))

    def _finished(self, asked: DataFrame, parsed: DataFrame, n: int) -> None:
        """Cursors and last scenes of the sessions that were asked, and the two counts of facts."""
        scene = parsed.groupBy("session_key").agg(F.max_by("scene_name", F.struct("scene_pos", "pos")).alias("_scene"))
        held = self.runner().select("session_key", F.col("last_scene_name").alias("_old"))
        done = asked.select("session_key", F.col("cursor").alias("last_l1_cursor")).join(scene, "session_key", "left").join(held, "session_key", "left")
        done = done.select("session_key", "last_l1_cursor", F.coalesce("_scene", "_old").alias("last_scene_name"))
        self._replace("runner", store.merge_states(self.runner(), done))
        totals = self.totals()
        rows = [(name, totals.get(name, 0) + n) for name in ("total_memories_extracted", "memories_since_last_persona")]
        self._replace("totals", self.spark.createDataFrame(rows, TOTALS))

    def persona_written(self) -> None:
        """Begin to count the facts since the last persona anew."""
        rows = [(name, 0 if name == "memories_since_last_persona" else n) for name, n in self.totals().items()]
        if rows:
            self._replace("totals", self.spark.createDataFrame(rows, TOTALS))


def tx_clean(text: str) -> str:
    """A query without control characters, on one line."""
    return " ".join("".join(c if c.isprintable() else " " for c in text).split())


def render(rows: DataFrame, form: str = "json", limit: int = 100, envelope: dict | None = None) -> str:
    """A short result as JSON (with what ``envelope`` tells, such as level, offset, sort and
    filter), JSON lines, a table or plain lines; the total, unless told, is that of all rows."""
    got = [r.asDict(recursive=True) for r in rows.limit(limit).collect()]
    if form == "json":
        told = envelope or {}
        if "total" not in told:
            told = {"total": len(got) if len(got) < limit else rows.count(), **told}
        return json.dumps({**told, "data": got}, ensure_ascii=False, default=str)
    if form == "jsonl":
        return "\n".join(json.dumps(r, ensure_ascii=False, default=str) for r in got)
    if form == "table":
        cells = [rows.columns, *([str(r[c]) for c in rows.columns] for r in got)]
        width = [min(40, max(tx.display_width(x[k]) for x in cells)) for k in range(len(rows.columns))]
        return "\n".join("  ".join(tx.fit_width(x, w) for x, w in zip(line, width, strict=True)).rstrip() for line in cells)
    return "\n".join("  ".join(f"{k}={v}" for k, v in r.items()) for r in got)


def report(found: DataFrame, what: str = "memories") -> str:
    """Search results as a numbered text, best first."""
    got = found.collect()
    if not got:
        return f"No matching {what} found."
    lines = [f"Found {len(got)} matching {what}:"]
    for k, r in enumerate(got, 1):
        kind = r.type if "type" in found.columns else r.role
        lines.append(f"{k}. [{kind}] {r.content} (score: {r.score:.3f})")
    return "\n".join(lines)
