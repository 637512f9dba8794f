"""Benchmark decontamination by winnowing.

Both sides are fingerprinted by the minimum ``KGRAM``-gram hash of every ``WINDOW``
consecutive ones, so a span of ``KGRAM + WINDOW - 1`` = 13 words that a document shares
with a benchmark item always leaves a common fingerprint.  Fingerprints are joined
(a sorted merge against the benchmark's, which are broadcast), and each common one is
extended: every 13-word window over it is compared with the benchmark's windows, first
by hash and then by its words, and the words of each confirmed window are hits.  Items
of fewer than 13 words are one window, looked up at their own length.

A benchmark of at most ``BLOCK_WORDS`` words is broadcast, and each document is handled where
it is read: nothing is shuffled, so neither frequent passages nor long documents gather in a
task.  A larger one is cut into blocks of about that many words, long items into pieces that overlap.
One pass writes no texts but the
fingerprints of the documents (of short windows only those that items have), which are joined
with the benchmark's; then only the texts with a common fingerprint are read again and
compared with the blocks that they share one with, all blocks in one job: a task holds a block
and ``GROUP_BYTES`` of texts.

Defined results: a null or empty text has no words and is never contaminated; items that are
null or without words take no part; an id counts once, however many items have it, and items
without one count together as one more; repeated documents are judged alike; an empty
benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from .columns import apart, clear_of
from .scratch import table

KGRAM, WINDOW = 5, 9
SPAN = KGRAM + WINDOW - 1
#: Words of benchmark text that are broadcast at once (about 300 bytes each in a worker).
BLOCK_WORDS = 200_000
#: Hashes of short items that are broadcast at once, and judged texts that may be.
SHORT_ITEMS, BROADCAST_TEXTS = 1_000_000, 100_000
#: Bytes of text that meet a block of the benchmark in one task.
GROUP_BYTES = 32 << 20
RESULT = ("n_words", "n_hit", "hit_spans", "item_ids", "items_sha256", "contaminated")
_TOP = np.uint64(2**64 - 1)


def winnow(hashes: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Positions whose k-gram is the least of some window of ``WINDOW`` k-grams.

    ``last`` marks the positions whose k-gram would run over the end of a text.  A window
    that crosses texts may add a position, never remove one.
    """
    g = K.grams(hashes, KGRAM)
    if not len(g):
        return np.zeros(0, np.int64)
    g = np.where(last[: len(g)], _TOP, g)
    if len(g) < WINDOW:
        return np.flatnonzero(g != _TOP)
    low = g.copy()  # low[s]: least of g[s : s + WINDOW]
    m = len(g) - WINDOW + 1
    low = low[:m]
    for k in range(1, WINDOW):
        low = np.minimum(low, g[k : k + m])
    high = np.zeros(len(g), np.uint64)  # high[i]: the largest of the minima of windows over i
    for k in range(WINDOW):
        np.maximum(high[k : k + m], low, out=high[k : k + m])
    return np.flatnonzero((high == g) & (g != _TOP))


def _crossing(bounds: np.ndarray, total: int, n: int) -> np.ndarray:
    """True where ``n`` items from a position on would leave its text."""
    out = np.zeros(total, dtype=bool)
    for k in range(1, n):
        at = bounds[1:] - k
        out[at[at >= bounds[:-1]]] = True
    return out


class Index:
    """Fingerprints and windows of some benchmark items, ready for look-ups by hash."""

    def __init__(self, items: list[tuple[str, str]]):
        self.windows: dict[int, dict[tuple[int, bytes], list[int]]] = {}
        self.ids = [i for i, _ in items]
        prints = []
        for at, (_, text) in enumerate(items):
            w = K.words(*K.texts(pa.array([text])), K.ALNUM)
            n = len(w.hashes)
            if not n:
                continue
            size = min(n, SPAN)
            low = K.LOWER[w.data]
            for s, h in enumerate(K.grams(w.hashes, size)):
                key = (int(h), b" ".join(low[a:b].tobytes() for a, b in zip(w.starts[s : s + size], w.ends[s : s + size], strict=True)))
                held = self.windows.setdefault(size, {}).setdefault(key, [])
                if not held or held[-1] != at:
                    held.append(at)
            if size == SPAN:
                prints.append(_prints(w)[1])
        self.prints = np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64)
        self.hashes = {n: np.unique(np.array([h for h, _ in x], np.uint64)) for n, x in self.windows.items()}

    def hits(self, w: K.Words) -> Iterator[tuple[int, int, list[int]]]:
        """(first word, number of words, items) of each window of the benchmark that occurs in ``w``."""
        total = len(w.hashes)
        low = None
        for n, known in self.hashes.items():
            crossing = _crossing(w.bounds, total, n)
            if n == SPAN:
                at, g = _prints(w)
                at = at[_member(g, self.prints)]
                at = np.unique((at[:, None] - np.arange(WINDOW)).ravel())
            else:
                at = np.arange(max(0, total - n + 1))
            at = at[(at >= 0) & (at <= total - n)]
            at = at[~crossing[at]]
            if not len(at):
                continue
            h = K.grams(w.hashes, n)[at]
            found = _member(h, known)
            for s, x in zip(at[found].tolist(), h[found].tolist(), strict=True):
                low = K.LOWER[w.data] if low is None else low
                text = b" ".join(low[a:b].tobytes() for a, b in zip(w.starts[s : s + n], w.ends[s : s + n], strict=True))
                if items := self.windows[n].get((x, text)):
                    yield s, n, items


def _prints(w: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the fingerprints of some texts."""
    at = winnow(w.hashes, _crossing(w.bounds, len(w.hashes), KGRAM))
    return at, K.grams(w.hashes, KGRAM)[at] if len(at) else np.zeros(0, np.uint64)


def _member(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), dtype=bool)
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return known[at] == x


def _scan(batches: Iterator[pa.RecordBatch], index, at: int, kept: list[str]) -> Iterator[pa.RecordBatch]:
    own: Index = index.value
    for batch in batches:
        data, offs = K.texts(batch.column(at))
        n_words, spans, items = np.zeros(batch.num_rows, np.int64), [[] for _ in range(batch.num_rows)], [set() for _ in range(batch.num_rows)]
        for lo, hi in K.chunks(offs):
            w = K.words(data, offs[lo : hi + 1], K.ALNUM)
            n_words[lo:hi] = np.diff(w.bounds)
            for s, n, found in own.hits(w):
                row = int(np.searchsorted(w.bounds, s, side="right")) - 1
                s -= int(w.bounds[row])
                row += lo
                items[row].update(found)
                if spans[row] and spans[row][-1][0] <= s <= spans[row][-1][1]:
                    spans[row][-1][1] = max(spans[row][-1][1], s + n)
                else:
                    spans[row].append([s, s + n])
        ids = [list({own.ids[i] for i in x}) for x in items]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in kept), pa.array(n_words), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(ids, pa.list_(pa.string()))],
            names=[*kept, "_words", "_spans", "_items"],
        )


# ---- a benchmark of several blocks


def _marks(batches: Iterator[pa.RecordBatch], lead: list[str], short: bool) -> Iterator[pa.RecordBatch]:
    """Items (lead columns, text) -> lead, n, print: fingerprints of items (n = 0), and with
    ``short`` the hash of items of n < 13 words."""
    for batch in batches:
        data, offs = K.texts(batch.column(len(lead)))
        for lo, hi in K.chunks(offs):
            w = K.words(data, offs[lo : hi + 1], K.ALNUM)
            at, g = _prints(w)
            row, n = np.searchsorted(w.bounds, at, side="right") - 1, np.diff(w.bounds)
            if short:  # a short item has its whole hash instead
                keep = n[row] >= SPAN
                own = np.flatnonzero((n > 0) & (n < SPAN))
                whole = np.array([K.grams(w.hashes[w.bounds[k] : w.bounds[k + 1]], int(n[k]))[0] for k in own], np.uint64)
                row, g, size = np.concatenate([row[keep], own]), np.concatenate([g[keep], whole]), np.concatenate([np.zeros(int(keep.sum()), np.int64), n[own]])
            else:
                size = np.zeros(len(row), np.int64)
            order = np.lexsort((g, row))
            row, g, size = row[order], g[order], size[order]
            once = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (g[1:] != g[:-1])])) if len(row) else np.zeros(0, np.int64)
            take = pa.array(lo + row[once])
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in range(len(lead))), pa.array(size[once].astype(np.int32)), pa.array(g[once].view(np.int64))], names=[*lead, "n", "print"])


def _shorts(batches: Iterator[pa.RecordBatch], known) -> Iterator[pa.RecordBatch]:
    """k, text -> k, n, print: the windows of n < 13 words that are hashes of items."""
    hashes: dict[int, np.ndarray] = known.value
    for batch in batches:
        data, offs = K.texts(batch.column(1))
        for lo, hi in K.chunks(offs):
            w = K.words(data, offs[lo : hi + 1], K.ALNUM)
            for n, own in hashes.items():
                g = K.grams(w.hashes, n)
                at = np.flatnonzero(_member(g, own))
                at = at[~_crossing(w.bounds, len(w.hashes), n)[at]]
                row = np.searchsorted(w.bounds, at, side="right") - 1
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lo + row)), pa.array(np.full(len(at), n, np.int32)), pa.array(g[at].view(np.int64))], names=["k", "n", "print"])


def _counted(batches: Iterator[pa.RecordBatch], kept: list[str]) -> Iterator[pa.RecordBatch]:
    """kept, _k, text -> kept, _k, _words."""
    for batch in batches:
        data, offs = K.texts(batch.column("_text"))
        n = np.concatenate([np.diff(K.words(data, offs[lo : hi + 1], K.ALNUM).bounds) for lo, hi in K.chunks(offs)] or [np.zeros(0, np.int64)])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), batch.column("_k"), pa.array(n.astype(np.int64))], names=[*kept, "_k", "_words"])


def _cut_items(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """i, t -> the same, long items in pieces of about ``size`` bytes that overlap by ``SPAN`` - 1 words,
    so that each window is in one of them; a piece of fewer words than a window is in the next one."""
    for batch in batches:
        data, offs = K.texts(batch.column(1))
        ids, out = [], []
        for k, i in enumerate(batch.column(0).to_pylist()):
            last, kept = b"", False
            for _, _, w, _ in K.pieces(data, offs[k : k + 2], K.ALNUM, size, SPAN - 1, hashed=False):
                if len(w.starts) >= SPAN:
                    ids.append(i)
                    out.append(w.data.tobytes().decode())
                    kept = True
                elif len(w.starts):
                    last = w.data.tobytes()
            if last and not kept:
                ids.append(i)
                out.append(last.decode())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(out, pa.string())], names=["i", "t"])


class _Held:
    def __init__(self, value: Index):
        self.value = value


def _met(texts: pa.Table, items: pa.Table) -> pa.Table:
    """(block, part, k, _text) and (block, part, i, t) of one block and part -> k, _words, _spans, _items of hit texts."""
    own = sorted(zip(items.column("i").to_pylist(), items.column("t").to_pylist(), strict=True), key=lambda x: (x[0] is not None, x))
    batches = texts.select(["k", "_text"]).combine_chunks().to_batches()
    found = pa.Table.from_batches(_scan(iter(batches), _Held(Index(own)), 1, ["k"]))
    return found.filter(pc.greater(pc.list_value_length(found.column("_spans")), 0))


_KEY = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
_FOUND = [T.StructField("_spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("_items", T.ArrayType(T.StringType()))]


def _in_blocks(docs: DataFrame, items: DataFrame, blocks: int, piece: int, kept: list[str]) -> DataFrame:
    """The columns ``kept`` of ``docs`` (which has ``_text``) with _words, _spans and _items."""
    spark = docs.sparkSession
    items = items.mapInArrow(lambda x: _cut_items(x, piece), "i string, t string")
    items = table(items.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(blocks)).cast("int")), "benchmark")
    marks = table(items.select("block", "t").mapInArrow(lambda x: _marks(x, ["block"], True), "block int, n int, print long").distinct(), "marks")
    key = F.struct(F.xxhash64("_text").alias("a"), F.xxhash64(F.lit(1), "_text").alias("b"))
    texts = docs.where("_text <> ''").select(key.alias("k"), "_text")
    schema = f"k {_KEY.simpleString()}, n int, print long"
    prints = texts.mapInArrow(lambda x: _marks(x, ["k"], False), f"k {_KEY.simpleString()}, n int, print long")
    short = marks.where("n > 0").select("n", "print").distinct()
    parts = -(-short.count() // SHORT_ITEMS)
    for p in range(parts):
        known: dict[int, list[int]] = {}
        for n, h in short.where(F.pmod(F.xxhash64("n", "print"), F.lit(parts)) == p).toLocalIterator():
            known.setdefault(n, []).append(h)
        held = spark.sparkContext.broadcast({n: np.sort(np.array(h, np.int64).view(np.uint64)) for n, h in known.items()})
        prints = prints.unionByName(texts.mapInArrow(lambda x, h=held: _shorts(x, h), schema))
    shared = prints.join(marks, ["n", "print"]).select("k", "block").distinct()
    shared = texts.join(shared, "k").dropDuplicates(["k", "block"])
    shared = table(shared.withColumn("bytes", F.octet_length("_text")), "shared")
    # a block and a part of the texts that share a fingerprint with it meet in a task
    parts_of = table(shared.groupBy("block").agg(F.ceil(F.sum("bytes") / GROUP_BYTES).cast("int").alias("parts")), "parts")
    parts_of = F.broadcast(parts_of) if parts_of.count() <= BROADCAST_TEXTS else parts_of
    left = shared.join(parts_of, "block").select("block", F.pmod(F.xxhash64("k"), F.col("parts")).cast("int").alias("part"), "k", "_text")
    right = items.join(parts_of, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "i", "t")
    judged = T.StructType([T.StructField("k", _KEY), T.StructField("_words", T.LongType()), *_FOUND])
    hits = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(_met, judged)
    hits = hits.groupBy(F.col("k").alias("_of")).agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("_spans", "_items")))
    hits = table(hits, "hits")
    hits = F.broadcast(hits) if hits.count() <= BROADCAST_TEXTS else hits
    base = T.StructType([*(docs.schema[c] for c in kept), T.StructField("_k", _KEY), T.StructField("_words", T.LongType())])
    out = docs.select(*(f"`{c}`" for c in kept), key.alias("_k"), "_text").mapInArrow(lambda x: _counted(x, kept), base).join(hits, F.col("_k") == F.col("_of"), "left")
    return out.select(*(f"`{c}`" for c in kept), "_words", *(F.coalesce(f.name, F.array().cast(f.dataType)).alias(f.name) for f in _FOUND))


def _merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _finish(batches: Iterator[pa.RecordBatch], kept: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [_merged(x) for x in batch.column("_spans").to_pylist()]
        ids = [sorted(set(x), key=lambda i: (i is None, i)) for x in batch.column("_items").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in kept),
                batch.column("_words"),
                pa.array([sum(b - a for a, b in x) for x in spans], pa.int64()),
                pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                pa.array(ids, pa.list_(pa.string())),
                pa.array([hashlib.sha256(",".join(i for i in x if i is not None).encode()).hexdigest() for x in ids]),
            ],
            names=[*kept, "n_words", "n_hit", "hit_spans", "item_ids", "items_sha256"],
        )


def mark_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    keep: list[str] | None = None,
    share: float = 0.05,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Judge every document against the benchmark.

    Returns the columns ``keep`` (all of ``docs`` by default; the six result names win
    over columns of ``docs`` so called) with n_words, n_hit, hit_spans (first and last+1
    word of merged hits), item_ids (each once, with one null for items without an id, which
    the digest leaves out), items_sha256, and contaminated: some word is hit and
    hits are at least ``share`` of the words.
    """
    names = clear_of(docs.columns if keep is None else keep, RESULT, docs)
    return apart(docs, RESULT, (text_col,), lambda d, own: _marked(d, benchmark, own(text_col), item_col, item_text_col, [own(c) for c in names], share, block_words))


def _marked(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, kept: list[str], share: float, block_words: int) -> DataFrame:
    out = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text_col}`").alias("_text"))
    base = T.StructType([docs.schema[c] for c in kept])
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("i"), F.col(f"`{item_text_col}`").alias("t")).where("t is not null")
    total = items.agg(F.sum(F.length("t").cast("long"))).first()[0] or 0
    blocks = max(1, -(-total // (2 * block_words)))  # a word and its separator take two characters at least
    if blocks == 1:
        index = docs.sparkSession.sparkContext.broadcast(Index([tuple(x) for x in items.orderBy("i", "t").collect()]))
        schema = T.StructType([*base.fields, T.StructField("_words", T.LongType()), *_FOUND])
        out = out.mapInArrow(lambda x: _scan(x, index, len(kept), kept), schema)
    else:
        out = _in_blocks(out, items, blocks, max(2 * block_words, 1 << 12), kept)
    schema = T.StructType([*base.fields, T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("item_ids", T.ArrayType(T.StringType())), T.StructField("items_sha256", T.StringType())])
    out = out.mapInArrow(lambda x, k=kept: _finish(x, k), schema)
    part = Fraction(str(share)).limit_denominator(10**17)  # as it is written
    times = lambda c, n: F.col(c).cast("decimal(19,0)") * F.lit(n).cast("decimal(18,0)")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (times("n_hit", part.denominator) >= times("n_words", part.numerator)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents, with their own columns, that :func:`mark_contamination` leaves clean."""
    return apart(docs, (), (), lambda d, own: mark_contamination(d, benchmark, own(text_col), **options).where(~F.col("contaminated")).select(*d.columns))
