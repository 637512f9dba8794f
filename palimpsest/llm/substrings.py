"""Passages that repeat word for word, by seed and extend.

A repeat is a window of ``LENGTH`` consecutive words of one document that also starts somewhere
else, in the same document or another.  Seeds are winnowed anchors: of the ``KGRAM``-word grams
of each window, the one with the least hash (the first of equal ones) is its anchor.  Equal windows
have equal anchors at equal places, so a repeat is found among the occurrences of its anchor.
An occurrence stands for the *run* of consecutive windows that it anchors.

1. One pass over the texts writes the runs: row, first window, windows, anchor, and a digest of all
   words that the run's windows cover.
2. Runs are extended as a whole first.  Runs of an anchor with equal digests are one class; a class
   of several runs is repeated from end to end, a class of one whose anchor has no other class is
   not repeated at all.  Nothing is paired: a passage of a million copies is a count.
3. Where an anchor has several classes, which agree for some words to either side, they
   are compared a step at a time: one run of each class gives the windows it anchors, each with a
   digest of all its words, and windows that classes share are repeated.
4. Overlapping repeated windows of a document are joined to maximal spans, which are cut.

Digests are two independent values of 64 bits (the anchor's and the window's or run's).  Keys with
more than ``HOT`` rows (and more than all rows over ``HOT_KEYS``) are joined by a broadcast of
such keys, of which there are at most ``HOT_KEYS``; a key of the others has few rows.  A text longer
than a megabyte is hashed in pieces that overlap.

Rows are numbered in a written table, so repeated rows are occurrences of their own: two equal
documents of ``LENGTH`` words or more repeat each other, and nothing of either stays.  Windows are
judged on the input, not on what is left.

Defined results: a null text has no words and stays null; a text of fewer words
than ``LENGTH`` loses nothing; white space of a text that loses nothing is kept, of others it becomes
single spaces; ids play no part, so they may be null or repeated; an empty table gives an
empty result.  The names of the results win over columns so called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from .columns import apart, clear_of
from .scratch import drop, table

LENGTH = 35
KGRAM = 12
HOT, HOT_KEYS = 1_000, 100_000
RESULT = ("n_words", "n_removed", "spans", "kept_sha256")
_FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("kept_sha256", T.StringType()), T.StructField("rewritten", T.StringType())]
_SEED, _ENDS = K.U64(0x9E3779B97F4A7C15), K.U64(0xC2B2AE3D27D4EB4F)


def anchors(hashes: np.ndarray, length: int, kgram: int) -> np.ndarray:
    """The place of the anchor of each window of ``length`` words."""
    grams = K.mix(K.grams(hashes, kgram) ^ _SEED)
    wide = length - kgram + 1  # grams in a window
    at, span = np.arange(len(grams)), 1
    low = grams
    while span < wide:  # the first least gram of `span` grams, from those of shorter stretches
        step = min(span, wide - span)
        later = low[step:] < low[:-step]
        at = np.where(later, at[step:], at[:-step])
        low = np.minimum(low[step:], low[:-step])
        span += step
    return at


def _each(data: np.ndarray, offs: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row of each word, hashes, number of each word in its text), some text at a time."""
    seen = 0
    for lo, hi, w, carried in K.pieces(data, offs, K.SPACED, carry=length - 1, lower=K.EXACT):
        row = np.repeat(np.arange(hi - lo), np.diff(w.bounds))
        start = seen - carried if carried else 0  # of a piece of a long text
        seen = start + len(w.hashes)
        yield lo, row, w.hashes, np.arange(len(w.hashes)) - w.bounds[row] + start


def _runs(batches: Iterator[pa.RecordBatch], length: int, kgram: int) -> Iterator[pa.RecordBatch]:
    """row, text -> row, first, windows, anchor, digest."""
    for batch in batches:
        for lo, row, hashes, number in _each(*K.texts(batch.column(1)), length):
            if len(hashes) < length:
                continue
            whole = np.flatnonzero(row[length - 1 :] == row[: len(row) - length + 1])  # windows within a text
            if not len(whole):
                continue
            at, digest = anchors(hashes, length, kgram), K.grams(hashes, length)
            new = np.concatenate([[True], (at[whole][1:] != at[whole][:-1]) | (np.diff(whole) > 1)])
            heads = np.flatnonzero(new)
            first, last = whole[heads], whole[np.append(heads[1:], len(whole)) - 1]
            both = K.mix(digest[first] ^ _ENDS) * _SEED + digest[last]  # the first and the last window cover all between them
            both = K.mix(both + (last - first).astype(np.uint64))
            seed = K.grams(hashes, kgram)[at[first]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(lo + row[first])), pa.array(number[first]), pa.array((last - first + 1).astype(np.int32)), pa.array(seed.view(np.int64)), pa.array(both.view(np.int64))],
                names=["row", "first", "windows", "anchor", "digest"],
            )


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """row, text, runs (first, windows, anchor, many) -> row, at, anchor, many, window: a row a window of the runs."""
    for batch in batches:
        lists = batch.column(2)
        bounds, flat = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten()
        first, windows, anchor, many = (flat.field(k) for k in range(4))
        first, windows = first.to_numpy(), windows.to_numpy()
        for lo, row, hashes, number in _each(*K.texts(batch.column(1)), length):
            if len(hashes) < length:
                continue
            digest, rows = K.grams(hashes, length), int(row[-1]) + 1
            starts = np.searchsorted(row, np.arange(rows + 1))
            a, b = int(bounds[lo]), int(bounds[lo + rows])
            run = np.repeat(np.arange(a, b), windows[a:b])
            own = np.repeat(np.arange(rows), np.diff(bounds[lo : lo + rows + 1]))[run - a]
            at = first[run] + np.arange(len(run)) - np.repeat(np.cumsum(windows[a:b]) - windows[a:b], windows[a:b])
            place = starts[own] + at - number[np.minimum(starts[own], len(number) - 1)]  # within this piece
            here = (place >= starts[own]) & (place + length <= starts[own + 1])
            run, own, at, place = run[here], own[here], at[here], place[here]
            take = pa.array(run)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lo + own)), pa.array(at), anchor.take(take), many.take(take), pa.array(digest[place].view(np.int64))], names=["row", "at", "anchor", "many", "window"])


def _cut(batches: Iterator[pa.RecordBatch], n_kept: int) -> Iterator[pa.RecordBatch]:
    """kept columns, text, spans -> kept columns, n_words, n_removed, spans, kept_sha256, rewritten."""
    for batch in batches:
        texts, rows = batch.column(n_kept), batch.num_rows
        data, offs = K.texts(texts)
        spans = [_merged(x or []) for x in batch.column(n_kept + 1).to_pylist()]
        n_words, removed = np.zeros(rows, np.int64), [sum(b - a for a, b in x) for x in spans]
        digests, parts = [hashlib.sha256() for _ in range(rows)], [[] for _ in range(rows)]
        begun = np.zeros(rows, dtype=bool)  # a long text comes in pieces
        for lo, hi, w, _ in K.pieces(data, offs, K.SPACED, hashed=False):
            stays, bounds = _staying(w, [[[a - n, b - n] for a, b in spans[k]] for k, n in enumerate(n_words[lo:hi].tolist(), lo)])
            n_words[lo:hi] += np.diff(w.bounds)
            for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True), lo):
                part = b" " * bool(begun[k] and b > a) + stays[a:b]
                digests[k].update(part)
                if spans[k]:
                    parts[k].append(part)
                begun[k] |= b > a
        rewritten = pa.array([b"".join(p).decode() if s else None for p, s in zip(parts, spans, strict=True)], pa.string())
        cut = pa.array([bool(s) for s in spans], pa.bool_())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:n_kept], pa.array(n_words), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array([d.hexdigest() for d in digests], pa.string()), pc.if_else(cut, rewritten, texts.cast(pa.string()))],
            names=[*batch.schema.names[:n_kept], *RESULT, "rewritten"],
        )


def _staying(w: K.Words, spans: list[list[list[int]]]) -> tuple[bytes, np.ndarray]:
    """The words outside the spans of each text, joined by single spaces, and where each text's begin."""
    change = np.zeros(len(w.starts) + 1, np.int64)
    for k, own in enumerate(spans):
        low, high = int(w.bounds[k]), int(w.bounds[k + 1])
        for a, b in own:
            if low + a < high and b > 0:
                change[low + max(a, 0)] += 1
                change[min(low + b, high)] -= 1
    stay = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    row = np.searchsorted(w.bounds, stay, side="right") - 1
    edges = np.zeros(len(w.data) + 1, np.int8)
    np.add.at(edges, w.starts[stay], 1)
    np.add.at(edges, w.ends[stay], -1)
    mask = np.cumsum(edges[:-1], dtype=np.int8).astype(bool)
    spaced = np.flatnonzero(row[1:] == row[:-1])  # words with another after them; white space follows each
    between = w.ends[stay[spaced]]
    mask[between] = True
    out = w.data.copy()
    out[between] = 32
    size = np.bincount(row, weights=w.ends[stay] - w.starts[stay], minlength=len(spans)) + np.bincount(row[spaced], minlength=len(spans))
    return out[mask].tobytes(), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


def _merged(spans: list) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _joined(rows: DataFrame, keys: DataFrame, on: list[str], size: str) -> DataFrame:
    """The inner join of ``rows`` with ``keys``, whose rows are distinct ``on`` and tell by ``size`` how
    many of ``rows`` have each: keys of many are broadcast, so that no task gathers their rows."""
    total = keys.agg(F.sum(size)).first()[0] or 0
    many = F.col(size) > max(HOT, total // HOT_KEYS)
    hot = F.broadcast(keys.where(many))
    return rows.join(hot, on).unionByName(rows.join(hot.select(*on), on, "left_anti").join(keys.where(~many), on))


def mark_repeats(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, length: int = LENGTH, kgram: int = KGRAM) -> DataFrame:
    """The columns ``keep`` (all by default) of every document with n_words, n_removed, spans (first and
    last+1 word of each maximal repeat) and kept_sha256 (of the words outside them, joined by spaces)."""
    names = clear_of(docs.columns if keep is None else keep, RESULT, docs)
    return apart(docs, RESULT, (text_col,), lambda d, own: _marked(d, own(text_col), [own(c) for c in names], length, kgram).drop("rewritten"))


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, kgram: int = KGRAM) -> DataFrame:
    """``docs`` without the words of repeats in ``text_col``."""

    def run(d: DataFrame, own) -> DataFrame:
        out = _marked(d, own(text_col), d.columns, length, kgram)
        return out.select(*(F.col("rewritten").alias(c) if c == own(text_col) else F.col(c) for c in d.columns))

    return apart(docs, (), (), run)


def _marked(docs: DataFrame, text_col: str, kept: list[str], length: int, kgram: int) -> DataFrame:
    if not 0 < kgram < length:
        raise ValueError(f"anchors of {kgram} words are not within windows of {length}")
    rows = table(docs.select(*kept, F.col(text_col).alias("text_")).withColumn("row", F.monotonically_increasing_id()), "numbered")
    found = repeats(rows.select("row", F.col("text_").alias("text")), length, kgram)
    spans = found.groupBy(F.col("row").alias("of")).agg(F.collect_list(F.struct("a", "b")).alias("spans_"))  # of one document
    schema = T.StructType([*(docs.schema[c] for c in kept), *_FIELDS])
    return rows.join(spans, F.col("row") == F.col("of"), "left").select(*kept, "text_", "spans_").mapInArrow(lambda x, n=len(kept): _cut(x, n), schema)


def repeats(rows: DataFrame, length: int = LENGTH, kgram: int = KGRAM) -> DataFrame:
    """(row, a, b): spans of repeated windows, which may overlap, of the texts of a written table (row, text)."""
    runs = table(rows.mapInArrow(lambda x: _runs(x, length, kgram), "row long, first long, windows int, anchor long, digest long"), "runs")
    classes = table(runs.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("one")), "classes")
    seeds = table(classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("total")).where("total > 1").drop("total"), "seeds")
    classes_of = table(_joined(classes, seeds, ["anchor"], "kinds").select("anchor", "digest", "n", "one", (F.col("kinds") > 1).alias("several")), "extended")
    known = _joined(runs, classes_of, ["anchor", "digest"], "n").select("row", "first", "windows", "anchor", (F.col("n") > 1).alias("many"), (F.col("several") & (F.col("row") == F.col("one"))).alias("probe"))
    known = table(known.where("many or probe"), "known")
    drop(runs, classes, seeds, classes_of)
    probes = known.where("probe").groupBy("row").agg(F.collect_list(F.struct("first", "windows", "anchor", "many")).alias("runs"))  # of one document
    windows = rows.join(probes, "row").select("row", "text", "runs").mapInArrow(lambda x: _windows(x, length), "row long, at long, anchor long, many boolean, window long")
    windows = table(windows, "windows")
    shared = windows.groupBy("anchor", "window").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("many")).alias("alone")).where("n > 1 and alone > 0").drop("n")
    shared = table(shared, "shared")
    single = _joined(windows.where("not many"), shared, ["anchor", "window"], "alone")
    whole = known.where("many").select("row", F.col("first").alias("a"), (F.col("first") + F.col("windows") - 1 + length).alias("b"))
    return whole.unionByName(single.select("row", F.col("at").alias("a"), (F.col("at") + length).alias("b")))
