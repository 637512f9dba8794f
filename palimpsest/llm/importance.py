"""Importance resampling of documents towards a target corpus, by hashed n-grams.

Features are all runs of 1 to ``n`` words; a feature's bucket is the CRC-32 of its UTF-8 bytes
modulo ``buckets``.  A bucket's gain is how much likelier it is in the target than in the
documents, a document's weight the mean gain of its features, and adding Gumbel noise that
depends on the id alone to the weights makes the highest scores a sample without replacement.

Buckets come from suffix arrays of word ids.  For some megabytes of a partition words are numbered,
and the suffixes, of which the first ``n`` words count, are sorted by these numbers.  In that
order equal n-grams stand together: neighbours with a longest common prefix (LCP) of m words or
more are runs of one m-gram.  Its bytes are hashed once a run, from the hash of the run of its
first m - 1 words, and the bucket is scattered back to all places of the run.

1. Both tables are counted by bucket: a task adds up its own and returns ``buckets`` numbers
   at most; the sums (``buckets`` numbers for each table) give the gains, on the driver.
2. A second pass looks the gains up and keeps a weight for each document.
3. The documents long enough are dealt by ranges of their scores and sorted there, and each
   range starts at the number of rows in those before it: no task holds them all.

Defined results: a null or empty text has no features and weight 0; a null id counts as an empty
one for its noise and comes last among equal scores; rows of one id and text are documents of
their own with equal scores; an empty target or table has no counts (all its buckets are equally
likely).  The names of the results win over columns so called.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from .columns import apart, clear_of
from .scratch import table

#: Bytes of text in a suffix array.
CHUNK = 4 << 20
RESULT = ("n_features", "weight", "score", "rank")


def suffixes(ids: np.ndarray, room: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): the suffix array of ``ids`` as far as ``n`` words tell suffixes apart, and how
    many first words (at most ``n``) each suffix has in common with the one before it.

    ``room`` tells how many words there are from each place to the end of its text."""
    size = int(ids.max(initial=0)) + 2
    rank, nexts = ids.astype(np.int64), [ids]
    for k in range(1, min(n, int(room.max(initial=1)))):
        after = np.zeros(len(ids), np.int64)
        after[:-k] = ids[k:] + 1
        after[room <= k] = 0  # the end of a text sorts first
        nexts.append(after)
        rank = (np.unique(rank, return_inverse=True)[1] if k > 1 else rank) * size + after
    order = np.argsort(rank, kind="stable")
    lcp, same = np.zeros(len(ids), np.int64), np.ones(max(0, len(ids) - 1), dtype=bool)
    for k, after in enumerate(nexts):
        own = after[order]
        same &= own[1:] == own[:-1]
        if k:
            same &= own[1:] > 0
        lcp[1:] += same
    return order, lcp


def gram_buckets(w: K.Words, n: int, buckets: int) -> list[np.ndarray]:
    """For m = 1 to ``n`` the bucket of the m-gram from each word on, -1 where a text has not so many."""
    total = len(w.starts)
    room = np.repeat(w.bounds[1:], np.diff(w.bounds)) - np.arange(total)
    seen, first, ids = np.unique(w.hashes, return_index=True, return_inverse=True)
    order, lcp = suffixes(ids, room, n)
    low = K.LOWER[w.data].tobytes()
    spelt = [low[a:b] for a, b in zip(w.starts[first].tolist(), w.ends[first].tolist(), strict=True)]
    out, before = [], None
    for m in range(1, n + 1):
        starts = lcp < m  # the first suffix of each run
        run = np.cumsum(starts) - 1
        heads = order[starts]
        full = room[heads] >= m
        last = np.where(full, heads + m - 1, 0)
        if m == 1:
            crc = [zlib.crc32(x) for x in spelt]
            crc = np.array(crc, np.int64)[ids[heads]] if len(heads) else np.zeros(0, np.int64)
        else:
            spaced = [zlib.crc32(b" ", x) for x in before[0].tolist()]
            crc = [zlib.crc32(spelt[x], spaced[y]) if ok else 0 for ok, x, y in zip(full.tolist(), ids[last].tolist(), before[1][starts].tolist(), strict=True)]
            crc = np.array(crc, np.int64)
        bucket = np.empty(total, np.int64)
        bucket[order] = np.where(full, crc % buckets, -1)[run]
        out.append(bucket)
        before = (crc, run)
    return out


def _features(data: np.ndarray, offs: np.ndarray, n: int, buckets: int) -> Iterator[tuple[int, int, K.Words, int, list[np.ndarray]]]:
    """(lo, hi, words, carried, buckets by m): places whose m-gram ended in an earlier piece are -1."""
    for lo, hi, w, carried in K.pieces(data, offs, K.ALNUM, CHUNK, n - 1):
        found = gram_buckets(w, n, buckets)
        for m, b in enumerate(found, 1):
            b[: max(0, carried - m + 1)] = -1
        yield lo, hi, w, carried, found


def _counted(batches: Iterator[pa.RecordBatch], n: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """text -> bucket, times."""
    times = np.zeros(buckets, np.int64)
    for batch in batches:
        for *_, found in _features(*K.texts(batch.column(0)), n, buckets):
            for b in found:
                times += np.bincount(b[b >= 0], minlength=buckets)
    own = np.flatnonzero(times)
    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(times[own])], names=["bucket", "times"])


def _weighed(batches: Iterator[pa.RecordBatch], n_kept: int, n: int, gains: np.ndarray) -> Iterator[pa.RecordBatch]:
    """kept columns, text -> kept columns, _words, n_features, weight."""
    padded = np.append(gains, 0)  # for places without an m-gram
    for batch in batches:
        words, features, sums = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
        for lo, hi, w, carried, found in _features(*K.texts(batch.column(n_kept)), n, len(gains)):
            per = np.diff(w.bounds)
            words[lo:hi] += per - carried
            for b in found:
                features[lo:hi] += np.diff(np.concatenate([[0], np.cumsum(b >= 0)])[w.bounds])
                sums[lo:hi] += np.diff(np.concatenate([[0], np.cumsum(padded[b])])[w.bounds])
        weight = sums // np.maximum(features, 1)
        yield pa.RecordBatch.from_arrays([*batch.columns[:n_kept], pa.array(words), pa.array(features), pa.array(weight)], names=[*batch.schema.names[:n_kept], "_words", "n_features", "weight"])


def bucket_counts(texts: DataFrame, text_col: str, n: int, buckets: int) -> np.ndarray:
    """How many features of all the texts are in each bucket."""
    per_task = texts.select(F.col(f"`{text_col}`").alias("t")).mapInArrow(lambda x: _counted(x, n, buckets), "bucket long, times long")
    out = np.zeros(buckets, np.int64)
    for bucket, times in per_task.groupBy("bucket").agg(F.sum("times").alias("times")).collect():  # `buckets` rows at most
        out[bucket] = times
    return out


def bucket_gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of how much likelier each bucket is in the target, rounded down."""
    size = len(own)
    whole, aim = float(own.sum() + size), float(target.sum() + size)
    return np.array([math.floor(1000 * math.log((t + 1) * whole / ((s + 1) * aim))) for s, t in zip(own.tolist(), target.tolist(), strict=True)], np.int64)


def rank_documents(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    keep: list[str] | None = None,
    percent: int = 25,
    least_words: int = 20,
    n: int = 2,
    buckets: int = 10_000,
    seed: int = 7,
) -> DataFrame:
    """The columns ``keep`` (all by default) of every document with n_features, weight, score and rank.

    ``percent`` of the documents with ``least_words`` or more are drawn: they have the highest scores
    and ranks from 1 on, ties going to the smaller id; the rank of the others is null.
    """
    names = clear_of(docs.columns if keep is None else keep, RESULT, docs)
    return apart(docs, RESULT, (id_col, text_col), lambda d, own: _ranked(d, target, own(id_col), own(text_col), target_col, [own(c) for c in names], percent, least_words, n, buckets, seed))


def _ranked(docs: DataFrame, target: DataFrame, id_col: str, text_col: str, target_col: str, kept: list[str], percent: int, least_words: int, n: int, buckets: int, seed: int) -> DataFrame:
    gains = bucket_gains(bucket_counts(docs, text_col, n, buckets), bucket_counts(target, target_col, n, buckets))
    lead = docs.select(*kept, F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    schema = T.StructType([*lead.schema.fields[:-1], *(T.StructField(c, T.LongType()) for c in ("_words", "n_features", "weight"))])
    weighed = lead.mapInArrow(lambda x, k=len(kept) + 1: _weighed(x, k, n, gains), schema)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256)
    part = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    noise = F.floor(-1000 * F.log(-F.log(part))).cast("long")
    scored = table(weighed.withColumn("score", F.col("weight") + noise).withColumn("_row", F.monotonically_increasing_id()), "scored")
    enough = F.col("_words") >= least_words
    drawn = scored.where(enough).count() * percent // 100
    spark, columns = docs.sparkSession, [*kept, "n_features", "weight", "score", "rank"]
    order = [F.col("score").desc(), F.col("_id").asc_nulls_last(), F.col("_row")]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = scored.where(enough).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    dealt = table(dealt.withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))), "sorted")
    before, starts = 0, []
    for k, rows in sorted(tuple(x) for x in dealt.groupBy("_range").count().collect()):  # a row for each range
        starts.append((k, before))
        before += rows
    starts = F.broadcast(spark.createDataFrame(starts, "_range int, _before long"))
    rank = F.col("_before") + F.col("_at") + 1
    ranked = dealt.join(starts, "_range").withColumn("rank", F.when(rank <= drawn, rank)).select(*columns)
    return ranked.unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long")).select(*columns))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, with their own columns, that :func:`rank_documents` draws."""
    return apart(docs, (), (), lambda d, own: rank_documents(d, target, own(id_col), own(text_col), **options).where("rank is not null").select(*d.columns))
