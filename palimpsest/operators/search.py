"""Ranked retrieval: BM25, exact cosine neighbours, reciprocal-rank fusion, and their compositions.

A keyword query is two passes over the texts without a shuffle of terms: corpus numbers
(documents, their mean length, and documents with each query term) and scores, of which
only the best ``k`` leave the tasks.  For many queries over one corpus, :func:`build_index`
writes postings once, and :func:`search_index` reads those of the query's terms alone; for a corpus
that changes :mod:`.fulltext` keeps them up.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vec

K1, B = 1.2, 0.75
RRF_K = 60


def _idf(n: int, with_term: int) -> float:
    got = math.log((n - with_term + 0.5) / (with_term + 0.5))
    return got if got > 0 else 1e-6


def _ranked(docs: DataFrame, query: str, text_col: str) -> DataFrame | None:
    """``docs`` with ``rank`` (negative BM25), null without a term of the query; None without terms."""
    asked = tx.query_terms(query)
    if not asked:
        return None
    terms = tx.terms(F.coalesce(F.col(text_col), F.lit("")))
    numbers = docs.select(terms.alias("_terms")).agg(F.count(F.lit(1)), F.avg(F.size("_terms")), *(F.count_if(F.array_contains("_terms", t)) for t in asked)).first()
    n, mean = numbers[0], float(numbers[1] or 1.0)

    def rank(own: Column) -> Column:
        score = F.lit(0.0)
        for t, with_term in zip(asked, numbers[2:], strict=True):
            tf = F.size(own) - F.size(F.array_remove(own, t))
            score = score + F.lit(_idf(n, with_term)) * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.size(own) / F.lit(mean)))
        return F.when(F.arrays_overlap(own, F.array(*(F.lit(t) for t in asked))), -score)

    return docs.withColumn("rank", tx.once(terms, rank))


def keyword_ranks(docs: DataFrame, query: str, text_col: str) -> DataFrame | None:
    """All of ``docs`` that have a term of the query, with ``rank``; None without terms."""
    ranked = _ranked(docs, query, text_col)
    return None if ranked is None else ranked.where(F.col("rank").isNotNull())


def score_l1(rank: Column) -> Column:
    """Between 0 and 1 from a BM25 rank; a rank that is not finite gives 1/1000."""
    odd = rank.isNull() | F.isnan(rank) | (F.abs(rank) == float("inf"))
    return F.when(odd, 1 / 1000).when(rank < 0, -rank / (1 - rank)).otherwise(1 / (1 + rank))


def score_l0(rank: Column) -> Column:
    """Like :func:`score_l1` for negative ranks, transformed twice for others."""
    x = F.when(rank < 0, -rank).otherwise(1 / (1 + rank))
    return x / (1 + x)


def keyword_search(docs: DataFrame, query: str, k: int, id_col: str = "record_id", text_col: str = "content", score=score_l1, index=None) -> DataFrame:
    """The ``k`` best by BM25 with ``score``, ties by id; none without query terms.

    With ``index`` (a :class:`~.fulltext.Index` of ``docs``) only postings of the query's terms and the ``k`` rows are read."""
    if index is not None:
        best = _held(index.search(query, k, score))
        ids = [r[0] for r in best.collect()]
        rows = docs.where(F.col(id_col).isin(ids)).join(F.broadcast(best.select(F.col("id").alias(id_col), "score")), id_col)
        return rows.select(*docs.columns, "score").orderBy(F.desc("score"), id_col)
    ranked = _ranked(docs, query, text_col)
    if ranked is None:
        return docs.limit(0).withColumn("score", F.lit(0.0))
    best = ranked.orderBy(F.col("rank").asc_nulls_last(), id_col).limit(k).where(F.col("rank").isNotNull())
    return best.withColumn("score", score(F.col("rank"))).drop("rank")


def build_index(docs: DataFrame, path: str, id_col: str, text_col: str, buckets: int = 64) -> None:
    """Write postings (term, id, tf, dl) by hash of the term, and the corpus numbers."""
    own = docs.select(F.col(id_col).alias("id"), tx.terms(F.coalesce(F.col(text_col), F.lit(""))).alias("t")).withColumn("dl", F.size("t"))
    postings = own.select("id", "dl", F.inline(tx.counts(F.col("t")))).select("term", "id", "dl", "tf")
    postings = postings.withColumn("bucket", F.pmod(F.crc32("term"), F.lit(buckets)).cast("int"))
    postings.repartition(buckets, "bucket").sortWithinPartitions("term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    own.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("mean"), F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{path}/corpus")


def search_index(spark, path: str, query: str, k: int) -> DataFrame:
    """(id, rank, score) of the best ``k``, from the postings of the query's terms."""
    asked = tx.query_terms(query)
    n, mean, buckets = spark.read.parquet(f"{path}/corpus").first()
    terms = spark.createDataFrame([(t,) for t in asked], "term string").withColumn("bucket", F.pmod(F.crc32("term"), F.lit(buckets)).cast("int"))
    wanted = [r[0] for r in terms.select("bucket").distinct().collect()]
    found = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(wanted) & F.col("term").isin(asked))
    df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = found.join(F.broadcast(df), "term")  # a row per query term
    part = F.when(idf > 0, idf).otherwise(1e-6) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / mean))
    ranks = weighed.groupBy("id").agg((-F.sum(part)).alias("rank"))
    return ranks.orderBy("rank", "id").limit(k).withColumn("score", score_l1(F.col("rank")))


def vector_search(vectors: DataFrame, query: list[float], k: int, id_col: str = "record_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest by cosine distance, ties by id; rows without a distance are dropped."""
    distance = vec.cosine_distance(F.col(vector_col), F.array(*(F.lit(float(x)) for x in query)))
    found = vectors.withColumn("distance", distance).where(F.col("distance").isNotNull() & ~F.isnan("distance"))
    return found.orderBy("distance", id_col).limit(k).withColumn("score", 1 - F.col("distance"))


def neighbours(new: DataFrame, vectors: DataFrame, k: int, id_col: str = "record_id", vector_col: str = "embedding", most: int = 10_000) -> DataFrame:
    """For each of a batch of new rows its ``k`` nearest others that are not in the batch.

    The batch is compared with all vectors in the tasks that read them, in blocks of about
    ``most`` new rows, and each task keeps and returns ``k`` per new row, however many it reads.
    """
    import numpy as np
    import pyarrow as pa

    schema, spark = "new_id string, candidate_id string, distance double", new.sparkSession
    asked = new.select(F.col(id_col).cast("string").alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v")).where(vec.nonzero(F.col("v")))
    others = vectors.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).alias("v")).join(new.select(F.col(id_col).cast("string").alias("id")), "id", "left_anti")
    sizes = asked.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy("d").collect()
    found = None
    for d, n in sizes:
        blocks = -(-n // most)
        for b in range(blocks):
            rows = asked.where((F.size("v") == d) & (F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)).orderBy("id").collect()
            if not rows:
                continue
            q = np.array([r[1] for r in rows])
            held = spark.sparkContext.broadcast((np.array([r[0] for r in rows], object), q / np.linalg.norm(q, axis=1, keepdims=True)))

            def nearest(batches, held=held, d=d):
                own_ids, own = held.value
                best, names_of = np.zeros((len(own), 0)), np.zeros((len(own), 0), "U1")
                for batch in batches:
                    for lo in range(0, batch.num_rows, 4096):
                        part = batch.slice(lo, 4096)
                        names = np.array(part.column(0).to_pylist(), "U")
                        x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
                        length = np.linalg.norm(x, axis=1)
                        names, x = names[length > 0], x[length > 0] / length[length > 0, None]
                        if not len(names):
                            continue
                        place, most_ = np.argsort(np.argsort(names)), min(k, best.shape[1] + len(names))
                        after, after_of = np.empty((len(own), most_)), np.empty((len(own), most_), np.promote_types(names.dtype, names_of.dtype))
                        for a in range(0, len(own), 256):
                            dist = 1 - own[a : a + 256] @ x.T
                            order = np.lexsort((np.broadcast_to(place, dist.shape), dist), axis=1)[:, :k]
                            both = np.concatenate([best[a : a + 256], np.take_along_axis(dist, order, 1)], 1)
                            both_of = np.concatenate([names_of[a : a + 256], names[order]], 1)
                            order = np.lexsort((both_of, both), axis=1)[:, :most_]
                            after[a : a + 256], after_of[a : a + 256] = np.take_along_axis(both, order, 1), np.take_along_axis(both_of, order, 1)
                        best, names_of = after, after_of
                row = np.repeat(np.arange(len(own)), best.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(own_ids[row]), pa.array(names_of.ravel().tolist(), pa.string()), pa.array(best.ravel())], names=["new_id", "candidate_id", "distance"])

            part = others.where(F.size("v") == d).mapInArrow(nearest, schema)
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], schema)
    rank = F.row_number().over(Window.partitionBy("new_id").orderBy("distance", "candidate_id"))
    return found.withColumn("r", rank).where(F.col("r") <= k).drop("r")


def fuse(lists: list[DataFrame], id_col: str = "record_id", k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (each with ``id_col`` and ``pos`` from 0).

    Sums 1 / (k + pos + 1) of all places, an id's repeats in a list too; ``first`` is the
    place of its first appearance over the lists one after another, the tie-break.
    """
    both = None
    for i, one in enumerate(lists):
        part = one.select(id_col, F.col("pos").cast("long").alias("pos"), F.lit(i).alias("list"))
        both = part if both is None else both.unionByName(part)
    share = F.array_sort(F.collect_list(F.struct("list", "pos")))  # as many as there are lists, summed in their order
    fused = both.groupBy(id_col).agg(share.alias("at"))
    total = F.aggregate("at", F.lit(0.0), lambda s, x: s + 1.0 / (k + x["pos"] + 1))
    return fused.select(id_col, total.alias("rrf"), F.element_at("at", 1).alias("first")).orderBy(F.desc("rrf"), "first.list", "first.pos")


def positions(ranked: DataFrame, *order: Column) -> DataFrame:
    """A short ranked list with ``pos`` from 0."""
    return ranked.withColumn("pos", F.row_number().over(Window.orderBy(*order)) - 1)


def _held(found: DataFrame) -> DataFrame:
    """A list of bounded length, evaluated once."""
    return found.sparkSession.createDataFrame(found.collect(), found.schema)


def hybrid(docs: DataFrame, query: str, k: int, vectors: DataFrame | None = None, embedding: list[float] | None = None, id_col: str = "record_id", text_col: str = "content", score=score_l1, by_results: bool = True, index=None) -> tuple[DataFrame, str]:
    """The ``k`` best of each branch that can run, fused if both do; and the strategy's name.

    The strategy is that of the branches that found something, or with ``by_results`` off of
    those that could run; without any result it is that of what there is, or ``none``.
    """
    by_text = bool(tx.query_terms(query))
    has_vectors = vectors is not None and embedding is not None
    by_vector = has_vectors and any(embedding)
    texts = keyword_search(docs, query, k, id_col, text_col, score, index) if by_text else None
    if by_vector:
        near = vector_search(vectors, embedding, k + 10, id_col).select(id_col, "distance", "score").join(docs, id_col)
        near = near.orderBy("distance", id_col).limit(k)
    if by_results and by_text and by_vector:
        texts, near = _held(texts), _held(near)
        by_text, by_vector = not texts.isEmpty(), not near.isEmpty()
    if by_text and by_vector:
        a = positions(texts.select(id_col, "score"), F.desc("score"), F.col(id_col))
        b = positions(near.select(id_col, "distance"), F.col("distance"), F.col(id_col))
        ranked = fuse([a, b], id_col).withColumnRenamed("rrf", "score")
        rows = texts.drop("score").unionByName(near.drop("score", "distance")).dropDuplicates([id_col]) if by_results else docs
        return rows.join(F.broadcast(ranked), id_col).withColumn("_o", F.struct(-F.col("score"), "first.list", "first.pos")).drop("first"), "hybrid"
    if by_vector:
        return near.withColumn("_o", F.struct("distance", F.col(id_col))).drop("distance"), "embedding"
    if by_text:
        return texts.withColumn("_o", F.struct(-F.col("score"), F.col(id_col))), "fts"
    return docs.limit(0).withColumns({"score": F.lit(0.0), "_o": F.lit(0)}), "embedding" if has_vectors else "fts" if query.strip() else "none"


def search_memories(l1: DataFrame, query: str, limit: int = 5, vectors: DataFrame | None = None, embedding: list[float] | None = None, kind: str | None = None, scene: str | None = None, index=None) -> DataFrame:
    """Facts: candidates of three times the limit, then the filters, then the limit."""
    found, strategy = hybrid(l1, query, 3 * limit, vectors, embedding, index=index)
    if kind:
        found = found.where(F.col("type") == kind)
    if scene:
        found = found.where(F.lower("scene_name").contains(scene.lower()))
    found = found.orderBy("_o").limit(limit)
    return found.select("record_id", "content", "type", "priority", "scene_name", "score", F.col("timestamp_start").alias("created_at"), F.col("timestamp_end").alias("updated_at"), F.lit(strategy).alias("strategy"))


def search_conversations(l0: DataFrame, query: str, limit: int = 5, vectors: DataFrame | None = None, embedding: list[float] | None = None, session_key: str | None = None, index=None) -> DataFrame:
    """Messages: candidates of three times the limit (four with a session filter), then the filter and limit."""
    found, strategy = hybrid(l0, query, (4 if session_key else 3) * limit, vectors, embedding, text_col="message_text", score=score_l0, index=index)
    if session_key:
        found = found.where(F.col("session_key") == session_key)
    found = found.orderBy("_o").limit(limit)
    return found.select("record_id", "session_key", "role", F.col("message_text").alias("content"), "score", "recorded_at", F.lit(strategy).alias("strategy"))


def threshold_with_fallback(found: DataFrame, least: float, limit: int) -> DataFrame:
    """Rows of a short list with a sufficient score; if none has, all, provided they are at
    most half the limit."""
    whole = Window.partitionBy(F.lit(0))
    ok = F.col("score") >= least
    flagged = found.withColumns({"_any": F.max(ok).over(whole), "_n": F.count(F.lit(1)).over(whole)})
    return flagged.where(ok | (~F.col("_any") & (F.col("_n") <= limit / 2))).drop("_any", "_n")


def recall(l1: DataFrame, query: str, max_results: int = 5, least: float = 0.3, strategy: str = "hybrid", vectors: DataFrame | None = None, embedding: list[float] | None = None, index=None) -> DataFrame:
    """Facts for a turn, in order of ``_o``: keyword and embedding recall apply the threshold, the
    hybrid one does not."""
    can_vector = vectors is not None and embedding is not None and any(embedding)
    if strategy == "hybrid" and can_vector:
        found, name = hybrid(l1, query, 3 * max_results, vectors, embedding, by_results=False, index=index)
    elif strategy == "embedding" and can_vector:
        found, name = hybrid(l1, "", 2 * max_results, vectors, embedding)
        found = found.where(F.col("score") >= least)
    else:
        found, name = hybrid(l1, query, 2 * max_results, index=index)
        found = threshold_with_fallback(found, least, 2 * max_results)
    return found.orderBy("_o").limit(max_results).withColumn("strategy", F.lit(name))
