"""Near-duplicate documents by b-bit MinHash.

A document is the set of its word shingles.  One pass over the texts makes, for each
document, the minima of ``HASHES`` hash functions; the low ``BITS`` bits of each are
packed into a signature of a few longs, and every ``ROWS`` whole minima hash to a band
key.  From there on:

1. Documents with equal sets become one node, by a digest of the set.
2. Nodes that share a band key are candidates.  A bucket is not expanded into pairs:
   its nodes are compared with one hub, then (where parts of it are still apart) with
   another, and what is apart then is compared across the parts, in blocks: first by
   their signatures, then, for nodes whose signature is near another's, by their texts.
3. A candidate pair is kept if its sizes allow the similarity and the estimate from its
   signatures (equal lanes, corrected for chance) is within ``SIGMAS`` of it, and is
   confirmed on the full sets of both texts.
4. Confirmed links are joined into components round by round.

With 24 bands of 4 rows a pair at a similarity of 0.85 has no band in common with a
probability of 2e-8, one at 0.8 with 3e-6.  Signatures turn a pair away with less than 1e-9.

Copies of a set that has very many are joined by a broadcast of such sets, of which there are
at most ``HOT_SETS``, so that none gathers in a task.

Defined results: a null or empty text, and one without words, has no shingles and is
linked with nothing.  A text of fewer words than a shingle is one shingle.  Rows of one
doc_id are one document of the graph.  Rows without a doc_id are linked with nothing:
their component is null and they are not kept by the query, while :func:`deduplicate`
keeps them.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .columns import apart
from .components import components
from .scratch import table

ROWS, BANDS = 4, 24
HASHES = ROWS * BANDS
BITS = 4
LANES = 64 // BITS
LONGS = HASHES // LANES
SIGMAS = 7.0
#: Nodes of a bucket in a block of the last, exhaustive comparison, and shingles of them (a
#: task holds the texts and sets of two blocks); also the shingles whose sets are multiplied at once.
BLOCK, BLOCK_SHINGLES = 512, 1_000_000
#: Sets with so many copies, and more than all rows over ``HOT_SETS``, are joined by broadcast.
HOT_COPIES, HOT_SETS = 1_000, 100_000
#: Shared shingles that are counted at once in that comparison.
COLUMNS = 4096
#: Ids that may be broadcast to filter texts; more are joined.
BROADCAST_IDS = 1_000_000

_rng = np.random.default_rng(7)
_MUL = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
_C = [np.uint64(int(x) * 2 + 1) for x in _rng.integers(1, 2**62, 4)]


def shingle_sets(w: K.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted, one text after another, and their bounds."""
    counts = np.diff(w.bounds)
    per = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    ends = np.cumsum(per)
    g = K.grams(w.hashes, size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    first = np.zeros(len(out), dtype=bool)
    for k, (n, b) in enumerate(zip(per.tolist(), ends.tolist(), strict=True)):
        if not n:
            continue
        a, at = b - n, int(w.bounds[k])
        if counts[k] >= size:
            out[a:b] = g[at : at + n]
            out[a:b].sort()
        else:
            out[a] = K.whole(w.hashes[at : at + int(counts[k])])
        first[a] = True
    keep = first.copy()
    keep[1:] |= out[1:] != out[:-1]
    cum = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], cum[np.concatenate([[0], ends])]


def _sketch(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """doc_id, text -> doc_id, n, s1, s2, bands, sig."""
    for batch in batches:
        data, offs = K.texts(batch.column(1))
        rows = batch.num_rows
        n, s1, s2 = np.zeros(rows, np.int64), np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
        bands, sig = np.zeros((rows, BANDS), np.uint64), np.zeros((rows, LONGS), np.uint64)
        for lo, hi in K.chunks(offs):
            u, bounds = shingle_sets(K.words(data, offs[lo : hi + 1], K.SPACED), size)
            n[lo:hi] = np.diff(bounds)
            has = np.flatnonzero(n[lo:hi])
            if not len(has):
                continue
            at, rows_at = bounds[has], has + lo
            s1[rows_at] = np.add.reduceat(K.mix(u ^ _C[0]), at)
            s2[rows_at] = np.add.reduceat(K.mix(u ^ _C[1]), at)
            low = np.empty((HASHES, len(has)), np.uint64)
            for k in range(HASHES):
                low[k] = np.minimum.reduceat(u * _MUL[k] + _ADD[k], at)
            for b in range(BANDS):
                key = np.full(len(has), np.uint64(b))
                for r in range(ROWS):
                    key = K.mix((key + low[b * ROWS + r]) * _C[2])
                bands[rows_at, b] = key
            lane = K.mix(low) & np.uint64(2**BITS - 1)
            for k in range(HASHES):
                sig[rows_at, k // LANES] |= lane[k] << np.uint64(BITS * (k % LANES))
        arrays = [pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel().view(np.int64))) for x in (bands, sig)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), *arrays], names=["doc_id", "n", "s1", "s2", "bands", "sig"])


def _confirm(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """a, b, text_a, text_b -> the pairs (a, b) whose full sets are similar enough."""
    for batch in batches:
        left, right = K.texts(batch.column(2)), K.texts(batch.column(3))
        kept, last, held = [], None, None
        for k in range(batch.num_rows):
            one = shingle_sets(K.words(left[0], left[1][k : k + 2], K.SPACED), size)[0]
            at = right[1][k : k + 2]
            own = right[0][at[0] : at[1]].tobytes()
            if own != last:
                last, held = own, shingle_sets(K.words(right[0], at, K.SPACED), size)[0]
            both = np.sort(np.concatenate([one, held]))
            same = int(np.count_nonzero(both[1:] == both[:-1]))
            if 100 * same >= percent * (len(one) + len(held) - same) and same:
                kept.append(k)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).take(pa.array(kept, pa.int64()))


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections, from products of 0/1 matrices over shared shingles."""
    every = [*left, *right]
    flat = np.concatenate(every)
    row = np.repeat(np.arange(len(every)), [len(x) for x in every])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    often = count > 1
    number = np.cumsum(often) - 1
    keep = often[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, int(often.sum()), COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        m = np.zeros((len(every), COLUMNS), np.float32)
        m[row[a:b], column[a:b] - lo] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each (band, i, j), of batches sorted by them."""
    key, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy() for k in range(3)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        for lo, hi in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows], strict=True):
            at = tuple(int(c[lo]) for c in cols)
            if at != key:
                if parts:
                    yield pa.concat_batches(parts)
                key, parts = at, []
            parts.append(batch.slice(lo, hi - lo))
    if parts:
        yield pa.concat_batches(parts)


def _longs(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1).view(np.uint64)


def _near(rows: pa.RecordBatch, percent: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, near): places of the two sides of a block, and which pairs sizes and
    signatures allow, across components and without an earlier band in common."""
    band, i, j = (int(rows.column(k)[0].as_py()) for k in range(3))
    own = rows.column(3).to_numpy()
    left = np.arange(len(own)) if i == j else np.flatnonzero(own == i)
    right = np.arange(len(own)) if i == j else np.flatnonzero(own == j)
    comp = rows.column(5).dictionary_encode().indices.to_numpy()
    n, bands, sig = rows.column(6).to_numpy(), _longs(rows.column(7)), _longs(rows.column(8))
    low, high = np.minimum(n[left][:, None], n[right]), np.maximum(n[left][:, None], n[right])
    near = (comp[left][:, None] != comp[right]) & (100 * low >= percent * high)
    if i == j:
        near &= left[:, None] < right
    if not near.any():
        return left, right, near
    place = int(np.flatnonzero(bands[0] == np.int64(band).view(np.uint64))[0])
    for k in range(place):  # pairs that share an earlier band are compared there
        near &= bands[left][:, None, k] != bands[right][:, k]
    apart = np.zeros(near.shape, np.int64)
    for k in range(sig.shape[1]):
        x = sig[left][:, None, k] ^ sig[right][:, k]
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        apart += np.bitwise_count(x & np.uint64(0x1111111111111111))
    near &= HASHES - apart >= least
    return left, right, near


def _alike(batches: Iterator[pa.RecordBatch], percent: int, least: int) -> Iterator[pa.RecordBatch]:
    """Rows (band, i, j, own, node, comp, n, bands, sig) of blocks -> those that signatures put near another."""
    for rows in _blocks(batches):
        left, right, near = _near(rows, percent, least)
        keep = np.zeros(rows.num_rows, dtype=bool)
        keep[left[near.any(1)]] = True
        keep[right[near.any(0)]] = True
        if keep.any():
            yield rows.filter(pa.array(keep))


def _all_pairs(batches: Iterator[pa.RecordBatch], size: int, percent: int, least: int) -> Iterator[pa.RecordBatch]:
    """The rows of :func:`_alike` with their texts -> links across components."""
    for rows in _blocks(batches):
        left, right, near = _near(rows, percent, least)
        if not near.any():
            continue
        sets = [shingle_sets(K.words(*K.texts(rows.column(9).slice(k, 1)), K.SPACED), size)[0] for k in range(rows.num_rows)]
        n = rows.column(6).to_numpy()
        for a in _pieces(n[left]):
            for b in _pieces(n[right]):
                own = near[a, b]
                if own.any():
                    both = _shared([sets[k] for k in left[a]], [sets[k] for k in right[b]])
                    own &= 100 * both >= percent * (n[left[a]][:, None] + n[right[b]] - both)
        comp = rows.column(5).dictionary_encode().indices.to_numpy()
        found, root = [], list(range(int(comp.max()) + 1))
        for x, y in zip(*np.nonzero(near), strict=True):
            p, q = int(comp[left[x]]), int(comp[right[y]])
            while root[p] != p:
                p = root[p]
            while root[q] != q:
                q = root[q]
            if p != q:  # at most a link for each row
                root[p] = q
                found.append((int(left[x]), int(right[y])))
        node = rows.column(4)
        yield pa.RecordBatch.from_arrays([node.take(pa.array([x[c] for x in found], pa.int64())) for c in (0, 1)], names=["a", "b"])


def _pieces(n: np.ndarray) -> list[slice]:
    """Slices of at most ``BLOCK_SHINGLES`` shingles, or of one row."""
    out, start, total = [], 0, 0
    for k, x in enumerate(n.tolist()):
        if k > start and total + x > BLOCK_SHINGLES:
            out.append(slice(start, k))
            start, total = k, 0
        total += x
    return [*out, slice(start, len(n))]


def _equal_lanes(a: str, b: str) -> Column:
    """How many lanes of the two signatures are equal."""
    out = []
    for k in range(LONGS):
        x = f"({a}[{k}] ^ {b}[{k}])"
        x = f"({x} | shiftrightunsigned({x}, 1))"
        out.append(f"bit_count(({x} | shiftrightunsigned({x}, 2)) & {0x1111111111111111}L)")
    return F.expr(f"{HASHES} - ({' + '.join(out)})")


def least_lanes(percent: int) -> int:
    """Equal lanes of a pair just at the similarity, less ``SIGMAS`` standard deviations."""
    chance = 2.0**-BITS
    p = chance + (1 - chance) * percent / 100
    return int(HASHES * p - SIGMAS * (HASHES * p * (1 - p)) ** 0.5)


class _Graph:
    """Candidates and links of one table of documents."""

    def __init__(self, docs: DataFrame, size: int, percent: int):
        self.size, self.percent, self.docs = size, percent, docs
        kind = dict(docs.dtypes)["doc_id"]
        schema = f"doc_id {kind}, n long, s1 long, s2 long, bands array<bigint>, sig array<bigint>"
        self.rows = table(docs.mapInArrow(lambda x, s=size: _sketch(x, s), schema), "sketches")
        sets = self.rows.where("n > 0 and doc_id is not null").select("doc_id", "n", "s1", "s2")
        self.total = total = self.rows.count()
        nodes = table(sets.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies")), "sets", total)
        many = F.col("copies") > max(HOT_COPIES, total // HOT_SETS)
        hot = F.broadcast(nodes.where(many).drop("copies"))
        rare = sets.join(hot, ["n", "s1", "s2"], "left_anti").join(nodes.where(~many), ["n", "s1", "s2"])
        self.member = table(rare.select("doc_id", "n", "node").unionByName(sets.join(hot, ["n", "s1", "s2"]).select("doc_id", "n", "node")), "members", total)
        self.links_kind = kind

    def run(self) -> DataFrame:
        """(node, comp) of the nodes that have links."""
        reps = self.rows.where(f"n * {100 - self.percent} >= {self.percent} and doc_id is not null")  # a smaller set has only equal ones
        reps = reps.join(self.member.where("doc_id = node").select("node", F.col("n").alias("m")).distinct(), (F.col("doc_id") == F.col("node")) & (F.col("n") == F.col("m")))
        self.reps = table(reps.select("node", "n", "sig", "bands"), "nodes")
        rows = self.reps.select("node", "n", F.explode("bands").alias("band"))
        hubs = rows.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("other")).where("hub <> other")
        # a hub per bucket, and all that share it
        self.shared = table(rows.join(hubs.select("band", "hub"), "band"), "buckets")
        ids = self.shared.select("node").distinct()
        few = ids.count() <= BROADCAST_IDS
        known = F.broadcast(ids) if few else ids
        self.texts = table(self.docs.select(F.col("doc_id").alias("node"), "text").where("node is not null").join(known, "node", "left_semi"), "texts")
        twice = self.member.where("doc_id <> node").join(self.member.where("doc_id = node").select(F.col("node").alias("own")).distinct(), F.col("doc_id") == F.col("own"), "left_semi")
        links = self._confirmed(self.shared.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))).union(twice.select("doc_id", "node"))
        labels = components(links)
        pairs = self._again(labels)
        if pairs is None:
            return labels
        more = self._confirmed(pairs)
        labels = labels if more.isEmpty() else self._joined(labels, more)
        more = self._exhausted(labels)
        return labels if more is None or more.isEmpty() else self._joined(labels, more)

    def _joined(self, labels: DataFrame, links: DataFrame) -> DataFrame:
        """The labels after some more links, by the components of components."""
        for c in ("a", "b"):
            links = self._labelled(links, labels, c).withColumn(c, F.col("comp")).drop("comp")
        step = components(links)
        whole = labels.select("node", F.col("comp").alias("own")).union(step.select("node", "node")).distinct()
        moved = whole.join(step.select(F.col("node").alias("own"), "comp"), "own", "left")
        return table(moved.groupBy("node").agg(F.min(F.coalesce("comp", "own")).alias("comp")), "components", self.total)

    @staticmethod
    def _labelled(df: DataFrame, labels: DataFrame, column: str) -> DataFrame:
        found = labels.select(F.col("node").alias("_of"), F.col("comp").alias("_is"))
        return df.join(found, F.col(column) == F.col("_of"), "left").withColumn("comp", F.coalesce("_is", F.col(column))).drop("_of", "_is")

    def _bands(self, bands: DataFrame) -> DataFrame | None:
        """A written table with a row for each band, to be broadcast if it is small; None without rows."""
        bands = table(bands, "bands", BANDS * self.total)
        n = bands.count()
        return None if not n else F.broadcast(bands) if n <= BROADCAST_IDS else bands

    def _again(self, labels: DataFrame) -> DataFrame | None:
        """Candidates in different components, with another hub of each bucket that is still apart."""
        rows = self._labelled(self.shared.select("node", "band"), labels, "node")
        hub = F.min_by("node", F.xxhash64(F.lit(1), "band", "node")).alias("hub")
        apart = self._bands(rows.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("size"), hub).where("low <> high and size > 2").select("band", "hub"))
        if apart is None:
            return None
        pairs = self._labelled(rows.join(apart, "band").where("node <> hub").withColumnRenamed("comp", "c"), labels, "hub").where("c <> comp")
        return pairs.select(F.col("node").alias("a"), F.col("hub").alias("b"))

    def _exhausted(self, labels: DataFrame) -> DataFrame | None:
        """Links across components from all pairs of each bucket that are still apart.

        The nodes of a bucket's largest component, which need no comparison with one another,
        and the rest of it are cut into blocks of so many nodes and shingles, and a task holds two of them, one at least of
        the rest: a signature is sent once for each block that it is compared with, not for
        each pair.  Texts follow for the nodes that are near another by size and signature,
        and what comes back is at most a link for each of them.
        """
        rows = self._labelled(self.shared.select("node", "n", "band"), labels, "node")
        each = rows.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"))
        top = F.max(F.struct("size", "shingles", "comp")).alias("top")
        apart = each.groupBy("band").agg(top, F.sum("size").alias("size"), F.sum("shingles").alias("shingles"), F.count(F.lit(1)).alias("comps")).where("comps > 1 and size > 2")
        part = lambda n, m: F.greatest(F.ceil(n / BLOCK), F.ceil(m / BLOCK_SHINGLES), F.lit(1)).cast("int")
        others = part(F.col("size") - F.col("top.size"), F.col("shingles") - F.col("top.shingles"))
        apart = self._bands(apart.select("band", F.col("top.comp").alias("major"), others.alias("rest"), part(F.col("top.size"), F.col("top.shingles")).alias("most")))
        if apart is None:
            return None
        full = rows.drop("n").join(apart, "band").withColumn("in_most", F.col("comp") == F.col("major"))
        own = F.when(F.col("in_most"), F.col("rest") + F.pmod(F.xxhash64("node"), F.col("most"))).otherwise(F.pmod(F.xxhash64("node"), F.col("rest"))).cast("int")
        pairs = F.expr("transform(sequence(0, if(in_most, rest, rest + most) - 1), k -> struct(least(k, own) as i, greatest(k, own) as j))")
        columns = ["band", "i", "j", "own", "node", "comp", "n", "bands", "sig"]
        full = full.withColumn("own", own).withColumn("p", F.explode(pairs)).select("band", "p.i", "p.j", "own", "node", "comp").join(self.reps.select("node", "n", "bands", "sig"), "node").select(*columns)
        n = int(self.docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = lambda df: df.repartition(n, "band", "i", "j").sortWithinPartitions("band", "i", "j")
        size, percent, least, kind = self.size, self.percent, least_lanes(self.percent), self.links_kind
        alike = table(dealt(full).mapInArrow(lambda x: _alike(x, percent, least), full.schema), "alike")
        if alike.isEmpty():
            return None
        with_texts = dealt(alike.join(self.texts, "node").select(*columns, "text"))
        return table(with_texts.mapInArrow(lambda x: _all_pairs(x, size, percent, least), f"a {kind}, b {kind}"), "confirmed")

    def _possible(self, n: str, m: str) -> Column:
        return (100 * F.least(n, m)) >= (self.percent * F.greatest(n, m))

    def _confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that sizes, signatures and then the full sets confirm, as a table."""
        a, b = (self.reps.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}")) for c in "ab")
        near = pairs.distinct().join(a, "a").join(b, "b").where(self._possible("n_a", "n_b") & (_equal_lanes("sig_a", "sig_b") >= least_lanes(self.percent))).select("a", "b")
        with_texts = near.join(self.texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(self.texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        size, percent = self.size, self.percent
        found = with_texts.select("a", "b", "text_a", "text_b").mapInArrow(lambda x: _confirm(x, size, percent), f"a {self.links_kind}, b {self.links_kind}")
        return table(found, "confirmed")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Documents are linked if 100 * intersection >= ``percent`` * union of their sets of
    ``shingle``-word shingles (A-Z lower-cased, words between white space).
    """
    graph = _Graph(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), shingle, percent)
    labels = graph.run()
    known = _Graph._labelled(graph.member, labels, "node").select("doc_id", F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"))
    rest = graph.rows.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    out = known.unionByName(rest)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with exactly one row of each component: that with the least id (a row without one
    comes last), the first of equal ones.

    Rows are numbered in a written table, so rows that share an id, or have none, are documents of
    their own; rows without words are linked with nothing and stay.
    """
    return apart(docs, (), (), lambda d, own: _deduplicated(d, own(id_col), own(text_col), shingle, percent))


def _deduplicated(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    columns, number = docs.columns, "row"
    rows = table(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    graph = _Graph(rows.select(F.col(number).alias("doc_id"), F.col(f"`{text_col}`").alias("text")), shingle, percent)
    found = _Graph._labelled(graph.member, graph.run(), "node").select("doc_id", "comp")
    ids = rows.select(F.col(number).alias("doc_id"), F.col(f"`{id_col}`").alias("id"))
    found = found.join(ids, "doc_id").withColumn("order", F.struct(F.col("id").isNull(), "id", "doc_id"))
    stay = found.groupBy("comp").agg(F.min("order").getField("doc_id").alias("_stay")).select("_stay")
    gone = found.join(stay, F.col("doc_id") == F.col("_stay"), "left_anti").select(F.col("doc_id").alias("_gone"))
    return rows.join(gone, F.col(number) == F.col("_gone"), "left_anti").select(*(f"`{c}`" for c in columns))
