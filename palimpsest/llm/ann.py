"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are turned to unit length and padded to a power-of-two dimension.  Each table turns
them by pseudo-rotations, three rounds of random signs and a fast Hadamard transform, and
assigns them to the nearest signed axis (with ``hashes=2``, to a pair of axes of two
rotations).  A query probes the nearest cells of each table; what is in them are its
candidates, which are ranked by the exact inner product in double precision.

The measure is the inner product, so lengths matter and the hash does not see them: the
index is cut into bands of norm, each band ``RATIO`` times shorter than the last, and every
band is searched on its own.  A band of at most ``WHOLE`` vectors is one cell.

How many tables, axes and probes a band gets is fitted: up to ``SAMPLE`` queries are compared
with the whole index, and the cheapest choice is taken that finds ``TARGET`` of their
neighbours in the band.  Where vectors have no clusters that is a large share of all cells.
Every vector is indexed and every query searched; only the fit sees a sample.  A query that
still finds fewer than ``k`` neighbours is compared with the whole index, in blocks.

Vectors travel once for each table, and queries once for each group of cells that they
probe.  A group holds about ``GROUP_BYTES`` of vectors; a cell of more is cut into blocks,
groups of their own, which its queries visit all: nothing is left out, and no task holds a
whole hot cell.  Of equal vectors only the ``k + 1`` least ids are indexed; no query can have
another among its ``k`` nearest.

Defined results: vectors that are null, empty or zero, or hold null or non-finite components,
take no part; nor do rows without an id.  Vectors of different lengths have no inner product:
each length is searched on its own (more than ``LENGTHS`` of them raise ``ValueError``).  Rows
of one id and vector count once; an id with several vectors is ranked by its best.  A query
has fewer than ``k`` rows only if there are no more candidates.  Other columns of the table
are not looked at.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as K
from .scratch import table

#: Numbers of tables that the fit chooses from, and the most probes of a table.
TABLES, PROBES = (2, 3, 4, 6, 8), 16_384
#: Queries of the fit, and the share of their neighbours that it must find.
SAMPLE, TARGET = 200, 0.96
#: Norms of a band are within this factor; the last band takes all that are shorter.
RATIO, BANDS = 1.25, 12
#: Vectors of a band that are one cell.
WHOLE = 1024
#: Vectors of a cell from which pairs of axes are tried too.
FINE = 1024
#: Bytes of index vectors, in double precision, of a group of cells.
GROUP_BYTES = 4 << 20
#: Candidates kept by their products until the exact sums, so that rounding cannot cost one.
SPARE = 8
#: Candidate rows a task gathers before it reduces them.
HELD = 500_000
#: Bytes of query vectors, in double precision, that one pass over the index compares.
QUERY_BYTES = 16_000_000
#: Index vectors of a block in that comparison.
BLOCK = 4096
#: Different lengths of vectors in one table.
LENGTHS = 64


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised Hadamard transform of each row."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], (3, x.shape[1]))
    for s in signs:
        x = hadamard(x * s)
    return x


def cells(x: np.ndarray, tables: int, hashes: int, probes: int) -> np.ndarray:
    """The ``probes`` nearest cells of each row in each table: [row, table, probe]."""
    n, d = x.shape
    probes = min(probes, (2 * d) ** hashes)
    out = np.zeros((n, tables, probes), np.int64)
    for t in range(tables):
        best, value = [], []
        for j in range(hashes):
            y = rotate(x, t * hashes + j)
            both = np.stack([y, -y], 2).reshape(n, -1)  # axis k: 2k, its opposite: 2k + 1
            at = np.argmax(both, axis=1)[:, None] if probes == 1 else np.argsort(-both, axis=1, kind="stable")[:, :probes]
            best.append(at)
            value.append(np.take_along_axis(both, at, 1))
        if hashes == 1:
            out[:, t] = best[0]
            continue
        combos = [c for c in product(range(best[0].shape[1]), repeat=hashes) if np.prod([k + 1 for k in c]) <= probes]  # a combination that can be among the best
        score = np.stack([sum(value[j][:, k] for j, k in enumerate(c)) for c in combos], 1)
        code = np.stack([sum(best[j][:, k] * (2 * d) ** j for j, k in enumerate(c)) for c in combos], 1)
        out[:, t] = np.take_along_axis(code, np.argsort(-score, axis=1, kind="stable")[:, :probes], 1)  # there are as many combinations at least
    return out


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors of a power-of-two dimension."""
    n, d = x.shape
    out = np.zeros((n, 1 << (d - 1).bit_length()))
    x = x / np.abs(x).max(1, keepdims=True)
    out[:, :d] = x / np.linalg.norm(x, axis=1, keepdims=True)
    return out


# ---- the fit


@dataclass
class Band:
    """How the vectors of a band are hashed and grouped."""

    size: int
    tables: int = 1
    hashes: int = 0
    probes: int = 1
    groups: int = 1
    #: (table, cell) -> first group and blocks of cells that are cut
    hot: dict[tuple[int, int], tuple[int, int]] = field(default_factory=dict)

    def cells(self, x: np.ndarray, probes: int) -> np.ndarray:
        return cells(_unit(x), self.tables, self.hashes, probes) if self.hashes else np.zeros((len(x), 1, 1), np.int64)

    def group(self, c: np.ndarray) -> np.ndarray:
        return (K.mix(c.astype(np.uint64)) % np.uint64(self.groups)).astype(np.int64)


def _choose(size: int, n_queries: int, groups: int, q: np.ndarray, v: np.ndarray, row: np.ndarray, hashes: tuple[int, ...]) -> tuple[int, int, int]:
    """(tables, hashes, probes): the cheapest that finds ``TARGET`` of the pairs (q[row], v)."""
    best, axes = None, 2 << (q.shape[1] - 1).bit_length()
    if not len(v):  # nothing of the band is near any query of the sample
        return TABLES[0], hashes[0], max(1, axes ** hashes[0] // 16)
    q, v = _unit(q), _unit(v)
    for h in hashes:
        every = axes**h
        limit = min(every, PROBES)
        own, rank = cells(v, max(TABLES), h, 1)[:, :, 0], np.full((len(v), max(TABLES)), limit)
        near = cells(q, max(TABLES), h, limit)
        for k in range(len(v)):
            at = near[row[k]] == own[k][:, None]
            rank[k] = np.where(at.any(1), at.argmax(1), limit)
        for t in TABLES:
            first = np.sort(rank[:, :t].min(1))
            probes = int(first[int(np.ceil(TARGET * len(first))) - 1]) + 1
            if len(first) < SAMPLE:  # few pairs tell little
                probes = max(probes, every // 16)
            if probes > limit:
                continue
            visits = n_queries * t * probes
            cost = size * t + n_queries * t * min(probes, groups) + 0.2 * visits + 0.01 * visits * size / every
            if best is None or cost < best[0]:
                best = cost, (t, h, probes)
    return best[1] if best else (TABLES[0], 1, axes)


def _fit(index: DataFrame, queries: DataFrame, n_queries: int, d: int, k: int, tables: int | None, probes: int | None, hashes: int | None) -> dict[int, Band]:
    """The bands of the index, by their number."""
    bands = {r[0]: Band(r[1]) for r in index.groupBy("band").count().collect()}
    hashed = {b: x for b, x in bands.items() if x.size > WHOLE}
    rows = max(WHOLE, GROUP_BYTES // (8 * d))
    for x in hashed.values():
        x.groups = -(-x.size // rows)
    if hashed and probes is not None:
        for x in hashed.values():
            x.tables, x.hashes, x.probes = tables or max(TABLES), hashes or 1, probes
    elif hashed:
        some = queries.orderBy(F.xxhash64(F.lit(1), "id"), "id").limit(SAMPLE)
        if n_queries < SAMPLE:
            some = some.union(index.select("id", "v").orderBy(F.xxhash64(F.lit(1), "id"), "id").limit(SAMPLE - n_queries))
        got = some.toArrow()
        ids, q = got.column(0).to_numpy(), _matrix(got.column(1).combine_chunks(), d)
        held = index.sparkSession.sparkContext.broadcast((ids, q, np.full(len(ids), -np.inf)))
        true = _ranked(index.select("id", "v").mapInArrow(lambda x: _scan(x, held, d, k), "query_id long, vec_id long, score double"), k)
        pairs = index.join(F.broadcast(true.select("query_id", F.col("vec_id").alias("id"))), "id").select("query_id", "band", "v").toArrow()
        order = np.argsort(ids, kind="stable")
        row = order[np.searchsorted(ids[order], pairs.column(0).to_numpy())]
        band, v = pairs.column(1).to_numpy(), _matrix(pairs.column(2).combine_chunks(), d)
        for b, x in hashed.items():
            own = band == b
            both = x.size > FINE * 2 * d  # axes alone would make large cells
            x.tables, x.hashes, x.probes = _choose(x.size, n_queries, x.groups, q, v[own], row[own], (hashes,) if hashes else (1, 2) if both else (1,))
    if hashed:
        plan = dict(hashed)
        counts = index.where(F.col("band").isin(list(hashed))).select("band", "v").mapInArrow(lambda x: _cells_of(x, plan, d), "band int, t int, cell long").groupBy("band", "t", "cell").count()
        free = {b: x.groups for b, x in hashed.items()}
        for b, t, cell, n in counts.where(F.col("count") > rows // 2).collect():  # a few for each group at most
            hashed[b].hot[t, cell] = free[b], -(-n // rows)
            free[b] += -(-n // rows)
    return bands


def _cells_of(batches: Iterator[pa.RecordBatch], bands: dict[int, Band], d: int) -> Iterator[pa.RecordBatch]:
    """band, v -> the cell of each table."""
    for batch in batches:
        band = batch.column(0).to_numpy()
        for b in np.unique(band).tolist():
            at = np.flatnonzero(band == b)
            for part in np.array_split(at, -(-len(at) // 1024)):
                found = bands[b].cells(_matrix(batch.column(1).take(pa.array(part)), d), 1)[:, :, 0]
                n, t = found.shape
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n * t, b, np.int32)), pa.array(np.tile(np.arange(t, dtype=np.int32), n)), pa.array(found.ravel())], names=["band", "t", "cell"])


# ---- dealing and comparing


class _Hot:
    """The hot cells of a table in order, for look-ups of many cells at once."""

    def __init__(self, band: Band, t: int):
        held = sorted((cell, *at) for (table_, cell), at in band.hot.items() if table_ == t)
        self.cells, self.first, self.blocks = np.array(held, np.int64).reshape(-1, 3).T

    def find(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(is hot, first group, groups) of each cell; other cells have one group."""
        if not len(self.cells):
            none = np.zeros(len(cells), np.int64)
            return none.astype(bool), none, none + 1
        at = np.minimum(np.searchsorted(self.cells, cells), len(self.cells) - 1)
        hit = self.cells[at] == cells
        return hit, self.first[at], np.where(hit, self.blocks[at], 1)


def _hot_tables(bands: dict[int, Band]) -> dict[int, list[_Hot]]:
    return {b: [_Hot(own, t) for t in range(own.tables)] for b, own in bands.items()}


DEALT = "band int, t int, g long, query boolean, cells array<bigint>, id long, v {}"


def _deal_index(batches: Iterator[pa.RecordBatch], bands: dict[int, Band], d: int) -> Iterator[pa.RecordBatch]:
    """id, v, band -> a row for each table, in the group of its cell."""
    hot = _hot_tables(bands)
    for batch in batches:
        band = batch.column(2).to_numpy()
        for b in np.unique(band).tolist():
            own, every = bands[b], np.flatnonzero(band == b)
            for part in np.array_split(every, -(-len(every) // 1024)):
                v = batch.column(1).take(pa.array(part))
                ids = batch.column(0).take(pa.array(part))
                found = own.cells(_matrix(v, d), 1)[:, :, 0]
                spread = K.mix(ids.to_numpy().astype(np.uint64))
                for t in range(found.shape[1]):
                    g = own.group(found[:, t])
                    hit, first, blocks = hot[b][t].find(found[:, t])
                    g = np.where(hit, first + (spread % blocks.astype(np.uint64)).astype(np.int64), g)
                    yield _dealt(b, t, g, False, found[:, t], np.arange(len(g) + 1), ids, v)


def _deal_queries(batches: Iterator[pa.RecordBatch], bands: dict[int, Band], d: int) -> Iterator[pa.RecordBatch]:
    """id, v -> a row for each group with cells that the query probes, all groups of a hot cell."""
    hot = _hot_tables(bands)
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            x = _matrix(part.column(1), d)
            for b, own in bands.items():
                found = own.cells(x, own.probes)
                for t in range(found.shape[1]):
                    c = found[:, t]
                    row, g, cell = np.repeat(np.arange(len(c)), c.shape[1]), own.group(c).ravel(), c.ravel()
                    hit, first, blocks = hot[b][t].find(cell)
                    nth = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                    row, cell, g = np.repeat(row, blocks), np.repeat(cell, blocks), np.repeat(np.where(hit, first, g), blocks) + nth
                    order = np.lexsort((cell, g, row))
                    row, g, cell = row[order], g[order], cell[order]
                    first_of = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (g[1:] != g[:-1])]))
                    take = pa.array(row[first_of])
                    yield _dealt(b, t, g[first_of], True, cell, np.append(first_of, len(cell)), part.column(0).take(take), part.column(1).take(take))


def _dealt(b: int, t: int, g: np.ndarray, query: bool, cell: np.ndarray, bounds: np.ndarray, ids: pa.Array, v: pa.Array) -> pa.RecordBatch:
    n = len(g)
    lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(cell))
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, b, np.int32)), pa.array(np.full(n, t, np.int32)), pa.array(g), pa.array(np.full(n, query)), lists, ids, v], names=["band", "t", "g", "query", "cells", "id", "v"])


def _best(q: np.ndarray, v: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of each query, each candidate once."""
    order = np.lexsort((-s, v, q))
    q, v, s = q[order], v[order], s[order]
    once = np.ones(len(q), dtype=bool)
    once[1:] = (q[1:] != q[:-1]) | (v[1:] != v[:-1])
    q, v, s = q[once], v[once], s[once]
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    keep = rank < k
    return q[keep], v[keep], s[keep]


def _exact(q: np.ndarray, v: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """The inner products of the pairs, summed component by component."""
    out = np.zeros(len(row))
    for j in range(q.shape[1]):
        out += q[row, j] * v[col, j]
    return out


class _Group:
    """The index vectors of a group of cells, sorted by cell."""

    def __init__(self, ids: list[np.ndarray], x: list[np.ndarray], cell: list[np.ndarray]):
        cell, ids, x = np.concatenate(cell), np.concatenate(ids), np.concatenate(x)
        order = np.argsort(cell, kind="stable")
        self.cell, self.ids, self.x = cell[order], ids[order], x[order]

    def find(self, q_ids: np.ndarray, q: np.ndarray, row: np.ndarray, cell: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ``k`` best (query, vector, score) of queries that visit ``cell`` with ``row``."""
        most, rows, cols, scores = k + SPARE, [], [], []
        order = np.argsort(cell, kind="stable")
        row, cell = row[order], cell[order]
        at = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        lo, hi = np.searchsorted(self.cell, cell[at]), np.searchsorted(self.cell, cell[at], side="right")
        for a, b, x, y in zip(at.tolist(), [*at[1:].tolist(), len(cell)], lo.tolist(), hi.tolist(), strict=True):
            for start in range(x, y, BLOCK):
                own, stop = row[a:b], min(y, start + BLOCK)
                s = q[own] @ self.x[start:stop].T
                s[q_ids[own][:, None] == self.ids[None, start:stop]] = -np.inf
                top = np.argpartition(-s, most - 1, axis=1)[:, :most] if s.shape[1] > most else np.broadcast_to(np.arange(s.shape[1]), s.shape)
                rows.append(np.repeat(own, top.shape[1]))
                cols.append(start + top.ravel())
                scores.append(np.take_along_axis(s, top, 1).ravel())
        if not rows:
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        row, col, s = (np.concatenate(c) for c in (rows, cols, scores))
        ok = s > -np.inf
        row, col, _ = _best(row[ok], col[ok], s[ok], most)
        return q_ids[row], self.ids[col], _exact(q, self.x, row, col)


def _compare(batches: Iterator[pa.RecordBatch], d: int, k: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group, index rows first -> each query's best candidates."""
    key, parts, group = None, ([], [], []), None
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def reduced(final: bool):
        nonlocal held
        if held and (final or sum(len(h[0]) for h in held) > HELD):
            held = [_best(*(np.concatenate(c) for c in zip(*held, strict=True)), k)]
            if final or len(held[0][0]) > HELD // 2:
                (q, v, s), held = held[0], []
                return pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s)], names=["query_id", "vec_id", "score"])
        return None

    for batch in batches:
        if not batch.num_rows:
            continue
        b, t, g, query = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2, 3))
        own, mat = batch.column(5).to_numpy(), _matrix(batch.column(6), d)
        bounds = np.concatenate([[0], np.cumsum(batch.column(4).value_lengths().to_numpy(zero_copy_only=False))])
        flat = batch.column(4).flatten().to_numpy()
        change = np.flatnonzero((b[1:] != b[:-1]) | (t[1:] != t[:-1]) | (g[1:] != g[:-1]) | (query[1:] != query[:-1])) + 1
        for lo, hi in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows], strict=True):
            if (b[lo], t[lo], g[lo]) != key:
                key, parts, group = (b[lo], t[lo], g[lo]), ([], [], []), None
            if not query[lo]:
                for to, what in zip(parts, (own[lo:hi], mat[lo:hi], flat[bounds[lo] : bounds[hi]]), strict=True):
                    to.append(what)
                continue
            if not parts[0]:
                continue
            group = group or _Group(*parts)
            for a in range(lo, hi, 1024):
                z = min(hi, a + 1024)
                row = np.repeat(np.arange(z - a), np.diff(bounds[a : z + 1]))
                held.append(group.find(own[a:z], mat[a:z], row, flat[bounds[a] : bounds[z]], k))
                if (out := reduced(False)) is not None:
                    yield out
    if (out := reduced(True)) is not None:
        yield out


def _scan(batches: Iterator[pa.RecordBatch], held_queries, d: int, k: int) -> Iterator[pa.RecordBatch]:
    """Index rows, id and v -> each query's best of the task that reach its bound."""
    own, q_all, bound = held_queries.value
    length, bound = np.linalg.norm(q_all, axis=1), bound.copy()
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def reduced():
        q, v, s = _best(*(np.concatenate(c) for c in zip(*held, strict=True)), k)
        ids, first, n = np.unique(q, return_index=True, return_counts=True)
        full = n == k
        last = np.full(len(ids), -np.inf)
        last[full] = s[first[full] + k - 1]
        at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
        np.maximum(bound, np.where(ids[at] == own, last[at], -np.inf), out=bound)
        return q, v, s

    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            piece = batch.slice(start, BLOCK)
            v_ids, v = piece.column(0).to_numpy(), _matrix(piece.column(1), d)
            longest = np.linalg.norm(v, axis=1).max()
            slack = 4 * d * np.finfo(np.float64).eps * length * longest  # of products in another order
            once = len(np.unique(v_ids)) == len(v_ids)
            live = np.flatnonzero(length * longest + slack >= bound)
            for part in np.array_split(live, max(1, -(-len(live) // 512))):
                s = q_all[part] @ v.T
                s[own[part][:, None] == v_ids[None, :]] = -np.inf
                least = bound[part] - slack[part]
                if once and s.shape[1] > k:  # rows that tie with the last stay
                    least = np.maximum(least, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] - slack[part])
                row, col = np.nonzero((s >= least[:, None]) & (s > -np.inf))
                exact = _exact(q_all[part], v, row, col)
                ok = exact >= bound[part[row]]
                held.append((own[part[row[ok]]], v_ids[col[ok]], exact[ok]))
                size += int(ok.sum())
                if size > HELD:
                    held = [reduced()]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        q, c, x = held[0]
                        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(c), pa.array(x)], names=["query_id", "vec_id", "score"])
                        held, size = [], 0
    if size:
        q, c, x = reduced()
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(c), pa.array(x)], names=["query_id", "vec_id", "score"])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query, each vec_id once, with ``rank``; one shuffle by query."""
    best = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def _missing(index: DataFrame, queries: DataFrame, found: DataFrame, d: int, k: int) -> DataFrame | None:
    """query_id, vec_id, score from all of the index for the queries that found fewer than ``k``."""
    spark = index.sparkSession
    full = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("id"))
    asked = table(queries.join(full, "id", "left_anti"), "short")
    size = asked.count() * d * 8
    n = -(-size // QUERY_BYTES)
    asked, out = asked.withColumn("b", F.pmod(F.xxhash64("id", "v"), F.lit(max(1, n)))), None
    for b in range(n):
        rows = asked.where(F.col("b") == b).select("id", "v").toArrow()
        if not rows.num_rows:
            continue
        held = spark.sparkContext.broadcast((rows.column(0).to_numpy(), _matrix(rows.column(1).combine_chunks(), d), np.full(rows.num_rows, -np.inf)))
        part = index.select("id", "v").mapInArrow(lambda x, q=held: _scan(x, q, d, k), "query_id long, vec_id long, score double")
        part = part if n == 1 else table(part, "compared")
        out = part if out is None else out.unionByName(part)
    return out


def _search(rows: DataFrame, kind: str, d: int, longest: float, k: int, tables: int | None, probes: int | None, hashes: int | None) -> DataFrame:
    """The neighbours among ``rows`` (id, v, query, norm) of one length."""
    spark = rows.sparkSession
    band = F.coalesce(F.least(F.lit(BANDS - 1), F.floor(F.log(F.lit(longest) / F.col("norm")) / F.log(F.lit(RATIO)) + 1e-6)), F.lit(BANDS - 1)).cast("int")
    same = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    index = rows.select("id", "v", band.alias("band"), "norm").dropDuplicates(["id", "v"]).withColumn("r", same).where(F.col("r") <= k + 1)
    index = table(index.sortWithinPartitions(F.desc("norm")).select("id", "v", "band"), "index")
    queries = table(rows.where("query").select("id", "v").distinct(), "asked")
    bands = _fit(index, queries, queries.count(), d, k, tables, probes, hashes)
    schema = DEALT.format(kind)
    dealt = index.mapInArrow(lambda x: _deal_index(x, bands, d), schema).unionByName(queries.mapInArrow(lambda x: _deal_queries(x, bands, d), schema))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "band", "t", "g").sortWithinPartitions("band", "t", "g", "query")
    found = dealt.mapInArrow(lambda x: _compare(x, d, k), "query_id long, vec_id long, score double")
    best = table(_ranked(found, k), "found")
    more = _missing(index, queries, best, d, k)
    return best if more is None else _ranked(best.drop("rank").unionByName(more), k)


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, tables: int | None = None, probes: int | None = None, hashes: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest found of the rows ``is_query``.

    With ``probes`` (and ``tables``, ``hashes``) given there is no fit; with ``hashes`` alone the
    fit keeps to it, unless ``PROBES`` probes of each table cannot find ``TARGET``.
    """
    v = F.col("v")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("v"), F.coalesce(is_query, F.lit(False)).alias("query"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & finite)
    rows = rows.withColumn("norm", F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.max("norm").alias("longest")).orderBy("d").limit(LENGTHS + 1).collect()
    if len(sizes) > LENGTHS:
        raise ValueError(f"vectors of more than {LENGTHS} lengths")
    out = None
    for d, longest in sizes:
        own = _search(rows.where(F.size("v") == d), dict(vectors.dtypes)[vector_col], d, longest, k, tables, probes, hashes)
        out = own if out is None else out.unionByName(own)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
