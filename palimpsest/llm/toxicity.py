"""Toxic spans by a linear-chain conditional random field.

Tokens are words; a token is toxic or not.  A token's features are its word, its first
and last bytes and its neighbours, hashed to ``2**DIMS`` weights; a 2 x 2 table weighs
transitions.  Labelled tokens come from labelled documents: in a toxic document, the
words or word beginnings that are much more frequent in toxic documents than in others
(a bound on their log odds, over distinct contexts) are toxic and the others have no label;
every token of other documents is not toxic.  The field is fitted to the labelled tokens by
its likelihood; forward-backward passes give gradients and, when scoring, each token's
marginal.

A document's score is a logistic function of its largest marginal, the expected number
of toxic tokens and their density; the offending spans are runs of tokens whose
marginal is at least 0.5, in code points.

The fit runs on the driver on at most ``MAX_DOCS`` labelled documents of each label and
``MAX_BYTES`` of whole texts, chosen by a hash.  Scoring is one pass over the whole texts without a shuffle, in pieces
of about a megabyte; the passes run over blocks of tokens side by side, and over the pieces of a longer
text with the messages that its other pieces send, so its marginals are those of the whole chain.

Defined results: null and empty texts have no tokens, no spans and the score of a text
without toxic tokens; repeated rows get equal results; without toxic training rows, or with
no others to tell them from, all scores are low; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from .columns import apart, clear_of

DIMS = 18
MAX_DOCS, MAX_BYTES = 1_500, 32 << 20
ROUNDS = 8
HEADS, TAILS = (4, 5, 7), (4,)
#: Log odds from which a word or beginning marks its tokens as toxic, and contexts that it must
#: have for each toxic document (two at least, and eight are always enough).
LEAST_ODDS, LEAST_SHARE, LEAST_SEEN = 2.0, 0.005, (2, 8)
#: Tokens of a block in a forward or backward pass.
BLOCK = 64
_SALTS = [np.uint64(x) for x in np.random.default_rng(11).integers(1, 2**63, 8, dtype=np.uint64)]


def token_features(w: K.Words) -> np.ndarray:
    """A row of hashed features for each kind, a column for each token."""
    h, none = w.hashes, np.uint64(0)
    before, after = np.full(len(h) + 1, none), np.full(len(h) + 1, none)  # neighbours of the same text
    before[1:], after[:-1][: len(h)] = h, np.append(h[1:], none)[: len(h)]
    before[w.bounds], after[np.maximum(w.bounds[1:] - 1, 0)[np.diff(w.bounds) > 0]] = none, none
    kinds = [h, *(w.heads[k] for k in HEADS), *(w.tails[k] for k in TAILS), before[:-1], after[:-1]]
    return np.stack([(K.mix(x ^ s) >> np.uint64(64 - DIMS)).astype(np.int32) for x, s in zip(kinds, _SALTS, strict=False)])


def _steps(u: np.ndarray, first: np.ndarray, trans: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray]:
    """Transition weights into each token (whole blocks, the last filled up with identities), and the
    normalised product of each block's."""
    n = len(u)
    size = -(-n // BLOCK) * BLOCK
    step = np.empty((size, 2, 2))
    step[n:] = np.eye(2)
    e = np.exp(np.clip(u, -30, 30))
    t = np.exp(trans)
    step[:n, :, 0] = t[:, 0]
    step[:n, :, 1] = t[:, 1] * e[:, None]
    at = np.flatnonzero(first)
    step[at, :, 0] = 1.0
    step[at, :, 1] = (np.exp(start) * e[at])[:, None]
    step /= step.max((1, 2), keepdims=True)
    blocks = step.reshape(-1, BLOCK, 2, 2)
    whole = blocks[:, 0].copy()
    for k in range(1, BLOCK):
        s = blocks[:, k]
        whole = whole[:, :, :1] * s[:, None, 0, :] + whole[:, :, 1:] * s[:, None, 1, :]
        whole /= whole.max((1, 2), keepdims=True)
    return step, whole


def passes(u: np.ndarray, first: np.ndarray, trans: np.ndarray, start: float, before: tuple[float, float] = (0.5, 0.5), after: tuple[float, float] = (0.5, 0.5)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised forward and backward messages of tokens with scores ``u`` for toxic.

    Returns (forward, backward, step): forward[t, y] and backward[t, y], and the
    transition weights step[t, i, j] into t.  ``first`` marks the first token of each
    text, whose step forgets what precedes, so many texts are one chain.  ``before`` and ``after``
    are the messages that reach the chain from its two sides.
    """
    n = len(u)
    step, whole = _steps(u, first, trans, start)
    blocks = step.reshape(-1, BLOCK, 2, 2)
    enter, leave = np.empty((len(blocks), 2)), np.empty((len(blocks), 2))
    a, b = before
    for k, ((p, q), (r, s)) in enumerate(whole.tolist()):
        enter[k] = a, b
        a, b = a * p + b * r, a * q + b * s
        a, b = a / (a + b), b / (a + b)
    a, b = after
    for k in range(len(blocks) - 1, -1, -1):
        leave[k] = a, b
        (p, q), (r, s) = whole[k].tolist()
        a, b = p * a + q * b, r * a + s * b
        a, b = a / (a + b), b / (a + b)
    forward, backward = np.empty((len(blocks), BLOCK, 2)), np.empty((len(blocks), BLOCK, 2))
    f, g = enter, leave
    for k in range(BLOCK):
        s = blocks[:, k]
        f = f[:, :1] * s[:, 0] + f[:, 1:] * s[:, 1]
        f /= f.sum(1, keepdims=True)
        forward[:, k] = f
    for k in range(BLOCK - 1, -1, -1):
        backward[:, k] = g
        s = blocks[:, k]
        g = s[:, :, 0] * g[:, :1] + s[:, :, 1] * g[:, 1:]
        g /= g.sum(1, keepdims=True)
    return forward.reshape(-1, 2)[:n], backward.reshape(-1, 2)[:n], step[:n]


class Field:
    """The fitted field, and the logistic function from marginals to a document's score."""

    def __init__(self):
        self.weights = np.zeros(1 << DIMS, np.float32)
        self.trans, self.start = np.zeros((2, 2)), -4.0
        self.bias = -4.0
        self.final = np.array([4.0, 1.0, 0.0, -4.0])

    def marginals(self, w: K.Words) -> np.ndarray:
        """The probability of toxic for each token."""
        n = len(w.hashes)
        if not n:
            return np.zeros(0)
        u = self.weights[token_features(w)].sum(0, dtype=np.float64) + self.bias
        first = np.zeros(n, dtype=bool)
        first[w.bounds[:-1][w.bounds[:-1] < n]] = True
        forward, backward, _ = passes(u, first, self.trans, self.start)
        p = forward * backward
        return p[:, 1] / p.sum(1)

    def long_marginals(self, data: np.ndarray, at: int, end: int) -> Iterator[tuple[K.Words, int, slice, np.ndarray]]:
        """(words, byte of the text where they begin, which of them, their probabilities) of a text
        that comes in pieces.

        A first sweep multiplies the steps of each piece, which gives the messages that reach it from
        behind; the second has them and what the pieces before send.  Pieces overlap by two
        words, so that each token is judged where both its neighbours are."""

        def sweep():
            base, seen, done = at, 0, 0
            for _, _, w, carried in K.pieces(data, np.array([at, end]), K.ALNUM, carry=2, heads=HEADS, tails=TAILS):
                n = len(w.hashes)
                head, last = seen - carried, base + len(w.data) >= end
                own = slice(done - head, n if last else max(done - head, n - 1))
                u = self.weights[token_features(w)[:, own]].sum(0, dtype=np.float64) + self.bias
                yield w, base - at, own, u, (np.arange(len(u)) + done) == 0
                seen, done = head + n, head + own.stop
                base += int(w.starts[n - min(2, n)]) if n else len(w.data)

        behind, after = [], (0.5, 0.5)
        for *_, u, first in sweep():
            (p, q), (r, s) = np.eye(2).tolist()
            for (c, d), (e, f) in _steps(u, first, self.trans, self.start)[1].tolist():
                p, q, r, s = p * c + q * e, p * d + q * f, r * c + s * e, r * d + s * f
                top = max(p, q, r, s)
                p, q, r, s = p / top, q / top, r / top, s / top
            behind.append((p, q, r, s))
        reach = []
        for p, q, r, s in reversed(behind):
            reach.append(after)
            a, b = p * after[0] + q * after[1], r * after[0] + s * after[1]
            after = a / (a + b), b / (a + b)
        before = (0.5, 0.5)
        for (w, base, own, u, first), after in zip(sweep(), reversed(reach), strict=True):
            forward, backward, _ = passes(u, first, self.trans, self.start, before, after)
            p = forward * backward
            before = tuple(forward[-1].tolist()) if len(forward) else before
            yield w, base, own, p[:, 1] / p.sum(1)

    @staticmethod
    def summary(w: K.Words, p: np.ndarray) -> np.ndarray:
        """(largest marginal, log of expected toxic tokens, their density, 1) of each text."""
        n = np.diff(w.bounds)
        total = np.diff(np.concatenate([[0.0], np.cumsum(p)])[w.bounds])
        top = np.zeros(len(n))
        has = np.flatnonzero(n)
        if len(has):
            top[has] = np.maximum.reduceat(p, w.bounds[has])
        return np.stack([top, np.log1p(np.maximum(0, total)), np.minimum(1, 20 * np.maximum(0, total) / np.maximum(1, n)), np.ones(len(n))], 1)

    def score(self, w: K.Words, p: np.ndarray) -> np.ndarray:
        return self.logistic(self.summary(w, p))

    def logistic(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.final, -30, 30)))


def tokens(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, K.Words]]:
    """Row ranges of texts with their words."""
    for lo, hi in K.chunks(offs):
        yield lo, hi, K.words(data, offs[lo : hi + 1], K.ALNUM, HEADS, TAILS)


def token_labels(parts: list[tuple[K.Words, np.ndarray]]) -> list[np.ndarray]:
    """1 for toxic tokens, 0 for others and -1 for those without a label, from documents' labels.

    Toxic are, in toxic documents, those with a word or beginning whose log odds, less a standard
    error, are at least ``LEAST_ODDS``.  What is counted are distinct pairs of neighbours, so
    copies of a document count once."""
    least = np.clip(LEAST_SHARE * sum(int(y.sum()) for _, y in parts), *LEAST_SEEN)
    toxic = np.concatenate([np.repeat(y, np.diff(w.bounds)) for w, y in parts])
    h = np.concatenate([w.hashes for w, _ in parts])
    around = K.mix(np.roll(h, 1) * np.uint64(3) + np.roll(h, -1))
    n_pos, n_neg = int(toxic.sum()), int((~toxic).sum())
    kinds = [lambda w: w.hashes, *(lambda w, k=k: w.heads[k] for k in HEADS)]
    out = [np.zeros(len(w.hashes), dtype=bool) for w, _ in parts]
    for kind in kinds:
        own = np.concatenate([kind(w) for w, _ in parts])
        once = [own[at][np.unique(K.mix(own[at] ^ around[at]), return_index=True)[1]] for at in (toxic, ~toxic)]
        known, counts = np.unique(once[0], return_counts=True)
        clean, others = np.unique(once[1], return_counts=True)
        against = np.zeros(len(known))
        if len(clean):
            at = np.minimum(np.searchsorted(clean, known), len(clean) - 1)
            against = np.where(clean[at] == known, others[at], 0)
        odds = np.log((counts + 0.5) / (n_pos + 1)) - np.log((against + 0.5) / (n_neg + 1)) - np.sqrt(1 / (counts + 0.5) + 1 / (against + 0.5))
        marked = known[(odds >= LEAST_ODDS) & (counts >= least)]
        for (w, _), held in zip(parts, out, strict=True):
            if len(marked):
                h = kind(w)
                held |= marked[np.minimum(np.searchsorted(marked, h), len(marked) - 1)] == h
    return [np.where(np.repeat(y, np.diff(w.bounds)), np.where(held, 1, -1), 0) for (w, y), held in zip(parts, out, strict=True)]


def fit(column: pa.Array, labels: np.ndarray, rounds: int = ROUNDS) -> Field:
    """Fit the field to texts with labels (1: toxic), then the documents' scores."""
    field, parts, rows = Field(), [], []
    labels = np.asarray(labels).astype(bool)
    for lo, hi, w in tokens(*K.texts(column)):
        parts.append((w, labels[lo:hi]))
        rows.append((lo, hi))
    if not labels.any() or labels.all():
        return field
    truth = token_labels(parts)
    grown = np.full(1 << DIMS, 1e-3)
    small = np.full(6, 1e-3)
    for _ in range(rounds):
        for (w, _), y in zip(parts, truth, strict=True):
            n = len(y)
            if not n:
                continue
            idx = token_features(w)
            first = np.zeros(n, dtype=bool)
            first[w.bounds[:-1][np.diff(w.bounds) > 0]] = True
            u = field.weights[idx].sum(0, dtype=np.float64) + field.bias
            forward, backward, step = passes(u, first, field.trans, field.start)
            p = forward * backward
            p = p[:, 1] / p.sum(1)
            known = y >= 0
            off = np.where(known, y - p, 0)
            g = np.bincount(idx.ravel(), np.tile(off, len(idx)), 1 << DIMS) - 1e-2 * field.weights
            grown += g * g
            field.weights += (0.5 * g / np.sqrt(grown)).astype(np.float32)
            at = np.flatnonzero(~first)
            at = at[known[at] & known[at - 1]]
            pair = forward[at - 1][:, :, None] * step[at] * backward[at][:, None, :]
            pair /= pair.sum((1, 2), keepdims=True)
            seen = np.zeros((2, 2))
            np.add.at(seen, (y[at - 1].astype(int), y[at].astype(int)), 1)
            more = np.concatenate([(seen - pair.sum(0)).ravel(), [off[first].sum(), off.sum()]])
            small += more * more
            more = 0.5 * more / np.sqrt(small)
            field.trans += more[:4].reshape(2, 2)
            field.start += more[4]
            field.bias += more[5]
    x = np.concatenate([field.summary(w, field.marginals(w)) for w, _ in parts])
    z = np.zeros(4)
    for _ in range(300):  # Newton steps with a small ridge, damped
        q = 1 / (1 + np.exp(-np.clip(x @ z, -30, 30)))
        h = (x * (q * (1 - q))[:, None]).T @ x + 0.05 * np.eye(4)
        z = z + 0.5 * np.linalg.solve(h, x.T @ (labels - q) - 0.05 * z)
    field.final = z
    return field


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label", max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES) -> Field:
    """Fit on at most ``max_docs`` documents of each label, the first by a hash of the id, and
    at most half of ``max_bytes`` of text of each label.

    A text that does not fit into what is left of that is passed over, and later ones are taken.  Without
    any labelled text an unfitted field comes back, whose scores are low; ``ValueError`` if a
    label has texts but none that fits."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_label"))
    order = F.xxhash64(F.lit(3), F.col("_id"))
    ids = known.where("_label = 1").orderBy(order, "_id").limit(max_docs).union(known.where("_label <> 1").orderBy(order, "_id").limit(max_docs))
    sample = docs.select(F.col(f"`{id_col}`").alias("_own"), F.col(f"`{text_col}`").alias("_text")).where("_text is not null").join(F.broadcast(ids), F.col("_own") == F.col("_id"))
    sample = sample.select("_text", (F.col("_label") == 1).alias("_toxic"), F.xxhash64("_id", "_text").alias("_order"), F.octet_length("_text").cast("long").alias("_bytes"))
    first = sample.select("_order", "_bytes", "_toxic").distinct().orderBy("_order", "_bytes").limit(2 * max_docs).collect()
    left, taken = {True: max_bytes // 2, False: max_bytes // 2}, []
    for r in first:
        if r._bytes <= left[r._toxic]:
            left[r._toxic] -= r._bytes
            taken.append((r._order, r._toxic))
    for label in {r._toxic for r in first} - {t for _, t in taken}:
        raise ValueError(f"no {'toxic' if label else 'clean'} text of at most {max_bytes // 2} bytes to learn from")
    if not taken:
        return Field()
    chosen = F.broadcast(docs.sparkSession.createDataFrame([o for o, _ in taken], "long").toDF("_order"))
    got = sample.join(chosen, "_order", "left_semi").dropDuplicates(["_order"]).orderBy("_order", "_bytes").toPandas()
    return fit(pa.array(got["_text"], pa.string()), got["_toxic"].to_numpy(dtype=bool))


class _Spans:
    """Runs of toxic tokens of one text, in code points."""

    def __init__(self):
        self.found: list[dict] = []
        self.last = -2

    def add(self, number: int, start: int, end: int) -> None:
        if number == self.last + 1:
            self.found[-1]["end"] = end
        else:
            self.found.append({"start": start, "end": end})
        self.last = number


def _long(field: Field, data: np.ndarray, at: int, end: int) -> tuple[float, list[dict]]:
    """Score and spans of a text that comes in pieces."""
    top = total = 0.0
    n, points, to, spans = 0, 0, at, _Spans()
    for w, base, own, p in field.long_marginals(data, at, end):
        points += int(np.count_nonzero((data[to : at + base] & 0xC0) != 0x80))
        to = at + base
        top, total = max(top, float(p.max(initial=0))), total + float(p.sum())
        hit = np.flatnonzero(p >= 0.5)
        if len(hit):
            before = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80, dtype=np.int32)])
            for t in hit.tolist():
                k = own.start + t
                spans.add(n + t, points + int(before[w.starts[k]]), points + int(before[w.ends[k]]))
        n += len(p)
    x = np.array([top, np.log1p(max(0.0, total)), min(1.0, 20 * max(0.0, total) / max(1, n)), 1.0])
    return float(field.logistic(x)), spans.found


def _scan(batches: Iterator[pa.RecordBatch], model, at: int, kept: list[str]) -> Iterator[pa.RecordBatch]:
    field: Field = model.value
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        score, spans = np.zeros(batch.num_rows), [[] for _ in range(batch.num_rows)]
        data, offs = K.texts(batch.column(at))
        big = np.diff(offs) > K.CHUNK
        for k in np.flatnonzero(big).tolist():
            score[k], spans[k] = _long(field, data, int(offs[k]), int(offs[k + 1]))
        for lo, hi, rows in _stretches(big):
            for a, b, w in tokens(data, offs[lo : hi + 1]):
                p = field.marginals(w)
                score[lo + a : lo + b] = field.score(w, p)
                hit = np.flatnonzero(p >= 0.5)
                if not len(hit):
                    continue
                points = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
                row = np.searchsorted(w.bounds, hit, side="right") - 1
                runs: dict[int, _Spans] = {}
                for t, r in zip(hit.tolist(), row.tolist(), strict=True):
                    base = int(points[w.offs[r]])
                    runs.setdefault(r, _Spans()).add(t, int(points[w.starts[t]]) - base, int(points[w.ends[t]]) - base)
                for r, found in runs.items():
                    spans[rows[a + r]] = found.found
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(score), pa.array(spans, kind)], names=[*kept, "score", "spans"])


def _stretches(big: np.ndarray) -> Iterator[tuple[int, int, range]]:
    """(first, last+1, rows) of the stretches of rows between big ones."""
    edges = np.flatnonzero(np.diff(np.concatenate([[True], big, [True]]).astype(np.int8)))
    for lo, hi in edges.reshape(-1, 2).tolist():
        yield lo, hi, range(lo, hi)


def score_documents(docs: DataFrame, field: Field, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) with ``score`` and ``spans``, which win over
    columns of those names."""
    names = clear_of(docs.columns if keep is None else keep, ("score", "spans"), docs)
    return apart(docs, ("score", "spans"), (text_col,), lambda d, own: _scored(d, field, own(text_col), [own(c) for c in names]))


def _scored(docs: DataFrame, field: Field, text_col: str, kept: list[str]) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(field)
    source = docs.select(*(f"`{c}`" for c in kept), F.col(f"`{text_col}`").alias("_scored"))
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])
    return source.mapInArrow(lambda x, m=held, a=len(kept), k=kept: _scan(x, m, a, k), schema)
