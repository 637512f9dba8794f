"""Quality of documents, learnt from trusted positives and unlabelled web text.

The classifier minimises the non-negative unbiased risk of positive-unlabelled learning,
``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))`` with the logistic loss, over a linear
model of ``FEATURES`` statistics of the whole text: shares of bytes by kind, lengths of words and
lines, and how much of the words and shingles repeat.

The prior is estimated from the scores that models fitted to one half of the sample, with a
prior of one half, give to the other; rows with another label are not looked at, but may be among the unlabelled.

The model is fitted on the driver from bounded samples (``MAX_POSITIVE`` trusted rows and
``MAX_UNLABELLED`` documents, chosen and put in order by a hash, so that reruns agree); their
features are computed by the executors.  Scoring is one pass over the texts without a shuffle.

Defined results: a null or empty text has the features of an empty one and is scored;
repeated rows get equal scores, rows of one id with different texts their own; without
trusted rows every score is the prior (0.5 if none is given); an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from .columns import apart, clear_of
from .neardup import shingle_sets

MAX_POSITIVE = 6_000
MAX_UNLABELLED = 6_000
ROUNDS = 400

_UPPER, _LOWERCASE, _DIGIT, _HIGH, _SPACE, _LINE = range(6)
_OTHER = 6
_kinds = np.full(256, _OTHER, np.uint8)
_kinds[65:91], _kinds[97:123], _kinds[48:58], _kinds[128:] = _UPPER, _LOWERCASE, _DIGIT, _HIGH
_kinds[[32, 9, 11, 12, 13]], _kinds[10] = _SPACE, _LINE
#: Signs counted one by one.
_SIGNS = b"!?.,:;|#$%&*@/\\<>{}[]()=_-+~^'\""
for _k, _b in enumerate(_SIGNS):
    _kinds[_b] = 7 + _k
KINDS = 7 + len(_SIGNS)
FEATURES = 2 * KINDS + 20


def _shares(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    return np.bincount(row * KINDS + _kinds[data], minlength=(len(offs) - 1) * KINDS).reshape(-1, KINDS).astype(float)


def features(column: pa.Array) -> np.ndarray:
    """A row of ``FEATURES`` numbers for each text."""
    data, offs = K.texts(column)
    out = np.zeros((len(offs) - 1, FEATURES), np.float32)
    for lo, hi in K.chunks(offs):
        w = K.words(data, offs[lo : hi + 1], K.SPACED)
        at = offs[lo : hi + 1] - offs[lo]
        counts = _shares(w.data, at)
        size = np.diff(at)
        n = np.diff(w.bounds).astype(float)
        one, some = np.maximum(1, n), np.maximum(1, size)
        share = counts / some[:, None]
        letters = counts[:, [_UPPER, _LOWERCASE, _HIGH]].sum(1)
        lengths = (w.ends - w.starts).astype(float)
        per = lambda x: np.diff(np.concatenate([[0.0], np.cumsum(x)])[w.bounds])
        first, last = w.data[w.starts] if len(w.starts) else np.zeros(0, np.uint8), w.data[w.ends - 1] if len(w.ends) else np.zeros(0, np.uint8)
        unique1 = np.diff(shingle_sets(w, 1)[1]) / one
        unique2 = np.diff(shingle_sets(w, 2)[1]) / np.maximum(1, n - 1)
        unique3 = np.diff(shingle_sets(w, 3)[1]) / np.maximum(1, n - 2)
        mean = per(lengths) / one
        lines = counts[:, _LINE] + 1
        rest = [
            np.log1p(n), np.log1p(size), mean, np.sqrt(np.maximum(0, per(lengths**2) / one - mean**2)), unique1, unique2, unique3, unique1 * np.log1p(n), n == 0, n / lines / 50, np.log1p(n / lines), lines / one,
            counts[:, _UPPER] / np.maximum(1, letters), per(_kinds[first] == _UPPER) / one, per(_kinds[last] >= _OTHER) / one, per(_kinds[first] >= _OTHER) / one, per(lengths == 1) / one, per(lengths > 15) / one, n < 20, n < 50,
        ]
        out[lo:hi] = np.concatenate([share, np.sqrt(share), np.stack(rest, 1)], 1)
    return out


class Model:
    """A linear model of standardised features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, bias: float):
        self.mean, self.scale, self.weights, self.bias = mean, scale, weights, bias

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = ROUNDS, decay: float | None = None) -> Model:
    """Minimise the non-negative risk by gradient steps with momentum (Adam).

    Weights decay the more the fewer positives there are, unless ``decay`` is given."""
    decay = float(np.clip(0.6 / max(1, len(positive)), 1e-4, 1e-2)) if decay is None else decay
    both = np.concatenate([positive, unlabelled]).astype(float)
    mean, scale = both.mean(0), both.std(0) + 1e-6
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    w, b = np.zeros(p.shape[1] + 1), 0.0
    p, u = np.c_[p, np.ones(len(p))], np.c_[u, np.ones(len(u))]
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    soft = lambda z: np.logaddexp(0, z)
    for t in range(1, rounds + 1):
        zp, zu = p @ w, u @ w
        negative = soft(zu).mean() - prior * soft(zp).mean()
        plus = -prior * (1 - sig(zp)) @ p / len(p)
        minus = sig(zu) @ u / len(u) - prior * sig(zp) @ p / len(p)
        g = plus + minus if negative >= 0 else -minus  # where the negative risk turns negative, step back
        g += decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, w[:-1], float(w[-1]) + b)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """The share of positives among the unlabelled, from scores of both: the ratio of the parts
    above a threshold, at the threshold where the ratio with its bound of chance is least."""
    cuts = np.unique(positive)
    pos = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    un = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    chance = sum(np.sqrt(np.log(4 / delta) / (2 * len(x))) for x in (positive, unlabelled))
    best = int(np.argmin((un + chance) / pos))
    return float(np.clip(un[best] / pos[best], 0.01, 0.99))


def cross_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """:func:`estimate_prior` from scores of models that were fitted to the other half."""
    if min(len(positive), len(unlabelled)) < 4:
        return 0.5
    out = []
    for k in (0, 1):
        model = fit(positive[k::2], unlabelled[k::2], 0.5)
        out.append(estimate_prior(model.score(positive[1 - k :: 2]), model.score(unlabelled[1 - k :: 2])))
    return float(np.mean(out))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = features(batch.column(0))
        flat = pa.array(x.ravel().astype(np.float32))
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.FixedSizeListArray.from_arrays(flat, FEATURES).cast(pa.list_(pa.float32())), batch.column(2)], names=["trusted", "x", "o"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, prior: float | None = None) -> Model:
    """Fit on the rows of ``labels`` with label 1 (trusted) and any documents (unlabelled).

    The samples are the first rows by a hash of the id, at most ``max_positive`` and
    ``max_unlabelled``.  The prior, unless given, is estimated.
    """
    known = labels.where((F.col(label_col) == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id")).distinct()
    by_hash = F.xxhash64(F.lit(1), F.col("_id"))
    ids = known.select("_id", F.lit(True).alias("trusted")).orderBy(by_hash, "_id").limit(max_positive)
    others = docs.select(F.col(f"`{id_col}`").alias("_id")).where("_id is not null").orderBy(F.xxhash64(F.lit(2), F.col("_id")), "_id").limit(max_unlabelled).distinct().withColumn("trusted", F.lit(False))
    sample = docs.select(F.col(f"`{id_col}`").alias("_own"), F.col(f"`{text_col}`").alias("_text")).join(F.broadcast(ids.union(others)), F.col("_own") == F.col("_id"))
    order = F.xxhash64("_id", "_text", "trusted")
    got = sample.select("_text", "trusted", order.alias("o")).mapInArrow(_vectors, "trusted boolean, x array<float>, o long").orderBy("o").limit(2 * (max_positive + max_unlabelled)).toPandas()
    trusted = got["trusted"].to_numpy(dtype=bool)
    if not trusted.any():
        return Model(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), 0.0 if prior is None else float(np.log(prior / (1 - prior))))
    x = np.stack(got["x"].to_numpy())
    p, u = x[trusted], x[~trusted]
    if not len(u):
        u = p
    if prior is None:
        prior = cross_prior(p, u)
    return fit(p, u, float(np.clip(prior, 0.01, 0.99)))


def _score(batches: Iterator[pa.RecordBatch], model, at: int, kept: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = model.value.score(features(batch.column(at)))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(score, pa.float64())], names=[*kept, "score"])


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default, but for one called score) and ``score``."""
    names = clear_of(docs.columns if keep is None else keep, ("score",), docs)
    return apart(docs, ("score",), (text_col,), lambda d, own: _scored(d, model, own(text_col), [own(c) for c in names]))


def _scored(docs: DataFrame, model: Model, text_col: str, kept: list[str]) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*(f"`{c}`" for c in kept), F.col(f"`{text_col}`").alias("_scored"))
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("score", T.DoubleType())])
    return source.mapInArrow(lambda x, m=held, a=len(kept), k=kept: _score(x, m, a, k), schema)


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of an id's text modulo ``n``; null for null."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))
