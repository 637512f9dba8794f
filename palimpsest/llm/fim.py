"""Fill-in-the-middle: documents rearranged so that a model learns to write what stands between.

One pass in Arrow batches, without a shuffle.  A text is tokens, each a run of non-space
characters with the white space before it; white space at the end is a token of its own.  All
rows of about a megabyte are cut together on their UTF-8 bytes: a table tells white space from
the rest, a mask of adjacent bytes marks where tokens end, its running sum less the sum at the
start of each document numbers them, and a binary search in the sum finds every row's two cuts.
Cuts are at token ends, so never within a character.  A long text is summed a megabyte at a time.

Which documents are rearranged, and where they are cut, depends on ``seed`` and the id alone: on
the first four 8-digit groups h1 to h4 of the hex sha256 of ``<seed>:<id>``.

Defined results: a null text counts as empty; an empty text, and one that holds a marker, stays
plain; a null id counts as an empty one; rows that share an id and a text are treated alike; an
empty table gives an empty result.  The names of the results win over columns so called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from .columns import apart

MARKERS = ("<P>", "<S>", "<M>")
FORMS = ("plain", "psm", "spm")
RESULT = ("n", "form", "prefix_chars", "middle_chars", "output")
#: Bytes whose marks are summed at once.
SPAN = 1 << 20

_FIELDS = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())]


def token_ends(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A mask of the bytes that end a token, of the texts that ``offs`` bounds in ``data``."""
    word = K.SPACED[data]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    ends[offs[1:][offs[1:] > offs[:-1]] - 1] = True
    return ends


def sums_at(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many bytes before each of the ascending places ``at`` are marked."""
    out, total = np.zeros(len(at), np.int64), 0
    for lo in range(0, len(mask), SPAN):
        sums = np.cumsum(mask[lo : lo + SPAN], dtype=np.int32)
        a, b = np.searchsorted(at, [lo, lo + len(sums)], side="right")
        out[a:b] = total + sums[at[a:b] - lo - 1]
        total += int(sums[-1])
    return out


def places(mask: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The place after the n-th marked byte (from 1) for each of ``numbers``; 0 has no place and gives 0."""
    out, total = np.zeros(len(numbers), np.int64), 0
    for lo in range(0, len(mask), SPAN):
        sums = np.cumsum(mask[lo : lo + SPAN], dtype=np.int32)
        here = np.flatnonzero((numbers > total) & (numbers <= total + int(sums[-1])))
        out[here] = lo + 1 + np.searchsorted(sums, numbers[here] - total)
        total += int(sums[-1])
    return out


def find(data: np.ndarray, offs: np.ndarray, what: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of every occurrence of ``what`` within a row."""
    at = np.flatnonzero(data[: max(0, len(data) - len(what) + 1)] == what[0])
    for k in range(1, len(what)):
        at = at[data[at + k] == what[k]]
    row = np.searchsorted(offs, at, side="right") - 1
    inside = at + len(what) <= offs[row + 1]
    return row[inside], at[inside]


def _string(parts: list, lengths: list[int]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(parts))]).cast(pa.string())


def _rearranged(batches: Iterator[pa.RecordBatch], n_kept: int, rate: int, spm: int, markers: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """kept columns, text, h1..h4 -> kept columns, n, form, prefix_chars, middle_chars, output."""
    prefix, suffix, middle = (m.encode() for m in markers)
    for batch in batches:
        data, offs = K.texts(batch.column(n_kept))
        h = [batch.column(n_kept + 1 + k).to_numpy() for k in range(4)]
        n, form, chars, parts, lengths = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int8), np.zeros((2, batch.num_rows), np.int64), [], []
        for lo, hi in K.chunks(offs):
            own = offs[lo : hi + 1] - offs[lo]
            text = data[offs[lo] : offs[hi]]
            mask = token_ends(text, own)
            before = sums_at(mask, own)
            n[lo:hi] = np.diff(before)
            a, b = (x[lo:hi] % (n[lo:hi] + 1) for x in h[:2])
            first, second = (np.where(u > 0, places(mask, before[:-1] + u), own[:-1]) for u in (np.minimum(a, b), np.maximum(a, b)))
            kind = np.where(h[2][lo:hi] % 100 >= rate, 0, np.where(h[3][lo:hi] % 100 < spm, 2, 1))
            kind[own[1:] == own[:-1]] = 0
            for m in (prefix, suffix, middle):
                kind[find(text, own, m)[0]] = 0
            form[lo:hi] = kind
            heads = np.append((text & 0xC0) != 0x80, False)  # the first bytes of characters
            cuts = np.stack([own[:-1], first, second, own[1:]], 1)
            per = np.add.reduceat(heads, cuts.ravel(), dtype=np.int64).reshape(-1, 4)
            chars[:, lo:hi] = np.where(np.diff(cuts)[:, :2] > 0, per[:, :2], 0).T
            view = memoryview(text)
            for k, (s, c, d, e) in zip(kind.tolist(), cuts.tolist(), strict=True):
                if k == 0:
                    parts.append(view[s:e])
                elif k == 1:
                    parts += (prefix, view[s:c], suffix, view[d:e], middle, view[c:d])
                else:
                    parts += (suffix, view[d:e], prefix, view[s:c], middle, view[c:d])
                lengths.append(e - s + (len(prefix) + len(suffix) + len(middle) if k else 0))
        plain = form == 0
        yield pa.RecordBatch.from_arrays([*batch.columns[:n_kept], pa.array(n), pa.array(FORMS).take(pa.array(form)), *(pa.array(c, mask=plain) for c in chars), _string(parts, lengths)], names=[*batch.schema.names[:n_kept], *RESULT])


def _restored(batches: Iterator[pa.RecordBatch], n_kept: int, markers: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """kept columns, output, form -> kept columns, restored."""
    names = [m.encode() for m in markers]
    for batch in batches:
        data, offs = K.texts(batch.column(n_kept))
        kind = np.array([FORMS.index(f) for f in batch.column(n_kept + 1).to_pylist()], np.int8)
        at = np.zeros((3, batch.num_rows), np.int64)
        for lo, hi in K.chunks(offs):
            text, own = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
            for k, m in enumerate(names):
                row, place = find(text, own, m)
                at[k, lo + row] = offs[lo] + place
        parts, lengths, view = [], [], memoryview(data)
        p, s, m = (len(x) for x in names)
        for k, start, end, (i, j, l) in zip(kind.tolist(), offs[:-1].tolist(), offs[1:].tolist(), at.T.tolist(), strict=True):  # noqa: E741
            if k == 0:
                parts.append(view[start:end])
            elif k == 1:
                parts += (view[i + p : j], view[l + m : end], view[j + s : l])
            else:
                parts += (view[i + p : l], view[l + m : end], view[j + s : i])
            lengths.append(end - start - (p + s + m if k else 0))
        yield pa.RecordBatch.from_arrays([*batch.columns[:n_kept], _string(parts, lengths)], names=[*batch.schema.names[:n_kept], "restored"])


def rearrange(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm: int = 80, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """``docs`` with n (tokens), form, prefix_chars, middle_chars (code points, null if plain) and output.

    ``rate`` per cent of the documents are rearranged: ``spm`` per cent of them as suffix, prefix,
    middle, the others as prefix, suffix, middle, each part after its one of ``markers``.
    """
    if any(len(m) < 2 or m[0] in m[1:] for m in markers) or len({m[0] for m in markers}) > 1 or len(set(markers)) < 3:
        raise ValueError("markers must differ, and begin with one character that they hold nowhere else")
    return apart(docs, RESULT, (id_col, text_col), lambda d, own: _rearrange(d, own(id_col), own(text_col), seed, rate, spm, markers))


def _rearrange(docs: DataFrame, id_col: str, text_col: str, seed: int, rate: int, spm: int, markers: tuple[str, ...]) -> DataFrame:
    kept = docs.columns
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    groups = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    schema = T.StructType([*(docs.schema[c] for c in kept), *_FIELDS])
    return docs.select(*kept, F.col(text_col).alias("_text"), *groups).mapInArrow(lambda x, n=len(kept): _rearranged(x, n, rate, spm, markers), schema)


def restore(docs: DataFrame, output_col: str = "output", form_col: str = "form", markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """``docs`` with ``restored``, the texts that :func:`rearrange` made ``output`` of."""

    def run(d: DataFrame, own) -> DataFrame:
        schema = T.StructType([*d.schema.fields, T.StructField("restored", T.StringType())])
        return d.select(*d.columns, F.col(own(output_col)).alias("_output"), F.col(own(form_col)).alias("_form")).mapInArrow(lambda x, n=len(d.columns): _restored(x, n, markers), schema)

    return apart(docs, ("restored",), (), run)
