"""Repeated passages, importance resampling and fill-in-the-middle against plain versions."""

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from helpers import docs, edited, prose, words

from palimpsest.llm import fim, importance, substrings
from palimpsest.llm import textkernel as K

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ODD = [(900, None), (901, ""), (None, " \t\n"), (None, "ünïcode <P> wörds here"), (902, "a"), (902, "a"), (903, "tail \n "), (904, "\U0001f600 \U0001f600 x\x0by")]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- repeats


def plain_repeats(texts, length):
    """(words, removed places) of every text."""
    lists = [SPACED.findall(t or "") for t in texts]
    times = Counter(tuple(w[i : i + length]) for w in lists for i in range(len(w) - length + 1))
    return [(w, {k for i in range(len(w) - length + 1) if times[tuple(w[i : i + length])] > 1 for k in range(i, i + length)}) for w in lists]


def check_repeats(spark, rows, length, kgram):
    out = substrings.mark_repeats(docs(spark, rows).withColumn("place", F.monotonically_increasing_id()).coalesce(1), length=length, kgram=kgram)
    out = sorted(out.collect(), key=lambda r: r.place)
    for (i, text), r, (w, gone) in zip(rows, out, plain_repeats([t for _, t in rows], length), strict=True):
        assert (r.doc_id, r.text, r.n_words, r.n_removed) == (i, text, len(w), len(gone))
        assert {k for a, b in r.spans for k in range(a, b)} == gone
        assert all(a[1] < b[0] for a, b in zip(r.spans, r.spans[1:], strict=False))
        assert r.kept_sha256 == sha(" ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def test_repeats_equal_all_windows(spark):
    rng = random.Random(3)
    passages = [prose(rng, n) for n in (8, 9, 12, 30, 60)]
    rows = [(k, " ".join(rng.choice([prose(rng, rng.randrange(1, 25)), rng.choice(passages)]) for _ in range(rng.randrange(1, 7)))) for k in range(120)]
    rows += [(200 + k, edited(rng, rows[k][1], 2)) for k in range(40)]
    rows += [(300, "same " * 50), (301, "same " * 9), (302, "ab " * 8 + "ba " * 8), (303, rows[0][1].upper()), (304, rows[5][1].replace(" ", " \n "))] + ODD
    for length, kgram in ((9, 4), (9, 8), (12, 1), (5, 2)):
        check_repeats(spark, rows, length, kgram)


def test_repeats_of_hot_passages(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", 5)
    rng = random.Random(4)
    passage = prose(rng, 50)
    rows = [(k, f"{prose(rng, rng.randrange(4))} {passage} {prose(rng, rng.randrange(4))}") for k in range(60)] + [(100 + k, passage) for k in range(60)] + [(None, passage)] * 20
    out = check_repeats(spark, rows, 35, 12)
    assert all(r.n_removed >= 50 for r in out)


def test_repeats_of_long_texts(spark):
    rng = random.Random(5)
    long = " ".join(f"v{rng.randrange(10**6)}" for _ in range(400_000))  # three pieces
    part = long.split(" ")
    rows = [(1, long), (2, " ".join(part[150_000:150_100])), (3, "x " + " ".join(part[:35])), (4, " ".join(part[-36:])), (5, "word" * 600_000)]
    at = [len(" ".join(part[:n])) for n in (150_000, 150_100)]
    assert at[1] > K.CHUNK
    check_repeats(spark, rows, 35, 12)
    mid = next(n for n in range(100_000, 400_000) if len(" ".join(part[:n])) > K.CHUNK)  # over the cut
    check_repeats(spark, [(1, long), (2, " ".join(part[mid - 40 : mid + 40]))], 35, 12)


def test_repeats_removed_from_texts(spark):
    passage = " ".join(f"p{k}" for k in range(40))
    d = docs(spark, [(1, f"start\n {passage} end"), (2, f"other {passage}"), (3, "kept \n as it is"), (4, None)])
    got = {r.doc_id: r.text for r in substrings.remove_repeats(d).collect()}
    assert got == {1: "start end", 2: "other", 3: "kept \n as it is", 4: None}
    assert substrings.remove_repeats(d.where("doc_id > 9")).collect() == []
    with pytest.raises(ValueError, match="anchors"):
        substrings.mark_repeats(d, length=5, kgram=5)


def test_anchor_of_a_window_depends_on_it_alone():
    rng = np.random.default_rng(6)
    h = rng.integers(0, 40, 300).astype(np.uint64)  # many equal grams
    at = substrings.anchors(h, 9, 2)
    g = K.mix(K.grams(h, 2) ^ substrings._SEED)
    assert at.tolist() == [s + int(np.argmin(g[s : s + 8])) for s in range(292)]


# ---- importance resampling


def features(text, n):
    w = words(text, "alnum")
    return [" ".join(w[i : i + m]) for m in range(1, n + 1) for i in range(len(w) - m + 1)]


def plain_ranks(rows, target, n, buckets, least, percent):
    count = lambda texts: Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t, n))
    s, t = count([x for _, x in rows]), count(target)
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for i, text in rows:
        f = features(text, n)
        weight = sum(gain(zlib.crc32(x.encode()) % buckets) for x in f) // len(f) if f else 0
        h = int(sha(f"7:{'' if i is None else i}")[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text, "alnum"))])
    drawn = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    ranks = {id(r): k for k, r in enumerate(drawn[: len(drawn) * percent // 100], 1)}
    return Counter((*r[:4], ranks.get(id(r))) for r in out)


@pytest.mark.parametrize(("n", "buckets", "least", "percent"), [(2, 10_000, 20, 25), (1, 7, 1, 100), (3, 50, 3, 60), (2, 100, 10**6, 50)])
def test_importance_equals_a_plain_version(spark, n, buckets, least, percent):
    rng = random.Random(7)
    rows = [(k % 150 if k % 9 else None, prose(rng, rng.randrange(60))) for k in range(300)] + [(400, "Äpfel ÄPFEL, apples-Apples 1x2 " * 8), (5, rows_text := prose(rng, 30)), (5, rows_text)] + ODD
    target = [prose(rng, 40) for _ in range(5)] + [None, "", "one"]
    got = importance.rank_documents(docs(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"), keep=["doc_id"], n=n, buckets=buckets, least_words=least, percent=percent)
    assert got.columns == ["doc_id", *importance.RESULT]
    got, want = Counter(tuple(r) for r in got.collect()), plain_ranks(rows, target, n, buckets, least, percent)
    # rows of one id and score are interchangeable
    key = lambda c: sorted((tuple(-1 if x is None else x for x in r[:4]), r[4] or 0) for r in c.elements())
    assert key(got) == key(want)


def test_importance_of_long_texts_and_empty_tables(spark):
    rng = random.Random(8)
    long = " ".join(f"u{rng.randrange(50_000)}" for _ in range(800_000))
    assert len(long) > importance.CHUNK
    rows = [(1, long), (2, long[:1000]), (3, "few words")]
    target = spark.createDataFrame([(long[500:900],)], "text string")
    got = Counter(tuple(r) for r in importance.rank_documents(docs(spark, rows), target, keep=["doc_id"]).collect())
    assert got == plain_ranks(rows, [long[500:900]], 2, 10_000, 20, 25)
    assert importance.rank_documents(docs(spark, []), target).collect() == []
    none = importance.rank_documents(docs(spark, rows[1:]), target.where("false"), percent=100)
    assert sorted((r.doc_id, r["rank"]) for r in none.collect()) == [(2, 1), (3, None)]
    kept = importance.resample(docs(spark, rows), target, percent=50)
    assert kept.columns == docs(spark, rows).columns and kept.count() == 1


def test_suffix_arrays():
    rng = np.random.default_rng(9)
    ids = rng.integers(0, 4, 200)
    bounds = np.array([0, 1, 1, 80, 120, 200])
    room = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(200)
    for n in (1, 2, 3, 5):
        order, lcp = importance.suffixes(ids, room, n)
        cut = [tuple(ids[i : i + min(n, int(room[i]))]) for i in range(200)]
        assert [cut[i] for i in order] == sorted(cut)
        for a, b, m in zip(order[:-1], order[1:], lcp[1:], strict=True):
            assert m == next((k for k in range(n) if k >= min(len(cut[a]), len(cut[b])) or cut[a][k] != cut[b][k]), n)


# ---- fill in the middle


def plain_fim(i, text, rate=50, spm=80):
    t = text or ""
    x = sha(f"42:{'' if i is None else i}")
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = TOKEN.findall(t)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(k in t for k in fim.MARKERS) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, t
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("rate", "spm"), [(50, 80), (100, 50), (0, 0)])
def test_fim_equals_a_plain_version(spark, rate, spm):
    rng = random.Random(10)
    alphabet = ["a", "bb", "é", "\U0001f600", " ", "  ", "\n", "\t", "\x0b", "\x1f", "　", "<", "S>", "<P>"[:2], ">"]
    rows = [(k, "".join(rng.choice(alphabet) for _ in range(rng.randrange(30)))) for k in range(500)] + ODD + [(950, "x <S> y"), (951, "<M>"), (952, "a <P"), (953, "words and spaces " * 200_000)]
    out = fim.restore(fim.rearrange(docs(spark, rows), rate=rate, spm=spm))
    assert out.columns == [*docs(spark, rows).columns, *fim.RESULT, "restored"]
    got = Counter((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in out.collect())
    assert got == Counter((i, t, *plain_fim(i, t, rate, spm), t or "") for i, t in rows)


def test_fim_of_slices_and_markers(spark):
    texts = pa.array(["gone", "one two ", None, "three", ""]).slice(1)
    batch = pa.record_batch([pa.array([1, 2, 3, 4]), texts, *(pa.array([v] * 4) for v in (1, 2, 0, 99))], names=["id", "t", "h1", "h2", "h3", "h4"])
    out = list(fim._rearranged(iter([batch]), 1, 50, 80, fim.MARKERS))[0]
    assert out.column("n").to_pylist() == [3, 0, 1, 0] and out.column("output").to_pylist() == ["<P>one<S> <M> two", "", "<P><S><M>three", ""]
    assert list(fim._restored(iter([out.select(["id", "output", "form"])]), 1, fim.MARKERS))[0].column("restored").to_pylist() == ["one two ", "", "three", ""]
    assert fim.rearrange(docs(spark, [])).collect() == []
    with pytest.raises(ValueError, match="markers"):
        fim.rearrange(docs(spark, []), markers=("<P<", "<S>", "<M>"))
