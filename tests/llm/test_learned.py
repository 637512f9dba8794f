import random
import re
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from helpers import docs, prose, words

from palimpsest.llm import quality, toxicity
from palimpsest.llm import textkernel as K


def web():
    rng = random.Random(12)
    rows, labels = [], []
    for k in range(400):
        good = k % 4 > 0
        text = ". ".join(prose(rng, rng.randrange(5, 14)).capitalize() for _ in range(rng.randrange(4, 30)))
        if not good:
            text = rng.choice([text.upper() + "!!", " ".join(["spam word"] * rng.randrange(20, 200)), "### $$$ " * 40])
        rows.append((k, text))
        labels.append((k, int(good)))
    return rows, labels


def test_positive_unlabelled_learning(spark):
    rows, labels = web()
    d = docs(spark, [*rows, (None, "x"), (900, None), (901, ""), (902, "ok " * 200_000)])
    known = spark.createDataFrame(labels, "doc_id long, label int")
    learn = known.where(quality.remainder(known.doc_id, 5) != 0)
    got = {r.doc_id: r.score for r in quality.score_documents(d, quality.train(d, learn), keep=["doc_id"]).collect()}
    assert len(got) == len(rows) + 4 and all(0 <= s <= 1 for s in got.values())
    held = [(got[i], y) for i, y in labels if __import__("zlib").crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(s >= 0.3) == bool(y) for s, y in held]) > 0.95
    only = quality.train(d, learn.where("label = 1"))
    some = {r.doc_id: r.score for r in quality.score_documents(d, only, keep=["doc_id"]).collect()}
    assert np.mean([some[i] for i, y in labels if y]) > np.mean([some[i] for i, y in labels if not y]) + 0.3


def test_untrained_model_scores_all(spark):
    d = docs(spark, [(1, "a"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, label int")
    assert {r.score for r in quality.score_documents(d, quality.train(d, none)).collect()} == {0.5}
    scored = toxicity.score_documents(d, toxicity.train(d, none)).collect()
    assert all(r.score < 0.5 and not r.spans for r in scored)


def test_negative_risk_stays_bounded():
    rng = np.random.default_rng(0)
    p, n = rng.normal(1.5, 1, (200, 3)), rng.normal(-1.5, 1, (300, 3))
    u = np.concatenate([rng.normal(1.5, 1, (100, 3)), n[:100]])
    m = quality.fit(p, u, 0.5)
    assert (m.score(p) > 0.5).mean() > 0.9 and (m.score(n) < 0.5).mean() > 0.9
    assert 0.3 < quality.estimate_prior(m.score(p), m.score(u)) < 0.75
    assert 0.35 < quality.cross_prior(p, u) < 0.7


def test_field_finds_spans(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for k in range(600):
        w = prose(rng, rng.randrange(20, 120), 300).split(" ")
        if bad := k % 3 == 0:
            for _ in range(rng.randrange(2, 5)):
                w.insert(rng.randrange(len(w)), rng.choice(["zarg", "zargish", "blöd", "fleem"]))
        rows.append((k, " ".join(w)))
        labels.append((k, int(bad)))
    d = docs(spark, [*rows, (700, None), (701, ""), (702, "héé — zarg zarg! ok")])
    known = spark.createDataFrame([x for x in labels if x[0] < 400], "doc_id long, label int")
    got = {r.doc_id: r for r in toxicity.score_documents(d, toxicity.train(d, known), keep=["doc_id"]).collect()}
    assert np.mean([(got[i].score >= 0.7) == bool(y) for i, y in labels if i >= 400]) > 0.97
    text = dict(rows)
    for i, y in labels[402:420]:
        found = {t for s in got[i].spans for t in text[i][s.start : s.end].split(" ")}
        assert bool(found) == bool(y) and found <= {"zarg", "zargish", "blöd", "fleem"}
    assert [tuple(s) for s in got[702].spans] == [(6, 15)]
    assert got[700].score < 0.5 and got[701].spans == []


def test_passes_equal_a_plain_chain():
    rng = np.random.default_rng(1)
    n = 150
    u, trans, start = rng.normal(0, 2, n), rng.normal(0, 1, (2, 2)), -0.5
    first = np.zeros(n, bool)
    first[[0, 40, 41, 149]] = True
    forward, backward, _ = toxicity.passes(u, first, trans, start)
    p = forward * backward
    p = p[:, 1] / p.sum(1)
    ends = [*np.flatnonzero(first).tolist(), n]
    for a, b in zip(ends, ends[1:], strict=False):
        f = np.zeros((b - a, 2))
        f[0] = [1, np.exp(start + u[a])]
        for t in range(1, b - a):
            f[t] = (f[t - 1] @ np.exp(trans)) * [1, np.exp(u[a + t])]
        g = np.ones((b - a, 2))
        for t in range(b - a - 2, -1, -1):
            g[t] = np.exp(trans) @ (g[t + 1] * [1, np.exp(u[a + t + 1])])
        want = f * g
        assert np.allclose(p[a:b], want[:, 1] / want.sum(1))


def test_features_of_odd_texts():
    x = quality.features(pa.array([None, "", " ", "\n\n", "a", "é" * 10_000]))
    assert x.shape == (6, quality.FEATURES) and np.isfinite(x).all()


def plain_features(text):
    """The numbers of a text for the quality model, one by one from its characters."""
    data, signs = text.encode(), "!?.,:;|#$%&*@/\\<>{}[]()=_-+~^'\""
    kind = lambda b: 0 if 65 <= b <= 90 else 1 if 97 <= b <= 122 else 2 if 48 <= b <= 57 else 3 if b >= 128 else 5 if b == 10 else 4 if b in b" \t\x0b\x0c\r" else 7 + signs.index(chr(b)) if chr(b) in signs else 6
    counts = np.bincount([kind(b) for b in data], minlength=7 + len(signs)).astype(float)
    w = [x.encode() for x in words(text)]
    raw = re.findall(r"[^ \t-\r]+", text)
    n, size, length = len(w), len(data), [len(x) for x in w]
    different = lambda k: len(set(zip(*(w[i:] for i in range(k)), strict=False))) if n >= k else min(n, 1)
    one, lines = max(1, n), counts[5] + 1
    mean = sum(length) / one
    share = counts / max(1, size)
    u1 = different(1) / one
    ends = lambda at, low: sum(kind(x.encode()[at]) >= low for x in raw) / one
    rest = [
        np.log1p(n), np.log1p(size), mean, max(0, sum(x * x for x in length) / one - mean**2) ** 0.5, u1, different(2) / max(1, n - 1), different(3) / max(1, n - 2), u1 * np.log1p(n), n == 0, n / lines / 50, np.log1p(n / lines), lines / one,
        counts[0] / max(1, counts[[0, 1, 3]].sum()), sum(kind(x.encode()[0]) == 0 for x in raw) / one, ends(-1, 6), ends(0, 6), sum(x == 1 for x in length) / one, sum(x > 15 for x in length) / one, n < 20, n < 50,
    ]
    return np.concatenate([share, np.sqrt(share), np.array(rest, float)])


def odd_texts():
    rng = random.Random(7)
    return ["", " \n", "A", "One two, Three! é\n\nfour\tfive 5", "x" * 3000, *(prose(rng, 200, 30).replace(" ", rng.choice([" ", "\n", ". "]), 40) for _ in range(10)), "tiny é " * 300_000]


def test_quality_scores_equal_a_plain_version(spark):
    rows, labels = web()
    model = quality.train(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, label int"))
    texts = [*odd_texts(), *(t for _, t in rows[:40])]
    d = docs(spark, [*enumerate(texts), (1, "another text of one id"), (None, None)]).withColumnRenamed("lang", "score")
    got = quality.score_documents(d, model, keep=["doc_id", "text"]).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        z = np.clip((plain_features(r.text or "") - model.mean) / model.scale, -8, 8) @ model.weights + model.bias
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-3  # features are kept in single precision
    assert quality.score_documents(d, model).columns == [c for c in d.columns if c != "score"] + ["score"]
    assert quality.score_documents(d.limit(0), model).count() == 0
    again = quality.train(docs(spark, rows).repartition(7), spark.createDataFrame(labels[::-1], "doc_id long, label int"))
    assert np.array_equal(again.weights, model.weights)


def plain_toxicity(field, text):
    """(score, spans) of a text by a chain of its own, token by token."""
    tokens = [m for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    if not tokens:
        return 1 / (1 + np.exp(-field.final[3])), []
    w = K.words(*K.texts(pa.array([" ".join(m[0] for m in tokens)])), K.ALNUM, toxicity.HEADS, toxicity.TAILS)
    u = field.weights[toxicity.token_features(w)].sum(0, dtype=float) + field.bias
    t = np.exp(field.trans)
    f = [np.array([1.0, np.exp(field.start + u[0])])]
    for x in u[1:]:
        f.append((f[-1] @ t) * [1, np.exp(x)])
        f[-1] /= f[-1].sum()
    g = [np.ones(2)]
    for x in u[:0:-1]:
        g.append(t @ (g[-1] * [1, np.exp(x)]))
        g[-1] /= g[-1].sum()
    p = np.array([(a * b)[1] / (a * b).sum() for a, b in zip(f, g[::-1], strict=True)])
    z = field.final @ [p.max(), np.log1p(p.sum()), min(1, 20 * p.sum() / len(p)), 1]
    spans = []
    for k in np.flatnonzero(p >= 0.5).tolist():
        if spans and spans[-1][2] == k - 1:
            spans[-1][1:] = [tokens[k].end(), k]
        else:
            spans.append([tokens[k].start(), tokens[k].end(), k])
    return 1 / (1 + np.exp(-z)), [(a, b) for a, b, _ in spans]


def test_toxicity_equals_a_plain_version(spark):
    rng = random.Random(4)
    rows = [(k, prose(rng, 40, 200) + (" zarg fleem" if k % 2 else "") + " end") for k in range(120)]
    known = spark.createDataFrame([(k, k % 2) for k in range(120)], "doc_id long, label int")
    field = toxicity.train(docs(spark, rows), known)
    texts = [*odd_texts(), *(t for _, t in rows[:30]), "é zarg, fleem! " * 5 + "fine", prose(rng, 150_000, 10**6) + " zarg"]
    d = docs(spark, [*enumerate(texts), (1, "zarg of one id"), (None, None)]).withColumnRenamed("lang", "score").withColumnRenamed("source", "spans")
    got = toxicity.score_documents(d, field, keep=["doc_id", "text"]).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        score, spans = plain_toxicity(field, r.text or "")
        assert abs(r.score - score) < 1e-6 and [tuple(s) for s in r.spans] == spans
    assert sum(bool(r.spans) for r in got) >= 16
    assert toxicity.score_documents(d.limit(0), field).count() == 0
    few = toxicity.train(docs(spark, rows), known, max_bytes=2_000)  # some texts, whole
    assert few.weights.any()
    assert not toxicity.train(docs(spark, rows), known.where("label = 1")).weights.any()
    with pytest.raises(ValueError, match="text of at most 5 bytes"):
        toxicity.train(docs(spark, rows), known, max_bytes=10)
    more = docs(spark, [*rows, (1000, "long " * 30_000), (1001, "longer zarg " * 30_000), (1, rows[1][1]), (1, rows[1][1])])  # too long to learn from, and repeated
    labels = known.union(spark.createDataFrame([(1000, 0), (1001, 1)], "doc_id long, label int"))
    again = toxicity.train(more, labels, max_bytes=200_000)
    assert (again.weights == field.weights).all() and (again.final == field.final).all()


def test_pieces_of_a_long_text_give_the_marginals_of_the_whole(monkeypatch):
    rng = random.Random(9)
    field = toxicity.Field()
    field.weights = np.random.default_rng(3).normal(0, 1.5, len(field.weights)).astype(np.float32)
    field.trans = np.array([[1.0, -1.0], [-0.5, 0.8]])
    for text in ("  " + prose(rng, 900, 50) + " é\n", "x", " - ", "a b", "w" * 700 + " " + prose(rng, 100, 9), prose(rng, 40, 5) + " " * 900 + "end"):
        data, offs = K.texts(pa.array([text]))
        w = K.words(data, offs, K.ALNUM, toxicity.HEADS, toxicity.TAILS)
        want = field.marginals(w)
        score, spans = toxicity._long(field, data, 0, int(offs[1]))
        for size in (1, 30, 200, 5_000):
            with monkeypatch.context() as m:
                pieces = K.pieces
                m.setattr(K, "pieces", lambda data, offs, kind, size=size, **options: pieces(data, offs, kind, size, **options))
                got = [(base + int(w.starts[k]), x) for w, base, own, p in field.long_marginals(data, 0, int(offs[1])) for k, x in zip(range(own.start, own.stop), p, strict=True)]
                assert [at for at, _ in got] == w.starts.tolist() and np.allclose([x for _, x in got], want, atol=1e-9)
                again = toxicity._long(field, data, 0, int(offs[1]))
                assert abs(again[0] - score) < 1e-9 and again[1] == spans and abs(score - field.score(w, want)[0]) < 1e-9


def test_rare_toxic_words_of_few_documents_are_learnt(spark):
    rng = random.Random(6)
    rows = [(k, prose(rng, 60, 200) + (" vilest" if k < 6 else "") + " " + prose(rng, 20, 200)) for k in range(60)]
    field = toxicity.train(docs(spark, rows), spark.createDataFrame([(k, int(k < 6)) for k in range(60)], "doc_id long, label int"))
    got = {r.doc_id: r.score for r in toxicity.score_documents(docs(spark, rows), field).collect()}
    assert min(got[k] for k in range(6)) > max(got[k] for k in range(6, 60))
