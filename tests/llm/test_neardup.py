import random
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa

sys.path.insert(0, str(Path(__file__).parent))
from helpers import components, docs, edited, prose, shingles

from palimpsest.llm import neardup
from palimpsest.llm import textkernel as K


def corpus():
    rng = random.Random(5)
    rows, k = [], 0
    for _ in range(12):  # a base, copies of it, and chains of edits of edits
        text = prose(rng, 120)
        for _ in range(8):
            rows.append((k, text))
            text = edited(rng, text, rng.choice([0, 1, 2, 5]))
            k += 1
    base = prose(rng, 150)
    for _ in range(60):  # one larger group around the threshold
        rows.append((k, edited(rng, base, rng.choice([1, 3, 6]))))
        k += 1
    rows += [(k, None), (k + 1, ""), (k + 2, "   \n"), (k + 3, "one two"), (k + 4, "One  TWO"), (k + 5, "one"), (k + 6, "solo")]
    return rows


def test_components_equal_brute_force(spark):
    rows = corpus()
    got = neardup.near_duplicates(docs(spark, rows), shingle=3, percent=85).collect()
    want = components(rows, 3, 85)
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(shingles(t, 3)) for i, t in rows}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_exhaustive_comparison_finds_what_hubs_miss(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 7)
    rows = corpus()
    got = neardup.near_duplicates(docs(spark, rows), shingle=3, percent=85).collect()
    assert {r.doc_id: r.component_id for r in got} == components(rows, 3, 85)


def test_odd_rows(spark):
    rng = random.Random(1)
    t = prose(rng, 50)
    rows = [(1, t), (1, t), (2, t), (None, t), (3, "x" * 300_000 + " y z"), (4, "x" * 300_000 + " y z")]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id, r.kept) for r in neardup.near_duplicates(docs(spark, rows), shingle=3, percent=85).collect())
    assert got == [(False, 1, 1, True), (False, 1, 1, True), (False, 2, 1, False), (False, 3, 3, True), (False, 4, 3, False), (True, 0, None, False)]
    assert neardup.near_duplicates(docs(spark, [])).count() == 0


def test_one_id_with_two_texts_joins_their_groups(spark):
    rng = random.Random(2)
    a, b = prose(rng, 60), prose(rng, 60)
    got = neardup.near_duplicates(docs(spark, [(1, a), (2, a), (2, b), (3, b)]), shingle=3, percent=85).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1)}


def test_deduplicate_keeps_columns(spark):
    rows = docs(spark, [(2, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (5, None), (6, ""), (None, "g h"), (None, "g h"), (7, "x y z"), (7, "other words here")])
    got = neardup.deduplicate(rows)
    assert got.columns == rows.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == [(0, "g h"), (1, "a b c d e f"), (5, ""), (6, ""), (7, "other words here"), (7, "x y z")]
    odd = rows.withColumnRenamed("lang", "_row").withColumnRenamed("source", "comp").withColumnRenamed("n_chars", "node")
    assert neardup.deduplicate(odd).columns == odd.columns and neardup.deduplicate(odd).count() == 6
    assert neardup.deduplicate(rows.limit(0)).count() == 0


def test_many_copies_of_a_set_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT_COPIES", 3)
    rows = corpus() + [(1000 + k, "the same words again and again") for k in range(50)]
    got = neardup.near_duplicates(docs(spark, rows), shingle=3, percent=85).collect()
    assert {r.doc_id: r.component_id for r in got} == components(rows, 3, 85)


def test_string_ids(spark):
    rows = corpus()
    named = spark.createDataFrame([(f"d{i:05d}", t) for i, t in rows], "doc_id string, text string")
    want = {f"d{i:05d}": f"d{c:05d}" for i, c in components(rows, 3, 85).items()}
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(named, shingle=3, percent=85).collect()} == want


def test_estimate_is_near_the_similarity():
    rng = random.Random(3)
    a = prose(rng, 400, 10**6)
    b = edited(rng, a, 12)
    true = len(shingles(a, 3) & shingles(b, 3)) / len(shingles(a, 3) | shingles(b, 3))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([a, b])], names=["doc_id", "text"])
    out = next(neardup._sketch(iter([batch]), 3))
    lanes = 0
    for x, y in zip(*(np.array(v, np.int64).view(np.uint64) for v in out.column("sig").to_pylist()), strict=True):
        lanes += sum((int(x) >> s) & 15 == (int(y) >> s) & 15 for s in range(0, 64, 4))
    estimate = (lanes / neardup.HASHES - 1 / 16) / (15 / 16)
    assert abs(estimate - true) < 0.15


def test_words_of_buffers():
    texts = ["Hello  World", "", None, "é" * 400_000 + " b", "x\ty\nz", "tail"]
    w = K.words(*K.texts(pa.array(texts)), K.SPACED)
    assert np.diff(w.bounds).tolist() == [2, 0, 0, 2, 3, 1]
    own = K.words(*K.texts(pa.array(["WORLD"])), K.SPACED)
    assert own.hashes[0] == w.hashes[1]


def test_long_texts_of_a_bucket_are_compared_in_small_blocks(spark, monkeypatch):
    """Texts just below the similarity share bands, and some of them are linked by others only."""
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 25_000)
    rng = random.Random(12)
    base = prose(rng, 10_000, 10**6)
    rows = [(k, edited(rng, base, rng.choice([150, 270, 290]))) for k in range(24)]
    seen, blocks = [], neardup._Graph._exhausted

    def watched(self, labels):
        apart = blocks(self, labels)
        seen.append(self.reps.selectExpr("sum(n)").first()[0])
        return apart

    monkeypatch.setattr(neardup._Graph, "_exhausted", watched)
    got = neardup.near_duplicates(docs(spark, rows), shingle=3, percent=85).collect()
    assert {r.doc_id: r.component_id for r in got} == components(rows, 3, 85)
    assert len(set(components(rows, 3, 85).values())) > 2 and seen[0] > 8 * neardup.BLOCK_SHINGLES
