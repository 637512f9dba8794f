import hashlib
import itertools
import random
import sys
from collections import Counter
from pathlib import Path

sys.path[:0] = [str(Path(__file__).parents[2]), str(Path(__file__).parent)]
import corpus_pipeline
import numpy as np
import pytest
from helpers import edited, prose, shingles
from test_decontaminate import brute
from test_learned import plain_features, web
from test_mix_shard import plain_mix

from palimpsest.llm import neardup, quality, scratch, shard

SF = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not SF.exists(), reason="the test tables are not here")
def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(SF))
        rows = out.collect()
        seen[name] = rows
        if name != "sharding":
            assert out.columns == columns
            docs = spark.createDataFrame(rows, docs.schema)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in seen["quality"]}
    here = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    right = [(i in kept) == bool(q) for i, q in labels.items() if i in here]
    assert sum(right) / len(right) >= 0.95
    assert all(r.kept for r in neardup.near_duplicates(spark.createDataFrame(seen["near-dedup"], columns and docs.schema)).collect())
    assert {r.doc_id for r in seen["mixing"]} <= {r.doc_id for r in seen["decontamination"]}
    assert max(Counter(r.doc_id for r in seen["mixing"]).values()) <= 3
    assert len(seen["sharding"]) == len(seen["mixing"]) and all(0 <= r.shard < shard.SHARDS for r in seen["sharding"])


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, _score string, _row int, shared string"


def plain_distinct(rows):
    """One row of each group of rows whose five-word shingles are 80 % alike."""
    sets, root = [shingles(r[1], 5) for r in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            root[find(a)] = find(b)
    best = {}
    for k, r in enumerate(rows):
        group = find(k) if sets[k] else ("alone", k)
        order = (r[0] is None, r[0] or 0)
        if group not in best or order < best[group][0]:
            best[group] = order, r
    return [r for _, r in best.values()]


def test_rows_equal_plain_stages(spark, tmp_path):
    rng = random.Random(21)
    web_rows, web_labels = web()
    items = [(k, prose(rng, 30, 3000)) for k in range(6)]
    rows = []
    for i, text in web_rows[:150]:
        rows.append((i, text, "en", rng.choice(["a", "a", "b", "c", None]), None, 0.5, "x", 1, "s"))
        if i % 9 == 0:  # exact and near copies
            rows.append((1000 + i, text, "en", "c", None, 0.5, "x", 1, "s"))
            rows.append((2000 + i, edited(rng, text, 1) if len(text.split(" ")) > 60 else text, "en", "b", None, 0.5, "x", 1, "s"))
        if i % 13 == 0:
            rows.append((3000 + i, f"{text} {items[i % 6][1]}", "en", "a", None, 0.5, "x", 1, "s"))
    rows += [(None, rows[3][1], "en", "a", 1, 0.1, None, None, None), (None, "Of no number, but. Quite fine words here.", None, None, None, None, None, None, None), (5, None, "en", "a", None, 0.5, "x", 1, "s"), (6, "", "en", "a", None, 0.5, "x", 1, "s")]
    rows += [rows[4], rows[4]]
    sf = str(tmp_path)
    docs = spark.createDataFrame(rows, COLUMNS)
    docs.write.parquet(f"{sf}/documents.parquet")
    labels = spark.createDataFrame([(i, y, 0) for i, y in web_labels], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    made = len(scratch._made)
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == [*docs.columns, "slot", "shard"]
    got = Counter(tuple(r) for r in got.collect())

    model = quality.train(spark.read.parquet(f"{sf}/documents.parquet"), labels.select("doc_id", labels.quality.alias("label")).where(quality.remainder(labels.doc_id, 5) != 0))
    score = lambda t: 1 / (1 + np.exp(-(np.clip((plain_features(t or "") - model.mean) / model.scale, -8, 8) @ model.weights + model.bias)))
    kept = plain_distinct([r for r in rows if score(r[1]) >= corpus_pipeline.QUALITY])
    bad = {i for i, *_, hit in brute([(k, r[1]) for k, r in enumerate(kept)], items) if hit}
    clean = [r for k, r in enumerate(kept) if k not in bad]
    assert 0 < len(bad) and len(clean) < len(kept) < len(rows)
    table, want = shard.fill([f"shard-{k:05d}" for k in range(shard.SHARDS)]), Counter()
    for r, n in plain_mix(spark.createDataFrame(clean, COLUMNS)).items():
        slot = int(hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest()[:15], 16) % shard.SLOTS
        want[(*r, slot, table[slot])] += n
    assert got == Counter({k: n for k, n in want.items() if n})
    left = [p for _, p in scratch._made[made:] if Path(p.removeprefix("file://")).exists()]
    assert {Path(p).name.split("-")[0] for p in left} <= {"mixing", "sources", "sizes", "targets", "placed", "cuts"}


def test_stages_take_empty_tables(spark, tmp_path):
    sf = str(tmp_path)
    docs = spark.createDataFrame([], COLUMNS)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0 and out.columns[: len(docs.columns)] == docs.columns, name
