import random
import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from helpers import docs, prose, words
from pyspark.sql import functions as F

from palimpsest.llm import mix, shard


def targets(sizes, weights=(5, 2, 1)):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    out, free, left = {}, set(sizes), float(sum(sizes.values()))
    while free:
        level = left / sum(w[s] for s in free)
        full = {s for s in free if 3 * sizes[s] < level * w[s]}
        if not full:
            return out | {s: level * w[s] for s in free}
        for s in full:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        free -= full
    return out


def corpus():
    rng = random.Random(9)
    rows = [(k, prose(rng, rng.randrange(1, 300)), rng.choice(["a", "a", "a", "a", "b", "c", "z", None])) for k in range(300)]
    return [*rows, (900, None, "a"), (901, "", "tiny"), (902, "x y", "tiny"), (903, "p q r", "b"), (903, "p q r", "b")]


@pytest.mark.parametrize("block", [16, 512])
def test_taken_words_meet_targets(spark, block):
    rows = corpus()
    m = mix.Mix(docs(spark, rows), block=block)
    got = m.taken().collect()
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(words(t))
    want = targets(size)
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in got)
    by = {r.source: (r["size"], r.target) for r in m.sources.collect()}
    assert {s: x[0] for s, x in by.items()} == size
    for s, t in want.items():
        assert by[s][1] == pytest.approx(t)
    source = {i: s for i, _, s in rows}
    taken = Counter()
    for r in got:
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - t) <= 1 for s, t in want.items())


def test_taken_of_odd_tables(spark):
    rows = [(1, "w " * 300_000, "a"), (2, "x", "b"), (2, "x", "b"), (None, "y z", None), (3, None, "c")]
    d = docs(spark, rows).withColumnRenamed("lang", "size").withColumnRenamed("n_chars", "ord")
    got = sorted((r.doc_id or 0, r["size"], r.taken) for r in mix.Mix(d).taken().collect())
    assert [x[:2] for x in got] == [(0, 2), (1, 300_000), (2, 1), (2, 1), (3, 0)] and [x[2] for x in got if x[0] != 1] == [6, 3, 3, 0]
    assert mix.Mix(d.limit(0)).taken().count() == 0


def test_slots_follow_the_points(spark):
    m = mix.Mix(docs(spark, corpus()), block=8)
    ends = sorted((r.low, r.high, r.ord) for r in m.sources.where("high > low").collect())
    blocks = {r.ord: r.blocks for r in m.sources.collect()}
    seen, want = Counter(), set()
    for i in range(m.n_slots):
        point = int(f"{i:0{mix.BITS}b}"[::-1], 2)
        o = next(o for a, b, o in ends if a <= point < b)
        if seen[o] < blocks[o]:
            want.add((i, o, seen[o]))
        seen[o] += 1
    m.small = True
    one = {tuple(r) for r in m.schedule().where(F.col("slot") < m.n_slots).collect()}
    m.small = False
    other = {tuple(r) for r in m.schedule().where(F.col("slot") < m.n_slots).collect()}
    assert one == want == other
    full = Counter(r.ord for r in m.schedule().collect())
    assert {o: n for o, n in full.items()} == {o: n for o, n in blocks.items() if n}


def test_whole_documents_and_reruns(spark):
    d = docs(spark, corpus())
    got = mix.mix_documents(d)
    assert got.columns == d.columns
    a, b = (Counter(tuple(r) for r in x.collect()) for x in (got, mix.mix_documents(d.repartition(7))))
    assert a == b == Counter({k: n for k, n in plain_mix(d).items() if n})
    assert max(n for k, n in a.items() if k[0] != 903) <= 3 and not any(k[1] in (None, "") for k in a)
    assert mix.mix_documents(d.limit(0)).count() == 0


def plain_mix(d):
    """row -> copies: documents in their source's order, over and over, up to its target."""
    every = F.xxhash64(F.lit(0), *d.columns)
    rows = [(r.source, r.place, r.doc_id if r.doc_id is not None else -1, tuple(r)[:-1], len(words(r.text))) for r in d.withColumn("place", every).collect()]
    size = Counter()
    for s, *_, n in rows:
        size[s] += n
    want, out = targets(dict(size)), Counter()
    for s in size:
        own = [r for r in rows if r[0] == s]
        buckets = -(-len(own) // mix.BUCKET_ROWS)
        own.sort(key=lambda r: (r[1] % buckets, r[1], r[2]))
        for turn in range(3):
            at = turn * size[s]
            for *_, row, n in own:
                if n and at < int(want[s] + 1e-6):
                    out[row] += 1
                at += n
    return out


def test_equal_rows_at_the_cut_are_taken_in_number(spark, monkeypatch):
    monkeypatch.setattr(mix, "BUCKET_ROWS", 7)
    rows = [(k, "a b c d e", "one") for k in range(30)] + [(500, "x y z", "two")] * 90 + [(700 + k, None if k % 2 else "", "one") for k in range(5)] + [(800, "w " * 50_000, "three")]
    d = docs(spark, rows).withColumnRenamed("lang", "h").withColumnRenamed("n_chars", "cut")
    got = mix.mix_documents(d)
    assert got.columns == d.columns
    assert Counter(tuple(r) for r in got.collect()) == Counter({k: n for k, n in plain_mix(d).items() if n})
    with pytest.raises(ValueError):
        monkeypatch.setattr(mix, "BITS", 4)
        mix.Mix(d, block=1)


def test_table_is_filled_in_turns():
    names = [f"n{k}" for k in range(7)]
    table = shard.fill(names, 101)
    count = Counter(table)
    assert set(table) == set(range(7)) and max(count.values()) - min(count.values()) <= 1
    fewer = shard.fill(names[:-1], 101)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6)
    assert moved < 30
    with pytest.raises(ValueError):
        shard.fill(names, 100)


def test_shards(spark, tmp_path):
    d = docs(spark, [(k, "t") for k in range(500)] + [(None, "t"), (3, "t")]).withColumn("slot", F.lit("own"))
    got = shard.assign_shards(d, shards=5, slots=101)
    assert got.columns == [*(c for c in d.columns if c != "slot"), "slot", "shard"] and got.count() == 502
    assert shard.assign_shards(d.limit(0)).count() == 0
    long = shard.assign_shards(docs(spark, [(1, "x" * 2_000_000), (1, "x")]).withColumnRenamed("lang", "shard"))
    assert long.select("slot", "shard").distinct().count() == 1 and long.columns[-2:] == ["slot", "shard"]
    table = shard.fill([f"shard-{k:05d}" for k in range(5)], 101)
    assert all(table[r.slot] == r.shard for r in got.collect())
    assert got.where("doc_id = 3").select("shard").distinct().count() == 1
    by_slot = shard.assign_shards(d, key_col="slot", shards=5, slots=101)
    assert by_slot.select("shard").distinct().count() == 1
    shard.write_shards(d.drop("slot"), str(tmp_path / "out"), shards=5, slots=101)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 502


def test_each_documents_words_follow_from_its_place(spark, monkeypatch):
    """What a document gives is what its turns have before the quota; equal rows are split up."""
    monkeypatch.setattr(mix, "COPIES", 7)
    rng = random.Random(21)
    rows = [(k, prose(rng, rng.randrange(30)), rng.choice("abcd")) for k in range(150)]
    rows += [(None, "the same few words", "a")] * 60 + [(7, "twice", None)] * 9 + [(8, "", "b")] * 20 + [(9, None, "b")] * 20
    for block in (5, 64):
        m = mix.Mix(docs(spark, rows), block=block)
        placed, taken = m.placed.collect(), m.taken().collect()
        assert len(placed) == len(taken) == len(rows)
        assert sorted((r.doc_id or -1, r.size) for r in placed) == sorted((i or -1, len((t or "").split())) for i, t, _ in rows)
        by_source = {}
        for r in placed:
            by_source.setdefault(r.source, []).append(r)
        want = []
        for own in by_source.values():
            at = 0
            for r in sorted(own, key=lambda r: (r.start, r.size)):
                if r.size:
                    assert r.start == at
                at += r.size
                assert r.source_size == sum(x.size for x in own)
                want.append((r.doc_id or -1, r.size, sum(max(0, min(r.size, r.quota - t * r.source_size - r.start)) for t in range(3))))
        assert sorted((r.doc_id or -1, r.size, r.taken) for r in taken) == sorted(want)
