import hashlib
import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from helpers import docs, prose, words

from palimpsest.llm import decontaminate


def brute(rows, items):
    windows = {}
    for i, t in items:
        w = words(t, "alnum")
        n = min(13, len(w))
        for k in range(len(w) - n + 1):
            if n:
                windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for i, t in rows:
        w = words(t, "alnum")
        hit, ids = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[k : k + n]))):
                    hit.update(range(k, k + n))
                    ids |= found
        out.append((i, len(w), len(hit), sorted(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def case():
    rng = random.Random(4)
    items = [(k, prose(rng, n, 5000)) for k, n in enumerate([13, 14, 20, 40, 40, 5, 1, 12, 60])]
    items += [(20, items[3][1]), (21, ""), (22, None), (23, items[4][1][:60].upper())]
    rows = []
    for k in range(60):
        text = prose(rng, rng.choice([3, 30, 200, 800]), 5000)
        w = text.split(" ")
        for _ in range(k % 3):
            own = (items[rng.randrange(9)][1]).split(" ")
            a = rng.randrange(max(1, len(own) - 14))
            at = rng.randrange(len(w))
            w[at:at] = own[a : a + rng.choice([12, 13, 14, 30])]
        rows.append((k, rng.choice([" ", "--", "\n"]).join(w)))
    rows += [(100, None), (101, ""), (102, items[3][1].upper()), (103, items[3][1]), (103, items[3][1])]
    return rows, items


def check(spark, **options):
    rows, items = case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.mark_contamination(docs(spark, rows), bench, keep=["doc_id"], **options).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids, r.items_sha256, r.contaminated) for r in got), key=str) == brute(rows, items)


def test_equals_brute_force(spark):
    check(spark)


def test_several_blocks_of_the_benchmark(spark):
    check(spark, block_words=120)


def test_clean_documents_stay_with_clashing_columns(spark):
    rows, items = case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    d = docs(spark, rows).withColumnRenamed("n_chars", "n_hit")
    got = decontaminate.decontaminate(d, bench)
    assert got.columns == d.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(i for i, *_, bad in brute(rows, items) if not bad)
    assert decontaminate.decontaminate(d.limit(0), bench).count() == 0
    assert decontaminate.decontaminate(d, bench.limit(0)).count() == len(rows)


def test_items_without_ids_and_exact_shares(spark):
    bench = spark.createDataFrame([(None, "one two three"), (None, "four five six"), (7, "one two three")], "item_id long, text string")
    rows = spark.createDataFrame([(1, "one two three a b"), (2, "four five six"), (3, "a b c")], "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate.mark_contamination(rows, bench, keep=["doc_id"]).collect()}
    assert [(got[k].n_hit, got[k].item_ids, got[k].contaminated) for k in (1, 2, 3)] == [(3, ["7", None], True), (3, [None], True), (0, [], False)]
    for share, over in ((0.7, False), (0.6, True), (0.61, False), (0.5, True)):  # three of five words
        assert decontaminate.mark_contamination(rows, bench, share=share).where("doc_id = 1").first().contaminated == over
    assert decontaminate.mark_contamination(rows, bench, share=0.7).where("doc_id = 2").first().contaminated


def test_large_benchmarks_with_repeated_ids_and_odd_rows(spark):
    rng = random.Random(8)
    items = [(k % 40, prose(rng, rng.choice([1, 4, 12, 13, 30]), 3000)) for k in range(120)] + [(None, "lonely words of no item"), (None, None), (7, ""), (8, "twice twice twice"), (8, "twice twice twice")]
    long = prose(rng, 200_000, 10**9)
    rows = [(k, " ".join([prose(rng, 40, 3000), rng.choice(items)[1] or "", prose(rng, 30, 3000)])) for k in range(80)]
    rows += [(None, items[3][1]), (1, items[3][1]), (900, f"{long} {items[4][1]}"), (901, "lonely words of no item"), (902, None), (903, "twice twice twice twice")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    columns = ["doc_id", "n_words", "n_hit", "item_ids", "items_sha256", "contaminated"]
    once = decontaminate.mark_contamination(docs(spark, rows), bench, keep=["doc_id"]).select(*columns).collect()
    blocks = decontaminate.mark_contamination(docs(spark, rows), bench, keep=["doc_id"], block_words=500).select(*columns).collect()
    key = lambda r: str(tuple(r))
    assert sorted(once, key=key) == sorted(blocks, key=key)
    known = [(i, t) for i, t in items if i is not None]
    got = {r.doc_id: r for r in once if r.doc_id is not None and r.doc_id >= 900}
    want = {r[0]: r for r in brute([r for r in rows if r[0] is not None and r[0] >= 900 and r[0] != 901], known)}
    assert all((r.n_words, r.n_hit, r.item_ids, r.items_sha256, r.contaminated) == want[i][1:] for i, r in got.items() if i != 901)
    assert (got[901].n_hit, got[901].item_ids) == (5, [None]) and got[903].item_ids == ["8"]


def test_columns_of_any_name_stay(spark):
    d = docs(spark, [(1, "a b c"), (2, None)]).withColumnRenamed("lang", "_text2").withColumnRenamed("source", "k")
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    for size in (100_000, 1):
        got = decontaminate.mark_contamination(d, bench, block_words=size).orderBy("doc_id").collect()
        assert [(r.doc_id, r.k, r.n_words, r.n_hit) for r in got] == [(1, "s", 3, 3), (2, "s", 0, 0)]


def test_many_blocks_are_as_many_jobs_as_few(spark):
    """A long item is cut where windows overlap; jobs do not grow with the blocks."""
    rng = random.Random(31)
    long = [f"v{rng.randrange(10**5)}" for _ in range(30_000)]
    items = [("long", " ".join(long)), ("short", "five words of an item"), (None, " ".join(long[50:80])), ("gap", "aa bb " + " " * 9_000 + "cc dd"), ("few", "  ")]
    rows = [(1, "x " + " ".join(long[700:760])), (2, "it has five words of an item in it"), (3, " ".join(long[40:70])), (4, "aa bb cc dd and more"), (5, "nothing of it"), (6, None), (7, " ".join(long[-13:]))]
    rows += [(100 + k, " ".join(long[k * 90 : k * 90 + 14])) for k in range(300)]  # over every cut
    d, b = docs(spark, rows), spark.createDataFrame(items, "item_id string, text string")
    seen, jobs = [], []
    for words_ in (10**6, 20_000, 300):
        group = f"blocks {words_}"
        spark.sparkContext.setJobGroup(group, group)
        out = decontaminate.mark_contamination(d, b, keep=["doc_id"], block_words=words_)
        seen.append(sorted((r.doc_id, r.n_words, r.n_hit, r.hit_spans, r.item_ids, r.items_sha256, r.contaminated) for r in out.collect()))
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert seen[0] == seen[1] == seen[2] and sum(r[6] for r in seen[0]) == 305
    assert jobs[2] <= jobs[1] + 2
