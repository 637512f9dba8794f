import gzip
import hashlib
import io
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import ann, warc

PAGES = "page_id long, url string, html string"


def pages():
    rng = random.Random(6)
    big = ["x" * 1000, "ü" * 700, "<p>" + "y" * 5000 + "</p>\r\n\r\nWARC/1.1\r\n"]
    rows = [(k, f"http://a/{k}", rng.choice([*big, "small", "", f"own {k} " * 300])) for k in range(200)]
    return [*rows, (500, None, None), (501, "http://b\r\nX: y", "z" * 999), (502, "u", "z" * 999)]


def want(rows):
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        head = max(j for j, _, g in rows if (g or "") == (h or ""))
        revisit = len(b) >= 1000 and head != i
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", head if revisit else None))
    return sorted(out)


def test_round_trip(spark):
    rows = pages()
    got = warc.round_trip(spark.createDataFrame(rows, PAGES).repartition(3))
    assert sorted(tuple(r) for r in got.collect()) == want(rows)
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_predicates_and_skipped_payloads(spark, tmp_path, compression):
    rows = pages()
    path = f"file://{tmp_path}/w"
    warc.register(spark)
    d = spark.createDataFrame(rows, PAGES).select(F.concat(F.lit("<urn:row:"), "page_id", F.lit(">")).alias("record_id"), F.lit("response").alias("record_type"), F.col("url").alias("target_uri"), F.encode("html", "utf-8").alias("payload"))
    d.repartition(2).write.format("warc").option("compression", compression).option("file_bytes", 20_000).mode("append").save(path)
    full = warc.read(spark, path, split_bytes=1_000)
    assert full.rdd.getNumPartitions() > 2
    assert full.where("record_type = 'warcinfo'").count() >= 2
    one = full.where("record_id = '<urn:row:7>'").collect()
    assert [bytes(r.payload).decode() for r in one] == [rows[7][2]]
    heads = warc.read(spark, path, "record_id string, record_type string").where("record_type IN ('response')")
    assert heads.count() == len(rows) and "payload" not in heads.columns
    if compression == "gzip":  # any gzip reader can read the members
        import glob

        plain = b"".join(gzip.open(f).read() for f in glob.glob(f"{tmp_path}/w/*.gz"))
        assert plain.count(b"WARC-Type: response") == len(rows)


def test_members_without_lengths_and_bad_files():
    records = [warc.encode({"record_id": f"<{k}>", "record_type": "response"}, b"p" * (10_000 * k)) for k in range(4)]
    data = b"".join(gzip.compress(r) for r in records)
    read = lambda d, ok=lambda c: True, body=True: [(c["record_id"], p and len(p)) for c, p in warc.records(io.BytesIO(d), ok, body)]
    assert read(data) == read(b"".join(records)) == [(f"<{k}>", 10_000 * k or b"") for k in range(4)]
    assert read(data, lambda c: c["record_id"] == "<2>") == [("<2>", 20_000)]
    assert read(data, body=False) == [(f"<{k}>", None) for k in range(4)]
    with pytest.raises(ValueError):
        read(b"".join(records)[:-11_000])
    with pytest.raises(ValueError):
        read(b"nonsense\r\n")


def test_odd_ids_clashing_columns_and_empty_tables(spark, monkeypatch):
    odd = spark.createDataFrame([("a\r\nb>", "u", "x" * 1500, 1), ("ü %20+", "u", "x" * 1500, 2), (None, "u", "small", 3)], "page_id string, url string, html string, digest int").withColumn("payload", F.lit("own")).withColumn("head", F.lit(1))
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(odd).collect()}
    assert got == {"ü %20+": (1500, "response", None), "a\r\nb>": (1500, "revisit", "ü %20+"), None: (5, "response", None)}
    assert warc.round_trip(odd.limit(0)).count() == 0
    df = spark.createDataFrame(pages(), PAGES)
    want = sorted(map(str, warc.round_trip(df).collect()))
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", 0)
    assert sorted(map(str, warc.round_trip(df).collect())) == want


def test_a_member_too_long_to_tell_its_length_is_inflated(monkeypatch):
    monkeypatch.setattr(warc, "MOST_SKIPPED", 500)
    records = [warc.encode({"record_id": f"<{k}>", "record_type": "response"}, bytes(range(256)) * n) for k, n in enumerate([0, 9, 0, 20])]
    got = warc.records(io.BytesIO(b"".join(warc.member(r) for r in records)), lambda c: True, False)
    assert [c["record_id"] for c, _ in got] == ["<0>", "<1>", "<2>", "<3>"]


def search(spark, x, ids, k=5, kind="float", **options):
    df = spark.createDataFrame(list(zip(ids, x, strict=True)), f"vec_id long, embedding array<{kind}>")
    return ann.nearest(df, F.col("vec_id") % 4 == 0, k=k, **options).orderBy("query_id", "rank").collect()


@pytest.mark.parametrize("hashes", [1, 2])
def test_recall_and_exact_scores(spark, hashes):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 24))
    x = centres[rng.integers(0, 20, 800)] + 0.4 * rng.normal(size=(800, 24))
    x *= rng.uniform(0.5, 2, (800, 1))  # norms differ
    got = search(spark, x.tolist(), range(800), kind="double", hashes=hashes, probes=16 * hashes)
    hit = total = 0
    for q in range(0, 800, 4):
        s = x @ x[q]
        s[q] = -np.inf
        best = set(np.lexsort((np.arange(800), -s))[:5])
        own = [r for r in got if r.query_id == q]
        assert [r.rank for r in own] == list(range(1, len(own) + 1))
        assert all(abs(r.score - float(x[q] @ x[r.vec_id])) < 1e-9 for r in own)
        hit += len(best & {r.vec_id for r in own})
        total += 5
    assert hit / total >= 0.9


def test_ties_copies_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 3)
    same = [1.0, 0.0, 0.0]
    x = [same] * 30 + [[0.0, 1.0, 0.0], None, [0.0, 0.0, 0.0], [float("nan"), 1.0, 1.0], [None, 1.0, 1.0], [float("inf"), 0.0, 0.0], [1.0, 2.0], []]
    got = search(spark, x, range(len(x)), k=4)
    for q in range(0, 28, 4):
        near = [v for v in range(30) if v != q][:4]
        assert [r.vec_id for r in got if r.query_id == q] == near
    assert {r.query_id for r in got} <= set(range(0, 31, 4))
    assert search(spark, [], []) == [] and search(spark, [[0.0]], [0]) == []
    assert search(spark, [same], [4]) == []


def brute(x, k):
    """query -> its neighbours among all rows, by inner product and then id."""
    x = np.asarray(x, dtype=np.float64)
    out = {}
    for q in range(0, len(x), 4):
        s = x @ x[q]
        out[q] = [int(v) for v in np.lexsort((np.arange(len(x)), -s)) if v != q][:k]
    return out


def by_query(rows, n):
    return {q: [r.vec_id for r in rows if r.query_id == q] for q in range(0, n, 4)}


@pytest.mark.parametrize("skew", ["one long vector", "lognormal norms", "256 dimensions"])
def test_all_neighbours_of_skewed_and_long_vectors(spark, monkeypatch, skew):
    monkeypatch.setattr(ann, "QUERY_BYTES", 20_000)  # several passes
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 256 if skew == "256 dimensions" else 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if skew == "one long vector":
        x[5] *= 100
    if skew == "lognormal norms":
        x *= rng.lognormal(size=(600, 1))
    got = search(spark, x.tolist(), range(600), k=20, kind="double")
    assert by_query(got, 600) == brute(x, 20)


@pytest.mark.parametrize("rows", [15, 21, 100])
def test_few_rows_give_the_full_count(spark, rows):
    x = np.random.default_rng(rows).normal(size=(rows, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = search(spark, x.tolist(), range(rows), k=20, kind="double")
    assert by_query(got, rows) == brute(x, 20)


def measured(spark, tmp_path, x, k=20, every=20, **options):
    """Recall of ``nearest`` against all inner products, and the least number of rows of a query."""
    x = np.asarray(x, np.float32)
    path = str(tmp_path / "vectors.parquet")
    pq.write_table(pa.table({"vec_id": pa.array(np.arange(len(x))), "embedding": pa.array(list(x), pa.list_(pa.float32()))}), path)
    got = ann.nearest(spark.read.parquet(path), F.col("vec_id") % every == 0, k=k, **options).toPandas()
    x = x.astype(np.float64)
    hit = total = 0
    least = k
    for q, own in ((q, got[got.query_id == q]) for q in range(0, len(x), every)):
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(len(x)), -s))[:k]
        hit, total, least = hit + len(set(best.tolist()) & set(own.vec_id)), total + len(best), min(least, len(own))
        assert np.allclose(own.score, s[own.vec_id.to_numpy()], rtol=1e-12)
    return hit / total, least


@pytest.mark.parametrize("shape", ["unit", "unequal norms", "clusters", "pairs of axes"])
def test_fitted_probes_reach_the_recall(spark, tmp_path, shape):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2000, 32))
    if shape == "unit":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    if shape == "unequal norms":
        x *= rng.lognormal(0, 0.3, size=(2000, 1))
    if shape == "clusters":
        x = x[rng.integers(0, 30, 2000)] + 0.3 * x
    recall, least = measured(spark, tmp_path, x, **({"hashes": 2} if shape == "pairs of axes" else {}))
    assert recall >= 0.9 and least == 20


def test_hot_cells_are_cut_and_short_queries_completed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ann, "WHOLE", 50)
    monkeypatch.setattr(ann, "GROUP_BYTES", 8 * 16 * 60)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 16))
    x[::3] = x[0] + 1e-3 * rng.normal(size=(200, 16))  # a third of all rows in one cell
    recall, least = measured(spark, tmp_path, x, every=5)
    assert recall >= 0.9 and least == 20
    recall, least = measured(spark, tmp_path, x, every=5, probes=1, tables=1)  # hashing leaves most of them short
    assert least == 20


def test_lengths_are_searched_apart(spark):
    x = [[1.0, 0.0], [0.5, 1.0], [2.0, 2.0, 2.0], [1.0, 1.0, 0.0], [3.0, 0.0], [0.0, 0.0, 1.0], [1.0, 1.0], [1.0], [5.0, 0.0, 0.0]]
    got = search(spark, x, range(9), k=3)
    assert [(r.query_id, r.vec_id, r.score) for r in got] == [(0, 4, 3.0), (0, 6, 1.0), (0, 1, 0.5), (4, 0, 3.0), (4, 6, 3.0), (4, 1, 1.5), (8, 2, 10.0), (8, 3, 5.0), (8, 5, 0.0)]
    with pytest.raises(ValueError):
        search(spark, [[1.0] * k for k in range(1, 67)], range(66))
    clash = spark.createDataFrame([(0, [1.0], "a", 1), (1, [2.0], "b", 2)], "vec_id long, embedding array<float>, score string, rank int")
    assert [tuple(r) for r in ann.nearest(clash, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2.0)]


def test_rows_of_the_largest_page_id_are_all_responses(spark):
    body = "x" * 2_000
    got = warc.round_trip(spark.createDataFrame([(3, "u", body), (3, "u", body), (1, "u", body), (2, "v", "short"), (2, "v", "short")], "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got if r.page_id != 1) == [(2, "response", None)] * 2 + [(3, "response", None)] * 2
    assert [(r.record_type, r.refers_to) for r in got if r.page_id == 1] == [("revisit", 3)]


def test_branches_of_one_archive_keep_their_own_predicates(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_pages(spark.createDataFrame([(k, "u", "x" * 2000 if k % 2 else str(k)) for k in range(10)], PAGES), path)
    of = lambda df, kind: df.where(f"record_type = '{kind}'").select("record_id")
    for one in (warc.read(spark, path), warc.read(spark, path, only={"record_type": ["response", "revisit"]}), warc.round_trip(spark.createDataFrame([(k, "u", "x" * 2000 if k % 2 else str(k)) for k in range(10)], PAGES)).withColumnRenamed("page_id", "record_id")):
        both = of(one, "response").union(of(one, "revisit"))
        assert (both.count(), both.distinct().count()) == (10, 10)
    pushed = warc.read(spark, path, pushdown=True).where("record_type = 'revisit'")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert pushed.count() == 4 and "= revisit" not in plan(pushed) and "= revisit" in plan(of(one, "revisit"))
    assert warc.read(spark, path, only={"record_type": ["revisit"], "target_uri": ["u"]}).count() == 4
    with pytest.raises(ValueError):
        warc.read(spark, path, only={"nothing": ["x"]})
