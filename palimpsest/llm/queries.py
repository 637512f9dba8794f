"""The thin queries over the test tables, one for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, fim, importance, linededup, mix, neardup, quality, secrets, shard, substrings, toxicity, warc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _labelled(spark: SparkSession, sf_dir: str, column: str, parts: int, held_out: int) -> DataFrame:
    """doc_id and label of the rows that a model may learn from."""
    labels = _read(spark, sf_dir, "labels").select("doc_id", F.col(column).alias("label"))
    return labels.where(quality.remainder(F.col("doc_id"), parts) != held_out)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document, learnt from positives and unlabelled text."""
    docs = _read(spark, sf_dir, "documents")
    model = quality.train(docs, _labelled(spark, sf_dir, "quality", 5, 0))
    scored = quality.score_documents(docs, model, keep=["doc_id"])
    held_out = quality.remainder(F.col("doc_id"), 5) == 0
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that are on five sources or more."""
    out = linededup.remove_boilerplate(_read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, slot and shard of every document, by its doc_id."""
    return shard.assign_shards(_read(spark, sf_dir, "documents").select("doc_id"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 85 % of their 3-word shingles."""
    return neardup.near_duplicates(_read(spark, sf_dir, "documents"), shingle=3, percent=85)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document judged against the whole benchmark."""
    out = decontaminate.mark_contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), "items_sha256", "contaminated")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document, with its offending spans in code points."""
    docs = _read(spark, sf_dir, "documents")
    field = toxicity.train(docs, _labelled(spark, sf_dir, "toxic", 3, 1))
    scored = toxicity.score_documents(docs, field, keep=["doc_id"])
    held_out = quality.remainder(F.col("doc_id"), 3) == 1
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "spans")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of archives written from all pages."""
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of secrets in every document."""
    out = secrets.find_secrets(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secret_spans", lambda s: s["name"].isin(*secrets.BASE))
    count = lambda k: F.size(F.filter("secret_spans", lambda s: s["name"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *(count(k) for k in secrets.BASE), F.sha2(secrets.digest(base).cast("binary"), 256).alias("base_sha256"), secrets.digest(F.col("secret_spans")).alias("spans"), secrets.link_digest(F.col("secret_links")).alias("links"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mix.Mix(_read(spark, sf_dir, "documents")).taken()


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth."""
    return ann.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of 35 words that start anywhere else."""
    return substrings.mark_repeats(_read(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", "n_words", "n_removed", "kept_sha256", "spans")


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents, drawn towards the benchmark."""
    return importance.rank_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), keep=["doc_id"])


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document rearranged to fill in its middle, and restored."""
    out = fim.restore(fim.rearrange(_read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_linededup, op3_sharding, op4_minhash, op5_decontamination, op6_toxicity, op7_warc, op8_secrets, op9_mixing, op10_ann, op11_substrings, op12_importance, op13_fim)}


def _op3_sql() -> str:
    table = "".join(f"{x:02x}" for x in shard.fill([f"shard-{k:05d}" for k in range(shard.SHARDS)]))
    return f"""
    WITH placed AS (SELECT doc_id, cast(cast('0x' || substr(md5(coalesce(cast(doc_id AS varchar), '')), 1, 15) AS bigint) % {shard.SLOTS} AS integer) AS slot FROM documents)
    SELECT doc_id, slot, cast('0x' || substr('{table}', 2 * slot + 1, 2) AS integer) AS shard FROM placed
    """


_OP5_SQL = r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l FROM documents),
    b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l FROM benchmark),
    bw AS (SELECT DISTINCT item_id, least(13, len(l)) AS n, array_to_string(l[p : p + least(13, len(l)) - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(l) - least(13, len(l)) + 2)) AS p FROM b WHERE len(l) > 0)),
    dw AS (SELECT doc_id, n, p, array_to_string(l[p : p + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(l) - n + 2)) AS p FROM w, (SELECT DISTINCT n FROM bw) WHERE len(l) >= n)),
    hit AS (SELECT doc_id, dw.n, p, item_id FROM dw JOIN bw USING (n, g)),
    pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
    ids AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS h FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS i FROM hit) GROUP BY doc_id)
    SELECT w.doc_id, cast(len(l) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(h, sha256('')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(l) AS contaminated
    FROM w LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

_OP2_SQL = r"""
    WITH l AS (SELECT doc_id, source, coalesce(text, '') = '' AND text IS NULL AS none, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents),
    k AS (SELECT *, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS bare FROM l),
    b AS (SELECT bare FROM k WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT source) >= 5),
    d AS (SELECT doc_id, count(*) AS n_lines, count(b.bare) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (b.bare IS NULL), '') AS t FROM k LEFT JOIN b USING (bare) GROUP BY doc_id)
    SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN text IS NOT NULL THEN sha256(t) END AS text_sha256 FROM documents LEFT JOIN d USING (doc_id)
"""


def _op8_sql() -> str:
    """Matches with the lengths between them, positions as running sums, and links by distance."""
    quoted = lambda p: p.replace("'", "''")
    each, fits = [], []
    for k, (name, pattern, full) in enumerate(secrets.PATTERNS):
        each.append(f"SELECT doc_id, {k} AS kind, '{name}' AS name, unnest(list_zip(regexp_split_to_array(t, '{quoted(pattern)}')[:-2], regexp_extract_all(t, '{quoted(pattern)}'))) AS z, generate_subscripts(regexp_extract_all(t, '{quoted(pattern)}'), 1) AS i FROM d")
        if full:
            fits.append(f"(kind <> {k} OR regexp_matches(z[2], '{quoted(full)}'))")
    within = lambda a, b: f"{b}.doc_id = {a}.doc_id AND {a}.start <= {b}.stop + {secrets.REACH} AND {a}.stop >= {b}.start - {secrets.REACH}"
    near = lambda a, kinds: f"EXISTS (SELECT 1 FROM p q WHERE {within(a, 'q')} AND q.name IN {kinds})"
    closest = lambda b: f"row_number() OVER (PARTITION BY a.doc_id, a.start, a.kind ORDER BY greatest(0, {b}.start - a.stop, a.start - {b}.stop), {b}.start, {b}.kind) = 1"
    span = lambda a: f"{a}.name || ':' || {a}.start || ':' || {a}.stop"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    m AS ({' UNION ALL '.join(each)}),
    s AS (SELECT *, sum(length(z[1]) + length(z[2])) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM m),
    p AS (SELECT doc_id, kind, name, cast(stop - length(z[2]) AS bigint) AS start, cast(stop AS bigint) AS stop FROM s
          WHERE {' AND '.join(fits)} AND (name <> 'secret' OR (regexp_matches(z[2], '[A-Z]') AND regexp_matches(z[2], '[a-z]') AND regexp_matches(z[2], '[0-9]')))),
    r AS (SELECT * FROM p WHERE name IN {secrets.BASE} OR (name = 'secret' AND {near('p', secrets.IDS)}) OR (name = 'id' AND {near('p', secrets.SECRETS)}) OR (name = 'endpoint' AND {near('p', secrets.IDS)} AND {near('p', secrets.SECRETS)})),
    g AS (SELECT doc_id, count(*) FILTER (name = 'assign') AS n_assign, count(*) FILTER (name = 'access') AS n_access, count(*) FILTER (name = 'hex') AS n_hex,
          string_agg({span('r')}, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg({span('r')}, ',' ORDER BY start, kind) AS spans FROM r GROUP BY doc_id),
    i AS (SELECT a.*, {span('b')} AS own FROM p a JOIN p b ON {within('a', 'b')} WHERE a.name IN {secrets.SECRETS} AND b.name IN {secrets.IDS} QUALIFY {closest('b')}),
    e AS (SELECT a.*, {span('b')} AS own FROM p a JOIN r b ON {within('a', 'b')} WHERE a.name IN {secrets.SECRETS} AND b.name = 'endpoint' QUALIFY {closest('b')}),
    l AS (SELECT i.doc_id, string_agg({span('i')} || '+' || i.own || coalesce('+' || e.own, ''), ',' ORDER BY i.start, i.kind) AS links FROM i LEFT JOIN e USING (doc_id, start, kind) GROUP BY i.doc_id)
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(links, '') AS links
    FROM d LEFT JOIN g USING (doc_id) LEFT JOIN l USING (doc_id)
    """


_OP7_SQL = """
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
    q AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS d FROM p),
    r AS (SELECT *, max(page_id) OVER (PARTITION BY d, n) AS head FROM q)
    SELECT page_id, cast(n AS bigint) AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND page_id <> head THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN n >= 1000 AND page_id <> head THEN head END AS refers_to FROM r
"""

_OP4_SQL = r"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents),
    s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 3 THEN [array_to_string(l, ' ')] ELSE list_transform(range(1, len(l) - 1), lambda i: array_to_string(l[i : i + 2], ' ')) END) AS g FROM w)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
    e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * i >= 85 * (x.n + y.n - i)),
    d AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    c AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT d.b, c.root FROM c JOIN d ON c.doc_id = d.a),
    m AS (SELECT doc_id, min(root) AS component_id FROM c GROUP BY doc_id)
    SELECT m.doc_id, coalesce(n, 0) AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""

_OP11_SQL = r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents),
    g AS (SELECT doc_id, p, md5_number(array_to_string(l[p : p + 34], ' ')) AS g FROM (SELECT *, unnest(range(1, len(l) - 33)) AS p FROM w)),
    r AS (SELECT doc_id, p FROM g JOIN (SELECT g FROM g GROUP BY g HAVING count(*) > 1) USING (g)),
    c AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM r),
    s AS (SELECT doc_id, p, sum(CASE WHEN before + 35 >= p THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM c),
    m AS (SELECT doc_id, min(p) - 1 AS a, max(p) + 34 AS b FROM s GROUP BY doc_id, k),
    d AS (SELECT doc_id, list([a, b] ORDER BY a) AS spans FROM m GROUP BY doc_id),
    e AS (SELECT w.doc_id, l, coalesce(spans, []) AS spans FROM w LEFT JOIN d USING (doc_id)),
    f AS (SELECT *, flatten(list_transform(range(len(spans) + 1), lambda k: l[CASE WHEN k = 0 THEN 1 ELSE spans[k][2] + 1 END : CASE WHEN k = len(spans) THEN len(l) ELSE spans[k + 1][1] END])) AS kept FROM e)
    SELECT doc_id, cast(len(l) AS bigint) AS n_words, cast(len(l) - len(kept) AS bigint) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256, spans FROM f
"""

_OP12_SQL = r"""
    WITH RECURSIVE bits AS (SELECT range AS v, range AS c, 0 AS k FROM range(256) UNION ALL SELECT v, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
    crc AS (SELECT list(c ORDER BY v) AS crc FROM bits WHERE k = 8),
    t AS (SELECT 'd' AS side, doc_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 'b', NULL, coalesce(text, '') FROM benchmark),
    w AS (SELECT row_number() OVER () AS r, side, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l FROM t),
    f AS (SELECT r, side, unnest(list_concat(l, list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1]))) AS g FROM w),
    h AS (SELECT g, hex(encode(g)) AS x FROM (SELECT DISTINCT g FROM f)),
    k AS (SELECT g, xor(4294967295, list_reduce(list_prepend(cast(4294967295 AS bigint), list_transform(range(length(x) // 2), lambda i: cast('0x' || substr(x, cast(2 * i + 1 AS bigint), 2) AS bigint))), lambda c, b: xor(c >> 8, crc[xor(c, b) % 256 + 1]))) % 10000 AS b FROM h, crc),
    n AS (SELECT b, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM f JOIN k USING (g) GROUP BY b),
    a AS (SELECT b, cast(floor(1000 * ln(cast(t + 1 AS double) * (cast(sum(s) OVER () AS double) + 10000) / (cast(s + 1 AS double) * (cast(sum(t) OVER () AS double) + 10000)))) AS bigint) AS gain FROM n),
    m AS (SELECT r, count(*) AS n_features, cast(sum(gain) AS bigint) AS total FROM f JOIN k USING (g) JOIN a USING (b) WHERE side = 'd' GROUP BY r),
    v AS (SELECT doc_id, len(l) AS words, coalesce(n_features, 0) AS n_features, coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS weight, cast('0x' || substr(sha256('7:' || coalesce(cast(doc_id AS varchar), '')), 1, 8) AS bigint) AS h FROM w LEFT JOIN m USING (r) WHERE side = 'd'),
    z AS (SELECT *, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double))) AS bigint) AS score FROM v),
    o AS (SELECT *, CASE WHEN words >= 20 THEN row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) END AS place, count(*) FILTER (words >= 20) OVER () AS eligible FROM z)
    SELECT doc_id, cast(n_features AS bigint) AS n_features, cast(weight AS bigint) AS weight, cast(score AS bigint) AS score, CASE WHEN place <= 25 * eligible // 100 THEN place END AS rank FROM o
"""

_OP13_SQL = r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(cast(doc_id AS varchar), '')) AS x FROM documents),
    h AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS l, list_transform([1, 9, 17, 25], lambda k: cast('0x' || substr(x, k, 8) AS bigint)) AS h FROM d),
    c AS (SELECT *, least(h[1] % (len(l) + 1), h[2] % (len(l) + 1)) AS a, greatest(h[1] % (len(l) + 1), h[2] % (len(l) + 1)) AS b,
          CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
    p AS (SELECT *, coalesce(array_to_string(l[1 : a], ''), '') AS pre, coalesce(array_to_string(l[a + 1 : b], ''), '') AS mid, coalesce(array_to_string(l[b + 1 :], ''), '') AS suf FROM c)
    SELECT doc_id, cast(len(l) AS bigint) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""

ORACLES = {"op11_substrings": _OP11_SQL, "op12_importance": _OP12_SQL, "op13_fim": _OP13_SQL, "op4_minhash": _OP4_SQL, "op7_warc": _OP7_SQL, "op2_linededup": _OP2_SQL, "op8_secrets": _op8_sql(), "op3_sharding": _op3_sql(), "op5_decontamination": _OP5_SQL}
