"""The registered queries over the layers, each with SQL for the same rows.

A query's id is that of its operator in the inventory; every one runs over its whole table.
Scores are rounded to nine digits, as engines differ in the order of sums.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import messages
from .functions import text as tx
from .functions import vectors as vec
from .operators import answers, extract, fulltext, joins, query, resolve, schedule, search, store, transcript, triggers, upkeep
from .plans import host, offload, views
from .plans.views import BLANK_SQL, L0_SQL, L1_SQL, TRANSCRIPT_SQL, read, strip_sql
from .sources import export, files, logs, logsource
from .streaming import capture

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The question and the vector that search queries ask.
ASKED = "the thing erly on"
_TERMS_SQL = "regexp_extract_all(translate(lower({}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[\\p{{L}}\\p{{N}}]+')"


def register(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


# ---- filters, counts, pages


@register(f"WITH {L1_SQL} SELECT record_id, type, updated_time FROM l1 WHERE session_key = 'en' AND session_id = 'en-3' AND updated_time > '1970-01-01T02:00:00.000Z'")
def flt01_l1_filter(spark, sf):
    return query.l1_filter(views.l1(spark, sf), "en", "en-3", "1970-01-01T02:00:00.000Z").select("record_id", "type", "updated_time")


@register(f"WITH {L0_SQL} SELECT record_id, recorded_at FROM l0 WHERE session_key = '7' ORDER BY recorded_at DESC, record_id DESC LIMIT 50")
def flt02_l0_newest(spark, sf):
    return query.newest(views.l0(spark, sf), "7", 50).select("record_id", "recorded_at")


@register(f"WITH {L0_SQL} SELECT record_id, recorded_at FROM l0 WHERE session_key = '7' AND timestamp > 7001000 ORDER BY recorded_at DESC, record_id DESC LIMIT 50")
def flt03_l0_after_cursor(spark, sf):
    return query.after_cursor(views.l0(spark, sf), "7", 7_001_000, 50).select("record_id", "recorded_at")


@register(f"WITH {L0_SQL} SELECT record_id FROM l0 WHERE session_key = '9' ORDER BY recorded_at DESC, record_id DESC LIMIT 50")
def flt04_cursor_dispatch(spark, sf):
    return query.after_cursor(views.l0(spark, sf), "9", None, 50).select("record_id")


@register("SELECT event_id, event_type, value FROM events WHERE value >= 10.5 AND event_type <> 'click' AND user_id < 500")
def flt09_where(spark, sf):
    return query.where(read(spark, sf, "events"), "value>=10.5, eventType!=click, userId<500").select("event_id", "event_type", "value")


@register(f"WITH {L0_SQL} SELECT record_id, timestamp FROM l0 WHERE timestamp >= 3000000 AND timestamp <= 9000000")
def flt10_time_range(spark, sf):
    return query.time_range(views.l0(spark, sf), "timestamp", 3_000_000, 9_000_000).select("record_id", "timestamp")


@register(f"WITH {L0_SQL} SELECT record_id FROM l0 WHERE role IN ('user', 'assistant') AND {strip_sql('message_text')} <> ''")
def flt13_user_assistant(spark, sf):
    return views.l0(spark, sf).where(F.col("role").isin("user", "assistant") & (tx.strip(F.col("message_text")) != "")).select("record_id")


_T = strip_sql("message_text")


@register(f"WITH {L0_SQL} SELECT record_id, strlen({_T}) >= 3 AND NOT starts_with({_T}, '/') AND NOT starts_with({_T}, '!') AND NOT contains({_T}, 'HEARTBEAT') AND NOT contains({_T}, 'heartbeat') AS ok FROM l0")
def flt14_capture_gate(spark, sf):
    return views.l0(spark, sf).select("record_id", tx.should_capture(F.col("message_text")).alias("ok"))


_L0_GATE = f"{_T} <> '' AND NOT starts_with(message_text, '/') AND {_T} NOT IN ('(session bootstrap)', 'NO_REPLY') AND NOT starts_with({_T}, 'A new session was started via') AND NOT starts_with({_T}, '✅ New session started') AND NOT starts_with({_T}, 'Pre-compaction memory flush')"


@register(f"WITH {L0_SQL} SELECT record_id, {_L0_GATE} AS ok FROM l0")
def flt15_l0_gate(spark, sf):
    return views.l0(spark, sf).select("record_id", tx.should_capture_l0(F.col("message_text")).alias("ok"))


def _injection_sql(x: str) -> str:
    low = f"lower({strip_sql(f'regexp_replace({x}, $$[{BLANK_SQL}]+$$, $$ $$, $$g$$)')})"
    has = lambda p: f"contains({low}, '{p}')"
    any_ = lambda ps: "(" + " OR ".join(map(has, ps)) + ")"
    parts = [f"({has(v)} AND {any_(n)})" for v, n in tx.INJECTION_PAIRS.items()]
    return "(" + " OR ".join([*parts, f"({has('system prompt')} AND {any_(tx.PROMPT_VERBS)})", any_(tx.INJECTION_PHRASES), any_(tx.INJECTION_TAGS)]) + ")"


_L1_GATE = f"({_L0_GATE}) AND NOT (length(message_text) <= 5 AND regexp_full_match(message_text, '[^\\p{{L}}\\p{{N}}{BLANK_SQL}]*')) AND NOT regexp_full_match(message_text, '[?？]*') AND NOT {_injection_sql('message_text')}"


@register(f"WITH {L0_SQL} SELECT record_id, {_L1_GATE} AS ok FROM l0")
def flt16_l1_gate(spark, sf):
    return views.l0(spark, sf).select("record_id", tx.should_extract_l1(F.col("message_text")).alias("ok"))


@register(f"SELECT doc_id, {_injection_sql('text')} AS injection FROM documents")
def flt17_injection(spark, sf):
    return read(spark, sf, "documents").select("doc_id", tx.looks_like_injection(F.col("text")).alias("injection"))


@register(f"WITH {L0_SQL} SELECT session_key, sum(strlen({_T})) >= 10 AS ok FROM l0 GROUP BY session_key")
def flt18_batch_gate(spark, sf):
    size = F.sum(F.octet_length(tx.strip(F.col("message_text"))))
    return views.l0(spark, sf).groupBy("session_key").agg(tx.enough_text(size).alias("ok"))


_KEY = "CASE page_id % 5 WHEN 0 THEN 'temp:' || url WHEN 1 THEN 'a:subagent:' || page_id ELSE url END"


@register(f"SELECT page_id, contains(k, ':memory-scene-extract-') OR contains(k, ':subagent:') OR starts_with(k, 'temp:') OR regexp_matches(k, '(?s)example.*en/') AS skip FROM (SELECT page_id, {_KEY} AS k FROM pages)")
def flt19_session_filter(spark, sf):
    key = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("temp:"), "url")).when(F.col("page_id") % 5 == 1, F.concat(F.lit("a:subagent:"), "page_id")).otherwise(F.col("url"))
    return read(spark, sf, "pages").select("page_id", tx.skip_session(key, ("example*en/",)).alias("skip"))


@register("SELECT doc_id, ['episodic', 'instruction', 'persona', 'persona', NULL][doc_id % 5 + 1] AS kind FROM documents")
def flt24_type_alias(spark, sf):
    given = F.get(F.array(*(F.lit(x) for x in ("episode", "instruct", "preference", "persona", "other"))), F.pmod("doc_id", F.lit(5)).cast("int"))
    return read(spark, sf, "documents").select("doc_id", extract.valid_type(given).alias("kind"))


@register(f"WITH {L0_SQL} SELECT record_id AS \"recordId\", session_key AS \"sessionKey\", session_id AS \"sessionId\", role, message_text AS content, recorded_at AS \"recordedAt\", timestamp FROM l0")
def prj01_api_rows(spark, sf):
    return query.api_l0(views.l0(spark, sf))


@register(f"WITH {L1_SQL} SELECT record_id, content, type, timestamp_start AS created_at, timestamp_end AS updated_at FROM l1")
def prj02_hit_projection(spark, sf):
    return views.l1(spark, sf).select("record_id", "content", "type", F.col("timestamp_start").alias("created_at"), F.col("timestamp_end").alias("updated_at"))


@register(f"WITH {L0_SQL}, {L1_SQL} SELECT 'l0' AS layer, count(*) AS n, count(DISTINCT session_key) AS sessions FROM l0 UNION ALL SELECT 'l1', count(*), count(DISTINCT session_key) FROM l1")
def agg01_counts(spark, sf):
    return query.status(views.l0(spark, sf), views.l1(spark, sf))


_CUTOFF = "timestamp '1995-06-01'"


@register(f"SELECT total, expired, total > 50 AND expired > 0 AND NOT expired * 10 > total * 8 AS allowed FROM (SELECT count(*) AS total, count(*) FILTER (o_orderdate < {_CUTOFF}) AS expired FROM orders)")
def agg02_retention_guard(spark, sf):
    return store.retention_guard(read(spark, sf, "orders"), "o_orderdate", F.expr(_CUTOFF), store.L0_RETENTION)


@register("SELECT count(*) AS n FROM events WHERE event_type = 'purchase' AND value > 20")
def agg03_filtered_count(spark, sf):
    return query.where(read(spark, sf, "events"), "eventType=purchase,value>20").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT role, count(*) AS n FROM conversations GROUP BY role")
def agg04_group_role(spark, sf):
    return query.counts(views.l0(spark, sf), "role")


@register(f"WITH {L0_SQL}, {L1_SQL} SELECT 'l0' AS layer, role AS key, count(*) AS n FROM l0 GROUP BY role UNION ALL SELECT 'l1', type, count(*) FROM l1 GROUP BY type UNION ALL SELECT 'l2', 'scenes', count(DISTINCT scene_name) FROM l1 UNION ALL SELECT 'l2', 'heat', count(*) FROM l1")
def agg05_overview(spark, sf):
    facts = views.l1(spark, sf)
    scenes = facts.groupBy("scene_name").agg(F.count(F.lit(1)).alias("heat"))
    return query.overview(views.l0(spark, sf), facts, scenes)


@register("""WITH a AS (SELECT c_custkey AS record_id, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS pos FROM customer QUALIFY pos < 200),
    b AS (SELECT c_custkey AS record_id, row_number() OVER (ORDER BY c_name DESC, c_custkey) - 1 AS pos FROM customer QUALIFY pos < 1000)
    SELECT record_id, round(sum(1.0::double / (60 + pos + 1)), 9) AS rrf FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY record_id""")
def agg06_rrf(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("record_id"), "c_acctbal", "c_name")
    a = search.positions(c.orderBy(F.desc("c_acctbal"), "record_id").limit(200), F.desc("c_acctbal"), F.col("record_id"))
    b = search.positions(c.orderBy(F.desc("c_name"), "record_id").limit(1000), F.desc("c_name"), F.col("record_id"))
    return search.fuse([a, b]).select("record_id", F.round("rrf", 9).alias("rrf"))


@register(f"WITH {L0_SQL} SELECT session_key, max(timestamp) AS cursor, max(recorded_at) AS recorded_at FROM l0 GROUP BY session_key")
def agg07_cursor_max(spark, sf):
    return views.l0(spark, sf).groupBy("session_key").agg(F.max("timestamp").alias("cursor"), F.max("recorded_at").alias("recorded_at"))


@register(f"WITH {L1_SQL} SELECT record_id, least(timestamp_start, timestamp_end) AS first, greatest(timestamp_start, timestamp_end) AS last FROM l1")
def agg08_time_trail(spark, sf):
    trail = F.array("timestamp_start", "timestamp_end")
    return views.l1(spark, sf).select("record_id", F.array_min(trail).alias("first"), F.array_max(trail).alias("last"))


@register(f"WITH {L0_SQL} SELECT session_id, min(timestamp) AS first, count(*) AS n, string_agg(record_id, ',' ORDER BY timestamp, record_id) AS ids FROM l0 GROUP BY session_id")
def agg09_sessions(spark, sf):
    return extract.by_session(views.l0(spark, sf)).select("session_id", "first", F.size("messages").cast("long").alias("n"), F.array_join(F.transform("messages", lambda m: m["record_id"]), ",").alias("ids"))


@register(f"WITH {TRANSCRIPT_SQL} SELECT session_id, cast(sum(tokens) + ceil(count(*) * 0.5) + 100 AS bigint) AS tokens FROM t GROUP BY session_id")
def agg11_transcript_tokens(spark, sf):
    return transcript.transcript_tokens(views.transcript(spark, sf), 100)


@register("SELECT doc_id, (length(text) - length(replace(text, 'the', ''))) // 3 AS n FROM documents")
def agg14_substring_counts(spark, sf):
    return read(spark, sf, "documents").select("doc_id", (F.size(F.split("text", "the")) - 1).cast("long").alias("n"))


@register(f"WITH {L0_SQL} SELECT count(*) AS n_docs, round(avg(len({_TERMS_SQL.format('message_text')})), 9) AS mean_length FROM l0")
def agg16_corpus_stats(spark, sf):
    return views.l0(spark, sf).agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.avg(F.size(tx.terms(F.col("message_text")))), 9).alias("mean_length"))


@register("SELECT user_id, string_agg(event_type, ' ' ORDER BY event_id) AS line FROM events GROUP BY user_id")
def agg17_listagg(spark, sf):
    return read(spark, sf, "events").groupBy("user_id").agg(F.expr("listagg(event_type, ' ') within group (order by event_id)").alias("line"))


# ---- ranks, windows, transcripts


def _bm25_sql(docs: str, text: str, k: int) -> str:
    terms = tx.query_terms(ASKED)
    arr = "[" + ", ".join(f"'{t}'" for t in terms) + "]"
    return f"""w AS (SELECT record_id, {_TERMS_SQL.format(text)} AS l FROM {docs}),
    s AS (SELECT count(*) AS n, avg(len(l)) AS mean FROM w),
    q AS (SELECT unnest({arr}) AS term),
    df AS (SELECT term, count(*) AS df FROM w, q WHERE list_contains(l, term) GROUP BY term),
    r AS (SELECT record_id, -sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * len(list_filter(l, lambda x: x = term)) * 2.2 / (len(list_filter(l, lambda x: x = term)) + 1.2 * (0.25 + 0.75 * len(l) / mean))) AS rank
          FROM w, df, s WHERE list_contains(l, term) GROUP BY record_id),
    bm AS (SELECT *, -rank / (1 - rank) AS score FROM r ORDER BY rank, record_id LIMIT {k})"""


@register(f"WITH {L1_SQL}, {_bm25_sql('l1', 'content', 10)} SELECT record_id, round(score, 9) AS score FROM bm")
def top01_bm25_l1(spark, sf):
    return search.keyword_search(views.l1(spark, sf), ASKED, 10).select("record_id", F.round("score", 9).alias("score"))


@register(f"WITH {L0_SQL}, {_bm25_sql('l0', 'message_text', 10)} SELECT record_id, round(score, 9) AS score FROM bm")
def top02_bm25_l0(spark, sf):
    return search.keyword_search(views.l0(spark, sf), ASKED, 10, text_col="message_text", score=search.score_l0).select("record_id", F.round("score", 9).alias("score"))


_KNN_SQL = """e AS (SELECT cast(vec_id AS varchar) AS record_id, cast(embedding AS double[]) AS v FROM embeddings),
    kn AS (SELECT a.record_id, 1 - list_cosine_similarity(a.v, b.v) AS distance FROM e a, e b WHERE b.record_id = '7' ORDER BY distance, a.record_id LIMIT {})"""


def _asked_vector(spark, sf) -> list[float]:
    return list(read(spark, sf, "embeddings").where("vec_id = 7").first()["embedding"])


@register(f"WITH {_KNN_SQL.format(15)} SELECT record_id, round(1 - distance, 7) AS score FROM kn")
def top03_knn(spark, sf):
    return search.vector_search(views.vectors(spark, sf), _asked_vector(spark, sf), 15).select("record_id", F.round("score", 7).alias("score"))


@register("SELECT event_id, round(CASE WHEN value - 50 < 0 THEN (50 - value) / (1 + 50 - value) ELSE 1 / (1 + value - 50) END, 9) AS score FROM events")
def top05_rank_to_score(spark, sf):
    return read(spark, sf, "events").select("event_id", F.round(search.score_l1(F.col("value") - 50), 9).alias("score"))


@register(f"SELECT conv_id, turn, array_to_string({_TERMS_SQL.format('text')}, ' ') AS terms FROM conversations")
def top07_index_terms(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", F.array_join(tx.terms(F.col("text")), " ").alias("terms"))


def _hybrid_sql(docs: str, text: str, k: int, limit: int, where: str) -> str:
    return f"""{_bm25_sql(docs, text, k)}, {_KNN_SQL.format(k)},
    ok AS (SELECT kn.* FROM kn JOIN {docs} USING (record_id)),
    ls AS (SELECT record_id, 0 AS l, row_number() OVER (ORDER BY score DESC, record_id) - 1 AS pos FROM bm UNION ALL SELECT record_id, 1, row_number() OVER (ORDER BY distance, record_id) - 1 FROM ok),
    fu AS (SELECT record_id, sum(1.0::double / (60 + pos + 1)) AS score, min(l * 1000000 + pos) AS first FROM ls GROUP BY record_id)
    SELECT record_id, round(score, 9) AS score, 'hybrid' AS strategy FROM fu JOIN {docs} USING (record_id) WHERE {where} ORDER BY fu.score DESC, first LIMIT {limit}"""


@register(f"WITH {L1_SQL}, {_hybrid_sql('l1', 'content', 30, 10, 'true')}")
def top08_memory_search(spark, sf):
    facts = views.l1(spark, sf)
    near = views.vectors(spark, sf).join(facts.select("record_id"), "record_id", "left_semi")
    found = search.search_memories(facts, ASKED, 10, near, _asked_vector(spark, sf))
    return found.select("record_id", F.round("score", 9).alias("score"), "strategy")


@register(f"WITH {L0_SQL}, {_bm25_sql('l0', 'message_text', 30)} SELECT record_id, round(score, 9) AS score, 'fts' AS strategy FROM bm ORDER BY rank, record_id LIMIT 10")
def top09_conversation_search(spark, sf):
    return search.search_conversations(views.l0(spark, sf), ASKED, 10).select("record_id", F.round("score", 9).alias("score"), "strategy")


@register(f"WITH {L1_SQL}, {_bm25_sql('l1', 'content', 10)} SELECT record_id, round(score, 9) AS score FROM bm WHERE score >= 0.3 OR ((SELECT max(score) FROM bm) < 0.3 AND (SELECT count(*) FROM bm) <= 5) ORDER BY rank, record_id LIMIT 5")
def top10_recall_keyword(spark, sf):
    return search.recall(views.l1(spark, sf), ASKED, 5, strategy="keyword").select("record_id", F.round("score", 9).alias("score"))


@register("""WITH e AS (SELECT vec_id, cast(embedding AS double[]) AS v FROM embeddings)
    SELECT cast(a.vec_id AS varchar) AS new_id, cast(b.vec_id AS varchar) AS candidate_id FROM e a, e b WHERE a.vec_id % 100 = 0 AND b.vec_id % 100 <> 0
    QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY 1 - list_cosine_similarity(a.v, b.v), cast(b.vec_id AS varchar)) <= 5""")
def top12_dedup_candidates(spark, sf):
    v = views.vectors(spark, sf)
    return search.neighbours(v.where(F.col("record_id").cast("long") % 100 == 0), v, 5).select("new_id", "candidate_id")


@register("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 20 OFFSET 40")
def top13_page(spark, sf):
    return query.page(read(spark, sf, "events"), "ts", 20, 40, tie="event_id").select("event_id", "ts")


@register("SELECT source, count(*) AS heat, row_number() OVER (ORDER BY count(*) DESC, source) AS rank FROM documents GROUP BY source")
def top14_scenes_by_heat(spark, sf):
    heat = read(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("heat"))
    return heat.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("heat"), "source")))


@register(f"""WITH {TRANSCRIPT_SQL}, u AS (SELECT *, max(pos) FILTER (role = 'user') OVER (PARTITION BY session_id) AS u FROM t)
    SELECT session_id, pos, tokens, '{transcript.TRUNCATED[0]}' || tokens || '{transcript.TRUNCATED[1]}' || role || ']' AS note FROM u WHERE pos IS DISTINCT FROM u
    QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY tokens DESC, pos DESC) = 1 AND tokens >= 100""")
def top17_largest_message(spark, sf):
    rows = views.transcript(spark, sf)
    top = transcript.largest_message(rows, 100)
    cut = transcript.truncate_largest(rows, 100).select("session_id", "pos", F.col("content").alias("note"))
    return top.join(cut, ["session_id", "pos"])


@register(f"WITH {L0_SQL} SELECT record_id, row_number() OVER (PARTITION BY session_key ORDER BY timestamp DESC, record_id DESC) AS back FROM l0 QUALIFY back <= 50")
def win02_newest50(spark, sf):
    return extract.newest_rows(views.l0(spark, sf)).select("record_id", "back")


@register(f"""WITH {L0_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY timestamp DESC, record_id DESC) AS b FROM l0 QUALIFY b <= 50),
    o AS (SELECT record_id, row_number() OVER (PARTITION BY session_key ORDER BY b) AS back FROM n WHERE {_L1_GATE})
    SELECT record_id, back, CASE WHEN back <= 10 THEN 'new' ELSE 'background' END AS part FROM o WHERE back <= 15""")
def win03_split_10_5(spark, sf):
    return extract.split_window(views.l0(spark, sf)).select("record_id", "back", "part")


@register(f"""WITH {TRANSCRIPT_SQL}, u AS (SELECT *, length(content) AS n, coalesce(sum(length(content) + 1) OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM t),
    o AS (SELECT *, 2000 - used AS room, n > 2000 - used AS over_ FROM u),
    p AS (SELECT *, coalesce(bool_or(over_) OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS after_ FROM o)
    SELECT session_id, pos, md5(CASE WHEN over_ AND n > room THEN regexp_replace(left(content, cast(room - {len(transcript.LINE_SUFFIX)} AS bigint)), '\\s+$', '') || '{transcript.LINE_SUFFIX}' ELSE content END) AS line FROM p WHERE NOT after_ AND room > 0 AND (NOT over_ OR room >= 40)""")
def win04_budget(spark, sf):
    rows = transcript.budget_lines(views.transcript(spark, sf), 2000, order="pos", line="content")
    return rows.select("session_id", "pos", F.md5("content").alias("line"))


@register(f"""WITH {TRANSCRIPT_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY pos) AS n, sum(tokens) OVER (PARTITION BY session_id ORDER BY pos) AS s, count(*) OVER (PARTITION BY session_id) AS size FROM t),
    c AS (SELECT *, max(n) FILTER (role = 'user') OVER (PARTITION BY session_id) AS u, min(n) FILTER (s >= 200) OVER (PARTITION BY session_id) AS f FROM n)
    SELECT session_id, pos, n <= greatest(0, least(coalesce(f, size), size - 2, coalesce(u - 1, size))) AS deleted FROM c""")
def win05_prefix_delete(spark, sf):
    return transcript.delete_prefix(views.transcript(spark, sf), F.lit(200)).select("session_id", "pos", "deleted")


_SCORES = "(SELECT cast(user_id AS varchar) AS session_id, event_id % 8 AS score FROM events)"


@register(f"""WITH n AS (SELECT session_id, t.t, count(*) FILTER (score >= t.t) AS n FROM {_SCORES}, (SELECT unnest(range(1, 8)) AS t) t GROUP BY ALL),
    m AS (SELECT session_id, coalesce(max(t) FILTER (n >= 10), 1) AS threshold FROM n GROUP BY session_id)
    SELECT session_id, cast(threshold AS integer) AS threshold, n AS replaced FROM m JOIN n USING (session_id) WHERE n.t = threshold""")
def win07_cascade(spark, sf):
    return transcript.cascade(read(spark, sf, "events").select(F.col("user_id").cast("string").alias("session_id"), (F.col("event_id") % 8).alias("score")))


@register(f"WITH {TRANSCRIPT_SQL} SELECT session_id, pos, max(pos) FILTER (role = 'user') OVER (PARTITION BY session_id) AS last_user FROM t")
def win08_last_user(spark, sf):
    return transcript.last_user(views.transcript(spark, sf)).select("session_id", "pos", "last_user")


@register(f"""WITH {TRANSCRIPT_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY pos) - 1 AS n, count(*) OVER (PARTITION BY session_id) AS size FROM t),
    e AS (SELECT session_id, size, max(n) FILTER (role = 'user') AS u, coalesce(max(n) FILTER (role NOT IN ('toolResult', 'tool', 'assistant')) + 1, 0) AS run FROM n GROUP BY session_id, size),
    s AS (SELECT *, CASE WHEN u >= size // 2 THEN u + 1 ELSE least(greatest(run, size - 30), size - 1) END AS start FROM e)
    SELECT session_id, CASE WHEN size <= 2 THEN 0 WHEN start >= size THEN start ELSE coalesce((SELECT max(n) FROM n WHERE n.session_id = s.session_id AND n.n <= s.start AND role NOT IN ('tool', 'toolResult')), 0) END AS at FROM s""")
def win09_insertion_point(spark, sf):
    return transcript.insertion_point(views.transcript(spark, sf))


@register("SELECT filename, source FROM (SELECT cast(doc_id AS varchar) AS filename, source, row_number() OVER (PARTITION BY source ORDER BY cast(doc_id AS varchar) DESC) AS n FROM documents) WHERE n <= 3")
def win10_keep_newest(spark, sf):
    return store.keep_newest(read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("filename"), "source"), 3, "source")


@register("SELECT name, size FROM (SELECT cast(doc_id AS varchar) AS name, n_chars AS size, sum(n_chars) OVER () AS total, coalesce(sum(n_chars) OVER (ORDER BY n_chars DESC, cast(doc_id AS varchar) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM documents) WHERE total - b > 1000000")
def win12_truncate_logs(spark, sf):
    return transcript.truncate_logs(read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("name"), F.col("n_chars").alias("size")), 1_000_000)


@register(f"WITH {L0_SQL} SELECT record_id, 1000 + 100 * (row_number() OVER (ORDER BY session_key, timestamp, record_id) - 1) AS filled FROM l0")
def win13_fill_times(spark, sf):
    """One running index over the messages of all sessions."""
    seed = views.l0(spark, sf).select("record_id", F.col("session_key").alias("session"), F.col("timestamp").alias("round"), F.col("record_id").alias("place"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("long").alias("timestamp"))
    return files.fill_times(seed, 1000).select("record_id", F.col("timestamp").alias("filled"))


# ---- joins and sets


@register("""SELECT e.event_id, b.event_id AS boundary FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_id % 10 = 0) b ON e.user_id = b.user_id AND e.event_id >= b.event_id""")
def join04_asof(spark, sf):
    e = read(spark, sf, "events").select("user_id", F.col("event_id").alias("idx"))
    b = e.where("idx % 10 = 0").select("user_id", F.col("idx").alias("start_index"))
    return joins.asof(e, b, "user_id").select(F.col("idx").alias("event_id"), F.col("start_index").alias("boundary"))


@register("""SELECT o_orderkey AS record_id, coalesce(action, 'store') AS action FROM orders LEFT JOIN (SELECT l_orderkey, arg_max(l_returnflag, (l_linenumber, l_partkey, l_suppkey)) AS action FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey""")
def join05_decisions(spark, sf):
    d = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("record_id"), F.col("l_returnflag").alias("action"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("pos"))
    return joins.decide(read(spark, sf, "orders").select(F.col("o_orderkey").alias("record_id")), d)


@register(f"""WITH {L1_SQL}, f AS (SELECT doc_id AS p, CASE WHEN doc_id % 7 = 3 THEN cast(doc_id AS varchar) ELSE 'n' || (doc_id - doc_id % 2) END AS id, md5(coalesce(text, '')) AS content, lang, cast(doc_id AS varchar) AS created FROM documents),
    d AS (SELECT id, max(p) AS q FROM f GROUP BY id),
    a AS (SELECT f.*, q, CASE q % 5 WHEN 1 THEN 'skip' WHEN 2 THEN 'update' WHEN 3 THEN 'merge' ELSE 'store' END AS action FROM f JOIN d USING (id)),
    t AS (SELECT p, unnest(CASE action WHEN 'update' THEN [cast(q // 3 AS varchar), 'n' || (q - 2)] WHEN 'merge' THEN ['missing', 'n' || (q + 1), cast(q // 4 AS varchar), id] ELSE [] END) AS id FROM a),
    r AS (SELECT id, max(p) AS removed FROM t GROUP BY id),
    w AS (SELECT a.*, action IN ('update', 'merge') AS merged FROM a LEFT JOIN r USING (id) WHERE action <> 'skip' AND (removed IS NULL OR p >= removed)),
    n AS (SELECT id AS record_id, arg_max(CASE WHEN merged THEN 'm' || q ELSE content END, p) AS content, arg_max(CASE WHEN merged AND q % 2 = 0 THEN 'persona' ELSE 'episodic' END, p) AS type,
          arg_max(CASE WHEN merged THEN 7.0 ELSE 50.0 END::double, p) AS priority, arg_max(CASE WHEN merged AND q % 4 = 0 THEN 'b' ELSE created END, p) AS timestamp_str, arg_max(CASE WHEN merged AND q % 4 = 0 THEN 'a' ELSE created END, p) AS timestamp_start,
          arg_max(CASE WHEN merged AND q % 4 = 0 THEN 'c' ELSE created END, p) AS timestamp_end, arg_min(lang || '!', p) AS session_key, arg_min(created, p) AS created_time FROM w GROUP BY id),
    o AS (SELECT record_id, md5(content) AS content, type, priority, timestamp_str, timestamp_start, timestamp_end, session_key, created_time FROM l1 WHERE record_id NOT IN (SELECT id FROM r))
    SELECT record_id, coalesce(n.content, o.content) AS content, coalesce(n.type, o.type) AS type, coalesce(n.priority, o.priority) AS priority, coalesce(n.timestamp_str, o.timestamp_str) AS timestamp_str, coalesce(n.timestamp_start, o.timestamp_start) AS timestamp_start,
           coalesce(n.timestamp_end, o.timestamp_end) AS timestamp_end, coalesce(o.session_key, n.session_key) AS session_key, coalesce(o.created_time, n.created_time) AS created_time FROM n FULL JOIN o USING (record_id)""")
def join05_resolved(spark, sf):
    """A new fact of each document, with a model's decision, resolved against all known facts: targets are shared, missing,
    and other new facts; ids come twice."""
    l1, i = views.l1(spark, sf), F.col("doc_id")
    text = lambda x: x.cast("long").cast("string")
    ident = F.when(i % 7 == 3, text(i)).otherwise(F.concat(F.lit("n"), text(i - i % 2)))
    rows = read(spark, sf, "documents").select("doc_id", ident.alias("record_id"), "text", "lang")
    action = F.get(F.array(*(F.lit(x) for x in ("store", "skip", "update", "merge", "odd"))), F.pmod(i, F.lit(5)).cast("int"))
    other = lambda k: F.concat(F.lit("n"), text(i + k))
    targets = F.when(i % 5 == 2, F.array(text(F.floor(i / 3)), other(-2))).otherwise(F.array(F.lit("missing"), F.lit(None), other(1), text(F.floor(i / 4)), F.col("record_id")))
    times = F.when(i % 4 == 0, F.array(F.lit("b"), F.lit("a"), F.lit("c")))
    decision = F.struct("record_id", action.alias("action"), targets.alias("target_ids"), F.concat(F.lit("m"), text(i)).alias("merged_content"), F.when(i % 2 == 0, "preference").alias("merged_type"), F.lit(7.0).alias("merged_priority"), times.alias("merged_timestamps"))
    decisions = extract.parse_decisions(rows.select("doc_id", F.to_json(F.array(decision)).alias("answer"))).withColumn("pos", F.struct("doc_id", "pos"))
    # an unknown action is no decision, though a later one than another of the same id
    odd = rows.where(i % 5 == 4).select("doc_id", "record_id", F.struct("doc_id", F.lit(0).alias("pos")).alias("pos"), F.lit("store").alias("action"))
    decisions = decisions.unionByName(odd, allowMissingColumns=True)
    created = text(i)
    facts = rows.select("record_id", F.md5(F.coalesce("text", F.lit(""))).alias("content"), F.lit("episodic").alias("type"), F.lit(50.0).alias("priority"), F.lit("s").alias("scene_name"), F.concat("lang", F.lit("!")).alias("session_key"), F.lit("s").alias("session_id"), F.array(created).alias("timestamps"), created.alias("created_time"), created.alias("updated_time"), F.lit("{}").alias("metadata_json"), i.alias("pos"))
    known = l1.withColumn("content", F.md5("content"))
    return resolve.resolve(known, facts, decisions).l1.select("record_id", "content", "type", "priority", "timestamp_str", "timestamp_start", "timestamp_end", "session_key", "created_time")


@register("""WITH e AS (SELECT 'call_' || vec_id AS id, label FROM embeddings WHERE vec_id % 2 = 0), m AS (SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN 'call_' || vec_id ELSE 'call' || vec_id END AS id FROM embeddings)
    SELECT vec_id, label FROM m LEFT JOIN e ON replace(m.id, '_', '') = replace(e.id, '_', '')""")
def join06_tool_id(spark, sf):
    v = read(spark, sf, "embeddings")
    e = v.where("vec_id % 2 = 0").select(F.concat(F.lit("call_"), "vec_id").alias("tool_call_id"), "label")
    m = v.select("vec_id", F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit("call_"), "vec_id")).otherwise(F.concat(F.lit("call"), "vec_id")).alias("tool_id"))
    return joins.by_tool_id(m, e, ("label",)).select("vec_id", "label")


@register("""SELECT cast(user_id AS varchar) AS session_id, event_type AS tool_id, max(event_id) FILTER (event_id % 2 = 0) OVER w AS call_pos, event_id AS result_pos FROM events
    WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) QUALIFY event_id % 2 = 1 AND call_pos IS NOT NULL""")
def join07_pairs(spark, sf):
    kind = F.when(F.col("event_id") % 2 == 0, "call").otherwise("result")
    return joins.pairs(read(spark, sf, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("pos"), kind.alias("kind"), F.col("event_type").alias("tool_id")))


@register("SELECT c_custkey AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def join10_orphans(spark, sf):
    return joins.orphans(read(spark, sf, "customer").select(F.col("c_custkey").alias("name")), read(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("name")))


@register("SELECT 'a_' || doc_id AS tool_call_id FROM documents SEMI JOIN labels USING (doc_id)")
def join11_confirmed(spark, sf):
    e = read(spark, sf, "documents").select(F.concat(F.lit("a_"), "doc_id").alias("tool_call_id"))
    return joins.confirmed(e, read(spark, sf, "labels").select(F.concat(F.lit("a"), "doc_id").alias("tool_call_id")))


@register("SELECT d.doc_id, CASE WHEN quality IS NOT NULL THEN 'n' || quality WHEN d.doc_id % 2 = 0 THEN 'wait' END AS node_id FROM documents d LEFT JOIN labels USING (doc_id)")
def join12_map_nodes(spark, sf):
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("tool_call_id"), F.lit(None).cast("string").alias("node_id"))
    m = read(spark, sf, "labels").select(F.col("doc_id").alias("tool_call_id"), F.concat(F.lit("n"), "quality").alias("node"))
    return joins.map_nodes(d, m, d.where("tool_call_id % 2 = 0")).select(F.col("tool_call_id").alias("doc_id"), "node_id")


@register("WITH a AS (SELECT DISTINCT lang, source FROM documents), b AS (SELECT DISTINCT lang, source FROM documents WHERE doc_id % 3 > 0) SELECT lang, bool_and(b.source IS NOT NULL) AS ok FROM a LEFT JOIN b USING (lang, source) GROUP BY lang")
def join13_bijection(spark, sf):
    d = read(spark, sf, "documents")
    return joins.same_ids(d.select("lang", "source").distinct(), d.where("doc_id % 3 > 0").select("lang", "source").distinct(), "lang", "source")


@register("SELECT p_partkey FROM part SEMI JOIN (SELECT DISTINCT split_part(p_name, ' ', 1) AS prefix FROM part WHERE p_size < 5) s ON split_part(p_name, ' ', 1) = s.prefix")
def join14_node_prefix(spark, sf):
    p = read(spark, sf, "part")
    h = p.select("p_partkey", F.split("p_name", " ")[0].alias("prefix"))
    gone = p.where("p_size < 5").select(F.replace("p_name", F.lit(" "), F.lit("-")).alias("node_id"))
    return joins.diagrams_of(h, gone).select("p_partkey")


@register("SELECT event_id, id FROM (SELECT event_id, unnest(list_distinct([event_type, replace(event_type, '_', '')])) AS id FROM events)")
def set02_id_variants(spark, sf):
    return read(spark, sf, "events").select("event_id", F.explode(F.array_distinct(F.array(F.col("event_type"), tx.tool_id(F.col("event_type"))))).alias("id"))


_PROFILES = "SELECT doc_id AS id, md5(text) AS content_md5 FROM documents"


@register("SELECT doc_id AS id, md5(text) AS content_md5 FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0")
def set03_changed(spark, sf):
    local = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("content_md5"))
    base = local.where("id % 3 <> 0").withColumn("content_md5", F.when(F.col("id") % 5 == 0, "other").otherwise(F.col("content_md5")))
    return store.changed(local, base)


@register("SELECT doc_id AS id FROM documents WHERE doc_id % 3 = 0")
def set04_deleted(spark, sf):
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return store.missing(d, d.where("id % 3 <> 0"))


@register("SELECT DISTINCT event_type || '-' || user_id AS key FROM events WHERE event_type || '-' || user_id NOT IN (SELECT event_type || '-' || user_id FROM events WHERE event_id < 500)")
def set05_idempotent(spark, sf):
    e = read(spark, sf, "events").select("event_id", F.concat_ws("-", "event_type", "user_id").alias("key"))
    return store.insert_if_absent(e.where("event_id < 500"), e).select("key")


@register(f"SELECT o_orderkey FROM orders WHERE NOT o_orderdate < {_CUTOFF} OR (SELECT count(*) FILTER (o_orderdate < {_CUTOFF}) * 10 > count(*) * 8 FROM orders)")
def set07_retention(spark, sf):
    return store.retain(read(spark, sf, "orders"), "o_orderdate", F.expr(_CUTOFF), store.L0_RETENTION).select("o_orderkey")


@register(f"""WITH {L1_SQL} SELECT record_id, CASE WHEN cast(record_id AS bigint) % 2 = 0 THEN 'new' ELSE md5(content) END AS content, session_key FROM l1""")
def snk04_upsert_l1(spark, sf):
    old = views.l1(spark, sf)
    new = old.where(F.col("record_id").cast("long") % 2 == 0).withColumns({"content": F.lit("new"), "session_key": F.lit("other")})
    out = store.upsert_l1(old, new)
    return out.select("record_id", F.when(F.col("content") == "new", "new").otherwise(F.md5("content")).alias("content"), "session_key")


@register("SELECT cast(vec_id AS varchar) AS record_id FROM embeddings WHERE vec_id % 4 <> 1 AND vec_id IN (SELECT doc_id FROM documents) AND vec_id % 2 = 0 UNION SELECT cast(vec_id AS varchar) FROM embeddings WHERE vec_id % 2 = 1")
def snk05_attach_embeddings(spark, sf):
    v = views.vectors(spark, sf).withColumn("updated_time", F.lit("t"))
    rows = views.l1(spark, sf)
    even = F.col("record_id").cast("long") % 2 == 0
    return store.attach_embeddings(v.where(~even), v.where(even).drop("updated_time"), rows, "updated_time").select("record_id")


@register("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def snk06_delete(spark, sf):
    return store.delete(read(spark, sf, "documents").select("doc_id"), read(spark, sf, "labels"), "doc_id")


# ---- scalar functions


def _first_block_sql(x: str, tag: str) -> str:
    a, b = f"strpos({x}, '<{tag}>')", f"strpos({x}, '</{tag}>')"
    return f"CASE WHEN {a} > 0 AND {b} > {a} THEN left({x}, {a} - 1) || substr({x}, {b} + {len(tag) + 3}) ELSE {x} END"


def _sanitize_sql() -> str:
    ctes, last = ["s0 AS (SELECT page_id, html AS x FROM pages)"], "s0"
    for k, tag in enumerate(tx.CONTEXT_TAGS, 1):
        ctes.append(f"s{k} AS (SELECT page_id, {_first_block_sql('x', tag)} AS x FROM {last})")
        last = f"s{k}"
    line = f"regexp_replace({strip_sql('l')}, '[ \\t]+', ' ', 'g')"
    return f"WITH {', '.join(ctes)} SELECT page_id, md5(array_to_string(list_filter(list_transform(regexp_split_to_array(x, '\\r?\\n'), lambda l: {line}), lambda l: l <> ''), chr(10))) AS clean FROM {last}"


@register(_sanitize_sql())
def scl_s01_sanitize(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.md5(tx.sanitize(F.col("html"))).alias("clean"))


@register("SELECT page_id, md5(regexp_replace(html, 'data:image/[^\") \\n]*([\") \\n])', '[image]\\1', 'g')) AS clean FROM pages")
def scl_s03_base64_images(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.md5(tx.strip_base64_images(F.col("html"))).alias("clean"))


@register(f"SELECT doc_id, md5({strip_sql(f'regexp_replace(text, $$[{BLANK_SQL}]+$$, $$ $$, $$g$$)')}) AS clean FROM documents")
def scl_s08_whitespace(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.md5(tx.normalize_whitespace(F.col("text"))).alias("clean"))


@register(f"SELECT doc_id, CASE WHEN length(text) <= 80 THEN text ELSE regexp_replace(left(text, 77), '[{BLANK_SQL}]+$', '') || '...' END AS short FROM documents")
def scl_s05_truncate(spark, sf):
    return read(spark, sf, "documents").select("doc_id", tx.truncate(F.col("text"), 80, "...").alias("short"))


@register("SELECT page_id, 'opencode:' || substr(sha256(url), 1, 16) || ':' || page_id AS key FROM pages")
def scl_s23_session_key(spark, sf):
    return read(spark, sf, "pages").select("page_id", tx.session_key(F.col("url"), F.col("page_id")).alias("key"))


def _redact_sql() -> str:
    x = "regexp_replace(regexp_replace(text, '(?is)<memory-context\\b[^>]*>.*?</memory-context>', '', 'g'), '(?i)</?memory-context\\b[^>]*>', '[REDACTED_MEMORY_TAG]', 'g')"
    for pattern, by in tx.REDACTIONS:
        x = f"regexp_replace({x}, '{pattern}', '{by.replace('$1', chr(92) + '1')}', 'g')"
    return f"SELECT doc_id, md5(left({strip_sql(x)}, 40000)) AS clean FROM documents"


@register(_redact_sql())
def scl_s21_redact(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.md5(tx.redact(F.col("text"))).alias("clean"))


@register("SELECT doc_id, CASE WHEN n_chars >= 10000 THEN '🔥🔥🔥🔥🔥' WHEN n_chars >= 1000 THEN '🔥🔥🔥🔥🔥' WHEN n_chars >= 500 THEN '🔥🔥🔥🔥' WHEN n_chars >= 200 THEN '🔥🔥🔥' WHEN n_chars >= 100 THEN '🔥🔥' WHEN n_chars >= 50 THEN '🔥' ELSE '' END AS mark FROM documents")
def scl_s20_heat(spark, sf):
    return read(spark, sf, "documents").select("doc_id", tx.heat_mark(F.col("n_chars")).alias("mark"))


_CJK_ANY = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{2E80}-\x{2FFF}]"


@register(f"SELECT doc_id, cast(ceil(c / 1.7::double + (length(text) - c - w) / 4.0::double) AS bigint) AS tokens FROM (SELECT *, len(regexp_extract_all(text, '{_CJK_ANY}')) AS c, len(regexp_extract_all(text, '[{BLANK_SQL}]')) AS w FROM documents)")
def scl_m04_tokens(spark, sf):
    return read(spark, sf, "documents").select("doc_id", tx.tokens_nonspace(F.col("text")).alias("tokens"))


@register(f"WITH {TRANSCRIPT_SQL} SELECT session_id, pos, tokens FROM t")
def scl_m05_tokens(spark, sf):
    return views.transcript(spark, sf).select("session_id", "pos", "tokens")


@register("SELECT vec_id, round(sqrt(list_sum(list_transform(v, lambda x: (x / n) * (x / n)))), 6) AS length FROM (SELECT vec_id, cast(embedding AS double[]) AS v, sqrt(list_sum(list_transform(cast(embedding AS double[]), lambda x: x * x))) AS n FROM embeddings)")
def scl_m01_normalise(spark, sf):
    return read(spark, sf, "embeddings").select("vec_id", F.round(vec.norm(vec.normalise(F.col("embedding"))), 6).alias("length"))


@register("SELECT doc_id, sha256('scope' || chr(1) || source || chr(1) || doc_id) AS id, md5(text) AS digest FROM documents")
def scl_m07_stable_ids(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.sha2(F.concat_ws("\x01", F.lit("scope"), "source", "doc_id"), 256).alias("id"), F.md5("text").alias("digest"))


@register("SELECT event_id, CASE WHEN floor(value) = floor(value) AND v = floor(v) THEN cast(cast(v AS bigint) AS varchar) ELSE cast(v AS varchar) END AS shown FROM (SELECT *, floor(value * 2) / 2 AS v FROM events)")
def scl_m11_plain_number(spark, sf):
    return read(spark, sf, "events").select("event_id", tx.plain_number(F.floor(F.col("value") * 2) / 2).alias("shown"))


_TZ = "Europe/Berlin"


@register(f"""SELECT event_id, strftime(l, '%Y-%m-%dT%H:%M:%S') || CASE WHEN m < 0 THEN '-' ELSE '+' END || printf('%02d:%02d', abs(m) // 60, abs(m) % 60) AS local FROM
    (SELECT event_id, l, cast((epoch(l) - epoch(t)) / 60 AS integer) AS m FROM (SELECT event_id, date_trunc('millisecond', ts) AS t, (date_trunc('millisecond', ts) AT TIME ZONE 'UTC') AT TIME ZONE '{_TZ}' AS l FROM events))""")
def scl_d02_local_time(spark, sf):
    return read(spark, sf, "events").select("event_id", tx.local_datetime(F.unix_millis(F.col("ts").cast("timestamp")), _TZ).alias("local"))


@register(f"SELECT event_id, epoch_ms((date_trunc('day', (ts AT TIME ZONE 'UTC') AT TIME ZONE '{_TZ}') AT TIME ZONE '{_TZ}') AT TIME ZONE 'UTC') AS day FROM events")
def scl_d03_start_of_day(spark, sf):
    return read(spark, sf, "events").select("event_id", tx.start_of_local_day(F.unix_millis(F.col("ts").cast("timestamp")), _TZ).alias("day"))


@register("SELECT event_id, cast(json_extract_string(props, '$.k') AS bigint) AS k FROM events")
def scl_j12_pointer(spark, sf):
    return read(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@register(f"WITH {L1_SQL} SELECT record_id, md5('- [' || type || '|' || scene_name || '] ' || content || ' (活动时间: ' || CASE WHEN substr(timestamp_start, 12, 5) = '00:00' THEN left(timestamp_start, 10) ELSE timestamp_start END || ' ~ ' || CASE WHEN substr(timestamp_end, 12, 5) = '00:00' THEN left(timestamp_end, 10) ELSE timestamp_end END || ')') AS line FROM l1")
def scl_s19_memory_line(spark, sf):
    line = tx.memory_line(F.col("type"), F.col("scene_name"), F.col("content"), F.col("timestamp_start"), F.col("timestamp_end"), F.col("timestamp_str"))
    return views.l1(spark, sf).select("record_id", F.md5(line).alias("line"))


# ---- triggers


@register("SELECT event_id, n, n IN (1, 3, 7) OR (n > 7 AND (n - 7) % 5 = 0) AS fires FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)")
def str03_warmup_replay(spark, sf):
    return triggers.count_trigger(read(spark, sf, "events"), "user_id", "event_id").select("event_id", "n", "fires")


@register("""WITH g AS (SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 864000000000, false) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    r AS (SELECT *, count(*) FILTER (gap) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g)
    SELECT user_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n FROM r GROUP BY user_id, run""")
def str04_idle_sessions(spark, sf):
    return triggers.idle_sessions(read(spark, sf, "events"), "user_id", "ts", 864_000)


@register("SELECT event_id, least(coalesce(d, u), u) AS due FROM (SELECT event_id, CASE WHEN event_id % 3 > 0 THEN event_id + 500 END AS d, greatest(event_id + 10, event_id % 7 * 200 + 900) AS u FROM events)")
def str06_advance_timer(spark, sf):
    now = F.col("event_id")
    return read(spark, sf, "events").select("event_id", triggers.advance_timer(F.when(now % 3 > 0, now + 500), now, now % 7 * 200).alias("due"))


@register("""SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'requested' WHEN doc_id % 4 > 0 AND doc_id % 3 = 0 AND doc_id % 5 > 0 THEN 'cold start' WHEN doc_id % 3 > 0 AND doc_id % 5 > 0 AND NOT doc_id % 7 > 0 THEN 'body lost'
    WHEN doc_id % 4 = 1 AND doc_id % 60 > 0 THEN 'first scene' WHEN doc_id % 60 >= 50 THEN 'threshold' END AS reason FROM documents""")
def str10_persona_trigger(spark, sf):
    i = F.col("doc_id")
    cp = read(spark, sf, "documents").select(i, (i % 11 == 0).alias("request_persona_update"), (i % 4).alias("scenes_processed"), (i % 3).alias("last_persona_at"), (i % 5 > 0).alias("has_scenes"), (i % 7 > 0).alias("has_body"), (i % 60).alias("memories_since_last_persona"))
    return triggers.persona_due(cp).select("doc_id", "reason")


# ---- sequential per session; their SQL takes a step of the loop in each recursion


_LIST = "list({'p': pos, 'r': role, 't': tokens} ORDER BY pos)"
#: The place (from 1) of the last user message of a list ``l``, 0 without one.
_LAST_USER = "coalesce(list_max(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN l[i].r = 'user' THEN i END)), 0)"


def _costliest_sql(least: str, most: str, roles: str) -> str:
    """The place of the costliest message of some roles but the last user's, the first of equals."""
    best = f"list_max(list_transform(range({least}, {most} + 1), lambda i: CASE WHEN i <> u AND l[i].r IN ({roles}) THEN l[i].t * 1000000 - i END))"
    return f"CASE WHEN {best} IS NOT NULL THEN 1000000 - (({best} % 1000000 + 1000000) % 1000000) END"


def _emergency_sql(rows: str, goal: int) -> str:
    """CTEs ``e`` (session_id, l): the list that is left of each session of ``rows`` (session_id, l, lft)."""
    largest = "list_max(list_transform(range(1, n + 1), lambda i: CASE WHEN i <> u THEN l[i].t * 1000000 + i END))"
    note = f"cast(ceil(length('{transcript.TRUNCATED[0]}' || l[cut].t || '{transcript.TRUNCATED[1]}' || l[cut].r || ']') / 4.0::double) AS bigint)"
    return f"""r AS (SELECT session_id, 0 AS k, l, lft, true AS go FROM {rows} UNION ALL SELECT session_id, k + 1,
        CASE WHEN c > 0 THEN l[c + 1:] WHEN tail IS NOT NULL THEN list_filter(l, lambda x, i: i <> tail) WHEN cut IS NOT NULL THEN list_transform(l, lambda x, i: CASE WHEN i = cut THEN {{'p': x.p, 'r': x.r, 't': note}} ELSE x END) ELSE l END,
        greatest(0, lft - coalesce(CASE WHEN c > 0 THEN list_sum(list_transform(l[:c], lambda x: x.t))::bigint WHEN tail IS NOT NULL THEN l[tail].t WHEN cut IS NOT NULL THEN greatest(0, l[cut].t - note) END, 0)),
        c > 0 OR tail IS NOT NULL OR coalesce(l[cut].t - note > 0, false)
        FROM (SELECT *, {note} AS note FROM (SELECT *, CASE WHEN c = 0 AND tail IS NULL AND {largest} >= 600000000 THEN {largest} % 1000000 END AS cut FROM (SELECT *, CASE WHEN c = 0 THEN {_costliest_sql('2', 'n - 1', "'tool', 'toolResult', 'assistant'")} END AS tail FROM (
            SELECT *, CASE WHEN u > 0 THEN least(h, u - 1) ELSE h END AS c FROM (SELECT *, least(greatest(1, cast(ceil(n * least((lft - {goal}) / lft::double, 0.5::double)) AS bigint)), n - 2) AS h FROM (
                SELECT *, len(l) AS n, {_LAST_USER} AS u FROM r WHERE go AND len(l) > 2 AND lft > {goal}))))))),
    e AS (SELECT session_id, arg_max(l, k) AS l FROM r GROUP BY session_id)"""


_OUT_SQL = "SELECT session_id, x.p AS pos, x.t AS tokens FROM (SELECT session_id, unnest(l) AS x FROM e)"


@register(f"WITH RECURSIVE {TRANSCRIPT_SQL}, s AS (SELECT session_id, {_LIST} AS l, cast(sum(tokens) + ceil(count(*) * 0.5) AS bigint) AS lft FROM t GROUP BY session_id), {_emergency_sql('s', 300)} {_OUT_SQL}")
def win06_emergency(spark, sf):
    return transcript.emergency(views.transcript(spark, sf), 500).select("session_id", "pos", "tokens")


@register(f"""WITH RECURSIVE {TRANSCRIPT_SQL}, s AS (SELECT session_id, {_LIST} AS l FROM t GROUP BY session_id),
    r AS (SELECT session_id, 0 AS k, l, 0::bigint AS saved FROM s UNION ALL SELECT session_id, k + 1, list_filter(l, lambda x, i: i <> g), saved + l[g].t
        FROM (SELECT *, {_costliest_sql('2', 'len(l)', "'assistant'")} AS g FROM (SELECT *, {_LAST_USER} AS u FROM r WHERE saved < 200 AND len(l) > 2)) WHERE g IS NOT NULL),
    e AS (SELECT session_id, arg_max(l, k) AS l FROM r GROUP BY session_id) SELECT session_id, x.p AS pos FROM (SELECT session_id, unnest(l) AS x FROM e)""")
def top16_tail_delete(spark, sf):
    rows = views.transcript(spark, sf).withColumn("tool_id", F.when(F.col("role") != "user", F.concat_ws("-", "role", "pos")))
    return transcript.tail_delete(rows, 200).select("session_id", "pos")


@register(f"""WITH RECURSIVE {TRANSCRIPT_SQL}, d AS (SELECT session_id, pos AS seq, tokens AS f, tokens // 4 AS c, row_number() OVER (PARTITION BY session_id ORDER BY pos DESC) AS n FROM t),
    r AS (SELECT session_id, 0::bigint AS n, 300::bigint AS room, 0::bigint AS seq, NULL::varchar AS form FROM d WHERE n = 1 UNION ALL
        SELECT d.session_id, d.n, room - CASE WHEN f <= room THEN f WHEN c <= room THEN c ELSE 0 END, d.seq, CASE WHEN f <= room THEN 'full' WHEN c <= room THEN 'compact' END FROM r JOIN d ON d.session_id = r.session_id AND d.n = r.n + 1)
    SELECT session_id, seq, form FROM r WHERE form IS NOT NULL""")
def win11_build_history(spark, sf):
    rows = views.transcript(spark, sf).select("session_id", F.col("pos").alias("seq"), F.col("tokens").alias("full_tokens"), (F.col("tokens") / 4).cast("long").alias("compact_tokens"))
    return transcript.build_history(rows, 300).select("session_id", "seq", "form")


_COMPRESS_SQL = f"""WITH RECURSIVE {TRANSCRIPT_SQL}, n AS (SELECT *, row_number() OVER w AS n, sum(tokens) OVER w AS acc, count(*) OVER p AS size, sum(tokens) OVER p + ceil(count(*) OVER p * 0.5) AS total FROM t WINDOW w AS (PARTITION BY session_id ORDER BY pos), p AS (PARTITION BY session_id)),
    c AS (SELECT *, max(n) FILTER (role = 'user') OVER (PARTITION BY session_id) AS u, min(n) FILTER (acc >= greatest(total - 340, 1)) OVER (PARTITION BY session_id) AS f FROM n),
    k AS (SELECT * FROM c WHERE total < 340 OR n > greatest(0, least(coalesce(f, size), size - 2, coalesce(u - 1, size)))),
    s AS (SELECT session_id, {_LIST} AS l, cast(sum(tokens) + ceil(count(*) * 0.5) AS bigint) AS lft FROM k GROUP BY session_id), o AS (SELECT * FROM s WHERE lft >= 380), {_emergency_sql('o', 240)}
    , kept AS ({_OUT_SQL} UNION ALL SELECT session_id, x.p, x.t FROM (SELECT session_id, unnest(l) AS x FROM s WHERE lft < 380))"""


@register(_COMPRESS_SQL + "SELECT session_id, pos, tokens FROM kept")
def trx03_compress(spark, sf):
    none = spark.createDataFrame([], "tool_call_id string, summary string, score double")
    return transcript.compress(views.transcript(spark, sf), 400, none).select("session_id", "pos", "tokens")


@register(_COMPRESS_SQL + """SELECT t.session_id, t.pos, 'call_' || t.session_id || '_' || t.pos AS tool_id, CASE WHEN kept.pos IS NULL THEN 'deleted' ELSE 'cut' END AS change
    FROM t LEFT JOIN kept USING (session_id, pos) WHERE kept.pos IS NULL OR kept.tokens <> t.tokens""")
def trx08_changes(spark, sf):
    """What a compression changed, for its entries to tell."""
    rows = views.transcript(spark, sf).withColumn("tool_id", F.concat_ws("_", F.lit("call"), "session_id", "pos"))
    none = spark.createDataFrame([], "tool_call_id string, summary string, score double")
    return transcript.changes(rows, transcript.compressed(rows, 400, none)[0], none)


@register(_COMPRESS_SQL + """, b AS (SELECT session_id, any_value(total) AS tokens_before, count(*) AS had FROM c GROUP BY session_id), a AS (SELECT session_id, sum(tokens) + ceil(count(*) * 0.5) AS tokens_after, count(*) AS has FROM kept GROUP BY session_id)
    SELECT session_id, CASE WHEN session_id IN (SELECT session_id FROM o) THEN 'emergency' WHEN tokens_before >= 340 THEN 'aggressive' WHEN tokens_before >= 200 THEN 'mild' ELSE 'none' END AS mode, 0::bigint AS replaced,
           had - has AS deleted, cast(tokens_before AS bigint) AS tokens_before, cast(tokens_after AS bigint) AS tokens_after, cast(greatest(0, tokens_before - tokens_after) AS bigint) AS tokens_saved FROM b JOIN a USING (session_id)""")
def trx08_report(spark, sf):
    """Mode and totals of a compression, for each session."""
    rows = views.transcript(spark, sf)
    none = spark.createDataFrame([], "tool_call_id string, summary string, score double")
    after, modes = transcript.compressed(rows, 400, none)
    return transcript.report(rows, after, transcript.changes(rows, after), modes)


# ---- more filters, sums and names


@register(f"WITH {L1_SQL}, {_bm25_sql('l1', 'content', 30)} SELECT record_id, round(score, 9) AS score FROM bm JOIN l1 USING (record_id) WHERE type = 'episodic' AND contains(lower(scene_name), 'src1') ORDER BY rank, record_id LIMIT 10")
def flt05_post_filters(spark, sf):
    return search.search_memories(views.l1(spark, sf), ASKED, 10, kind="episodic", scene="SRC1").select("record_id", F.round("score", 9).alias("score"))


@register(f"WITH {L0_SQL}, {_bm25_sql('l0', 'message_text', 40)} SELECT record_id, round(score, 9) AS score FROM bm JOIN l0 USING (record_id) WHERE session_key = '7' ORDER BY rank, record_id LIMIT 10")
def flt06_session_filter(spark, sf):
    return search.search_conversations(views.l0(spark, sf), ASKED, 10, session_key="7").select("record_id", F.round("score", 9).alias("score"))


@register("WITH f AS (SELECT n_nationkey, n_nationkey / 50 AS score FROM nation) SELECT 'some' AS list, n_nationkey FROM f WHERE score >= 0.3 UNION ALL SELECT 'none', n_nationkey FROM f")
def flt07_threshold_fallback(spark, sf):
    n = read(spark, sf, "nation")
    some = search.threshold_with_fallback(n.select("n_nationkey", (F.col("n_nationkey") / 50).alias("score")), 0.3, 60)
    none = search.threshold_with_fallback(n.select("n_nationkey", (F.col("n_nationkey") / 100).alias("score")), 0.3, 60)
    return some.select(F.lit("some").alias("list"), "n_nationkey").union(none.select(F.lit("none"), "n_nationkey"))


@register(f"WITH {_KNN_SQL.format(30)} SELECT record_id FROM kn WHERE 1 - distance >= 0.3")
def flt08_vector_threshold(spark, sf):
    return search.vector_search(views.vectors(spark, sf), _asked_vector(spark, sf), 30).where("score >= 0.3").select("record_id")


@register(f"WITH {L0_SQL} SELECT record_id FROM l0 WHERE cast(session_key AS bigint) % 2 = 1 OR timestamp % 1000000 > 2000")
def flt11_capture_cursor(spark, sf):
    l0 = views.l0(spark, sf)
    even = l0.where(F.col("session_key").cast("long") % 2 == 0).select("session_key").distinct()
    return capture.after_cursors(l0, even.withColumn("last_captured_timestamp", F.when(F.col("session_key") == "0", 2000).otherwise(F.col("session_key").cast("long") * 1_000_000 + 2000))).select("record_id")


@register(f"WITH {L0_SQL} SELECT record_id FROM l0 QUALIFY count(*) OVER (PARTITION BY session_key) < 2 OR row_number() OVER (PARTITION BY session_key ORDER BY timestamp, record_id) > 2")
def flt12_position_slice(spark, sf):
    return extract.drop_first(views.l0(spark, sf), 2).select("record_id")


@register("SELECT doc_id FROM documents WHERE regexp_matches(source, '(?s)s.*c1')")
def flt20_glob(spark, sf):
    return read(spark, sf, "documents").where(F.col("source").rlike("(?s)" + tx.glob_to_regex("s*c1"))).select("doc_id")


@register("SELECT event_id FROM events WHERE event_id % 7 > 0 AND event_id % 5 > 0 AND event_id % 3 > 0 AND event_id >= 100")
def flt21_tool_admission(spark, sf):
    i = F.col("event_id")
    e = read(spark, sf, "events").select(i, F.when(i % 7 > 0, i.cast("string")).otherwise("").alias("tool_call_id"), F.when(i % 5 > 0, "{}").otherwise('{"path": "HEARTBEAT.md"}').alias("params"), F.when(i % 3 > 0, "{}").otherwise('{"details": {"status": "approval-pending"}}').alias("result"))
    return joins.admit(e, e.where("event_id < 100")).select("event_id")


@register("SELECT page_id FROM pages WHERE page_id % 3 = 0 OR page_id % 3 = 1")
def flt26_changed_scenes(spark, sf):
    at = F.when(F.col("page_id") % 3 == 0, "not a time").when(F.col("page_id") % 3 == 1, "2024-05-02T00:00:00Z").otherwise("2024-04-01T00:00:00Z")
    return store.changed_since(read(spark, sf, "pages").select("page_id", at.alias("updated")), F.lit("2024-05-01T00:00:00Z")).select("page_id")


@register("""WITH e AS (SELECT user_id, event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'wait' ELSE 'n' END AS node, epoch_ms(ts) // 1000 AS s FROM events),
    o AS (SELECT * FROM e WHERE node IS NULL OR (node = 'wait' AND 1800000000 - s >= 120))
    SELECT 'd' || user_id AS target, string_agg(event_id, ',' ORDER BY event_id) AS ids FROM o WHERE user_id % 3 > 0 GROUP BY ALL""")
def agg10_group_candidates(spark, sf):
    node = F.when(F.col("event_id") % 4 == 1, "wait").when(F.col("event_id") % 4 > 1, "n")
    e = read(spark, sf, "events").select(F.col("user_id").cast("string").alias("session_id"), "event_id", F.col("event_id").alias("idx"), node.alias("node_id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"))
    user = F.col("session_id").cast("long")
    judged = e.select("session_id").distinct().select("session_id", F.lit(0).alias("start_index"), F.when(user % 3 > 0, "long").otherwise("short").alias("result"), F.concat(F.lit("d"), user).alias("target"), F.lit(0).alias("seq"))
    found = offload.diagram_candidates(e, judged, 1_800_000_000)
    return found.groupBy("target").agg(F.expr("listagg(event_id, ',') within group (order by event_id)").alias("ids"))


@register("SELECT count(DISTINCT conv_id) AS sessions, count(DISTINCT (conv_id, turn // 2)) AS rounds, count(*) AS messages, count(*) FILTER (role = 'system') AS skipped FROM conversations")
def agg12_seed_totals(spark, sf):
    c = read(spark, sf, "conversations")
    return c.agg(F.count_distinct("conv_id").alias("sessions"), F.count_distinct("conv_id", F.floor(F.col("turn") / 2)).alias("rounds"), F.count(F.lit(1)).alias("messages"), F.count_if(F.col("role") == "system").alias("skipped"))


@register("""WITH g AS (SELECT cast(user_id AS varchar) AS session_key, count(*) FILTER (event_id % 20 = 0) AS n, min(event_id) FILTER (event_id % 20 = 0) AS oldest, max(event_id) FILTER (event_id % 20 = 0) AS newest FROM events GROUP BY user_id)
    SELECT session_key, n, n >= 4 OR (10000 - 9000 >= 300 AND n > 0 AND coalesce(newest > 9000, false)) AS due FROM g""")
def agg15_diagram_due(spark, sf):
    e = read(spark, sf, "events").select(F.col("user_id").cast("string").alias("session_key"), F.when(F.col("event_id") % 20 > 0, "n").alias("node_id"), F.col("event_id").alias("ts"))
    return triggers.diagram_due(e, F.lit(10_000), F.lit(9_000)).select("session_key", "n", F.coalesce("due", F.lit(False)).alias("due"))


@register(f"SELECT conv_id, turn, len(list_distinct({_TERMS_SQL.format('text')})) AS n FROM conversations")
def agg19_distinct_terms(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", F.size(F.array_distinct(tx.terms(F.col("text")))).cast("long").alias("n"))


@register("""SELECT cast(a.conv_id AS varchar) AS session_id, a.turn AS assistant, row_number() OVER (PARTITION BY a.conv_id ORDER BY a.turn DESC) AS rank FROM conversations a JOIN conversations u ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
    WHERE a.role = 'assistant' AND u.role = 'user'""")
def join08_parents(spark, sf):
    c = read(spark, sf, "conversations")
    m = c.select(F.col("conv_id").cast("string").alias("session_id"), F.concat_ws("-", "conv_id", "turn").alias("id"), F.concat_ws("-", "conv_id", F.col("turn") - 1).alias("parent_id"), F.col("turn").alias("completed"), "role")
    return joins.parents(m).select("session_id", F.col("completed").alias("assistant"), "rank")


@register("SELECT o_orderkey FROM orders SEMI JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) c ON o_custkey = c_custkey")
def set06_registry_retain(spark, sf):
    known = read(spark, sf, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return read(spark, sf, "orders").join(known, "o_custkey", "left_semi").select("o_orderkey")


@register(f"WITH {L1_SQL} SELECT record_id FROM l1 QUALIFY row_number() OVER (PARTITION BY session_key ORDER BY updated_time, record_id) <= 20")
def top15_limit_per_session(spark, sf):
    return extract.limit_per_session(views.l1(spark, sf).withColumn("o", F.struct("updated_time", "record_id")), 20, "o").select("record_id")


_STATES = "SELECT user_id, max(event_id) AS last_active, min(event_id) AS last_run, count(*) % 2 AS queued, 0 AS buffered FROM events GROUP BY user_id"


def _states(spark, sf):
    return read(spark, sf, "events").groupBy("user_id").agg(F.max("event_id").alias("last_active"), F.min("event_id").alias("last_run"), (F.count(F.lit(1)) % 2).alias("queued"), F.lit(0).alias("buffered"))


@register(f"SELECT user_id FROM ({_STATES}) WHERE 12000 - last_run >= 3600 AND 12000 - last_active < 2500")
def str07_due_after_max(spark, sf):
    return triggers.due_after_max(_states(spark, sf), F.lit(12_000), 3600, 2500).select("user_id")


@register(f"WITH {L1_SQL} SELECT session_key, count(*) AS n, max(updated_time) AS cursor FROM l1 WHERE updated_time > '1970-01-01T02:00:00.000Z' GROUP BY session_key")
def str08_incremental_run(spark, sf):
    rows = views.l1(spark, sf).where(F.col("updated_time") > "1970-01-01T02:00:00.000Z")
    return rows.groupBy("session_key").agg(F.count(F.lit(1)).alias("n"), F.max("updated_time").alias("cursor"))


@register(f"SELECT user_id FROM ({_STATES}) WHERE 12000 - last_active >= 3 * 700 AND queued = 0")
def str11_stale_sessions(spark, sf):
    return triggers.stale(_states(spark, sf), F.lit(12_000), 700).select("user_id")


@register("SELECT page_id, substr(u, 1, 30) AS label FROM (SELECT page_id, regexp_replace(regexp_replace(url, '[^\\p{L}\\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g') AS u FROM pages)")
def scl_s13_label(spark, sf):
    return read(spark, sf, "pages").select("page_id", tx.label(F.col("url")).alias("label"))


@register("SELECT page_id, replace(regexp_replace(url, '[\\x00-\\x1f\\x7f<>:\"/\\\\|?*]', '_', 'g'), '..', '_') AS name FROM pages")
def scl_s12_safe_component(spark, sf):
    return read(spark, sf, "pages").select("page_id", tx.safe_component(F.col("url")).alias("name"))


@register("SELECT doc_id, CASE WHEN doc_id % 20 >= 15 THEN 'merge now' WHEN doc_id % 20 = 14 THEN 'last free' WHEN doc_id % 20 >= 12 THEN 'nearly full' END AS advice FROM documents")
def scl_s30_scene_advice(spark, sf):
    return read(spark, sf, "documents").select("doc_id", triggers.scene_advice(F.col("doc_id") % 20).alias("advice"))


@register("SELECT a.vec_id, round(1 - list_cosine_similarity(cast(a.embedding AS double[]), cast(b.embedding AS double[])), 7) AS distance FROM embeddings a, embeddings b WHERE b.vec_id = 7")
def scl_m02_cosine(spark, sf):
    asked = F.array(*(F.lit(float(x)) for x in _asked_vector(spark, sf)))
    return read(spark, sf, "embeddings").select("vec_id", F.round(vec.cosine_distance(F.col("embedding"), asked), 7).alias("distance"))


@register("SELECT event_id, epoch_ms(date_trunc('day', ts)) - 6 * 86400000 AS cutoff FROM events")
def scl_d05_retention_cutoff(spark, sf):
    return read(spark, sf, "events").select("event_id", tx.retention_cutoff(F.unix_millis(F.col("ts").cast("timestamp")), "UTC", 7).alias("cutoff"))


# ---- logs, stores and files


def _work(spark, name: str) -> str:
    """A new folder where all executors can write."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='palimpsest-')}"
    return f"{base.rstrip('/')}/palimpsest/{name}-{uuid.uuid4().hex}"


@register(f"WITH {L0_SQL} SELECT record_id, session_key, role, md5(message_text) AS content, recorded_at, timestamp FROM l0")
def src01_messages_log(spark, sf):
    path = _work(spark, "messages")
    logs.append_messages(views.l0(spark, sf), path)
    return logs.read_messages(spark, path).select("record_id", "session_key", "role", F.md5("message_text").alias("content"), "recorded_at", "timestamp")


@register(f"WITH {L1_SQL} SELECT record_id, md5(content) AS content, type, priority, scene_name, timestamp_start, timestamp_end, updated_time FROM l1")
def src02_facts_log(spark, sf):
    path = _work(spark, "facts")
    logs.append_facts(views.l1(spark, sf), path)
    return logs.read_facts(spark, path).select("record_id", F.md5("content").alias("content"), "type", "priority", "scene_name", "timestamp_start", "timestamp_end", "updated_time")


@register("SELECT 'c' || doc_id AS tool_call_id, md5(text) AS summary FROM documents WHERE doc_id % 7 <> 0")
def src03_entries(spark, sf):
    path = _work(spark, "entries")
    logs.append_entries(read(spark, sf, "documents").select(F.when(F.col("doc_id") % 7 > 0, F.concat(F.lit("c"), "doc_id")).alias("tool_call_id"), F.md5("text").alias("summary")), path)
    return logs.read_entries(spark, path).select("tool_call_id", "summary")


@register("SELECT count(*) AS n, sum(cast(json_extract_string(props, '$.k') AS bigint)) AS k FROM events WHERE event_id % 3 <> 0")
def src04_values(spark, sf):
    path = _work(spark, "values")
    read(spark, sf, "events").select(F.when(F.col("event_id") % 3 == 0, F.concat("props", F.lit(",}"))).otherwise(F.col("props")).alias("value")).write.text(path)
    return logs.read_values(spark, path).agg(F.count(F.lit(1)).alias("n"), F.sum(F.try_variant_get("value", "$.k", "bigint")).alias("k"))


@register("SELECT doc_id AS filename, source AS summary, n_chars AS heat, md5(trim(text, ' ' || chr(10) || chr(9) || chr(13))) AS body, CASE WHEN doc_id % 2 = 0 THEN 'c' || doc_id ELSE '' END AS created FROM documents WHERE doc_id % 3 > 0 UNION ALL SELECT doc_id, '', 0, md5(trim(text, ' ' || chr(10) || chr(9) || chr(13))), '' FROM documents WHERE doc_id % 3 = 0")
def src05_scenes(spark, sf):
    i = F.col("doc_id")
    created = F.when(i % 2 == 0, F.concat(F.lit("created:  c"), i, F.lit(" \n"))).otherwise("")
    head = F.concat(F.lit("before\n-----META-START-----\n"), created, F.lit("summary: "), "source", F.lit("\nheat: "), "n_chars", F.lit("\n-----META-END-----\n"))
    raw = F.when(i % 3 > 0, F.concat(head, "text")).otherwise(F.col("text"))
    found = files.parse_scenes(read(spark, sf, "documents").select(i.alias("filename"), raw.alias("raw")))
    return found.select("filename", "summary", "heat", F.md5("body").alias("body"), "created")


@register(f"WITH {L1_SQL}, {L0_SQL} SELECT 'l1' AS layer, record_id, md5(content) AS t, updated_time AS at FROM l1 UNION ALL SELECT 'l0', record_id, md5(message_text), recorded_at FROM l0")
def src07_reindex_rows(spark, sf):
    a = views.l1(spark, sf).select(F.lit("l1").alias("layer"), "record_id", F.md5("content").alias("t"), F.col("updated_time").alias("at"))
    return a.union(views.l0(spark, sf).select(F.lit("l0"), "record_id", F.md5("message_text"), "recorded_at"))


@register(f"WITH {L0_SQL} SELECT record_id, CASE WHEN timestamp % 3000 = 0 THEN 'new' ELSE md5(message_text) END AS content, role FROM l0")
def snk03_upsert_l0(spark, sf):
    old = views.l0(spark, sf)
    new = old.where(F.col("timestamp") % 3000 == 0).withColumns({"message_text": F.lit("new"), "role": F.lit("other")})
    out = store.upsert_l0(old, new)
    return out.select("record_id", F.when(F.col("message_text") == "new", "new").otherwise(F.md5("message_text")).alias("content"), "role")


@register("SELECT event_id, 'refs/' || replace(regexp_replace(regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S'), '[:.]', '-', 'g') || '-' || event_type || '/x-' || event_id, '[<>:\"/\\\\|?*]', '_', 'g'), '..', '_') || '.md' AS ref FROM events")
def snk09_reference(spark, sf):
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return read(spark, sf, "events").select("event_id", export.reference(at, F.concat("event_type", F.lit("/x")), F.col("event_id")).alias("ref"))


@register("SELECT 'a_' || doc_id AS tool_call_id, CASE WHEN l.doc_id IS NOT NULL THEN 'deleted' WHEN d.doc_id % 2 = 0 THEN 'true' END AS offloaded FROM documents d LEFT JOIN labels l USING (doc_id)")
def snk10_mark_status(spark, sf):
    e = read(spark, sf, "documents").select(F.concat(F.lit("a_"), "doc_id").alias("tool_call_id"), F.when(F.col("doc_id") % 2 == 0, "true").alias("offloaded"))
    return joins.mark_status(e, read(spark, sf, "labels").select(F.concat(F.lit("a"), "doc_id").alias("tool_call_id"), F.lit("deleted").alias("offloaded")))


@register("SELECT o_custkey AS session_key, count(*) AS n, 'old' AS v FROM orders WHERE o_custkey % 3 > 0 GROUP BY o_custkey UNION ALL SELECT c_custkey, c_nationkey, 'new' FROM customer WHERE c_custkey % 3 = 0")
def snk12_merge_states(spark, sf):
    old = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("session_key")).agg(F.count(F.lit(1)).alias("n"), F.lit("old").alias("v"))
    new = read(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("session_key"), F.col("c_nationkey").cast("long").alias("n"), F.lit("new").alias("v"))
    return store.merge_states(old, new)


@register("SELECT cast(c_custkey AS varchar) AS session_key, 's' || CASE WHEN c_custkey % 2 = 0 THEN c_nationkey + 100 ELSE c_nationkey END AS session_id, 'offload-s' || CASE WHEN c_custkey % 2 = 0 THEN c_nationkey + 100 ELSE c_nationkey END || '.jsonl' AS offload_file, CASE WHEN c_custkey % 2 = 0 THEN 't2' ELSE 't1' END AS updated_at FROM customer")
def snk15_register_sessions(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("session_key"), "c_custkey", "c_nationkey")
    one = upkeep.register_sessions(spark.createDataFrame([], upkeep.REGISTRY), c.select("session_key", F.concat(F.lit("s"), "c_nationkey").alias("session_id")), F.lit("t1"))
    return upkeep.register_sessions(one, c.where("c_custkey % 2 = 0").select("session_key", F.concat(F.lit("s"), F.col("c_nationkey") + 100).alias("session_id")), F.lit("t2"))


@register(f"WITH {L1_SQL} SELECT record_id, CASE WHEN record_id = '7' THEN 'changed' ELSE md5(content) END AS content, CASE WHEN record_id = '7' THEN 't' ELSE updated_time END AS updated_time, type FROM l1")
def snk21_update_fact(spark, sf):
    old = views.l1(spark, sf)
    out = store.upsert_l1(old, upkeep.update_content(old, "7", "changed", "t"))
    return out.select("record_id", F.when(F.col("content") == "changed", "changed").otherwise(F.md5("content")).alias("content"), "updated_time", "type")


@register("""WITH f AS (SELECT 'a' || c_nationkey AS agent, c_custkey AS k, c_custkey % 4 AS m, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_custkey * 1000000 END AS mt FROM customer),
    o AS (SELECT *, mt < 1000000000 - 7 * 86400000 AS old, count(*) FILTER (m = 2) OVER (PARTITION BY agent) AS size FROM f),
    d AS (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY mt, k || '.mmd') AS n FROM o WHERE m = 2 AND old AND k % 3 > 0)
    SELECT agent, k, 'entries' AS kind FROM o WHERE m = 0 AND old UNION ALL SELECT agent, k, 'reference' FROM o WHERE m = 1 AND old AND k % 2 > 0 AND k % 3 > 0 UNION ALL SELECT agent, k, 'diagram' FROM d WHERE n <= size - 15""")
def snk24_offload_waste(spark, sf):
    k, agent = F.col("c_custkey"), F.concat(F.lit("a"), "c_nationkey")
    name = F.when(k % 4 == 0, F.concat(F.lit("offload-"), k, F.lit(".jsonl"))).when(k % 4 == 1, F.concat(k, F.lit(".md"))).when(k % 4 == 2, F.concat(k, F.lit(".mmd"))).otherwise("state.json")
    folder = F.when(k % 4 == 1, "refs/").when(k % 4 == 2, "mmds/").otherwise("")
    at = F.when(k % 5 == 0, 0).otherwise(k * 1_000_000)
    f = read(spark, sf, "customer").select(agent.alias("agent"), F.concat(F.lit("/"), agent, F.lit("/"), folder, name).alias("path"), name.alias("name"), at.cast("long").alias("modified"), k.alias("k"))
    third = f.where("k % 3 = 0").select("agent", "name")
    return upkeep.offload_waste(f, third, third, 1_000_000_000, 7).select("agent", "k", "kind")


@register("SELECT count(*) AS scanned_files, count(*) FILTER (o_orderkey % 5 > 0 AND o_orderdate < DATE '1995-06-01') AS changed_files, count(*) FILTER (o_orderkey % 5 = 0) AS skipped_files FROM orders WHERE o_orderkey % 7 > 0")
def agg18_cleanup_counts(spark, sf):
    k = F.col("o_orderkey")
    name = F.concat(F.when(k % 5 > 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("notes"), F.when(k % 7 == 0, ".txt").otherwise(".jsonl"))
    shards = upkeep.expired_shards(read(spark, sf, "orders").select(k.cast("string").alias("path"), name.alias("name")), "1995-06-01")
    return upkeep.cleanup_counts(shards).select("scanned_files", "changed_files", "skipped_files")


# ---- searches by what they find


@register(f"WITH {L1_SQL}, {_bm25_sql('l1', 'content', 1_000_000_000)} SELECT record_id, round(rank, 9) AS rank FROM r")
def flt29_keyword_ranks(spark, sf):
    return search.keyword_ranks(views.l1(spark, sf), ASKED, "content").select("record_id", F.round("rank", 9).alias("rank"))


_L0_KNN_SQL = f"""{L0_SQL}, e AS (SELECT vec_id || '-0' AS record_id, cast(embedding AS double[]) AS v FROM embeddings),
    kn AS (SELECT a.record_id, 1 - list_cosine_similarity(a.v, b.v) AS distance FROM e a, e b WHERE b.record_id = '7-0' ORDER BY distance, a.record_id LIMIT 40),
    ok AS (SELECT record_id, distance FROM kn JOIN l0 USING (record_id) ORDER BY distance, record_id LIMIT 30)"""


def _message_vectors(spark, sf):
    return views.vectors(spark, sf).withColumn("record_id", F.concat("record_id", F.lit("-0")))


@register(f"WITH {_L0_KNN_SQL} SELECT record_id, round(1 - distance, 7) AS score, 'embedding' AS strategy FROM ok ORDER BY distance, record_id LIMIT 10")
def top04_conversation_vectors(spark, sf):
    found = search.search_conversations(views.l0(spark, sf), "qqqzzzxxx", 10, _message_vectors(spark, sf), _asked_vector(spark, sf))
    return found.select("record_id", F.round("score", 7).alias("score"), "strategy")


@register(f"WITH {L1_SQL}, {_KNN_SQL.format(40)}, ok AS (SELECT kn.* FROM kn JOIN l1 USING (record_id)) SELECT record_id, round(1 - distance, 7) AS score, 'embedding' AS strategy FROM ok ORDER BY distance, record_id LIMIT 10")
def top08_words_that_match_nothing(spark, sf):
    facts = views.l1(spark, sf)
    found = search.search_memories(facts, "qqqzzzxxx", 10, views.vectors(spark, sf), _asked_vector(spark, sf))
    return found.select("record_id", F.round("score", 7).alias("score"), "strategy")


@register(f"WITH {L1_SQL}, {_bm25_sql('l1', 'content', 30)} SELECT record_id, round(score, 9) AS score, 'fts' AS strategy FROM bm ORDER BY rank, record_id LIMIT 10")
def top08_without_vectors(spark, sf):
    found = search.search_memories(views.l1(spark, sf), ASKED, 10)
    return found.select("record_id", F.round("score", 9).alias("score"), "strategy")


# ---- texts, names and times


@register("SELECT doc_id, md5('x' || doc_id || chr(10) || 'end ' || source) AS t FROM documents")
def scl_s02_code_blocks(spark, sf):
    text = F.concat(F.lit("x"), "doc_id", F.lit("\n  ```py\n"), "text", F.lit("\n```\nend "), "source", F.lit("\n```\nopen "), "lang")
    plain = F.replace(F.col("text"), F.lit("```"), F.lit(""))
    return read(spark, sf, "documents").withColumn("text", plain).select("doc_id", F.md5(tx.strip_code_blocks(text)).alias("t"))


@register("SELECT doc_id, '&lt;system&gt;' || source || '&lt;/system&gt;<b>&lt;user-persona&gt;' AS t FROM documents")
def scl_s04_escape_tags(spark, sf):
    return read(spark, sf, "documents").select("doc_id", tx.escape_tags(F.concat(F.lit("<system>"), "source", F.lit("</system><b><user-persona>"))).alias("t"))


@register("SELECT doc_id, round(CASE WHEN length(text) <= 100 THEN length(text) ELSE 100 END) AS n, left(text, 97) || CASE WHEN length(text) <= 100 THEN substr(text, 98) ELSE '...' END AS t, CASE WHEN length(text) <= 300 THEN text ELSE left(text, 299) || '…' END AS c FROM documents")
def scl_s07_cuts(spark, sf):
    t = tx.truncate_chars(F.col("text"), 100, "...")
    return read(spark, sf, "documents").select("doc_id", F.length(t).cast("double").alias("n"), t.alias("t"), tx.compact_call(F.col("text")).alias("c"))


@register(f"SELECT doc_id, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda x: {strip_sql('x')} <> ''), '|')) AS t FROM documents")
def scl_s09_join_lines(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.md5(tx.join_non_empty(F.split("text", "\n"), "|")).alias("t"))


@register(r"""SELECT page_id, CASE WHEN b = '' THEN 'scene' ELSE b END || '.md' AS name FROM (SELECT page_id, regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^.*[/\\]', ''), '(?i)\.md$', ''), '\s+', '-', 'g'), '[<>:"/\\|?*\x00-\x1f]', '', 'g'), '--', '-'), '__', '_'), '..', '.'), '^[-_.]+|[-_.]+$', '', 'g') AS b FROM pages)""")
def scl_s10_scene_filename(spark, sf):
    return read(spark, sf, "pages").select("page_id", tx.scene_filename(F.col("url")).alias("name"))


@register("SELECT doc_id, CASE WHEN doc_id % 3 > 0 AND doc_id % 5 > 0 THEN 'me' || CASE WHEN doc_id % 2 = 0 THEN '-w' || doc_id ELSE '' END END AS agent, CASE WHEN doc_id % 3 > 0 AND doc_id % 5 > 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'swebench-w' || doc_id ELSE 's' || doc_id END || '_x' END AS session FROM documents")
def scl_s14_session_key(spark, sf):
    i = F.col("doc_id")
    key = F.concat(F.when(i % 3 > 0, "agent:").otherwise("user:"), F.when(i % 5 > 0, "me:").otherwise(":"), F.when(i % 2 == 0, "swebench-w").otherwise("s"), i, F.lit(":x"))
    return read(spark, sf, "documents").select(i, tx.parse_session_key(key).alias("p")).select("doc_id", "p.agent", "p.session")


@register(f"SELECT doc_id, md5({strip_sql("CASE WHEN contains(text, '<scene-navigation>') THEN string_split(text, '<scene-navigation>')[1] ELSE text END")}) AS t FROM documents")
def scl_s17_navigation(spark, sf):
    d = read(spark, sf, "documents")
    return d.select("doc_id", F.md5(files.strip_navigation(F.concat("text", F.lit("\n\n<scene-navigation>\n- a\n</scene-navigation>")))).alias("t"))


@register("SELECT doc_id, lang || '(' || CASE WHEN length(text) <= 200 THEN text ELSE left(text, 197) || '...' END || ')' AS tool_call, '[L1 degraded] ' || lang || ': ' || CASE WHEN length(text) <= 300 THEN text ELSE left(text, 297) || '...' END AS summary FROM documents")
def scl_s18_degraded(spark, sf):
    return read(spark, sf, "documents").select("doc_id", logs.degraded_summary(F.col("lang"), F.col("text"), F.col("text")).alias("d")).select("doc_id", "d.tool_call", "d.summary")


@register("SELECT doc_id, regexp_full_match(source, '(?is)SR.*1') AS hit FROM documents")
def scl_s24_anchored_glob(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.col("source").rlike(tx.anchored_glob("SR*1")).alias("hit"))


@register("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name || chr(10) || 'new' || chr(10) || 'c' WHEN 1 THEN 'x' || chr(10) || 'b' || chr(10) || 'y' END AS t FROM customer")
def scl_s26_splice(spark, sf):
    k = F.col("c_custkey")
    source = F.concat("c_name", F.lit("\nb\nc\n"))
    block = lambda a, b, c: F.struct(F.lit(a).cast("long").alias("start_line"), F.lit(b).cast("long").alias("end_line"), F.lit(c).alias("content"))
    blocks = F.when(k % 3 == 0, F.array(block(2, 2, "new"))).when(k % 3 == 1, F.array(block(1, 1, "x"), block(3, 3, "y"))).otherwise(F.array(block(3, 4, "z")))
    return read(spark, sf, "customer").select(k, tx.splice_lines(source, blocks).alias("t"))


@register("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END AS goal, '%%{\"taskGoal\": \"' || c_name || '\"}%%' || chr(10) || 'A[\"' || c_custkey || '\"]' AS outline FROM customer")
def scl_s27_task_goal(spark, sf):
    head = F.concat(F.lit('%%{"taskGoal": "'), "c_name", F.lit('"}%%\n'))
    body = F.concat(head, F.lit('A["'), "c_custkey", F.lit('"]\nA --> B\n'))
    shown = F.when(F.col("c_custkey") % 2 == 0, body).otherwise(F.concat(F.lit("flowchart\n"), body))
    return read(spark, sf, "customer").select("c_custkey", offload.task_goal(shown).alias("goal"), tx.diagram_outline(body).alias("outline"))


@register("""WITH c AS (SELECT doc_id, text, list_filter(range(0, least(length(text), 50) + 1), lambda n: n + length(regexp_replace(left(text, n), '[\\x{0}-\\x{FFFF}]', '', 'g')) <= 50) AS fits FROM documents)
    SELECT doc_id, left(text, list_max(fits)) AS t FROM c""")
def scl_s29_input_cap(spark, sf):
    return read(spark, sf, "documents").select("doc_id", tx.cut_utf16(F.col("text"), 50).alias("t"))


@register("SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y-%m-%dT12:30:00.5+02:00') END AS shown FROM events")
def scl_d06_recall_time(spark, sf):
    day = F.date_format("ts", "yyyy-MM-dd")
    value = F.when(F.col("event_id") % 3 == 0, F.concat(day, F.lit("T00:00:59Z"))).when(F.col("event_id") % 3 == 1, F.concat(day, F.lit("T12:30:00.5+02:00"))).otherwise(F.concat(day, F.lit(" 12:30")))
    return read(spark, sf, "events").select("event_id", tx.recall_time(value).alias("shown"))


@register("SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_id * 7 WHEN 1 THEN epoch_ms(date_trunc('second', ts)) END AS ms FROM events")
def scl_d10_parse_time(spark, sf):
    i = F.col("event_id")
    value = F.when(i % 3 == 0, (i * 7).cast("string")).when(i % 3 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("some day")
    return read(spark, sf, "events").select(i, tx.parse_time_ms(value).alias("ms"))


@register("SELECT vec_id, len(list_filter(embedding, lambda x: x <> 0)) > 0 AND vec_id % 4 > 0 AS ok FROM embeddings")
def scl_m03_nonzero(spark, sf):
    e = F.when(F.col("vec_id") % 4 > 0, F.col("embedding")).otherwise(F.transform("embedding", lambda x: x * 0))
    return read(spark, sf, "embeddings").select("vec_id", vec.nonzero(e).alias("ok"))


@register("SELECT event_id, 'l0_' || user_id || '_' || epoch_us(ts) // 1000 || '_' || substr(sha256(user_id || chr(31) || epoch_us(ts) // 1000 || chr(31) || event_id), 1, 8) AS id FROM events")
def scl_m09_record_id(spark, sf):
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    return read(spark, sf, "events").select("event_id", tx.record_id("l0", F.col("user_id"), at, F.col("event_id")).alias("id"))


@register(f"WITH {TRANSCRIPT_SQL}, s AS (SELECT session_id, cast(sum(tokens) + ceil(count(*) * 0.5) + 50 AS bigint) AS tokens FROM t GROUP BY session_id) SELECT *, CASE WHEN tokens >= 380 THEN 'emergency' WHEN tokens >= 340 THEN 'aggressive' WHEN tokens >= 200 THEN 'mild' ELSE 'none' END AS level FROM s")
def scl_m10_level(spark, sf):
    return transcript.level(views.transcript(spark, sf), 400, 50)


# ---- JSON


def _array(*columns):
    return F.to_json(F.array(F.struct(*columns)))


@register("SELECT doc_id, md5(source) AS source, n_chars AS n FROM documents")
def scl_j01_repair(spark, sf):
    broken = F.concat(F.lit("```json\n{\"s\": "), F.to_json(F.array("source")), F.lit(", \"n\": "), "n_chars", F.lit(" ,\n}\n```"))
    j = tx.repair_json(broken)
    return read(spark, sf, "documents").select("doc_id", F.md5(F.get_json_object(j, "$.s[0]")).alias("source"), F.get_json_object(j, "$.n").cast("long").alias("n"))


@register("SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN source END AS s FROM documents")
def scl_j02_extract(spark, sf):
    i, obj = F.col("doc_id"), F.to_json(F.struct(F.col("source").alias("s")))
    text = F.when(i % 4 == 0, obj).when(i % 4 == 1, F.concat(F.lit("Here it is:\n```json\n"), obj, F.lit("\n```\nDone"))).when(i % 4 == 2, F.concat(F.lit("so "), obj, F.lit(" it is"))).otherwise("nothing at all")
    return read(spark, sf, "documents").select(i, F.get_json_object(tx.extract_json(text), "$.s").alias("s"))


@register("SELECT doc_id, md5(text) AS content, ['persona', 'episodic', 'instruction'][doc_id % 4 + 1] AS type, CASE WHEN doc_id % 2 = 0 THEN 70.5 ELSE 50.0 END::double AS priority, CASE WHEN doc_id % 3 = 0 THEN '未知情境' ELSE source END AS scene_name FROM documents WHERE doc_id % 4 < 3 AND trim(text, ' ' || chr(10) || chr(9) || chr(13)) <> ''")
def scl_j03_memories(spark, sf):
    i = F.col("doc_id")
    kind = F.get(F.array(F.lit("preference"), F.lit(None), F.lit("instruct"), F.lit("odd")), F.pmod(i, F.lit(4)).cast("int"))
    m = F.struct(F.col("text").alias("content"), kind.alias("type"), F.when(i % 2 == 0, 70.5).alias("priority"))
    answer = F.concat(F.lit("Sure. "), F.to_json(F.array(F.struct(F.when(i % 3 > 0, F.col("source")).alias("scene_name"), F.array(m).alias("memories")))), F.lit(" ok"))
    return extract.parse_memories(read(spark, sf, "documents").select(i, answer.alias("answer"))).select("doc_id", F.md5("content").alias("content"), "type", "priority", "scene_name")


@register("SELECT doc_id, 'r' || doc_id AS record_id, ['store', 'skip', 'update', 'merge'][doc_id % 5 + 1] AS action, CASE WHEN doc_id % 2 = 0 THEN 'persona' END AS merged_type FROM documents WHERE doc_id % 5 < 4")
def scl_j04_decisions(spark, sf):
    i = F.col("doc_id")
    action = F.get(F.array(*(F.lit(x) for x in ("store", "skip", "update", "merge", "odd"))), F.pmod(i, F.lit(5)).cast("int"))
    answer = _array(F.concat(F.lit("r"), i).alias("record_id"), action.alias("action"), F.when(i % 2 == 0, "preference").alias("merged_type"))
    return extract.parse_decisions(read(spark, sf, "documents").select(i, answer.alias("answer"))).select("doc_id", "record_id", "action", "merged_type")


@register("SELECT doc_id, 'c' || doc_id AS tool_call_id, source AS summary, CASE WHEN doc_id % 2 = 0 THEN 7.5 ELSE 5.0 END::double AS score FROM documents WHERE doc_id % 3 > 0")
def scl_j05_summaries(spark, sf):
    i = F.col("doc_id")
    answer = F.concat(F.lit("```json\n"), _array(F.when(i % 3 > 0, F.concat(F.lit("c"), i)).alias("tool_call_id"), F.col("source").alias("summary"), F.when(i % 2 == 0, 7.5).alias("score")), F.lit("\n```"))
    return answers.summaries(read(spark, sf, "documents").select(i, answer.alias("answer"))).select("doc_id", "tool_call_id", "summary", "score")


@register("SELECT doc_id, doc_id % 2 = 0 AS task_completed, doc_id % 3 = 0 AS is_long_task, CASE WHEN doc_id % 3 > 0 THEN source END AS new_label FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def scl_j05_judgements(spark, sf):
    i = F.col("doc_id")
    answer = F.to_json(F.struct(F.when(i % 2 == 0, True).alias("taskCompleted"), F.when(i % 3 == 0, True).alias("isLongTask"), F.when(i % 3 > 0, F.col("source")).alias("newTaskLabel")))
    return answers.judgements(read(spark, sf, "documents").select(i, answer.alias("answer"))).select("doc_id", "task_completed", "is_long_task", "new_label")


@register("SELECT doc_id, doc_id % 2 = 0 AS replace, CASE WHEN doc_id % 2 = 1 THEN 'flowchart ' || source END AS content, CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE 0 END AS start_line, 'n' || doc_id AS node FROM documents")
def scl_j05_diagrams(spark, sf):
    i = F.col("doc_id")
    block = F.struct(i.cast("string").alias("start_line"), (i + 1).alias("end_line"), F.lit("x").alias("content"))
    answer = F.to_json(F.struct(F.when(i % 2 == 0, "replace").alias("file_action"), F.when(i % 2 == 1, F.concat(F.lit("```mermaid\nflowchart "), "source", F.lit("\n```"))).alias("mmd_content"), F.when(i % 2 == 0, F.array(block)).alias("replace_blocks"), F.create_map(F.lit("a"), F.concat(F.lit("n"), i)).alias("node_mapping")))
    out = answers.diagrams(read(spark, sf, "documents").select(i, answer.alias("answer")))
    return out.select("doc_id", "replace", "content", F.coalesce(F.get("blocks", F.lit(0))["start_line"], F.lit(0)).alias("start_line"), F.col("nodes")["a"].alias("node"))


def _raw_messages(spark, sf):
    """Turns as JSON messages: plain, in blocks, and wrapped."""
    c = read(spark, sf, "conversations")
    kind = F.col("turn") % 3
    call = F.to_json(F.struct(F.lit("tool_use").alias("type"), F.concat(F.lit("t_"), "turn").alias("id")))
    text = F.to_json(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    plain = F.to_json(F.struct("role", F.col("text").alias("content"), F.lit(1).alias("details")))
    blocks = F.concat(F.lit('{"role": "assistant", "content": ['), text, F.lit(","), call, F.lit("]}"))
    tool = F.concat(F.lit('{"message": {"role": "tool", "toolCallId": "t'), "turn", F.lit('", "content": '), F.to_json(F.array("text")).substr(F.lit(2), F.length(F.to_json(F.array("text"))) - 2), F.lit("}}"))
    return c.select("conv_id", "turn", "text", F.when(kind == 0, plain).when(kind == 1, blocks).otherwise(tool).alias("m"))


@register("SELECT conv_id, turn, md5(text) AS content, CASE turn % 3 WHEN 0 THEN role WHEN 1 THEN 'assistant' ELSE 'tool' END AS role, CASE WHEN turn % 3 = 2 THEN 't' || turn END AS tool, CASE WHEN turn % 3 = 1 THEN 't_' || turn ELSE '' END AS calls FROM conversations")
def scl_j06_message_views(spark, sf):
    m = F.col("m")
    return _raw_messages(spark, sf).select("conv_id", "turn", F.md5(messages.text_content(m)).alias("content"), messages.role(m).alias("role"), messages.result_id(m).alias("tool"), F.array_join(messages.call_ids(m), ",").alias("calls"))


@register("SELECT event_id, event_id % 6 IN (1, 3, 5) AS ok FROM events")
def scl_j07_truth(spark, sf):
    value = F.get(F.array(*(F.lit(x) for x in ("0", "true", '""', '"x"', "[]", "[0]"))), F.pmod("event_id", F.lit(6)).cast("int"))
    return read(spark, sf, "events").select("event_id", messages.truthy(value).alias("ok"))


@register("SELECT conv_id, turn, md5(CASE WHEN turn % 3 = 2 THEN 'note ' || turn ELSE text END) AS content, CASE WHEN turn % 3 = 2 THEN 'true' END AS marked FROM conversations")
def scl_j10_replaced(spark, sf):
    rows = _raw_messages(spark, sf).withColumn("m", messages.replace_result(F.col("m"), F.concat(F.lit("note "), "turn"), F.concat(F.lit("t_"), "turn")))
    return rows.select("conv_id", "turn", F.md5(messages.text_content(F.col("m"))).alias("content"), F.get_json_object("m", "$._offloaded").alias("marked"))


@register("SELECT conv_id, turn, true AS clean FROM conversations")
def prj04_tracked(spark, sf):
    return _raw_messages(spark, sf).select("conv_id", "turn", F.get_json_object(messages.tracked(F.col("m")), "$.details").isNull().alias("clean"))


# ---- decisions on transcripts, and states of sessions


@register("WITH e AS (SELECT doc_id, quality, toxic FROM labels) SELECT doc_id, CASE WHEN quality = 1 THEN 'sum ' || doc_id ELSE md5(text) END AS content FROM documents LEFT JOIN e USING (doc_id) WHERE toxic IS DISTINCT FROM 1")
def trx02_reapply(spark, sf):
    m = read(spark, sf, "documents").select("doc_id", F.concat(F.lit("t_"), "doc_id").alias("tool_id"), F.md5("text").alias("content"))
    e = read(spark, sf, "labels").select(F.concat(F.lit("t"), "doc_id").alias("tool_call_id"), F.concat(F.lit("sum "), "doc_id").alias("summary"), F.when(F.col("toxic") == 1, "deleted").when(F.col("quality") == 1, "true").alias("offloaded"))
    return transcript.reapply(m, e).select("doc_id", "content")


@register("WITH n AS (SELECT user_id, event_id, row_number() OVER w AS n, count(*) OVER (PARTITION BY user_id) AS size FROM events WHERE event_id % 5 > 0 WINDOW w AS (PARTITION BY user_id ORDER BY ts, cast(event_id AS varchar))) SELECT event_id, (n - 1) // 5 AS chunk FROM n WHERE n <= 20 AND size >= 4")
def str20_flush_chunks(spark, sf):
    e = read(spark, sf, "events").select("event_id", F.col("user_id").alias("session_id"), F.col("ts").alias("timestamp"), F.col("event_id").cast("string").alias("tool_call_id"), F.lit("{}").alias("params"), F.lit("{}").alias("result"))
    return offload.ready(e, e.where("event_id % 5 = 0")).select("event_id", F.col("chunk").cast("long").alias("chunk"))


@register("SELECT cast(user_id AS varchar) AS session_id, event_id // 50 AS start_index, coalesce(arg_max(CASE WHEN event_id % 3 = 0 THEN 'long' WHEN event_id % 3 = 1 THEN 'short' ELSE '' END, event_id), '') AS result FROM events GROUP BY ALL")
def str21_boundaries(spark, sf):
    i = F.col("event_id")
    j = read(spark, sf, "events").select(F.col("user_id").cast("string").alias("session_id"), F.floor(i / 50).alias("start_index"), i.alias("seq"), F.when(i % 3 == 0, "long").when(i % 3 == 1, "short").otherwise("").alias("result"), F.lit(None).cast("string").alias("target"))
    return offload.boundaries(j).select("session_id", "start_index", "result")


_STATE_SQL = "SELECT cast(user_id AS varchar) AS k, count(*) AS c, max(event_id) AS a, CASE user_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 4 END AS w FROM events GROUP BY user_id"


def _schedule(spark, sf):
    user = F.col("user_id")
    e = read(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("conversation_count"), F.max("event_id").alias("last_active"))
    warm = F.when(user % 4 == 0, 0).when(user % 4 == 1, 1).when(user % 4 == 2, 2).otherwise(4)
    null = lambda t: F.lit(None).cast(t)
    return e.select(
        user.cast("string").alias("session_key"), "conversation_count", F.lit(3).cast("long").alias("buffered"), "last_active", warm.cast("long").alias("warmup_threshold"), F.lit(1).cast("long").alias("l2_pending_l1_count"),
        F.when(user % 2 == 0, 5_000).cast("long").alias("l1_due"), (user % 6).cast("int").alias("l1_retries"), F.when(user % 3 == 0, 9_000).cast("long").alias("l2_due"), F.when(user % 3 == 0, "max").alias("l2_source"),
        F.when(user % 5 == 0, 9_500).cast("long").alias("l2_last_run"), null("string").alias("l2_cursor"),
    )


_TIMES = schedule.Times(every=5, warmup=True, idle=100, delay=50, least=1000, most=2000, active=4000)


@register(f"SELECT k AS session_key, c + 2 AS conversation_count, CASE WHEN c + 2 >= CASE WHEN w > 0 THEN least(w, 5) ELSE 5 END THEN 10000 ELSE 10100 END AS l1_due, 5 AS buffered FROM ({_STATE_SQL}) WHERE cast(k AS bigint) % 2 = 0 UNION ALL SELECT k, c, NULL, 3 FROM ({_STATE_SQL}) WHERE cast(k AS bigint) % 2 = 1 UNION ALL SELECT 'new', 1, 10000, 2")
def str03_notified(spark, sf):
    states = _schedule(spark, sf)
    came = states.where("cast(session_key as bigint) % 2 = 0").select("session_key", F.lit(2).cast("long").alias("conversations"), F.lit(2).cast("long").alias("messages")).union(spark.createDataFrame([("new", 1, 2)], "session_key string, conversations long, messages long"))
    return schedule.notified(states, came, 10_000, _TIMES).select("session_key", "conversation_count", "l1_due", "buffered")


@register(f"""SELECT k AS session_key, CASE WHEN ok THEN c ELSE 1 END AS pending, CASE WHEN ok THEN 0 ELSE c END AS conversation_count, CASE WHEN ok AND w > 0 THEN CASE WHEN w * 2 >= 5 THEN 0 ELSE w * 2 END ELSE w END AS warmup_threshold,
    CASE WHEN ok THEN NULL WHEN u % 6 + 1 <= 5 THEN 40000 END AS l1_due, CASE WHEN ok THEN 0 ELSE u % 6 + 1 END AS l1_retries, CASE WHEN u % 3 = 0 THEN 9000 WHEN ok THEN greatest(10050, CASE WHEN u % 5 = 0 THEN 10500 ELSE 0 END) END AS l2_due FROM (SELECT *, cast(k AS bigint) AS u, cast(k AS bigint) % 7 > 2 AS ok FROM ({_STATE_SQL}))""")
def str29_extracted(spark, sf):
    states = _schedule(spark, sf)
    done = states.select("session_key", (F.col("session_key").cast("long") % 7 > 2).alias("ok"), F.lit(3).cast("long").alias("taken"))
    return schedule.extracted(states, done, 10_000, _TIMES).select("session_key", F.col("l2_pending_l1_count").alias("pending"), "conversation_count", "warmup_threshold", "l1_due", F.col("l1_retries").cast("long").alias("l1_retries"), "l2_due")


@register(f"SELECT k AS session_key, CASE WHEN cast(k AS bigint) % 2 = 0 THEN 1 ELSE 0 END AS l1, CASE WHEN cast(k AS bigint) % 3 = 0 AND 10000 - a < 4000 THEN 1 ELSE 0 END AS l2 FROM ({_STATE_SQL})")
def str28_due(spark, sf):
    states = _schedule(spark, sf)
    a, b = schedule.due_extractions(states, 10_000).withColumn("l1", F.lit(1)), schedule.due_scenes(states, 10_000, _TIMES)[0].select("session_key", F.lit(1).alias("l2"))
    return states.select("session_key").join(a, "session_key", "left").join(b, "session_key", "left").select("session_key", F.coalesce("l1", F.lit(0)).alias("l1"), F.coalesce("l2", F.lit(0)).alias("l2"))


@register(f"SELECT k AS session_key, greatest(c, 1) AS pending, 0 AS conversation_count, greatest(10050, CASE WHEN cast(k AS bigint) % 5 = 0 THEN 10500 ELSE 0 END) AS l2_due FROM ({_STATE_SQL})")
def str13_restored(spark, sf):
    return schedule.restored(_schedule(spark, sf), 10_000, _TIMES).select("session_key", F.col("l2_pending_l1_count").alias("pending"), "conversation_count", "l2_due")


@register(f"SELECT k AS session_key, CASE WHEN ok THEN 0 ELSE 1 END AS pending, CASE WHEN ok THEN 10000 WHEN u % 5 = 0 THEN 9500 END AS last_run, 12000 AS l2_due FROM (SELECT *, cast(k AS bigint) AS u, cast(k AS bigint) % 4 > 0 AND NOT (cast(k AS bigint) % 3 = 0 AND cast(k AS bigint) % 5 <> 0) AS ok FROM ({_STATE_SQL}))")
def str30_scenes_done(spark, sf):
    states = _schedule(spark, sf)
    user = F.col("session_key").cast("long")
    done = states.select("session_key", (user % 4 > 0).alias("ok"), (user % 3 == 0).alias("skipped"), F.lit(None).cast("string").alias("cursor"))
    return schedule.scenes_done(states, done, 10_000, "t", _TIMES)[0].select("session_key", F.col("l2_pending_l1_count").alias("pending"), F.col("l2_last_run").alias("last_run"), "l2_due")


@register(f"WITH {L0_SQL} SELECT session_key, greatest(max(timestamp), CASE WHEN cast(session_key AS bigint) % 2 = 0 THEN 5000000 ELSE 0 END) AS last_captured_timestamp FROM l0 GROUP BY session_key")
def str02_advance_cursors(spark, sf):
    l0 = views.l0(spark, sf)
    known = l0.where(F.col("session_key").cast("long") % 2 == 0).select("session_key", F.lit(5_000_000).cast("long").alias("last_captured_timestamp")).distinct()
    return capture.advance(known, l0)


# ---- host transcripts and captures


def _host(spark, sf):
    """Orders as a user's and an assistant's message with tool parts: one for each line of the order."""
    null = F.lit(None).cast("string")
    one = lambda **given: F.struct(*(given.get(n, null if n not in ("ignored", "synthetic") else F.lit(None).cast("boolean")).alias(n) for n in ("id", "type", "text", "call_id", "tool", "status", "input", "output", "error", "ignored", "synthetic", "kind"))).cast(host.PART)
    # an order and its lines meet once, as narrow rows; all that follows stays where its session is
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.coalesce(F.col("l_returnflag") == "R", F.lit(False)).alias("running"), "l_linestatus").alias("line")
    lines = read(spark, sf, "lineitem").where("l_orderkey is not null").select(F.col("l_orderkey").cast("string").alias("session_id"), line)
    orders = read(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("session_id"), F.struct("o_orderpriority").alias("order"))
    both = orders.unionByName(lines, allowMissingColumns=True).groupBy("session_id").agg(F.collect_list("order").alias("orders"), F.array_sort(F.collect_list("line")).alias("lines"))

    def part(r):
        call = F.concat_ws("-", "session_id", r["l_linenumber"], r["l_partkey"], r["l_suppkey"])
        return one(id=call, type=F.lit("tool"), call_id=call, tool=F.lit("ship"), status=F.when(r["running"], "running").otherwise("completed"), output=r["l_linestatus"])

    message = lambda pos, of, role, parts: F.struct(F.lit(pos).cast("long").alias("pos"), F.concat(F.lit(of), "session_id").alias("id"), F.lit(role).alias("role"), parts.alias("parts"))
    asked = F.transform("orders", lambda o: message(0, "u", "user", F.array(one(type=F.lit("text"), text=o["o_orderpriority"]))))
    answer = message(1, "a", "assistant", F.concat(F.array(one(type=F.lit("text"), text=F.lit("done"))), F.transform("lines", part)))
    answered = (F.size("orders") > 0) & (F.size("lines") > 0)
    return both.select("session_id", F.inline(F.concat(asked, F.filter(F.array(answer), lambda _: answered))))


_CALLS_SQL = "c AS (SELECT l_orderkey, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, l_linestatus, l_returnflag, l_linenumber, l_partkey, l_suppkey FROM lineitem SEMI JOIN orders ON l_orderkey = o_orderkey)"


@register(f"""WITH {_CALLS_SQL} SELECT cast(o_orderkey AS varchar) AS session_id, 'user' AS role, o_orderpriority AS content, NULL AS tool_id, 0 AS calls FROM orders
    UNION ALL SELECT cast(l_orderkey AS varchar), 'assistant', 'done', NULL, count(*) FROM c GROUP BY l_orderkey UNION ALL SELECT cast(l_orderkey AS varchar), 'tool', l_linestatus, id, 0 FROM c WHERE l_returnflag <> 'R'""")
def scl_j11_canonical(spark, sf):
    return host.canonical(_host(spark, sf)).select("session_id", "role", "content", "tool_id", F.size("tool_calls").cast("long").alias("calls"))


@register(f"""WITH {_CALLS_SQL}, k AS (SELECT l_orderkey, string_agg(CASE WHEN l_linestatus = 'O' THEN 'short' ELSE l_linestatus END, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS outputs FROM c WHERE l_returnflag = 'A' GROUP BY l_orderkey)
    SELECT cast(l_orderkey AS varchar) AS session_id, coalesce(outputs, '') AS outputs FROM (SELECT DISTINCT l_orderkey FROM c) LEFT JOIN k USING (l_orderkey)""")
def join09_merged(spark, sf):
    given = _host(spark, sf)
    gone = read(spark, sf, "lineitem").where("l_returnflag = 'N'").select(F.col("l_orderkey").cast("string").alias("session_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("call"))
    gone = gone.groupBy("session_id").agg(F.collect_list("call").alias("gone"))
    rows = host.canonical(given)
    stays = ~F.coalesce(F.array_contains("gone", F.col("tool_id")), F.lit(False))
    kept = rows.where("role <> 'user'").join(gone, "session_id", "left").where(stays).select(*rows.columns)
    kept = kept.withColumn("content", F.when((F.col("role") == "tool") & (F.col("content") == "O"), "short").otherwise(F.col("content")))
    tools = F.filter("parts", lambda p: p["type"] == "tool")
    return host.merged(given, kept).select("session_id", F.array_join(F.transform(tools, lambda p: p["output"]), ",").alias("outputs"))


@register(f"WITH {L0_SQL} SELECT record_id FROM l0 WHERE role IN ('user', 'assistant') AND strlen({_T}) >= 3 AND NOT starts_with({_T}, '/') AND NOT starts_with({_T}, '!') AND NOT contains({_T}, 'HEARTBEAT') AND NOT contains({_T}, 'heartbeat') AND NOT starts_with(session_key, '1')")
def str01_captured(spark, sf):
    l0 = views.l0(spark, sf).withColumn("session_key", F.when(F.col("session_key").startswith("1"), F.concat(F.lit("temp:"), "session_key")).otherwise(F.col("session_key")))
    return capture.prepare(l0).select("record_id")


@register("SELECT 'a' AS name, count(*) AS n, bool_and(true) AS ok FROM embeddings")
def snk16_export(spark, sf):
    path = _work(spark, "export")
    export.export({"a": read(spark, sf, "embeddings")}, path)
    got = spark.read.json(f"{path}/a")
    return got.agg(F.lit("a").alias("name"), F.count(F.lit(1)).alias("n"), F.lit("embedding" not in got.columns).alias("ok"))


@register(f"WITH {L1_SQL} SELECT record_id, type, CASE cast(record_id AS bigint) % 3 WHEN 0 THEN metadata_json WHEN 1 THEN '[1]' ELSE '{{}}' END AS metadata, timestamp_str AS time FROM l1")
def prj05_memory_records(spark, sf):
    hits = views.l1(spark, sf).withColumn("metadata_json", F.when(F.col("record_id").cast("long") % 3 == 0, F.col("metadata_json")).when(F.col("record_id").cast("long") % 3 == 1, "[1]").otherwise("{"))
    return query.memory_records(hits).select("record_id", "type", "metadata", F.element_at("timestamps", 1).alias("time"))


@register("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN 'p' ELSE '' END AS prepend, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'password=[REDACTED]' ELSE c_name END AS append FROM customer")
def prj08_recall_parts(spark, sf):
    k = F.col("c_custkey")
    body = F.when(k % 3 == 0, F.to_json(F.struct(F.col("c_name").alias("context")))).when(k % 3 == 1, F.to_json(F.struct(F.lit("p").alias("prependContext"), F.lit("password=x").alias("append_system_context")))).otherwise(F.to_json(F.struct(F.col("c_name").alias("context"), F.lit(2).alias("memory_count"))))
    return read(spark, sf, "customer").select(k, messages.recall_parts(body).alias("r")).select("c_custkey", "r.prepend", "r.append")


@register(f"WITH {L1_SQL}, lx AS (SELECT * FROM l1 WHERE type <> 'persona'), {_bm25_sql('lx', 'content', 10)} SELECT record_id, round(score, 9) AS score FROM bm")
def top01_kept_index(spark, sf):
    """An index that took all facts, a third of them first with another's text, and lost another third."""
    facts, index = views.l1(spark, sf), fulltext.Index(spark, _work(spark, "index"))
    first = facts.withColumn("content", F.when(F.col("type") == "episodic", F.concat_ws(" ", F.lit(ASKED), "content")).otherwise(F.col("content")))
    index.upsert(first, "record_id", "content")
    index.upsert(facts.where("type = 'episodic'"), "record_id", "content")
    index.delete(facts.where("type = 'persona'"), "record_id")
    return index.search(ASKED, 10).select(F.col("id").alias("record_id"), F.round("score", 9).alias("score"))


_SIDES_SQL = """b AS (SELECT cast(doc_id AS varchar) AS id, md5(text) AS m, 3 AS v FROM documents WHERE doc_id % 5 <> 0),
    o AS (SELECT cast(doc_id AS varchar) AS id, CASE WHEN doc_id % 3 = 0 THEN md5(lang || text) ELSE md5(text) END AS m FROM documents WHERE doc_id % 7 <> 0),
    r AS (SELECT cast(doc_id AS varchar) AS id, CASE WHEN doc_id % 4 = 0 THEN md5(source || text) WHEN doc_id % 6 = 0 THEN md5(lang || text) ELSE md5(text) END AS m, 4 AS v FROM documents WHERE doc_id % 11 <> 0),
    p AS (SELECT id, b.m AS bm, o.m AS om, r.m AS rm, b.v AS bv, r.v AS rv, CASE WHEN o.m IS NOT DISTINCT FROM r.m THEN 'none' WHEN r.m IS NOT DISTINCT FROM b.m THEN CASE WHEN o.m IS NULL THEN 'delete' ELSE 'push' END
        WHEN o.m IS NOT DISTINCT FROM b.m THEN CASE WHEN r.m IS NULL THEN 'remove' ELSE 'pull' END ELSE 'conflict' END AS action FROM b FULL JOIN o USING (id) FULL JOIN r USING (id))"""


def _reconciled(spark, sf):
    """Documents as profiles: a baseline without a fifth, and two sides that changed and lost some."""
    d, n, t = read(spark, sf, "documents"), F.col("doc_id"), F.col("text")
    side = lambda where, digest, v: d.where(where).select(n.cast("string").alias("id"), digest.alias("content_md5"), F.lit(v).alias("version"))
    new, other = F.md5(F.concat("lang", "text")), F.md5(F.concat("source", "text"))
    return store.reconcile(side(n % 5 != 0, F.md5(t), 3), side(n % 7 != 0, F.when(n % 3 == 0, new).otherwise(F.md5(t)), 0), side(n % 11 != 0, F.when(n % 4 == 0, other).when(n % 6 == 0, new).otherwise(F.md5(t)), 4))


@register(f"WITH {_SIDES_SQL} SELECT id, action, bm AS base_md5, om AS local_md5, rm AS remote_md5 FROM p")
def snk14_reconciled(spark, sf):
    return _reconciled(spark, sf).select("id", "action", "base_md5", "local_md5", "remote_md5")


@register(f"WITH {_SIDES_SQL}, n AS (SELECT id, CASE action WHEN 'conflict' THEN bm WHEN 'delete' THEN NULL WHEN 'push' THEN om ELSE rm END AS content_md5, CASE action WHEN 'conflict' THEN bv WHEN 'push' THEN greatest(coalesce(rv, 0), coalesce(bv, 0)) + 1 ELSE rv END AS version FROM p) SELECT id, content_md5, cast(version AS bigint) AS version FROM n WHERE content_md5 IS NOT NULL")
def src10_next_baseline(spark, sf):
    return store.after_sync(_reconciled(spark, sf))


@register(f"""WITH {TRANSCRIPT_SQL}, o AS (SELECT *, row_number() OVER w - 1 AS n, count(*) OVER (PARTITION BY session_id) AS size FROM (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY pos) > 1) WINDOW w AS (PARTITION BY session_id ORDER BY pos)),
    e AS (SELECT session_id, size, max(CASE WHEN role = 'user' THEN n END) AS u, coalesce(max(CASE WHEN role NOT IN ('tool', 'toolResult', 'assistant') THEN n END) + 1, 0) AS run FROM o GROUP BY session_id, size),
    pl AS (SELECT session_id, CASE WHEN size <= 2 THEN 0 WHEN u >= size // 2 THEN u + 1 ELSE least(greatest(run, size - 30), size - 1) END AS place FROM e)
    SELECT s.session_id, cast(coalesce(place, 0) AS bigint) AS place FROM (SELECT DISTINCT session_id FROM t) s LEFT JOIN pl USING (session_id)""")
def win14_reinserted(spark, sf):
    """Each session's first message as an injected one that is put in its place again."""
    t = views.transcript(spark, sf)
    first = F.row_number().over(Window.partitionBy("session_id").orderBy("pos")) == 1
    rows = transcript.reinserted(t.withColumn("injected", first).withColumn("context", F.when(F.col("injected"), "active")))
    return rows.where("injected").select("session_id", F.col("pos").cast("long").alias("place"))


@register(f"WITH {L0_SQL} SELECT record_id, md5(message_text) AS content, timestamp FROM l0 WHERE session_key = '7' OR timestamp >= (SELECT max(timestamp) FROM l0) - 20000000")
def src01_daily_logs(spark, sf):
    """All messages as daily logs; one session's, and the last ones of all, are read."""
    path, l0 = _work(spark, "daily"), views.l0(spark, sf)
    logs.append_messages(l0, path)
    last = l0.agg(F.max("timestamp")).first()[0] - 20_000_000
    got = logsource.read(spark, path, since=last).unionByName(logsource.read(spark, path, session="7", until=last - 1))
    return got.select("record_id", F.md5("message_text").alias("content"), "timestamp")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search over raw messages: BM25 and cosine neighbours, fused, filtered, limited."""
    messages = views.l0(spark, sf_dir)
    near = views.vectors(spark, sf_dir).withColumn("record_id", F.concat(F.col("record_id"), F.lit("-0")))
    return search.search_conversations(messages, ASKED, 10, near, _asked_vector(spark, sf_dir))
