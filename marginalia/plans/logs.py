"""Queries: merges, audits, sessions, evaluation, model payloads, event windows."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluate, maintain, matching, payloads, search_index
from ..operators import sessions as S
from ..streaming import events as E
from .base import Tables, query, values

#: Lines of orders that a task pairs, about.
LINES = 1 << 19

_DAY = "CAST(day(ts) AS BIGINT)"


def _seen(t: Tables, kinds: str):
    return t.events.filter(kinds).select(F.col("user_id").alias("entity_id"), F.dayofmonth("ts").alias("first_chapter_number"))


@query("upsert_min_merge", f"SELECT user_id AS entity_id, min({_DAY}) AS first_chapter_number FROM events GROUP BY user_id")
def upsert_min_merge(t: Tables):
    return maintain.merge_first_seen(_seen(t, "event_type = 'view'"), _seen(t, "event_type <> 'view'"), ["entity_id"])


@query(
    "insert_ignore_antijoin",
    "WITH o AS (SELECT DISTINCT user_id, 'old' AS origin FROM events WHERE event_type = 'signup'), n AS (SELECT DISTINCT user_id, 'new' AS origin FROM events WHERE event_type = 'error' AND user_id NOT IN (SELECT user_id FROM o)) SELECT * FROM o UNION ALL SELECT * FROM n",
)
def insert_ignore_antijoin(t: Tables):
    rows = lambda kind, origin: t.events.filter(F.col("event_type") == kind).select("user_id", F.lit(origin).alias("origin"))
    return maintain.insert_missing(rows("signup", "old").distinct(), rows("error", "new"), ["user_id"])


@query("tombstone_antijoin", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def tombstone_antijoin(t: Tables):
    audit = t.labels.select("doc_id", F.when(F.col("toxic") == 1, "rejected").otherwise("confirmed").alias("status"))
    return maintain.without_rejected(t.documents.select("doc_id", "lang"), audit, ["doc_id"])


_AUDIT = "a AS (SELECT d.lang AS record_kind, CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'confirmed' ELSE 'pending' END AS status, l.doc_id FROM labels l JOIN documents d USING (doc_id))"


def _audit(t: Tables):
    status = F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "confirmed").otherwise("pending")
    return t.labels.join(t.documents.select("doc_id", F.col("lang").alias("record_kind")), "doc_id").withColumn("status", status)


@query("audit_stats", f"WITH {_AUDIT} SELECT record_kind, status, count(*) AS n FROM a GROUP BY ROLLUP (record_kind, status)")
def audit_stats(t: Tables):
    return maintain.audit_stats(_audit(t))


@query("audit_pivot", f"WITH {_AUDIT} SELECT record_kind, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'confirmed') AS confirmed, count(*) FILTER (status = 'rejected') AS rejected FROM a GROUP BY record_kind")
def audit_pivot(t: Tables):
    return maintain.audit_pivot(_audit(t), ["pending", "confirmed", "rejected"])


@query("audit_untracked", f"WITH {_AUDIT}, t AS (SELECT lang AS record_kind, count(*) AS n FROM documents GROUP BY lang), k AS (SELECT record_kind, count(*) AS k FROM a WHERE status <> 'rejected' GROUP BY record_kind) SELECT record_kind, greatest(0, n - coalesce(k, 0)) AS legacy_untracked FROM t LEFT JOIN k USING (record_kind)")
def audit_untracked(t: Tables):
    totals = t.documents.groupBy(F.col("lang").alias("record_kind")).agg(F.count("*").alias("dynamic_total"))
    return maintain.untracked(totals, _audit(t).filter("status <> 'rejected'").groupBy("record_kind").agg(F.count("*").alias("tracked")))


@query(
    "review_transition",
    f"""WITH {_AUDIT}, r AS (SELECT doc_id AS audit_id, status, 'e' || doc_id AS evidence, '' AS original_evidence, doc_id % 3 AS review_version,
  CASE doc_id % 4 WHEN 0 THEN 'confirm' WHEN 1 THEN 'correct' WHEN 2 THEN 'reject' END AS action, doc_id % 2 AS expected FROM a),
o AS (SELECT *, CASE WHEN action IS NULL THEN 'none' WHEN expected <> review_version THEN 'stale' WHEN status = 'rejected' THEN 'invalid' ELSE 'applied' END AS outcome FROM r)
SELECT audit_id, CASE WHEN outcome <> 'applied' THEN status WHEN action = 'reject' THEN 'rejected' WHEN action = 'confirm' THEN 'confirmed' ELSE 'corrected' END AS status,
  CASE WHEN outcome = 'applied' AND action = 'correct' THEN 'fixed' ELSE evidence END AS evidence, CASE WHEN outcome = 'applied' AND action = 'correct' THEN evidence ELSE original_evidence END AS original_evidence,
  review_version + CASE WHEN outcome = 'applied' THEN 1 ELSE 0 END AS review_version, outcome FROM o""",
)
def review_transition(t: Tables):
    rows = _audit(t).select(F.col("doc_id").alias("audit_id"), "status", F.concat(F.lit("e"), "doc_id").alias("evidence"), F.lit("").alias("original_evidence"), (F.col("doc_id") % 3).alias("review_version"))
    action = F.when(F.col("audit_id") % 4 == 0, "confirm").when(F.col("audit_id") % 4 == 1, "correct").when(F.col("audit_id") % 4 == 2, "reject")
    actions = rows.select("audit_id", action.alias("action"), (F.col("audit_id") % 2).alias("expected_version"), F.lit("fixed").alias("evidence")).filter("action is not null")
    return maintain.review(rows, actions)


@query(
    "refcount_repair",
    """WITH m AS (SELECT o_custkey AS c_custkey, CAST(year(o_orderdate) AS BIGINT) AS ch FROM orders WHERE o_orderstatus <> 'F'), k AS (SELECT c_custkey, min(ch) AS first_chapter_number, count(*) AS mention_count FROM m GROUP BY c_custkey),
p AS (SELECT c.c_custkey, first_chapter_number, coalesce(mention_count, 0) AS mention_count FROM customer c LEFT JOIN k USING (c_custkey))
SELECT * FROM p WHERE mention_count > 0 OR c_custkey IN (SELECT o_custkey FROM orders)""",
)
def refcount_repair(t: Tables):
    live = t.orders.filter("o_orderstatus <> 'F'").select(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("chapter_number"))
    parents = maintain.recount(t.customer.select("c_custkey"), live, "c_custkey")
    return maintain.without_orphans(parents, t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("latest_progress", "SELECT user_id, event_type, round(arg_max(value, {'t': ts, 'e': event_id}), 6) AS value FROM events GROUP BY user_id, event_type")
def latest_progress(t: Tables):
    return E.latest(t.events).withColumn("value", F.round("value", 6))


_TURNS = """m AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
turns AS (SELECT conv_id AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn_index, text AS question, CASE WHEN nr = 'assistant' THEN nt ELSE '' END AS answer FROM m WHERE role = 'user')"""


@query("session_turns", f"WITH {_TURNS} SELECT session_id, turn_index, question, coalesce(answer, '') AS answer FROM turns")
def session_turns(t: Tables):
    return S.turns_of(t.conversations)


@query("last_n_turns", f"WITH {_TURNS}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_index DESC) AS r FROM turns) SELECT session_id, turn_index, question FROM r WHERE r <= 2")
def last_n_turns(t: Tables):
    return S.last_turns(S.turns_of(t.conversations), 2).select("session_id", "turn_index", "question")


@query("turns_before", f"WITH {_TURNS} SELECT session_id, turn_index, question FROM turns WHERE session_id = 1 AND turn_index < 3")
def turns_before(t: Tables):
    return S.before_turn(S.turns_of(t.conversations), 1, 3).select("session_id", "turn_index", "question")


@query("session_rollup", f"WITH {_TURNS} SELECT session_id, count(*) AS turns, max(turn_index) AS last_turn, arg_max(question, turn_index) AS last_question FROM turns GROUP BY session_id")
def session_rollup(t: Tables):
    return S.rollup(S.turns_of(t.conversations))


_PREFIX = """x AS (SELECT coalesce(a.turn_index, b.turn_index) AS i, coalesce(a.question = b.question AND a.answer = b.answer, false) AS same FROM (SELECT * FROM turns WHERE session_id = 1) a FULL JOIN (SELECT * FROM turns WHERE session_id = 2) b ON a.turn_index = b.turn_index),
prefix AS (SELECT coalesce(min(i) FILTER (NOT same) - 1, max(i), 0) AS common FROM x)"""


@query("session_prefix_diff", f"WITH {_TURNS}, {_PREFIX} SELECT common FROM prefix")
def session_prefix_diff(t: Tables):
    return S.common_prefix(S.turns_of(t.conversations), 1, 2)


@query(
    "session_set_delta",
    """WITH a AS (SELECT DISTINCT event_type FROM events WHERE user_id = 1), b AS (SELECT DISTINCT event_type FROM events WHERE user_id = 2)
SELECT coalesce(a.event_type, b.event_type) AS event_type, CASE WHEN a.event_type IS NOT NULL AND b.event_type IS NOT NULL THEN 'shared' WHEN a.event_type IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS side FROM a FULL JOIN b ON a.event_type = b.event_type""",
)
def session_set_delta(t: Tables):
    return S.set_delta(t.events.filter("user_id = 1"), t.events.filter("user_id = 2"), "event_type")


@query(
    "session_merge_renumber",
    f"""WITH {_TURNS}, {_PREFIX}, u AS (SELECT 0 AS b, * FROM turns WHERE session_id = 1 UNION ALL SELECT 1, * FROM turns WHERE session_id = 2 AND turn_index > (SELECT common FROM prefix))
SELECT CAST(9 AS BIGINT) AS session_id, row_number() OVER (ORDER BY b, turn_index) AS turn_index, question, coalesce(answer, '') AS answer FROM u""",
)
def session_merge_renumber(t: Tables):
    turns = S.turns_of(t.conversations)
    return S.merge_branches(turns, 1, 2, S.common_prefix(turns, 1, 2).scalar(), 9)


def _calls(t: Tables):
    return t.events.select(F.col("user_id").alias("session_id"), F.col("event_type").alias("tool_name"), F.col("value").alias("elapsed_ms"), (F.col("event_type") == "error").alias("blocked"))


@query(
    "trace_summary",
    "SELECT user_id AS session_id, count(*) AS calls, count(*) FILTER (event_type = 'error') AS blocked, round(sum(value), 4) AS elapsed_ms, arg_max(event_type, {'v': value, 't': event_type}) AS slowest FROM events GROUP BY user_id",
)
def trace_summary(t: Tables):
    return S.trace_summary(_calls(t)).withColumn("elapsed_ms", F.round("elapsed_ms", 4))


@query(
    "session_digest",
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS c FROM events)
SELECT user_id AS session_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS intents, min(nullif(day(ts) % 7, 0)) AS least, max(nullif(day(ts) % 7, 0)) AS most, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY i) FILTER (i > c - 5) AS questions FROM n GROUP BY user_id""",
)
def session_digest(t: Tables):
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    turns = t.events.select(F.col("user_id").alias("session_id"), number.alias("turn_index"), F.col("event_id").cast("string").alias("question"), F.col("event_type").alias("intent"), (F.dayofmonth("ts") % 7).alias("progress"), F.array("event_type").alias("entities"), F.array("event_type").alias("tools"))
    d = S.digest(turns)
    return d.select("session_id", F.array_join("intents", ",").alias("intents"), "least", "most", F.array_join("questions", ",").alias("questions"))


@query(
    "recent_entity",
    """WITH e AS (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS turn_index, CASE WHEN event_type IN ('error', 'purchase') THEN event_type ELSE '' END AS entity FROM events)
SELECT session_id, turn_index, last_value(nullif(entity, '') IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY turn_index ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS recent_entity FROM e""",
)
def recent_entity(t: Tables):
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    turns = t.events.select(F.col("user_id").alias("session_id"), number.alias("turn_index"), F.when(F.col("event_type").isin("error", "purchase"), F.col("event_type")).otherwise("").alias("entity"))
    return S.recent_entity(turns).drop("entity")


_HITS = """b AS (SELECT item_id AS case_id, text AS whole FROM benchmark), rel AS (SELECT case_id, list(DISTINCT doc_id) AS relevant FROM b JOIN documents ON contains(text, whole) GROUP BY case_id),
q AS (SELECT 'whole' AS method, case_id, whole AS q FROM b JOIN rel USING (case_id) UNION ALL SELECT 'head', case_id, substr(whole, 1, 25) FROM b JOIN rel USING (case_id)),
qt AS (SELECT *, list_distinct(regexp_extract_all(lower(q), '[A-Za-z0-9_]+')) AS e, replace(q, ' ', '') AS bare FROM q), d AS (SELECT doc_id, replace(text, ' ', '') AS bare, list_distinct(regexp_extract_all(lower(text), '[A-Za-z0-9_]+')) AS d FROM documents),
m AS (SELECT method, case_id, doc_id, len(list_intersect(d, e)) AS hits, len(e) AS ne, len(d) AS nd, CASE WHEN contains(d.bare, qt.bare) THEN 0.25 ELSE 0 END AS bonus FROM qt, d WHERE len(e) > 0 AND len(d) > 0),
mm AS (SELECT *, max(hits) OVER (PARTITION BY method, case_id) AS most FROM m), s AS (SELECT *, hits / ne + hits / sqrt(nd) + bonus AS score FROM mm WHERE hits > 0 OR most = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY method, case_id, doc_id // 4 ORDER BY score DESC, doc_id) AS r FROM s WHERE score > 0), k AS (SELECT *, row_number() OVER (PARTITION BY method, case_id ORDER BY score DESC, doc_id) AS rank FROM p WHERE r = 1),
res AS (SELECT q.method, q.case_id, min(rank) FILTER (list_contains(relevant, doc_id)) AS first_rank, count(DISTINCT doc_id) FILTER (list_contains(relevant, doc_id)) / any_value(len(relevant)) AS recall,
  coalesce(bool_or(rank = 1 AND list_contains(relevant, doc_id)), false) AS top1 FROM q JOIN rel USING (case_id) LEFT JOIN (SELECT * FROM k WHERE rank <= 4) k ON k.method = q.method AND k.case_id = q.case_id GROUP BY q.method, q.case_id)"""


def _cases(t: Tables):
    """Cases: the benchmark passages that occur whole in documents, which are the relevant ones. Hits: what the library's lexical search finds for a whole passage, and for its first 25 characters."""
    chunks = t.documents.select(F.lit("all").alias("book_id"), F.floor(F.col("doc_id") / 4).cast("string").alias("parent_id"), F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").cast("int").alias("chapter_number"), "text")
    passages = t.benchmark.select(F.col("item_id").alias("case_id"), F.col("text").alias("surface"))
    met = matching.occurrences(t.documents.select("doc_id", "text"), "text", passages).join(passages, "surface")
    cases = met.groupBy("case_id").agg(F.collect_set(F.col("doc_id").cast("int")).alias("relevant")).persist(StorageLevel.DISK_ONLY)  # a row a case
    asked = passages.join(cases, "case_id", "left_semi").select("case_id", F.explode(F.create_map(F.lit("whole"), F.col("surface"), F.lit("head"), F.substring("surface", 1, 25))).alias("method", "query"))
    asked = asked.select(F.concat_ws(":", "method", "case_id").alias("query_id"), "method", "case_id", "query")
    hits = search_index.search_many(search_index.built(chunks), asked.select("query_id", "query")).join(asked.select("query_id", "method", "case_id"), "query_id")
    return cases, hits.select("method", "case_id", "rank", "chapter_number")


@query("eval_rank_metrics", f"WITH {_HITS} SELECT method, count(*) AS total_cases, round(avg(CAST(top1 AS INT)), 6) AS top1_accuracy, round(avg(recall), 6) AS recall_at_k, round(avg(coalesce(1.0 / first_rank, 0)), 6) AS mrr FROM res GROUP BY method")
def eval_rank_metrics(t: Tables):
    r = evaluate.report(evaluate.case_results(*_cases(t)))
    return r.select("method", "total_cases", *[F.round(c, 6).alias(c) for c in ("top1_accuracy", "recall_at_k", "mrr")])


@query("eval_gate", f"WITH {_HITS}, r AS (SELECT method, avg(CAST(top1 AS INT)) AS t, avg(coalesce(1.0 / first_rank, 0)) AS m FROM res GROUP BY method) SELECT method, 'top1' AS failure FROM r WHERE t < 0.95 UNION ALL SELECT method, 'mrr' FROM r WHERE m < 0.96")
def eval_gate(t: Tables):
    return evaluate.gate(evaluate.report(evaluate.case_results(*_cases(t))), 0.95, 0.96)


@query("eval_percentiles", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def eval_percentiles(t: Tables):
    return evaluate.percentiles(t.events, "event_type", "value")


@query("json_tolerant_parse", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_tolerant_parse(t: Tables):
    odd = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```"))).otherwise(F.col("props"))
    return t.events.select("event_id", payloads.tolerant(odd, "struct<k:bigint>")["k"].alias("k"))


_CUES = "translate(text, 'abcdefghijklmno', '攻击袭刺杀师父帮助救交换发现一')"


def _supported_sql(cues: dict) -> str:
    return "CASE kind " + " ".join(f"WHEN '{k}' THEN {' OR '.join(f"contains(evidence, '{x}')" for x in terms)}" for k, terms in cues.items()) + " ELSE false END"


_KINDS = [*payloads.RELATION_CUES, "不明"]


@query(
    "quality_gate",
    f"""WITH e AS (SELECT doc_id, [{', '.join(f"'{k}'" for k in _KINDS)}][CAST(doc_id % {len(_KINDS)} AS INT) + 1] AS kind, {_CUES} AS evidence FROM documents)
SELECT doc_id, kind, {_supported_sql(payloads.RELATION_CUES)} AS relation, kind = '冲突' AND NOT contains(evidence, '死') AS unproven FROM e""",
)
def quality_gate(t: Tables):
    """Whether documents, with letters as cue characters, bear out a type of relation that their ids pick; and a claim of a death that they don't have."""
    kinds = F.array(*map(F.lit, _KINDS))
    e = t.documents.select("doc_id", F.get(kinds, (F.col("doc_id") % len(_KINDS)).cast("int")).alias("kind"), F.translate("text", "abcdefghijklmno", "攻击袭刺杀师父帮助救交换发现一").alias("evidence"))
    death = (F.col("kind") == "冲突") & ~payloads.event_supported(F.lit("冲突/危机"), F.lit("死亡"), F.col("evidence"))
    return e.select("doc_id", "kind", payloads.relation_supported(F.col("kind"), F.col("evidence")).alias("relation"), death.alias("unproven"))


@query(
    "cjk_tokens",
    """WITH l AS (SELECT doc_id, lower(translate(text, 'abcdefghijkl', '一二三四五六七八九十百千')) AS t FROM documents), c AS (SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9_]+') AS w, regexp_extract_all(t, '[一-鿿]') AS c FROM l)
SELECT doc_id, len(list_distinct(list_concat(w, c, list_transform(range(1, len(c)), lambda i: c[i] || c[i + 1])))) AS n FROM c""",
)
def cjk_tokens(t: Tables):
    """Tokens of documents whose first twelve letters are CJK characters."""
    return t.documents.select("doc_id", F.size(T.tokens(F.translate("text", "abcdefghijkl", "一二三四五六七八九十百千"))).alias("n"))


@query(
    "llm_rerank_payload",
    """WITH i AS (SELECT doc_id, doc_id % 3 + 1 AS index, least(1.0, (doc_id % 7) / 4) AS relevance, 'r' || doc_id AS reason FROM documents UNION ALL SELECT doc_id, (doc_id + 1) % 3 + 1, 0.25, '' FROM documents),
h AS (SELECT doc_id AS query_id, index FROM documents, range(1, 4) AS r(index))
SELECT query_id, h.index, CAST(relevance AS DOUBLE) AS relevance, reason, row_number() OVER (PARTITION BY query_id ORDER BY relevance IS NULL, relevance DESC, h.index) AS rank FROM h LEFT JOIN i ON i.doc_id = query_id AND i.index = h.index""",
)
def llm_rerank_payload(t: Tables):
    """Rankings of three hits a document, told in JSON with a fence, a repeated index and one that isn't there."""
    item = lambda i, x, reason: F.concat(F.lit('{"index":'), i.cast("string"), F.lit(',"relevance":'), x.cast("string"), F.lit(',"reason":"'), reason, F.lit('"}'))
    first, second = F.col("doc_id") % 3 + 1, (F.col("doc_id") + 1) % 3 + 1
    items = [item(first, (F.col("doc_id") % 7) / 4, F.concat(F.lit(" r"), "doc_id", F.lit(" "))), item(F.lit(9), F.lit(0.5), F.lit("x")), item(first, F.lit(0.1), F.lit("again")), item(second, F.lit(0.25), F.lit(""))]
    answers = t.documents.select(F.col("doc_id").alias("query_id"), F.concat(F.lit('说明 ```json\n{"ranked_hits":['), F.concat_ws(",", *items), F.lit("]}\n```")).alias("answer"))
    hits = t.documents.select(F.col("doc_id").alias("query_id"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("index"))
    return payloads.apply_ranking(hits, payloads.rerank_items(answers, 3)).select("query_id", "index", "rank", "relevance", "reason")


@query("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY ALL")
def event_windows(t: Tables):
    return E.windowed(t.events).withColumn("v", F.round("v", 4))


@query(
    "event_sessions",
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 2 HOUR THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k""",
)
def event_sessions(t: Tables):
    return E.sessions(t.events)


@query("event_windows_sliding", "SELECT time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE * k AS start, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events, range(4) AS r(k) GROUP BY ALL")
def event_windows_sliding(t: Tables):
    return E.sliding(t.events).withColumn("v", F.round("v", 4))


@query(
    "event_follow_ups",
    """SELECT a.user_id, a.event_id AS first_id, a.ts AS first_ts, b.event_id AS then_id, b.ts AS then_ts FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 3 HOUR
WHERE a.event_type = 'view' AND b.event_type = 'purchase'""",
)
def event_follow_ups(t: Tables):
    """Purchases up to three hours after a view of the same user."""
    return E.followed(t.events.filter("event_type = 'view'"), t.events.filter("event_type = 'purchase'"), "3 hours")


@query("part_pairs", "SELECT a.l_partkey AS source, b.l_partkey AS target, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY ALL HAVING count(*) > 1")
def part_pairs(t: Tables):
    """Parts of one order as names of one sentence; an order has few parts. Tasks are as many as keep each at ``LINES`` lines, about, however large the table."""
    lines = t.lineitem.select("l_orderkey", F.col("l_partkey").alias("source"))
    tasks = max(16, -(-lines.count() // LINES))
    a = lines.repartition(tasks, "l_orderkey")
    pairs = a.join(a.withColumnRenamed("source", "target"), "l_orderkey").filter("source < target").select("source", "target")
    return pairs.repartition(tasks, "source", "target").groupBy("source", "target").agg(F.count("*").alias("n")).filter("n > 1")


@query(
    "market_rollup",
    "SELECT r_name, c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, c_mktsegment)",
)
def market_rollup(t: Tables):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.rollup("r_name", "c_mktsegment").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
