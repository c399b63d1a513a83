"""Queries: lists and single answers of a library, fragments and chains, the on-demand index, audit lists and repairs, session edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dynamic, library, retrieval
from ..operators import mentions as M
from ..operators import sessions as S
from .base import CHAPTERS_SQL, NAMES, Tables, query, values
from .index import _EVENTS, _PAIRS, _TRIM, BOUND, ENTITY, RELATIONS, _events, _windows
from .logs import _AUDIT, _TURNS, _audit

_SUMMARY = "CASE WHEN length({t}) > 140 THEN rtrim(substr({t}, 1, 140)) || '...' ELSE {t} END"
_SUMMARIES = f"summaries AS (SELECT book_id, chapter_number, {_SUMMARY.format(t='t')} AS summary FROM (SELECT book_id, chapter_number, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS t FROM chapters WHERE doc_id % 3 = 0))"


def _summaries(t: Tables):
    return t.chapters.filter("doc_id % 3 = 0").select("book_id", "chapter_number", T.summary(F.col("content")).alias("summary"))


@query("chapter_titles_with_summaries", f"WITH {CHAPTERS_SQL}, {_SUMMARIES} SELECT book_id, chapter_number, title, coalesce(summary, '') AS summary FROM chapters LEFT JOIN summaries USING (book_id, chapter_number)")
def chapter_titles_with_summaries(t: Tables):
    return library.titles_with_summaries(t.chapters, _summaries(t))


@query("chapter_summary_bounded", f"WITH {CHAPTERS_SQL}, {_SUMMARIES} SELECT book_id, chapter_number, chapter_number > 4 AS blocked, CASE WHEN chapter_number <= 4 THEN summary END AS summary FROM summaries WHERE chapter_number IN (3, 5)")
def chapter_summary_bounded(t: Tables):
    return library.chapter_summary(_summaries(t), 3, 4).unionByName(library.chapter_summary(_summaries(t), 5, 4))


@query("latest_chapters", "SELECT s.source AS book_id, coalesce(max(n), 0) AS latest FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, lang FROM documents) d ON d.source = s.source AND d.lang <> 'en' GROUP BY s.source")
def latest_chapters(t: Tables):
    some = t.chapters.join(t.documents.filter("lang <> 'en'").select("doc_id"), "doc_id")
    return library.latest_chapter(some, t.documents.select(F.col("source").alias("book_id")))


@query("entity_list", f"{ENTITY}, n AS (SELECT DISTINCT book_id, name FROM mentions) SELECT book_id, name, row_number() OVER (PARTITION BY book_id ORDER BY length(name) DESC, name) AS rank FROM n")
def entity_list(t: Tables):
    return library.name_list(M.rollup(M.mentions(t.chapters, t.names)))


_COUNTS = "chapters_n AS (SELECT source AS book_id, count(*) AS chapters FROM documents GROUP BY source), k AS (SELECT *, (SELECT count(*) FROM mentions m WHERE m.book_id = c.book_id) AS mentions, (SELECT count(DISTINCT name) FROM mentions m WHERE m.book_id = c.book_id) AS entities FROM chapters_n c)"


def _counts(t: Tables):
    found = M.mentions(t.chapters, t.names)
    return library.counts_by_kind({"chapters": t.documents.select(F.col("source").alias("book_id")), "mentions": found, "entities": M.rollup(found)})


@query("book_counts", f"{ENTITY}, {_COUNTS} SELECT * FROM k")
def book_counts(t: Tables):
    return _counts(t)


@query("library_totals", f"{ENTITY}, {_COUNTS} SELECT count(*) AS books, CAST(sum(chapters) AS BIGINT) AS chapters, CAST(sum(mentions) AS BIGINT) AS mentions, CAST(sum(entities) AS BIGINT) AS entities FROM k")
def library_totals(t: Tables):
    return library.totals(_counts(t))


@query(
    "titled_hits",
    f"""WITH {CHAPTERS_SQL}, h AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY chapter_number) AS rank FROM chapters WHERE contains(content, 'worthless'))
SELECT book_id, chapter_number, rank, CASE WHEN doc_id % 2 = 0 THEN title ELSE '第 ' || chapter_number || ' 章' END AS chapter_title FROM h WHERE rank <= 5""",
)
def titled_hits(t: Tables):
    chapters = t.chapters
    hits = retrieval.exact_search(chapters, "worthless", limit=5).select("book_id", "chapter_number", "rank")
    return library.with_titles(hits, chapters.withColumn("title", F.when(F.col("doc_id") % 2 == 0, F.col("title")).otherwise(" ")))


@query(
    "relation_fragments",
    f"""{_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY book_id, source, target, relation_type ORDER BY chapter_number, window_no, sentence) AS r FROM pairs)
SELECT book_id, source, target, relation_type, string_agg(sentence, '|' ORDER BY r) FILTER (r <= 3) AS fragments, (SELECT string_agg(c, ',' ORDER BY c) FROM (SELECT DISTINCT q.chapter_number AS c FROM pairs q WHERE q.book_id = r.book_id AND q.source = r.source AND q.target = r.target AND q.relation_type = r.relation_type)) AS chapters
FROM r GROUP BY book_id, source, target, relation_type""",
)
def relation_fragments(t: Tables):
    rows = library.relation_fragments(M.relations(_windows(t), RELATIONS))
    return rows.withColumns({"fragments": F.array_join("fragments", "|"), "chapters": F.array_join("chapters", ",")})


@query(
    "relation_near_fragments",
    f"""{ENTITY}, l AS (SELECT * FROM mentions WHERE name = 'thnt'), r AS (SELECT * FROM mentions WHERE name = 'eron'),
n AS (SELECT l.book_id, l.chapter_number, l.position, l.excerpt AS own, arg_min(r.excerpt, r.position) AS other FROM l JOIN r ON l.book_id = r.book_id AND l.chapter_number = r.chapter_number AND abs(l.position - r.position) <= 220 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY chapter_number, position) AS rank FROM n)
SELECT book_id, rank, chapter_number, CASE WHEN contains(own, 'eron') THEN own ELSE other END AS excerpt FROM k WHERE rank <= 3""",
)
def relation_near_fragments(t: Tables):
    return library.fragments_between(M.mentions(t.chapters, t.names), "thnt", "eron")


@query(
    "event_chain",
    f"""{_EVENTS}, g AS (SELECT book_id, count(*) AS n, first(summary ORDER BY chapter_number, window_no) AS a, last(summary ORDER BY chapter_number, window_no) AS b, min(chapter_number) AS i, max(chapter_number) AS j, list(DISTINCT event_type) AS types FROM events_found GROUP BY book_id),
h AS (SELECT *, list_filter(['choice', 'loss'], lambda x: list_contains(types, x)) AS kinds FROM g)
SELECT book_id, CASE WHEN len(kinds) > 0 THEN '命中' || array_to_string(kinds, '、') || '等阅读记忆链路。' ELSE '' END || CASE WHEN n = 1 THEN '第 ' || i || ' 章的关键事件是：' || a ELSE '事件链从第 ' || i || ' 章“' || substr(a, 1, 42) || '”推进到第 ' || j || ' 章“' || substr(b, 1, 42) || '”。' END AS chain FROM h""",
)
def event_chain(t: Tables):
    return library.event_chain(_events(t), ["book_id"], ("choice", "loss")).drop("kinds")


_HITS = f"""hits0 AS (SELECT lang AS question_id, doc_id AS rank, doc_id % 5 AS chapter_number, 't' || doc_id AS chapter_title, trim(substr(text, 301, 200), {_TRIM}) AS c, trim(text, {_TRIM}) AS p FROM documents),
hits1 AS (SELECT *, CASE WHEN strpos(p, c) > 0 THEN strpos(p, c) ELSE strpos(p, substr(c, 1, 80)) END AS spot FROM hits0),
hits2 AS (SELECT *, CASE WHEN c = '' OR p = '' THEN c || p WHEN spot = 0 THEN c ELSE trim(substr(p, greatest(spot - 101, 0) + 1, spot - 1 + length(c) + 260 - greatest(spot - 101, 0)), {_TRIM}) END AS text FROM hits1),
hits3 AS (SELECT *, row_number() OVER (PARTITION BY question_id, chapter_number, substr(text, 1, 80) ORDER BY rank) AS o FROM hits2 WHERE text <> '' AND chapter_number > 0),
hits AS (SELECT * FROM (SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY rank, chapter_number) AS hit_no, chapter_number, chapter_title, text FROM hits3 WHERE o = 1) WHERE hit_no <= 5)"""


def _hits(t: Tables):
    d = t.documents
    return d.select(F.col("lang").alias("question_id"), F.col("doc_id").alias("rank"), (F.col("doc_id") % 5).alias("chapter_number"), F.concat(F.lit("t"), "doc_id").alias("chapter_title"), F.substring("text", 301, 200).alias("child_text"), F.col("text").alias("parent_text"))


@query("dynamic_hits", f"WITH {_HITS} SELECT question_id, hit_no, chapter_number, chapter_title, text FROM hits")
def dynamic_hits(t: Tables):
    return dynamic.select_hits(_hits(t))


@query(
    "dynamic_evidence",
    f"""WITH {_HITS}, items AS (SELECT l.lang AS question_id, row_number() OVER (PARTITION BY l.lang ORDER BY v.name, w.raw) AS item_no, v.name, w.raw FROM (SELECT DISTINCT lang FROM documents) l, {values([(n,) for n in NAMES], 'name')}, (VALUES (0), (1)) AS w(raw)),
x AS (SELECT i.*, h.hit_no, h.chapter_number, h.chapter_title, trim(regexp_replace(h.text, '\\s+', ' ', 'g')) AS line FROM items i JOIN hits h USING (question_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY question_id, item_no ORDER BY hit_no) AS r FROM x WHERE contains(line, name))
SELECT question_id, name, item_no, CASE WHEN raw = 0 THEN substr(line, 1, 500) ELSE name END AS evidence, chapter_number, chapter_title FROM k WHERE r = 1""",
)
def dynamic_evidence(t: Tables):
    """Items with their name as evidence are quoted; those with words that no hit has get the first hit with the name."""
    names = sorted(NAMES)
    rows = [(n, w, 2 * i + w + 1) for i, n in enumerate(names) for w in (0, 1)]
    items = t.spark.createDataFrame(rows, "name string, w int, item_no long").select("name", "item_no", F.when(F.col("w") == 0, "no such words").otherwise(F.concat(F.lit(" "), "name", F.lit("\n"))).alias("raw"), F.array("name").alias("required"))
    items = t.documents.select(F.col("lang").alias("question_id")).distinct().join(F.broadcast(items))
    return dynamic.validated(items, dynamic.select_hits(_hits(t))).drop("required")


@query(
    "audit_list",
    f"""WITH {_AUDIT}, l AS (SELECT record_kind, doc_id AS record_id, status FROM a WHERE status = 'confirmed' ORDER BY doc_id DESC LIMIT 50)
SELECT record_kind, record_id, status, CASE WHEN record_id % 3 <> 0 THEN substr(text, 1, 40) END AS live_text, record_id % 3 = 0 AS missing FROM l JOIN documents d ON d.doc_id = record_id""",
)
def audit_list(t: Tables):
    audit = _audit(t).select("record_kind", F.col("doc_id").alias("record_id"), F.col("doc_id").alias("audit_id"), F.col("doc_id").alias("updated_at"), "status")
    live = t.documents.filter("doc_id % 3 <> 0").select("lang", F.col("doc_id").alias("record_id"), F.substring("text", 1, 40).alias("text"))
    kinds = {k: live.filter(F.col("lang") == k) for k in ("en", "de", "fr", "es")}
    return dynamic.audit_list(audit, kinds, "confirmed", 50).select("record_kind", "record_id", "status", "live_text", "missing")


@query(
    "corrected_records",
    "SELECT ':event:' || CASE WHEN doc_id % 2 = 0 THEN 'dynamic:' ELSE '' END || doc_id AS record_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'new' ELSE substr(text, 1, 30) END AS excerpt, CASE WHEN doc_id % 6 = 0 AND doc_id % 4 = 0 THEN 'told' ELSE lang END AS summary FROM documents",
)
def corrected_records(t: Tables):
    key = F.concat(F.lit(":event:"), F.when(F.col("doc_id") % 2 == 0, "dynamic:").otherwise(""), F.col("doc_id"))
    records = t.documents.select(key.alias("record_id"), F.substring("text", 1, 30).alias("excerpt"), F.col("lang").alias("summary"))
    changes = t.documents.filter("doc_id % 3 = 0").select(key.alias("record_id"), F.lit("new").alias("evidence"), F.when(F.col("doc_id") % 4 == 0, "told").otherwise("").alias("summary"))
    return dynamic.corrected(records, changes, protect_static=True)


@query(
    "rejected_with_repair",
    """WITH m AS (SELECT o_custkey AS k, o_orderkey AS id, CAST(year(o_orderdate) AS BIGINT) AS ch, o_orderkey % 3 = 0 AS gone FROM orders), g AS (SELECT k, count(*) FILTER (NOT gone) AS mention_count, min(ch) FILTER (NOT gone) AS first_chapter_number FROM m GROUP BY k)
SELECT k, first_chapter_number, mention_count FROM g WHERE mention_count > 0 OR k % 2 = 0""",
)
def rejected_with_repair(t: Tables):
    mentions = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("mention_id"), F.year("o_orderdate").cast("long").alias("chapter_number"))
    parents = mentions.groupBy("k").agg(F.min("chapter_number").alias("first_chapter_number"), F.count("*").alias("mention_count"))
    return dynamic.rejected(parents, mentions, mentions.filter("mention_id % 3 = 0"), mentions.filter("k % 2 = 0"), "k")[0]


@query("progress_bounds", "WITH c AS (SELECT source AS book_id, count(*) AS n FROM documents GROUP BY source) SELECT book_id, CASE WHEN n % 2 = 0 THEN CAST(7 AS BIGINT) ELSE n END AS bound FROM c")
def progress_bounds(t: Tables):
    readers = t.documents.groupBy(F.col("source").alias("book_id")).agg(F.when(F.count("*") % 2 == 0, 7).alias("progress"))
    return library.progress_of(readers, t.chapters).drop("progress")


@query("session_branch", f"WITH {_TURNS} SELECT CAST(-1 AS BIGINT) AS session_id, turn_index, question, answer FROM turns WHERE session_id = 1 AND turn_index < 3")
def session_branch(t: Tables):
    return S.branched(S.turns_of(t.conversations), 1, 3, -1)


@query("session_edits", f"""WITH {_TURNS}, e AS (SELECT session_id, turn_index, CASE WHEN turn_index = 2 THEN 'edited' ELSE question END AS question, answer FROM turns WHERE NOT (session_id = 1 AND turn_index >= 2) AND NOT (session_id = 2 AND turn_index = 1) AND session_id <> 3)
SELECT * FROM e UNION ALL SELECT session_id, max(turn_index) + 1, 'more', '' FROM e WHERE session_id < 6 GROUP BY session_id""")
def session_edits(t: Tables):
    turns = S.turns_of(t.conversations)
    turns = S.deleted(S.deleted(S.deleted(turns, 1, 2, onwards=True), 2, 1), 3)
    turns = S.updated(turns, turns.filter("turn_index = 2").select("session_id", "turn_index", F.lit("edited").alias("question"), F.lit(None).cast("string").alias("answer")))
    more = turns.filter("session_id < 6").select("session_id").distinct().select("session_id", F.lit(1).alias("at"), F.lit("more").alias("question"), F.lit("").alias("answer"))
    return S.appended(turns, more)
