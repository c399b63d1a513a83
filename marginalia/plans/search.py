"""Queries: tokens, postings, lexical, exact and vector search, rerank windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval as R
from ..operators import search_index, vectors
from .base import CHAPTERS_SQL, Tables, query

QUERY = "the worthless trash of ones onth"
BARE = "hwhe"
TOKENS = "list_distinct(regexp_extract_all(lower(text), '[A-Za-z0-9_]+'))"
CHUNKS_SQL = f"{CHAPTERS_SQL}, chunks AS (SELECT book_id, chapter_number, CAST(doc_id AS VARCHAR) AS chunk_id, CAST(doc_id // 4 AS VARCHAR) AS parent_id, content AS text FROM chapters)"


def lexical_sql(q: str, bound: int | None) -> str:
    words = "[" + ", ".join(f"'{w}'" for w in sorted(set(q.lower().split()))) + "]"
    n = len(set(q.lower().split()))
    return f"""
WITH {CHUNKS_SQL},
t AS (SELECT *, {TOKENS} AS d FROM chunks),
h AS (SELECT *, len(list_intersect(d, {words})) AS hits FROM t),
c AS (SELECT *, max(hits) OVER (PARTITION BY book_id) AS most FROM h),
s AS (SELECT *, hits / {n}.0 + hits / sqrt(len(d)) + CASE WHEN contains(replace(text, ' ', ''), '{q.replace(" ", "")}') THEN 0.25 ELSE 0 END AS score FROM c WHERE (hits > 0 OR most = 0) AND len(d) > 0),
p AS (SELECT *, row_number() OVER (PARTITION BY book_id, parent_id ORDER BY score DESC, chapter_number, parent_id, chunk_id) AS r FROM s WHERE score > 0 {f'AND chapter_number <= {bound}' if bound else ''}),
k AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY score DESC, chapter_number, parent_id, chunk_id) AS rank FROM p WHERE r = 1)
SELECT book_id, rank, chapter_number, chunk_id, round(score, 6) AS score FROM k WHERE rank <= 4"""


def _lexical(t: Tables, q: str, bound: int | None):
    return R.lexical_search(t.chunks, q, bound).select("book_id", "rank", "chapter_number", "chunk_id", F.round("score", 6).alias("score"))


@query("lexical_topk", lexical_sql(QUERY, None))
def lexical_topk(t: Tables):
    return _lexical(t, QUERY, None)


@query("lexical_progress_bound", lexical_sql(QUERY, 10))
def lexical_progress_bound(t: Tables):
    return _lexical(t, QUERY, 10)


@query("lexical_no_candidate_fallback", lexical_sql(BARE, None))
def lexical_no_candidate_fallback(t: Tables):
    return _lexical(t, BARE, None)


@query("lexical_postings_topk", lexical_sql(QUERY, None))
def lexical_postings_topk(t: Tables):
    """The same search from an index; a session that searches again reads what ``search_index.refresh`` wrote."""
    return search_index.search(search_index.built(t.chunks), QUERY).select("book_id", "rank", "chapter_number", "chunk_id", F.round("score", 6).alias("score"))


@query("tokenize_stats", f"SELECT lang, count(*) AS docs, CAST(sum(len({TOKENS})) AS BIGINT) AS tokens FROM documents GROUP BY lang")
def tokenize_stats(t: Tables):
    return t.documents.groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.size(T.tokens(F.col("text")))).alias("tokens"))


@query("postings_df", f"SELECT token, count(*) AS df FROM (SELECT unnest({TOKENS}) AS token FROM documents) GROUP BY token HAVING count(*) >= 20")
def postings_df(t: Tables):
    return R.postings(t.chunks).groupBy("token").agg(F.count("*").alias("df")).filter("df >= 20")


@query("candidate_chunks", f"SELECT source AS book_id, CAST(doc_id AS VARCHAR) AS chunk_id FROM documents WHERE len(list_intersect({TOKENS}, ['stupid', 'idiot'])) > 0")
def candidate_chunks(t: Tables):
    return R.candidates(R.postings(t.chunks), "stupid idiot")


@query(
    "exact_text_search",
    f"""
WITH {CHAPTERS_SQL}, a AS (SELECT *, strpos(content, 'worthless') - 1 AS position, length(content) AS n FROM chapters WHERE contains(content, 'worthless')),
c AS (SELECT *, greatest(position - 60, 0) AS s, least(n, position + 69) AS e, row_number() OVER (PARTITION BY book_id ORDER BY chapter_number) AS rank FROM a)
SELECT book_id, chapter_number, position, CASE WHEN s > 0 THEN '...' ELSE '' END || trim(substr(content, s + 1, e - s), E' \\n\\t\\r') || CASE WHEN e < n THEN '...' ELSE '' END AS excerpt, rank, round(1.0 / rank, 6) AS score FROM c WHERE rank <= 5""",
)
def exact_text_search(t: Tables):
    return R.exact_search(t.chapters, "worthless", limit=5, context=60).withColumns({"score": F.round("score", 6)})


VECTORS = "v AS (SELECT vec_id, label, embedding, CAST(vec_id AS VARCHAR) AS chunk_id, CAST(vec_id // 4 AS VARCHAR) AS parent_id, (SELECT embedding FROM embeddings WHERE vec_id = 7) AS q FROM embeddings)"
SCORED = f"{VECTORS}, s AS (SELECT *, round(list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * CAST(q[i] AS DOUBLE))) / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) / sqrt(list_sum(list_transform(q, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS score FROM v), top AS (SELECT * FROM s ORDER BY score DESC, chunk_id LIMIT 80)"


def _vectors(t: Tables):
    rows = t.embeddings.select(F.col("vec_id").cast("string").alias("chunk_id"), F.floor(F.col("vec_id") / 4).cast("string").alias("parent_id"), F.col("label").alias("chapter_number"), "embedding", "vec_id")
    return rows, rows.filter("vec_id = 7").first()["embedding"]


@query("vector_topk", f"WITH {SCORED} SELECT chunk_id, CAST(label AS BIGINT) AS chapter_number, score FROM top")
def vector_topk(t: Tables):
    rows, q = _vectors(t)
    return R.vector_hits(rows, q).select("chunk_id", "chapter_number", "score")


_BEST = "p AS (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY score DESC, label, chunk_id) AS r FROM top {w}) SELECT parent_id, chunk_id, CAST(label AS BIGINT) AS chapter_number, score FROM p WHERE r = 1 ORDER BY score DESC, label, parent_id, chunk_id LIMIT 4"


@query("vector_best_per_parent", f"WITH {SCORED}, {_BEST.format(w='')}")
def vector_best_per_parent(t: Tables):
    rows, q = _vectors(t)
    return R.vector_search(rows, q).select("parent_id", "chunk_id", "chapter_number", "score")


@query("vector_postfilter", f"WITH {SCORED}, {_BEST.format(w='WHERE label <= 3')}")
def vector_postfilter(t: Tables):
    rows, q = _vectors(t)
    return R.vector_search(rows, q, 3).select("parent_id", "chunk_id", "chapter_number", "score")


@query(
    "rerank_window",
    """
WITH d AS (SELECT doc_id, trim(text, E' \\n\\t\\r') AS p, trim(substr(text, 1 + CAST(length(text) // 2 AS INT), 100), E' \\n\\t\\r') AS c FROM documents),
a AS (SELECT *, CASE WHEN c = '' THEN -1 ELSE strpos(p, substr(c, 1, 120)) - 1 END AS pos, length(p) AS n FROM d),
b AS (SELECT *, least(n, pos + length(c)) AS ce FROM a), e AS (SELECT *, greatest(0, 384 - (ce - pos)) AS room FROM b),
f AS (SELECT *, greatest(0, pos - room // 2) AS l0 FROM e), g AS (SELECT *, least(n, ce + (room - (pos - l0))) AS r FROM f),
h AS (SELECT *, CASE WHEN r - l0 < 384 AND l0 > 0 THEN greatest(0, r - 384) ELSE l0 END AS l FROM g)
SELECT doc_id, CASE WHEN p = '' THEN substr(c, 1, 384) WHEN n <= 384 THEN p WHEN pos >= 0 THEN substr(p, l + 1, r - l) WHEN c = '' THEN substr(p, 1, 384)
       ELSE substr(c || E'\\n' || substr(p, 1, greatest(0, 384 - length(c) - 1)), 1, 384) END AS passage FROM h""",
)
def rerank_window(t: Tables):
    child = F.substring("text", (F.floor(F.length("text") / 2) + 1).cast("int"), F.lit(100))
    return R.rerank_windows(t.documents.select("doc_id", "text"), child, F.col("text")).select("doc_id", "passage")


@query(
    "vector_many_topk",
    """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM e),
s AS (SELECT q.vec_id AS query_id, CAST(r.vec_id AS VARCHAR) AS chunk_id, floor(list_sum(list_transform(range(1, 65), lambda i: q.v[i] * r.v[i])) / (q.n * r.n) * 1e6 + 0.5) / 1e6 AS score FROM n q JOIN n r ON q.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) SELECT query_id, chunk_id, score, rank FROM k WHERE rank <= 10""",
)
def vector_many_topk(t: Tables):
    """Every twentieth vector as a question to all vectors."""
    rows = t.embeddings.select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding")
    return vectors.nearest(rows, t.embeddings.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"))
