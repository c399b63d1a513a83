"""Queries: chapters, chunks, mention tables, look-ups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import names
from ..functions import text as T
from ..operators import answers, ingest, lookup, maintain
from ..operators import mentions as M
from .base import ALIASES, CHAPTERS_SQL, NAMES, Tables, query, values

BOUND = 12
#: Cue words for the driver's invented languages, instead of the fixed CJK ones.
EVENTS = (("loss", ("scum", "trash")), ("conflict", ("stupid", "idiot", "moron")), ("choice", ("inghe", "tionan")))
RELATIONS = (("kin", ("worthless", "pathetic")), ("ally", ("ingan", "tionth")))
LATIN = r"(?<=[.!?])\s*|\n+"
_TRIM = r"E' \n\t\r\f'"

NAMES_SQL = f"names AS (SELECT name, name AS surface FROM {values([(n,) for n in NAMES], 'name')})"
SURFACES_SQL = f"surfaces AS (SELECT name, name AS surface FROM {values([(n,) for n in NAMES], 'name')} UNION ALL SELECT name, surface FROM {values(ALIASES, 'name', 'surface')})"


def mentions_sql(names: str) -> str:
    return f"""
hit AS (SELECT book_id, name, surface, chapter_number, content, string_split(content, surface) AS parts FROM chapters JOIN {names} ON contains(content, surface)),
pos AS (SELECT * EXCLUDE (parts), unnest(list_transform(range(1, len(parts)), lambda i: CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) AS BIGINT) + (i - 1) * length(surface))) AS position FROM hit),
win AS (SELECT *, greatest(position - 60, 0) AS s, least(length(content), position + length(surface) + 60) AS e FROM pos),
mentions AS (SELECT book_id, name, surface, chapter_number, position, replace(trim(substr(content, s + 1, e - s), {_TRIM}), E'\\n', ' ') AS excerpt,
  row_number() OVER (PARTITION BY book_id, name ORDER BY chapter_number, position, surface) AS mention_no FROM win)"""


ENTITY = f"WITH {CHAPTERS_SQL}, {NAMES_SQL}, {mentions_sql('names')}"
THEME = f"WITH {CHAPTERS_SQL}, {SURFACES_SQL}, {mentions_sql('surfaces')}"


@query("book_stats", "SELECT source AS book_id, count(*) AS chapters, CAST(sum(length(text)) AS BIGINT) AS chars, min(doc_id) AS first_doc, max(length(text)) AS longest FROM documents GROUP BY source")
def book_stats(t: Tables):
    return t.documents.groupBy(F.col("source").alias("book_id")).agg(F.count("*").alias("chapters"), F.sum(F.length("text")).alias("chars"), F.min("doc_id").alias("first_doc"), F.max(F.length("text")).alias("longest"))


@query(
    "chapter_offsets",
    f"""WITH {CHAPTERS_SQL}, s AS (SELECT *, length(title) + 1 + length(content) AS size FROM chapters)
SELECT book_id, chapter_number, CAST(coalesce(sum(size + 2) OVER w, 0) AS BIGINT) AS start_offset, CAST(coalesce(sum(size + 2) OVER w, 0) + size AS BIGINT) AS end_offset FROM s
WINDOW w AS (PARTITION BY book_id ORDER BY chapter_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def chapter_offsets(t: Tables):
    rows = t.chapters.select("book_id", "chapter_number", (F.length("title") + 1 + F.length("content")).cast("long").alias("size"))
    placed = ingest.running(rows.withColumn("length", F.col("size") + 2), "book_id", "chapter_number", ("length",))
    return placed.select("book_id", "chapter_number", F.col("before_length").alias("start_offset"), (F.col("before_length") + F.col("size")).alias("end_offset"))


@query(
    "segment_lines",
    f"""WITH {CHAPTERS_SQL}, s AS (SELECT book_id, chapter_number, 'Chapter ' || chapter_number || ' d' || doc_id AS title, trim(content, {_TRIM}) AS content FROM chapters),
z AS (SELECT *, length(trim(title || E'\\n' || content, {_TRIM})) AS size FROM s)
SELECT book_id, chapter_number, title, length(CASE WHEN content = '' THEN title ELSE content END) AS chars, sha256(CASE WHEN content = '' THEN title ELSE content END) AS digest,
       CAST(coalesce(sum(size + 2) OVER w, 0) AS BIGINT) AS start_offset FROM z WINDOW w AS (PARTITION BY book_id ORDER BY chapter_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def segment_lines(t: Tables):
    headed = t.chapters.withColumn("content", F.concat(F.lit("Chapter "), "chapter_number", F.lit(" d"), "doc_id", F.lit("\r\n"), "content"))
    found = ingest.parse_chapters(ingest.source_parts(headed))
    return found.select("book_id", "chapter_number", "title", F.length("content").alias("chars"), F.sha2("content", 256).alias("digest"), "start_offset")


@query(
    "volume_carry_forward",
    f"""WITH {CHAPTERS_SQL}, v AS (SELECT book_id, chapter_number, doc_id, last_value(CASE WHEN doc_id % 5 = 0 THEN '第' || doc_id || '卷 v' || doc_id END IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY chapter_number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS volume FROM chapters)
SELECT book_id, chapter_number, coalesce(volume || ' / ', '') || 'd' || doc_id AS title FROM v""",
)
def volume_carry_forward(t: Tables):
    """Every fifth document opens a volume, under which the chapters behind it stand."""
    volume = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("第"), "doc_id", F.lit("卷 v"), "doc_id", F.lit("\n"))).otherwise("")
    headed = t.chapters.withColumn("content", F.concat(volume, F.lit("第"), "chapter_number", F.lit("章 d"), "doc_id", F.lit("\n"), "content"))
    return ingest.parse_chapters(ingest.source_parts(headed)).select("book_id", "chapter_number", "title")


@query(
    "default_summary",
    f"WITH c AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 140 THEN rtrim(substr(t, 1, 140)) || '...' ELSE t END AS summary FROM c",
)
def default_summary(t: Tables):
    return t.documents.select("doc_id", T.summary(F.col("text")).alias("summary"))


def spans_sql(table: str, keys: str, target: int, overlap: int, into: str) -> str:
    """Recursive twin of the window cutter over a table with column t (stripped text)."""
    least = int(target * 0.6)
    last = lambda c: f"CASE WHEN strpos(reverse(seg), {c}) > 0 THEN s + length(seg) - strpos(reverse(seg), {c}) ELSE -1 END"
    step = lambda src: f"""SELECT {keys}, t, i, s, CASE WHEN s + {target} < length(t) AND greatest({last("'.'")}, {last("E'\\n'")}) > s + {least} THEN greatest({last("'.'")}, {last("E'\\n'")}) + 1 ELSE least(length(t), s + {target}) END AS e
  FROM (SELECT *, substr(t, s + 1, least(length(t), s + {target} + 80) - s) AS seg FROM {src})"""  # noqa: E731
    return f"""
{into}_r AS (({step(f"(SELECT {keys}, t, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS s FROM {table} WHERE t <> '')")}) UNION ALL ({step(f"(SELECT {keys}, t, i + 1 AS i, greatest(e - {overlap}, s + 1) AS s FROM {into}_r WHERE e < length(t))")})),
{into} AS (SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY i) - 1 AS chunk_index, trim(substr(t, s + 1, e - s), {_TRIM}) AS text FROM {into}_r WHERE trim(substr(t, s + 1, e - s), {_TRIM}) <> '')"""


_PARENTS = f"WITH RECURSIVE {CHAPTERS_SQL}, src AS (SELECT book_id, chapter_number, trim(content, {_TRIM}) AS t FROM chapters), {spans_sql('src', 'book_id, chapter_number', 1800, 200, 'parents')}"


@query("chunk_parents", f"{_PARENTS} SELECT book_id || ':p:' || chapter_number || ':' || chunk_index AS chunk_id, chunk_index, length(text) AS chars, sha256(text) AS digest FROM parents")
def chunk_parents(t: Tables):
    parents, _ = ingest.chunk_hierarchy(t.chapters, ends=".\n")
    return parents.select("chunk_id", "chunk_index", F.length("text").alias("chars"), F.sha2("text", 256).alias("digest"))


@query(
    "chunk_join_parent",
    f"""{_PARENTS}, src2 AS (SELECT book_id, chapter_number, chunk_index AS parent_index, text AS t FROM parents), {spans_sql('src2', 'book_id, chapter_number, parent_index', 260, 40, 'children')}
SELECT book_id || ':p:' || chapter_number || ':' || parent_index AS parent_id, count(*) AS children, CAST(sum(length(c.text)) AS BIGINT) AS chars, max(length(p.t)) AS parent_chars
FROM children c JOIN src2 p USING (book_id, chapter_number, parent_index) GROUP BY ALL""",
)
def chunk_join_parent(t: Tables):
    rows = ingest.search_rows(*ingest.chunk_hierarchy(t.chapters, ends=".\n"))
    return rows.groupBy("parent_id").agg(F.count("*").alias("children"), F.sum(F.length("text")).alias("chars"), F.max(F.length("parent_text")).alias("parent_chars"))


@query("entity_mentions", f"{ENTITY} SELECT book_id, name, chapter_number, position, excerpt, mention_no FROM mentions")
def entity_mentions(t: Tables):
    return M.mentions(t.chapters, t.names).select("book_id", "name", "chapter_number", "position", "excerpt", "mention_no")


@query("entity_rollup", f"{ENTITY} SELECT book_id, name, min(chapter_number) AS first_chapter_number, count(*) AS mention_count FROM mentions GROUP BY ALL")
def entity_rollup(t: Tables):
    return M.rollup(M.mentions(t.chapters, t.names))


@query(
    "first_appearance",
    f"""{ENTITY} SELECT book_id, name, chapter_number > {BOUND} AS blocked, CASE WHEN chapter_number <= {BOUND} THEN chapter_number END AS chapter_number, CASE WHEN chapter_number <= {BOUND} THEN excerpt END AS excerpt
FROM mentions WHERE mention_no = 1""",
)
def first_appearance(t: Tables):
    return lookup.first_appearance(M.mentions(t.chapters, t.names), BOUND).select("book_id", "name", "blocked", "chapter_number", "excerpt")


@query(
    "timeline_fragments",
    f"""{ENTITY}, b AS (SELECT * FROM mentions WHERE chapter_number <= {BOUND}), a AS (SELECT book_id, name, count(DISTINCT chapter_number) AS chapters, count(*) AS n_mentions FROM b GROUP BY ALL)
SELECT book_id, name, mention_no AS rank, chapter_number, excerpt, chapters, n_mentions FROM b JOIN a USING (book_id, name) WHERE mention_no <= 3""",
)
def timeline_fragments(t: Tables):
    return lookup.timeline(M.mentions(t.chapters, t.names), BOUND).select("book_id", "name", "rank", "chapter_number", "excerpt", "chapters", "n_mentions")


@query(
    "alias_resolution",
    rf"""WITH s AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[^ \t\r\n]+')) AS surface FROM documents)
SELECT surface, coalesce(d.name, a.name) AS name FROM s LEFT JOIN {values([(n,) for n in NAMES], 'name').replace('AS v', 'AS d')} ON d.name = lower(surface) LEFT JOIN {values(ALIASES, 'name', 'alias').replace('AS v', 'AS a')} ON a.alias = lower(surface) WHERE coalesce(d.name, a.name) IS NOT NULL""",
)
def alias_resolution(t: Tables):
    """The names that words of the documents stand for."""
    words = t.documents.select(F.explode(F.regexp_extract_all("text", F.lit(r"[^ \t\r\n]+"), 0)).alias("surface")).distinct()
    return lookup.resolve(words, t.names.select("name"), t.aliases)


@query(
    "dictionary_match",
    f"""WITH {SURFACES_SQL}, h AS (SELECT conv_id, turn, name, surface, CASE WHEN name = surface THEN 0 ELSE 1 END AS kind FROM conversations JOIN surfaces ON contains(text, surface) WHERE role = 'user'),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, name ORDER BY kind, length(surface) DESC, surface) AS r FROM h)
SELECT conv_id, turn, name, surface, CAST(kind AS BIGINT) AS kind, row_number() OVER (PARTITION BY conv_id, turn ORDER BY kind, length(surface) DESC, name) AS rank FROM r WHERE r = 1""",
)
def dictionary_match(t: Tables):
    """The names that users' messages have."""
    asked = t.conversations.filter("role = 'user'").select("conv_id", "turn", "text")
    return lookup.names_in(asked, t.names.select("name"), t.aliases, "text").select("conv_id", "turn", "name", "surface", "kind", "rank")


@query(
    "name_aliases",
    f"""{ENTITY}, f AS (SELECT DISTINCT book_id, name FROM mentions) SELECT book_id, f.name, coalesce(string_agg(alias, '、' ORDER BY alias), '') AS aliases FROM f LEFT JOIN {values(ALIASES, 'name', 'alias').replace('AS v', 'AS a')} ON a.name = f.name GROUP BY book_id, f.name""",
)
def name_aliases(t: Tables):
    """The names of each book with their aliases."""
    return lookup.with_aliases(M.rollup(M.mentions(t.chapters, t.names)).select("book_id", "name"), t.aliases).select("book_id", "name", "aliases")


@query("theme_mentions", f"{THEME} SELECT book_id, name, surface, chapter_number, position, mention_no FROM mentions")
def theme_mentions(t: Tables):
    return M.mentions(t.chapters, t.surfaces).select("book_id", "name", "surface", "chapter_number", "position", "mention_no")


@query(
    "theme_stages",
    f"""{THEME}, n AS (SELECT *, row_number() OVER (PARTITION BY book_id, name ORDER BY chapter_number, excerpt) - 1 AS i, count(*) OVER (PARTITION BY book_id, name) AS n FROM mentions),
f AS (SELECT *, greatest(1, n // 3) AS f FROM n), s AS (SELECT *, CASE WHEN n <= 2 THEN i * 2 WHEN i < f THEN 0 WHEN i < greatest(f + 1, n * 2 // 3) THEN 1 ELSE 2 END AS stage FROM f)
SELECT book_id, name, CAST(stage AS BIGINT) AS stage, min(chapter_number) AS chapter_start, max(chapter_number) AS chapter_end, count(*) AS excerpt_count,
       first(excerpt ORDER BY chapter_number, excerpt) AS first_excerpt, last(excerpt ORDER BY chapter_number, excerpt) AS last_excerpt FROM s GROUP BY book_id, name, stage""",
)
def theme_stages(t: Tables):
    return lookup.stages_of_chapters(M.mentions(t.chapters, t.surfaces))


def _sentence_sql(least: int, most: int | None) -> str:
    """Sentences of the driver's texts; longer ones in windows where ``most`` says so."""
    keep = f"length(x) BETWEEN {least} AND 220" if most is None else "true"
    base = f"""
sent0 AS (SELECT book_id, chapter_number, list_filter(list_transform(string_split(regexp_replace(content, '([.!?])\\s*|\\n+', '\\1⏎', 'g'), '⏎'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: {keep}) AS ss FROM chapters)"""
    if most is None:
        return base + ", sent AS (SELECT book_id, chapter_number, unnest(ss) AS sentence, unnest(range(0, len(ss))) AS window_no FROM sent0)"
    return base + f""", sent1 AS (SELECT book_id, chapter_number, list_filter(flatten(list_transform(ss, lambda x: CASE WHEN length(x) <= {most} THEN [x] ELSE list_transform(range(1, length(x) + 1, {most}), lambda i: trim(substr(x, i, {most}))) END)), lambda x: length(x) >= {least}) AS ss FROM sent0),
sent AS (SELECT book_id, chapter_number, unnest(ss) AS sentence, unnest(range(0, len(ss))) AS window_no FROM sent1)"""


def _case_sql(groups, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f"contains(sentence, '{x}')" for x in terms)} THEN '{k}'" for k, terms in groups) + f" ELSE '{otherwise}' END"


_NAMES_LIST = "[" + ", ".join(f"'{n}'" for n in sorted(NAMES)) + "]"
_NAMED = f"named AS (SELECT *, list_filter({_NAMES_LIST}, lambda n: contains(sentence, n)) AS names FROM sent)"
_PAIRS = f"""WITH {CHAPTERS_SQL}, {_sentence_sql(8, 120)}, {_NAMED}, typed AS (SELECT *, {_case_sql(RELATIONS, M.NO_RELATION)} AS relation_type FROM named WHERE len(names) > 1),
lf AS (SELECT *, unnest(names) AS source FROM typed WHERE relation_type <> '{M.NO_RELATION}'), pr AS (SELECT *, unnest(list_filter(names, lambda n: n > source)) AS target FROM lf),
pairs AS (SELECT book_id, source, target, relation_type, chapter_number, window_no, sentence FROM pr)"""


def _windows(t: Tables):
    """Relation windows with the driver's sentence ends."""
    return M.windows(t.chapters, t.names, T.relation_windows(F.col("content"), pattern=LATIN))


@query("relation_pairs", f"{_PAIRS} SELECT book_id, source, target, relation_type, min(chapter_number) AS first_chapter_number, count(*) AS mention_count FROM pairs GROUP BY ALL")
def relation_pairs(t: Tables):
    return M.relation_rollup(M.relations(_windows(t), RELATIONS))


@query(
    "relations_for_entity",
    f"""{_PAIRS}, r AS (SELECT book_id, source, target, relation_type, min(chapter_number) AS first_chapter_number, count(*) AS mention_count, count(*) FILTER (chapter_number <= {BOUND}) AS visible_mention_count FROM pairs GROUP BY ALL)
SELECT * FROM r WHERE first_chapter_number <= {BOUND} AND (source = 'thnt' OR target = 'thnt')""",
)
def relations_for_entity(t: Tables):
    pairs = M.relations(_windows(t), RELATIONS)
    return lookup.relations_of(M.relation_rollup(pairs), pairs, "Thnt", BOUND)


@query("relation_stages", f"""{_PAIRS}, n AS (SELECT *, sentence AS excerpt, row_number() OVER (PARTITION BY book_id, relation_type ORDER BY chapter_number, sentence, source, target) - 1 AS i, count(*) OVER (PARTITION BY book_id, relation_type) AS n FROM pairs),
f AS (SELECT *, greatest(1, n // 3) AS f FROM n), s AS (SELECT *, CASE WHEN n <= 2 THEN i * 2 WHEN i < f THEN 0 WHEN i < greatest(f + 1, n * 2 // 3) THEN 1 ELSE 2 END AS stage FROM f)
SELECT book_id, relation_type, CAST(stage AS BIGINT) AS stage, min(chapter_number) AS chapter_start, max(chapter_number) AS chapter_end, count(*) AS excerpt_count FROM s GROUP BY book_id, relation_type, stage""")
def relation_stages(t: Tables):
    pairs = M.relations(_windows(t), RELATIONS).withColumn("excerpt", F.col("sentence"))
    return lookup.stages(pairs, ["book_id", "relation_type"]).drop("first_excerpt", "last_excerpt")


@query(
    "node_weights",
    f"""{_PAIRS}, r AS (SELECT book_id, source, target, relation_type, count(*) AS n FROM pairs GROUP BY ALL), e AS (SELECT book_id, source AS name, n FROM r UNION ALL SELECT book_id, target, n FROM r)
SELECT book_id, name, CAST(sum(n) AS BIGINT) AS weight, count(*) AS degree FROM e GROUP BY ALL""",
)
def node_weights(t: Tables):
    return lookup.node_weights(M.relation_rollup(M.relations(_windows(t), RELATIONS)))


@query(
    "relation_band_fallback",
    f"""{_PAIRS}, {NAMES_SQL}, {mentions_sql('names')}, f AS (SELECT book_id, chapter_number, name, min(position) AS p FROM mentions WHERE book_id NOT IN (SELECT book_id FROM pairs) GROUP BY ALL)
SELECT a.book_id, a.chapter_number, a.name AS source, b.name AS target FROM f a JOIN f b ON a.book_id = b.book_id AND a.chapter_number = b.chapter_number AND a.name < b.name AND abs(a.p - b.p) <= 120""",
)
def relation_band_fallback(t: Tables):
    return M.band_relations(M.mentions(t.chapters, t.names), M.relations(_windows(t), RELATIONS)).drop("relation_type")


_EVENTS = f"""WITH {CHAPTERS_SQL}, {_sentence_sql(8, None)}, {_NAMED}, typed AS (SELECT *, {_case_sql(EVENTS, M.NO_EVENT)} AS event_type, row_number() OVER (PARTITION BY book_id, chapter_number, sentence ORDER BY window_no) AS o FROM named WHERE len(names) > 0),
events_found AS (SELECT book_id, chapter_number, window_no, event_type, CASE WHEN length(sentence) > 72 THEN rtrim(substr(sentence, 1, 72)) || '...' ELSE sentence END AS summary,
  CASE WHEN length(sentence) > 120 THEN rtrim(substr(sentence, 1, 120)) || '...' ELSE sentence END AS excerpt, names FROM typed WHERE event_type <> '{M.NO_EVENT}' AND o = 1)"""


def _events(t: Tables):
    column = T.sentences(F.col("content"), LATIN)
    return M.events(M.windows(t.chapters, t.names, column), EVENTS)


@query("event_sentences", f"{_EVENTS} SELECT book_id, chapter_number, window_no, event_type, summary, excerpt, array_to_string(names, '、') AS names FROM events_found")
def event_sentences(t: Tables):
    return _events(t).withColumn("names", F.array_join("names", "、"))


_BARE = "lower(regexp_replace({x}, '[^0-9A-Za-z一-鿿]+', '', 'g'))"
_BI = "CASE WHEN length({x}) = 0 THEN [] WHEN length({x}) < 2 THEN [{x}] ELSE list_distinct(list_transform(range(1, length({x})), lambda i: substr({x}, i, 2))) END"


@query(
    "near_duplicate_pairs",
    f"""{_EVENTS}, b AS (SELECT book_id, chapter_number, event_type, window_no, {_BARE.format(x='excerpt')} AS x FROM events_found), g AS (SELECT *, {_BI.format(x='x')} AS g FROM b),
p AS (SELECT l.book_id, l.chapter_number, l.event_type, l.window_no AS a, r.window_no AS b, l.x, r.x AS y, l.g, r.g AS h, len(list_intersect(l.g, r.g)) AS o
  FROM g l JOIN g r ON l.book_id = r.book_id AND l.chapter_number = r.chapter_number AND l.event_type = r.event_type AND l.window_no < r.window_no)
SELECT book_id, chapter_number, event_type, a, b FROM p WHERE x <> '' AND y <> '' AND ((least(length(x), length(y)) >= 16 AND (contains(x, y) OR contains(y, x))) OR o >= 0.78 * (len(g) + len(h) - o) OR o >= 0.78 * least(len(g), len(h)))""",
)
def near_duplicate_pairs(t: Tables):
    """Events of one chapter and type whose excerpts are near duplicates, which is where the rule is used."""
    return maintain.near_duplicate_events(_events(t), "window_no")


@query(
    "event_search_tokens",
    f"""{_EVENTS}, h AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY chapter_number, window_no) AS rank FROM events_found WHERE chapter_number <= 40 AND (event_type ILIKE '%con%' OR summary ILIKE '%con%' OR excerpt ILIKE '%con%') AND (event_type ILIKE '%THE%' OR summary ILIKE '%THE%' OR excerpt ILIKE '%THE%'))
SELECT book_id, chapter_number, window_no, event_type, rank FROM h WHERE rank <= 8""",
)
def event_search_tokens(t: Tables):
    return lookup.event_search(_events(t), ["con", "THE"], max_chapter=40, limit=8).select("book_id", "chapter_number", "window_no", "event_type", "rank")


@query(
    "event_search_entity_semi",
    f"""{_EVENTS}, h AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY chapter_number, window_no) AS rank FROM events_found WHERE list_contains(names, 'thnt'))
SELECT book_id, chapter_number, window_no, event_type, rank FROM h WHERE rank <= 8""",
)
def event_search_entity_semi(t: Tables):
    return lookup.event_search(_events(t), entity="thnt", limit=8).select("book_id", "chapter_number", "window_no", "event_type", "rank")


@query(
    "ngram_frequency",
    """WITH r AS (SELECT unnest(regexp_extract_all(text, '[a-z]{4,}')) AS s FROM documents),
g AS (SELECT unnest(flatten(list_transform([2, 3, 4], lambda n: list_transform(range(1, length(s) - n + 2), lambda i: substr(s, i, n))))) AS gram FROM r)
SELECT gram, count(*) AS n FROM g GROUP BY gram HAVING count(*) >= 8""",
)
def ngram_frequency(t: Tables):
    return M.ngram_counts(t.documents.select(F.col("text").alias("content")), run="[a-z]{4,}")


@query(
    "sampled_chapters",
    f"""WITH {CHAPTERS_SQL}, n AS (SELECT book_id, chapter_number, count(*) OVER (PARTITION BY book_id) AS c FROM chapters), k AS (SELECT * FROM n WHERE (chapter_number - 1) % 7 = 0 OR chapter_number = c)
SELECT book_id, chapter_number, CAST((row_number() OVER (PARTITION BY book_id ORDER BY chapter_number) - 1) // 4 AS BIGINT) AS batch_no FROM k""",
)
def sampled_chapters(t: Tables):
    return M.sample_chapters(t.chapters.select("book_id", "chapter_number"), stride=7, batch=4)


_LETTERS, _CHARS = "abcdefghijklmnoprstuvwxyz", "铜镜山门甲乙丙丁的了中上下这那有没不我们他命运自由"
_GRAM_RUN = "[一-鿿]{4,}"


def _any(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


@query(
    "discovered_names",
    f"""WITH r AS (SELECT unnest(regexp_extract_all(translate(text, '{_LETTERS}', '{_CHARS}'), '{_GRAM_RUN}')) AS s FROM documents),
g AS (SELECT unnest(flatten(list_transform([2, 3, 4], lambda n: list_transform(range(1, length(s) - n + 2), lambda i: substr(s, i, n))))) AS gram FROM r), c AS (SELECT gram, count(*) AS n FROM g GROUP BY gram HAVING count(*) >= 8),
k AS (SELECT * FROM c WHERE NOT regexp_matches(gram, '^[{names.NUMERALS}]+$') AND NOT (length(gram) <= 3 AND regexp_matches(gram, '[{names.PARTICLES}]')) AND gram NOT IN {_any(names.COMMON_WORDS)} AND gram NOT IN {_any(names.THEME_WORDS)}
  AND NOT (length(gram) <= 3 AND regexp_matches(gram, '^[{names.SHORT_BEGINS}]|[{names.SHORT_ENDS}]$'))),
p AS (SELECT DISTINCT unnest(flatten(list_transform(range(1, length(gram)), lambda n: list_transform(range(1, length(gram) - n + 2), lambda i: substr(gram, i, n))))) AS gram FROM k), o AS (SELECT gram, n FROM k ANTI JOIN p USING (gram)), t AS (SELECT gram FROM o ORDER BY length(gram) DESC, n DESC, gram LIMIT 60)
SELECT gram AS name FROM t""",
)
def discovered_names(t: Tables):
    """Likely names of the documents with letters as CJK characters, particles and theme words among them."""
    return M.discovered(t.documents.select(F.translate("text", _LETTERS, _CHARS).alias("content")))


_ASKED = [("thnt", "eron"), ("ones", "thha"), ("ungen", "onth"), ("onth", "ernt")]


@query(
    "relation_answers",
    f"""{_PAIRS}, {NAMES_SQL}, {mentions_sql('names')}, q AS (SELECT a, b, least(a, b) AS source, greatest(a, b) AS target FROM {values(_ASKED, 'a', 'b')}),
asked_typed AS (SELECT p.* FROM pairs p JOIN q USING (source, target) WHERE chapter_number <= {BOUND}),
kfr AS (SELECT book_id, source, target, relation_type, chapter_number, sentence AS excerpt, row_number() OVER (PARTITION BY book_id, source, target, relation_type ORDER BY chapter_number, window_no, sentence) AS r, count(*) OVER (PARTITION BY book_id, source, target, relation_type) AS n FROM asked_typed),
near AS (SELECT book_id, source, target, l.chapter_number, l.position, CASE WHEN contains(any_value(l.excerpt), q.b) THEN any_value(l.excerpt) ELSE arg_min(m.excerpt, m.position) END AS excerpt FROM q JOIN mentions l ON l.name = q.a JOIN mentions m USING (book_id)
  WHERE m.name = q.b AND m.chapter_number = l.chapter_number AND abs(m.position - l.position) <= 220 AND l.chapter_number <= {BOUND} AND (book_id, source, target) NOT IN (SELECT (book_id, source, target) FROM asked_typed) GROUP BY book_id, source, target, q.b, l.chapter_number, l.position),
gf AS (SELECT *, row_number() OVER (PARTITION BY book_id, source, target ORDER BY chapter_number, position) AS r FROM near), g AS (SELECT *, count(*) OVER (PARTITION BY book_id, source, target) AS n FROM gf WHERE r <= 3),
f AS (SELECT book_id, source, target, relation_type, chapter_number, excerpt, r, n FROM kfr UNION ALL SELECT book_id, source, target, '{answers.UNCONFIRMED}', chapter_number, excerpt, r, n FROM g)
SELECT book_id, source, target, relation_type, min(chapter_number) AS first_chapter_number, any_value(n) AS mention_count, string_agg(chapter_number || ':' || excerpt, '|' ORDER BY r) FILTER (r <= 3) AS fragments, CAST(least(any_value(n), 3) AS BIGINT) AS stages FROM f GROUP BY book_id, source, target, relation_type""",
)
def relation_answers(t: Tables):
    """Asked pairs: their relations with fragments and stages, or the excerpts that speak for one."""
    asked = t.spark.createDataFrame(_ASKED, "source string, target string")
    out = answers.relation_answers(M.relations(_windows(t), RELATIONS), M.mentions(t.chapters, t.names), asked, BOUND)
    told = F.array_join(F.transform("fragments", lambda x: F.concat(x["chapter_number"].cast("string"), F.lit(":"), x["excerpt"])), "|")
    return out.withColumns({"fragments": told, "stages": F.size("stages")})


@query(
    "build_quality_report",
    f"""{_EVENTS}, {NAMES_SQL}, {mentions_sql('names')}, c AS (SELECT book_id, count(*) AS chapter_count, count(*) FILTER (chapter_number % 2 = 0) AS summary_count FROM chapters GROUP BY book_id),
n AS (SELECT book_id, count(DISTINCT name) AS entity_count FROM mentions GROUP BY book_id), e AS (SELECT book_id, count(*) AS event_count FROM events_found GROUP BY book_id)
SELECT book_id, chapter_count, coalesce(entity_count, 0) AS entity_count, coalesce(event_count, 0) AS event_count, summary_count, 'missing' AS vector_status,
  array_to_string(list_filter([CASE WHEN chapter_count <= 1 THEN 'few_chapters' END, CASE WHEN entity_count IS NULL THEN 'no_entities' END, CASE WHEN event_count IS NULL THEN 'no_events' END, CASE WHEN summary_count = 0 THEN 'no_summaries' END, 'no_vectors'], lambda x: x IS NOT NULL), ',') AS warnings
FROM c LEFT JOIN n USING (book_id) LEFT JOIN e USING (book_id)""",
)
def build_quality_report(t: Tables):
    """What an index of each book has; every second chapter counts as summarised, and there are no vectors."""
    chapters = t.chapters.select("book_id", "chapter_number")
    report = ingest.quality_report(chapters, M.rollup(M.mentions(t.chapters, t.names)), _events(t), chapters.filter("chapter_number % 2 = 0"), chapters.limit(0))
    return report.withColumn("warnings", F.array_join("warnings", ","))
