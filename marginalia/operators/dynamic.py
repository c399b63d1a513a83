"""The on-demand index: records that a model reads out of a question's hits, checked against these hits, and their audit.

Questions are rows, so many are answered at once: hits are (question_id, rank, chapter_number, chapter_title, child_text, parent_text), and what the model said is a payload a question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.names import is_name
from .payloads import EVENT_CUES, INDEX, RELATION_CUES, event_supported, relation_supported, tolerant

LEAST_CONFIDENCE, MOST_HITS, GATE = 0.68, 5, "grounded_v2"


def hit_text(child: Column, parent: Column, before: int = 100, after: int = 260) -> Column:
    """The parent's text around the child, or whichever of the two there is."""
    c, p = T.strip(F.coalesce(child, F.lit(""))), T.strip(F.coalesce(parent, F.lit("")))

    def around(c: Column, p: Column) -> Column:
        at = F.coalesce(F.nullif(F.instr(p, c), F.lit(0)), F.instr(p, F.substring(c, 1, 80)))
        start = F.greatest(at - 1 - before, F.lit(0))
        return F.when(at == 0, c).otherwise(T.strip(F.substring(p, start + 1, at - 1 + F.length(c) + after - start)))

    return T.let(c, lambda c: T.let(p, lambda p: F.when((c == "") | (p == ""), F.concat(c, p)).otherwise(around(c, p))))


def select_hits(hits: DataFrame, most: int = MOST_HITS) -> DataFrame:
    """(question_id, hit_no, chapter_number, chapter_title, text): a question's first hits with a text, of those that begin alike in one chapter the first."""
    rows = hits.withColumn("text", hit_text(F.col("child_text"), F.col("parent_text"))).filter("text <> '' and chapter_number > 0")
    once = rows.groupBy("question_id", "chapter_number", F.substring("text", 1, 80).alias("head")).agg(F.min_by(F.struct("rank", "chapter_title", "text"), "rank").alias("h"))
    no = F.row_number().over(Window.partitionBy("question_id").orderBy("h.rank", "chapter_number"))
    return once.withColumn("hit_no", no).filter(F.col("hit_no") <= max(1, most)).select("question_id", "hit_no", "chapter_number", "h.chapter_title", "h.text")


def validated(items: DataFrame, hits: DataFrame) -> DataFrame:
    """``items`` (question_id, raw, required (array of names), ...) with ``evidence`` (500 characters), ``chapter_number`` and ``chapter_title``, from the first hit that has the raw evidence
    with all names in it, else from the first that has all the names itself; items without either go. An item must have an ``item_no`` of its own in its question.
    """
    line = hits.select("question_id", "hit_no", "chapter_number", "chapter_title", T.collapse(F.col("text")).alias("line"))
    raw = T.collapse(F.coalesce("raw", F.lit("")))
    needed = F.filter("required", lambda x: x != "")
    rows = items.withColumns({"raw": raw, "required": needed}).join(line, "question_id")
    all_in = lambda s: F.forall("required", lambda n: F.contains(s, n))
    quoted = (F.col("raw") != "") & F.contains(F.col("line"), F.col("raw")) & all_in(F.col("raw"))
    kind = F.when(quoted, 0).when((F.size("required") > 0) & all_in(F.col("line")), 1)
    found = rows.withColumn("kind", kind).filter("kind is not null")
    proof = F.struct(F.substring(F.when(F.col("kind") == 0, F.col("raw")).otherwise(F.col("line")), 1, 500).alias("evidence"), "chapter_number", "chapter_title")
    best = found.groupBy("question_id", "item_no").agg(F.min_by(proof, F.struct("kind", "hit_no")).alias("p"))
    return items.drop("raw").join(best, ["question_id", "item_no"]).select(*[c for c in items.columns if c != "raw"], "p.*")


def _items(answers: DataFrame, part: str, least: float) -> DataFrame:
    """A payload's items of one part with their place, those of enough confidence; ``anchors`` are the question's known names."""
    parsed = answers.select("question_id", "anchors", "known", F.posexplode(tolerant(F.col("answer"), INDEX)[part]).alias("item_no", "i"))
    return parsed.filter(F.coalesce("i.confidence", F.lit(0.0)) >= least)


def with_anchors(questions: DataFrame, names: DataFrame) -> DataFrame:
    """Questions (question_id, question) with ``known``, all names of ``names`` (name; a dictionary), and ``anchors``, those that the question has."""
    known = names.filter("name <> ''").agg(F.array_sort(F.collect_set("name")).alias("known"))
    return questions.crossJoin(F.broadcast(known)).withColumn("anchors", F.filter("known", lambda n: F.contains(F.col("question"), n)))


def entity_records(answers: DataFrame, hits: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """(question_id, name, first_chapter_number, confidence, aliases, evidence): valid names with evidence. Where the question has anchors, a name must be one or stand with one."""
    rows = _items(answers, "entities", least).select("question_id", "anchors", "item_no", T.strip(F.coalesce("i.name", F.lit(""))).alias("name"), F.col("i.evidence").alias("raw"), F.col("i.aliases").alias("aliases"), F.col("i.confidence").alias("confidence"))
    rows = validated(rows.withColumn("required", F.array("name")), hits)
    near = (F.size("anchors") == 0) | F.array_contains("anchors", F.col("name")) | F.exists("anchors", lambda a: F.contains(F.col("evidence"), a))
    rows = rows.filter(is_name(F.col("name"), F.col("evidence")) & near)
    corpus = hits.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hit_no", "text"))), lambda x: x["text"]), "\n").alias("corpus"))
    other = rows.join(corpus, "question_id").select("question_id", F.col("name").alias("n"), "corpus", F.explode("aliases").alias("alias")).withColumn("alias", T.strip(F.col("alias")))
    other = other.filter(is_name(F.col("alias"), F.col("corpus")) & F.contains("corpus", "alias") & (F.col("alias") != F.col("n"))).groupBy("question_id", F.col("n").alias("name")).agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    one = rows.groupBy("question_id", "name").agg(F.min("chapter_number").alias("first_chapter_number"), F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("evidence")).alias("evidence"))
    return one.join(other, ["question_id", "name"], "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def _may_be(name: Column, known: Column) -> Column:
    return F.array_contains(known, name) | is_name(name)


def relation_records(answers: DataFrame, hits: DataFrame, entities: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """(question_id, source, target, relation_type, first_chapter_number, confidence, evidence): by ordered ends and known type, with a cue of the type in the evidence, and an anchor at one end if there are any."""
    rows = _items(_widened(answers, entities), "relations", least).select("question_id", "anchors", "known", "item_no", *[T.strip(F.coalesce(f"i.{c}", F.lit(""))).alias(c) for c in ("source", "target", "type")], F.col("i.evidence").alias("raw"), F.col("i.confidence").alias("confidence"))
    ends = (F.col("source") != F.col("target")) & _may_be(F.col("source"), F.col("known")) & _may_be(F.col("target"), F.col("known"))
    near = (F.size("anchors") == 0) | F.array_contains("anchors", F.col("source")) | F.array_contains("anchors", F.col("target"))
    rows = validated(rows.filter(ends & near & F.col("type").isin(*RELATION_CUES)).withColumn("required", F.array("source", "target")), hits)
    rows = rows.filter(relation_supported(F.col("type"), F.col("evidence")))
    return rows.groupBy("question_id", F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"), F.col("type").alias("relation_type")).agg(
        F.min("chapter_number").alias("first_chapter_number"), F.max("confidence").alias("confidence"), F.transform(F.array_sort(F.collect_list(F.struct("item_no", "evidence"))), lambda x: x["evidence"]).alias("evidence"))


def event_records(answers: DataFrame, hits: DataFrame, entities: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """(question_id, chapter_number, chapter_title, event_type, summary, excerpt, names, confidence): events of a known type with names, once a chapter and evidence, supported by it."""
    rows = _items(_widened(answers, entities), "events", least).select("question_id", "anchors", "known", "item_no", T.strip(F.coalesce("i.type", F.lit(""))).alias("event_type"), F.col("i.summary").alias("said"), F.col("i.evidence").alias("raw"), F.transform(F.coalesce("i.entities", F.array().cast("array<string>")), T.strip).alias("names"), F.col("i.confidence").alias("confidence"))
    rows = rows.withColumn("names", F.filter("names", lambda n: _may_be(n, F.col("known")))).filter(F.size("names") > 0)
    near = (F.size("anchors") == 0) | F.arrays_overlap("anchors", "names")
    rows = validated(rows.filter(near & F.col("event_type").isin(*EVENT_CUES)).withColumn("required", F.col("names")), hits)
    summary = F.substring(T.strip(F.coalesce(F.nullif("said", F.lit("")), "evidence")), 1, 120)
    rows = rows.withColumn("summary", summary).filter(event_supported(F.col("event_type"), F.col("summary"), F.col("evidence")))
    fields = ("chapter_title", "event_type", "summary", "names", "confidence")
    once = rows.groupBy("question_id", "chapter_number", F.col("evidence").alias("excerpt")).agg(F.min_by(F.struct(*fields), "item_no").alias("e"))
    return once.select("question_id", "chapter_number", "e.chapter_title", "e.event_type", "e.summary", "excerpt", "e.names", "e.confidence")


def _widened(answers: DataFrame, entities: DataFrame) -> DataFrame:
    """Answers whose known names have those of the question's records too."""
    found = entities.groupBy("question_id").agg(F.collect_set("name").alias("__n"))
    return answers.join(found, "question_id", "left").withColumn("known", F.array_union("known", F.coalesce("__n", F.array().cast("array<string>")))).drop("__n")


def build_records(answers: DataFrame, hits: DataFrame, least: float = LEAST_CONFIDENCE, most: int = MOST_HITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, relations, events) of answers (question_id, question, anchors, known, answer). Entities are those that a relation, an event or the question names."""
    chosen = select_hits(hits, most)
    entities = entity_records(answers, chosen, least)
    relations, events = relation_records(answers, chosen, entities, least), event_records(answers, chosen, entities, least)
    used = answers.select("question_id", F.explode("anchors").alias("name")).union(relations.select("question_id", F.explode(F.array("source", "target")))).union(events.select("question_id", F.explode("names")))
    return entities.join(used.distinct(), ["question_id", "name"], "left_semi"), relations, events


def dynamic_only(rows: DataFrame, id: str) -> DataFrame:
    """Rows that came from questions, by their id."""
    return rows.filter(F.contains(F.col(id), F.lit(":dynamic:")))


def audit_list(audit: DataFrame, live: dict[str, DataFrame], status: str | None = None, limit: int = 100) -> DataFrame:
    """The latest audit rows (audit_id, record_kind, record_id, status, evidence, updated_at) with ``live_text``, what the record says now (``live``: kind -> (record_id, text)), and ``missing``.

    A status must be a known one; the limit is clamped to 1 to 500. Only the rows that are listed meet the records.
    """
    if status is not None and status not in ("pending", "confirmed", "corrected", "rejected"):
        raise ValueError(f"unknown status: {status}")
    rows = audit if status is None else audit.filter(F.col("status") == status)
    rows = rows.orderBy(F.desc("updated_at"), "audit_id").limit(max(1, min(500, limit)))
    now = None
    for kind, df in live.items():
        one = df.select(F.lit(kind).alias("record_kind"), "record_id", F.col("text").alias("live_text"))
        now = one if now is None else now.unionByName(one)
    return rows.join(now, ["record_kind", "record_id"], "left").withColumn("missing", F.col("live_text").isNull())


def corrected(records: DataFrame, changes: DataFrame, protect_static: bool = False) -> DataFrame:
    """``records`` (record_id, excerpt, perhaps summary) with the excerpts, and summaries where they aren't blank, of ``changes`` (record_id, evidence, summary). Static events are protected."""
    c = changes.select(F.col("record_id").alias("__id"), "evidence", F.col("summary").alias("__s"))
    rows = records.join(c, F.col("record_id") == F.col("__id"), "left")
    ok = F.col("__id").isNotNull() & (F.contains("record_id", F.lit(":event:dynamic:")) if protect_static else F.lit(True))
    new = {"excerpt": F.when(ok, F.col("evidence")).otherwise(F.col("excerpt"))}
    if "summary" in records.columns:
        new["summary"] = F.when(ok & (F.coalesce("__s", F.lit("")) != ""), F.col("__s")).otherwise(F.col("summary"))
    return rows.withColumns(new).select(*records.columns)


def rejected(parents: DataFrame, mentions: DataFrame, rejects: DataFrame, references: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(parents, mentions) after mentions in ``rejects`` (mention_id) go: counts and first chapters are made anew, and parents of which nothing is left go, unless ``references`` (key) has them."""
    from .maintain import recount, without_orphans

    left = mentions.join(rejects.select("mention_id").distinct(), "mention_id", "left_anti")
    touched = mentions.join(rejects.select("mention_id").distinct(), "mention_id", "left_semi").select(key).distinct()
    fresh = without_orphans(recount(parents.join(touched, key, "left_semi"), left, key), references, key)
    return parents.join(touched, key, "left_anti").unionByName(fresh.select(*parents.columns)), left


def merge_records(parents: DataFrame, mentions: DataFrame, new: DataFrame, audit: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(parents, mentions) after new mentions (keys, mention_id, chapter_number, excerpt): rejected ones stay away, known ones aren't repeated, and the parents that they touch are counted anew."""
    from .maintain import insert_missing, without_rejected

    fresh = without_rejected(new.withColumn("record_id", F.col("mention_id")), audit, ["record_id"]).drop("record_id")
    every = insert_missing(mentions, fresh.select(*mentions.columns), ["mention_id"])
    counted = every.groupBy(*keys).agg(F.min("chapter_number").alias("first_chapter_number"), F.count("*").alias("mention_count"))
    touched = fresh.select(*keys).distinct()
    kept = parents.join(touched, keys, "left_anti")
    return kept.unionByName(counted.join(touched, keys, "left_semi"), allowMissingColumns=True), every
