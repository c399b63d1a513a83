"""Merge, audit and review of index tables. Each function gives the new table; the caller writes it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def merge_first_seen(old: DataFrame, new: DataFrame, keys: list[str], chapter: str = "first_chapter_number") -> DataFrame:
    """Rows by key; the earlier chapter wins. Commutative, so late and repeated batches do no harm."""
    return old.select(*keys, chapter).unionByName(new.select(*keys, chapter)).groupBy(*keys).agg(F.min(chapter).alias(chapter))


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and those of ``new`` whose key isn't there, one row a key."""
    fresh = new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")
    return old.unionByName(fresh, allowMissingColumns=True)


def without_rejected(new: DataFrame, audit: DataFrame, keys: list[str]) -> DataFrame:
    """What was rejected once never comes back."""
    return new.join(audit.filter("status = 'rejected'").select(*keys).distinct(), keys, "left_anti")


def recount(parents: DataFrame, mentions: DataFrame, key: str) -> DataFrame:
    """First chapter and count of each parent from its live mentions; 0 for those without."""
    live = mentions.groupBy(key).agg(F.min("chapter_number").alias("first_chapter_number"), F.count("*").alias("mention_count"))
    kept = parents.drop("first_chapter_number", "mention_count")
    return kept.join(live, key, "left").withColumn("mention_count", F.coalesce("mention_count", F.lit(0).cast("long")))


def without_orphans(parents: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """Parents with a mention, and those without one that something still refers to."""
    return parents.filter("mention_count > 0").unionByName(parents.filter("mention_count = 0").join(references.select(key).distinct(), key, "left_semi"))


EVENT_KEYS = ("book_id", "chapter_number", "event_type")


def near_duplicate_events(events: DataFrame, id: str, threshold: float = 0.78) -> DataFrame:
    """(book_id, chapter_number, event_type, a, b): events (a < b, by ``id``) of one chapter and type with near duplicate excerpts.

    Each excerpt is reduced to its letters and character pairs once. Only events of one chapter meet.
    """
    bare = T.bare(F.col("excerpt"))
    made = F.inline(F.array(T.let(bare, lambda x: F.struct(x.alias("x"), F.array_sort(T.bigrams(x)).alias("g")))))
    rows = events.select(*EVENT_KEYS, F.col(id).alias("id"), made).filter("x <> ''")
    l, r = rows.alias("l"), rows.alias("r")
    same = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in EVENT_KEYS]
    nl, nr, common = F.size("l.g"), F.size("r.g"), F.size(F.array_intersect("l.g", "r.g"))
    holds = (F.least(F.length("l.x"), F.length("r.x")) >= 16) & (F.contains(F.col("l.x"), F.col("r.x")) | F.contains(F.col("r.x"), F.col("l.x")))
    alike = holds | (common >= threshold * (nl + nr - common)) | (common >= threshold * F.least(nl, nr))
    met = l.join(r, [*same, F.col("l.id") < F.col("r.id"), alike])
    return met.select(*[F.col(f"l.{k}").alias(k) for k in EVENT_KEYS], F.col("l.id").alias("a"), F.col("r.id").alias("b"))


def merge_events(old: DataFrame, new: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """Events (event_id, book_id, chapter_number, event_type, summary, excerpt, names) after a batch, whose events come in one after another, by event_id.

    One that is a near duplicate of an event of its chapter and type joins the first of them: names are united, and a longer excerpt that is alike, or whose summary is, replaces the event's. Others
    are added, so the batch may repeat itself. What is, or joins, an event in ``rejected`` (event_id) changes nothing. A chapter's events of one type are folded together in its row.
    """
    fields = ("event_id", "summary", "excerpt", "names", "barred")
    bars = F.lit(False) if rejected is None else None
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    if rejected is None:
        both = both.withColumn("barred", bars)
    else:
        flags = rejected.select("event_id").distinct().withColumn("barred", F.lit(True))
        both = both.join(flags, "event_id", "left").withColumn("barred", F.coalesce("barred", F.lit(False)))
    grouped = both.groupBy(*EVENT_KEYS).agg(F.array_sort(F.collect_list(F.struct("__new", *fields))).alias("rows"))
    pick = lambda x, **new: F.struct(*[new.get(c, x[c]).alias(c) for c in fields])
    alike = lambda e, x: T.near_duplicate(e["excerpt"], x["excerpt"]) | T.near_duplicate(e["summary"], x["summary"], 0.75)

    def joined(e: Column, x: Column) -> Column:
        better = (F.length(x["excerpt"]) > F.length(e["excerpt"])) & (T.near_duplicate(e["excerpt"], x["excerpt"], 0.68) | T.near_duplicate(e["summary"], x["summary"], 0.75))
        merged = pick(e, excerpt=F.when(better, x["excerpt"]).otherwise(e["excerpt"]), names=F.array_sort(F.array_union(e["names"], x["names"])))
        return F.when(e["barred"], pick(e)).otherwise(merged)

    def add(acc: Column, x: Column) -> Column:
        first = F.array_position(F.transform(acc, lambda e: alike(e, x)), F.lit(True))
        into = lambda at: F.when(at == 0, F.when(x["barred"], acc).otherwise(F.concat(acc, F.array(pick(x))))).otherwise(F.transform(acc, lambda e, i: F.when(i + 1 == at, joined(e, x)).otherwise(e)))
        return F.when(x["__new"] == 0, F.concat(acc, F.array(pick(x)))).otherwise(T.let(first, into))

    kind = "array<struct<" + ",".join(f"{c}:{dict(both.dtypes)[c]}" for c in fields) + ">>"
    folded = grouped.select(*EVENT_KEYS, F.inline(F.aggregate("rows", F.array().cast(kind), add)))
    return folded.select("event_id", *EVENT_KEYS, "summary", "excerpt", "names")


def merge_audit(old: DataFrame, new: DataFrame) -> DataFrame:
    """Audit rows (audit_id, confidence, source_query, evidence, original_evidence, status): new provenance overwrites, evidence that a person corrected and the status stay."""
    o, n = old.alias("o"), new.alias("n")
    has = F.col("o.audit_id").isNotNull()
    return o.join(n, F.col("o.audit_id") == F.col("n.audit_id"), "full_outer").select(
        F.coalesce("o.audit_id", "n.audit_id").alias("audit_id"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("n.confidence", "o.confidence"))).alias("confidence"),
        F.substring(F.coalesce("n.source_query", "o.source_query"), 1, 500).alias("source_query"),
        F.substring(F.when(has & (F.coalesce("o.original_evidence", F.lit("")) != ""), F.col("o.evidence")).otherwise(F.coalesce("n.evidence", "o.evidence")), 1, 1000).alias("evidence"),
        F.coalesce("o.original_evidence", F.lit("")).alias("original_evidence"),
        F.coalesce("o.status", "n.status", F.lit("pending")).alias("status"),
    )


def review(audit: DataFrame, actions: DataFrame) -> DataFrame:
    """Applies (audit_id, action, expected_version, evidence): confirm, correct or reject. A stale version or a rejected row changes nothing and is told in ``outcome``."""
    a, r = audit.alias("a"), actions.alias("r")
    rows = a.join(r, F.col("a.audit_id") == F.col("r.audit_id"), "left")
    asked = F.col("r.action").isNotNull()
    stale = asked & (F.col("r.expected_version") != F.col("a.review_version"))
    bad = asked & ~stale & ((F.col("a.status") == "rejected") | ~F.col("r.action").isin("confirm", "correct", "reject"))
    ok = asked & ~stale & ~bad
    correct = ok & (F.col("r.action") == "correct")
    return rows.select(
        "a.audit_id",
        F.when(ok & (F.col("r.action") == "reject"), "rejected").when(ok & (F.col("r.action") == "confirm"), "confirmed").when(correct, "corrected").otherwise(F.col("a.status")).alias("status"),
        F.when(correct, F.col("r.evidence")).otherwise(F.col("a.evidence")).alias("evidence"),
        F.when(correct, F.col("a.evidence")).otherwise(F.col("a.original_evidence")).alias("original_evidence"),
        (F.col("a.review_version") + ok.cast("int")).alias("review_version"),
        F.when(stale, "stale").when(bad, "invalid").when(ok, "applied").otherwise("none").alias("outcome"),
    )


def audit_stats(audit: DataFrame) -> DataFrame:
    """Counts by kind and status, with totals a kind and over all (nulls)."""
    return audit.rollup("record_kind", "status").agg(F.count("*").alias("n"))


def audit_pivot(audit: DataFrame, statuses: list[str]) -> DataFrame:
    return audit.groupBy("record_kind").pivot("status", statuses).count().na.fill(0)


def untracked(totals: DataFrame, tracked: DataFrame) -> DataFrame:
    """Dynamic rows of each kind that no audit row tracks, never below 0."""
    return totals.join(tracked, "record_kind", "left").select("record_kind", F.greatest(F.lit(0).cast("long"), F.col("dynamic_total") - F.coalesce("tracked", F.lit(0).cast("long"))).alias("legacy_untracked"))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; a plain aggregate, so it streams and combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__last"))
    return best.select(*keys, "__last.*")


def replace_book(path: str, rows: DataFrame) -> None:
    """Overwrites only the partitions of the books in ``rows``."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("book_id").parquet(path)


def dynamic_id(prefix, evidence):
    """A dynamic record's id: a prefix, and 16 hex digits of the evidence's SHA-1."""
    return F.concat(prefix, F.lit(":dynamic:"), F.substring(F.sha1(evidence), 1, 16))
