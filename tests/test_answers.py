"""Composed answers: discovery, relations with what stands for them, evidence in order."""

import datetime as dt

from pyspark.sql import functions as F

from marginalia.operators import answers, mentions


def test_discovery_sifts_before_it_takes_the_longest(spark):
    runs = "。".join(["铜镜山门", "铜镜山", "我们他们"] * 9)
    texts = [(f"{runs}。他拿着《夜行录》走了。" + "x" * 60 + "【山门令】在手。",), ("起点的作者写了《网书名》这本小说。" + "y" * 60,), (None,)]
    names = [r.name for r in mentions.discovered(spark.createDataFrame(texts, "content string")).collect()]
    # 我们他们 isn't in the word lists, but its halves are; the book that the text speaks of as a book is no name.
    assert names == ["我们他们", "铜镜山门", "夜行录", "山门令"]
    assert mentions.discovered(spark.createDataFrame([], "content string")).collect() == []


def test_unconfirmed_relations_stand_in_for_missing_ones(spark):
    pairs = spark.createDataFrame([("b", "甲", "乙", "冲突", c, 0, f"甲乙{c}") for c in (1, 2, 4, 9)], "book_id string, source string, target string, relation_type string, chapter_number int, window_no int, sentence string")
    found = [("b", "甲", 1, 0, "甲在"), ("b", "乙", 1, 5, "乙"), ("b", "丙", 1, 100, "丙在此"), ("b", "甲", 3, 10, "甲丙"), ("b", "丙", 3, 50, "丙"), ("b", "丙", 3, 20, "近丙"), ("b", "丁", 5, 0, "丁"), ("b", "甲", 8, 0, "甲8"), ("b", "丙", 8, 1, "丙8")]
    spans = spark.createDataFrame(found, "book_id string, name string, chapter_number int, position int, excerpt string")
    asked = spark.createDataFrame([("甲", "乙"), ("甲", "丙"), ("甲", "丁")], "source string, target string")
    # Ends of a relation are in order of their code points.
    pairs = pairs.select("book_id", F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"), *pairs.columns[3:])
    rows = {(r.source, r.target): r for r in answers.relation_answers(pairs, spans, asked, 7).collect()}
    known, guess = rows[tuple(sorted("甲乙"))], rows[tuple(sorted("甲丙"))]
    assert set(rows) == {tuple(sorted("甲乙")), tuple(sorted("甲丙"))}
    assert (known.relation_type, known.first_chapter_number, known.mention_count, [f.chapter_number for f in known.fragments], len(known.stages)) == ("冲突", 1, 3, [1, 2, 4], 3)
    assert (guess.relation_type, guess.mention_count, [tuple(f) for f in guess.fragments]) == (answers.UNCONFIRMED, 2, [(1, "丙在此"), (3, "甲丙")])


def test_evidence_is_ordered_and_cut(spark):
    rows = [(1, k, r, "entity_timeline", None) for k, r in enumerate(["a", "b", "原文精确命中“x”", "c", "原文精确命中“y”"])]
    rows += [(2, k, "a", "compare", " Brief ") for k in range(3)] + [(3, k, "a", "other", None) for k in range(9)] + [(4, k, "a", "other", "详细") for k in range(9)]
    df = spark.createDataFrame(rows, "query_id int, seq int, reason string, intent string, answer_style string")
    kept = answers.kept_evidence(answers.ordered_evidence(df)).collect()
    assert [r.seq for r in sorted((r for r in kept if r.query_id == 1), key=lambda r: r["rank"])] == [2, 4, 0]
    assert [sum(r.query_id == q for r in kept) for q in (2, 3, 4)] == [1, 9, 4]


def test_lists_and_stamps(spark):
    r = spark.createDataFrame([("甲、、乙", dt.datetime(2024, 1, 31, 9, 5, 7)), (None, None)], "t string, at timestamp").select(answers.split_list(F.col("t")).alias("t"), answers.stamp(F.col("at")).alias("s")).collect()
    assert r[0].t == ["甲", "乙"] and tuple(r[0].s) == ("2024-01-31 09:05", "20240131-090507") and r[1].t == [] and r[1].s.shown is None
