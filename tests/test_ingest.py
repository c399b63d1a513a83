"""Chapters, chunks and lexicons on small written texts."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.operators import ingest
from marginalia.sources import readers

BOOKS = {
    "plain": ("第1章 晨雾\n沈微捡到铜镜。\n第2章 渡口\n陌生船夫出现。\n", ["晨雾", "渡口"]),
    "volume": ("第一卷 北境\n第一节：出发\n甲。\n第二卷 南海\n第一节 归来\n乙。\n", ["第一卷 北境 / 出发", "第二卷 南海 / 归来"]),
    "gap": ("第1章 甲\nx\n第9章 乙\ny\n", ["甲", "乙"]),
    "prelude": ("序言文字\n第1章 甲\nx\n", ["第1章", "甲"]),
    "none": ("Only prose.\nMore prose.", ["全文"]),
    "crlf": ("　　第一节 起\r\nx\r\n", ["起"]),
    "english": ("Chapter 1 Dawn\ntext\n", ["Chapter 1 Dawn"]),
}


@pytest.fixture(scope="module")
def chapters(spark):
    return ingest.parse_chapters(readers.inline_books(spark, [(k, v[0]) for k, v in BOOKS.items()])).collect()


@pytest.mark.parametrize("name", sorted(BOOKS))
def test_headings(chapters, name):
    own = sorted((r for r in chapters if r.book_id == name), key=lambda r: r.chapter_number)
    assert [r.title for r in own] == BOOKS[name][1]
    assert [r.chapter_number for r in own] == list(range(1, len(own) + 1))


@settings(max_examples=60, deadline=None)
@given(st.text("ab。\n ", max_size=400), st.integers(20, 90), st.integers(0, 19))
def test_windows_cover_the_text(text, target, overlap):
    pieces = ingest.spans(text, target, overlap)
    assert all(p and len(p) <= target + ingest.LOOK_AHEAD for p in pieces)
    assert set("".join(pieces)) - set(" \n") == set(text) - set(" \n")
    at = -1
    for p in pieces:
        found = text.find(p, at + 1) if at >= 0 else text.find(p)
        assert found >= 0 or p in text
        at = max(at, found)
    assert bool(pieces) == bool(text.strip())


def test_children_carry_their_lineage(spark):
    rows = spark.createDataFrame([("b", 1, "t", "词。" * 1500), ("b", 2, "u", "short"), ("b", 3, "v", None)], "book_id string, chapter_number int, title string, content string")
    parents, children = ingest.chunk_hierarchy(rows)
    ids = {r.chunk_id for r in parents.collect()}
    kids = children.collect()
    assert {r.parent_id for r in kids} == ids
    assert {r.chapter_number for r in kids} == {1, 2}
    assert len({r.chunk_id for r in kids}) == len(kids)
    assert {r.chapter_number for r in ingest.search_rows(parents, children, 1).collect()} == {1}


def test_lexicon_lines(spark):
    got = {r.name: r.aliases for r in readers.inline_lexicon(spark, "# note\n沈微\n船夫|摆渡人，撑船的\n\n铜镜|古镜, 古镜\n").collect()}
    assert got == {"沈微": [], "船夫": ["摆渡人", "撑船的"], "铜镜": ["古镜"]}


def test_cases_are_checked(spark, tmp_path):
    good = '{"id":"a","book_id":"b","query":"q","relevant_chapters":[2,2,1],"max_chapter":3}'
    for name, text in {"good": f"# c\n\n{good}\n", "twice": f"{good}\n{good}\n", "zero": good.replace("[2,2,1]", "[0]"), "beyond": good.replace("[2,2,1]", "[4]"), "broken": "{oops"}.items():
        (tmp_path / f"{name}.jsonl").write_text(text)
    assert readers.cases(spark, f"file://{tmp_path}/good.jsonl").collect()[0].relevant_chapters == [2, 1]
    for name in ("twice", "zero", "beyond", "broken"):
        with pytest.raises(Exception, match="."):
            readers.cases(spark, f"file://{tmp_path}/{name}.jsonl").collect()


def test_parts_read_as_one_text(spark):
    texts = ["序\n第一卷 北\n第一节 甲", "a\n第二节 乙\nb", "c", "", "第二卷 南\nx\n第一节 丙\nd", None, "e\n第三节 丁"]
    rows = [("long", i * 700, t) for i, t in enumerate(texts)] + [("plain", 1, "u"), ("plain", 5000, "v"), (None, 0, "第1章 w\nz")]
    parts = spark.createDataFrame(rows, "book_id string, part int, text string")
    whole = ingest.source_text(parts.select("book_id", parts.part.alias("chapter_number"), F.coalesce("text", F.lit("")).alias("content")))
    key = lambda r: (r.book_id or "", r.chapter_number)
    got = sorted(ingest.parse_chapters(parts).collect(), key=key)
    assert got == sorted(ingest.parse_chapters(whole).collect(), key=key)
    assert [r.title for r in got if r.book_id == "long"] == ["第1章", "第一卷 北 / 甲", "第一卷 北 / 乙", "第4章", "第二卷 南 / 丙", "第二卷 南 / 丁"]
    assert [(r.title, r.content) for r in got if r.book_id == "plain"] == [("全文", "u\n\nv")]


def test_running_over_blocks(spark):
    rows = [("a", i * 300, i, f"v{i}" if i % 4 == 1 else None) for i in range(40)] + [("b", 0, 5, None), (None, 3, 1, "n"), (None, 9000, 2, None)]
    got = ingest.running(spark.createDataFrame(rows, "k string, at int, n int, v string"), "k", "at", ("n",), ("v",)).collect()
    assert len(got) == len(rows)
    for r in got:
        before = [x for x in rows if x[0] == r.k and x[1] < r["at"]]
        assert (r.before_n, r.before_v) == (sum(x[2] for x in before), ([None] + [x[3] for x in before if x[3]])[-1])


def long_book(lines, seed=1):
    rng = random.Random(seed)
    out = ["序言"]
    for k in range(lines):
        out.append(f"第{k // 40 + 1}卷 山" if k % 400 == 399 else f"第{k}章 夜行{k}" if k % 40 == 5 else rng.choice(["", "　少年走进山门。", "Ünïcödé 😀 text " * 3, "他说：“走。”", "x"]) + str(k % 7))
    return out


@pytest.mark.parametrize(("end", "last"), [("\n", ""), ("\n", "\n"), ("\r\n", "\r\n"), ("\r", "")])
def test_long_book_in_parts_is_the_whole_book(spark, tmp_path, end, last):
    text = end.join(long_book(3000)) + last
    (tmp_path / "one.book.txt").write_bytes(text.encode())
    (tmp_path / "plain.txt").write_bytes((end.join(["没有标题 😀", "", "第二行"] * 500) + last).encode())
    (tmp_path / "empty.txt").write_bytes(b"")
    whole = ingest.parse_chapters(readers.books(spark, f"file://{tmp_path}")).filter("book_id <> 'empty'").collect()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7001")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        parts = readers.book_parts(spark, f"file://{tmp_path}", 2000)
        if end != "\r":
            assert parts.filter("book_id = 'one.book'").select(F.spark_partition_id()).distinct().count() > 8
        assert parts.agg(F.max(F.length("text"))).first()[0] < (2100 if end != "\r" else 10**6)
        got = ingest.parse_chapters(parts, joined="\n").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(whole) > 70 and sorted(map(tuple, got)) == sorted(map(tuple, whole))


def test_volumes_scope_the_chapters_behind_them(spark):
    book = "序言文字\n第一卷 北境\n第一节：出发\n甲走了。\n\n第二节 夜\n乙。\n第二卷 南海\n　　第一节 归来\n丙回来了。\n第9章\n丁。"
    books = spark.createDataFrame([("b1", book), ("b2", "没有标题。\n第一卷 只有卷\n")], "book_id string, text string")
    want = [("b1", 1, "第1章", "序言文字", 0, 5), ("b1", 2, "第一卷 北境 / 出发", "甲走了。", 7, 23), ("b1", 3, "第一卷 北境 / 夜", "乙。", 25, 37), ("b1", 4, "第二卷 南海 / 归来", "丙回来了。", 39, 56), ("b1", 5, "第二卷 南海 / 第9章", "丁。", 58, 73), ("b2", 1, "全文", "没有标题。\n第一卷 只有卷", 0, 13)]
    assert sorted(tuple(r)[:4] for r in ingest.parse_chapters(books).collect()) == [w[:4] for w in want]


def test_long_texts_of_one_batch_are_cut_in_portions(spark):
    """All texts of a batch are cut whole, and no more than a portion's windows are held at once."""
    import pyarrow as pa

    texts = [None, "", "x. " * 400_000, *("ab. " * k for k in range(300))]
    cut = ingest._cut(100, 10, ".\n").func
    sizes = []
    for part in cut(iter([pa.array(texts)])):
        sizes.append(len(part))
    assert sum(sizes) == len(texts) and sizes == [2, 1, 300]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    got = {r.i: r.c for r in df.select("i", ingest._cut(100, 10, ".\n")("t").alias("c")).collect()}
    assert got == {i: ingest.spans(t or "", 100, 10, ".\n") for i, t in enumerate(texts)}
