"""Nulls, empty and long texts, repeated rows, clashing column names and empty tables."""

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from marginalia.llm import bpe, hilbert_shards, jaccard_join, maxent_lm, mixing, pu_quality, quality_rules, simhash, toxicity, warc
from marginalia.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, slot string, `curve` string"
ROWS = [
    (1, "one two three four five six seven eight nine ten eleven", "en", "a", 1, 0.5, "x", "y"),
    (1, "one two three four five six seven eight nine ten eleven", "en", "a", 1, 0.5, "x", "y"),
    (2, None, None, None, None, None, None, None),
    (3, "", "en", "a", 0, None, None, None),
    (None, "no id here but some words all the same, enough of them", "en", None, 3, None, None, None),
    (4, "long " * 60_000, "de", "a", 300_000, None, None, None),
    (5, " \t\n\x0b\x0c\r ", "fr", "b", 7, None, None, None),
    (6, "dup line\ndup line\n\n\ndup line", "fr", "b", 7, None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module", params=["rows", "empty"])
def both(request, odd):
    return (odd, len(ROWS)) if request.param == "rows" else (odd.limit(0), 0)


def test_toxicity(both):
    df, n = both
    model = toxicity.fit(df.withColumn("y", F.when(F.col("doc_id") > 1, 1.0).otherwise(0.0)))
    out = toxicity.score(df, model)
    rows = out.collect()
    assert len(rows) == n and set(out.columns) == set(df.columns)
    assert all(0 <= r.score <= 1 for r in rows)


def test_quality(both):
    df, n = both
    w = pu_quality.fit(df.filter("doc_id = 1"), df, 0.5)
    rows = pu_quality.score(df, w).collect()
    assert len(rows) == n and all(0 <= r.score <= 1 for r in rows)


def test_jaccard(both):
    df, n = both
    rows = jaccard_join.jaccard_components(df).collect()
    assert len(rows) == n
    for r in rows:
        assert r.component_id == r.doc_id
    if n:
        assert {(r.doc_id, r.n_shingles) for r in rows} == {(1, 8), (2, 0), (3, 0), (None, 9), (4, 1), (5, 0), (6, 2)}


def test_shards(both):
    df, n = both
    rows = hilbert_shards.hilbert_shards(df, ["source", "lang", "n_chars"], [F.col("doc_id"), F.col("text")]).collect()
    assert len(rows) == n
    assert sorted({r.shard for r in rows}) == list(range(min(n, 8)))


def test_quality_rules(both, spark):
    df, n = both
    ratios = quality_rules.fit_ratios(df, spark.createDataFrame([(1,)], "doc_id long"))
    rows = quality_rules.quality_rules(df, ratios).collect()
    assert len(rows) == n
    assert {r.doc_id: r.n_words for r in rows} == ({1: 11, 2: 0, 3: 0, None: 12, 4: 60_000, 5: 0, 6: 6} if n else {})
    assert {r.doc_id: r.n_dup_lines for r in rows if r.doc_id == 6} == ({6: 2} if n else {})


def test_simhash(both):
    df, n = both
    rows = simhash.edited_fingerprints(df).collect()
    assert len(rows) == n
    assert {r.fingerprint for r in rows if r.doc_id in (2, 3, 5)} == ({"0" * 16} if n else set())
    assert len({r.fingerprint for r in rows if r.doc_id == 1}) == min(n, 1)


def test_mixing(both):
    df, n = both
    rows = mixing.mix(df, block_rows=1).collect()
    assert len(rows) == n
    assert sorted(r.slot for r in rows) == list(range(n))


def test_bpe(both):
    import public_tokenizers

    df, n = both
    rows = bpe.encode(df, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert len(rows) == n
    assert {r.doc_id for r in rows if r.n_tokens == 0} == ({2, 3, 5} if n else set())


def test_maxent(both):
    df, n = both
    counts = maxent_lm.count_tokens(df)
    vocabulary = maxent_lm.Vocabulary(counts)
    weights = maxent_lm.train(df, vocabulary, F.lit(0))
    rows = maxent_lm.score(df, counts, vocabulary, weights).collect()
    assert len(rows) == n
    assert all(r.n_known == r.n_tokens and r.score < 0 and r.base_score < 0 for r in rows)


def test_warc(spark, tmp_path):
    page = "<p>" + "x" * 200
    pages = spark.createDataFrame([(1, "u", page), (2, None, page), (2, "u", page), (3, "u\r\nv", None), (4, "u", "")], "page_id long, url string, html string")
    for df, n in ((pages, 5), (pages.limit(0), 0)):
        path = f"file://{tmp_path}/{n}"
        (tmp_path / str(n)).mkdir()
        got = warc.read_archives(warc.archive_contents(spark, warc.write_archives(warc.plan_records(df), path))).collect()
        assert sorted((r.page_id, r.record_type, r.refers_to) for r in got if not r.gap and r.refers_to) == ([(2, "revisit", 1)] * 2 if n else [])
        assert len(got) == n


def test_salvage_quarantines_what_is_damaged():
    one = [warc.record(i, "u", b"body %d" % i, __import__("hashlib").sha256(b"body %d" % i).hexdigest(), 6, None) for i in range(4)]
    packed = [warc.member(r) for r in one]
    broken = packed[1][:20] + b"\0" * 8 + packed[1][28:]
    data = packed[0] + broken + packed[2] + one[3].replace(b"body 3", b"bodY 3") + one[3] + packed[3][:-9]
    found = list(warc.salvage(data))
    ids = [f[3]["warc-record-id"] for f in found if f[0] == "record"]
    assert ids == ["<urn:page:0>", "<urn:page:2>", "<urn:page:3>"]
    at = 0
    for f in found:
        assert f[1] == at
        at += f[2]
    assert at == len(data)
    assert sum(f[0] == "gap" for f in found) == 3


def archive_of(*bad):
    body = [(b"%d " % i) + bytes((i * 7919 + k * k * 31) % 251 for k in range(3000)) for i in range(5)]
    rows = [warc.record(i, "u", b, hashlib.sha256(b).hexdigest(), len(b), None) for i, b in enumerate(body)]
    return [r.replace(b"\r\n\r\n%d " % i, b"\r\n\r\n! ") if i in bad else r for i, r in enumerate(rows)]


def found_in(data):
    found = list(warc.salvage(data))
    return [int(f[3]["warc-record-id"][10:-1]) for f in found if f[0] == "record"], found


@pytest.mark.parametrize("bad", [(0,), (2,), (4,), (0, 1, 4), ()])
def test_salvage_reads_on_behind_a_bad_record_of_a_member(bad):
    rows = archive_of(*bad)
    ids, found = found_in(warc.member(b"".join(rows)))
    assert ids == [i for i in range(5) if i not in bad]
    at = 0
    for f in found:
        assert f[5][0] == at
        at += f[5][1]
    assert at == sum(map(len, rows))
    assert {f[5] for f in found if f[0] == "gap"} >= {(sum(map(len, rows[:i])), len(rows[i])) for i in bad if i - 1 not in bad and i + 1 not in bad}


@pytest.mark.parametrize("level", [0, 6])
def test_salvage_reads_a_damaged_member_up_to_the_damage(level):
    rows = archive_of()
    data = gzip.compress(b"".join(rows), level)
    first = warc.member(rows[4])
    ids, found = found_in(first + data[: len(data) * 7 // 10] + first)
    assert ids == [4, 0, 1, 2, 4]
    spans = sorted({f[1:3] for f in found})
    assert [a + n for a, n in spans] == [*(a for a, _ in spans[1:]), 2 * len(first) + len(data) * 7 // 10]
    assert sum(f[0] == "gap" for f in found) == 1


def test_archives_of_one_member_are_read_as_rows(spark):
    rows = archive_of(1)
    files = spark.createDataFrame([("f", bytearray(warc.member(b"".join(rows))))], "path string, content binary")
    got = warc.read_archives(files).collect()
    assert [(r.page_id, r.gap, r.inner_length) for r in got] == [(None if i == 1 else i, i == 1, len(x)) for i, x in enumerate(rows)]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (200, 201)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), **dict.fromkeys(range(100, 160), 100), 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("leaf", [4096, 8])
def test_hilbert_cuts_are_exact_quantiles_of_all_rows(spark, monkeypatch, leaf):
    """More rows than a sample of 16,384 would have; their cuts are the order statistics of all."""
    monkeypatch.setattr(hilbert_shards, "LEAF", leaf)
    monkeypatch.setattr(hilbert_shards, "SPLITS", 31)
    n = 40_000 if leaf > 8 else 3_000
    df = spark.range(n).selectExpr("pow(id % 9973, 2) as x", "if(id % 7 = 0, null, concat('w', sha2(string(id), 256))) as w", "if(id % 3 = 0, double('nan'), cast(id % 5 as double)) as f", "cast(null as int) as z")
    rows = df.collect()
    want = []
    for c in ("x", "w", "f", "z"):
        values = sorted(r[c] for r in rows if r[c] is not None and r[c] == r[c])
        want.append(sorted({values[k * len(values) // 16] for k in range(1, 16)}) if values else [])
    assert hilbert_shards.cuts_of(df, ["x", "w", "f", "z"], 16) == want
