"""Token counts against the tokenizers library."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marginalia.llm import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "   ", "  a  b \n\n c", "<|endoftext|>", "a<|endoftext|> <|endoftext|>b", "<|endoftext", "<|endoftext|><|endoftext|>\n", "don't I'LL we've 'S 's", "x  y z", "\x85\x1c\x00",
    "日本語テキスト。" * 50, "é" * 3000, "é" * 50, "😀😀 😀👩‍👩‍👧", "x" * 50_000, "ab" * 20_000, " " * 30_000, "1234567 ٣٤٥ Ⅷ", "ᚠᛇᚻ ᏣᎳᎩ",
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def vocabulary():
    return token_counts.Vocabulary(PATH)


def test_whole_tokens_are_proved(vocabulary, library):
    whole = sorted(vocabulary.whole)
    assert len(whole) > 45_000
    assert set(library([w for w in whole if w not in vocabulary.specials])) == {1}


def test_odd_texts_count_as_in_the_library(vocabulary, library):
    assert token_counts.TokenCounter(vocabulary)(ODD) == library(ODD)


def test_every_character_is_cut_as_in_the_library(vocabulary, library):
    points = [i for i in range(0x30000) if not 0xD800 <= i < 0xE000]
    texts = [f"a{chr(x)}b 1{chr(x)}2 .{chr(x)}. {chr(x)} x {chr(x)}" for x in points]
    assert token_counts.TokenCounter(vocabulary)(texts) == library(texts)


def test_small_caches_and_runs_change_nothing(vocabulary, library, monkeypatch):
    monkeypatch.setattr(token_counts, "KEPT", 3)
    monkeypatch.setattr(token_counts, "TEXTS_CHARS", 40)
    monkeypatch.setattr(token_counts, "TOGETHER", 6)
    texts = ODD[:12] + ["some words sesquipedalianly unheardoflike again", "unheardoflike"] * 20
    assert token_counts.TokenCounter(vocabulary)(texts) == library(texts)


def test_query_counts_whole_table_as_the_library(spark, small, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = token_counts.op13_token_counts(spark, small).collect()
    want = dict(zip(docs, library(list(docs.values())), strict=True))
    assert len(rows) == len(docs)
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows} == {i: (len(t.encode()), want[i], want[i] > 512) for i, t in docs.items()}


def test_odd_rows_and_empty_tables(spark, library):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, None, None), (2, "", "y"), (3, "word " * 200_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").withColumn("n_bytes", F.lit("clash"))
    out = token_counts.count_tokens(df, PATH)
    assert sorted(out.columns) == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in out.collect()) == [
        (0, 0, 0, False), (1, 3, 2, False), (1, 3, 2, False), (2, 0, 0, False), (3, 1_000_000, library(["word " * 200_000])[0], True),
    ]
    assert token_counts.count_tokens(df.limit(0), PATH).collect() == []


def test_other_kinds_of_files_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        token_counts.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))
