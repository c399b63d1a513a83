"""Every stage of the pipeline on odd rows, clashing columns, empty tables and without labels."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marginalia.llm import pu_quality, toxicity

GOOD = "some words of a plain text that nobody would mind at all number"
ROWS = [
    (1, f"{GOOD} one and more to tell it apart", "a"), (1, f"{GOOD} one and more to tell it apart", "a"), (2, None, None), (3, "", "a"), (None, f"{GOOD} two without an id but with its own words", None),
    (4, " ".join(f"w{k}" for k in range(60_000)), "a"), (5, f"{GOOD} five", "b"), (6, f"{GOOD} five", "b"), (7, "too few words", "b"),
]
SCHEMA = "doc_id long, text string, source string"
CLASH = {"lang": "en", "kept": "mine", "slot": "mine", "score": "mine", "llr": "mine", "Block": "mine", "n_words": "mine", "n_tokens": "mine", "__n": "mine"}


def folder(spark, tmp_path, rows, labels):
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(v) for c, v in CLASH.items()}).withColumn("n_chars", F.length("text").cast("long"))
    docs.repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    return f"file://{tmp_path}", spark.read.parquet(f"file://{tmp_path}/documents.parquet")


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (5, 1, None), (7, 0, 1), (None, 1, 1)]])
def test_stages_on_odd_rows(spark, tmp_path, labels):
    sf_dir, docs = folder(spark, tmp_path, ROWS, labels)
    left = [1, 1, None, 5, 6] if labels else [1, 1, None, 4, 5, 6]  # with a target, 60,000 words that it hasn't got are unlike it
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert all(r[c] == v for r in rows for c, v in CLASH.items()), name
        if name.startswith("n-gram"):
            left = left[1:-1]  # of the repeated row one stays, and of the equal texts the first
        assert sorted(r.doc_id or 0 for r in rows) == sorted(i or 0 for i in left), name
        docs = spark.createDataFrame(rows, out.schema)
    assert corpus_pipeline.run(spark, sf_dir).count() == len(left)


def test_stages_on_an_empty_table(spark, tmp_path):
    sf_dir, docs = folder(spark, tmp_path, [], [(1, 1, 0)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.collect() == [], name
    assert corpus_pipeline.run(spark, sf_dir).collect() == []


def test_without_labels_nothing_is_toxic(spark, small, tmp_path):
    sf_dir, _ = folder(spark, tmp_path, ROWS, [])
    rows = toxicity.op1_toxicity(spark, sf_dir).collect()
    assert len(rows) == len(ROWS) and {(round(r.score, 9), r.predicted) for r in rows} == {(toxicity.RATE, 0)}


def test_texts_without_features_score_at_the_labels_rate(spark):
    rows = [(f"bad{k % 3} word{k}", 1.0) for k in range(30)] + [(f"fine{k % 7} thing{k}", 0.0) for k in range(270)]
    model = toxicity.fit(spark.createDataFrame(rows, "text string, y double"))
    out = toxicity.score(spark.createDataFrame([("",), (None,), ("bad1 bad2",), ("fine1 fine2",)], "text string"), model).collect()
    assert all(0.02 < r.score < 0.2 for r in out[:2]) and out[2].score > 0.5 > 0.1 > out[3].score


def test_copies_are_dealt_to_all_shards(spark, monkeypatch):
    monkeypatch.setattr(pu_quality, "SHARD_ROWS", 100)
    found = []
    monkeypatch.setattr(pu_quality, "dealt", lambda rows, *a: found.append(rows.groupBy("to").count().collect()) or rows.withColumn("shard", F.lit(0)).limit(0))
    copies = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("the same text").alias("text"))
    pu_quality.fit(copies.limit(5), copies, 0.5)
    counts = [r["count"] for r in found[0]]
    assert len(counts) >= 9 and max(counts) < 250
