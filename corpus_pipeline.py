"""A training corpus from raw documents: quality rules, toxicity, near duplicates, mixing, BPE.

Each stage takes all that its predecessor kept; all but the last return the columns of ``documents`` as they came, whatever their names, and whatever other columns there are.

Null and empty texts fail the quality rules; rows without an id are decided by their text alone; repeated rows, and so ties, are decided alike; long texts are read whole; empty
tables stay empty. Without labels the quality rules apply their base rules only, and no text is toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.llm import bpe, mixing, quality_rules, toxicity
from marginalia.llm.base import documents, written
from marginalia.llm.jaccard_join import jaccard_components

#: Near duplicates: shingles of five words, and a similarity of at least 0.8.
SHINGLE_WORDS, PERCENT = 5, 80


def around(docs: DataFrame, names, stage) -> DataFrame:
    """``stage(docs)`` with the columns of ``docs``, those of ``names``, which the stage makes for itself, out of its way."""
    away = {c: f"__own_{c}" for c in docs.columns if c.lower() in names}
    return stage(docs.withColumnsRenamed(away)).select(*[F.col(f"`{away.get(c, c)}`").alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    ratios = quality_rules.fit_ratios(docs, quality_rules.trusted(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return around(docs, quality_rules.RESULT, lambda d: quality_rules.quality_rules(d, ratios).filter("kept"))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    model = toxicity.train_toxicity(spark, docs, sf_dir)
    return around(docs, ("__score",), lambda d: toxicity.score(d, model, into="__score").filter(F.col("__score") < toxicity.THRESHOLD))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays; of rows that repeat it, the first by text. Rows without an id stay."""
    found = jaccard_components(docs, SHINGLE_WORDS, PERCENT)
    keep = found.filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    kept = around(docs, ("__n",), lambda d: d.join(keep, "doc_id", "left_semi").withColumn("__n", first).filter("__n = 1"))
    return kept.unionByName(docs.filter("doc_id is null"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order of the mix: range by range of slots, and sorted inside."""
    return around(docs, mixing.RESULT, lambda d: mixing.mix(d).repartitionByRange("slot", "place").sortWithinPartitions("slot", "place"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests instead of texts, with the slot and place of each document in the mix: rows read back from files have no order of their own."""
    import public_tokenizers

    coded = written(bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json")), "coded")
    return mixing.mix(coded).drop("block", "release", "deadline")


STAGES = [("quality rules", quality), ("toxicity", toxic), ("n-gram Jaccard join", near_duplicates), ("mixing", mixed), ("BPE", tokens)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
