"""A training corpus from raw documents: STAGES in order, each a function (spark, docs, sf_dir) -> DataFrame.

Every stage takes all that its predecessor kept; all but the last return the columns of ``docs``.  Whoever runs the stages writes each
result as Parquet and reads it again as the next one's docs; ``run`` does so in the folder that the cluster shares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm import decontaminate, jaccard_join, line_dedup, mixing, toxicity
from docspark.llm.common import stored


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars, where there is one, follows the text."""
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below 0.5; learned from the labels that aren't held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out(F.col("doc_id"), 0)))
    return toxicity.drop_toxic(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a document with a larger id has too."""
    return _measured(line_dedup.dedup_lines(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate component.  Documents that line dedup left empty are linked with nothing and stay."""
    return jaccard_join.keep_one(docs, jaccard_join.jaccard_components(docs))


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; those that are mostly benchmark go."""
    return _measured(decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, with n_times, taken and spans: how often, how much and what a training run reads of each."""
    return mixing.mixed_documents(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("jaccard_join", drop_near_duplicates), ("decontaminate", cut_benchmark), ("mix_sources", mix)]

#: The toxicity model isn't SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
