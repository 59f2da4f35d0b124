"""The registered queries of this package: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate as decon
from . import exact_dedup as exact
from . import line_dedup as lines
from . import chat, jaccard_join, langid, lm, mixing, phrases, pii, repair, toxicity, warc
from .sql import ORACLES

DIGEST = "doc_id"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = lines.apply_bitmaps(docs, lines.line_keep_bitmaps(docs), counts=True)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("source")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out(F.col("doc_id"), 0)))
    out = toxicity.score(docs, model)
    return out.select("doc_id", toxicity.held_out(F.col("doc_id"), 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = toxicity.held_out(F.col("doc_id"), 1)
    vocab, model, words = lm.fit(docs.where(~held_out).select(F.coalesce("text", F.lit("")).alias("text")))
    out = lm.score(docs, vocab, model, words)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(vocab.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op6_link_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    param = "struct<name:string,type:string,required:boolean>"
    tools = spark.createDataFrame([("answer", [("text", "string", True), ("words", "integer", True), ("after", "string", False)]), ("explain", [("text", "string", True), ("words", "string", True)])], f"name string, params array<{param}>")
    out = chat.link_tool_calls(chat.chats_as_tool_calls(table(spark, sf_dir, "conversations")), tools)
    return out.select("conv_id", "turn", "role", "kind", "call_id", "problems", "seq", F.sha2("json", 256).alias("json_sha256"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decon.contamination(decon.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents"), digest=True)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_private(table(spark, sf_dir, "documents"))
    count = [F.size(F.filter("base", pii.of_kind(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *count, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repair.damaged(table(spark, sf_dir, "conversations"))
    return repair.repair_report(repair.repaired(rows, repair.structure_edits(rows)))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = toxicity.held_out(F.col("doc_id"), 0)
    out = langid.identify(docs.select("doc_id", "text"), langid.fit(docs.where(~held_out)))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_line_dedup, op2_warc, op3_mix_sources, op4_toxicity, op5_lm_score, op6_link_tool_calls, op7_decontaminate, op8_jaccard_join, op9_exact_dedup, op10_pii, op11_collocations, op12_repair_conversations, op13_language_id)}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if k in QUERIES}
