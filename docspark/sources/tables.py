"""Readers and writers of files: inventories, glossaries, nested JSON, versioned artifacts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Glossary headers by canonical column, and yes/no words.
GLOSSARY_HEADERS = {
    "source_term": ("source_term", "source", "english", "term", "en"), "target_term": ("target_term", "target", "translation"), "note": ("note", "notes", "comment"),
    "case_sensitive": ("case_sensitive", "case sensitive"), "do_not_translate": ("do_not_translate", "do not translate", "dnt"),
}
YES, NO = ("yes", "y", "true", "1", "x", "ja", "oui", "sí", "si"), ("", "no", "n", "false", "0", "nein", "non")


def file_inventory(spark: SparkSession, path: str, suffixes: Sequence[str], most_bytes: int) -> DataFrame:
    """Files under a path: path, length, suffix, accepted (an allowed suffix and not too large); contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.select("path", "length", suffix.alias("suffix"), (suffix.isin(*suffixes) & (F.col("length") <= most_bytes)).alias("accepted"))


def verify_artifacts(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """Index rows (name, sha256) whose file is missing or has another digest."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("found"))
    return index.join(files, "name", "left").where(F.col("found").isNull() | (F.col("found") != F.col("sha256"))).select("name", F.col("found").isNull().alias("missing"))


def _flag(c: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(low.isin(*YES), True).when(low.isin(*NO), False)


def read_glossary_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entries, problems) of a glossary CSV with aliased headers; a bad row is a problem, not an error.

    Problems: a missing or doubled header (for all), no source term, no target term, a flag that is neither yes nor no, a source term that an earlier row has (by case-folded, trimmed form).
    """
    raw = spark.read.option("header", "true").option("multiLine", "true").csv(path)
    names = {k: [c for c in raw.columns if c.strip().lower().lstrip("﻿") in v] for k, v in GLOSSARY_HEADERS.items()}
    bad = [("header", f"{'missing' if not names[k] else 'doubled'}: {k}") for k in names if len(names[k]) > 1 or (k == "source_term" and not names[k])]
    none = "term string, problem string"
    if bad:
        return spark.createDataFrame([], "source_term string, target_term string, note string, case_sensitive boolean, do_not_translate boolean"), spark.createDataFrame(bad, none)
    col = lambda k: F.trim(F.col(f"`{names[k][0]}`")) if names[k] else F.lit(None).cast("string")
    rows = raw.select(col("source_term").alias("source_term"), col("target_term").alias("target_term"), col("note").alias("note"), _flag(col("case_sensitive")).alias("case_sensitive"), _flag(col("do_not_translate")).alias("do_not_translate"), F.monotonically_increasing_id().alias("_row"))
    rows = rows.withColumn("target_term", F.when(F.col("do_not_translate") & (F.coalesce("target_term", F.lit("")) == ""), F.col("source_term")).otherwise(F.col("target_term")))
    rows = rows.withColumn("_n", F.row_number().over(W.partitionBy(F.lower("source_term")).orderBy("_row")))
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    problem = F.when(empty("source_term"), "no source term").when(empty("target_term"), "no target term").when(F.col("case_sensitive").isNull() | F.col("do_not_translate").isNull(), "unclear flag").when(F.col("_n") > 1, "repeated term")
    rows = rows.withColumn("problem", problem)
    return rows.where("problem is null").drop("_row", "_n", "problem"), rows.where("problem is not null").select(F.col("source_term").alias("term"), "problem")


def write_glossary_csv(entries: DataFrame, path: str) -> None:
    yes = lambda c: F.when(F.col(c), "yes").otherwise("no").alias(c)
    entries.select("source_term", "target_term", "note", yes("case_sensitive"), yes("do_not_translate")).write.option("header", "true").csv(path)


def nest(rows: DataFrame, by: Sequence[str], order: str, name: str) -> DataFrame:
    """Child rows as an ordered array of structs per parent; nulls are left out by the JSON writer."""
    fields = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in fields if c != order]))).alias(name))


def read_json_strict(texts: DataFrame, column: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(parsed, rejected): rows whose JSON fits the closed schema, and the text of those that don't."""
    field = F.from_json(column, f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = texts.withColumn("_p", field)
    good = F.col("_p").isNotNull() & F.col("_p._corrupt").isNull()
    return rows.where(good).select("_p.*").drop("_corrupt"), rows.where(~good | good.isNull()).select(F.col(column).alias("rejected"))


def write_artifact(rows: DataFrame, root: str, kind: str, scope: str, version: int) -> DataFrame:
    """Append rows as one version of an artifact, partitioned by kind and scope; returns (kind, scope, version, n, sha256) with an order-independent digest."""
    body = F.to_json(F.struct(*rows.columns))
    out = rows.select(F.lit(version).alias("version"), body.alias("json"), F.sha2(body, 256).alias("sha256"), F.lit(kind).alias("kind"), F.lit(scope).alias("scope"))
    out.write.mode("append").partitionBy("kind", "scope").parquet(root)
    digest = F.sha2(F.array_join(F.array_sort(F.collect_list(F.substring("sha256", 1, 16))), ","), 256)
    per_bucket = out.groupBy(F.substring("sha256", 1, 2).alias("b")).agg(F.count("*").alias("n"), digest.alias("d"))
    return per_bucket.agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda s: s["d"]), ","), 256).alias("sha256")).select(F.lit(kind).alias("kind"), F.lit(scope).alias("scope"), F.lit(version).alias("version"), "n", "sha256")
