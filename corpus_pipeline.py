"""Corpus pipeline: quality, line dedup, near duplicates, benchmark leaks and packing, each stage on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.llm import decontaminate, jaccard_join, line_dedup, packing, quality
from ledgerloom.llm.common import join_key, stage

#: No SQL: the first stage learns a model (see tests/llm for the brute-force comparison of the others).
ORACLE_SQL = None


def _with_text(found: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of the nested row, with the text replaced by ``kept`` and n_chars counted anew if it changed."""
    changed = ~F.col("kept").eqNullSafe(F.col("row.text"))
    new = {"text": F.col("kept"), "n_chars": F.when(changed, F.length("kept").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in columns else None}
    return found.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in columns])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    scored = quality.quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where("predicted = 1").select("row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs; those that lose all their lines are copies as a whole and go."""
    found = line_dedup.drop_repeated_lines(docs).where("n_removed = 0 or n_removed < n_lines")
    return _with_text(found, docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: the one with the smallest doc_id; of repeated rows one."""
    classes = jaccard_join.near_duplicates(docs)
    keep = classes.where(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("h") == F.col("class_h"))).select(F.col("doc_id").alias("_d"), F.col("h").alias("_h")).distinct()
    found = docs.withColumn("_d", F.col("doc_id").cast("long")).withColumn("_h", F.xxhash64("text"))
    return join_key(found, keep, "inner", ("_d", "_h")).dropDuplicates(["_d", "_h"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without windows of benchmark items."""
    return decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("not contaminated").select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences."""
    return packing.pack(docs)


STAGES = [("quality", keep_good), ("lines", drop_lines), ("near_duplicates", drop_near_duplicates), ("leaks", drop_leaks), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
    return docs
