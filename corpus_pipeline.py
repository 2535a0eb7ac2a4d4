"""Training-corpus pipeline: classify, clean, drop near copies, cut repeats, pack.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its
predecessor kept. The stages before the last return the columns of
``documents`` (and any others ``docs`` has). An empty table passes through; null
ids and texts are treated as the operators' docstrings say: a null or empty
text fails the quality rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm import packing, quality_knn, quality_rules, simhash, suffix_dedup
from tallyline.llm.shared import remove_folder, ship, table
from tallyline.session import scratch_path


def with_sizes(docs: DataFrame) -> DataFrame:
    """``n_chars``, where the table has it, says how long the texts are now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier accepts."""
    ship(spark)
    model = quality_knn.fit(docs, table(spark, sf_dir, "labels"))
    made, names = quality_knn.classify(docs, model)
    return made.filter(F.col(names["predicted"]) == 1).select(*docs.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the line-first rules keep, without the lines that failed."""
    ship(spark)
    return with_sizes(quality_rules.clean(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    ship(spark)
    return simhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings that stand in earlier ones."""
    ship(spark)
    return with_sizes(suffix_dedup.remove_repeats(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    ship(spark)
    return packing.pack(docs, added_tokens=True)


STAGES = [
    ("quality_classifier", classify), ("quality_rules", clean), ("simhash_near_dedup", drop_near_copies), ("suffix_array_dedup", cut_repeats),
    ("best_fit_packing", pack),
]

# trained models, hashes and token ids are beyond SQL: the stages are tested against brute force instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove_folder(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
