"""From raw documents to packed training sequences, in stages that each write a table the next one reads.

Each stage works on all that the one before kept and passes all columns on, under their names; the cases that its
operator defines (nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names) hold for it:
null and blank texts fail the quality rules, rows that repeat are one class of near duplicates, and the last stage gives
a row for each piece of what is left. An empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomery.llm import decontaminate, line_dedup, ngram_join, packing, quality_rules
from loomery.llm.workdir import fresh_path, remove, scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, boilerplate lines cut."""
    return quality_rules.apply_rules(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated three-line windows cut; documents of which nothing is left go."""
    return line_dedup.apply_dedup(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return ngram_join.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their bins."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]

#: SQL cannot express the similarity join, the alignment and the packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written as Parquet and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch(spark) as kept:  # what the stage makes on its way goes when its result is written
            path = fresh_path(spark, name.replace(" ", "-"))
            kept.append(path)
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
            docs = spark.read.schema(made.schema).parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
