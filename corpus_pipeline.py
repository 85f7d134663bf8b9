"""The corpus pipeline: language ID, near-dedup, substring dedup, decontamination, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
returns the next stage's documents, the last one the packed pieces. run()
applies them to a folder's documents, each stage's result written as Parquet in
the folder that spark.checkpoint.dir names and read again. Every stage reads
all rows its predecessor kept, and keeps whatever it does not itself decide
against.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skald.llm import decontaminate, language_id, neardup, packing, substring
from skald.llm.common import drop, scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go; the others keep their own columns."""
    return language_id.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one of least id. Rows without an id stay."""
    return neardup.deduplicate(docs, percent=80, bands=14, slack=24, nameless=True)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out of later ones."""
    return substring.remove(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with passages of the benchmark go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("decontamination", benchmark_free),
    ("packing", packed),
]

#: Language models, fuzzy chains and byte-pair ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the folder's documents."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        kept, written = scratch(stage(spark, docs, sf_dir), name)
        if path:
            drop(spark, path)
        docs, path = kept, written
    out = STAGES[-1][1](spark, docs, sf_dir)
    if path:
        drop(spark, path)  # packing has settled what it read
    return out
