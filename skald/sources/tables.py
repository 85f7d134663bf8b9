"""Parquet tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables whose rows are texts: work on a row costs far more than moving it.
TEXTS = {"documents", "pages"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder. Texts are dealt over all cores if their files make fewer partitions than there are cores.

    That happens only to small tables in a file or two; larger ones are read as they lie.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in TEXTS and df.rdd.getNumPartitions() < cores else df
