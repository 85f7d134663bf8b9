"""Ranks and running sums over ranges: exact whatever the sampler saw and however many ranges there are."""

import pytest
from pyspark.sql import functions as F

from skald.operators import tokens as K

N = 1_000_000


@pytest.fixture(params=["8", "200"])
def partitions(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)


def shuffled(spark):
    """N rows with distinct terms in no order, most of them of one frequency."""
    key = F.xxhash64("id")
    return spark.range(N, numPartitions=16).select(F.concat(F.lit("t"), F.hex(key)).alias("term"), F.when(F.pmod(key, F.lit(5)) == 0, F.pmod(key, F.lit(997))).otherwise(1).cast("long").alias("freq"))


def test_ranks_are_every_number_once_in_order(spark, partitions):
    ranked = K.ranked(shuffled(spark))
    wrong = ranked.toPandas().sort_values("rank")
    assert wrong["rank"].tolist() == list(range(1, N + 1))
    expected = wrong.sort_values(["freq", "term"], ascending=[False, True])
    assert expected["rank"].is_monotonic_increasing


def test_running_sums_are_those_of_one_pass(spark, partitions):
    rows = spark.range(N, numPartitions=16).select(F.xxhash64("id").alias("key"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)).alias("v"))
    got = K.running_sum(rows, "key", "v", "before").toPandas().sort_values("key")
    assert (got["before"] == got["v"].cumsum() - got["v"]).all()


def test_empty_tables_have_no_ranks(spark):
    assert K.ranked(spark.createDataFrame([], "term string, freq long")).collect() == []
    assert K.running_sum(spark.createDataFrame([], "key long, v long"), "key", "v", "before").collect() == []
