"""The raw store's figures: averages that lie on the edge between two ninth decimals, and texts that are empty."""

import duckdb

from skald.operators import stats
from skald.plans import oracles, registry


def test_averages_on_an_edge_equal_sql(spark, tmp_path):
    """5,120 stored documents of 10,241 bytes in all: 2.0001953125 each, a tie in the tenth decimal."""
    texts = spark.range(6400).selectExpr("id AS doc_id", "repeat('a', CASE WHEN id = 1 THEN 2194 ELSE 1 END) AS text", "'en' AS lang", "'web' AS source")
    texts.write.parquet(f"{tmp_path}/documents.parquet")
    ours = registry.raw_store_stats(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    theirs = con.execute(oracles.ORACLES["raw_store_stats"]).df()
    assert [tuple(r) for r in ours.select(*theirs.columns).collect()] == list(theirs.itertuples(index=False, name=None))


def test_rounding_equals_sql(spark):
    pairs = [(944993135, 450849), (731015080, 340556), (116974491, 56108), (1600129050, 500319), (123105454, 47061), (-1403795830, 451986), (5123, 5120), (1, 3), (0, 7)]
    ours = registry.round9(spark.createDataFrame([(a / b,) for a, b in pairs] + [(None,), (float("inf"),)], "x double")).collect()
    theirs = [duckdb.execute("SELECT round(CAST(? AS DOUBLE) / ?, 9)", p).fetchone()[0] for p in pairs]
    assert [r["x"] for r in ours] == [*theirs, None, float("inf")]


def test_empty_texts_are_not_there(spark):
    """As the statistics of the plain program: only texts with something in them count."""
    rows = spark.createDataFrame([("ab", "é"), ("", ""), (None, "abc"), ("abcd", None)], "raw_html string, clean_text string")
    assert tuple(stats.raw_store_stats(rows).first()) == (4, 2, 2, 6, 3.0, 5, 2.5)
