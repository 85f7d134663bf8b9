"""Every registered query of the library against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest
from paths import LARGE, SF

from skald.plans import oracles, registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def rows(df: pd.DataFrame) -> list:
    columns = sorted(df.columns)
    return sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query_equals_sql(spark, duck, name):
    ours = registry.queries()[name](spark, SF).toPandas()
    if name not in oracles.ORACLES:
        assert len(ours)
        return
    theirs = duck.execute(oracles.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.skipif(not Path(LARGE).is_dir(), reason="needs the larger tables")
@pytest.mark.parametrize("name", ["zipf", "zipf_plot", "docs_idx", "visit_budget", "sizes"])
def test_order_over_many_ranges_equals_sql(spark, name):
    """What a range sampler cannot see whole: more rows in a range than it samples."""
    ours = registry.queries()[name](spark, LARGE).toPandas()
    theirs = connect(LARGE).execute(oracles.ORACLES[name]).df()
    assert rows(ours) == rows(theirs)
