"""Every registered query vs its DuckDB oracle on the smallest driver tables."""

import duckdb
import pytest

import __spark_entry__ as E
from postlens.plans.catalog import QUERIES
from tools.compare import TABLES, digest

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con(sf_small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(NAMES) <= set(E.oracle_sql()) and set(NAMES) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, sf_small, con, name):
    sdf = E.queries()[name](spark, sf_small).toPandas()
    ddf = con.execute(E.oracle_sql()[name]).df()
    assert sorted(sdf.columns) == sorted(ddf.columns)
    assert digest(sdf)[:2] == digest(ddf)[:2]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns[:4] == ["year_month", "positive_sentiment", "negative_sentiment", "entity"]
    assert df.count() > 0


def test_quality_checks_all_pass(spark, sf_small):
    bad = E.queries()["quality_checks"](spark, sf_small).filter("NOT ok").collect()
    assert bad == []
