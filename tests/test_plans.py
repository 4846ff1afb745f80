"""Plan-shape checks: no cartesian products, pruned scans, bounded top-N."""

import pytest

import __spark_entry__ as E
from postlens.operators import tables as TB
from postlens.plans.catalog import QUERIES
from postlens.sources.fixtures import load_corpus

# Queries that write helper tables when planned (incremental/stream/dump
# rendering) are planned too; the check is on the final plan.
NAMES = sorted(QUERIES)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_no_cartesian_or_nested_loop(spark, sf_small, name):
    plan = _plan(E.queries()[name](spark, sf_small))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_month_table_reads_only_needed_columns(spark, sf_small):
    plan = _plan(E.queries()["month_table"](spark, sf_small))
    assert "o_orderpriority" not in plan and "o_orderstatus" not in plan


def test_date_rows_shuffles_each_input_once(spark, sf_small):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        c = load_corpus(spark, sf_small)
        plan = _plan(TB.date_rows(c.tweets, c.entities, 20))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    key_exchanges = [ln for ln in plan.split("\n")
                     if "Exchange hashpartitioning(year_month" in ln and "tweet_id" in ln
                     and "ReusedExchange" not in ln]
    # posts once + mentions once (the second use of the mention shuffle is reused)
    assert len(key_exchanges) == 2
    assert "ReusedExchange" in plan
    assert "WindowGroupLimit" in plan


def test_long_top_lists_need_no_shuffle_by_name(spark, sf_small):
    """N = 5,000 under AQE: two exchanges on the post key, one by (month, name) for the counts."""
    import re

    c = load_corpus(spark, sf_small)
    df = TB.date_rows(c.tweets, c.entities, 5000)
    df.collect()
    final = _plan(df).split("+- == Initial Plan ==")[0]
    made = [x for x in final.splitlines() if re.search(r"\bExchange hashpartitioning\(", x) and "Reused" not in x]
    assert len([x for x in made if "tweet_id" in x]) == 2
    assert len([x for x in made if re.search(r"hashpartitioning\(year_month#\d+, name#", x)]) == 1
