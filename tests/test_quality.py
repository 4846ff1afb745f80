"""Every check passes on the built tables and fails on a seeded fault."""

import pytest
from pyspark.sql import functions as F

from postlens.operators import tables as TB
from postlens.plans.quality import CHECKS, quality_checks
from tests.helpers import entities, tweets

N_DATE, N_ENTITY = 2, 3


@pytest.fixture(scope="module")
def built(spark):
    t = tweets(spark, [("2013-01", str(i), i, i % 4, (i % 5) / 4, (i % 3) / 4) for i in range(40)]
               + [("2013-02", str(i), 1, 1, 0, 0) for i in range(6)])
    e = entities(spark, [("2013-01", str(i), n) for i in range(30) for n in "abcdef"[i % 6:i % 6 + 2]] + [("2013-02", "1", "z")])
    from postlens.session import cut_lineage
    return (t, e, *[cut_lineage(x, "test") for x in (TB.month_table(t), TB.date_table(t, e, N_DATE), TB.entity_table(t, e, N_ENTITY))])


def failing(t, e, m, d, n, red=None):
    return {r.check_name for r in quality_checks(t, e, m, d, n, N_DATE, N_ENTITY, red).filter("NOT ok").collect()}


def test_all_pass(built):
    assert failing(*built) == set()


def test_ranks_are_limited_before_the_shuffle(built, monkeypatch):
    """Each task hands on as many names of a month as are asked for, not all of them."""
    from postlens.plans import quality
    plans, cut = {}, quality.cut_lineage

    def watched(df, tag):
        plans[tag] = df._jdf.queryExecution().optimizedPlan().toString()
        return cut(df, tag)

    monkeypatch.setattr(quality, "cut_lineage", watched)
    quality_checks(*built, N_DATE, N_ENTITY)
    assert "WindowGroupLimit" in plans["quality-ranks"]


def _set(col, value, where):
    return lambda df: df.withColumn(col, F.when(F.expr(where), F.expr(value)).otherwise(F.col(col)))


FAULTS = {
    "month_post_count": (2, _set("post_count", "post_count + 1", "true")),
    "month_likes": (2, _set("total_likes", "total_likes + 1", "true")),
    "month_shares": (2, _set("total_shares", "total_shares - 1", "true")),
    "date_unique_keys": (3, lambda d: d.unionByName(d.limit(1))),
    "date_names_at_most_n_plus_2": (3, lambda d: d.unionByName(d.filter("entity = 'None'").limit(1).withColumn("entity", F.lit("q")))),
    "date_sentiment_domain": (3, _set("positive_sentiment", "0.3D", "entity = 'None'")),
    "date_flags": (3, _set("classified", "true", "entity = 'Other'")),
    "date_names_of_the_month": (3, _set("entity", "'z'", "entity NOT IN ('Other', 'None') AND year_month = '2013-01'")),
    "date_total_pairs": (3, lambda d: d.filter("entity IN ('Other', 'None')")),
    "date_pairs_at_least_posts": (3, lambda d: d.filter("entity = 'None'")),
    **{f"date_{b.lower()}_{x}": (3, _set(c, f"{c} + 1", f"entity = '{b}'")) for b in ("None", "Other")
       for c, x in (("post_count", "posts"), ("total_likes", "likes"), ("total_shares", "shares"))},
    "entity_unique_keys": (4, lambda d: d.unionByName(d.limit(1))),
    "entity_names_at_most_n": (4, lambda d: d.unionByName(d.filter("year_month = '2013-01'").limit(1).withColumn("entity", F.lit("q")))),
    "entity_means_in_unit_range": (4, _set("negative_sentiment", "1.5D", "true")),
    "entity_flags": (4, _set("redacted", "true", "true")),
    **{f"entity_total_{x}": (4, _set(c, f"{c} + 1", "true")) for c, x in (("post_count", "posts"), ("total_likes", "likes"), ("total_shares", "shares"))},
    **{f"date_vs_entity_{x}": (4, _set(c, f"{c} + 1", "true")) for c, x in (("post_count", "posts"), ("total_likes", "likes"), ("total_shares", "shares"))},
}


def test_every_check_has_a_fault():
    assert set(FAULTS) == {c[0] for c in CHECKS}


@pytest.mark.parametrize("group", [[n for n in FAULTS if FAULTS[n][0] == i] for i in (2, 3, 4)], ids=["month", "date", "entity"])
def test_seeded_faults_are_found(built, group):
    for name in group:
        at, spoil = FAULTS[name]
        tables = list(built)
        tables[at] = spoil(tables[at])
        assert name in failing(*tables), name


def test_shared_tokens_are_found(spark, built):
    red = spark.createDataFrame([("x", "t"), ("y", "t")], "original string, token string")
    assert failing(*built, red) == {"redaction_token_collisions"}


def test_a_swap_between_months_is_found(spark):
    from postlens.plans.quality import compare_by_id
    rows = lambda *r: spark.createDataFrame(r, "year_month string, tweet_id string")
    source = rows(("m1", "a"), ("m1", "b"), ("m1", "b"), ("m2", "c"), ("m2", None), ("m3", "e"))
    built = rows(("m1", "a"), ("m1", "b"), ("m1", "c"), ("m2", "b"), ("m2", None), ("m4", "x"))
    got = {r.year_month: tuple(r)[1:] for r in compare_by_id(source, built).collect()}
    assert got == {"m1": (3, 3, 1, 1, "b", "c"), "m2": (2, 2, 1, 1, "c", "b"), "m3": (1, 0, 1, 0, "e", None), "m4": (0, 1, 0, 1, None, "x")}
    same = compare_by_id(source, source).collect()
    assert all(r.missing == r.extra == 0 and r.missing_ids is None for r in same)
