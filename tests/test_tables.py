"""Hand-written trap cases for the table builders (FIXTURES.md §2.3)."""

import pytest

from postlens.operators import tables as TB
from tests.helpers import entities, rows, tweets

M = "2013-01"


def test_half_even_quantize(spark):
    t = tweets(spark, [(M, "1", 1, 1, 0.125, 0.375), (M, "2", 1, 1, 0.625, None)])
    got = rows(TB.quantized_posts(t), "tweet_id", "positive_sentiment", "negative_sentiment")
    assert got == [("1", 0.0, 0.5), ("2", 0.5, 0.0)]


def test_nulls_count_as_zero(spark):
    t = tweets(spark, [(M, "1", None, None, None, None)])
    d = TB.date_rows(t, entities(spark, []), 10)
    assert rows(d, "entity", "total_likes", "total_shares", "post_count",
                "positive_sentiment") == [("None", 0, 0, 1, 0.0)]


def test_tie_at_cut_keeps_smaller_name(spark):
    t = tweets(spark, [(M, "1", 1, 0, 0, 0), (M, "2", 1, 0, 0, 0)])
    e = entities(spark, [(M, "1", "beta"), (M, "2", "alpha")])
    got = rows(TB.date_rows(t, e, 1), "entity", "post_count")
    assert got == [("Other", 1), ("alpha", 1)]


def test_mixed_post_no_other_row_and_dedup(spark):
    # post 1: top name twice + non-top name -> one named row only
    # post 2: two non-top names -> one Other row
    t = tweets(spark, [(M, "1", 5, 0, 0, 0), (M, "2", 7, 0, 0, 0), (M, "3", 1, 0, 0, 0)])
    e = entities(spark, [(M, "1", "a"), (M, "1", "a"), (M, "1", "x"), (M, "2", "y"),
                         (M, "2", "z"), (M, "3", "a")])
    got = rows(TB.date_rows(t, e, 1), "entity", "total_likes", "post_count")
    assert got == [("Other", 7, 1), ("a", 6, 2)]


def test_orphan_entity_ranks_but_adds_no_row(spark):
    t = tweets(spark, [(M, "1", 1, 0, 0, 0)])
    e = entities(spark, [(M, "9", "ghost"), (M, "8", "ghost"), (M, "1", "real")])
    assert rows(TB.date_rows(t, e, 1), "entity") == [("Other",)]
    assert rows(TB.entity_rows(t, e, 1), "entity") == []
    assert rows(TB.entity_rows(t, e, 2), "entity") == [("real",)]


def test_duplicate_post_rows_both_counted(spark):
    t = tweets(spark, [(M, "1", 2, 0, 1.0, 0), (M, "1", 3, 0, 0.0, 0)])
    e = entities(spark, [(M, "1", "a")])
    assert rows(TB.entity_rows(t, e, 5), "entity", "post_count", "total_likes",
                "positive_sentiment") == [("a", 2, 5, 1.0)]
    assert sum(r[0] for r in rows(TB.date_rows(t, e, 5), "post_count")) == 2


def test_signal_only_mean_and_all_zero_axis(spark):
    t = tweets(spark, [(M, "1", 0, 0, 0.5, 0), (M, "2", 0, 0, 0.0, 0), (M, "3", 0, 0, 1.0, 0)])
    e = entities(spark, [(M, "1", "a"), (M, "2", "a"), (M, "3", "a")])
    got = rows(TB.entity_rows(t, e, 5), "positive_sentiment", "negative_sentiment")
    assert got == [(0.75, 0.0)]


def test_sentinel_name_other_merges_and_is_unclassified(spark):
    t = tweets(spark, [(M, "1", 1, 0, 0, 0), (M, "2", 1, 0, 0, 0)])
    e = entities(spark, [(M, "1", "Other"), (M, "2", "zzz")])
    d = TB.date_table(t, e, top_n=1)
    assert rows(d, "entity", "post_count", "classified") == [("Other", 2, False)]


def test_same_id_in_two_months_stays_in_month(spark):
    t = tweets(spark, [("2013-01", "1", 1, 0, 0, 0), ("2013-02", "1", 1, 0, 0, 0)])
    e = entities(spark, [("2013-01", "1", "a")])
    got = rows(TB.date_rows(t, e, 5), "year_month", "entity")
    assert got == [("2013-01", "a"), ("2013-02", "None")]


def test_empty_month_file_gives_zero_row(spark):
    t = tweets(spark, [("2013-01", "1", 4, 2, 0, 0)])
    months = spark.createDataFrame([("2013-01",), ("2013-02",)], "year_month string")
    assert rows(TB.month_table(t, months), "year_month", "total_likes", "total_shares",
                "post_count") == [("2013-01", 4, 2, 1), ("2013-02", 0, 0, 0)]


def test_null_name_goes_to_other_in_date_dropped_in_entity(spark):
    t = tweets(spark, [(M, "1", 1, 0, 0, 0)])
    e = entities(spark, [(M, "1", None)])
    assert rows(TB.date_rows(t, e, 5), "entity") == [("Other",)]
    assert rows(TB.entity_rows(t, e, 5), "entity") == []


def test_redaction_token_and_flags(spark):
    t = tweets(spark, [(M, "1", 1, 0, 0, 0), (M, "2", 1, 0, 0, 0)])
    e = entities(spark, [(M, "1", "Sh1t show"), (M, "2", "fine name")])
    words = spark.createDataFrame([("shit",)], "word string")
    d, red = TB.date_table(t, e, 5, words, with_redactions=True)
    import hashlib
    tok = "[REDACTED_" + hashlib.md5(b"Sh1t show").hexdigest()[:6] + "]"
    assert rows(d, "entity", "redacted", "classified") == [(tok, True, True), ("fine name", False, True)]
    assert rows(red, "token", "original") == [(tok, "Sh1t show")]


def test_redaction_side_table_rerun_keeps_one_row(spark):
    from postlens.operators.redaction import redaction_table
    a = spark.createDataFrame([("[REDACTED_aaaaaa]", "x")], "token string, original string")
    got = redaction_table(a, existing=redaction_table(a))
    assert got.count() == 1


def test_top_n_plan_uses_window_group_limit(spark):
    e = entities(spark, [(M, "1", "a")])
    plan = TB.top_names(TB.post_names(e), 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan or "AdaptiveSparkPlan" in plan


def test_listed_phrases_of_any_length_and_alphabet(spark):
    from postlens.operators.redaction import apply_redaction, redaction_collisions, redaction_table
    words = spark.createDataFrame([(w,) for w in ("4chan", "foo-bar", "son of a", "coño", "b1tch", "***", None)], "word string")
    names = ["4chan", "on achan now", "foo bar baz", "foobar", "a son of a gun", "son of gun", "COÑO.", "cono", "bitch", "b!tch x", "clean"]
    t = spark.createDataFrame([(n,) for n in names], "entity string")
    out, red = apply_redaction(t, words)
    assert sorted(r.original for r in red.collect()) == sorted(
        ["4chan", "on achan now", "foo bar baz", "a son of a gun", "COÑO.", "bitch", "b!tch x"])
    assert out.filter("redacted").count() == 7
    # every original stays in the side table, also where two share a token
    both = spark.createDataFrame([("x", "t1"), ("y", "t1")], "original string, token string")
    assert sorted(r.original for r in redaction_table(both, redaction_table(both)).collect()) == ["x", "y"]
    assert [r.n_originals for r in redaction_collisions(both).collect()] == [2]


def test_long_entries_do_not_multiply_the_words_of_names(spark):
    """An entry is filed under its rarest word; names give a row a word, whatever the entries' lengths."""
    from postlens.operators.redaction import dirty_names
    long_entry = " ".join(f"w{i}" for i in range(30))
    names = [f"the of {i}" for i in range(50)] + [f"x {long_entry} y", long_entry.replace("w7 ", ""), "of the", "the the of",
                                                  "ab c", "a bc", "c ab", None, ""]
    t = spark.createDataFrame([(n,) for n in names * 2], "entity string")
    words = lambda *w: spark.createDataFrame([(x,) for x in w], "word string")
    found = lambda *w: sorted(r.original for r in dirty_names(t, words(*w)).collect())
    assert found(long_entry) == [f"x {long_entry} y"]
    assert found("the of 3", "OF the", "of missing", "the the") == ["of the", "the of 3", "the the of"]
    assert found("ab", "b c") == ["ab c", "c ab"]
    assert found() == found("", "--", None) == []
    plans = [dirty_names(t, words(e))._jdf.queryExecution().optimizedPlan().toString() for e in ("w1", long_entry)]
    assert plans[0].count("Generate") == plans[1].count("Generate")


def test_bad_index_ranges_mean_all_months(spark):
    from postlens.plans.explore import filter_entities_by_index
    t = spark.createDataFrame([("a", f"2013-0{m}", True, False) for m in (1, 2, 3)],
                              "entity string, year_month string, classified boolean, redacted boolean")
    assert filter_entities_by_index(t, ["a"], "x", None).count() == 3
    assert filter_entities_by_index(t, ["a"], 1, 99).count() == 2


def test_ordered_results(spark):
    from postlens.plans import explore as X
    from postlens.plans import reports as R
    t = spark.createDataFrame([("b x", "2013-02", 5, False, True), ("a x", "2013-01", 9, True, True), ("c x", "2013-01", 9, False, True)],
                              "entity string, year_month string, post_count long, redacted boolean, classified boolean")
    assert [r.year_month for r in R.monthly_volume(t).collect()] == ["2013-01", "2013-02"]
    assert [(r.year_month, r.redacted) for r in X.redacted_share(t).collect()] == [("2013-01", False), ("2013-01", True), ("2013-02", False)]
    assert [r.entity for r in X.keyword_group(t, {"g": "x"}).collect()] == ["a x", "c x", "b x"]


@pytest.mark.parametrize("listed", [TB.MOST_LISTED_NAMES, 0])
def test_tables_of_shared_facts_equal_those_of_the_rows(spark, monkeypatch, listed):
    monkeypatch.setattr(TB, "MOST_LISTED_NAMES", listed)
    t = tweets(spark, [(M, "1", 2, 1, 1.0, 0), (M, "1", 3, 1, 0.0, -0.1), (M, "1", 3, 1, 0.0, -0.1), (M, "2", None, 4, None, 0.3),
                       (M, "3", 7, 0, 0.6, 0), (M, "4", 1, 1, 0, 0), (M, "5", 9, 9, 0, 1.0), (M, None, 5, 5, 0, 0),
                       (None, "1", 6, 6, 0, 0), (None, None, 8, 8, 0, 0), ("2013-02", "1", 1, 0, 0.5, 0), ("2013-03", "1", 1, 0, 0, 0)])
    e = entities(spark, [(M, "1", "a"), (M, "1", "a"), (M, "1", "b"), (M, "2", "a"), (M, "2", "Other"), (M, "3", "Other"),
                         (M, "3", None), (M, "4", None), (M, "9", "ghost"), (M, "8", "ghost"), (M, "7", "ghost"), (M, "7", "None"),
                         (M, None, "a"), (None, "1", "a"), ("2013-02", "1", "None"), ("2013-02", "6", "z")])
    facts = TB.post_facts(t, e)
    for build in (TB.date_rows, TB.entity_rows):
        for n in (1, 2, 3, 10):
            want, got = build(t, e, n), build(t, e, n, facts)
            assert got.dtypes == want.dtypes
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), (build.__name__, n)


def test_published_tables_read_the_mentions_once(spark, monkeypatch):
    import uuid

    from postlens.plans import catalog as C
    from postlens.sources.fixtures import Corpus
    words = spark.createDataFrame([("bad",)], "word string")
    t = tweets(spark, [(M, "1", 1, 0, 0, 0), (M, "2", 2, 0, 0.5, 0), (M, "3", 4, 0, 0, 0)])
    e = entities(spark, [(M, "1", "bad name"), (M, "2", "good name"), (M, "2", "bad name")])
    seen, post_names = [], TB.post_names
    monkeypatch.setattr(C, "load_corpus", lambda *a: Corpus(t, e, words))
    monkeypatch.setattr(TB, "post_names", lambda *a: seen.append(a) or post_names(*a))
    place = f"/nowhere/{uuid.uuid4().hex}"
    got = rows(C.q_published_date_table(spark, place), "year_month", "positive_sentiment", "entity", "total_likes", "redacted")
    want = rows(TB.date_table(t, e, C.DATE_TOP_N, words), "year_month", "positive_sentiment", "entity", "total_likes", "redacted")
    assert got == want and len(got) == 4
    assert [r.original for r in C.q_published_redactions(spark, place).collect()] == ["bad name"]
    assert len(seen) == 2                     # once for both tables, once for what this test wants
