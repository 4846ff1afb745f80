"""Property test: table builders vs a brute-force pandas restatement.

Random small months of posts and mentions (duplicate post rows, repeated
and null names, ties at the cut, orphan mentions, a real "Other" name,
null emotions) — the Spark result must equal the straightforward pandas
computation of the same rules.
"""

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from postlens.operators import tables as TB

NAMES = ["a", "b", "c", "Other", None]
MONTHS = ["2013-01", "2013-02"]


def q(x):
    x = 0.0 if x is None or (isinstance(x, float) and np.isnan(x)) else x
    return float(np.round(np.float64(np.float32(x)) * 4) / 4)   # half-even, like rint


def brute_date(tw, en, n):
    rows = []
    for ym in MONTHS:
        t = tw[tw.ym == ym]
        e = en[en.ym == ym]
        cnt = e.dropna(subset=["name"]).drop_duplicates(["tid", "name"]).groupby("name").size()
        top = set(sorted(cnt.index, key=lambda k: (-cnt[k], k))[:n])
        lab = e.assign(entity=[nm if nm in top else "Other" for nm in e.name])[["tid", "entity"]]
        lab = lab.drop_duplicates()
        named = set(lab.loc[lab.entity != "Other", "tid"])
        lab = lab[~((lab.entity == "Other") & lab.tid.isin(named))]
        m = t.merge(lab, on="tid", how="left")
        m["entity"] = m.entity.fillna("None")
        m["p"] = [q(x) for x in m.pos]
        m["n"] = [q(x) for x in m.neg]
        for (p, ng, ent), g in m.groupby(["p", "n", "entity"]):
            rows.append((ym, p, ng, ent, int(g.likes.astype(float).fillna(0).sum()), len(g)))
    return sorted(rows)


def brute_entity(tw, en, n):
    rows = []
    for ym in MONTHS:
        t = tw[tw.ym == ym]
        e = en[en.ym == ym].dropna(subset=["name"]).drop_duplicates(["tid", "name"])
        cnt = e.groupby("name").size()
        top = set(sorted(cnt.index, key=lambda k: (-cnt[k], k))[:n])
        m = t.merge(e[e.name.isin(top)], on="tid", how="inner")
        m["p"] = [q(x) for x in m.pos]
        for ent, g in m.groupby("name"):
            nz = (g.p > 0).sum()
            rows.append((ent, ym, round(g.p.sum() / nz, 9) if nz else 0.0, int(g.likes.astype(float).fillna(0).sum()), len(g)))
    return sorted(rows)


post = st.tuples(st.sampled_from(MONTHS), st.integers(0, 5), st.one_of(st.none(), st.integers(0, 9)),
                 st.one_of(st.none(), st.sampled_from([0.0, 0.125, 0.3, 0.375, 0.6, 0.625, 1.0])),
                 st.one_of(st.none(), st.sampled_from([0.0, 0.5, 0.75])))
mention = st.tuples(st.sampled_from(MONTHS), st.integers(0, 7), st.sampled_from(NAMES))


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(post, min_size=1, max_size=14), st.lists(mention, max_size=16), st.integers(1, 3))
def test_builders_match_brute_force(spark, posts, mentions, n):
    tw = pd.DataFrame(posts, columns=["ym", "tid", "likes", "pos", "neg"]).astype({"tid": str})
    en = pd.DataFrame(mentions, columns=["ym", "tid", "name"]).astype({"tid": str})
    t = spark.createDataFrame(
        [(r.tid, None, "u", None if pd.isna(r.likes) else int(r.likes), 0,
          None if pd.isna(r.pos) else float(r.pos), None if pd.isna(r.neg) else float(r.neg), r.ym)
         for r in tw.itertuples()],
        "tweet_id string, created_at timestamp_ntz, user_id string, likes int, shares int, "
        "positive_emotion float, negative_emotion float, year_month string")
    e = spark.createDataFrame([(r.tid, r.name, "u", 0.0, r.ym) for r in en.itertuples()],
                              "tweet_id string, detected_as string, matched_uri string, "
                              "confidence float, year_month string")
    d = TB.date_rows(t, e, n).select("year_month", "positive_sentiment", "negative_sentiment", "entity",
                                     "total_likes", "post_count").collect()
    assert sorted(tuple(r) for r in d) == brute_date(tw, en, n)
    ent = TB.entity_rows(t, e, n).select("entity", "year_month", "positive_sentiment", "total_likes",
                                         "post_count").collect()
    got = sorted((r[0], r[1], round(r[2], 9), r[3], r[4]) for r in ent)
    assert got == brute_entity(tw, en, n)
