def _f(x):
    return None if x is None else float(x)


def tweets(spark, rows):
    """rows: (ym, tweet_id, likes, shares, pos, neg)."""
    return spark.createDataFrame(
        [(tid, None, "u", lk, sh, _f(p), _f(n), ym) for ym, tid, lk, sh, p, n in rows],
        "tweet_id string, created_at timestamp_ntz, user_id string, likes int, shares int, "
        "positive_emotion float, negative_emotion float, year_month string")


def entities(spark, rows):
    """rows: (ym, tweet_id, name)."""
    return spark.createDataFrame([(tid, name, "urn:x", 0.0, ym) for ym, tid, name in rows],
                                 "tweet_id string, detected_as string, matched_uri string, "
                                 "confidence float, year_month string")


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())

