"""DuckDB SQL for the driver's correctness check.

Each string is a self-contained query over the driver's pre-registered
views (orders, lineitem, part, ...).  They restate the reference semantics
directly (DISTINCT pairs, NOT EXISTS for the "Other" rule, ...) rather than
mirroring the Spark plan, so a match is an independent check.
"""

from __future__ import annotations

from postlens.sources.fixtures import DATE_TOP_N, ENTITY_TOP_N, FIXTURE_WORDS
from postlens.functions.redact import LEET_FROM, LEET_TO, SPLIT_PATTERN

WORDS_VALUES = ", ".join(f"('{w}')" for w in FIXTURE_WORDS)

FX = f"""
fx_tweets AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS tweet_id,
         strftime(o_orderdate, '%Y-%m') AS year_month,
         o_orderdate AS created_at,
         CAST(o_custkey AS VARCHAR) AS user_id,
         CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS INTEGER) AS likes,
         CAST(o_custkey % 50 AS INTEGER) AS shares,
         CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0.0 WHEN o_orderkey % 11 = 0 THEN NULL
                   ELSE (o_orderkey % 5) / 4.0 + 0.03 END AS FLOAT) AS positive_emotion,
         CAST(CASE WHEN o_custkey % 2 = 0 THEN 0.0 ELSE (o_custkey % 5) / 4.0 END AS FLOAT)
           AS negative_emotion
  FROM orders),
fx_entities AS (
  SELECT CAST(l.l_orderkey AS VARCHAR) AS tweet_id,
         strftime(o.o_orderdate, '%Y-%m') AS year_month,
         lower(p.p_brand || ' ' || p.p_type) AS detected_as,
         'urn:part:' || CAST(l.l_partkey AS VARCHAR) AS matched_uri,
         CAST(-30 * l.l_discount AS FLOAT) AS confidence
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
                  JOIN orders o ON l.l_orderkey = o.o_orderkey),
fx_words AS (SELECT * FROM (VALUES {WORDS_VALUES}) w(word)),
q_tweets AS (
  SELECT year_month, tweet_id,
         round_even(coalesce(CAST(positive_emotion AS DOUBLE), 0) * 4, 0) / 4 AS positive_sentiment,
         round_even(coalesce(CAST(negative_emotion AS DOUBLE), 0) * 4, 0) / 4 AS negative_sentiment,
         CAST(coalesce(likes, 0) AS BIGINT) AS likes,
         CAST(coalesce(shares, 0) AS BIGINT) AS shares
  FROM fx_tweets)"""


def _redact(src: str, out: str) -> str:
    """CTEs ``{out}_red(entity, token)`` for the distinct names of ``src``."""
    return f"""
{out}_names AS (SELECT DISTINCT entity FROM {src}),
{out}_toks AS (
  SELECT entity, list_filter(string_split_regex(
           translate(lower(entity), '{LEET_FROM}', '{LEET_TO}'), '{SPLIT_PATTERN}'),
           lambda x: x <> '') AS t
  FROM {out}_names),
{out}_grams AS (
  SELECT entity, unnest(t) AS g FROM {out}_toks
  UNION ALL
  SELECT entity, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))
  FROM {out}_toks),
{out}_red AS (
  SELECT DISTINCT entity, '[REDACTED_' || substr(md5(entity), 1, 6) || ']' AS token
  FROM {out}_grams WHERE g IN (SELECT lower(word) FROM fx_words))"""


DATE_CTE = f"""
d_pairs AS (SELECT DISTINCT year_month, tweet_id, detected_as AS name FROM fx_entities),
d_counts AS (SELECT year_month, name, count(*) AS n FROM d_pairs
             WHERE name IS NOT NULL GROUP BY year_month, name),
d_top AS (
  SELECT year_month, name FROM (
    SELECT year_month, name, row_number() OVER (
             PARTITION BY year_month ORDER BY n DESC, name ASC) AS rn
    FROM d_counts) WHERE rn <= {DATE_TOP_N}),
d_labelled AS (
  SELECT DISTINCT p.year_month, p.tweet_id,
         CASE WHEN t.name IS NOT NULL THEN p.name ELSE 'Other' END AS entity
  FROM d_pairs p LEFT JOIN d_top t ON p.year_month = t.year_month AND p.name = t.name),
d_post_ent AS (
  SELECT l.* FROM d_labelled l
  WHERE NOT (l.entity = 'Other' AND EXISTS (
    SELECT 1 FROM d_labelled n
    WHERE n.year_month = l.year_month AND n.tweet_id = l.tweet_id AND n.entity <> 'Other'))),
d_agg AS (
  SELECT q.year_month, q.positive_sentiment, q.negative_sentiment,
         coalesce(e.entity, 'None') AS entity,
         sum(q.likes) AS total_likes, sum(q.shares) AS total_shares, count(*) AS post_count
  FROM q_tweets q LEFT JOIN d_post_ent e ON q.year_month = e.year_month AND q.tweet_id = e.tweet_id
  GROUP BY ALL),{_redact('d_agg', 'd')},
date_t AS (
  SELECT a.year_month, a.positive_sentiment, a.negative_sentiment,
         coalesce(r.token, a.entity) AS entity,
         CAST(a.total_likes AS BIGINT) AS total_likes, CAST(a.total_shares AS BIGINT) AS total_shares,
         CAST(a.post_count AS BIGINT) AS post_count,
         r.token IS NOT NULL AS redacted,
         coalesce(r.token, a.entity) NOT IN ('Other', 'None') AS classified
  FROM d_agg a LEFT JOIN d_red r ON a.entity = r.entity)"""

ENTITY_CTE = f"""
e_pairs AS (SELECT DISTINCT year_month, tweet_id, detected_as AS entity FROM fx_entities
            WHERE detected_as IS NOT NULL),
e_counts AS (SELECT year_month, entity, count(*) AS n FROM e_pairs GROUP BY year_month, entity),
e_top AS (
  SELECT year_month, entity FROM (
    SELECT year_month, entity, row_number() OVER (
             PARTITION BY year_month ORDER BY n DESC, entity ASC) AS rn
    FROM e_counts) WHERE rn <= {ENTITY_TOP_N}),
e_agg AS (
  SELECT p.entity, p.year_month,
         coalesce(sum(q.positive_sentiment) / nullif(count(*) FILTER (WHERE q.positive_sentiment > 0), 0), 0.0)
           AS positive_sentiment,
         coalesce(sum(q.negative_sentiment) / nullif(count(*) FILTER (WHERE q.negative_sentiment > 0), 0), 0.0)
           AS negative_sentiment,
         sum(q.likes) AS total_likes, sum(q.shares) AS total_shares, count(*) AS post_count
  FROM e_pairs p
  JOIN e_top t ON p.year_month = t.year_month AND p.entity = t.entity
  JOIN q_tweets q ON q.year_month = p.year_month AND q.tweet_id = p.tweet_id
  GROUP BY p.entity, p.year_month),{_redact('e_agg', 'e')},
entity_t AS (
  SELECT coalesce(r.token, a.entity) AS entity, a.year_month,
         CAST(a.positive_sentiment AS DOUBLE) AS positive_sentiment,
         CAST(a.negative_sentiment AS DOUBLE) AS negative_sentiment,
         CAST(a.total_likes AS BIGINT) AS total_likes, CAST(a.total_shares AS BIGINT) AS total_shares,
         CAST(a.post_count AS BIGINT) AS post_count,
         r.token IS NOT NULL AS redacted,
         coalesce(r.token, a.entity) NOT IN ('Other', 'None') AS classified
  FROM e_agg a LEFT JOIN e_red r ON a.entity = r.entity)"""

MONTH_CTE = """
month_t AS (
  SELECT year_month, CAST(sum(coalesce(likes, 0)) AS BIGINT) AS total_likes,
         CAST(sum(coalesce(shares, 0)) AS BIGINT) AS total_shares,
         CAST(count(*) AS BIGINT) AS post_count
  FROM fx_tweets GROUP BY year_month)"""


def with_tables(body: str, ctes: str = "") -> str:
    """Wrap a final SELECT with every fixture/table CTE it may use."""
    extra = f",\n{ctes}" if ctes else ""
    return f"WITH {FX},{DATE_CTE},{ENTITY_CTE},{MONTH_CTE}{extra}\n{body}"


SQL: dict[str, str] = {
    "month_table": with_tables("SELECT * FROM month_t"),
    "date_table": with_tables("SELECT * FROM date_t"),
    "entity_table": with_tables("SELECT * FROM entity_t"),
    "redaction_table": with_tables("""
SELECT token, entity AS original FROM (SELECT * FROM d_red UNION SELECT * FROM e_red)"""),
}


# Reports / explore
from postlens.plans import catalog as C  # noqa: E402


def _in(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


CLEAN = "clean AS (SELECT * FROM entity_t WHERE classified AND NOT redacted)"


def _tops(k: int, name: str = "tops") -> str:
    return (f"{name} AS (SELECT entity, sum(post_count) AS total FROM clean GROUP BY entity "
            f"ORDER BY total DESC, entity ASC LIMIT {k})")


NZ = "coalesce(avg({c}) FILTER (WHERE {c} > 0), 0.0)"
RANGE = f"year_month BETWEEN '{C.FX_LO}' AND '{C.FX_HI}'"
SELECTED = f"entity IN ({_in(C.FX_SELECTED)})"
F20 = f"f20 AS (SELECT * FROM entity_t WHERE {SELECTED} AND {RANGE} AND classified AND NOT redacted)"
F21 = f"""f21_sub AS (SELECT * FROM entity_t WHERE {RANGE} AND classified AND NOT redacted),
f21_top AS (SELECT entity, sum(post_count) AS total FROM f21_sub GROUP BY entity
            ORDER BY total DESC, entity ASC LIMIT 200),
f21 AS (SELECT * FROM f21_sub WHERE entity IN (SELECT entity FROM f21_top))"""
GROUP_MATCH = " OR ".join(f"regexp_matches(lower(entity), '{kw}')" for kw in C.FX_GROUPS.values())
SPACE = f"""SELECT entity, year_month, CAST(sum(post_count) AS BIGINT) AS post_count,
       CAST(sum(total_likes) AS BIGINT) AS total_likes, CAST(sum(total_shares) AS BIGINT) AS total_shares,
       round_even({NZ.format(c='positive_sentiment')}, 6) AS positive_sentiment,
       round_even({NZ.format(c='negative_sentiment')}, 6) AS negative_sentiment
FROM {{src}} GROUP BY entity, year_month"""
GROUPS = (f"grp AS (SELECT * FROM entity_t WHERE ({GROUP_MATCH}) AND {RANGE} AND NOT redacted),\n"
          f"space AS ({SPACE.format(src='grp')})")
SUMMARY = f"""SELECT entity, CAST(count(DISTINCT year_month) AS BIGINT) AS months,
       CAST(sum(post_count) AS BIGINT) AS posts, CAST(sum(total_likes) AS BIGINT) AS likes,
       CAST(sum(total_shares) AS BIGINT) AS shares,
       round_even({NZ.format(c='positive_sentiment')}, 6) AS pos_sentiment,
       round_even({NZ.format(c='negative_sentiment')}, 6) AS neg_sentiment
FROM {{src}} GROUP BY entity"""


SQL.update({
    "monthly_volume": with_tables(f"""
SELECT year_month, CAST(sum(post_count) AS BIGINT) AS post_count,
       CASE WHEN year_month IN ({_in(C.FX_GAP_MONTHS)}) THEN '<-- KNOWN DATA GAP (near-zero)'
            WHEN year_month IN ({_in(C.FX_MISSING_MONTHS)}) THEN '<-- MISSING (corrupted gzip)'
            ELSE '' END AS note
FROM date_t GROUP BY year_month"""),
    "monthly_volume_summary": with_tables("""
SELECT CAST(count(*) AS BIGINT) AS n_months, CAST(sum(post_count) AS BIGINT) AS total_posts,
       CAST(quantile_cont(post_count, 0.5) AS DOUBLE) AS median_posts,
       first(year_month ORDER BY post_count DESC, year_month ASC) AS peak_month,
       CAST(max(post_count) AS BIGINT) AS peak_posts
FROM mv""", "mv AS (SELECT year_month, sum(post_count) AS post_count FROM date_t GROUP BY year_month)"),
    "calendar_gaps": with_tables(f"""
SELECT c.year_month, CAST(coalesce(m.post_count, 0) AS BIGINT) AS post_count,
       CASE WHEN m.post_count IS NULL THEN 'missing'
            WHEN m.post_count < (SELECT thr FROM gthr) THEN 'near_empty' ELSE 'ok' END AS status
FROM cal c LEFT JOIN month_t m ON c.year_month = m.year_month""", f"""
cal AS (SELECT strftime(d, '%Y-%m') AS year_month FROM generate_series(
          DATE '{C.FX_CAL_START}-01', DATE '{C.FX_CAL_END}-01', INTERVAL 1 MONTH) g(d)),
gthr AS (SELECT quantile_cont(post_count, 0.5) * 0.1 AS thr FROM month_t)"""),
    "sentiment_trend": with_tables("""
SELECT * FROM (SELECT 'positive' AS side, * FROM st ORDER BY avg_positive DESC, year_month LIMIT 10)
UNION ALL
SELECT * FROM (SELECT 'negative' AS side, * FROM st ORDER BY avg_negative DESC, year_month LIMIT 10)""", """
st0 AS (SELECT year_month, CAST(sum(post_count) AS BIGINT) AS total_posts,
               sum(positive_sentiment * post_count) / sum(post_count) AS avg_positive,
               sum(negative_sentiment * post_count) / sum(post_count) AS avg_negative
        FROM date_t WHERE classified AND NOT redacted GROUP BY year_month),
st AS (SELECT year_month, avg_positive, avg_negative, avg_positive - avg_negative AS sentiment_net,
              total_posts FROM st0)"""),
    "entity_spikiness": with_tables("""
SELECT *, peak_count / total_posts AS spikiness FROM sp ORDER BY spikiness DESC, entity LIMIT 20""",
        f"""{CLEAN},
{_tops(50)},
sp AS (SELECT c.entity, CAST(sum(c.post_count) AS BIGINT) AS total_posts,
              first(c.year_month ORDER BY c.post_count DESC, c.year_month ASC) AS peak_month,
              CAST(max(c.post_count) AS BIGINT) AS peak_count
       FROM clean c JOIN tops t ON c.entity = t.entity GROUP BY c.entity)"""),
    "entity_growth": with_tables("""
SELECT * FROM (SELECT 'growing' AS side, * FROM gr ORDER BY slope DESC, entity LIMIT 20)
UNION ALL
SELECT * FROM (SELECT 'declining' AS side, * FROM gr ORDER BY slope ASC, entity LIMIT 20)""",
        f"""{CLEAN},
{_tops(200)},
sub AS (SELECT c.*, t.total FROM clean c JOIN tops t ON c.entity = t.entity),
mi AS (SELECT year_month, dense_rank() OVER (ORDER BY year_month) - 1 AS idx
       FROM (SELECT DISTINCT year_month FROM sub)),
g AS (SELECT entity, CAST(max(total) AS BIGINT) AS total_posts, CAST(count(*) AS BIGINT) AS n_months,
             regr_slope(post_count, idx) AS s, regr_r2(post_count, idx) AS r,
             var_pop(post_count) AS vy, var_pop(idx) AS vx
      FROM sub JOIN mi ON sub.year_month = mi.year_month GROUP BY entity HAVING count(*) >= 6),
gr AS (SELECT entity, total_posts,
              round_even(CASE WHEN vx = 0 THEN 0.0 ELSE s END, 6) AS slope,
              round_even(CASE WHEN vx = 0 OR vy = 0 THEN 0.0 ELSE r END, 6) AS r_squared, n_months FROM g)"""),
    "entity_sentiment": with_tables("""
SELECT * FROM (SELECT 'positive' AS side, * FROM es ORDER BY avg_positive DESC, entity LIMIT 10)
UNION ALL
SELECT * FROM (SELECT 'negative' AS side, * FROM es ORDER BY avg_negative DESC, entity LIMIT 10)""",
        f"""{CLEAN},
{_tops(100)},
es0 AS (SELECT c.entity, CAST(sum(c.post_count) AS BIGINT) AS total_posts,
               sum(c.positive_sentiment * c.post_count) AS pw, sum(c.negative_sentiment * c.post_count) AS nw
        FROM clean c JOIN tops t ON c.entity = t.entity GROUP BY c.entity),
es AS (SELECT entity, total_posts, round_even(pw / total_posts, 6) AS avg_positive,
              round_even(nw / total_posts, 6) AS avg_negative,
              round_even((pw - nw) / total_posts, 6) AS sentiment_net FROM es0)"""),
    "top_entity_names": with_tables("""
SELECT entity, CAST(sum(post_count) AS BIGINT) AS post_count FROM entity_t
WHERE classified AND NOT redacted GROUP BY entity ORDER BY post_count DESC, entity LIMIT 200"""),
    "entity_names_by_filter": with_tables("\nUNION ALL\n".join(
        f"SELECT {c} AS classified_only, {r} AS exclude_redacted, entity, "
        f"CAST(sum(post_count) AS BIGINT) AS post_count FROM entity_t "
        f"WHERE {'classified' if c == 'true' else 'true'} AND {'NOT redacted' if r == 'true' else 'true'} "
        f"GROUP BY entity"
        for c in ("false", "true") for r in ("false", "true"))),
    "search_entities": with_tables(f"""
SELECT entity, CAST(sum(post_count) AS BIGINT) AS post_count FROM entity_t
WHERE classified AND NOT redacted GROUP BY entity
HAVING contains(lower(entity), '{C.FX_NEEDLE.lower()}')
ORDER BY post_count DESC, entity LIMIT 200"""),
    "keyword_group": with_tables("\nUNION ALL\n".join(
        f"SELECT '{label}' AS label, entity, CAST(sum(post_count) AS BIGINT) AS post_count "
        f"FROM entity_t GROUP BY entity HAVING regexp_matches(lower(entity), '{kw}')"
        for label, kw in C.FX_GROUPS.items())),
    "yearly_mentions": with_tables(f"""
SELECT entity, year,
       CASE {' '.join(f"WHEN year = {y} THEN '{y} (Annualized)'" for y in C.FX_PARTIAL)}
            ELSE CAST(year AS VARCHAR) END AS year_label,
       CAST(pc * CASE {' '.join(f'WHEN year = {y} THEN {f}' for y, f in C.FX_PARTIAL.items())}
                 ELSE 1 END AS BIGINT) AS post_count
FROM (SELECT entity, CAST(substr(year_month, 1, 4) AS INTEGER) AS year, sum(post_count) AS pc
      FROM entity_t WHERE classified AND NOT redacted AND entity IN ({_in(C.FX_YEARLY)})
      GROUP BY entity, year)"""),
    "entity_timeline": with_tables(f"""
SELECT year_month, post_count FROM entity_t
WHERE classified AND NOT redacted AND entity = '{C.FX_NAME}'"""),
    "volume_and_net_sentiment": with_tables(f"""
SELECT year_month, post_count, positive_sentiment - negative_sentiment AS net_sentiment FROM entity_t
WHERE classified AND NOT redacted AND entity = '{C.FX_NAME}'"""),
    "net_sentiment_ranking": with_tables("""
SELECT * FROM (SELECT 'negative' AS side, entity, net, total FROM ns ORDER BY net ASC, entity ASC LIMIT 10)
UNION ALL
SELECT * FROM (SELECT 'positive' AS side, entity, net, total FROM ns ORDER BY net DESC, entity DESC LIMIT 10)""",
        f"""{CLEAN},
{_tops(200)},
ns AS (SELECT c.entity,
              round_even(sum((c.positive_sentiment - c.negative_sentiment) * c.post_count)
                    / sum(c.post_count), 6) AS net,
              CAST(sum(c.post_count) AS BIGINT) AS total
       FROM clean c JOIN tops t ON c.entity = t.entity GROUP BY c.entity)"""),
    "normalized_growth": with_tables("""
SELECT * FROM (SELECT 'growing' AS side, entity, slope, n FROM ng ORDER BY slope DESC, entity LIMIT 15)
UNION ALL
SELECT * FROM (SELECT 'declining' AS side, entity, slope, n FROM ng ORDER BY slope ASC, entity LIMIT 15)""",
        f"""{CLEAN},
{_tops(500)},
sub AS (SELECT c.* FROM clean c JOIN tops t ON c.entity = t.entity),
x AS (SELECT entity, post_count,
             CAST(date_diff('day', (SELECT min(CAST(year_month || '-01' AS DATE)) FROM sub),
                            CAST(year_month || '-01' AS DATE)) AS DOUBLE) AS month_num,
             post_count / avg(post_count) OVER (PARTITION BY entity) AS y_norm
      FROM sub),
g AS (SELECT entity, regr_slope(y_norm, month_num) AS s, var_pop(month_num) AS vx,
             CAST(count(post_count) AS BIGINT) AS n FROM x GROUP BY entity),
ng AS (SELECT entity, round_even(s * 365, 6) AS slope, n FROM g WHERE vx > 0 AND n >= 6)"""),
    "filter_entities": with_tables("SELECT * FROM f20", F20),
    "all_entities": with_tables("SELECT * FROM f21", F21),
    "metric_timeseries": with_tables("""
SELECT year_month, entity, round_even(CAST(sum(post_count) AS DOUBLE), 6) AS value
FROM f20 GROUP BY year_month, entity""", F20),
    "metric_timeseries_all": with_tables(f"""
SELECT year_month, 'All entities' AS entity, round_even({NZ.format(c='positive_sentiment')}, 6) AS value
FROM f21 GROUP BY year_month""", F21),
    "metric_ranking": with_tables("""
SELECT entity, round_even(CAST(sum(total_likes) AS DOUBLE), 6) AS value FROM f20 GROUP BY entity""", F20),
    "metric_ranking_all": with_tables(f"""
SELECT entity, round_even({NZ.format(c='negative_sentiment')}, 6) AS value FROM f21 GROUP BY entity""", F21),
    "sentiment_space": with_tables(SPACE.format(src="f20"), F20),
    "entity_summary": with_tables(SUMMARY.format(src="f20"), F20),
    "entity_summary_all": with_tables(SUMMARY.format(src="f21"), F21),
    "sentiment_density": with_tables("""
SELECT CAST(least(floor(positive_sentiment * 4), 3) AS INTEGER) AS pos_bin,
       CAST(least(floor(negative_sentiment * 4), 3) AS INTEGER) AS neg_bin,
       CAST(count(*) AS BIGINT) AS n
FROM f21 WHERE positive_sentiment > 0 OR negative_sentiment > 0 GROUP BY ALL""", F21),
    "month_timeseries": with_tables(f"""
SELECT year_month, CAST(total_likes AS DOUBLE) AS value FROM month_t WHERE {RANGE}"""),
    "redacted_share": with_tables("""
SELECT year_month, redacted, post_count, month_total, post_count / month_total * 100 AS pct
FROM (SELECT *, CAST(sum(post_count) OVER (PARTITION BY year_month) AS BIGINT) AS month_total
      FROM rs0)""", f"""
rs0 AS (SELECT year_month, redacted, CAST(sum(post_count) AS BIGINT) AS post_count FROM date_t
        WHERE {RANGE} GROUP BY year_month, redacted)"""),
    "group_comparison_snapshot": with_tables(
        "SELECT * FROM space WHERE year_month = (SELECT max(year_month) FROM space)", GROUPS),
    "group_comparison_frames": with_tables("SELECT * FROM space", GROUPS),
})


# Logs / profile / checks
from postlens.plans.prompts import SKIP_PREFIXES  # noqa: E402
from postlens.plans.quality import CHECKS  # noqa: E402

_MEASURES = (("post_count", "posts"), ("total_likes", "likes"), ("total_shares", "shares"))


def _check_sql(name, expected, actual, rel) -> str:
    e, a = (f"coalesce({x}, 0)" if isinstance(x, str) else str(x) for x in (expected, actual))
    return f"SELECT '{name}' AS check_name, year_month, {e} AS expected, {a} AS actual, '{rel}' AS rel FROM qc"


def _bucket_sql(name, cond) -> str:
    f = f"FILTER (WHERE {cond})"
    return f"count(*) {f} AS p_{name}_posts, sum(likes) {f} AS p_{name}_likes, sum(shares) {f} AS p_{name}_shares"

_STRIP = "regexp_replace(text, '^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$', '', 'g')"
PROMPTS = f"""
pr0 AS (SELECT printf('conv-%06d', conv_id) AS session_id, turn AS line_pos, {_STRIP} AS content
        FROM conversations WHERE role = 'user'),
pr AS (SELECT * FROM pr0 WHERE content <> ''
         AND NOT ({' OR '.join(f"starts_with(content, '{p}')" for p in SKIP_PREFIXES)})
         AND NOT (starts_with(content, '<') AND ends_with(content, '>')))"""

SQL.update({
    "extract_prompts": with_tables("""
SELECT CAST(row_number() OVER (ORDER BY session_id, line_pos) AS BIGINT) AS n, session_id,
       '' AS timestamp, content,
       coalesce(lag(session_id) OVER (ORDER BY session_id, line_pos) <> session_id, true) AS new_session
FROM pr""", PROMPTS),
    "prompt_log_summary": with_tables("""
SELECT CAST((SELECT count(DISTINCT conv_id) FROM conversations) AS BIGINT) AS n_sessions,
       CAST((SELECT count(*) FROM pr) AS BIGINT) AS n_prompts""", PROMPTS),
    "entity_sentiment_profile": with_tables(f"""
SELECT entity, strftime(bin, '%Y-%m-%d') AS bin, CAST(n_posts AS BIGINT) AS n_posts,
       round_even(fb, 6) AS frac_bearing, round_even(mp, 6) AS mean_pos,
       round_even(mn, 6) AS mean_neg, round_even(fa, 6) AS frac_ambivalent
FROM prof WHERE n_posts >= {C.FX_PROFILE_MIN_POSTS}""", f"""
pn AS (SELECT DISTINCT year_month, tweet_id, detected_as AS entity FROM fx_entities
       WHERE confidence >= {C.FX_MIN_CONFIDENCE} AND detected_as IS NOT NULL),
pp AS (SELECT year_month, tweet_id, CAST(date_trunc('month', created_at) AS DATE) AS bin,
              coalesce(CAST(positive_emotion AS DOUBLE), 0.0) AS pos,
              coalesce(CAST(negative_emotion AS DOUBLE), 0.0) AS neg FROM fx_tweets),
prof AS (SELECT pn.entity, pp.bin, count(*) AS n_posts,
                avg(CASE WHEN pos > 0 OR neg > 0 THEN 1.0 ELSE 0.0 END::DOUBLE) AS fb,
                coalesce(avg(pos) FILTER (WHERE pos > 0), 0.0) AS mp,
                coalesce(avg(neg) FILTER (WHERE neg > 0), 0.0) AS mn,
                avg(CASE WHEN pos >= {C.FX_AMBIVALENT_AT} AND neg >= {C.FX_AMBIVALENT_AT}
                         THEN 1.0 ELSE 0.0 END::DOUBLE) AS fa
         FROM pp JOIN pn ON pp.year_month = pn.year_month AND pp.tweet_id = pn.tweet_id
         GROUP BY pn.entity, pp.bin)"""),
    "quality_checks": with_tables(f"""
SELECT check_name, year_month, CAST(expected AS BIGINT) AS expected, CAST(actual AS BIGINT) AS actual,
       CASE rel WHEN 'eq' THEN expected = actual WHEN 'le' THEN actual <= expected ELSE actual >= expected END AS ok
FROM ({' UNION ALL '.join(_check_sql(*c) for c in CHECKS)})
UNION ALL
SELECT 'redaction_token_collisions', NULL, 0, count(*), count(*) = 0
FROM (SELECT token FROM (SELECT DISTINCT token, entity FROM (SELECT * FROM d_red UNION ALL SELECT * FROM e_red))
      GROUP BY token HAVING count(*) > 1)""", f"""
qc_top AS (SELECT p.year_month, p.tweet_id, count(t.name) AS n_date, count(e.entity) AS n_entity
           FROM d_pairs p LEFT JOIN d_top t ON p.year_month = t.year_month AND p.name = t.name
           LEFT JOIN e_top e ON p.year_month = e.year_month AND p.name = e.entity GROUP BY p.year_month, p.tweet_id),
qc_p AS (SELECT t.year_month, count(*) AS p_posts, sum(likes) AS p_likes, sum(shares) AS p_shares,
                sum(greatest(coalesce(n_date, 0), 1)) AS p_pairs,
                {_bucket_sql('none', 'n_date IS NULL')}, {_bucket_sql('other', 'n_date = 0')},
                sum(coalesce(n_entity, 0)) AS p_top_posts, sum(coalesce(n_entity, 0) * likes) AS p_top_likes,
                sum(coalesce(n_entity, 0) * shares) AS p_top_shares
         FROM q_tweets t LEFT JOIN qc_top k ON t.year_month = k.year_month AND t.tweet_id = k.tweet_id GROUP BY t.year_month),
qc_m AS (SELECT year_month, post_count AS m_posts, total_likes AS m_likes, total_shares AS m_shares FROM month_t),
qc_d AS (SELECT year_month, count(*) AS d_rows, count(DISTINCT (positive_sentiment, negative_sentiment, entity)) AS d_keys,
                count(DISTINCT entity) AS d_names,
                count(*) FILTER (WHERE positive_sentiment NOT IN (0, .25, .5, .75, 1) OR negative_sentiment NOT IN (0, .25, .5, .75, 1))
                  AS d_off_domain,
                count(*) FILTER (WHERE classified <> (entity NOT IN ('Other', 'None')) OR redacted <> starts_with(entity, '[REDACTED_'))
                  AS d_bad_flags,
                {', '.join(f"sum({c}) {f} AS d{b}_{x}" for b, f in (('', ''), ('_none', "FILTER (WHERE entity = 'None')"),
                                                                    ('_other', "FILTER (WHERE entity = 'Other')"))
                           for c, x in _MEASURES)}
         FROM date_t GROUP BY year_month),
qc_e AS (SELECT year_month, count(*) AS e_rows, count(DISTINCT entity) AS e_names,
                count(*) FILTER (WHERE NOT (positive_sentiment BETWEEN 0 AND 1) OR NOT (negative_sentiment BETWEEN 0 AND 1)) AS e_off_range,
                count(*) FILTER (WHERE classified <> (entity NOT IN ('Other', 'None')) OR redacted <> starts_with(entity, '[REDACTED_'))
                  AS e_bad_flags, {', '.join(f"sum({c}) AS e_{x}" for c, x in _MEASURES)}
         FROM entity_t GROUP BY year_month),
qc_n AS (SELECT year_month, entity, bool_or(classified AND NOT redacted) AS plain, {', '.join(f"sum({c}) AS d_{x}" for c, x in _MEASURES)}
         FROM date_t WHERE classified GROUP BY year_month, entity),
qc_b AS (SELECT n.year_month, {', '.join(f"sum(n.d_{x}) AS both_d_{x}, sum(e.{c}) AS both_e_{x}" for c, x in _MEASURES)},
                count(*) FILTER (WHERE plain AND NOT EXISTS (SELECT 1 FROM fx_entities f WHERE f.year_month = n.year_month
                                                             AND f.detected_as = n.entity)) AS d_foreign_names
         FROM qc_n n LEFT JOIN entity_t e ON n.year_month = e.year_month AND n.entity = e.entity GROUP BY n.year_month),
qc AS (SELECT *, {DATE_TOP_N + 2} AS date_n_plus_2, {ENTITY_TOP_N} AS entity_n
       FROM qc_p FULL JOIN qc_m USING (year_month) FULL JOIN qc_d USING (year_month)
       FULL JOIN qc_e USING (year_month) FULL JOIN qc_b USING (year_month))"""),
})

SQL.update({
    "rdf_tweets": with_tables("""
SELECT tweet_id, created_at, user_id, likes, shares,
       coalesce(positive_emotion, CAST(0 AS FLOAT)) AS positive_emotion,
       coalesce(negative_emotion, CAST(0 AS FLOAT)) AS negative_emotion, year_month
FROM fx_tweets"""),
    "rdf_entities": with_tables("""
SELECT tweet_id, detected_as, matched_uri, confidence, year_month FROM fx_entities"""),
    "rdf_mentions": """
SELECT CAST(o.o_orderkey AS VARCHAR) AS tweet_id,
       lower(regexp_replace(c.c_name, '[^A-Za-z0-9]', '', 'g')) AS username,
       strftime(o.o_orderdate, '%Y-%m') AS year_month
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""",
})

SQL.update({
    "incremental_date_table": SQL["date_table"],
    "streaming_date_table": SQL["date_table"],
    "merged_date_table": SQL["date_table"],
    "merged_entity_table": SQL["entity_table"],
    "merged_month_table": SQL["month_table"],
})

SQL.update({
    "date_run_summary": with_tables("""
SELECT CAST(count(*) AS BIGINT) AS n_rows, min(year_month) AS first_month, max(year_month) AS last_month,
       CAST(sum(post_count) AS BIGINT) AS total_posts, CAST(sum(total_likes) AS BIGINT) AS total_likes,
       CAST(sum(total_shares) AS BIGINT) AS total_shares
FROM date_t"""),
    "date_sample_rows": with_tables("""
SELECT * FROM date_t ORDER BY year_month, entity, positive_sentiment, negative_sentiment LIMIT 16"""),
    "filter_entities_by_index": with_tables(f"""
SELECT * FROM entity_t
WHERE entity IN ({_in(C.FX_SELECTED)}) AND classified AND NOT redacted
  AND year_month BETWEEN (SELECT year_month FROM ax WHERE i = (SELECT lo FROM b))
                     AND (SELECT year_month FROM ax WHERE i = (SELECT hi FROM b))""", f"""
ax AS (SELECT year_month, dense_rank() OVER (ORDER BY year_month) - 1 AS i
       FROM (SELECT DISTINCT year_month FROM entity_t)),
b0 AS (SELECT least(greatest({C.FX_LO_IDX}, 0), count(*) - 1) AS lo, count(*) AS n FROM ax),
b AS (SELECT lo, greatest(lo, least({C.FX_HI_IDX}, n - 1)) AS hi FROM b0)"""),
})

SQL.update({
    "entity_summary_display": with_tables(f"""
SELECT entity, posts,
       format('{{:,}}', months) AS months_fmt, format('{{:,}}', posts) AS posts_fmt,
       format('{{:,}}', likes) AS likes_fmt, format('{{:,}}', shares) AS shares_fmt,
       format('{{:.3f}}', pos_sentiment) AS pos_fmt, format('{{:.3f}}', neg_sentiment) AS neg_fmt
FROM ({SUMMARY.format(src="f21")})""", F21),
})


# Dumps, files and months in unusual shapes
def _tokens(c: str) -> str:
    return f"list_filter(string_split_regex(translate(lower({c}), '{LEET_FROM}', '{LEET_TO}'), '{SPLIT_PATTERN}'), lambda x: x <> '')"


_PHRASES = ", ".join(f"('{w}')" for w in C.FX_PHRASES)
_SHIFT = " ".join(f"WHEN {i} THEN to_hours({-int(o[:3] if o != 'Z' else 0)})" for i, o in enumerate(C.FX_LOG_OFFSETS))

SQL.update({
    "rdf_hole_month": SQL["rdf_entities"],
    "rdf_plain_split": SQL["rdf_tweets"],
    "rdf_long_streams": SQL["rdf_tweets"],
    "converted_posts": SQL["rdf_tweets"],
    "conversion_status": with_tables("SELECT DISTINCT year_month, 'skipped' AS status FROM fx_tweets"),
    "swapped_posts_found": with_tables(f"""
SELECT year_month, n_source, CAST(n_source - missing + extra AS BIGINT) AS n_built, missing, extra, missing_ids, extra_ids FROM (
  SELECT t.year_month, count(*) AS n_source, CAST(count(*) FILTER (moved) AS BIGINT) AS missing,
         array_to_string(list_sort((list(tweet_id ORDER BY tweet_id) FILTER (moved))[1:3]), ',') AS missing_ids
  FROM (SELECT year_month, tweet_id,
               CAST(tweet_id AS BIGINT) % {C.FX_HOLE_EVERY} = 0 AND year_month IN ({_in(C.FX_SWAPPED)}) AS moved FROM fx_tweets) t
  GROUP BY ALL) LEFT JOIN (
  SELECT CASE year_month WHEN '{C.FX_SWAPPED[0]}' THEN '{C.FX_SWAPPED[1]}' ELSE '{C.FX_SWAPPED[0]}' END AS year_month,
         count(*) AS came, array_to_string((list(tweet_id ORDER BY tweet_id))[1:3], ',') AS extra_ids
  FROM fx_tweets WHERE CAST(tweet_id AS BIGINT) % {C.FX_HOLE_EVERY} = 0 AND year_month IN ({_in(C.FX_SWAPPED)}) GROUP BY ALL)
  USING (year_month), LATERAL (SELECT CAST(coalesce(came, 0) AS BIGINT) AS extra)"""),
    "published_date_table": SQL["date_table"],
    "published_redactions": SQL["redaction_table"],
    "streaming_mended_month": SQL["date_table"],
    "streaming_status": with_tables(f"""
SELECT DISTINCT year_month, CASE WHEN year_month = '{C.FX_BAD_MONTH}' THEN 'failed' ELSE 'built' END AS status
FROM fx_tweets WHERE created_at <= TIMESTAMP '{C.FX_FIRST_WAVE_END} 23:59:59'"""),
    "incremental_entity_table": SQL["entity_table"],
    "incremental_month_table": SQL["month_table"],
    "streaming_late_entities": SQL["date_table"],
    "month_files_posts": SQL["month_table"],
    "month_table_with_empty_months": with_tables(f"""
SELECT c.year_month, coalesce(total_likes, 0) AS total_likes, coalesce(total_shares, 0) AS total_shares,
       coalesce(post_count, 0) AS post_count
FROM (SELECT strftime(unnest(generate_series(DATE '{C.FX_CAL_START}-01', DATE '{C.FX_CAL_END}-01', INTERVAL 1 MONTH)), '%Y-%m')
             AS year_month) c LEFT JOIN month_t m ON c.year_month = m.year_month"""),
    "redaction_phrases": with_tables("""
SELECT DISTINCT n.name AS original, '[REDACTED_' || substr(md5(n.name), 1, 6) || ']' AS token
FROM nm n JOIN ph ON contains(n.folded, ph.folded)""", f"""
nm AS (SELECT name, ' ' || array_to_string({_tokens('name')}, ' ') || ' ' AS folded
       FROM (SELECT DISTINCT detected_as AS name FROM fx_entities)),
ph AS (SELECT ' ' || array_to_string(t, ' ') || ' ' AS folded
       FROM (SELECT {_tokens('word')} AS t FROM (VALUES {_PHRASES}) w(word)) WHERE len(t) > 0)"""),
    "written_date_table": with_tables("""
SELECT * REPLACE (CAST(positive_sentiment AS FLOAT) AS positive_sentiment, CAST(negative_sentiment AS FLOAT) AS negative_sentiment),
       year_month || '-01' AS month FROM date_t"""),
    "extract_prompts_in_zones": with_tables("""
SELECT CAST(row_number() OVER (ORDER BY timestamp, session_id, line_pos) AS BIGINT) AS n, session_id, timestamp, content,
       coalesce(lag(session_id) OVER (ORDER BY timestamp, session_id, line_pos) <> session_id, true) AS new_session
FROM prz""", f"""{PROMPTS},
prz AS (SELECT *, strftime(TIMESTAMP '{C.FX_LOG_START}' + to_minutes(line_pos)
               + CASE CAST(substr(session_id, 6) AS BIGINT) % {len(C.FX_LOG_OFFSETS)} {_SHIFT} END, '%Y-%m-%d %H:%M') || ' UTC' AS timestamp
        FROM pr)"""),
})
