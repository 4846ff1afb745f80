"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from postlens.llm import mixing, url_filter
from postlens.llm.queries import HOST_RULES

SQL: dict[str, str] = {}


def _mix_sql(fills: int = mixing.FILLS) -> str:
    cycle = ", ".join(f"{float(w)}" for w in mixing.WEIGHTS)
    n, most, share = len(mixing.WEIGHTS), mixing.MOST, mixing.SHARE
    sql = f"""
WITH d AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS k, source,
         CAST(coalesce(length(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         (CAST(CAST('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS UBIGINT) AS DOUBLE)
          + 0.5) / 4503599627370496.0 AS u,
         coalesce(doc_id, -9223372036854775808) AS id
  FROM documents),
s0 AS (SELECT k, any_value(source) AS source, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY k),
s1 AS (SELECT *, [{cycle}][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {n} + 1 AS BIGINT)] AS w, n * {most} AS cap FROM s0),
s2 AS (SELECT *, cap / w AS full_at FROM s1),
s3 AS (SELECT *, (sum(n) OVER () * {share} - coalesce(sum(cap) OVER (ORDER BY full_at, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY full_at, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS lev FROM s2),
s4 AS (SELECT *, max(CASE WHEN full_at >= lev THEN lev END) OVER () AS level FROM s3),
s5 AS (SELECT k, n AS source_size, coalesce(least(cap, w * level), cap) AS target FROM s4),
r0 AS (SELECT d.doc_id, d.k, d.size, d.id, d.u, s5.source_size, s5.target,
              least(CASE WHEN source_size > 0 THEN target / CAST(source_size AS DOUBLE) ELSE 1.0 END, {most}) AS e
       FROM d JOIN s5 ON d.k = s5.k),
r1 AS (SELECT *, CAST(floor(e) AS BIGINT) AS whole, e - floor(e) AS p FROM r0),
r2 AS (SELECT *, CASE WHEN p > 0 THEN (u / (1.0 - u)) / (p / (1.0 - p)) END AS q FROM r1),
t0 AS (SELECT * EXCLUDE (q), CASE WHEN p > 0 THEN q / (q + 1.0) ELSE 1.0 END AS t,
              greatest(target - sum(whole * size) OVER (PARTITION BY k), 0.0) AS amount,
              FALSE AS won FROM r2)"""
    for r in range(fills + 1):
        extra = " AND p > 0" if r == 0 else " AND NOT won AND size > 0 AND size <= amount"
        rank = "t" if r < fills else "CASE WHEN amount > 0 THEN (size - 1 + t) / amount END"
        sql += f""",
a{r} AS (SELECT *, whole + 1 <= {most}{extra} AS open FROM t{r}),
b{r} AS (SELECT *, CASE WHEN open THEN sum(CASE WHEN open THEN size ELSE 0 END)
                   OVER (PARTITION BY k ORDER BY {rank}, id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= amount
                   ELSE FALSE END AS hit FROM a{r}),
t{r + 1} AS (SELECT * EXCLUDE (open, hit, won, amount), won OR hit AS won,
              CASE WHEN max(CASE WHEN open AND NOT hit THEN 1 ELSE 0 END) OVER (PARTITION BY k) = 1
                   THEN amount - sum(CASE WHEN hit THEN size ELSE 0 END) OVER (PARTITION BY k) ELSE 0.0 END AS amount FROM b{r})"""
    return sql + f"""
SELECT doc_id, size, source_size, target, CAST((whole + CASE WHEN won THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM t{fills + 1}"""


SQL["op2_mix_sources"] = _mix_sql()


def _url_sql() -> str:
    def text(s):
        return "'" + s.replace("'", "''") + "'"

    fits, names, verdicts = [], "", ""
    for r in sorted(HOST_RULES, key=lambda r: -len(r.name)):
        host, path = r.name.split("/", 1)
        test = f"(host = {text(host)} OR ends_with(host, {text('.' + host)})) AND starts_with(path, {text('/' + path)})"
        names += f" WHEN {test} THEN {text(r.name)}"
        verdicts += f" WHEN {test} THEN {text(r.verdict)}"
    for p in sorted(url_filter.DEFAULT_PATTERNS, key=lambda r: -len(r.name)):
        fits.append(f"WHEN ok AND regexp_matches(host || rest, {text(url_filter.to_regex(p.pattern))}) THEN {text(p.name)}")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH a AS (SELECT page_id, coalesce(instr(url, '://') > 0, FALSE) AS ok,
                  CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS tail FROM pages),
b AS (SELECT page_id, ok, translate(regexp_extract(tail, '^[^/?#]*'), '{upper}', '{lower}') AS host,
             regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path,
             substr(tail, length(regexp_extract(tail, '^[^/?#]*')) + 1) AS rest FROM a),
c AS (SELECT *, CASE{names} END AS rule, CASE {' '.join(fits)} END AS hit,
             CASE{verdicts} END AS ruled FROM b)
SELECT page_id, host, path, rule, CASE WHEN rule IS NULL THEN hit END AS pattern,
       coalesce(ruled, CASE WHEN hit IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM c"""


SQL["op1_url_filter"] = _url_sql()

SQL["op5_exact_topk"] = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5"""

SQL["op7_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
r AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT payload_digest, max(page_id) AS top FROM r WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT r.page_id, payload_bytes, r.payload_digest,
       CASE WHEN top IS NULL OR top = r.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN top <> r.page_id THEN top END AS refers_to
FROM r LEFT JOIN m ON r.payload_digest = m.payload_digest AND payload_bytes >= 1000"""


SQL["op12_ranked_search"] = r"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id,
             regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
d1 AS (SELECT uid, doc_id, CAST(len(ts) AS BIGINT) AS n, ts FROM d WHERE len(ts) > 0),
s AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(coalesce(sum(n), 0) AS BIGINT) AS nt FROM d1),
i AS (SELECT row_number() OVER () AS item, item_id,
             unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
      FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (SELECT item, item_id, t, CAST(count(*) AS BIGINT) AS times FROM i GROUP BY ALL),
p AS (SELECT uid, t, CAST(count(*) AS BIGINT) AS tf FROM (SELECT uid, unnest(ts) AS t FROM d1) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln((2 * (SELECT nd FROM s) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p GROUP BY t),
c AS (SELECT p.uid, d1.doc_id, p.t, w.w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // nt))) AS v
      FROM p JOIN d1 USING (uid) JOIN w USING (t), s),
r AS (SELECT item, item_id, uid, doc_id, CAST(sum(v * times) AS BIGINT) AS score FROM c JOIN q USING (t) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM r WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 20"""


SQL["op11_collocations"] = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, unnest([1, 2, 3]) AS k, w, i FROM s),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, CAST(count(*) AS HUGEINT) AS f
      FROM g WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k >= 2),
cut AS (SELECT lang, k, phrase, a, w, unnest(range(1, k)) AS k1 FROM c),
sc AS (SELECT cut.lang, cut.phrase, a, x.f AS l, y.f AS r, (1000000 * a * a) // (x.f * y.f) AS score, k1
       FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(cut.w[1:k1], ' ')
                JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(cut.w[k1 + 1:], ' ')),
lo AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k1) = 1),
pairs AS (SELECT lang, phrase, max(a) AS outer_a FROM (
            SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM c WHERE k = 3
            UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM c WHERE k = 3) GROUP BY ALL),
kept AS (SELECT lo.* FROM lo LEFT JOIN pairs USING (lang, phrase) WHERE outer_a IS NULL OR 100 * outer_a < 50 * a),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r.r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM r JOIN t ON r.lang = t.lang WHERE rank <= 2000"""
