"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a filter-list pattern over ``host + rest`` (host lower-cased; rest
is the url after the host): ``||`` at the start anchors it to the host or any
of its subdomains, ``*`` matches anything, ``^`` a separator or the end;
without ``||`` it may match anywhere.  A rule's safe literal tokens are the
letter-digit runs that every matching url holds as whole tokens.  All urls'
token counts say which of them is rarest; the rule is filed there.  A url
looks its own tokens up and runs only the regular expressions found; rules
without a safe token are tried on every url.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import by_value

by_value(__name__)

TOKEN = re.compile(r"[A-Za-z0-9]+")
MOST_RULES_A_PASS = 200_000
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    """``tier`` 0 outranks tier 1; inside a tier the longest ``name`` wins, then the earlier rule."""
    name: str
    pattern: str
    verdict: str
    tier: int = 0


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """Fits ``host`` and its subdomains where the url's path starts with ``path``."""
    literal = host + path
    if "*" in literal or "^" in literal:
        raise ValueError("host rules are literal")
    return Rule(literal, "||" + literal, verdict)


#: Word patterns for the verdict where no host rule fits.
DEFAULT_PATTERNS = tuple(
    Rule(p, p, "block", 1) for p in
    ("casino", "free-bets", "cheap-pills", "spam-farm", "ads-track", "adult-", "/ads/", "/adserver^", "||doubleclick^",
     "/wp-login.php", "-phishing-", "*/popunder/*"))


def to_regex(pattern: str) -> str:
    host = pattern.startswith("||")
    body = "".join({"*": r"[\s\S]*", "^": r"(?:[^A-Za-z0-9_.%-]|$)"}.get(c, re.escape(c)) for c in pattern[2 if host else 0:])
    return (r"^(?:[^/?#]*\.)?" if host else "") + body


def safe_tokens(pattern: str) -> list[str]:
    """Tokens with a literal non-token character, an anchor or ``^`` on both sides."""
    host = pattern.startswith("||")
    body = pattern[2:] if host else pattern
    out = []
    for m in TOKEN.finditer(body):
        left = m.start() > 0 and body[m.start() - 1] != "*" or m.start() == 0 and host
        right = m.end() < len(body) and body[m.end()] != "*"
        if left and right:
            out.append(m.group())
    return out


def split_url(url: str | None) -> tuple[str, str, str]:
    """host, path and rest (all after the host); empty without ``://``."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", "", ""
    tail = url[at + 3:]
    end = min((i for i in map(tail.find, "/?#") if i >= 0), default=len(tail))
    rest = tail[end:]
    stop = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    return tail[:end].translate(LOWER), rest[:stop], rest


def token_counts(urls: DataFrame, url: str, tokens: set[str]) -> dict[str, int]:
    """In how many urls each of the rules' tokens occurs (as many rows as tokens reach the driver)."""
    def run(batches):
        from collections import Counter

        found: Counter = Counter()
        for b in batches:
            for u in b.column(0).to_pylist():
                host, _, rest = split_url(u)
                found.update(tokens.intersection(TOKEN.findall(host + rest)))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())],
                                         ["token", "n"])

    got = urls.select(F.col(url).cast("string").alias("u")).mapInArrow(run, "token string, n long")
    return {r.token: r.n for r in got.groupBy("token").agg(F.sum("n").alias("n")).collect()}


def build_index(rules: list[Rule], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """(rarest token -> rule numbers, numbers of rules without a safe token)."""
    index: dict[str, list[int]] = {}
    always = []
    for i, rule in enumerate(rules):
        tokens = safe_tokens(rule.pattern)
        if tokens:
            index.setdefault(min(tokens, key=lambda t: (counts.get(t, 0), t)), []).append(i)
        else:
            always.append(i)
    return index, always


def judge(urls: DataFrame, rules: list[Rule], url: str = "url", key: str = "page_id", default: str = "allow") -> DataFrame:
    """(key, host, path, rule, pattern, verdict), a row for every row.

    ``rule`` is the winning tier-0 rule's name, else null; ``pattern`` the
    winning lower-tier pattern where no rule fits; without either the verdict
    is ``default``.  Null urls and urls without ``://`` have an empty host and
    path and match no rule.  Repeated rows each get a row; an empty table
    gives an empty result; other columns are not read.  Rules are sent to the
    tasks MOST_RULES_A_PASS at a time; more take further passes.
    """
    best = urls.select(F.col(key), F.col(url).cast("string").alias("url"), F.lit(None).cast("int").alias("win"))
    counts = token_counts(urls, url, {t for r in rules for t in safe_tokens(r.pattern)})
    # Numbered from best to worst, so that the smallest number wins.
    ranked = sorted(range(len(rules)), key=lambda i: (rules[i].tier, -len(rules[i].name), i))
    ordered = [rules[i] for i in ranked]
    for at in range(0, len(ordered), MOST_RULES_A_PASS):
        best = best.mapInArrow(_pass(ordered[at:at + MOST_RULES_A_PASS], at, counts), best.schema)

    def finish(batches):
        for b in batches:
            out = []
            for u, w in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                host, path, _ = split_url(u)
                r = None if w is None else ordered[w]
                out.append((host, path, r.name if r and r.tier == 0 else None, r.name if r and r.tier else None,
                            r.verdict if r else default))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.string()) for c in cols)],
                                             [b.schema.names[0], "host", "path", "rule", "pattern", "verdict"])

    kind = urls.schema[key].dataType.simpleString()
    return best.mapInArrow(finish, f"`{key}` {kind}, host string, path string, rule string, pattern string, verdict string")


def _pass(rules: list[Rule], offset: int, counts: dict[str, int]):
    def run(batches):
        index, always = build_index(rules, counts)
        compiled = {}

        def fits(i, s):
            if i not in compiled:
                compiled[i] = re.compile(to_regex(rules[i].pattern))
            return compiled[i].search(s)

        for b in batches:
            wins = []
            for u, held in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                host, _, rest = split_url(u)
                s = host + rest
                if held is None and u is not None and "://" in u:
                    found = [i for t in set(TOKEN.findall(s)) & index.keys() for i in index[t]] + always
                    held = next((i + offset for i in sorted(found) if fits(i, s)), None)
                wins.append(held)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(wins, pa.int32())], b.schema.names)

    return run
