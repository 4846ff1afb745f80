"""Dirty-name detection (K1) and the redaction token (K2) as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Leetspeak folding applied before tokenising, the token
# separator pattern, and the token format ``[REDACTED_<first 6 md5 hex>]``.
LEET_FROM = "4@31!0$57"
LEET_TO = "aaeiiosst"
SPLIT_PATTERN = r"[^\p{L}\p{N}]+"
TOKEN_PREFIX = "[REDACTED_"
TOKEN_SUFFIX = "]"
TOKEN_HEX = 6


def fold_tokens(c) -> Column:
    """Lower, fold leetspeak, split on everything but letters and digits of any alphabet."""
    norm = F.translate(F.lower(F.col(c) if isinstance(c, str) else c), LEET_FROM, LEET_TO)
    return F.filter(F.split(norm, SPLIT_PATTERN), lambda t: t != F.lit(""))


def padded(tokens: Column) -> Column:
    """Folded words as one string with a space at either end, so that whole runs of words are substrings of it."""
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))


def redaction_token(c, digits: int = TOKEN_HEX) -> Column:
    """``digits`` hex digits of the MD5; more of them make clashes between names rarer."""
    x = F.col(c) if isinstance(c, str) else c
    return F.concat(F.lit(TOKEN_PREFIX), F.substring(F.md5(x), 1, digits), F.lit(TOKEN_SUFFIX))
