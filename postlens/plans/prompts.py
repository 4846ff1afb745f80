"""Human prompt extraction from session logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.operators.sequence import global_row_number, previous_value

# Wrapper prefixes that mark tool/command echoes, not prompts.
SKIP_PREFIXES = (
    "<local-command",
    "<command-name",
    "<command-message",
    "<command-args",
    "<system-reminder",
    "<local-command-stdout",
    "<local-command-caveat",
    "<user-prompt-submit-hook",
)
OFFSET = r"(Z|[+-]\d{2}(:?\d{2})?)\s*$"
WS = "[ \\t\\n\\r\\f\\x0B]"
STRIP_PATTERN = f"^{WS}+|{WS}+$"


def strip_ws(c):
    return F.regexp_replace(c, STRIP_PATTERN, "")


def prompt_records(logs: DataFrame) -> DataFrame:
    """Parse each line (malformed -> dropped) and keep human text prompts."""
    v = F.try_parse_json(strip_ws(F.col("value")))
    rec = logs.select("session_id", "line_pos", v.alias("v")).filter(F.col("v").isNotNull())
    content_v = F.variant_get("v", "$.message.content", "variant")
    content = strip_ws(F.try_variant_get("v", "$.message.content", "string"))
    ts_raw = F.try_variant_get("v", "$.timestamp", "string")
    # An instant with an offset is shown in UTC whatever the session's zone; one without is taken as UTC.
    ts = F.try_to_timestamp(ts_raw)
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), ts.cast("timestamp_ntz"))
    ts = F.when(ts_raw.rlike(OFFSET), utc).otherwise(ts.cast("timestamp_ntz"))
    ts_fmt = F.coalesce(F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm"), F.lit(" UTC")), ts_raw, F.lit(""))
    kept = rec.filter(
        (F.try_variant_get("v", "$.type", "string") == "user")
        & ~F.coalesce(F.try_variant_get("v", "$.isMeta", "boolean"), F.lit(False))
        & (F.try_variant_get("v", "$.message.role", "string") == "user")
        & (F.schema_of_variant(content_v) == "STRING"))
    out = kept.select("session_id", "line_pos", ts_fmt.alias("timestamp"), content.alias("content"))
    skip = F.lit(False)
    for p in SKIP_PREFIXES:
        skip = skip | F.col("content").startswith(p)
    wrapped = F.col("content").startswith("<") & F.col("content").endswith(">")
    return out.filter((F.col("content") != "") & ~skip & ~wrapped)


def extract_prompts(logs: DataFrame) -> DataFrame:
    """Q31: prompts ordered by (timestamp text, session, line), numbered,
    with a marker where the session changes from the previous prompt."""
    p = global_row_number(prompt_records(logs), ["timestamp", "session_id", "line_pos"])
    p = previous_value(p, "session_id", out="_prev")
    return p.select("n", "session_id", "timestamp", "content",
                    F.coalesce(F.col("_prev") != F.col("session_id"), F.lit(True)).alias("new_session"))


def prompt_log_summary(logs: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Sessions are counted over all lines, even sessions with no prompt.

    ``files`` (``log_files``) names the sessions of empty files too, which have no line.
    """
    named = logs.select("session_id")
    sessions = (named if files is None else named.unionByName(files.select("session_id"))).agg(F.countDistinct("session_id").alias("n_sessions"))
    prompts = prompt_records(logs).agg(F.count(F.lit(1)).alias("n_prompts"))
    return sessions.select(
        "n_sessions", prompts.select("n_prompts").scalar().alias("n_prompts"))
