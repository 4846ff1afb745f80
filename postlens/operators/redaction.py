"""Redaction of unwanted names.

Detection runs on the *distinct* names of an already aggregated table, as
the reference does; the word list is a user-supplied DataFrame ``(word)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.functions.columns import classified_flag
from postlens.functions.redact import TOKEN_HEX, fold_tokens, padded, redaction_token


def dirty_names(names: DataFrame, words: DataFrame, name_col: str = "entity", digits: int = TOKEN_HEX) -> DataFrame:
    """K1: distinct names that hold an entry of the word list -> (original, token).

    Names and entries are folded and split alike; an entry is a word or a
    phrase of any length.  Entries without a letter or digit match nothing.

    Each entry is filed under that of its words which the fewest names hold
    (ties: the first by code point; an entry with a word that no name holds
    matches nothing).  A name's words fetch candidate entries, and only those
    are compared whole.  A name gives one row a distinct word, however long
    the longest entry is.
    """
    entries = (words.select(fold_tokens("word").alias("w")).where(F.size("w") > 0)
               .select(padded(F.col("w")).alias("phrase"), F.array_distinct("w").alias("w")).distinct())
    entry_words = entries.select("phrase", F.size("w").alias("n_words"), F.explode("w").alias("word"))
    by_word = (names.select(F.col(name_col).alias("original")).distinct()
               .select("original", F.explode(F.array_distinct(fold_tokens("original"))).alias("word")))
    met = by_word.join(entry_words.select("word").distinct(), "word", "left_semi")
    held = met.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    index = (entry_words.join(held, "word").groupBy("phrase", "n_words")
             .agg(F.count(F.lit(1)).alias("n_met"), F.min(F.struct("n", "word")).alias("rarest"))
             .where("n_met = n_words").select("phrase", F.col("rarest.word").alias("word")))
    return (met.join(index, "word").where(F.contains(padded(fold_tokens("original")), F.col("phrase")))
            .select("original").distinct().withColumn("token", redaction_token("original", digits)))


def apply_redaction(table: DataFrame, words: DataFrame | None, name_col: str = "entity", digits: int = TOKEN_HEX):
    """K2: replace dirty names by their token, add ``redacted`` and ``classified``.

    Returns ``(table, redactions)``.  No re-aggregation after the rename (the
    reference does none either); ``redaction_collisions`` reports token clashes.
    """
    if words is None:
        out = table.withColumn("redacted", F.lit(False))
        red = table.sparkSession.createDataFrame([], "original string, token string")
    else:
        red = dirty_names(table, words, name_col, digits)
        out = (table.join(red.withColumnRenamed("original", name_col), name_col, "left")
               .withColumn("redacted", F.col("token").isNotNull())
               .withColumn(name_col, F.coalesce("token", name_col))
               .drop("token"))
    return out.withColumn("classified", classified_flag(name_col)), red


def redaction_table(redactions: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Side table ``(token, original)``, one row for each original (``redaction_collisions`` lists shared tokens)."""
    new = redactions.select("token", "original")
    return (new if existing is None else existing.select("token", "original").unionByName(new)).distinct()


def redaction_collisions(redactions: DataFrame) -> DataFrame:
    """Trap 16: tokens shared by more than one original name."""
    return (redactions.groupBy("token").agg(F.count("*").alias("n_originals"))
            .filter("n_originals > 1"))
