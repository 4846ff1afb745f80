"""Small tables with the awkward cases every operator must survive."""

import duckdb

from tools.compare import TABLES, digest

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
CLASH = ("size", "shard", "slot", "law", "target", "taken", "source_size", "copies", "fp", "root", "queue", "n", "ids", "uid",
         "hits", "mask", "score", "predicted", "toxic", "host", "path", "rule", "verdict", "window", "__k", "__n", "__id")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"

ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta", "en", "s1", 1),
    (2, None, None, None, None),
    (3, "", "en", "s1", 0),
    (4, " \n\t ", "en", "s2", 4),
    (5, LONG, "en", "s2", len(LONG)),
    (6, LONG, "en", "s3", len(LONG)),
    (7, LONG + " tail", "fr", "s3", len(LONG)),
    (8, "one", "en", "s1", 3),
    (8, "one", "en", "s1", 3),
    (None, "no id here at all", "en", "s1", 9),
    (9, "ÀÉ tail \x0b x\u00a0y <|endoftext|> end", "fr", "a", 9),
    (10, "Alpha beta gamma delta epsilon zeta", "en", "ä", 1),
    (100, "one two three", None, "s1", 3),
]


def docs(spark, rows=ROWS, clash=True):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit(f"extra-{c}") for c in CLASH}) if clash else df


def empty(spark):
    return docs(spark, [])


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def assert_oracle(spark, sf_dir, name):
    import __spark_entry__ as E
    got = E.queries()[name](spark, sf_dir).toPandas()
    want = duck(sf_dir).execute(E.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert digest(got)[:2] == digest(want)[:2]
