"""Benchmark: headline queries on the driver's tables, one JSON line out.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is run to completion through the ``noop`` sink (full execution,
no collect), twice: ``cold`` is the first run in the session (includes plan
code generation), ``queries`` the second (warm).  ``value`` is the warm
total.  Inputs that the reference would already have on disk — the built
tables the reports read and the rendered N3 dump the parser reads — are
prepared before timing; their build time is reported as ``prepare_sec``.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "month_table", "date_table", "entity_table", "redaction_table",
    "rdf_tweets", "rdf_entities",
    "monthly_volume", "calendar_gaps", "sentiment_trend", "entity_spikiness", "entity_growth",
    "entity_sentiment", "top_entity_names", "search_entities", "net_sentiment_ranking",
    "normalized_growth", "metric_timeseries_all", "sentiment_space", "entity_summary_all",
    "sentiment_density", "redacted_share", "group_comparison_snapshot",
    "entity_sentiment_profile", "extract_prompts", "quality_checks",
]
DUMP_COPIES = 10


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from postlens.plans import catalog as C
    from postlens.session import build_session
    spark = build_session(master=f"local[{cpus}]", partitions=max(8, cpus * 2))
    spark.range(1000).selectExpr("sum(id)").collect()          # JVM warm-up
    t0 = time.time()
    C.gold_month(spark, sf_dir)
    C.gold_date(spark, sf_dir)
    C.gold_entity(spark, sf_dir)
    C.dump_path(spark, sf_dir)
    prepare = time.time() - t0
    cold, warm = {}, {}
    for name in HEADLINE:
        for store in (cold, warm):
            t = time.time()
            C.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            store[name] = round(time.time() - t, 3)
    # Q05 end to end, the one figure the baseline publishes (rows/s): parse the
    # dump once and write the three month-partitioned tables; then a dump of
    # DUMP_COPIES times its lines.
    from pyspark.sql import functions as F

    from postlens.session import ensure_checkpoint_dir
    from postlens.sources import rdf
    from postlens.sources.fixtures import load_corpus, mentions_from_orders, read_table
    from postlens.streaming import incremental as inc
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/bench/{uuid.uuid4().hex}"

    def convert(dump):
        out = f"{root}/convert-{uuid.uuid4().hex}"
        t = time.time()
        rdf.convert_dump(spark, dump, out, skip_existing=False)
        return round(time.time() - t, 3), sum(spark.read.parquet(f"{out}/{k}").count() for k in rdf.TABLES)

    dump = C.dump_path(spark, sf_dir)
    cold["rdf_convert"], _ = convert(dump)
    warm["rdf_convert"], rows = convert(dump)
    c = load_corpus(spark, sf_dir)
    users = mentions_from_orders(read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer"))

    def again(df):
        df = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(DUMP_COPIES - 1))))
        return df.withColumn("tweet_id", (F.col("tweet_id").cast("long") * DUMP_COPIES + F.col("copy")).cast("string")).drop("copy")

    rdf.write_dump(rdf.render_dump(again(c.tweets), again(c.entities), again(users)), f"{root}/dump")
    large_s, large_rows = convert(f"{root}/dump")
    # One month rebuilt in a history of all of them.
    c.tweets.select(*inc.TWEETS_SOURCE.names).write.partitionBy("year_month").parquet(f"{root}/tweets")
    c.entities.select(*inc.ENTITIES_SOURCE.names).write.partitionBy("year_month").parquet(f"{root}/entities")
    inc.run_incremental(spark, f"{root}/tweets", f"{root}/entities", f"{root}/staging", "date", C.DATE_TOP_N)
    late = c.tweets.filter("year_month = '1998-03'").limit(1).select(*inc.TWEETS_SOURCE.names)
    late.write.mode("append").partitionBy("year_month").parquet(f"{root}/tweets")
    t = time.time()
    inc.run_incremental(spark, f"{root}/tweets", f"{root}/entities", f"{root}/staging", "date", C.DATE_TOP_N)
    warm["incremental_one_month"] = round(time.time() - t, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_time_warm", "value": round(sum(warm.values()), 3),
                      "unit": "sec", "queries": warm, "cold": cold,
                      "cold_total": round(sum(cold.values()), 3), "prepare_sec": round(prepare, 3),
                      "rdf_convert_rows": rows,
                      "rdf_convert_rows_per_sec": round(rows / warm["rdf_convert"]),
                      "rdf_convert_large": {"rows": large_rows, "sec": large_s, "rows_per_sec": round(large_rows / large_s)},
                      "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
