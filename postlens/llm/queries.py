"""Registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from postlens.llm import ann, bpe, collocations, licenses, mixing, packing, ranked, sharding, simhash, topk, toxicity, url_filter, warc
from postlens.session import ensure_checkpoint_dir
from postlens.sources.fixtures import read_table


#: The filter's host rules; urls that none fits are judged by ``url_filter.DEFAULT_PATTERNS``.
HOST_RULES = tuple(url_filter.host_rule(h, p, v) for h, p, v in (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block")))


def op1_url_filter(spark, sf_dir):
    return url_filter.judge(read_table(spark, sf_dir, "pages"), [*HOST_RULES, *url_filter.DEFAULT_PATTERNS])


def op2_mix_sources(spark, sf_dir):
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_simhash(spark, sf_dir):
    groups = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_pack(spark, sf_dir):
    return packing.pack(read_table(spark, sf_dir, "documents")).drop("token_bytes")


def op5_exact_topk(spark, sf_dir):
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), k=5, every=50)


def op6_nearest(spark, sf_dir):
    return ann.nearest(read_table(spark, sf_dir, "embeddings"), k=20, every=20)


def op7_warc(spark, sf_dir):
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-warc/{uuid.uuid4().hex}"
    records = warc.round_trip(read_table(spark, sf_dir, "pages"), folder)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to_page").alias("refers_to"))


def op8_toxicity(spark, sf_dir):
    return toxicity.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_licenses(spark, sf_dir):
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op10_shard(spark, sf_dir):
    placed = sharding.shard(read_table(spark, sf_dir, "documents"))
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return placed.select("doc_id", "size", crc.alias("text_crc32"), "law", "shard", "slot", "grown_shard")


def op11_collocations(spark, sf_dir):
    return collocations.mine(read_table(spark, sf_dir, "documents")).drop("cut")


def op12_ranked_search(spark, sf_dir):
    return ranked.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_bpe(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    both = bpe.decode(bpe.encode(docs, keep_text=False))
    return bpe.digests(both).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_mix_sources": op2_mix_sources,
    "op3_simhash": op3_simhash,
    "op4_pack": op4_pack,
    "op5_exact_topk": op5_exact_topk,
    "op6_nearest": op6_nearest,
    "op7_warc": op7_warc,
    "op8_toxicity": op8_toxicity,
    "op9_licenses": op9_licenses,
    "op10_shard": op10_shard,
    "op11_collocations": op11_collocations,
    "op12_ranked_search": op12_ranked_search,
    "op13_bpe": op13_bpe,
}
