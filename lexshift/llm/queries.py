"""One query for each operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexshift.llm import hnsw, links, mixing, packing, pii, simhash, token_orc, topk, toxicity, warc
from lexshift.session import table


def op1_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_toxicity_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_orc.round_trip(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")


def op7_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), "word_bpe_49k.json")


def op8_nra_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op9_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.judge(table(spark, sf_dir, "pages"))


def op10_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_pii_boosting,
        op2_simhash_dedup,
        op3_toxicity_pu,
        op4_mix_sources,
        op5_embedding_dedup,
        op6_token_orc,
        op7_hilbert_packing,
        op8_nra_top_k,
        op9_link_trust,
        op10_arc_to_warc,
    )
}
ORACLES = {"op4_mix_sources": mixing.ORACLE, "op8_nra_top_k": topk.ORACLE, "op10_arc_to_warc": warc.ORACLE}
