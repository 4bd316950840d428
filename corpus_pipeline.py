"""The training-data pipeline: five stages, each over all that the one before it kept.

Toxic documents go; of documents of similar texts (five-word shingles, 0.8 or more) one stays; personal
data is replaced by its kind; sources are mixed to their target weights; the mix is packed into sequences.

Defined cases: a null text counts as empty and stays null until it is packed (an end id alone); documents
without words count as copies of each other; rows of null ids are all kept by the first two stages; of rows of one id
one stays; without confirmed toxic labels no document is toxic; other columns, whatever their names, are
carried to the last stage; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexshift.llm import mixing, packing, pii, simhash, toxicity
from lexshift.session import scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, "word_bpe_49k.json", cache=250_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_copies),
    ("pii", redact),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Learning, near-duplicates by fingerprints and tokenizers are beyond SQL; the pipeline is tested against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Every stage is written to the shared folder as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
