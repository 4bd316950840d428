"""Token ids of documents as ORC files.

Documents are range-partitioned by id and sorted, so the files, in the order of
their shard column, hold them in ascending id order. ORC encodes the ids by integer
run lengths in stripes that are read in parallel, its row indexes and Bloom filters
on doc_id let a reader skip stripes and row groups. Positions in the whole stream
(start) come from one sum for each shard, so nothing runs over all rows at once.

Columns: doc_id, shard (int, in order), at (ids of the shard's documents before this
one), n_tokens, ids (array<int>, with the end id).

Defined cases: a null text counts as empty (the end id alone); null ids come first;
repeated rows are written each; an empty table makes no shard and reads back empty;
other columns of the input are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lexshift.llm.tokens import encoder, slices
from lexshift.session import scratch, ship, small_batches

SCHEMA = "doc_id long, shard int, at long, n_tokens long, ids array<int>"
END_ID = 2
#: Units that a task keeps, and bytes of text that it encodes at once.
CACHE, CHUNK = 600_000, 4_000_000
OPTIONS = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
    "compression": "zstd",
}


def _encoded(tokenizer: str, kind: str, end_id: int):
    def run(batches):
        units, shard, at = encoder(tokenizer, kind, CACHE), TaskContext.get().partitionId(), 0
        for batch in slices(batches, chunk=CHUNK):
            ids, n = units.encode(batch.column("text"))
            ids = np.insert(ids, np.cumsum(n), end_id)
            n = n + 1
            ends = np.cumsum(n)
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.full(len(n), shard, np.int32)),
                    pa.array(at + ends - n),
                    pa.array(n),
                    pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32))),
                ],
                names=["doc_id", "shard", "at", "n_tokens", "ids"],
            )
            at += int(n.sum())

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, kind: str = "byte", end_id: int = END_ID, mode: str = "error") -> None:
    """Write the token ids of (doc_id, text) to ORC files at path."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    with small_batches(docs.sparkSession):
        rows.mapInArrow(_encoded(tokenizer, kind, end_id), SCHEMA).write.mode(mode).options(**OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows; filters on doc_id prune stripes and row groups."""
    return spark.read.schema(SCHEMA).orc(path)


def _summed(batches):
    for batch in batches:
        ids = batch.column("ids")
        flat = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4"))
        at = ids.offsets.to_numpy().tolist()
        sums = [zlib.crc32(flat[a:b]) for a, b in zip(at, at[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("shard"), batch.column("at"), pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64())],
            names=["doc_id", "shard", "at", "n_tokens", "ids_crc32"],
        )


def summarize(spark: SparkSession, path: str) -> DataFrame:
    """What the files hold: doc_id, start, n_tokens, ids_crc32."""
    rows = read_tokens(spark, path).select("doc_id", "shard", "at", "ids").mapInArrow(_summed, "doc_id long, shard int, at long, n_tokens long, ids_crc32 long")
    shards = read_tokens(spark, path).groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # one row for each writing task
    before = W.Window.partitionBy().orderBy("shard").rowsBetween(W.Window.unboundedPreceding, -1)
    bases = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(bases, "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, kind: str = "byte", end_id: int = END_ID) -> DataFrame:
    spark = docs.sparkSession
    path = scratch(spark, "token-orc")
    write_tokens(docs, path, tokenizer, kind, end_id)
    return summarize(spark, path)
