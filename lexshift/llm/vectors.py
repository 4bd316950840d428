"""What the operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(v: Column) -> Column:
    """True for vectors without null or non-finite components; false for null."""
    finite = lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(F.coalesce(x, F.lit(0.0)))
    return F.coalesce(F.forall(v, finite), F.lit(False))


def asked_of_shards(members: DataFrame, queries: DataFrame | None, shards: int, run, schema: str) -> DataFrame:
    """Every query meets every shard. members and queries: (grp, id, weight, v); only rows of equal grp meet.

    Without queries, members are the queries, and each of them meets its own shard and the later ones; so two members
    of one shard meet both ways and others once.

    run(members, queries) gets one shard's members as (ids, weights, vectors) and an
    iterator over its queries' batches of the same form, and yields record batches. Members
    stay in memory, so a shard has bounded rows; queries stream.
    """
    columns = ["shard", "asks", "id", "weight", "v"]
    if queries is None:
        members = members.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
        queries, first = members, F.col("shard")
    else:  # a repeated id doesn't fill one shard
        members = members.withColumn("shard", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(shards)))
        first = F.lit(0).cast("long")
    queries = queries.withColumn("shard", F.explode(F.sequence(first, F.lit(shards - 1).cast("long")))).withColumn("asks", F.lit(True))
    rows = members.withColumn("asks", F.lit(False)).unionByName(queries).withColumn("shard", F.col("grp") * 1_000_003 + F.col("shard")).select(*columns)
    # By range, as few keys would collide by hash; more partitions than shards, so that each stands alone.
    rows = rows.repartitionByRange(4 * shards, "shard").sortWithinPartitions("shard", "asks", "id")
    return rows.mapInArrow(lambda batches: _by_shard(batches, run), schema)


def _matrix(batch: pa.RecordBatch):
    v = batch.column("v")
    flat = v.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(v.offsets.to_numpy())
    width = int(sizes.max()) if len(sizes) else 0
    if (sizes == width).all():
        matrix = flat.reshape(len(sizes), width)
    else:  # short vectors end in zeros
        matrix = np.zeros((len(sizes), width), flat.dtype)
        matrix[np.arange(width)[None, :] < sizes[:, None]] = flat
    return batch.column("id").to_numpy(zero_copy_only=False), batch.column("weight").to_numpy(zero_copy_only=False), matrix


def widened(matrix: np.ndarray, width: int) -> np.ndarray:
    return matrix if matrix.shape[1] >= width else np.pad(matrix, ((0, 0), (0, width - matrix.shape[1])))


def _by_shard(batches, run):
    def pieces():
        for batch in batches:
            if not batch.num_rows:
                continue
            shard = batch.column("shard").to_numpy(zero_copy_only=False)
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((shard[1:] != shard[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                yield int(shard[a]), bool(asks[a]), batch.slice(a, b - a)

    rows = pieces()
    ahead = next(rows, None)
    while ahead:
        shard, held = ahead[0], []
        while ahead and ahead[0] == shard and not ahead[1]:
            held.append(_matrix(ahead[2]))
            ahead = next(rows, None)

        def asked(shard=shard):
            nonlocal ahead
            while ahead and ahead[0] == shard:
                yield _matrix(ahead[2])
                ahead = next(rows, None)

        if held:
            width = max(m[2].shape[1] for m in held)
            members = np.concatenate([m[0] for m in held]), np.concatenate([m[1] for m in held]), np.concatenate([widened(m[2], width) for m in held])
            yield from run(members, asked())
        for _ in asked():  # what run left, or queries of a shard without members
            pass
