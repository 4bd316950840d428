"""Packing documents into sequences along a Hilbert curve.

A document's token ids are hashed into buckets; the bucket counts are projected to
three dimensions by fixed random directions, scaled by the root of the document's
length, and cut into a grid. The cell's place on a Hilbert curve is the document's
key: neighbours on the curve have similar words. Documents are cut into ranges of that key with
equal numbers of ids, whatever their documents' lengths: the ids of each cell of the curve (CELLS at most) are
counted, a cell stands on the line of all ids in the curve's order, and this line is
cut every SHARD_TOKENS ids. A cell that lies across a cut, such as one of many
copies, deals its documents to its ranges by a hash. Each range is sorted and is one stream of ids
that is cut every 2048 ids. The rest of a stream, less than 2048 ids, is cut into sequences
whose lengths are powers of two, which need no padding; so nothing is padded at all.

Defined cases: a null text counts as empty (the end id alone); repeated rows are packed
each; documents with equal keys are ordered by id, length and ids; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexshift.llm.tokens import CACHE, encoder, slices
from lexshift.session import ship, small_batches, staged

LENGTH = 2048
END_ID = 1
DIMS, BITS, BUCKETS, SEED = 3, 10, 1024, 7
TOKENIZED = "doc_id long, key long, doc_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Ids of a range, and ranges at most (beyond these, ranges are longer).
SHARD_TOKENS, SHARDS = 4_000_000, 50_000
#: Cells of the curve whose ids are counted.
CELL_BITS = 15
CELLS = 1 << CELL_BITS
#: Sequences of one task have ids from its number times this.
SPAN = 1 << 40


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of integer cells (n x dims), by Skilling's transposition."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[dims - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def directions(seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).choice([-1.0, 1.0], (BUCKETS, DIMS)).astype(np.float32)


def document_keys(ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents whose ids (n each) stand one after another."""
    if not len(n):
        return np.zeros(0, np.int64)
    bucket = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(54)).astype(np.int64)
    at = np.cumsum(n) - n
    sums = np.stack([np.add.reduceat(way[bucket].astype(np.float64), at) for way in directions().T], axis=1)
    place = np.tanh(sums / np.sqrt(n)[:, None] / 4)
    cells = np.clip(((place + 1) / 2 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
    return hilbert_keys(cells)


def _tokenized(tokenizer: str, kind: str, end_id: int, cache: int):
    def run(batches):
        units = encoder(tokenizer, kind, cache)
        for batch in slices(batches):
            ids, n = units.encode(batch.column("text"))
            ids = np.insert(ids, np.cumsum(n), end_id)
            n = n + 1
            raw = ids.astype(units.width)
            offsets = np.concatenate([[0], np.cumsum(n) * raw.itemsize])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(document_keys(ids, n)),
                    pa.array(n),
                    pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).cast(pa.binary()),
                ],
                names=["doc_id", "key", "doc_tokens", "ids"],
            )

    return run


def _packed(length: int):
    def run(batches):
        first = TaskContext.get().partitionId() * SPAN
        position, open_pieces = 0, []  # the pieces of the sequence that isn't full yet

        def record(doc, start, ids, total, sequence, offset):
            return doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, first + sequence, offset

        def batch_of(rows):
            names = [x.split()[0] for x in PIECES.split(", ")]
            columns = zip(*rows) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        for batch in batches:
            rows = []
            for doc, total, raw in zip(batch.column("doc_id").to_pylist(), batch.column("doc_tokens").to_pylist(), batch.column("ids")):
                data, start = raw.as_buffer(), 0
                ids = np.frombuffer(data, f"<u{data.size // total}")
                while start < total:
                    offset = position % length
                    n = min(total - start, length - offset)
                    open_pieces.append((doc, start, ids[start : start + n], total, position // length, offset))
                    position, start = position + n, start + n
                    if position % length == 0:
                        rows += [record(*p) for p in open_pieces]
                        open_pieces = []
            if rows:
                yield batch_of(rows)
        rest, sequence, rows = position % length, position // length, []
        size, filled = 1 << max(0, rest.bit_length() - 1), 0
        for doc, start, ids, total, _, _ in open_pieces:
            while len(ids):
                n = min(len(ids), size - filled)
                rows.append(record(doc, start, ids[:n], total, sequence, filled))
                ids, start, filled = ids[n:], start + n, filled + n
                if filled == size:
                    rest, sequence, filled = rest - size, sequence + 1, 0
                    size = 1 << max(0, rest.bit_length() - 1)
        if rows:
            yield batch_of(rows)

    return run


def dealt(tokenized: DataFrame, shard_tokens: int = SHARD_TOKENS) -> tuple[DataFrame, int]:
    """Rows with key and doc_tokens, with the number of their range added; and the number of ranges."""
    cell = F.shiftright("key", DIMS * BITS - CELL_BITS).alias("cell")
    cells = sorted(tuple(r) for r in tokenized.groupBy(cell).agg(F.sum("doc_tokens")).collect())  # CELLS rows at most
    before = np.concatenate([[0], np.cumsum([n for _, n in cells], dtype=np.int64)]).tolist()
    each = max(shard_tokens, -(-before[-1] // SHARDS))
    places = [(c, b, n) for (c, n), b in zip(cells, before)]
    places = F.broadcast(tokenized.sparkSession.createDataFrame(places, "cell long, before long, cell_tokens long"))
    spot = F.pmod(F.xxhash64("doc_id", "key", "doc_tokens"), F.lit(1 << 20)) / (1 << 20)
    shard = F.floor((F.col("before") + F.floor(spot * F.col("cell_tokens"))) / each).cast("int")
    rows = tokenized.withColumn("cell", cell).join(places, "cell")
    return rows.select(shard.alias("shard"), *tokenized.columns), max(1, -(-before[-1] // each))


def pack(docs: DataFrame, tokenizer: str, kind: str = "word", end_id: int = END_ID, length: int = LENGTH, shard_tokens: int = SHARD_TOKENS, cache: int = CACHE) -> DataFrame:
    """(doc_id, text) to pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with small_batches(docs.sparkSession):
        tokenized = staged(rows.mapInArrow(_tokenized(tokenizer, kind, end_id, cache), TOKENIZED), "packing-tokens")
    shards, n = dealt(tokenized, shard_tokens)
    ordered = shards.repartitionById(n, "shard").sortWithinPartitions("key", "doc_id", "doc_tokens", "ids")
    return ordered.select(*tokenized.columns).mapInArrow(_packed(length), PIECES)
