"""Exact top-k by inner product with no random access (NRA).

Components become integers, floor(256 x). Candidates are dealt to blocks of bounded
bytes and every query meets every block. A block keeps one list for each dimension,
sorted by value, and reads all lists sequentially and at the same pace, from both ends
towards the middle. What has been read of a candidate is kept in one matrix; of what has not
been read it is known only that it lies between the two places where reading stands. That
gives each candidate a lower and an upper bound of its score. Only the candidates whose upper
bound reaches the k-th best lower bound (or a smaller one that costs less to find) are kept for a
query. Reading is shared by all queries of a batch: a query is decided once no outsider can
qualify, that is, when k candidates are left; the final scores of these come from reading on, as
no vector is ever fetched by its id. Each block gives a query at most k rows, and a window of
these gives the result.

Memory does not grow with the number of queries or with how many candidates a query keeps:
bounds are made for a few queries at once, a query's candidates are listed only when they
are a small part of the block (else its bounds are made anew from the whole block, further on),
and batches are the shorter the larger the block is. Where a few queries show that most
would keep too many to be listed, reading goes on without bounds for the others.

With many dimensions of like spread, as in the test tables, bounds meet late: most of each
list is read, and plain scoring would cost less. The lists pay off where few
dimensions carry most of the scores (README).

Defined cases: vectors that are null or hold null or non-finite components take no part;
shorter vectors count as ending in zeros; equal scores go to the smaller id; a repeated
row is a candidate each time and a query once; a query without candidates gives no
row; an empty table gives an empty result; other columns are ignored. Scores that could reach
2^53 raise an error, since doubles would no longer hold them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lexshift.llm.vectors import asked_of_shards, usable, widened
from lexshift.session import ship

SCALE, K, EVERY = 256, 5, 50
#: Bytes of a block: its rows, its lists and what has been read of it.
BLOCK_BYTES = 128 << 20
#: Bytes of a component in these, if components are 16-bit integers and if they are not; and of a row besides.
NARROW, WIDE, ROW = 16, 36, 48
#: Blocks at least, so that small tables use more than one task.
BLOCKS = 6
#: Queries that share one reading of the lists, at most, and bytes of what they keep of a block.
BATCH, KEPT_BYTES = 2048, 32 << 20
#: Bytes of the bounds that are made at once.
BOUNDS_BYTES = 32 << 20
#: A query's candidates are listed if they are at most this part of the block.
LISTED = 1 / 32
#: Queries that show whether bounds serve at a stop.
PROBED = 32
#: How far lists are read from each end, round by round, as parts of their half.
STOPS = (0.25, 0.5, 0.75, 0.875, 0.9375, 1.0)
EXACT = 1 << 53
FOUND = "query_id long, vec_id long, score long"


class SortedLists:
    """One block's lists, sorted by value, and how far they have been read."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids = ids
        n, d = vectors.shape
        self.order, self.values = np.empty((d, n), np.int32), np.empty((d, n), vectors.dtype)
        for j in range(d):
            column = np.ascontiguousarray(vectors[:, j])
            self.order[j] = np.argsort(column, kind="stable")
            self.values[j] = column[self.order[j]]
        self.largest = float(max(-float(vectors.min(initial=0)), vectors.max(initial=0)))
        #: Holds every value, and halves between two values, as they are.
        self.real = np.float32 if self.largest < 1 << 23 else np.float64
        self.by_id = np.argsort(ids, kind="stable")
        self.sorted_ids = ids[self.by_id]
        self._known, self._unread = np.zeros((d, n), self.real), np.ones((d, n), self.real)
        self.depth = 0

    @property
    def known(self) -> np.ndarray:
        """What has been read of each candidate, a row for each; zero elsewhere."""
        return self._known.T

    @property
    def unread(self) -> np.ndarray:
        return self._unread.T

    def rewind(self) -> None:
        if self.depth:
            self._known.fill(0)
            self._unread.fill(1)
        self.depth = 0

    def read_to(self, depth: int) -> None:
        """Reads on to a depth from both ends of every list, in the lists' order."""
        n = len(self.ids)
        ends = [(self.depth, n - self.depth)] if 2 * depth >= n else [(self.depth, depth), (n - depth, n - self.depth)]
        for a, b in ends:
            for known, unread, order, values in zip(self._known, self._unread, self.order, self.values):
                known[order[a:b]] = values[a:b]
                unread[order[a:b]] = 0
        self.depth = depth

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Between which values of each list all lies that has not been read."""
        n, d = len(self.ids), min(self.depth, (len(self.ids) - 1) // 2)
        return self.values[:, d].astype(self.real), self.values[:, n - 1 - d].astype(self.real)

    def all_read(self) -> bool:
        return 2 * self.depth >= len(self.ids)

    def filled(self) -> np.ndarray:
        """What has been read, and the middle between the edges for what has not."""
        if self.all_read():
            return self._known
        low, high = self.edges()
        return self._unread * ((low + high) / 2)[:, None] + self._known

    def slack(self, queries: np.ndarray) -> np.ndarray:
        """What rounding may do to a bound, for each query; 0 where all has been read and sums are exact."""
        sizes = np.abs(queries).sum(1) * self.largest
        unit = np.finfo(self.real).eps
        return np.where(self.all_read() & (sizes * unit < 1), 0.0, (queries.shape[1] + 8) * unit * sizes).astype(self.real)[:, None]

    def bounds(self, queries: np.ndarray, filled: np.ndarray, unread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores of some candidates, a row for each query."""
        slack, queries = self.slack(queries), queries.astype(self.real)
        upper = queries @ filled
        if self.all_read():
            return upper - slack, upper + slack
        low, high = self.edges()
        radius = (np.abs(queries) * ((high - low) / 2)) @ unread
        radius += slack
        lower = upper - radius
        upper += radius
        return lower, upper

    def _own(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, candidate) places of equal ids."""
        a, b = np.searchsorted(self.sorted_ids, asked, "left"), np.searchsorted(self.sorted_ids, asked, "right")
        row = np.repeat(np.arange(len(asked)), b - a)
        return row, self.by_id[np.repeat(a, b - a) + np.arange(len(row)) - np.repeat(np.cumsum(b - a) - (b - a), b - a)]

    def _kept(self, asked: np.ndarray, queries: np.ndarray, filled: np.ndarray, k: int):
        """For each query the candidates that can still qualify, out of the whole block, and their upper bounds."""
        lower, upper = self.bounds(queries, filled, self._unread)
        own = self._own(asked)
        lower[own], upper[own] = -np.inf, -np.inf
        least = np.maximum(_reached(lower, k), np.finfo(self.real).min)  # own ids never qualify
        for row, bound in zip(upper, least):
            some = np.flatnonzero(row >= bound)
            yield some, row[some]

    def _best(self, some: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of some candidates and their scores, when all has been read."""
        step = BOUNDS_BYTES // (8 * max(1, len(self._known))) + 1
        parts = [query @ self._known[:, some[a : a + step]].astype(np.float64) for a in range(0, len(some), step)]
        scores = np.concatenate([np.empty(0), *parts]).astype(np.int64)
        best = np.lexsort((self.ids[some], -scores))[:k]
        return some[best], scores[best]

    def top(self, asked: np.ndarray, queries: np.ndarray, k: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """For each query the ids and scores of its k best, best first; and how many entries of each list had been
        read when it was decided."""
        n, queries = len(self.ids), queries.astype(np.float64)
        if self.largest * np.abs(queries).sum(1).max(initial=0.0) >= EXACT:
            raise ValueError("scores reach 2^53")
        self.rewind()
        left: list = [None] * len(asked)  # the candidates that can still qualify, where they are few
        decided = np.full(len(asked), -1)
        together, few = max(1, BOUNDS_BYTES // (self._known.itemsize * n)), max(k, int(n * LISTED))
        for stop in STOPS:
            self.read_to(math.ceil(stop * n / 2))
            filled = None
            for q in np.flatnonzero(decided < 0).tolist():
                if left[q] is not None:
                    lower, upper = (b[0] for b in self.bounds(queries[q : q + 1], self._filled_of(left[q]), self._unread[:, left[q]]))
                    if len(lower) > k:
                        left[q] = left[q][upper >= np.partition(lower, len(lower) - k)[len(lower) - k]]
            open_ = [q for q, some in enumerate(left) if some is None]
            at, serves = 0, True
            while at < len(open_) and serves:
                filled = self.filled() if filled is None else filled
                some = np.array(open_[at : at + (min(together, PROBED - at) if at < PROBED else together)])
                for q, (kept, upper) in zip(some.tolist(), self._kept(asked[some], queries[some], filled, k)):
                    if self.all_read() and len(kept) > k and not self.slack(queries[q : q + 1]).any():  # upper bounds are scores
                        kept = kept[np.lexsort((self.ids[kept], -upper))[:k]]
                        decided[q] = n
                    elif self.all_read():
                        kept = self._best(kept, queries[q], k)[0]
                    if len(kept) <= few:
                        left[q] = kept.astype(np.int32)
                at += len(some)
                if at == PROBED and not self.all_read():
                    serves = 2 * sum(left[q] is not None for q in open_[:at]) >= at
            for q in np.flatnonzero(decided < 0).tolist():
                if left[q] is not None and len(left[q]) <= k:
                    decided[q] = min(n, 2 * self.depth)
        decided[decided < 0] = n  # ties
        out = []
        for some, query in zip(left, queries):  # all has been read
            best, scores = self._best(some, query, k)
            out.append((self.ids[best], scores))
        return out, decided

    def _filled_of(self, some: np.ndarray) -> np.ndarray:
        if self.all_read():
            return self._known[:, some]
        low, high = self.edges()
        return self._known[:, some] + self._unread[:, some] * ((low + high) / 2)[:, None]


def _reached(lower: np.ndarray, k: int) -> np.ndarray:
    """For each row a bound that k of its values reach: the k-th best of the largest values of parts."""
    n = lower.shape[1]
    if n <= k:
        return np.full((len(lower), 1), -np.inf, lower.dtype)
    parts = min(64, n // (8 * k))
    if parts > 1:
        m = n // parts
        lower = np.concatenate([lower[:, : parts * m].reshape(len(lower), parts, m).max(1), lower[:, parts * m :]], axis=1)
    return np.partition(lower, lower.shape[1] - k, axis=1)[:, lower.shape[1] - k, None]


def _searched(k: int):
    def run(members, queries):
        lists = SortedLists(members[0], members[2])
        n, width = len(lists.ids), members[2].shape[1]
        del members
        batch = int(min(BATCH, max(1, KEPT_BYTES / (4 * LISTED * n))))
        for every, _, wide in queries:
            for at in range(0, len(every), batch):
                ids, vectors = every[at : at + batch], widened(wide[at : at + batch], width)[:, :width]
                got, _ = lists.top(ids, vectors, k)
                columns = np.repeat(ids, [len(g[0]) for g in got]), np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, every: int = EVERY, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(vec_id, embedding): query_id, rank, vec_id, score for the queries whose id every divides."""
    ship(vectors.sparkSession)
    rows = vectors.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    least, most = F.min(F.array_min("embedding")).cast("double"), F.max(F.array_max("embedding")).cast("double")
    width, n, least, most = rows.agg(F.coalesce(F.max(F.size("embedding")), F.lit(1)), F.count("*"), F.coalesce(least, F.lit(0.0)), F.coalesce(most, F.lit(0.0))).first()
    narrow = math.floor(least * SCALE) >= -(1 << 15) and math.floor(most * SCALE) < 1 << 15  # less to shuffle and to hold
    v = F.transform(F.col("embedding"), lambda x: F.floor(x.cast("double") * SCALE).cast("short" if narrow else "long"))
    rows = rows.select(F.lit(0).cast("long").alias("grp"), F.col("vec_id").cast("long").alias("id"), F.lit(1).cast("long").alias("weight"), v.alias("v"))
    queries = rows.filter(F.col("id") % every == 0).distinct()
    blocks = max(BLOCKS, -(-((NARROW if narrow else WIDE) * width + ROW) * n // block_bytes))
    found = asked_of_shards(rows, queries, blocks, _searched(k), FOUND)
    rank = F.row_number().over(W.Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
