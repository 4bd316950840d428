"""Near-duplicate embeddings by hierarchical navigable small-world graphs.

Equal vectors are grouped to one row with a weight. The distinct vectors are dealt to
shards of bounded bytes; each shard builds its graph, and every vector is searched in its
own shard and in all later ones, where a link counts for both its ends: so every two vectors
meet in one search at least. A search keeps a beam of the best vectors seen and expands them until none
is left. If even the worst of a beam is a link, the beam is doubled for that query, so
no number of links is cut off. After each batch of queries, some of it is compared with
the whole shard (the audit): a uniform sample, and samples of the queries with few and with
many links, all without those that were already compared with the whole shard. While the
mean share of a query's links that was found is below AUDIT_RECALL in any of them, the beams
of the batch are doubled, up to the whole shard. Every link is verified by its cosine in
double precision.

A shard returns one count for each query with links and a spanning forest of the
links, never all pairs. Components over all shards follow in Spark. Vectors are shuffled in the
type of their column; with s shards each is sent to (s + 1) / 2 of them as a query.

Defined cases: vectors that are null, zero or hold null or non-finite components link
with nothing and are kept; vectors of different lengths don't link; equal vectors link;
repeated rows count as other vectors; null ids link like others but name no component (one
of null ids alone has a null component_id) and are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexshift.llm.graph import components
from lexshift.llm.simhash import Links
from lexshift.llm.vectors import asked_of_shards, usable
from lexshift.session import ship, staged

COSINE = 0.95
#: Bytes of a shard's vectors as 32-bit floats, and shards at least, so that small tables use more than one task.
SHARD_BYTES, SHARDS = 48 << 20, 6
M, BUILD_BEAM, BEAM, EXPAND = 16, 40, 24, 4
AUDIT, AUDIT_RECALL = 48, 0.995
BATCH, VISITED = 512, 24_000_000
RATIO = 16
FOUND = "kind int, a long, b long, n long"


def _best(sims: np.ndarray, ids: np.ndarray, n: int):
    """The n best columns of each row, best first."""
    if sims.shape[1] > n:
        keep = np.argpartition(-sims, n - 1, axis=1)[:, :n]
        sims, ids = np.take_along_axis(sims, keep, 1), np.take_along_axis(ids, keep, 1)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(sims, order, 1), np.take_along_axis(ids, order, 1)


class Graph:
    """A navigable small-world hierarchy over unit vectors (float32). Batches are inserted and searched in lockstep."""

    def __init__(self, vectors: np.ndarray, m: int = M, seed: int = 1):
        self.v, self.m = vectors, m
        n = len(vectors)
        order = np.random.default_rng(seed).permutation(n)
        self.layers = []  # from the bottom: (members in order of insertion, links by member)
        while True:
            self.layers.append((order, np.full((n, m * 2 if not self.layers else m), -1, np.int32)))
            if len(order) <= 4 * RATIO:
                break
            order = order[: len(order) // RATIO]
        for layer in range(len(self.layers) - 1, -1, -1):
            self._fill(layer)

    def _fill(self, layer: int) -> None:
        members, links = self.layers[layer]
        done = min(len(members), 4 * RATIO)
        self._join(links, members[:done], None, None)
        while done < len(members):
            new = members[done : done + min(done, 1024)]
            sims, ids = self._walk(layer, self.v[new], self._descend(self.v[new], layer, members[0]), BUILD_BEAM)
            self._join(links, new, sims, ids)
            done += len(new)

    def _join(self, links, new, sims, ids) -> None:
        """Links new members to their best and diverse neighbours among those found and each other."""
        near = self.v[new] @ self.v[new].T
        np.fill_diagonal(near, -np.inf)
        both = _best(near, np.broadcast_to(new, near.shape), min(len(new), self.m))
        if sims is not None:
            both = _best(np.concatenate([sims, both[0]], 1), np.concatenate([ids, both[1]], 1), BUILD_BEAM + self.m)
        own = self._diverse(new, *both, self.m)
        links[new, : own.shape[1]] = own
        source = np.repeat(new, own.shape[1])
        target = own.ravel()
        source, target = source[target >= 0], target[target >= 0]
        self._link_back(links, target, source)

    def _link_back(self, links, at, new) -> None:
        """The new members become neighbours of those they chose, as far as these still find them near or diverse."""
        order = np.argsort(at, kind="stable")
        at, new = at[order], new[order]
        nodes, first, counts = np.unique(at, return_index=True, return_counts=True)
        width = links.shape[1]
        by_count = np.argsort(counts, kind="stable")
        cuts = np.searchsorted(counts[by_count], [5, 17, 65, 257])
        for some in np.split(by_count, cuts):  # nodes with like numbers of new neighbours together
            for some in np.array_split(some, max(1, len(some) // 1024)):
                if not len(some):
                    continue
                column = np.arange(int(counts[some].max()))[None, :]
                added = np.where(column < counts[some][:, None], new[np.minimum(first[some][:, None] + column, len(new) - 1)], -1)
                ids = np.concatenate([links[nodes[some]], added.astype(np.int32)], 1)
                sims = np.einsum("bmd,bd->bm", self.v[np.maximum(ids, 0)], self.v[nodes[some]])
                sims[ids < 0] = -np.inf
                sims, ids = _best(sims, np.where(ids < 0, -1, ids), width + 16)
                full = (ids >= 0).sum(1) > width
                kept = np.where(np.isfinite(sims), ids, -1)[:, :width]
                kept = np.pad(kept, ((0, 0), (0, width - kept.shape[1])), constant_values=-1)
                if full.any():
                    kept[full] = self._diverse(nodes[some[full]], sims[full], ids[full], width)
                links[nodes[some]] = kept

    def _diverse(self, nodes, sims, ids, most: int) -> np.ndarray:
        """Of neighbours, best first, those nearer to the node than to any chosen before; then the best of the others."""
        n, c = ids.shape
        v = self.v[np.maximum(ids, 0)]
        between = np.matmul(v, v.transpose(0, 2, 1))
        fine = np.isfinite(sims) & (ids >= 0) & (ids != nodes[:, None])
        chosen = np.zeros((n, c), bool)
        for j in range(c):
            rival = np.where(chosen[:, :j], between[:, j, :j], -np.inf).max(axis=1, initial=-np.inf)
            chosen[:, j] = fine[:, j] & (sims[:, j] > rival)
        rank = np.where(fine, np.where(chosen, 0, 1) * c + np.arange(c)[None, :], 4 * c)
        take = np.argsort(rank, axis=1, kind="stable")[:, :most]
        return np.where(np.take_along_axis(fine, take, 1), np.take_along_axis(ids, take, 1), -1).astype(np.int32)

    def _descend(self, queries, layer: int, start) -> np.ndarray:
        """For each query a member of the layer to start from."""
        at = np.full(len(queries), self.layers[-1][0][0])
        for above in range(len(self.layers) - 1, layer, -1):
            at = self._walk(above, queries, at, 4)[1][:, 0]
        return at

    def _walk(self, layer: int, queries, start, beam: int):
        """The best `beam` members found for each query from its start: sims and ids, best first (-inf and -1: none)."""
        parts = []
        step = max(1, min(BATCH, VISITED // max(1, len(self.v))))
        for a in range(0, len(queries), step):
            parts.append(self._walk_some(self.layers[layer][1], queries[a : a + step], start[a : a + step], beam))
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _walk_some(self, links, q, start, beam):
        n = len(q)
        sims = np.full((n, beam), -np.inf, np.float32)
        ids = np.full((n, beam), -1, np.int32)
        spent = np.zeros((n, beam), bool)
        seen = np.zeros((n, len(self.v)), bool)
        ids[:, 0], sims[:, 0] = start, np.einsum("bd,bd->b", self.v[start], q)
        seen[np.arange(n), start] = True
        busy = np.arange(n)
        expand = min(EXPAND, beam)
        while len(busy):
            open_ = np.where(spent[busy] | (ids[busy] < 0), -np.inf, sims[busy])
            pick = np.argpartition(-open_, expand - 1, axis=1)[:, :expand] if beam > expand else np.broadcast_to(np.arange(beam), (len(busy), beam))
            live = np.isfinite(np.take_along_axis(open_, pick, 1))
            on = live.any(1)
            busy, pick, live = busy[on], pick[on], live[on]
            if not len(busy):
                break
            spent[busy[:, None], pick] |= live
            near = np.where(live[:, :, None], links[np.maximum(ids[busy[:, None], pick], 0)], -1).reshape(len(busy), -1)
            rows, cols = np.nonzero(near >= 0)
            new = near[rows, cols]
            key = busy[rows].astype(np.int64) * len(self.v) + new
            key, once = np.unique(key, return_index=True)
            once = once[~seen.ravel()[key]]
            rows, cols, new = rows[once], cols[once], new[once]
            seen[busy[rows], new] = True
            got = np.full(near.shape, -np.inf, np.float32)
            got[rows, cols] = np.einsum("bd,bd->b", self.v[new], q[busy[rows]])
            alls = np.concatenate([sims[busy], got], 1)
            alli = np.concatenate([ids[busy], np.where(np.isfinite(got), near, -1)], 1)
            allp = np.concatenate([spent[busy], np.zeros(near.shape, bool)], 1)
            keep = np.argpartition(-alls, beam - 1, axis=1)[:, :beam]
            sims[busy], ids[busy], spent[busy] = np.take_along_axis(alls, keep, 1), np.take_along_axis(alli, keep, 1), np.take_along_axis(allp, keep, 1)
        return _best(sims, ids, beam)

    def search(self, queries: np.ndarray, beam: int):
        return self._walk(0, queries, self._descend(queries, 0, None), min(beam, len(self.v)))


def _recall(graph: Graph, queries, near: float, found, own, sample) -> float:
    """The mean share of found links over the sampled queries with links; a query's own row doesn't count."""
    if not len(sample):
        return 1.0
    truth = (queries[sample] @ graph.v.T >= near).sum(1)
    mine = own[sample] >= 0
    truth[mine] -= np.einsum("bd,bd->b", queries[sample[mine]], graph.v[own[sample[mine]]]) >= near
    linked = truth > 0
    return float(np.minimum(found[sample[linked]] / truth[linked], 1.0).mean()) if linked.any() else 1.0


def links_of(graph: Graph, queries: np.ndarray, near: float, audit_seed: int, own: np.ndarray | None = None):
    """(query indices, member indices) of all pairs above near that searching finds; beams are widened as told above.
    own: for each query the member that it is itself, or -1."""
    n, beam = len(graph.v), BEAM
    own = np.full(len(queries), -1) if own is None else own
    while True:
        if beam > BEAM and beam * 4 >= n:  # as wide as the shard
            pairs = [np.nonzero(queries[a : a + 256] @ graph.v.T >= near) for a in range(0, len(queries), 256)]
            return np.concatenate([p[0] + a for a, p in zip(range(0, len(queries), 256), pairs)]), np.concatenate([p[1] for p in pairs])
        found, todo, width = [], np.arange(len(queries)), beam
        while len(todo):
            if width > BEAM and width * 4 >= n:
                for a in range(0, len(todo), 256):
                    i, j = np.nonzero(queries[todo[a : a + 256]] @ graph.v.T >= near)
                    found.append((todo[a : a + 256][i], j))
                break
            sims, ids = graph.search(queries[todo], width)
            full = sims[:, -1] >= near
            i, j = np.nonzero((sims >= near) & ~full[:, None])
            found.append((todo[i], ids[i, j]))
            todo, width = todo[full], width * 2
        q, p = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]).astype(np.int64)
        rng = np.random.default_rng(audit_seed)
        counts = np.bincount(q[p != own[q]], minlength=len(queries))
        rest = np.setdiff1d(np.arange(len(queries)), todo)  # todo: compared with the whole shard
        linked = rest[counts[rest] > 0]
        many = counts[linked] > np.median(counts[linked]) if len(linked) else np.zeros(0, bool)
        samples = [rng.choice(c, min(AUDIT, len(c)), replace=False) for c in (rest, linked[~many], linked[many])]
        if all(_recall(graph, queries, near, counts, own, c) >= AUDIT_RECALL for c in samples):
            return q, p
        beam *= 2


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1, in double precision; scaled first, so that no square leaves its range."""
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1)[:, None]


def _searched(cosine: float):
    def run(members, queries):
        ids, weights, vectors = members
        unit = _unit(vectors)
        graph, links = Graph(unit.astype(np.float32)), Links(len(ids))
        asked_by = np.zeros(len(ids), np.int64)  # links to vectors of other shards
        by_id = np.argsort(ids, kind="stable")

        def batch(kind, a, b, n):
            columns = [pa.array(np.full(len(a), kind, np.int32)), *(pa.array(np.asarray(c), pa.int64()) for c in (a, b, n))]
            return pa.RecordBatch.from_arrays(columns, names=["kind", "a", "b", "n"])

        for k, (asked, asking, vectors) in enumerate(queries):
            vectors = _unit(vectors)
            at = by_id[np.minimum(np.searchsorted(ids, asked, sorter=by_id), len(ids) - 1)]
            own = np.where(ids[at] == asked, at, -1)
            q, p = links_of(graph, vectors.astype(np.float32), cosine - 1e-4, k, own)
            sure = np.concatenate([np.einsum("bd,bd->b", vectors[q[a : a + 65536]], unit[p[a : a + 65536]]) for a in range(0, max(1, len(q)), 65536)]) >= cosine
            sure &= asked[q] != ids[p]
            q, p = q[sure], p[sure]
            foreign = own[q] < 0
            np.add.at(asked_by, p[foreign], asking[q[foreign]])
            if len(q):
                order = np.argsort(q, kind="stable")
                q, p = q[order], p[order]
                first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
                links.add(np.repeat(p[first], np.diff([*first, len(q)])), p)
                yield batch(0, asked[q[first]], ids[p[first]], np.add.reduceat(weights[p], first))
        linked = np.flatnonzero(asked_by)
        yield batch(0, ids[linked], ids[linked], asked_by[linked])
        roots = links.roots()
        moved = np.flatnonzero(roots != np.arange(len(ids)))
        yield batch(1, ids[moved], ids[roots[moved]], np.zeros(len(moved)))

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, shard_bytes: int = SHARD_BYTES, least_shards: int = SHARDS) -> DataFrame:
    """(vec_id, embedding) to vec_id, n_links, component_id, kept."""
    ship(vectors.sparkSession)
    fine = usable(F.col("embedding")) & F.exists("embedding", lambda x: x != 0)
    number = vectors.schema["embedding"].dataType.elementType.simpleString()
    number = number if number in ("float", "double") else "double"
    v = F.transform("embedding", lambda x: x.cast(number) + F.lit(0).cast(number))  # -0.0 becomes 0.0
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(fine, v).alias("v"))
    distinct = rows.filter(F.col("v").isNotNull()).groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"))
    distinct = staged(distinct.select(F.size("v").cast("long").alias("grp"), "id", "weight", "v"), "distinct-vectors")
    n, top, width = distinct.agg(F.count("*"), F.max("id"), F.max("grp")).first()
    top = -1 if top is None else top
    # Vectors of null ids only stand under ids beyond all others, so they are the least of a component only if alone in it.
    named = F.coalesce("id", F.lit(top).cast("long") + 1 + F.monotonically_increasing_id())
    distinct = staged(distinct.withColumn("id", named), "named-vectors")
    shards = max(least_shards, -(-4 * n * (width or 1) // shard_bytes))
    found = staged(asked_of_shards(distinct, None, shards, _searched(cosine), FOUND), "vector-links")
    roots = staged(components(found.select(F.col("a").alias("u"), F.col("b").alias("v"))), "vector-roots")
    counts = found.filter("kind = 0").groupBy("a").agg(F.sum("n").alias("n"))
    classes = (
        distinct.join(counts, distinct["id"] == counts["a"], "left")
        .join(roots, distinct["id"] == roots["node"], "left")
        .select("v", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("root", "id").alias("root"))
        .withColumn("root", F.when(F.col("root") <= top, F.col("root")))
    )
    classes = staged(classes, "vector-classes")
    alone = rows.filter(F.col("v").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    linked = rows.filter(F.col("v").isNotNull()).join(classes, "v").select("vec_id", F.col("links").alias("n_links"), F.col("root").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
