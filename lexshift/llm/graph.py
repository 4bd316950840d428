"""Connected components of large undirected graphs, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexshift.session import staged

#: Each round at least halves the depth of every tree, so this is beyond any real graph.
MAX_ROUNDS = 60


#: A node of more than HUB_ROWS edges, and of more than 1 / HUBS of them, is a hub; so there are at most 2 * HUBS hubs.
HUB_ROWS, HUBS = 100, 4096


def _with_least(rows: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """rows (u, v) with the m of least (u, m, n) for u. The minima of hubs, whose number is bounded, are broadcast, so that
    their rows need not meet in one task; a shuffled join is left with keys of few rows."""
    most = max(HUB_ROWS, n // HUBS)
    hubs = least.filter(F.col("n") > most).select(F.col("u").alias("hub"), F.col("m").alias("hub_m"))
    rows = rows.join(F.broadcast(hubs), F.col("u") == F.col("hub"), "left")
    few = rows.filter("hub IS NULL").select("u", "v").join(least.filter(F.col("n") <= most).select("u", "m"), "u")
    return rows.filter("hub IS NOT NULL").select("u", "v", F.col("hub_m").alias("m")).union(few.select("u", "v", "m"))


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Every larger neighbour of a node moves to the node's least neighbour (or itself)."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "least")
    return _with_least(both.filter("v > u"), least, n).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Every node and its smaller neighbours move to the least of them. u > v holds for all edges."""
    least = staged(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
    moved = _with_least(edges, least, n).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u != v")


def components(edges: DataFrame) -> DataFrame:
    """edges: (u, v) of one orderable type. Rows (node, root): every node with an edge and the least node of its component.

    Large-star and small-star alternate until nothing changes. Minima are partially
    aggregated before they are shuffled, and those of hubs are broadcast (see _with_least), so a
    hub's edges stay where they are. Each half round's edges are written to the
    shared folder. Self-loops, nulls and repeated edges are ignored.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v")
    edges = staged(edges.distinct(), "edges")
    sign = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first()
    before = sign(edges)
    for _ in range(MAX_ROUNDS if before[0] else 0):
        edges = staged(_large_star(edges, before[0]).distinct(), "edges")
        edges = staged(_small_star(edges, before[0]).distinct(), "edges")
        after = sign(edges)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError("components did not converge")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
