"""A latent-topic translation model, by sampling.

A sentence has a mixture theta over K topics; topic k draws source words from alpha_k and
their translations from beta_k,f. A sweep draws the topic of every aligned pair 100 times
from theta_k alpha_k(f) beta_k,f(e) + 1e-4, with all three fixed; all draws count, and the
distributions are drawn anew from the counts (Dirichlet with 0.01 added). So pairs are
independent within a sweep: it is three joins on words and sentences, an Arrow step that
draws, and aggregations. Every draw's generator is seeded by the row's key and the sweep, so
results don't depend on partitions. Each sweep is written to the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexshift.functions.draws import generators
from lexshift.session import ship, staged

DRAWS, PRIOR, SMOOTH = 100, 0.01, 1e-4
#: Probabilities of what the model has not seen.
UNSEEN_F, UNSEEN_E = 1e-4, 1e-3


def _cells(k: int) -> list[str]:
    return [f"n_{i}" for i in range(k)]


def pairs_of(bitext: DataFrame, sent: str = "sent") -> DataFrame:
    """doc, pos, f, e of every aligned pair."""
    rows = bitext.select(F.col(sent).cast("long").alias("doc"), "src", "tgt", F.posexplode("align").alias("pos", "p"))
    rows = rows.select("doc", "pos", F.try_element_at("src", F.col("p.s") + 1).alias("f"), F.try_element_at("tgt", F.col("p.t") + 1).alias("e"))
    return rows.filter("f IS NOT NULL AND e IS NOT NULL")


def start(pairs: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """Pairs with all draws at one random topic."""
    z = F.pmod(F.xxhash64("doc", "pos", F.lit(seed)), F.lit(k))
    return staged(pairs.select("doc", "pos", "f", "e", *[F.when(z == i, DRAWS).otherwise(0).cast("long").alias(n) for i, n in enumerate(_cells(k))]), "topics")


def _gammas(k: int):
    def run(batches):
        for batch in batches:
            seeds = batch.column("seed").to_numpy()
            n = np.stack([batch.column(c).to_numpy() for c in _cells(k)], 1) if k else np.zeros((batch.num_rows, 0))
            drawn = np.array([rng.standard_gamma(row) for rng, row in zip(generators(seeds & (2**63 - 1)), n + PRIOR)]).reshape(len(seeds), k)
            rest = [c for c in batch.schema.names if c not in (*_cells(k), "seed")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], *[pa.array(np.maximum(drawn[:, i], 1e-300)) for i in range(k)]], names=[*rest, *[f"w_{i}" for i in range(k)]])

    return run


def _dirichlet(counts: DataFrame, keys: list[str], within: list[str], k: int, seed: int, name: str) -> DataFrame:
    """Draws each topic's distribution over keys (within their group) from counts: keys, <name>_0 ..."""
    seeded = counts.withColumn("seed", F.xxhash64(*keys, F.lit(seed), F.lit(name)))
    types = dict(counts.dtypes)
    schema = ", ".join([*[f"{c} {types[c]}" for c in keys], *[f"w_{i} double" for i in range(k)]])
    drawn = seeded.select(*keys, "seed", *_cells(k)).mapInArrow(_gammas(k), schema)
    drawn = staged(drawn, f"topics-{name}")
    sums = drawn.groupBy(*within).agg(*[F.sum(f"w_{i}").alias(f"s_{i}") for i in range(k)])
    joined = drawn.join(sums, within) if within else drawn.crossJoin(F.broadcast(sums))  # one row
    return joined.select(*keys, *[(F.col(f"w_{i}") / F.col(f"s_{i}")).alias(f"{name}_{i}") for i in range(k)])


def distributions(state: DataFrame, k: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """theta (doc), alpha (f) and beta (f, e), one column for each topic."""
    sums = [F.sum(c).alias(c) for c in _cells(k)]
    by_pair = staged(state.groupBy("f", "e").agg(*sums), "topics-counts")
    alpha = _dirichlet(by_pair.groupBy("f").agg(*sums), ["f"], [], k, seed, "alpha")
    beta = _dirichlet(by_pair, ["f", "e"], ["f"], k, seed, "beta")
    docs = state.groupBy("doc").agg(*sums)
    theta = docs.withColumn("seed", F.xxhash64("doc", F.lit(seed))).mapInArrow(_gammas(k), ", ".join(["doc long", *[f"w_{i} double" for i in range(k)]]))
    whole = sum((F.col(f"w_{i}") for i in range(k)), F.lit(0.0))
    return theta.select("doc", *[(F.col(f"w_{i}") / whole).alias(f"theta_{i}") for i in range(k)]), alpha, beta


def _drawn(k: int):
    def run(batches):
        for batch in batches:
            d = np.stack([batch.column(f"d_{i}").to_numpy() for i in range(k)], 1)
            d = d / d.sum(1, keepdims=True)
            n = np.array([rng.multinomial(DRAWS, p) for rng, p in zip(generators(batch.column("seed").to_numpy() & (2**63 - 1)), d)], np.int64).reshape(-1, k)
            rest = ["doc", "pos", "f", "e"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], *[pa.array(n[:, i]) for i in range(k)]], names=[*rest, *_cells(k)])

    return run


def sweep(state: DataFrame, k: int, seed: int) -> DataFrame:
    ship(state.sparkSession)
    theta, alpha, beta = distributions(state, k, seed)
    rows = state.select("doc", "pos", "f", "e").join(beta, ["f", "e"]).join(alpha, "f").join(theta, "doc")
    density = [(F.col(f"theta_{i}") * F.col(f"alpha_{i}") * F.col(f"beta_{i}") + SMOOTH).alias(f"d_{i}") for i in range(k)]
    rows = rows.select("doc", "pos", "f", "e", F.xxhash64("doc", "pos", F.lit(seed), F.lit("z")).alias("seed"), *density)
    return staged(rows.mapInArrow(_drawn(k), ", ".join(["doc long, pos int, f string, e string", *[f"{c} long" for c in _cells(k)]])), "topics")


def topic(k: int) -> Column:
    """The topic drawn most often, the first of equals."""
    cells = F.array(*_cells(k))
    return (F.array_position(cells, F.array_max(cells)) - 1).cast("int").alias("z")


def split(state: DataFrame, k: int, seed: int) -> DataFrame:
    """Twice as many topics: half of the pairs, by a hash, move from k to k + K."""
    moves = F.pmod(F.xxhash64("doc", "pos", F.lit(seed), F.lit("split")), F.lit(2)) == 0
    low = [F.when(moves, 0).otherwise(F.col(c)).cast("long").alias(c) for c in _cells(k)]
    high = [F.when(moves, F.col(c)).otherwise(0).cast("long").alias(f"n_{k + i}") for i, c in enumerate(_cells(k))]
    return staged(state.select("doc", "pos", "f", "e", *low, *high), "topics")


def fit(bitext: DataFrame, topics: int = 4, sweeps: int = 20, splits: int = 1, seed: int = 1) -> tuple[DataFrame, int]:
    """Draws after the schedule: sweeps, then a split and sweeps again, `splits` times. Returns (state, topics)."""
    state = start(pairs_of(bitext), topics, seed)
    for r in range(splits + 1):
        if r:
            state, topics = split(state, topics, seed + 1000 * r), topics * 2
        for s in range(sweeps):
            state = sweep(state, topics, seed + 1000 * r + s + 1)
    return state, topics


def changed(before: DataFrame, after: DataFrame, k: int) -> DataFrame:
    """The share of pairs whose topic differs."""
    a, b = before.select("doc", "pos", topic(k)), after.select("doc", "pos", topic(k).alias("y"))
    return a.join(b, ["doc", "pos"]).agg(F.avg(F.when(F.col("z") == F.col("y"), 0.0).otherwise(1.0)).alias("changed"))


def likelihood(pairs: DataFrame, alpha: DataFrame, beta: DataFrame, k: int) -> DataFrame:
    """One row: mixture and best, the log probabilities of held-out pairs' translations, summed in logs."""
    rows = pairs.join(alpha, "f", "left").join(beta, ["f", "e"], "left")
    ln = lambda c, unseen: F.ln(F.greatest(F.coalesce(c, F.lit(unseen)), F.lit(1e-300)))
    sums = rows.groupBy("doc").agg(
        *[F.sum(ln(f"alpha_{i}", UNSEEN_F)).alias(f"a_{i}") for i in range(k)], *[F.sum(ln(f"beta_{i}", UNSEEN_E)).alias(f"b_{i}") for i in range(k)]
    )
    logsum = lambda xs: F.greatest(*xs, xs[0]) + F.ln(sum((F.exp(x - F.greatest(*xs, xs[0])) for x in xs), F.lit(0.0)))
    a, ab = [F.col(f"a_{i}") for i in range(k)], [F.col(f"a_{i}") + F.col(f"b_{i}") for i in range(k)]
    return sums.select((logsum(ab) - logsum(a)).alias("m"), (F.greatest(*ab, ab[0]) - logsum(a)).alias("x")).agg(F.sum("m").alias("mixture"), F.sum("x").alias("best"))
