"""Empirical distribution functions, low-rank projections and pairwise copulas of document vectors."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexshift.functions.running import descending_totals
from lexshift.session import ship, staged

FAMILIES = ("gaussian", "clayton", "gumbel")
#: Rows are counted in groups: one for each GROUP_ROWS rows by square root, MOST_BUCKETS at most (then groups grow).
GROUP_ROWS, MOST_BUCKETS = 1000, 1024


def long_form(vectors: DataFrame, vector: str, key: str) -> DataFrame:
    return vectors.select(key, F.posexplode(vector).alias("dim", "value"))


def ecdf(rows: DataFrame, by: str = "dim", value: str = "value") -> DataFrame:
    """Adds cdf, the share of its column's values that are at most its own. Distinct values are counted and summed
    in buckets, so no column has to stand in one task."""
    counts = rows.groupBy(by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("n"))
    totals = counts.groupBy(by).agg(F.sum("n").alias("_all"))
    above = descending_totals(counts, [by], "_v", ["n"]).join(totals, by)
    cdf = above.select(by, "_v", ((F.col("_all") - F.col("n_before")) / F.col("_all")).alias("cdf"))
    return rows.withColumn("_v", F.col(value).cast("double")).join(cdf, [by, "_v"]).drop("_v")


def projected(vectors: DataFrame, vector: str, key: str, rank: int = 10) -> DataFrame:
    """key, factors: each row times the leading right singular vectors. Signs are set so that each vector's entry of
    greatest size is positive. The Gram matrix (dimensions squared) is summed in Spark and solved on the driver."""
    d = vectors.select(F.max(F.size(vector)).alias("d")).first()["d"] or 0
    x = [F.coalesce(F.try_element_at(F.col(vector), F.lit(i + 1)).cast("double"), F.lit(0.0)) for i in range(d)]
    flat = vectors.select(key, *[c.alias(f"x_{i}") for i, c in enumerate(x)])
    sums = flat.agg(*[F.sum(F.col(f"x_{i}") * F.col(f"x_{j}")).alias(f"g_{i}_{j}") for i in range(d) for j in range(i + 1)]).first()
    gram = np.zeros((d, d))
    for i in range(d):
        for j in range(i + 1):
            gram[i, j] = gram[j, i] = sums[f"g_{i}_{j}"] or 0.0
    values, right = np.linalg.eigh(gram)
    right = right[:, np.argsort(-values)[:rank]]
    right = right * np.sign(right[np.abs(right).argmax(0), np.arange(right.shape[1])])
    factors = [sum((F.col(f"x_{i}") * float(right[i, r]) for i in range(d)), F.lit(0.0)) for r in range(right.shape[1])]
    return flat.select(key, F.array(*factors).alias("factors"))


def _inversions(values: np.ndarray) -> int:
    """Pairs i < j with values[i] > values[j], counted bit by bit: rows stay stably grouped by their higher bits,
    and a pair is told by the first bit in which it differs."""
    ranks = np.unique(values, return_inverse=True)[1].astype(np.int64)
    total = 0
    for bit in range(int(ranks.max(initial=0)).bit_length() - 1, -1, -1):
        high, one = ranks >> (bit + 1), (ranks >> bit) & 1
        ones = np.cumsum(one)
        first = np.r_[True, high[1:] != high[:-1]]
        base = np.maximum.accumulate(np.where(first, np.arange(len(ranks)), 0))
        before = ones - (ones - one)[base]
        total += int(before[one == 0].sum())
        ranks = ranks[np.argsort(ranks >> bit, kind="stable")]
    return total


def concordance(u: np.ndarray, v: np.ndarray) -> int:
    """Concordant less discordant pairs; ties in either are neither."""
    apart = lambda w: _inversions(w[np.lexsort((w, u))])
    return apart(-v) - apart(v)


def _within(side: str):
    def run(frame):
        u, v = frame["u"].to_numpy(), frame["v"].to_numpy()
        total = concordance(u, v)
        if side == "ub":  # pairs of one cell are counted with the other side
            cells = frame["vb"].to_numpy()
            total -= sum(concordance(u[at], v[at]) for at in np.split(np.argsort(cells, kind="stable"), np.flatnonzero(np.diff(np.sort(cells))) + 1))
        return pd.DataFrame({"left": frame["left"].iloc[:1].to_numpy(), "s": [float(total)]})

    return run


def _across(frame):
    i, j = np.unique(frame["ub"], return_inverse=True)[1], np.unique(frame["vb"], return_inverse=True)[1]
    n = np.zeros((i.max() + 2, j.max() + 2))
    n[i + 1, j + 1] = frame["n"]
    below = n.cumsum(0).cumsum(1)
    row = below[:, -1]
    less = below[i, j]
    # Cells before in the first order and after in the second are discordant.
    after = row[i] - below[i, j + 1]
    return pd.DataFrame({"left": frame["left"].iloc[:1].to_numpy(), "s": [float((frame["n"].to_numpy() * (less - after)).sum())]})


def _buckets_of(n: int) -> int:
    """Groups grow with the square root of the rows, as a table of groups by groups is summed too."""
    return max(1, min(MOST_BUCKETS, math.isqrt(n // GROUP_ROWS)))


def neighbours(vectors: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """left, u, v, ub, vb: every row's empirical distribution values of column left and the next one, and the groups that they
    fall into; and the number of rows. A value that more rows share than a group should have is a group of its own."""
    d = vectors.select(F.max(F.size(vector)).alias("d")).first()["d"] or 0
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    whole = vectors.filter((F.size(vector) == d) & ~bad).select(F.monotonically_increasing_id().alias("_row"), F.col(vector).alias("_vector"))
    rows = staged(long_form(whole, "_vector", "_row"), "vine")
    n = rows.filter("dim = 0").count()
    groups = _buckets_of(n)
    cdf = staged(ecdf(rows).select("_row", "dim", "cdf"), "vine-cdf")
    heavy = cdf.groupBy("dim", "cdf").agg(F.count("*").alias("n")).filter(F.col("n") > n / groups).select("dim", "cdf", F.lit(1).alias("heavy"))
    spot = (2 * F.floor(F.col("cdf") * groups * (1 - 1e-12)) + F.when(F.col("heavy").isNull(), 1).otherwise(0)).cast("int")
    placed = cdf.join(heavy, ["dim", "cdf"], "left").select("_row", "dim", "cdf", spot.alias("b"))
    lists = placed.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("dim", "cdf", "b"))).alias("c"))
    pairs = lists.select(F.explode(F.arrays_zip(F.slice("c", 1, max(d - 1, 0)).alias("x"), F.slice("c", 2, max(d - 1, 0)).alias("y"))).alias("p"))
    pairs = pairs.select(F.col("p.x.dim").alias("left"), F.col("p.x.cdf").alias("u"), F.col("p.y.cdf").alias("v"), F.col("p.x.b").alias("ub"), F.col("p.y.b").alias("vb"))
    return staged(pairs, "vine-pairs"), n


def kendall(pairs: DataFrame, n: int) -> DataFrame:
    """left, tau over all rows, exactly: pairs of rows in one group of either column are counted within that group, all others
    from the numbers of rows in each two groups."""
    out = None
    parts = [pairs.filter(F.col(b) % 2 == 1).groupBy("left", b).applyInPandas(_within(b), "left int, s double") for b in ("ub", "vb")]
    cells = pairs.groupBy("left", "ub", "vb").agg(F.count("*").alias("n"))
    for part in (*parts, cells.groupBy("left").applyInPandas(_across, "left int, s double")):
        out = part if out is None else out.unionByName(part)
    return out.groupBy("left").agg((2 * F.sum("s") / (float(n) * (n - 1))).alias("tau"))


def parameter_of(family: str, tau: float) -> float:
    """The parameter that tau implies."""
    if family == "gaussian":
        return float(np.clip(math.sin(math.pi * tau / 2), -0.999, 0.999))
    tau = min(tau, 0.95)  # beyond it the densities overflow
    return max(2 * tau / (1 - tau), 1e-6) if family == "clayton" else max(1 / (1 - tau), 1.0)


def log_density(family: str, t: float, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    if family == "gaussian":
        a, b = (np.array([NormalDist().inv_cdf(p) for p in w.tolist()]) for w in (u, v))
        return -0.5 * math.log(1 - t**2) - (t**2 * (a**2 + b**2) - 2 * t * a * b) / (2 * (1 - t**2))
    if family == "clayton":
        return math.log(1 + t) - (1 + t) * (np.log(u) + np.log(v)) - (2 + 1 / t) * np.log(np.maximum(u**-t + v**-t - 1, 1e-12))
    a, b = -np.log(u), -np.log(v)  # gumbel
    s = a**t + b**t
    c = s ** (1 / t)
    return -c + (t - 1) * (np.log(a) + np.log(b)) - np.log(u) - np.log(v) + (2 / t - 2) * np.log(s) + np.log1p((t - 1) / c)


def _likelihoods(parameters: dict[int, dict[str, float]], n: int):
    def run(batches):
        for batch in batches:
            left, u, v = (batch.column(c).to_numpy() for c in ("left", "u", "v"))
            out = []
            for i in np.unique(left).tolist():
                at = left == i
                for family, t in parameters[i].items():
                    out.append((i, family, float(log_density(family, t, u[at] * n / (n + 1), v[at] * n / (n + 1)).sum())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.string(), pa.float64()))], names=["left", "family", "ll"])

    return run


def vine_pairs(vectors: DataFrame, vector: str) -> DataFrame:
    """The first tree of a D-vine: for all neighbouring columns left, right, tau, family, parameter, aic of the best of three
    families, fitted on all rows. Vectors that are null, shorter than the longest, or hold a null or non-finite component are
    left out. Only one row for each two columns and family comes to the driver."""
    spark = vectors.sparkSession
    schema = "left int, right int, tau double, family string, parameter double, aic double"
    ship(spark)
    pairs, n = neighbours(vectors, vector)
    taus = {r["left"]: r["tau"] for r in kendall(pairs, n).collect()} if n > 1 else {}
    parameters = {i: {f: parameter_of(f, tau) for f in (FAMILIES if tau > 0 else FAMILIES[:1])} for i, tau in taus.items()}
    if not parameters:
        return spark.createDataFrame([], schema)
    sums = pairs.select("left", "u", "v").mapInArrow(_likelihoods(parameters, n), "left int, family string, ll double").groupBy("left", "family").agg(F.sum("ll").alias("ll"))
    best: dict[int, tuple[float, str]] = {}
    for r in sums.collect():
        best[r["left"]] = min(best.get(r["left"], (math.inf, "")), (2 - 2 * r["ll"], r["family"]))
    return spark.createDataFrame([(i, i + 1, taus[i], family, parameters[i][family], aic) for i, (aic, family) in sorted(best.items())], schema)
