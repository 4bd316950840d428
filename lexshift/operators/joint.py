"""Joint distributions of word pairs: marginals, divergence, recovery from new marginals, change features."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lexshift.functions.scalar import same_word
from lexshift.session import ship

FLOOR = 1e-9
#: Fixed value: the price of a pair that the old table lacks.
NEW_PRICE = 1.1
LIMIT = 300


def marginals(pairs: DataFrame, value: str = "n") -> DataFrame:
    """side ("e", "f"), word, total: both margins in one pass."""
    return pairs.groupingSets([["e"], ["f"]], "e", "f").agg(F.sum(value).alias("total"), F.grouping_id().alias("g")).select(
        F.when(F.col("g") == 1, "e").otherwise("f").alias("side"), F.when(F.col("g") == 1, F.col("e")).otherwise(F.col("f")).alias("word"), "total"
    )


def normalized(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """A value's share of its group's sum; the sums are joined, so no group is held by one task."""
    keys = by or []
    totals = rows.groupBy(*keys).agg(F.sum(value).alias("_total"))
    joined = rows.join(totals, keys) if keys else rows.crossJoin(F.broadcast(totals))  # one row
    return joined.withColumn(value, F.try_divide(F.col(value), F.col("_total"))).drop("_total")


def divergence(p: DataFrame, q: DataFrame, keys: list[str], floor: float = FLOOR) -> DataFrame:
    """sum p ln(p / q) over the pairs of q, values of at least `floor`."""
    rows = q.select(*keys, F.col("p").alias("_q")).join(p.select(*keys, F.col("p").alias("_p")), keys, "left")
    a, b = F.greatest(F.coalesce("_p", F.lit(floor)), F.lit(floor)), F.greatest(F.col("_q"), F.lit(floor))
    return rows.agg(F.sum(a * F.ln(a / b)).alias("kl"))


def solve(old: np.ndarray, known: np.ndarray, rows: np.ndarray, columns: np.ndarray, rounds: int = 2000, rho: float = 4.0, close: float = 1e-9) -> np.ndarray:
    """The matrix x in [0, 1] with these margins that minimises the sum of (x - old)^2 + |x - old| over known cells and
    x^2 + 1.1 x over others: alternating directions, a closed form for each cell and one for the margins."""
    return solve_all(old[None], known[None], rows[None], columns[None], rounds, rho, close)[0]


def solve_all(old: np.ndarray, known: np.ndarray, rows: np.ndarray, columns: np.ndarray, rounds: int = 2000, rho: float = 4.0, close: float = 1e-9) -> np.ndarray:
    """solve for many problems of one shape, the first axis telling them apart. Each ends at its own round, as if it were alone.

    Inside, problems stand on the last axis, so sums along the short ones run over many problems at a time."""
    n, m = old.shape[1:]
    out, at = np.empty(old.shape), np.arange(len(old))
    old, known, rows, columns = (np.ascontiguousarray(np.moveaxis(c, 0, -1)) for c in (old, known, rows, columns))
    z, u = rows[:, None] * columns[None], np.zeros(old.shape)
    # a cell moves to the nearest of [up, down] from its old value; the two are the same for a cell without one
    high, low = np.where(known, 2 * old - 1, -NEW_PRICE), np.where(known, 2 * old + 1, -NEW_PRICE)
    for _ in range(rounds):
        v = np.subtract(z, u)
        v *= rho
        x, down = high + v, np.add(low, v, out=v)
        x /= 2 + rho
        down /= 2 + rho
        np.minimum(np.maximum(old, x, out=x), down, out=x)
        np.minimum(np.maximum(x, 0, out=x), 1, out=x)
        w = x + u
        a = (rows - w.sum(1)) / m
        b = (columns - w.sum(0) - np.ascontiguousarray(a.T).sum(1)) / n
        last, z = z, np.add(w, a[:, None], out=w)
        z += b[None]
        apart = np.subtract(x, z)
        u += apart
        going = np.abs(apart, out=apart).max((0, 1)) >= close
        going |= np.abs(np.subtract(z, last, out=last), out=last).max((0, 1)) >= close
        if not going.all():
            out[at[~going]] = np.moveaxis(x[..., ~going], -1, 0)
            if not going.any():
                return out
            at = at[going]
            old, rows, columns, z, u, x, high, low = (c[..., going] for c in (old, rows, columns, z, u, x, high, low))
    out[at] = np.moveaxis(x, -1, 0)
    return out


#: Groups taken up at once, and matrix cells solved at once: some arrays of as many doubles, whatever the groups' number.
GROUPS, CELLS = 2048, 1 << 13


def _places(group: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each row's place among its group's words in order; the words of all groups, where a group's begin, and their numbers."""
    codes, names = pd.factorize(words, sort=True, use_na_sentinel=False)
    pairs, place = np.unique(group * len(names) + codes, return_inverse=True)
    of = pairs // len(names)
    starts = np.searchsorted(of, np.arange(group[-1] + 1))
    return place - starts[group], names[pairs % len(names)], starts, np.diff(np.append(starts, len(of)))


def _recovered(batches):
    """Rows (grp, cells) to all pairs of each group's words. Groups of one shape are solved side by side."""
    for batch in batches:
        for s in range(0, batch.num_rows, GROUPS):
            some = batch.slice(s, GROUPS)
            grp, lists = np.array(some.column("grp").to_pylist(), object), some.column("cells")
            cells, group = lists.flatten(), np.repeat(np.arange(len(grp)), lists.value_lengths().to_numpy(zero_copy_only=False))
            e, e_words, e_from, n = _places(group, np.array(cells.field("e").to_pylist(), object))
            f, f_words, f_from, m = _places(group, np.array(cells.field("f").to_pylist(), object))
            counts = [cells.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("old", "new")]
            shapes, shape = np.unique(np.stack([n, m], 1), axis=0, return_inverse=True)
            for k, (rows, columns) in enumerate(shapes.tolist()):
                alike, step = np.flatnonzero(shape.ravel() == k), max(1, CELLS // (rows * columns))
                for c in range(0, len(alike), step):
                    part = alike[c : c + step]
                    spot = np.full(len(grp), -1)
                    spot[part] = np.arange(len(part))
                    here = spot[group] >= 0
                    to = spot[group[here]], e[here], f[here]
                    old, new, known = (np.zeros((len(part), rows, columns), t) for t in (float, float, bool))
                    np.add.at(old, to, counts[0][here])
                    np.add.at(new, to, counts[1][here])
                    known[to] = True
                    old, new = (v / np.maximum(v.sum((1, 2), keepdims=True), 1) for v in (old, new))
                    x = solve_all(old, known, new.sum(2), new.sum(1))
                    i, j = np.divmod(np.arange(rows * columns), columns)
                    names = [np.repeat(grp[part], rows * columns), e_words[(e_from[part][:, None] + i).ravel()], f_words[(f_from[part][:, None] + j).ravel()]]
                    yield pa.RecordBatch.from_arrays([*[pa.array(v, pa.string(), from_pandas=True) for v in names], *[pa.array(v.ravel()) for v in (old, new, x)]], names=["grp", "e", "f", "old", "new", "x"])


def recover(pairs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(grp, line_no, e, f, old, new counts) to grp, e, f, old, new, x for all pairs of a group's words. A group is its first
    `limit` lines, as the task is defined, so a group's matrix is bounded."""
    ship(pairs.sparkSession)
    first = F.row_number().over(W.Window.partitionBy("grp").orderBy("line_no"))
    rows = pairs.withColumn("_r", first).filter(F.col("_r") <= limit)
    lists = rows.groupBy("grp").agg(F.collect_list(F.struct("e", "f", "old", "new")).alias("cells"))
    return lists.mapInArrow(_recovered, "grp string, e string, f string, old double, new double, x double")


def top_words(joint: DataFrame, k: int) -> DataFrame:
    """fr, words: the k translations of greatest joint probability, ties by name."""
    ranked = joint.withColumn("_r", F.row_number().over(W.Window.partitionBy("fr").orderBy(F.col("joint").desc(), "en"))).filter(F.col("_r") <= k)
    return ranked.groupBy("fr").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "en"))), lambda x: x["en"]).alias("words"))


def change_features(types: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """fr, pbml, max_change, top5_overlap, top2_overlap: does new have the word, has its best translation changed, which
    share of the best 5 and 2 did not; overlaps are 0 where either table lacks the word."""
    types = types.select("fr").distinct()
    sides = {}
    for name, joint in (("old", old), ("new", new)):
        tops = top_words(joint.join(types, "fr", "left_semi"), 5)
        sides[name] = tops.select("fr", F.col("words").alias(f"{name}_words"))
    rows = types.join(sides["old"], "fr", "left").join(sides["new"], "fr", "left")
    best = lambda side: F.coalesce(F.try_element_at(f"{side}_words", F.lit(1)), F.lit(""))
    shared = lambda k: F.coalesce(F.size(F.array_intersect(F.slice("old_words", 1, k), F.slice("new_words", 1, k))) / F.lit(float(k)), F.lit(0.0))
    both = F.col("old_words").isNotNull() & F.col("new_words").isNotNull()
    return rows.select(
        "fr", F.when(F.col("new_words").isNull(), 0).otherwise(1).alias("pbml"), F.when(same_word(best("old"), best("new")), 0).otherwise(1).alias("max_change"),
        F.when(both, shared(5)).otherwise(0.0).alias("top5_overlap"), F.when(both, shared(2)).otherwise(0.0).alias("top2_overlap"),
    )
