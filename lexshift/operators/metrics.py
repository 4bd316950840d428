"""Scores of predictions: ROC and PR areas, precision, recall and F, bootstrap, summaries.

Areas follow one definition throughout: of all points with one abscissa only the highest
counts, and consecutive ones are joined by straight lines. That is not the usual rank
statistic (see rank_auroc for that): scores 4, 3, 2, 1 with labels +, -, +, - give 0.875.

Predictions are rows with a score, a label (positive: above 0) and any number of columns to
group by. Rows with a null score or label are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lexshift.functions.running import descending_totals
from lexshift.functions.scalar import guessed_threshold

#: Fixed value: a prediction is positive above it.
PRF_THRESHOLD = 0.0001
#: Cumulative Poisson(1) probabilities: the chance of at most 0, 1, ... draws of a row.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)


def steps(rows: DataFrame, score: str, label: str, by: list[str], weight: str | None = None) -> DataFrame:
    """One row for each distinct score: pos, neg, pos_before, neg_before (of greater scores)."""
    w = F.col(weight) if weight else F.lit(1).cast("long")
    rows = rows.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    at = rows.groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.sum(F.when(F.col(label) > 0, w).otherwise(0)).alias("pos"), F.sum(F.when(F.col(label) > 0, 0).otherwise(w)).alias("neg")
    )
    return descending_totals(at, by, "score", ["pos", "neg"])


def _keyed(rows: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    return (rows, by) if by else (rows.withColumn("_all", F.lit(0)), ["_all"])


def auroc(rows: DataFrame, score: str = "score", label: str = "label", by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """by, n_pos, n_neg, numerator, auroc = numerator / (2 n_pos n_neg); null without both classes.

    Each score with negatives moves the curve to the right, from the positives above it to
    those above the next score with negatives."""
    rows, keys = _keyed(rows, list(by or []))
    at = steps(rows, score, label, keys, weight)
    totals = at.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    falls = at.filter("neg > 0")
    heads = falls.groupBy(*keys, "_bucket").agg(F.min("pos_before").alias("head"))
    later = W.Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(1, W.Window.unboundedFollowing)
    heads = heads.select(*keys, "_bucket", F.min("head").over(later).alias("next_head"))
    inside = W.Window.partitionBy(*keys, "_bucket").orderBy(F.col("score").desc())
    falls = falls.withColumn("next", F.lead("pos_before").over(inside)).join(heads, [*keys, "_bucket"]).join(totals, keys)
    area = F.sum(F.col("neg") * (F.col("pos_before") + F.coalesce("next", "next_head", "n_pos"))).cast("long").alias("numerator")
    out = totals.join(falls.groupBy(*keys).agg(area), keys, "left")
    return out.select(*(by or []), "n_pos", "n_neg", "numerator", F.try_divide(F.col("numerator"), 2 * F.col("n_pos") * F.col("n_neg")).alias("auroc"))


def aupr(rows: DataFrame, score: str = "score", label: str = "label", by: list[str] | None = None) -> DataFrame:
    """by, aupr: the best precision at each recall; the curve starts at recall 0 with precision 1."""
    rows, keys = _keyed(rows, list(by or []))
    at = steps(rows, score, label, keys)
    totals = at.groupBy(*keys).agg(F.sum("pos").alias("n_pos"))
    hits = at.filter("pos > 0").withColumn("precision", (F.col("pos_before") + F.col("pos")) / (F.col("pos_before") + F.col("pos") + F.col("neg_before") + F.col("neg")))
    tails = hits.groupBy(*keys, "_bucket").agg(F.min_by("precision", "score").alias("tail"))
    earlier = W.Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.Window.unboundedPreceding, -1)
    tails = tails.select(*keys, "_bucket", F.last("tail", ignorenulls=True).over(earlier).alias("last_tail"))
    inside = W.Window.partitionBy(*keys, "_bucket").orderBy(F.col("score").desc())
    first = F.when((F.col("pos_before") == 0) & (F.col("neg_before") == 0), 1.0).otherwise(0.0)
    hits = hits.withColumn("last", F.lag("precision").over(inside)).join(tails, [*keys, "_bucket"]).join(totals, keys)
    area = F.sum(F.col("pos") / F.col("n_pos") * (F.col("precision") + F.coalesce("last", "last_tail", first)) / 2)
    return totals.join(hits.groupBy(*keys).agg(area.alias("aupr")), keys, "left").select(*(by or []), F.coalesce("aupr", F.lit(0.0)).alias("aupr"))


def rank_auroc(rows: DataFrame, score: str = "score", label: str = "label", by: list[str] | None = None) -> DataFrame:
    """The usual area: the share of pairs in the right order, ties counting half."""
    rows, keys = _keyed(rows, list(by or []))
    at = steps(rows, score, label, keys)
    pairs = F.sum(F.col("neg") * (2 * F.col("pos_before") + F.col("pos")))
    return at.groupBy(*keys).agg(F.try_divide(pairs, 2 * F.sum("pos") * F.sum("neg")).alias("auroc")).select(*(by or []), "auroc")


def _prf(y: Column, p: Column, hit: Column) -> tuple[Column, Column, Column]:
    """Precision and recall are 1 where nothing was to be found, F of two zeros is 0."""
    precision = F.when(p <= 0, 1.0).otherwise(F.try_divide(hit, p))
    recall = F.when(y <= 0, 1.0).otherwise(F.try_divide(hit, y))
    return precision, recall, F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)


def prf_by_type(rows: DataFrame, score: str = "score", label: str = "label", grp: str = "grp", threshold: float = PRF_THRESHOLD, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """by, grp, y, p, hit, precision, recall, f: for groups with a positive label or prediction."""
    pos, said = F.col(label) > 0, F.col(score) > threshold
    count = lambda c: F.sum(F.when(c, F.col(weight) if weight else F.lit(1)).otherwise(0)).cast("long")
    counts = rows.groupBy(*(by or []), grp).agg(count(pos).alias("y"), count(said).alias("p"), count(pos & said).alias("hit")).filter("y > 0 OR p > 0")
    precision, recall, f = _prf(F.col("y"), F.col("p"), F.col("hit"))
    return counts.withColumns({"precision": precision, "recall": recall, "f": f})


def prf(rows: DataFrame, score: str = "score", label: str = "label", grp: str = "grp", threshold: float = PRF_THRESHOLD, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """One row (for each `by`): precision, recall and F of pooled counts, and their means over groups.

    In the convention of the published numbers the pooled ones are called macro and the means micro."""
    types = prf_by_type(rows, score, label, grp, threshold, by, weight)
    sums = types.groupBy(*(by or [])).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("y", "p", "hit")], *[F.avg(c).alias(f"mean_{c}") for c in ("f", "precision", "recall")])
    precision, recall, f = _prf(F.col("y"), F.col("p"), F.col("hit"))
    return sums.select(*(by or []), f.alias("pooled_f"), precision.alias("pooled_precision"), recall.alias("pooled_recall"), "mean_f", "mean_precision", "mean_recall")


#: What is reported of each fold or replicate.
FIELDS = ("auroc", "pooled_f", "pooled_precision", "pooled_recall", "mean_f", "mean_precision", "mean_recall")


def fields_by(rows: DataFrame, by: list[str], score: str = "score", label: str = "label", grp: str = "grp", weight: str | None = None) -> DataFrame:
    """by and all FIELDS of each fold or replicate."""
    areas = auroc(rows, score, label, by, weight).select(*by, "auroc")
    return areas.join(prf(rows, score, label, grp, by=by, weight=weight), by, "outer").select(*by, *FIELDS)


def conventional(prf_row: DataFrame) -> DataFrame:
    """The same row under the usual names: micro is pooled, macro the mean over groups."""
    names = {"pooled": "micro", "mean": "macro"}
    return prf_row.select(*[F.col(c).alias(f"{names[c.split('_')[0]]}_{c.split('_')[1]}") for c in prf_row.columns])


def draw_weights(rows: DataFrame, key: str, replicates: int, seed: int = 7) -> DataFrame:
    """Every row once for each replicate that draws it: replicate, weight. Draws are Poisson(1), told by
    the row's whole-number key alone, so nothing is joined and reruns agree."""
    prime = 1_000_003
    b = F.col("replicate")
    h = F.pmod(F.pmod(F.col(key).cast("long"), F.lit(prime)) * 7919 + b * 104_729 + seed, F.lit(prime))
    h = F.pmod(F.pmod(h * h, F.lit(prime)) * 31 + h * 17 + b, F.lit(prime))
    u = h / F.lit(float(prime))
    weight = sum((F.when(u >= c, 1).otherwise(0) for c in POISSON), F.lit(0)).cast("long")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicates - 1).cast("long")))
    return rows.withColumn("replicate", every).withColumn("weight", weight).filter("weight > 0")


def bootstrap_auroc(rows: DataFrame, key: str, score: str = "score", label: str = "label", replicates: int = 20, seed: int = 7) -> DataFrame:
    """The area in each replicate."""
    return auroc(draw_weights(rows, key, replicates, seed), score, label, ["replicate"], "weight")


def bootstrap_fields(rows: DataFrame, key: str, score: str = "score", label: str = "label", grp: str = "grp", replicates: int = 20, seed: int = 7) -> DataFrame:
    """Mean and deviation of all FIELDS over the replicates."""
    return mean_std(fields_by(draw_weights(rows, key, replicates, seed), ["replicate"], score, label, grp, "weight"), list(FIELDS))


def mean_std(rows: DataFrame, values: list[str], by: list[str] | None = None) -> DataFrame:
    """Mean and population standard deviation of each value."""
    return rows.groupBy(*(by or [])).agg(*[f(v).alias(f"{v}_{n}") for v in values for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def threshold_of(rows: DataFrame, label: str = "label") -> DataFrame:
    return rows.agg(guessed_threshold(F.min(label), F.max(label)).alias("threshold"))


def losses(rows: DataFrame, score: str = "score", label: str = "label", cut: float = 0.0) -> DataFrame:
    """One row: error, f_loss, squared, logistic (mean losses of signed scores)."""
    pos, said = F.col(label) > cut, F.col(score) > 0
    sign = F.when(pos, 1.0).otherwise(-1.0)
    hit = F.count_if(pos & said)
    f = F.try_divide(2.0 * hit, F.count_if(pos) + F.count_if(said))
    return rows.agg(
        F.avg(F.when(pos == said, 0.0).otherwise(1.0)).alias("error"),
        (1 - F.coalesce(f, F.lit(0.0))).alias("f_loss"),
        F.avg(F.pow(F.col(score) - sign, F.lit(2.0))).alias("squared"),
        F.avg(F.log1p(F.exp(-sign * F.col(score)))).alias("logistic"),
    )


def multiclass_error(rows: DataFrame, truth: str, said: str, by: list[str] | None = None) -> DataFrame:
    """Share of wrong labels. With `by` (the example), rows are one example's candidate labels and the one
    of least cost `said` should be the true one (truth = 1)."""
    if not by:
        return rows.agg(F.avg(F.when(F.col(truth) == F.col(said), 0.0).otherwise(1.0)).alias("error"))
    best = rows.groupBy(*by).agg(F.min_by(truth, said).alias("hit"))
    return best.agg(F.avg(F.when(F.col("hit") > 0, 0.0).otherwise(1.0)).alias("error"))


def class_balance(rows: DataFrame, label: str = "label", by: list[str] | None = None) -> DataFrame:
    """by, n, n_pos, n_neg, percent_pos (cut off after one digit)."""
    pos = F.count_if(F.col(label) > 0)
    return rows.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), pos.alias("n_pos"), F.count_if(F.col(label) <= 0).alias("n_neg"), (F.floor(pos * 1000 / F.count("*")) / 10.0).alias("percent_pos")
    )
