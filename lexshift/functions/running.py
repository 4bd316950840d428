"""Running totals over a global order without putting all rows into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

BUCKETS = 64


def descending_totals(rows: DataFrame, by: list[str], order: str, values: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Adds <value>_before, the sum over the rows of `by` with a greater `order`, and _bucket.

    The order is cut into buckets of about equal numbers of rows, at approximate quantiles, so outliers
    do not put all others into one; sums of whole buckets (a few rows for each `by`) are carried over, and
    only rows of one bucket stand in one window. Buckets follow the order, so later steps can use them in
    the same way.
    """
    shares = F.array(*[F.lit(k / buckets) for k in range(1, buckets)])
    cuts = rows.groupBy(*by).agg(F.array_distinct(F.percentile_approx(order, shares, F.lit(20 * buckets))).alias("_cuts"))
    above = F.size(F.filter("_cuts", lambda c: c > F.col(order)))
    cells = rows.join(cuts, by).withColumn("_bucket", above).drop("_cuts")
    earlier = W.Window.partitionBy(*by).orderBy("_bucket").rowsBetween(W.Window.unboundedPreceding, -1)
    sums = cells.groupBy(*by, "_bucket").agg(*[F.sum(v).alias(f"_sum_{v}") for v in values])
    bases = sums.select(*by, "_bucket", *[F.coalesce(F.sum(f"_sum_{v}").over(earlier), F.lit(0)).alias(f"_base_{v}") for v in values])
    inside = W.Window.partitionBy(*by, "_bucket").orderBy(F.col(order).desc()).rowsBetween(W.Window.unboundedPreceding, -1)
    joined = cells.join(bases, [*by, "_bucket"])
    return joined.withColumns({f"{v}_before": F.col(f"_base_{v}") + F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values}).drop(*[f"_base_{v}" for v in values])
