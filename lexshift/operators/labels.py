"""Seen translations and the labels they give to tokens.

A seen table has rows (fr, en, p). Tokens have fr and en. Label +1: the phrase was seen, this
translation of it never; -1: it was; tokens of unseen phrases have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def seen_from_counts(tokens: DataFrame) -> DataFrame:
    """p(en | fr) of the tokens."""
    counts = tokens.groupBy("fr", "en").agg(F.count("*").alias("n"))
    return counts.select("fr", "en", "n", (F.col("n") / F.sum("n").over(W.Window.partitionBy("fr"))).alias("p"))


def seen_from_phrases(phrases: DataFrame, types: DataFrame) -> DataFrame:
    """Sums the third score (p(en | fr)) of a phrase table's pairs, for the source phrases in types(fr)."""
    return phrases.join(types.select("fr").distinct(), "fr", "left_semi").groupBy("fr", "en").agg(F.sum(F.element_at("scores", 3)).alias("p"))


def last_wins(rows: DataFrame, keys: list[str], line: str = "line_no") -> DataFrame:
    """Of rows with equal keys the last line."""
    rest = [c for c in rows.columns if c not in keys]
    others = [c for c, t in rows.dtypes if c not in (*keys, line) and t in ("int", "bigint", "double")]
    if len(others) == 1 and set(rest) == {others[0], line}:  # hashed, where a struct would be sorted by its key
        return rows.groupBy(*keys).agg(F.max(line).alias(line), F.max_by(others[0], line).alias(others[0])).select(*keys, *rest)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), line).alias("_row")).select(*keys, *[f"_row.{c}" for c in rest])


def prune(seen: DataFrame, max_count: int = 20, max_sum: float = 0.95, min_rel: float = 0.01) -> DataFrame:
    """Of each phrase's translations, best first (ties by en): the first, and the following as long as fewer than
    max_count are kept, these sum to less than max_sum, and the next has min_rel of the first's share or more."""
    order = W.Window.partitionBy("fr").orderBy(F.col("p").desc(), "en")
    shares = seen.withColumn("p", F.col("p") / F.sum("p").over(W.Window.partitionBy("fr")))
    ranked = shares.withColumns({
        "rank": F.row_number().over(order),
        "before": F.coalesce(F.sum("p").over(order.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0.0)),
        "top": F.max("p").over(W.Window.partitionBy("fr")),
    })
    stays = (F.col("rank") <= max_count) & (F.round("before", 9) < max_sum) & (F.round(F.col("p") / F.col("top"), 9) >= min_rel)
    return ranked.filter((F.col("rank") == 1) | stays).select("fr", "en", "p")


def mfs(seen: DataFrame) -> DataFrame:
    """The most frequent translations of each phrase, all of them where they tie."""
    best = seen.withColumn("top", F.max("p").over(W.Window.partitionBy("fr")))
    return best.filter("p >= top").select("fr", "en", "p")


def label_new_sense(tokens: DataFrame, seen: DataFrame) -> DataFrame:
    """Tokens of seen phrases with label: +1 for a translation that was never seen. Seen pairs are
    cut to a phrase's own before the join, so a token is matched once."""
    pairs = seen.select("fr", "en").distinct().withColumn("known", F.lit(1))
    phrases = seen.select("fr").distinct()
    return tokens.join(phrases, "fr", "left_semi").join(pairs, ["fr", "en"], "left").withColumn("label", F.when(F.col("known").isNull(), 1).otherwise(-1)).drop("known")


def label_mfs(tokens: DataFrame, seen: DataFrame) -> DataFrame:
    """+1: the translation is not a most frequent one."""
    return label_new_sense(tokens, mfs(seen))


def unseen_phrases(tokens: DataFrame, seen: DataFrame) -> DataFrame:
    """fr, n of the phrases that the seen table lacks."""
    return tokens.join(seen.select("fr").distinct(), "fr", "left_anti").groupBy("fr").agg(F.count("*").alias("n"))
