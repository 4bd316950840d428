"""Phrase tables: probabilities, and how well a pair is explained by shorter ones.

A table has fr, en, scores (array of 4), counts (array: source, target).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the probability of a target that no sequence of other pairs makes.
NO_WAY = 1e-10


def probabilities(table: DataFrame) -> DataFrame:
    """fr, en, joint, prob, logprob: joint is the greater of what either direction implies."""
    at = F.element_at
    joint = F.greatest(at("scores", 1) * at("counts", 1), at("scores", 3) * at("counts", 2))
    rows = table.select("fr", "en", joint.alias("joint"), F.try_divide(joint, at("counts", 1)).alias("prob"))
    return rows.withColumn("logprob", F.ln("prob"))


def source_matches(phrases: DataFrame, table: DataFrame) -> DataFrame:
    """phrases(fr) to (fr, start, end, part): all spans of words that are source phrases of table."""
    words = F.split("fr", " ")
    spans = phrases.select("fr", words.alias("w")).select("fr", "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("start"))
    spans = spans.select("fr", "w", "start", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("start") + 1)).alias("n"))
    spans = spans.select("fr", (F.col("start") - 1).alias("start"), (F.col("start") + F.col("n") - 2).alias("end"), F.array_join(F.slice("w", F.col("start"), F.col("n")), " ").alias("part"))
    return spans.join(table.select(F.col("fr").alias("part")).distinct(), "part", "left_semi").select("fr", "start", "end", "part")


def places(words, part):
    """Starts (from 0) of the word array part in words."""
    last = F.size(words) - F.size(part)
    every = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.filter(every, lambda i: F.slice(words, i + 1, F.size(part)) == part)


def arcs(probs: DataFrame) -> DataFrame:
    """For each pair (fr, en): arcs (start, end, logprob) of other pairs whose source stands in fr and whose target in en,
    the best for each place. The arc over all of en is left out."""
    parts = source_matches(probs.select("fr").distinct(), probs).select("fr", "part").distinct()
    inner = probs.select(F.col("fr").alias("part"), F.split("en", " ").alias("t"), F.col("logprob").alias("lp"))
    pairs = probs.select("fr", "en").join(parts, "fr").join(inner, "part").withColumn("w", F.split("en", " "))
    found = pairs.select("fr", "en", F.size("w").alias("n"), F.size("t").alias("k"), "lp", F.explode(places(F.col("w"), F.col("t"))).alias("start"))
    found = found.withColumn("end", F.col("start") + F.col("k")).filter(~((F.col("start") == 0) & (F.col("end") == F.col("n"))))
    return found.groupBy("fr", "en", "n", "start", "end").agg(F.max("lp").alias("lp"))


def decoded(probs: DataFrame) -> DataFrame:
    """fr, en, new_logprob: the best sequence of arcs from 0 to the end of en, null if there is none.

    Arcs in order of their ends update an array of the best sums, so each is final when it is read."""
    lists = arcs(probs).groupBy("fr", "en", "n").agg(F.array_sort(F.collect_list(F.struct("end", "start", "lp"))).alias("arcs"))
    low = F.lit(float("-inf"))
    first = F.transform(F.sequence(F.lit(0), F.col("n")), lambda i: F.when(i == 0, 0.0).otherwise(low))

    def take(best, arc):
        way = F.element_at(best, arc["start"] + 1) + arc["lp"]
        return F.transform(best, lambda v, i: F.when(i == arc["end"], F.greatest(v, way)).otherwise(v))

    total = F.element_at(F.aggregate("arcs", first, take), -1)
    return lists.select("fr", "en", F.when(total > low, total).alias("new_logprob"))


def relative_entropy(table: DataFrame) -> DataFrame:
    """fr, en, joint, logprob, new_logprob, entropy = joint (logprob - new_logprob). No row is dropped."""
    probs = probabilities(table)
    rows = probs.join(decoded(probs), ["fr", "en"], "left")
    rows = rows.withColumn("new_logprob", F.coalesce("new_logprob", F.ln(F.lit(NO_WAY))))
    return rows.select("fr", "en", "joint", "logprob", "new_logprob", (F.col("joint") * (F.col("logprob") - F.col("new_logprob"))).alias("entropy"))
