"""Mixing sources to target weights by capped water-filling.

Every source gets a share of the mix by its weight, but never more than
``max_epochs`` times its own size; what a capped source cannot take is dealt
again to the others by weight until no target is above its cap. The fixed point
is found in closed form: with sources in the order of cap / weight, the capped
ones are a prefix, and all others share one level (words per unit of weight).

A target above the source's size means whole repetitions of every document plus
one fractional repetition: documents in the order of a seeded hash take one more
copy until the target is reached, and the document at the cut gives as many of
its first words as are missing. Which documents these are is found from sums over
4096 hash buckets for each source and then inside the one bucket that holds the
cut, so no source is ever ordered as a whole, and the only thing joined to the
documents is one row for each source.

Defined cases: a null text has size 0 and takes nothing; a null source is a source
of its own, last in order; repeated rows (same id) stand at the same place in the
order and share what the cut leaves in proportion to their sizes; an empty table
gives an empty result; extra columns are carried or ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lexshift.llm.text import n_words
from lexshift.session import staged

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"
#: Leading hex digits of the hash that name a bucket.
DIGITS = 3


def place(doc_id: Column, seed: str = SEED) -> Column:
    """The seeded place of a document in its source's order; hex digits."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, size) rows to (source, source_size, target): the water-filling.

    Only sums for each source reach the windows without a key.
    """
    whole = W.Window.partitionBy()
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.Window.partitionBy().orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    fill = W.Window.partitionBy().orderBy("fill_order", "rank")
    return (
        by_source.withColumn("rank", rank)
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("goal", F.sum("source_size").over(whole) * F.lit(float(share)))
        .withColumn("fill_order", F.col("cap") / F.col("weight"))
        .withColumn("filled", F.coalesce(F.sum("cap").over(fill.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("rest_weight", F.sum("weight").over(fill.rowsBetween(0, W.Window.unboundedFollowing)))
        .withColumn("left", F.col("goal") - F.col("filled"))
        .withColumn("capped", F.col("weight") * F.col("left") / F.col("rest_weight") > F.col("cap"))
        .withColumn("level", F.min(F.when(~F.col("capped"), F.struct("fill_order", "rank", "left", "rest_weight"))).over(whole))
        .withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("level.left") / F.col("level.rest_weight")))
        .select("source", "source_size", "target")
    )


def plan_sources(sized: DataFrame, **how) -> DataFrame:
    """sized: (source, size, place) rows. One row for each source:
    source_size, target, whole (repetitions of everything), need (words of the
    fractional repetition), and its cut (place, words left there, words there)."""
    before = lambda part, order: W.Window.partitionBy(part).orderBy(order).rowsBetween(W.Window.unboundedPreceding, -1)
    goal = (
        targets(sized, **how)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("need", F.floor(F.col("target") + 0.5).cast("long") - F.col("whole") * F.col("source_size"))
    )
    goal = staged(goal, "mix-goals")
    key = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source").cast("string")))
    rows = sized.select(key.alias("key"), "size", "place", F.substring("place", 1, DIGITS).alias("bucket"))
    goals = goal.withColumn("key", key)
    cells = rows.groupBy("key", "bucket").agg(F.sum("size").alias("cell"))
    at = (
        cells.withColumn("base", F.coalesce(F.sum("cell").over(before("key", "bucket")), F.lit(0)))
        .join(goals.select("key", "need"), "key")
        .filter((F.col("base") < F.col("need")) & (F.col("need") <= F.col("base") + F.col("cell")))
        .select("key", "bucket", "base", "need")
    )
    cut = (
        rows.join(at, ["key", "bucket"])
        .groupBy("key", "base", "need", "place")
        .agg(F.sum("size").alias("at_cut"))
        .withColumn("so_far", F.col("base") + F.coalesce(F.sum("at_cut").over(before("key", "place")), F.lit(0)))
        .filter((F.col("so_far") < F.col("need")) & (F.col("need") <= F.col("so_far") + F.col("at_cut")))
        .select("key", F.col("place").alias("cut"), (F.col("need") - F.col("so_far")).alias("cut_words"), "at_cut")
    )
    return goals.join(cut, "key", "left").select("key", "source_size", "target", "whole", "cut", "cut_words", "at_cut")


def with_plan(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds each row's source_size, target, whole and extra (words of the fractional repetition).
    rows: has _key, _place and _size. sources has one row for each source; Spark sends it to all tasks if it is
    below its size limit, else it splits the join's hot keys."""
    extra = (
        F.when(F.col("_place") < F.col("cut"), F.col("_size"))
        .when(F.col("_place") == F.col("cut"), F.expr("_size * cut_words div at_cut"))
        .otherwise(F.lit(0).cast("long"))
    )
    return rows.join(sources.withColumnRenamed("key", "_key"), "_key").withColumn("_extra", extra)


def mix(docs: DataFrame, seed: str = SEED, **how) -> DataFrame:
    """(doc_id, source, text) to doc_id, size, source_size, target, taken. Texts are read once."""
    sized = staged(
        docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), place(F.col("doc_id"), seed).alias("place")),
        "mix-sizes",
    )
    sources = staged(plan_sources(sized, **how), "mix-sources")
    key = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source").cast("string")))
    rows = sized.select("doc_id", key.alias("_key"), F.col("place").alias("_place"), F.col("size").alias("_size"))
    return with_plan(rows, sources).select(
        "doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("whole") * F.col("_size") + F.col("_extra")).alias("taken")
    )


def apply_mix(docs: DataFrame, seed: str = SEED, **how) -> DataFrame:
    """The mix itself, with the columns of docs: documents that it takes more than once
    come as several rows, and the one at each source's cut comes with its first words, joined by spaces."""
    sized = staged(
        docs.select("source", n_words(F.col("text")).alias("size"), place(F.col("doc_id"), seed).alias("place")), "mix-sizes"
    )
    sources = staged(plan_sources(sized, **how), "mix-sources")
    key = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source").cast("string")))
    whole_row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = with_plan(docs.select(whole_row, key.alias("_key"), place(F.col("doc_id"), seed).alias("_place"), n_words(F.col("text")).alias("_size")), sources)
    text = F.col("_row.text")
    part = F.array_join(F.slice(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""), 1, F.col("_extra").cast("int")), " ")
    copies = F.when(F.col("whole") > 0, F.array_repeat(F.lit(False), F.col("whole").cast("int"))).otherwise(F.array().cast("array<boolean>"))
    copies = F.concat(copies, F.when(F.col("_extra") > 0, F.array(F.col("_extra") < F.col("_size"))).otherwise(F.array().cast("array<boolean>")))
    out = rows.withColumn("_part", F.explode(copies)).withColumn("_text", F.when(F.col("_part"), part).otherwise(text))
    changed = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("_part"), F.length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    return out.select(*[changed.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place
  FROM documents),
by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rnk FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE rnk % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 2 AS cap,
         CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS goal FROM by_source),
filled AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / CAST(weight AS DOUBLE), rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
         sum(weight) OVER (ORDER BY cap / CAST(weight AS DOUBLE), rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
         row_number() OVER (ORDER BY cap / CAST(weight AS DOUBLE), rnk) AS k FROM weighed),
judged AS (
  SELECT *, goal - CAST(used AS DOUBLE) AS room, weight * (goal - CAST(used AS DOUBLE)) / CAST(rest AS DOUBLE) > cap AS capped FROM filled),
level AS (SELECT room, rest FROM judged WHERE NOT capped ORDER BY k LIMIT 1),
goals AS (
  SELECT j.source, j.source_size,
         CASE WHEN j.capped THEN CAST(j.cap AS DOUBLE) ELSE j.weight * (SELECT room FROM level) / CAST((SELECT rest FROM level) AS DOUBLE) END AS target
  FROM judged j),
needs AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM goals),
ordered AS (
  SELECT s.doc_id, s.size, n.source_size, n.target, n.whole,
         CAST(floor(n.target + 0.5) AS BIGINT) - n.whole * n.source_size AS need,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.place, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far
  FROM sized s JOIN needs n ON s.source IS NOT DISTINCT FROM n.source)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, need - so_far)) AS BIGINT) AS taken
FROM ordered
"""
