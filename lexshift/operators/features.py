"""Sparse features in long form, and the generators of type and token features.

A feature row has name, text (the value as written) and value. Type features belong to a
phrase, token features to a line of the token table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lexshift.functions.scalar import MISSING_LOG10, feature_name, feature_text
from lexshift.operators.labels import last_wins

STATS = ("count", "mean", "std", "min", "max", "sum")


def parsed(rows: DataFrame, items: str, keys: list[str]) -> DataFrame:
    """Arrays of "name" or "name:number" to feature rows; of repeated names the last counts."""
    each = rows.select(*keys, F.posexplode(items).alias("at", "item")).filter("item <> ''")
    out = each.select(*keys, "at", feature_name(F.col("item")).alias("name"), feature_text(F.col("item")).alias("text"))
    out = last_wins(out, [*keys, "name"], "at").drop("at")
    return out.withColumn("value", F.col("text").try_cast("double"))


def rendered(features: DataFrame, keys: list[str], order: str = "name") -> DataFrame:
    """Feature rows to one text for each key: zeros dropped, ones without their value, in order of names."""
    item = F.when(F.col("value") == 1, F.col("name")).otherwise(F.concat_ws(":", "name", "text"))
    lists = features.filter("value <> 0").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("i")))).alias("items"))
    return lists.select(*keys, F.array_join(F.transform("items", lambda x: x["i"]), " ").alias("line"))


def type_features(tokens: DataFrame, features: DataFrame, keys: list[str]) -> DataFrame:
    """features(fr, source, name, value) joined to tokens by phrase: keys, name with its prefix, value. Features grow with
    the phrases, so they are never sent to every task, however small their compressed files make them look."""
    return tokens.select(*keys, "fr").join(features.hint("merge"), "fr").select(*keys, F.concat(F.col("source"), F.lit("___type_"), F.col("name")).alias("name"), "text", "value")


def token_features(tokens: DataFrame, features: DataFrame, keys: list[str], line: str = "line_no") -> DataFrame:
    """features(line_no, source, name, value) joined to tokens by line; lines without a token are left out."""
    return tokens.select(*keys, *[c for c in [line] if c not in keys]).join(features, line).select(*keys, F.concat(F.col("source"), F.lit("___token_"), F.col("name")).alias("name"), "text", "value")


def bias(tokens: DataFrame, keys: list[str]) -> DataFrame:
    return tokens.select(*keys, F.lit("___bias").alias("name"), F.lit("1").alias("text"), F.lit(1.0).alias("value"))


def assembled(tokens: DataFrame, by_type: DataFrame, by_token: DataFrame, keys: list[str], ignore: tuple[str, ...] = (), use_type: bool = True, use_token: bool = True) -> DataFrame:
    """All feature rows of tokens. ignore: "type.<source>" or "token.<source>", filtered before any join."""
    out = bias(tokens, keys)
    for on, kind, rows, join in ((use_type, "type", by_type, type_features), (use_token, "token", by_token, token_features)):
        if on:
            out = out.unionByName(join(tokens, rows.filter(~F.concat(F.lit(kind + "."), F.col("source")).isin(list(ignore))), keys))
    return out


def as_maps(features: DataFrame, keys: list[str]) -> DataFrame:
    return features.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("features"))


def missing_lines(tokens: DataFrame, features: DataFrame, line: str = "line_no") -> DataFrame:
    """One row: lines of features beyond the tokens, and tokens without a line."""
    t, f = tokens.select(line).distinct(), features.select(line).distinct()
    return t.withColumn("t", F.lit(1)).join(f.withColumn("f", F.lit(1)), line, "outer").agg(F.count_if(F.col("t").isNull()).alias("extra"), F.count_if(F.col("f").isNull()).alias("missing"))


def capped(tokens: DataFrame, cap: int = 100, order: tuple[str, ...] = ("domain", "line_no")) -> DataFrame:
    """The first `cap` tokens of each phrase in the given order, over all domains. Spark keeps `cap` rows of a phrase
    in each task before it shuffles."""
    rank = F.row_number().over(W.Window.partitionBy("fr").orderBy(*order))
    return tokens.withColumn("_rank", rank).filter(F.col("_rank") <= cap).drop("_rank")


def sampled(rows: DataFrame, key: str, share: float, salt: str = "subset") -> DataFrame:
    """A share of the rows, told by a hash of their key, so reruns agree."""
    return rows.filter(F.pmod(F.xxhash64(F.lit(salt), F.col(key)), F.lit(1_000_000)) < int(share * 1_000_000))


def relative_frequency(types: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """fr, lp_old, lp_new, lp_diff from base-10 log probabilities (word, logprob)."""
    at = lambda lm, name: lm.groupBy(F.col("word").alias("fr")).agg(F.max("logprob").alias(name))
    rows = types.select("fr").distinct().join(at(old, "lp_old"), "fr", "left").join(at(new, "lp_new"), "fr", "left")
    rows = rows.select("fr", *[F.coalesce(c, F.lit(MISSING_LOG10)).alias(c) for c in ("lp_old", "lp_new")])
    return rows.withColumn("lp_diff", F.col("lp_new") - F.col("lp_old"))


def series(gb: Column, gs: Column, db: Column, ds: Column) -> dict[str, Column]:
    """The four series of a position's log probabilities: general and domain, big and small model."""
    return {"gb": gb, "gb_gs": gb - gs, "db_gb": db - gb, "db_gs": db + gs - gb - ds}


def series_stats(rows: DataFrame, names: list[str], key: str = "fr", digits: int | None = None) -> DataFrame:
    """Six statistics of each series for each key; deviations are those of the population."""
    functions = {"count": F.count, "mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max, "sum": F.sum}
    cut = lambda c, s: F.round(c, digits) if digits is not None and s != "count" else c
    return rows.groupBy(key).agg(*[cut(functions[s](n), s).alias(f"{n}_{s}") for n in names for s in STATS])


def flow_rows(diffs: DataFrame) -> DataFrame:
    """Flow output (page, word, diff) as a series: the sign turned."""
    return diffs.select(F.col("word").alias("fr"), (-F.col("diff")).alias("flow"))


def span_values(tokens: DataFrame, scores: DataFrame, start: str = "fr_start", end: str = "fr_end", sent: str = "snt_id") -> DataFrame:
    """Token features from per-sentence arrays gen and dom (base-10 logs, one for each word and the sentence end): their values
    and difference at the span's first word and at the word after it. Null where the sentence or position is missing."""
    rows = tokens.join(scores, sent, "left")
    at = lambda c, i: F.try_element_at(F.col(c), i.cast("int"))
    first, after = F.col(start) + 1, F.col(end) + 2
    out = {"gen_at": at("gen", first), "dom_at": at("dom", first), "gen_after": at("gen", after), "dom_after": at("dom", after)}
    rows = rows.withColumns(out).drop("gen", "dom")
    return rows.withColumns({"diff_at": F.col("dom_at") - F.col("gen_at"), "diff_after": F.col("dom_after") - F.col("gen_after")})


def span_errors(tokens: DataFrame, sentences: DataFrame, start: str = "fr_start", end: str = "fr_end", sent: str = "snt_id") -> DataFrame:
    """Tokens whose phrase is not what stands at their span of sentences(snt_id, tokens)."""
    there = F.array_join(F.slice("tokens", F.col(start).cast("int") + 1, (F.col(end) - F.col(start)).cast("int") + 1), " ")
    return tokens.join(sentences, sent, "left").withColumn("there", there).filter(~F.col("fr").eqNullSafe(F.col("there"))).drop("tokens")


def adapted(features: DataFrame, domain: str = "domain", target: str = "new") -> DataFrame:
    """Domain adaptation by copies: rows of other domains come twice, the second with the domain before the name."""
    old = F.col(domain) != target
    names = F.when(old, F.array(F.col("name"), F.concat_ws("_", F.col(domain), "name"))).otherwise(F.array(F.col("name")))
    return features.withColumn("name", F.explode(names))
