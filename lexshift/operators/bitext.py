"""Bitext: alignments, word pairs, counts, overlap of corpora, words in context.

A bitext row has sent, src, tgt (arrays of words) and align (array of (s, t), from 0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL = "NULL"
PAIR = "array<struct<s:int,t:int>>"


def parse_align(text: Column, permissive: bool = True) -> Column:
    """"0-0 1-2" to pairs. permissive: anything else gives an empty alignment, otherwise an error."""
    items = F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")
    fine = F.forall(items, lambda x: x.rlike(r"^[0-9]+-[0-9]+$"))
    pairs = F.transform(items, lambda x: F.struct(F.split_part(x, F.lit("-"), F.lit(1)).try_cast("int").alias("s"), F.split_part(x, F.lit("-"), F.lit(2)).try_cast("int").alias("t")))
    otherwise = F.array().cast(PAIR) if permissive else F.raise_error(F.concat(F.lit("bad alignment: "), text)).cast(PAIR)
    return F.when(fine, pairs).otherwise(otherwise)


def show_align(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat_ws("-", p["s"].cast("string"), p["t"].cast("string"))), " ")


def flip(pairs: Column) -> Column:
    return F.transform(pairs, lambda p: F.struct(p["t"].alias("s"), p["s"].alias("t")))


def intersect(forward: Column, backward: Column) -> Column:
    """The pairs of forward that backward has the other way round."""
    return F.array_intersect(forward, flip(backward))


def outside(rows: DataFrame) -> DataFrame:
    """Rows with a pair beyond their words."""
    return rows.filter(F.exists("align", lambda p: (p["s"] < 0) | (p["t"] < 0) | (p["s"] >= F.size("src")) | (p["t"] >= F.size("tgt"))))


def matrix_lines(src: Column, tgt: Column, pairs: Column) -> Column:
    """An alignment as lines: one for each source word, a mark for each target word."""
    cell = lambda i, j: F.when(F.exists(pairs, lambda p: (p["s"] == i) & (p["t"] == j)), "#").otherwise(".")
    row = lambda w, i: F.concat(F.array_join(F.transform(tgt, lambda _, j: cell(i, j)), ""), F.lit(" "), w)
    return F.transform(src, row)


def word_pairs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, f, e of every aligned pair, and of every unaligned word with NULL on the other side."""
    range_ = lambda c: F.when(F.size(c) > 0, F.sequence(F.lit(0), F.size(c) - 1)).otherwise(F.array().cast("array<int>"))
    linked = F.transform("align", lambda p: F.struct(F.element_at("src", p["s"] + 1).alias("f"), F.element_at("tgt", p["t"] + 1).alias("e")))
    free = lambda words, side: F.array_except(range_(words), F.transform("align", lambda p: p[side]))
    no_t = F.transform(free("src", "s"), lambda i: F.struct(F.element_at("src", i + 1).alias("f"), F.lit(NULL).alias("e")))
    no_s = F.transform(free("tgt", "t"), lambda i: F.struct(F.lit(NULL).alias("f"), F.element_at("tgt", i + 1).alias("e")))
    return rows.select(*keys, F.explode(F.concat(linked, no_t, no_s)).alias("p")).select(*keys, "p.f", "p.e")


def word_counts(rows: DataFrame, tokens: str = "tokens") -> DataFrame:
    return rows.select(F.explode(tokens).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def pair_counts(rows: DataFrame) -> DataFrame:
    return word_pairs(rows, []).groupBy("f", "e").agg(F.count("*").alias("n"))


def overlap(old: DataFrame, new: DataFrame, key: str = "word", compat: bool = True) -> DataFrame:
    """One row: types, tokens and singletons only in old, in both, only in new, from (key, n) tables.

    compat: a word that only new has adds 1 to new's tokens, whatever its count; otherwise the count."""
    both = old.select(key, F.col("n").alias("a")).join(new.select(key, F.col("n").alias("b")), key, "outer")
    a, b = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    in_old, in_new = F.col("a").isNotNull(), F.col("b").isNotNull()
    fresh = F.lit(1) if compat else b
    n = lambda c: F.count_if(c)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return both.agg(
        n(in_old & ~in_new).alias("old_types"), n(in_old & in_new).alias("both_types"), n(~in_old & in_new).alias("new_types"),
        total(F.greatest(a - b, F.lit(0))).alias("old_tokens"), total(F.least(a, b)).alias("both_tokens"),
        total(F.when(in_old, F.greatest(b - a, F.lit(0))).otherwise(fresh)).alias("new_tokens"),
        n(in_old & ~in_new & (a == 1)).alias("old_single"), n(in_old & in_new & (a == 1)).alias("both_single"), n(~in_old & in_new & (b == 1)).alias("new_single"),
    )


def corpus_stats(counts: DataFrame) -> DataFrame:
    return counts.agg(F.count("*").alias("types"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("tokens"), F.count_if(F.col("n") == 1).alias("singletons"))


def oov(test: DataFrame, train: DataFrame) -> DataFrame:
    """word, n of test's words that train lacks."""
    return test.join(train.select("word"), "word", "left_anti")


def kwic(tokens: DataFrame, sentences: DataFrame, start: str = "fr_start", end: str = "fr_end", sent: str = "snt_id") -> DataFrame:
    """Tokens in their sentences(sent, tokens): before, word, after; each line once."""
    rows = tokens.join(sentences, sent)
    first, last = F.col(start).cast("int"), F.col(end).cast("int")
    cut = lambda a, n: F.array_join(F.slice("tokens", a, n), " ")
    shown = rows.select(
        sent, F.when(first > 0, cut(F.lit(1), first)).otherwise("").alias("before"), cut(first + 1, last - first + 1).alias("word"),
        F.when(F.size("tokens") > last + 1, cut(last + 2, F.size("tokens"))).otherwise("").alias("after"),
    )
    return shown.distinct()


def symmetrized(forward: DataFrame, backward: DataFrame, sent: str = "sent") -> DataFrame:
    """Two directions' alignments of one bitext, met: only pairs that both have."""
    return forward.join(backward.select(sent, F.col("align").alias("_back")), sent).withColumn("align", intersect(F.col("align"), F.col("_back"))).drop("_back")
