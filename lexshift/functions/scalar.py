"""Scalar functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the weighting schemes and floors.
BM25_K1, BM25_B, BM25_IDF_FLOOR = 1.5, 0.75, 0.01
PROB_FLOOR, LOG10_FLOOR, MISSING_LOG10 = 1e-6, -6.0, -20.0


def log0(v: Column) -> Column:
    """Natural logarithm, 0 for values that have none."""
    return F.when(v > 0, F.ln(v)).otherwise(0.0)


def floored_log(p: Column, floor: float = PROB_FLOOR) -> Column:
    return F.ln(F.greatest(p, F.lit(floor)))


def feature_name(text: Column) -> Column:
    """The name in "name:number", the whole text where no number ends it."""
    return F.when(text.rlike(r"^.+:-?[0-9.e+-]+$"), F.regexp_extract(text, r"^(.+):-?[0-9.e+-]+$", 1)).otherwise(text)


def feature_text(text: Column) -> Column:
    """The number of "name:number" as text, "1" where there is none."""
    return F.when(text.rlike(r"^.+:-?[0-9.e+-]+$"), F.regexp_extract(text, r":(-?[0-9.e+-]+)$", 1)).otherwise("1")


def tfidf(tf: Column, df: Column, n_docs: Column) -> Column:
    return tf * F.ln(n_docs / df)


def bm25(tf: Column, df: Column, size: Column, mean_size: Column, n_docs: Column, k1: float = BM25_K1, b: float = BM25_B) -> Column:
    """size: the document's number of distinct terms."""
    idf = F.greatest(F.lit(BM25_IDF_FLOOR), F.ln((n_docs - df + 0.5) / (df + 0.5)))
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / mean_size))


def truncated(v: Column, digits: int = 2) -> Column:
    """A share as a percentage with its digits cut off, not rounded; null outside 0 to 1."""
    scale = 10**digits
    shown = F.format_string(f"%.{digits}f", F.floor(v * 100 * scale + 1e-9).cast("double") / scale)
    return F.when(v.between(0, 1), shown)


def same_word(a: Column, b: Column) -> Column:
    """Equal but for white space around; two empty words are equal."""
    return F.trim(F.coalesce(a, F.lit(""))) == F.trim(F.coalesce(b, F.lit("")))


def padded(text: Column, width: int) -> Column:
    """Filled up with blanks on the right; longer texts stay whole."""
    return F.when(F.length(text) >= width, text).otherwise(F.rpad(text, width, " "))


def words(text: Column) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def unescaped(text: Column) -> Column:
    return F.replace(text, F.lit("&apos;"), F.lit("'"))


def guessed_threshold(low: Column, high: Column) -> Column:
    """The threshold between labels whose least and greatest are given."""
    return F.when((low <= -0.8) & (high > 0.8), 0.0).when((low >= -0.2) & (high > 0.8), 0.5).otherwise(0.0)


def text_root(path: Column) -> Column:
    """A path's file name without its extensions."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\..*$", "")
