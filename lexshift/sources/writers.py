"""Writers of the text formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexshift.operators.bitext import show_align
from lexshift.operators.features import rendered


def write_lines(rows: DataFrame, path: str, column: str = "line", gzip: bool = False, mode: str = "error") -> None:
    rows.select(F.col(column).cast("string").alias("value")).write.mode(mode).option("compression", "gzip" if gzip else "none").text(path)


def example_lines(rows: DataFrame, features: DataFrame, key: str = "key", bar: bool = True, seed: int = 1) -> DataFrame:
    """key, line: "label | phrase_id=... name[:value] ..." in a seeded order; zeros dropped, ones implicit."""
    lists = rendered(features, [key])
    mark = F.lit(" |" if bar else "")
    line = F.concat_ws(" ", F.concat(F.col("label").cast("string"), mark), F.concat(F.lit("phrase_id="), F.regexp_replace("fr", r"\s", "_")), F.col("_items"))
    out = rows.join(lists.withColumnRenamed("line", "_items"), key, "left").select(key, line.alias("line"))
    return out.orderBy(F.xxhash64(key, F.lit(seed)), key)


def one_class(rows: DataFrame) -> DataFrame:
    """One row if labels are of one class only, to warn of."""
    return rows.agg(F.count_if(F.col("label") > 0).alias("pos"), F.count_if(F.col("label") <= 0).alias("neg")).filter("pos = 0 OR neg = 0")


def bucket_lines(bounds: DataFrame) -> DataFrame:
    lists = bounds.groupBy("name").agg(F.array_sort(F.collect_list("boundary")).alias("b"))
    return lists.select("name", F.concat_ws("\t", F.col("name"), F.array_join(F.transform("b", lambda x: x.cast("string")), "\t")).alias("line")).orderBy("name")


def type_feature_lines(features: DataFrame) -> DataFrame:
    return rendered(features, ["fr"]).select("fr", F.concat_ws("\t", "fr", "line").alias("line")).orderBy("fr")


def token_feature_lines(tokens: DataFrame, features: DataFrame) -> DataFrame:
    """One line for each token in order, empty where it has no features."""
    return tokens.select("line_no").join(rendered(features, ["line_no"]), "line_no", "left").select("line_no", F.coalesce("line", F.lit("")).alias("line")).orderBy("line_no")


def seen_lines(seen: DataFrame) -> DataFrame:
    return seen.orderBy("fr", F.col("p").desc(), "en").select(F.concat_ws("\t", "fr", "en", F.col("p").cast("string")).alias("line"))


def bitext_lines(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Source, target and alignment lines in sentence order."""
    in_order = rows.orderBy("sent")
    text = lambda c: in_order.select(F.array_join(c, " ").alias("line"))
    return text("src"), text("tgt"), in_order.select(show_align(F.col("align")).alias("line"))


def html_rows(weights: DataFrame, doc: str = "doc", labels: Column | None = None) -> DataFrame:
    """A document's terms, heaviest first, as one table row."""
    safe = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    cell = F.concat(F.lit("<td>"), safe(F.col("term")), F.format_string(" %.3f</td>", F.col("weight")))
    lists = weights.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "term", cell.alias("c")))).alias("l"))
    head = F.concat(F.lit("<th>"), safe((labels if labels is not None else F.col(doc)).cast("string")), F.lit("</th>"))
    return lists.select(doc, F.concat(F.lit("<tr>"), head, F.array_join(F.transform("l", lambda x: x["c"]), ""), F.lit("</tr>")).alias("line"))


def kwic_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in rows.columns]).alias("line")).distinct()
