"""Readers of the text formats. Compressed files are told by their names; lines keep their number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lexshift.functions.scalar import LOG10_FLOOR, floored_log
from lexshift.operators.bitext import PAIR, parse_align
from lexshift.operators.features import parsed
from lexshift.operators.labels import last_wins

TOKENS = "snt_id int, fr_start int, fr_end int, en_start int, en_end int, fr string, en string"


def lines(spark: SparkSession, path: str, **of_file: Column) -> DataFrame:
    """line_no (from 1, in each file), value, file. Numbers count the lines of a file's earlier parts first, so a
    file may be read in parts by many tasks; a count and the first id of each part are gathered, and no line is
    moved. A folder that Spark wrote is one file: its name is the folder's, its part files follow each other.
    of_file: more columns of the file's name, found once for each part."""
    # ids rise by one from line to line of a task, so a line's place in its part is told by the part's first id
    rows = spark.read.text(path).select(F.input_file_name().alias("_name"), F.input_file_block_start().alias("_block"), "value", F.monotonically_increasing_id().alias("_at"))
    counts = rows.groupBy("_name", "_block").agg(F.count("*").alias("n"), F.min("_at").alias("_first")).withColumn("file", F.regexp_replace("_name", r"/part-[0-9]+[^/]*$", ""))
    before = W.Window.partitionBy("file").orderBy(F.length("_name"), "_name", "_block").rowsBetween(W.Window.unboundedPreceding, -1)
    bases = counts.select("_name", "_block", "file", (F.coalesce(F.sum("n").over(before), F.lit(0)) + 1 - F.col("_first")).alias("_base"))
    bases = bases.select("*", *[c.alias(n) for n, c in of_file.items()])
    numbered = rows.join(F.broadcast(bases), ["_name", "_block"])  # one row for each part
    return numbered.select((F.col("_base") + F.col("_at")).alias("line_no"), "value", "file", *of_file)


def source_name(file: Column) -> Column:
    """"DOMAIN.kind.source[.gz]" to its parts: domain without -old or -big, kind, source."""
    m = lambda i: F.regexp_extract(file, r"([^/]+?)(?:-old|-big)?\.(type|token)\.([^/]+?)(?:\.gz)?$", i)
    return F.struct(m(1).alias("domain"), m(2).alias("kind"), m(3).alias("source"))


def fields(value: Column, sep: str, names: list[tuple[str, str]]) -> list[Column]:
    parts = F.split(value, sep, -1)
    return [F.try_element_at(parts, F.lit(i + 1)).try_cast(t).alias(n) for i, (n, t) in enumerate(names)]


def tokens(spark: SparkSession, path: str) -> DataFrame:
    """The token table: line_no, snt_id, spans, fr, en."""
    names = [tuple(c.split()) for c in TOKENS.split(", ")]
    return lines(spark, path).select("line_no", *fields(F.col("value"), "\t", names))


def types(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("fr")).filter("fr <> ''").distinct()


def type_union(*tables: DataFrame) -> DataFrame:
    """Phrases of several lists or token tables, each once, in order."""
    out = tables[0].select("fr")
    for t in tables[1:]:
        out = out.union(t.select("fr"))
    return out.filter("trim(fr) <> ''").distinct().orderBy("fr")


def type_features(spark: SparkSession, path: str) -> DataFrame:
    """domain, source, fr, name, text, value of type feature files; lines without features are passed over. Of lines of
    one phrase and of repeated names the last counts."""
    m = lambda i: F.regexp_extract("value", r"^([^\t]+)\t(.+)$", i)
    rows = lines(spark, path, s=source_name(F.col("file"))).select("line_no", "s", m(1).alias("fr"), F.split(m(2), r"\s+").alias("items")).filter("fr <> ''")
    out = parsed(rows.select("line_no", "s.domain", "s.source", "fr", "items"), "items", ["domain", "source", "fr", "line_no"])
    return last_wins(out, ["domain", "source", "fr", "name"])


def token_features(spark: SparkSession, path: str) -> DataFrame:
    """domain, source, line_no, name, text, value of token feature files, one line for each token."""
    rows = lines(spark, path, s=source_name(F.col("file"))).select("line_no", "s", F.split("value", r"\s+").alias("items"))
    return parsed(rows.select("line_no", "s.domain", "s.source", "items"), "items", ["domain", "source", "line_no"])


def seen(spark: SparkSession, path: str) -> DataFrame:
    """fr, en, p; lines without a number are passed over, of repeated pairs the last counts."""
    rows = lines(spark, path).select("line_no", *fields(F.col("value"), "\t", [("fr", "string"), ("en", "string"), ("p", "double")]))
    return last_wins(rows.filter("p IS NOT NULL"), ["fr", "en"])


def phrase_table(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """fr, en, scores, align, counts; most: the first lines only, where that is the task."""
    rows = lines(spark, path)
    rows = rows.filter(F.col("line_no") <= most) if most else rows
    p = F.split("value", r" \|\|\| ?", -1)
    numbers = lambda i: F.transform(F.filter(F.split(F.try_element_at(p, F.lit(i)), " "), lambda x: x != ""), lambda x: x.try_cast("double"))
    return rows.select("line_no", F.element_at(p, 1).alias("fr"), F.try_element_at(p, F.lit(2)).alias("en"), numbers(3).alias("scores"), F.try_element_at(p, F.lit(4)).alias("align"), numbers(5).alias("counts"))


def unigrams(spark: SparkSession, path: str) -> DataFrame:
    """word, logprob of a language model's unigram lines (two or three fields, the first a number)."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(F.element_at(p, 1).try_cast("double").alias("logprob"), F.try_element_at(p, F.lit(2)).alias("word"), F.size(p).alias("n"))
    return rows.filter("logprob IS NOT NULL AND n BETWEEN 2 AND 3").select("word", "logprob")


def score_logs(value: Column) -> Column:
    """"ppl oov zero p1 ... pn" to natural logs of the floored probabilities."""
    p = F.split(F.trim(value), r"\s+")
    return F.transform(F.slice(p, 4, F.greatest(F.size(p) - 3, F.lit(0))), lambda x: floored_log(F.coalesce(x.try_cast("double"), F.lit(0.0))))


def sentence_scores(spark: SparkSession, sentences: str, gb: str, gs: str, db: str, ds: str) -> DataFrame:
    """line_no, pos, fr, gb, gs, db, ds: words of a sentence file beside four score files of as many lines."""
    out = lines(spark, sentences).select("line_no", F.split(F.trim("value"), r"\s+").alias("tokens"))
    for name, path in (("gb", gb), ("gs", gs), ("db", db), ("ds", ds)):
        out = out.join(lines(spark, path).select("line_no", score_logs(F.col("value")).alias(name)), "line_no")
    at = lambda c: F.try_element_at(F.col(c), F.col("i") + 1).alias(c)
    return out.select("line_no", "gb", "gs", "db", "ds", F.posexplode("tokens").alias("i", "fr")).select("line_no", "i", "fr", *map(at, ("gb", "gs", "db", "ds"))).filter("gb IS NOT NULL")


#: Lines of a file that stand in one window.
CHUNK = 50_000


def debug_scores(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """snt_id (from 1), sentence, probs (floored base-10 logs) of a language model's per-word debug output.

    A block is a sentence line, lines with "p( ... ) ... [ logprob ]", and trailer lines; a sentence line is one
    after a blank line. Blocks are counted in chunks of lines: a chunk begins with the count and the last line of
    those before it, of which there is one row each."""
    rows = lines(spark, path).withColumn("blank", F.trim("value") == "").withColumn("chunk", F.floor((F.col("line_no") - 1) / chunk))
    ends = rows.groupBy("file", "chunk").agg(F.max_by("blank", "line_no").alias("end"))
    chunks = W.Window.partitionBy("file").orderBy("chunk")
    heads = ends.select("file", "chunk", F.lag("end", 1, True).over(chunks).alias("head"))
    order = W.Window.partitionBy("file", "chunk").orderBy("line_no")
    first = (F.coalesce(F.lag("blank").over(order), "head") & ~F.col("blank")).cast("int")
    rows = rows.join(F.broadcast(heads), ["file", "chunk"]).withColumn("first", first)
    sums = rows.groupBy("file", "chunk").agg(F.sum("first").alias("n"))
    bases = sums.select("file", "chunk", F.coalesce(F.sum("n").over(chunks.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    rows = rows.join(F.broadcast(bases), ["file", "chunk"]).withColumn("block", F.col("base") + F.sum("first").over(order)).filter(~F.col("blank"))
    number = F.regexp_extract("value", r"^\s*p\(.*\[ *(\S+) *\]\s*$", 1)
    value = F.greatest(F.coalesce(number.try_cast("double"), F.lit(LOG10_FLOOR)), F.lit(LOG10_FLOOR))
    return rows.groupBy("file", "block").agg(
        F.min_by("value", "line_no").alias("sentence"), F.array_sort(F.collect_list(F.when(number != "", F.struct("line_no", value.alias("v"))))).alias("l")
    ).select(F.col("block").alias("snt_id"), F.trim("sentence").alias("sentence"), F.transform("l", lambda x: x["v"]).alias("probs")).filter(F.size("probs") > 0)


def corpus(spark: SparkSession, path: str, lower: bool = False) -> DataFrame:
    """sent, tokens."""
    text = F.lower("value") if lower else F.col("value")
    return lines(spark, path).select(F.col("line_no").alias("sent"), F.filter(F.split(text, r"\s+"), lambda w: w != "").alias("tokens"))


def zipped(*tables: DataFrame, on: str = "sent") -> DataFrame:
    """Tables side by side by line; the shortest ends it."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, on)
    return out


def bitext(spark: SparkSession, src: str, tgt: str, align: str, lower: bool = False, permissive: bool = True) -> DataFrame:
    """sent, src, tgt, align of three files."""
    pairs = lines(spark, align).select(F.col("line_no").alias("sent"), parse_align(F.col("value"), permissive).alias("align"))
    return zipped(corpus(spark, src, lower).withColumnRenamed("tokens", "src"), corpus(spark, tgt, lower).withColumnRenamed("tokens", "tgt"), pairs)


def giza(spark: SparkSession, path: str) -> DataFrame:
    """sent, src, tgt, align of three-line records: a comment, the target, "word ({ 1 3 }) ..." with places from 1; the
    first group is NULL's and left out."""
    rows = lines(spark, path).withColumn("sent", F.floor((F.col("line_no") - 1) / 3) + 1).withColumn("k", (F.col("line_no") - 1) % 3)
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("value")))
    rec = rows.groupBy("file", "sent").agg(at(1).alias("target"), at(2).alias("source"))
    group = r"(\S+) \(\{([^}]*)\}\)"
    found = lambda i: F.regexp_extract_all("source", F.lit(group), F.lit(i))
    words, places = F.slice(found(1), 2, F.size(found(1))), F.slice(found(2), 2, F.size(found(2)))
    linked = F.transform(places, lambda p, i: F.transform(F.filter(F.split(p, r"\s+"), lambda x: x != ""), lambda x: F.struct(i.alias("s"), (x.cast("int") - 1).alias("t"))))
    return rec.select("sent", words.alias("src"), F.filter(F.split("target", r"\s+"), lambda w: w != "").alias("tgt"), F.flatten(linked).cast(PAIR).alias("align"))


def page_counts(spark: SparkSession, path: str, min_count: int = 0) -> DataFrame:
    """page (the file), word, n of "n word" lines; repeated words are summed, then held against min_count."""
    p = F.split(F.trim("value"), r"\s+")
    page = F.regexp_replace(F.input_file_name(), r"/part-[0-9]+[^/]*$", "")
    rows = spark.read.text(path).select(page.alias("page"), F.try_element_at(p, F.lit(2)).alias("word"), F.element_at(p, 1).try_cast("long").alias("n"))
    return rows.filter("word IS NOT NULL AND n IS NOT NULL").groupBy("page", "word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def page_shares(spark: SparkSession, path: str) -> DataFrame:
    """page, word, p: of repeated words the last count, over the sum of all lines."""
    rows = lines(spark, path).select("line_no", F.col("file").alias("page"), *fields(F.trim("value"), r"\s+", [("n", "double"), ("word", "string")])).filter("n IS NOT NULL AND word IS NOT NULL")
    totals = rows.groupBy("page").agg(F.sum("n").alias("total"))
    return last_wins(rows, ["page", "word"]).join(totals, "page").select("page", "word", (F.col("n") / F.col("total")).alias("p"))


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """f, e, p: scores over their f's sum; lines that do not have three fields are passed over, of repeated pairs the last counts."""
    p = F.split(F.trim("value"), r"\s+")
    rows = lines(spark, path).filter(F.size(p) == 3).select("line_no", *fields(F.trim("value"), r"\s+", [("score", "double"), ("f", "string"), ("e", "string")]))
    rows = last_wins(rows.filter("score IS NOT NULL"), ["f", "e"])
    return rows.select("f", "e", (F.col("score") / F.sum("score").over(W.Window.partitionBy("f"))).alias("p"))


def joint_table(spark: SparkSession, path: str, words: DataFrame | None = None, learned: bool = False) -> DataFrame:
    """fr, en, joint, p_ef, p_fe; learned: the words stand before the numbers. words: keep these phrases only."""
    numbers, names = [("joint", "double"), ("p_ef", "double"), ("p_fe", "double")], [("fr", "string"), ("en", "string")]
    rows = spark.read.text(path).select(*fields(F.trim("value"), r"\s+", [*names, *numbers] if learned else [*numbers, *names])).filter("joint IS NOT NULL AND en IS NOT NULL")
    return rows.join(words.select("fr").distinct(), "fr", "left_semi") if words is not None else rows


def pair_counts(spark: SparkSession, path: str, most: int = 300) -> DataFrame:
    """line_no, f, e, old, new of the first lines of "f__e old new"."""
    p = F.split(F.trim("value"), r"\s+")
    rows = lines(spark, path).filter(F.col("line_no") <= most)
    return rows.select("line_no", F.split_part(p[0], F.lit("__"), F.lit(1)).alias("f"), F.split_part(p[0], F.lit("__"), F.lit(2)).alias("e"), F.try_element_at(p, F.lit(2)).try_cast("long").alias("old"), F.try_element_at(p, F.lit(3)).try_cast("long").alias("new"))


def example_sections(spark: SparkSession, path: str) -> DataFrame:
    """line_no, section (train, dev or test), label, features of learner lines; a line DEV or TEST begins a section."""
    rows = lines(spark, path)
    mark = F.when(F.col("value").startswith("DEV"), 1).when(F.col("value").startswith("TEST"), 2)
    marks = rows.select("line_no", mark.alias("m")).filter("m IS NOT NULL").groupBy("m").agg(F.min("line_no").alias("from"))
    starts = marks.agg(F.min(F.when(F.col("m") == 1, F.col("from"))).alias("dev"), F.min(F.when(F.col("m") == 2, F.col("from"))).alias("test"))
    at = rows.filter(mark.isNull()).crossJoin(F.broadcast(starts))  # one row
    section = F.when(F.col("line_no") > F.col("test"), "test").when(F.col("line_no") > F.col("dev"), "dev").otherwise("train")
    items = F.filter(F.split(F.trim(F.regexp_extract("value", r"\|\s*(.*)$", 1)), r"\s+"), lambda x: x != "")
    return at.select("line_no", section.alias("section"), F.regexp_extract("value", r"^\s*(\S+)", 1).try_cast("double").alias("label"), items.alias("items"))


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """score, label, grp of "score label [group]" lines."""
    return lines(spark, path).select("line_no", *fields(F.trim("value"), r"\s+", [("score", "double"), ("label", "double"), ("grp", "string")]))


def flow_output(spark: SparkSession, path: str) -> DataFrame:
    """word, diff of flow files; header lines are passed over."""
    return spark.read.text(path).filter(~F.col("value").startswith("#")).select(*fields(F.trim("value"), r"\s+", [("word", "string"), ("diff", "double")])).filter("diff IS NOT NULL")


def every_nth(rows: DataFrame, offset: int, step: int = 5, most: int = 400, line: str = "line_no") -> DataFrame:
    """Every step-th line from offset on, the first `most` of them."""
    return rows.filter(F.pmod(F.col(line) - offset, F.lit(step)) == 0).filter(F.col(line) >= offset).filter(F.floor((F.col(line) - offset) / step) < most)
