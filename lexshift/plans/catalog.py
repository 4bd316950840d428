"""The queries: every operator over the tables, and the same in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexshift.functions.scalar import truncated
from lexshift.operators import bitext, buckets, copula, features, flow, folds, joint, labels, learn, metrics, phrases, retrieval, topics
from lexshift.plans import experiment, tables
from lexshift.plans.tables import sql
from lexshift.session import scratch, staged, table
from lexshift.sources import readers, writers
from lexshift.streaming.pages import keep, type_statistics

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# Metrics ---------------------------------------------------------------------------------------------


def _auroc_sql(source: str, by: str = "", weight: str = "1", tail: str = "") -> str:
    k, p, on = (f"{by}, ", f"PARTITION BY {by} ", f"GROUP BY {by}") if by else ("", "", "")
    return f"""a0 AS (SELECT {k}score, sum(CASE WHEN label > 0 THEN {weight} ELSE 0 END) AS pos, sum(CASE WHEN label > 0 THEN 0 ELSE {weight} END) AS neg FROM {source} GROUP BY {k}score),
a1 AS (SELECT {k}sum(pos) OVER ({p}ORDER BY score DESC) AS tp, sum(neg) OVER ({p}ORDER BY score DESC) AS fp FROM a0),
a2 AS (SELECT {k}fp, max(tp) AS tp FROM a1 GROUP BY {k}fp),
a3 AS (SELECT {k}fp, tp, lag(fp, 1, 0) OVER ({p}ORDER BY fp) AS fp0, lag(tp, 1, 0) OVER ({p}ORDER BY fp) AS tp0 FROM a2),
area AS (SELECT {k}CAST(max(tp) AS BIGINT) AS n_pos, CAST(max(fp) AS BIGINT) AS n_neg,
  CAST(CASE WHEN max(fp) > 0 THEN sum((fp - fp0) * (tp + tp0)) END AS BIGINT) AS numerator FROM a3 {on}){tail}"""


_SCORES = "SELECT {k}n_pos, n_neg, numerator, CAST(numerator AS DOUBLE) / nullif(2 * n_pos * n_neg, 0) AS auroc FROM area"


@query(sql("P", "," + _auroc_sql("P") + "\n" + _SCORES.format(k="")))
def auroc_quality(spark, sf_dir):
    return metrics.auroc(tables.predictions(spark, sf_dir))


@query(sql("PT", "," + _auroc_sql("PT", "lang") + "\n" + _SCORES.format(k="lang, ")))
def auroc_toxic_by_lang(spark, sf_dir):
    return metrics.auroc(tables.predictions(spark, sf_dir, "toxic"), by=["lang"])


@query(sql("P", """, s AS (SELECT score, sum(label) AS pos, count(*) AS n FROM P GROUP BY score),
c AS (SELECT score, pos, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS k FROM s),
m AS (SELECT tp, max(CASE WHEN tp > 0 THEN CAST(tp AS DOUBLE) / k ELSE 0 END) AS pre FROM c GROUP BY tp),
l AS (SELECT tp, pre, lag(tp, 1, 0) OVER (ORDER BY tp) AS tp0, lag(pre, 1, 1) OVER (ORDER BY tp) AS pre0 FROM m)
SELECT round(sum((tp - tp0) / CAST((SELECT max(tp) FROM m) AS DOUBLE) * (pre + pre0) / 2), 9) AS aupr FROM l"""))  # fmt: skip
def aupr_quality(spark, sf_dir):
    return metrics.aupr(tables.predictions(spark, sf_dir)).select(F.round("aupr", 9).alias("aupr"))


@query(sql("P", """SELECT round(sum(CASE WHEN a.score > b.score THEN 2 WHEN a.score = b.score THEN 1 ELSE 0 END) / (2.0 * count(*)), 9) AS auroc
FROM P a JOIN P b ON a.label > 0 AND b.label <= 0"""))  # fmt: skip
def rank_auroc_quality(spark, sf_dir):
    return metrics.rank_auroc(tables.predictions(spark, sf_dir)).select(F.round("auroc", 9).alias("auroc"))


_PRF = """, c AS (SELECT grp, count(*) FILTER (label > 0) AS y, count(*) FILTER (score > 0.0001) AS p, count(*) FILTER (label > 0 AND score > 0.0001) AS hit FROM G GROUP BY grp),
k AS (SELECT * FROM c WHERE y > 0 OR p > 0),
r AS (SELECT *, CASE WHEN p <= 0 THEN 1.0 ELSE CAST(hit AS DOUBLE) / p END AS pre, CASE WHEN y <= 0 THEN 1.0 ELSE CAST(hit AS DOUBLE) / y END AS rec FROM k),
f AS (SELECT *, CASE WHEN pre + rec > 0 THEN 2 * pre * rec / (pre + rec) ELSE 0.0 END AS f FROM r),
t AS (SELECT sum(y) AS y, sum(p) AS p, sum(hit) AS hit, avg(f) AS mf, avg(pre) AS mp, avg(rec) AS mr FROM f),
u AS (SELECT *, CASE WHEN p <= 0 THEN 1.0 ELSE CAST(hit AS DOUBLE) / p END AS pre, CASE WHEN y <= 0 THEN 1.0 ELSE CAST(hit AS DOUBLE) / y END AS rec FROM t)
"""
_ALL = "round(CASE WHEN pre + rec > 0 THEN 2 * pre * rec / (pre + rec) ELSE 0.0 END, 9) AS {a}_f, round(pre, 9) AS {a}_precision, round(rec, 9) AS {a}_recall, round(mf, 9) AS {b}_f, round(mp, 9) AS {b}_precision, round(mr, 9) AS {b}_recall"


def _rounded(df: DataFrame, digits: int = 9, skip: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes])


@query(sql("G", _PRF + "SELECT " + _ALL.format(a="pooled", b="mean") + " FROM u"))
def prf_pooled(spark, sf_dir):
    return _rounded(metrics.prf(tables.signed(tables.predictions(spark, sf_dir))))


@query(sql("G", _PRF + "SELECT grp, y, p, hit, round(pre, 9) AS precision, round(rec, 9) AS recall, round(f, 9) AS f FROM f"))
def prf_per_type(spark, sf_dir):
    return _rounded(metrics.prf_by_type(tables.signed(tables.predictions(spark, sf_dir))))


@query(sql("G", _PRF + "SELECT " + _ALL.format(a="micro", b="macro") + " FROM u"))
def prf_conventional_aliases(spark, sf_dir):
    return _rounded(metrics.conventional(metrics.prf(tables.signed(tables.predictions(spark, sf_dir)))))


_DRAWS = """, d0 AS (SELECT score, label, b AS replicate, ((doc_id % 1000003) * 7919 + b * 104729 + 7) % 1000003 AS h FROM P, (SELECT unnest(range(20)) AS b)),
d1 AS (SELECT *, ((h * h % 1000003) * 31 + h * 17 + replicate) % 1000003 / 1000003.0::DOUBLE AS u FROM d0),
d AS (SELECT score, label, replicate, """ + " + ".join(f"CASE WHEN u >= {c!r} THEN 1 ELSE 0 END" for c in metrics.POISSON) + " AS w FROM d1),\ndw AS (SELECT * FROM d WHERE w > 0),\n"


@query(sql("P", _DRAWS + _auroc_sql("dw", "replicate", "w") + "\n" + _SCORES.format(k="replicate, ")))
def bootstrap_auroc(spark, sf_dir):
    return metrics.bootstrap_auroc(tables.predictions(spark, sf_dir), "doc_id")


@query(sql("P", "," + _auroc_sql("P", "source") + """
SELECT round(avg(CAST(numerator AS DOUBLE) / nullif(2 * n_pos * n_neg, 0)), 9) AS auroc_mean, round(stddev_pop(CAST(numerator AS DOUBLE) / nullif(2 * n_pos * n_neg, 0)), 9) AS auroc_std FROM area"""))
def fold_mean_std(spark, sf_dir):
    return _rounded(metrics.mean_std(metrics.auroc(tables.predictions(spark, sf_dir), by=["source"]), ["auroc"]))


def _fields_sql(source: str, by: str, w: str = "1") -> str:
    n = lambda c: f"sum(CASE WHEN {c} THEN {w} ELSE 0 END)"
    rate = "CASE WHEN p <= 0 THEN 1.0 ELSE CAST(hit AS DOUBLE) / p END AS pre, CASE WHEN y <= 0 THEN 1.0 ELSE CAST(hit AS DOUBLE) / y END AS rec"
    f = "CASE WHEN pre + rec > 0 THEN 2 * pre * rec / (pre + rec) ELSE 0.0 END"
    cells = ", ".join(f"round(avg({x}), 6) AS {x}_mean, round(stddev_pop({x}), 6) AS {x}_std" for x in metrics.FIELDS)
    return f"""{_auroc_sql(source, by, w)},
c AS (SELECT {by}, grp, {n('label > 0')} AS y, {n('score > 0.0001')} AS p, {n('label > 0 AND score > 0.0001')} AS hit FROM {source} GROUP BY {by}, grp),
r AS (SELECT *, {rate} FROM c WHERE y > 0 OR p > 0), t AS (SELECT {by}, sum(y) AS y, sum(p) AS p, sum(hit) AS hit, avg({f}) AS mean_f, avg(pre) AS mean_precision, avg(rec) AS mean_recall FROM r GROUP BY {by}),
u AS (SELECT *, {rate} FROM t),
x AS (SELECT CAST(numerator AS DOUBLE) / nullif(2 * n_pos * n_neg, 0) AS auroc, {f} AS pooled_f, pre AS pooled_precision, rec AS pooled_recall, mean_f, mean_precision, mean_recall FROM area FULL JOIN u USING ({by}))
SELECT {cells} FROM x"""


def _signed_by(spark, sf_dir):
    rows = tables.predictions(spark, sf_dir)
    return rows.select("doc_id", "lang", (F.col("score") - 2000).alias("score"), "label", F.col("source").alias("grp"))


@query(sql("P", ", GL AS (SELECT doc_id, lang, score - 2000 AS score, label, source AS grp FROM P), " + _fields_sql("GL", "lang")))
def fold_fields_mean_std(spark, sf_dir):
    return _rounded(metrics.mean_std(metrics.fields_by(_signed_by(spark, sf_dir), ["lang"]), list(metrics.FIELDS)), 6)


@query(sql("P", _DRAWS.replace("score, label", "score - 2000 AS score, label, source AS grp", 1).replace("score, label, replicate", "score, label, grp, replicate") + _fields_sql("dw", "replicate", "w")))
def bootstrap_fields(spark, sf_dir):
    return _rounded(metrics.bootstrap_fields(_signed_by(spark, sf_dir), "doc_id"), 6)


@query(sql("G", """, s AS (SELECT (score / 2000) AS s, label > 0.5 AS y FROM G)
SELECT round(avg(CASE WHEN y = (s > 0) THEN 0.0 ELSE 1.0 END), 9) AS error,
 round(1 - coalesce(2.0 * count(*) FILTER (y AND s > 0) / nullif(count(*) FILTER (y) + count(*) FILTER (s > 0), 0), 0), 9) AS f_loss,
 round(avg(pow(s - CASE WHEN y THEN 1 ELSE -1 END, 2)), 6) AS squared, round(avg(ln(1 + exp(-s * CASE WHEN y THEN 1 ELSE -1 END))), 6) AS logistic FROM s"""))
def prediction_losses(spark, sf_dir):
    rows = tables.signed(tables.predictions(spark, sf_dir)).withColumn("score", F.col("score") / 2000)
    return metrics.losses(rows, cut=0.5).select(F.round("error", 9).alias("error"), F.round("f_loss", 9).alias("f_loss"), F.round("squared", 6).alias("squared"), F.round("logistic", 6).alias("logistic"))


@query(sql("P", "SELECT CASE WHEN min(label) <= -0.8 AND max(label) > 0.8 THEN 0.0 WHEN min(label) >= -0.2 AND max(label) > 0.8 THEN 0.5 ELSE 0.0 END::DOUBLE AS threshold FROM P"))
def label_threshold(spark, sf_dir):
    return metrics.threshold_of(tables.predictions(spark, sf_dir))


@query(sql("P", "," + _auroc_sql("k") .replace("a0 AS", "k AS (SELECT 1.0 AS score, label FROM P), a0 AS", 1) + "\n" + _SCORES.format(k="")))
def constant_auroc(spark, sf_dir):
    return metrics.auroc(learn.constant(tables.predictions(spark, sf_dir)))


# Seen tables and labels ------------------------------------------------------------------------------


def _seen(spark, sf_dir):
    return labels.seen_from_counts(tables.tokens(spark, sf_dir).filter("domain = 'old'"))


@query(sql("S", "SELECT fr, en, n, p FROM S"))
def seen_pairs(spark, sf_dir):
    return _seen(spark, sf_dir)


@query(sql("S", """, r AS (SELECT fr, en, p, row_number() OVER (PARTITION BY fr ORDER BY p DESC, en) AS k, max(p) OVER (PARTITION BY fr) AS top,
 coalesce(sum(p) OVER (PARTITION BY fr ORDER BY p DESC, en ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT fr, en, n / sum(n) OVER (PARTITION BY fr) AS p FROM S))
SELECT fr, en, round(p, 9) AS p FROM r WHERE k = 1 OR (k <= 5 AND round(before, 9) < 0.6 AND round(p / top, 9) >= 0.4)"""))
def seen_pruned(spark, sf_dir):
    return _rounded(labels.prune(_seen(spark, sf_dir), 5, 0.6, 0.4))


@query(sql("S", "SELECT fr, en, p FROM (SELECT *, max(p) OVER (PARTITION BY fr) AS top FROM S) WHERE p >= top"))
def mfs_pairs(spark, sf_dir):
    return labels.mfs(_seen(spark, sf_dir))


def _labelled(spark, sf_dir):
    return labels.label_new_sense(tables.tokens(spark, sf_dir).filter("domain = 'new'"), _seen(spark, sf_dir))


_LABELLED = "L AS (SELECT t.*, CASE WHEN s.fr IS NULL THEN 1 ELSE -1 END AS label FROM T t LEFT JOIN S s ON t.fr = s.fr AND t.en = s.en WHERE t.domain = 'new' AND t.fr IN (SELECT fr FROM S))"


@query(sql("S", f", {_LABELLED} SELECT fr, en, label, count(*) AS n FROM L GROUP BY ALL"))
def label_new_sense(spark, sf_dir):
    return _labelled(spark, sf_dir).groupBy("fr", "en", "label").agg(F.count("*").alias("n"))


@query(sql("S", """, M AS (SELECT fr, en FROM (SELECT *, max(p) OVER (PARTITION BY fr) AS top FROM S) WHERE p >= top)
SELECT t.fr, CASE WHEN m.fr IS NULL THEN 1 ELSE -1 END AS label, count(*) AS n FROM T t LEFT JOIN M m ON t.fr = m.fr AND t.en = m.en WHERE t.domain = 'new' AND t.fr IN (SELECT fr FROM S) GROUP BY ALL"""))
def label_mfs(spark, sf_dir):
    rows = labels.label_mfs(tables.tokens(spark, sf_dir).filter("domain = 'new'"), _seen(spark, sf_dir))
    return rows.groupBy("fr", "label").agg(F.count("*").alias("n"))


@query(sql("T", "SELECT fr, count(*) AS n FROM T WHERE o_orderdate >= TIMESTAMP '1999-01-01' AND fr NOT IN (SELECT fr FROM T WHERE o_orderdate < TIMESTAMP '1995-03-01') GROUP BY fr"))
def unseen_phrases(spark, sf_dir):
    rows = tables.tokens(spark, sf_dir)
    early = rows.filter(F.col("o_orderdate") < F.lit("1995-03-01").cast("timestamp_ntz"))
    return labels.unseen_phrases(rows.filter("domain = 'new'"), labels.seen_from_counts(early))


@query(sql("S", f", {_LABELLED} SELECT l_returnflag, count(*) AS n, count(*) FILTER (label > 0) AS n_pos, count(*) FILTER (label <= 0) AS n_neg, floor(count(*) FILTER (label > 0) * 1000 / CAST(count(*) AS DOUBLE)) / 10 AS percent_pos FROM L GROUP BY l_returnflag"))
def class_balance(spark, sf_dir):
    return metrics.class_balance(_labelled(spark, sf_dir), by=["l_returnflag"])


# Features --------------------------------------------------------------------------------------------


def _type_rows(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    rows = part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("fr"), F.explode(F.array(F.struct(F.lit("size").alias("name"), F.col("p_size").cast("double").alias("value")), F.struct(F.lit("price").alias("name"), F.col("p_retailprice").alias("value")))).alias("x"))
    return rows.select("fr", F.lit("part").alias("source"), "x.name", F.lit("1").alias("text"), "x.value")


@query(sql("T", """SELECT domain, 'part___type_' || name AS name, count(*) AS n, round(sum(value), 4) AS total FROM T
JOIN (SELECT 'p' || p_partkey AS fr, 'size' AS name, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT 'p' || p_partkey, 'price', p_retailprice FROM part) USING (fr) GROUP BY ALL"""))
def type_feature_join(spark, sf_dir):
    counts = tables.tokens(spark, sf_dir).groupBy("fr", "domain").agg(F.count("*").alias("times"))  # tokens that are alike meet their features once
    rows = features.type_features(counts, _type_rows(spark, sf_dir), ["domain", "times"])
    return rows.groupBy("domain", "name").agg(F.sum("times").alias("n"), F.round(F.sum(F.col("value") * F.col("times")), 4).alias("total"))


def _token_rows(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("line_no"), F.lit("events").alias("source"), F.col("event_type").alias("name"), F.lit("1").alias("text"), "value")


@query(sql("O", "SELECT line_no, fr, 'events___token_' || event_type AS name, value FROM O JOIN events ON line_no = event_id"))
def token_feature_positional_join(spark, sf_dir):
    rows = features.token_features(tables.order_tokens(spark, sf_dir), _token_rows(spark, sf_dir), ["line_no", "fr"])
    return rows.select("line_no", "fr", "name", "value")


@query(sql("O", "SELECT count(*) FILTER (l IS NULL) AS extra, count(*) FILTER (e IS NULL) AS missing FROM (SELECT line_no AS l FROM O) FULL JOIN (SELECT event_id AS e FROM events) ON l = e"))
def token_feature_line_check(spark, sf_dir):
    return features.missing_lines(tables.order_tokens(spark, sf_dir), _token_rows(spark, sf_dir))


@query(sql("O", "SELECT fr, domain, line_no FROM (SELECT *, row_number() OVER (PARTITION BY fr ORDER BY domain, line_no) AS k FROM O) WHERE k <= 5"))
def cap_per_type(spark, sf_dir):
    return features.capped(tables.order_tokens(spark, sf_dir), 5).select("fr", "domain", "line_no")


@query("""SELECT event_id, event_type || ':x' AS name, CAST(user_id % 50 AS VARCHAR) AS text, CAST(user_id % 50 AS DOUBLE) AS value FROM events
UNION ALL SELECT event_id, 'flag', '1', 1.0 FROM events UNION ALL SELECT event_id, 'twice', '2', 2.0 FROM events""")
def vw_feature_parse(spark, sf_dir):
    items = F.split(F.concat(F.col("event_type"), F.lit(":x:"), (F.col("user_id") % 50).cast("string"), F.lit(" flag twice:1 twice:2 ")), " ")
    return features.parsed(table(spark, sf_dir, "events").select("event_id", items.alias("items")), "items", ["event_id"]).select("event_id", "name", "text", "value")


@query("""SELECT user_id, string_agg(CASE WHEN n = 1 THEN event_type ELSE event_type || ':' || n END, ' ' ORDER BY event_type) AS line
FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id""")
def vw_feature_render(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("name")).agg(F.count("*").alias("n"))
    return features.rendered(rows.select("user_id", "name", F.col("n").cast("string").alias("text"), F.col("n").cast("double").alias("value")), ["user_id"])


@query(sql("O", """SELECT line_no AS key, CASE WHEN en = 'F' THEN '1' ELSE '-1' END || ' | phrase_id=' || fr || ' ' || o_orderpriority || ' status:2' AS line FROM O""".replace("o_orderpriority", "replace(o_orderpriority, ' ', '_')")))
def vw_example_lines(spark, sf_dir):
    rows = tables.order_tokens(spark, sf_dir).withColumn("label", F.when(F.col("en") == "F", 1).otherwise(-1))
    items = [F.struct(F.translate("o_orderpriority", " ", "_").alias("name"), F.lit("1").alias("text"), F.lit(1.0).alias("value")), F.struct(F.lit("status").alias("name"), F.lit("2").alias("text"), F.lit(2.0).alias("value")), F.struct(F.lit("zero").alias("name"), F.lit("0").alias("text"), F.lit(0.0).alias("value"))]
    sparse = rows.select("key", F.explode(F.array(*items)).alias("x")).select("key", "x.*")
    return writers.example_lines(rows, sparse)


@query(sql("C", """, w AS (SELECT domain, word, count(*) AS n FROM (SELECT domain, unnest(tokens) AS word FROM C) GROUP BY ALL),
a AS (SELECT word, log10(n / CAST(sum(n) OVER () AS DOUBLE)) AS lp FROM w WHERE domain = 'old'), b AS (SELECT word, n, log10(n / CAST(sum(n) OVER () AS DOUBLE)) AS lp FROM w WHERE domain = 'new')
SELECT b.word AS fr, round(coalesce(a.lp, -20), 9) AS lp_old, round(b.lp, 9) AS lp_new, round(b.lp - coalesce(a.lp, -20), 9) AS lp_diff FROM b LEFT JOIN a ON a.word = b.word WHERE b.n >= 3"""))
def rel_freq_log10(spark, sf_dir):
    docs = tables.corpus(spark, sf_dir)
    counts = {d: bitext.word_counts(docs.filter(F.col("domain") == d)) for d in ("old", "new")}
    lm = {d: joint.normalized(c.withColumn("p", F.col("n").cast("double")), "p").select("word", F.log10("p").alias("logprob"), "n") for d, c in counts.items()}
    return _rounded(features.relative_frequency(lm["new"].filter("n >= 3").select(F.col("word").alias("fr")), lm["old"], lm["new"]))


@query("""SELECT event_type AS fr, """ + ", ".join(
    f"count({e}) AS {n}_count, round(avg({e}), 6) AS {n}_mean, round(stddev_pop({e}), 6) AS {n}_std, round(min({e}), 6) AS {n}_min, round(max({e}), 6) AS {n}_max, round(sum({e}), 6) AS {n}_sum"
    for n, e in (("gb", "value"), ("gb_gs", "(value - value / 2)"), ("db_gb", "(value * 3 - value)"), ("db_gs", "(value * 3 + value / 2 - value - value / 4)"))) + " FROM events GROUP BY event_type")
def ppl_type_stats(spark, sf_dir):
    v = F.col("value")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("fr"), *[c.alias(n) for n, c in features.series(v, v / 2, v * 3, v / 4).items()])
    return features.series_stats(rows, ["gb", "gb_gs", "db_gb", "db_gs"], digits=6)


@query(sql("V", """, x AS (SELECT conv_id, turn, tokens, turn % 3 AS st FROM V)
SELECT conv_id, turn, CAST(len(tokens[st + 1]) AS DOUBLE) AS gen_at, CAST(len(tokens[st + 1]) * 2 AS DOUBLE) AS dom_at, CAST(len(tokens[st + 2]) AS DOUBLE) AS gen_after, CAST(len(tokens[st + 2]) * 2 AS DOUBLE) AS dom_after,
CAST(len(tokens[st + 1]) AS DOUBLE) AS diff_at, CAST(len(tokens[st + 2]) AS DOUBLE) AS diff_after FROM x"""))
def ppl_token_span(spark, sf_dir):
    from lexshift.functions.scalar import words

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("snt_id"), (F.col("turn") % 3).alias("fr_start"), (F.col("turn") % 3).alias("fr_end"), words(F.col("text")).alias("w"))
    scores = rows.select("snt_id", F.transform("w", lambda x: F.length(x).cast("double")).alias("gen"), F.transform("w", lambda x: F.length(x) * 2.0).alias("dom"))
    return features.span_values(rows, scores).select("conv_id", "turn", "gen_at", "dom_at", "gen_after", "dom_after", "diff_at", "diff_after")


@query("""SELECT 'u' || user_id AS fr, count(value) AS flow_count, round(avg(-value), 6) AS flow_mean, round(stddev_pop(-value), 6) AS flow_std, round(min(-value), 6) AS flow_min, round(max(-value), 6) AS flow_max, round(sum(-value), 6) AS flow_sum FROM events GROUP BY user_id""")
def flow_stats(spark, sf_dir):
    diffs = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("word"), F.col("value").alias("diff"))
    return features.series_stats(features.flow_rows(diffs), ["flow"], digits=6)


@query(sql("O", """SELECT name, count(*) AS n FROM (SELECT en AS name FROM O UNION ALL SELECT 'old_' || en FROM O WHERE domain = 'old') GROUP BY name"""))
def domain_adapt_features(spark, sf_dir):
    return features.adapted(tables.order_tokens(spark, sf_dir).withColumn("name", F.col("en"))).groupBy("name").agg(F.count("*").alias("n"))


# Buckets and folds -----------------------------------------------------------------------------------

_BOUNDS = """z AS (SELECT name, value, n FROM (SELECT name, value, count(*) AS n FROM F GROUP BY ALL) UNION ALL SELECT name, 0.0, (SELECT count(*) FROM lineitem) - count(*) FROM F GROUP BY name HAVING (SELECT count(*) FROM lineitem) > count(*)),
c AS (SELECT name, value, sum(n) AS n FROM z GROUP BY name, value),
r AS (SELECT name, value, n, CAST(sum(n) OVER (PARTITION BY name ORDER BY value) AS BIGINT) AS after, CAST(sum(n) OVER (PARTITION BY name) AS BIGINT) AS total FROM c),
k AS (SELECT unnest(range(10)) AS k),
bounds AS (SELECT DISTINCT name, value AS boundary FROM r JOIN k ON k.k < least(10, total) AND (k.k * total) // least(10, total) >= after - n AND (k.k * total) // least(10, total) < after)"""


def _bounds(spark, sf_dir):
    return buckets.boundaries(tables.item_features(spark, sf_dir), table(spark, sf_dir, "lineitem").count())


@query(sql("F", f", {_BOUNDS} SELECT name, boundary FROM bounds"))
def bucket_boundaries(spark, sf_dir):
    return _bounds(spark, sf_dir)


@query(sql("F", f", {_BOUNDS} SELECT l_returnflag, F.name AS feature, count(*) AS n FROM F JOIN bounds b ON F.name = b.name AND value >= boundary GROUP BY ALL"))
def bucket_apply(spark, sf_dir):
    rows = buckets.indicators(tables.item_features(spark, sf_dir), _bounds(spark, sf_dir), ["l_returnflag"])
    return rows.groupBy("l_returnflag", F.substring_index("name", ">=", 1).alias("feature")).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT CAST(CAST(l_quantity AS INT) AS VARCHAR) AS t, count(*) AS n FROM lineitem GROUP BY ALL),
r AS (SELECT t, n, CAST(sum(n) OVER (ORDER BY t) AS BIGINT) AS after, CAST(sum(n) OVER () AS BIGINT) AS total FROM c)
SELECT DISTINCT 'quantity' AS name, t AS boundary FROM r JOIN (SELECT unnest(range(10)) AS k) k ON (k.k * total) // 10 >= after - n AND (k.k * total) // 10 < after""")
def bucket_string_order(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.lit("quantity").alias("name"), F.col("l_quantity").cast("int").cast("string").alias("text"), F.col("l_quantity").alias("value"))
    return buckets.boundaries(rows, table(spark, sf_dir, "lineitem").count(), mode="text")


@query(sql("T", "SELECT fr, CAST(k % 8 AS INT) AS testfold, CAST((k % 8 + 1) % 8 AS INT) AS devfold FROM (SELECT fr, row_number() OVER (ORDER BY md5('1:' || fr), fr) - 1 AS k FROM (SELECT DISTINCT fr FROM T))"))
def fold_uneven(spark, sf_dir):
    return folds.uneven(tables.tokens(spark, sf_dir), 8)


@query(sql("O", """SELECT part, domain, count(*) AS n FROM (SELECT domain, CASE WHEN domain = 'new' THEN 'test' WHEN CAST('0x' || substr(md5('1:' || line_no), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < 0.11111 THEN 'dev' ELSE 'train' END AS part FROM O) GROUP BY ALL"""))
def fold_tr_te(spark, sf_dir):
    return folds.train_test(tables.order_tokens(spark, sf_dir), "key", "new").groupBy("part", "domain").agg(F.count("*").alias("n"))


@query()
def fold_even_split(spark, sf_dir):
    return folds.even(_labelled(spark, sf_dir), 8)


@query(sql("S", f""", {_LABELLED}, d AS (SELECT fr, label, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS test FROM L)
SELECT t.fr, coalesce(CAST(s.score AS DOUBLE), 1.0) AS score, count(*) AS n FROM d t LEFT JOIN (SELECT fr, sum(label) AS score FROM d WHERE test = 0 GROUP BY fr) s ON t.fr = s.fr WHERE t.test = 1 GROUP BY ALL"""))
def oracle_type_score(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    return learn.oracle_type(rows.filter("l_returnflag <> 'R'"), rows.filter("l_returnflag = 'R'")).groupBy("fr", "score").agg(F.count("*").alias("n"))


# Corpora and retrieval -------------------------------------------------------------------------------


def _domain_counts(spark, sf_dir, domain):
    return bitext.word_counts(tables.corpus(spark, sf_dir).filter(F.col("domain") == domain))


_WORDS = "w AS (SELECT domain, word, count(*) AS n FROM (SELECT domain, unnest(tokens) AS word FROM C) GROUP BY ALL), a AS (SELECT * FROM w WHERE domain = 'old'), b AS (SELECT * FROM w WHERE domain = 'new')"


@query(sql("C", "SELECT word, count(*) AS n FROM (SELECT unnest(tokens) AS word FROM C) GROUP BY word"))
def word_counts(spark, sf_dir):
    return bitext.word_counts(tables.corpus(spark, sf_dir))


@query(sql("C", "SELECT term, count(DISTINCT doc) AS df FROM (SELECT doc, unnest(tokens) AS term FROM C) GROUP BY term"))
def doc_freq(spark, sf_dir):
    return retrieval.doc_freq(retrieval.term_counts(tables.corpus(spark, sf_dir)))


def _cells(spark, sf_dir):
    return retrieval.term_counts(tables.corpus(spark, sf_dir), min_count=2)


_TOTALS = "d AS (SELECT *, count(*) OVER (PARTITION BY term) AS df, count(*) OVER (PARTITION BY doc) AS size, (SELECT count(DISTINCT doc) FROM N) AS nd, (SELECT count(*) FROM N) AS nc FROM N)"
_BM25 = "greatest(0.01, ln((nd - df + 0.5) / (df + 0.5))) * n * 2.5 / (n + 1.5 * (0.25 + 0.75 * size / (CAST(nc AS DOUBLE) / nd)))"


@query(sql("N", f", {_TOTALS} SELECT doc, term, round(n * ln(CAST(nd AS DOUBLE) / df), 6) AS weight FROM d"))
def tfidf(spark, sf_dir):
    return _rounded(retrieval.weigh_tfidf(_cells(spark, sf_dir)), 6)


@query(sql("N", f", {_TOTALS} SELECT doc, term, round({_BM25}, 6) AS weight FROM d"))
def bm25(spark, sf_dir):
    return _rounded(retrieval.weigh_bm25(_cells(spark, sf_dir)), 6)


@query(sql("N", f", {_TOTALS}, x AS (SELECT doc, term, {_BM25} AS weight FROM d) SELECT doc, term, round(weight / sqrt(sum(weight * weight) OVER (PARTITION BY term)), 6) AS weight FROM x"))
def term_norm(spark, sf_dir):
    return _rounded(retrieval.normalized(retrieval.weigh_bm25(_cells(spark, sf_dir))), 6)


def _page_sql(lang: str) -> str:
    return f"""{lang}_n AS (SELECT doc, term, count(*) AS n FROM (SELECT doc, unnest(tokens) AS term FROM Q WHERE lang = '{lang}') GROUP BY ALL HAVING count(*) >= 2),
{lang}_d AS (SELECT *, count(*) OVER (PARTITION BY term) AS df, count(*) OVER (PARTITION BY doc) AS size, (SELECT count(DISTINCT doc) FROM {lang}_n) AS nd, (SELECT count(*) FROM {lang}_n) AS nc FROM {lang}_n),
{lang}_w AS (SELECT doc, term, {_BM25} AS weight FROM {lang}_d), {lang}_x AS (SELECT doc, term, weight / sqrt(sum(weight * weight) OVER (PARTITION BY term)) AS weight FROM {lang}_w)"""


def _cosine_sql(a: str, b: str) -> str:
    return f"""{a}_top AS (SELECT * FROM (SELECT a, b, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank FROM
 (SELECT x.term AS a, y.term AS b, round(sum(x.weight * y.weight), 6) AS score FROM {a}_x x JOIN {b}_x y USING (doc) GROUP BY x.term, y.term)) WHERE rank <= 10)"""


def _page_weights(spark, sf_dir):
    return [staged(retrieval.normalized(retrieval.weigh_bm25(retrieval.term_counts(d, min_count=2))), "page-weights") for d in tables.page_pairs(spark, sf_dir)]


@query(sql("Q", f", {_page_sql('fr')}, {_page_sql('en')}, {_cosine_sql('fr', 'en')} SELECT a, b, score, CAST(rank AS INT) AS rank FROM fr_top"))
def cosine_topk(spark, sf_dir):
    f, e = _page_weights(spark, sf_dir)
    return retrieval.cosine_top(f, e)


@query(sql("Q", f", {_page_sql('fr')}, {_page_sql('en')}, {_cosine_sql('fr', 'en')}, {_cosine_sql('en', 'fr')} SELECT x.a AS f, x.b AS e, round(x.score * y.score, 6) AS score FROM fr_top x JOIN en_top y ON x.a = y.b AND x.b = y.a"))
def mutual_pairs(spark, sf_dir):
    f, e = _page_weights(spark, sf_dir)
    return _rounded(retrieval.mutual(retrieval.cosine_top(f, e), retrieval.cosine_top(e, f)), 6)


@query(sql("C", f""", {_WORDS}, j AS (SELECT a.n AS x, b.n AS y FROM a FULL JOIN b ON a.word = b.word)
SELECT count(*) FILTER (y IS NULL) AS old_types, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS both_types, count(*) FILTER (x IS NULL) AS new_types,
CAST(sum(greatest(coalesce(x, 0) - coalesce(y, 0), 0)) AS BIGINT) AS old_tokens, CAST(sum(least(coalesce(x, 0), coalesce(y, 0))) AS BIGINT) AS both_tokens, CAST(sum(CASE WHEN x IS NULL THEN 1 ELSE greatest(coalesce(y, 0) - x, 0) END) AS BIGINT) AS new_tokens,
count(*) FILTER (y IS NULL AND x = 1) AS old_single, count(*) FILTER (y IS NOT NULL AND x = 1) AS both_single, count(*) FILTER (x IS NULL AND y = 1) AS new_single FROM j"""))
def corpus_overlap(spark, sf_dir):
    return bitext.overlap(_domain_counts(spark, sf_dir, "old"), _domain_counts(spark, sf_dir, "new"))


@query(sql("C", f", {_WORDS} SELECT count(*) AS types, CAST(sum(n) AS BIGINT) AS tokens, count(*) FILTER (n = 1) AS singletons FROM a"))
def corpus_stats(spark, sf_dir):
    return bitext.corpus_stats(_domain_counts(spark, sf_dir, "old"))


@query(sql("C", f", {_WORDS} SELECT b.word, b.n FROM b LEFT JOIN a ON a.word = b.word WHERE a.word IS NULL"))
def oov_words(spark, sf_dir):
    return bitext.oov(_domain_counts(spark, sf_dir, "new"), _domain_counts(spark, sf_dir, "old"))


@query(sql("B", "SELECT sent, array_to_string(list_transform(list_filter(range(CAST(k AS BIGINT)), lambda i: i % 2 = 0), lambda i: i || '-' || i), ' ') AS align FROM B"))
def align_intersect(spark, sf_dir):
    rows = tables.bitext(spark, sf_dir)
    back = rows.withColumn("align", bitext.flip(F.filter("align", lambda p: p["s"] % 2 == 0)))
    return bitext.symmetrized(rows, back).select("sent", bitext.show_align(F.col("align")).alias("align"))


@query(sql("W", "SELECT f, e FROM W"))
def align_word_pairs(spark, sf_dir):
    return bitext.word_pairs(tables.bitext(spark, sf_dir), [])


@query(sql("W", "SELECT f, e, count(*) AS n FROM W GROUP BY f, e"))
def align_counts(spark, sf_dir):
    return bitext.pair_counts(tables.bitext(spark, sf_dir))


@query(sql("B", """SELECT DISTINCT sent, array_to_string(src[1:2], ' ') AS before, src[3] AS word, array_to_string(src[4:], ' ') AS after FROM B WHERE len(src) >= 3"""))
def kwic(spark, sf_dir):
    rows = tables.bitext(spark, sf_dir).filter(F.size("src") >= 3)
    spans = rows.select(F.col("sent").alias("snt_id"), F.lit(2).alias("fr_start"), F.lit(2).alias("fr_end"))
    return bitext.kwic(spans, rows.select(F.col("sent").alias("snt_id"), F.col("src").alias("tokens"))).withColumnRenamed("snt_id", "sent")


# Joint tables, distributions, phrases, flow ----------------------------------------------------------


def _joint(spark, sf_dir, domain):
    counts = tables.tokens(spark, sf_dir).filter(F.col("domain") == domain).groupBy("fr", "en").agg(F.count("*").cast("double").alias("joint"))
    return joint.normalized(counts, "joint")


_TOPS = """k AS (SELECT domain, fr, en, row_number() OVER (PARTITION BY domain, fr ORDER BY count(*) DESC, en) AS k FROM T GROUP BY domain, fr, en),
l AS (SELECT domain, fr, list(en ORDER BY k) FILTER (k <= 5) AS t5, list(en ORDER BY k) FILTER (k <= 2) AS t2 FROM k GROUP BY domain, fr), o AS (SELECT * FROM l WHERE domain = 'old'), n AS (SELECT * FROM l WHERE domain = 'new')"""


@query(sql("T", f""", {_TOPS} SELECT fr, CASE WHEN n.t5 IS NULL THEN 0 ELSE 1 END AS pbml, CASE WHEN coalesce(o.t5[1], '') = coalesce(n.t5[1], '') THEN 0 ELSE 1 END AS max_change,
CASE WHEN o.t5 IS NULL OR n.t5 IS NULL THEN 0.0 ELSE len(list_intersect(o.t5, n.t5)) / 5.0 END::DOUBLE AS top5_overlap, CASE WHEN o.t5 IS NULL OR n.t5 IS NULL THEN 0.0 ELSE len(list_intersect(o.t2, n.t2)) / 2.0 END::DOUBLE AS top2_overlap FROM o FULL JOIN n USING (fr)"""))
def joint_change_features(spark, sf_dir):
    return joint.change_features(tables.tokens(spark, sf_dir).select("fr"), _joint(spark, sf_dir, "old"), _joint(spark, sf_dir, "new"))


@query(sql("T", """, c AS (SELECT domain, fr, en, count(*) / CAST(sum(count(*)) OVER (PARTITION BY domain) AS DOUBLE) AS p FROM T GROUP BY domain, fr, en)
SELECT round(sum(greatest(coalesce(o.p, 1e-9), 1e-9) * ln(greatest(coalesce(o.p, 1e-9), 1e-9) / greatest(n.p, 1e-9))), 6) AS kl FROM (SELECT * FROM c WHERE domain = 'new') n LEFT JOIN (SELECT * FROM c WHERE domain = 'old') o ON o.fr = n.fr AND o.en = n.en"""))
def kl_divergence(spark, sf_dir):
    old, new = (_joint(spark, sf_dir, d).withColumnRenamed("joint", "p") for d in ("old", "new"))
    return _rounded(joint.divergence(old, new, ["fr", "en"]), 6)


@query(sql("T", "SELECT 'f' AS side, fr AS word, count(*) AS total FROM T GROUP BY fr UNION ALL SELECT 'e', en, count(*) FROM T GROUP BY en"))
def marginals(spark, sf_dir):
    return joint.marginals(tables.tokens(spark, sf_dir).groupBy(F.col("fr").alias("f"), F.col("en").alias("e")).agg(F.count("*").alias("n")))


@query("""SELECT vec_id, dim, round(cume_dist() OVER (PARTITION BY dim ORDER BY v), 9) AS cdf FROM (SELECT vec_id, unnest(embedding) AS v, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS dim FROM embeddings)""")
def ecdf_columns(spark, sf_dir):
    rows = copula.ecdf(copula.long_form(table(spark, sf_dir, "embeddings"), "embedding", "vec_id"))
    return rows.select("vec_id", "dim", F.round("cdf", 9).alias("cdf"))


@query(sql("H", "SELECT fr, en, round(greatest(n / ne * nf, n / nf * ne), 6) AS joint, round(greatest(n / ne * nf, n / nf * ne) / nf, 6) AS prob FROM H"))
def phrase_joint_prob(spark, sf_dir):
    return _rounded(phrases.probabilities(tables.phrases(spark, sf_dir)).select("fr", "en", "joint", "prob"), 6)


@query()
def phrase_relative_entropy(spark, sf_dir):
    return phrases.relative_entropy(tables.phrases(spark, sf_dir))


def _flow(spark, sf_dir):
    f, e = tables.page_pairs(spark, sf_dir)
    count = lambda d: d.select(F.col("doc").alias("page"), F.explode("tokens").alias("word")).groupBy("page", "word").agg(F.count("*").alias("n"))
    place = lambda d, c: d.select("doc", F.posexplode("tokens").alias("pos", c))
    dictionary = place(f, "f").join(place(e, "e"), ["doc", "pos"]).groupBy("f", "e").agg(F.count("*").alias("score"))
    return flow.residuals(count(f), count(e), dictionary)


@query()
def flow_residual(spark, sf_dir):
    return _flow(spark, sf_dir)


#: Neighbouring parts of one problem: with 25 nations at most 125 lines, so recover()'s bound cuts nothing off.
QP_PARTS = 5


def _qp(spark, sf_dir):
    pairs = tables.tokens(spark, sf_dir).groupBy("fr", "en").agg(F.count_if(F.col("domain") == "old").alias("old"), F.count_if(F.col("domain") == "new").alias("new"))
    block = F.floor((F.expr("CAST(substring(fr, 2) AS BIGINT)") - 1) / QP_PARTS)
    return pairs.select(F.concat(F.lit("parts_"), block.cast("string")).alias("grp"), F.xxhash64("fr", "en").alias("line_no"), F.col("en").alias("e"), F.col("fr").alias("f"), "old", "new")


@query()
def joint_qp(spark, sf_dir):
    return joint.recover(_qp(spark, sf_dir))


@query()
def topic_model(spark, sf_dir):
    state, k = topics.fit(tables.bitext(spark, sf_dir), topics=4, sweeps=20, splits=1)
    return state.select("doc", "pos", "f", "e", topics.topic(k))


@query()
def lsa_ecdf(spark, sf_dir):
    low = staged(copula.projected(table(spark, sf_dir, "embeddings"), "embedding", "vec_id"), "lsa")
    return copula.ecdf(copula.long_form(low, "factors", "vec_id"))


@query()
def vine_pairs(spark, sf_dir):
    return copula.vine_pairs(table(spark, sf_dir, "embeddings"), "embedding")


# Files: written in a format, read back --------------------------------------------------------------


def _written(spark, rows: DataFrame, name: str) -> str:
    path = scratch(spark, name)
    writers.write_lines(rows, path)
    return path


@query(sql("S", "SELECT fr, en, round(p, 9) AS p FROM S"))
def seen_file(spark, sf_dir):
    rows = readers.seen(spark, _written(spark, writers.seen_lines(_seen(spark, sf_dir)), "seen"))
    return _rounded(rows.select("fr", "en", F.col("p").cast("double").alias("p")))


@query(sql("T", "SELECT fr AS f, en AS e, round(n / sum(n) OVER (PARTITION BY fr), 9) AS p FROM (SELECT fr, en, count(*) AS n FROM T GROUP BY ALL)"))
def dictionary_file(spark, sf_dir):
    counts = tables.tokens(spark, sf_dir).groupBy("fr", "en").agg(F.count("*").alias("n"))
    lines = counts.select(F.concat_ws(" ", F.col("n").cast("string"), "fr", "en").alias("line")).union(spark.createDataFrame([("too few",), ("",), ("x a b",)], "line string"))
    return _rounded(readers.dictionary(spark, _written(spark, lines, "dictionary")))


@query(sql("T", "SELECT fr, en, CAST(n AS DOUBLE) AS joint, CAST(n * 2 AS DOUBLE) AS p_ef, CAST(n * 3 AS DOUBLE) AS p_fe FROM (SELECT fr, en, count(*) AS n FROM T GROUP BY ALL) WHERE fr IN (SELECT 'p' || p_partkey FROM part WHERE p_size > 25)"))
def joint_table_file(spark, sf_dir):
    counts = tables.tokens(spark, sf_dir).groupBy("fr", "en").agg(F.count("*").alias("n"))
    path = _written(spark, counts.select(F.concat_ws(" ", *[(F.col("n") * k).cast("string") for k in (1, 2, 3)], "fr", "en").alias("line")), "joint")
    wanted = table(spark, sf_dir, "part").filter("p_size > 25").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("fr"))
    return readers.joint_table(spark, path, wanted).select("fr", "en", "joint", "p_ef", "p_fe")


@query("SELECT 'e' || event_id AS word, value AS diff FROM events WHERE value IS NOT NULL")
def flow_file(spark, sf_dir):
    events = table(spark, sf_dir, "events").filter("value IS NOT NULL")
    lines = events.select(F.concat(F.lit("e"), F.col("event_id").cast("string"), F.lit(" "), F.col("value").cast("string")).alias("line"))
    return readers.flow_output(spark, _written(spark, spark.createDataFrame([("# word diff",)], "line string").union(lines), "flow")).select("word", "diff")


@query("SELECT event_type AS grp, count(*) AS n, round(sum(value), 4) AS total, count(*) FILTER (user_id % 2 = 1) AS pos FROM events WHERE value IS NOT NULL GROUP BY event_type")
def predictions_file(spark, sf_dir):
    events = table(spark, sf_dir, "events").filter("value IS NOT NULL")
    lines = events.select(F.concat_ws(" ", F.col("value").cast("string"), (F.col("user_id") % 2).cast("string"), "event_type").alias("line"))
    rows = readers.predictions(spark, _written(spark, lines, "predictions"))
    return rows.groupBy("grp").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("total"), F.count_if(F.col("label") > 0).alias("pos"))


@query("SELECT event_type AS word, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 9) AS p FROM events GROUP BY event_type")
def page_shares_file(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    lines = counts.select(F.concat_ws(" ", F.col("n").cast("string"), "event_type").alias("line"))
    return _rounded(readers.page_shares(spark, _written(spark, lines, "page")).select("word", "p"))


@query(sql("T", """SELECT f, e, old, new FROM (SELECT fr AS f, en AS e, count(*) FILTER (domain = 'old') AS old, count(*) FILTER (domain = 'new') AS new, row_number() OVER (ORDER BY fr, en) AS k FROM T GROUP BY fr, en) WHERE k <= 300"""))
def pair_counts_file(spark, sf_dir):
    pairs = tables.tokens(spark, sf_dir).groupBy("fr", "en").agg(F.count_if(F.col("domain") == "old").alias("old"), F.count_if(F.col("domain") == "new").alias("new"))
    lines = pairs.orderBy("fr", "en").select(F.concat(F.concat_ws("__", "fr", "en"), F.lit(" "), F.col("old").cast("string"), F.lit(" "), F.col("new").cast("string")).alias("line"))
    return readers.pair_counts(spark, _written(spark, lines, "pairs")).select("f", "e", "old", "new")


def _line(*columns, sep: str = "\t"):
    return F.concat_ws(sep, *[(c if not isinstance(c, str) else F.col(c)).cast("string") for c in columns]).alias("line")


@query("SELECT l_orderkey AS snt_id, l_linenumber AS fr_start, l_linenumber + 1 AS fr_end, 0 AS en_start, 1 AS en_end, 'p ' || l_partkey AS fr, 's ' || l_suppkey AS en, count(*) AS n FROM lineitem GROUP BY ALL")
def token_file(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    rows = items.select(_line("l_orderkey", "l_linenumber", F.col("l_linenumber") + 1, F.lit(0), F.lit(1), F.concat(F.lit("p "), F.col("l_partkey")), F.concat(F.lit("s "), F.col("l_suppkey"))))
    return readers.tokens(spark, _written(spark, rows, "tokens")).groupBy("snt_id", "fr_start", "fr_end", "en_start", "en_end", "fr", "en").agg(F.count("*").alias("n")).withColumn("snt_id", F.col("snt_id").cast("long"))


@query("SELECT DISTINCT 'u ' || user_id AS fr FROM events")
def type_list_file(spark, sf_dir):
    path = scratch(spark, "types")
    writers.write_lines(table(spark, sf_dir, "events").select(F.concat(F.lit("u "), F.col("user_id").cast("string")).alias("line")), path, gzip=True)
    return readers.types(spark, path)


@query("SELECT 'new' AS domain, 'part' AS source, 'p' || p_partkey AS fr, 'size' AS name, CAST(p_size AS DOUBLE) AS value FROM part WHERE p_size <> 0 UNION ALL SELECT 'new', 'part', 'p' || p_partkey, 'price', p_retailprice FROM part WHERE p_retailprice <> 0")
def type_feature_file(spark, sf_dir):
    rows = _type_rows(spark, sf_dir).withColumn("text", F.col("value").cast("string"))
    path = _written(spark, writers.type_feature_lines(rows), "new-old.type.part")
    return readers.type_features(spark, path).select("domain", "source", "fr", "name", "value")


@query("SELECT 'new' AS domain, 'events' AS source, event_id + 1 AS line_no, event_type AS name, CAST(user_id AS DOUBLE) AS value FROM events WHERE user_id % 3 <> 0")
def token_feature_file(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("line_no", F.col("event_id") + 1)  # ids are 0, 1, ...
    some = events.filter("user_id % 3 <> 0").select("line_no", F.col("event_type").alias("name"), F.col("user_id").cast("string").alias("text"), F.col("user_id").cast("double").alias("value"))
    path = _written(spark, writers.token_feature_lines(events, some), "new.token.events")
    return readers.token_features(spark, path).select("domain", "source", "line_no", "name", "value")


def _phrase_file(spark, sf_dir):
    show = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    rows = tables.phrases(spark, sf_dir).select(F.concat_ws(" ||| ", "fr", "en", show(F.col("scores")), F.lit("0-0"), show(F.col("counts"))).alias("line"))
    return readers.phrase_table(spark, _written(spark, rows, "phrase-table"))


@query(sql("H", "SELECT fr, en, round(n / ne, 9) AS p_fe, round(n / nf, 9) AS p_ef, '0-0' AS align, nf AS n_fr, ne AS n_en FROM H"))
def phrase_table_file(spark, sf_dir):
    rows = _phrase_file(spark, sf_dir)
    return rows.select("fr", "en", F.round(F.col("scores")[0], 9).alias("p_fe"), F.round(F.col("scores")[2], 9).alias("p_ef"), "align", F.col("counts")[0].alias("n_fr"), F.col("counts")[1].alias("n_en"))


@query(sql("H", "SELECT fr, en, round(n / nf, 9) AS p FROM H WHERE fr IN (SELECT lower(p_type) FROM part WHERE p_size > 25)"))
def seen_from_phrase_table(spark, sf_dir):
    wanted = table(spark, sf_dir, "part").filter("p_size > 25").select(F.lower("p_type").alias("fr"))
    return _rounded(labels.seen_from_phrases(_phrase_file(spark, sf_dir), wanted))


@query("SELECT 'p' || p_partkey AS word, -p_size / 8.0::DOUBLE AS logprob FROM part")
def unigram_file(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    entry = part.select(F.concat_ws("\t", (F.col("p_size") / -8.0).cast("string"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")), F.when(F.col("p_size") % 2 == 0, "-0.5")).alias("line"))
    others = spark.createDataFrame([("\\data\\",), ("ngram 1=9",), ("",), ("\\1-grams:",), ("-1 of two words",), ("\\end\\",)], "line string")
    return readers.unigrams(spark, _written(spark, others.union(entry), "model"))


@query("""WITH s AS (SELECT event_id + 1 AS line_no, i, CASE i WHEN 0 THEN 'e' || event_id ELSE event_type END AS fr, (event_id % 7 + i) / 10.0::DOUBLE AS p FROM events, (SELECT unnest(range(2)) AS i))
SELECT line_no, CAST(i AS INT) AS i, fr, round(ln(greatest(p, 1e-6)), 9) AS gb, round(ln(greatest(p / 2, 1e-6)), 9) AS gs, round(ln(greatest(p / 4, 1e-6)), 9) AS db, round(ln(greatest(p / 8, 1e-6)), 9) AS ds FROM s""")
def lm_score_files(spark, sf_dir):
    events = table(spark, sf_dir, "events").orderBy("event_id")  # ids are 0, 1, ...
    p = lambda i, by: ((F.col("event_id") % 7 + i) / 10.0 / by).cast("string")
    scores = [_written(spark, events.select(F.concat_ws(" ", F.lit("9.5 0 0"), p(0, by), p(1, by)).alias("line")), "scores") for by in (1.0, 2.0, 4.0, 8.0)]
    words = _written(spark, events.select(F.concat(F.lit("e"), F.col("event_id").cast("string"), F.lit(" "), F.col("event_type")).alias("line")), "sentences")
    return _rounded(readers.sentence_scores(spark, words, *scores))


@query("SELECT event_id + 1 AS snt_id, 'e' || event_id || ' ' || event_type AS sentence, -(event_id % 9 + 1) / 2.0::DOUBLE AS first, -6.0::DOUBLE AS second, CAST(2 AS INT) AS n FROM events")
def lm_debug_file(spark, sf_dir):
    event, blank = F.concat(F.lit("e"), F.col("event_id").cast("string")), F.lit("")
    mark = F.concat(F.lit("\tp( "), event, F.lit(" | <s> ) \t= [1gram] 0.5 [ "), ((F.col("event_id") % 9 + 1) / -2.0).cast("string"), F.lit(" ]"))
    block = F.array(F.concat_ws(" ", event, "event_type"), mark, F.lit("\tp( x | y ) \t= [OOV] 0 [ -inf ]"), F.lit("1 sentences, 2 words, 1 OOVs"), F.lit("0 zeroprobs, logprob= -9.5 ppl= 8"), blank)
    path = _written(spark, table(spark, sf_dir, "events").orderBy("event_id").select(F.explode(block).alias("line")), "debug")
    rows = readers.debug_scores(spark, path)
    return rows.select("snt_id", "sentence", F.col("probs")[0].alias("first"), F.col("probs")[1].alias("second"), F.size("probs").alias("n"))


_PLACED = "X AS (SELECT row_number() OVER (ORDER BY sent) AS sent, src, tgt, list_transform(range(CAST(k AS BIGINT)), lambda i: i || '-' || i) AS a FROM B)"


def _shown(rows):
    return rows.select("sent", F.array_join("src", " ").alias("src"), F.array_join("tgt", " ").alias("tgt"), bitext.show_align(F.col("align")).alias("align"))


@query(sql("B", f", {_PLACED} SELECT sent, array_to_string(src, ' ') AS src, array_to_string(tgt, ' ') AS tgt, array_to_string(a, ' ') AS align FROM X"))
def bitext_files(spark, sf_dir):
    paths = [_written(spark, r, n) for r, n in zip(writers.bitext_lines(staged(tables.bitext(spark, sf_dir), "bitext")), ("src", "tgt", "align"))]
    return _shown(readers.bitext(spark, *paths))


@query(sql("B", f", {_PLACED} SELECT sent, array_to_string(src, ' ') AS src, array_to_string(tgt, ' ') AS tgt, array_to_string(a, ' ') AS align FROM X"))
def giza_file(spark, sf_dir):
    group = F.transform("src", lambda w, i: F.concat(w, F.when(i < F.size("tgt"), F.concat(F.lit(" ({ "), (i + 1).cast("string"), F.lit(" })"))).otherwise(" ({ })")))
    rows = tables.bitext(spark, sf_dir).orderBy("sent")
    record = F.array(F.lit("# Sentence pair"), F.array_join("tgt", " "), F.concat_ws(" ", F.lit("NULL ({ })"), F.array_join(group, " ")))
    return _shown(readers.giza(spark, _written(spark, rows.select(F.explode(record).alias("line")), "giza")))


@query("SELECT event_type || '_' || user_id AS word, CAST(2 * count(*) AS BIGINT) AS n FROM events GROUP BY ALL HAVING 2 * count(*) >= 20")
def page_count_file(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n")).select(F.concat_ws(" ", F.col("n").cast("string"), F.concat_ws("_", "event_type", F.col("user_id").cast("string"))).alias("line"))
    return readers.page_counts(spark, _written(spark, counts.union(counts), "counts"), 20).select("word", "n")


@query(sql("O", "SELECT CASE en WHEN 'F' THEN 'train' WHEN 'O' THEN 'dev' ELSE 'test' END AS section, fr AS name, CASE WHEN domain = 'old' THEN 1.0 ELSE -1.0 END::DOUBLE AS label, count(*) AS n FROM O GROUP BY ALL"))
def section_file(spark, sf_dir):
    rows = tables.order_tokens(spark, sf_dir).select(F.when(F.col("en") == "F", 0).when(F.col("en") == "O", 2).otherwise(4).alias("k"), F.concat(F.when(F.col("domain") == "old", "1 | ").otherwise("-1 | "), F.col("fr")).alias("line"))
    marks = spark.createDataFrame([(1, "DEV"), (3, "TEST")], "k int, line string")
    found = readers.example_sections(spark, _written(spark, rows.union(marks).orderBy("k"), "examples"))
    return found.select("section", F.col("items")[0].alias("name"), "label").groupBy("section", "name", "label").agg(F.count("*").alias("n"))


@query("SELECT event_id AS line_no FROM events WHERE event_id % 5 = 3 AND event_id < 3 + 5 * 400")
def every_fifth_line(spark, sf_dir):
    return readers.every_nth(table(spark, sf_dir, "events").select(F.col("event_id").alias("line_no")), 3)


@query(sql("F", f", {_BOUNDS} SELECT name || chr(9) || string_agg(CAST(boundary AS VARCHAR), chr(9) ORDER BY boundary) AS value FROM bounds GROUP BY name"))
def bucket_file(spark, sf_dir):
    return spark.read.text(_written(spark, writers.bucket_lines(_bounds(spark, sf_dir)), "buckets"))


@query(sql("B", """SELECT DISTINCT src[1] || chr(9) || array_to_string(src[2:], ' ') AS value FROM B WHERE len(src) >= 1"""))
def kwic_file(spark, sf_dir):
    rows = tables.bitext(spark, sf_dir).filter(F.size("src") >= 1).select(F.col("src")[0].alias("word"), F.array_join(F.slice("src", 2, F.size("src")), " ").alias("after"))
    return spark.read.text(_written(spark, writers.kwic_lines(rows), "kwic"))


@query("SELECT event_type, date_trunc('day', ts) AS day, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY ALL")
def streamed_type_statistics(spark, sf_dir):
    arrived, kept = scratch(spark, "events"), scratch(spark, "statistics")  # a stream of files needs a folder
    rows = table(spark, sf_dir, "events").select("event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    rows.write.parquet(arrived)
    events = spark.readStream.schema(rows.schema).parquet(arrived)
    keep(type_statistics(events), kept, scratch(spark, "stream")).awaitTermination()
    return spark.read.parquet(kept).select("event_type", F.col("window.start").cast("timestamp_ntz").alias("day"), "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


# Experiments -----------------------------------------------------------------------------------------


def _experiment_rows(spark, sf_dir):
    """Orders as labelled tokens, and their sparse features."""
    rows = tables.order_tokens(spark, sf_dir)
    rows = rows.withColumn("label", F.when(F.col("en") == "F", 1).otherwise(-1))
    items = [F.struct(F.concat(F.lit("orders___token_"), F.lit(n)).alias("name"), c.cast("double").alias("value")) for n, c in (("price", F.col("o_totalprice")), ("urgent", F.col("o_orderpriority").startswith("1").cast("int")), ("key", F.col("line_no") % 97))]
    sparse = rows.select("key", F.explode(F.array(*items)).alias("x")).select("key", "x.name", "x.value", F.lit("").alias("text"))
    return rows, sparse


@query()
def lr_newsense(spark, sf_dir):
    rows, sparse = _experiment_rows(spark, sf_dir)
    spec = experiment.Experiment(train=("old",), test=("new",), classifier="lr")
    scores = experiment.run(spec, rows, sparse)
    return metrics.auroc(scores, by=["fold"])


@query()
def dt_newsense(spark, sf_dir):
    rows, sparse = _experiment_rows(spark, sf_dir)
    prep = experiment.prepared(experiment.Experiment(train=("old",), test=("new",)), rows)
    parts = prep.withColumn("part", folds.part_of(0)).select("key", "fr", "label", "part")
    train = parts.filter("part = 'train'")
    bounds = staged(buckets.boundaries(sparse.join(train, "key", "left_semi"), train.count()), "boundaries")
    sets = learn.marked_sets(parts, sparse, bounds, learn.Space.reached(sparse, bounds))
    best, model = learn.fit_trees(sets["train"], sets["dev"])
    return metrics.auroc(learn.scored(model, sets["test"]).select("label", "score"))


@query()
def oracle_type_experiment(spark, sf_dir):
    rows, sparse = _experiment_rows(spark, sf_dir)
    return experiment.summary(experiment.run(experiment.Experiment(xv=("old", "new"), folds=4, classifier="oracle_type"), rows, sparse))


@query()
def ablation_round(spark, sf_dir):
    rows = tables.predictions(spark, sf_dir)
    names = ["score", "lang", "source"]
    columns = {"score": F.col("score"), "lang": F.length("lang") * 100.0, "source": F.length("source") * 10.0}

    def measure(gone):
        total = sum((columns[n] for n in names if n not in gone), F.lit(0.0))
        return metrics.auroc(rows.withColumn("score", total)).first()["auroc"] or 0.0

    return experiment.ablation_table(spark, experiment.ablation(names, measure))


@query(sql("P", "," + _auroc_sql("P", "lang") + """
SELECT lang AS label, lang || ' & ' || coalesce(printf('%.2f', floor(CAST(numerator AS DOUBLE) / nullif(2 * n_pos * n_neg, 0) * 10000 + 1e-9) / 100), '--') || ' \\\\' AS line FROM area"""))
def report_lines(spark, sf_dir):
    return experiment.latex(metrics.auroc(tables.predictions(spark, sf_dir), by=["lang"]), "lang", ["auroc"])


@query("SELECT event_type, date_trunc('day', ts) AS day, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY ALL")
def windowed_type_statistics(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = type_statistics(events)
    return rows.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("day"), "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))
