"""How the operators' inputs are bound to the star-schema and document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexshift.functions.scalar import words
from lexshift.session import table

CUT = "1999-01-01"


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as tokens: the part is the phrase, the supplier's nation its translation, orders before CUT the old domain."""
    line, order, supplier = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "supplier"))
    rows = line.join(order, line["l_orderkey"] == order["o_orderkey"]).join(supplier, line["l_suppkey"] == supplier["s_suppkey"])
    domain = F.when(F.col("o_orderdate") < F.lit(CUT).cast("timestamp_ntz"), "old").otherwise("new")
    return rows.select(
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("fr"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("en"), domain.alias("domain"), "o_orderdate", "l_quantity", "l_discount", "l_tax", "l_returnflag"
    )


def order_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tokens with a line number: the customer is the phrase, the status its translation."""
    domain = F.when(F.col("o_orderdate") < F.lit(CUT).cast("timestamp_ntz"), "old").otherwise("new")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("fr"), F.col("o_orderstatus").alias("en"), domain.alias("domain"),
        F.col("o_orderkey").alias("line_no"), F.col("o_orderkey").alias("key"), "o_totalprice", "o_orderpriority",
    )


def predictions(spark: SparkSession, sf_dir: str, label: str = "quality") -> DataFrame:
    """Labelled documents scored by their length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.col("n_chars").cast("double").alias("score"))
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", F.col(label).alias("label")), "doc_id")


def signed(rows: DataFrame) -> DataFrame:
    return rows.select((F.col("score") - 2000).alias("score"), "label", F.col("source").alias("grp"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as doc, lang, domain (sources with an even number are old), tokens."""
    number = F.regexp_extract("source", "([0-9]+)$", 1).try_cast("int")
    domain = F.when(number % 2 == 0, "old").otherwise("new")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "lang", domain.alias("domain"), words(F.col("text")).alias("tokens"))


def page_pairs(spark: SparkSession, sf_dir: str, f: str = "fr", e: str = "en") -> tuple[DataFrame, DataFrame]:
    """Documents of two languages paired by their rank: doc, tokens of each."""
    from pyspark.sql import window as W

    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", words(F.col("text")).alias("tokens")).filter(F.col("lang").isin(f, e))
    ranks = docs.select("doc_id", "lang").withColumn("doc", F.row_number().over(W.Window.partitionBy("lang").orderBy("doc_id")).cast("long"))
    n = ranks.groupBy("lang").agg(F.max("doc").alias("n")).agg(F.min("n").alias("n"), F.count("*").alias("langs"))
    docs = docs.join(ranks.crossJoin(F.broadcast(n)).filter("doc <= n AND langs = 2").select("doc_id", "doc"), "doc_id")  # one row
    return tuple(docs.filter(F.col("lang") == x).select("doc", "tokens") for x in (f, e))


def bitext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's turn and the answer after it, aligned place by place."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", words(F.col("text")).alias("tokens"))
    src = turns.filter("role = 'user'").select("conv_id", "turn", F.col("tokens").alias("src"))
    tgt = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("tokens").alias("tgt"))
    n = F.least(F.size("src"), F.size("tgt"))
    pairs = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("s"), i.alias("t")))).otherwise(F.array().cast("array<struct<s:int,t:int>>"))
    return src.join(tgt, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("sent"), "src", "tgt", pairs.alias("align"))


def item_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of line items as sparse features; discounts below 0.05 are left out, so they count as zeros."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"l_{n}").cast("double").alias("value")) for n in ("quantity", "discount", "tax")])).alias("x"))
    return rows.select("l_returnflag", "x.name", "x.value").filter("name <> 'discount' OR value >= 0.05")


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as phrase pairs: words of the type to words of the brand and type, with counts as scores."""
    part = table(spark, sf_dir, "part")
    rows = part.select(F.lower("p_type").alias("fr"), F.concat_ws(" ", F.lower(F.substring("p_brand", 1, 7)), F.lower("p_type")).alias("en"))
    single = part.select(F.explode(F.array(F.struct(F.lower("p_type").alias("fr"), F.lower("p_type").alias("en")), F.struct(F.lower("p_type").alias("fr"), F.lower(F.substring("p_brand", 1, 7)).alias("en")))).alias("x")).select("x.fr", "x.en")
    counts = rows.union(single).groupBy("fr", "en").agg(F.count("*").alias("n"))
    both = counts.join(counts.groupBy("fr").agg(F.sum("n").alias("nf")), "fr").join(counts.groupBy("en").agg(F.sum("n").alias("ne")), "en")
    scores = F.array(F.col("n") / F.col("ne"), F.lit(0.5), F.col("n") / F.col("nf"), F.lit(0.5))
    return both.select("fr", "en", scores.alias("scores"), F.array(F.col("nf").cast("double"), F.col("ne").cast("double")).alias("counts"))


#: The same inputs as SQL common table expressions.
SQL = {
    "T": """SELECT 'p' || l_partkey AS fr, 'n' || s_nationkey AS en, CASE WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN 'old' ELSE 'new' END AS domain,
        o_orderdate, l_quantity, l_discount, l_tax, l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey""",
    "O": """SELECT 'c' || o_custkey AS fr, o_orderstatus AS en, CASE WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN 'old' ELSE 'new' END AS domain,
        o_orderkey AS line_no, o_totalprice, o_orderpriority FROM orders""",
    "S": "SELECT fr, en, count(*) AS n, count(*) / CAST(sum(count(*)) OVER (PARTITION BY fr) AS DOUBLE) AS p FROM T WHERE domain = 'old' GROUP BY fr, en",
    "P": "SELECT doc_id, lang, source, CAST(n_chars AS DOUBLE) AS score, quality AS label FROM documents JOIN labels USING (doc_id)",
    "PT": "SELECT doc_id, lang, source, CAST(n_chars AS DOUBLE) AS score, toxic AS label FROM documents JOIN labels USING (doc_id)",
    "G": "SELECT score - 2000 AS score, label, source AS grp FROM P",
    "C": r"""SELECT doc_id AS doc, lang, CASE WHEN TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 2 = 0 THEN 'old' ELSE 'new' END AS domain,
        list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda w: w <> '') AS tokens FROM documents""",
    "N": "SELECT doc, term, count(*) AS n FROM (SELECT doc, unnest(tokens) AS term FROM C) GROUP BY doc, term HAVING count(*) >= 2",
    "R": "SELECT doc, lang, tokens, row_number() OVER (PARTITION BY lang ORDER BY doc) AS page FROM C WHERE lang IN ('fr', 'en')",
    "Q": "SELECT page AS doc, lang, tokens FROM R WHERE page <= (SELECT min(n) FROM (SELECT max(page) AS n FROM R GROUP BY lang)) AND (SELECT count(DISTINCT lang) FROM R) = 2",
    "V": r"SELECT conv_id, turn, role, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda w: w <> '') AS tokens FROM conversations",
    "B": """SELECT u.conv_id * 1000 + u.turn AS sent, u.tokens AS src, a.tokens AS tgt, least(len(u.tokens), len(a.tokens)) AS k
        FROM V u JOIN V a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant'""",
    "W": """SELECT src[i] AS f, tgt[i] AS e FROM (SELECT src, tgt, unnest(range(1, CAST(k AS BIGINT) + 1)) AS i FROM B)
        UNION ALL SELECT src[i], 'NULL' FROM (SELECT src, unnest(range(CAST(k AS BIGINT) + 1, CAST(len(src) AS BIGINT) + 1)) AS i FROM B)
        UNION ALL SELECT 'NULL', tgt[i] FROM (SELECT tgt, unnest(range(CAST(k AS BIGINT) + 1, CAST(len(tgt) AS BIGINT) + 1)) AS i FROM B)""",
    "F": """SELECT l_returnflag, 'quantity' AS name, CAST(l_quantity AS DOUBLE) AS value FROM lineitem UNION ALL SELECT l_returnflag, 'discount', CAST(l_discount AS DOUBLE) FROM lineitem WHERE l_discount >= 0.05
        UNION ALL SELECT l_returnflag, 'tax', CAST(l_tax AS DOUBLE) FROM lineitem""",
    "H0": """SELECT lower(p_type) AS fr, lower(substr(p_brand, 1, 7)) || ' ' || lower(p_type) AS en FROM part UNION ALL SELECT lower(p_type), lower(p_type) FROM part
        UNION ALL SELECT lower(p_type), lower(substr(p_brand, 1, 7)) FROM part""",
    "H1": "SELECT fr, en, count(*) AS n FROM H0 GROUP BY fr, en",
    "H": """SELECT fr, en, n, CAST(sum(n) OVER (PARTITION BY fr) AS DOUBLE) AS nf, CAST(sum(n) OVER (PARTITION BY en) AS DOUBLE) AS ne FROM H1""",
}
NEEDS = {"S": ["T"], "G": ["P"], "N": ["C"], "R": ["C"], "Q": ["R"], "B": ["V"], "W": ["B"], "H1": ["H0"], "H": ["H1"]}


def sql(names: str, body: str) -> str:
    """body with the named inputs before it; "NAME AS (...)" parts of body may follow a leading comma."""
    order: list[str] = []

    def add(name):
        for x in NEEDS.get(name, []):
            add(x)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    body = body.strip()
    heads = ",\n".join(f"{n} AS ({SQL[n]})" for n in order)
    return f"WITH {heads}{',' if body.startswith(',') else ''}\n{body.removeprefix(',')}"
