"""URL filters: rules first, then trust and distrust that spread along host links.

A rule names a host and the start of a path; it fits the host and its subdomains, and the
longest fitting rule decides. For all other urls the host decides. Hosts whose ruled pages
are mostly allowed are trusted seeds, those mostly blocked are blocked seeds, weighted by
the surplus. Personalised PageRank spreads trust from trusted seeds along the links between
hosts, and distrust from blocked seeds against them (who links to a blocked host is
suspect). What a host without links would pass on goes back to the seeds; that scales all ranks of a
kind alike, and only shares are compared, so it is left out. A host is blocked if its share of all distrust exceeds MARGIN times its share of
all trust; a host that neither reaches is allowed.

Links are the hosts of absolute href and src attributes and bare www names in the text,
each once for a page; links inside a host don't count. An iteration is one join and one
aggregation over hosts, written to the shared folder; it ends when no host is reached for
the first time and no rank moves by more than TOLERANCE of itself, so neither a host's
distance nor the size of the graph decides what is seen. Ranks meet pages in a join that Spark can split.

Defined cases: a url that is null or has no "://" has an empty host and path, which no rule
fits, and is judged like any host; null html has no links; equal ids and repeated rows are
judged each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexshift.session import staged

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DAMPING, TOLERANCE, MARGIN = 0.85, 1e-4, 1.0
#: Shares that differ by less than this part of themselves are equal.
EQUAL = 1e-9
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"(?i)\b(?:href|src)\s*+=\s*+[\"']?+\s*+(?:[a-z][a-z0-9+.-]*+:)?+//([^/?#\"'\s<>]++)"
NAME = r"(?i)(?<![a-z0-9.@/-])(www(?:\.[a-z0-9-]++){2,})"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def ruled(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as (rule, verdict), else null."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1], r[2])):  # later ones, which are longer, win
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        best = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def page_hosts(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, url, html) to page_id, host, path, rule, ruled, links (the other hosts it links to)."""
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), F.col("html").cast("string").alias("html"))
    best = ruled(F.col("host"), F.col("path"), rules)
    linked = F.when(F.contains("html", F.lit("//")), F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).otherwise(F.array().cast("array<string>"))
    named = F.when(F.lower("html").contains("www."), F.regexp_extract_all("html", F.lit(NAME), F.lit(1))).otherwise(F.array().cast("array<string>"))
    every = F.array_distinct(F.transform(F.concat(linked, named), lambda x: F.rtrim(F.translate(x, UPPER, LOWER), F.lit("."))))
    links = F.filter(F.coalesce(every, F.array().cast("array<string>")), lambda x: (x != F.col("host")) & (x != ""))
    return rows.select("page_id", "host", "path", best.alias("best"), links.alias("links")).select("page_id", "host", "path", "best.rule", F.col("best.verdict").alias("ruled"), "links")


def host_verdicts(found: DataFrame, damping: float = DAMPING, rounds: int | None = None, margin: float = MARGIN) -> DataFrame:
    """Rows of page_hosts() to (host, trust, distrust, verdict) of all hosts that ranks reach; rounds bounds the iterations."""
    edges = found.select("host", F.explode("links").alias("to")).groupBy("host", "to").agg(F.count("*").alias("n"))
    edges = staged(edges, "host-links")
    ways = edges.select(F.lit("trust").alias("kind"), F.col("host").alias("src"), F.col("to").alias("dst"), "n").union(
        edges.select(F.lit("distrust"), F.col("to"), F.col("host"), "n")
    )
    outs = staged(ways.groupBy("kind", "src").agg(F.sum("n").alias("all")), "host-outs")  # written, so that Spark can split the join at popular hosts
    ways = staged(ways.join(outs, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("all")).alias("share")), "host-ways")
    surplus = found.groupBy("host").agg(F.sum(F.when(F.col("ruled") == "allow", 1).when(F.col("ruled") == "block", -1).otherwise(0)).alias("surplus"))
    seeds = surplus.filter("surplus <> 0").select(F.when(F.col("surplus") > 0, "trust").otherwise("distrust").alias("kind"), "host", F.abs("surplus").cast("double").alias("seed"))
    seeds = staged(seeds, "host-seeds")
    totals = {r["kind"]: r["t"] for r in seeds.groupBy("kind").agg(F.sum("seed").alias("t")).collect()}  # two rows at most
    whole = F.when(F.col("kind") == "trust", totals.get("trust", 1.0)).otherwise(totals.get("distrust", 1.0))
    seeds = seeds.withColumn("seed", F.col("seed") / whole)
    ranks = staged(seeds.withColumnRenamed("seed", "rank"), "host-ranks")
    start = seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("part"), F.lit(0.0).alias("was"))
    for _ in count() if rounds is None else range(rounds):
        passed = ranks.join(ways, (ranks["kind"] == ways["kind"]) & (ranks["host"] == ways["src"])).select(
            ways["kind"], F.col("dst").alias("host"), (F.col("rank") * F.col("share") * damping).alias("part"), F.lit(0.0).alias("was")
        )
        before = ranks.select("kind", "host", F.lit(0.0).alias("part"), F.col("rank").alias("was"))
        moved = staged(start.union(passed).union(before).groupBy("kind", "host").agg(F.sum("part").alias("rank"), F.sum("was").alias("was")), "host-ranks")
        ranks = moved.select("kind", "host", "rank")
        if not moved.filter(F.abs(F.col("rank") - F.col("was")) > F.col("rank") * TOLERANCE).head(1):  # a new host moves by its whole rank
            break
    sums = {r["kind"]: r["t"] for r in ranks.groupBy("kind").agg(F.sum("rank").alias("t")).collect()}
    share = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("rank") / (sums.get(kind) or 1.0)).otherwise(0.0)).alias(kind)
    hosts = ranks.groupBy("host").agg(share("trust"), share("distrust"))
    verdict = F.when(F.col("distrust") > F.col("trust") * margin * (1 + EQUAL), "block").otherwise("allow")
    return hosts.withColumn("verdict", verdict)


def judge(pages: DataFrame, rules=RULES, **how) -> DataFrame:
    """(page_id, url, html) to page_id, host, path, rule, verdict."""
    found = staged(page_hosts(pages, rules), "page-hosts")
    hosts = host_verdicts(found, **how).filter("verdict = 'block'").select("host", F.lit("block").alias("judged"))
    left = found.join(staged(hosts, "blocked-hosts"), "host", "left")
    return left.select("page_id", "host", "path", "rule", F.coalesce("ruled", "judged", F.lit("allow")).alias("verdict"))
