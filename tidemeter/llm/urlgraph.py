"""URL filter: rules by host and path, and trust and distrust over the link graph of hosts, in DataFrames only.

Hosts with allowed pages are trusted seeds, hosts with blocked pages distrusted ones, each weighted by the share of its
pages. Trust follows links (personalised PageRank), distrust follows them backwards. Seeds keep their weight where nothing
links: a host without links has just its own share, so the threshold means the same at every size of the graph.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemeter.llm.common import stored

#: Verdict, host and path of the query's rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
URL = "(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = "(?i)href\\s*=\\s*[\"']?([^\"'\\s>]+)"
TO_HOST = "(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"


def lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return lowered(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules) -> Column:
    """(verdict, rule) of the longest rule that fits; null where none does. Rules are a short configured list."""
    out = F.lit(None).cast("struct<verdict: string, rule: string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule_host + rule_path).alias("rule"))).otherwise(out)
    return out


def host_edges(pages: DataFrame, html: str = "html") -> DataFrame:
    """(src, dst, weight) between different hosts: links of all pages, summed before they meet."""
    links = F.transform(F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1)), lambda x: lowered(F.regexp_extract(x, TO_HOST, 1)))
    to = pages.select(F.col("host").alias("src"), F.explode(F.filter(links, lambda x: x != "")).alias("dst"))
    return to.where("src <> dst AND src <> ''").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def propagate(seeds: DataFrame, edges: DataFrame, weight: str, damping: float, rounds: int, every: int = 5) -> DataFrame:
    """(host, rank): rank = (1 - damping) * seed + damping * what linking hosts pass on; a host that links nowhere keeps its own.

    Each round joins hosts to their edges and sums by target; every few rounds the ranks are a written table.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    shares = stored(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")), "url-shares")
    ends = out.select(F.col("src").alias("host"), F.lit(True).alias("links"))
    base = stored(seeds.join(ends, "host", "left").select("host", F.col(weight).alias("seed"), F.coalesce("links", F.lit(False)).alias("links")), "url-seeds")
    ranks = base.select("host", F.col("seed").alias("rank"))
    for number in range(1, rounds + 1):
        passed = (
            shares.join(ranks, F.col("src") == F.col("host"))
            .groupBy("dst")
            .agg(F.sum(F.col("rank") * F.col("share")).alias("gain"))
        )
        ranks = (
            base.join(ranks, "host")
            .join(passed, F.col("host") == F.col("dst"), "left")
            .select(
                "host",
                (
                    F.col("seed") * (1 - damping)
                    + (F.coalesce("gain", F.lit(0.0)) + F.when(F.col("links"), F.lit(0.0)).otherwise(F.col("rank"))) * damping
                ).alias("rank"),
            )
        )
        if number % every == 0 or number == rounds:
            ranks = stored(ranks, "url-ranks")
    return ranks


def judge(
    pages: DataFrame,
    rules=RULES,
    damping: float = 0.85,
    rounds: int = 10,
    threshold: float = 0.5,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every row of ``pages``.

    A rule decides where one fits (the longest). Otherwise the host is blocked if distrust less trust is
    ``threshold`` or more, and allowed else. A null url, or one without ``://``, has an empty host and path, no rule
    and no links, and is allowed. A null html has no links. Repeated rows are judged each.
    """
    base = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(html).alias("html"))
    judged = base.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    shares = judged.groupBy("host").agg(
        F.avg(F.when(F.col("hit.verdict") == "allow", 1.0).otherwise(0.0)).alias("allowed"),
        F.avg(F.when(F.col("hit.verdict") == "block", 1.0).otherwise(0.0)).alias("blocked"),
    )
    edges = stored(host_edges(base), "url-edges")
    linked = edges.select(F.col("dst").alias("host")).distinct().join(shares, "host", "left_anti")
    zero = F.lit(0.0)
    hosts = stored(shares.unionByName(linked.select("host", zero.alias("allowed"), zero.alias("blocked"))), "url-hosts")
    reverse = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    if edges.isEmpty():  # nothing to pass on: every host keeps its seeds
        trust = hosts.select("host", F.col("allowed").alias("trust"))
        distrust = hosts.select("host", F.col("blocked").alias("distrust"))
    else:
        trust = propagate(hosts, edges, "allowed", damping, rounds).withColumnRenamed("rank", "trust")
        distrust = propagate(hosts, reverse, "blocked", damping, rounds).withColumnRenamed("rank", "distrust")
    scores = stored(trust.join(distrust, "host"), "url-scores")
    # A host may hold a third of all pages: adaptive execution splits it, or sends the scores round if they are small.
    met = judged.drop("html").join(scores, "host", "left")
    bad = F.round(F.col("distrust") - F.col("trust"), 9) >= threshold
    verdict = F.coalesce(F.col("hit.verdict"), F.when((F.col("host") != "") & bad, F.lit("block")).otherwise(F.lit("allow")))
    return met.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), "trust", "distrust")
