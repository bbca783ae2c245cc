"""URL filters: longest-prefix rules, and link-graph propagation for what no rule decides.

Hosts are judged by two personalised PageRanks over host edges: trust flows along links from
hosts with allowed pages, distrust flows against links from hosts with blocked pages (who links
to a bad host is suspect). A host's threshold is its own trust plus its fair share of all
pages; distrust beyond it blocks the host. Ranks are iterated until a round changes them by less
than a thousandth of one page's share in sum. DataFrame operations only.

Defined cases: a null url, or one without `://`, has an empty host and path and no rule; a null
html has no links; repeated rows are judged alike, and each counts as a page; very long urls and
pages are read whole; empty tables give no rows; further columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.session import shared_dir

#: (host, path, verdict)
Rules = Sequence[tuple[str, str, str]]
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Rules) -> Column:
    """struct<rule, verdict> of the longest rule that fits, else null."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        best = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct links between hosts: (src, dst, weight), weights of one src summing to 1."""
    link = F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))
    links = pages.where(F.col("html").contains("//")).select(host_of(F.col("url")).alias("src"), link.alias("to"))
    found = F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), F.col("to"))).otherwise(F.col("to"))
    pairs = links.select("src", host_of(found).alias("dst")).where("src <> dst AND src <> '' AND dst <> ''")
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("n"))


#: A round's summed change at which ranks are settled, as a part of one page's share of all pages.
SETTLED = 1e-3
#: Rounds between checkpoints and tests for convergence.
STRIDE = 4


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int | None = None, tolerance: float = 1e-9) -> DataFrame:
    """Personalised PageRank (host, score) from seeds (host, seed); a host without out-links keeps its mass.

    It goes on until a round's summed change is below `tolerance`, or for just `rounds` where these are given. A round
    leaves at most `damping` of the last one's change, which bounds the rounds; RuntimeError if that does not hold.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("of"))
    steps = edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("of")).alias("share"))
    nodes = (
        seeds.select("host", "seed", F.lit(0).alias("linked"))
        .unionByName(edges.select(F.col("src").alias("host"), F.lit(0.0).alias("seed"), F.lit(1).alias("linked")))
        .unionByName(edges.select(F.col("dst").alias("host"), F.lit(0.0).alias("seed"), F.lit(0).alias("linked")))
        .groupBy("host")
        .agg(F.sum("seed").alias("seed"), F.max("linked").alias("linked"))
    )
    shared_dir(seeds.sparkSession)
    nodes = nodes.checkpoint()
    stays = nodes.where("linked = 0").select(F.col("host").alias("src"), F.col("host").alias("dst"), F.lit(1.0).alias("share"))
    steps = steps.unionByName(stays).checkpoint()
    rank = nodes.select("host", F.col("seed").alias("score"))
    most = rounds if rounds is not None else STRIDE + max(1, math.ceil(math.log(tolerance / 2) / math.log(damping)))
    for i in range(1, most + 1):
        sent = rank.join(steps, rank["host"] == steps["src"]).select(F.col("dst").alias("host"), (F.col("score") * F.col("share")).alias("got"))
        got = sent.groupBy("host").agg(F.sum("got").alias("got"))
        new = nodes.join(got, "host", "left").select(
            "host", ((1 - damping) * F.col("seed") + damping * F.coalesce("got", F.lit(0.0))).alias("score")
        )
        if i % STRIDE and i < most:
            rank = new
            continue
        new = new.join(rank.withColumnRenamed("score", "was"), "host").checkpoint()
        change = new.agg(F.sum(F.abs(F.col("score") - F.col("was"))).alias("x")).first()["x"] or 0.0
        rank = new.select("host", "score")
        if rounds is None and change < tolerance:
            return rank
    if rounds is None:
        raise RuntimeError(f"ranks did not settle in {most} rounds")
    return rank


def judge(pages: DataFrame, rules: Rules, damping: float = 0.85, rounds: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages (page_id, url, html)."""
    url = F.col("url")
    parts = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    ruled = parts.withColumn("hit", rule_for(F.col("host"), F.col("path"), rules))
    verdict = F.col("hit.verdict")
    hosts = ruled.groupBy("host").agg(
        F.count("*").alias("pages"),
        F.count_if(verdict == "allow").alias("trusted"),
        F.count_if(verdict == "block").alias("blocked"),
    )
    shared_dir(pages.sparkSession)
    hosts = hosts.checkpoint()
    total = hosts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pages", "trusted", "blocked"))).first()
    seeds = lambda c: hosts.where(F.col(c) > 0).select("host", (F.col(c) / F.lit(float(total[c] or 1))).alias("seed"))
    edges = host_edges(pages).checkpoint()
    tolerance = SETTLED / (total["pages"] or 1)
    trust = propagate(seeds("trusted"), edges, damping, rounds, tolerance)
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = propagate(seeds("blocked"), turned, damping, rounds, tolerance)
    fair = F.col("pages") / F.lit(float(total["pages"] or 1))
    bad = (
        hosts.join(trust.withColumnRenamed("score", "trust"), "host", "left")
        .join(distrust.withColumnRenamed("score", "distrust"), "host", "left")
        .where(F.coalesce("distrust", F.lit(0.0)) > F.coalesce("trust", F.lit(0.0)) + fair)
        .select("host", F.lit(True).alias("bad"))
        .checkpoint()
    )
    judged = F.coalesce(verdict, F.when(F.col("bad"), F.lit("block")).otherwise(F.lit("allow")))
    return ruled.join(bad, "host", "left").select("page_id", "host", "path", F.col("hit.rule").alias("rule"), judged.alias("verdict"))
