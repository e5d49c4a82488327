"""URL verdicts: host and path rules first, then trust and distrust spread over the link graph.

Hosts link to hosts by the addresses in their pages. Trust is a personalised PageRank that restarts
at hosts with pages that a rule allows; distrust one on the reversed links that restarts at hosts
with pages that a rule blocks: who links to bad hosts is bad, who is linked from good ones is good.
A host whose share of distrust exceeds ``BLOCK_SHARE`` is blocked where no rule decides.

A host's seed is the share of its pages that rules allow or block, and a walk's ranks add up to its seeds:
each walk is a distribution times the prior weight of its side, so that a host's share of distrust is the
posterior of Bayes' rule. Rank that reaches a host without links returns to the seeds; that scales
all ranks of a walk alike, and is done at the end. A walk ends when what is still on its way is less than
``TOLERANCE`` of the seeds, however many rounds that takes.

The link table has one row per pair of hosts with its number of links, so a hub costs what it links
to, not how often. Ranks are joined as rows; sums are partially aggregated before each shuffle. All
of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import materialise, release

#: (verdict, host, path prefix), fixed values of the rule list.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
DAMPING = 0.85
#: Part of the seeds that may still be on its way when a walk ends; each round leaves DAMPING of it at most.
TOLERANCE = 1e-6
#: Share of distrust in a host's trust and distrust from which on it is blocked.
BLOCK_SHARE = 0.75
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    return ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits; nulls without one."""
    longest = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in reversed(longest):
        text, verdict = F.when(fits(host, path, h, p), h + p).otherwise(text), F.when(fits(host, path, h, p), kind).otherwise(verdict)
    return text, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts from the pages' href and src addresses.

    Addresses without a host stay on their own host and are no edges.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    targets = F.regexp_extract_all(html, F.lit(r"""(?i)\b(?:href|src)\s*=\s*["']?((?:[a-z][a-z0-9+.-]*+:)?//[^"'\s<>]++)"""), F.lit(1))
    rows = pages.select(host_of(F.col("url")).alias("src"), F.explode(targets).alias("link"))
    absolute = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))
    pairs = rows.select("src", host_of(absolute).alias("dst"))
    return pairs.where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def rank(links: DataFrame, hosts: DataFrame, seed: str, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, rank): personalised PageRank over (src, dst, n), summing to the seeds; ``hosts`` has ``host`` and the seed weight.

    ``links`` and ``hosts`` are written tables. Ranks only grow from round to round, by what was on its way.
    """
    seeds = hosts.agg(F.sum(seed)).first()[0] or 0.0
    restart = hosts.select("host", ((1 - damping) * F.col(seed)).alias("base")).where("base > 0")
    ranks = restart.select("host", F.col("base").alias("rank"))
    total = (1 - damping) * seeds
    if links.isEmpty() or not seeds:
        return ranks.withColumn("rank", F.col("rank") / (1 - damping))
    out = links.groupBy("src").agg(F.sum("n").alias("out"))
    shares = materialise(links.join(out, "src").select("src", "dst", (F.col("n") / F.col("out")).alias("share")), "shares")
    before = None
    while True:
        sent = shares.join(ranks, shares["src"] == ranks["host"]).groupBy("dst").agg(F.sum(F.col("share") * F.col("rank") * damping).alias("got"))
        both = restart.select("host", F.col("base").alias("r")).unionAll(sent.select(F.col("dst").alias("host"), F.col("got").alias("r")))
        ranks = materialise(both.groupBy("host").agg(F.sum("r").alias("rank")), "ranks")
        if before is not None:
            release(before)
        now = ranks.agg(F.sum("rank")).first()[0]
        if now - total <= tolerance * seeds:
            return ranks.withColumn("rank", F.col("rank") * F.lit(seeds / now))
        before, total = ranks, now


def host_scores(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """(host, trust, distrust, blocked) for every host that a walk reaches."""
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    seen = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("verdict", verdict)
    share = lambda k: F.avg((F.coalesce(F.col("verdict"), F.lit("")) == k).cast("double"))
    hosts = materialise(seen.where("host <> ''").groupBy("host").agg(share("allow").alias("good"), share("block").alias("bad")), "hosts")
    links = materialise(host_links(pages), "links")
    trust = rank(links, hosts, "good").select("host", F.col("rank").alias("trust"), F.lit(0.0).alias("distrust"))
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = rank(back, hosts, "bad").select("host", F.lit(0.0).alias("trust"), F.col("rank").alias("distrust"))
    both = trust.unionAll(distrust).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
    return both.withColumn("blocked", F.col("distrust") > BLOCK_SHARE * (F.col("trust") + F.col("distrust")))


def verdicts(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for every row.

    A null address, or one without ``://``, has empty host and path, fits no rule and is allowed, as
    is a host that neither trust nor distrust reaches. Rows that repeat a page are judged each; other columns are not read.
    """
    scores = materialise(host_scores(pages, rules).where("blocked").select(F.col("host").alias("bad_host")), "scores")
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = urls.withColumn("rule", text).withColumn("by_rule", verdict).join(scores, F.col("host") == F.col("bad_host"), "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("bad_host").isNotNull(), "block").otherwise("allow")).alias("verdict"))
