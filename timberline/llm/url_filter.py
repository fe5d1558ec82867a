"""URL filters: rules by host and path, and link-graph propagation for the rest.

A rule fits its host and all subdomains if the url's path starts with the rule's; the longest
wins. Pages without a rule get their host's verdict: trust spreads from hosts with allowed pages by
personalised PageRank along host links, distrust from hosts that a rule blocks whole, along reversed
links; a host is blocked if its distrust exceeds both a floor and its trust. Distrust is split over all
hosts that link to one, so exposure stands in for the floor: the same rounds, but a host takes of each host that it links to
by the share of its own links, however many others link there, and blocked hosts keep theirs. It is 1 for a blocked
host, 0.85 if all links go to such, 0.72 two links away; above ``REACH`` the distrust needs no floor.

All of it is DataFrame functions. Links are counted per pair of hosts before they are
shuffled, so a host with a third of all pages is one row a target; rank rounds move one row
per host and link, are written to the shared folder every few rounds and end when the ranks have settled. Rules are a parameter (each becomes a
branch of one expression), not data.

Null urls and urls without ``://`` have empty host and path, fit no rule and are allowed. Null html has no
links. Repeated rows are judged each. Without links only the seeds have a score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import discard, materialize

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DAMPING = 0.85
#: rounds end once the ranks change by less than this share of the seeds' in EVERY rounds, or after so many
TOLERANCE, ROUNDS, EVERY = 1e-7, 60, 3
FLOOR = 0.02
REACH = 0.72
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HREF = r"""(?i)\bhref\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """Between the first :// and the next / ? # or end, A-Z lower-cased; empty if there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict, whole> of the longest rule that fits; null if none does."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    kind = "struct<rule:string,verdict:string,whole:boolean>"
    out = F.lit(None).cast(kind)
    for verdict, name, prefix in reversed(ordered):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        found = F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"), F.lit(prefix in ("", "/")).alias("whole"))
        out = F.when(fits, found.cast(kind)).otherwise(out)
    return out


def host_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """src, dst, n: links between different hosts in the pages' html."""
    target = F.when(F.col("href").startswith("//"), F.concat(F.lit("x:"), F.col("href"))).otherwise(F.col("href"))
    found = pages.select(host_of(F.col(url)).alias("src"), F.explode(F.regexp_extract_all(F.col(html), F.lit(HREF), F.lit(1))).alias("href"))
    found = found.select("src", host_of(target).alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    return found.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(seeds: DataFrame, links: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING, per: str = "src", tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank: (host, rank) over seeds (host) and links (src, dst, n); a lone seed has 1 - damping.

    A link's share is of all links of its src, or with ``per`` of its dst. Goes on until it settles.
    """
    start = materialize(seeds.select("host", F.lit(1 - damping).alias("rank")), "seeds")
    total = links.groupBy(per).agg(F.sum("n").alias("all"))
    share = materialize(links.join(total, per).select("src", "dst", (F.col("n") / F.col("all")).alias("share")), "shares")
    rank, before = start, start
    mass = max(1, start.count()) * (1 - damping)
    for k in range(rounds):
        moved = rank.join(share, rank["host"] == share["src"]).select(F.col("dst").alias("host"), (damping * F.col("rank") * F.col("share")).alias("rank"))
        rank = start.unionByName(moved).groupBy("host").agg(F.sum("rank").alias("rank"))
        if k % EVERY == EVERY - 1:
            rank = materialize(rank, f"rank{k}")
            steps = rank.unionByName(before.select("host", (-F.col("rank")).alias("rank"))).groupBy("host").agg(F.abs(F.sum("rank")).alias("step"))
            change = steps.agg(F.sum("step")).first()[0] or 0.0
            if before is not start:
                discard(before)
            before = rank
            if change <= tolerance * mass:
                break
    return rank


def host_scores(judged: DataFrame, links: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """host, trust, distrust, exposure from judged (host, found) and host links."""
    hosts = judged.where("host <> ''").groupBy("host").agg(
        F.max(F.when((F.col("found.verdict") == "block") & F.col("found.whole"), 1).otherwise(0)).alias("blocked"),
        F.max(F.when(F.col("found.verdict") == "allow", 1).otherwise(0)).alias("allowed"),
    )
    hosts = materialize(hosts, "hosts")
    links = materialize(links, "links")
    trusted, blocked = hosts.where("allowed = 1 and blocked = 0").select("host"), hosts.where("blocked = 1").select("host")
    if links.isEmpty():
        trust, distrust = (x.select("host", F.lit(1 - damping).alias("rank")) for x in (trusted, blocked))
        exposure = blocked.select("host", F.lit(1.0).alias("rank"))
    else:
        back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
        trust = propagate(trusted, links, rounds, damping)
        distrust = propagate(blocked, back, rounds, damping)
        kept = back.join(blocked.select(F.col("host").alias("dst")), "dst", "left_anti").select("src", "dst", "n")
        exposure = propagate(blocked, kept, rounds, damping, "dst").select("host", (F.col("rank") / (1 - damping)).alias("rank"))
    names = ("trust", "distrust", "exposure")
    parts = [x.select("host", *[(F.col("rank") if n == name else F.lit(0.0)).alias(n) for n in names]) for name, x in zip(names, (trust, distrust, exposure))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("host").agg(*[F.sum(n).alias(n) for n in names])


def filter_urls(pages: DataFrame, rules=RULES, url: str = "url", html: str = "html", floor: float = FLOOR, rounds: int = ROUNDS) -> DataFrame:
    """pages' columns but html, plus ``url_filter``: struct of host, path, rule, verdict, trust, distrust."""
    rest = [c for c in pages.columns if c != html]
    mine = pages.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    mine = mine.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    scores = host_scores(mine.select("host", "found"), host_links(pages, url, html), rounds)
    trust, distrust, exposure = (F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust", "exposure"))
    by_host = F.when(((distrust > floor) | (exposure > REACH)) & (distrust > trust), "block").otherwise("allow")
    out = mine.join(scores, "host", "left").withColumn("verdict", F.coalesce("found.verdict", by_host))
    result = F.struct("host", "path", F.col("found.rule").alias("rule"), "verdict", trust.alias("trust"), distrust.alias("distrust"))
    return out.select("row.*", result.alias("url_filter"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return out.select("page_id", "url_filter.*")
