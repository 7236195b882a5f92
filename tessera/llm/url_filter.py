"""URL verdicts by rules, and by trust that spreads over the graph of hosts.

Rules (host and path, like `example.net/en/`) decide first: a rule fits its host and all subdomains if the path
starts with the rule's; the longest wins. Hosts are linked by the absolute links in their pages and, since one owner
runs them, to and from their parent domain as long as that keeps three labels. Pages that rules allow make their hosts
trusted seeds, pages that rules block make theirs blocked seeds. Personalised PageRank spreads trust along the links
and, along the reversed links, distrust: who links to blocked hosts is distrusted. A host is blocked if its share
distrust / (trust + distrust), to 9 decimals, is above the threshold, however small both are (only the columns trust and
distrust of the result are rounded); its pages that no rule fits get that verdict. Hosts that
neither reaches are allowed.

All steps are DataFrame expressions: links are counted by (source, target) before anything is joined, an iteration is
one join and one aggregation, and every fifth is written to the shared folder. Iteration ends when no host's trust or
distrust has changed by more than `tolerance` of itself in the last five: so all hosts that links lead to are reached,
however far and however little arrives (down to 1e-300, some 4,000 links away, which counts as nothing).

Nulls and edge cases: equal trust and distrust allow; a rule doesn't fit an url without a path; a null url, or one without `://`, has an empty host and path and is allowed unless a rule says
otherwise; null pages have no links; repeated rows are judged each and count as seeds each; a null page_id stays; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import save

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the query, as (rule, verdict).
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        own, _, start = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def parent_of(host: Column) -> Column:
    """The domain above, if that has three labels at least; else null."""
    return F.when(F.size(F.split(host, r"\.")) >= 4, F.regexp_replace(host, r"^[^.]*\.", ""))


def host_links(judged: DataFrame) -> DataFrame:
    """src, dst, weight between different hosts."""
    by_page = judged.filter("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("dst"))
    linked = by_page.select("src", lower_ascii(F.col("dst")).alias("dst")).filter("src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    up = judged.select("host").filter("host <> ''").distinct().select(F.col("host").alias("src"), parent_of(F.col("host")).alias("dst")).filter("dst is not null")
    own = up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct().withColumn("weight", F.lit(1.0))
    return linked.unionByName(own).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-3, cut: int = 5) -> DataFrame:
    """host, trust, distrust. links: src, dst, weight; seeds: host, trusted, blocked (masses)."""
    links = save(links, "host-links")
    both = links.select(F.lit("trust").alias("kind"), "src", "dst", "weight").unionByName(links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    out = both.groupBy("kind", "src").agg(F.sum("weight").alias("total"))
    edges = save(both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.col("total")).alias("share")), "host-edges")
    long = seeds.select("host", F.explode(F.create_map(F.lit("trust"), "trusted", F.lit("distrust"), "blocked")).alias("kind", "mass")).filter("mass > 0")
    sums = long.groupBy("kind").agg(F.sum("mass").alias("all"))
    start = save(long.join(F.broadcast(sums), "kind").select("kind", "host", (F.col("mass") / F.col("all")).alias("s")), "seeds")
    rank = start
    if not edges.isEmpty():
        base = start.select("kind", "host", (F.col("s") * (1 - damping)).alias("s"))
        while True:
            before = rank.select("kind", "host", F.col("s").alias("s0"))
            for _ in range(cut):
                moved = edges.join(rank.select("kind", F.col("host").alias("src"), "s"), ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("s") * F.col("share") * damping).alias("s"))
                rank = moved.unionByName(base).groupBy("kind", "host").agg(F.sum("s").alias("s")).filter("s > 1e-300")
            rank = save(rank, "rank")
            gap = F.abs(F.coalesce("s0", F.lit(0.0)) - F.coalesce("s", F.lit(0.0)))
            if rank.join(before, ["kind", "host"], "full").filter(gap > tolerance * F.coalesce("s", F.lit(0.0))).isEmpty():
                break
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("s")).otherwise(0.0)).alias(kind)
    return rank.groupBy("host").agg(of("trust"), of("distrust"))


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, threshold: float = 0.5, damping: float = 0.85, tolerance: float = 1e-3) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every page."""
    own = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    placed = own.select("page_id", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.coalesce(path_of(F.col("url")), F.lit("")).alias("path"), "html")
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    judged = placed.select("page_id", "host", "path", rule.alias("rule"), says.alias("says"), "html")
    count = lambda v: F.sum(F.when(F.col("says") == v, 1.0).otherwise(0.0))
    seeds = judged.filter("host <> ''").groupBy("host").agg(count("allow").alias("trusted"), count("block").alias("blocked"))
    ranks = save(propagate(host_links(judged), seeds, damping, tolerance), "host-ranks")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    share = F.round(F.try_divide(distrust, trust + distrust), 9)
    method = F.when(share > threshold, "block").otherwise("allow")
    return judged.drop("html").join(ranks, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("says", method).alias("verdict"), F.round(trust, 9).alias("trust"), F.round(distrust, 9).alias("distrust"))
