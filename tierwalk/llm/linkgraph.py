"""URL filters: rules first, then trust and distrust spread over the graph of hosts.

Edges go from a page's host to the hosts of the links in its html (absolute or without a scheme, in any case;
relative links stay on the host or go to that of <base>), and both ways between each host met and its
registrable domain, whether or not that has pages; so hosts of one domain are two steps apart. Trust is personalised PageRank from trusted seeds; distrust is the
same over reversed edges from blocked seeds: hosts with a bad name and hosts whose pages the rules all block (a
rule for some paths says nothing of the host's other pages). A host is blocked where distrust passes the threshold and trust.

Null urls and urls without :// have an empty host and path, fit no rule and are allowed. Null html has no
links. Repeated rows are judged alike; repeated links count once for a pair of hosts. Long pages are searched whole. Ties between
trust and distrust allow. An empty table has an empty result. Columns other than the id, url and html are left behind.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierwalk.llm.common import Work, columns

# Fixed values: (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Words in a host's name that make it a blocked seed.
BAD_NAMES = ("adult", "cheap-pills", "casino", "xxx")
#: Input for callers: (host, allow or block) of seeds by hand; a seed stands for its subdomains as well.
SEEDS: tuple[tuple[str, str], ...] = ()
#: Suffixes of several labels under which each name is a site of its own; any last label is one besides.
SUFFIXES = ("example.com", "example.net", "example.org", "co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "co.jp", "co.nz", "com.br", "co.in", "co.za")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null where none does."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def site_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The registrable domain of a host, one label under its longest suffix; '' where there is none, as for addresses."""
    site = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    for s in sorted(suffixes, key=len):
        site = F.when((host == s) | host.endswith(f".{s}"), F.regexp_extract(host, r"([^.]+\." + re.escape(s) + ")$", 1)).otherwise(site)
    return F.when(host.rlike(r"^[0-9.]+(:[0-9]*)?$|[\[\]]"), "").otherwise(site)


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html", suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """Distinct edges (src, dst) without loops."""
    src = columns(pages, [url_col, html_col]).select(host_of(F.col(url_col)).alias("src"), F.col(html_col).alias("html"))
    found = F.expr(r"regexp_extract_all(coalesce(html, ''), '(?i)[\\s\"\'/]href\\s*=\\s*[\"\']?\\s*((?:https?:)?//[^/?#\"\'>\\s]+)', 1)")
    links = src.select("src", F.explode(F.array_distinct(found)).alias("url")).select("src", host_of(F.regexp_replace("url", "^(?:[^/]*:)?//", "http://")).alias("dst")).distinct()
    hosts = src.select("src").union(links.select("dst")).distinct()
    up = hosts.select("src", site_of(F.col("src"), suffixes).alias("dst"))
    both = up.union(up.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return links.union(both).filter("src <> '' and dst <> '' and src <> dst").distinct()


#: Rounds of propagation in one plan.
STEPS = 4


def propagate(edges: DataFrame, seeds: DataFrame, work: Work, damping: float = 0.85, tolerance: float = 1e-4) -> DataFrame:
    """kind, host, rank: each kind's rank flows along its edges (kind, src, dst) and returns to its seeds (kind, host).

    STEPS rounds are one plan and a written table. They go on until a round changes a kind's ranks by less than tolerance of a whole of 1
    and reaches no new host.
    """
    degree = edges.groupBy("kind", "src").agg(F.count(F.lit(1)).alias("out"))
    flow = work.write("flow", edges.join(degree, ["kind", "src"]))
    base = work.write("seeds", seeds.join(seeds.groupBy("kind").agg((1.0 / F.count(F.lit(1))).alias("rank")), "kind"))
    home = base.select("kind", "host", (F.col("rank") * (1 - damping)).alias("rank"))

    def step(rank: DataFrame) -> DataFrame:
        moved = flow.join(rank.withColumnRenamed("host", "src"), ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.lit(damping) * F.col("rank") / F.col("out")).alias("rank"))
        return moved.union(home).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))

    rank, k = base, 0
    while True:
        old = reduce(lambda r, _: step(r), range(STEPS - 1), rank)
        both = step(old).join(old.withColumnRenamed("rank", "old"), ["kind", "host"], "full")
        new = work.write(f"rank{k}", both)
        change = new.groupBy("kind").agg(F.sum(F.abs(F.coalesce("rank", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))).alias("by"), F.count_if(F.col("old").isNull()).alias("fresh"))
        done = change.filter((F.col("by") >= tolerance) | (F.col("fresh") > 0)).isEmpty()
        if k:
            work.drop(f"rank{k - 1}")
        rank, k = new.filter("rank is not null").select("kind", "host", "rank"), k + 1
        if done:
            return rank


def judge(pages: DataFrame, rules=RULES, bad_names=BAD_NAMES, threshold: float = 0.0, url_col: str = "url", html_col: str = "html", id_col: str = "page_id", seeds: Sequence[tuple[str, str]] = SEEDS, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of the host; bad_names and seeds are where distrust starts."""
    work = Work(pages.sparkSession, "hosts")
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = columns(pages, [id_col, url_col]).select(F.col(id_col), host.alias("host"), path.alias("path")).withColumns({"rule": name, "ruled": verdict})
    bad = F.lit(False)
    for b in bad_names:
        bad = bad | F.col("host").contains(b)
    for h, v in seeds:
        if v == "block":
            bad = bad | (F.col("host") == h) | F.col("host").endswith(f".{h}")
    well = F.col("good") > 0
    for h, v in seeds:
        if v == "allow":
            well = well | (F.col("host") == h) | F.col("host").endswith(f".{h}")
    edges = work.write("edges", host_edges(pages, url_col, html_col, suffixes))
    met = edges.select(F.col("src").alias("host")).union(edges.select("dst")).withColumn("ruled", F.lit(None).cast("string"))
    judged = rows.filter("host <> ''").select("host", "ruled", F.lit(1).alias("page")).union(met.withColumn("page", F.lit(0)))
    hosts = work.write("all", judged.groupBy("host").agg(F.count_if(F.col("ruled") == "allow").alias("good"), F.count_if(F.col("ruled") == "block").alias("ill"), F.sum("page").alias("pages")).withColumns({"bad": bad, "well": well}))
    kinds = edges.withColumn("kind", F.lit("trust")).union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("distrust")))
    starts = hosts.filter("well and ill = 0 and not bad").select(F.lit("trust").alias("kind"), "host").union(hosts.filter("bad or (ill > 0 and ill = pages)").select(F.lit("distrust"), "host"))
    ranks = propagate(kinds.select("kind", "src", "dst"), starts, work)
    found = ranks.groupBy("host").agg(*[F.sum(F.when(F.col("kind") == c, F.col("rank"))).alias(c) for c in ("trust", "distrust")])
    found = work.write("found", found.select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")))
    out = rows.join(found, "host", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust")})
    own = F.when((F.col("distrust") > threshold) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow")
    return out.select(id_col, "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "trust", "distrust")
