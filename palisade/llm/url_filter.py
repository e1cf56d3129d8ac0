"""URL verdicts: host and path rules first, else link-graph propagation between hosts.

Hosts are nodes; an edge counts the links from pages of one host to another. Trust is a
personalised PageRank from hosts with allowed pages along the edges; distrust is one
from hosts with blocked pages against the edges, so that it reaches those who link to
blocked hosts. Both go on until the mass that is still unsettled is far below what blocks
a host. A host's own seed says nothing of its other pages: only received mass
counts. A host is blocked if the distrust it receives, times the number of hosts, is at
least `threshold` and more than the trust it receives.

Results for special rows: a null url, or one without "://", has an empty host and path
and is allowed unless a rule fits; a null html has no links; repeated rows count as
pages of their own; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace

# The rules (fixed values): verdict, host and path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DAMPING = 0.85
ROUNDS = 10
THRESHOLD = 0.2
#: Mass that may be unsettled at the end, as a share of what blocks a host.
UNSETTLED = 0.001
#: Rounds between tables that cut the lineage.
CUT = 5

LINK = r"(?i)\shref\s*=\s*[\"']?\s*((?:https?:)?//[^\"'\s>]+)"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(after_scheme(url), F.lit("")), "^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(after_scheme(url), F.lit("")), "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def propagate(edges: DataFrame, seeds: DataFrame, workspace: Workspace, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float | None = None) -> DataFrame:
    """edges (src, dst, n), seeds (host, w) to (host, mass): personalised PageRank.

    With a tolerance, rounds go on until the L1 distance to the limit is at most that.
    """
    total = seeds.agg(F.sum("w").alias("total"))
    start = workspace.save(seeds.crossJoin(total).select("host", (F.col("w") / F.col("total")).alias("seed")), "seeds")  # total is one row
    out = edges.groupBy("src").agg(F.sum("n").alias("out"))
    share = workspace.save(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("out")).alias("share")), "shares")
    mass = start.select("host", F.col("seed").alias("mass"))
    last, i = mass, 0
    while tolerance is not None or i < rounds:
        passed = share.join(mass, share.src == mass.host).select(F.col("dst").alias("host"), (damping * F.col("share") * F.col("mass")).alias("mass"))
        kept = start.select("host", ((1 - damping) * F.col("seed")).alias("mass"))
        mass = passed.unionByName(kept).groupBy("host").agg(F.sum("mass").alias("mass"))
        i += 1
        if i % CUT == 0:
            mass = workspace.save(mass, "mass")
            if tolerance is not None:
                # a round shrinks the distance to the limit by damping at least, so CUT rounds leave at most this part of their change
                left = damping**CUT / (1 - damping**CUT)
                both = mass.unionByName(last.select("host", (-F.col("mass")).alias("mass"))).groupBy("host").agg(F.abs(F.sum("mass")).alias("change"))
                if (both.agg(F.sum("change")).first()[0] or 0.0) * left <= tolerance:
                    break
                last = mass
    return mass.join(start, "host", "left").select("host", F.greatest(F.lit(0.0), F.col("mass") - F.coalesce((1 - damping) * F.col("seed"), F.lit(0.0))).alias("mass"))


def host_edges(pages: DataFrame) -> DataFrame:
    """pages (host, html) to (src, dst, n): links between different hosts."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("link"))
    target = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))
    links = links.select("src", host_of(target).alias("dst")).filter("src <> '' and dst <> '' and src <> dst")
    return links.groupBy("src", "dst").agg(F.count("*").alias("n"))


def judge_urls(pages: DataFrame, rules=RULES, damping: float = DAMPING, rounds: int | None = None, threshold: float = THRESHOLD, workspace: Workspace | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict. rounds: a fixed number of them, else as many as it takes."""
    workspace = workspace or Workspace(pages.sparkSession, "urls")
    url = F.col("url")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), "html")
    rows = rows.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    edges = workspace.save(host_edges(rows), "edges")
    judged = rows.select("page_id", "host", "path", "fit.rule", F.col("fit.verdict").alias("by_rule"))
    if edges.limit(1).count() == 0:  # no link, so nothing is received anywhere
        return judged.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.lit("allow")).alias("verdict"))
    by_host = judged.filter("host <> ''").groupBy("host").agg(F.count_if(F.col("by_rule") == "allow").alias("good"), F.count_if(F.col("by_rule") == "block").alias("bad"))
    by_host = workspace.save(by_host, "hosts")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    hosts = workspace.save(edges.select(F.col("src").alias("host")).unionByName(edges.select(F.col("dst").alias("host"))).unionByName(by_host.select("host")).distinct(), "nodes")
    n_hosts = hosts.count()
    tolerance = UNSETTLED * threshold / n_hosts if rounds is None else None
    trust = propagate(edges, by_host.filter("good > 0").select("host", F.col("good").alias("w")), workspace, damping, rounds or ROUNDS, tolerance)
    distrust = propagate(back, by_host.filter("bad > 0").select("host", F.col("bad").alias("w")), workspace, damping, rounds or ROUNDS, tolerance)
    scores = hosts.join(trust.withColumnRenamed("mass", "trust"), "host", "left").join(distrust.withColumnRenamed("mass", "distrust"), "host", "left")
    t, d = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    bad = scores.filter((d * n_hosts >= threshold) & (d > t)).select("host", F.lit("block").alias("by_graph"))
    out = judged.join(workspace.save(bad, "bad"), "host", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", "by_graph", F.lit("allow")).alias("verdict"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
