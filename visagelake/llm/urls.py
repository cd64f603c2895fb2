"""URL filters: fixed rules, and trust that spreads over the links between hosts.

Pages that a rule allows or blocks are the seeds. Trust walks along host links from allowed seeds (personalised
PageRank), distrust walks against them from blocked seeds; both are in units of pages. A host that is only linked to is a
seed of one page if a rule for all of its paths fits it. A host is blocked when its distrust outweighs its trust by more than `threshold` of its pages, and that decides its pages that no rule fits.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visagelake.operators import tables

#: (host, path, verdict) of the production rules (fixed values).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Host of a link. A tag ends at the next `<` or `>`, and runs of spaces are taken whole, so that any page is read in linear time.
LINK = r"""(?i)<a\s[^<>]*?href\s*+=\s*+(?:["']\s*+)?(?:https?:)?//([^/"'?#\s>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits, else nulls. rules is a list of bounded length."""
    rule = verdict = F.lit(None).cast("string")
    for rule_host, rule_path, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule, verdict = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def rounds_to(tolerance: float, damping: float) -> int:
    """Rounds after which a walk changes by the tolerance at most, whatever its links: every round damps the change."""
    return math.ceil(math.log(tolerance / 2) / math.log(damping))


def spread(edges: DataFrame, seeds: DataFrame, damping: float, tolerance: float) -> DataFrame:
    """(host, mass) after a walk with restarts from seeds (host, seed) over edges (src, dst, part).

    A host without links keeps what would leave it, so the sum of masses stays that of the seeds. Ends when the sum
    of changes is below tolerance times that sum.
    """
    ends = edges.select("src").distinct()
    now = tables.save(seeds.select("host", F.col("seed").alias("mass")), "rank")
    total = now.agg(F.sum("mass")).first()[0] or 0.0
    if edges.isEmpty() or not total:
        return now
    sinks = seeds.select("host").unionByName(edges.select(F.col("dst").alias("host"))).distinct().join(ends.withColumnRenamed("src", "host"), "host", "left_anti")
    sinks = tables.save(sinks, "sinks")
    for _ in range(rounds_to(tolerance, damping)):
        walked = edges.join(now.withColumnRenamed("host", "src"), "src").select(F.col("dst").alias("host"), (damping * F.col("mass") * F.col("part")).alias("mass"))
        stayed = now.join(sinks, "host", "left_semi").select("host", (damping * F.col("mass")).alias("mass"))
        restart = seeds.select("host", ((1 - damping) * F.col("seed")).alias("mass"))
        after = tables.save(walked.unionByName(stayed).unionByName(restart).groupBy("host").agg(F.sum("mass").alias("mass")), "rank")
        gap = now.withColumnRenamed("mass", "old").join(after, "host", "full").agg(F.sum(F.abs(F.coalesce("mass", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))))).first()[0]
        tables.drop(now)
        now = after
        if gap <= tolerance * total:
            break
    return now


def judge(pages: DataFrame, rules=RULES, damping: float = 0.85, tolerance: float = 1e-4, threshold: float = 0.3, broadcast_rows: int = 200_000) -> DataFrame:
    """Verdicts for all pages.

    Returns (page_id, host, path, rule, verdict), one row per input row; other columns are not carried. A null url, or
    one without ://, has an empty host and path. A null page has no links; links to the own host do not count; tags that are
    not closed end at the next one. Repeated rows count repeatedly; without any seed every host is allowed. Pages of any
    length are read in linear time.
    """
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("html").cast("string").alias("html"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    told = parts.withColumns({"rule": rule, "told": verdict})
    hosts = tables.save(
        told.groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("told") == "allow").alias("allowed"), F.count_if(F.col("told") == "block").alias("blocked")), "hosts"
    )
    linked = parts.select("host", F.explode_outer(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))).alias("to"))
    linked = linked.select(F.col("host").alias("src"), F.translate("to", UPPER, LOWER).alias("dst")).where("src <> dst and src <> ''")
    links = tables.save(linked.groupBy("src", "dst").agg(F.count("*").alias("n")), "links")

    beyond = links.select(F.col("dst").alias("host")).distinct().join(hosts.select("host"), "host", "left_anti")
    says = rule_of(F.col("host"), F.lit("/"), rules)[1]
    one = lambda verdict: F.when(says == verdict, 1).otherwise(0).cast("long")
    seeded = tables.save(hosts.select("host", "allowed", "blocked").unionByName(beyond.select("host", one("allow").alias("allowed"), one("block").alias("blocked"))), "seeds")

    def walk(src: str, dst: str, seeds: str) -> DataFrame:
        turned = links.select(F.col(src).alias("src"), F.col(dst).alias("dst"), "n")
        out = turned.groupBy("src").agg(F.sum("n").alias("all"))
        edges = tables.save(turned.join(out, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("part")), "edges")
        return spread(edges, seeded.where(F.col(seeds) > 0).select("host", F.col(seeds).cast("double").alias("seed")), damping, tolerance)

    trust = walk("src", "dst", "allowed").withColumnRenamed("mass", "trust")
    distrust = walk("dst", "src", "blocked").withColumnRenamed("mass", "distrust")
    score = (F.coalesce("trust", F.lit(0.0)) - F.coalesce("distrust", F.lit(0.0))) / F.col("pages")
    bad = tables.save(hosts.join(trust, "host", "left").join(distrust, "host", "left").where(score < -threshold).select("host", F.lit("block").alias("spread")), "bad-hosts")
    return told.drop("html").join(tables.small(bad, broadcast_rows), "host", "left").select("page_id", "host", "path", "rule", F.coalesce("told", "spread", F.lit("allow")).alias("verdict"))


def oracle(rounds: int | None = None) -> str:
    """DuckDB SQL with as many rounds written out as judge() may take."""
    rounds = rounds or rounds_to(1e-4, 0.85)
    when = lambda then, path="path": " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with({path}, '{p}') THEN '{h + p if then else v}'" for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    )
    steps = []
    for name, src, dst, seed in (("t", "src", "dst", "allowed"), ("d", "dst", "src", "blocked")):
        steps.append(f"{name}e AS MATERIALIZED (SELECT {src} AS src, {dst} AS dst, n / sum(n) OVER (PARTITION BY {src}) AS part FROM links)")
        steps.append(f"{name}s AS (SELECT host, CAST({seed} AS DOUBLE) AS seed FROM seeded WHERE {seed} > 0)")
        steps.append(f"{name}0 AS (SELECT host, seed AS mass FROM {name}s)")
        for k in range(rounds):
            steps.append(
                f"{name}{k + 1} AS MATERIALIZED (SELECT host, sum(mass) AS mass FROM (SELECT dst AS host, 0.85 * mass * part AS mass FROM {name}e JOIN {name}{k} ON host = src"
                f" UNION ALL SELECT host, 0.85 * mass FROM {name}{k} WHERE host NOT IN (SELECT src FROM {name}e)"
                f" UNION ALL SELECT host, 0.15 * seed FROM {name}s) GROUP BY host)"
            )
    return f"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path, html FROM pages),
told AS (SELECT page_id, host, path, html, CASE {when(True)} END AS rule, CASE {when(False)} END AS told FROM parts),
hosts AS (SELECT host, count(*) AS pages, count(*) FILTER (told = 'allow') AS allowed, count(*) FILTER (told = 'block') AS blocked FROM told GROUP BY host),
linked AS (SELECT host AS src, translate(unnest(regexp_extract_all(coalesce(html, ''), '<a\\s[^<>]*?href\\s*=\\s*(?:["'']\\s*)?(?:https?:)?//([^/"''?#\\s>]+)', 1, 'i')), '{UPPER}', '{LOWER}') AS dst FROM parts),
links AS (SELECT src, dst, count(*) AS n FROM linked WHERE src <> dst AND src <> '' GROUP BY src, dst),
seeded AS (SELECT host, allowed, blocked FROM hosts UNION ALL SELECT host, CAST(says = 'allow' AS BIGINT), CAST(says = 'block' AS BIGINT)
  FROM (SELECT host, coalesce(CASE {when(False, "'/'")} END, '') AS says FROM (SELECT DISTINCT dst AS host FROM links) WHERE host NOT IN (SELECT host FROM hosts))),
{", ".join(steps)},
bad AS (SELECT hosts.host FROM hosts LEFT JOIN t{rounds} t ON t.host = hosts.host LEFT JOIN d{rounds} d ON d.host = hosts.host
        WHERE (coalesce(t.mass, 0) - coalesce(d.mass, 0)) / pages < -0.3)
SELECT page_id, told.host, path, rule, coalesce(told, CASE WHEN bad.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM told LEFT JOIN bad ON bad.host = told.host"""
