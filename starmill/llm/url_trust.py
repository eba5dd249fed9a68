"""URL verdicts by rules and by trust and distrust over the host graph.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from
there up to ``?``, ``#`` or the end. Null urls and those without ``://`` have both empty. A
rule fits its host and all subdomains if the path starts with the rule's; the longest wins.

Pages that no rule fits are judged by their host. Hosts are nodes; edges are the links of
the pages' html to other hosts, weighted by their number, and, in both directions, a
host and the domain above it if that is a host too. Trust is a personalised PageRank from
pages that rules allow along edges; distrust one from pages that rules block against edges
(who links to bad hosts is suspect). Each is divided by the host's share of all pages. A
host is blocked if its distrust exceeds ``least`` times the mean and its trust.

The score of all hosts solves s = (1 - d) v + d M s, by rounds of a join and a grouped sum
(partial sums before the shuffle, so a host with very many links is a row per task). Rows
for hosts without edges onward lose mass; dividing by the sum returns it to the seeds.
Rounds go on until the scores change by less than ``CLOSE`` in sum; every few rounds
are written to the shared folder.

Empty tables give no rows, null html no links; repeated pages count as often as they stand.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starmill.llm.stored import drop, stored, stored_at

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DAMPING, CLOSE, STEP, ROUNDS = 0.85, 1e-4, 6, 60
_LINK = r"""(?i)\shref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def fitting(rules: Sequence[tuple[str, str, str]], result: int) -> Column:
    """Of the longest rule that fits ``host`` and ``path``: its string (0) or verdict (1); else null."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    made = F.lit(None).cast("string")
    for host, path, verdict in reversed(ordered):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        made = F.when(fits, F.lit((host + path, verdict)[result])).otherwise(made)
    return made


def host_edges(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """(src, dst, weight): links between hosts, and hosts with the domain above them."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), 1)).alias("dst")).select(
        "src", F.translate("dst", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("dst")).where(
        "src <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    above = hosts.select(F.col("host").alias("src"), F.regexp_extract("host", r"^[^.]*\.(.+)$", 1).alias("host"))
    family = above.join(hosts.select("host"), "host").select("src", F.col("host").alias("dst"))
    both = family.union(family.select("dst", "src")).withColumn("weight", F.lit(1.0))
    return links.union(both).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagated(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(host, kind, score) from ``seeds`` (host, kind, share): 'trust' along edges, 'distrust' against."""
    spark = edges.sparkSession
    forward = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "weight")
    backward = edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "weight")
    every = forward.union(backward)
    out = every.groupBy("kind", "host").agg(F.sum("weight").alias("whole"))
    moves = stored(every.join(out, ["kind", "host"]).select("kind", "host", "to", (F.col("weight") / F.col("whole")).alias("part")), "host-moves")
    base = stored(seeds.select("kind", "host", (F.col("share") * (1 - DAMPING)).alias("score")), "host-seeds")
    scores, path = base, None
    for _ in range(0, ROUNDS, STEP):
        before = scores
        for _ in range(STEP):
            given = scores.join(moves, ["kind", "host"]).select(
                "kind", F.col("to").alias("host"), (F.col("score") * F.col("part") * DAMPING).alias("score"))
            previous, scores = scores, given.union(base).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        both = scores.withColumnRenamed("score", "now").join(previous.withColumnRenamed("score", "was"), ["kind", "host"], "full").select(
            "kind", "host", F.coalesce("now", F.lit(0.0)).alias("score"), F.coalesce("was", F.lit(0.0)).alias("was"))
        made, made_at = stored_at(both, "host-scores")
        change = made.agg(F.sum(F.abs(F.col("score") - F.col("was")))).first()[0]
        if path:
            drop(spark, path)
        scores, path = made.drop("was"), made_at
        if before is not base and (change or 0) < CLOSE or not change:
            break
    return scores


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, least: float = 1.0) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust (per mean page)."""
    named = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html").withColumns(
        {"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    ruled = named.withColumn("rule", fitting(rules, 0)).withColumn("ruled", fitting(rules, 1))
    hosts = stored(ruled.groupBy("host").agg(
        F.count("*").alias("pages"), F.sum((F.col("ruled") == "allow").cast("int")).alias("allowed"),
        F.sum((F.col("ruled") == "block").cast("int")).alias("blocked")).where("host <> ''"), "hosts")
    total = hosts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pages", "allowed", "blocked"))).first()
    seeds = hosts.select("host", F.explode(F.array(
        F.struct(F.lit("trust").alias("kind"), (F.col("allowed") / F.lit(max(total["allowed"], 1))).alias("share")),
        F.struct(F.lit("distrust").alias("kind"), (F.col("blocked") / F.lit(max(total["blocked"], 1))).alias("share")))).alias("x")).select(
        "host", "x.kind", "x.share").where("share > 0")
    scores = propagated(host_edges(named, hosts), seeds)
    sums = {r["kind"]: r["whole"] for r in scores.groupBy("kind").agg(F.sum("score").alias("whole")).collect()}  # two rows
    wide = scores.groupBy("host").agg(*(
        F.sum(F.when(F.col("kind") == kind, F.col("score"))).alias(kind) for kind in ("trust", "distrust")))

    def lift(kind: str) -> Column:
        return F.round(F.coalesce(F.col(kind), F.lit(0.0)) / F.lit(sums.get(kind, 1.0)) * F.lit(total["pages"]) / F.col("pages"), 6)

    lifted = hosts.join(wide, "host", "left").select("host", lift("trust").alias("trust"), lift("distrust").alias("distrust"))
    bad = (F.col("distrust") > least) & (F.col("distrust") > F.col("trust"))
    return ruled.drop("html").join(lifted, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", F.when(bad, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
