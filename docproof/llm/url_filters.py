"""URL filters: rules first, then link-graph propagation of trust and distrust between hosts.

Trust is a personalised PageRank that restarts at hosts all of whose rule verdicts allow; it follows links.
Distrust restarts at hosts all of whose rule verdicts block and follows links backwards: who links to a bad
host shares its distrust. A host is blocked where distrust exceeds ``ratio`` times its trust. Both are power
iterations of joins and sums over the host edges, written out every few steps so that lineage stays short
and a lost executor costs no more than those steps. All of it is DataFrame functions.

Mass that leaves through a host without links is lost rather than dealt out anew, so scores are sums over
walks from the seeds; only their comparison matters.

Defined cases: a null url, or one without '://', has an empty host and path, fits no rule and takes the
method's verdict for an unknown host, allow; null or empty html has no links; repeated rows are judged each;
an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docproof.llm.common import stored

#: (host, path, verdict); fixed values of the contract.
RULES: tuple[tuple[str, str, str], ...] = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMPING, STEPS_WRITTEN, TOLERANCE = 0.85, 4, 1e-6


def _after(url: Column) -> Column:
    """What follows the first '://', or null."""
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(_after(url), r"\A[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path_of_url(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of rule and verdict, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for at, start, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(at + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """src, dst, n: links from pages of one host to another, relative links excepted."""
    links = F.regexp_extract_all(F.col(html_col), F.lit(r"(?i)\bhref\s*=\s*[\"']?\s*((?:https?:)?//[^\"'\s>]+)"), 1)
    seen = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.array_distinct(links)).alias("link"))
    full = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))
    return seen.select("src", host_of(full).alias("dst")).where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(host, score): walks from seeds(host, weight) along edges(src, dst, n), damped at every step.

    It ends when scores change by less than TOLERANCE in all and the last steps reached no new host.
    """
    total = seeds.agg(F.sum("weight")).first()[0] or 1
    seeds = stored(seeds.select("host", (F.col("weight") / F.lit(float(total))).alias("seed")), "seeds")
    out = edges.groupBy("src").agg(F.sum("n").alias("all"))
    share = stored(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("all") * DAMPING).alias("share")), "edges")
    score = seeds.select("host", (F.col("seed") * (1 - DAMPING)).alias("score"))
    restart = score
    while True:
        before = score
        for _ in range(STEPS_WRITTEN):
            moved = share.join(score, share.src == score.host).groupBy("dst").agg(F.sum(F.col("share") * F.col("score")).alias("score"))
            score = restart.unionByName(moved.select(F.col("dst").alias("host"), "score")).groupBy("host").agg(F.sum("score").alias("score"))
        score = stored(score, "scores")
        change = score.select("host", "score").unionByName(before.select("host", (-F.col("score")).alias("score"))).groupBy("host").agg(F.abs(F.sum("score")).alias("d"), F.count("*").alias("n"))
        moved_by, added = change.agg(F.sum("d"), F.count_if(F.col("n") == 1)).first()
        if (moved_by or 0.0) < TOLERANCE and not added:
            break
    return score


def judge(pages: DataFrame, rules=RULES, ratio: float = 1.0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, host, path, rule, verdict, and the host's trust and distrust."""
    url = F.col(url_col).cast("string")
    hosts = pages.select(F.col(id_col), host_of(url).alias("host"), path_of_url(url).alias("path"))
    hosts = hosts.withColumn("_found", rule_of(F.col("host"), F.col("path"), rules))
    votes = hosts.where("_found is not null").groupBy("host").agg(F.count_if(F.col("_found.verdict") == "allow").alias("allowed"), F.count_if(F.col("_found.verdict") == "block").alias("blocked"))
    votes = stored(votes, "votes")
    edges = stored(host_edges(pages, url_col, html_col), "links")
    trust = propagate(edges, votes.where("allowed > 0 and blocked = 0").select("host", F.col("allowed").alias("weight")))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = propagate(back, votes.where("blocked > 0 and allowed = 0").select("host", F.col("blocked").alias("weight")))
    scores = trust.withColumnRenamed("score", "trust").join(distrust.withColumnRenamed("score", "distrust"), "host", "full")
    joined = hosts.join(scores, "host", "left")
    low = F.coalesce("distrust", F.lit(0.0)) > ratio * F.coalesce("trust", F.lit(0.0))
    verdict = F.coalesce("_found.verdict", F.when(low, "block").otherwise("allow"))
    return joined.select(id_col, "host", "path", F.col("_found.rule").alias("rule"), verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op3_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")
