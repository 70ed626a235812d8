"""URL filters: fixed rules first, then trust that flows over the graph of hosts.

Rules name a host and the start of a path; a rule fits its host and all subdomains, and the longest one that fits
decides. For other pages the host decides: trust is a PageRank personalised to hosts that allow rules name (or whose
pages they allow), distrust one over reversed edges, personalised to hosts with blocked pages. A host whose distrust,
as a share of the two, is over the threshold is blocked. Edges are absolute links of the pages' html and the step from
a host to the domain above it (a subdomain vouches for its domain and the other way round, at a lower weight).

Null urls and such without `://` have empty host and path; no rule but the method judges them: they have no host in
the graph and are allowed. Repeated rows are judged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import ascii_lower, materialize, table

#: Verdict, host, start of the path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
DAMPING, ROUNDS, DISTRUSTED = 0.85, 8, 0.5


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if there is no `://`."""
    url = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return ascii_lower(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)


def match_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null where none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, domain, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(domain + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame, html_col: str | None = "html") -> DataFrame:
    """src, dst, weight out of pages(host, html): counted links between different hosts and the domains above hosts."""
    names = pages.select("host").where("host <> ''")
    targets = None
    if html_col:
        # no break inside a tag's quotes; a link without a scheme stays on its host and is no edge
        refs = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(html_col, F.lit(r"(?i)href\s*=\s*[\"']?([a-z][a-z0-9+.-]*://[^\"'\s>]+)"), F.lit(1))).alias("ref"))
        targets = refs.select("src", url_parts(F.col("ref"))[0].alias("dst")).where("dst <> '' and dst <> src").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    hosts = names.distinct()
    if targets is not None:
        hosts = hosts.unionByName(targets.select(F.col("dst").alias("host"))).distinct()
    above = hosts.select(F.col("host").alias("src"), F.regexp_extract("host", r"^[^.]+\.(.+\..+)$", 1).alias("dst")).where("dst <> ''")
    kin = above.select("src", "dst", F.lit(1.0).alias("weight")).unionByName(above.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0.5).alias("weight")))
    return kin if targets is None else kin.unionByName(targets)


def personalised_rank(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """host, score: `rounds` steps of PageRank that restarts at seeds(host, share).

    A host's rank flows along its edges by weight; what hosts without edges hold is not passed on. Without seeds all
    scores are 0. Every second round is written to the shared folder.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    flow = materialize(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("part")))
    restart = seeds.select("host", (F.col("share") * (1 - damping)).alias("score"))
    rank = seeds.select("host", F.col("share").alias("score"))
    for i in range(rounds):
        passed = flow.join(rank, F.col("src") == F.col("host")).select(F.col("dst").alias("host"), (F.col("score") * F.col("part") * damping).alias("score"))
        rank = passed.unionByName(restart).groupBy("host").agg(F.sum("score").alias("score"))
        if i % 2 == 1 or i == rounds - 1:
            rank = materialize(rank)
    return rank


def _seeds(found: DataFrame, verdict: str) -> DataFrame:
    """host, share: the hosts of found(host, verdict, pages) by their pages with that verdict, shares adding up to 1."""
    counted = found.where(F.col("verdict") == verdict).select("host", F.col("pages").alias("n"))
    total = counted.agg(F.sum("n")).first()[0] or 1
    return counted.select("host", (F.col("n") / F.lit(total)).alias("share"))


def host_scores(found: DataFrame, edges: DataFrame, **how) -> DataFrame:
    """host, trust, distrust, distrusted (share of distrust in the two) for the hosts that either reaches."""
    trust = personalised_rank(edges, materialize(_seeds(found, "allow")), **how)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    distrust = personalised_rank(back, materialize(_seeds(found, "block")), **how)
    both = trust.select("host", F.col("score").alias("trust"), F.lit(0.0).alias("distrust")).unionByName(distrust.select("host", F.lit(0.0).alias("trust"), F.col("score").alias("distrust")))
    summed = both.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
    return summed.withColumn("distrusted", F.col("distrust") / F.greatest(F.col("trust") + F.col("distrust"), F.lit(1e-300)))


def judge_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html", threshold: float = DISTRUSTED, **how) -> DataFrame:
    """page_id, host, path, rule, verdict, distrusted for every row of pages."""
    host, path = url_parts(F.col(url_col))
    plain = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), *([F.col(html_col).alias("html")] if html_col else []))
    found = plain.withColumn("_m", match_rule(F.col("host"), F.col("path"), rules)).withColumn("rule", F.col("_m.rule")).withColumn("verdict", F.col("_m.verdict")).drop("_m")
    counted = materialize(found.where("host <> ''").groupBy("host", "verdict").agg(F.count("*").alias("pages")))
    edges = materialize(host_edges(plain, "html" if html_col else None))
    scores = host_scores(counted, edges, **how).select(F.col("host").alias("_host"), "distrusted")
    judged = found.drop("html").join(scores, F.col("host") == F.col("_host"), "left")
    by_method = F.when(F.coalesce("distrusted", F.lit(0.0)) > threshold, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", by_method).alias("verdict"), "distrusted")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of all pages."""
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op9_url_filter": op9_url_filter}
ORACLES: dict[str, str] = {}
