"""URL verdicts from rules, and for other urls from trust spread over the host graph.

Hosts link to hosts. Trust starts at hosts that an allow rule names and follows links
(personalised PageRank); distrust starts at hosts that a block rule names and follows links
backwards, since who links to a bad host is suspect. A host passes if its trust less its
distrust reaches a threshold. Everything is DataFrame work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.runtime import cut

# Fixed values: (rule, verdict); a rule is a host, a slash and the beginning of a path.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
DAMPING = 0.85
TOLERANCE = 1e-3
MOST_ROUNDS = 100
THRESHOLD = 0.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Absolute and protocol-relative targets of links and embedded files.
LINK = r"(?i)(?:href|src|action)\s*=\s*[\"']?\s*(?:https?:)?//([^/?#\"'\s<>]+)"


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z in lower case; empty without one."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to '?', '#' or the end; empty without a host part."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. ``rules`` is a short list."""
    def fits(rule: str) -> Column:
        at, start = rule.split("/", 1)
        return ((host == at) | F.endswith(host, F.lit(f".{at}"))) & F.startswith(path, F.lit(f"/{start}"))

    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        found = F.when(fits(rule), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, counted before they are shuffled."""
    hosts = F.transform(F.regexp_extract_all(F.col("html"), F.lit(LINK), F.lit(1)), lambda h: F.translate(h, _UPPER, _LOWER))
    links = pages.where(F.col("url").isNotNull() & F.col("html").isNotNull()).select(host_of(F.col("url")).alias("src"), F.explode(hosts).alias("dst"))
    return links.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def seeds(pages: DataFrame, rules=RULES) -> DataFrame:
    """(host, trusted, blocked): urls of each host that an allow or block rule decides."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    return (pages.select(host.alias("host"), best_rule(host, path, rules)["verdict"].alias("v")).where("host <> ''").groupBy("host")
            .agg(F.count_if(F.col("v") == "allow").alias("trusted"), F.count_if(F.col("v") == "block").alias("blocked")))


def propagate(edges: DataFrame, marked: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, rounds: int = MOST_ROUNDS) -> DataFrame:
    """(host, trust, distrust) of every host in ``marked`` or ``edges``.

    Both walks run together: kind 0 follows links, kind 1 goes against them, each restarting
    at its seeds in proportion to their urls. What reaches a host without a way on restarts
    too. The loop ends when no score moves by more than the share ``tolerance`` of itself and
    no host is newly reached, so it does not depend on how many seeds share the scores.
    """
    both = edges.select(F.lit(0).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "n").union(
        edges.select(F.lit(1), F.col("dst"), F.col("src"), "n"))
    leaving = both.groupBy("kind", "a").agg(F.sum("n").alias("all"))
    steps = cut(both.join(leaving, ["kind", "a"]).select("kind", "a", "b", (F.col("n") / F.col("all")).alias("w")), "steps")
    kinds = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("trusted").alias("s")), F.struct(F.lit(1).alias("kind"), F.col("blocked").alias("s"))))
    hosts = marked.select("host", kinds.alias("x")).select("host", "x.kind", F.col("x.s").cast("double").alias("s")).union(
        both.select(F.col("a").alias("host"), "kind", F.lit(0.0))).union(both.select(F.col("b").alias("host"), "kind", F.lit(0.0)))
    hosts = cut(hosts.groupBy("host", "kind").agg(F.sum("s").alias("s")), "hosts")
    total = {r["kind"]: r["s"] for r in hosts.groupBy("kind").agg(F.sum("s").alias("s")).collect()}
    restart = F.when(F.col("kind") == 0, F.col("s") / F.lit(total.get(0) or 1.0)).otherwise(F.col("s") / F.lit(total.get(1) or 1.0))
    base = hosts.select("host", "kind", restart.alias("restart"))
    scores = base.withColumn("score", F.col("restart"))
    quiet = steps.isEmpty()  # without links every walk stays at its seeds
    for turn in range(1, 0 if quiet else rounds + 1):
        moved = (scores.join(steps, (F.col("host") == F.col("a")) & (scores["kind"] == steps["kind"]))
                 .groupBy(F.col("b").alias("host"), steps["kind"]).agg(F.sum(F.col("score") * F.col("w")).alias("got")))
        arrived = base.join(moved, ["host", "kind"], "left").withColumn("got", F.coalesce("got", F.lit(0.0)))
        # What did not move on restarts with the rest of the walk.
        kept = {r["kind"]: r["g"] for r in moved.groupBy("kind").agg(F.sum("got").alias("g")).collect()}
        part = lambda k: 1 - damping * (kept.get(k) or 0.0)
        fresh = arrived.select("host", "kind", "restart", (damping * F.col("got") + F.col("restart") * F.when(
            F.col("kind") == 0, F.lit(part(0))).otherwise(F.lit(part(1)))).alias("score"))
        fresh = cut(fresh, "scores")
        gap = fresh.join(scores.select("host", "kind", F.col("score").alias("old")), ["host", "kind"]).where("score > 0").agg(F.max(F.abs(F.col("score") - F.col("old")) / F.col("score"))).first()[0]
        scores = fresh
        if (gap or 0.0) <= tolerance:
            break
    return scores.groupBy("host").agg(F.sum(F.when(F.col("kind") == 0, F.col("score"))).alias("trust"), F.sum(F.when(F.col("kind") == 1, F.col("score"))).alias("distrust"))


def judge_urls(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every row of ``pages``.

    * A rule fits its host and all subdomains if the path starts with the rule's; the longest
      wins. Its verdict stands. Other urls pass if trust - distrust of their host is at
      least ``threshold``; hosts that no walk reaches have 0 and 0.
    * A null url, or one without '://', has an empty host and path and no scores: allowed
      if ``threshold`` is not above 0.
    * Null html has no links. Links inside a host carry nothing. Repeated rows each get a row.
    * A host with very many pages is one row of scores; its pages stay where they are while
      the scores are looked up.
    """
    scores = cut(propagate(host_edges(pages), seeds(pages, rules), tolerance=tolerance), "scores")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), best_rule(host, path, rules).alias("_r"))
    net = F.coalesce(F.col("trust") - F.col("distrust"), F.lit(0.0))
    return rows.join(scores, "host", "left").select(
        "page_id", "host", "path", F.col("_r.rule").alias("rule"),
        F.coalesce(F.col("_r.verdict"), F.when(net >= threshold, "allow").otherwise("block")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
