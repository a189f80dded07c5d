"""URL filter: host and path rules, and a tree of path templates judged by the purity of their labels.

1. Host and path are cut from the url; the longest rule that fits decides, and labels the url for step 2.
2. Templates. Segments that look like values (numbers, hexadecimal ids, dates, long mixed tokens) become
   wildcards of their shape. The tree is built from the host down, one level for each segment: below one node,
   literal segments that are more than `most_branches` become one wildcard too. A node counts the labels of
   all urls at and below it. Siblings whose labelled block rates do not differ from the rest (two-proportion
   z test) are merged, so that their labels count together; what is below them stays apart.
3. A url that no rule decides is blocked if its template's smoothed block rate is at least `reject`:
   (blocked + strength * up) / (labelled + strength), where `up` is the rate of the node above, so templates
   back off to their parents, the host, and a prior that allows. A url without segments is judged by its host.

All counts are sums by (host, node): partial sums are made before the shuffle, so a host that holds a
third of all urls is a few rows for each task. Each level is one staged table of the distinct shapes that are
at least as deep; there are `LEVELS` of them, and the last segment of the last level is all that is left of a path.

Defined results: null url or one without :// has empty host and path, no rule, and is allowed by the prior.
Repeated rows are judged each. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

# Fixed values: (verdict, host, path) of the production rules.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
LEVELS = 12  # of the template tree


def host_and_path(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule (host and path together) that fits: struct of rule and verdict, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def shape(segment: Column) -> Column:
    """A literal segment, or the wildcard of its shape; the file ending is kept."""
    stem = F.regexp_replace(segment, r"\.[A-Za-z]{1,5}$", "")
    end = F.regexp_extract(segment, r"(\.[A-Za-z]{1,5})$", 1)
    wild = (
        F.when(stem.rlike(r"^[0-9]+$"), "{n}")
        .when(stem.rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), "{date}")
        .when(stem.rlike(r"^[0-9a-fA-F-]{8,}$") & stem.rlike("[0-9]"), "{hex}")
        .when((F.length(stem) >= 12) & stem.rlike("[0-9]"), "{id}")
    )
    return F.when(wild.isNull(), segment).otherwise(F.concat(wild, end))


def descend(tree: DataFrame, level: int, levels: int, most_branches: int, strength: float, z: float) -> DataFrame:
    """The shapes that are at least `level` segments deep, each taken from its node to the one below."""
    tree = tree.where(F.col("depth") >= level).withColumn("seg", F.element_at(F.split("shapes", "/", levels), level))
    seen = tree.groupBy("host", "node", "seg").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.max("purity").alias("up"))
    # Literal segments that are too many become one wildcard: counted by sums, never listed.
    literal = ~F.col("seg").startswith("{")
    above = seen.groupBy("host", "node").agg(F.sum(literal.cast("long")).alias("branches"), F.sum("n").alias("pn"), F.sum("b").alias("pb"))
    seen = seen.join(above, ["host", "node"]).withColumn("branch", F.when((F.col("branches") > most_branches) & literal, "{*}").otherwise(F.col("seg")))
    nodes = seen.groupBy("host", "node", "branch").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), *(F.max(c).alias(c) for c in ("pn", "pb", "up")))
    # A branch that does not differ from its siblings together counts with them.
    n, b, pn, pb = (F.col(c).cast("double") for c in ("n", "b", "pn", "pb"))
    one, share = F.lit(1.0), F.try_divide(pb, pn)
    gap = F.abs(F.try_divide(b, n) - F.try_divide(pb - b, pn - n))
    error = F.sqrt(share * (one - share) * (F.try_divide(one, n) + F.try_divide(one, pn - n)))
    nodes = nodes.withColumn("own", F.coalesce(gap > z * error, F.lit(False)))
    merged = nodes.groupBy("host", "node").agg(F.sum(F.when(~F.col("own"), F.col("n")).otherwise(0)).alias("mn"), F.sum(F.when(~F.col("own"), F.col("b")).otherwise(0)).alias("mb"))
    nodes = nodes.join(merged, ["host", "node"])
    n, b = F.when(F.col("own"), F.col("n")).otherwise(F.col("mn")), F.when(F.col("own"), F.col("b")).otherwise(F.col("mb"))
    nodes = nodes.select("host", "node", "branch", ((b + strength * F.col("up")) / (n + strength)).alias("purity"))
    known = seen.select("host", "node", "seg", "branch").join(nodes, ["host", "node", "branch"])
    return tree.drop("purity").join(known, ["host", "node", "seg"]).select("host", "shapes", "depth", "n", "b", F.concat("node", F.lit("/"), "branch").alias("node"), "purity")


def judge(pages: DataFrame, rules=RULES, most_branches: int = 50, strength: float = 5.0, prior: float = 0.1, reject: float = 0.8, z: float = 1.96, levels: int = LEVELS) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity (smoothed block rate) for every url. The tree has `levels` levels:
    from there on what is left of a path is one segment, so that a trap of endless paths makes no more jobs than others."""
    host, path = host_and_path(F.col("url"))
    base = pages.select("page_id", host.alias("host"), path.alias("path"))
    base = base.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    base = base.withColumn("shapes", F.array_join(F.transform(segments, shape), "/"))
    blocked, labelled = F.col("r.verdict").eqNullSafe("block").cast("long"), F.col("r").isNotNull().cast("long")
    tree = base.groupBy("host", "shapes").agg(F.sum(labelled).alias("n"), F.sum(blocked).alias("b"))
    depth = F.when(F.col("shapes") == "", 0).otherwise(F.size(F.split("shapes", "/", levels)))
    hosts = tree.groupBy("host").agg(((F.sum("b") + strength * prior) / (F.sum("n") + strength)).alias("purity"))
    tree = staged(tree.join(hosts, "host").select("host", "shapes", depth.alias("depth"), "n", "b", F.lit("").alias("node"), "purity"), "urls-0")
    deepest = tree.agg(F.max("depth")).first()[0] or 0
    ends = [tree.where("depth = 0")]
    for level in range(1, deepest + 1):
        tree = staged(descend(tree, level, levels, most_branches, strength, z), f"urls-{level}")
        ends.append(tree.where(F.col("depth") == level))
    known = ends[0]
    for end in ends[1:]:
        known = known.unionAll(end)
    out = base.join(known.select("host", "shapes", "node", "purity"), ["host", "shapes"])
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("purity") >= reject, "block").otherwise("allow"))
    template = F.when(F.col("node") == "", "/").otherwise(F.col("node"))
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), template.alias("template"), "purity")
