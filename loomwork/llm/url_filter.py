"""URL filters: host and path rules first, then a tree of path templates for each host.

A url's path is generalised segment by segment: one with a digit, or at a place of the tree where more than `most_children`
different segments follow, becomes a wildcard. Children of one node whose labelled shares of bad pages don't differ
significantly are merged into a branch. A template's purity starts at the mean of its shares over domains, each counted once and smoothed towards
a half: what is bad on one domain alone is no ground to reject it on another, six that agree are. From there it is drawn, first at the host's root
and then at each node on its way down the host's tree, towards the share of the node's branch, the less the more domains stand behind
its start. A template whose purity of bad pages is high is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.session import written

# Verdict, host and path of the rules.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
MOST_CHILDREN = 64
DEPTH = 4
STRENGTH = 4.0
PRIOR = 0.5
REJECT_FROM = 0.8
Z = 1.96


def url_host(url: Column) -> Column:
    """What follows the first :// up to a slash, question mark or hash, A-Z in lower case; empty for other urls and null."""
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host up to a question mark or hash; empty for a url without :// and for null."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule whose host the url's host is or lies under and whose path begins its path."""
    chosen = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1], r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        chosen = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def segments(path: Column, depth: int) -> Column:
    """The path's non-empty segments, those with a digit as *; ** stands for all beyond the depth."""
    own = F.filter(F.split(path, "/"), lambda s: s != "")
    own = F.transform(own, lambda s: F.when(s.rlike("[0-9]"), F.lit("*")).otherwise(s))
    return F.when(F.size(own) > depth, F.concat(F.slice(own, 1, depth), F.array(F.lit("**")))).otherwise(own)


def template_tree(urls: DataFrame, depth: int = DEPTH, most_children: int = MOST_CHILDREN) -> DataFrame:
    """(host, raw, template, nodes) for each host and digit-free form of a path in urls(host, segs); raw and template are strings, nodes the template's segments.

    Works on the distinct forms only, level by level from the root. The children of a node are counted, so a node with
    any number of pages under it is a few rows.
    """
    tree = urls.select("host", "segs").distinct().withColumn("raw", F.array_join("segs", "/")).withColumn("made", F.array().cast("array<string>"))
    for level in range(depth):
        seg = F.get("segs", F.lit(level))
        parent = F.array_join("made", "/")
        children = tree.select("host", parent.alias("parent"), seg.alias("seg")).where("seg is not null").distinct()
        wide = children.groupBy("host", "parent").count().where(F.col("count") > most_children).select(F.col("host").alias("wide_host"), F.col("parent").alias("wide_parent"))
        tree = tree.join(wide, (F.col("host") == F.col("wide_host")) & (parent == F.col("wide_parent")), "left")
        step = F.when(seg.isNull(), F.array().cast("array<string>")).when(F.col("wide_host").isNotNull(), F.array(F.lit("*"))).otherwise(F.array(seg))
        tree = tree.withColumn("made", F.concat("made", step)).drop("wide_host", "wide_parent")
    tail = F.when(F.size("segs") > depth, F.concat("made", F.array(F.lit("**")))).otherwise(F.col("made"))
    return tree.select("host", "raw", F.array_join(tail, "/").alias("template"), tail.alias("nodes"))


def branches(nodes: DataFrame, z: float = Z) -> DataFrame:
    """(host, parent, node, b, n): the bad and labelled pages of each node's branch, from (host, parent, node, labelled, bad).

    A node's children with labels stand by their share of bad pages; neighbours whose shares differ by less than z standard
    errors are one branch. Children are most_children and two wildcards at most, so a window is small.
    """
    order = Window.partitionBy("host", "parent").orderBy("rate", "node")
    rows = nodes.where("labelled > 0").withColumn("rate", F.col("bad") / F.col("labelled"))
    rows = rows.withColumns({"rate0": F.lag("rate").over(order), "bad0": F.lag("bad").over(order), "labelled0": F.lag("labelled").over(order)})
    pooled = (F.col("bad") + F.col("bad0")) / (F.col("labelled") + F.col("labelled0"))
    error = F.sqrt(pooled * (1 - pooled) * (1.0 / F.col("labelled") + 1.0 / F.col("labelled0")))
    apart = F.coalesce((F.col("rate") - F.col("rate0") > z * error).cast("int"), F.lit(0))
    rows = rows.withColumn("apart", apart)
    rows = rows.withColumn("branch", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    branch = Window.partitionBy("host", "parent", "branch")
    return rows.select("host", "parent", "node", F.sum("bad").over(branch).alias("b"), F.sum("labelled").over(branch).alias("n"))


def domain_of(host: Column) -> Column:
    """The last two labels of a host; a host with fewer is its own domain."""
    return F.substring_index(host, ".", -2)


def template_purity(counted: DataFrame, depth: int = DEPTH, strength: float = STRENGTH, z: float = Z) -> DataFrame:
    """(host, template, purity) from (host, template, nodes, labelled, bad), a row for each template of a host."""
    share = F.sum("bad") / F.sum("labelled")
    labelled = counted.where("labelled > 0").withColumn("domain", domain_of(F.col("host")))
    everywhere = labelled.groupBy("template", "domain").agg(share.alias("share")).groupBy("template").agg(F.round(F.sum("share"), 9).alias("bad_domains"), F.count("*").alias("domains"))
    roots = counted.groupBy("host").agg(F.sum("bad").alias("b0"), F.sum("labelled").alias("n0"))
    level = F.explode(F.sequence(F.lit(1), F.size("nodes")))
    steps = counted.where("size(nodes) > 0").withColumn("level", level)
    prefix = lambda n: F.array_join(F.slice("nodes", 1, n), "/")
    steps = steps.select("host", "template", "level", prefix(F.col("level") - 1).alias("parent"), prefix(F.col("level")).alias("node"), "labelled", "bad")
    nodes = steps.groupBy("host", "parent", "node").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    held = steps.select("host", "template", "level", "parent", "node").join(branches(nodes, z), ["host", "parent", "node"])
    at = lambda k, c: F.max(F.when(F.col("level") == k, F.col(c))).alias(f"{c}{k}")
    held = held.groupBy("host", "template").agg(*[at(k, c) for k in range(1, depth + 2) for c in "bn"])
    rows = counted.select("host", "template").join(held, ["host", "template"], "left").join(everywhere, "template", "left").join(roots, "host")
    domains = F.coalesce("domains", F.lit(0))
    rows = rows.withColumn("purity", (F.coalesce("bad_domains", F.lit(0.0)) + strength * PRIOR) / (domains + strength))
    for k in range(depth + 2):
        drawn = (F.col(f"b{k}") + (strength + domains) * F.col("purity")) / (F.col(f"n{k}") + strength + domains)
        rows = rows.withColumn("purity", F.coalesce(drawn, F.col("purity")))
    return rows.select("host", "template", "purity")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, reject_from: float = REJECT_FROM, depth: int = DEPTH, most_children: int = MOST_CHILDREN, strength: float = STRENGTH, id_col: str = "page_id", url_col: str = "url", label_col: str | None = None) -> DataFrame:
    """(id, host, path, rule, verdict, template, purity), a row for each page.

    A page that a rule fits has its verdict, and is a labelled page: bad if blocked. label_col, where given, labels further pages (1: bad,
    0: good, null: none). The others are blocked if their template's purity reaches reject_from. Null urls and those without
    :// have an empty host and path and share a template, which has no nodes. Repeated rows give repeated results.
    """
    label = F.col(f"`{label_col}`") if label_col else F.lit(None).cast("int")
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), url_host(F.col(f"`{url_col}`")).alias("host"), url_path(F.col(f"`{url_col}`")).alias("path"), label.cast("int").alias("label"))
    rows = rows.withColumn("match", match_rule(F.col("host"), F.col("path"), rules)).withColumn("segs", segments(F.col("path"), depth))
    rows = rows.withColumn("raw", F.array_join("segs", "/"))
    label = F.coalesce(F.when(F.col("match.verdict") == "block", 1).when(F.col("match.verdict") == "allow", 0), F.col("label"))
    counts = rows.groupBy("host", "raw").agg(F.count(label).alias("labelled"), F.coalesce(F.sum(label), F.lit(0)).alias("bad"))
    tree = written(template_tree(rows, depth, most_children), "url-tree")
    counted = written(tree.join(counts, ["host", "raw"]).groupBy("host", "template", "nodes").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")), "url-templates")
    purity = tree.join(template_purity(counted, depth, strength), ["host", "template"]).select("host", "raw", "template", "purity")
    out = rows.join(purity, ["host", "raw"])
    by_method = F.when(F.col("purity") >= reject_from, "block").otherwise("allow")
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("match.rule").alias("rule"), F.coalesce(F.col("match.verdict"), by_method).alias("verdict"), "template", "purity")
