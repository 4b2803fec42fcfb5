"""URL filter by a tree of path templates per host and the smoothed purity of their labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: (verdict, host, path prefix) of the labelled rules.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DEPTH, MOST_CHILDREN, REPEATS, Z, PRIOR, REJECT = 6, 20, 10, 1.96, 5.0, 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host behind the first ://, A-Z lower-cased, and the path behind it; both empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (the host itself or a subdomain, the path's beginning), as text, and its verdict; null without any."""
    rule = verdict = F.lit(None).cast("string")
    for decision, top, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == top) | host.endswith(f".{top}")) & path.startswith(prefix)
        rule, verdict = F.when(fits, top + prefix).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    return rule, verdict


def segments(path: Column, depth: int = DEPTH) -> Column:
    """The path's segments, variable-looking ones as classes: <n> digits, <x> long hexadecimal, <d> dates; beyond `depth` one **."""
    def classed(s: Column) -> Column:
        name, dot = F.regexp_extract(s, r"^(.*?)(\.[a-z]{1,5})?$", 1), F.regexp_extract(s, r"^.*?(\.[a-z]{1,5})$", 1)
        kind = F.when(name.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "<d>").when(name.rlike("^[0-9]+$"), "<n>").when(name.rlike("^[0-9a-f-]{12,}$"), "<x>")
        return F.coalesce(F.concat(kind, dot), s)

    parts = F.filter(F.split(F.translate(path, _UPPER, _LOWER), "/"), lambda s: s != "")
    parts = F.when(F.size(parts) > depth, F.concat(F.slice(parts, 1, depth), F.array(F.lit("**")))).otherwise(parts)
    return F.transform(parts, classed)


def _replaced(parts: Column, level: int, by: Column) -> Column:
    return F.transform(parts, lambda s, i: F.when((i == level) & by, "*").otherwise(s))


def path_templates(
    urls: DataFrame, depth: int = DEPTH, most_children: int = MOST_CHILDREN, repeats: int = REPEATS, z: float = Z
) -> DataFrame:
    """(host, parts, template): the template of each path; `urls`: (host, parts, allow, block, n), one row per host and path.

    Level by level from the root, the children of a node become one wildcard if they are more than `most_children` and repeat less than
    `repeats` times on average. Then, from the last level up, literal siblings merge into a wildcard if below them stand the same templates and
    each one's share of blocked labels is within `z` standard errors of that of all of them together; siblings without labels stay.
    """
    tree = stored(urls.withColumn("template", F.col("parts")), "tree")
    depth = min(depth, tree.agg(F.max(F.size("template"))).first()[0] or 0)
    for level in range(depth):
        above = F.slice("template", 1, level)
        at = tree.filter(F.size("template") > level)
        children = at.groupBy("host", above.alias("above"), F.get("template", F.lit(level)).alias("child")).agg(F.sum("n").alias("n"))
        wild = children.groupBy("host", "above").agg(F.count("*").alias("children"), F.sum("n").alias("n"))
        wild = wild.filter((F.col("children") > most_children) & (F.col("n") < repeats * F.col("children")))
        wild = stored(wild.select(F.col("host").alias("h"), F.col("above").alias("a")), "wild")
        tree = tree.join(wild, (F.col("host") == F.col("h")) & (above == F.col("a")) & (F.size("template") > level), "left")
        tree = tree.withColumn("template", _replaced(F.col("template"), level, F.col("h").isNotNull())).drop("h", "a")
        tree = stored(tree, "tree")
    for level in range(depth - 1, -1, -1):
        nodes = tree.filter(F.size("template") > level).select(
            "host", F.slice("template", 1, level).alias("above"), F.get("template", F.lit(level)).alias("child"),
            F.xxhash64(F.slice("template", level + 2, depth + 2)).alias("below"), "allow", "block",
        )
        shapes = nodes.groupBy("host", "above", "child", "below").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
        branch = shapes.groupBy("host", "above", "child").agg(
            F.sum("allow").alias("allow"), F.sum("block").alias("block"), F.bit_xor(F.xxhash64("below")).alias("shape"), F.count("*").alias("width")
        )
        branch = stored(branch.filter("child <> '*' and allow + block > 0"), "branch")
        family = branch.groupBy("host", "above", "shape", "width").agg(
            F.sum("allow").alias("fa"), F.sum("block").alias("fb"), F.count("*").alias("members")
        )
        family = stored(family.filter("members > 1"), "family")
        n, p = F.col("allow") + F.col("block"), F.col("fb") / (F.col("fa") + F.col("fb"))
        alike = F.abs(F.col("block") / n - p) <= z * F.sqrt(p * (1 - p) / n)
        merged = branch.join(family, ["host", "above", "shape", "width"]).filter(alike)
        merged = stored(merged.select(F.col("host").alias("h"), F.col("above").alias("a"), F.col("child").alias("c")), "merged")
        here = (F.col("host") == F.col("h")) & (F.slice("template", 1, level) == F.col("a")) & (F.get("template", F.lit(level)) == F.col("c"))
        tree = tree.join(merged, here, "left")
        tree = stored(tree.withColumn("template", _replaced(F.col("template"), level, F.col("h").isNotNull())).drop("h", "a", "c"), "tree")
    return tree


def template_shares(tree: DataFrame, prior: float = PRIOR) -> DataFrame:
    """(host, template, block_share, own_labels) of the templates of `path_templates`.

    On the way from the host's root down to the template, each node's share of blocked labels is smoothed by `prior` labels' worth of the share above
    it, so a template without labels has the share of its nearest parent with some. Above the root stands the share of the same template on other
    hosts; where that has no labels, the root's own share, and where the host has none either, nothing: null.
    """
    own = tree.groupBy("host", "template").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
    own = stored(own, "own")
    level = F.explode(F.sequence(F.lit(0), F.size("template"))).alias("level")
    nodes = own.select("host", "template", "allow", "block", level).groupBy("host", F.slice("template", F.lit(1), F.col("level")).alias("node"))
    nodes = stored(nodes.agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")), "nodes")
    way = own.select("host", "template", level).withColumn("node", F.slice("template", F.lit(1), F.col("level"))).join(nodes, ["host", "node"])
    way = way.groupBy("host", "template").agg(F.array_sort(F.collect_list(F.struct("level", "allow", "block"))).alias("way"))
    everywhere = own.groupBy("template").agg(F.sum("allow").alias("all_allow"), F.sum("block").alias("all_block"))
    known = own.join(stored(everywhere, "everywhere"), "template").join(way, ["host", "template"])
    others = F.col("all_allow") + F.col("all_block") - F.col("allow") - F.col("block")
    elsewhere = (F.col("all_block") - F.col("block")) / F.nullif(others, F.lit(0))

    def down(share: Column, node: Column) -> Column:
        n = node["allow"] + node["block"]
        return F.when(n == 0, share).when(share.isNull(), node["block"] / n).otherwise((node["block"] + prior * share) / (n + prior))

    root = F.get("way", F.lit(0))
    return known.select(
        "host", "template", F.aggregate("way", elsewhere.cast("double"), down).alias("block_share"), (root["allow"] + root["block"] > 0).alias("own_labels")
    )


def judge_urls(
    pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", depth: int = DEPTH, prior: float = PRIOR, reject: float = REJECT
) -> DataFrame:
    """Per page: id, host, path, rule, verdict, template, block_share and own_labels.

    Urls that a rule fits have its verdict and are the labels. Every other url has that of its host's path template: block if the template's share of
    blocked labels reaches `reject`, smoothed as `template_shares` says; own_labels tells whether labels of its own host speak. Without a label
    on that way the share is null and the url is allowed. A null url or one without :// has an empty host and path. One row per row.

    What is grouped are hosts with path shapes, counted before the shuffle; a host with a third of all pages is spread by its paths, and
    its tree's nodes are partial sums. The two joins back meet written tables, so adaptive execution can split a hot side.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", host.alias("host"), path.alias("path"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), segments(F.col("path"), depth).alias("parts"))
    counts = rows.groupBy("host", "parts").agg(
        F.count("*").alias("n"), F.count_if(F.col("ruled") == "allow").alias("allow"), F.count_if(F.col("ruled") == "block").alias("block")
    )
    tree = path_templates(counts, depth)
    purity = stored(template_shares(tree, prior), "shares")
    known = stored(tree.select("host", "parts", "template").join(purity, ["host", "template"]), "purity")
    judged = rows.join(known, ["host", "parts"])
    decided = F.coalesce("ruled", F.when(F.col("block_share") >= reject, "block").otherwise("allow"))
    template = F.concat(F.lit("/"), F.array_join("template", "/"))
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", decided.alias("verdict"), template.alias("template"), "block_share", "own_labels")
