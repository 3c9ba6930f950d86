"""URL filters by a path-template tree, with DataFrame functions only.

1. Generalise: a host's paths form a tree of segments. Segments that are variable
   by shape (numbers, long hexadecimal, dates, mixed ids) become wildcards row by
   row; then, level by level from the root, children that are too thin among too
   many siblings become a wildcard too, and what lies under them is pooled before
   the next level is decided. Levels at which no host has so many different
   segments, such as the far ends of very long paths, are passed over.
2. Merge: the root's children are the hosts, theirs the first segments, and so on.
   At every level a branch is held against the pool of all branches of its parent:
   it merges into the pool if the templates below it are distributed alike (a
   chi-square statistic within its noise, or a small effect) and, where both the
   branch and the rest of the pool have labels, their shares of bad ones agree.
   Each branch is compared with one pool, so no pairs of branches are made.
3. Reject: a template takes its own labels; if it has too few, those of the same
   template in the merged branches of the deepest level that has enough, up to the
   merged hosts. It is rejected if the smoothed share of bad labels reaches the
   purity threshold. The tree is built from counts by (host, template).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom.llm.common import stage, table

MANY, THIN = 20, 0.05
PRIOR_WEIGHT, PURITY, MIN_LABELS = 2.0, 0.8, 3
NOISE, EFFECT, APART = 3.0, 0.1, 2.0
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for urls without `://`."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null; rules are the filter's configuration, `host/path prefix` each."""
    best = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        h, _, p = rule.partition("/")
        p = "/" + p if "/" in rule else ""
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        best = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def shape(segment: Column) -> Column:
    """A segment, or the wildcard of its shape."""
    s = segment
    s = F.regexp_replace(s, r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}(?=\.|$)", "{uuid}")
    s = F.regexp_replace(s, r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?=\.|$)", "{date}")
    s = F.regexp_replace(s, r"^(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{8,}(?=\.|$)", "{hex}")
    return F.regexp_replace(s, r"[0-9]+", "{n}")


def template_tree(counts: DataFrame, many: int = MANY, thin: float = THIN) -> DataFrame:
    """`counts(host, shaped, n, good, bad)` -> the same with `parts`, the array of the template's segments.

    A round for each level at which some host has more than `many` different segments; others can hold no thin child.
    """
    seg = F.filter(F.split("shaped", "/"), lambda s: s != "")
    tree = stage(counts.withColumn("seg", seg).withColumn("parts", F.slice(seg, 1, 0)), "tree")
    kinds = tree.select("host", F.posexplode("seg").alias("at", "child")).distinct().groupBy("host", "at").agg(F.count("*").alias("kinds"))
    busy = sorted(r["at"] + 1 for r in kinds.where(F.col("kinds") > many).select("at").distinct().collect())  # levels of paths
    upto = lambda end: F.concat("parts", F.slice("seg", F.size("parts") + 1, F.greatest(end - F.size("parts"), F.lit(0))))
    node = ["host", "parts"]
    for depth in busy:
        there = F.size("seg") >= depth
        tree = tree.withColumn("parts", F.when(there, upto(F.lit(depth - 1))).otherwise(F.col("parts"))).withColumn("child", F.when(there, F.try_element_at("seg", F.lit(depth))))
        child = tree.where(there).groupBy(*node, "child").agg(F.sum("n").alias("load"))
        wide = child.groupBy(*node).agg(F.count("*").alias("children"), F.sum("load").alias("total")).where(F.col("children") > many)
        loose = child.join(wide, node).where((F.col("load") < thin * F.col("total")) & ~F.contains("child", F.lit("{"))).select(*node, "child", F.lit(True).alias("loose"))
        step = tree.join(loose, [*node, "child"], "left")
        name = F.when(F.col("loose"), F.lit("{*}")).otherwise(F.col("child"))
        tree = stage(step.withColumn("parts", F.when(there, F.concat("parts", F.array(name))).otherwise(F.col("parts"))).drop("child", "loose"), "tree")
    return tree.withColumn("parts", upto(F.size("seg"))).drop("seg")


def smoothed(bad: Column, good: Column, prior: Column | float, weight: float = PRIOR_WEIGHT) -> Column:
    return (bad + weight * prior) / (bad + good + weight)


def branches(leaves: DataFrame, min_labels: int = MIN_LABELS) -> tuple[DataFrame, DataFrame]:
    """`leaves(host, parts, n, good, bad)` -> (places, merged).

    places: a row for each leaf and level: host, parts, level, above (the parent),
    branch, below (what follows the branch). merged: (above, branch) of the
    branches that go into their parent's pool.
    """
    node = F.concat(F.array(F.col("host")), "parts")
    levels = leaves.withColumn("node", node).select("*", F.explode(F.sequence(F.lit(0), F.size("parts"))).alias("level"))
    places = levels.select(
        "host", "parts", "level", F.expr("array_join(slice(node, 1, level), '/')").alias("above"), F.expr("element_at(node, level + 1)").alias("branch"),
        F.expr("array_join(slice(node, level + 2, size(node)), '/')").alias("below"), "n", "good", "bad",
    )
    places = stage(places, "places")
    # Level 0 has no parent's name, as a host with an empty name has at level 1.
    pool = places.groupBy("level", "above", "below").agg(F.sum("n").alias("pool"))
    whole = places.groupBy("level", "above").agg(F.sum("n").alias("all"), F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad"))
    kinds = pool.groupBy("level", "above").agg(F.count("*").alias("kinds"))
    own = places.join(pool, ["level", "above", "below"]).groupBy("level", "above", "branch").agg(
        F.sum("n").alias("size"), F.sum(F.col("n") * F.col("n") / F.col("pool")).alias("squares"), F.sum("good").alias("g"), F.sum("bad").alias("b")
    )
    own = own.join(whole, ["level", "above"]).join(kinds, ["level", "above"])
    distance = F.greatest(F.col("squares") * F.col("all") / F.col("size") / F.col("size") - 1, F.lit(0.0)) * F.col("size")
    free = F.col("kinds") - 1
    alike = (distance <= free + NOISE * F.sqrt(2.0 * free)) | (distance <= EFFECT * F.col("size"))
    mine, others = F.col("g") + F.col("b"), F.col("all_good") + F.col("all_bad") - F.col("g") - F.col("b")
    share = (F.col("all_bad") + 1) / (F.col("all_good") + F.col("all_bad") + 2)
    gap = F.abs(F.col("b") / mine - (F.col("all_bad") - F.col("b")) / others)
    enough = (mine >= min_labels) & (others >= min_labels)
    agree = F.when(enough, gap <= APART * F.sqrt(share * (1 - share) * (1 / mine + 1 / others))).otherwise(F.lit(True))
    return places, own.where(alike & agree).select("level", "above", "branch")


def purities(tree: DataFrame, min_labels: int = MIN_LABELS) -> DataFrame:
    """`template_tree` -> (host, parts, level, labelled, purity): the labels a template is judged by, and the level they are pooled at (null: its own)."""
    leaves = tree.groupBy("host", "parts").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    leaves = stage(leaves, "leaves")
    every = leaves.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("b"), F.coalesce(F.sum("good"), F.lit(0)).alias("g")).first()
    prior = (every["b"] + 1) / (every["b"] + every["g"] + 2)
    places, merged = branches(leaves, min_labels)
    inside = places.join(merged, ["level", "above", "branch"], "left_semi")
    pools = inside.groupBy("level", "above", "below").agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).where(F.col("g") + F.col("b") >= min_labels)
    best = inside.join(pools, ["level", "above", "below"]).groupBy("host", "parts").agg(F.max(F.struct("level", "g", "b")).alias("p"))
    out = leaves.join(best, ["host", "parts"], "left")
    own = F.col("good") + F.col("bad") >= min_labels
    take = lambda mine, theirs: F.when(own | F.col("p").isNull(), F.col(mine)).otherwise(F.col(f"p.{theirs}"))
    out = out.select("host", "parts", F.when(~own, F.col("p.level")).alias("level"), take("good", "g").alias("g"), take("bad", "b").alias("b"))
    return out.select("host", "parts", "level", (F.col("g") + F.col("b")).alias("labelled"), F.round(smoothed(F.col("b"), F.col("g"), prior), 6).alias("purity"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, labels: DataFrame | None = None, purity: float = PURITY, min_labels: int = MIN_LABELS) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, template, level, labelled, purity.

    `labels(page_id, bad boolean)` label some pages; without them, pages that a
    rule decides are the labelled ones. Without a rule, a page is blocked if its
    template is judged by at least `min_labels` labels with a smoothed share of
    bad ones of at least `purity`. Null urls, and urls without `://`, have empty
    host and path and the template of the empty host. Repeated rows give repeated
    results (and count as often), null ids stay null; an empty table gives an
    empty result; extra columns are ignored.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url")
    host, path = host_and_path(F.col("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("hit", longest_rule(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("shaped", F.array_join(F.transform(F.split("path", "/"), shape), "/"))
    if labels is None:
        marked = rows.withColumn("bad", F.col("hit.verdict") == "block")
    else:
        marked = rows.join(labels.select(F.col("page_id").cast("long").alias("page_id"), "bad").dropDuplicates(["page_id"]), "page_id", "left")
    counts = marked.groupBy("host", "shaped").agg(F.count("*").alias("n"), F.count_if(~F.col("bad")).alias("good"), F.count_if(F.col("bad")).alias("bad"))
    tree = template_tree(counts)
    named = tree.select("host", "shaped", "parts").join(purities(tree, min_labels), ["host", "parts"])
    named = named.withColumn("template", F.concat(F.lit("/"), F.array_join("parts", "/"))).drop("parts")
    out = rows.join(stage(named, "templates"), ["host", "shaped"])
    own = F.when((F.col("labelled") >= min_labels) & (F.col("purity") >= purity), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", own).alias("verdict"), "template", "level", "labelled", "purity")


def op2_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))
