"""URL filters by a path-template tree (operator 2).  DataFrame operations only.

Each host has a tree of path segments.  Level by level a segment becomes a
wildcard where it is variable (it holds digits, or it is one of many rare ones
under its parent) or where its branch is statistically like its siblings (a
two-proportion test of the labelled bad share does not tell them apart).  The
leaves are templates; a template is rejected when the bad share of its labelled
pages, smoothed towards the host's and that towards the whole, passes a limit.
Fixed rules on hosts and paths come first; pages that one fits are no part of
the tree, so its purity rests on labels alone.

The tree is built on the distinct masked paths with their counts, so a host
with a third of all pages is summed map-side first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import land

#: Fixed values: (verdict, host, path) of the rules.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))

#: Levels of the tree; what lies deeper is one more segment, the tail.
DEPTH = 5
#: A parent of so many branches has rare ones (below an equal share) joined.
WIDE = 12
#: Branches whose bad shares differ by less than so many standard errors merge.
Z_MERGE = 2.6
#: Pseudo-counts of the smoothing, and the bad share that rejects.
SMOOTH, REJECT = 8.0, 0.6

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def first_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls.  Rules are a
    short list from the configuration and become one expression."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def masked_segments(path: Column, depth: int = DEPTH) -> Column:
    """Segments of a path with digits and long codes as wildcards; the end of
    the path is a segment of its own, so that /a and /a/ differ."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/", -1)
    some = F.when(F.size(parts) > depth, F.concat(F.slice(parts, 1, depth - 1), F.array(F.array_join(
        F.slice(parts, F.lit(depth), F.size(parts) - depth + 1), "/")))).otherwise(parts)
    return F.transform(some, lambda s: F.regexp_replace(F.regexp_replace(s, r"[0-9a-fA-F-]*[0-9][0-9a-fA-F-]*", "<*>"), r"(?:<\*>[^.<]*)*<\*>", "<*>"))


def _level(paths: DataFrame, level: int) -> DataFrame:
    """``paths`` with one more segment of their template."""
    seg = F.get("segments", F.lit(level))
    here = paths.where(seg.isNotNull()).select("host", "template", seg.alias("seg"), "n", "labelled", "bad")
    child = here.groupBy("host", "template", "seg").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "bad")])
    node = child.groupBy("host", "template").agg(F.count(F.lit(1)).alias("branches"), F.sum("n").alias("all_n"),
                                                 F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
    c = F.col
    rare = (c("branches") >= WIDE) & (c("n") * c("branches") < c("all_n"))
    others = c("all_labelled") - c("labelled")
    pooled = F.try_divide(c("all_bad"), c("all_labelled"))
    error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1), c("labelled")) + F.try_divide(F.lit(1), others)))
    apart = F.abs(F.try_divide(c("bad"), c("labelled")) - F.try_divide(c("all_bad") - c("bad"), others))
    # a branch without labels, or without siblings that have some, shows no difference
    alike = F.when((c("labelled") == 0) | (others == 0) | (pooled == 0) | (pooled == 1), F.lit(True)).otherwise(apart <= Z_MERGE * error)
    wide = (c("branches") > 1) & (rare | alike)
    named = (child.join(node, ["host", "template"])
             .select("host", "template", "seg", F.when(wide, F.lit("<*>")).otherwise(c("seg")).alias("part")))
    p, k = paths.withColumn("seg", seg).alias("p"), named.alias("k")
    on = (F.col("p.host") == F.col("k.host")) & (F.col("p.template") == F.col("k.template")) & (F.col("p.seg") == F.col("k.seg"))
    return p.join(k, on, "left").select("p.host", "p.segments", F.concat("p.template", F.coalesce(
        F.concat(F.lit("/"), F.col("k.part")), F.lit(""))).alias("template"), "p.n", "p.labelled", "p.bad")


def judge_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, depth: int = DEPTH,
               smooth: float = SMOOTH, reject: float = REJECT) -> DataFrame:
    """(page_id, host, path, rule, template, bad_share, verdict) of every page.

    ``labels``: (page_id, bad), bad 0 or 1, of some pages.  A page that a rule
    fits has the rule's verdict, no template and no share.  Null urls and urls without :// have an empty
    host and path and are judged like a host of their own; pages with equal or
    null ids are separate rows (a null id has no label); no labels at all
    rejects nothing; very long urls are parsed whole (what lies deeper than
    ``depth`` is one segment).
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = first_rule(F.col("host"), F.col("path"), rules)
    rows = land(rows.withColumn("segments", masked_segments(F.col("path"), depth))
                .withColumn("rule", name).withColumn("by_rule", verdict), "urls")
    free = rows.where("by_rule IS NULL")
    given = labels.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.max("bad").alias("bad"))
    labelled = (free.join(given, "page_id")
                .select("host", "segments", F.lit(0).alias("n"), F.lit(1).alias("labelled"), F.col("bad").cast("int").alias("bad")))
    counted = free.select("host", "segments", F.lit(1).alias("n"), F.lit(0).alias("labelled"), F.lit(0).alias("bad"))
    paths = land(counted.unionByName(labelled).groupBy("host", "segments")
                 .agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "bad")]).withColumn("template", F.lit("")), "url-paths")
    for level in range(depth):
        paths = land(_level(paths, level), "url-tree")
    whole = paths.agg(F.sum("labelled"), F.sum("bad")).first()
    prior = (whole[1] / whole[0]) if whole[0] else 0.0
    of_host = paths.groupBy("host").agg(((F.sum("bad") + smooth * prior) / (F.sum("labelled") + smooth)).alias("host_share"))
    leaf = paths.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    share = ((F.col("bad") + smooth * F.col("host_share")) / (F.col("labelled") + smooth)).alias("bad_share")
    judged = leaf.join(of_host, "host").select("host", "template", share)
    known = paths.select("host", "segments", "template").join(judged, ["host", "template"])
    own = F.col("by_rule").isNull()
    return (rows.join(known, ["host", "segments"], "left")
            .select("page_id", "host", "path", "rule", F.when(own, F.col("template")).alias("template"),
                    F.when(own, F.col("bad_share")).alias("bad_share"),
                    F.coalesce("by_rule", F.when(F.col("bad_share") > reject, "block").otherwise("allow")).alias("verdict")))
