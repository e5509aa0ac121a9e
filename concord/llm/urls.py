"""URL filters: rules first, then a path-template tree per host whose branches are judged by labelled purity.

Every host has a tree of path templates for each shape of path (number of segments, and which below the first are empty).
It is decided from the first segment to the last, among the pages under one generalised prefix: segments that vary (digits
in them, or seen once among many siblings) become wildcards, and so do siblings whose labelled share does not differ
significantly from that of the others. A template is rejected when the smoothed share of allowed pages among its labelled
ones is low; one without labelled pages takes the counts of the prefix above it. Pages that a rule decides are the labelled
ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.tables import written

# Verdict, host and path of the rules.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Weight of the share of all labelled pages in a template's share, and the least share that is kept.
PRIOR_WEIGHT, LEAST_SHARE = 4.0, 0.5
#: A segment that stands on one page only varies when its parent has this many pages; branches are merged below this many
#: standard errors.
MANY_SIBLINGS, STANDARD_ERRORS = 20, 2.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(url.contains("://"), F.substring_index(F.regexp_extract(url, "(?s)://(.*)$", 1), "#", 1)).otherwise("")
    rest = F.coalesce(F.substring_index(rest, "?", 1), F.lit(""))
    host = F.translate(F.substring_index(rest, "/", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.substring(rest, F.length(F.substring_index(rest, "/", 1)) + 1, 1 << 30)


def _rule(host: Column, path: Column, value: int) -> Column:
    """Verdict (0) or name (1) of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for verdict, h, p in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.lit((verdict, h + p)[value])).otherwise(out)
    return out


def _named(open_: DataFrame, depth: int) -> DataFrame:
    """``open_`` with the node of segment ``depth`` added to each prefix, and whether the prefix is done.

    A prefix is done at the last segment, and when no segment below can differ from its siblings: with one path,
    or with labelled pages that are all allowed or all blocked.
    """
    family = ["host", "shape", "prefix"]
    open_ = open_.withColumn("segments", F.split("general", "/", -1)).withColumn("segment", F.col("segments")[depth])
    sums = [F.sum(c).alias(c) for c in ("pages", "labelled", "allowed")]
    children = open_.groupBy(*family, "segment").agg(*sums)
    whole = children.groupBy(*family).agg(*[F.sum(c).alias(f"{c}_in") for c in ("pages", "labelled", "allowed")])
    rare = (F.col("pages") == 1) & (F.col("pages_in") >= MANY_SIBLINGS)
    # Two shares differ significantly when they are standard errors of their pooled share apart.
    others, other_allowed = F.col("labelled_in") - F.col("labelled"), F.col("allowed_in") - F.col("allowed")
    pooled = F.when(F.col("labelled_in") > 0, F.col("allowed_in") / F.col("labelled_in"))
    apart = F.col("allowed") / F.col("labelled") - other_allowed / others
    error = pooled * (1 - pooled) * (1 / F.col("labelled") + 1 / others)
    differs = F.when((F.col("labelled") > 0) & (others > 0), apart * apart > STANDARD_ERRORS * STANDARD_ERRORS * error).otherwise(False)
    node = F.when(differs & ~rare, F.col("segment")).otherwise("*")
    if depth:
        node = F.when(F.col("segment") == "", "").otherwise(node)
    chosen = children.join(whole, family).select(*family, "segment", node.alias("node"))
    named = open_.join(chosen, [*family, "segment"]).withColumn("prefix", F.concat("prefix", F.lit("/"), "node"))
    under = named.groupBy(*family).agg(F.sum("labelled").alias("l"), F.sum("allowed").alias("a"), F.count("*").alias("n"))
    rest = F.slice("segments", depth + 2, F.size("segments"))
    ended = (F.size("segments") == depth + 1) | (F.col("n") == 1) | (F.col("a") == 0) | (F.col("a") == F.col("l"))
    below = F.array_join(F.transform(rest, lambda s: F.when(s == "", "").otherwise("*")), "/")
    template = F.when(F.size(rest) > 0, F.concat("prefix", F.lit("/"), below)).otherwise(F.col("prefix"))
    return named.join(under, family).select(
        *family, "general", "pages", "labelled", "allowed",
        F.when(F.col("l") > 0, F.col("l")).otherwise(F.col("held_labelled")).alias("held_labelled"),
        F.when(F.col("l") > 0, F.col("a")).otherwise(F.col("held_allowed")).alias("held_allowed"),
        F.when(ended, template).alias("template"),
    )


def _templates(paths: DataFrame) -> DataFrame:
    """(host, general, template, held_labelled, held_allowed) of distinct paths with their counts.

    The held counts are those of the template, or of the longest prefix above that has labelled pages; they are 0 where not
    even the first node has any. There is a round for each depth down to which some prefix has both allowed and blocked pages.
    """
    first = F.substring_index("general", "/", 1)
    shape = F.regexp_replace(F.substring("general", F.length(first) + 1, 1 << 30), "[^/]+", "x")
    none = F.lit(0).cast("long")
    open_ = paths.withColumns({"shape": shape, "prefix": F.lit(""), "held_labelled": none, "held_allowed": none})
    done, depth = None, 0
    while done is None or not open_.isEmpty():
        named = written(_named(open_, depth), "url_templates")
        ended = named.where("template is not null").select("host", "general", "template", "held_labelled", "held_allowed")
        done = ended if done is None else done.unionByName(ended)
        open_, depth = named.where("template is null").drop("template"), depth + 1
    return done


def judge(pages: DataFrame, ident: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, template, share) of every row of ``pages``.

    A null url and one without ``://`` have an empty host and path and share one template. Rows with null or repeated ids
    are judged alike; every row counts in the shares. An empty table gives no rows; without any labelled page the
    prior share is one half and nothing is rejected. Further columns are not looked at.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(f"`{ident}`").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("ruled", _rule(F.col("host"), F.col("path"), 0)).withColumn("rule", _rule(F.col("host"), F.col("path"), 1))

    # Digits make a segment vary; the tree is worked out over distinct paths.
    varied = F.regexp_replace("path", "[^/]*[0-9][^/]*", "*")
    rows = rows.withColumn("general", F.substring(varied, 2, 1 << 30))
    paths = rows.groupBy("host", "general").agg(
        F.count("*").alias("pages"), F.count("ruled").alias("labelled"), F.count_if(F.col("ruled") == "allow").alias("allowed")
    )
    every = paths.agg(F.sum("labelled").alias("all_labelled"), F.sum("allowed").alias("all_allowed"))
    prior = F.when(F.col("all_labelled") > 0, F.col("all_allowed") / F.col("all_labelled")).otherwise(0.5)
    share = (F.col("held_allowed") + PRIOR_WEIGHT * prior) / (F.col("held_labelled") + PRIOR_WEIGHT)
    nodes = _templates(paths).crossJoin(every).select("host", "general", "template", share.alias("share"))  # one row of totals
    judged = rows.join(nodes, ["host", "general"])
    return judged.select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("share") < LEAST_SHARE, "block").otherwise("allow")).alias("verdict"),
        "template", "share",
    )
