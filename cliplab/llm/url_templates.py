"""URL filter: explicit rules first, then a path-template tree judged by labelled purity.

Per host, the paths of all urls form a tree of segments.  Runs of digits (and long hexadecimal
names) are one value from the start.  A node with many different children is variable: its children
become one wildcard.  Among the children of other nodes, those whose share of bad labelled urls does
not differ significantly from their siblings' are merged into one branch.  The tree is grown from
its root: what hangs below a wildcard or a merged branch is pooled before it is judged itself.  What
remains are the host's templates.  A template is rejected when its purity, the share of good urls
among its labelled ones, smoothed towards the host's and the host's towards the corpus's, is below a
floor.

Everything after the first aggregate runs on counts by (host, generalised path), not on urls; all
joins are plain equi-joins whose large side Spark can split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliplab.llm.stored import shared_folder, stored

WILD, MERGED, DEEP = "*", "~", "**"
Z = 1.96


def _fold(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no `://`."""
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))
    return _fold(host), path


def rule_for(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null if none fits.

    `rules` maps `host/path` to allow or block, as in `example.net/en/`.  They become one CASE
    expression: meant for up to some thousands; a rule list of corpus size belongs in a table.
    """
    longest = sorted(rules, key=lambda r: (-len(r), r))

    def fits(rule: str) -> Column:
        name, slash, rest = rule.partition("/")
        return ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)

    first = lambda value: reduce(lambda rest, r: F.when(fits(r), F.lit(value(r))).otherwise(rest), reversed(longest), F.lit(None).cast("string"))
    return first(lambda r: r), first(lambda r: rules[r])


def general_segments(path: Column, max_depth: int | None) -> Column:
    """Segments with digit runs and long hexadecimal names as `#`; what lies deeper than max_depth, if given, as one `**`."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    parts = F.transform(parts, lambda s: F.regexp_replace(s, "[0-9a-fA-F]{16,}|[0-9]+", "#"))
    if max_depth is None:
        return parts
    cut = F.concat(F.slice(parts, 1, max_depth), F.array(F.lit(DEEP)))
    return F.when(F.size(parts) > max_depth, cut).otherwise(parts)


def _common(low: Column, high: Column) -> Column:
    """How many first elements the least and the greatest of some arrays share, and so all of them."""
    differs = F.array_position(F.zip_with(low, high, lambda a, b: a.eqNullSafe(b)), False)
    return F.when(differs > 0, differs - 1).otherwise(F.size(low)).cast("int")


def _grown(growing: DataFrame, many: int, share: float) -> DataFrame:
    """One branching of every open node: `names` takes the next names, `rest` loses as many segments."""
    seg = F.element_at("rest", 1)
    children = growing.groupBy("host", "names", seg.alias("seg")).agg(
        F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"), F.min("rest").alias("low"), F.max("rest").alias("high")
    )
    parents = children.groupBy("host", "names").agg(
        F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("all_n"), F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad")
    )
    rest = F.col("all_labelled") - F.col("labelled")
    rate = F.try_divide("all_bad", "all_labelled")
    gap = F.try_divide("bad", "labelled") - F.try_divide(F.col("all_bad") - F.col("bad"), rest)
    error = F.sqrt(rate * (1 - rate) * (F.try_divide(F.lit(1), F.col("labelled")) + F.try_divide(F.lit(1), rest)))
    differs = F.coalesce((F.col("labelled") > 0) & (rest > 0) & (error > 0) & (F.abs(gap) > Z * error), F.lit(False))
    variable = (F.col("kinds") >= many) & (F.col("kinds") >= share * F.col("all_n"))
    # a child that keeps its name is a node of its own: all that its paths share follows at once
    own = F.slice("low", F.lit(1), _common(F.col("low"), F.col("high")))
    added = F.when(variable, F.array(F.lit(WILD))).when((F.col("kinds") == 1) | differs, own).otherwise(F.array(F.lit(MERGED)))
    named = children.join(parents, ["host", "names"]).select("host", "names", "seg", added.alias("added"))
    placed = growing.withColumn("seg", seg).join(named, ["host", "names", "seg"])
    left = F.slice("rest", F.size("added") + 1, F.greatest(F.size("rest") - F.size("added"), F.lit(0)))
    return placed.select("host", "segments", "n", "labelled", "bad", F.concat("names", "added").alias("names"), left.alias("rest"))


def path_templates(paths: DataFrame, many: int = 8, share: float = 0.3) -> DataFrame:
    """Counts by (host, segments): n, labelled, bad -> (host, segments, template).

    One row per distinct (host, segments); no segments give the empty template.  A node is variable
    with at least `many` different children that are at least `share` of its urls.  The tree grows by
    one branching a round, each written to the shared folder; paths that are alone end at once.
    Segments that are spelled like a wildcard or a merged branch count as one.
    """
    spark, folder = paths.sparkSession, shared_folder(paths.sparkSession, "url-templates")
    done = F.size("rest") == 0
    here = paths.select("host", "segments", "n", "labelled", "bad", F.array().cast("array<string>").alias("names"), F.col("segments").alias("rest"))
    i, growing = 0, True
    while growing:
        here.write.parquet(f"{folder}/{i}")
        here = spark.read.schema(here.schema).parquet(f"{folder}/{i}").filter(~done)
        growing = not here.isEmpty()
        here, i = _grown(here, many, share), i + 1
    grown = spark.read.schema(here.schema).parquet(*[f"{folder}/{r}" for r in range(i)]).filter(done)
    return grown.select("host", "segments", F.when(F.size("names") > 0, F.concat(F.lit("/"), F.array_join("names", "/"))).otherwise("").alias("template"))


def judge_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules: dict[str, str],
    smoothing: float = 4.0,
    floor: float = 0.5,
    max_depth: int | None = None,
) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity per row of `pages` (page_id, url).

    `labels` holds (page_id, bad): true for bad, false for good; of several labels of a page bad ones
    win, null labels count as none.  Rows that repeat a page_id are judged and counted each, those
    without one have no label.  Null urls and urls without `://` have empty host and path and the
    empty template.  With no labels at all every url that no rule blocks is allowed.  With
    `max_depth`, branches deeper than that aren't told apart.
    """
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("segments", general_segments(F.col("path"), max_depth))
    marks = labels.filter("bad IS NOT NULL").groupBy(F.col("page_id").alias("__id")).agg(F.max(F.col("bad").cast("int")).alias("bad"))
    marked = rows.select("page_id", "host", "segments").join(marks, F.col("page_id") == F.col("__id"), "left")
    counts = marked.groupBy("host", "segments").agg(
        F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")
    )
    counts = stored(counts, "url-counts")
    templates = counts.join(path_templates(counts), ["host", "segments"])

    totals = counts.agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
    overall = totals.select(F.coalesce(1 - F.try_divide("b", "l"), F.lit(1.0)).alias("p")).scalar()
    smooth = lambda bad, labelled, towards: (F.col(labelled) - F.col(bad) + smoothing * towards) / (F.col(labelled) + smoothing)
    hosts = counts.groupBy("host").agg(F.sum("labelled").alias("hl"), F.sum("bad").alias("hb"))
    hosts = hosts.select("host", smooth("hb", "hl", overall).alias("host_purity"))
    judged = templates.groupBy("host", "template").agg(F.sum("labelled").alias("tl"), F.sum("bad").alias("tb")).join(hosts, "host")
    judged = judged.select("host", "template", smooth("tb", "tl", F.col("host_purity")).alias("purity"))
    by_path = templates.select("host", "segments", "template").join(judged, ["host", "template"])

    rule, ruled = rule_for(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(ruled, F.when(F.col("purity") < floor, "block").otherwise("allow"))
    return rows.join(by_path, ["host", "segments"]).select(
        "page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "template", "purity"
    )
