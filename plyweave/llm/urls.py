"""URL filter: fixed rules first, then a path-template tree per host; DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fresh, small_enough, written


def with_host_and_path(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """page_id, host, path. Null or no '://': both empty."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return pages.select(
        "page_id",
        ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"),
    )


def rule_of(rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; both null where none does. rules: (verdict, 'host/path')."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = text.partition("/")
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def shape() -> Column:
    """The path's segments with slashes between them, variable ones as wildcards by their form; empty ones are left out."""

    def kind(x: Column) -> Column:
        return (
            F.when(x.rlike(r"^[0-9]+(\.[A-Za-z0-9]+)?$"), "{n}")
            .when(x.rlike(r"^[0-9a-fA-F-]{8,}$"), "{x}")
            .when(x.rlike(r"[0-9]") & (F.length(x) >= 6), "{s}")
            .otherwise(ascii_lower(x))
        )

    return F.array_join(F.transform(F.filter(F.split("path", "/"), lambda x: x != ""), kind), "/")


def template_tree(groups: DataFrame, max_children: int = 24, z: float = 2.0) -> DataFrame:
    """host, shape, n, lab, bad, template: the tree's leaf for each kind of path.

    groups: host, shape, n, lab (labelled rows), bad (of them rejected). From the root down, a node with more than
    max_children different segments gets one wildcard child; else children whose share of rejected rows is within z
    standard errors of all children's are merged, and the others stay apart. A level is written before the next one is
    made, and the last is the one where every path has ended or is the only one of its node, whose other segments stay
    as they are: so there are as many levels as segments that two kinds of path share, whatever the paths' lengths.
    """
    spark, base = groups.sparkSession, fresh(groups.sparkSession, "levels")
    left, level = groups.withColumn("template", F.lit("")), 0
    while True:
        segs = F.filter(F.split("shape", "/"), lambda x: x != "")
        at = left.withColumn("s", F.coalesce(F.get(segs, F.lit(level)), F.lit("")))
        own = at.groupBy("host", "template", "s").agg(F.count("*").alias("kinds"), F.sum("lab").alias("lab"), F.sum("bad").alias("bad"))
        node = own.groupBy("host", "template").agg(
            F.count("*").alias("children"), F.sum("kinds").alias("all_kinds"), F.sum("lab").alias("all_lab"), F.sum("bad").alias("all_bad")
        )
        share = (F.col("all_bad") + 0.5) / (F.col("all_lab") + 1.0)
        off = F.abs(F.col("bad") - F.col("lab") * share) / F.sqrt(F.col("lab") * share * (1 - share) + 1e-9)
        token = (
            F.when(F.col("s") == "", "")
            .when(F.col("children") > max_children, "/*")
            .when((F.col("children") > 1) & (F.col("lab") > 0) & (off < z), "/~")
            .otherwise(F.concat(F.lit("/"), F.col("s")))
        )
        named = own.join(node, ["host", "template"]).select("host", "template", "s", token.alias("token"), (F.col("all_kinds") == 1).alias("alone"))
        rest = F.concat_ws("", F.transform(F.slice(segs, level + 1, F.greatest(F.size(segs) - level, F.lit(0))), lambda x: F.concat(F.lit("/"), x)))
        to = F.concat("template", F.when(F.col("alone"), rest).otherwise(F.col("token")))
        found = at.join(named, ["host", "template", "s"]).select("host", "shape", "n", "lab", "bad", to.alias("template"), (F.col("alone") | (F.col("s") == "")).alias("done"))
        found.write.parquet(f"{base}/level={level}")
        left = spark.read.schema(found.schema).parquet(f"{base}/level={level}").filter("not done").drop("done")
        if small_enough(left, 0):
            return spark.read.schema(found.schema).parquet(base).filter("done").select("host", "shape", "n", "lab", "bad", "template")
        level += 1


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], strength: float = 4.0, reject_at: float = 0.5, max_children: int = 24) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity for every row of pages.

    Rules decide where one fits, and are the labels of the tree: a template's purity is its share of rejected labelled
    pages, smoothed by strength pages of the host's share, which is itself smoothed by the share of all pages. Pages
    without a rule are blocked from purity reject_at on. Null urls have empty host and path and are judged alike;
    repeated rows give repeated results; other columns are ignored.
    """
    rule, said = rule_of(rules)
    seen = with_host_and_path(pages).select("*", rule.alias("rule"), said.alias("said"), shape().alias("shape"))
    keys = ["host", "shape"]
    groups = seen.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count("said").alias("lab"), F.sum((F.coalesce("said", F.lit("")) == "block").cast("long")).alias("bad")
    )
    groups = written(groups, "groups")  # a row for each kind of path, from one pass over the pages
    tree = template_tree(groups, max_children)
    leaf = tree.groupBy("host", "template").agg(F.sum("lab").alias("lab"), F.sum("bad").alias("bad"))
    hosts = leaf.groupBy("host").agg(F.sum("lab").alias("h_lab"), F.sum("bad").alias("h_bad"))
    base = groups.agg((F.sum("bad") + 0.5) / (F.sum("lab") + 1.0)).first()[0] or 0.0  # one number
    host = hosts.select("host", ((F.col("h_bad") + strength * base) / (F.col("h_lab") + strength)).alias("prior"))
    purity = (F.col("bad") + strength * F.col("prior")) / (F.col("lab") + strength)
    judged = leaf.join(host, "host").select("host", "template", purity.alias("purity"))
    by_kind = written(tree.join(judged, ["host", "template"]).select(*keys, "template", "purity"), "kinds")
    verdict = F.coalesce("said", F.when(F.col("purity") >= reject_at, "block").otherwise("allow"))
    return seen.join(by_kind, keys).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
