"""URL filters with redirect equivalence: what blocks a page also blocks its aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii
from .components import connected_components


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://, or for null."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return lower_ascii(rest)


def url_path(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty without ://, or for null."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def url_node(url: Column) -> Column:
    """The name of a url among aliases: scheme and host in lower case, without fragment."""
    u = F.coalesce(url, F.lit(""))
    head = F.regexp_extract(u, r"(?s)^(.*?://[^/?#]*)", 1)
    return F.concat(lower_ascii(head), F.substring_index(F.substr(u, F.length(head) + 1), "#", 1))


def link_targets(html: Column, url: Column) -> Column:
    """Absolute targets of canonical links and of meta refreshes in a page; those without a host lead to the page's own."""
    page = F.coalesce(html, F.lit(""))
    tags = F.concat(
        F.regexp_extract_all(page, F.lit(r"(?is)(<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>)"), 1),
        F.regexp_extract_all(page, F.lit(r"(?is)(<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>)"), 1),
    )
    site = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(.*?://[^/?#]*)", 1)
    scheme = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(.*?:)//", 1)

    def target(tag: Column) -> Column:
        found = F.when(tag.rlike(r"(?is)^<link"), F.regexp_extract(tag, r"(?is)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)", 1)).otherwise(F.regexp_extract(tag, r"(?is)\burl\s*=\s*[\"']?\s*([^\"'\s>]+)", 1))
        return F.when(found.contains("://"), found).when(found.startswith("//"), F.concat(scheme, found)).when(found.startswith("/"), F.concat(site, found)).otherwise(F.lit(""))

    return F.filter(F.transform(tags, target), lambda x: x != "")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, allow) for the distinct (host, path) of ``urls`` that a rule (rule_host, rule_path, allow) fits.

    A rule fits its host and all subdomains if the path starts with the rule's; the
    longest rule wins, among equally long ones the allowing one. The rules are joined on each
    host suffix; Spark broadcasts them only if their size is small.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    each = urls.select("host", "path").where("host != ''").distinct().withColumn("rule_host", F.explode(suffixes))
    fits = each.join(rules.select("rule_host", "rule_path", "allow"), "rule_host").where(F.startswith("path", F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    best = F.max(F.struct(F.length(rule).alias("n"), F.col("allow").alias("allow"), rule.alias("rule")))
    return fits.groupBy("host", "path").agg(best.alias("b")).select("host", "path", "b.rule", "b.allow")


def filter_urls(pages: DataFrame, rules: DataFrame, links: DataFrame | None = None, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Each page with host, path, rule and verdict (allow or block).

    A page that a rule fits has that rule's verdict. Any other takes its group's: pages
    and link targets are groups of aliases, the connected components over canonical and
    refresh links, read from ``html`` or given as ``links`` (src, dst: urls, as of a
    crawl's redirects). A group with a member that a rule allows is allowed, even
    if another member is blocked; else a blocked member blocks it; else it is
    allowed. Targets count as members whether or not they are pages. Null urls and urls
    without :// have no host and no group and are allowed. Repeated rows are judged each; of equally long rules the
    allowing one wins; html of any length is searched whole; other columns aren't read.
    """
    parsed = pages.select(F.col(page).alias("page"), F.col(url).alias("url"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    if links is None:
        found = pages.select(F.col(url).alias("src"), F.explode(link_targets(F.col(html), F.col(url))).alias("dst"))
    else:
        found = links.select("src", "dst")
    found = found.where(F.contains("src", F.lit("://")) & F.contains("dst", F.lit("://")))
    groups = connected_components(found.select(url_node(F.col("src")).alias("src"), url_node(F.col("dst")).alias("dst")))
    members = groups.select("node", "component", url_host(F.col("node")).alias("host"), url_path(F.col("node")).alias("path"))
    member_rules = members.join(match_rules(members, rules), ["host", "path"])
    decided = member_rules.groupBy("component").agg(F.when(F.bool_or("allow"), "allow").otherwise("block").alias("group_verdict"))
    passed = groups.join(decided, "component").select("node", "group_verdict")
    ruled = parsed.join(match_rules(parsed, rules), ["host", "path"], "left").withColumn("node", url_node(F.col("url")))
    verdict = F.when(F.col("allow").isNotNull(), F.when(F.col("allow"), "allow").otherwise("block"))
    return ruled.join(passed, "node", "left").select(
        F.col("page").alias(page),
        "host",
        "path",
        "rule",
        F.coalesce(verdict, "group_verdict", F.lit("allow")).alias("verdict"),
    )
